"""WARC archives: one gzip member per record, read in byte ranges.

Writing: records of equal payload are written once; the others become ``revisit`` records that name it.  Reading: a file is
cut into byte ranges; a task looks for gzip magic from the start of its range, takes a candidate for a member if it decodes
to a WARC header with a whole record behind it, and owns the records that start inside the range, whose end may lie beyond.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, open_folder, task_id, write_once

#: Fixed values of the format.
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
_RECORD_ID = re.compile(r"<urn:x-page:(-?\d+|none)>")
_READ = 1 << 20
_CONTROLS = dict.fromkeys(range(32)) | {127: None}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 3) -> bytes:
    """One gzip member: a response with its payload, or a revisit, which has the digest but no payload."""
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit")]
    head.append(b"WARC-Record-ID: " + _name(page_id).encode())
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.translate(_CONTROLS).encode())
    head.append(b"WARC-Payload-Digest: sha1:" + digest(payload).encode())
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        block = status + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        head.append(b"WARC-Refers-To: " + _name(refers_to).encode())
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        block = status + b"\r\n"
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class _Bytes:
    """A file's bytes from a place on, read ahead in blocks; what lies behind is dropped."""

    def __init__(self, file, at: int):
        self.file, self.base, self.data = file, at, b""

    def fill(self, upto: int) -> None:
        while self.base + len(self.data) < upto:
            self.file.seek(self.base + len(self.data))
            more = self.file.read(max(_READ, upto - self.base - len(self.data)))
            if not more:
                return
            self.data += more

    def drop(self, upto: int) -> None:
        if upto - self.base > 4 * _READ:
            self.data, self.base = self.data[upto - self.base :], upto

    def find(self, start: int, end: int) -> int:
        """Place of the next magic that starts in start..end-1, or -1."""
        spare = len(MAGIC) - 1
        while start < end:
            self.fill(start + _READ)
            stop = min(end + spare, self.base + len(self.data))
            at = self.data.find(MAGIC, start - self.base, stop - self.base)
            if at >= 0:
                return self.base + at
            if stop == end + spare or stop - start <= spare:
                return -1
            start = stop - spare
        return -1

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The decoded record of a member that starts here and the place behind it; None if there is none."""
        packer, out, place, start = zlib.decompressobj(31), [], at, b""
        try:
            while not packer.eof:
                self.fill(place + 1)
                most = _READ if start == VERSION else 512  # a short look decides on candidates that are no records
                block = self.data[place - self.base : place - self.base + most]
                if not block:
                    return None
                out.append(packer.decompress(block))
                place += len(block) - len(packer.unused_data)
                start = (start + out[-1])[: len(VERSION)]
                if not VERSION.startswith(start):
                    return None
        except zlib.error:
            return None
        return (b"".join(out), place) if start == VERSION else None


def parse(whole: bytes) -> dict | None:
    """Headers and block of a decoded record; None unless the block is as long as its header says."""
    head, gap, rest = whole.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip()
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError):
        return None
    if not gap or len(rest) != length + 4 or not rest.endswith(b"\r\n\r\n"):
        return None
    return {"fields": fields, "block": rest[:length]}


def records_in(file, begin: int, end: int) -> Iterator[tuple[int, dict]]:
    """Offset and content of the records that start in begin..end-1."""
    data, at = _Bytes(file, begin), begin
    while (at := data.find(at, end)) >= 0:
        found = data.member(at)
        content = parse(found[0]) if found else None
        if content is None:
            at += 1
        else:
            yield at, content
            at = found[1]
        data.drop(at)


# ------------------------------------------------------------------------------------------------ Spark
def _writer(folder: str, level: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [0]

        def members() -> Iterator[bytes]:
            for batch in batches:
                columns = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to")]
                for page_id, url, payload, refers_to in zip(*columns, strict=True):
                    count[0] += 1
                    yield record(page_id.as_py(), url.as_py(), payload.as_py() or b"", refers_to.as_py(), level)

        blocks = members()
        head = next(blocks, None)
        if head is None:
            return

        def whole() -> Iterator[bytes]:
            yield head
            yield from blocks

        name, size = write_once(folder, f"part-{task_id():06d}.warc.gz", whole())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([count[0]])], ["file", "bytes", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, work: Work, min_bytes: int = 0, level: int = 3) -> DataFrame:
    """Write ``page_id, url, payload`` (binary) rows; returns the manifest ``file, bytes, records`` of complete files.

    Which records are revisits is found on digests alone and joined back by page, so payloads of a group of copies never
    meet in one task.
    """
    marked = pages.withColumn("payload", F.coalesce("payload", F.lit(b""))).withColumn("sha", F.sha1("payload"))
    ids = work.put(marked.where(F.col("page_id").isNotNull()).where(F.length("payload") >= min_bytes).select("page_id", "sha"), "digests")
    top = ids.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = work.put(ids.join(top, "sha").where("page_id < refers_to").distinct(), "revisits")
    rows = marked.join(again, ["page_id", "sha"], "left").select("page_id", "url", "payload", "refers_to")
    manifest = work.put(rows.mapInArrow(_writer(folder, level), "file string, bytes long, records long"), "manifest")
    work.free(ids, again)
    return manifest


def _reader(folder: str, with_payload: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(folder)
        schema = pa.schema(
            [("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()),
             ("url", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
             ("payload_bytes", pa.int64()), ("payload", pa.binary())]
        )

        def id_of(value: bytes | None) -> int | None:
            found = _RECORD_ID.fullmatch(value.decode("latin-1")) if value else None
            return int(found[1]) if found and found[1] != "none" else None

        for batch in batches:
            for name, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, size = [], 0
                with files.open_input_file(f"{path}/{name}") as file:
                    for offset, content in records_in(file, begin, end):
                        fields, kind = content["fields"], content["fields"].get("warc-type", b"").decode("latin-1")
                        stated = fields.get("warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")
                        payload = content["block"].partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if payload is not None and digest(payload) != stated:
                            raise ValueError(f"payload of {name} at {offset} does not have the digest it states")
                        url = fields.get("warc-target-uri")
                        rows.append(
                            (name, offset, id_of(fields.get("warc-record-id")), kind, url.decode() if url is not None else None,
                             stated, id_of(fields.get("warc-refers-to")), None if payload is None else len(payload),
                             payload if with_payload else None)
                        )
                        size += len(payload or b"") if with_payload else 0
                        if len(rows) >= 4096 or size > 16 * _READ:
                            yield _batch(rows, schema)
                            rows, size = [], 0
                yield _batch(rows, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read_archives(manifest: DataFrame, folder: str, split_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """Records of the manifest's files: ``file, offset, page_id, record_type, url, payload_digest, refers_to, payload_bytes,
    payload``.  Payload and its size are null for revisits; a response's payload must have the digest it states."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    splits = manifest.where("bytes > 0").select("file", starts.alias("begin"), F.col("bytes").alias("size"))
    splits = splits.select("file", "begin", F.least(F.col("begin") + split_bytes, "size").alias("end"))
    splits = splits.repartition(max(1, splits.count()))
    return splits.mapInArrow(
        _reader(folder, with_payload),
        "file string, offset long, page_id long, record_type string, url string, payload_digest string, refers_to long, "
        "payload_bytes long, payload binary",
    )


def round_trip(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, split_bytes: int = 8 << 20
) -> DataFrame:
    """Write a record per row, read all archives back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Of rows with equal payloads of ``min_bytes`` or more, the one with the largest id is the response (all of them if that id
    repeats), the others revisit it.  A null text is an empty payload; a null url is left out; a row with a null id is always
    a response; repeated rows are records of their own; other columns play no part; an empty table gives no row.
    """
    work = Work(pages.sparkSession, "warc")
    folder = f"{work.root}/archives"
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("binary").alias("payload")
    )
    manifest = write_archives(rows, folder, work, min_bytes)
    read = work.put(read_archives(manifest, folder, split_bytes, with_payload=False).drop("payload"), "records")
    full = read.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("full_bytes"))
    revisits = read.where("record_type = 'revisit'").join(full, "payload_digest")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read.where("record_type = 'response'").select(columns).unionByName(
        revisits.withColumn("payload_bytes", F.col("full_bytes")).select(columns)
    )
