"""Training-order materialisation: every token sequence has a global slot and lies at a computable place in a shard.

The slot of sequence i is a keyed Feistel permutation of 0..n-1 (with cycle-walking for an n that is no power of four), so
the order is a shuffle that needs no sort key to be stored, and ``slot -> i`` can be undone with the key alone.  Shard s
holds slots s*per_shard on, in order, each as a record of the same size, so a reader resumes anywhere by one seek.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, offsets_by_task, open_folder, task_id, write_once
from .tokens import END_ID, encoder

_ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _keys(key: int) -> list[int]:
    return [(key * 0x100000001B3 + (r + 1) * 0xD1342543DE82EF95) & (2**64 - 1) for r in range(_ROUNDS)]


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Slots of ``index`` (whole numbers in 0..n-1), or their indices with ``inverse``.

    A balanced Feistel network permutes 0..4^h-1, the least such range that holds n; what lands at n or above is sent
    through it again until it is below n, which keeps the map a permutation of 0..n-1.
    """
    half = np.uint64(max(1, ((max(n, 1) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = _keys(key)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        return (left << half) | right

    with np.errstate(over="ignore"):
        out = once(np.asarray(index).astype(np.uint64))
        while len(far := np.flatnonzero(out >= n)):
            out[far] = once(out[far])
    return out.astype(np.int64)


def _cutter(length: int, end_id: int, dtype: str, vocabulary: str | None, ranks: str | None) -> Callable:
    """Sequences of ``length`` ids from a task's documents, one behind the other; the task's last one is filled with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, nth = encoder(vocabulary, ranks), task_id(), 0
        room = np.zeros(length, dtype)
        filled, inside, kind = 0, [], None

        def sequence() -> tuple[bytes, list]:
            nonlocal filled, inside, nth
            row = (room.tobytes(), inside)
            room[:] = 0
            filled, inside, nth = 0, [], nth + 1
            return row

        def batch_of(rows: list[tuple[bytes, list]]) -> pa.RecordBatch:
            part = pa.struct([("doc_id", kind), ("piece", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(part)),
                    pa.array(np.full(len(rows), task)), pa.array(np.arange(nth - len(rows), nth)),
                ],
                ["ids", "parts", "task", "nth"],
            )

        for batch in batches:
            kind = batch.schema.field(0).type
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(end_id))
                if ids.max() > np.iinfo(dtype).max:
                    raise ValueError(f"a token id does not fit {dtype}")
                at, piece = 0, 0
                while at < len(ids):
                    n = min(length - filled, len(ids) - at)
                    room[filled : filled + n] = ids[at : at + n]
                    inside.append({"doc_id": doc_id, "piece": piece, "start": filled, "length": n})
                    filled, at, piece = filled + n, at + n, piece + 1
                    if filled == length:
                        rows.append(sequence())
            yield batch_of(rows)
        if filled:
            yield batch_of([sequence()])

    return run


def _slots(n: int, key: int, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permute(batch.column("sequence").to_numpy(zero_copy_only=False), n, key)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(slot)], [*names, "slot"])

    return run


def _parcels(n: int, key: int, per_shard: int) -> Callable:
    """A batch's sequences by shard: their slots and, compressed together, their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=9)  # every id is shuffled once, so bytes count for more than time
        for batch in batches:
            slot = permute(batch.column("sequence").to_numpy(zero_copy_only=False), n, key)
            shard, bodies = slot // per_shard, batch.column("ids")
            order = np.argsort(shard, kind="stable")
            names, first = np.unique(shard[order], return_index=True)
            rows = []
            for name, mine in zip(names, np.split(order, first[1:]), strict=True):
                body = b"".join(bodies[int(i)].as_py() for i in mine)
                rows.append((int(name), slot[mine].astype("<i8").tobytes(), len(body), codec.compress(body, asbytes=True)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int32(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "slots", "size", "ids"]
            )

    return run


def _writer(folder: str, per_shard: int, stride: int) -> Callable:
    """A shard's file: every parcel's sequences put at their slots' places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, shard, count = np.zeros((per_shard, stride), np.uint8), None, 0
        for batch in batches:
            for shard_, slots, size, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                shard, slots = shard_, np.frombuffer(slots, "<i8")
                body = pa.decompress(ids, size, "zstd", asbytes=True)
                place[slots - shard * per_shard] = np.frombuffer(body, np.uint8).reshape(len(slots), stride)
                count += len(slots)
        if shard is None:
            return
        name, size = write_once(folder, f"shard-{shard:08d}", iter([place[:count].tobytes()]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([name]), pa.array([shard * per_shard]), pa.array([count]), pa.array([size])],
            ["shard", "file", "first_slot", "records", "bytes"],
        )

    return run


def _reader(folder: str, stride: int, block: int = 4096) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(folder)
        for batch in batches:
            for shard, name, first, begin, end in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                with files.open_input_file(f"{path}/{name}") as file:
                    file.seek((begin - first) * stride)
                    for at in range(begin, end, block):
                        n = min(block, end - at)
                        body = file.read(n * stride)
                        slot = np.arange(at, at + n)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(slot), pa.array(np.full(n, shard)), pa.array((slot - first) * stride),
                                pa.array([body[i * stride : (i + 1) * stride] for i in range(n)], pa.binary()),
                            ],
                            ["slot", "shard", "offset", "ids"],
                        )

    return run


def read_slots(
    spark: SparkSession, folder: str, manifest: DataFrame, length: int, dtype: str = "<u2", first: int = 0, last: int | None = None
) -> DataFrame:
    """``slot, shard, offset, ids`` (little-endian bytes) of slots ``first`` to ``last`` (not included).

    One seek into each shard that has any of them, whatever was read before: a stopped reader goes on at its next slot.
    """
    end = F.col("first_slot") + F.col("records")
    rows = manifest.select(
        "shard", "file", "first_slot",
        F.greatest(F.col("first_slot"), F.lit(first)).alias("begin"),
        (end if last is None else F.least(end, F.lit(last))).alias("end"),
    ).where("begin < end")
    rows = rows.repartition(max(1, manifest.count()))  # a task for each shard
    return rows.mapInArrow(_reader(folder, length * np.dtype(dtype).itemsize), "slot long, shard long, offset long, ids binary")


def write_training_order(
    docs: DataFrame,
    length: int = 1024,
    key: int = 20240522,
    per_shard: int = 8192,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    ranks: str | None = None,
    dtype: str = "<u2",
) -> tuple[DataFrame, DataFrame, str]:
    """Write the shards; returns (parts, manifest, folder).

    ``parts``: ``doc_id, piece, start, length, sequence, slot``, where each piece of a document lies in a sequence;
    ``manifest``: the complete shard files ``shard, file, first_slot, records, bytes``; files that it does not name are
    left-overs of lost attempts.  A document is its ids and ``end_id``; documents of a task follow one another and every
    ``length`` ids are a sequence, the last one of a task filled with zeros.  A null or empty text is ``end_id`` alone; rows
    with null or repeated ids are documents of their own; other columns play no part; an empty table gives no shard.
    """
    spark = docs.sparkSession
    work = Work(spark, "token-output")
    folder = f"{work.root}/shards"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    cut = rows.mapInArrow(
        _cutter(length, end_id, dtype, vocabulary, ranks),
        f"ids binary, parts array<struct<doc_id: {kind}, piece: int, start: int, length: int>>, task long, nth long",
    )
    cut = work.put(cut, "sequences")
    counts = work.put(cut.groupBy("task").agg(F.count("*").alias("n")), "counts")
    base = offsets_by_task(counts, []).select("task", "base")
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-n // per_shard))
    numbered = cut.join(base, "task").withColumn("sequence", F.col("base") + F.col("nth"))
    parcels = numbered.select("sequence", "ids").mapInArrow(_parcels(n, key, per_shard), "shard int, slots binary, size long, ids binary")
    manifest = parcels.repartitionById(shards, F.col("shard")).mapInArrow(
        _writer(folder, per_shard, length * np.dtype(dtype).itemsize), "shard long, file string, first_slot long, records long, bytes long"
    )
    manifest = work.put(manifest, "manifest")
    parts = numbered.select(F.explode("parts").alias("p"), "sequence").select("p.*", "sequence")
    names = ["doc_id", "piece", "start", "length", "sequence"]
    parts = parts.mapInArrow(_slots(n, key, names), f"doc_id {kind}, piece int, start int, length int, sequence long, slot long")
    parts = work.put(parts, "parts")
    work.free(cut, counts)
    return parts, manifest, folder


def _checksums(folder: str, stride: int, dtype: str, names: list[str]) -> Callable:
    """Place and checksum of parts, all of one shard, whose file is read in one go."""
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(folder)
        opened, body = None, b""
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("file", "first_slot", "slot", "start", "length")]
            offset, crc = [], []
            for file, first, slot, start, n in zip(*columns, strict=True):
                if file != opened:
                    with files.open_input_file(f"{path}/{file}") as source:
                        opened, body = file, source.read()
                offset.append((slot - first) * stride)
                at = offset[-1] + start * width
                crc.append(zlib.crc32(body[at : at + n * width]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(offset, pa.int64()), pa.array(crc, pa.int64())], [*names, "offset", "ids_crc32"]
            )

    return run


def materialised(docs: DataFrame, length: int = 1024, per_shard: int = 8192, dtype: str = "<u2", **options) -> DataFrame:
    """Write the shards, read them back, and tell for every piece where it lies and what was read there.

    ``doc_id, piece, start, length, sequence, slot, shard, offset, ids_crc32``: ``offset`` is the byte in the shard at which
    the sequence starts, ``start`` the id within it, and the checksum is of the piece's ids in the shard.
    """
    parts, manifest, folder = write_training_order(docs, length, per_shard=per_shard, dtype=dtype, **options)
    shards = max(1, manifest.count())
    placed = parts.withColumn("shard", F.floor(F.col("slot") / F.lit(per_shard)).cast("long"))
    placed = placed.repartitionById(shards, F.col("shard").cast("int")).join(
        F.broadcast(manifest.select("shard", "file", "first_slot")) if shards <= 10_000 else manifest.select("shard", "file", "first_slot"), "shard"
    )
    kind = parts.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "sequence", "slot", "shard"]
    return placed.mapInArrow(
        _checksums(folder, length * np.dtype(dtype).itemsize, dtype, names),
        f"doc_id {kind}, piece int, start int, length int, sequence long, slot long, shard long, offset long, ids_crc32 long",
    )
