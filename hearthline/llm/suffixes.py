"""Repeated byte strings by a distributed, common-prefix-aware merge sort of sampled suffixes.

A string of ``length`` bytes at start t holds a window of ``window`` positions, whose least hash marks an anchor; strings
that are equal have it at the same distance from their start.  So only suffixes at anchors are sorted, about two for every
``window`` bytes, each in two forms: the bytes to its right and then those to its left, backwards; and with its left before
its last right part.  Anchors whose first bytes occur nowhere else (told by counting their hashes) are not sorted at all.

Sort: tasks sort their suffixes into runs, keep equal ones once, cut the runs at sampled splitters and send each piece front
coded: the length of the prefix shared with the suffix before it, and the rest.  A task per splitter range decodes its pieces
and merges them in a loser tree that knows every suffix's common prefix with the last winner: the longer one wins without a
look at the bytes, and only on a tie are bytes compared, from the known prefix on.  What comes out is each suffix's longest
common prefix with any other.

For a start that lies l bytes before its anchor a match needs l equal bytes to the left and length - l to the right.  The two
forms decide all starts but those of short matches cut on both sides, whose whole strings are then compared by 128-bit
digests.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, shuffle_partitions

_GRAM, _CHUNK, _RUN_BYTES = 16, 1 << 17, 16 << 20
_RIGHT, _LEFT = b"\x01", b"\x02"
_OWNER = "<16sIQHH"  # document, anchor, hash of its first bytes, least and most distance of its starts
_OWNER_BYTES = struct.calcsize(_OWNER)
_NONE = b"\0" * _OWNER_BYTES


# ------------------------------------------------------------------------------------------------ anchors
def anchors(text: bytes, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text, in order, with the least and the most distance of the starts that they belong to."""
    starts = len(text) - length + 1
    if starts <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    where, low, high = [], [], []
    for at in range(0, starts, _CHUNK):
        n = min(_CHUNK, starts - at)
        size = n + window - 1
        words = np.ndarray((size + 8,), "<u8", text, at, (1,))
        with np.errstate(over="ignore"):
            mixed = words[:-8] * np.uint64(0x9E3779B97F4A7C15) + words[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        # hash above, place below: the least of a window is its first position of least hash
        least = (mixed & np.uint64(0xFFFFFFFF00000000)) | np.arange(size, dtype=np.uint64)
        span = 1
        while 2 * span <= window:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[:n], least[window - span : window - span + n])
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], n) - 1
        where.append(place[first] + at)
        high.append(place[first] - first)
        low.append(place[first] - last)
    where, low, high = np.concatenate(where), np.concatenate(low), np.concatenate(high)
    own = np.flatnonzero(np.diff(where, prepend=-1))  # an anchor whose starts lie in two chunks is one
    return where[own], np.minimum.reduceat(low, own), np.maximum.reduceat(high, own)


def _anchor_rows(length: int, window: int) -> Callable:
    reach = length - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            source, parts, many = [], [], 0
            for i, value in enumerate(batch.column("text")):
                text = value.as_py()
                where, low, high = anchors(text, length, window)
                hashes = np.array([digest(text[a : a + reach]) for a in where.tolist()], np.uint64)
                source.append(np.full(len(where), i))
                parts.append((hashes.view(np.int64), where, low, high))
                many += len(where)
                if many > 200_000 or i == batch.num_rows - 1:
                    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    key = batch.column("key").take(pa.array(np.concatenate(source)))
                    kinds = (pa.int64(), pa.int32(), pa.int16(), pa.int16())
                    yield pa.RecordBatch.from_arrays(
                        [key, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["key", "h", "pos", "low", "high"]
                    )
                    source, parts, many = [], [], 0

    return run


def forms(text: bytes, a: int, length: int, window: int) -> tuple[bytes, bytes]:
    """The two strings an anchor's suffix is sorted by.

    Right form: ``length`` bytes from the anchor, then up to window - 1 bytes to its left, backwards.  Left form: the first
    length - window + 1 bytes, window - 1 bytes to the left, backwards, then the other bytes to the right.  Where a text ends
    too soon for a part to be whole, what would follow it is left out, so that equal places always hold the same part.
    """
    reach = length - window + 1
    right, left = text[a : a + length], text[max(0, a - window + 1) : a][::-1]
    one = _RIGHT + right + (left if len(right) == length else b"")
    two = _LEFT + right[:reach] + left + (right[reach:] if len(left) == window - 1 else b"")
    return one, two


# ------------------------------------------------------------------------------------------------ sorted runs
def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Shared prefix with the string before, and the rest, of sorted strings."""
    shared = [0, *(common_prefix(a, b) for a, b in zip(strings, strings[1:], strict=False))][: len(strings)]
    return shared, [s[c:] for s, c in zip(strings, shared, strict=True)]


def decode(shared: np.ndarray, sizes: np.ndarray, rest: bytes) -> list[bytes]:
    out, at, last = [], 0, b""
    for c, n in zip(shared.tolist(), sizes.tolist(), strict=True):
        last = last[:c] + rest[at : at + n]
        out.append(last)
        at += n
    return out


_PIECE = pa.schema(
    [("part", pa.int32()), ("run", pa.bool_()), ("shared", pa.binary()), ("sizes", pa.binary()), ("rest", pa.binary()), ("owners", pa.binary())]
)
_PIECE_SQL = "part int, run boolean, shared binary, sizes binary, rest binary, owners binary"


def _pieces(items: list[tuple[bytes, bytes]], splitters: list[bytes]) -> Iterator[pa.RecordBatch]:
    """A sorted run's pieces, one row for each splitter range; ``run`` false: owners whose prefix is already known.

    Suffixes of one run that are equal in all their bytes know it here: they stay behind in one entry without owner.
    """
    items.sort()
    strings, owners, known = [], [], []
    i = 0
    while i < len(items):
        j = i + 1
        while j < len(items) and items[j][0] == items[i][0]:
            j += 1
        strings.append(items[i][0])
        owners.append(items[i][1] if j == i + 1 else _NONE)
        if j > i + 1:
            known.extend((o, s) for s, o in items[i:j])
        i = j
    rows = []
    cuts = [0, *(bisect_left(strings, s) for s in splitters), len(strings)]
    for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a < b:
            shared, rest = front_code(strings[a:b])
            sizes = np.array([len(r) for r in rest], "<u2").tobytes()
            rows.append((part, True, np.array(shared, "<u2").tobytes(), sizes, b"".join(rest), b"".join(owners[a:b])))
    for at in range(0, len(known), 5000):
        mine = known[at : at + 5000]
        kinds = b"".join(s[:1] for _, s in mine)
        sizes = np.array([len(s) for _, s in mine], "<u2").tobytes()
        part = xxhash.xxh32_intdigest(mine[0][0]) % (len(splitters) + 1)
        rows.append((part, False, b"", sizes, kinds, b"".join(o for o, _ in mine)))
    columns = list(zip(*rows, strict=True)) or [()] * len(_PIECE)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE, strict=True)], schema=_PIECE)


def _suffixes(batch: pa.RecordBatch, length: int, window: int) -> Iterator[tuple[bytes, bytes]]:
    for key, value, found in zip(*(batch.column(c) for c in ("key", "text", "found")), strict=True):
        key, text = key.as_py(), value.as_py()
        for f in found.as_py():
            owner = struct.pack(_OWNER, key, f["pos"], f["h"] & (2**64 - 1), f["low"], f["high"])
            for form in forms(text, f["pos"], length, window):
                yield form, owner


def _runs(length: int, window: int, splitters: list[bytes]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, size = [], 0
        for batch in batches:
            for item in _suffixes(batch, length, window):
                items.append(item)
                size += len(item[0])
                if size > _RUN_BYTES:
                    yield from _pieces(items, splitters)
                    items, size = [], 0
        yield from _pieces(items, splitters)

    return run


def _samples(length: int, window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_suffixes(batch, length, window))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["suffix", "owner"]
            )

    return run


# ------------------------------------------------------------------------------------------------ merging
def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """``(run, place in it, prefix shared with the suffix before)`` of all suffixes in order.

    A loser tree.  ``near[i]`` is the common prefix of run i's head with the winner that it lost to last.  A challenger comes
    from the run of the last winner, and so do all it meets have lost to that winner: of two, the one that shares more with
    it is smaller, without a look at the bytes.
    """
    count = max(1, len(runs))
    width = 1 << (count - 1).bit_length()
    place, near = [0] * width, [0] * width
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (width - len(runs))
    for i, head in enumerate(heads):
        near[i] = 0 if head is not None else -1
    tree = [0] * (2 * width)

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two heads; the loser learns its common prefix with the winner."""
        if near[a] != near[b]:
            return (a, b) if near[a] > near[b] else (b, a)
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return a, b
        c = common_prefix(x, y, near[a])
        if c == len(x) or (c < len(y) and x[c] < y[c]):
            near[b] = c
            return a, b
        near[a] = c
        return b, a

    best = list(range(width)) if width > 1 else [0]
    level = width
    while level > 1:
        nxt = []
        for k in range(level // 2):
            won, lost = play(best[2 * k], best[2 * k + 1])
            tree[level // 2 + k] = lost
            nxt.append(won)
        best, level = nxt, level // 2
    winner = best[0]
    while heads[winner] is not None:
        strings, shared = runs[winner]
        at = place[winner]
        yield winner, at, near[winner]
        at += 1
        place[winner] = at
        if at < len(strings):
            heads[winner], near[winner] = strings[at], shared[at]
        else:
            heads[winner], near[winner] = None, -1
        node = (winner + width) >> 1
        while node:
            won, lost = play(winner, tree[node])
            tree[node], winner = lost, won
            node >>= 1


_LCP_SQL = "key binary, pos long, h long, low int, high int, one int, two int"


def _merged(splitters: list[bytes], splitter_owners: list[bytes]) -> Callable:
    def rows_of(found: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
        key, pos, h, low, high = list(zip(*(struct.unpack(_OWNER, o) for o, _, _ in found), strict=True)) or [()] * 5
        value = [max(0, c - 1) for _, c, _ in found]  # without the byte that tells the forms apart
        right = [k == _RIGHT for _, _, k in found]
        one = [v if r else None for v, r in zip(value, right, strict=True)]
        two = [None if r else v for v, r in zip(value, right, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(key, pa.binary()), pa.array(pos, pa.int64()), pa.array(np.array(h, np.uint64).view(np.int64)),
                pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(one, pa.int32()), pa.array(two, pa.int32()),
            ],
            ["key", "pos", "h", "low", "high", "one", "two"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, owners, part = [], [], None
        for batch in batches:
            for part_, is_run, shared, sizes, rest, own in zip(*(batch.column(f.name).to_pylist() for f in _PIECE), strict=True):
                part, sizes = part_, np.frombuffer(sizes, "<u2")
                if is_run:
                    shared = np.frombuffer(shared, "<u2")
                    runs.append((decode(shared, sizes, rest), shared.tolist()))
                    owners.append(own)
                else:
                    step = _OWNER_BYTES
                    yield rows_of([(own[step * i : step * (i + 1)], int(n), rest[i : i + 1]) for i, n in enumerate(sizes)])
        if not runs:
            return
        following = splitters[part] if part < len(splitters) else None
        if following is not None:  # the next range starts with this suffix: the last one here is its neighbour
            runs.append(([following], [0]))
            owners.append(splitter_owners[part])
        found, last, kept = [], None, 0
        for r, i, shared in merge(runs):
            owner = owners[r][_OWNER_BYTES * i : _OWNER_BYTES * (i + 1)]
            kind = runs[r][0][i][:1]
            if last is not None:
                if last[0] != _NONE:
                    found.append((last[0], max(kept, shared), last[1]))
                if len(found) >= 50_000:
                    yield rows_of(found)
                    found = []
            last, kept = (owner, kind), shared
        if last is not None and last[0] != _NONE:
            found.append((last[0], kept, last[1]))
        yield rows_of(found)

    return run


# ------------------------------------------------------------------------------------------------ the operator
def _digests(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for key, value, found in zip(*(batch.column(c) for c in ("key", "text", "found")), strict=True):
                text = value.as_py()
                starts = np.unique(np.concatenate([np.arange(f["a"], f["b"] + 1) for f in found.as_py()]))
                for at in range(0, len(starts), 100_000):
                    some = starts[at : at + 100_000]
                    d = pa.array([digest(text[t : t + length]) for t in some.tolist()], pa.binary())
                    keys = pa.array([key.as_py()] * len(some), pa.binary())
                    yield pa.RecordBatch.from_arrays([d, keys, pa.array(some)], ["digest", "key", "start"])

    return run


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that half-open spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for value, found in zip(batch.column("text"), batch.column("found"), strict=True):
            text = value.as_py()
            spans = union_of([(f["a"], f["b"]) for f in found.as_py()])
            edges = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["key", "n_removed", "n_spans", "sha", "kept"]
        )


class Repeats:
    """What repeats in the different texts of a table.  ``texts``: ``key, text`` of those long enough, ``spans``: ``key,
    found`` with the byte spans covered by a string of ``length`` bytes that starts in two places."""

    def __init__(self, rows: DataFrame, work: Work, length: int, window: int, item_parts: int = 10_000):
        """``rows``: ``key`` (16 bytes that identify the text) and ``text`` (bytes)."""
        if not _GRAM + window - 1 <= length:
            raise ValueError("a window has to fit into a string")
        spark = rows.sparkSession
        self.work, self.table = work, f"repeats_{uuid.uuid4().hex}"
        different = rows.where(F.length("text") >= length).dropDuplicates(["key"]).select("key", "text")
        # Bucketed by key, so that later joins with the texts move only what is joined to them.
        different.write.option("compression", "zstd").option("path", f"{work.root}/texts").bucketBy(
            shuffle_partitions(spark), "key"
        ).saveAsTable(self.table)
        self.texts = spark.table(self.table)
        self.spans = self._find(length, window, item_parts)

    def with_texts(self, rows: DataFrame, *fields: str) -> DataFrame:
        """Texts that have ``rows``, with all of a text's rows as one array ``found``."""
        grouped = rows.groupBy("key").agg(F.collect_list(F.struct(*fields)).alias("found"))
        return self.texts.join(grouped.hint("shuffle_hash"), "key")

    def _find(self, length: int, window: int, item_parts: int) -> DataFrame:
        spark, work, reach = self.texts.sparkSession, self.work, length - window + 1
        marks = self.texts.mapInArrow(_anchor_rows(length, window), "key binary, h long, pos int, low short, high short")
        marks = work.put(marks, "anchors")
        # Counts are written before they are joined: a join of two plain shuffles is one that Spark can split at a hot hash.
        twice = work.put(marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "twice")
        hits = work.put(marks.join(twice, "h", "left_semi"), "hits")
        work.free(marks, twice)

        # Splitters: about 32 sampled suffixes a range, of which Spark's range partitioner picks one for each.
        many = 2 * hits.count()
        parts = max(shuffle_partitions(spark), many // item_parts)
        rate = max(1, many // (parts * 64))
        sample = hits.where(F.pmod(F.xxhash64("key", "pos"), F.lit(rate)) == 0)
        sample = self.with_texts(sample, "pos", "h", "low", "high").mapInArrow(_samples(length, window), "suffix binary, owner binary")
        sample = work.put(sample.groupBy("suffix").agg(F.min("owner").alias("owner")), "samples")  # equal ones can't be told apart
        firsts = sample.repartitionByRange(parts, "suffix").groupBy(F.spark_partition_id()).agg(F.min(F.struct("suffix", "owner")).alias("s"))
        picked = sorted((bytes(r[0]["suffix"]), bytes(r[0]["owner"])) for r in firsts.select("s").collect())  # one a range
        splitters, owners = [p[0] for p in picked], [p[1] for p in picked]

        pieces = self.with_texts(hits, "pos", "h", "low", "high").mapInArrow(_runs(length, window, splitters), _PIECE_SQL)
        pieces = pieces.repartitionById(len(splitters) + 1, F.col("part"))
        lcps = pieces.mapInArrow(_merged(splitters, owners), _LCP_SQL)
        lcps = lcps.groupBy("key", "pos").agg(
            F.first("h").alias("h"), F.first("low").alias("low"), F.first("high").alias("high"), F.max("one").alias("one"), F.max("two").alias("two")
        )

        # Starts l bytes before the anchor that the forms show to repeat, and those that could.
        n, side = F.lit(length), F.lit(window - 1)
        left = F.least(F.col("two") - F.lit(reach), side)
        far = F.least(F.col("one"), n)
        lcps = lcps.select(
            "*",
            F.least(F.col("high"), F.col("one") - n).alias("r_to"),  # from low
            F.greatest(F.col("low"), n - (F.col("two") - side)).alias("l_from"),  # to high, if the left is whole
            F.greatest(F.col("low"), n - far).alias("c_from"),
            F.least(F.col("high"), left).alias("c_to"),
        )
        lcps = work.put(lcps.withColumn("l_from", F.when(F.col("two") >= F.lit(reach) + side, F.col("l_from")).otherwise(F.lit(1 << 20))), "prefixes")
        known = lcps.select("key", (F.col("pos") - F.col("r_to")).alias("a"), (F.col("pos") - F.col("low") + n).alias("b")).where(
            "r_to >= low"
        ).unionByName(
            lcps.select("key", (F.col("pos") - F.col("high")).alias("a"), (F.col("pos") - F.col("l_from") + n).alias("b")).where("l_from <= high")
        )
        # Undecided: could repeat, above what the right form and below what the left form shows.
        open_from = F.greatest(F.col("c_from"), F.col("r_to") + 1)
        open_to = F.least(F.col("c_to"), F.col("l_from") - 1)
        unsure = lcps.where(open_from <= open_to).groupBy("h").agg(F.min(open_from).alias("o_from"), F.max(open_to).alias("o_to"))
        probes = lcps.join(work.put(unsure, "unsure"), "h").select(
            "key",
            (F.col("pos") - F.least("c_to", "o_to")).alias("a"),
            (F.col("pos") - F.greatest("c_from", "o_from")).alias("b"),
        ).where("a <= b")
        probes = work.put(probes, "probes")
        starts = work.put(self.with_texts(probes, "a", "b").mapInArrow(_digests(length), "digest binary, key binary, start long"), "digests")
        both = work.put(starts.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "both")
        found = starts.join(both, "digest", "left_semi").select("key", F.col("start").alias("a"), (F.col("start") + n).alias("b"))
        return work.put(known.unionByName(found), "spans")

    def drop(self) -> None:
        """Remove the table of texts, once what is derived from it is written."""
        self.texts.sparkSession.sql(f"drop table if exists {self.table}")
        self.work.remove("texts")

    def without(self) -> DataFrame:
        """``key, n_removed, n_spans, sha, kept`` of the texts that lose bytes."""
        return self.with_texts(self.spans, "a", "b").mapInArrow(
            _without, "key binary, n_removed long, n_spans long, sha string, kept string"
        )


def remove_repeats(docs: DataFrame, length: int = 400, window: int = 200, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes, n_removed, n_spans, kept_sha256, kept`` (the text that is left).

    A byte goes if a string of ``length`` bytes covers it that also starts elsewhere, in another row or the same; strings are
    judged as they come, matches never cross rows, and overlaps count.  ``kept_sha256`` is that of the bytes left; ``kept`` is
    without the rest of a character that was cut.  Equal texts are sorted once: all their bytes repeat if they are long enough.
    A null text is empty.  Null and repeated ids, repeated rows and other columns make no difference to what repeats; columns
    of ``docs`` stay, but for those named as above; an empty table gives no row.
    """
    work = Work(docs.sparkSession, "suffixes")
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    carried = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), text.alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256)).withColumn("key", F.unhex(F.substring("sha", 1, 32)))
    repeats = Repeats(rows.select("key", "text"), work, length, window)
    changed = work.put(repeats.without(), "changed")
    repeats.drop()
    copies = rows.where(F.length("text") >= length).groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    info = work.put(changed.join(copies, "key", "full"), "info")  # one row a text
    n_bytes = F.length("text").cast("long")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    joined = rows.join(info.withColumnRenamed("sha", "kept_sha"), "key", "left")
    gone = F.col("copies") > 1

    def chosen(whole, part, same):
        return F.when(gone, whole).when(F.col("n_removed").isNotNull(), part).otherwise(same)

    return joined.select(
        *(F.col("row").getField(c).alias(c) for c in carried),
        n_bytes.alias("n_bytes"),
        chosen(n_bytes, F.col("n_removed"), F.lit(0)).alias("n_removed"),
        chosen(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        chosen(nothing, F.col("kept_sha"), F.col("sha")).alias("kept_sha256"),
        chosen(F.lit(""), F.col("kept"), F.col("text").cast("string")).alias("kept"),
    )
