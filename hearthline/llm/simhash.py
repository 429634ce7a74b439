"""SimHash near-duplicates through an inverted index of positional bytes.

Two 64-bit fingerprints at no more than four differing bits differ in at most four of their eight bytes, so at least four
positions hold equal bytes: the guaranteed minimum of matches.  Posting lists are kept for triples of positions, chosen so
that any four positions contain one of the triples (a Turan system of 20 triples); a list then holds 2^-24 of evenly spread
fingerprints instead of 2^-8.  For two fingerprints of a list the shared positional bytes are tallied, pairs that reach
the minimum are kept, each at its first shared triple only, and the differing bits decide.

Only different fingerprints are indexed, so a group of copies is one entry.  Lists longer than a tile are compared tile
against tile, spread over tasks, which give back spanning stars of what the links connect instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, _forest, components

BYTES, SEED = 8, 42


def triples() -> list[tuple[int, int, int]]:
    """Triples of the eight positions such that any four positions contain one of them.

    Positions fall into three classes in a ring; a triple lies within a class, or has two of a class and one of the next.
    Of four positions, two at least share a class, and a count of cases always leaves such a triple.
    """
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    within = [t for t in combinations(range(BYTES), 3) if len({group[p] for p in t}) == 1]
    across = [
        t
        for t in combinations(range(BYTES), 3)
        for g in range(3)
        if sorted(group[p] for p in t) == sorted((g, g, (g + 1) % 3))
    ]
    return within + across


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; zero where there is no word."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and splits at 0x20 and 0x09-0x0D only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    stops = ends[width - 1 :].tolist()
    for at in range(0, n, 65536):
        h = [digest(line[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536], strict=True)]
        bits = np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _fingerprints(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(v.as_py(), width) for v in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return run


def _tiles(limit: int) -> Callable:
    """What links between the two tiles of a group connect, as spanning stars."""

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        mine = table.column("own").to_numpy(zero_copy_only=False)
        i, j = keys[1].as_py(), keys[2].as_py()
        left, right = fp[mine == i], fp[mine == j]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(left), 64):
            part = left[at : at + 64, None] ^ right[None, :]
            rows, cols = np.nonzero((np.bitwise_count(part) <= limit) & (part != 0))
            found.append((left[at + rows], right[cols]))
        a = np.concatenate([f[0] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64)
        b = np.concatenate([f[1] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64)
        edges = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        return pa.Table.from_batches(list(_forest(iter([edges]))), pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def near_links(prints: DataFrame, work: Work, bits: int = 4, tile: int = 256) -> DataFrame:
    """``a, b``: pairs that connect just those fingerprints (``fp``, distinct) that links of ``bits`` or fewer bits connect."""
    if bits > 4:
        raise ValueError("four shared bytes are guaranteed for up to four differing bits")
    shapes = triples()
    masks = [sum(0xFF << (8 * p) for p in t) for t in shapes]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(masks)))
    postings = prints.select("fp", F.explode(keys).alias("key")).select("fp", "key.k", "key.v")
    sizes = work.put(postings.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1"), "lists")

    # Lists of up to a tile: joined with themselves.
    short = sizes.where(F.col("n") <= tile).select("k", "v")
    mine = postings.join(short, ["k", "v"])
    a, b = mine.select("k", "v", F.col("fp").alias("a")), mine.select("k", "v", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    shared = [F.when(differ.bitwiseAND(F.lit(0xFF << (8 * p) if p < 7 else -(1 << 56))) == 0, 1).otherwise(0) for p in range(BYTES)]
    tally = sum(shared[1:], shared[0])
    first = F.coalesce(*(F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(k)) for k, m in enumerate(masks)))
    pairs = (
        a.join(b, ["k", "v"])
        .where("a < b")
        .where((tally >= BYTES - bits) & (F.bit_count(differ) <= bits) & (first == F.col("k")))
        .select("a", "b")
    )

    # Longer lists: members are dealt to tiles by hash, every pair of tiles is one small comparison.
    long = sizes.where(F.col("n") > tile).select("k", "v", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    dealt = postings.join(long, ["k", "v"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = dealt.withColumn("other", other).select(
        F.xxhash64("k", "v").alias("list"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp"
    )
    tiled = dealt.groupBy("list", "i", "j").applyInArrow(_tiles(bits), "a long, b long")
    return pairs.unionByName(tiled)


def near_duplicates(
    docs: DataFrame, bits: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) ``, component_id`` of every row.

    Fingerprints at ``bits`` or fewer differing bits link; ``component_id`` is the smallest ``doc_id`` reachable.  A text
    that is null or has no word has fingerprint zero, which links like any other.  A row with a null id is linked through
    its text but names no component; if no row of a component has an id, it is null.  Repeated rows are kept.  Other
    columns play no part, and an empty table gives no row.
    """
    work = Work(docs.sparkSession, "simhash")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    marked = work.put(rows.mapInArrow(_fingerprints(width), "doc_id long, fp long"), "fingerprints")
    prints = work.put(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(near_links(prints.select("fp"), work, bits), work)
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = work.put(rooted.join(lowest, "root").select("fp", "component_id"), "components")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
