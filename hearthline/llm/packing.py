"""Best-fit packing by large-item matching.

Lengths are whole numbers up to the capacity, so the corpus is described by one count for each length.  The packing is
worked out on those counts (at most ``capacity`` of them, whatever the corpus holds) and gives ranges: pieces number
r0 to r1 of a length go to bins b0 to b1 at one offset.  Spark then numbers the pieces of each length across tasks and
every piece looks up its own place, so nothing but counts meets in one task and no bin is limited to one partition.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, offsets_by_task, task_id
from .tokens import END_ID, cuts, encoder

#: For each length: (first rank, bins, first bin, offset) of ranges of pieces.
Plan = dict[int, list[tuple[int, int, int, int]]]


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[Plan, int]:
    """Where the pieces of each length go, and the number of bins.

    Pieces above a third of the capacity: at most two share a bin, so the longest left is matched with the longest one
    that still fits beside it, which gives as many pairs as there can be.  Then shorter pieces, longest first, go to the
    smallest gap that holds them; where none does, new bins are filled with that length.
    """
    left = {s: int(n) for s, n in counts.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan: Plan = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first bin, bins)
    open_gaps: list[int] = []
    bins = 0

    def put(s: int, n: int, first: int, offset: int) -> None:
        plan[s].append((used[s], n, first, offset))
        used[s] += n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                open_gaps.insert(bisect_left(open_gaps, gap), gap)
            gaps[gap].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    for s in reversed(large):
        while left[s]:
            at = bisect_left(large, min(s, capacity - s) + 1) - 1
            while at >= 0 and left[large[at]] < 1 + (large[at] == s):
                at -= 1
            if at < 0:
                n, mate = left[s], 0
            else:
                mate = large[at]
                n = left[s] // 2 if mate == s else min(left[s], left[mate])
            put(s, n, bins, 0)
            left[s] -= n
            if mate:
                put(mate, n, bins, s)
                left[mate] -= n
            leave(capacity - s - mate, bins, n)
            bins += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(open_gaps, s)
            if at < len(open_gaps):
                gap = open_gaps[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(at)
                take = min(n, left[s])
                put(s, take, first, capacity - gap)
                left[s] -= take
                leave(gap, first + take, n - take)
                leave(gap - s, first, take)
                continue
            each = capacity // s
            for n, deep in ((left[s] // each, each), (1, left[s] % each)):
                if n and deep:
                    for layer in range(deep):
                        put(s, n, bins, layer * s)
                    leave(capacity - deep * s, bins, n)
                    bins += n
            left[s] = 0
    return dict(plan), bins


def _cutter(capacity: int, end_id: int, vocabulary: str | None, ranks: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(vocabulary, ranks), task_id()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            source, rows = [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    source.append(i)
                    rows.append((piece, start, length, zlib.crc32(ids[start : start + length]), task, int(seen[length])))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    return run


def _placer(plan: Plan) -> Callable:
    tables = {s: np.array(sorted(ranges), np.int64).T for s, ranges in plan.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            place = np.zeros((2, len(length)), np.int64)
            for s in np.unique(length):
                mine = np.flatnonzero(length == s)
                first_rank, _, first_bin, offset = tables[int(s)]
                at = np.searchsorted(first_rank, rank[mine], "right") - 1
                place[0, mine] = first_bin[at] + rank[mine] - first_rank[at]
                place[1, mine] = offset[at]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(place[0]), pa.array(place[1])], [*names, "sequence_id", "offset"]
            )

    return run


def pack(
    docs: DataFrame,
    capacity: int = 1024,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    ranks: str | None = None,
) -> DataFrame:
    """Every document's pieces with their place in sequences of at most ``capacity`` tokens.

    Columns: ``doc_id`` (type of ``id_col``), ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.
    A document is its token ids and then ``end_id``; only longer ones are cut, the first piece takes what is left over.
    A null or empty text is ``end_id`` alone.  Null ids, repeated ids and repeated rows are packed as they come, one set of
    pieces a row; other columns play no part; an empty table gives no row.
    """
    spark = docs.sparkSession
    work = Work(spark, "packing")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = work.put(
        rows.mapInArrow(_cutter(capacity, end_id, vocabulary, ranks), f"{schema}, task long, nth long"), "pieces"
    )
    counts = work.put(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    totals = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    plan, _ = plan_bins(totals, capacity)
    base = offsets_by_task(counts, ["length"]).drop("n")
    ranked = pieces.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.mapInArrow(_placer(plan), f"{schema}, sequence_id long, offset long")
