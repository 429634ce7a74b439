"""Embedding near-duplicates by collision counting on one-dimensional projections.

Unit vectors are projected on many orthogonal lines.  On each line the points are sorted and every point opens a window
around itself; how many windows a pair shares is its collision count.  For two vectors at the threshold the difference on a
line is about normal with a known width, so the count that a true pair reaches with the wanted probability is known
beforehand; pairs that reach it are verified by their cosine.

The points are cut into ranges of one line, each written once as a block that tasks read, and only ranges within reach of each
other meet, two by two: the counts of such a pair live in one task, bounded by the range size, and only verified links that join
groups, and numbers of links, leave it.  Work is the number of pairs of ranges in reach, so it grows faster than the input where
vectors do not spread along the line; what is shuffled, held and written grows with the input.
"""

from __future__ import annotations

import bisect
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, components, open_folder, unpacked, usable_vectors, write_once

_SEED = 7
_TOGETHER, _TASKS = 8, 10_000  # blocks that one is compared with in a row; tasks at most


def lines(width: int, many: int) -> np.ndarray:
    """``many`` unit directions, orthogonal in blocks of ``width``."""
    rng, made = np.random.default_rng(_SEED), []
    while sum(len(m) for m in made) < many:
        made.append(np.linalg.qr(rng.normal(size=(width, width)))[0].T)
    return np.concatenate(made)[:many]


def calibrate(cosine: float, width: int, many: int, spread: float, recall: float) -> tuple[float, int]:
    """Half width of a window, and the count that a pair at the threshold reaches with probability ``recall``.

    Such a pair differs by sqrt(2 - 2 cos) in all and by about that over sqrt(width) on a line; a window reaches ``spread``
    times as far.  Nearer pairs collide more often, so the probability holds for them as well.
    """
    half = spread * math.sqrt(max(2 - 2 * cosine, 1e-12) / width)
    p = math.erf(spread / math.sqrt(2))
    tail = 0.0
    for count in range(many, 0, -1):
        tail += math.comb(many, count) * p**count * (1 - p) ** (many - count)
        if tail >= recall:
            return half, count
    return half, 1


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each number of components."""
    widths = pc.binary_length(batch.column("v")).to_numpy() // 8
    for width in np.unique(widths):
        yield int(width), batch.take(pa.array(np.flatnonzero(widths == width)))


def _ranged(cuts: dict[int, np.ndarray]) -> Callable:
    """Adds the range ``own`` of each vector; ``cuts`` has the inner bounds of a width's ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, widths = batch.column("at").to_numpy(), batch.column("width").to_numpy()
            own = np.zeros(len(at), np.int64)
            for width in np.unique(widths).tolist():
                mine = widths == width
                own[mine] = np.searchsorted(cuts.get(width, np.zeros(0)), at[mine], "right")
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("id", "copies", "v", "width")), pa.array(own)], ["id", "copies", "v", "width", "own"])

    return run


def _blocks(folder: str) -> Callable:
    """Writes the vectors of a block into a file: ids, copies, unit vectors."""

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        width, own, part = (k.as_py() for k in keys)
        arrays = (table.column("id").to_numpy(), table.column("copies").to_numpy(), unpacked(table.column("v").to_pylist()))
        name, _ = write_once(folder, f"{width}-{own}-{part}", (np.ascontiguousarray(x).tobytes() for x in arrays))
        return pa.table({"width": pa.array([width], pa.int32()), "own": pa.array([own], pa.int64()), "part": pa.array([part], pa.int64()), "name": [name], "n": pa.array([len(table)], pa.int64())})

    return run


def _read_block(folder: str, name: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    files, at = open_folder(folder)
    with files.open_input_stream(f"{at}/{name}") as f:
        data = f.read()
    n = len(data) // (16 + 8 * width)
    ids, copies = np.frombuffer(data, np.int64, n), np.frombuffer(data, np.int64, n, 8 * n)
    return ids, copies, np.frombuffer(data, np.float64, n * width, 16 * n).reshape(n, width)


def _linked(left: tuple, right: tuple | None, many: int, spread: float, recall: float, cosine: float) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Pairs of ids that connect what links between two blocks do, or within one, and how many links each vector has there.

    Only a link that joins two groups is kept, so there are fewer pairs than vectors, however many links.
    """
    ids, copies, unit = (np.concatenate(x) for x in zip(left, right, strict=True)) if right else left
    first = len(left[0]) if right else 0  # where the vectors begin that are looked up
    directions = lines(unit.shape[1], many)
    half, least = calibrate(cosine, unit.shape[1], many, spread, recall)
    values = directions @ unit.T
    order = np.argsort(values[:, first:], axis=1).astype(np.int32)
    ranked = np.take_along_axis(values[:, first:], order, axis=1)
    asked = values[:, : len(left[0])]
    low = np.stack([np.searchsorted(r, v - half, "left") for r, v in zip(ranked, asked, strict=True)], axis=1)
    high = np.stack([np.searchsorted(r, v + half, "right") for r, v in zip(ranked, asked, strict=True)], axis=1)
    degree, group, pairs = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
    for q in range(len(left[0])):
        windows = [order[k, low[q, k] : high[q, k]] for k in range(many)]
        count = np.bincount(np.concatenate(windows), minlength=len(ids) - first)
        near = first + np.flatnonzero(count >= least)
        near = near if right else near[near > q]
        near = near[unit[near] @ unit[q] >= cosine] if len(near) else near
        if len(near):
            degree[q] += copies[near].sum()
            degree[near] += copies[q]
            groups, some = np.unique(group[near], return_index=True)
            apart = groups != group[q]
            if apart.any():
                pairs += [(int(ids[q]), int(ids[x])) for x in near[some[apart]]]
                group[np.isin(group, groups)] = group[q]
    return pairs, degree[: len(left[0])], degree[len(left[0]) :]


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _counted(folder: str, names: list[str], widths: list[int], many: int, spread: float, recall: float, cosine: float) -> Callable:
    """Links of a block with itself and some of the next ones: rows ``a, b`` that connect them, and ``a, null, n`` with a vector's links there."""

    def rows(a: list | np.ndarray, b: list | None, n: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), none if b is None else pa.array(b, pa.int64()), none if n is None else pa.array(n, pa.int64())], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, start, stop in zip(*(batch.column(n).to_pylist() for n in ("block", "start", "stop")), strict=True):
                left = _read_block(folder, names[at], widths[at])
                total = np.zeros(len(left[0]), np.int64)
                for other in range(start, stop):
                    right = _read_block(folder, names[other], widths[other]) if other != at else None
                    pairs, mine, theirs = _linked(left, right, many, spread, recall, cosine)
                    total += mine
                    some = np.flatnonzero(theirs)
                    yield rows([p[0] for p in pairs], [p[1] for p in pairs], None)
                    if len(some):
                        yield rows(right[0][some], None, theirs[some])
                some = np.flatnonzero(total)
                yield rows(left[0][some], None, total[some])

    return run


def near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.9,
    many: int = 24,
    spread: float = 1.5,
    recall: float = 0.999,
    block: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Pairs found with a cosine (double precision) of ``cosine`` or more link; ``component_id`` is the smallest id reachable.
    ``many`` lines, windows of ``spread`` standard deviations of a pair at the threshold, and the count such a pair reaches
    with probability ``recall``.  Equal vectors are one point that knows its copies.  A vector that is null, empty, zero or holds
    null or non-finite components links with nothing, and others only with vectors of their length.  Rows that repeat an id
    are copies of each other where their vectors are equal.  A null id links with nothing and has no component.  Other columns
    play no part; an empty table gives no row.
    """
    work = Work(vectors.sparkSession, "embedding-dedup")
    packed, others = usable_vectors(vectors, id_col, vector_col)
    packed = work.put(packed, "vectors")
    different = work.put(packed.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "points")
    points = different

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part in _by_width(batch):
                x = unpacked(part.column("v").to_pylist())
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                v = pa.array([r.tobytes() for r in unit], pa.binary())
                at = pa.array(unit @ lines(width, 1)[0])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("copies"), v, at, pa.array(np.full(len(x), width, np.int32))], ["id", "copies", "v", "at", "width"])

    points = work.put(points.mapInArrow(projected, "id long, copies long, v binary, at double, width int"), "unit")
    # One number for each range of `block` points; a width of fewer points is one range.
    wide = points.groupBy("width").agg(F.count("*").alias("n")).where(F.col("n") > block)
    most = math.ceil((wide.agg(F.max("n")).first()[0] or 0) / block)
    cuts: dict[int, np.ndarray] = {}
    if most:
        tenths = F.array(*(F.lit((k + 1) / most) for k in range(most - 1)))
        marks = points.groupBy("width").agg(F.count("*").alias("n"), F.percentile_approx("at", tenths, F.lit(10 * most)).alias("marks")).where(F.col("n") > block)
        for r in marks.collect():
            own = math.ceil(r.n / block)
            cuts[r.width] = np.unique([r.marks[round((k + 1) * most / own) - 1] for k in range(own - 1)])

    def reach(width: int) -> float:
        return 4 / spread * calibrate(cosine, width, many, spread, recall)[0]

    # Each vector is written once, into the block of its range; a range of more than two blocks, as of vectors that differ in
    # length only, is several.  Tasks get numbers of blocks and read what they compare.
    ranged = points.mapInArrow(_ranged(cuts), "id long, copies long, v binary, width int, own long")
    ranged = work.put(ranged, "ranged")
    parts = ranged.groupBy("width", "own").agg(F.ceil(F.count("*") / (2 * block)).alias("parts"))
    dealt = ranged.join(work.put(parts, "parts"), ["width", "own"]).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")))
    folder = f"{work.root}/blocks-{uuid.uuid4().hex}"
    written = dealt.groupBy("width", "own", "part").applyInArrow(_blocks(folder), "width int, own long, part long, name string, n long")
    written = work.put(written.select("width", "own", "part", "name", "n"), "written")
    made = written.orderBy("width", "own", "part").select("width", "own", "name").collect()  # one name for each block
    spans, items = [], 0
    for at, r in enumerate(made):
        inner = cuts.get(r.width, np.zeros(0))
        most = int(np.searchsorted(inner, (inner[r.own] if r.own < len(inner) else np.inf) + reach(r.width), "right"))
        stop = bisect.bisect_right(made, (r.width, most), key=lambda x: (x.width, x.own))
        spans.append((at, stop))
        items += -(-(stop - at) // _TOGETHER)
    spans = vectors.sparkSession.createDataFrame(spans, "block int, last int")
    asked = spans.select("block", "last", F.explode(F.sequence(F.col("block"), F.col("last") - 1, F.lit(_TOGETHER))).alias("start"))
    asked = asked.select("block", "start", F.least("last", F.col("start") + _TOGETHER).alias("stop")).repartition(max(1, min(items, _TASKS)))
    found = asked.mapInArrow(_counted(folder, [r.name for r in made], [r.width for r in made], many, spread, recall, cosine), "a long, b long, n long")
    found = work.put(found, "links")
    work.remove(folder.rsplit("/", 1)[1])
    degrees = found.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    roots = components(found.where("n is null").select("a", "b"), work)
    # Back to the rows: by vector to the point that stands for it, which has the component and the links.
    stands = different.withColumnRenamed("id", "point")
    known = stands.join(degrees, stands["point"] == degrees["id"], "left").drop("id")
    known = known.join(roots, known["point"] == roots["node"], "left")
    known = known.select(
        "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "point").alias("component_id")
    )
    linked = packed.join(known, "v").select(F.col("id").alias("vec_id"), "n_links", "component_id")
    alone = others.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
