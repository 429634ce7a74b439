"""Hard negatives by a multiway hyperplane tree whose split points know their siblings' distances.

Scores are inner products of integer vectors.  Every vector gets one more component that brings all to one length (and an
anchor gets 0), so that a score is a falling function of a Euclidean distance and a window of scores is an annulus around the
anchor.  A node of the tree gives each point to its nearest split point, and each split point stores the smallest and largest
distance to the points of every sibling.  By the triangle inequality a sibling whose range can't meet the anchor's annulus, as
seen from any split point, is left out; leaves are compared exactly.  So nothing is missed.

The first node is spread over the cluster: at most 64 split points make its cells, whose ranges are aggregated by Spark, and a
cell is cut by hash into blocks of about 4,096 points, each with a tree of its own that is built and written once.  Anchors go
to the cell of their nearest split point first; what they find there narrows the annulus for the cells that are left.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Work

_LEAF, _FAN, _CELLS, _BLOCK, _ASKED = 96, 16, 64, 4096, 4096
_FAR = 1 << 62
_EXACT = float(1 << 53)  # sums below are whole numbers in double precision


# ------------------------------------------------------------------------------------------------ geometry
def _matrix(values, width: int) -> np.ndarray:
    values = list(values)
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), width)


def _products(a: np.ndarray, b: np.ndarray, longest: float) -> np.ndarray:
    """Exact inner products; beyond what doubles hold, in integers."""
    if longest < _EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Points brought to the norm of the longest by one more component."""
    return np.concatenate([x, np.sqrt(np.maximum(longest - (x**2).sum(axis=1), 0))[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _spread_out(points: np.ndarray, many: int) -> np.ndarray:
    """Indices of ``many`` points, each the farthest from those taken before."""
    taken = [0]
    near = _distances(points, points[:1])[:, 0]
    while len(taken) < min(many, len(points)):
        taken.append(int(near.argmax()))
        near = np.minimum(near, _distances(points, points[taken[-1:]])[:, 0])
    return np.array(taken)


def _meets(to_splits: np.ndarray, low: np.ndarray, high: np.ndarray, inner: np.ndarray, outer: np.ndarray, slack: float) -> np.ndarray:
    """Which children (columns) each query can have points of its annuli in; ``inner``, ``outer``: queries x windows.

    ``low[i, j]`` and ``high[i, j]``: distances from split point i to the points of child j.
    """
    d = to_splits[:, :, None]
    least = np.maximum(low[None] - d, d - high[None]).max(axis=1)
    most = (d + high[None]).min(axis=1)
    return ((least[:, :, None] <= outer[:, None] + slack) & (most[:, :, None] >= inner[:, None] - slack)).any(axis=2)


def _annuli(norm: np.ndarray, longest: float, floor: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances at which scores from ``floor`` to ``top`` lie; nothing lies beyond any window whose floor is above its top."""
    base = (longest + norm)[:, None]
    inner, outer = (np.sqrt(np.maximum(base - 2.0 * s, 0)) for s in (top.astype(np.float64), floor.astype(np.float64)))
    return inner, np.where(floor <= top, outer, -np.inf)


# ------------------------------------------------------------------------------------------------ trees
def build(points: np.ndarray) -> list[dict]:
    """Nodes of a tree over lifted points; the first is the root, a leaf holds the places of its points."""
    nodes: list[dict] = [{}]
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, own = todo.pop()
        fan = min(_FAN, len(own) // _LEAF + 1)
        if fan > 1:
            sample = own[np.linspace(0, len(own) - 1, min(len(own), 3 * fan)).astype(np.int64)]
            splits = points[sample[_spread_out(points[sample], fan)]]
            far = _distances(points[own], splits)
            child = far.argmin(axis=1)
            many = np.bincount(child, minlength=len(splits))
        if fan == 1 or many.max() == len(own):  # few points, or all in one place
            nodes[at] = {"leaf": own}
            continue
        low, high = np.full((len(splits), len(splits)), np.inf), np.full((len(splits), len(splits)), -np.inf)
        below = np.full(len(splits), -1)
        for j in np.flatnonzero(many):
            mine = far[child == j]
            low[:, j], high[:, j] = mine.min(axis=0), mine.max(axis=0)
            below[j] = len(nodes)
            nodes.append({})
            todo.append((below[j], own[child == j]))
        nodes[at] = {"splits": splits, "low": low, "high": high, "below": below}
    return nodes


class Best:
    """The ``k`` best points so far of every query and window: higher scores first, then smaller ids."""

    def __init__(self, floor: np.ndarray, top: np.ndarray, k: int):
        self.floor, self.top, self.k = floor.copy(), top, k
        self.score = np.full((*floor.shape, k), -_FAR, np.int64)
        self.id = np.full((*floor.shape, k), np.iinfo(np.int64).max, np.int64)
        self.twin = np.zeros((*floor.shape, k), bool)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, fits: np.ndarray, twin: np.ndarray) -> None:
        for w in range(self.floor.shape[1]):
            good = fits & (score >= self.floor[query, w, None]) & (score <= self.top[query, w, None])
            rows = np.flatnonzero(good.any(axis=1))
            if not len(rows):
                continue
            q = query[rows]
            both = np.concatenate([self.score[q, w], np.where(good[rows], score[rows], -_FAR)], axis=1)
            names = np.concatenate([self.id[q, w], np.where(good[rows], ids[None], np.iinfo(np.int64).max)], axis=1)
            twins = np.concatenate([self.twin[q, w], twin[rows]], axis=1)
            order = np.lexsort((names, -both), axis=1)[:, : self.k]
            self.score[q, w] = np.take_along_axis(both, order, axis=1)
            self.id[q, w] = np.take_along_axis(names, order, axis=1)
            self.twin[q, w] = np.take_along_axis(twins, order, axis=1)
            self.floor[q, w] = np.maximum(self.floor[q, w], self.score[q, w, -1])


def search(tree: dict, asked: np.ndarray, label: np.ndarray, floor: np.ndarray, top: np.ndarray, k: int, same: bool, longest: float) -> Best:
    """The best points of one block for every query and window."""
    best, nodes, x = Best(floor, top, k), tree["nodes"], tree["x"]
    norm, slack = (asked**2).sum(axis=1), 1e-6 * math.sqrt(longest) + 1e-9
    lifted = np.concatenate([asked, np.zeros((len(asked), 1))], axis=1)

    def leaf(own: np.ndarray, query: np.ndarray) -> None:
        score = _products(asked[query], x[own], longest)
        fits = (tree["label"][own][None] == label[query][:, None]) == same
        twin = (score == norm[query][:, None]) & (tree["norm"][own][None] == norm[query][:, None])
        best.add(query, score, tree["id"][own], fits, twin)

    # Down to the nearest leaf first, then everywhere the narrowed annuli reach.
    home = np.zeros(len(asked), np.int64)
    todo = [(0, np.arange(len(asked)))]
    while todo:
        at, query = todo.pop()
        node = nodes[at]
        if "leaf" in node:
            home[query] = at
            leaf(node["leaf"], query)
            continue
        far = _distances(lifted[query], node["splits"])
        near = np.where(node["below"] >= 0, far, np.inf).argmin(axis=1)
        todo.extend((int(node["below"][j]), query[near == j]) for j in np.unique(near))
    todo = [(0, np.arange(len(asked)))]
    while todo:
        at, query = todo.pop()
        node = nodes[at]
        if "leaf" in node:
            query = query[home[query] != at]
            if len(query):
                leaf(node["leaf"], query)
            continue
        inner, outer = _annuli(norm[query], longest, best.floor[query], top[query])
        alive = _meets(_distances(lifted[query], node["splits"]), node["low"], node["high"], inner, outer, slack)
        todo.extend((int(b), query[alive[:, j]]) for j, b in enumerate(node["below"]) if b >= 0 and alive[:, j].any())
    return best


# ------------------------------------------------------------------------------------------------ on Spark
def _integers(scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed whole components and their number; rows whose squares pass 2^62 have no score that fits a long and go."""
        for batch in batches:
            v, norm, keep = [], [], []
            for x in batch.column(2):
                x = np.floor(scale * np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)) + 0.0
                v.append(x.astype("<f8").tobytes())
                norm.append(float((x**2).sum()))
                keep.append(norm[-1] < _FAR)
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(v, pa.binary()), pa.array([len(b) // 8 for b in v], pa.int32()), pa.array(norm, pa.float64()), batch.column(3)],
                ["id", "label", "v", "width", "norm", "asked"],
            )
            yield out.filter(pa.array(keep, pa.bool_()))

    return run


def _cells(splits: np.ndarray, width: int, longest: float) -> Callable:
    """The cell of each point: its nearest split point, or below zero one for each other width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            cell = -1 - widths.astype(np.int64)
            own = np.flatnonzero(widths == width)
            if len(own):
                x = _lifted(_matrix(batch.column("v").take(pa.array(own)).to_pylist(), width), longest)
                cell[own] = _distances(x, splits).argmin(axis=1)
            yield batch.append_column("cell", pa.array(cell))

    return run


def _ranges(splits: np.ndarray, width: int, longest: float) -> Callable:
    """``cell, split, low, high`` of a task's points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((len(splits), len(splits)), np.inf), np.full((len(splits), len(splits)), -np.inf)
        for batch in batches:
            if batch.num_rows:
                far = _distances(_lifted(_matrix(batch.column("v").to_pylist(), width), longest), splits)
                cell = batch.column("cell").to_numpy()
                np.minimum.at(low, cell, far)
                np.maximum.at(high, cell, far)
        cell, split = np.nonzero(np.isfinite(low))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(split), pa.array(low[cell, split]), pa.array(high[cell, split])], ["cell", "split", "low", "high"])

    return run


def _trees(longest: float) -> Callable:
    def run(keys: tuple, table: pa.Table) -> pa.Table:
        width = table.column("width")[0].as_py()
        x = _matrix(table.column("v").to_pylist(), width)
        tree = {"x": x, "nodes": build(_lifted(x, longest)), "norm": (x**2).sum(axis=1)}
        tree |= {n: table.column(n).to_numpy() for n in ("id", "label")}
        return pa.table({"cell": pa.array([keys[0].as_py()], pa.int64()), "block": pa.array([keys[1].as_py()], pa.int64()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return run


def _windows(table, name: str) -> np.ndarray:
    """A column of window bounds as queries x windows; missing windows hold nothing."""
    rows = table.column("windows").to_pylist()
    many = max((len(r) for r in rows), default=0)
    empty = {"floor": _FAR, "top": -_FAR}
    return np.array([[w[name] for w in [*r, *[empty] * (many - len(r))]] for r in rows], np.int64).reshape(len(rows), many)


def _routes(splits: np.ndarray, width: int, longest: float, low: np.ndarray, high: np.ndarray, home: bool) -> Callable:
    """Each query once for the cell nearest to it, or for every other cell that its annuli can meet."""
    slack = 1e-6 * math.sqrt(longest) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            odd, own = np.flatnonzero(widths != width), np.flatnonzero(widths == width)
            row, cell = [odd if home else odd[:0]], [(-1 - widths[odd].astype(np.int64)) if home else np.zeros(0, np.int64)]
            if len(own):
                part = batch.take(pa.array(own))
                x = _matrix(part.column("v").to_pylist(), width)
                far = _distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1), splits)
                near = np.where(np.isfinite(low).any(axis=0)[None], far, np.inf).argmin(axis=1)
                if home:
                    row.append(own)
                    cell.append(near)
                else:
                    inner, outer = _annuli((x**2).sum(axis=1), longest, _windows(part, "floor"), _windows(part, "top"))
                    alive = _meets(far, low, high, inner, outer, slack)
                    alive[np.arange(len(x)), near] = False
                    r, c = np.nonzero(alive)
                    row.append(own[r])
                    cell.append(c)
            row, cell = np.concatenate(row), np.concatenate(cell)
            for at in range(0, len(row), 10_000):
                yield batch.take(pa.array(row[at : at + 10_000])).append_column("cell", pa.array(cell[at : at + 10_000].astype(np.int64)))

    return run


_FOUND = pa.schema([("q", pa.int64()), ("w", pa.int32()), ("id", pa.int64()), ("score", pa.int64()), ("twin", pa.bool_())])


def _searched(k: int, same: bool, longest: float) -> Callable:
    def run(trees: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(asked) or not len(trees):
            return _FOUND.empty_table()
        tree = pickle.loads(trees.column("tree")[0].as_py())
        x = _matrix(asked.column("v").to_pylist(), tree["x"].shape[1])
        q = asked.column("q").to_numpy()
        best = search(tree, x, asked.column("label").to_numpy(), _windows(asked, "floor"), _windows(asked, "top"), k, same, longest)
        row, w, place = np.nonzero(best.id != np.iinfo(np.int64).max)
        return pa.table(
            [pa.array(q[row]), pa.array(w.astype(np.int32)), *(pa.array(a[row, w, place]) for a in (best.id, best.score, best.twin))], schema=_FOUND
        )

    return run


class _Index:
    """Cells, blocks and trees of all points."""

    def __init__(self, points: DataFrame, work: Work):
        self.work = work
        top = points.groupBy("width").agg(F.count("*").alias("n"), F.max("norm").alias("norm"))
        top = top.agg(F.max_by("width", F.struct("n", "width")), F.max("n"), F.max("norm")).first()
        self.width, n, self.longest = top[0] or 0, top[1] or 0, float(top[2] or 0)
        many = max(1, min(_CELLS, math.ceil(n / _BLOCK)))
        # A sample of three points for a split point, at most 192.
        sample = points.where(F.col("width") == self.width).orderBy(F.xxhash64("v"), "v").limit(3 * many).select("v").collect()
        sample = _lifted(_matrix((bytes(r.v) for r in sample), self.width), self.longest) if sample else np.zeros((1, self.width + 1))
        self.splits = sample[_spread_out(sample, many)]
        schema = "id long, label long, v binary, width int, norm double"
        placed = points.select("id", "label", "v", "width", "norm")
        placed = work.put(placed.mapInArrow(_cells(self.splits, self.width, self.longest), f"{schema}, cell long"), "cells")
        found = placed.where("cell >= 0").select("v", "cell").mapInArrow(_ranges(self.splits, self.width, self.longest), "cell long, split long, low double, high double")
        found = found.groupBy("cell", "split").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()  # 64 x 64 at most
        self.low, self.high = np.full((len(self.splits),) * 2, np.inf), np.full((len(self.splits),) * 2, -np.inf)
        for r in found:
            self.low[r.split, r.cell], self.high[r.split, r.cell] = r.low, r.high
        self.sizes = work.put(placed.groupBy("cell").agg(F.ceil(F.count("*") / _BLOCK).alias("blocks")), "sizes")
        dealt = placed.join(self.sizes, "cell").withColumn("block", F.pmod(F.xxhash64("v", "label", "id"), F.col("blocks")))
        self.trees = work.put(dealt.groupBy("cell", "block").applyInArrow(_trees(self.longest), "cell long, block long, tree binary"), "trees")
        work.free(placed)

    def ask(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """``q, w, id, score, twin, rank``: the ``k`` best of every window of ``q, label, v, width, windows``."""
        chunks = max(1, math.ceil(queries.count() / _ASKED))
        found = self._pass(queries, k, same, True, chunks)
        first = _ranked(found, k).where(F.col("rank") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("reached"))
        narrowed = queries.join(first, "q", "left").withColumn(
            "windows",
            F.transform("windows", lambda x, i: F.struct(F.greatest(x["floor"], F.coalesce(F.col("reached")[i], x["floor"])).alias("floor"), x["top"].alias("top"))),
        )
        rest = self._pass(self.work.put(narrowed.drop("reached"), "narrowed"), k, same, False, chunks)
        return self.work.put(_ranked(found.unionByName(rest), k), "best")

    def _pass(self, queries: DataFrame, k: int, same: bool, home: bool, chunks: int) -> DataFrame:
        route = _routes(self.splits, self.width, self.longest, self.low, self.high, home)
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
        routed = queries.mapInArrow(route, f"{kinds}, cell long").join(self.sizes, "cell")
        routed = routed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        routed = self.work.put(routed.withColumn("chunk", F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int")), "routed")
        keys = ["cell", "block", "chunk"]
        meet = routed.select(*(F.col(c).alias(f"_{c}") for c in keys)).distinct()
        needed = meet.join(self.trees, (F.col("_cell") == F.col("cell")) & (F.col("_block") == F.col("block"))).select("_cell", "_block", "_chunk", "tree")
        found = needed.groupBy("_cell", "_block", "_chunk").cogroup(routed.groupBy(*keys)).applyInArrow(_searched(k, same, self.longest), "q long, w int, id long, score long, twin boolean")
        return self.work.put(found, "found")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    percent: tuple[int, int] = (80, 100),
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components are ``floor(scale * x)``; a score is an inner product, higher ones come first, then smaller ids.  For every
    row where ``anchors`` (a condition on ``id``) holds and each of its first ``positives`` other rows of the same label: the
    first ``negatives`` rows of other labels whose score is from ``percent[0]`` to ``percent[1]`` hundredths of the positive's.

    Rows with a null id, label or vector, a null or non-finite component, or components too large for a score to be a long
    take no part.  Only vectors of one length are compared.  A row that repeats another in id, label and vector is the same
    row; rows that share an id only are different ones.  Labels are whole numbers.  Other columns play no part, and an empty
    table gives no row.  Of equal vectors with one label those with the smallest ids are kept, as many as can be asked for.
    """
    work = Work(vectors.sparkSession, "negatives")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where("id is not null and label is not null and x is not null").where(~bad).withColumn("asked", F.coalesce(anchors, F.lit(False)))
    rows = work.put(rows.mapInArrow(_integers(scale), "id long, label long, v binary, width int, norm double, asked boolean"), "rows")
    twins = Window.partitionBy("label", "v").orderBy("id")
    # The same row twice would take two of the places, so places are dealt by id.
    points = rows.withColumn("place", F.dense_rank().over(twins)).where(F.col("place") <= max(positives + 1, negatives))
    points = work.put(points.drop("place", "asked").dropDuplicates(["id", "label", "v"]), "points")
    index = _Index(points, work)

    asking = rows.where("asked").select("id", "label", "v", "width")
    every = F.array(F.struct(F.lit(-_FAR).alias("floor"), F.lit(_FAR).alias("top")))
    asked = asking.select("label", "v", "width").distinct().select(F.monotonically_increasing_id().alias("q"), "label", "v", "width")
    asked = work.put(asked, "asked")
    best = index.ask(asked.withColumn("windows", every), positives + 1, True)
    chosen = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score", "twin"))).alias("chosen"))
    chosen = work.put(chosen, "chosen")
    # The smallest whole number of at least percent[0] hundredths, the largest of at most percent[1].
    windows = F.transform(
        F.array_sort(F.array_distinct(F.transform("chosen", lambda c: c["score"]))),
        lambda s: F.struct(
            F.ceil((s.cast("decimal(22,0)") * percent[0]) / 100).cast("long").alias("floor"),
            F.floor((s.cast("decimal(22,0)") * percent[1]) / 100).cast("long").alias("top"),
        ),
    )
    scores = F.array_sort(F.array_distinct(F.transform("chosen", lambda c: c["score"])))
    wanted = work.put(asked.join(chosen, "q").withColumn("windows", windows).withColumn("scores", scores).drop("chosen"), "wanted")
    worst = index.ask(wanted.drop("scores"), negatives, False)
    worst = worst.join(wanted.select("q", "scores"), "q").select("q", F.col("scores")[F.col("w")].alias("positive_score"), "rank", "id", "score")
    answers = worst.groupBy("q", "positive_score").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("answers"))
    answers = work.put(answers, "answers")

    # Back to the anchors; those with one vector and label have the same rows, but for themselves.
    named = work.put(asking.distinct().join(asked.select("q", "label", "v"), ["label", "v"]).select("id", "q"), "anchors")
    pairs = named.join(chosen, "q").withColumn("other", F.filter("chosen", lambda c: ~(c["twin"] & (c["id"] == F.col("id")))))
    pairs = pairs.select(F.col("id").alias("anchor_id"), "q", F.explode(F.slice("other", 1, positives)).alias("p"))
    pairs = pairs.select("anchor_id", "q", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    out = pairs.join(answers, ["q", "positive_score"]).select("anchor_id", "positive_id", "positive_score", F.explode("answers").alias("n"))
    return out.select("anchor_id", "positive_id", F.col("n.rank").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))
