"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard.

A shard holds a bounded number of different vectors, dealt by hash.  Its graph starts random; batches of points search it
greedily, and what a search has met proposes the point's neighbours, of which relaxed distance pruning keeps diverse ones:
a candidate goes if a kept neighbour is clearly nearer to it than the point is.  Links are made in both directions and
pruned again where they exceed the degree.  Queries run a beam search in every shard, in blocks, and the best of all shards
are merged.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Work, unpacked, usable_vectors

_SEED = 11


class Graph:
    """Directed graph over the rows of ``points`` (float32 for the search; callers measure exactly themselves)."""

    def __init__(self, points: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, batch: int = 256):
        self.points = np.ascontiguousarray(points, np.float32)
        self.degree = min(degree, max(1, len(points) - 1))
        self.links = np.full((len(points), self.degree), -1, np.int32)
        rng = np.random.default_rng(_SEED)
        if len(points):
            centre = self.points.mean(axis=0)
            self.entry = int(((self.points - centre) ** 2).sum(axis=1).argmin())
        if len(points) < 2:
            return
        for i in range(len(points)):
            pick = rng.choice(len(points) - 1, self.degree, replace=False)
            self.links[i] = pick + (pick >= i)
        for relax in (1.0, alpha):
            order = rng.permutation(len(points))
            for at in range(0, len(order), batch):
                self._insert(order[at : at + batch], beam, relax)

    def _distances(self, rows: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Squared distances of each row's targets (ids, -1 is none) to that row's point."""
        gap = self.points[targets] - rows[:, None, :]
        out = np.einsum("ijk,ijk->ij", gap, gap)
        out[targets < 0] = np.inf
        return out

    def search(self, queries: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of the ``beam`` nearest met, for several queries at once; -1 where there are fewer."""
        n, rows = len(self.points), np.arange(len(queries))
        queries = np.asarray(queries, np.float32)
        ids = np.full((len(queries), beam), -1, np.int32)
        far = np.full((len(queries), beam), np.inf, np.float32)
        done = np.zeros((len(queries), beam), bool)
        seen = np.zeros((len(queries), n + 1), bool)
        ids[:, 0], seen[:, self.entry] = self.entry, True
        far[:, 0] = ((queries - self.points[self.entry]) ** 2).sum(axis=1)
        while True:
            open_far = np.where(done, np.inf, far)
            turn = np.argsort(open_far, axis=1)[:, :expand]
            live = np.isfinite(np.take_along_axis(open_far, turn, axis=1))
            if not live.any():
                return ids, far
            np.put_along_axis(done, turn, True, axis=1)
            picked = np.where(live, np.take_along_axis(ids, turn, axis=1), -1)
            next_ids = np.where(picked[:, :, None] >= 0, self.links[picked], -1).reshape(len(queries), -1)
            next_ids[seen[rows[:, None], next_ids]] = -1
            next_ids = np.sort(next_ids, axis=1)  # a point met twice in one step counts once
            next_ids[:, 1:][next_ids[:, 1:] == next_ids[:, :-1]] = -1
            seen[rows[:, None], next_ids] = True
            seen[:, n] = False
            all_ids = np.concatenate([ids, next_ids], axis=1)
            all_far = np.concatenate([far, self._distances(queries, next_ids)], axis=1)
            all_done = np.concatenate([done, next_ids < 0], axis=1)
            best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            ids, far, done = (np.take_along_axis(x, best, axis=1) for x in (all_ids, all_far, all_done))

    def _prune(self, points: np.ndarray, cand: np.ndarray, far: np.ndarray, relax: float) -> np.ndarray:
        """Relaxed distance pruning of each point's candidates (-1 is none): at most ``degree`` diverse ones."""
        order = np.argsort(far, axis=1)
        cand, far = np.take_along_axis(cand, order, axis=1), np.take_along_axis(far, order, axis=1)
        alive = np.isfinite(far)
        alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
        vectors = self.points[cand]
        norms = np.einsum("ijk,ijk->ij", vectors, vectors)
        between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
        out, rows = np.full((len(points), self.degree), -1, np.int32), np.arange(len(points))
        for k in range(self.degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = alive.argmax(axis=1)
            out[some, k] = cand[rows, pick][some]
            alive &= (relax * relax) * between[rows, pick] > far
            alive[rows, pick] = False
        return out

    def _insert(self, batch: np.ndarray, beam: int, relax: float) -> None:
        ids, far = self.search(self.points[batch], beam)
        old = self.links[batch]
        cand = np.concatenate([ids, old], axis=1)
        far = np.concatenate([far, self._distances(self.points[batch], old)], axis=1)
        far[cand == batch[:, None]] = np.inf
        self.links[batch] = self._prune(batch, cand, far, relax)
        source = np.repeat(batch, self.degree)
        target = self.links[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order].astype(np.int32), target[order]
        nodes, starts = np.unique(target, return_index=True)
        full_nodes, full_cand = [], []
        for node, back in zip(nodes, np.split(source, starts[1:]), strict=True):
            own = self.links[node]
            own = own[own >= 0]
            new = back[~np.isin(back, own)]
            if len(own) + len(new) <= self.degree:
                self.links[node, len(own) : len(own) + len(new)] = new
            else:
                full_nodes.append(node)
                full_cand.append(np.concatenate([own, new]))
        for at in range(0, len(full_nodes), 256):
            part, lists = np.array(full_nodes[at : at + 256]), full_cand[at : at + 256]
            cand = np.full((len(part), max(map(len, lists))), -1, np.int32)
            for i, c in enumerate(lists):
                cand[i, : len(c)] = c
            self.links[part] = self._prune(part, cand, self._distances(self.points[part], cand), relax)


def _searcher(k: int, degree: int, beam: int, query_beam: int, alpha: float, block: int = 256) -> Callable:
    """The ``k`` nearest rows of a shard for the queries of a block: ``query_id, vec_id, score``."""
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(points) or not len(queries):
            return kind.empty_table()
        exact, asked = unpacked(points.column("v").to_pylist()), unpacked(queries.column("v").to_pylist())
        ids, names = points.column("ids").to_pylist(), queries.column("id").to_numpy()
        graph = Graph(exact, degree, beam, alpha)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(asked), block):
            near, _ = graph.search(asked[at : at + block], min(max(query_beam, 2 * k), max(len(exact), 1)))
            for q, found in enumerate(near, at):
                found = found[found >= 0]
                score = np.sqrt(((exact[found] - asked[q]) ** 2).sum(axis=1))
                rows = [(s, i) for s, f in zip(score.tolist(), found.tolist(), strict=True) for i in ids[f] if i != names[q]]
                rows = sorted(rows)[:k]
                out.append((np.full(len(rows), names[q]), np.array([r[1] for r in rows], np.int64), np.array([r[0] for r in rows])))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=kind)

    return run


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    shard_rows: int = 4096,
    query_block: int = 8192,
    degree: int = 32,
    beam: int = 64,
    query_beam: int = 192,
    alpha: float = 1.2,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for every row for which ``is_query(id)`` holds.

    ``score`` is the Euclidean distance in double precision on the vectors as given; ties go to the smaller id; a row is not
    its own neighbour.  ``is_query`` is a condition on the column ``id``.  Equal vectors are one point of a graph, which lists
    its ``k + 1`` smallest ids: of equal distances no more can be among a query's ``k``.  Rows with a null id, or a vector that
    is null, empty, zero or holds null or non-finite components, take no part; vectors are compared with those of their length
    only; an id counts once, at its nearest vector, however often it is there; other columns play no part; an empty table
    gives no row.
    """
    work = Work(vectors.sparkSession, "ann")
    packed = work.put(usable_vectors(vectors, id_col, vector_col)[0], "vectors")
    ranked = packed.withColumn("nth", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("nth") <= k + 1)
    points = work.put(ranked.groupBy("v").agg(F.collect_set("id").alias("ids")), "points")
    queries = work.put(packed.where(is_query).distinct(), "queries")
    # Each length has shards of its own.
    points = points.withColumn("width", F.length("v"))
    sizes = work.put(points.groupBy("width").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), "sizes")
    blocks = max(1, -(-queries.count() // query_block))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = points.join(sizes, "width").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))
    left = left.withColumn("block", every).select("width", "shard", "block", "v", "ids")
    right = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("width", F.length("v"))
    right = right.join(sizes.withColumnRenamed("width", "of"), F.col("width") == F.col("of"))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("width", "shard", "block", "id", "v")
    keys = ["width", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _searcher(k, degree, beam, query_beam, alpha), "query_id long, vec_id long, score double"
    )
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
