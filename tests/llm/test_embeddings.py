from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import ann, embedding_dedup

from .brute import cosine_links, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, id int, v string"
ODD = [
    (None, [1.0] * 16), (9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] * 16), (9005, [float("inf")] + [1.0] * 15),
    (9006, [1.0] * 5), (9007, [None] + [1.0] * 15),
]


def table(spark, vectors):
    rows = [(i, [float(x) for x in v], 1, 2, "x") for i, v in vectors.items()] + [(i, v, None, None, None) for i, v in ODD]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(900, 16)).astype(np.float32)
    out = list(base)
    for i in range(0, 300, 3):
        out.append((base[i] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.3, 0.4])).astype(np.float32))
    out += [base[5]] * 60 + [base[5] * 2, -base[5]]
    order = rng.permutation(len(out))
    return {int(i): np.asarray(out[k], np.float64) for i, k in enumerate(order)}


def test_links_and_components(spark, vectors):
    links, low = cosine_links(vectors, 0.9)
    out = embedding_dedup.near_duplicates(table(spark, vectors), block=200, many=16).collect()
    got = {r.vec_id: r for r in out}
    assert len(out) == len(vectors) + len(ODD)
    for i, _ in ODD:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    missed = sum(links[i] - got[i].n_links for i in vectors)
    assert all(got[i].n_links <= links[i] for i in vectors) and missed <= 0.01 * sum(links.values())
    if not missed:
        assert all(got[i].component_id == low[i] and got[i].kept == (low[i] == i) for i in vectors)
    assert np.mean([got[i].component_id == low[i] for i in vectors]) > 0.99


def test_calibration():
    half, least = embedding_dedup.calibrate(0.9, 64, 24, 1.5, 0.999)
    assert 0 < least < 24
    rng = np.random.default_rng(2)
    lines = embedding_dedup.lines(64, 24)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * side
    collisions = (np.abs((a - b) @ lines.T) <= half).sum(axis=1)
    assert (collisions >= least).mean() > 0.995


def test_search_recall_and_order(spark, vectors):
    asked = [i for i in vectors if i % 20 == 0]
    out = ann.nearest(table(spark, vectors), F.col("id") % 20 == 0, k=10, shard_rows=300, query_block=25).collect()
    by_query = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        by_query.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert sorted(by_query) == sorted(asked)
    hits = 0
    for q in asked:
        wanted = nearest(vectors, q, 10)
        assert by_query[q] == sorted(by_query[q]) and len(by_query[q]) == 10
        for score, i in by_query[q]:
            assert abs(score - np.sqrt(((vectors[i] - vectors[q]) ** 2).sum())) < 1e-12 and i != q
        hits += len({i for _, i in wanted} & {i for _, i in by_query[q]})
    assert hits / (10 * len(asked)) >= 0.97


def test_few_rows_and_repeats(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 1, "") for i, v in rows], SCHEMA)
    out = ann.nearest(df, F.col("id") == 0, k=10).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in out] == [(0, 1, 1), (0, 2, 2)]
    links = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    assert links == [(0, 1, 0, True), (0, 1, 0, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert embedding_dedup.near_duplicates(df).collect() == []
    assert ann.nearest(df, F.col("id") % 20 == 0).collect() == []


def test_graph_reaches_its_points():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(2000, 32))
    graph = ann.Graph(points)
    ids, _ = graph.search(points[:300], 96)
    exact = ((points[:300, None] - points[None]) ** 2).sum(axis=2)
    wanted = np.argsort(exact, axis=1)[:, :10]
    assert np.mean([len(set(w) & set(f)) / 10 for w, f in zip(wanted.tolist(), ids.tolist(), strict=True)]) > 0.95
    assert (graph.links != np.arange(2000)[:, None]).all()


def test_more_neighbours_than_the_beam(spark):
    rng = np.random.default_rng(9)
    vectors = {i: v.astype(np.float32).astype(np.float64) for i, v in enumerate(rng.normal(size=(600, 16)))}
    rows = ann.nearest(table(spark, vectors), F.col("id") < 3, k=500).collect()
    for q in range(3):
        found = {r.vec_id for r in rows if r.query_id == q}
        assert len(found) == 500 and len(found & {i for _, i in nearest(vectors, q, 500)}) > 490


def test_vectors_of_several_lengths(spark):
    """One longer vector takes no other out; each length is searched and linked by itself."""
    rng = np.random.default_rng(8)
    base = {n: rng.normal(size=(many, n)) for n, many in ((8, 300), (3, 250), (64, 1))}
    found = {}
    for n, rows in base.items():
        for k, row in enumerate(rows):
            found[1000 * n + k] = row if k % 3 else rows[max(k - 1, 0)] * 1.01
    rows = [(i, [float(x) for x in v], 0, 0, "x") for i, v in found.items()]
    table_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id int, v string").repartition(3)
    out = embedding_dedup.near_duplicates(table_, block=100, many=16).collect()
    near = ann.nearest(table_, F.col("id") % 50 == 0, k=5, shard_rows=80).collect()
    assert len(out) == len(found)
    hits = asked = 0
    for n in base:
        own = {i: v for i, v in found.items() if len(v) == n}
        links, low = cosine_links(own, 0.9)
        got = {r.vec_id: r for r in out if r.vec_id in own}
        assert all(got[i].n_links <= links[i] for i in own)
        assert sum(links.values()) - sum(r.n_links for r in got.values()) <= 0.01 * sum(links.values())
        for q in (i for i in own if i % 50 == 0):
            wanted = {i for _, i in nearest(own, q, 5)}
            mine = {r.vec_id for r in near if r.query_id == q}
            assert mine <= set(own)
            hits, asked = hits + len(wanted & mine), asked + len(wanted)
    assert hits >= 0.9 * asked > 0


def test_vectors_are_written_once_however_many_ranges_meet(spark, monkeypatch):
    """No table has a row for each range that a vector meets, no block grows, and a group keeps fewer links than it has vectors."""
    written, put = {}, embedding_dedup.Work.put

    def counted(self, df, name, *more):
        done = put(self, df, name, *more)
        written[name] = [r.n for r in done.select("n").collect()] if name == "written" else done.count()
        return done

    monkeypatch.setattr(embedding_dedup.Work, "put", counted)
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    near = {i: v for i, v in enumerate(base + 0.05 * rng.normal(size=(300, 16)))}
    far = {1000 + i: v for i, v in enumerate(rng.normal(size=(100, 16)))}
    long = {2000 + i: (i + 2) * far[1000] for i in range(100)}  # one place on the line
    vectors = {i: v.astype(np.float32).astype(np.float64) for i, v in (near | far | long).items()}
    df = spark.createDataFrame([(i, [float(x) for x in v], 0, 0, "") for i, v in vectors.items()], SCHEMA)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=20).collect()}
    links, low = cosine_links(vectors, 0.9)
    assert sum(written["written"]) == written["ranged"] == 500 and max(written["written"]) <= 80 and len(written["written"]) > 15
    assert written["links"] <= 500 * len(written["written"])
    assert {i: r.n_links for i, r in got.items()} == links and {i: r.component_id for i, r in got.items()} == low


def test_a_dense_block_gives_fewer_pairs_than_vectors():
    rng = np.random.default_rng(6)
    unit = rng.normal(size=8) + 0.02 * rng.normal(size=(400, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    whole = np.arange(400), np.ones(400, np.int64), unit
    halves = [tuple(x[part] for x in whole) for part in (slice(0, 150), slice(150, 400))]
    pairs, mine, theirs = embedding_dedup._linked(whole, None, 24, 1.5, 0.999, 0.9)
    assert len(pairs) == 399 and (mine == 399).all() and not len(theirs)
    pairs, mine, theirs = embedding_dedup._linked(*halves, 24, 1.5, 0.999, 0.9)
    assert len(pairs) == 399 and (mine == 250).all() and (theirs == 150).all()
