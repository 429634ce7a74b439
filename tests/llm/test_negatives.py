from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import negatives

from .brute import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, id string, score int, rank int"
ODD = [
    (None, [0.5] * 6, 1), (900_000, None, 1), (900_100, [0.5] * 6, None), (900_200, [float("nan")] * 6, 1),
    (900_300, [float("inf")] + [0.1] * 5, 1), (900_400, [None] + [0.1] * 5, 2), (900_500, [1e300] * 6, 2),
]


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 0, 0) for i, v, y in rows], SCHEMA).repartition(5)


def mined(spark, rows, **more):
    out = negatives.hard_negatives(table(spark, rows), F.col("id") % 20 == 0, **more).collect()
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    got = [tuple(r[n] for n in names) for r in out]
    assert len(got) == len(set(got))
    return set(got)


def brute(rows, **more):
    good = [(i, y, tuple(int(np.floor(256 * x)) for x in v)) for i, v, y in dict.fromkeys((i, tuple(v), y) for i, v, y in rows)]
    return hard_negatives(good, {r[0] for r in good if r[0] % 20 == 0}, **more)


@pytest.mark.parametrize("block", [60, 4096])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "_BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    vectors = [(centres[i % 12] + rng.normal(size=6) * rng.choice([0.05, 0.5])) / 3 for i in range(700)]
    rows = [(i, [float(x) for x in v], i % 5) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[20][1], i % 2) for i in range(200)]  # a large group of equal vectors with two labels
    rows += [(2000 + i, [0.0] * 6, 3) for i in range(30)]
    rows += [(3000 + i, [float(x) for x in rng.normal(size=4)], i % 2) for i in range(60)]  # of another length
    rows += [(4000, [], 1), (4001, [], 2), (4020, [], 1)]
    rows += [rows[40], rows[40], (40, rows[60][1], 0), (40, rows[61][1], 2)]  # one row repeated; one id with other vectors
    got = mined(spark, rows + ODD)
    assert got == brute(rows) and len(got) > 500


def test_other_numbers_and_empty(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3) / 4], int(rng.integers(3))) for i in range(400)]  # many ties
    assert mined(spark, rows, positives=2, negatives=7) == brute(rows, positives=2, negatives=7)
    assert mined(spark, rows[:1]) == set()
    assert mined(spark, []) == set()


def test_trees_leave_out_what_they_may():
    rng = np.random.default_rng(6)
    x = np.floor(256 * (rng.normal(size=(40, 1, 8)) * 4 + rng.normal(size=(40, 50, 8)) * 0.05)).reshape(-1, 8)
    longest = float((x**2).sum(axis=1).max())
    nodes = negatives.build(negatives._lifted(x, longest))
    tree = {"x": x, "nodes": nodes, "norm": (x**2).sum(axis=1), "id": np.arange(len(x)), "label": np.zeros(len(x), np.int64)}
    calls = []
    exact = negatives._products
    try:
        negatives._products = lambda a, b, n: calls.append(len(a) * len(b)) or exact(a, b, n)
        best = negatives.search(tree, x[::40], np.zeros(50, np.int64), np.full((50, 1), -(1 << 62)), np.full((50, 1), 1 << 62), 3, True, longest)
    finally:
        negatives._products = exact
    score = x[::40] @ x.T
    assert (best.score[:, 0] == -np.sort(-score, axis=1)[:, :3]).all()
    assert sum(calls) < 0.5 * score.size
