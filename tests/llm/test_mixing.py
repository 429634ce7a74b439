from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from hearthline.llm import mixing

SCHEMA = "doc_id long, text string, source string, row int, pick string, `mix_pass` string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for i in range(600):
        source = rng.choices(["big", "mid", "small", None], [60, 25, 10, 5])[0]
        out.append((i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 60))), source, 1, "p", "m"))
    out += [(1000, None, "big", None, None, None), (1001, " \n", "none", 2, "", ""), (None, "no id", "small", 1, "", ""), (5, "again", "big", 1, "", "")]
    return out


def counts(rows, out):
    size = {}
    for i, text, source, *_ in rows:
        if text and text.split():
            size[source] = size.get(source, 0) + len(text.split())
    read = Counter()
    for r in out:
        read[r.source] += len(r.text.split())
    return size, read


def entropy(weights):
    total = sum(weights)
    return -sum(w / total * math.log(w / total) for w in weights)


def test_weights_meet_the_target(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = mixing.blocks(df, flatten=0.5, max_passes=50).collect()
    size, read = counts(rows, out)
    goal = entropy(size.values()) + 0.5 * (math.log(4) - entropy(size.values()))
    assert abs(entropy(read.values()) - goal) < 0.02
    assert read["big"] == size["big"] and all(read[s] >= size[s] for s in size)
    top = max(size, key=size.get)
    alpha = [math.log(read[s] / read[top]) / math.log(size[s] / size[top]) for s in size if s != top]
    assert max(alpha) - min(alpha) < 0.1  # one exponent for all sources
    times = Counter((r.doc_id, r.text) for r in out)
    assert set(times) == {(r[0], r[1]) for r in rows if r[1] and r[1].split()}
    for source in size:  # whole blocks and one partial block: two values that differ by one
        mine = {times[(r[0], r[1])] for r in rows if r[2] == source and r[1] and r[1].split()}
        assert max(mine) - min(mine) <= 1
    assert out[0].pick == "p" and all(0 <= r.mix_at <= 1 for r in out)
    half = Counter()
    for r in sorted(out, key=lambda r: r.mix_at)[: len(out) // 2]:
        half[r.source] += len(r.text.split())
    for source in ("big", "mid"):  # any stretch has the weights of the whole
        assert abs(half[source] / sum(half.values()) - read[source] / sum(read.values())) < 0.08


def test_limit_on_repeats_wins(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.blocks(df, flatten=1.0, max_passes=2.5).collect()
    size, read = counts(rows, out)
    assert max(read[s] / size[s] for s in size) <= 2.5 and max(read[s] / size[s] for s in size) > 2.2


def test_same_result_on_other_partitions(spark, rows):
    a, b = (mixing.blocks(spark.createDataFrame(rows, SCHEMA).repartition(n)).select("doc_id", "mix_pass", "mix_at") for n in (1, 5))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_one_source_and_empty(spark):
    one = spark.createDataFrame([(1, "a b", "s", 1, "", "x"), (1, "a b", "s", 1, "", "x")], SCHEMA)
    assert [r.mix_pass for r in mixing.blocks(one).collect()] == [0, 0]
    assert mixing.blocks(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.blocks(spark.createDataFrame([(1, None, "s", 1, "", "x")], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        mixing.blocks(one, max_passes=0.5)
