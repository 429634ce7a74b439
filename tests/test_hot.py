"""Hot keys: whole results and even tasks without adaptive execution; budgets whose calls share a moment."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hearthline.operators import addresses, hot


@pytest.fixture
def plain(spark):
    """No adaptive execution and no broadcast."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def test_a_third_of_the_rows_share_a_key(plain):
    kind = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 997))
    rows = plain.range(30_000).withColumn("key", kind)
    table = rows.where("key <> 'k5'").groupBy("key").agg(F.max("id").alias("top"))
    assert hot.hot_keys(rows, "key", 8) == (["hot"], True)
    joined = hot.join_to_few(rows, table, "key")
    want = {r.id: r.top for r in rows.join(table, "key", "left").collect()}
    assert {r.id: r.top for r in joined.collect()} == want and joined.count() == 30_000
    sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 30_000 / 8


def test_no_hot_key_no_place(plain):
    rows = plain.range(1000).withColumn("key", F.col("id").cast("string"))
    joined = hot.join_to_few(rows, rows.select("key", (F.col("id") * 2).alias("two")), "key")
    assert "_place" not in joined._jdf.queryExecution().toString()
    assert all(r.two == 2 * r.id for r in joined.collect())
    assert hot.join_to_few(rows.limit(0), rows.select("key"), "key").count() == 0


@pytest.mark.parametrize("ranked", [0, 3, 100])
def test_budget_of_calls_in_one_moment(spark, ranked):
    pick = random.Random(4)
    one = datetime(2024, 1, 9, 12, 0, 30, 5)
    calls = [(one, i << pick.choice((0, 15, 30, 45)), "x") for i in range(1, 120)]
    calls += [(datetime(2024, 2, d, 12, 0, 30, d), -d, "x") for d in range(1, 29)] + [(datetime(2024, 1, 2), 7, "x")]
    calls = list({c[:2]: c for c in calls}.values())
    df = spark.createDataFrame(calls, "ts timestamp_ntz, call_id long, kind string")
    for cap in (1, 20, 60, 500):
        want, seen = {}, {}
        for ts, i, _ in sorted(calls):
            seen[ts.month] = seen.get(ts.month, 0) + 1
            want[ts, i] = seen[ts.month] <= cap
        got = addresses.within_budget(df, cap, ranked=ranked).collect()
        assert {(r.ts, r.call_id): r.allowed for r in got} == want


def test_calls_alike_share_a_position(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), 1)] * 50 + [(datetime(2024, 1, 2), 2)], "ts timestamp_ntz, call_id long")
    got = addresses.within_budget(df, 20, ranked=10).groupBy("call_id", "allowed").count().collect()
    assert sorted(map(tuple, got)) == [(1, True, 50), (2, False, 1)]
