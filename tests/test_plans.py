"""What the plans must look like for the jobs to hold at scale."""

from __future__ import annotations

import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline import schemas
from hearthline.operators import addresses, dedupe, screening, state
from hearthline.plans.store import Store
from hearthline.sources import tables

PARAMS = P.ScreenParams()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A written state table."""
    path = str(tmp_path_factory.mktemp("state") / "posts")
    spark.createDataFrame([], schemas.POSTS).write.parquet(path)
    return spark.read.schema(schemas.POSTS).parquet(path)


def test_retry_filter_reaches_the_scan(stored):
    assert "PushedFilters: [In(verdict" in plan(state.retry_candidates(stored))


def test_skip_test_reads_three_columns(spark, stored):
    feed = spark.createDataFrame([("u",)], "url string")
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan(state.skip_processed(feed, stored, PARAMS)))[1]
    assert read == "url:string,verdict:string,attempts:int"


def test_narrow_state_skips_old_batches_and_payload(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for batch in (0, 1):
        store.load(batch, posts(spark, batch, batch + 1))
    narrow = store.narrow_state(1)
    assert "raw_text" not in plan(narrow) and all("/changes-0-" in f for f in narrow.inputFiles())


def test_a_side_that_grows_with_the_run_is_not_broadcast(spark, stored, tmp_path):
    """However small its files are for Spark, and though a small one could be: it goes through the driver's memory."""
    feed = spark.createDataFrame([("u",)], "url string")
    assert "Broadcast" not in plan(state.skip_published(state.skip_processed(feed, stored, PARAMS), stored))
    store = Store(spark, str(tmp_path))
    store.load(0, posts(spark, 0, 5))
    assert "Broadcast" not in plan(store.state()) and store.state().count() == 5
    # The URLs of a run are counted: few of them still go to where the history lies.
    for n, sent in ((3, True), (100_001, False)):
        spark.range(n).selectExpr("concat('u', id) as url").write.parquet(f"{tmp_path}/urls-{n}")
        found = store.narrow_state(9, spark.read.parquet(f"{tmp_path}/urls-{n}"))
        assert ("Broadcast" in plan(found)) == sent and found.count() == min(n, 5)


def posts(spark, low, high):
    rows = spark.range(low, high).selectExpr("concat('u', id) as url", "'added' as verdict", "0 as attempts", "timestamp_ntz'2024-05-01 00:00:00' as first_seen")
    full = tables.add_missing_columns(rows, schemas.POSTS)
    return full.select(*(F.col(f.name).cast(f.dataType) for f in schemas.POSTS.fields))


def test_an_empty_history_costs_nothing(spark, tmp_path):
    """What is not there is neither scanned by Python workers nor joined with."""
    store, urls = Store(spark, str(tmp_path)), spark.range(3).selectExpr("concat('u', id) as url")
    listed, narrow = store._listed(0, urls), store.narrow_state(0, urls)
    assert listed.columns == ["url"] and narrow.columns == ["url", "verdict", "attempts", "first_seen"] and listed.count() == 0
    new = state.skip_published(state.skip_processed(urls, narrow, PARAMS), listed)
    for rows in (new, store.cache(), store.state(), store.published()):
        shown = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "RDD" not in shown and "Join" not in shown
    assert new.count() == 3 and store.state().schema == schemas.POSTS and store.published().schema == schemas.LISTINGS


def test_what_a_run_learns_is_stored_where_it_lies(spark, tmp_path, monkeypatch):
    """Nothing is shuffled for URLs that are new; the payload of one that is known goes to the month of its first sight."""
    plans, write = {}, Store._write

    def told(self, df, name, batch_id, by=None):
        plans[name, batch_id] = plan(df)
        return write(self, df, name, batch_id, by)

    monkeypatch.setattr(Store, "_write", told)
    store = Store(spark, str(tmp_path))
    store.load(0, posts(spark, 0, 5))
    assert "Exchange" not in plan(store._folded(store._now())) and "Exchange" not in plan(store.narrow_state())
    later = lambda rows: rows.withColumn("first_seen", F.expr("timestamp_ntz'2024-07-01 00:00:00'"))
    store.load(1, later(posts(spark, 5, 9)))
    assert not any("Exchange" in plans[name, batch] for name in ("changes", "payload") for batch in (0, 1))
    store.load(2, later(posts(spark, 4, 6)).withColumn("raw_text", F.col("url")))
    assert "Exchange" not in plans["changes", 2] and sorted(store._now()["batches"]["2"]["payload"]) == ["2024-05", "2024-07"]
    found = {r.url: (str(r.first_seen)[:7], r.raw_text) for r in store.state().collect()}
    assert len(found) == 9 and found["u4"] == ("2024-05", "u4") and found["u5"] == ("2024-07", "u5") and found["u6"] == ("2024-07", None)


def test_a_small_batch_opens_its_own_buckets(spark, tmp_path):
    """Of a large history, whatever its number of runs, only the buckets that the batch's URLs fall in."""
    store = Store(spark, str(tmp_path), buckets=64)
    for batch in range(3):
        store.load(batch, posts(spark, 1000 * batch, 1000 * batch + 1000))
        store.compact(batch)
    urls = spark.createDataFrame([("u5",), ("u1500",), ("new",)], "url string")
    narrow = store.narrow_state(9, urls)
    assert sorted(r.url for r in narrow.collect()) == ["u1500", "u5"]
    every = store._changes(store._now()).inputFiles()
    assert len(every) >= 64 and len(narrow.inputFiles()) <= 3
    # A small run rewrites the buckets that it touches; the others are carried over by name.
    before = store._base(store._now())["state"]
    store.load(3, posts(spark, 2999, 3001))
    store.compact(3)
    after = store._base(store._now())["state"]
    assert sum(before[b] != after[b] for b in before) <= 2 and store.narrow_state().count() == 3001


def test_first_per_url_is_cut_before_the_shuffle(spark):
    feed = spark.createDataFrame([("u", 1)], "url string, ord bigint").repartition(3)
    shown = plan(screening.first_per_url(feed))
    assert shown.count("WindowGroupLimit") == 2
    assert shown.rindex("WindowGroupLimit") > shown.index("Exchange hashpartitioning(url")


def test_dedupe_is_combined_on_the_map_side(spark):
    df = spark.createDataFrame([(1, "u", "a", 3.0, 1, date(2024, 1, 1))], "ord int, url string, address string, rooms double, price int, post_date date")
    shown = plan(dedupe.deduplicated(df))
    assert shown.count("partial_min_by") == 2 and "Window" not in shown


def test_small_updates_leave_the_state_where_it_is(spark, stored):
    records = spark.createDataFrame([], schemas.POSTS).withColumn("ord", F.lit(1))
    # Only the folding of the run's own records and the finding of its new URLs may shuffle.
    merged = state.upsert_posts(stored, records, datetime(2024, 1, 1))
    merged.collect()
    final = merged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in final and "SortMergeJoin" not in final.split("Initial Plan")[0]


def test_one_month_does_not_meet_in_one_task(spark):
    calls = spark.createDataFrame([], schemas.CALL_LOG)
    shown = plan(addresses.last_call_within_cap(calls, 9000))
    # What is ranked are calls of the range in which a month's budget ends: they are joined with it below the window.
    window, join = shown.index("Window"), shown.index("BroadcastHashJoin")
    assert window < join and "_end" in shown[join:] and "SortMergeJoin" not in shown


def hot(spark, n=6000):
    """A feed in which one URL, one address and one missing address hold a third of the rows each."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), "id")).alias("url"),
        F.when(F.col("id") % 3 == 1, "הרצל 1").when(F.col("id") % 3 == 2, F.concat(F.lit("הרצל "), "id")).alias("address"),
        F.col("id").alias("ord"),
        F.lit("x" * 30).alias("text"),
    )


def test_hot_keys_give_whole_results(spark):
    feed = hot(spark).repartition(6)
    assert screening.first_per_url(feed).count() == 4001
    none = spark.createDataFrame([], schemas.ADDRESS_CACHE)
    geo = spark.createDataFrame([("הרצל 1", False, [(["premise"], "הרצל 1, רמת גן", [])])], schemas.GEOCODES)
    routes = spark.createDataFrame([("הרצל 1, רמת גן", "OK", 700)], schemas.ROUTES)
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        resolved = addresses.resolve_addresses(addresses.distinct_addresses(feed), none, geo, routes, PARAMS)
        placed = addresses.with_distance(feed, resolved)
        got = {r[0]: r[1] for r in placed.groupBy("distance_meters").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert got == {700: 2000, None: 4000}
