from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline import schemas
from hearthline.operators import reports, state

PARAMS = P.ScreenParams()
TYPES = {f.name: f.dataType for f in schemas.POSTS.fields}


def records(spark, rows):
    """Records of (url, verdict, price, ord)."""
    df = spark.createDataFrame(rows, "url string, verdict string, price_val double, ord bigint")
    return df.withColumns({c: F.lit(None).cast(TYPES[c]) for c in state.REPLACED if c not in ("verdict", "price_val")})


def loop(runs):
    """The state table as single-row upserts would leave it."""
    table = {}
    for now, rows in runs:
        for url, verdict, price, _ in sorted(rows, key=lambda r: r[3]):
            old = table.get(url)
            attempts = (old[2] if old else 0) + (verdict == P.PARSE_FAILED)
            table[url] = (verdict, price, attempts, old[3] if old else now, now)
    return table


def as_dict(df):
    return {r.url: (r.verdict, r.price_val, r.attempts, r.first_seen, r.last_processed) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_upsert_equals_row_by_row(spark, seed):
    rng = random.Random(seed)
    runs = []
    for n in range(3):
        rows = [
            (f"u{rng.randint(0, 12)}", rng.choice([*P.VERDICTS, None]), rng.choice([None, 5500.0, 6000.0]), i)
            for i in range(rng.randint(1, 25))
        ]
        runs.append((datetime(2024, 1, 1 + n), rows))
    table = spark.createDataFrame([], schemas.POSTS)
    change_table = None
    for n, (now, rows) in enumerate(runs):
        table = state.upsert_posts(table, records(spark, rows), now)
        part = state.changes(records(spark, rows), now).withColumn("batch_id", F.lit(n).cast("bigint"))
        change_table = part if change_table is None else change_table.unionByName(part)
    want = loop(runs)
    assert table.schema.simpleString() == schemas.POSTS.simpleString()
    assert as_dict(table) == want
    folded = state.current_state(change_table)
    assert folded.schema.simpleString() == schemas.POSTS.simpleString()
    assert as_dict(folded) == want
    narrow = {r.url: (r.verdict, r.attempts) for r in state.narrow_state(change_table).collect()}
    assert {u: (v, n) for u, (v, n) in narrow.items()} == {u: (w[0], w[2]) for u, w in want.items()}


def test_skip_processed(spark):
    rows = [("a", P.ADDED, 0), ("b", P.PARSE_FAILED, 2), ("c", P.PARSE_FAILED, 3), ("d", None, 0)]
    known = spark.createDataFrame(rows, "url string, verdict string, attempts int")
    feed = spark.createDataFrame([(u,) for u in "abcde"], "url string")
    assert sorted(r.url for r in state.skip_processed(feed, known, PARAMS).collect()) == ["b", "e"]


def test_published(spark):
    listed = spark.createDataFrame([("a",), ("",), ("a",), (None,)], "url string")
    feed = spark.createDataFrame([("a",), ("b",)], "url string")
    assert [r.url for r in state.skip_published(feed, listed).collect()] == ["b"]
    assert [r.url for r in state.published_urls(listed).collect()] == ["a"]
    assert sorted(r.url for r in state.with_published(state.published_urls(listed), feed).collect()) == ["a", "b"]


def test_retention(spark):
    now = datetime(2024, 5, 22, 9, 0)
    rows = [("old", now - timedelta(days=22)), ("edge", now - timedelta(days=21)), ("bare", now - timedelta(days=50))]
    df = spark.createDataFrame(rows, "url string, first_seen timestamp_ntz").withColumns(
        {"raw_text": F.when(F.col("url") != "bare", "t"), "parsed_json": F.lit("{}"), "verdict": F.lit("added")}
    )
    kept = {r.url: (r.raw_text, r.parsed_json, r.verdict) for r in state.retain(df, now, PARAMS).collect()}
    assert kept == {"old": (None, None, "added"), "edge": ("t", "{}", "added"), "bare": (None, None, "added")}
    assert tuple(state.retention_report(df, now, PARAMS).first()) == (1, 3)


def test_cache_and_usage(spark):
    def rows(*items):
        full = [(k, k, "", "", "high", "", "", m, "google_maps", "ok", datetime(2024, 1, d)) for k, m, d in items]
        return spark.createDataFrame(full, schemas.ADDRESS_CACHE)

    merged = state.upsert_cache(rows(("a", 1, 2), ("b", 2, 1)), rows(("a", 3, 2), ("c", 4, 1), ("c", 5, 3)))
    assert {r.address_key: r.distance_meters for r in merged.collect()} == {"a": 3, "b": 2, "c": 5}
    usage = spark.createDataFrame([("2024-01", 3)], schemas.API_USAGE)
    calls = spark.createDataFrame([(datetime(2024, 1, 31), 1, "x"), (datetime(2024, 2, 1), 2, "x")], schemas.CALL_LOG)
    assert {r.month: r.calls for r in state.upsert_usage(usage, calls).collect()} == {"2024-01": 4, "2024-02": 1}


def test_reports(spark):
    df = spark.createDataFrame([("g1", P.ADDED), ("g1", P.PREFILTERED), ("g2", P.PARSE_FAILED)], "group_url string, verdict string")
    counts = [tuple(r) for r in reports.all_verdict_counts(df).collect()]
    assert [c[1] for c in counts] == list(P.VERDICTS) and [c[2] for c in counts] == [1, 0, 0, 0, 1, 1, 0]
    got = {(r.group_url, r.is_total): (r.seen, r.prefiltered, r.sent, r.added) for r in reports.run_summary(df).collect()}
    assert got == {("g1", 0): (2, 1, 1, 1), ("g2", 0): (1, 0, 1, 0), (None, 1): (3, 1, 2, 1)}


def test_blanked_invention(spark):
    df = spark.createDataFrame([("נמל התעופה", 5), ("הרצל", 6), (None, 7)], "address string, distance_meters int")
    got = state.blank_invented_addresses(df).collect()
    assert sorted((r.address or "", r.distance_meters or 0) for r in got) == [("", 0), ("", 7), ("הרצל", 6)]
