from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline import schemas
from hearthline.functions import text
from hearthline.operators import addresses, reports, state

PARAMS = P.ScreenParams()


def result(types=("street_address",), formatted="הרצל 5, רמת גן, ישראל", **parts):
    return (list(types), formatted, [(name, [kind.replace("admin", "administrative_area_level_"), "political"]) for kind, name in parts.items()])


def geocodes(spark, answers):
    return spark.createDataFrame([(k, failed, results) for k, (failed, results) in answers.items()], schemas.GEOCODES)


GOOD = result(locality="רמת גן")
CASES = {
    "ok": (False, [GOOD]),
    "geocode_error": (True, []),
    "not_found": (False, []),
    "wrong_city": (False, [result(formatted="חיפה", locality="חיפה"), GOOD]),
    "not_street_precision": (False, [result(types=["locality"], locality="גבעתיים")]),
}


def test_accept_geocode(spark):
    rows = geocodes(spark, CASES).withColumns(
        {"address": F.col("address_key"), "confidence": F.lit("medium"), "asked": F.lit(True)}
    )
    got = {r.address_key: r for r in addresses.accept_geocode(rows, PARAMS).collect()}
    assert {k: r.geocode_status for k, r in got.items()} == {k: k for k in CASES}
    assert got["ok"].geocode_confidence == "high" and got["ok"].canonical_address == "הרצל 5, רמת גן, ישראל"
    assert got["wrong_city"].city == "חיפה" and got["wrong_city"].geocode_confidence == "low"
    assert got["geocode_error"].geocode_confidence == "medium" and got["geocode_error"].canonical_address == "geocode_error"
    for column, value, status in (("confidence", "low", "skipped_low_confidence"), ("asked", False, "quota")):
        again = addresses.accept_geocode(rows.withColumn(column, F.lit(value)), PARAMS)
        assert {r.geocode_status for r in again.collect()} == {status}
    off = addresses.accept_geocode(rows, P.ScreenParams(validate_addresses=False))
    assert {r.geocode_status for r in off.collect()} == {"disabled"}


def test_city_and_precision(spark):
    answers = {
        "level2": (False, [result(admin1="מחוז", admin2="גבעתיים")]),
        "level1": (False, [result(types=["geocode"], admin1="תל אביב", route="הרצל")]),
        "none": (False, [result(types=["subpremise"])]),
    }
    best = F.get("results", F.lit(0))
    got = {
        r[0]: tuple(r)[1:]
        for r in geocodes(spark, answers).select(
            "address_key",
            addresses.result_city(best),
            addresses.has_street(best),
            addresses.has_street(best, P.STREET_LEVEL_TYPES, P.STREET_LEVEL_TYPES),
        ).collect()
    }
    assert got == {"level2": ("גבעתיים", True, True), "level1": ("תל אביב", True, True), "none": ("", False, True)}


def cache(spark, rows):
    full = [(k, k, "", "", conf, "cached", "", meters, source, "ok", datetime(2024, 1, 1)) for k, conf, meters, source in rows]
    return spark.createDataFrame(full, schemas.ADDRESS_CACHE)


def test_distances(spark):
    listed = {
        "u1": "הרצל 1", "u2": "הרצל 2", "u3": "הרצל 3", "u4": "הרצל 4", "u5": "הרצל 5", "u6": "הרצל 6",
        "u7": "רמת גן", "u8": "ab", "u9": None, "u10": "הרצל 10", "u11": " הרצל  1", "u12": "הרצל 12",
    }
    rows = spark.createDataFrame(list(listed.items()), "url string, address string")
    found = {f"הרצל {n}": (False, [result(formatted=f"מקום {n}", locality="רמת גן")]) for n in (1, 2, 3, 5, 6, 12)}
    geo = geocodes(spark, found | {"הרצל 4": (False, [])})
    routes = spark.createDataFrame(
        [("מקום 1", "OK", 1200), ("מקום 2", "ZERO_RESULTS", None), ("מקום 3", "ERROR", None), ("מקום 12", "OK", 9)], schemas.ROUTES
    )
    hits = cache(spark, [("הרצל 6", "", 0, P.SOURCE_MEASURED), ("הרצל 10", "low", None, P.SOURCE_SKIPPED), ("הרצל 12", "high", 7, P.SOURCE_QUOTA)])
    resolved = addresses.resolve_addresses(addresses.distinct_addresses(rows), hits, geo, routes, PARAMS)
    got = {r.url: r for r in addresses.with_distance(rows, resolved).collect()}
    assert len(got) == len(listed)
    want = {
        "u1": (1200, "google_maps", True, "high", ""),
        "u2": (None, "google_maps_failed", False, "high", P.WARN_NO_ROUTE),
        "u3": (None, "google_maps_error", False, "high", P.WARN_ROUTE_ERROR),
        "u4": (None, "skipped", False, "low", P.WARN_NOT_FOUND),
        "u5": (None, "quota", False, "high", ""),
        "u6": (0, "cache", True, "high", "cached"),
        "u7": (None, "skipped", False, "low", P.WARN_CITY_ONLY),
        "u8": (None, "skipped", False, "missing", P.WARN_MISSING),
        "u9": (None, "skipped", False, "missing", P.WARN_MISSING),
        "u10": (None, "cache", False, "low", "cached"),
        "u11": (1200, "google_maps", True, "high", ""),
        "u12": (9, "google_maps", True, "high", ""),
    }
    for url, expected in want.items():
        r = got[url]
        assert (r.distance_meters, r.distance_source, r.is_measured, r.address_confidence, r.address_warning) == expected, url
    assert got["u1"].distance_text == "1.2" and got["u5"].distance_text == P.WARN_QUOTA


def test_new_cache_rows_fit_the_cache(spark):
    rows = spark.createDataFrame([("u1", "הרצל 1"), ("u2", "הרצל 1")], "url string, address string")
    empty = cache(spark, [])
    routes = spark.createDataFrame([("הרצל 5, רמת גן, ישראל", "OK", 1200)], schemas.ROUTES)
    resolved = addresses.resolve_addresses(
        addresses.distinct_addresses(rows), empty, geocodes(spark, {"הרצל 1": (False, [GOOD])}), routes, PARAMS
    )
    new = addresses.new_cache_rows(resolved, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    merged = state.upsert_cache(empty, new).collect()
    assert [(r.address_key, r.distance_meters, r.canonical_address) for r in merged] == [("הרצל 1", 1200, "הרצל 5, רמת גן, ישראל")]


def test_repair(spark):
    tel_aviv = result(formatted="דיזנגוף 1, תל אביב", locality="תל אביב-יפו")
    rows = {
        "blank": "", "none": None, "invented": "נמל התעופה", "lost": "רחוב לא ידוע", "home": "הרצל 5 רג", "near": "דיזנגוף 1",
        "far": "דיזנגוף 2", "nowhere": "דיזנגוף 3", "other": "חיפה 1", "forced": "ביאליק 9", "broken": "שבור 1", "broken2": "שבור 2",
    }
    geo = geocodes(
        spark,
        {
            "הרצל 5 רמת גן": (False, [GOOD]),
            "דיזנגוף 1": (False, [tel_aviv]),
            "דיזנגוף 2": (False, [result(formatted="דיזנגוף 2, תל אביב", locality="תל אביב-יפו")]),
            "דיזנגוף 3": (False, [result(formatted="דיזנגוף 3, תל אביב", locality="תל אביב-יפו")]),
            "חיפה 1": (False, [result(formatted="חיפה", locality="חיפה")]),
            "ביאליק 9, גבעתיים": (False, [result(formatted="ביאליק 9, גבעתיים", locality="גבעתיים")]),
            "שבור 1": (True, []),
            "שבור 2, רמת גן": (True, []),
            "שבור 2, גבעתיים": (False, [GOOD]),
        },
    )
    routes = spark.createDataFrame(
        [("הרצל 5, רמת גן, ישראל", "OK", 900), ("דיזנגוף 1, תל אביב", "OK", 4000), ("דיזנגוף 2, תל אביב", "OK", 4001)], schemas.ROUTES
    )
    listings = spark.createDataFrame([(k, a, 5.0) for k, a in rows.items()], "url string, address string, distance_km double")
    planned = addresses.repair_addresses(listings, geo, routes, PARAMS)
    got = {r.url: r for r in planned.collect()}
    assert {k: r.action for k, r in got.items()} == {
        "blank": "unchanged", "none": "unchanged", "invented": "blanked", "lost": "unresolved", "home": "updated", "near": "updated",
        "far": "dropped", "nowhere": "dropped", "other": "other_city", "forced": "updated", "broken": "unresolved", "broken2": "unresolved",
    }
    assert (got["home"].new_address, got["home"].new_distance_km) == ("הרצל 5, רמת גן, ישראל", 0.9)
    assert got["forced"].new_address == "ביאליק 9, גבעתיים" and got["invented"].new_distance_km is None
    done = {r.url: r.address for r in addresses.apply_repair(planned).collect()}
    assert "far" not in done and done["other"] == "חיפה 1" and len(done) == 10
    report = addresses.repair_report(planned).first()
    assert tuple(report) == (12, 3, 2, 3, 10)


@pytest.mark.parametrize("cap", [0, 1, 7, 50, 1000])
def test_budget_equals_a_counter(spark, cap):
    rng = random.Random(cap)
    start = datetime(2024, 1, 25)
    calls = [(start + timedelta(hours=rng.randint(0, 300)), n, "geo") for n in range(200)]
    used, allowed, halted, stopped = {}, {}, [], False
    for ts, n, _ in sorted(calls):
        month = ts.strftime("%Y-%m")
        allowed[n] = used.get(month, 0) < cap
        stopped = stopped or not allowed[n]
        used[month] = used.get(month, 0) + allowed[n]
        if not stopped:
            halted.append(n)
    df = spark.createDataFrame(calls, schemas.CALL_LOG)
    assert {r.call_id: r.allowed for r in addresses.within_budget(df, cap).collect()} == allowed
    assert sorted(r.call_id for r in addresses.within_budget(df, cap, "halt").collect()) == sorted(halted)


def test_quota_status(spark):
    usage = spark.createDataFrame([("2024-01", 7199), ("2024-02", 7200), ("2024-03", 9500)], schemas.API_USAGE)
    got = [(r.used, r.remaining, r.alert) for r in reports.quota_status(usage, PARAMS).orderBy("month").collect()]
    assert got == [(7199, 1801, False), (7200, 1800, True), (9500, 0, True)]
    assert not reports.quota_status(usage, P.ScreenParams(monthly_call_cap=0)).filter("alert").count()


def test_cache_key_is_shared(spark):
    df = spark.createDataFrame([(" Herzl  ST",)], "a string").select(text.cache_key(F.col("a")))
    assert df.first()[0] == "herzl st"
