"""The cascade and the judgement on posts of our own that cover the features of the rule pack."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline import schemas
from hearthline.functions import dates
from hearthline.operators import judging, screening

PARAMS = P.ScreenParams()

# text, reason
POSTS = [
    ("דירת 3 חדרים ברחוב הרצל 8, 6100 ₪", None),
    ("שלושה חדרים בבני ברק, 6100 ₪", "excluded_location:בני ברק"),
    ("מחפש שותפה לדירת 3 חדרים", "roommate_keyword:שותפ"),
    ("3 חדרים, מתאים לזוג או\nשני שותפים", None),
    ("3 חדרים, מיזוג, חדר לשותף", "roommate_keyword:שותף"),
    ("3 חדרים, מיטה זוגית, שותפים", "roommate_keyword:שותפ"),
    ("זוג " + "א" * 31 + " שותפים 3 חדרים", "roommate_keyword:שותפ"),
    ("סאבלט 3 חדרים", "negative_keyword:סאבלט"),
    ("למכירה 3 חדרים 2,395,000 ₪", "for_sale:2,395,000"),
    ("3 חדרים ב 2.5 מיליון", "for_sale:2.5 מיליון"),
    ("3 חדרים, טלפון 050-1234567", None),
    ("4 חדרים", "room_count_mismatch"),
    ("13 חדרים", "room_count_mismatch"),
    ("2.3 חדרים", None),
    ("3 וחצי חדרים", None),
    ("שלוש וחצי חד", None),
]


def test_cascade(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(POSTS)], "i int, text string")
    got = screening.apply_rules(df, PARAMS).orderBy("i").collect()
    reasons = [r.reject_reason for r in got]
    assert reasons == [w for _, w in POSTS]
    assert all((r.verdict == P.PREFILTERED) == (r.reject_reason is not None) for r in got)


def test_age_comes_first(spark):
    now = datetime(2024, 5, 22, 9, 0)
    rows = [(0, "סאבלט", "30d"), (1, "סאבלט", None), (2, "3 חדרים", "21d"), (3, "3 חדרים", "20d"), (4, "3 חדרים", "soon")]
    df = spark.createDataFrame(rows, "i int, text string, post_date_text string")
    got = screening.apply_rules(dates.with_post_date(df, now), PARAMS, now).orderBy("i").collect()
    # A post of exactly 21 days ago is dropped once midnight has passed.
    assert [r.reject_reason for r in got] == ["older_than_21_days", "negative_keyword:סאבלט", "older_than_21_days", None, None]


def test_found_rooms_and_first_excluded(spark):
    rules = P.RulePack(excluded_places=("חולון", "בת ים"))
    df = spark.createDataFrame([(0, "4.5 חדרים בבת ים ובחולון")], "i int, text string")
    row = screening.rule_hits(df, P.ScreenParams(rules=rules)).first()
    assert row.found_rooms == "4.5" and row.excluded_place
    assert screening.apply_rules(df, P.ScreenParams(rules=rules)).first().reject_reason == "excluded_location:חולון"


def test_feed_preparation_and_first_per_url(spark):
    rows = [("u1", "x" * 21, 2), ("u1", "y" * 21, 1), (None, "z" * 30, 3), ("u2", " short ", 4)]
    feed = spark.createDataFrame(rows, "url string, text string, ord bigint")
    kept = screening.first_per_url(screening.prepare_feed(feed, PARAMS)).collect()
    assert [(r.url, r.ord) for r in kept] == [("u1", 1)]


def _record(**values):
    return tuple(values.get(f.name) for f in schemas.RECORD.fields)


def _judge(spark, rows, params=PARAMS):
    schema = "i int, text string, verdict string, reject_reason string, record " + schemas.RECORD.simpleString()
    df = spark.createDataFrame([(i, t, v, None, r) for i, (t, v, r) in enumerate(rows)], schema)
    return judging.judge(df, params).orderBy("i").collect()


def test_verdicts(spark):
    rows = [
        ("3 חדרים 6200 ₪", None, _record(rooms=3.0, price=6200, vaad="250 לחודש", floor="3", address="הרצל 5")),
        ("3 חדרים", None, _record(rooms=4.0, price=9000)),
        ("3 חדרים", None, _record(rooms=3.0)),
        ("3 חדרים", None, _record(rooms=3.0, price=0)),
        ("3 חדרים, היה 6,500 עכשיו 7,200 ₪", None, _record(rooms=3.0, price=7200)),
        ("3 חדרים, היה 6,500 עכשיו 7,200 ₪", None, _record(rooms=3.0)),
        ("3 חדרים ₪ 9000", None, _record(rooms=None, price=None)),
        ("סאבלט", P.PREFILTERED, None),
        ("3 חדרים", None, None),
        ("3 חדרים", None, _record(rooms=3.5, price=6700)),
        ("3 חדרים", None, _record(rooms=float("nan"), price=6000)),
    ]
    got = _judge(spark, rows)
    assert [r.verdict for r in got] == [
        "added", "rejected_rooms", "price_unknown", "rejected_price", "rejected_price", "rejected_price",
        "rejected_price", "prefiltered", "parse_failed", "added", "rejected_rooms",
    ]
    assert (got[0].vaad, got[0].floor, got[0].address, got[0].price_val) == (500, 3, "הרצל 5", 6200.0)
    assert got[1].address is None and got[7].price_val is None
    assert _judge(spark, [rows[2]], P.ScreenParams(include_price_unknown=True))[0].verdict == "added"


@pytest.mark.parametrize("meters,measured,verdict", [(4000, True, "added"), (4001, True, "rejected_distance"), (9000, False, "added"), (None, True, "added")])
def test_distance_limit(spark, meters, measured, verdict):
    df = spark.createDataFrame([("added", meters, measured)], "verdict string, distance_meters int, is_measured boolean")
    assert judging.limit_distance(df, PARAMS).first().verdict == verdict


def test_published_row(spark):
    now = datetime(2024, 5, 22, 9, 30)
    df = spark.createDataFrame(
        [("u", 6200.0, 3.5, 1250, "מיידי", 3, True, None, 500, None, None, False, datetime(2024, 5, 2).date(), "הרצל 5")],
        "url string, price_val double, rooms_val double, distance_meters int, entry_date string, floor int, elevator boolean,"
        " parking string, arnona bigint, vaad bigint, shelter boolean, is_agent boolean, posted_on date, address string",
    )
    row = judging.listing_row(df, dates.clock(now))
    assert row.schema.simpleString() == schemas.LISTINGS.simpleString()
    shown = judging.rendered_row(row).first()
    assert tuple(shown)[:3] == ("u", "6200", "3.5") and len(shown) == len(P.LISTING_HEADERS)
    assert (shown.elevator, shown.shelter, shown.is_agent, shown.post_date, shown.scanned_at) == ("כן", "", "לא", "02/05", "2024-05-22 09:30")


def test_fee_flags(spark):
    df = spark.createDataFrame([(2401, 3000), (None, 3001)], "vaad bigint, arnona bigint")
    got = judging.fee_quality(df, PARAMS).orderBy(F.col("vaad").desc_nulls_last()).collect()
    assert [(r.vaad_implausible, r.arnona_implausible) for r in got] == [(True, False), (False, True)]
