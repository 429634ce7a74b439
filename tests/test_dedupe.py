from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest

from hearthline import params as P
from hearthline.operators import dedupe

PARAMS = P.ScreenParams()
NOW = datetime(2024, 5, 22, 9, 0)
SCHEMA = "ord bigint, url string, address string, rooms double, price bigint, post_date date"


def plain(rows):
    """The published table as a loop over rows would keep it."""
    newer = lambda a, b: (a[5] or date.min) > (b[5] or date.min)
    by_url = {}
    for r in rows:
        key = r[1] or ("row", r[0])
        if key not in by_url or newer(r, by_url[key]):
            by_url[key] = r
    by_key = {}
    for own, r in by_url.items():
        strong = r[2] is not None and len(r[2]) >= 4
        key = (r[2], r[3], r[4]) if strong else own
        if key not in by_key or newer(r, by_key[key]):
            by_key[key] = r
    kept = list(by_key.values())
    fresh = [r for r in kept if r[5] is None or datetime.combine(r[5], datetime.min.time()) >= NOW - timedelta(days=21)]
    fresh.sort(key=lambda r: r[5] or date.min, reverse=True)
    return [r[0] for r in fresh], (len(rows) - len(kept), len(kept) - len(fresh), len(fresh))


def random_rows(seed, n=120):
    rng = random.Random(seed)
    return [
        (
            i,
            rng.choice(["", *(f"u{k}" for k in range(25))]),
            rng.choice(["רחוב א", "רחוב ב", "אב", "", None]),
            rng.choice([3.0, 3.5, None]),
            rng.choice([5500, 6000, None]),
            rng.choice([None, *(date(2024, 5, 22) - timedelta(days=d) for d in (0, 1, 5, 20, 21, 22, 60))]),
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(12))
def test_publish_equals_the_loop(spark, seed):
    rows = random_rows(seed, 20 + 15 * seed)
    want, report = plain(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.ord for r in dedupe.publish(df, NOW, PARAMS).collect()] == want
    assert tuple(dedupe.publish_report(df, NOW, PARAMS).first()) == report


def test_a_third_of_the_table_under_one_url_and_one_listing(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"u{i}", "רחוב חם" if i % 3 == 1 else f"רחוב {i}", 3.0, 6000, date(2024, 5, 20)) for i in range(3000)]
    want, report = plain(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert [r.ord for r in dedupe.publish(df, NOW, PARAMS).collect()] == want
    assert tuple(dedupe.publish_report(df, NOW, PARAMS).first()) == report


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dedupe.publish(df, NOW, PARAMS).count() == 0
    assert tuple(dedupe.publish_report(df, NOW, PARAMS).first()) == (0, 0, 0)
