from __future__ import annotations

import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearthline.functions import dates

CLOCKS = [datetime(2024, 2, 29, 8, 0), datetime(2025, 1, 2, 23, 30), datetime(2023, 12, 31, 12, 0), datetime(2025, 3, 1, 0, 0)]


def _on(year, month, day):
    try:
        return date(year, month, day)
    except ValueError:
        return None


def _near(day, month, now, latest):
    here = _on(now.year, month, day)
    if here is None:
        return None
    return _on(now.year - 1, month, day) if datetime.combine(here, datetime.min.time()) > latest else here


def plain_infer(value, now):
    m = re.match(r"^(\d{1,2})/(\d{1,2})$", value.strip())
    return _near(int(m[1]), int(m[2]), now, now + timedelta(days=1)) if m else None


@pytest.mark.parametrize("now", CLOCKS)
def test_infer_every_day(apply, now):
    values = [f"{d}/{m}" for d in range(0, 33) for m in range(0, 14)] + ["01/02", " 3/4 ", "1/2/3", "x", "", "111/2"]
    assert apply(lambda c: dates.infer_date(c, now), values) == [plain_infer(v, now) for v in values]


@pytest.mark.parametrize("now", CLOCKS)
def test_absolute_every_day(apply, now):
    names = ["Jan", "february", "MAR", "Apr", "may", "June", "jul", "August", "sept", "oct", "Nov", "dec"]
    values = [f"{n} {d} at 5:50 PM" for n in names for d in (0, 1, 2, 3, 28, 29, 30, 31, 32)]
    want = [_near(d, i + 1, now, now) if d else None for i, n in enumerate(names) for d in (0, 1, 2, 3, 28, 29, 30, 31, 32)]
    assert apply(lambda c: dates.absolute_date(c, now), values) == want


def test_only_the_leftmost_pair_is_tried(apply):
    now = CLOCKS[1]
    values = ["Yesterday at 5, July 9", "9 July", "July 9", "on July 9 2024", None, "July 123"]
    assert apply(lambda c: dates.absolute_date(c, now), values) == [None, None, date(2024, 7, 9), date(2024, 7, 9), None, None]


def test_relative(apply):
    now = CLOCKS[1]
    units = {"s": 1, "secs": 1, "m": 60, " Min": 60, "minutes": 60, "h": 3600, " hrs": 3600, "D": 86400, " day": 86400, "w": 604800, " WKS": 604800}
    rng = random.Random(5)
    values, want = [], []
    for unit, seconds in units.items():
        for n in [0, 1] + [rng.randint(2, 3000) for _ in range(4)]:
            values.append(f"{n}{unit}")
            want.append((now - timedelta(seconds=n * seconds)).date())
    values += ["yesterday", " YESTERDAY ", "yesterday at 5", "3 months", "h", "", None, "3.5h", "999999999w"]
    want += [date(2025, 1, 1)] * 2 + [None] * 7
    assert apply(lambda c: dates.relative_date(c, now), values) == want


def test_post_date_steps(spark):
    now = datetime(2025, 1, 2, 23, 30)
    rows = ["3 hrs", "yesterday", "July 9 at 5:50 PM", "31/12", "9 ביולי", "", None, "Feb 30", "400d"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, post_date_text string")
    got = dates.with_post_date(df, now).orderBy("i").collect()
    assert [r.post_date for r in got] == ["02/01", "01/01", "09/07", "31/12", "9 ביולי", "", None, "Feb 30", "29/11"]
    assert [r.posted_on for r in got] == [
        date(2025, 1, 2), date(2025, 1, 1), date(2024, 7, 9), date(2024, 12, 31), None, None, None, None, date(2024, 11, 29),
    ]
    assert [r.unparsed_date for r in got] == [False, False, False, True, True, False, False, True, False]


def test_recency_uses_the_time_of_day(apply):
    now = datetime(2024, 5, 22, 9, 0)
    values = ["2024-05-01", "2024-05-02", None]
    assert apply(lambda c: dates.is_recent(c.cast("date"), now, 21), values) == [False, True, True]
    assert apply(lambda c: dates.month_key(F.to_timestamp_ntz(c)), ["2024-05-01 10:00:00"]) == ["2024-05"]
