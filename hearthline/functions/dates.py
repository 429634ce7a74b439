"""Post dates.  Every function takes the run's clock as a parameter; none reads the wall clock."""

from __future__ import annotations

from calendar import monthrange
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.functions.text import strip

# Seconds per unit; the unit is known by its first letter.
_UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
_RELATIVE = (
    r"(?U)^[0-9]+\s*(s|secs?|seconds?|m|mins?|minutes?|h|hrs?|hours?|d|days?|w|wks?|weeks?)\z"
)
_MONTH_DAY = r"(?U)\b([A-Za-z]+)\s+(\d{1,2})\b"
_DAY_MONTH = r"^([0-9]{1,2})/([0-9]{1,2})\z"
_MAX_SECONDS = 50_000_000_000  # further back than the calendar reaches


def clock(as_of: datetime) -> Column:
    """The run's clock as a zone-free timestamp column."""
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("int")


def _nearest(day: Column, month: Column, as_of: datetime, latest: datetime) -> Column:
    """The day and month in the clock's year, or in the year before if that lies after ``latest``.

    NULL unless the day exists in the clock's year and in the year taken.  The clock is known when the plan is built,
    so the month lengths and the turning point are literals.
    """
    year = as_of.year
    turn = 1231 if latest.year > year else latest.month * 100 + latest.day
    here = [monthrange(year, m)[1] for m in range(1, 13)]
    before = [min(monthrange(year - 1, m)[1], here[m - 1]) for m in range(1, 13)]
    last_year = month * 100 + day > turn

    def length(days):
        return F.get(F.array(*[F.lit(d) for d in days]), month - 1)

    exists = (day >= 1) & (day <= F.when(last_year, length(before)).otherwise(length(here)))
    return F.when(exists, F.make_date(F.when(last_year, year - 1).otherwise(F.lit(year)), month, day))


def _month_number(name: Column) -> Column:
    months = F.create_map(*[F.lit(x) for pair in P.MONTHS.items() for x in pair])
    return F.try_element_at(months, F.lower(name))


def relative_date(col: Column, as_of: datetime) -> Column:
    """Date of 'yesterday' or of a count and unit ('3 hrs', '2 wks'); NULL for anything else."""
    text = F.lower(strip(col))
    unit = F.regexp_extract(text, "[a-z]", 0)
    per_unit = F.lit(None).cast("bigint")
    for letter, seconds in _UNIT_SECONDS.items():
        per_unit = F.when(unit == letter, F.lit(seconds).cast("bigint")).otherwise(per_unit)
    count = F.nullif(F.regexp_extract(text, "^[0-9]+", 0), F.lit("")).try_cast("bigint")
    seconds = F.try_multiply(count, per_unit)
    near = F.when(seconds < _MAX_SECONDS, seconds)
    ago = clock(as_of) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), near.cast("decimal(18,6)"))
    return F.when(text == "yesterday", F.lit((as_of - timedelta(days=1)).date())).when(
        text.rlike(_RELATIVE), ago.cast("date")
    )


def absolute_date(col: Column, as_of: datetime) -> Column:
    """Date of an English month and day; only the leftmost word-and-number pair is tried."""
    month = _month_number(F.regexp_extract(col, _MONTH_DAY, 1))
    return _nearest(_number(col, _MONTH_DAY, 2), month, as_of, latest=as_of)


def infer_date(col: Column, as_of: datetime) -> Column:
    """Full date of DD/MM text: this year, or last year if that is more than a day ahead; NULL if it is no date."""
    text = strip(col)
    return _nearest(
        _number(text, _DAY_MONTH, 1), _number(text, _DAY_MONTH, 2), as_of, latest=as_of + timedelta(days=1)
    )


def with_post_date(rows: DataFrame, as_of: datetime, raw: str = "post_date_text") -> DataFrame:
    """Add ``post_date`` (DD/MM as shown, or the text as it came), ``posted_on`` (full date) and ``unparsed_date``.

    A recognised date is shown as day and month only, and its year is inferred from those again; each step is a
    projection of its own, so no pattern runs twice.
    """
    kept = rows.columns
    text, known = F.col("_text"), F.col("_known")
    stepped = (
        rows.withColumn("_text", strip(F.col(raw)))
        .withColumn("_relative", relative_date(text, as_of))
        .withColumns(
            {
                "_month_name": F.when(F.col("_relative").isNull(), F.regexp_extract(text, _MONTH_DAY, 1)),
                "_day_number": F.when(F.col("_relative").isNull(), _number(text, _MONTH_DAY, 2)),
            }
        )
        .withColumn("_month_number", _month_number(F.col("_month_name")))
        .withColumn(
            "_known",
            F.coalesce("_relative", _nearest(F.col("_day_number"), F.col("_month_number"), as_of, latest=as_of)),
        )
        .withColumns(
            {
                "_day": F.when(known.isNotNull(), F.day(known)).otherwise(_number(text, _DAY_MONTH, 1)),
                "_month": F.when(known.isNotNull(), F.month(known)).otherwise(_number(text, _DAY_MONTH, 2)),
            }
        )
    )
    return stepped.select(
        *kept,
        F.when(known.isNotNull(), F.date_format(known, "dd/MM")).otherwise(F.col(raw)).alias("post_date"),
        _nearest(F.col("_day"), F.col("_month"), as_of, latest=as_of + timedelta(days=1)).alias("posted_on"),
        (F.coalesce(F.length(text) > 0, F.lit(False)) & known.isNull()).alias("unparsed_date"),
    )


def is_recent(date: Column, as_of: datetime, max_age_days: int) -> Column:
    """True unless the date's midnight lies before the limit; an unknown date passes."""
    return F.coalesce(date.cast("timestamp_ntz") >= clock(as_of - timedelta(days=max_age_days)), F.lit(True))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")
