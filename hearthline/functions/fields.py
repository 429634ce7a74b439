"""Normalisers and repairs of single listing fields: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.functions.text import address_key, any_contains, drop_direction_marks, hebrew_only, strip


def in_range(col: Column, low: float, high: float) -> Column:
    return (col >= F.lit(float(low))) & (col <= F.lit(float(high)))


def number_or_zero(col: Column) -> Column:
    """A number, 0 if missing or invalid."""
    return F.coalesce(col.try_cast("double"), F.lit(0.0))


def is_missing(col: Column) -> Column:
    return col.try_cast("double").isNull()


def join_thousands(col: Column) -> Column:
    """Drop a dot, comma or blank before exactly three digits: '6,500' -> '6500'."""
    return F.regexp_replace(col, P.THOUSANDS_SEPARATOR, "")


def price_candidates(text: Column) -> Column:
    """4-5 digit numbers next to a price word, in text order, as array<int>.

    A match holds one digit run only, since neither the marker nor the gap may contain a digit; so the number is
    what remains of the match without its other characters.
    """
    near = F.regexp_extract_all(join_thousands(drop_direction_marks(text)), F.lit(P.PRICE_NEAR_MARKER), F.lit(0))
    return F.transform(near, lambda m: F.regexp_replace(m, "[^0-9]", "").cast("int"))


def with_repaired_price(
    rows: DataFrame, price: Column, text: Column, params: P.ScreenParams, out: str = "price_val"
) -> DataFrame:
    """Add the model's price, or a number of the text where the model's is missing or absurd.

    The patterns run once, and only for prices outside the range.
    """
    value, candidates = F.col("_value"), F.col("_candidates")
    fits = in_range(value, params.min_price, params.max_price)
    first = F.get(candidates, F.lit(0)).cast("double")
    first_fit = F.get(F.filter(candidates, lambda c: c.between(params.min_price, params.max_price)), F.lit(0))
    absurd = (value < params.absurd_price_low) | (value > params.absurd_price_high)
    repaired = F.when(F.col("_missing"), first_fit.cast("double"))
    return (
        rows.withColumns({"_value": number_or_zero(price), "_missing": is_missing(price)})
        .withColumn("_candidates", F.when(~fits, price_candidates(text)))
        .withColumn(out, F.coalesce(repaired, F.when(absurd, first), value))
        .drop("_value", "_missing", "_candidates")
    )


def rooms_mentions(text: Column) -> Column:
    """Room counts stated in a text, in text order, as array<double>."""
    found = F.regexp_extract_all(drop_direction_marks(text), F.lit(P.ROOMS_MENTION), F.lit(1))
    return F.transform(found, lambda m: m.cast("double"))


def with_repaired_rooms(
    rows: DataFrame, rooms: Column, text: Column, params: P.ScreenParams, out: str = "rooms_val"
) -> DataFrame:
    """Add the model's room count; only where it is missing, the first mention within the limits."""
    fitting = F.filter(rooms_mentions(text), lambda r: in_range(r, params.min_rooms, params.max_rooms))
    return rows.withColumn(
        out, F.coalesce(rooms.try_cast("double"), F.when(is_missing(rooms), F.get(fitting, F.lit(0))), F.lit(0.0))
    )


def bimonthly_fee(raw: Column) -> Column:
    """Fee for two months: all digits as one number, doubled if stated per month; 0 if included; else NULL."""
    digits = F.regexp_replace(raw, r"(?U)[^\d]", "")
    amount = digits.try_cast("bigint")
    per_month = raw.rlike(P.FEE_PER_MONTH)
    return (
        F.when(F.length(digits) > 0, F.when(per_month, F.try_multiply(amount, F.lit(2).cast("bigint"))).otherwise(amount))
        .when(F.contains(raw, F.lit(P.FEE_INCLUDED)), F.lit(0).cast("bigint"))
    )


def is_implausible_fee(fee: Column, limit: int) -> Column:
    return F.coalesce(fee > limit, F.lit(False))


def floor_number(raw: Column) -> Column:
    """First digit run; without one, the first floor word in list order."""
    number = F.nullif(F.regexp_extract(raw, r"(?U)\d+", 0), F.lit(""))
    word = F.lit(None).cast("int")
    for text, value in reversed(P.FLOOR_WORDS):
        word = F.when(F.contains(raw, F.lit(text)), F.lit(value)).otherwise(word)
    return F.when(number.isNotNull(), number.try_cast("int")).otherwise(word)


def agent_flag(text: Column, stated: Column) -> Column:
    """True if the text speaks of an agency, unless it also denies one; then the stated flag."""
    return F.when(~text.rlike(P.AGENT_DENIED) & text.rlike(P.AGENT_WORDS), F.lit(True)).otherwise(stated)


def parking_class(raw: Column) -> Column:
    none, private, street = P.PARKING_LABELS
    text = strip(raw)
    return (
        F.when(text.rlike(P.PARKING_NONE), none)
        .when(text.rlike(P.PARKING_PRIVATE), private)
        .when(text.rlike(P.PARKING_STREET), street)
    )


def entry_date_text(raw: Column) -> Column:
    """Cleaned entry date; every wording of 'at once' becomes one token.  '' if nothing was stated."""
    clean = hebrew_only(raw)
    return F.coalesce(F.when(clean.rlike(P.IMMEDIATE_WORDS), P.IMMEDIATE_LABEL).otherwise(clean), F.lit(""))


def credible_address(address: Column, text: Column) -> Column:
    """Drop the address a model is known to invent, unless the post itself speaks of it."""
    invented = F.contains(address, F.lit(P.INVENTED_ADDRESS)) & ~any_contains(text, P.INVENTED_ADDRESS_EVIDENCE)
    return F.when(invented, "").otherwise(address)


def clean_address(address: Column, text: Column) -> Column:
    return credible_address(hebrew_only(F.coalesce(address, F.lit(""))), text)


def address_confidence(address: Column) -> Column:
    """struct(confidence, warning) of an address as written."""
    text = strip(F.coalesce(address, F.lit("")))

    def graded(confidence: str, warning: str) -> Column:
        return F.struct(F.lit(confidence).alias("confidence"), F.lit(warning).alias("warning"))

    return (
        F.when(text == "", graded("missing", P.WARN_MISSING))
        .when(text.isin(*P.CITY_ONLY), graded("low", P.WARN_CITY_ONLY))
        .when(~text.rlike(P.HEBREW_LETTER), graded("missing", P.WARN_INVALID))
        .when(text.rlike(P.STREET_WORDS) | text.rlike(r"(?U)\d"), graded("high", ""))
        .when(text.rlike(P.LANDMARK_WORDS), graded("medium", P.WARN_LANDMARK))
        .when(F.length(address_key(text)) < 4, graded("low", P.WARN_SHORT))
        .otherwise(graded("medium", P.WARN_NO_STREET))
    )


def finite_meters(distance: Column) -> Column:
    """Whole metres; NULL for text that is no number, NaN and infinities."""
    value = distance.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < 2147483647.0), value.cast("int"))


def km(meters: Column) -> Column:
    return meters / F.lit(1000.0)


def km_text(meters: Column) -> Column:
    """One-decimal kilometres, for display only."""
    return F.when(meters.isNotNull(), F.format_string("%.1f", km(meters)))
