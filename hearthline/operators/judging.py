"""From a validated record and its text to a verdict and normalised fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.functions import fields, text

FIELDS = (
    "arnona", "vaad", "address", "floor", "is_agent", "parking", "entry_date", "elevator", "shelter",
)


def price_rooms_verdict(price: Column, price_missing: Column, rooms: Column, params: P.ScreenParams) -> Column:
    """Rooms before price; both bounds count as inside."""
    unknown = (price == 0) & price_missing
    return (
        F.when(~fields.in_range(rooms, params.min_rooms, params.max_rooms), P.REJECTED_ROOMS)
        .when(unknown, P.ADDED if params.include_price_unknown else P.PRICE_UNKNOWN)
        .when(~fields.in_range(price, params.min_price, params.max_price), P.REJECTED_PRICE)
        .otherwise(P.ADDED)
    )


def judge(rows: DataFrame, params: P.ScreenParams) -> DataFrame:
    """Judge rows of (text, record).  A row that already has a verdict keeps it; one without a record has failed."""
    post, record = F.col("_post"), F.col("record")
    open_row = F.col("verdict").isNull()
    has_record = open_row & record.isNotNull()
    # Only rows that are judged here show their text to the patterns.
    repaired = rows.withColumn("_post", F.when(has_record, F.col("text")))
    repaired = fields.with_repaired_price(repaired, record["price"], post, params)
    repaired = fields.with_repaired_rooms(repaired, record["rooms"], post, params)
    repaired = repaired.withColumns(
        {c: F.when(has_record, F.col(c)) for c in ("price_val", "rooms_val")}
    )
    verdict = (
        F.when(~open_row, F.col("verdict"))
        .when(record.isNull(), P.PARSE_FAILED)
        .otherwise(
            price_rooms_verdict(F.col("price_val"), fields.is_missing(record["price"]), F.col("rooms_val"), params)
        )
    )
    normal = {
        "arnona": fields.bimonthly_fee(record["arnona"]),
        "vaad": fields.bimonthly_fee(record["vaad"]),
        "address": fields.clean_address(record["address"], post),
        "floor": fields.floor_number(record["floor"]),
        "is_agent": fields.agent_flag(post, record["is_agent"]),
        "parking": fields.parking_class(record["parking"]),
        "entry_date": fields.entry_date_text(record["entry_date"]),
        "elevator": record["elevator"],
        "shelter": record["shelter"],
    }
    return (
        repaired.withColumn("_open", has_record)
        .withColumn("verdict", verdict)
        .withColumns({name: F.when(F.col("_open") & (F.col("verdict") == P.ADDED), normal[name]) for name in FIELDS})
        .drop("_open", "_post")
    )


def fee_quality(rows: DataFrame, params: P.ScreenParams) -> DataFrame:
    """Flag fees that are too high to be true."""
    return rows.withColumns(
        {
            "vaad_implausible": fields.is_implausible_fee(F.col("vaad"), params.max_vaad),
            "arnona_implausible": fields.is_implausible_fee(F.col("arnona"), params.max_arnona),
        }
    )


def too_far(meters: Column, is_measured: Column, params: P.ScreenParams) -> Column:
    """Only a measured distance strictly beyond the limit counts."""
    return F.coalesce(is_measured & (fields.km(meters) > params.max_distance_km), F.lit(False))


def limit_distance(rows: DataFrame, params: P.ScreenParams) -> DataFrame:
    far = (F.col("verdict") == P.ADDED) & too_far(F.col("distance_meters"), F.col("is_measured"), params)
    return rows.withColumn("verdict", F.when(far, P.REJECTED_DISTANCE).otherwise(F.col("verdict")))


def file_reason(rows: DataFrame) -> DataFrame:
    """Rejected rows carry their verdict as the reason, unless a rule gave one."""
    plain = F.when(F.col("verdict").isin(P.ADDED, P.PARSE_FAILED), "").otherwise(F.col("verdict"))
    return rows.withColumn("reject_reason", F.coalesce(F.col("reject_reason"), plain))


def listing_row(rows: DataFrame, scanned_at: Column) -> DataFrame:
    """The 15 typed columns of the published table."""
    return rows.select(
        "url",
        F.when(F.col("price_val") != 0, F.col("price_val").cast("int")).alias("price"),
        F.col("rooms_val").alias("rooms"),
        F.round(fields.km(F.col("distance_meters")), 3).alias("distance_km"),
        "entry_date",
        "floor",
        "elevator",
        "parking",
        "arnona",
        "vaad",
        "shelter",
        "is_agent",
        F.col("posted_on").alias("post_date"),
        "address",
        scanned_at.alias("scanned_at"),
    )


def rendered_row(listings: DataFrame) -> DataFrame:
    """The published table as display text, one string per column."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return listings.select(
        shown("url").alias("url"),
        shown("price").alias("price"),
        shown("rooms").alias("rooms"),
        F.when(F.col("distance_km").isNull(), "")
        .otherwise(F.format_string("%.1f", F.col("distance_km")))
        .alias("distance_km"),
        shown("entry_date").alias("entry_date"),
        shown("floor").alias("floor"),
        text.tri_state(F.col("elevator")).alias("elevator"),
        shown("parking").alias("parking"),
        shown("arnona").alias("arnona"),
        shown("vaad").alias("vaad"),
        text.tri_state(F.col("shelter")).alias("shelter"),
        text.tri_state(F.col("is_agent")).alias("is_agent"),
        F.coalesce(F.date_format("post_date", "dd/MM"), F.lit("")).alias("post_date"),
        shown("address").alias("address"),
        F.coalesce(F.date_format("scanned_at", "yyyy-MM-dd HH:mm"), F.lit("")).alias("scanned_at"),
    )


def analysis_columns(rows: DataFrame) -> DataFrame:
    """The analysis part of a state row."""
    return rows.select(
        "url",
        "price_val",
        "rooms_val",
        "address",
        "address_confidence",
        "distance_text",
        "distance_meters",
        "post_date",
        "reject_reason",
        "model_used",
    )
