"""Cross-post removal, expiry and order of the published table.

Both steps keep the newest row of a key by an aggregate, not by a ranking window: it is combined on the map side, so a
listing that was re-posted into a third of the table reaches its final task as one row per input split, and the number
of copies and the first position come out of the same pass.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.functions import dates, text

_UNDATED = 2147483647
MIN_KEY_CHARS = 4


def _newest_first(date: Column) -> Column:
    """Sort key: small for new dates, largest for unknown ones."""
    return F.coalesce(-F.unix_date(date), F.lit(_UNDATED))


def url_key(url: Column, row: Column) -> Column:
    """Key of the first step; rows without a URL are never merged, so each gets a key of its own."""
    return F.coalesce(F.nullif(url, F.lit("")), F.concat(F.lit("\x00"), row.cast("string")))


def listing_key(address: Column, rooms: Column, price: Column, own_key: Column) -> Column:
    """Key of the second step: address, rooms and whole price; a weak address keeps the row's own key."""
    key = text.address_key(address)
    strong = F.length(key) >= MIN_KEY_CHARS
    return F.struct(
        F.when(strong, key).otherwise(own_key).alias("address"),
        F.when(strong, F.round(rooms.cast("double"), 1)).alias("rooms"),
        F.when(strong, price.cast("bigint")).alias("price"),
        strong.alias("strong"),
    )


def best_per_url(listings: DataFrame, order: str = "ord") -> DataFrame:
    """Newest row per URL; the earlier row wins a tie.  Adds ``pos`` (the URL's first position) and ``copies``."""
    columns = listings.columns
    best = listings.groupBy(url_key(F.col("url"), F.col(order)).alias("_own_key")).agg(
        F.min_by(F.struct(*columns), F.struct(_newest_first(F.col("post_date")), F.col(order))).alias("_row"),
        F.min(order).alias("pos"),
        F.count("*").alias("copies"),
    )
    return best.select("_row.*", "pos", "copies", "_own_key")


def best_per_listing(survivors: DataFrame) -> DataFrame:
    """Newest row per listing key; ties go to the URL seen first.  ``pos`` becomes the key's first position."""
    columns = [c for c in survivors.columns if c not in ("pos", "copies", "_own_key")]
    key = listing_key(F.col("address"), F.col("rooms"), F.col("price"), F.col("_own_key"))
    best = survivors.groupBy(key.alias("_key")).agg(
        F.min_by(F.struct(*columns), F.struct(_newest_first(F.col("post_date")), F.col("pos"))).alias("_row"),
        F.min("pos").alias("pos"),
        F.sum("copies").alias("copies"),
    )
    return best.select("_row.*", "pos", "copies")


def deduplicated(listings: DataFrame, order: str = "ord") -> DataFrame:
    return best_per_listing(best_per_url(listings, order))


def flag_stale(listings: DataFrame, as_of: datetime, params: P.ScreenParams) -> DataFrame:
    return listings.withColumn(
        "stale", ~dates.is_recent(F.col("post_date"), as_of, params.max_age_days)
    )


def newest_first(listings: DataFrame) -> DataFrame:
    """Newest first, unknown dates last, otherwise in order of first appearance."""
    return listings.orderBy(F.col("post_date").desc_nulls_last(), F.col("pos"))


def publish(listings: DataFrame, as_of: datetime, params: P.ScreenParams, order: str = "ord") -> DataFrame:
    """The published table: deduplicated by URL, then by listing, without stale rows, newest first."""
    flagged = flag_stale(deduplicated(listings, order), as_of, params)
    return newest_first(flagged.filter(~F.col("stale"))).drop("stale", "copies")


def publish_report(
    listings: DataFrame, as_of: datetime, params: P.ScreenParams, order: str = "ord"
) -> DataFrame:
    """Rows removed as duplicates, removed as stale, and kept."""
    return flag_stale(deduplicated(listings, order), as_of, params).agg(
        (F.coalesce(F.sum("copies"), F.lit(0)) - F.count("*")).alias("duplicates_removed"),
        F.count_if("stale").alias("stale_removed"),
        F.count_if(~F.col("stale")).alias("kept"),
    )
