"""The keyed history of posts: which posts to skip, how to record new results, what to forget."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline import schemas
from hearthline.functions.dates import clock, month_key

_KEPT = ("url", "attempts", "first_seen", "last_processed")
REPLACED = tuple(f.name for f in schemas.POSTS.fields if f.name not in _KEPT)
_HANDED_OUT = 100_000  # keys that a join may send to every executor by way of the driver


def many(rows: DataFrame, n: int | None = None) -> DataFrame:
    """The side of a join that may hold a row for every URL of a run: it is shuffled, never broadcast, unless ``n`` rows are few.

    Spark judges a written table by the bytes of the columns it reads, in which millions of URLs pass for a few MB; broadcast,
    they take the driver's memory.
    """
    return rows if n is not None and n <= _HANDED_OUT else rows.hint("merge")


# ---------------------------------------------------------------------------------------------- what to skip
def is_final(verdict: Column, attempts: Column, params: P.ScreenParams) -> Column:
    """Any verdict, a missing one too, is final; a failed parse only once its attempts are used up."""
    return ~verdict.eqNullSafe(F.lit(P.PARSE_FAILED)) | (attempts >= params.max_parse_attempts)


def skip_processed(feed: DataFrame, state: DataFrame, params: P.ScreenParams) -> DataFrame:
    """Posts that no earlier run has settled.  Reads three narrow columns of the state."""
    settled = state.filter(is_final(F.col("verdict"), F.col("attempts"), params)).select("url")
    return feed.join(many(settled), "url", "left_anti")


def published_urls(listings: DataFrame) -> DataFrame:
    return listings.filter(F.col("url") != "").select("url").distinct()


def skip_published(feed: DataFrame, listings: DataFrame) -> DataFrame:
    """Posts that are not in the published table yet."""
    return feed.join(many(listings.select("url")), "url", "left_anti")


def with_published(urls: DataFrame, listings: DataFrame) -> DataFrame:
    """URLs known as published after new listings have been added."""
    return urls.select("url").union(listings.select("url")).distinct()


def retry_candidates(state: DataFrame, verdicts=P.RETRY_VERDICTS) -> DataFrame:
    """Rows whose verdict a new run may overturn; the filter reaches the scan."""
    return state.filter(F.col("verdict").isin(*verdicts))


# ---------------------------------------------------------------------------------------------- recording results
def fold_updates(records: DataFrame, order: str = "ord") -> DataFrame:
    """One row per URL from the records of a run: the last one's columns and the number of failed parses."""
    return (
        records.groupBy("url")
        .agg(
            F.max_by(F.struct(*REPLACED), F.col(order)).alias("_last"),
            F.count_if(F.col("verdict") == P.PARSE_FAILED).cast("int").alias("failures"),
        )
        .select("url", "_last.*", "failures")
    )


def upsert_posts(state: DataFrame, records: DataFrame, now: datetime, order: str = "ord") -> DataFrame:
    """The state after a run.

    ``first_seen`` is kept, ``attempts`` grows by failed parses only, every other column is replaced, by NULL too.
    The state is the streamed side of a left join: give written records, whose size Spark knows when it plans, and
    while they are small enough to broadcast nothing of the state is shuffled.  New URLs are found by a semi join of
    the URL column alone.
    """
    at = clock(now)
    updates = fold_updates(records, order)
    marked = updates.select(
        "url", F.lit(True).alias("_hit"), "failures", *[F.col(c).alias(f"_new_{c}") for c in REPLACED]
    )
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    known = state.join(marked, "url", "left").select(
        "url",
        *[F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in REPLACED],
        (F.col("attempts") + F.coalesce("failures", F.lit(0))).alias("attempts"),
        "first_seen",
        F.when(hit, at).otherwise(F.col("last_processed")).alias("last_processed"),
    )
    met = state.select("url").join(updates.select("url"), "url", "left_semi")
    new = updates.join(met, "url", "left_anti").select(
        "url", *REPLACED, F.col("failures").alias("attempts"), at.alias("first_seen"), at.alias("last_processed")
    )
    columns = [f.name for f in schemas.POSTS.fields]
    return known.select(*columns).unionByName(new.select(*columns))


def changes(records: DataFrame, now: datetime, order: str = "ord") -> DataFrame:
    """A run's rows for the append-only change table: ``attempts`` holds the run's own failures."""
    at = clock(now)
    columns = [f.name for f in schemas.POSTS.fields]
    return (
        fold_updates(records, order)
        .withColumns({"attempts": F.col("failures"), "first_seen": at, "last_processed": at})
        .select(*columns)
    )


def learnt_once(records: DataFrame, now: datetime) -> DataFrame:
    """``changes`` of records that name each URL once: nothing is gathered by URL.  Payload is left out."""
    at = clock(now)
    failed = F.coalesce(F.col("verdict") == P.PARSE_FAILED, F.lit(False)).cast("int")
    columns = [f.name for f in schemas.POSTS.fields if f.name not in schemas.PAYLOAD_COLUMNS]
    return records.withColumns({"attempts": failed, "first_seen": at, "last_processed": at}).select(*columns)


def current_state(change_table: DataFrame, version: str = "batch_id") -> DataFrame:
    """The state as the fold of its change table: what ``upsert_posts`` gives."""
    return fold_changes(change_table, version).select(*[f.name for f in schemas.POSTS.fields])


def fold_changes(change_table: DataFrame, version: str = "batch_id") -> DataFrame:
    """One row per URL: columns and ``version`` of its newest change, attempts summed, the earliest ``first_seen``.

    A run changes a URL once, so (url, version) names a row: the newest version of each URL is found on narrow columns by
    a map-side combined hash aggregate, and only then are the rows that won fetched, their texts neither sorted nor folded.
    """
    last = change_table.groupBy("url").agg(
        F.max(version).alias(version), F.sum("attempts").cast("int").alias("attempts"), F.min("first_seen").alias("first_seen")
    )
    return change_table.drop("attempts", "first_seen").join(many(last), ["url", version])


def narrow_state(change_table: DataFrame, version: str = "batch_id") -> DataFrame:
    """The columns of the state that decide what to skip, and when a URL was first seen."""
    return change_table.groupBy("url").agg(
        F.max_by("verdict", version).alias("verdict"),
        F.sum("attempts").cast("int").alias("attempts"),
        F.min("first_seen").alias("first_seen"),
    )


def upsert_cache(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The address cache after new rows: the latest row of a key wins, a new row over an old one of the same time."""
    columns = [f.name for f in schemas.ADDRESS_CACHE.fields]
    both = cache.select(*columns, F.lit(0).alias("_new")).unionByName(rows.select(*columns, F.lit(1).alias("_new")))
    last = F.struct(F.col("updated_at"), F.col("_new"))
    return (
        both.filter(F.col("address_key").isNotNull())
        .groupBy("address_key")
        .agg(F.max_by(F.struct(*columns[1:]), last).alias("_row"))
        .select("address_key", "_row.*")
    )


def upsert_usage(usage: DataFrame, calls: DataFrame, ts: str = "ts") -> DataFrame:
    """Monthly call counts after the calls of a log."""
    new = calls.groupBy(month_key(F.col(ts)).alias("month")).agg(F.count("*").alias("calls"))
    return usage.select("month", "calls").unionByName(new).groupBy("month").agg(F.sum("calls").alias("calls"))


# ---------------------------------------------------------------------------------------------- forgetting
def _expired(as_of: datetime, max_age_days: int) -> Column:
    return F.col("first_seen") < clock(as_of - timedelta(days=max_age_days))


def retain(state: DataFrame, as_of: datetime, params: P.ScreenParams) -> DataFrame:
    """Drop the payload of old rows; key, verdict and analysis stay, so nothing is ever processed twice."""
    old = _expired(as_of, params.max_age_days)
    return state.withColumns(
        {c: F.when(old, F.lit(None)).otherwise(F.col(c)).cast("string") for c in ("raw_text", "parsed_json")}
    )


def retention_report(state: DataFrame, as_of: datetime, params: P.ScreenParams) -> DataFrame:
    """Rows that ``retain`` would lighten."""
    old = _expired(as_of, params.max_age_days)
    return state.agg(F.count_if(old & F.col("raw_text").isNotNull()).alias("lightened"), F.count("*").alias("rows_kept"))


def blank_invented_addresses(rows: DataFrame) -> DataFrame:
    """Blank address and distance of stored rows that hold the invented address."""
    invented = F.coalesce(F.contains(F.col("address"), F.lit(P.INVENTED_ADDRESS)), F.lit(False))
    return rows.withColumns(
        {
            "address": F.when(~invented, F.col("address")),
            "distance_meters": F.when(~invented, F.col("distance_meters")),
        }
    )
