"""The jobs: incremental screening, reprocessing, replay, maintenance, address repair.

Each is a function of DataFrames that returns DataFrames; ``hearthline.plans.store`` writes the results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.functions import dates, lax, text
from hearthline.operators import addresses, dedupe, extraction, judging, screening, state as history

# Adds ``responses array<string>``, the answers of an extraction model in the order of its tries, to rows of
# (url, text, ...); usually a mapInPandas over ``prompt``.
Extractor = Callable[[DataFrame], DataFrame]
# Makes a result safe to use twice: ``hearthline.sources.tables.Scratch``.
Stage = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Outcome:
    """What a job found: a record per post, every address it resolved, the service calls it made (month, calls), and the
    posts' payload (url, raw_text, parsed_json), apart so that what is stored of it needs no join with the records."""

    records: DataFrame
    resolved: DataFrame
    calls: DataFrame | None
    texts: DataFrame

    def with_text(self) -> DataFrame:
        return self.records.join(history.many(self.texts.select("url", "raw_text")), "url")


@dataclass(frozen=True)
class Lookups:
    """Answers of address services, each keyed by ``address_key``.

    ``geocodes`` and ``routes`` are tables of answers, or functions that ask for them: they get the requests
    (``address_key, query``) that the month's budget allows after ``usage`` (month, calls).
    """

    cache: DataFrame | None
    geocodes: addresses.Answers
    routes: addresses.Answers
    usage: DataFrame | None = None


def _judged(
    open_rows: DataFrame,
    extractor: Extractor,
    lookups: Lookups,
    params: P.ScreenParams,
    stage: Stage,
    as_of: datetime,
    carry: tuple[str, ...] = (),
) -> Outcome:
    """Extraction, judgement, distance and the final verdict of rows that no rule has stopped.

    Two results are written on the way: the judged rows, so that the model is asked once although the address lookup, the
    records and the payload need its answers; and the resolved addresses, so that their size is known when they are joined.
    Texts are read from the rows they were written with and take part in no join.
    """
    # Rows lie unevenly in their files, by rules or by verdicts; spread them, since the model is by far the dearest step.
    open_rows = extraction.with_prompt(open_rows.repartition("url"), params)
    answered = extraction.with_record(extractor(open_rows), params).drop("responses", "prompt", *carry)
    read = stage(judging.judge(answered, params), "judged")
    judged = read.drop("text")
    resolved, calls = addresses.look_up(
        addresses.distinct_addresses(judged), lookups.cache, lookups.geocodes, lookups.routes, params, lookups.usage, as_of, stage
    )
    placed = addresses.with_distance(judged, resolved)
    final = judging.file_reason(judging.limit_distance(placed, params))
    sent = F.col("record").isNotNull()
    answer = F.when(sent, lax.record_json(F.col("record"))).alias("parsed_json")
    located = F.col("verdict").isin(P.ADDED, P.REJECTED_DISTANCE)
    records = final.withColumns(
        {
            "parsed_json": answer,
            "model_used": F.when(sent, F.lit("model")),
            **{
                c: F.when(located, F.col(c))
                for c in ("address_confidence", "distance_text", "distance_meters", "address_warning")
            },
        }
    ).drop("record")
    return Outcome(records, resolved, calls, read.select("url", F.col("text").alias("raw_text"), answer))


def _settled(
    ruled: DataFrame,
    extractor: Extractor,
    lookups: Lookups,
    params: P.ScreenParams,
    stage: Stage,
    as_of: datetime,
    carry: tuple[str, ...] = (),
) -> Outcome:
    """The final verdict of rows that rules were applied to.

    They are written first, so that only open ones reach the extractor.  Rows that a rule has stopped, the most of a feed,
    go from there straight into the records.
    """
    open_row = F.col("verdict").isNull()
    # What only the extractor reads is not written for rows that it never sees.
    ruled = stage(ruled.withColumns({c: F.when(open_row, F.col(c)) for c in carry}), "ruled")
    done = _judged(ruled.filter(open_row), extractor, lookups, params, stage, as_of, carry)
    unknown = {f.name: F.lit(None).cast(f.dataType) for f in done.records.schema.fields if f.name not in ruled.columns}
    unknown |= {"distance_source": F.lit(P.SOURCE_SKIPPED), "is_measured": F.lit(False)}
    stopped = judging.file_reason(ruled.filter(~open_row).drop("text", *carry)).withColumns(unknown)
    texts = ruled.filter(~open_row).select("url", F.col("text").alias("raw_text"), F.lit(None).cast("string").alias("parsed_json"))
    return Outcome(done.records.unionByName(stopped), done.resolved, done.calls, texts.unionByName(done.texts))


def screen(
    posts_in: DataFrame,
    state: DataFrame,
    published: DataFrame,
    extractor: Extractor,
    lookups: Lookups,
    as_of: datetime,
    stage: Stage,
    params: P.ScreenParams = P.ScreenParams(),
    carry: tuple[str, ...] = (),
) -> Outcome:
    """A record per new post of a feed, with its final verdict.

    ``state`` needs url, verdict and attempts, ``published`` url.  Within one run the first post of a URL is judged.
    ``carry`` names columns of the feed that are for the extractor only.
    """
    feed = screening.first_per_url(screening.prepare_feed(posts_in, params))
    new = history.skip_published(history.skip_processed(feed, state, params), published)
    return judge(new, extractor, lookups, as_of, stage, params, carry)


def judge(
    new: DataFrame,
    extractor: Extractor,
    lookups: Lookups,
    as_of: datetime,
    stage: Stage,
    params: P.ScreenParams = P.ScreenParams(),
    carry: tuple[str, ...] = (),
) -> Outcome:
    """A record per row of a prepared feed that has one new post for each URL."""
    ruled = screening.apply_rules(dates.with_post_date(new, as_of), params, as_of)
    return _settled(ruled, extractor, lookups, params, stage, as_of, carry)


def _from_state(rows: DataFrame, as_of: datetime, carry: tuple[str, ...]) -> DataFrame:
    return rows.select(
        "url",
        "group_url",
        F.col("raw_text").alias("text"),
        F.coalesce("post_date", F.lit("")).alias("post_date"),
        dates.infer_date(F.col("post_date"), as_of).alias("posted_on"),
        F.lit(0).cast("bigint").alias("ord"),
        *carry,
    )


def reprocess(
    state: DataFrame,
    published: DataFrame,
    extractor: Extractor,
    lookups: Lookups,
    as_of: datetime,
    stage: Stage,
    params: P.ScreenParams = P.ScreenParams(),
    verdicts=P.RETRY_VERDICTS,
    carry: tuple[str, ...] = (),
) -> Outcome:
    """New records of stored posts that were rejected or failed; no text rule is applied, so none is written before."""
    candidates = screening.with_text(history.retry_candidates(state, verdicts))
    rows = _from_state(history.skip_published(candidates, published), as_of, carry)
    no_rule = F.lit(None).cast("string")
    return _judged(
        rows.withColumns({"reject_reason": no_rule, "verdict": no_rule}), extractor, lookups, params, stage, as_of, carry
    )


def replay(
    state: DataFrame,
    extractor: Extractor,
    lookups: Lookups,
    as_of: datetime,
    stage: Stage,
    params: P.ScreenParams = P.ScreenParams(),
    carry: tuple[str, ...] = (),
) -> Outcome:
    """New records of every stored post that still has its text, under the present rules but without the age rule."""
    rows = text.with_post_text(_from_state(screening.with_text(state), as_of, carry), "text")
    return _settled(screening.apply_rules(rows, params), extractor, lookups, params, stage, as_of, carry)


def new_listings(records: DataFrame, scanned_at: datetime) -> DataFrame:
    """Rows to add to the published table."""
    return judging.listing_row(records.filter(F.col("verdict") == P.ADDED), dates.clock(scanned_at))


def maintain(
    listings: DataFrame, state: DataFrame, as_of: datetime, params: P.ScreenParams = P.ScreenParams(), order: str = "ord"
) -> tuple[DataFrame, DataFrame]:
    """The published table without duplicates and stale rows, and the state without old payload."""
    return dedupe.publish(listings, as_of, params, order), history.retain(state, as_of, params)
