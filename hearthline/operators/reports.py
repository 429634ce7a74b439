"""Counts for people: verdicts, runs, call budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.functions.dates import month_key, with_post_date
from hearthline.functions.text import long_enough


def verdict_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("verdict").agg(F.count("*").alias("cnt"))


def all_verdict_counts(rows: DataFrame) -> DataFrame:
    """Counts of every verdict in fixed order, 0 for those that do not occur.

    One pass of seven counters: no key is shuffled, so a verdict that holds most rows is no hot key, and there is no
    join whose key filter would be pushed into the expressions behind the verdict.
    """
    counters = rows.agg(
        F.array(*[F.struct(F.lit(v).alias("verdict"), F.count_if(F.col("verdict") == v).alias("cnt")) for v in P.VERDICTS])
        .alias("_all")
    )
    return counters.select(F.posexplode("_all").alias("position", "_one")).select(
        "position", "_one.verdict", "_one.cnt"
    )


def monthly_usage(calls: DataFrame, ts: str = "ts") -> DataFrame:
    return calls.groupBy(month_key(F.col(ts)).alias("month")).agg(F.count("*").alias("calls"))


def quota_status(usage: DataFrame, params: P.ScreenParams) -> DataFrame:
    """Used and remaining calls per month, and whether the alert share is reached; a cap of 0 never alerts."""
    cap = F.lit(params.monthly_call_cap)
    return usage.select(
        "month",
        F.col("calls").alias("used"),
        F.greatest(cap - F.col("calls"), F.lit(0)).cast("bigint").alias("remaining"),
        ((cap > 0) & (F.col("calls") >= cap * F.lit(params.quota_alert_share))).alias("alert"),
    )


_COUNTERS = ("seen", "prefiltered", "sent", "added")


def _group_counts(rows: DataFrame, group: str, verdict: str) -> DataFrame:
    is_rule: Column = F.col(verdict) == P.PREFILTERED
    return rows.groupBy(group).agg(
        F.count("*").alias("seen"),
        F.count_if(is_rule).alias("prefiltered"),
        F.count_if(F.col(verdict).isNotNull() & ~is_rule).alias("sent"),
        F.count_if(F.col(verdict) == P.ADDED).alias("added"),
    )


def _with_total(per_group: DataFrame, group: str) -> DataFrame:
    """Groups and their total, rolled up from the groups' counts, not from the posts."""
    sums = [F.sum(c).alias(c) for c in _COUNTERS]
    return per_group.rollup(group).agg(F.grouping(group).cast("int").alias("is_total"), *sums)


def run_summary(rows: DataFrame, group: str = "group_url", verdict: str = "verdict") -> DataFrame:
    """Per group and in total: posts seen, stopped by a rule, sent to the model, added."""
    return _with_total(_group_counts(rows, group, verdict), group)


def feed_summary(
    posts_in: DataFrame, records: DataFrame, params: P.ScreenParams, group: str = "group_url"
) -> DataFrame:
    """The summary of a screening run: ``seen`` counts every real post of the feed, known ones too."""
    seen = posts_in.filter(long_enough(F.col("text"), params.min_chars)).withColumn("_none", F.lit(None).cast("string"))
    done = _group_counts(records, group, "verdict").withColumn("seen", F.lit(0).cast("bigint"))
    return _with_total(_group_counts(seen, group, "_none").unionByName(done), group)


def unparsed_dates(feed: DataFrame, as_of, raw: str = "post_date_text") -> DataFrame:
    """How many stated post dates no form recognised, with one example."""
    flag = F.col("unparsed_date")
    return with_post_date(feed, as_of, raw).agg(
        F.count_if(flag).alias("unparsed"), F.min(F.when(flag, F.col(raw))).alias("example")
    )
