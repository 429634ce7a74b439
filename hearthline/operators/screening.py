"""Feed preparation and the ordered rule cascade.

The cascade is one CASE expression per job: each pattern is tested at most once per text, and a text that an earlier
rule stops is never shown to a later one.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.functions import dates, text


@dataclass(frozen=True)
class Rule:
    """A named test of the text; ``reason`` is what a stopped post is filed under."""

    name: str
    hit: Column
    reason: Column


def _first_excluded(post: Column, places) -> Column:
    found = F.lit(None).cast("string")
    for place in reversed(places):
        found = F.when(F.contains(post, F.lit(place)), F.lit(place)).otherwise(found)
    return found


def _tagged(tag: str, pattern: str, post: Column) -> Column:
    return F.concat(F.lit(f"{tag}:"), text.strip(F.regexp_extract(post, pattern, 0)))


def text_rules(post: Column, rules: P.RulePack) -> list[Rule]:
    """The text rules in their order."""
    return [
        Rule(
            "excluded_place",
            text.any_contains(post, rules.excluded_places),
            F.concat(F.lit("excluded_location:"), _first_excluded(post, rules.excluded_places)),
        ),
        Rule(
            "shared_flat",
            post.rlike(rules.shared_flat) & ~post.rlike(rules.couple_near_shared),
            _tagged("roommate_keyword", rules.shared_flat, post),
        ),
        Rule("disqualified", post.rlike(rules.disqualifying), _tagged("negative_keyword", rules.disqualifying, post)),
        Rule("for_sale", post.rlike(rules.sale_price), _tagged("for_sale", rules.sale_price, post)),
        Rule("other_rooms", ~post.rlike(rules.target_rooms), F.lit("room_count_mismatch")),
    ]


def first_reason(rules: list[Rule]) -> Column:
    """Reason of the first rule that hits, NULL if none does."""
    reason = F.lit(None).cast("string")
    for rule in reversed(rules):
        reason = F.when(rule.hit, rule.reason).otherwise(reason)
    return reason


def age_rule(post_date: Column, as_of: datetime, max_age_days: int) -> Rule:
    return Rule(
        "too_old", ~dates.is_recent(post_date, as_of, max_age_days), F.lit(f"older_than_{max_age_days}_days")
    )


def found_rooms(post: Column, rules: P.RulePack) -> Column:
    """Diagnostic: the room count a text states instead of the wanted one."""
    return F.nullif(F.regexp_extract(post, rules.rooms_mention, 1), F.lit(""))


def prepare_feed(posts_in: DataFrame, params: P.ScreenParams) -> DataFrame:
    """Posts with a link and more than a few characters, their text without outer blanks and cleaned for the rules."""
    linked = posts_in.filter(F.col("url") != "").withColumn("text", text.strip(F.col("text")))
    return text.with_post_text(linked.filter(F.length("text") > params.min_chars), "text")


def first_per_url(feed: DataFrame, key: str = "url", order: str = "ord") -> DataFrame:
    """The first post of each URL in feed order.

    A rank filter of this form is applied inside every map task before the shuffle, so a URL repeated in a third of
    the feed reaches its final task as one row per input split.
    """
    first = Window.partitionBy(key).orderBy(order)
    return feed.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def apply_rules(feed: DataFrame, params: P.ScreenParams, as_of: datetime | None = None) -> DataFrame:
    """Add ``reject_reason`` and ``verdict`` ('prefiltered' or NULL).  With a clock the age rule comes first."""
    rules = text_rules(F.col("text"), params.rules)
    if as_of is not None:
        rules = [age_rule(F.col("posted_on"), as_of, params.max_age_days), *rules]
    return feed.withColumn("reject_reason", first_reason(rules)).withColumn(
        "verdict", F.when(F.col("reject_reason").isNotNull(), F.lit(P.PREFILTERED))
    )


def rule_hits(feed: DataFrame, params: P.ScreenParams) -> DataFrame:
    """Every rule's own answer as a boolean column, plus the room count found."""
    hits = {rule.name: rule.hit for rule in text_rules(F.col("text"), params.rules)}
    return feed.withColumns({**hits, "found_rooms": found_rooms(F.col("text"), params.rules)})


def with_text(rows: DataFrame, column: str = "raw_text") -> DataFrame:
    """Rows that still have a text to work on."""
    return rows.filter(F.length(F.col(column)) > 0)
