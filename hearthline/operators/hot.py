"""Joins with a table of one row per key where some keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TRACKED = 10_000


def hot_keys(rows: DataFrame, key: str, parts: int, tracked: int = _TRACKED) -> tuple[list, bool]:
    """The keys that may hold more than a quarter of a task's even share of ``rows``, and whether the null key does.

    A sketch of the counts tells, with ``tracked`` counters, merged from the partitions; counts are right to the number of
    rows over the counters.  A list of at most ``4 * parts`` keys reaches the driver.
    """
    wanted = min(4 * parts, tracked)
    top = F.call_function("approx_top_k", F.col(key), F.lit(wanted), F.lit(tracked))
    found = rows.agg(F.count("*").alias("n"), F.count(key).alias("keyed"), top.alias("top")).first()
    share = 4 * parts
    keys = [item["item"] for item in found["top"] or [] if item["item"] is not None and item["count"] * share > found["n"]]
    return keys, (found["n"] - found["keyed"]) * share > found["n"]


def join_to_few(rows: DataFrame, table: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """``rows`` left-joined by ``key`` with ``table`` (one row per key), no task getting more than its share of a hot key.

    Rows of a hot key are dealt to ``parts`` places by the hash of the row, so a task that runs again deals alike, and the key's one
    row of the table is put in every place; other keys have one place.  What is copied is at most ``4 * parts * parts``
    rows, however large the data.  It does not rest on adaptive execution, but rows that are alike in every column share a
    place.  A null key finds nothing.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot, null_too = hot_keys(rows, key, parts)
    if not hot and not null_too:
        return rows.join(table, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(null_too))
    place = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.lit(parts)).cast("int")
    dealt = rows.withColumn("_place", F.when(is_hot, place).otherwise(F.lit(0)))
    places = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(table.withColumn("_place", F.explode(places)), [key, "_place"], "left").drop("_place")
