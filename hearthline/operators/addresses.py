"""Address lookups: geocode acceptance, distance resolution, call budgets, repair of stored addresses.

Answers of external services arrive as tables: geocodes (results) keyed by the address's ``cache_key``, routes (metres) by
that of the place they start from, the canonical address or else the address.  A key without an answer row was not asked,
because the budget was spent; of several answers to a key the latest counts.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.functions import fields, text
from hearthline.functions.dates import month_key
from hearthline.operators import hot
from hearthline.operators.state import many

# A table of answers, or a function that gets requests (address_key, query) and returns one.
Answers = DataFrame | Callable[[DataFrame], DataFrame]


class BudgetSpent(RuntimeError):
    """The month's calls are used up and the run is set to stop there."""


# ---------------------------------------------------------------------------------------------- geocode results
def component_names(result: Column, component_type: str) -> Column:
    matching = F.filter(
        result["address_components"], lambda c: F.coalesce(F.array_contains(c["types"], component_type), F.lit(False))
    )
    return F.transform(matching, lambda c: c["long_name"])


def result_city(result: Column, component_types=P.CITY_COMPONENT_TYPES) -> Column:
    """First long name of the first component type present; '' if there is none."""
    return F.coalesce(*[F.get(component_names(result, t), F.lit(0)) for t in component_types], F.lit(""))


def _component_has(result: Column, types) -> Column:
    wanted = F.array(*[F.lit(t) for t in types])
    return F.coalesce(
        F.exists(result["address_components"], lambda c: F.coalesce(F.arrays_overlap(c["types"], wanted), F.lit(False))),
        F.lit(False),
    )


def has_street(result: Column, result_types=P.PRECISE_RESULT_TYPES, part_types=P.PRECISE_COMPONENT_TYPES) -> Column:
    wanted = F.array(*[F.lit(t) for t in result_types])
    return F.coalesce(F.arrays_overlap(result["types"], wanted), F.lit(False)) | _component_has(result, part_types)


def city_allowed(result: Column, city: Column, targets) -> Column:
    return text.any_contains(F.coalesce(result["formatted_address"], F.lit("")), targets) | text.any_contains(
        city, targets
    )


def accept_geocode(rows: DataFrame, params: P.ScreenParams) -> DataFrame:
    """Judge rows of (address, confidence, asked, failed, results).

    Adds canonical_address, city, geocode_confidence, geocode_warning and geocode_status.
    """
    rows = rows.withColumn("_best", F.get("results", F.lit(0)))
    best = F.col("_best")
    rows = rows.withColumn("_city", result_city(best)).withColumn(
        "geocode_status",
        F.when(F.lit(not params.validate_addresses), "disabled")
        .when(F.col("confidence").isin("missing", "low"), "skipped_low_confidence")
        .when(~F.col("asked"), "quota")
        .when(F.col("failed"), "geocode_error")
        .when(best.isNull(), "not_found")
        .when(~city_allowed(best, F.col("_city"), params.target_cities), "wrong_city")
        .when(~has_street(best), "not_street_precision")
        .otherwise("ok"),
    )
    status = F.col("geocode_status")
    warnings = {
        "skipped_low_confidence": P.WARN_WEAK,
        "quota": P.WARN_QUOTA,
        "geocode_error": P.WARN_LOOKUP_ERROR,
        "not_found": P.WARN_NOT_FOUND,
        "wrong_city": P.WARN_WRONG_CITY,
        "not_street_precision": P.WARN_IMPRECISE,
    }
    warning = F.lit("")
    for name, message in warnings.items():
        warning = F.when(status == name, message).otherwise(warning)
    return rows.withColumns(
        {
            "canonical_address": F.when(status.isin("disabled", "quota", "geocode_error"), F.col("address"))
            .when(status == "ok", F.coalesce(best["formatted_address"], F.col("address")))
            .otherwise(""),
            "city": F.when(status.isin("ok", "wrong_city", "not_street_precision"), F.col("_city")).otherwise(""),
            "geocode_confidence": F.when(status == "ok", "high")
            .when(status.isin("not_found", "wrong_city", "not_street_precision"), "low")
            .otherwise(F.col("confidence")),
            "geocode_warning": warning,
        }
    ).drop("_best", "_city")


# ---------------------------------------------------------------------------------------------- distances
def cache_hits(cache: DataFrame) -> DataFrame:
    """Cached answers that may be served again: measured ones and addresses not worth asking."""
    return cache.filter(F.col("distance_source").isin(P.SOURCE_MEASURED, P.SOURCE_SKIPPED))


def unique_answers(table: DataFrame, *columns: str) -> DataFrame:
    """One row for each key: the latest by ``answered_at``, if there is one, then the greatest."""
    when = [F.col("answered_at")] if "answered_at" in table.columns else []
    best = F.max(F.struct(*when, F.struct(*columns).alias("_answer"))).alias("_best")
    return table.filter(F.col("address_key").isNotNull()).groupBy("address_key").agg(best).select("address_key", "_best._answer.*")


def _answers(table: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return unique_answers(table, *columns).select(
        "address_key", F.lit(True).alias(f"_{prefix}"), *[F.col(c).alias(f"_{prefix}_{c}") for c in columns]
    )


def route_key(canonical: Column, address: Column) -> Column:
    """Key of a route: it starts at the canonical address, or else at the address itself."""
    return text.cache_key(F.coalesce(F.nullif(canonical, F.lit("")), address))


def distinct_addresses(rows: DataFrame) -> DataFrame:
    """One row per address key: each address is looked up once, however many posts share it."""
    return (
        rows.select(text.cache_key(F.col("address")).alias("address_key"), "address")
        .filter(F.col("address_key").isNotNull() & (F.length("address") >= 3))
        .groupBy("address_key")
        .agg(F.min("address").alias("address"))
    )


def _graded(addresses: DataFrame, cache: DataFrame) -> DataFrame:
    """Addresses with their own confidence and warning, and what the cache knows of them."""
    graded = addresses.withColumn("_grade", fields.address_confidence(F.col("address"))).withColumns(
        {"confidence": F.col("_grade.confidence"), "warning": F.col("_grade.warning")}
    )
    known = _answers(
        cache_hits(cache), "cache", "confidence", "warning", "distance_meters", "distance_source", "canonical_address", "city",
        "geocode_status",
    )
    return graded.join(known, "address_key", "left")


def _geocoded(graded: DataFrame, geocodes: DataFrame, params: P.ScreenParams) -> DataFrame:
    joined = graded.join(many(_answers(geocodes, "geo", "failed", "results")), "address_key", "left").withColumns(
        {
            "asked": F.coalesce(F.col("_geo"), F.lit(False)),
            "failed": F.coalesce(F.col("_geo_failed"), F.lit(False)),
            "results": F.col("_geo_results"),
        }
    )
    return accept_geocode(joined, params)


def _not_worth_a_route(params: P.ScreenParams) -> Column:
    doubtful = F.lit(params.confident_addresses_only) & ~F.col("geocode_confidence").isin("high", "medium")
    return F.trim("address").isin(*P.CITY_ONLY) | doubtful


def resolve_addresses(
    addresses: DataFrame, cache: DataFrame, geocodes: DataFrame, routes: DataFrame, params: P.ScreenParams
) -> DataFrame:
    """Distance, confidence, warning and their source for each distinct address.

    The lookups are plain equality joins: Spark broadcasts a side it measures to be small and shuffles otherwise; geocodes,
    nested and wide, are always shuffled.
    """
    return _resolved(_geocoded(_graded(addresses, cache), geocodes, params), routes, params)


def _resolved(geocoded: DataFrame, routes: DataFrame, params: P.ScreenParams) -> DataFrame:
    routed = _answers(routes, "route", "status", "meters").withColumnRenamed("address_key", "_from")
    judged = geocoded.withColumn("_start", route_key(F.col("canonical_address"), F.col("address")))
    judged = judged.join(routed, F.col("_start") == F.col("_from"), "left")
    cached = F.coalesce(F.col("_cache"), F.lit(False))
    city_only = F.trim("address").isin(*P.CITY_ONLY)
    route_status = F.col("_route_status")
    judged = judged.withColumn(
        "distance_source",
        F.when(cached, P.SOURCE_CACHE)
        .when(_not_worth_a_route(params), P.SOURCE_SKIPPED)
        .when(F.col("_route").isNull(), P.SOURCE_QUOTA)
        .when(route_status == "OK", P.SOURCE_MEASURED)
        .when(route_status == "ERROR", P.SOURCE_ERROR)
        .otherwise(P.SOURCE_NO_ROUTE),
    )
    source = F.col("distance_source")
    later_warning = F.coalesce(F.nullif(F.col("geocode_warning"), F.lit("")), F.col("warning"))
    return judged.select(
        "address_key",
        "address",
        F.when(cached, F.col("_cache_canonical_address"))
        .when(city_only, "")
        .otherwise(F.col("canonical_address"))
        .alias("canonical_address"),
        F.when(cached, F.col("_cache_city")).when(city_only, "").otherwise(F.col("city")).alias("city"),
        F.when(cached, F.coalesce(F.nullif(F.col("_cache_confidence"), F.lit("")), F.col("confidence")))
        .when(city_only, "low")
        .otherwise(F.col("geocode_confidence"))
        .alias("address_confidence"),
        F.when(cached, F.coalesce(F.col("_cache_warning"), F.lit("")))
        .when(city_only, P.WARN_CITY_ONLY)
        .when(source == P.SOURCE_NO_ROUTE, P.WARN_NO_ROUTE)
        .when(source == P.SOURCE_ERROR, P.WARN_ROUTE_ERROR)
        .otherwise(later_warning)
        .alias("address_warning"),
        F.when(cached, F.col("_cache_distance_meters"))
        .when(source == P.SOURCE_MEASURED, F.col("_route_meters"))
        .alias("distance_meters"),
        "distance_source",
        F.coalesce(
            (source == P.SOURCE_MEASURED) | (cached & (F.col("_cache_distance_source") == P.SOURCE_MEASURED)),
            F.lit(False),
        ).alias("is_measured"),
        F.when(cached, F.col("_cache_geocode_status"))
        .when(city_only, "city_only")
        .otherwise(F.col("geocode_status"))
        .alias("geocode_status"),
    )


def geocode_requests(graded: DataFrame, params: P.ScreenParams) -> DataFrame:
    """``address_key, query`` of the addresses worth asking for: unknown to the cache, more than a city, not weak."""
    worth = F.col("_cache").isNull() & ~F.trim("address").isin(*P.CITY_ONLY) & ~F.col("confidence").isin("missing", "low")
    rows = graded.filter(worth & F.lit(params.validate_addresses))
    return rows.select("address_key", text.anchored_address(F.col("address")).alias("query"))


def route_requests(geocoded: DataFrame, params: P.ScreenParams) -> DataFrame:
    """``address_key, query`` of the places a route is to be asked from, keyed as routes are."""
    rows = geocoded.filter(F.col("_cache").isNull() & ~_not_worth_a_route(params))
    start = F.coalesce(F.nullif(F.col("canonical_address"), F.lit("")), F.col("address"))
    keyed = rows.select(route_key(F.col("canonical_address"), F.col("address")).alias("address_key"), text.anchored_address(start).alias("query"))
    return keyed.filter(F.col("address_key").isNotNull()).groupBy("address_key").agg(F.min("query").alias("query"))


def within_rest(requests: DataFrame, rest: int, params: P.ScreenParams, needed: int) -> DataFrame:
    """The requests that the rest of the month's budget allows, in order of their keys.

    The budget is the operator's feature and bounds what the limit keeps.  With ``on_cap='halt'`` a run that needs more
    stops before it asks.
    """
    if needed > rest and params.on_cap == "halt":
        raise BudgetSpent(f"{needed} calls are needed, {rest} are left this month")
    return requests if needed <= rest else requests.orderBy("address_key").limit(max(rest, 0))


def look_up(
    addresses: DataFrame,
    cache: DataFrame,
    geocodes: Answers,
    routes: Answers,
    params: P.ScreenParams,
    usage: DataFrame | None,
    as_of: datetime,
    stage: Callable[[DataFrame, str], DataFrame],
) -> tuple[DataFrame, DataFrame | None]:
    """Resolved addresses, written, and the calls made for them (month, calls).

    Where a service is a function it is asked once for each request within the month's budget, geocodes first; the
    requests are written before they are handed over, so a lost executor does not ask again for those that were answered.
    """
    if not callable(geocodes) and not callable(routes):
        return stage(resolve_addresses(addresses, cache, geocodes, routes, params), "resolved"), None
    spark, month = addresses.sparkSession, as_of.strftime("%Y-%m")
    spent = 0 if usage is None else usage.filter(F.col("month") == month).agg(F.coalesce(F.sum("calls"), F.lit(0))).first()[0]
    rest, made = params.monthly_call_cap - spent, 0

    def ask(service: Answers, requests: DataFrame, name: str) -> DataFrame:
        nonlocal rest, made
        if not callable(service):
            return service
        requests = stage(requests, f"{name}_requests")
        needed = requests.count()
        allowed = within_rest(requests, rest, params, needed)
        rest, made = rest - min(needed, max(rest, 0)), made + min(needed, max(rest, 0))
        return stage(service(allowed), f"{name}_answers")

    graded = stage(_graded(addresses, cache), "graded")
    geocoded = stage(_geocoded(graded, ask(geocodes, geocode_requests(graded, params), "geocode"), params), "geocoded")
    resolved = stage(_resolved(geocoded, ask(routes, route_requests(geocoded, params), "route"), params), "resolved")
    calls = spark.createDataFrame([(month, made)], "month string, calls bigint")
    return resolved, calls


def with_distance(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Add distance_meters, distance_text, distance_source, is_measured, address_confidence and address_warning.

    Rows without an address to speak of take no part in the join, so their texts are not shuffled and they do not meet
    under one empty key.  ``resolved`` has one row per address.  Addresses that very many rows share are found first, by a
    sketch over the column, and their rows are dealt to several tasks; give written rows, which are read for it once more.
    """
    known = F.coalesce(F.length("address") >= 3, F.lit(False))
    answers = resolved.select(
        "address_key", "distance_meters", "distance_source", "is_measured", "address_confidence", "address_warning"
    )
    keyed = rows.filter(known).withColumn("address_key", text.cache_key(F.col("address")))
    placed = hot.join_to_few(keyed, answers, "address_key").drop("address_key")
    # Blanks alone have a length but no key.
    unplaced = rows.filter(~known).withColumns(
        {
            "distance_meters": F.lit(None).cast("int"),
            "distance_source": F.lit(P.SOURCE_SKIPPED),
            "is_measured": F.lit(False),
            "address_confidence": F.lit("missing"),
            "address_warning": F.lit(P.WARN_MISSING),
        }
    )
    return placed.unionByName(unplaced).withColumns(
        {
            "distance_source": F.coalesce("distance_source", F.lit(P.SOURCE_SKIPPED)),
            "is_measured": F.coalesce("is_measured", F.lit(False)),
            "address_confidence": F.coalesce("address_confidence", F.lit("missing")),
            "address_warning": F.coalesce("address_warning", F.lit(P.WARN_MISSING)),
            "distance_text": F.when(F.col("distance_source") == P.SOURCE_QUOTA, P.WARN_QUOTA).otherwise(
                F.coalesce(fields.km_text(F.col("distance_meters")), F.lit(""))
            ),
        }
    )


def new_cache_rows(resolved: DataFrame, now: Column) -> DataFrame:
    """Cache rows to store for addresses resolved in this run."""
    return resolved.filter(F.col("distance_source") != P.SOURCE_CACHE).select(
        "address_key",
        F.col("address").alias("original_address"),
        "canonical_address",
        "city",
        F.col("address_confidence").alias("confidence"),
        F.col("address_warning").alias("warning"),
        F.when(F.col("distance_source") == P.SOURCE_QUOTA, P.WARN_QUOTA)
        .otherwise(F.coalesce(fields.km_text(F.col("distance_meters")), F.lit("")))
        .alias("distance_text"),
        "distance_meters",
        "distance_source",
        "geocode_status",
        now.alias("updated_at"),
    )


# ---------------------------------------------------------------------------------------------- call budget
def last_call_within_cap(calls: DataFrame, cap: int, order=("ts", "call_id"), ranked: int = 100_000) -> DataFrame:
    """Per month, the position of the call that uses the budget up; no row for a month within its budget.

    Calls are counted in ranges of their order, the counts are summed up, and the range in which a month's budget ends is
    counted again in finer ranges, until it holds no more than ``ranked`` calls, which are ranked one by one: minutes,
    milliseconds, then the times themselves, then ranges of 2^48, 2^32 and 2^16 ids and the ids.  Calls alike in all of them
    share a position.  So no task sees a month's calls, however they bunch.  The end of each month is looked at between
    the steps, one row a month.
    """
    spark, left = calls.sparkSession, F.lit(cap)
    rows = calls.select(month_key(F.col(order[0])).alias("month"), *order)
    here = F.struct(*order).alias("last_call")
    if cap <= 0:
        return rows.select("month", here).limit(0)
    for value in _ranges(rows, order):
        rows = rows.withColumn("_at", value)
        counts = rows.groupBy("month", "_at").agg(F.count("*").alias("_n"), F.max(left).alias("_left"))
        upto = F.sum("_n").over(Window.partitionBy("month").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
        ends = counts.withColumn("_upto", upto).filter("_upto >= _left and _upto - _n < _left")
        ends = ends.select("month", F.col("_at").alias("_end"), "_n", (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_rest"))
        found = ends.collect()
        ends = spark.createDataFrame([(r["month"], r["_end"], r["_rest"]) for r in found], ends.drop("_n").schema)
        ends = F.broadcast(ends.withColumnRenamed("month", "_month"))  # one row a month, which the driver has just seen
        here_ends = F.col("month").eqNullSafe(F.col("_month")) & F.col("_at").eqNullSafe(F.col("_end"))
        rows = rows.drop("_rest").join(ends, here_ends)
        rows, left = rows.select("month", *order, "_rest"), F.col("_rest")
        if all(r["_n"] <= ranked for r in found):
            rank = F.row_number().over(Window.partitionBy("month").orderBy(*order))
            return rows.withColumn("_rank", rank).filter("_rank = _rest").select("month", here)
    return rows.groupBy("month").agg(F.max(here).alias("last_call"))


def _ranges(rows: DataFrame, order) -> list[Column]:
    """Ever finer ranges of the order, each of so few values within the one before that a task can sum them up."""
    micros = F.unix_micros(F.col(order[0]).cast("timestamp"))
    out = [F.floor(micros / F.lit(60_000_000)), F.floor(micros / F.lit(1_000)), micros]
    for name in order[1:]:
        if rows.schema[name].dataType.typeName() in ("long", "integer", "short", "byte"):
            out += [F.shiftright(F.col(name).cast("long"), bits) for bits in (48, 32, 16)]
        out.append(F.col(name))
    return out


def within_budget(calls: DataFrame, cap: int, on_cap: str = "skip", order=("ts", "call_id"), ranked: int = 100_000) -> DataFrame:
    """Apply the monthly cap to a call log.

    'skip' keeps every call and adds ``allowed``; 'halt' drops everything from the first call over any month's cap on.
    The joined side has one row per month.
    """
    last = last_call_within_cap(calls, cap, order, ranked)
    dated = calls.withColumn("month", month_key(F.col(order[0])))
    here = F.struct(*order)
    if cap <= 0:
        flagged = dated.withColumn("allowed", F.lit(False))
    else:
        flagged = (
            dated.join(F.broadcast(last), "month", "left")
            .withColumn("allowed", F.col("last_call").isNull() | (here <= F.col("last_call")))
            .drop("last_call")
        )
    if on_cap == "skip":
        return flagged
    first_over = flagged.filter(~F.col("allowed")).agg(F.min(here).alias("stop")).scalar()
    return flagged.filter(F.coalesce(here < first_over, F.lit(True)))


# ---------------------------------------------------------------------------------------------- address repair
def _city_of(result: Column) -> Column:
    return F.get(component_names(result, "locality"), F.lit(0))


def _names_home(results: Column, params: P.ScreenParams) -> Column:
    return F.coalesce(
        F.exists(
            results, lambda r: F.coalesce(text.any_contains(_city_of(r), params.home_cities), F.lit(False))
        ),
        F.lit(False),
    )


def _repair_answers(geocodes: DataFrame, params: P.ScreenParams) -> DataFrame:
    """Each geocode answer judged once, as a few scalars, however many listings share its address."""
    best = F.col("_best")
    return (
        geocodes.select(
            "address_key",
            F.coalesce("failed", F.lit(False)).alias("failed"),
            _names_home(F.col("results"), params).alias("home"),
            F.get("results", F.lit(0)).alias("_best"),
        )
        .withColumn("_precise", has_street(best, P.STREET_LEVEL_TYPES, P.STREET_LEVEL_TYPES))
        .select(
            "address_key",
            F.struct(
                "failed",
                "home",
                F.when(F.col("_precise"), best["formatted_address"]).alias("canonical"),
                F.when(F.col("_precise"), _city_of(best)).alias("city"),
            ).alias("answer"),
        )
    )


def _repaired(clean: DataFrame, geocodes: Answers, routes: Answers, params: P.ScreenParams) -> DataFrame:
    """For each distinct ``clean`` address: ``fate``, ``canonical`` and ``meters``.

    Asked as it is; if neither the address nor an answer names a home city, again with each home city behind it.
    """

    def answers_to(rows: DataFrame, query: Column, name: str) -> DataFrame:
        asked = rows.withColumn("_ask", text.cache_key(query))
        requests = asked.filter(F.col("_ask").isNotNull()).groupBy(F.col("_ask").alias("address_key")).agg(F.min(query).alias("query"))
        table = geocodes(requests) if callable(geocodes) else geocodes
        found = _repair_answers(unique_answers(table, "failed", "results"), params)
        found = found.select(F.col("address_key").alias("_ask"), F.col("answer").alias(name))
        return asked.join(found, "_ask", "left").drop("_ask")

    names_home = text.any_contains(F.col("clean"), params.home_cities)
    rows = answers_to(clean, F.col("clean"), "_chosen").withColumn("_failed", F.coalesce(F.col("_chosen.failed"), F.lit(False)))
    searching = ~F.col("_failed") & ~names_home & ~F.coalesce(F.col("_chosen.home"), F.lit(False))
    rows = rows.withColumn("_searching", searching)
    for city in params.home_cities:
        query = F.when(F.col("_searching"), F.concat(F.col("clean"), F.lit(f", {city}")))
        rows = answers_to(rows, query, "_forced")
        found, broken = (
            F.col("_searching") & F.coalesce(F.col(f"_forced.{flag}"), F.lit(False)) for flag in ("home", "failed")
        )
        rows = rows.withColumns(
            {
                "_chosen": F.when(found, F.col("_forced")).otherwise(F.col("_chosen")),
                "_failed": F.col("_failed") | broken,
                "_searching": F.col("_searching") & ~found & ~broken,
            }
        ).drop("_forced")
    rows = rows.withColumns({"canonical": F.col("_chosen.canonical"), "_city": F.col("_chosen.city")})
    rows = rows.withColumn("_from", route_key(F.col("canonical"), F.lit(None).cast("string")))
    if callable(routes):
        starts = rows.filter(F.col("_from").isNotNull()).groupBy(F.col("_from").alias("address_key")).agg(F.min("canonical").alias("query"))
        routes = routes(starts)
    routed = unique_answers(routes, "status", "meters").filter(F.col("status") == "OK")
    rows = rows.join(routed.select(F.col("address_key").alias("_from"), "meters"), "_from", "left")
    unresolved = (
        F.col("_failed")
        | F.coalesce(F.length("canonical") == 0, F.lit(True))
        | F.coalesce(F.length("_city") == 0, F.lit(True))
    )
    near = F.coalesce(F.col("meters") <= params.neighbour_limit_m, F.lit(False))
    fate = (
        F.when(unresolved, "unresolved")
        .when(text.any_contains(F.col("_city"), params.home_cities), "updated")
        .when(F.contains(F.col("_city"), F.lit(params.neighbour_city)), F.when(near, "updated").otherwise("dropped"))
        .otherwise("other_city")
    )
    return rows.select("clean", fate.alias("fate"), "canonical", "meters")


def repair_addresses(listings: DataFrame, geocodes: Answers, routes: Answers, params: P.ScreenParams) -> DataFrame:
    """Add ``action``, ``new_address`` and ``new_distance_km`` to listings (``address``, ``distance_km``).

    The action column is the dry run: unchanged, blanked, unresolved, updated, dropped, other_city.  ``apply_repair``
    carries it out.  The questions are settled on the distinct addresses; listings that have one are joined to them once,
    the others take no part.
    """
    rows = listings.withColumn("_raw", text.strip(F.coalesce("address", F.lit(""))))
    blank, invented = F.col("_raw") == "", F.contains(F.col("_raw"), F.lit(P.INVENTED_ADDRESS))
    rows = rows.withColumn("_clean", F.when(~blank & ~invented, text.repair_spelling(F.col("_raw"))))
    asked = rows.filter(F.col("_clean").isNotNull())
    answers = _repaired(asked.select(F.col("_clean").alias("clean")).distinct(), geocodes, routes, params)
    settled = asked.join(answers.withColumnRenamed("clean", "_clean"), "_clean").withColumn("action", F.col("fate"))
    updated = F.col("action") == "updated"
    settled = settled.withColumns(
        {
            "new_address": F.when(updated, F.col("canonical")).otherwise(F.col("address")),
            "new_distance_km": F.when(updated, F.round(fields.km(F.col("meters")), 3)).otherwise(F.col("distance_km")),
        }
    )
    others = rows.filter(F.col("_clean").isNull()).withColumns(
        {
            "action": F.when(blank, "unchanged").otherwise("blanked"),
            "new_address": F.when(blank, F.col("address")).otherwise(""),
            "new_distance_km": F.when(blank, F.col("distance_km")),
        }
    )
    columns = [*listings.columns, "action", "new_address", "new_distance_km"]
    return settled.select(*columns).unionByName(others.select(*columns))


def apply_repair(planned: DataFrame) -> DataFrame:
    """Carry out the planned actions."""
    return (
        planned.filter(F.col("action") != "dropped")
        .withColumns({"address": F.col("new_address"), "distance_km": F.col("new_distance_km")})
        .drop("action", "new_address", "new_distance_km")
    )


def repair_report(planned: DataFrame) -> DataFrame:
    count = {
        name: F.count_if(F.col("action") == action)
        for name, action in (("updated", "updated"), ("removed", "dropped"), ("unresolved", "unresolved"))
    }
    return planned.agg(
        F.count("*").alias("total"),
        *[c.alias(name) for name, c in count.items()],
        F.count_if(F.col("action") != "dropped").alias("rows_after"),
    )
