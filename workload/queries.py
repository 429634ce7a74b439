"""The registered queries: (spark, sf_dir) -> DataFrame, each over its whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline import schemas
from hearthline.functions import dates, fields, lax, text
from hearthline.operators import addresses, dedupe, extraction, judging, reports, screening, state
from hearthline.plans import jobs
from hearthline.plans.store import Store
from hearthline.sources import feeds, tables
from hearthline.streaming.gate import gated_stream
from hearthline.streaming.screening import feed_stream, screen_stream
from workload import views as V

PARAMS = P.ScreenParams()
POSTS_CLOCK = datetime.fromisoformat(V.AS_OF_POSTS)
EVENTS_CLOCK = datetime.fromisoformat(V.AS_OF_EVENTS)
TABLES = ("orders", "customer", "events", "documents", "pages", "conversations", "labels", "part", "supplier")

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for table in TABLES:
        if f"from {table}" in sql:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(sql)


# ------------------------------------------------------------------------------------------ text preparation
@query
def clean_documents(spark, sf_dir):
    """B1 B2 B3 B5 C1."""
    docs = view(spark, sf_dir, V.NOISY_DOCUMENTS).withColumn("raw", text.strip(F.col("raw")))
    docs = docs.filter(F.length("raw") > PARAMS.min_chars)
    return text.with_post_text(docs, "raw", "post").select(
        "doc_id",
        "post",
        text.model_input(F.col("post")).alias("model_input"),
        text.snippet(F.col("post"), PARAMS.snippet_chars).alias("snippet"),
    )


@query
def prompt_table(spark, sf_dir):
    """B4."""
    docs = view(spark, sf_dir, V.NOISY_DOCUMENTS)
    return extraction.with_prompt(docs, PARAMS, "raw").select("doc_id", "prompt")


@query
def hebrew_text(spark, sf_dir):
    """E11 on whole documents."""
    docs = view(spark, sf_dir, V.NOISY_DOCUMENTS)
    return docs.select("doc_id", text.hebrew_only(F.col("raw")).alias("kept"))


@query
def address_keys(spark, sf_dir):
    """E19 E21 E22 E26 and C14's guard column."""
    rows = view(spark, sf_dir, V.FIELDS).withColumn(
        "addr",
        F.concat(
            F.coalesce("address_txt", F.lit(P.ADDRESS_UNSTATED)),
            F.when(F.col("post_no") % 4 == 0, "__extra").when(F.col("post_no") % 4 == 1, "  רג  גיבעתיים").otherwise(""),
        ),
    )
    addr = F.col("addr")
    return rows.select(
        "post_no",
        text.address_key(addr).alias("listing_key"),
        text.cache_key(addr).alias("cache_key"),
        text.repair_spelling(addr).alias("mended"),
        text.anchored_address(addr).alias("anchored"),
    )


# ------------------------------------------------------------------------------------------ rules
@query
def rule_cascade(spark, sf_dir):
    """C6-C11."""
    return screening.apply_rules(view(spark, sf_dir, V.POSTS), PARAMS).select("post_no", "verdict", "reject_reason")


@query
def rule_hits(spark, sf_dir):
    """C6-C10 one by one, C12."""
    return screening.rule_hits(view(spark, sf_dir, V.POSTS), PARAMS).select(
        "post_no", "excluded_place", "shared_flat", "disqualified", "for_sale", "other_rooms", "found_rooms"
    )


@query
def cascade_with_age(spark, sf_dir):
    """C5 before the text rules; counts per reason."""
    feed = view(spark, sf_dir, V.FIELDS).withColumnRenamed("date_txt", "post_date_text")
    ruled = screening.apply_rules(dates.with_post_date(feed, POSTS_CLOCK), PARAMS, POSTS_CLOCK)
    return ruled.groupBy(F.coalesce("reject_reason", F.lit("pass")).alias("reason")).agg(F.count("*").alias("posts"))


# ------------------------------------------------------------------------------------------ repairs and verdict
@query
def price_repair(spark, sf_dir):
    """E1-E4."""
    posts = view(spark, sf_dir, V.POSTS)
    return fields.with_repaired_price(posts, F.col("model_price"), F.col("text"), PARAMS, "price").select(
        "post_no",
        fields.is_missing(F.col("model_price")).alias("price_missing"),
        F.array_join(fields.price_candidates(F.col("text")).cast("array<string>"), ",").alias("candidates"),
        "price",
    )


@query
def rooms_repair(spark, sf_dir):
    """E5."""
    posts = view(spark, sf_dir, V.POSTS)
    return fields.with_repaired_rooms(posts, F.col("model_rooms"), F.col("text"), PARAMS, "rooms").select(
        "post_no",
        F.array_join(fields.rooms_mentions(F.col("text")).cast("array<string>"), ",").alias("mentions"),
        "rooms",
    )


def _judged(spark, sf_dir):
    """Posts through rules and the verdict on price and rooms."""
    ruled = screening.apply_rules(view(spark, sf_dir, V.POSTS), PARAMS)
    missing = [f for f in schemas.RECORD.fields if f.name not in ("rooms", "price")]
    record = F.struct(
        F.col("model_rooms").alias("rooms"),
        F.col("model_price").cast("bigint").alias("price"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing],
    )
    return judging.judge(ruled.withColumn("record", record), PARAMS)


@query
def verdict_counts(spark, sf_dir):
    """Flagship: C11 E2-E5 F1 H1 H2."""
    return reports.all_verdict_counts(_judged(spark, sf_dir))


@query
def verdict_rows(spark, sf_dir):
    """F1 per post."""
    return _judged(spark, sf_dir).select("post_no", "verdict", "price_val", "rooms_val")


@query
def counts_by_verdict(spark, sf_dir):
    """H1."""
    return reports.verdict_counts(view(spark, sf_dir, V.VERDICT_LOG))


@query
def run_summary(spark, sf_dir):
    """H5."""
    return reports.run_summary(_judged(spark, sf_dir))


# ------------------------------------------------------------------------------------------ fields
@query
def fees(spark, sf_dir):
    """E6 E7."""
    rows = view(spark, sf_dir, V.FIELDS).select(
        "post_no",
        fields.bimonthly_fee(F.col("arnona_txt")).alias("arnona"),
        fields.bimonthly_fee(F.col("vaad_txt")).alias("vaad"),
    )
    return judging.fee_quality(rows, PARAMS)


@query
def floors(spark, sf_dir):
    """E8."""
    return view(spark, sf_dir, V.FIELDS).select("post_no", fields.floor_number(F.col("floor_txt")).alias("floor"))


@query
def agent_flags(spark, sf_dir):
    """E9 E14."""
    post = F.concat("text", "agent_txt")
    return (
        view(spark, sf_dir, V.FIELDS)
        .withColumn("is_agent", fields.agent_flag(post, F.col("model_agent")))
        .select("post_no", "is_agent", text.tri_state(F.col("is_agent")).alias("shown"))
    )


@query
def parking(spark, sf_dir):
    """E10."""
    return view(spark, sf_dir, V.FIELDS).select("post_no", fields.parking_class(F.col("parking_txt")).alias("parking"))


@query
def entry_dates(spark, sf_dir):
    """E11 E12."""
    return view(spark, sf_dir, V.FIELDS).select("post_no", fields.entry_date_text(F.col("entry_txt")).alias("entry_date"))


@query
def address_class(spark, sf_dir):
    """E11 E13 E20."""
    post = F.concat("text", F.when(F.col("post_no") % 2 == 0, " ליד שדה תעופה").otherwise(""))
    return (
        view(spark, sf_dir, V.FIELDS)
        .withColumn("address", fields.clean_address(F.col("address_txt"), post))
        .withColumn("grade", fields.address_confidence(F.col("address")))
        .select("post_no", "address", "grade.confidence", "grade.warning")
    )


@query
def distances_checked(spark, sf_dir):
    """Whole metres of mixed text, kilometres."""
    events = view(spark, sf_dir, "select event_id, value from events")
    raw = (
        F.when(F.col("event_id") % 5 == 0, "inf")
        .when(F.col("event_id") % 5 == 1, "NaN")
        .when(F.col("event_id") % 5 == 2, "far")
        .otherwise(F.floor(F.col("value") * 100).cast("string"))
    )
    return events.withColumn("meters", fields.finite_meters(raw)).select(
        "event_id", "meters", fields.km(F.col("meters")).alias("km")
    )


# ------------------------------------------------------------------------------------------ dates
@query
def post_dates(spark, sf_dir):
    """E15 E16 E17 E18 C5."""
    return dates.with_post_date(view(spark, sf_dir, V.FIELDS), POSTS_CLOCK, "date_txt").select(
        "post_no",
        F.col("post_date").alias("shown"),
        "posted_on",
        F.col("unparsed_date").alias("unparsed"),
        dates.is_recent(F.col("posted_on"), POSTS_CLOCK, PARAMS.max_age_days).alias("recent"),
    )


@query
def relative_dates(spark, sf_dir):
    """E15 with every unit, on event times rendered as ages."""
    events = view(spark, sf_dir, "select event_id from events")
    units = ("s", "secs", " minute", "mins", " hrs", "H", " day", "d", "w", " wks", " months", "")
    unit = F.element_at(F.array(*[F.lit(u) for u in units]), (F.col("event_id") % len(units) + 1).cast("int"))
    count = F.when(F.col("event_id") % 17 == 3, F.col("event_id") * 7_000_001).otherwise(F.col("event_id") % 90)
    raw = F.concat(count.cast("string"), F.when(F.col("event_id") % 19 == 4, F.lit("0" * 20)).otherwise(""), unit)
    return events.select("event_id", dates.relative_date(raw, EVENTS_CLOCK).alias("posted_on"))


@query
def unparsed_dates(spark, sf_dir):
    """E17's report."""
    return reports.unparsed_dates(view(spark, sf_dir, V.FIELDS), POSTS_CLOCK, "date_txt")


# ------------------------------------------------------------------------------------------ extraction
@query
def json_validate(spark, sf_dir):
    """D1."""
    read = extraction.validated(view(spark, sf_dir, V.RESPONSES))
    return read.select(
        "post_no",
        F.col("record").isNotNull().alias("valid"),
        F.col("record.rooms").alias("rooms"),
        F.col("record.price").alias("price"),
        F.col("record.shelter").alias("shelter"),
        F.col("record.floor").alias("floor"),
    )


@query
def first_valid(spark, sf_dir):
    """D2 on an answer log: turns of a conversation are tries, their length decides the shape."""
    turns = view(spark, sf_dir, "select conv_id, turn, length(text) as n from conversations")
    answer = (
        F.when(F.col("n") % 4 == 0, F.lit('{"rooms": "many"}'))
        .when(F.col("n") % 4 == 1, F.lit("no json"))
        .otherwise(F.concat(F.lit('{"price": '), F.col("n").cast("string"), F.lit("}")))
    )
    log = turns.select(
        F.col("conv_id").alias("url"), (F.col("turn") + 1).alias("response_no"), answer.alias("response_json")
    )
    found = extraction.first_valid_response(log, PARAMS)
    return found.select(F.col("url").alias("conv_id"), F.col("record.price").alias("price"), "verdict")


@query
def record_json(spark, sf_dir):
    """A validated record written and read again is the same record."""
    read = extraction.validated(view(spark, sf_dir, V.RESPONSES))
    again = read.withColumn("parsed_json", lax.record_json(F.col("record"))).drop("record", "answered")
    back = extraction.validated(again, "parsed_json")
    return back.select(
        "post_no", "answered", F.col("record.rooms").alias("rooms"), F.col("record.floor").alias("floor")
    )


@query
def parse_attempts(spark, sf_dir):
    """D3 I4."""
    log = view(spark, sf_dir, V.VERDICT_LOG)
    return extraction.attempts_from_log(log, PARAMS).select("url", "attempts", "gave_up", "gave_up_at")


# ------------------------------------------------------------------------------------------ state and joins
def _state(spark, sf_dir):
    """State rows from the log, one per URL, with the columns the skip tests read."""
    log = view(spark, sf_dir, V.VERDICT_LOG)
    return log.groupBy("url").agg(
        F.max_by("verdict", "seq").alias("verdict"),
        F.count_if(F.col("verdict") == P.PARSE_FAILED).cast("int").alias("attempts"),
    )


@query
def skip_processed(spark, sf_dir):
    """Orders as a feed against the events state."""
    feed = view(
        spark,
        sf_dir,
        "select o_orderkey as ord, concat('https://example.test/u/', cast(o_custkey % 150 as string), '/',"
        " cast(o_orderkey % 10 as string)) as url from orders",
    )
    return state.skip_processed(feed, _state(spark, sf_dir), PARAMS).select("ord", "url")


def _listed(spark, sf_dir):
    return view(spark, sf_dir, V.LISTED)


@query
def skip_published(spark, sf_dir):
    """C4 G2."""
    feed = view(spark, sf_dir, V.POSTS).select("post_no", "url")
    return state.skip_published(feed, _listed(spark, sf_dir)).select("post_no", "url")


@query
def published_urls(spark, sf_dir):
    """A3 K1."""
    old = state.published_urls(_published(spark, sf_dir).filter("batch <> 'again'"))
    return state.with_published(old, _published(spark, sf_dir).filter("batch = 'again'"))


@query
def retry_candidates(spark, sf_dir):
    """A2 C13."""
    posts = _posts_state(spark, sf_dir)
    rows = screening.with_text(state.retry_candidates(posts))
    return state.skip_published(rows, _listed(spark, sf_dir)).select("url", "verdict")


@query
def first_per_url(spark, sf_dir):
    """G8."""
    log = view(spark, sf_dir, V.VERDICT_LOG)
    return screening.first_per_url(log, "url", "seq").select("url", "seq", "verdict")


def _posts_state(spark, sf_dir):
    """A full state table: every post of the view with a verdict and times."""
    rows = view(spark, sf_dir, V.FIELDS).select("*", *[c for c in _model_columns() if not isinstance(c, str)])
    seen = F.to_timestamp_ntz(F.col("order_date").cast("string"), F.lit("yyyy-MM-dd"))
    columns = {
        "raw_text": F.when(F.col("post_no") % 10 != 3, F.col("text")),
        "parsed_json": F.lit("{}"),
        "verdict": F.element_at(F.array(*[F.lit(v) for v in P.VERDICTS]), (F.col("post_no") % 7 + 1).cast("int")),
        "attempts": (F.col("post_no") % 4).cast("int"),
        "first_seen": seen,
        "last_processed": seen,
        "price_val": F.col("model_price").cast("double"),
        "rooms_val": F.col("model_rooms"),
        "address": F.col("address_txt"),
        "address_confidence": F.lit("high"),
        "distance_text": F.lit(""),
        "distance_meters": (F.col("post_no") % 6000).cast("int"),
        "post_date": F.col("date_txt"),
        "reject_reason": F.lit(""),
        "model_used": F.lit("model"),
    }
    return rows.withColumns(columns).select(
        *schemas.POSTS.names, "post_no", "model_price", "model_rooms", *_MODEL_TEXTS
    )


def _log_records(spark, sf_dir):
    """Records of a run: the odd events, as posts."""
    log = view(spark, sf_dir, V.VERDICT_LOG).withColumnRenamed("seq", "ord")
    empty = [c for c in state.REPLACED if c not in ("group_url", "verdict", "price_val")]
    types = {f.name: f.dataType for f in schemas.POSTS.fields}
    return log.withColumns({c: F.lit(None).cast(types[c]) for c in empty}).withColumn("price_val", F.col("value"))


@query
def upsert_posts(spark, sf_dir):
    """The first half of the log makes the state, the second half is merged into it."""
    records = _log_records(spark, sf_dir)
    none = spark.createDataFrame([], schemas.POSTS)
    before, after = datetime(2024, 1, 15), datetime(2024, 1, 31)
    first = records.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    second = records.filter(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    old = state.upsert_posts(none, first, before)
    return state.upsert_posts(old, second, after).select(
        "url", "group_url", "verdict", "attempts", "first_seen", "last_processed", "price_val"
    )


@query
def state_from_changes(spark, sf_dir):
    """L1 in its append-only form: the same rows as ``upsert_posts`` from a table of changes."""
    records = _log_records(spark, sf_dir)
    split = F.lit("2024-01-15").cast("timestamp_ntz")
    first = state.changes(records.filter(F.col("ts") < split), datetime(2024, 1, 15))
    second = state.changes(records.filter(F.col("ts") >= split), datetime(2024, 1, 31))
    table = first.withColumn("batch_id", F.lit(0)).unionByName(second.withColumn("batch_id", F.lit(1)))
    return state.current_state(table).select(
        "url", "group_url", "verdict", "attempts", "first_seen", "last_processed", "price_val"
    )


@query
def upsert_cache(spark, sf_dir):
    """Addresses of the log's URLs, the latest row of a key wins."""
    rows = view(spark, sf_dir, V.VERDICT_LOG).select(
        text.cache_key(F.concat(F.lit(" Street  "), F.col("seq") % 700)).alias("address_key"),
        F.col("url").alias("original_address"),
        *[F.lit("").alias(c) for c in ("canonical_address", "city", "confidence", "warning", "distance_text")],
        F.floor(F.col("value")).cast("int").alias("distance_meters"),
        F.lit(P.SOURCE_MEASURED).alias("distance_source"),
        F.lit("ok").alias("geocode_status"),
        F.col("ts").alias("updated_at"),
    )
    split = F.lit("2024-01-15").cast("timestamp_ntz")
    merged = state.upsert_cache(rows.filter(F.col("updated_at") < split), rows.filter(F.col("updated_at") >= split))
    return merged.select("address_key", "original_address", "distance_meters", "updated_at")


@query
def retention(spark, sf_dir):
    """L4."""
    kept = state.retain(_posts_state(spark, sf_dir), POSTS_CLOCK, PARAMS)
    return kept.select("url", "raw_text", "parsed_json", "verdict")


@query
def retention_report(spark, sf_dir):
    """H8."""
    return state.retention_report(_posts_state(spark, sf_dir), POSTS_CLOCK, PARAMS)


@query
def blank_invented(spark, sf_dir):
    """C14."""
    return state.blank_invented_addresses(_posts_state(spark, sf_dir)).select("url", "address", "distance_meters")


# ------------------------------------------------------------------------------------------ call budget
def _calls(spark, sf_dir):
    return view(
        spark,
        sf_dir,
        "select event_id as call_id, case when event_id % 3 = 0 then ts else ts + interval 20 days end as ts,"
        " event_type as kind from events",
    )


@query
def monthly_usage(spark, sf_dir):
    """H3 E24."""
    return reports.monthly_usage(_calls(spark, sf_dir))


@query
def upsert_usage(spark, sf_dir):
    """L3."""
    old = reports.monthly_usage(view(spark, sf_dir, "select o_orderdate as ts from orders")).unionByName(
        reports.monthly_usage(view(spark, sf_dir, "select ts from events"))
    )
    return state.upsert_usage(old, _calls(spark, sf_dir))


@query
def quota_status(spark, sf_dir):
    """H4."""
    return reports.quota_status(reports.monthly_usage(_calls(spark, sf_dir)), P.ScreenParams(monthly_call_cap=4000))


@query
def quota_skip(spark, sf_dir):
    """I5, 'skip'."""
    return addresses.within_budget(_calls(spark, sf_dir), 3000, "skip").select("call_id", "month", "allowed")


@query
def quota_halt(spark, sf_dir):
    """I5, 'halt'."""
    return addresses.within_budget(_calls(spark, sf_dir), 3000, "halt").select("call_id", "month")


# ------------------------------------------------------------------------------------------ addresses
def _geocodes(spark, sf_dir):
    src = view(spark, sf_dir, V.GEOCODE_SRC)

    def part(name, kind):
        return F.struct(name.alias("long_name"), F.array(F.lit(kind), F.lit("political")).alias("types"))

    parts = F.filter(
        F.array(
            part(F.col("city3"), "administrative_area_level_1"),
            part(F.col("city2"), "administrative_area_level_2"),
            part(F.col("city1"), "locality"),
            part(F.when(F.col("has_route"), "ביאליק"), "route"),
        ),
        lambda c: c["long_name"].isNotNull(),
    )
    result = F.struct(
        F.array(F.col("result_type")).alias("types"),
        F.col("formatted").alias("formatted_address"),
        parts.alias("address_components"),
    )
    good = F.struct(
        F.array(F.lit("street_address")).alias("types"),
        F.lit("ביאליק, רמת גן").alias("formatted_address"),
        F.array(part(F.lit("רמת גן"), "locality")).alias("address_components"),
    )
    results = F.slice(F.array(result, good), F.lit(1), F.col("n_results"))
    return src.select("address_key", "failed", results.alias("results"))


def _lookups(spark, sf_dir):
    cache = view(spark, sf_dir, V.CACHE).withColumn("updated_at", F.lit(V.AS_OF_POSTS).cast("timestamp_ntz"))
    # Every key has an older answer as well, another one, which must not count.
    now, before = (F.lit(t).cast("timestamp_ntz") for t in (V.AS_OF_POSTS, "2001-01-01 00:00:00"))
    geocodes = _geocodes(spark, sf_dir).withColumn("answered_at", now)
    geocodes = geocodes.unionByName(geocodes.withColumns({"failed": ~F.col("failed"), "answered_at": before}))
    routes = view(spark, sf_dir, V.ROUTES).withColumn("answered_at", now)
    routes = routes.unionByName(routes.withColumns({"meters": F.col("meters") + 9000, "answered_at": before}))
    # Nested answers are built once and read as a table, as they would be in use.
    return jobs.Lookups(cache, tables.Scratch(spark, "lookups")(geocodes, "geocodes"), routes)


@query
def geocode_accept(spark, sf_dir):
    """G4 G5 K2."""
    rows = _geocodes(spark, sf_dir).withColumns(
        {"address": F.col("address_key"), "confidence": F.lit("high"), "asked": F.lit(True)}
    )
    return addresses.accept_geocode(rows, PARAMS).select(
        "address_key", "canonical_address", "city", "geocode_confidence", "geocode_warning", "geocode_status"
    )


@query
def street_precision(spark, sf_dir):
    """G5 K2 in the wider form of the address repair."""
    best = F.get("results", F.lit(0))
    return _geocodes(spark, sf_dir).select(
        "address_key",
        addresses.result_city(best).alias("city"),
        addresses.has_street(best, P.STREET_LEVEL_TYPES, P.STREET_LEVEL_TYPES).alias("precise"),
    )


def _addressed(spark, sf_dir):
    return view(spark, sf_dir, V.FIELDS).withColumn("address", text.hebrew_only(F.coalesce("address_txt", F.lit(""))))


def _placed(spark, sf_dir):
    look, scratch = _lookups(spark, sf_dir), tables.Scratch(spark, "placed")
    rows = scratch(_addressed(spark, sf_dir).select("post_no", "address"), "rows")
    resolved = addresses.resolve_addresses(
        addresses.distinct_addresses(rows), look.cache, look.geocodes, look.routes, PARAMS
    )
    return addresses.with_distance(rows, scratch(resolved, "resolved"))


@query
def distance_lookup(spark, sf_dir):
    """G3 G6 E20."""
    placed = _placed(spark, sf_dir)
    return placed.select(
        "post_no", "distance_meters", "distance_source", "is_measured", "address_confidence", "address_warning"
    )


@query
def distance_limit(spark, sf_dir):
    """F2."""
    placed = _placed(spark, sf_dir)
    limited = judging.limit_distance(placed.withColumn("verdict", F.lit(P.ADDED)), PARAMS)
    return limited.select("post_no", "verdict")


def _repair_plan(spark, sf_dir):
    look = _lookups(spark, sf_dir)
    rows = view(spark, sf_dir, V.FIELDS).select(
        "url",
        "post_no",
        F.concat(
            F.col("address_txt"), F.when(F.col("post_no") % 2 == 0, "__old").otherwise("")
        ).alias("address"),
        ((F.col("post_no") % 100) / F.lit(10.0)).alias("distance_km"),
    )
    rows = tables.add_missing_columns(rows, schemas.LISTINGS).select("post_no", *schemas.LISTINGS.names)
    return addresses.repair_addresses(rows, look.geocodes, look.routes, PARAMS)


@query
def address_repair(spark, sf_dir):
    """G7 E22."""
    return _repair_plan(spark, sf_dir).select("post_no", "action", "new_address", "new_distance_km")


@query
def repair_report(spark, sf_dir):
    """H7."""
    return addresses.repair_report(_repair_plan(spark, sf_dir))


# ------------------------------------------------------------------------------------------ published table
def _published(spark, sf_dir):
    return view(spark, sf_dir, V.PUBLISHED)


@query
def dedupe_url(spark, sf_dir):
    """I1 I3."""
    return dedupe.best_per_url(_published(spark, sf_dir)).select("url", "ord", "pos", "copies", "post_date")


@query
def dedupe_listing(spark, sf_dir):
    """I2 I3."""
    return dedupe.deduplicated(_published(spark, sf_dir)).select("url", "ord", "pos", "copies")


@query
def publish(spark, sf_dir):
    """L5 C5 J1; rows are sorted by ``post_date``, newest first, then by ``pos``."""
    rows = dedupe.publish(_published(spark, sf_dir), POSTS_CLOCK, PARAMS)
    return rows.select("url", "ord", "post_date", "price", "rooms", "pos")


@query
def publish_report(spark, sf_dir):
    """H6."""
    return dedupe.publish_report(_published(spark, sf_dir), POSTS_CLOCK, PARAMS)


# ------------------------------------------------------------------------------------------ tables
@query
def staged_rewrite(spark, sf_dir):
    """Publish, append a second batch, then rewrite the table from itself."""
    root = tables.scratch_path(spark, "listings")
    rows = _published(spark, sf_dir)
    schema = rows.schema
    tables.rewrite(rows.filter("batch <> 'again'"), root)
    tables.append(rows.filter("batch = 'again'"), root)
    now = tables.read(spark, root, schema)
    tables.rewrite(dedupe.publish(now, POSTS_CLOCK, PARAMS).select(*schema.names), root)
    return tables.read(spark, root, schema).select("ord", "url", "post_date")


@query
def snapshot_and_clear(spark, sf_dir):
    """Rows in the snapshot and in the cleared table."""
    root = tables.scratch_path(spark, "listings")
    rows = _published(spark, sf_dir)
    tables.rewrite(rows, root)
    tables.snapshot(spark, root, "20010802_103000")
    tables.clear(spark, root, rows.schema)
    tables.forget(spark, root)
    both = tables.read_snapshot(spark, root, rows.schema, "20010802_103000").select(F.lit("snapshot").alias("part"), "ord").unionByName(
        tables.read(spark, root, rows.schema).select(F.lit("table").alias("part"), "ord")
    )
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum("ord").alias("ord_sum"))


@query
def additive_migration(spark, sf_dir):
    """A4 A5: an old state without the later columns is brought to the declared schema."""
    old = _posts_state(spark, sf_dir).select(*schemas.POSTS.names[:8])
    new = tables.check_schema(tables.add_missing_columns(old, schemas.POSTS), schemas.POSTS)
    return new.groupBy("verdict").agg(
        F.count("*").alias("n"), F.count("price_val").alias("prices"), F.count("raw_text").alias("texts")
    )


@query
def page_links(spark, sf_dir):
    """A10."""
    pages = view(spark, sf_dir, V.LINKED_PAGES)
    found = feeds.page_links(pages, "https://example.test/")
    return screening_input(found)


def screening_input(found):
    """Pages without a post link are left out."""
    return found.filter(F.col("url").isNotNull()).select("page_id", "url", "post_date_text")


@query
def canonical_urls(spark, sf_dir):
    """A10's cleaning on the pages' own addresses."""
    pages = view(spark, sf_dir, "select page_id, url from pages")
    return pages.select("page_id", feeds.canonical_url(F.col("url"), "https://example.test").alias("clean"))


# ------------------------------------------------------------------------------------------ jobs
_MODEL_TEXTS = tuple(
    f"model_{name}" for name in ("arnona", "vaad", "parking", "entry", "floor", "elevator", "agent", "address")
)


_CARRIED = ("model_price", "model_rooms", *_MODEL_TEXTS)


def _feed(spark, sf_dir):
    """The posts view as a feed; the model's answers ride along for the extractor below."""
    return view(spark, sf_dir, V.FIELDS).select(
        "post_no",
        "url",
        "group_url",
        F.concat("text", "agent_txt", F.lit(" View more comments 99 ₪")).alias("text"),
        F.col("date_txt").alias("post_date_text"),
        F.col("post_no").alias("ord"),
        "model_price",
        "model_rooms",
        *_model_columns(),
    )


def _model_columns():
    return [
        F.col("arnona_txt").alias("model_arnona"),
        F.col("vaad_txt").alias("model_vaad"),
        F.col("parking_txt").alias("model_parking"),
        F.col("entry_txt").alias("model_entry"),
        F.col("floor_txt").alias("model_floor"),
        "model_elevator",
        "model_agent",
        F.col("address_txt").alias("model_address"),
    ]


def _extractor(rows):
    """Stands in for a model: answers are JSON of columns of the row, some of them invalid."""
    key = F.regexp_extract("url", r"([0-9]+)\z", 1).cast("bigint")
    good = F.to_json(
        F.struct(
            F.col("model_rooms").alias("rooms"),
            F.col("model_price").alias("price"),
            F.col("model_arnona").alias("arnona"),
            F.col("model_vaad").alias("vaad"),
            F.col("model_parking").alias("parking"),
            F.col("model_entry").alias("entry_date"),
            F.col("model_floor").alias("floor"),
            F.col("model_elevator").alias("elevator"),
            F.col("model_agent").alias("is_agent"),
            F.col("model_address").alias("address"),
        )
    )
    bad = F.lit('{"rooms": "many"}')
    return rows.withColumn(
        "responses",
        F.when(key % 17 == 5, F.array(bad, bad)).when(key % 17 == 6, F.array(bad, good)).otherwise(F.array(good)),
    )


def _screen(spark, sf_dir):
    # Posts stored later than 1995 are known under another URL, so the feed meets both known and new ones.
    known_as = F.when(F.year("first_seen") < 1996, F.col("url")).otherwise(F.concat("url", F.lit("/later")))
    old = _posts_state(spark, sf_dir).select(known_as.alias("url"), "verdict", "attempts")
    return jobs.screen(
        _feed(spark, sf_dir),
        old,
        _listed(spark, sf_dir),
        _extractor,
        _lookups(spark, sf_dir),
        POSTS_CLOCK,
        tables.Scratch(spark, "screen"),
        PARAMS,
        _CARRIED,
    ).records


@query
def screen(spark, sf_dir):
    """Final verdict of every new post."""
    return _screen(spark, sf_dir).select(
        "url", "verdict", "reject_reason", "price_val", "rooms_val", "distance_meters", "posted_on"
    )


@query
def screen_listings(spark, sf_dir):
    """The published rows of a screening run."""
    rows = jobs.new_listings(_screen(spark, sf_dir), POSTS_CLOCK)
    return rows.select(
        "url", "price", "rooms", "entry_date", "floor", "elevator", "parking", "arnona", "vaad", "shelter",
        "is_agent", "post_date", "address", "scanned_at",
    )


@query
def feed_summary(spark, sf_dir):
    """H5 over a whole screening run: known posts are seen, too."""
    return reports.feed_summary(_feed(spark, sf_dir), _screen(spark, sf_dir), PARAMS)


@query
def published_text(spark, sf_dir):
    """The published rows as display text."""
    shown = judging.rendered_row(jobs.new_listings(_screen(spark, sf_dir), POSTS_CLOCK))
    return shown.select(
        "url", "price", "entry_date", "floor", "elevator", "parking", "arnona", "is_agent", "post_date", "scanned_at"
    )


@query
def analysis_columns(spark, sf_dir):
    """B7."""
    return judging.analysis_columns(_screen(spark, sf_dir)).select(
        "url", "price_val", "rooms_val", "address", "address_confidence", "post_date", "reject_reason"
    )


@query
def reprocess(spark, sf_dir):
    """L6."""
    done = jobs.reprocess(
        _posts_state(spark, sf_dir),
        _listed(spark, sf_dir),
        _extractor,
        _lookups(spark, sf_dir),
        POSTS_CLOCK,
        tables.Scratch(spark, "reprocess"),
        PARAMS,
        carry=_CARRIED,
    )
    return done.records.select("url", "verdict", "price_val", "rooms_val", "distance_meters")


@query
def replay(spark, sf_dir):
    """L7."""
    done = jobs.replay(
        _posts_state(spark, sf_dir),
        _extractor,
        _lookups(spark, sf_dir),
        POSTS_CLOCK,
        tables.Scratch(spark, "replay"),
        PARAMS,
        _CARRIED,
    )
    return done.records.select("url", "verdict", "reject_reason", "price_val", "rooms_val", "distance_meters")


@query
def maintain(spark, sf_dir):
    """What is left of the published table and of the state's texts."""
    listings, kept = jobs.maintain(_published(spark, sf_dir), _posts_state(spark, sf_dir), POSTS_CLOCK, PARAMS)
    return listings.agg(F.lit("listings").alias("part"), F.count("*").alias("n"), F.sum("ord").alias("check")).unionByName(
        kept.agg(
            F.lit("state").alias("part"), F.count("raw_text").alias("n"), F.sum(F.length("raw_text")).alias("check")
        )
    )


@query
def stream_screen(spark, sf_dir):
    """M1: the feed arrives as files in several micro-batches; the state afterwards."""
    root = tables.scratch_path(spark, "stream")
    feed = _feed(spark, sf_dir)
    feed.repartition("url").write.parquet(f"{root}/feed")
    store = Store(spark, f"{root}/store")
    running = screen_stream(
        feed_stream(spark, f"{root}/feed", feed.schema, files_per_batch=2),
        store,
        _extractor,
        _lookups(spark, sf_dir),
        lambda _: POSTS_CLOCK,
        PARAMS,
        _CARRIED,
    )
    running.awaitTermination()
    return store.state().select("url", "verdict", "attempts", "price_val", "rooms_val")


@query
def stream_state(spark, sf_dir):
    """M1 I4 L4: the feed through keyed state, then all of it again after a restart: only failed posts are tried again."""
    root = tables.scratch_path(spark, "gate")
    feed, store = _feed(spark, sf_dir), Store(spark, f"{root}/store")
    for _ in range(2):
        feed.repartition("url").write.mode("append").parquet(f"{root}/feed")
        posts = feed_stream(spark, f"{root}/feed", feed.schema)
        gated_stream(posts, store, _extractor, _lookups(spark, sf_dir), lambda _: POSTS_CLOCK, PARAMS, _CARRIED).awaitTermination()
    return store.state().select("url", "verdict", "attempts", "price_val", "rooms_val")


# ------------------------------------------------------------------------------------------ stored tables after a run
def _knowing_extractor(spark, sf_dir):
    """The same answers for rows that have lost their model columns on the way through a store: found by URL."""
    answers = _feed(spark, sf_dir).select("url", *_CARRIED)
    return lambda rows: _extractor(rows.join(answers, "url", "left")).drop(*_CARRIED)


def _store(spark, name):
    return Store(spark, tables.scratch_path(spark, name))


@query
def store_repeat(spark, sf_dir):
    """The state after a run, a compaction, the same run again and another compaction."""
    store, feed, look = _store(spark, "repeat"), _feed(spark, sf_dir), _lookups(spark, sf_dir)
    for _ in range(2):
        store.screen(0, feed, _extractor, look, POSTS_CLOCK, PARAMS, _CARRIED)
        store.compact(0)
    return store.state().select("url", "verdict", "attempts", "price_val", "rooms_val")


@query
def store_compact(spark, sf_dir):
    """L1 L2: the state after a feed in two runs, folded after each, once more, and downwards."""
    store, feed, look = _store(spark, "compact"), _feed(spark, sf_dir), _lookups(spark, sf_dir)
    for batch in (0, 1):
        part = feed.filter(F.col("post_no") % 2 == batch)
        store.screen(batch, part, _extractor, look, POSTS_CLOCK, PARAMS, _CARRIED)
        store.compact(batch)
    store.compact(1)
    store.compact(0)
    return store.state().select("url", "verdict", "attempts", "price_val", "rooms_val")


@query
def store_replay(spark, sf_dir):
    """The stored state after a replay under the present rules."""
    store = _store(spark, "replay")
    store.load(0, _posts_state(spark, sf_dir).select(*schemas.POSTS.names))
    store.replay(1, _knowing_extractor(spark, sf_dir), _lookups(spark, sf_dir), POSTS_CLOCK, PARAMS)
    return store.state().select("url", "verdict", "attempts")


@query
def store_commit(spark, sf_dir):
    """The state after a run that stopped before its commit, and two runs of which one ends within the other."""
    store, feed, look = _store(spark, "commit"), _feed(spark, sf_dir), _lookups(spark, sf_dir)
    other, half = Store(spark, store.root), F.pmod(F.xxhash64("url"), F.lit(2))

    def stopped(rows):
        raise InterruptedError

    def within(rows):
        other.screen(0, feed.filter(half == 0), _extractor, look, POSTS_CLOCK, PARAMS, _CARRIED)
        return _extractor(rows)

    try:
        store.screen(0, feed, stopped, look, POSTS_CLOCK, PARAMS, _CARRIED)
    except InterruptedError:
        pass
    store.screen(1, feed.filter(half == 1), within, look, POSTS_CLOCK, PARAMS, _CARRIED)
    return store.state().select("url", "verdict", "attempts", "price_val", "rooms_val")


@query
def state_buckets(spark, sf_dir):
    """L1: the rows of ``upsert_posts`` from a store in which each run's buckets are folded into those before."""
    store, records = _store(spark, "buckets"), _log_records(spark, sf_dir)
    split = F.lit("2024-01-15").cast("timestamp_ntz")
    for batch, (part, day) in enumerate(((F.col("ts") < split, 15), (F.col("ts") >= split, 31))):
        store.load(batch, state.changes(records.filter(part), datetime(2024, 1, day)))
        store.compact(batch)
    return store.state().select("url", "group_url", "verdict", "attempts", "first_seen", "last_processed", "price_val")


@query
def store_retention(spark, sf_dir):
    """L4 on stored tables: the texts that are read back once old ones have gone by their months."""
    store = _store(spark, "retention")
    store.load(0, _posts_state(spark, sf_dir).select(*schemas.POSTS.names))
    store.retain(POSTS_CLOCK, PARAMS)
    store.vacuum(keep=1)
    return store.state().select("url", "raw_text", "parsed_json", "verdict")


@query
def store_maintain(spark, sf_dir):
    """L8 on stored tables: what is left of the state's texts."""
    store = _store(spark, "maintain")
    store.load(0, _posts_state(spark, sf_dir).select(*schemas.POSTS.names))
    store.maintain(POSTS_CLOCK, PARAMS)
    return store.state().agg(F.count("*").alias("urls"), F.count("raw_text").alias("n"), F.sum(F.length("raw_text")).alias("check"))


@query
def store_reprocess(spark, sf_dir):
    """L6 on stored tables: the state after rejected and failed posts were judged again."""
    store = _store(spark, "reprocess")
    store.load(0, _posts_state(spark, sf_dir).select(*schemas.POSTS.names))
    store.reprocess(1, _knowing_extractor(spark, sf_dir), _lookups(spark, sf_dir), POSTS_CLOCK, PARAMS)
    return store.state().select("url", "verdict", "attempts")


@query
def publish_delta(spark, sf_dir):
    """The published view after three runs, each merged into the parts that it falls in."""
    store, rows = _store(spark, "published"), view(spark, sf_dir, V.PUBLISHED)
    found = rows.select(
        F.when(F.col("url") == "", F.concat(F.lit("none/"), "ord")).otherwise(F.col("url")).alias("url"),
        F.col("price").cast("int").alias("price"),
        F.col("rooms").cast("double").alias("rooms"),
        *(F.lit(None).cast(schemas.LISTINGS[c].dataType).alias(c) for c in schemas.LISTINGS.names[3:12]),
        "post_date",
        "address",
        F.expr("timestamp_ntz'2001-01-01 00:00:00' + make_dt_interval(0, 0, 0, ord)").alias("scanned_at"),
        "batch",
    )
    for number, batch in enumerate(("main", "again", "copy")):
        store.load(number, spark.createDataFrame([], schemas.POSTS), found.filter(F.col("batch") == batch).select(*schemas.LISTINGS.names))
        store.publish(POSTS_CLOCK, PARAMS)
    return store.published().select("url", "price", "rooms", "address", "post_date", "scanned_at")


@query
def lookup_requests(spark, sf_dir):
    """The addresses that the rest of a month's budget lets a run ask for, as they are asked."""
    look = _lookups(spark, sf_dir)
    graded = addresses._graded(addresses.distinct_addresses(_addressed(spark, sf_dir)), look.cache)
    requests = addresses.geocode_requests(graded, PARAMS)
    return addresses.within_rest(requests, 500, PARAMS, requests.count()).select("address_key", "query")


@query
def text_files(spark, sf_dir):
    """Every document as a file of its own, read back."""
    root = tables.scratch_path(spark, "texts")
    docs = view(spark, sf_dir, "select doc_id, text from documents")
    feeds.write_text_files(docs, root, F.col("doc_id"), F.col("text"))
    found = feeds.read_text_files(spark, f"{root}/*/")
    return found.groupBy(F.md5(F.regexp_replace("text", r"\n\z", "")).alias("digest")).agg(F.count("*").alias("n"))
