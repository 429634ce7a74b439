"""The jobs end to end on a small feed, in batch and as a stream."""

from __future__ import annotations

import json
import threading
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline import schemas
from hearthline.operators import reports, state
from hearthline.operators.addresses import BudgetSpent
from hearthline.plans import jobs
from hearthline.plans.store import Store
from hearthline.sources import tables
from hearthline.sources.commits import Conflict
from hearthline.streaming.screening import feed_stream, screen_stream

NOW = datetime(2024, 5, 22, 9, 0)
PARAMS = P.ScreenParams()

# url, text, date, answers, verdict
GOOD = {"rooms": 3, "price": 6200, "address": "הרצל 5"}
POSTS = [
    ("u1", "דירת 3 חדרים להשכרה, 6200 ₪ לחודש", "3 hrs", [GOOD], "added"),
    ("u2", "דירת 3 חדרים להשכרה, 6200 ₪ לחודש", "30d", [GOOD], "prefiltered"),
    ("u3", "סאבלט 3 חדרים להשכרה במרכז", None, [GOOD], "prefiltered"),
    ("u4", "דירת 3 חדרים להשכרה במרכז העיר", None, [{"rooms": "x"}, {"rooms": "y"}], "parse_failed"),
    ("u5", "דירת 3 חדרים להשכרה במרכז העיר", "1d", [{"rooms": "x"}, GOOD | {"address": "הרצל 9"}], "rejected_distance"),
    ("u6", "דירת 3 חדרים, היה 6,500 עכשיו 7,200 ₪", None, [GOOD | {"price": 7200}], "rejected_price"),
    ("u7", "דירת 3 חדרים להשכרה במרכז העיר", None, [{"rooms": 3}], "price_unknown"),
    ("u8", "דירת 3 חדרים להשכרה, 6200 ₪ View more comments סאבלט", "2 wks", [GOOD | {"address": None}], "added"),
    ("u9", "קצר מדי", None, [GOOD], None),
    (None, "דירת 3 חדרים להשכרה, 6200 ₪ לחודש", None, [GOOD], None),
    ("u1", "סאבלט 3 חדרים להשכרה במרכז", None, [GOOD], "added"),
    ("u10", "דירת 3 חדרים להשכרה, 6200 ₪ לחודש", None, [{"rooms": 4, "price": 6000}], "rejected_rooms"),
]
EXPECTED = {u: v for u, _, _, _, v in POSTS if v}


def extractor(rows):
    """Answers of a model, looked up by URL."""
    first = {}
    for url, _, _, answers, _ in POSTS:
        first.setdefault(url, [json.dumps(a) for a in answers])
    table = rows.sparkSession.createDataFrame([(u, a) for u, a in first.items() if u], "url string, responses array<string>")
    return rows.join(F.broadcast(table), "url", "left")


def feed(spark, posts=POSTS):
    rows = [(u, "g1" if n % 2 else "g2", t, d, n) for n, (u, t, d, _, _) in enumerate(posts)]
    return spark.createDataFrame(rows, schemas.POSTS_IN)


def lookups(spark):
    result = (["street_address"], "הרצל, רמת גן", [("רמת גן", ["locality"])])
    far = (["street_address"], "הרצל 9, רמת גן", result[2])
    geo = spark.createDataFrame([("הרצל 5", False, [result]), ("הרצל 9", False, [far])], schemas.GEOCODES)
    routes = spark.createDataFrame([("הרצל, רמת גן", "OK", 1200), ("הרצל 9, רמת גן", "OK", 4100)], schemas.ROUTES)
    return jobs.Lookups(spark.createDataFrame([], schemas.ADDRESS_CACHE), geo, routes)


def verdicts(df):
    return {r.url: r.verdict for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_screening_and_a_second_run(spark, store):
    store.screen(0, feed(spark), extractor, lookups(spark), NOW)
    first = store.state().collect()
    assert {r.url: r.verdict for r in first} == EXPECTED
    by_url = {r.url: r for r in first}
    assert by_url["u4"].attempts == 1 and by_url["u1"].distance_meters == 1200 and by_url["u1"].post_date == "22/05"
    assert by_url["u8"].raw_text == "דירת 3 חדרים להשכרה, 6200 ₪" and by_url["u8"].address == ""
    assert by_url["u2"].reject_reason == "older_than_21_days" and by_url["u6"].reject_reason == "rejected_price"
    assert json.loads(by_url["u1"].parsed_json)["price"] == 6200 and by_url["u3"].parsed_json is None
    assert sorted(r.url for r in store.listings().collect()) == ["u1", "u8"]
    assert {r.address_key: r.distance_meters for r in store.cache().collect()} == {"הרצל 5": 1200, "הרצל 9": 4100}
    # Eleven real posts, one of them without a link and one a copy.
    total = reports.feed_summary(feed(spark), store.state(), PARAMS).filter("is_total = 1").first()
    assert (total.seen, total.prefiltered, total.sent, total.added) == (11, 2, 7, 2)
    # Only the failed parse is looked at again, until its attempts are used up.
    for batch, attempts in ((1, 2), (2, 3), (3, 3)):
        store.screen(batch, feed(spark), extractor, lookups(spark), NOW)
        again = {r.url: r for r in store.state().collect()}
        assert again["u4"].attempts == attempts
        assert {u: r.verdict for u, r in again.items()} == EXPECTED
        assert [u for u, r in again.items() if r != by_url[u] and u != "u4"] == []
    assert sorted(r.url for r in store.listings().collect()) == ["u1", "u8"]


def test_stopped_posts_go_straight_into_the_records(spark):
    """They are neither judged nor written a second time, nor do they keep what only the extractor reads."""
    scratch, staged = tables.Scratch(spark, "stopped"), {}

    def stage(df, name):
        staged[name] = scratch(df, name)
        return staged[name]

    state_rows, listed = spark.createDataFrame([], "url string, verdict string, attempts int"), spark.createDataFrame([], "url string")
    posts = feed(spark).withColumn("hint", F.lit("x"))
    done = jobs.screen(posts, state_rows, listed, extractor, lookups(spark), NOW, stage, carry=("hint",))
    assert verdicts(done.records) == EXPECTED
    stopped = {u for u, v in EXPECTED.items() if v == P.PREFILTERED}
    assert {r.url for r in staged["judged"].collect()} == set(EXPECTED) - stopped
    assert {r.url for r in staged["ruled"].where("hint is null").collect()} == stopped
    row = done.records.where("url = 'u3'").first().asDict()
    assert (row["distance_source"], row["is_measured"], row["price_val"], row["address_confidence"]) == (P.SOURCE_SKIPPED, False, None, None)
    scratch.drop()


def test_reprocessing_writes_nothing_before_rows_are_judged(spark):
    """No rule stops a row, so all of them go to the extractor as they are read."""
    scratch, staged = tables.Scratch(spark, "again"), []

    def stage(df, name):
        staged.append(name)
        return scratch(df, name)

    none = spark.createDataFrame([], schemas.POSTS)
    known = jobs.screen(feed(spark), none, none, extractor, lookups(spark), NOW, scratch, PARAMS).with_text()
    posts = state.changes(known, NOW)
    done = jobs.reprocess(posts, none, extractor, lookups(spark), NOW, stage, PARAMS)
    wanted = {u: v for u, v in EXPECTED.items() if v in P.RETRY_VERDICTS}
    assert wanted and verdicts(done.records) == wanted
    assert {r.url for r in done.texts.where("raw_text is not null").collect()} == set(wanted)
    assert "ruled" not in staged and "judged" in staged
    scratch.drop()


def test_texts_and_answers_are_kept_without_a_join(spark):
    """The payload of a run is read from the rows that were written, in two pieces; it is that of the records."""
    none = spark.createDataFrame([], schemas.POSTS)
    done = jobs.screen(feed(spark), none, none, extractor, lookups(spark), NOW, tables.Scratch(spark, "test"), PARAMS)
    shown = done.texts._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in shown and "Exchange" not in shown and done.texts.columns == ["url", "raw_text", "parsed_json"]
    whole = sorted((r.url, r.raw_text, r.parsed_json or "") for r in done.with_text().collect())
    assert whole == sorted((r.url, r.raw_text, r.parsed_json or "") for r in done.texts.collect()) and len(whole) == len(EXPECTED)


def test_a_repeated_batch_changes_nothing(spark, store):
    store.screen(0, feed(spark), extractor, lookups(spark), NOW)
    before = sorted(store.state().collect()), sorted(map(str, store.listings().collect()))
    store.screen(0, feed(spark), extractor, lookups(spark), NOW)
    assert (sorted(store.state().collect()), sorted(map(str, store.listings().collect()))) == before


def test_compaction_keeps_the_state(spark, store):
    for batch in range(3):
        store.screen(batch, feed(spark), extractor, lookups(spark), NOW)
        if batch == 1:
            before = sorted(store.state().collect())
            store.compact(1)
            assert sorted(store.state().collect()) == before
    assert {r.url: r.attempts for r in store.state().collect()}["u4"] == 3


def test_stream_equals_batch(spark, store, tmp_path):
    store.screen(0, feed(spark), extractor, lookups(spark), NOW)
    folder = str(tmp_path / "feed")
    for part in (POSTS[:5], POSTS[5:]):
        feed(spark, part).withColumn("ord", F.col("ord") + (0 if part[0] is POSTS[0] else 5)).coalesce(1).write.mode("append").parquet(folder)
    live = Store(spark, str(tmp_path / "live"))
    running = screen_stream(feed_stream(spark, folder, files_per_batch=1), live, extractor, lookups(spark), lambda _: NOW)
    running.awaitTermination()
    assert verdicts(live.state()) == verdicts(store.state()) == EXPECTED
    assert sorted(r.url for r in live.listings().collect()) == ["u1", "u8"]
    # New files only; what is known stays as it is.
    before = sorted(live.state().filter("url <> 'u4'").collect())
    feed(spark).coalesce(1).write.mode("append").parquet(folder)
    screen_stream(feed_stream(spark, folder), live, extractor, lookups(spark), lambda _: NOW).awaitTermination()
    assert sorted(live.state().filter("url <> 'u4'").collect()) == before
    assert {r.url: r.attempts for r in live.state().collect()}["u4"] == 2


def test_reprocess_under_wider_limits(spark, store):
    store.screen(0, feed(spark), extractor, lookups(spark), NOW)
    wide = P.ScreenParams(max_price=8000, max_distance_km=5.0, include_price_unknown=True, max_rooms=4.0)
    done = jobs.reprocess(
        store.state(), store.listings().select("url"), extractor, lookups(spark), NOW, tables.Scratch(spark), wide
    )
    got = {r.url: r for r in done.records.collect()}
    assert {u: r.verdict for u, r in got.items()} == {
        "u4": "parse_failed", "u5": "added", "u6": "added", "u7": "added", "u10": "added",
    }
    assert got["u5"].post_date == "21/05"
    after = state.upsert_posts(store.state(), done.with_text(), datetime(2024, 5, 23))
    assert {r.url: r.attempts for r in after.collect()}["u4"] == 2


def test_replay_ignores_age_and_applies_rules(spark, store):
    store.screen(0, feed(spark), extractor, lookups(spark), NOW)
    old = store.state().withColumn("raw_text", F.when(F.col("url") != "u7", F.col("raw_text")))
    done = jobs.replay(old, extractor, lookups(spark), NOW, tables.Scratch(spark), PARAMS)
    assert verdicts(done.records) == {u: v for u, v in (EXPECTED | {"u2": "added"}).items() if u != "u7"}
    listings = jobs.new_listings(done.records, NOW)
    assert tables.check_schema(listings, schemas.LISTINGS) is listings


def test_maintain_and_publish(spark, store):
    store.screen(0, feed(spark), extractor, lookups(spark), NOW)
    view = store.publish(NOW)
    assert [r.url for r in view.collect()] == ["u1", "u8"]
    later = datetime(2024, 6, 20)
    assert [r.url for r in store.publish(later).collect()] == []
    listings, kept = jobs.maintain(store.listings(), store.state(), later, order="url")
    assert listings.count() == 0 and kept.filter("raw_text is not null").count() == 0


def contents(store):
    return tuple(sorted(map(str, df.collect())) for df in (store.state(), store.listings(), store.cache(), store.published()))


def test_a_batch_repeated_after_compaction(spark, store):
    for batch, part in ((0, POSTS[:6]), (1, POSTS[6:])):
        store.screen(batch, feed(spark, part), extractor, lookups(spark), NOW)
    store.publish(NOW)
    whole = contents(store)
    store.compact(0)
    store.compact(1)
    assert contents(store) == whole
    store.screen(1, feed(spark, POSTS[6:]), extractor, lookups(spark), NOW)
    store.publish(NOW)
    assert contents(store) == whole
    store.compact(1)
    store.compact(0)
    store.compact(1)
    assert contents(store) == whole
    with pytest.raises(ValueError, match="folded"):
        store.screen(0, feed(spark, POSTS[:6]), extractor, lookups(spark), NOW)
    assert contents(store) == whole


def test_a_run_killed_between_its_writes(spark, store, monkeypatch):
    store.screen(0, feed(spark), extractor, lookups(spark), NOW)
    store.publish(NOW)
    whole = contents(store)
    write = Store._write
    for table in ("addresses", "listings", "changes", "payload"):
        other = Store(spark, f"{store.root}-{table}")

        def broken(self, df, name, batch_id, by=None, table=table):
            if name == table:
                raise RuntimeError("killed")
            return write(self, df, name, batch_id, by)

        monkeypatch.setattr(Store, "_write", broken)
        with pytest.raises(RuntimeError, match="killed"):
            other.screen(0, feed(spark), extractor, lookups(spark), NOW)
        monkeypatch.setattr(Store, "_write", write)
        assert other.state().count() == other.listings().count() == other.cache().count() == 0
        other.screen(0, feed(spark), extractor, lookups(spark), NOW)
        other.publish(NOW)
        assert contents(other) == whole


def test_stored_replay_takes_listings_away(spark, store):
    store.screen(0, feed(spark), extractor, lookups(spark), NOW)
    assert [r.url for r in store.publish(NOW).collect()] == ["u1", "u8"]
    strict = P.ScreenParams(max_price=6100)
    for _ in range(2):  # repeated after a failure: the same
        assert store.replay(1, extractor, lookups(spark), NOW, strict).collect() == []
    assert verdicts(store.state())["u1"] == P.REJECTED_PRICE
    assert sorted(r.url for r in store.replay(2, extractor, lookups(spark), NOW).collect()) == ["u1", "u8"]  # u2 is too old to stay published


def test_stored_reprocess_and_maintain(spark, store):
    store.screen(0, feed(spark), extractor, lookups(spark), NOW)
    store.publish(NOW)
    wide = P.ScreenParams(max_price=8000, max_distance_km=5.0, include_price_unknown=True, max_rooms=4.0)
    got = store.reprocess(1, extractor, lookups(spark), NOW, wide)
    assert {r.url for r in got.collect()} >= {"u1", "u5", "u6"}
    assert verdicts(store.state())["u6"] == P.ADDED
    later = datetime(2024, 6, 20)
    assert store.maintain(later).filter("post_date is not null").count() == 0
    assert store.state().filter("raw_text is not null or parsed_json is not null").count() == 0
    assert verdicts(store.state())["u6"] == P.ADDED
    assert not list(Path(store.root).glob("data/changes-*/*.parquet")) and list(Path(store.root).glob("data/state-*/*/*.parquet"))


def test_stored_repair(spark, store):
    store.screen(0, feed(spark), extractor, lookups(spark), NOW)
    store.publish(NOW)
    fixed = {r.url: r for r in store.repair(lookups(spark), NOW).collect()}
    assert fixed["u1"].address == "הרצל, רמת גן" and fixed["u8"].address == ""


class Service:
    """Answers requests from a table and remembers them."""

    def __init__(self, table):
        self.table, self.asked = table, []

    def __call__(self, requests):
        self.asked.append({r.address_key: r.query for r in requests.collect()})
        return self.table.join(requests.select("address_key"), "address_key")


def services(spark):
    known = lookups(spark)
    return jobs.Lookups(None, Service(known.geocodes), Service(known.routes))


def test_services_are_asked_once_and_within_the_budget(spark, store):
    look = services(spark)
    store.screen(0, feed(spark, POSTS[:4]), extractor, look, NOW)
    assert look.geocodes.asked == [{"הרצל 5": "הרצל 5, רמת גן, גבעתיים, ישראל"}] and look.routes.asked == [{"הרצל, רמת גן": "הרצל, רמת גן"}]
    store.screen(1, feed(spark, [("v1", *POSTS[0][1:])]), extractor_like("v1"), look, NOW)
    assert look.geocodes.asked[1] == {} and look.routes.asked[1] == {}
    assert {r.month: r.calls for r in store.usage().collect()} == {"2024-05": 2}
    small = P.ScreenParams(monthly_call_cap=2)
    store.screen(2, feed(spark, POSTS[4:5]), extractor, look, NOW, small)
    assert look.geocodes.asked[2] == {} and {r.url: r.distance_text for r in store.state().collect()}["u5"] == P.WARN_QUOTA
    with pytest.raises(BudgetSpent):
        fresh = [("w1", POSTS[4][1], POSTS[4][2], POSTS[4][3], None)]
        store.screen(3, feed(spark, fresh), extractor_like("w1", POSTS[4][3]), look, NOW, P.ScreenParams(monthly_call_cap=2, on_cap="halt"))


def extractor_like(url, answers=POSTS[0][3]):
    return lambda rows: rows.withColumn("responses", F.when(F.col("url") == url, F.array(*[F.lit(json.dumps(a)) for a in answers])))


def test_the_cache_of_earlier_batches_serves_later_ones(spark, store):
    store.screen(0, feed(spark, POSTS[:1]), extractor, lookups(spark), NOW)
    before = store.cache().collect()
    store.screen(1, feed(spark, [("v1", *POSTS[0][1:])]), extractor_like("v1"), lookups(spark), datetime(2024, 5, 23))
    assert store.cache().collect() == before
    assert store._batches("addresses", schemas.ADDRESS_CACHE, 2, 0).count() == 0


def test_doubled_answers_publish_once(spark, store):
    known = lookups(spark)
    double = jobs.Lookups(known.cache, known.geocodes.union(known.geocodes), known.routes.union(known.routes))
    store.screen(0, feed(spark), extractor, double, NOW)
    assert sorted(r.url for r in store.listings().collect()) == ["u1", "u8"]


def test_posts_without_url_stay_out(spark, store):
    store.screen(0, feed(spark, [("", *POSTS[0][1:]), ("", *POSTS[5][1:])]), extractor_like(""), lookups(spark), NOW)
    assert store.state().count() == 0 and store.listings().count() == 0


def test_two_writers_of_one_batch(spark, store, monkeypatch):
    """The later one is told and leaves nothing; writers of different batches both win."""
    store.screen(0, feed(spark, POSTS[:3]), extractor, lookups(spark), NOW)
    other = Store(spark, store.root)
    write = Store._write

    def during(batch):
        def interleaved(self, df, name, batch_id, by=None):
            if name == "payload":
                monkeypatch.setattr(Store, "_write", write)
                other.screen(batch, feed(spark, POSTS[3:6]), extractor, lookups(spark), NOW)
            return write(self, df, name, batch_id, by)

        monkeypatch.setattr(Store, "_write", interleaved)

    during(1)
    with pytest.raises(Conflict):
        store.screen(1, feed(spark, POSTS[5:]), extractor, lookups(spark), NOW)
    assert set(verdicts(store.state())) == {"u1", "u2", "u3", "u4", "u5", "u6"}
    during(3)
    store.screen(2, feed(spark, POSTS[6:]), extractor, lookups(spark), NOW)
    assert store.last_batch() == 3 and verdicts(store.state()) == EXPECTED | {"u4": "parse_failed"}


def test_log_entries_are_made_once(spark, tmp_path):
    from hearthline.sources.commits import CommitLog

    log, seen = CommitLog(spark, str(tmp_path / "log")), []

    def add(name):
        for _ in range(5):
            log.commit(lambda e: seen.append(name) or e | {"n": e.get("n", 0) + 1, name: e.get(name, 0) + 1})

    writers = [threading.Thread(target=add, args=(n,)) for n in "abc"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert log.last() == (15, {"n": 15, "a": 5, "b": 5, "c": 5}) and len(seen) >= 15
    assert log.forget(2, lambda e: {f"data/{e['n']}"}) == {f"data/{n}" for n in range(1, 14)} and log.numbers() == [14, 15]


def test_a_reader_sees_a_run_whole_or_not_at_all(spark, store, monkeypatch):
    store.screen(0, feed(spark, POSTS[:4]), extractor, lookups(spark), NOW)
    reader, before, seen = Store(spark, store.root), contents(store), []
    write = Store._write

    def read_before(self, df, name, batch_id, by=None):
        folder = write(self, df, name, batch_id, by)
        seen.append(contents(reader) == before)
        return folder

    monkeypatch.setattr(Store, "_write", read_before)
    store.screen(1, feed(spark, POSTS[4:]), extractor, lookups(spark), NOW)
    assert len(seen) >= 4 and all(seen) and contents(reader) != before


def test_old_payload_goes_by_month(spark, store):
    """No file of a young month is written again, and what is old in a month that stays is hidden."""
    for batch, day in enumerate((datetime(2024, 3, 20), datetime(2024, 4, 2), datetime(2024, 4, 25), datetime(2024, 5, 20))):
        store.screen(batch, feed(spark, [(f"p{batch}", *POSTS[0][1:])]), extractor_like(f"p{batch}"), lookups(spark), day)
    store.compact(1)
    files = lambda: {str(p.relative_to(store.root)): p.stat().st_mtime_ns for p in Path(store.root).glob("data/payload-*/*/*.parquet")}
    before = files()
    texts = lambda: sorted(r.url for r in store.state().filter("raw_text is not null").collect())
    assert texts() == ["p0", "p1", "p2", "p3"]
    store.retain(datetime(2024, 5, 10))  # older than 19 April
    assert texts() == ["p2", "p3"] and store.state().count() == 4
    store.vacuum(keep=1)
    after = files()
    assert set(before) - set(after) == {f for f in before if "month=2024-03" in f} and all(before[f] == t for f, t in after.items())
    store.maintain(datetime(2024, 6, 30))
    assert texts() == [] and verdicts(store.state())["p3"] == P.ADDED and not files()


def test_merged_pieces_of_closed_runs(spark, store, monkeypatch):
    from hearthline.plans import store as module

    monkeypatch.setattr(module, "_PIECES", 1)
    for batch in range(4):
        store.screen(batch, feed(spark, [(f"p{batch}", *POSTS[0][1:]), POSTS[3]]), extractor_like(f"p{batch}"), lookups(spark), NOW)
        store.publish(NOW)
        whole = contents(store)
        store.compact(batch)
        assert contents(store) == whole
    kept = store._now()["kept"]
    assert len(kept["listings"]) == 1 and all(len(p) == 1 for p in kept["payload"].values())
    store.vacuum(keep=1)
    assert contents(store) == whole and store.state().filter("raw_text is null").count() == 0
