"""Screening through keyed state: the same tables as the batch job, restarts, held posts, a standing state."""

from __future__ import annotations

from datetime import timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.plans.store import Store
from hearthline.streaming.gate import Gate, gated_stream
from hearthline.streaming.screening import feed_stream
from test_jobs import EXPECTED, NOW, POSTS, extractor, feed, lookups, verdicts


def run(spark, folder, live, asked=None, **more):
    def counting(rows):
        if asked is not None:
            asked.append(sorted(r.url for r in rows.select("url").collect()))
        return extractor(rows)

    gated_stream(feed_stream(spark, folder, files_per_batch=1), live, counting, lookups(spark), lambda _: NOW, **more).awaitTermination()


def put(rows, folder):
    rows.coalesce(1).write.mode("append").parquet(folder)


def test_restarts_try_failed_posts_only(spark, tmp_path):
    folder, live, asked = str(tmp_path / "feed"), Store(spark, str(tmp_path / "live")), []
    put(feed(spark), folder)
    run(spark, folder, live, asked)
    assert verdicts(live.state()) == EXPECTED
    assert sorted(r.url for r in live.listings().collect()) == ["u1", "u8"]
    standing = sorted(live.state().filter("url <> 'u4'").collect())
    for attempts in (2, 3, 3):
        put(feed(spark), folder)
        run(spark, folder, live, asked)
        assert {r.url: r.attempts for r in live.state().collect()}["u4"] == attempts
    assert sorted(live.state().filter("url <> 'u4'").collect()) == standing
    assert asked[1:] == [["u4"], ["u4"]]


def test_a_post_waits_for_the_verdict_of_the_one_before(spark, tmp_path):
    folder, live, asked = str(tmp_path / "feed"), Store(spark, str(tmp_path / "live")), []
    for _ in range(3):
        put(feed(spark), folder)  # three micro-batches of one start, whose verdicts the next start reads
    run(spark, folder, live, asked)
    assert len(asked) == 1 and verdicts(live.state()) == EXPECTED
    put(feed(spark, POSTS[:1]), folder)
    run(spark, folder, live, asked)
    assert asked[1:] == [["u4"]]  # the held one; the held posts of settled URLs are gone
    assert {r.url: r.attempts for r in live.state().collect()}["u4"] == 2


def test_a_standing_state_and_a_hot_url(spark, tmp_path):
    folder, live, asked = str(tmp_path / "feed"), Store(spark, str(tmp_path / "live")), []
    hot = feed(spark, POSTS[:1]).crossJoin(spark.range(5000)).withColumn("ord", F.col("id") + 100).drop("id")
    put(feed(spark).unionByName(hot), folder)
    known = spark.createDataFrame(
        [("u5", "added", 0), ("u4", "parse_failed", 3), ("u6", "parse_failed", 1), ("gone", None, 0)], "url string, verdict string, attempts int"
    )
    run(spark, folder, live, asked, known=known)
    assert verdicts(live.state()) == {u: v for u, v in EXPECTED.items() if u not in ("u4", "u5")}
    assert live.state().filter("url = 'u1'").first().first_seen == NOW


def test_an_empty_feed(spark, tmp_path):
    folder, live = str(tmp_path / "feed"), Store(spark, str(tmp_path / "live"))
    put(feed(spark).limit(0), folder)
    run(spark, folder, live)
    assert live.state().count() == 0


class Kept:
    """A value or a list of state that counts the calls made to it."""

    def __init__(self):
        self.value, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value=None):
        self.calls, self.value = self.calls + 1, value

    put, clear = update, update


def test_the_state_is_called_by_bucket_not_by_post():
    known, held, timers = Kept(), Kept(), []
    handle = SimpleNamespace(getValueState=lambda *_: known, getListState=lambda *_: held, registerTimer=timers.append)
    gate = Gate(T.StructType.fromDDL("url string, ord long"), 3, timedelta(days=1))
    gate.init(handle)
    at = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 1000)

    def send(rows):
        return [(r.url, r.ord) for r in gate.handleInputRows((0,), iter(rows), at)]

    def post(url, ord):
        return {"url": url, "post": {"url": url, "ord": ord}, "verdict": None, "batch_id": None}

    def verdict(url, found):
        return {"url": url, "post": None, "verdict": found, "batch_id": 0}

    assert sorted(send([post(f"u{n}", k) for k in (2, 1) for n in range(1000)])) == sorted((f"u{n}", 1) for n in range(1000))
    assert send([post("u1", 5), post("u2", 6), post("new", 7)]) == [("new", 7)] and len(held.value) == 2 and len(timers) == 1
    assert send([verdict("u1", "added"), verdict("u2", "parse_failed"), post("u2", 9)]) == [("u2", 6)] and held.value is None
    assert send([verdict("u2", "parse_failed"), post("u1", 10), post("u2", 11)]) == [] and [r[0] for r in held.value] == ["u2"]
    gate.handleExpiredTimer((0,), at, SimpleNamespace(getExpiryTimeInMs=lambda: 999 + 86_400_000))
    assert len(held.value) == 1
    gate.handleExpiredTimer((0,), at, SimpleNamespace(getExpiryTimeInMs=lambda: 1000 + 86_400_000))
    assert held.value is None and known.calls + held.calls < 30
