"""The published view that is kept by parts, against a loop that regroups everything each time."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest

from hearthline import params as P
from hearthline import schemas
from hearthline.plans import jobs
from hearthline.plans.store import Store
from hearthline.sources import tables
from hearthline.sources.commits import Conflict

NOW = datetime(2024, 5, 22, 9, 0)
STREETS = ["רחוב ארוך אחד", "רחוב ארוך שתיים", "רחוב ארוך שלוש", "רחוב ארוך ארבע", "אב", "", None]


def random_rows(rng, n, urls=60):
    found = {}
    for _ in range(n):
        url = f"u{rng.randrange(urls)}"
        day = rng.choice([None, *(date(2024, 5, 22) - timedelta(days=d) for d in (0, 1, 5, 15, 20, 21, 22))])
        found[url] = (url, rng.choice([5500, 6000, None]), rng.choice([3.0, -0.0, 0.0, None]), rng.choice(STREETS), day)
    return list(found.values())


def listings(spark, rows, batch):
    at = datetime(2024, 5, 1) + timedelta(hours=batch)
    wide = [{"url": u, "price": p, "rooms": r, "address": a, "post_date": d, "scanned_at": at} for u, p, r, a, d in rows]
    return spark.createDataFrame([tuple(w.get(c) for c in schemas.LISTINGS.names) for w in wide], schemas.LISTINGS)


def load(spark, store, batch, rows):
    store.load(batch, spark.createDataFrame([], schemas.POSTS), listings(spark, rows, batch))


def grown(standing, later, now):
    """Rows (place, row) after a publish: the newest of each URL, then of each listing, without stale ones, newest first."""
    newer = lambda a, b: (a[1][4] or date.min) > (b[1][4] or date.min)

    def best(rows, key):
        kept = {}
        for place, row in sorted(rows, key=lambda r: r[0]):
            k = key(row)
            if k not in kept:
                kept[k] = (place, (place, row))
            elif newer((place, row), kept[k][1]):
                kept[k] = (kept[k][0], (place, row))
        return [(first, row) for first, (_, row) in kept.values()]

    by_url = best([*standing, *later], lambda r: r[0])
    strong = lambda r: r[3] is not None and len(r[3]) >= 4
    by_key = best(by_url, lambda r: ("listing", r[3], None if r[2] is None else r[2] + 0.0, r[1]) if strong(r) else ("url", r[0]))
    fresh = [x for x in by_key if x[1][4] is None or datetime.combine(x[1][4], datetime.min.time()) >= now - timedelta(days=21)]
    return sorted(sorted(fresh, key=lambda x: x[0]), key=lambda x: x[1][4] or date.min, reverse=True)


def seen(df):
    return [(r.url, r.price, r.rooms, r.address, r.post_date) for r in df.collect()]


@pytest.mark.parametrize("seed", range(3))
def test_publish_by_parts_equals_regrouping(spark, tmp_path, seed):
    """Across clocks that go on and back, runs of no rows, and a replay, with more parts than rows and fewer."""
    rng, standing = random.Random(seed), []
    store = Store(spark, str(tmp_path / "store"), buckets=(3, 16, 200)[seed])
    clocks = [NOW, NOW + timedelta(days=3), NOW - timedelta(days=2), NOW + timedelta(days=1)]
    for batch, clock in enumerate(clocks):
        rows = random_rows(rng, (40, 5, 0, 12)[batch])
        load(spark, store, batch, rows)
        standing = grown(standing, [((batch, r[0]), r) for r in rows], clock)
        assert seen(store.publish(clock)) == [r for _, r in standing]
        index = store._index(store._view(store._now())).collect()
        assert len({r.url for r in index}) == len(index) >= len(standing)
        assert {r.url for r in store._listed(batch + 1).collect()} == {r[0] for _, r in standing}
    assert seen(store.publish(clocks[-1])) == [r for _, r in standing]


def test_a_small_run_writes_few_parts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), buckets=32)
    load(spark, store, 0, [(f"u{n}", 6000, 3.0, f"רחוב ארוך {n}", date(2024, 5, 20)) for n in range(600)])
    store.publish(NOW)
    first = store._view(store._now())
    assert len(first["parts"]) == len(first["urls"]) == 32
    # A new listing, and one that moves to another address: three parts at most, and the buckets of two URLs.
    load(spark, store, 1, [("new", 6000, 3.0, "רחוב חדש 1", date(2024, 5, 21)), ("u5", 6000, 3.0, "רחוב חדש 2", date(2024, 5, 21))])
    store.publish(NOW)
    second = store._view(store._now())
    changed = {kind: sum(first[kind][k] != second[kind][k] for k in second[kind]) for kind in ("parts", "urls")}
    assert 1 <= changed["parts"] <= 3 and 1 <= changed["urls"] <= 2
    rows = store.published().collect()
    assert len(rows) == 601 and {r.url: r.address for r in rows}["u5"] == "רחוב חדש 2" and {rows[0].url, rows[1].url} == {"new", "u5"}
    # What has grown stale is hidden without a write, also from the URLs a run skips.
    store.publish(NOW + timedelta(days=19))
    third = store._view(store._now())
    assert third["parts"] == second["parts"] and sorted(r.url for r in store.published().collect()) == ["new", "u5"]
    assert sorted(r.url for r in store._listed(9).collect()) == ["new", "u5"]


def test_a_run_that_falls_in_all_parts_compares_no_rows(spark, tmp_path, monkeypatch):
    """Its index is written from the rows of the view: no difference to the version before is worked out, no URL looked up."""
    store, staged, call = Store(spark, str(tmp_path / "store"), buckets=4), [], tables.Scratch.__call__
    monkeypatch.setattr(tables.Scratch, "__call__", lambda self, df, name: staged.append(name) or call(self, df, name))
    for batch in (0, 1):
        load(spark, store, batch, [(f"u{n}", 6000, 3.0, f"רחוב ארוך {n + batch}", date(2024, 5, 20 + batch)) for n in range(40 + batch)])
        staged.clear()
        store.publish(NOW)
        assert staged == ["later"]
        index = {r.url: r.part for r in store._index(store._view(store._now())).collect()}
        assert sorted(index) == sorted(r.url for r in store.published().collect()) and len(index) == 40 + batch
        rows = store._standing(store._view(store._now()))
        assert index == {r.url: r.part for r in rows.withColumn("part", store._part(store._now())).collect()}


def test_repair_moves_a_row_into_the_listing_it_equals(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), buckets=16)
    old, new = date(2024, 5, 18), date(2024, 5, 20)
    load(spark, store, 0, [("a", 6000, 3.0, "הרצל 5", old), ("b", 6000, 3.0, "הרצל, רמת גן", new), ("c", 6000, 3.0, None, new), ("d", 5500, 3.0, "בצפון 7", new)])
    store.publish(NOW)
    home = (["street_address"], "הרצל, רמת גן", [("רמת גן", ["locality"])])
    next_door = (["street_address"], "בצפון 7, גבעתיים", [(P.ScreenParams().neighbour_city, ["locality"])])
    geo = [("הרצל 5", False, [home]), ("הרצל, רמת גן", False, [home]), ("בצפון 7", False, [next_door])]
    geo += [(f"בצפון 7, {c}", False, [next_door]) for c in P.ScreenParams().home_cities]
    routes = spark.createDataFrame([("הרצל, רמת גן", "OK", 1200)], schemas.ROUTES)
    look = jobs.Lookups(None, spark.createDataFrame(geo, schemas.GEOCODES), routes)
    got = {r.url: (r.address, r.distance_km) for r in store.repair(look, NOW).collect()}
    assert got["b"] == ("הרצל, רמת גן", 1.2) and "a" not in got and "c" in got
    assert {r.url for r in store._listed(1).collect()} == set(got)


def test_two_publishers(spark, tmp_path, monkeypatch):
    """Of two that start from one version the later is told, and the view is that of the earlier."""
    store = Store(spark, str(tmp_path / "store"))
    load(spark, store, 0, [("a", 6000, 3.0, "הרצל 5", date(2024, 5, 20))])
    other, write = Store(spark, store.root), Store._write

    def interleaved(self, df, name, batch_id, by=None):
        monkeypatch.setattr(Store, "_write", write)
        other.publish(NOW)
        return write(self, df, name, batch_id, by)

    monkeypatch.setattr(Store, "_write", interleaved)
    with pytest.raises(Conflict, match="published"):
        store.publish(NOW)
    assert [r.url for r in store.published().collect()] == ["a"]
