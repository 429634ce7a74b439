"""Where the jobs keep their tables.

A run writes ``addresses`` (what was looked up), ``usage`` (calls made), ``listings`` (what was found worth publishing),
``changes`` (what was learnt about each URL) and ``payload`` (texts and model answers) into folders of new names, and one entry
of the commit log then names them all.  A reader takes the newest entry and sees a run whole or not at all.  Writing a run
again names other folders for it, so a repeated run changes nothing; two writers of one run can't both win.

The history is laid out in buckets of the URL's hash.  A run reads only the buckets its own URLs fall in, and ``compact``
folds finished runs into a base of the buckets that they touched, the others being carried over by name.  The base before the
newest stays, and so do the runs above it: such a run may be repeated, and what was folded from its first attempt is then
dropped.  An older run is refused.

Payload lies in months of the day its URL was first seen.  Old payload is hidden at once and goes by whole months; no other file
is touched.

``published`` is the deduplicated view, in parts by the hash of the listing key, with an index of its URLs in parts by the hash of
the URL.  A version continues the one before: only parts that later listings or rows taken back fall in are merged and written,
the others are carried over by name.  Rows that have grown stale meanwhile are hidden by their date until their part is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline import params as P
from hearthline import schemas
from hearthline.functions import dates
from hearthline.functions.dates import clock, month_key
from hearthline.operators import addresses, dedupe, state as history
from hearthline.plans import jobs
from hearthline.sources import commits, tables
from hearthline.sources.commits import Conflict

_LAST_BATCH = 9223372036854775807
_PIECES = 16  # folders of closed runs that a month or the listings gather before they are merged
# A published row remembers its first position, which decides between rows of one date.
_PLACE = (("first_batch", T.LongType()), ("first_seen_at", T.TimestampNTZType()), ("first_url", T.StringType()))
_PUBLISHED = T.StructType([*schemas.LISTINGS.fields, *(T.StructField(n, t) for n, t in _PLACE)])
_INDEX = T.StructType([T.StructField("url", T.StringType()), T.StructField("post_date", T.DateType()), T.StructField("part", T.IntegerType())])
_NO_VIEW = {"up_to": -1, "cutoff": None, "parts": {}, "urls": {}}
_NAMES = [f.name for f in schemas.CHANGES.fields]


def _place():
    return F.struct(*(n for n, _ in _PLACE))


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])


def _entry(found: dict) -> dict:
    """An entry with all its parts."""
    empty = {"batches": {}, "bases": [], "views": [], "replayed": [], "closed": -1, "cutoff": None, "named": {}, "kept": {"listings": [], "payload": {}}}
    return empty | found


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        """``buckets``: into how many the URLs are dealt; fixed by the first commit.  Choose some hundred MB of state each."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.log = commits.CommitLog(spark, self.root)
        self._buckets = buckets

    # ------------------------------------------------------------------------------------------ entries
    def _now(self) -> dict:
        return _entry(self.log.last()[1])

    def _commit(self, change) -> None:
        def whole(found: dict) -> dict:
            entry = _entry(found)
            entry.setdefault("buckets", self._buckets)
            change(entry)
            return entry

        self.log.commit(whole)

    def bucket(self, entry: dict, url=None):
        """The bucket of a URL column, or of ``url``."""
        return F.pmod(F.xxhash64(F.col("url") if url is None else url), F.lit(entry.get("buckets", self._buckets))).cast("int")

    @staticmethod
    def _base(entry: dict, before: int = _LAST_BATCH) -> dict:
        """The newest base that holds nothing from ``before`` on."""
        return max((b for b in entry["bases"] if b["up_to"] < before), key=lambda b: b["up_to"], default={"up_to": -1, "state": {}, "cache": None, "usage": None})

    @staticmethod
    def _runs(entry: dict, before: int, after: int = -1) -> dict[int, dict]:
        return {int(b): t for b, t in entry["batches"].items() if after < int(b) < before}

    def is_closed(self, batch_id: int) -> bool:
        """Whether a run is recorded for good: folded, and not to be written again."""
        return batch_id <= self._now()["closed"]

    # ------------------------------------------------------------------------------------------ reading
    def _read(self, paths: Iterable[str | None], schema: T.StructType) -> DataFrame:
        found = [f"{self.root}/{p}" for p in paths if p]
        return self.spark.read.schema(schema).parquet(*found) if found else tables.empty(self.spark, schema)

    def _batches(self, table: str, schema: T.StructType, before: int = _LAST_BATCH, after: int = -1, entry: dict | None = None) -> DataFrame:
        """Rows of the runs between two batches, neither included; other runs' folders are not opened."""
        entry = entry or self._now()
        paths = [t.get(table) for t in self._runs(entry, before, after).values()]
        if table == "listings":
            paths += [p for b, p in entry["kept"]["listings"] if b > after]
            # A merged folder holds several closed runs.
            return self._read(paths, _with_batch(schema)).where((F.col("batch_id") < before) & (F.col("batch_id") > after))
        return self._read(paths, _with_batch(schema))

    def _changes(self, entry: dict, before: int = _LAST_BATCH, buckets: list[int] | None = None) -> DataFrame:
        """The newest usable base and later changes; of the given buckets only, whose files alone are opened."""
        base = self._base(entry, before)
        runs = self._runs(entry, before, base["up_to"]).values()
        if buckets is None:
            return self._read([*base["state"].values(), *(t["changes"] for t in runs)], schemas.CHANGES)
        wanted = set(buckets)
        paths = [p for b, p in base["state"].items() if int(b) in wanted]
        paths += [t["changes"] for t in runs if wanted & set(t["buckets"])]
        return self._read(paths, schemas.CHANGES).where(F.col("bucket").isin(sorted(wanted)))

    def _has(self, entry: dict, before: int, buckets: list[int]) -> bool:
        """Whether anything was recorded in some buckets before a run."""
        base, wanted = self._base(entry, before), set(buckets)
        runs = self._runs(entry, before, base["up_to"]).values()
        return any(int(b) in wanted for b in base["state"]) or any(wanted & set(t["buckets"]) for t in runs)

    def _folded(self, entry: dict, before: int = _LAST_BATCH, buckets: list[int] | None = None) -> DataFrame:
        """One row per URL.  A base, or a run on no base, has just that and is taken as it is."""
        rows = self._changes(entry, before, buckets)
        return rows.where("url is not null") if self._alone(entry, before) else history.fold_changes(rows)

    def _alone(self, entry: dict, before: int) -> bool:
        base = self._base(entry, before)
        return bool(base["state"]) + len(self._runs(entry, before, base["up_to"])) <= 1

    def _narrow(self, entry: dict, before: int, rows: DataFrame) -> DataFrame:
        return rows.select("url", "verdict", "attempts", "first_seen") if self._alone(entry, before) else history.narrow_state(rows)

    def _touched(self, entry: dict, urls: DataFrame) -> list[int]:
        """Buckets of some URLs: no more numbers than there are buckets."""
        return sorted(r[0] for r in urls.select(self.bucket(entry)).distinct().collect())

    def _payload(self, entry: dict, before: int = _LAST_BATCH) -> DataFrame:
        """Texts and answers that are not too old, by URL and run."""
        months = [m for t in self._runs(entry, before).values() for m in t["payload"].values()]
        return self._read([*months, *(p for parts in entry["kept"]["payload"].values() for _, p in parts)], schemas.PAYLOAD)

    def state(self, before: int = _LAST_BATCH) -> DataFrame:
        """The newest row of each URL, with its payload where that is not past its age."""
        entry = self._now()
        rows = self._folded(entry, before).join(history.many(self._payload(entry, before)), ["url", "batch_id"], "left")
        if entry["cutoff"]:
            young = F.col("first_seen") >= F.lit(datetime.fromisoformat(entry["cutoff"])).cast("timestamp_ntz")
            rows = rows.withColumns({c: F.when(young, F.col(c)) for c in schemas.PAYLOAD_COLUMNS})
        return rows.select(*schemas.POSTS.names)

    def narrow_state(self, before: int = _LAST_BATCH, urls: DataFrame | None = None) -> DataFrame:
        """Verdict, attempts and first sight, of all posts or of the given URLs only: only their buckets are read."""
        entry = self._now()
        if urls is None:
            return self._narrow(entry, before, self._changes(entry, before))
        rows = self._changes(entry, before, self._touched(entry, urls))
        return self._narrow(entry, before, rows.join(history.many(urls.select("url"), urls.count()), "url", "left_semi"))

    def cache(self, before: int = _LAST_BATCH) -> DataFrame:
        """The address cache: the latest row of each address."""
        entry = self._now()
        base = self._base(entry, before)
        rows = self._batches("addresses", schemas.ADDRESS_CACHE, before, base["up_to"], entry)
        return history.upsert_cache(self._read([base["cache"]], schemas.ADDRESS_CACHE), rows)

    def usage(self, before: int = _LAST_BATCH) -> DataFrame:
        """Calls made in each month."""
        entry = self._now()
        base = self._base(entry, before)
        rows = self._batches("usage", schemas.API_USAGE, before, base["up_to"], entry).drop("batch_id")
        return rows.unionByName(self._read([base["usage"]], schemas.API_USAGE)).groupBy("month").agg(F.sum("calls").alias("calls"))

    def listings(self, before: int = _LAST_BATCH) -> DataFrame:
        """What runs found worth publishing, whether or not it is still published."""
        return self._batches("listings", schemas.LISTINGS, before)

    def published(self, before: int = _LAST_BATCH) -> DataFrame:
        """The published rows, newest first."""
        return self._shown(self._view(self._now(), before))

    def snapshot(self, name: str) -> DataFrame:
        """The published view under a name given by ``replay``."""
        return self._shown(self._now()["named"][name])

    def _shown(self, view: dict) -> DataFrame:
        return dedupe.newest_first(self._standing(view).withColumn("pos", _place())).select(*schemas.LISTINGS.names)

    def _view(self, entry: dict, before: int = _LAST_BATCH) -> dict:
        view = max((v for v in entry["views"] if v["up_to"] < before), key=lambda v: v["up_to"], default=_NO_VIEW)
        cleared = max((b - 1 for b in entry["replayed"] if b < before), default=-1)
        return view if view["up_to"] > cleared else _NO_VIEW | {"up_to": cleared}  # a replay starts from nothing

    @staticmethod
    def _young(view: dict, rows: DataFrame) -> DataFrame:
        """Without the rows that this version hides for their age."""
        return rows.where(dates.is_recent(F.col("post_date"), datetime.fromisoformat(view["cutoff"]), 0)) if view["cutoff"] else rows

    def _standing(self, view: dict, parts: Iterable[int] | None = None) -> DataFrame:
        """Published rows; of the given parts only, whose files alone are opened."""
        wanted = None if parts is None else {str(p) for p in parts}
        return self._young(view, self._read((f for p, f in view["parts"].items() if wanted is None or p in wanted), _PUBLISHED))

    def _index(self, view: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        """URL, date and part of every stored row, hidden ones too; of the given buckets of URLs only."""
        wanted = None if buckets is None else {str(b) for b in buckets}
        return self._read((f for b, f in view["urls"].items() if wanted is None or b in wanted), _INDEX)

    def _later(self, entry: dict, before: int = _LAST_BATCH) -> DataFrame:
        """Listings of the runs after the newest version, each with its first position."""
        later = self._batches("listings", schemas.LISTINGS, before, self._view(entry, before)["up_to"], entry)
        return later.withColumns({"first_batch": F.col("batch_id"), "first_seen_at": F.col("scanned_at"), "first_url": F.col("url")}).drop("batch_id")

    def _listed(self, before: int, urls: DataFrame | None = None) -> DataFrame:
        """URLs that are published or about to be; of the given ones only, by the buckets of the index that they fall in."""
        entry = self._now()
        view = self._view(entry, before)
        found = self._young(view, self._index(view, None if urls is None else self._touched(entry, urls)))
        rows = found.select("url").unionByName(self._later(entry, before).select("url"))
        return rows if urls is None else rows.join(history.many(urls.select("url"), urls.count()), "url", "left_semi")

    # ------------------------------------------------------------------------------------------ writing
    def _write(self, df: DataFrame, table: str, batch_id: int, by: str | None = None) -> str:
        """Write rows into a folder of a new name; nobody reads it before an entry names it."""
        folder = f"data/{table}-{batch_id}-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(f"{self.root}/{folder}")
        return folder

    def _parts(self, folder: str, by: str) -> dict[str, str]:
        """The partitions of a folder: value and path."""
        path, fs = commits.hadoop_path(self.spark, f"{self.root}/{folder}")
        names = (s.getPath().getName() for s in fs.listStatus(path))
        return {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith(f"{by}=")}

    def _stored(self, entry: dict, batch_id: int, learnt: DataFrame, payload: DataFrame) -> dict:
        """Write what a run learnt (narrow columns of ``POSTS``) by bucket and its payload (with ``first_seen``) by month.

        A URL's month is that of its first sight, in this run or an earlier one; URLs of earlier runs are found on narrow
        columns and written, so payload is shuffled only where they are many.
        """
        number = F.lit(batch_id).cast("bigint")
        rows = learnt.withColumns({"bucket": self.bucket(entry), "batch_id": number}).select(*_NAMES)
        changes = self._write(rows.sortWithinPartitions("bucket"), "changes", batch_id)
        narrow = self._read([changes], schemas.CHANGES)
        found = {r[0]: r[1] for r in narrow.groupBy("bucket").count().collect()}
        touched, n = sorted(found), sum(found.values())
        rows, first, scratch = payload.withColumn("batch_id", number), F.col("first_seen"), tables.Scratch(self.spark, f"seen-{batch_id}")
        try:
            if self._has(entry, batch_id, touched):
                old = self._changes(entry, batch_id, touched).select("url", F.col("first_seen").alias("_seen"))
                old = old.join(history.many(narrow.select("url"), n), "url", "left_semi").groupBy("url").agg(F.min("_seen").alias("_seen"))
                old = scratch(old, "seen")
                if n_old := old.count():
                    rows, first = rows.join(history.many(old, n_old), "url", "left"), F.least("first_seen", "_seen")
            dated = rows.withColumn("month", month_key(first)).select(*schemas.PAYLOAD.names, "month")
            parts = self._parts(self._write(dated, "payload", batch_id, "month"), "month")
        finally:
            scratch.drop()
        return {"changes": changes, "buckets": touched, "payload": parts}

    def _add(self, batch_id: int, started: dict, run: dict, replayed: bool = False) -> None:
        """One commit for all that a run wrote."""

        def change(entry: dict) -> None:
            self._refuse_closed(entry, batch_id)
            if entry["batches"].get(str(batch_id)) != started["batches"].get(str(batch_id)):
                raise Conflict(f"another writer has recorded batch {batch_id}")
            entry["batches"][str(batch_id)] = run
            for kind in ("bases", "views"):  # what holds the run's first attempt
                entry[kind] = [x for x in entry[kind] if x["up_to"] < batch_id]
            entry["replayed"] = sorted({*entry["replayed"], batch_id}) if replayed else [b for b in entry["replayed"] if b != batch_id]

        self._commit(change)

    @staticmethod
    def _refuse_closed(entry: dict, batch_id: int) -> None:
        if batch_id <= entry["closed"]:
            raise ValueError(f"batch {batch_id} has been folded away and can't be written again")

    def record(self, batch_id: int, outcome: jobs.Outcome, at: datetime, started: dict | None = None, replayed: bool = False) -> None:
        """Keep a run's addresses and calls, its listings and what it learnt about its posts, in one commit.

        The records name each URL once, are read twice and should be written ones.
        """
        started = started or self._now()
        self._refuse_closed(started, batch_id)
        number = F.lit(batch_id).cast("bigint")
        run = {"addresses": self._write(addresses.new_cache_rows(outcome.resolved, clock(at)).withColumn("batch_id", number), "addresses", batch_id)}
        if outcome.calls is not None:
            run["usage"] = self._write(outcome.calls.withColumn("batch_id", number), "usage", batch_id)
        run["listings"] = self._write(jobs.new_listings(outcome.records, at).withColumn("batch_id", number), "listings", batch_id)
        run |= self._stored(started, batch_id, history.learnt_once(outcome.records, at), outcome.texts.withColumn("first_seen", clock(at)))
        self._add(batch_id, started, run, replayed)

    def load(self, batch_id: int, posts: DataFrame, listings: DataFrame | None = None) -> None:
        """Take over a state from elsewhere (columns of ``POSTS``, a row per URL), and listings, as a run of its own."""
        entry = self._now()
        tables.check_schema(posts, schemas.POSTS)
        payload = posts.select("url", *schemas.PAYLOAD_COLUMNS, "first_seen")
        run = self._stored(entry, batch_id, posts.drop(*schemas.PAYLOAD_COLUMNS), payload)
        if listings is not None:
            rows = tables.check_schema(listings, schemas.LISTINGS).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            run["listings"] = self._write(rows, "listings", batch_id)
        self._add(batch_id, entry, run)

    def _lookups(self, lookups: jobs.Lookups, batch_id: int) -> jobs.Lookups:
        """The caller's services with this store's cache and usage as they were before the run."""
        cache = self.cache(batch_id)
        if lookups.cache is not None:
            cache = history.upsert_cache(lookups.cache, cache)
        return jobs.Lookups(cache, lookups.geocodes, lookups.routes, self.usage(batch_id))

    def _run(self, name: str, batch_id: int, as_of: datetime, job, replayed: bool = False, told=None) -> None:
        """Record a job's outcome; its scratch tables go in any case.  ``told`` gets the records before they are kept."""
        started = self._now()
        self._refuse_closed(started, batch_id)
        scratch = tables.Scratch(self.spark, f"{name}-{batch_id}")
        try:
            found = job(scratch)
            records = scratch(found.records.drop("parsed_json"), "records")  # kept with the payload
            if told is not None:
                told(records)
            self.record(batch_id, jobs.Outcome(records, found.resolved, found.calls, found.texts), as_of, started, replayed)
        finally:
            scratch.drop()

    def screen(
        self,
        batch_id: int,
        posts_in: DataFrame,
        extractor: jobs.Extractor,
        lookups: jobs.Lookups,
        as_of: datetime,
        params: P.ScreenParams = P.ScreenParams(),
        carry: tuple[str, ...] = (),
    ) -> None:
        """Screen a feed against everything recorded before this run, and record the outcome."""

        def job(scratch: tables.Scratch) -> jobs.Outcome:
            urls = scratch(posts_in.where("url is not null").select("url").distinct(), "urls")
            listed, state = self._listed(batch_id, urls), self.narrow_state(batch_id, urls)
            known = self._lookups(lookups, batch_id)
            return jobs.screen(posts_in, state, listed, extractor, known, as_of, scratch, params, carry)

        self._run("screen", batch_id, as_of, job)

    def judge(
        self,
        batch_id: int,
        new: DataFrame,
        extractor: jobs.Extractor,
        lookups: jobs.Lookups,
        as_of: datetime,
        params: P.ScreenParams = P.ScreenParams(),
        carry: tuple[str, ...] = (),
        told=None,
    ) -> None:
        """Judge a prepared feed of one new post for each URL without a look at the history, and record the outcome."""

        def job(scratch: tables.Scratch) -> jobs.Outcome:
            return jobs.judge(new, extractor, self._lookups(lookups, batch_id), as_of, scratch, params, carry)

        self._run("judge", batch_id, as_of, job, told=told)

    def reprocess(
        self,
        batch_id: int,
        extractor: jobs.Extractor,
        lookups: jobs.Lookups,
        as_of: datetime,
        params: P.ScreenParams = P.ScreenParams(),
        verdicts=P.RETRY_VERDICTS,
        carry: tuple[str, ...] = (),
    ) -> DataFrame:
        """Judge stored rejected and failed posts again, record the outcome and publish what is new."""

        def job(scratch: tables.Scratch) -> jobs.Outcome:
            known = self._lookups(lookups, batch_id)
            return jobs.reprocess(self.state(batch_id), self._listed(batch_id), extractor, known, as_of, scratch, params, verdicts, carry)

        self._run("reprocess", batch_id, as_of, job)
        return self.publish(as_of, params)

    def replay(
        self,
        batch_id: int,
        extractor: jobs.Extractor,
        lookups: jobs.Lookups,
        as_of: datetime,
        params: P.ScreenParams = P.ScreenParams(),
        carry: tuple[str, ...] = (),
    ) -> DataFrame:
        """Run every stored post through the present rules and publish only what passes them.

        The published table gets the name ``before-<batch>`` first, by which it stays readable; no row is copied.  The commit
        of the run's listings also clears it of all that earlier runs found; the state takes the new verdicts.
        """

        def name(entry: dict) -> None:
            entry["named"].setdefault(f"before-{batch_id}", max(entry["views"], key=lambda v: v["up_to"], default=_NO_VIEW))

        self._commit(name)

        def job(scratch: tables.Scratch) -> jobs.Outcome:
            known = self._lookups(lookups, batch_id)
            return jobs.replay(self.state(batch_id), extractor, known, as_of, scratch, params, carry)

        self._run("replay", batch_id, as_of, job, replayed=True)
        return self.publish(as_of, params)

    # ------------------------------------------------------------------------------------------ upkeep
    def last_batch(self) -> int:
        entry = self._now()
        return max([self._base(entry)["up_to"], *map(int, entry["batches"])])

    @staticmethod
    def _same_runs(then: dict, now: dict, up_to: int) -> None:
        if Store._runs(then, up_to + 1) != Store._runs(now, up_to + 1) or then["closed"] != now["closed"]:
            raise Conflict(f"runs up to {up_to} have changed meanwhile")

    def compact(self, up_to: int, as_of: datetime | None = None, params: P.ScreenParams = P.ScreenParams(), keep: int = 2) -> None:
        """Fold the runs up to a batch into a new base; nothing if a base holds them already.

        Only buckets that those runs touched are read and written.  With ``as_of``, payload past its age goes.  Of bases, the
        newest ``keep`` stay, and only runs above the oldest of them; with ``keep=1`` no run up to here can be repeated.
        """
        entry = self._now()
        base = self._base(entry)
        runs = self._runs(entry, up_to + 1, base["up_to"])
        if up_to > base["up_to"] and runs:
            touched = sorted({b for t in runs.values() for b in t["buckets"]})
            folded = self._folded(entry, up_to + 1, touched).select(*_NAMES)
            # The bucket stays a column of its own, so a folder is read like any other.
            folder = self._write(folded.withColumn("part", F.col("bucket")).repartition("part"), "state", up_to, "part")
            rows = self._batches("addresses", schemas.ADDRESS_CACHE, up_to + 1, base["up_to"], entry)
            cache = self._write(history.upsert_cache(self._read([base["cache"]], schemas.ADDRESS_CACHE), rows), "cache", up_to)
            new = {"up_to": up_to, "state": base["state"] | self._parts(folder, "part"), "cache": cache, "usage": self._write(self.usage(up_to + 1), "usage", up_to)}

            def add(now: dict) -> None:
                self._same_runs(entry, now, up_to)
                now["bases"] = sorted([*(b for b in now["bases"] if b["up_to"] < up_to), new], key=lambda b: b["up_to"])

            self._commit(add)
        self._commit(lambda now: self._close(now, keep))
        if as_of is not None:
            self.retain(as_of, params)
        self._merge()

    @staticmethod
    def _close(entry: dict, keep: int) -> None:
        """Drop bases beyond the newest ``keep``, and the runs that can't be repeated any more, but for listings and payload."""
        entry["bases"] = entry["bases"][-keep:]
        if len(entry["bases"]) < keep:
            return
        entry["closed"] = max(entry["closed"], entry["bases"][0]["up_to"])
        for b in sorted(map(int, entry["batches"])):
            if b <= entry["closed"]:
                run = entry["batches"].pop(str(b))
                if run.get("listings"):
                    entry["kept"]["listings"].append([b, run["listings"]])
                for month, path in run["payload"].items():
                    entry["kept"]["payload"].setdefault(month, []).append([b, path])

    def _merge(self) -> None:
        """Make one folder of many small ones of closed runs: of the listings, and of a month's payload its newest rows."""
        entry = self._now()
        kept, merged = entry["kept"], {}
        if len(kept["listings"]) > _PIECES:
            last = max(b for b, _ in kept["listings"])
            merged["listings"] = [[last, self._write(self._read((p for _, p in kept["listings"]), _with_batch(schemas.LISTINGS)), "listings", last)]]
        for month, parts in kept["payload"].items():
            if len(parts) > _PIECES:
                last, rows = max(b for b, _ in parts), self._read((p for _, p in parts), schemas.PAYLOAD)
                newest = rows.groupBy("url").agg(F.max("batch_id").alias("batch_id"))
                merged.setdefault("payload", {})[month] = [[last, self._write(rows.join(history.many(newest), ["url", "batch_id"]).select(*schemas.PAYLOAD.names), "payload", last)]]
        if not merged:
            return

        def change(now: dict) -> None:
            if now["kept"] != kept:
                raise Conflict("closed runs have changed meanwhile")
            now["kept"] = {"listings": merged.get("listings", kept["listings"]), "payload": kept["payload"] | merged.get("payload", {})}

        self._commit(change)

    def retain(self, as_of: datetime, params: P.ScreenParams = P.ScreenParams()) -> None:
        """Hide payload of posts first seen too long ago, and drop the months that hold no other; no data is written."""
        cutoff = as_of - timedelta(days=params.max_age_days)

        def change(entry: dict) -> None:
            entry["cutoff"] = max(entry["cutoff"] or "", cutoff.isoformat())
            month = entry["cutoff"][:7]
            for run in entry["batches"].values():
                run["payload"] = {m: p for m, p in run["payload"].items() if m >= month}
            entry["kept"]["payload"] = {m: p for m, p in entry["kept"]["payload"].items() if m >= month}

        self._commit(change)

    def vacuum(self, keep: int = 10) -> None:
        """Remove log entries but the newest ``keep``, and the folders that none of those names; readers of older ones end."""
        for folder in self.log.forget(keep, lambda e: set(commits.folders(e))):
            path, fs = commits.hadoop_path(self.spark, f"{self.root}/{folder}")
            fs.delete(path, True)

    def publish(self, as_of: datetime, params: P.ScreenParams = P.ScreenParams()) -> DataFrame:
        """Continue the published view with the listings of later runs: deduplicated, without stale rows, newest first."""
        entry = self._now()
        self._publish(entry, self._later(entry), as_of, params)
        return self.published()

    def _publish(self, entry: dict, later: DataFrame, as_of: datetime, params: P.ScreenParams, back: DataFrame | None = None) -> None:
        """Merge rows into the view, after the standing rows of the URLs in ``back`` have been taken out.

        A part that is merged holds every standing row of a key that a later row has, and every standing row of a later row's
        URL, so the merged rows are those of the whole view.  A clock that goes back brings no hidden row back: all is written.
        """
        view, limit = self._view(entry), (as_of - timedelta(days=params.max_age_days)).isoformat()
        up_to = max([-1, *(v["up_to"] for v in entry["views"]), *map(int, entry["batches"]), *(b for b, _ in entry["kept"]["listings"])])
        scratch = tables.Scratch(self.spark, "publish")
        try:
            later = scratch(later.select(*_PUBLISHED.names).withColumn("part", self._part(entry)), "later")
            parts = {r[0] for r in later.select("part").distinct().collect()}
            if {int(p) for p in view["parts"]} - parts:  # a large run falls in all parts by itself
                urls = later.select("url").union(back.select("url")) if back is not None else later.select("url")
                urls = scratch(urls.distinct(), "urls")
                held = self._index(view, self._touched(entry, urls)).join(history.many(urls, urls.count()), "url", "left_semi")
                parts |= {r[0] for r in held.select("part").distinct().collect()}
            if limit < (view["cutoff"] or limit):
                parts |= {int(p) for p in view["parts"]}
            new = view | {"up_to": up_to, "cutoff": limit}
            if parts:
                new |= self._merged(entry, view, new, later, parts, back, scratch)
        finally:
            scratch.drop()

        def change(now: dict) -> None:
            self._same_runs(entry, now, up_to)
            if now["views"] != entry["views"]:
                raise Conflict("the published table has changed meanwhile")
            now["views"] = [*(v for v in now["views"] if v["up_to"] < up_to), new][-2:]

        self._commit(change)

    def _part(self, entry: dict):
        """The part of the view that a row's listing key falls in."""
        key = dedupe.listing_key(F.col("address"), F.col("rooms"), F.col("price"), dedupe.url_key(F.col("url"), _place()))
        return self.bucket(entry, key)

    def _merged(self, entry: dict, view: dict, new: dict, later: DataFrame, parts: set[int], back: DataFrame | None, scratch: tables.Scratch) -> dict:
        """Write the given parts of the view again and the buckets of the index whose URLs have moved; the new names of all."""
        standing = self._standing(view, parts)
        if back is not None:
            standing = standing.join(history.many(back.select("url")), "url", "left_anti")
        rows = standing.unionByName(later.drop("part")).withColumn("ord", _place())
        best = self._young(new, dedupe.deduplicated(rows)).withColumns({n: F.col("pos")[n] for n, _ in _PLACE}).select(*_PUBLISHED.names)
        laid = best.withColumn("part", self._part(entry)).repartition("part")
        laid = laid.sortWithinPartitions("part", F.col("post_date").desc_nulls_last(), *(n for n, _ in _PLACE))
        folder = self._write(laid, "published", new["up_to"], "part")
        written = self._parts(folder, "part")
        if {int(p) for p in view["parts"]} <= parts:  # nothing is carried over, so the index is that of the rows written
            rows = self._read([folder] if written else [], T.StructType([*_PUBLISHED.fields, _INDEX["part"]]))
            return {"parts": written, "urls": self._indexed(entry, rows.select(*_INDEX.names), new)}
        # What the index is told: the rows that these parts hold now and did not before, or the other way round.
        old = self._read((f for p, f in view["parts"].items() if int(p) in parts), _PUBLISHED)
        rows = ((old, -1), (self._read(written.values(), _PUBLISHED), 1))
        was, now = (r.withColumn("part", self._part(entry)).select(*_INDEX.names, F.lit(n).alias("n")) for r, n in rows)
        moves = scratch(was.union(now).groupBy(*_INDEX.names).agg(F.sum("n").alias("n")).where("n <> 0"), "moves")
        come, moved = moves.where("n > 0").select(*_INDEX.names), moves.select("url").distinct()
        buckets = self._touched(entry, moved)
        index = self._index(view, buckets).join(history.many(moved, moves.count()), "url", "left_anti").unionByName(come)
        listed = self._indexed(entry, index, new) if buckets else {}
        return {
            "parts": {p: f for p, f in view["parts"].items() if int(p) not in parts} | written,
            "urls": {b: f for b, f in view["urls"].items() if int(b) not in set(buckets)} | listed,
        }

    def _indexed(self, entry: dict, index: DataFrame, new: dict) -> dict:
        """Write rows of the index by bucket of the URL."""
        laid = index.withColumn("bucket", self.bucket(entry)).repartition("bucket").sortWithinPartitions("bucket")
        return self._parts(self._write(laid, "urls", new["up_to"], "bucket"), "bucket")

    def maintain(self, as_of: datetime, params: P.ScreenParams = P.ScreenParams()) -> DataFrame:
        """Publish without duplicates and stale rows, fold what is recorded and take old payload out, files included."""
        last = self.last_batch()
        if last >= 0:
            self.compact(last, as_of, params, keep=1)
        self.publish(as_of, params)
        self.vacuum(keep=1)
        return self.published()

    def repair(self, lookups: jobs.Lookups, as_of: datetime, params: P.ScreenParams = P.ScreenParams()) -> DataFrame:
        """Mend the addresses of the published table and deduplicate what has changed against the rest; returns the table."""
        self.publish(as_of, params)
        scratch = tables.Scratch(self.spark, "repair")
        try:
            entry = self._now()
            rows = scratch(self._standing(self._view(entry)), "published")
            planned = scratch(addresses.repair_addresses(rows, lookups.geocodes, lookups.routes, params), "planned")
            same = F.col("new_address").eqNullSafe(F.col("address")) & F.col("new_distance_km").eqNullSafe(F.col("distance_km"))
            changed = planned.where((F.col("action") == "dropped") | ~same)
            self._publish(entry, addresses.apply_repair(changed), as_of, params, changed.select("url"))
        finally:
            scratch.drop()
        return self.published()
