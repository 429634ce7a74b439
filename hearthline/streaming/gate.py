"""Screening as a stream with its memory in keyed state: what is known of a URL is looked up where its posts arrive.

A gate holds, for each URL, its verdict and failed attempts.  Posts that need work pass it, a run of the store judges them, and
the verdicts come back to the gate as a second stream of files.  So a micro-batch costs what its own posts cost: neither the
stored history nor the published table is read.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from hearthline import params as P
from hearthline import schemas
from hearthline.operators import screening
from hearthline.plans import jobs
from hearthline.plans.store import Store
from hearthline.sources import commits, tables

_BUCKETS = 16_384  # some hundred URLs in each at ten million; a micro-batch rewrites those that its URLs fall in
_KNOWN = "urls string"  # of a bucket, as JSON: verdict, attempts, batch and whether a verdict is awaited, by URL
_VERDICTS = T.StructType(
    [T.StructField("url", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("batch_id", T.LongType())]
)
# Keyed state of several values needs RocksDB.  Timers fire with the batches that bring data: for their sake alone Spark would
# start one empty batch after the other and a run over what is there would never end.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _first_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each Arrow batch the first post of a URL, so that a URL repeated in a third of the feed is thinned before the shuffle."""
    for batch in batches:
        order = pc.sort_indices(batch, sort_keys=[("ord", "ascending")])
        again = batch.column("url").take(order).to_pandas().duplicated().to_numpy()
        yield batch.take(order.filter(pa.array(~again)))


class Gate(StatefulProcessor):
    """Verdict and failed attempts of each URL, kept by bucket of the URL's hash; passes the first post of a URL that is new, or
    that failed and has attempts left.

    While a verdict is awaited the first further post is held, and passes if the verdict is a failure; a held post is payload
    and is forgotten after ``keep``.  Verdicts are applied once each, by the number of their batch, before the posts that arrive
    with them.  A call into the state, and a batch of output, costs as much as some hundred posts, so both are made by bucket.
    """

    def __init__(self, post: T.StructType, max_attempts: int, keep: timedelta):
        self.post, self.max_attempts, self.keep_ms = post, max_attempts, int(keep.total_seconds() * 1000)
        self.url = post.names.index("url")

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", _KNOWN)
        self.held = handle.getListState("held", T.StructType([*self.post.fields, T.StructField("_until", T.LongType())]))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._keep({row["url"]: (row["verdict"], row["attempts"], -1, False) for row in initialState["urls"]})

    def _keep(self, known: dict) -> None:
        self.known.update((json.dumps(known),))

    def _open(self, verdict: str | None, attempts: int) -> bool:
        return verdict == P.PARSE_FAILED and attempts < self.max_attempts

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, verdicts = {}, {}
        for row in rows:
            url, post = row["url"], row["post"]
            if post is None:
                verdicts.setdefault(url, {})[row["batch_id"]] = row["verdict"]
            elif url not in first or _before(post, first[url]):
                first[url] = post
        stored = self.known.get()
        known = json.loads(stored[0]) if stored is not None else {}
        held = {row[self.url]: tuple(row) for row in self.held.get()} if self.held.exists() else {}
        kept, until = dict(held), timerValues.getCurrentProcessingTimeInMs() + self.keep_ms
        for url in dict.fromkeys([*verdicts, *first]):
            found = known.get(url)
            for batch_id, verdict in sorted(verdicts.get(url, {}).items()):
                if found is None or batch_id > found[2]:
                    attempts = (found[1] if found else 0) + (verdict == P.PARSE_FAILED)
                    found = (verdict, attempts, batch_id, False)
            post = held[url][:-1] if url in held else tuple(first[url][name] for name in self.post.names) if url in first else None
            keep = False
            if found is not None and found[3]:
                keep = post is not None
            elif post is not None and (found is None or self._open(found[0], found[1])):
                found = (None, 0, -1, True) if found is None else (*found[:3], True)
                yield Row(**dict(zip(self.post.names, post, strict=True)))
            if found is not None:
                known[url] = found
            if not keep:
                kept.pop(url, None)
            elif url not in held:
                kept[url] = (*post, until)
        self._keep(known)
        self._hold(held, kept)
        if kept.keys() - held.keys():
            self.handle.registerTimer(until)

    def _hold(self, held: dict, kept: dict) -> None:
        if kept and kept != held:
            self.held.put(list(kept.values()))
        elif held and not kept:
            self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = {row[self.url]: tuple(row) for row in self.held.get()} if self.held.exists() else {}
        self._hold(held, {url: row for url, row in held.items() if row[-1] > expiredTimerInfo.getExpiryTimeInMs()})
        return iter(())

    def close(self) -> None:
        pass


def _before(a: dict, b: dict) -> bool:
    """Feed order; a post without a place comes first, as nulls do in a sort."""
    return (a["ord"] is not None, a["ord"] or 0) < (b["ord"] is not None, b["ord"] or 0)


def gated(posts: DataFrame, verdicts: DataFrame, params: P.ScreenParams, known: DataFrame | None = None) -> DataFrame:
    """Of a stream of posts (``url, ord, ...``) those that need work, given the stream of verdicts (``url, verdict, batch_id``).

    ``known`` (url, verdict, attempts), one row a URL, is taken over when the state is empty; a published URL is one with a
    verdict that is final.
    """
    post = posts.schema
    thin = posts.mapInArrow(_first_of_batch, post)
    bucket = F.pmod(F.xxhash64("url"), F.lit(_BUCKETS)).cast("int").alias("bucket")
    arrived = thin.select(bucket, "url", F.struct(*post.names).alias("post"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("long").alias("batch_id"))
    back = verdicts.select(bucket, "url", F.lit(None).cast(post).alias("post"), "verdict", "batch_id")
    gate = Gate(post, params.max_parse_attempts, timedelta(days=params.max_age_days))
    start = None
    if known is not None:
        rows = F.collect_list(F.struct("url", "verdict", "attempts")).alias("urls")
        start = known.groupBy(bucket).agg(rows).groupBy("bucket")
    return arrived.unionByName(back).groupBy("bucket").transformWithState(gate, post, "Append", "ProcessingTime", start)


def gated_stream(
    feed: DataFrame,
    store: Store,
    extractor: jobs.Extractor,
    lookups: jobs.Lookups,
    clock: Callable[[int], datetime],
    params: P.ScreenParams = P.ScreenParams(),
    carry: tuple[str, ...] = (),
    known: DataFrame | None = None,
    **trigger,
) -> StreamingQuery:
    """Start screening a stream of posts through a gate of keyed state.

    Does what ``screen_stream`` does, for a store that this stream alone writes; what the store held before is given as
    ``known``.  A micro-batch that is run again after a failure replaces its own run, and its verdicts count once.  A URL that
    arrives while its verdict is awaited is judged again only if that was a failure.
    """
    spark, back = store.spark, f"{store.root}/_verdicts"
    path, fs = commits.hadoop_path(spark, back)
    fs.mkdirs(path)
    verdicts = spark.readStream.schema(_VERDICTS).option("recursiveFileLookup", "true").parquet(back)

    def one_batch(posts: DataFrame, batch_id: int) -> None:
        scratch = tables.Scratch(spark, f"gate-{batch_id}")
        try:
            # Written first: the gate runs once a micro-batch, whatever the run reads its posts for.
            passed = scratch(posts, "passed")
            if not store.is_closed(batch_id) and not passed.isEmpty():
                store.judge(batch_id, passed, extractor, lookups, clock(batch_id), params, carry, told=tell(batch_id))
        finally:
            scratch.drop()

    def tell(batch_id: int) -> Callable[[DataFrame], None]:
        def write(records: DataFrame) -> None:
            found = records.select("url", "verdict", F.lit(batch_id).cast("long").alias("batch_id"))
            found.write.mode("overwrite").parquet(f"{back}/run-{batch_id}")

        return write

    arrived = screening.prepare_feed(feed, params).select(*dict.fromkeys([*schemas.POSTS_IN.names, *carry]))
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        return (
            gated(arrived, verdicts, params, known)
            .writeStream.outputMode("append")
            .foreachBatch(one_batch)
            .option("checkpointLocation", f"{store.root}/_gate")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
