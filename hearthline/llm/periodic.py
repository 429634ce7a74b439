"""Runs of periodic words, from the suffix array of every text.

A run is a stretch of words with smallest period q that no neighbour extends.  Its last square (two equal roots of q words,
after which the period breaks) is a branching one: the suffixes at its two halves share exactly q words, so they lie in
different children of one LCP interval of depth q.  So for every LCP interval the suffixes of all children but its largest
are looked up: whether the suffix ``depth`` words on, or back, has its place (inverse suffix array) in the same interval but in
another child.  Each square found is rotated to the left as far as the period holds, in steps of powers of two, which gives
its run; squares of one run, and roots that are repeats of a shorter one, merge in it.  Intervals are bounds in the LCP array,
found by pointer jumping; no tree is built.

All texts of a block are one array whose suffixes are compared within their own text only.  Memory is, for a block of
500,000 characters or one longer text, four bytes for each word and each doubling up to the longest repeat in a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import _parts


class Suffixes:
    """Suffix array of several word sequences at once, and the ranks of all stretches of 1, 2, 4, ... words.

    ``words``: numbers of the words, sequence after sequence; ``owner``: the sequence of each.  Equal ranks at a level mean
    equal stretches of one sequence.
    """

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        n = len(words)
        self.n, self.owner = n, owner
        stop = np.searchsorted(owner, owner, "right") if n else np.zeros(0, np.int64)
        key = owner * (int(words.max(initial=0)) + 1) + words
        self.order = np.argsort(key, kind="stable")
        rank = self._ranked(key[self.order], self.order)
        self.levels = [rank]
        width = 1
        while True:
            # Only what is not yet alone in its rank is sorted again.  A rank is the first place of its group.
            size = np.bincount(rank, minlength=n)
            open_places = np.flatnonzero(size[rank[self.order]] > 1)
            if not len(open_places):
                break
            at = self.order[open_places]
            ahead = at + width
            inside = ahead < stop[at]
            follow = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
            group = rank[at]
            sorted_ = np.lexsort((follow, group))
            at, group, follow = at[sorted_], group[sorted_], follow[sorted_]
            self.order[open_places] = at
            new = np.ones(len(at), bool)
            new[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
            rank = rank.copy()
            rank[at] = open_places[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            self.levels.append(rank)
            width *= 2
        self.place = rank  # all different: the inverse suffix array

    @staticmethod
    def _ranked(sorted_keys: np.ndarray, order: np.ndarray) -> np.ndarray:
        new = np.ones(len(order), bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        return rank

    def common(self) -> np.ndarray:
        """Words that each suffix of the array shares with the one before it; 0 for the first of a sequence."""
        length = np.zeros(self.n, np.int64)
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        for k in range(len(self.levels) - 1, -1, -1):
            inside = (a < self.n) & (b < self.n)
            same = np.zeros(len(a), bool)
            same[inside] = self.levels[k][a[inside]] == self.levels[k][b[inside]]
            a[same] += 1 << k
            b[same] += 1 << k
            length[1:][same] += 1 << k
        return length

    def reach_back(self, start: np.ndarray, period: np.ndarray) -> np.ndarray:
        """How far left of ``start`` words keep equalling those ``period`` on, in the same sequence."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            to = at - (1 << k)
            fits = to >= 0
            fits[fits] = self.levels[k][to[fits]] == self.levels[k][to[fits] + period[fits]]
            at[fits] = to[fits]
        return at


def _nearest_lower(value: np.ndarray, or_equal: bool) -> np.ndarray:
    """Place before each positive value with a lower (or equal) one; -1 where there is none.

    Small values, which most are, are done a value at a time; the others by pointer jumping.
    """
    jump = np.arange(len(value)) - 1
    for small in range(1, 7):
        own = np.flatnonzero(value == small)
        last = np.maximum.accumulate(np.where(value <= small if or_equal else value < small, np.arange(len(value)), -1))
        jump[own] = np.where(own > 0, last[own - 1], -1)
    todo = np.flatnonzero(value > 6)
    while len(todo):
        at = jump[todo]
        higher = at >= 0
        seen = value[at[higher]]
        own = value[todo[higher]]
        higher[higher] = seen > own if or_equal else seen >= own
        todo = todo[higher]
        jump[todo] = jump[jump[todo]]
    return jump


def branching_squares(found: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """``start`` and ``period`` of every square after which its period breaks."""
    shared = found.common()
    bounds = np.flatnonzero(shared > 0)  # between two children of the interval of that depth
    none = np.zeros(0, np.int64)
    if not len(bounds):
        return none, none
    ahead = np.append(shared, 0)[::-1]
    back = lambda or_equal: len(shared) - _nearest_lower(ahead, or_equal)[::-1][:-1]
    low, high = _nearest_lower(shared, False)[bounds], back(False)[bounds]  # the interval is [low, high)
    # Its children, as [from, to): one before every bound, and one behind the last.
    left, right = np.maximum(_nearest_lower(shared, True)[bounds], 0), back(True)[bounds]
    last = right == high
    child = np.concatenate([left, bounds[last]])
    end = np.concatenate([bounds, right[last]])
    depth = np.concatenate([shared[bounds], shared[bounds][last]])
    low, high = np.concatenate([low, low[last]]), np.concatenate([high, high[last]])
    # All but the largest child of each interval.
    order = np.lexsort((child - end, low, depth))
    first = np.ones(len(order), bool)
    first[1:] = (low[order][1:] != low[order][:-1]) | (depth[order][1:] != depth[order][:-1])
    small = order[~first]
    size = (end - child)[small]
    of = np.repeat(small, size)
    leaf = found.order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(child[small], size)]
    starts, periods = [none], [none]
    for sign in (1, -1):
        other = leaf + sign * depth[of]
        there = (other >= 0) & (other < found.n)
        place = np.where(there, found.place[np.where(there, other, 0)], -1)
        hit = (place >= low[of]) & (place < high[of]) & ((place < child[of]) | (place >= end[of]))
        starts.append(np.minimum(leaf, other)[hit])
        periods.append(depth[of][hit])
    return np.concatenate(starts), np.concatenate(periods)


def runs(words: np.ndarray, owner: np.ndarray, least_words: int = 6, least_roots: int = 4) -> np.ndarray:
    """``start, stop, period`` of the runs of ``max(least_words, least_roots * period)`` words or more, in that order."""
    found = Suffixes(words, owner)
    start, period = branching_squares(found)
    stop = start + 2 * period
    start = found.reach_back(start, period)
    keep = stop - start >= np.maximum(least_words, least_roots * period)
    out = np.stack([start, stop, period], axis=1)[keep]
    out = out[np.lexsort(out.T[::-1])]
    # A root that repeats a shorter one gives the same stretch: the shortest is the smallest period.
    first = np.ones(len(out), bool)
    first[1:] = (out[1:, :2] != out[:-1, :2]).any(axis=1)
    out = out[first]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text, the number of each word, and the text of each."""
    numbers: dict[bytes, int] = {}
    words = [t.split() for t in texts]  # of bytes: at runs of blanks and the five controls from tab to carriage return
    flat = np.array([numbers.setdefault(w, len(numbers)) for ws in words for w in ws], np.int64)
    return words, flat, np.repeat(np.arange(len(words)), [len(ws) for ws in words])


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _found(least_words: int, least_roots: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            every: list[list[dict]] = [[] for _ in texts]
            kept: list[bytes] = [b""] * len(texts)
            count = np.zeros(len(texts), np.int64)
            for part in _parts(texts):  # by bytes here
                words, numbers, owner = _numbered([texts[i] for i in part])
                first = np.searchsorted(owner, np.arange(len(part)))
                gone = np.zeros(len(numbers) + 1, np.int64)
                for a, b, q in runs(numbers, owner, least_words, least_roots).tolist():
                    k = int(owner[a])
                    every[part[k]].append({"start": a - int(first[k]), "length": b - a, "period": q})
                    gone[a + q] += 1
                    gone[b] -= 1
                stays = np.cumsum(gone[:-1]) == 0
                for k, i in enumerate(part):
                    count[i] = len(words[k])
                    own = stays[first[k] : first[k] + len(words[k])]
                    kept[i] = b" ".join(words[k] if own.all() else [w for w, s in zip(words[k], own.tolist(), strict=True) if s])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count), pa.array(every, _RUNS), pa.array(kept, pa.binary())], ["key", "n_words", "runs", "collapsed"]
            )

    return run


def collapse_runs(docs: DataFrame, carry: list[str], text_col: str = "text", least_words: int = 6, least_roots: int = 4) -> DataFrame:
    """``carry`` columns with ``n_words``, ``runs`` and ``collapsed`` for every row.

    Words are stretches without blanks and the controls from tab to carriage return; ``runs`` (start, length, period; in words
    from 0) holds the runs of ``least_words`` words and ``least_roots`` periods at least, by start, then period; ``collapsed`` is
    the words that no run repeats, joined by one blank: of a run, what follows its first period goes.  A null or empty text has
    no words.  Every row stands for itself, repeated or not; other columns play no part; an empty table gives no row.
    """
    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    rows = docs.select(F.struct(*carry).alias("key"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = rows.mapInArrow(
        _found(least_words, least_roots),
        f"key struct<{kinds}>, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary",
    )
    return found.select("key.*", "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with the tail of every tenth document, by the hash of its id, made periodic.

    With h the id's crc32 and g a tenth of it, word i from a = g % n on becomes word a + (i - a) % p, where p is a (3 + g % 8)th
    of what follows a, and one.  Documents without an id or a word stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), h.alias("h"))
    chosen = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    words = F.when(chosen, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    turned = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    made = F.when(F.col("n") > 0, F.array_join(turned, " "))
    return rows.select("doc_id", F.coalesce(made, F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns from ``doc_id, runs, collapsed``: the longest run of each document and digests of all."""
    longest = F.reduce(
        "runs",
        F.lit(None).cast("struct<start: long, length: long, period: long>"),
        lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best),  # runs are in order: the first of a length wins
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = docs.withColumn("top", longest)
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
