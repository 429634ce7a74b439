from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hearthline.llm import periodic

from .brute import planted_words, word_runs

SCHEMA = "doc_id long, text string, runs int, n_words string, key int"


def expected(text, least_words=6, least_roots=4):
    words = (text or "").encode().split()
    runs = word_runs(words, least_words, least_roots)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    return runs, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4))
def test_runs_of_several_texts_at_once(texts):
    words = np.array([w for t in texts for w in t], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    begin = np.cumsum([0, *(len(t) for t in texts)])
    for least in ((6, 4), (2, 2)):
        want = [(s + begin[k], e + begin[k], q) for k, t in enumerate(texts) for s, e, q in word_runs(t, *least)]
        assert [tuple(r) for r in periodic.runs(words, owner, *least).tolist()] == want


def texts():
    rng = random.Random(3)
    out = [None, "", "  \t\n ", "one", "x " * 5, "x " * 6, "x x " * 7, "A a A a A a A a", "ab\x0bab\x0cab ab ab ab"]
    for n in (50, 400, 3000, 20_000):
        words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)]
        at = rng.randrange(n // 2)
        for i in range(at, at + n // 3):
            words[i] = words[at + (i - at) % 7]
        out.append(" ".join(words))
    out.append(" ".join(["tick", "tock", "tick", "tock"] * 2500))  # nested: one run of 10,000 words
    return out + out[-3:-1]


def test_collapsed_texts_of_odd_rows(spark):
    rows = [(None if i == 3 else i % 12, t, 1, "x", None) for i, t in enumerate(texts())]
    out = periodic.collapse_runs(spark.createDataFrame(rows, SCHEMA).repartition(3), ["doc_id"]).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, [(x.start, x.start + x.length, x.period) for x in r.runs], r.collapsed) for r in out)
    want = sorted((i is None, i or 0, len((t or "").encode().split()), *expected(t)) for i, t, *_ in rows)
    assert got == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert periodic.run_digests(periodic.collapse_runs(periodic.planted(empty), ["doc_id"])).collect() == []


def test_planted_digests(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "a", "of", "x" * rng.randint(1, 9)]) for _ in range(rng.randint(0, 300))), 1, "x", 2) for i in range(400)]
    rows += [(None, "a a a a a a a", 1, "x", 2), (7, None, 1, "x", 2), *rows[:20]]
    out = periodic.run_digests(periodic.collapse_runs(periodic.planted(spark.createDataFrame(rows, SCHEMA)), ["doc_id"])).collect()
    want = []
    for i, text, *_ in rows:
        words = planted_words(i, (text or "").encode().split())
        runs, kept = expected(b" ".join(words).decode())
        top = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
        best = (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2]) if top else (None,) * 4
        want.append((i, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    assert sum(i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows) > 20
