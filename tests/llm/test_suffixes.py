from __future__ import annotations

import random

import numpy as np
import pytest

from hearthline.llm import suffixes

from .brute import repeats


def noise(rng, n, letters="abcdefghij "):
    return "".join(rng.choice(letters) for _ in range(n))


def check(spark, texts, length, window):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = suffixes.remove_repeats(df.repartition(3), length, window).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out}
    assert got == dict(enumerate(repeats(texts, length)))


def test_planted_matches_of_all_lengths_and_cuts(spark):
    rng = random.Random(3)
    length, window = 60, 30
    passage = noise(rng, 300)
    texts = [noise(rng, rng.randint(0, 400)) for _ in range(60)]
    for i in range(60):  # pieces of one passage: shorter, just as long, longer, cut on both sides
        n = rng.choice([59, 60, 61, 65, 75, 89, 90, 120, 200])
        a = rng.randint(0, 300 - n)
        at = rng.randint(0, len(texts[i]))
        texts[i] = texts[i][:at] + passage[a : a + n] + texts[i][at:]
    texts += [texts[3]] * 5 + [texts[7][:-1] + "!"] * 3 + [None, "", "x", "é" * 100, "ab" * 200, "a" * 70, " " * 59]
    check(spark, texts, length, window)


def test_many_variants_of_one_passage(spark):
    """Copies with an edit each: starts are decided by different partners on their two sides."""
    rng = random.Random(5)
    base = noise(rng, 260)
    texts = []
    for _ in range(120):
        t = list(base)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(len(t))] = rng.choice("XYZ")
        a, b = sorted(rng.sample(range(len(t)), 2))
        texts.append(noise(rng, 20) + "".join(t[a:b]) + noise(rng, 20))
    check(spark, texts, 60, 30)


def test_few_letters(spark):
    rng = random.Random(8)
    check(spark, [noise(rng, rng.randint(30, 120), "ab") for _ in range(80)] + ["a" * 300, "a" * 299 + "b"], 40, 20)


def test_production_sizes(spark):
    rng = random.Random(9)
    passage = noise(rng, 900)
    texts = [noise(rng, 500) + passage[a : a + n] + noise(rng, 300) for a, n in ((0, 399), (1, 400), (0, 450), (300, 600), (100, 800), (5, 401))]
    check(spark, texts + [noise(rng, 200_000), "é" * 3000], 400, 200)


def test_empty_and_clashing_columns(spark):
    schema = "doc_id long, text string, key string, row int, sha string, n_bytes int, copies int, found int"
    assert suffixes.remove_repeats(spark.createDataFrame([], schema), 60, 30).collect() == []
    df = spark.createDataFrame([(None, "q" * 80, "k", 1, "s", 7, 2, 3), (None, "q" * 80, None, None, None, None, None, None)], schema)
    out = suffixes.remove_repeats(df, 60, 30)
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in out.collect()} == {(None, 80, 80, 1, "")}
    assert {r.sha for r in out.collect()} == {"s", None}


@pytest.mark.parametrize("window", [10, 33, 64])
def test_anchor_of_every_start(window):
    rng = np.random.default_rng(1)
    length = window + 15 + 5
    text = bytes(rng.integers(97, 100, 3000, dtype=np.uint8))
    where, low, high = suffixes.anchors(text, length, window)
    owner = {}
    for a, x, y in zip(where, low, high, strict=True):
        for dist in range(x, y + 1):
            assert 0 <= dist < window
            owner[a - dist] = dist
    assert sorted(owner) == list(range(len(text) - length + 1))
    by_string = {}
    for t, dist in owner.items():
        assert by_string.setdefault(text[t : t + length], dist) == dist


def test_merge_is_a_sort_that_knows_prefixes():
    rng = random.Random(2)
    for _ in range(30):
        runs = [sorted(noise(rng, rng.randint(0, 6), "ab").encode() for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))]
        coded = [(r, suffixes.front_code(r)[0]) for r in runs]
        out = [(coded[r][0][i], c) for r, i, c in suffixes.merge(coded)]
        assert [s for s, _ in out] == sorted(s for r in runs for s in r)
        for (a, _), (b, c) in zip(out, out[1:], strict=False):
            assert c == suffixes.common_prefix(a, b)
        for r in runs:
            shared, rest = suffixes.front_code(r)
            assert suffixes.decode(np.array(shared), np.array([len(x) for x in rest]), b"".join(rest)) == r


def test_planted_passages_go_and_clean_texts_stay(spark):
    """Passages of 400 bytes or more that several texts share are gone from all of them; other texts lose nothing."""
    import random

    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n))
    passages = [p for p in (words(n) for n in range(55, 120, 3)) if len(p) >= 400]
    rows, holds = [], {}
    for i in range(120):
        text = words(rng.randint(10, 200))
        if i % 2:
            holds[i] = passages[i // 2 % len(passages)]
            text = f"{text} {holds[i]} {words(20)}"
        rows.append((i, text))
    out = {r.doc_id: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        if i in holds:
            assert holds[i] not in out[i].kept and len(out[i].kept) < len(text) - 390
        else:
            assert out[i].kept == text and out[i].n_removed == 0
