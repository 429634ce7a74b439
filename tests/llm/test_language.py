from __future__ import annotations

import random
from itertools import product

import numpy as np
import pytest

from hearthline.llm import langid

EN = "the cat sat on a mat and then it went with her through that house where they were sleeping".split()
DE = "die katze saß auf der matte und ging dann mit ihr durch das haus wo sie schliefen nicht ich auch".split()
RU = "кошка сидела на ковре и потом пошла с ней через дом где они спали".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        lang, words = rng.choice([("en", EN), ("de", DE), ("ru", RU)])
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) + ".", lang))
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 !? 45", None), (None, "the house and the cat", None), (1003, "the cat", None)]
    rows += [(1004, "the cat " * 40_000, None), (1003, "the cat", None)]
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, lang string, score int, key string").repartition(3)


def test_held_out_accuracy_and_odd_rows(spark, docs):
    import zlib

    out = langid.predict_languages(docs).join(docs.selectExpr("doc_id as d", "lang").distinct(), langid.F.col("doc_id").eqNullSafe(langid.F.col("d")), "left").collect()
    assert len(out) == 307
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score, r.spans) == ("und", 0.0, [])
    held = [r for r in out if r.held_out and r.lang and r.lang_pred != "und"]
    assert len(held) > 30 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert {r.lang_pred for r in out if r.doc_id in (None, 1003, 1004)} == {"en"}


def test_spans_of_mixed_text(spark, docs):
    model = langid.learn_documents(docs)
    text = "the cat sat on a mat and it went " + "die katze saß auf der matte und ging " + "кошка сидела на ковре"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = langid.identify(df, model, ["doc_id"]).first()
    assert [s.lang for s in row.spans] == ["en", "de", "ru"]
    assert text[row.spans[1].start : row.spans[1].end].startswith("die katze") and row.spans[2].end == len(text)


def test_labels_of_held_out_rows_teach_nothing(spark, docs):
    a = langid.learn_documents(docs)
    lied = docs.withColumn("lang", langid.F.when(langid.held_out(langid.F.col("doc_id")), "xx").otherwise(langid.F.col("lang")))
    b = langid.learn_documents(lied)
    assert a.langs == b.langs and np.allclose(a.table, b.table)


def test_nothing_to_learn_and_empty(spark):
    schema = "doc_id long, text string, lang string"
    assert langid.predict_languages(spark.createDataFrame([], schema)).collect() == []
    row = langid.predict_languages(spark.createDataFrame([(1, "some words", None)], schema)).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)

    def value(scores, path, penalty):
        changes = sum(a != b for a, b in zip(path, path[1:], strict=False))
        return sum(scores[t, k] for t, k in enumerate(path)) - penalty * changes

    def plain(scores, penalty):
        best = scores[0].astype(float)
        for row in scores[1:]:
            best = np.maximum(best, best.max() - penalty) + row
        return best.max()

    for penalty in (0.0, 1.5, 4.0):
        counts = np.array([1, 5, 64, 65, 3, 128, 200, 1000, 2])
        scores = rng.normal(size=(counts.sum(), 3)).astype(np.float32)
        path = langid.viterbi(scores, counts, penalty)
        for a, n in zip(np.cumsum(counts) - counts, counts, strict=True):
            assert abs(value(scores[a : a + n], path[a : a + n].tolist(), penalty) - plain(scores[a : a + n], penalty)) < 1e-2
            if n <= 5:
                every = max(value(scores[a : a + n], p, penalty) for p in product(range(3), repeat=int(n)))
                assert abs(every - plain(scores[a : a + n], penalty)) < 1e-4


def test_words_and_their_grams():
    texts = ["Ab, c1d", "", "é!", "  xyz"]
    words = langid.Words(texts)
    found = [(int(t), texts[t][a:b]) for t, a, b in zip(words.text, words.start, words.stop, strict=True)]
    assert found == [(0, "Ab"), (0, "c"), (0, "d"), (2, "é"), (3, "xyz")]
    counts = np.zeros(5, int)
    for bucket, word in words.grams(1000):
        counts += np.bincount(word, minlength=5)
    assert counts.tolist() == [4 * len(t) for _, t in found]
    again = langid.Words(["xyz", "ab", "AB"])
    first = [sorted(b[w == 4].tolist()) for b, w in words.grams(1000)]
    assert first == [sorted(b[w == 0].tolist()) for b, w in again.grams(1000)]
    one, two = ([sorted(b[w == k].tolist()) for b, w in again.grams(1000)] for k in (1, 2))
    assert one == two
    assert len(langid.Words(["12 !", ""]).size) == 0


def test_scripts():
    names = langid.Words(["ab дом 東京 한국 שלום"])
    assert [names.script_names[i] for i in dict.fromkeys(names.scripts.tolist())] == ["latin", "cyrillic", "han", "hangul", "hebrew"]


def test_rare_languages_stay_in_the_sample(spark):
    rows = [("common", f"ordinary words number {i}", i) for i in range(3000)]
    rows += [(f"rare{k}", f"seldom heard {k} {i}", 10_000 + 10 * k + i) for k in range(20) for i in range(4)]
    model = langid.learn(spark.createDataFrame(rows, "lang string, text string, key long"), sample_docs=100)
    assert model.langs == sorted({r[0] for r in rows})


def test_paths_by_steps_are_those_by_strides():
    rng = np.random.default_rng(3)
    words = np.array([1, 64, 65, 300, 2, 1])
    scores = -rng.exponential(2.0, (words.sum(), 5)).astype(np.float32)
    assert (langid._by_steps(scores, words, 3.0) == langid.viterbi(scores, words, 3.0)).all()


def test_many_languages_in_bounded_memory(spark):
    """200 languages of invented words: most texts are told, and the worker stays under a gigabyte."""
    import resource

    rng = random.Random(4)
    kinds = {f"l{i:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(12)] for i in range(200)}
    texts = [(k, " ".join(rng.choice(w) for _ in range(40))) for k, w in kinds.items() for _ in range(6)]
    table = np.full((1 << 14, 200), 0.1)
    for j, (k, w) in enumerate(kinds.items()):
        found = langid.Words([" ".join(w)])
        for bucket, _ in found.grams(1 << 14):
            np.add.at(table[:, j], bucket, 1)
    letters = np.ones((len(langid._characters()[2]), 200), bool)
    model = langid.Model(list(kinds), np.log(table / table.sum(axis=0)).astype(np.float32), letters)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = langid._labelled([t for _, t in texts] + [" ".join(t for _, t in texts) * 3], model, 6.0).field("lang_pred").to_pylist()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000
    assert np.mean([a == b for a, (b, _) in zip(out, texts)]) > 0.95


def test_a_script_that_no_language_uses_says_nothing(spark, docs):
    model = langid.learn_documents(docs)
    rows = spark.createDataFrame([(1, "ελλάδα μόνο"), (2, "the cat ελλάδα")], "doc_id long, text string")
    alone, mixed = langid.identify(rows, model, ["doc_id"]).orderBy("doc_id").collect()
    assert alone.lang_pred == "de" and abs(alone.score - 1 / 3) < 1e-9
    assert mixed.lang_pred == "en" and abs(mixed.score - (6 + 6 / 3) / 12) < 1e-9
