from __future__ import annotations

import zlib

import numpy as np
import pytest

from hearthline.llm import toxicity

DOCS, LABELS = "doc_id long, text string, toxic string, score int", "doc_id long, quality int, toxic int, text int"
INSULTS, GROUPS = ("scum", "trash", "moron"), ("northerners", "newcomers", "farmers")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def written(seed, many, words=40):
    """Texts that are toxic where an insult meets a group; either alone is harmless."""
    rng = np.random.default_rng(seed)
    plain = [f"w{i}" for i in range(300)]
    texts, label = [], []
    for _ in range(many):
        text = list(rng.choice(plain, words))
        insult, group = rng.random(2) < 0.4
        for there, kinds in ((insult, INSULTS), (group, GROUPS)):
            if there:
                text[rng.integers(words)] = str(rng.choice(kinds))
        texts.append(" ".join(text))
        label.append(int(insult and group))
    return texts, np.array(label)


def features(texts):
    out = []
    for t in texts:
        found = toxicity.Passages([t])
        out.append(np.split(found.term.astype(np.int32), np.searchsorted(found.passage, np.arange(1, len(found.text)))))
    return out


def test_pairs_say_what_weights_alone_cannot():
    texts, label = written(1, 3000)
    other, truth = written(2, 1000)

    def right(**how):
        machine = toxicity.fit(label.astype(float), np.ones(len(label)), features(texts), epochs=12, **how)
        said = machine.scores(toxicity.Passages(other)) >= 0
        return (said == truth).mean(), said[truth == 1].mean()

    both, alone = right(), right(vector_rate=0.0)
    assert both[0] > 0.95 and both[1] > 0.7
    assert alone[1] < 0.4


def test_passages():
    found = toxicity.Passages([" ".join(f"w{i}" for i in range(100)), "", "One, one! TWO", " ".join(["x"] * 65)])
    assert np.bincount(found.text).tolist() == [3, 1, 1, 2]
    assert np.bincount(found.passage, minlength=7).tolist() == [64, 64, 36, 0, 2, 1, 1]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(7)
    plain = [f"w{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(1500):
        text = list(rng.choice(plain, int(rng.integers(20, 150))))
        toxic = i % 6 == 0
        for _ in range(3 * toxic):
            text[rng.integers(len(text))] = str(rng.choice(INSULTS)).upper() + "!"
        docs.append((i, " ".join(text), "x", 1))
        if i % 3 != 1:
            labels.append((i, None, int(toxic), 9))
    long = " ".join(rng.choice(plain, 20_000))
    docs += [(None, "scum trash", None, 0), (5000, None, None, 0), (5001, "", None, 0), (5002, "?! אב", None, 0)]
    docs += [(5003, long + " moron scum trash", None, 0), (5004, long, None, 0), (6, docs[6][1], "x", 1), (7, "repeated id", "x", 1)]
    labels += [(None, 1, 1, 0), (5000, 1, 1, 0), (5001, 1, 0, 0), (8, 1, None, 0), (11, 1, 7, 0), (6, 1, 1, 0), (999_999, 1, 1, 0), *labels[:50]]
    return spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, LABELS).repartition(3)


def test_held_out_texts(spark, tables):
    docs, labels = tables
    out = toxicity.predict_toxicity(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == held(r.doc_id) for r in out)
    fresh = [r for r in out if r.held_out and r.doc_id < 1500 and r.doc_id != 7]
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in fresh]) > 0.97
    by_id = {r.doc_id: r for r in out}
    # A long text is as toxic as its worst passage, and not more for being long.
    assert by_id[5003].predicted == 1 and by_id[5003].worst_word > 19_000 and by_id[5004].predicted == 0
    assert by_id[5000].predicted == by_id[5001].predicted == by_id[5002].predicted == 0
    assert by_id[5000].score == by_id[5001].score


def test_nothing_but_text_decides(spark, tables):
    """Labels of held-out rows and other columns change nothing."""
    from pyspark.sql import functions as F

    docs, labels = tables
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held_out, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.lit(3))
    first = toxicity.predict_toxicity(docs, labels).orderBy("doc_id", "score").collect()
    again = toxicity.predict_toxicity(docs.drop("score").withColumn("lang", F.lit("x")), turned).orderBy("doc_id", "score").collect()
    assert first == again


def test_bounded_sample(spark, tables):
    docs, labels = tables
    out = toxicity.predict_toxicity(docs, labels, sample_docs=400, sample_passages=3000).where("held_out and doc_id < 1500").collect()
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in out if r.doc_id != 7]) > 0.9


def test_nothing_to_learn(spark, tables):
    docs, labels = tables
    assert {(r.score, r.predicted) for r in toxicity.predict_toxicity(docs, labels.where("toxic = 0")).collect()} == {(0.0, 0)}
    assert toxicity.predict_toxicity(docs.limit(0), labels).collect() == []
    assert {r.score for r in toxicity.predict_toxicity(docs, labels.limit(0)).collect()} == {0.0}
