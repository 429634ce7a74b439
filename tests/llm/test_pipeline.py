"""The pipeline's stages against brute force, each on what the stage before it kept."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline

from .brute import groups, repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "src0", 0), (10_002, "12 34", "en", "src0", 5), (10_003, "", None, None, 0)], docs.schema)
    out = [("documents", docs.unionByName(extra).toPandas())]
    for name, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame(out[-1][1], docs.schema).repartition(3)
        result = stage(spark, now, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert result.columns == docs.columns
        out.append((name, result.toPandas()))
    return out


def test_names_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "best_fit_packing"]
    assert entry.queries()["pipeline"].__wrapped__ is corpus_pipeline.run


def test_language(stages):
    before, after = stages[0][1], stages[1][1]
    lettered = before[before.text.fillna("").map(lambda t: any(c.isalpha() for c in t))]
    assert sorted(after.doc_id) == sorted(lettered.doc_id)
    both = lettered.merge(after, on="doc_id", suffixes=("", "_new")).dropna(subset=["lang"])
    assert (both.lang == both.lang_new).mean() > 0.95 and (both.text == both.text_new).all()


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_duplicates(stages):
    """Sets of five-word shingles with a Jaccard similarity of 0.8 or more link; of each group one row stays."""
    before, after = stages[1][1], stages[2][1]
    sets = [shingles(t) for t in before.text]
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or 5 * len(a & b) >= 4 * len(a | b)]
    best = {}
    for doc_id, root in zip(before.doc_id, groups(len(sets), near), strict=True):
        best[root] = min(best.get(root, doc_id), doc_id)
    assert sorted(after.doc_id) == sorted(best.values())


def test_repeats(stages):
    before, after = stages[2][1], stages[3][1]
    kept = dict(zip(after.doc_id, after.text, strict=True))
    for doc_id, text, (n_bytes, n_removed, _, _) in zip(before.doc_id, before.text, repeats(list(before.text), 400), strict=True):
        if n_removed == 0:
            assert kept[doc_id] == text
        elif doc_id in kept:
            assert n_bytes - n_removed - 6 <= len(kept[doc_id].encode()) <= n_bytes - n_removed
    sizes = dict(zip(before.doc_id, before.n_chars, strict=True))
    whole = dict(zip(before.doc_id, before.text, strict=True))
    for doc_id, text, n in zip(after.doc_id, after.text, after.n_chars, strict=True):
        assert n == (sizes[doc_id] if text == whole[doc_id] else len(text))


def test_mixing(stages):
    before, after = stages[3][1], stages[4][1]
    assert set(after.doc_id) == set(before.doc_id)
    size = before.assign(n=before.text.str.split().map(len)).groupby("source").n.sum()
    read = after.assign(n=after.text.str.split().map(len)).groupby("source").n.sum()
    assert ((read / size) <= 4).all() and read[size.idxmax()] == size.max() and len(after) > len(before)


def test_packing(stages):
    before, after = stages[4][1], stages[5][1]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = Counter()
    for doc_id, text in zip(before.doc_id, before.text, strict=True):
        wanted[doc_id] += len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    assert after.groupby("doc_id").length.sum().to_dict() == dict(wanted)
    assert after.groupby("sequence_id").length.sum().max() <= 1024


def test_run(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 80").write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_odd_rows_and_an_empty_table(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, score int, mix_pass int, first_id int"
    words = "the cat sat on the mat and went home by night with all of its friends"
    rows = [(i, f"{words} number {'abcdefgh'[i % 8]} {i} " * 3, "en", "s", 9, "r", "k", 1, 2, 3) for i in range(30)]
    rows += [(None, "no id but some words here", None, None, None, None, None, None, None, None)] * 2
    rows += [(40, None, None, None, None, None, None, None, None, None), (41, "", "xx", "t", 0, "", "", 0, 0, 0), rows[3]]
    rows += [(42, "long words " * 30_000, "en", None, 1, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).collect() == [], name
        made = out.collect()
        assert made and all(r.row in ("r", None, "") for r in made), name
        docs = spark.createDataFrame(made, docs.schema)
    ids = [r.doc_id for r in docs.collect()]
    assert 40 not in ids and 41 not in ids and 42 not in ids and ids.count(3) <= 4 and None in ids
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(ids)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).collect() == []
