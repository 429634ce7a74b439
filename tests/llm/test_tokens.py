from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hearthline.llm import packing, token_output, tokens

TEXTS = [
    "Hello there, world!", None, "", "naïve café 東京 🙂 1234", "<|endoftext|> and more", " " * 3000 + "x", "word " * 900,
    "a" * 5000, "same", "same", "line\n\n\n  indented\r\n", "Die straße ist lang. " * 300,
]


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (3, "id again", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(3)


def test_ids_are_those_of_tokenizers(exact):
    for text in TEXTS:
        assert tokens.encoder()(text).tolist() == exact(text)[:-1]


@pytest.mark.parametrize("n", [1, 7, 8, 9, 16, 17])
def test_cuts(n):
    pieces = tokens.cuts(n, 8)
    assert sum(size for _, size in pieces) == n and pieces[0][0] == 0
    assert all(size == 8 for _, size in pieces[1:]) and 0 < pieces[0][1] <= 8


def test_pack_round_trip(spark, docs, exact):
    out = packing.pack(docs, capacity=64).collect()
    bins = defaultdict(list)
    per_doc = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
        per_doc[r.doc_id].append(r)
    for places in bins.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= 64
    for i, text in enumerate(TEXTS):
        if i == 3:
            continue
        ids, at = exact(text), 0
        for r in sorted(per_doc[i], key=lambda r: r.piece):
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids) and [r.piece for r in sorted(per_doc[i], key=lambda r: r.piece)] == list(range(len(per_doc[i])))
    assert sum(r.length for r in per_doc[3]) == len(exact(TEXTS[3])) + len(exact("id again")) and per_doc[None]
    total = sum(r.length for r in out)
    assert len(bins) <= -(-total // 64) + 3


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_plan_against_a_plain_packer():
    """Never worse than pairing the large by hand and best-fitting the small, bin by bin."""
    rng = random.Random(4)
    for _ in range(40):
        capacity = 60
        sizes = [rng.choice([rng.randint(1, 60), rng.randint(1, 20), rng.randint(18, 35)]) for _ in range(rng.randint(1, 300))]
        plan, bins = packing.plan_bins(Counter(sizes), capacity)
        content = defaultdict(list)
        for s, ranges in plan.items():
            assert sum(n for _, n, _, _ in ranges) == sizes.count(s)
            for _, n, first, offset in ranges:
                for k in range(n):
                    content[first + k].append((offset, s))
        assert set(content) == set(range(bins))
        for places in content.values():
            at = 0
            for offset, s in sorted(places):
                assert offset == at
                at += s
            assert at <= capacity
        gaps, left = [], sorted(sizes, reverse=True)
        large = [s for s in left if 3 * s > capacity]
        while large:
            s = large.pop(0)
            mate = next((m for m in large if m <= capacity - s), 0)
            if mate:
                large.remove(mate)
            gaps.append(capacity - s - mate)
        for s in (s for s in left if 3 * s <= capacity):
            fit = min((g for g in gaps if g >= s), default=None)
            if fit is None:
                gaps.append(capacity - s)
            else:
                gaps[gaps.index(fit)] = fit - s
        assert bins <= len(gaps)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 16, 17, 1000, 4097])
def test_permutation_and_its_inverse(n):
    slots = token_output.permute(np.arange(n), n, 5)
    assert sorted(slots.tolist()) == list(range(n))
    assert (token_output.permute(slots, n, 5, inverse=True) == np.arange(n)).all()
    if n >= 1000:
        assert (slots != token_output.permute(np.arange(n), n, 6)).any() and abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.1


def test_shards_round_trip(spark, docs, exact):
    parts, manifest, folder = token_output.write_training_order(docs, length=32, per_shard=16)
    read = {r.slot: r for r in token_output.read_slots(spark, folder, manifest, 32).collect()}
    assert sorted(read) == list(range(len(read)))
    assert all(r.offset == (slot % 16) * 64 and r.shard == slot // 16 for slot, r in read.items())
    found = defaultdict(list)
    for p in parts.collect():
        ids = np.frombuffer(read[p.slot].ids, "<u2")[p.start : p.start + p.length]
        found[p.doc_id].append((p.piece, ids.tolist()))
    for i, text in enumerate(TEXTS):
        if i != 3:
            assert [x for _, ids in sorted(found[i]) for x in ids] == exact(text)
    assert len(found[None]) >= 1
    some = token_output.read_slots(spark, folder, manifest, 32, first=10, last=40).collect()
    assert {r.slot: r.ids for r in some} == {s: r.ids for s, r in read.items() if 10 <= s < 40}
    rows = token_output.materialised(docs, length=32, per_shard=16).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    ids, at = exact(TEXTS[7]), 0
    for r in sorted(by_doc[7], key=lambda r: r.piece):
        assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u2").tobytes())
        at += r.length
    assert at == len(ids)


def test_shards_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    parts, manifest, folder = token_output.write_training_order(empty, length=32)
    assert parts.collect() == [] and manifest.collect() == []
    assert token_output.read_slots(spark, folder, manifest, 32).collect() == []
    assert token_output.materialised(empty, length=32).collect() == []
