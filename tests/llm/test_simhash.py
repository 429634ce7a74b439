from __future__ import annotations

import random
from itertools import combinations

from hearthline.llm import simhash
from hearthline.llm.common import Work, components

from .brute import groups
from .brute import simhash as plain


def test_triples_meet_every_four_positions():
    triples = simhash.triples()
    assert len(triples) == 20
    for four in combinations(range(8), 4):
        assert any(set(t) <= set(four) for t in triples)


def test_fingerprint():
    for text in (None, "", " \t\n", "One", "one two", "A b C d", "Ä ä B\x0bc\x1cd e f g", "x y " * 500, "a" * 3000, "é " * 20):
        assert simhash.fingerprint(None if text is None else text.encode()) == plain(text), text


def links_of(prints, bits=4):
    return [(i, j) for i, j in combinations(range(len(prints)), 2) if bin(prints[i] ^ prints[j]).count("1") <= bits]


def test_links_on_all_distances_and_long_lists(spark):
    rng = random.Random(1)
    prints = {0, 2**64 - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            prints.add(x)
    low = rng.getrandbits(64) >> 40 << 40
    prints |= {low | rng.getrandbits(12) for _ in range(300)}  # one posting list that fills several tiles
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    work = Work(spark, "test")
    edges = simhash.near_links(df, work, tile=32).collect()
    place = {p: i for i, p in enumerate(signed)}
    found = [(place[e.a], place[e.b]) for e in edges]
    assert groups(len(prints), found) == groups(len(prints), links_of(prints))


def test_documents(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 30, 300]))) for _ in range(25)]
    texts = [None, "", "  "]
    for t in base:
        texts.append(t)
        for _ in range(rng.randint(0, 4)):
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(rng.choice(["", "\n"]) + " ".join(w).upper())
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 2), (None, texts[6], 3), (None, "alone " * 9, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(4)
    out = simhash.near_duplicates(df).collect()
    prints = [plain(t) for _, t, _ in rows]
    low = groups(len(rows), links_of(prints))
    ids = {}
    for i, root in enumerate(low):
        if rows[i][0] is not None:
            ids[root] = min(ids.get(root, rows[i][0]), rows[i][0])
    wanted = sorted((str(r[0]), f"{p:016x}", str(ids.get(root))) for r, p, root in zip(rows, prints, low, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in out) == wanted


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    nodes = list(range(400))
    rng.shuffle(nodes)
    edges = [(nodes[i], nodes[i + 1]) for i in range(150)] + [(nodes[200], n) for n in nodes[201:320]] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    out = {r.node: r.root for r in components(df, Work(spark, "test")).collect()}
    low = groups(400, edges)
    assert out == {n: low[n] for e in edges if e[0] != e[1] for n in e}
