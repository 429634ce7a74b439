"""Toxicity by a factorization machine over hashed terms.

A text is read in passages of 64 words, each half overlapping the next.  A passage's score is a bias, a weight for each of its
different terms and, for every pair of them, the product of their learnt vectors: a word that is harmless alone and another
one can be toxic together, which weights that only add up can't say.  A text is as toxic as its worst passage.

Spark picks the labelled rows, turns them to passages and scores every text; the machine itself is fitted by AdaGrad on the
driver from a sample whose size is bounded by two parameters.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work
from .langid import _parts, held_out

_TERM = re.compile(r"[^\W_]+")
_BUCKETS, _HALF, _RANK, _SEED = 1 << 18, 32, 8, 11


class Passages:
    """Different terms of every passage of several texts: ``passage`` and ``term`` of each, and ``text`` of each passage."""

    def __init__(self, texts: list[str]):
        cache: dict[str, int] = {}
        terms, sizes = [], []
        for text in texts:
            words = _TERM.findall(text.casefold())
            for w in words:
                if w not in cache:
                    cache[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % _BUCKETS
            terms.extend([cache[w] for w in words])
            sizes.append(len(words))
        term, size = np.array(terms, np.int64), np.array(sizes, np.int64)
        count = np.maximum(1, -(-size // _HALF) - 1)
        first = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(texts)), size)
        half = (np.arange(len(term)) - np.repeat(np.cumsum(size) - size, size)) // _HALF
        # A word is in the passage its half begins and in the one before.
        later, before = half < count[owner], half > 0
        passage = np.concatenate([(first[owner] + half)[later], (first[owner] + half - 1)[before]])
        both = np.unique(passage * _BUCKETS + np.concatenate([term[later], term[before]]))
        self.passage, self.term = both // _BUCKETS, both % _BUCKETS
        self.text = np.repeat(np.arange(len(texts)), count)


@dataclass(frozen=True)
class Machine:
    """``place`` of a bucket among the learnt terms, or -1; their weights and vectors; the bias."""

    bias: float
    place: np.ndarray
    weight: np.ndarray
    vector: np.ndarray

    def scores(self, passages: Passages) -> np.ndarray:
        """Score (log odds) of every passage."""
        at = self.place[passages.term]
        known = at >= 0
        return self.bias + _interactions(passages.passage[known], at[known], self.weight, self.vector, len(passages.text))


def _interactions(passage: np.ndarray, term: np.ndarray, weight: np.ndarray, vector: np.ndarray, many: int) -> np.ndarray:
    """Weights, and products of all pairs by the usual identity: half the square of the sum less the sum of the squares."""
    out = np.bincount(passage, (weight - 0.5 * (vector**2).sum(axis=1))[term], many).astype(np.float64)  # whole numbers where empty
    for f in range(vector.shape[1]):
        out += 0.5 * np.bincount(passage, vector[:, f][term], many) ** 2
    return out


# ------------------------------------------------------------------------------------------------ learning
def fit(
    label: np.ndarray,
    importance: np.ndarray,
    terms: list[list[np.ndarray]],
    rank: int = _RANK,
    epochs: int = 8,
    rate: float = 0.02,
    vector_rate: float = 0.1,
    decay: float = 0.01,
    min_texts: int = 5,
    shrink: float = 20.0,
) -> Machine | None:
    """A machine from texts given as the terms of their passages; None unless both labels are there.

    Terms that fewer than ``min_texts`` of the texts hold keep no parameters, and so say nothing.  Weights start at what a term
    alone does to the odds, drawn to nothing by ``shrink`` texts; vectors start small.  Each step takes 128 texts and moves the
    parameters of every text's worst passage; ``importance`` weighs texts.  Every eighth text is left out of the steps: the
    epoch after which those are judged best (log loss) counts.
    """
    if not len(label) or label.min() == label.max():
        return None
    rng = np.random.default_rng(_SEED)
    importance = importance / importance.mean()
    judge = np.arange(len(label)) % 8 == 7
    seen, toxic, weighed = np.zeros(_BUCKETS, np.int64), np.zeros(_BUCKETS), np.zeros(_BUCKETS)
    for k in np.flatnonzero(~judge):
        own = np.unique(np.concatenate(terms[k]))
        seen[own] += 1
        toxic[own] += label[k] * importance[k]
        weighed[own] += importance[k]
    learnt = np.flatnonzero(seen >= min_texts)
    place = np.full(_BUCKETS, -1, np.int32)
    place[learnt] = np.arange(len(learnt))
    # All passages in one array: where each begins, and the passages of each text.
    flat = [place[p] for passages in terms for p in passages]
    flat = [p[p >= 0] for p in flat]
    size = np.array([len(p) for p in flat], np.int64)
    term = np.concatenate(flat)
    stop = np.cumsum(size)
    count = np.array([len(p) for p in terms], np.int64)
    last = np.cumsum(count)
    odds = (importance * label).sum() / importance.sum()
    bias = float(np.log(odds / (1 - odds)))
    alone = ((toxic + shrink * odds) / (weighed + shrink))[learnt]
    weight, vector = np.log(alone / (1 - alone)) - bias, rng.normal(0, 0.02, (len(learnt), rank))

    def inside(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the chosen passages, and which of them each is in."""
        begin = np.cumsum(size[chosen]) - size[chosen]
        row = np.repeat(np.arange(len(chosen)), size[chosen])
        return term[np.arange(len(row)) - begin[row] + (stop - size)[chosen][row]], row

    def worst(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each text's worst passage, and which that is."""
        own = np.arange(count[texts].sum()) + np.repeat(last[texts] - np.cumsum(count[texts]), count[texts])
        t, row = inside(own)
        score = _interactions(row, t, weight, vector, len(own))
        begin = np.cumsum(count[texts]) - count[texts]
        top = np.maximum.reduceat(score, begin)
        return top, own[np.minimum.reduceat(np.where(score == np.repeat(top, count[texts]), np.arange(len(own)), len(own)), begin)]

    def loss(texts: np.ndarray) -> float:
        score = np.clip(np.concatenate([worst(part)[0] for part in np.array_split(texts, -(-len(texts) // 512))]) + bias, -30, 30)
        return float((importance[texts] * np.logaddexp(0, np.where(label[texts] == 1, -score, score))).sum())

    past_w, past_v, past_b = np.ones(len(learnt)), np.ones((len(learnt), rank)), 1.0
    least, best = np.inf, None
    for _ in range(epochs):
        order = rng.permutation(np.flatnonzero(~judge))
        for texts in np.array_split(order, -(-len(order) // 128)):
            top, chosen = worst(texts)
            slope = importance[texts] * (1 / (1 + np.exp(-np.clip(bias + top, -30, 30))) - label[texts])
            t, row = inside(chosen)
            total = np.stack([np.bincount(row, vector[t, f], len(chosen)) for f in range(rank)], axis=1)
            which, back = np.unique(t, return_inverse=True)
            move_w = np.bincount(back, slope[row], len(which)) + decay * len(texts) * weight[which]
            pull = slope[row][:, None] * (total[row] - vector[t])
            move_v = np.stack([np.bincount(back, pull[:, f], len(which)) for f in range(rank)], axis=1) + decay * len(texts) * vector[which]
            past_w[which] += move_w**2
            past_v[which] += move_v**2
            past_b += slope.sum() ** 2
            weight[which] -= rate * move_w / np.sqrt(past_w[which])
            vector[which] -= vector_rate * move_v / np.sqrt(past_v[which])
            bias -= rate * slope.sum() / np.sqrt(past_b)
        now = loss(np.flatnonzero(judge)) if judge.any() else 0.0
        if now <= least:
            least, best = now, Machine(float(bias), place, weight.astype(np.float32), vector.astype(np.float32))
    return best


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of every passage of the labelled texts."""
    kind = pa.list_(pa.list_(pa.int32()))
    for batch in batches:
        texts = batch.column(1).to_pylist()
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int32)] for _ in texts]
        for part in _parts(texts):
            found = Passages([texts[i] for i in part])
            cut = np.searchsorted(found.passage, np.arange(1, len(found.text)))
            rows = np.split(found.term.astype(np.int32), cut)
            for k, i in enumerate(part):
                lo, hi = np.searchsorted(found.text, [k, k + 1])
                out[i] = rows[lo:hi]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(o) for o in out], pa.int64()), pa.array([[p.tolist() for p in o] for o in out], kind)], ["label", "n", "terms"]
        )


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_docs: int = 20_000,
    sample_passages: int = 400_000,
) -> Machine | None:
    """A machine from the labelled documents that are not held out.

    At most about ``sample_docs`` different ids are learnt from, half of each label where there are as many, and of them at
    most about ``sample_passages`` passages; each label then weighs what it weighs among all labelled rows.  Texts that alone
    have over a hundredth of those passages, null ids, labels other than 0 and 1 and null texts teach nothing; a repeated text
    teaches once a label.
    """
    work = Work(docs.sparkSession, "toxicity")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id"))).distinct()
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    least = min(sizes.values())
    take = {k: min(n, max(sample_docs // 2, sample_docs - least)) for k, n in sizes.items()}
    share = F.when(F.col("label") == 1, F.lit(int(take[1] / sizes[1] * (1 << 30)))).otherwise(F.lit(int(take[0] / sizes[0] * (1 << 30))))
    picked = work.put(known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share), "picked")
    # The picked ids number about `sample_docs`, whatever the size of the tables.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = rows.join(F.broadcast(picked), "id").select("label", "text")
    rows = rows.dropDuplicates(["label", "text"])
    found = work.put(rows.mapInArrow(_featured, "label int, n long, terms array<array<int>>"), "terms")
    total = found.where(F.col("n") <= sample_passages // 100).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    part = min(1.0, sample_passages / max(total[0], 1), 2 * sample_docs / max(total[1], 1))
    kept = found.where(F.col("n") <= sample_passages // 100)
    if part < 1:
        kept = kept.where(F.pmod(F.xxhash64("terms"), F.lit(1 << 30)) < int(part * (1 << 30)))
    # In one order whatever the partitions, so that a repeated run learns the same.
    table = kept.orderBy("label", "n", F.xxhash64("terms")).select("label", "terms").toArrow()
    if not len(table):
        return None
    label = table.column("label").to_numpy().astype(np.float64)
    there = np.array([max((label == 0).sum(), 1), max((label == 1).sum(), 1)])
    importance = np.where(label == 1, sizes[1] / there[1], sizes[0] / there[0])
    passages = []
    for chunk in table.column("terms").chunks:
        outer, inner = chunk.offsets.to_numpy(), chunk.values.offsets.to_numpy()
        values = chunk.values.values.to_numpy()
        for a, b in zip(outer[:-1], outer[1:], strict=True):
            passages.append([values[inner[i] : inner[i + 1]] for i in range(a, b)])
    work.free(picked, found)
    return fit(label, importance, passages)


# ------------------------------------------------------------------------------------------------ scoring
def _scorer(machine: Machine | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            odds = np.full(len(texts), machine.bias if machine else -np.inf)
            worst = np.zeros(len(texts), np.int64)
            for part in _parts(texts) if machine else ():
                found = Passages([texts[i] for i in part])
                score = machine.scores(found)
                begin = np.searchsorted(found.text, np.arange(len(part)))
                top = np.maximum.reduceat(score, begin)
                hit = np.where(score == top[found.text], np.arange(len(score)), len(score))
                odds[part] = top
                worst[part] = np.minimum.reduceat(hit, begin) - begin
            score = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
            score = np.where(np.isneginf(odds), 0.0, score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(worst * _HALF)], ["key", "score", "worst_word"])

    return run


def score_texts(docs: DataFrame, machine: Machine | None, carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry`` columns with ``score`` (0 to 1), ``predicted`` and ``worst_word``, where the worst passage begins, for every row.

    A null text, or one without a term, scores what the bias alone says; without a machine every text scores 0.
    """
    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    rows = docs.select(F.struct(*carry).alias("key"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_scorer(machine), f"key struct<{kinds}>, score double, worst_word long")
    return out.select("key.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_word")


def predict_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_docs: int = 20_000,
    sample_passages: int = 400_000,
) -> DataFrame:
    """``doc_id, held_out, score, predicted, worst_word`` of every row of ``docs``.

    Learns from the labelled rows that are not held out (see ``learn``); a null id is in no fold.  Repeated rows are kept,
    other columns play no part, and an empty table gives no row.  If nothing can be learnt, every score is 0.
    """
    machine = learn(docs, labels, id_col, text_col, label_col, sample_docs, sample_passages)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    return score_texts(rows, machine, ["doc_id", "held_out"])
