"""Language of whole texts and of their spans.

A word's scripts (ranges of code points) narrow the languages it can be in; the mean log-likelihood of its letter n-grams
scores those.  A Viterbi pass over the words, with a penalty for every change of language, labels spans of a mixed text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"

#: First code point of each stretch of letters and its script, from Unicode's blocks.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
)
_BLANK, _BLOCK_CHARS, _STRIDE = 0x20, 500_000, 64


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For every code point: its lower-case letter, or a blank if it is no letter; its script; the scripts' names."""
    top = 0x110000
    lower = np.full(top, _BLANK, np.uint32)
    for i in range(top):
        c = chr(i)
        if c.isalpha():
            small = c.lower()
            lower[i] = ord(small) if len(small) == 1 else i
    names = sorted({s for _, s in SCRIPTS})
    starts = [a for a, _ in SCRIPTS] + [top]
    script = np.repeat([names.index(s) for _, s in SCRIPTS], np.diff(starts)).astype(np.int16)
    return lower, script, names


class Words:
    """The words (runs of letters) of several texts, as one array of lower-cased code points with single blanks between."""

    def __init__(self, texts: list[str]):
        lower, script, self.script_names = _characters()
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        points = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        letters = lower[points]
        is_letter = letters != _BLANK
        change = np.flatnonzero(np.diff(is_letter, prepend=False, append=False))
        first, stop = change[::2], change[1::2]
        ends = np.cumsum(sizes)
        self.text = np.searchsorted(ends, first, "right")  # of each word
        begin = ends - sizes
        self.start, self.stop = first - begin[self.text], stop - begin[self.text]
        self.size = stop - first
        # A blank before every word and one behind the last.
        keep = is_letter.copy()
        keep[stop] = True
        self.codes = np.concatenate([[_BLANK], letters[keep]]).astype(np.uint32)
        self.scripts = script[points[is_letter]]
        self.owner = np.repeat(np.arange(len(first)), self.size)  # word of each letter

    def grams(self, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Bucket and word of every run of one to four characters of a word with a blank at both its ends.

        A blank may stand first or last in a run but not within, and not alone; a word of k letters has 4k such runs.
        """
        codes, blank = self.codes, self.codes == _BLANK
        word = np.cumsum(blank) - 1  # a blank belongs to the word behind it
        hashed = np.zeros(len(codes), np.uint32)
        inside = np.ones(len(codes), bool)
        for n in range(1, 5):
            m = len(codes) - n + 1
            if m <= 0:
                return
            with np.errstate(over="ignore"):
                hashed = hashed[:m] * np.uint32(0x01000193) + codes[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
                spread = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            if n > 2:
                inside = inside[:m] & ~blank[n - 2 : n - 2 + m]
            use = inside[:m] & ~blank if n == 1 else inside[:m]
            at = np.flatnonzero(use)
            yield ((spread >> np.uint32(9)) % np.uint32(buckets))[at].astype(np.int64), word[at]


# ------------------------------------------------------------------------------------------------ learning
def _counts(buckets: int) -> Callable:
    """``lang, feature, n`` of a task's texts: n-gram buckets, and letters by script as negative numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for part in _parts(texts):
                    words = Words([texts[i] for i in part])
                    if not len(words.size):
                        continue
                    mine = grams.setdefault(lang, np.zeros(buckets, np.int64))
                    for bucket, _ in words.grams(buckets):
                        mine += np.bincount(bucket, minlength=buckets)
                    seen = np.bincount(words.scripts, minlength=len(words.script_names))
                    scripts[lang] = scripts.get(lang, 0) + seen
        for lang in grams:
            some, also = np.flatnonzero(grams[lang]), np.flatnonzero(scripts[lang])
            feature = np.concatenate([some, -1 - also])
            n = np.concatenate([grams[lang][some], scripts[lang][also]])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(feature), pa.array(n)], ["lang", "feature", "n"])

    return run


class Model:
    """Log-probabilities of n-grams (a row for each language), and the languages each script allows."""

    def __init__(self, langs: list[str], table: np.ndarray, allowed: np.ndarray):
        self.langs, self.table, self.allowed = langs, np.ascontiguousarray(table.T), allowed

    def scores(self, words: Words) -> np.ndarray:
        """Each word's log-likelihood in each language, scaled to its letters and relative to the best.

        A language that uses none of the word's scripts is far below; a word in scripts that no language uses says nothing.
        """
        many, langs = len(words.size), len(self.langs)
        total = np.zeros((many, langs), np.float64 if langs <= 16 else np.float32)
        for bucket, word in words.grams(self.table.shape[1]):
            for k in range(langs):
                total[:, k] += np.bincount(word, self.table[k][bucket], many)
        total *= (np.minimum(words.size, 20) / (4 * words.size))[:, None].astype(total.dtype)
        fits = np.ones((many, langs), bool)
        if not self.allowed[np.unique(words.scripts)].all():
            for k in range(langs):
                fits[:, k] = np.bincount(words.owner, self.allowed[words.scripts, k], many) > 0
        best = np.where(fits, total, -np.inf).max(axis=1, keepdims=True)
        out = np.where(fits, total - np.where(np.isfinite(best), best, 0), -50.0)
        out[~fits.any(axis=1)] = 0
        return out.astype(np.float32)


def learn(labelled: DataFrame, sample_docs: int = 20_000, buckets: int = 1 << 17, min_script: float = 0.001) -> Model | None:
    """A model from rows ``lang, text, key``; rows without a label or letter teach nothing; None if no row does.

    ``sample_docs`` bounds how many labelled rows are learnt from: about that many by the languages' shares (those with the
    smallest hashes of ``key``), and of a rare language 200, or an equal part of ``sample_docs`` if that is less; the counts of those rows are made by Spark, and at most ``buckets`` numbers a language reach the driver.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    n, many = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    share = min(1.0, sample_docs / max(n, 1))
    if share < 1:
        least = min(200, sample_docs // many)
        rare = sizes.where(F.col("n") * share < least).orderBy("n", "lang").limit(1000).collect()  # no model has more languages
        own = F.lit(int(share * (1 << 30)))
        if rare:
            shares = F.create_map(*(F.lit(x) for r in rare for x in (r.lang, int(min(1.0, least / r.n) * (1 << 30)))))
            own = F.coalesce(shares[F.col("lang")], own)
        rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < own)
    counts = rows.select("lang", "text").mapInArrow(_counts(buckets), "lang string, feature long, n long")
    counts = counts.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return None
    langs = sorted(counts.lang.unique())
    if len(langs) > 1000:
        raise ValueError("more than 1000 languages")
    names = _characters()[2]
    table, letters = np.zeros((buckets, len(langs))), np.zeros((len(names), len(langs)))
    column = counts.lang.map({x: i for i, x in enumerate(langs)}).to_numpy()
    feature, n = counts.feature.to_numpy(), counts.n.to_numpy()
    gram = feature >= 0
    table[feature[gram], column[gram]] = n[gram]
    letters[-1 - feature[~gram], column[~gram]] = n[~gram]
    table = np.log((table + 0.1) / (table.sum(axis=0) + 0.1 * buckets)).astype(np.float32)
    return Model(langs, table, letters / np.maximum(letters.sum(axis=0), 1) >= min_script)


# ------------------------------------------------------------------------------------------------ labelling
def _by_steps(scores: np.ndarray, words: np.ndarray, penalty: float) -> np.ndarray:
    """The same path, a word of every text at a time; room for words x languages."""
    order = np.argsort(-words, kind="stable")
    first = (np.cumsum(words) - words)[order]
    many = words[order]
    own = np.arange(scores.shape[1], dtype=np.int16)
    back = np.zeros(scores.shape, np.int16)
    value = scores[first].astype(np.float64)
    for t in range(1, int(many.max())):
        live = np.searchsorted(-many, -t, "left")  # texts of more than t words
        top = value[:live].argmax(axis=1)
        change = value[np.arange(live), top][:, None] - penalty
        back[first[:live] + t] = np.where(value[:live] >= change, own, top[:, None])
        value[:live] = np.maximum(value[:live], change) + scores[first[:live] + t]
    path = np.zeros(len(scores), np.int16)
    state = value.argmax(axis=1).astype(np.int16)
    for t in range(int(many.max()) - 1, -1, -1):
        live = np.searchsorted(-many, -t, "left")
        path[first[:live] + t] = state[:live]
        state[:live] = back[first[:live] + t, state[:live]]
    return path


def viterbi(scores: np.ndarray, words: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word of several texts, whose words follow one another in ``scores`` (words x languages).

    ``words``: how many each text has, at least one.  A change of language between neighbouring words costs ``penalty``.
    With up to 16 languages texts are cut into strides of 64 words.  All strides are solved together, for every language that may stand before
    them; then the strides of each text are joined in order, the same place of all texts at a time; then the paths within
    are read back.  So a long text takes as many steps as it has strides, not words.  Solving for every language before takes
    room for the square of the languages: with more of them, the words of all texts are taken step by step instead.
    """
    if scores.shape[1] > 16:
        return _by_steps(scores, words, penalty)
    langs, strides = scores.shape[1], -(-words // _STRIDE)
    first = np.cumsum(strides) - strides
    total = int(strides.sum())
    padded = np.zeros((total, _STRIDE, langs), np.float32)
    inside = np.arange(len(scores)) - np.repeat(np.cumsum(words) - words, words)
    row = np.repeat(first, words) + inside // _STRIDE
    padded[row, inside % _STRIDE] = scores
    own = np.arange(langs, dtype=np.int16)
    best = np.where(np.eye(langs, dtype=bool), 0.0, -penalty)[None] + padded[:, 0, None, :].astype(np.float64)
    back = np.zeros((_STRIDE, total, langs, langs), np.int16)
    for t in range(1, _STRIDE):
        top = best.argmax(axis=2)
        change = np.take_along_axis(best, top[..., None], axis=2) - penalty
        back[t] = np.where(best >= change, own, top[..., None])
        best = np.maximum(best, change) + padded[:, t, None, :]
    order = np.argsort(-strides, kind="stable")
    value = np.zeros((len(words), langs))
    before = np.zeros((total, langs), np.int16)
    for k in range(int(strides.max())):
        live = order[: np.searchsorted(-strides[order], -k, "left")]
        joined = value[live][:, :, None] + best[first[live] + k]
        before[first[live] + k] = joined.argmax(axis=1)
        value[live] = joined.max(axis=1)
    begin, end = np.zeros(total, np.int16), np.zeros(total, np.int16)
    state = value.argmax(axis=1).astype(np.int16)
    for k in range(int(strides.max()) - 1, -1, -1):
        live = order[: np.searchsorted(-strides[order], -k, "left")]
        end[first[live] + k] = state[live]
        state[live] = before[first[live] + k, state[live]]
        begin[first[live] + k] = state[live]
    path, every = np.zeros((total, _STRIDE), np.int16), np.arange(total)
    state = end
    for t in range(_STRIDE - 1, -1, -1):
        path[:, t] = state
        state = back[t, every, begin, state]
    return path[row, inside % _STRIDE]


def _parts(texts: list[str | None], chars: int = _BLOCK_CHARS) -> Iterator[list[int]]:
    """Indices of the texts that are there, in blocks of a bounded number of characters, or of one longer text."""
    block, size = [], 0
    for i, text in enumerate(texts):
        if text:
            if block and size + len(text) > chars:
                yield block
                block, size = [], 0
            block.append(i)
            size += len(text)
    if block:
        yield block


_LABELS = "struct<lang_pred: string, score: double, spans: array<struct<start: int, end: int, lang: string>>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def _labelled(texts: list[str | None], model: Model | None, penalty: float) -> pa.StructArray:
    """Language, score and spans of some texts."""
    lang: list[str] = [UNKNOWN] * len(texts)
    score = np.zeros(len(texts))
    spans: list[list[dict]] = [[] for _ in texts]
    langs = len(model.langs) if model is not None else 0
    # The more languages, the fewer words at a time.
    for part in _parts(texts, max(10_000, _BLOCK_CHARS * 16 // max(langs, 16))) if langs else ():
        words = Words([texts[i] for i in part])
        if not len(words.size):
            continue
        have, count = np.unique(words.text, return_counts=True)
        scores = model.scores(words)
        path = viterbi(scores, count, penalty).astype(np.int64)
        silent = ~scores.any(axis=1)  # words that speak for no language: each has an equal part of them
        share = np.bincount(words.text * langs + path, words.size * ~silent, len(part) * langs).reshape(-1, langs)
        share += (np.bincount(words.text, words.size * silent, len(part)) / langs)[:, None]
        for k in have:
            lang[part[k]] = model.langs[int(share[k].argmax())]
            score[part[k]] = float(share[k].max() / share[k].sum())
        edge = np.flatnonzero((np.diff(path, prepend=-1) != 0) | (np.diff(words.text, prepend=-1) != 0))
        last = np.append(edge[1:], len(path)) - 1
        for k, a, b, code in zip(words.text[edge], words.start[edge], words.stop[last], path[edge], strict=True):
            spans[part[k]].append({"start": int(a), "end": int(b), "lang": model.langs[code]})
    return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(spans, _SPANS)], ["lang_pred", "score", "spans"])


def _labeller(model: Model | None, penalty: float) -> Callable:
    """A function of a text column; only the texts go to Python, and some hundred at a time are unpacked there."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [_labelled(batch.slice(at, 512).to_pylist(), model, penalty) for at in range(0, len(batch), 512)]
            yield pa.concat_arrays(parts) if parts else _labelled([], model, penalty)

    # Annotations decide the kind of function; they are strings in this module.
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Not to be run again by a filter on its result.
    return F.arrow_udf(run, _LABELS).asNondeterministic()


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, divisible by ``folds``."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds == 0


def identify(docs: DataFrame, model: Model | None, carry: list[str], text_col: str = "text", penalty: float = 6.0) -> DataFrame:
    """``carry`` columns with ``lang_pred, score, spans`` for every row.

    ``lang_pred``: the language with most letters, ``und`` where the text is null or holds no letter; ``score``: its share
    of the letters, 0 for ``und``; ``spans``: start, end (characters) and language of stretches, in order.  Words that no
    learnt language's script or model tells apart count an equal part for each; of equal shares the first name wins.
    """
    rows = docs.select(*carry, _labeller(model, penalty)(F.col(text_col).cast("string")).alias("_found"))
    return rows.select(*carry, *(F.col("_found").getField(c).alias(c) for c in ("lang_pred", "score", "spans")))


def learn_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 20_000
) -> Model | None:
    """A model from the labelled documents that are not held out; a null id is in no fold and is not learnt from."""
    rows = docs.where(~held_out(F.col(id_col)))
    return learn(rows.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("key")), sample_docs)


def predict_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 20_000
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, spans`` of every row.

    Learns from the labelled rows that are not held out, at most about ``sample_docs`` of them.  A null id is in no fold:
    it is neither learnt from nor held out.  If nothing can be learnt, every text is ``und``.  Repeated rows are kept and
    other columns play no part; an empty table gives no row.
    """
    model = learn_documents(docs, id_col, text_col, lang_col, sample_docs)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    return identify(rows, model, ["doc_id", "held_out"])
