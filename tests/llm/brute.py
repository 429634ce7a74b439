"""Plain versions of what the operators compute, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash


def simhash(text: str | None, width: int = 4) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n: int, links) -> list[int]:
    """Smallest index reachable of each of n items."""
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def repeats(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, hash of what is left."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def cosine_links(vectors: dict[int, np.ndarray], least: float) -> tuple[dict[int, int], dict[int, int]]:
    """Number of links and smallest id reachable of each vector."""
    ids = sorted(vectors)
    unit = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    low = groups(len(ids), list(zip(*np.nonzero(near), strict=True)))
    return {i: int(n) for i, n in zip(ids, near.sum(axis=1), strict=True)}, {i: ids[x] for i, x in zip(ids, low, strict=True)}


def nearest(vectors: dict[int, np.ndarray], query: int, k: int) -> list[tuple[float, int]]:
    found = sorted((float(np.sqrt(((v - vectors[query]) ** 2).sum())), i) for i, v in vectors.items() if i != query)
    return found[:k]


def word_runs(words: list, least_words: int = 6, least_roots: int = 4) -> list[tuple[int, int, int]]:
    """Start, stop and smallest period of every run, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(2 * q, least_words, least_roots * q):
                found.setdefault((i, j + q), q)  # a longer period of the same stretch repeats a shorter one
            i = j + 1
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def planted_words(doc_id: int | None, words: list) -> list:
    h = -1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def hard_negatives(rows: list[tuple[int, int, tuple]], anchors: set[int], positives: int = 5, negatives: int = 5) -> set[tuple]:
    """Of different rows (id, label, whole components): anchor, positive, rank, negative and the two scores."""
    out = set()
    score = lambda x, y: sum(a * b for a, b in zip(x[2], y[2], strict=True))
    for anchor in (r for r in rows if r[0] in anchors):
        others = [r for r in rows if r is not anchor and len(r[2]) == len(anchor[2])]
        ranked = sorted(((-score(anchor, r), r[0], r) for r in others), key=lambda x: x[:2])
        for s, i, _ in [x for x in ranked if x[2][1] == anchor[1]][:positives]:
            fits = [x for x in ranked if x[2][1] != anchor[1] and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out |= {(anchor[0], i, k + 1, n[1], -s, -n[0]) for k, n in enumerate(fits[:negatives])}
    return out
