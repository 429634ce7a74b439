"""Token ids of whole texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: The vocabulary's files (names of the public tokenizer package) and the id that ends a document.
VOCABULARY, RANKS, END_ID = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", 2


class Encoder:
    """The ids that ``tokenizers`` gives with ``add_special_tokens=False``, taken from the same vocabulary as ranks.

    The ranks are several times faster and give the same ids for ordinary text.  ``tokenizers`` itself takes a text that
    spells one of the vocabulary's added tokens, which it treats as the token, and one with a white-space run so long
    that the faster library's pattern can't match it.
    """

    _RUN = 512  # a white-space run of twice this length covers one of the blocks that are looked at

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary)
        self.added = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        blank = any(text[i : i + self._RUN].isspace() for i in range(0, len(text), self._RUN)) if len(text) > self._RUN else False
        if blank or any(t in text for t in self.added):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@lru_cache(maxsize=2)
def encoder(vocabulary: str | None = None, ranks: str | None = None) -> Encoder:
    """One per Python worker; without paths, the files of the public tokenizer package on this machine."""
    import public_tokenizers

    return Encoder(vocabulary or public_tokenizers.path(VOCABULARY), ranks or public_tokenizers.path(RANKS))


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: whole pieces at its end, the first one takes what is left."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))] if n else []
