"""Counting tokens with a public tokenizer, whose files stay where they are."""

from __future__ import annotations

import base64
import functools

import numpy as np

#: Where the vocabulary files lie; every operator takes another path as a parameter.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern of this vocabulary's pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer:
    """A byte-level BPE from a file of ranks; special tokens are ordinary text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._own = tiktoken.Encoding("strandline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._size = np.zeros(max(ranks.values()) + 1, "int32")
        for token, rank in ranks.items():
            self._size[rank] = len(token)

    def count(self, text: str) -> int:
        return len(self._own.encode_ordinary(text))

    def ends(self, text: str) -> np.ndarray:
        """The byte at which each token ends."""
        return np.cumsum(self._size[self._own.encode_ordinary(text)])


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """One instance per worker process."""
    return Tokenizer(path)
