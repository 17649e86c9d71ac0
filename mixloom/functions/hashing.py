"""Built-in text functions: a hashing encoder and a hashing tokenizer over whitespace tokens."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII whitespace, and hex digits of a token's digest that are used.
WHITESPACE = r"[ \t\n\x0B\f\r]+"
DIGEST_HEX = 8
VOCABULARY = 32_768
PAD_ID = 0
CACHE_TOKENS = 1_000_000


def token_ids(text: Column, max_len: int, vocabulary: int = VOCABULARY) -> Column:
    """Stable ids 1..vocabulary-1 of the first `max_len` tokens; 0 is the padding id."""
    tokens = F.slice(F.array_remove(F.split(text, WHITESPACE), ""), 1, max_len)

    def token_id(token: Column) -> Column:
        head = F.conv(F.substring(F.md5(token), 1, DIGEST_HEX), 16, 10).cast("bigint")
        return (head % (vocabulary - 1) + 1).cast("int")

    return F.transform(tokens, token_id)


class _Buckets(dict):
    """Hash bucket by token, worked out at first sight."""

    def __init__(self, width: int):
        self.width = width

    def __missing__(self, token: bytes) -> int:
        if len(self) >= CACHE_TOKENS:
            self.clear()
        bucket = int(hashlib.md5(token).hexdigest()[:DIGEST_HEX], 16) % self.width
        self[token] = bucket
        return bucket


class HashingEncoder:
    """Texts to L2-normalised token counts in `width` hash buckets; an empty text gives zeros."""

    def __init__(self, width: int = 256):
        self.width = width
        self._bucket = _Buckets(width).__getitem__

    def __call__(self, texts: list[str]) -> np.ndarray:
        words = [text.encode().split() for text in texts]
        rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        buckets = np.fromiter(map(self._bucket, chain.from_iterable(words)), np.int64, len(rows))
        counts = np.bincount(rows * self.width + buckets, minlength=len(texts) * self.width)
        counts = counts.reshape(len(texts), self.width).astype(np.float64)
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        unit = np.divide(counts, length, out=np.zeros_like(counts), where=length > 0)
        return unit.astype(np.float32)
