"""Token counts by a map-side two-tier lookup: a broadcast table of frequent pre-tokens, then a cache per worker.

No pre-token is shuffled. The table only saves time: what it lacks is encoded by the library, once per worker.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.llm.arrow import kept, strings, with_columns
from mixloom.llm.pretokens import Ranges, byte_shape, classes, finder

# Rows whose pre-tokens fill the broadcast table, its entries, and entries of a worker's cache.
TABLE_ROWS = 2_000
TABLE_ENTRIES = 50_000
CACHE_ENTRIES = 1_000_000
TOKEN_LIMIT = 1024


class TextCounter:
    """Counts whole texts. `table`: frequent pre-tokens joined by NUL bytes, and their token counts."""

    def __init__(self, source: bytes, known: dict[str, Ranges], table: tuple[bytes, np.ndarray] | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.find = finder(byte_shape, known)
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        specials.sort(key=len, reverse=True)
        self.split = re.compile("|".join(map(re.escape, specials))).split if specials else lambda t: [t]
        self.frequent = {}
        if table is not None and table[1].size:
            self.frequent = dict(zip(table[0].decode().split("\0"), table[1].tolist()))
        self.cache: dict[str, int] = dict(self.frequent)

    def learn(self, pieces: list[str]) -> None:
        if len(self.cache) >= CACHE_ENTRIES:
            self.cache = dict(self.frequent)
        new = list({p for p in pieces if p not in self.cache})
        found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False) if new else []
        self.cache.update(zip(new, map(len, found)))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of every text; what the cache lacks is encoded for all of them together."""
        parts = [self.split(t) if t else [] for t in texts]
        pieces = [[p for part in found for p in self.find(part)] for found in parts]
        special = [max(0, len(found) - 1) for found in parts]
        try:
            counts = [sum(map(self.cache.__getitem__, found)) for found in pieces]
        except KeyError:
            self.learn([p for found in pieces for p in found])
            counts = [sum(map(self.cache.__getitem__, found)) for found in pieces]
        return np.array(counts, np.int64) + np.array(special, np.int64)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def frequent_table(docs: DataFrame, source: bytes, known: dict[str, Ranges], text: str = "text") -> tuple[bytes, np.ndarray]:
    """The most frequent pre-tokens of about TABLE_ROWS rows, TABLE_ENTRIES at most, and their token counts.

    Rows are taken by the hash of their text. Any rows would do, as every count is exact with whatever table.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = finder(byte_shape, known), Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(find(t or ""))
                if len(seen) > 8 * TABLE_ENTRIES:
                    seen = Counter(dict(seen.most_common(2 * TABLE_ENTRIES)))
        top = [(p, n) for p, n in seen.most_common() if "\0" not in p and len(p) < 64]
        columns = [pa.array([t[i] for t in top], kind) for i, kind in ((0, pa.string()), (1, pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["piece", "n"])

    total = max(1, docs.count())
    sample = docs.select(text).where(F.pmod(F.xxhash64(text), F.lit(total)) < TABLE_ROWS)
    found = sample.mapInArrow(count, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    rows = found.where("n > 1").orderBy(F.desc("n"), "piece").limit(TABLE_ENTRIES).collect()
    counter = TextCounter(source, known)
    pieces = [r["piece"] for r in rows]
    counter.learn(pieces)
    return "\0".join(pieces).encode(), np.array([counter.cache[p] for p in pieces], np.uint16)


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """Add `n_bytes` (UTF-8), `n_tokens` and `over_limit` (n_tokens > limit) of every whole text.

    `path`: a byte-level tokenizer file; read on the driver, it travels to the workers with the table. Special strings
    inside texts count as one token, as is the library's default. A null or empty text has no tokens.
    """
    source, known = _read(path), classes()
    shared = docs.sparkSession.sparkContext.broadcast((source, known, frequent_table(docs, source, known, text)))
    key = ("token counts", hashlib.sha256(source).digest(), uuid.uuid4().hex)

    def kernel():
        count = kept(key, lambda: TextCounter(*shared.value))

        def run(column):
            _, offsets = strings(column)
            n = count(column.to_pylist())
            return np.diff(offsets), n, n > limit

        return run

    return with_columns(docs, text, "n_bytes bigint, n_tokens bigint, over_limit boolean", kernel)
