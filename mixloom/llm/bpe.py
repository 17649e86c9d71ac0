"""Byte-pair encoding by backtracking over longest token matches, and decoding through an offset table.

The encoder takes, at every place of a pre-token, the longest token that an Aho-Corasick automaton found there, and
checks it against the token before by a pair-compatibility table: two tokens may stand side by side in a BPE result
only if merging their concatenation gives them back. On a clash it goes on with the next shorter token of that place, or
steps back by one token; a place that failed once is never tried again, so the work is linear in the pre-token.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mixloom.llm.arrow import gathered, kept, with_columns
from mixloom.llm.pretokens import Ranges, classes, finder, holder, unlike, word_shape

# Pre-tokens of a generation, of which a worker remembers two, and pairs of tokens that it remembers before it starts anew: small,
# since the workers of an executor have one cache each.
CACHE_ENTRIES = 1 << 16
PAIR_ENTRIES = 1 << 17
# The last character of a word-final token is moved by this, to be another symbol than elsewhere.
FINAL = 0x10000


def byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself where printable, else from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class BpeModel:
    """Tables of a byte-level BPE tokenizer file. Inside, tokens are numbered by the order in which merges make them."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model = spec["model"]
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.end = model["end_of_word_suffix"] or ""
        self.letters = byte_letters()
        self.to_letters = dict(enumerate(self.letters))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in {**vocab, **self.special}.items():
            self.strings[i] = text

        made = [a + b for a, b in merges]
        if len(set(made)) != len(made):
            raise ValueError("a token has two merges")
        base = sorted(set(vocab) - set(made), key=vocab.get)
        order = {t: i for i, t in enumerate(base + made)}
        self.public = [vocab[t] for t in order]
        self.number = {self._symbols(t): i for t, i in order.items()}
        missing = [c for c in self.letters if c not in self.number or (self.end and self._final(c) not in self.number)]
        if missing:
            raise ValueError("the vocabulary lacks bytes")
        self.length = [len(s) for s in self.number]
        self.left, self.right = list(range(len(order))), list(range(len(order)))
        self.merged: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(merges, len(base)):
            self.left[k], self.right[k] = order[a], order[b]
            self.merged[order[a], order[b]] = k
        # Tokens that their own merges never make: they are in no result.
        self.usable = [True] * len(order)
        for k in range(len(base), len(order)):
            a, b = self.left[k], self.right[k]
            self.usable[k] = self.usable[a] and self.usable[b] and self._compatible(a, b, k)
        self.shorter = [self._next_prefix(s) for s in self.number]
        self.automaton = ahocorasick.Automaton()
        for s, i in self.number.items():
            if self.usable[i]:
                self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}

    def _final(self, body: str) -> str:
        return body[:-1] + chr(ord(body[-1]) + FINAL)

    def _symbols(self, token: str) -> str:
        if self.end and token.endswith(self.end) and token != self.end:
            return self._final(token[: -len(self.end)])
        return token

    def _next_prefix(self, symbols: str) -> int:
        """The longest usable token that is a shorter prefix, or -1."""
        for stop in range(len(symbols) - 1, 0, -1):
            i = self.number.get(symbols[:stop], -1)
            if i >= 0 and self.usable[i]:
                return i
        return -1

    def _compatible(self, a: int, b: int, limit: int) -> bool:
        """Whether BPE leaves the seam between two tokens alone.

        The merges of both sides are undone from the last to the first. Whatever pair meets at the seam must have no
        merge that comes before the merge undone last (on the right side: not after it, as BPE goes left to right).
        """
        merged, left, right = self.merged, self.left, self.right
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            known = self.pairs[a, b] = self._compatible(a, b, len(self.public))
        return known

    def encode_word(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        symbols = raw.decode("latin-1").translate(self.to_letters)
        if self.end:
            symbols = self._final(symbols)
        whole = self.number.get(symbols, -1)
        if whole >= 0 and self.usable[whole]:
            return [self.public[whole]]
        n = len(symbols)
        longest = [-1] * n
        for last, token in self.automaton.iter(symbols):
            start = last + 1 - self.length[token]
            if longest[start] < 0 or self.length[longest[start]] < self.length[token]:
                longest[start] = token
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                stop = at + self.length[token]
                if alive[stop] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = stop
                token = longest[at] if at < n else -1
            else:
                alive[at] = 0
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]
        return [self.public[t] for t in out]


class _Words(dict):
    """Packed ids by pre-token, worked out at first sight. Those of the generation before are looked up again, so frequent ones stay."""

    def __init__(self, model: BpeModel):
        self.model = model
        self.before: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.before = dict(self)
            self.clear()
        packed = self.before.get(word)
        if packed is None:
            packed = np.array(self.model.encode_word(word.encode()), np.uint32).tobytes()
        self[word] = packed
        return packed


class WordCodec:
    """Whole texts to ids and back, for a lower-casing tokenizer file with word ends."""

    def __init__(self, source: bytes, known: dict[str, Ranges]):
        self.model = BpeModel(source)
        self.find = finder(word_shape, known)
        self.unlike = holder(known["unlike"]) if known.get("unlike") else None
        specials = sorted(self.model.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.words = _Words(self.model)
        # Decoding: the bytes of all tokens one after the other, each with the blank that joins tokens.
        pieces = [s.encode() + b" " for s in self.model.strings]
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.find(text.lower())
        if self.unlike and self.unlike(text):
            from tokenizers.normalizers import NFC, Lowercase

            return self.find(Lowercase().normalize_str(NFC().normalize_str(text)))
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Lower-cased one character at a time, so a final sigma has no form of its own.
        return self.find(text.replace("\u03a3", "\u03c3").lower())

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers."""
        parts = self.special.split(text) if self.special else [text]
        if len(parts) == 1:
            return b"".join(map(self.words.__getitem__, self._plain(text)))
        found = []
        for i, part in enumerate(parts):
            if i % 2:
                found.append(np.uint32(self.model.special[part]).tobytes())
            else:
                found += map(self.words.__getitem__, self._plain(part))
        return b"".join(found)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_many(ids, np.array([0, len(ids)]))[0]

    def decode_many(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        lengths = self.lengths[ids]
        data = gathered(self.offsets[ids], lengths, self.blob).tobytes()
        edges = np.concatenate([[0], np.cumsum(lengths)])[first].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(edges, edges[1:])]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def bpe_kernel(source: bytes, results: Callable):
    """`results(ids, first, decoded)` turns a slice's ids into the added columns; first: where each text begins."""

    known = classes() | {"unlike": unlike()}

    def kernel():
        codec = kept(("word codec", hashlib.sha256(source).digest()), lambda: WordCodec(source, known))

        def run(column):
            parts = [codec.encode(t) if t else b"" for t in column.to_pylist()]
            first = np.cumsum([0, *(len(p) // 4 for p in parts)])
            ids = np.frombuffer(b"".join(parts), np.uint32)
            return results(ids, first, codec.decode_many(ids, first))

        return run

    return kernel


def encode_and_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add `ids` (array<int>) and `decoded` (string) of every whole text.

    `path`: a byte-level tokenizer file whose normaliser composes, joins white space and lower-cases, and whose words end
    in a mark; it is read on the driver and travels with the function (a few MB). A null or empty text has no ids and
    decodes to an empty text. Special strings inside texts become their ids.
    """

    def results(ids, first, decoded):
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
        return lists, pa.array([d.decode() for d in decoded], pa.string())

    return with_columns(docs, text, "ids array<int>, decoded string", bpe_kernel(_read(path), results))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add `n_tokens`, `ids` (array<int>) and the SHA-256 digest of the decoded text of every whole text."""

    def results(ids, first, decoded):
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
        return np.diff(first), lists, pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())

    return with_columns(docs, text, "n_tokens bigint, ids array<int>, decoded_sha256 string", bpe_kernel(_read(path), results))


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add `n_tokens`, and SHA-256 digests of the little-endian ids and of the decoded text, of every whole text.

    The same encoding and decoding as `encode_and_decode`; only the digests leave the task.
    """

    def results(ids, first, decoded):
        raw = ids.astype("<u4")
        return (
            np.diff(first),
            pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(first, first[1:])], pa.string()),
            pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
        )

    added = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return with_columns(docs, text, added, bpe_kernel(_read(path), results))
