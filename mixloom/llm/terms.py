"""Terms of slices of texts as numbers: in which row, which distinct term, how often.

A class of terms is a table of the bytes that end a term, all of them ASCII; every byte of a character beyond ASCII belongs
to terms, so pieces of UTF-8 are never cut. Only A-Z are lower-cased.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from mixloom.llm.arrow import gathered, strings
from mixloom.llm.hashing import LOWER, Rolling, words

# Bytes outside [^\x00-\x40\x5B-\x60\x7B-\x7F], and outside the same class with the digits.
NO_LETTER = np.zeros(256, bool)
NO_LETTER[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
NO_LETTER_OR_DIGIT = NO_LETTER.copy()
NO_LETTER_OR_DIGIT[0x30:0x3A] = False


@dataclass
class Counted:
    """Distinct (row, term) pairs of a slice in order, how often each occurs, and the distinct terms (binary)."""

    row: np.ndarray
    term: np.ndarray
    times: np.ndarray
    terms: pa.Array


def counted(column: pa.Array, ends: np.ndarray) -> Counted:
    """The terms of every row; a null text has none."""
    data, offsets = strings(column)
    data = LOWER[data]
    found = words(data, offsets, ends)
    if not len(found.starts):
        none = np.zeros(0, np.int64)
        return Counted(none, none, none, pa.array([], pa.large_binary()))
    length = found.ends - found.starts
    bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    packed = gathered(found.starts, length, data)
    every = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]
    )
    coded = every.dictionary_encode()
    term = coded.indices.to_numpy().astype(np.int64)
    pair, times = np.unique(found.rows * len(coded.dictionary) + term, return_counts=True)
    return Counted(pair // len(coded.dictionary), pair % len(coded.dictionary), times, coded.dictionary)


def prefix_hashes(terms: pa.Array, size: int) -> np.ndarray:
    """Hash of the first `size` bytes of every term, or of the whole term if it is not longer."""
    data, offsets = strings(terms.cast(pa.large_binary()).view(pa.large_string()))
    rolling = Rolling()
    length = np.diff(offsets)
    cut = rolling.pieces(rolling.prefixes(data), offsets[:-1], offsets[:-1] + np.minimum(length, size))
    return cut ^ (length > size).astype(np.uint64)


def lengths(terms: pa.Array) -> np.ndarray:
    return pc.binary_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
