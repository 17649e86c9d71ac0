"""Quality rules by repetition: characters inside repeated word n-grams of several lengths and repeated lines."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from mixloom.llm.arrow import filtered, strings, with_columns
from mixloom.llm.hashing import Rolling, mixed, windows, words

# Share of a text's word characters that may lie inside repeated n-grams, by n, and inside repeated lines.
NGRAM_LIMITS = ((5, 0.25), (7, 0.22), (10, 0.20))
LINE_LIMIT = 0.30
# Symbols that are counted, as bytes.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
BASE_WINDOW = 5
BASE_REPEAT_PERCENT = 20

FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, dup_ngram_share double, dup_line_share double"
)
KEPT = 6


def _repeated(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every key whether its row has it twice or more, and whether an earlier place of the row has it."""
    keys = mixed(keys + mixed(rows.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    if len(keys):
        same[1:-1] = k[1:] == k[:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return twice, later


def _covered(flags: np.ndarray, size: int, total: int) -> np.ndarray:
    """Words that lie in a flagged window of `size` words."""
    edge = np.zeros(total + 1, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def repetition_kernel(ngram_limits: Sequence[tuple[int, float]], line_limit: float):
    rolling = Rolling()
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def run(column):
        data, offsets = strings(column)
        found = words(data, offsets)
        rows, first, n = found.rows, found.first, len(found.starts)
        prefix = rolling.prefixes(data)
        hashes = rolling.pieces(prefix, found.starts, found.ends)
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        chars = points[found.ends] - points[found.starts]
        marks = _per_row(symbol[data], offsets)
        n_words, word_chars = np.diff(first), _per_row(chars, first)

        def repeats(size: int) -> np.ndarray:
            flags = np.zeros(n, bool)
            keys = windows(hashes, size)
            inside = np.flatnonzero(rows[: len(keys)] == rows[size - 1 : size - 1 + len(keys)])
            twice, _ = _repeated(keys[inside], rows[inside])
            flags[inside] = twice
            return _covered(flags, size, n)

        covered = {size: repeats(size) for size in {BASE_WINDOW, *(s for s, _ in ngram_limits)}}
        n_repeat_words = _per_row(covered[BASE_WINDOW], first)

        # Lines: pieces between \n and row ends; those without a word do not count.
        breaks = np.flatnonzero(data == 0x0A)
        line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
        line_starts = line_starts[line_starts < len(data)]
        line_starts = line_starts[data[line_starts] != 0x0A]
        stops = np.unique(np.concatenate([offsets[1:], breaks]))
        line_ends = stops[np.searchsorted(stops, line_starts, side="right")] if len(line_starts) else line_starts
        has_word = np.searchsorted(found.starts, line_ends) > np.searchsorted(found.starts, line_starts)
        line_starts, line_ends = line_starts[has_word], line_ends[has_word]
        line_rows = np.searchsorted(offsets, line_starts, side="right") - 1
        _, later = _repeated(rolling.pieces(prefix, line_starts, line_ends), line_rows)
        line_first = np.searchsorted(line_rows, np.arange(len(offsets)))
        n_dup_lines = _per_row(later, line_first)
        line_words = np.searchsorted(found.starts, [line_starts, line_ends])
        char_sums = np.zeros(n + 1, np.int64)
        np.cumsum(chars, out=char_sums[1:])
        line_chars = char_sums[line_words[1]] - char_sums[line_words[0]]
        base = np.maximum(word_chars, 1)
        line_share = _per_row(np.where(later, line_chars, 0), line_first) / base

        failed = (n_words < MIN_WORDS) | (100 * n_repeat_words > BASE_REPEAT_PERCENT * n_words)
        good = line_share <= line_limit
        ngram_share = np.zeros(len(n_words))
        for size, limit in ngram_limits:
            share = _per_row(np.where(covered[size], chars, 0), first) / base
            good &= share <= limit
            ngram_share = np.maximum(ngram_share, share)
        return (
            n_words.astype(np.int64), word_chars, marks, n_dup_lines, n_repeat_words,
            failed, good & ~failed, ngram_share, line_share,
        )

    return run


def quality(
    docs: DataFrame,
    text: str = "text",
    ngram_limits: Sequence[tuple[int, float]] = NGRAM_LIMITS,
    line_limit: float = LINE_LIMIT,
) -> DataFrame:
    """Add counts, shares of repeated characters and the verdict `kept` to every document.

    Words are runs of characters other than ASCII white space. `n_repeat_words` counts words in five-word windows that
    the text has twice or more, the first included; `n_dup_lines` lines with a word that equal an earlier line.
    `base_failed` is the base rule. `kept` also needs, for every (n, limit), at most that share of word characters inside
    n-grams that the text repeats, and at most `line_limit` of them inside repeats of lines. Symbols are counted, but decide
    nothing. An empty or null text fails.
    """
    limits = tuple(ngram_limits)
    return with_columns(docs, text, FIELDS, lambda: repetition_kernel(limits, line_limit))


def passing(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that `quality` keeps, with their own columns."""

    def kernel():
        judge = repetition_kernel(NGRAM_LIMITS, LINE_LIMIT)
        return lambda column: judge(column)[KEPT]

    return filtered(docs, text, kernel)
