"""Words and rolling hashes of whole slices of texts in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# An odd base of the polynomial hash (base - 1 is 2 mod 4, so no bits get lost) and of word windows,
# the constants of the 64-bit finaliser, and the seed of the byte table.
BASE = 0x9E3779B97F4A7C17 | 1
WINDOW_BASE = 0xD6E8FEB86659FD93
MIX_1 = 0xFF51AFD7ED558CCD
MIX_2 = 0xC4CEB9FE1A85EC53
TABLE_SEED = 20240229
POWERS = 1 << 16


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(MIX_1)
    h ^= h >> np.uint64(33)
    h *= np.uint64(MIX_2)
    h ^= h >> np.uint64(33)
    return h


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Prefix hashes of a byte string: the hash of any piece is a difference, moved to the origin.

    Equal bytes give equal hashes wherever they lie. Two different pieces agree by chance only (64 bits).
    """

    def __init__(self, seed: int = 0):
        self.table = np.random.default_rng(TABLE_SEED + seed).integers(1, 2**64, 256, dtype=np.uint64)
        self.up = self.down = np.zeros(0, np.uint64)

    def _grow(self, count: int) -> None:
        if len(self.up) < count:
            count = max(count, 2 * len(self.up), POWERS)
            self.up = _powers(BASE, count)
            self.down = _powers(pow(BASE, -1, 2**64), count)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def pieces(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (prefix[ends] - prefix[starts]) * self.down[starts]
        return mixed(h + (ends - starts).astype(np.uint64))


# ASCII white space as in [\x20\x09-\x0D]; all of UTF-8's other bytes belong to words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """Words of the rows of a slice: byte starts and ends, and the first word of each row (rows + 1)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """The longest runs within rows of bytes that are not in `space`."""
    inside = ~space[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[:1] = False
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1:] = False
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words, whatever row they lie in; len - size + 1 values."""
    count = max(0, len(hashes) - size + 1)
    out = np.zeros(count, np.uint64)
    for k in range(size):
        out *= np.uint64(WINDOW_BASE)
        out += hashes[k : k + count]
    return mixed(out)


def whole(first: np.ndarray, size: int, count: int) -> np.ndarray:
    """Of `count` windows, which lie in one row."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return rows[:count] == rows[size - 1 : size - 1 + count]
