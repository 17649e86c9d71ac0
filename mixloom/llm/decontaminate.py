"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, weighted-shingle similarity.

Window sizes form a ladder between the shortest and the longest item. The first and the last window of an item, of the
largest size that fits into it, are its fingerprints; the windows of the documents of these sizes get one too, from prefix
sums of their shingles' bit votes, where enough weight of items' shingles lies around them: a similar window shares that
much with its item, so none is left out. A fingerprint has eight blocks of 8 bits: two fingerprints within the radius differ
in at most radius / 7 bits in each of two blocks at least, so tables of all values that near to an item's blocks find every
fingerprint within the radius. A document shorter than an item has no window of that size: its whole fingerprint is held
against the item's. What they find is placed on the document and compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from mixloom.llm.arrow import filtered, gathered, slices, strings
from mixloom.llm.hashing import LOWER, Rolling, windows, words

SHINGLE_WORDS = 5
SIMILARITY = 0.8
# Windows of the least similarity differ in 10 to 11 bits on average, with a deviation of 3.
RADIUS = 20
# Ratio of window sizes; bytes of texts of one pass over the documents; places whose sums fit into 16 bits, and those whose
# sums are held at once.
LADDER = 1.25
ITEM_BYTES = 8 << 20
STRETCH = 4000
MOST_PLACES = 1 << 18
MOST_WEIGHT = 8
BITS, BLOCKS = 64, 8
BLOCK_BITS = BITS // BLOCKS
WORD = 64
# Places per item shingle of the table that tells which shingles may be an item's.
MARKS = 16
EPSILON = 1e-9


@dataclass
class Texts:
    """Shingles of the texts of a slice: hashes, weights, and the first word of every text.

    `short` has the texts of fewer words than a shingle: (row, words, hash of the whole sequence).
    """

    shingles: np.ndarray
    weights: np.ndarray
    first: np.ndarray
    short: tuple[tuple[int, int, int], ...] = ()

    @staticmethod
    def of(column: pa.Array, rolling: Rolling) -> Texts:
        data, offsets = strings(column)
        data = LOWER[data]
        found = words(data, offsets)
        hashes = rolling.pieces(rolling.prefixes(data), found.starts, found.ends)
        shingles = windows(hashes, SHINGLE_WORDS)
        letters = np.concatenate([[0], np.cumsum(found.ends - found.starts)])
        size = letters[SHINGLE_WORDS:] - letters[: len(letters) - SHINGLE_WORDS] if len(shingles) else letters[:0]
        # A shingle weighs by its letters: one of short, common words tells less.
        count, short = np.diff(found.first), []
        for n in range(1, SHINGLE_WORDS):
            rows = np.flatnonzero(count == n)
            if len(rows):
                short += [(r, n, k) for r, k in zip(rows.tolist(), windows(hashes, n)[found.first[rows]].tolist())]
        return Texts(shingles, np.clip(size // 6, 1, MOST_WEIGHT), found.first, tuple(short))


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles: shared weight over united weight."""
    keys, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    left = np.bincount(number[: len(a)], wa, len(keys))
    right = np.bincount(number[len(a) :], wb, len(keys))
    most = np.maximum(left, right).sum()
    return float(np.minimum(left, right).sum() / most) if most else 0.0


class SimHasher:
    """Fingerprints of all windows of a run of shingles, from prefix sums of their bits' votes.

    The sums of a run beyond MOST_PLACES are made bit by bit.
    """

    def __init__(self, shingles: np.ndarray, weights: np.ndarray):
        self.shingles, self.weights, self.sums = shingles, weights, None
        if len(shingles) <= MOST_PLACES:
            kind = np.int16 if len(shingles) <= STRETCH else np.int32
            bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)
            votes = (bits.astype(np.int16) * 2 - 1) * weights.astype(np.int16)[:, None]
            self.sums = np.zeros((len(shingles) + 1, BITS), kind)
            np.cumsum(votes, axis=0, out=self.sums[1:], dtype=kind)

    def windows(self, size: int) -> np.ndarray:
        """Of every window of `size` shingles."""
        if len(self.shingles) < size:
            return np.zeros(0, np.uint64)
        if self.sums is not None:
            bits = self.sums[size:] > self.sums[:-size]
            return np.packbits(bits, axis=1).view(np.uint64).ravel()
        prints = np.zeros(len(self.shingles) - size + 1, np.uint64)
        total = np.zeros(len(self.shingles) + 1, np.int64)
        for bit in range(BITS):
            on = (self.shingles >> np.uint64(bit)) & np.uint64(1) > 0
            np.cumsum(np.where(on, self.weights, -self.weights), out=total[1:])
            prints |= (total[size:] > total[:-size]).astype(np.uint64) << np.uint64(bit)
        return prints


class BlockIndex:
    """Fingerprints by their blocks; `near` gives all pairs within the radius.

    For every block and value a bit mask tells the fingerprints whose block is at most radius / 7 bits away, 64 to a word.
    """

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        flips = [sum(1 << i for i in c) for n in range(radius // (BLOCKS - 1) + 1) for c in combinations(range(BLOCK_BITS), n)]
        flips = np.array(flips, np.uint8)
        self.masks = np.zeros((BLOCKS, -(-len(prints) // WORD), 1 << BLOCK_BITS), np.uint64)
        for i, block in enumerate(self._blocks(prints)):
            for k, value in enumerate(block):
                self.masks[i, k // WORD, value ^ flips] |= np.uint64(1 << (k % WORD))

    @staticmethod
    def _blocks(prints: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(prints.view(np.uint8).reshape(-1, BLOCKS).T)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, fingerprint, distance) of every pair within the radius, once."""
        found = []
        blocks = self._blocks(prints)
        for word in range(self.masks.shape[1]):
            one = two = None
            for i in range(BLOCKS):
                mask = self.masks[i, word][blocks[i]]
                if one is None:
                    one, two = mask, np.zeros_like(mask)
                else:
                    two |= one & mask
                    one |= mask
            hit = np.flatnonzero(two)
            row, bit = np.nonzero(np.unpackbits(two[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            at, who = hit[row], bit + word * WORD
            distance = np.bitwise_count(prints[at] ^ self.prints[who]).astype(np.int64)
            close = distance <= self.radius
            found.append((at[close], who[close], distance[close]))
        return tuple(np.concatenate(c) for c in zip(*found))


class Benchmark:
    """Items of a benchmark, and the index of their fingerprints for every window size."""

    def __init__(self, ids: list, texts: list[str], radius: int = RADIUS):
        self.rolling = Rolling()
        self.ids, self.items = [], []
        brief: list[tuple[tuple[int, int], object]] = []
        for i, text in zip(ids, texts):
            item = Texts.of(pa.array([text], pa.large_string()), self.rolling)
            if len(item.shingles):
                self.ids.append(i)
                self.items.append(item)
            brief += [((n, key), i) for _, n, key in item.short]
        # Items of fewer words than a shingle, by their whole sequence; they are numbered after the others.
        self.brief: dict[tuple[int, int], list[int]] = {}
        for at, i in brief:
            self.brief.setdefault(at, []).append(len(self.ids))
            self.ids.append(i)
        sizes = np.array([len(t.shingles) for t in self.items], np.int64)
        self.ladder: list[int] = []
        size = float(sizes.min()) if len(sizes) else math.inf
        while len(sizes) and size <= sizes.max():
            self.ladder.append(int(size))
            size = max(int(size) + 1, size * LADDER)
        self.totals = np.array([t.weights.sum() for t in self.items], np.int64)
        self.known = np.unique(np.concatenate([t.shingles for t in self.items])) if self.items else np.zeros(0, np.uint64)
        self.marks = np.zeros(1 << (MARKS * len(self.known)).bit_length(), bool)
        self.marks[self.known & np.uint64(len(self.marks) - 1)] = True
        whole = [SimHasher(t.shingles, t.weights).windows(len(t.shingles))[0] for t in self.items]
        self.sizes, self.whole = sizes, BlockIndex(np.array(whole, np.uint64), radius) if whole else None
        # Of every window size the fingerprints, their items, the least weight of these and the furthest fingerprint.
        self.index: dict[int, tuple[BlockIndex, np.ndarray, int, int]] = {}
        for k, size in enumerate(self.ladder):
            above = self.ladder[k + 1] if k + 1 < len(self.ladder) else sizes.max() + 1
            prints, owners = [], []
            own = np.flatnonzero((sizes >= size) & (sizes < above))
            for n in own:
                windows_ = SimHasher(self.items[n].shingles, self.items[n].weights).windows(size)
                for place in {0, len(windows_) - 1}:
                    prints.append(windows_[place])
                    owners.append(n)
            if prints:
                blocks = BlockIndex(np.array(prints, np.uint64), radius)
                self.index[size] = blocks, np.array(owners), int(self.totals[own].min()), int(sizes[own].max()) - size

    def _hits(self, text: Texts) -> np.ndarray:
        """Weights of the shingles that are an item's, else 0."""
        at = np.flatnonzero(self.marks[text.shingles & np.uint64(len(self.marks) - 1)])
        keys = text.shingles[at]
        at = at[self.known[np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)] == keys]
        hits = np.zeros(len(text.shingles), np.int64)
        hits[at] = text.weights[at]
        return hits

    def _placed(self, text: Texts, low: int, high: int, item: int, threshold: float) -> tuple[int, float] | None:
        """The most similar window of an item's size within shingles low to high, of equal ones the first, if it passes.

        What a window shares is at most the weight of its shingles that are the item's: windows are compared by the bound
        that this gives until no other can be as similar.
        """
        own, total, count = self.items[item], int(self.totals[item]), high - low
        shingles, weights = text.shingles[low:high], text.weights[low:high]
        if own.weights[np.isin(own.shingles, shingles)].sum() < threshold * total - EPSILON:
            return None
        hits = np.concatenate([[0], np.cumsum(np.where(np.isin(shingles, own.shingles), weights, 0))])
        sums = np.concatenate([[0], np.cumsum(weights)])
        begin = np.arange(max(1, count - len(own.shingles) + 1))
        end = np.minimum(begin + len(own.shingles), count)
        shared = np.minimum(hits[end] - hits[begin], total)
        bound = shared / (sums[end] - sums[begin] + total - shared)
        best = None
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] < (best[1] if best else threshold) - EPSILON:
                break
            a, b = int(begin[i]), int(end[i])
            alike = similarity(shingles[a:b], weights[a:b], own.shingles, own.weights)
            if alike >= threshold and (best is None or (alike, -a) > (best[1], -best[0])):
                best = a, alike
        return best

    def leaks(self, column: pa.Array, threshold: float) -> list[tuple[int, int, int, int, float]]:
        """(row, item, first word, distance, similarity): of every row and item the most similar window, if it passes."""
        text = Texts.of(column, self.rolling)
        same = [(row, item, 0, 0, 1.0) for row, n, key in text.short for item in self.brief.get((n, key), ())]
        return sorted(same + self._windows(text, threshold))

    def _windows(self, text: Texts, threshold: float) -> list[tuple[int, int, int, int, float]]:
        """The same for rows and items that have shingles."""
        if not self.items or not len(text.shingles):
            return []
        # Only rows that share enough with the items, without the shingles that reach into the next row.
        count = np.maximum(0, np.diff(text.first) - SHINGLE_WORDS + 1)
        sums = np.concatenate([[0], np.cumsum(self._hits(text))])
        begin = np.minimum(text.first[:-1], len(text.shingles))
        shared = sums[begin + count] - sums[begin]
        rows = np.flatnonzero((count > 0) & (shared >= threshold * self.totals.min() - EPSILON))
        if not len(rows):
            return []
        first = np.concatenate([[0], np.cumsum(count[rows])])
        text = Texts(*(gathered(begin[rows], count[rows], v) for v in (text.shingles, text.weights)), first)
        sums = np.concatenate([[0], np.cumsum(self._hits(text))])

        nearest: dict[tuple[int, int], int] = {}

        def note(row: np.ndarray, item: np.ndarray, distance: np.ndarray) -> None:
            for r, i, d in zip(row.tolist(), item.tolist(), distance.tolist()):
                nearest[r, i] = min(d, nearest.get((r, i), BITS))

        short = np.flatnonzero(count[rows] < self.sizes.max())
        if len(short):
            runs = [(int(first[r]), int(first[r + 1])) for r in short]
            prints = [SimHasher(text.shingles[a:b], text.weights[a:b]).windows(b - a)[0] for a, b in runs]
            place, who, distance = self.whole.near(np.array(prints, np.uint64))
            less = count[rows[short[place]]] < self.sizes[who]
            note(short[place[less]], who[less], distance[less])

        longest = max(self.index)
        stretch = max(STRETCH, 2 * longest)
        for start in range(0, len(text.shingles), stretch - longest):
            stop = min(len(text.shingles), start + stretch)
            hasher = SimHasher(text.shingles[start:stop], text.weights[start:stop])
            for size, (index, owners, least, reach) in self.index.items():
                prints = hasher.windows(size)
                at = start + np.arange(len(prints))
                row = np.searchsorted(first, at, side="right") - 1
                around = sums[np.minimum(at + size + reach, len(text.shingles))] - sums[np.maximum(at - reach, 0)]
                fit = np.flatnonzero((at + size <= first[row + 1]) & (around >= threshold * least - EPSILON))
                place, who, distance = index.near(prints[fit])
                note(row[fit[place]], owners[who], distance)
            if stop == len(text.shingles):
                break
        found = []
        for (row, item), far in sorted(nearest.items()):
            best = self._placed(text, int(first[row]), int(first[row + 1]), item, threshold)
            if best:
                found.append((int(rows[row]), item, best[0], far, best[1]))
        return found


def benchmark_parts(items: DataFrame, item_id: str = "item_id", text: str = "text") -> list[DataFrame]:
    """The different items, in as many parts as keep each below ITEM_BYTES on average; null and empty texts are left out."""
    known = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    known = known.where(F.length("text") > 0).distinct()
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / ITEM_BYTES))
    return [known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p) for p in range(parts)]


def _loaded(part: DataFrame, radius: int) -> tuple[list, list[str], int]:
    rows = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0], r[1]))
    return [r[0] for r in rows], [r[1] for r in rows], radius


def leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, first_word, distance, similarity.

    Words are runs without ASCII white space, A-Z lower-cased; shingles have five words and weigh by their letters. A
    document holds an item if a window of the item's size has a weighted Jaccard similarity of at least `similarity` with
    it and a fingerprint of the document is within `radius` of the item's, `distance` at the nearest; the most similar
    window counts, of equal ones the first. A text of one to four words is one shingle, the whole sequence: it is held by texts of the
    same words only. Null texts, and those without words, hold nothing and are held by nothing; a null item_id is an id like others. Rows
    that repeat an item's id and text count once, repeated documents each. Items go to the tasks in parts of ITEM_BYTES, each by a
    pass over the documents.
    """
    shape = StructType(
        [docs.schema["doc_id"].__class__("doc_id", docs.schema["doc_id"].dataType)]
        + [items.schema["item_id"].__class__("item_id", items.schema["item_id"].dataType)]
        + list(StructType.fromDDL("first_word bigint, distance bigint, similarity double"))
    )

    def search(part: DataFrame) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(_loaded(part, radius))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            benchmark = Benchmark(*shared.value)
            for batch in batches:
                for start, stop in slices(batch.column(1)):
                    rows = batch.slice(start, stop - start)
                    found = benchmark.leaks(rows.column(1), similarity)
                    docs_ = rows.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                    items_ = pa.array([benchmark.ids[f[1]] for f in found], kind)
                    rest = [pa.array([f[i] for f in found], of) for i, of in _KINDS]
                    yield pa.RecordBatch.from_arrays([docs_, items_, *rest], shape.names)

        return docs.select("doc_id", text).mapInArrow(run, shape)

    kind = to_arrow_type(items.schema["item_id"].dataType)
    parts = [search(p) for p in benchmark_parts(items)]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found


_KINDS = ((2, pa.int64()), (3, pa.int64()), (4, pa.float64()))


def clean_documents(
    docs: DataFrame, items: DataFrame, text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS
) -> DataFrame:
    """The documents that hold no benchmark item, as `leaks` finds them, with their own columns."""
    for part in benchmark_parts(items):
        docs = _clean(docs, part, text, similarity, radius)
    return docs


def _clean(docs: DataFrame, part: DataFrame, text: str, threshold: float, radius: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_loaded(part, radius))

    def kernel():
        benchmark = Benchmark(*shared.value)

        def run(column):
            keep = np.ones(len(column), bool)
            keep[[f[0] for f in benchmark.leaks(column, threshold)]] = False
            return keep

        return run

    return filtered(docs, text, kernel)
