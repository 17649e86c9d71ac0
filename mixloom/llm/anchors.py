"""SimHash near duplicates by anchor-point covering: fingerprints, links within a radius, and the groups they make.

Two 64-bit fingerprints that differ in at most three bits differ in at most one bit of some 32-bit half. The anchors of a
half are the codewords of a covering code: the [31, 26] Hamming code with one free bit, 2^27 words, no half farther than one
bit from one of them. Every fingerprint goes to all anchors within covering radius plus threshold (1 + 1 bits) of
each half, 17 at most; a pair whose halves differ in one bit meets at the nearest anchor of either fingerprint. At every
anchor the fingerprints that it is nearest to are compared with all that came to it, so no link is lost.

Only distinct fingerprints are compared, whatever the number of their documents. What meets at an anchor is an equi-join,
whose crowded keys adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.cluster import small, stored
from mixloom.llm.arrow import gathered, slices, strings
from mixloom.llm.components import components
from mixloom.llm.hashing import LOWER, words

SHINGLE_WORDS = 3
SEED = 42
# The halves of two linked fingerprints differ in at most one bit on one side: floor(RADIUS / 2).
RADIUS = 3
# Shingles whose bits are counted together in byte lanes.
LANE_ROWS = 255
CODE_BITS = 31

# Byte values as eight byte lanes, bit 0 in the lowest one.
LANES = (
    np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).reshape(256)
)


class SimHash:
    """Fingerprints of a slice of texts: bit by bit the majority of the hashes of all shingles; zero without words."""

    def __call__(self, column: pa.Array) -> np.ndarray:
        data, offsets = strings(column)
        data = LOWER[data]
        found = words(data, offsets)
        # The words again with one space behind each, so that a shingle is a piece of the bytes.
        length = found.ends - found.starts + 1
        packed = gathered(found.starts, length, np.append(data, np.uint8(0x20)))
        ends = np.cumsum(length)
        packed[ends - 1] = 0x20
        starts, ends = ends - length, ends - 1
        count, first = np.diff(found.first), found.first[:-1]
        # Shingles start at every word but the last two of a row; a row of one or two words has one shingle.
        shingles = np.where(count > 0, np.maximum(count - SHINGLE_WORDS + 1, 1), 0)
        bounds = np.concatenate([[0], np.cumsum(shingles)]).astype(np.int64)
        begin = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first, shingles)
        last = begin + np.repeat(np.minimum(count, SHINGLE_WORDS), shingles) - 1
        text, digest = packed.tobytes(), xxhash.xxh64_intdigest
        pieces = zip(starts[begin].tolist(), ends[last].tolist())
        hashes = np.fromiter((digest(text[s:e], SEED) for s, e in pieces), np.uint64, len(begin))
        return majority(hashes, bounds)


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per row, hashes[bounds[i] : bounds[i + 1]], the bits that more than half of them have."""
    counts = np.diff(bounds)
    out = np.zeros(len(counts), np.uint64)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return out
    runs = -(-counts[rows] // LANE_ROWS)
    of_row = np.cumsum(runs) - runs
    at = bounds[:-1][rows].repeat(runs) + LANE_ROWS * (np.arange(runs.sum()) - of_row.repeat(runs))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        lanes = np.add.reduceat(LANES[octets[:, k]], at).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), of_row, axis=0)
        octet = np.packbits(2 * ones > counts[rows][:, None], axis=1, bitorder="little")[:, 0]
        out[rows] |= octet.astype(np.uint64) << np.uint64(8 * k)
    return out


def _syndrome_table() -> np.ndarray:
    """For each byte of a half and each value of it, the XOR of the numbers (from 1) of its code bits that are set."""
    number = np.arange(1, 33, dtype=np.uint64)
    number[CODE_BITS:] = 0
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint64)
    return np.stack([np.bitwise_xor.reduce(bits * number[8 * b : 8 * b + 8], axis=1) for b in range(4)])


SYNDROMES = _syndrome_table()


def syndromes(halves: np.ndarray) -> np.ndarray:
    out = np.zeros(len(halves), np.uint64)
    for b in range(4):
        out ^= SYNDROMES[b][(halves >> np.uint64(8 * b)) & np.uint64(255)]
    return out.astype(np.int64)


def _bit(number: np.ndarray) -> np.ndarray:
    return np.where(number > 0, np.uint64(1) << (np.maximum(number, 1) - 1).astype(np.uint64), np.uint64(0))


def _steps() -> list[np.ndarray]:
    """Per syndrome, what to flip to come to all codewords within two bits, the nearest first."""
    free = np.uint64(1) << np.uint64(CODE_BITS)
    out = []
    for s in range(32):
        i = np.arange(1, 32)
        i = i[(i ^ s) > i] if s else i[:0]
        nearest = _bit(np.array([s]))
        out.append(np.concatenate([nearest, nearest | free, (_bit(i) | _bit(i ^ s)) if s else nearest[:0]]))
    return out


STEPS = _steps()


def nearest_anchors(halves: np.ndarray) -> np.ndarray:
    return halves ^ _bit(syndromes(halves))


def all_anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of all anchors within covering radius plus threshold."""
    syndrome = syndromes(halves)
    rows, anchors = [], []
    for s in np.unique(syndrome):
        at = np.flatnonzero(syndrome == s)
        rows.append(np.repeat(at, len(STEPS[s])))
        anchors.append((halves[at][:, None] ^ STEPS[s][None, :]).ravel())
    none = np.zeros(0, np.int64)
    return np.concatenate(rows or [none]), np.concatenate(anchors or [none.astype(np.uint64)])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, print) of every row; print: the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        simhash = SimHash()
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                made = pa.array(simhash(part.column(1)).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), made], ["doc_id", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, print bigint")


def at_anchors(prints: DataFrame, every: bool) -> DataFrame:
    """(anchor, print): each print at the nearest anchor of both halves, or at every anchor that it may be needed at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy().view(np.uint64)
            for half in (0, 1):
                halves = (whole >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                rows, anchors = all_anchors(halves) if every else (np.arange(len(halves)), nearest_anchors(halves))
                key = (anchors | np.uint64(half) << np.uint64(32)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(whole[rows].view(np.int64))], ["anchor", "print"])

    return prints.select("print").mapInArrow(run, "anchor bigint, print bigint")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) of the distinct prints, a < b, that differ in at most `radius` bits; a pair may come more than once."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"anchors hold pairs within {RADIUS} bits")
    own = at_anchors(prints, every=False).withColumnRenamed("print", "a")
    came = at_anchors(prints, every=True).withColumnRenamed("print", "b").withColumnRenamed("anchor", "at")
    near = (F.col("anchor") == F.col("at")) & (F.col("a") != F.col("b"))
    near &= F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return own.join(came, near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def simhash_groups(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Shingles are three words, repeats included; a text of one or two words is one shingle; a null or wordless one has
    fingerprint zero and is linked like any other. component_id is the smallest doc_id that links reach; rows with one doc_id
    and different texts are rows of their own. A row without doc_id has its component all the same, and is null if alone.
    An empty table gives an empty result; other columns of `docs` have no effect.
    """
    named = stored(fingerprints(docs, text))
    classes = stored(named.groupBy("print").agg(F.min("doc_id").alias("least")))
    found = stored(components(links(classes, radius)))
    classes = classes.join(found.withColumnRenamed("node", "print"), "print", "left")
    classes = stored(classes.select("print", F.coalesce("component", "print").alias("group"), "least"))
    groups = classes.groupBy("group").agg(F.min("least").alias("component_id"))
    labelled = stored(classes.select("print", "group").join(groups, "group").select("print", "component_id"))
    digits = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
    return named.join(small(labelled), "print").select("doc_id", digits, "component_id")
