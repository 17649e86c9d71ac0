"""Exact Jaccard join of word-shingle sets by PartEnum signatures, and the groups that its links make.

Two sets with a Jaccard similarity of at least g differ in at most (|a| + |b|) (1 - g) / (1 + g) features. Sizes fall into
bands; a set belongs to its band, and to the next one if a partner there can be similar enough. For a band whose pairs
differ in at most k features, the feature domain is cut into k + 1 + t parts. A difference spoils one part, so at least
t + 1 parts agree, and two sets agree on a part exactly if they share its signature: the hash of their features in it.
Parts in which a set has no feature would be shared by unrelated sets: a set with at most t of them has a partner on
another part, and need not name them; the rare others name them too.

Exact copies are one set from the start. Links are verified on whole sets. Only connectivity is asked for, so sets that
are known to be connected are not compared again:

1. every set is compared with the one partner that most of its signatures point to;
2. signatures that still have sets of different groups make clusters. All pairs of a dense cluster are compared tile by
   tile, each tile a product of small matrices; in a sparse one, pairs of different groups within each signature are first
   held against a bound from sketches, a tenth of the size, and what passes is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mixloom.cluster import small, stored
from mixloom.llm.arrow import filtered, gathered, slices, strings
from mixloom.llm.components import components
from mixloom.llm.storage import Table
from mixloom.llm.hashing import LOWER, Rolling, mixed, windows, words

SHINGLE_WORDS = 4
PERCENT = 85
# Width of size bands, and the smallest share of extra parts.
BAND_RATIO = 1.3
# A tile holds two blocks of about this many sets, or bytes, at most.
BLOCK_SETS = 1024
BLOCK_BYTES = 8 << 20
# A cluster is compared whole if its pairs are at most so many times the pairs that share a signature, else by signature.
DENSE = 4.0
# Features that so many sets of a tile have become columns of matrices.
MANY_SETS = 32
# Rows that meet one partner in a task; beyond it the partner's set is sent to several.
ROWS_PER_PARTNER = 4096
# Columns of the small matrices.
TILE_COLUMNS = 1024
# Bits of the map-side filter of sets that have candidates: 16 per set, within these bounds.
FILTER_BITS = (1 << 20, 1 << 28)
BITMAP = 32768
SEEDS = 3
SIGNATURE_BITS = 48


@dataclass(frozen=True)
class Bands:
    """Sizes `low` to `high` of every band, its parts and how many of them may be empty."""

    low: np.ndarray
    high: np.ndarray
    parts: np.ndarray
    spare: np.ndarray
    percent: int

    @staticmethod
    def of(percent: int = PERCENT, ratio: float = BAND_RATIO, largest: int = 1 << 40) -> Bands:
        def differ(total: int) -> int:
            return total * (100 - percent) // (100 + percent)

        low = next(n for n in range(1, 1 << 20) if differ(2 * n) or n * 100 < percent * (n + 1) and differ(2 * n + 1))
        rows = []
        while low < largest:
            high = max(low, int(low * ratio))
            k, spare = differ(2 * high), 0
            for _ in range(4):
                parts = k + 1 + spare
                empty = parts * (1 - 1 / parts) ** low if parts > 1 else 0.0
                spare = min(math.ceil(empty + 3 * math.sqrt(empty)), 1 + k // 6)
            rows.append((low, high, k + 1 + spare, spare))
            low = high + 1
        return Bands(*(np.array(c, np.int64) for c in zip(*rows)), percent)

    def of_sizes(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, band) of every band that the sets of these sizes belong to."""
        own = np.searchsorted(self.low, sizes, side="right") - 1
        rows = np.flatnonzero(own >= 0)
        above = np.minimum(own + 1, len(self.low) - 1)
        reach = -(-self.low[above] * self.percent // 100)
        also = np.flatnonzero((sizes >= reach) & (above > own) & (sizes > 0))
        return np.concatenate([rows, also]), np.concatenate([own[rows], above[also]])


class ShingleSets:
    """Sets of a slice of texts: features sorted within rows, and the first feature of every row."""

    def __init__(self, seed: int = 0):
        self.rolling = Rolling(seed)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = strings(column)
        data = LOWER[data]
        found = words(data, offsets)
        hashes = self.rolling.pieces(self.rolling.prefixes(data), found.starts, found.ends)
        rows, first, count = found.rows, found.first, np.diff(found.first)
        keys = windows(hashes, SHINGLE_WORDS)
        inside = np.flatnonzero(rows[: len(keys)] == rows[SHINGLE_WORDS - 1 : SHINGLE_WORDS - 1 + len(keys)])
        keys, owner = keys[inside], rows[inside]
        for size in range(1, SHINGLE_WORDS):
            short = np.flatnonzero(count == size)
            if len(short):
                whole = windows(hashes, size)[first[short]] + np.uint64(size)
                keys, owner = np.concatenate([keys, mixed(whole)]), np.concatenate([owner, short])
        order = np.argsort(keys)
        order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
        keys, owner = keys[order], owner[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        keys, owner = keys[new], owner[new]
        return keys, np.searchsorted(owner, np.arange(len(column) + 1))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def names(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of every set."""
    size = np.diff(first).astype(np.uint64)
    one = mixed(sums(mixed(keys ^ np.uint64(0xA5A5)), first) + size)
    two = mixed(sums(mixed(keys ^ np.uint64(0x5A5A1)), first) ^ mixed(size))
    return one.view(np.int64), two.view(np.int64)


def signatures(keys: np.ndarray, first: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of all sets."""
    size = np.diff(first)
    rows, band = bands.of_sizes(size)
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length, parts = size[rows], bands.parts[band]
    begin = np.cumsum(length) - length
    place = np.arange(int(length.sum())) + np.repeat(first[:-1][rows] - begin, length)
    value = mixed(keys[place] + np.repeat(mixed(band.astype(np.uint64)), length))
    base = np.cumsum(parts) - parts
    part = ((value >> np.uint64(32)) % np.repeat(parts, length).astype(np.uint64)).astype(np.int64)
    at = np.repeat(base, length) + part
    total = int(parts.sum())
    signature = np.zeros(total, np.uint64)
    np.add.at(signature, at, mixed(value))
    empty = np.bincount(at, minlength=total) == 0
    emission = np.repeat(np.arange(len(rows)), parts)
    named = ~empty | (np.add.reduceat(empty.astype(np.int64), base) > bands.spare[band])[emission]
    number = np.arange(total) - base[emission]
    domain = mixed((band[emission].astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64))
    signature = mixed(signature + domain) >> np.uint64(64 - SIGNATURE_BITS)
    return rows[emission[named]], signature[named].astype(np.int64)


def _batch(names_: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names_)


def set_names(docs: DataFrame, text: str, seed: int) -> DataFrame:
    """(doc_id, n_shingles, node, check) of every row; node is null without words or without doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = ShingleSets(seed)
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                keys, first = shingles(part.column(1))
                one, two = names(keys, first)
                none = (np.diff(first) == 0) | part.column(0).is_null().to_numpy(zero_copy_only=False)
                yield _batch(
                    ["doc_id", "n_shingles", "node", "check"],
                    part.column(0), np.diff(first), pa.array(one, mask=none), pa.array(two, mask=none),
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, n_shingles bigint, node bigint, check bigint"
    return docs.select("doc_id", text).mapInArrow(run, shape)


def set_signatures(docs: DataFrame, text: str, seed: int, bands: Bands) -> DataFrame:
    """(signature, node) of every set; a task names a set that it sees again only once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = ShingleSets(seed), np.zeros(0, np.int64)
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                keys, first = shingles(batch.column(0).slice(start, stop - start))
                node, _ = names(keys, first)
                _, once = np.unique(node, return_index=True)
                new = np.zeros(len(node), bool)
                new[once] = ~np.isin(node[once], seen)
                seen = np.concatenate([seen, node[new]])[-(1 << 20) :]
                rows, signature = signatures(keys, first, bands)
                kept = new[rows]
                yield _batch(["signature", "node"], signature[kept], node[rows[kept]])

    known = docs.where(F.col("doc_id").isNotNull())
    return known.select(text).mapInArrow(run, "signature bigint, node bigint")


def shared_signatures(signed: DataFrame) -> DataFrame:
    """(signature, node, partner) where at least two sets share it; partner: the smallest of them."""
    w = Window.partitionBy("signature")
    found = signed.withColumns({"partner": F.min("node").over(w), "last": F.max("node").over(w)})
    return found.where("partner <> last").drop("last").distinct()


class SetFilter:
    """Which sets are worth sending: a bitmap of their names. It may let others pass, never stops one that counts."""

    def __init__(self, nodes: DataFrame, count: int):
        self.bits = min(max(FILTER_BITS[0], 1 << (16 * max(1, count)).bit_length()), FILTER_BITS[1])
        place = F.pmod(F.col("node"), F.lit(self.bits))
        bitmaps = nodes.groupBy(F.expr(f"pmod(node, {self.bits}L) div {BITMAP}").alias("k")).agg(
            F.bitmap_construct_agg(F.pmod(place, F.lit(BITMAP))).alias("bitmap")
        )
        whole = np.zeros(self.bits // 8, np.uint8)
        for row in bitmaps.collect():
            at = row["k"] * (BITMAP // 8)
            whole[at : at + BITMAP // 8] = np.frombuffer(bytes(row["bitmap"]), np.uint8)
        self.shared = nodes.sparkSession.sparkContext.broadcast(whole)

    def passes(self, nodes: np.ndarray) -> np.ndarray:
        place = nodes & (self.bits - 1)
        return (self.shared.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def needed_sets(docs: DataFrame, text: str, seed: int, reps: DataFrame) -> DataFrame:
    """(node, n, sketch, features, task) of the sets of the rows whose doc_id is in `reps` (stored), and of a few others.

    The bitmap of these ids is the only thing sent to the tasks, and sets of other rows are not sent back. A task gives a
    set once; `once` keeps one of those that several tasks give.
    """
    wanted = SetFilter(reps.select(F.xxhash64("doc_id").alias("node")), reps.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = ShingleSets(seed), set()
        for batch in batches:
            batch = batch.filter(pa.array(wanted.passes(batch.column(1).to_numpy())))
            for start, stop in slices(batch.column(0)):
                keys, first = shingles(batch.column(0).slice(start, stop - start))
                node, _ = names(keys, first)
                rows = [r for r in np.flatnonzero(np.diff(first) > 0) if not (node[r] in seen or seen.add(node[r]))]
                found = [keys[first[r] : first[r + 1]] for r in rows]
                yield _batch(
                    ["node", "n", "sketch", "features"],
                    pa.array(node[rows], pa.int64()),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([sketch(f).tobytes() for f in found], pa.binary()),
                    pa.array([f.tobytes() for f in found], pa.binary()),
                )

    known = docs.where(F.col("doc_id").isNotNull()).select(text, F.xxhash64("doc_id").alias("h"))
    found = known.mapInArrow(run, "node bigint, n bigint, sketch binary, features binary")
    return found.withColumn("task", F.spark_partition_id())


def once(sets: DataFrame) -> DataFrame:
    """(node, n, sketch, features) of every node of written sets once: the row of the first task that gave it."""
    tasks = sets.groupBy("node").agg(F.min("task").alias("first"), F.max("task").alias("last"))
    several = stored(tasks.where("first <> last").select("node", "first"))
    if several.limit(1).collect():
        sets = sets.join(small(several), "node", "left").where("first IS NULL OR task = first").drop("first")
    return sets.drop("task")


def sketch(features: np.ndarray) -> np.ndarray:
    """Features per part of the hash range, up to 255; a power of two of parts, one or two features in each."""
    bits = max(4, min(16, (len(features) // 2).bit_length()))
    counts = np.bincount((features >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8)


def sketched_pairs(
    nodes: np.ndarray, groups: np.ndarray, sizes: np.ndarray, sketches: list[np.ndarray], percent: int
) -> list[tuple[int, int]]:
    """Pairs of different groups that may be similar.

    Every feature that two sets do not share changes a part's count by one at most, so the distance of their sketches never
    exceeds the number of features in which they differ. Sketches of unequal width are folded to the narrower one.
    """
    if len(nodes) < 2 or (groups == groups[0]).all():
        return []
    width = min(map(len, sketches))
    counts = np.stack([np.minimum(s.reshape(width, -1).sum(axis=1, dtype=np.int64), 255) for s in sketches]).astype(np.int16)
    out = []
    for i in range(1, len(nodes)):
        others = np.flatnonzero(groups[:i] != groups[i])
        total = sizes[others] + sizes[i]
        differ = np.abs(counts[others] - counts[i]).sum(axis=1, dtype=np.int64)
        for j in others[differ * (100 + percent) <= total * (100 - percent)].tolist():
            a, b = int(nodes[i]), int(nodes[j])
            out.append((max(a, b), min(a, b)))
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(best: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of (node, partner), stored and distinct, whose sets are similar.

    The sets of all nodes go to their partner; the rows of a partner with very many nodes are dealt over several groups,
    each of which gets its set. A task holds one partner's set at a time.
    """
    counts = best.groupBy("partner").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_PARTNER).cast("int").alias("deals"))
    counts = stored(counts)
    dealt = best.join(small(counts), "partner")
    dealt = dealt.withColumn("deal", F.pmod(F.xxhash64("node"), F.col("deals")).cast("int"))
    sets = sets.select("node", "features")
    members = sets.join(small(dealt.select("node", "partner", "deal"), best.count()), "node")
    members = members.select("partner", "deal", F.lit(1).alias("side"), "node", "features")
    centres = sets.withColumnRenamed("node", "partner").join(small(counts), "partner")
    centres = centres.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    centres = centres.select("partner", "deal", F.lit(0).alias("side"), F.col("partner").alias("node"), "features")
    together = centres.unionByName(members).repartition("partner", "deal")
    together = together.sortWithinPartitions("partner", "deal", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = None
        for batch in batches:
            partner, _, side, node, packed = (batch.column(i).to_pylist() for i in range(5))
            out = []
            for p, s, n, f in zip(partner, side, node, packed):
                features = np.frombuffer(f, np.uint64)
                if s == 0:
                    centre = features
                elif similar(centre, features, percent):
                    out.append((n, p))
            yield _links(out)

    return together.mapInArrow(run, "a bigint, b bigint")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return _batch(["a", "b"], *(pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets.

    Features that many sets have are columns of small matrices whose products are added up; those that few have add one
    to each pair of their sets.
    """
    features = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(features, kind="stable")
    features, owner = features[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], features[1:] != features[:-1]]))
    times = np.diff(np.append(first, len(features)))
    both = np.zeros((len(sets), len(sets)), np.float32)
    rare = np.repeat((times > 1) & (times < MANY_SETS), times)
    value, who = features[rare], owner[rare]
    for lag in range(1, MANY_SETS - 1):
        at = np.flatnonzero(value[lag:] == value[:-lag])
        if not len(at):
            break
        np.add.at(both, (who[at], who[at + lag]), 1)
    both += both.T
    often = np.flatnonzero(times >= MANY_SETS)
    for start in range(0, len(often), TILE_COLUMNS):
        part = often[start : start + TILE_COLUMNS]
        block = np.zeros((len(sets), len(part)), np.float32)
        rows = gathered(first[part], times[part], owner)
        block[rows, np.repeat(np.arange(len(part)), times[part])] = 1
        both += block @ block.T
    return both


def tile_links(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between similar sets of a tile: enough to connect what they connect."""
    if len(sets) < 2:
        return []
    size = np.array([len(s) for s in sets], np.float64)
    both = overlaps(sets)
    label = np.arange(len(sets))
    links = []
    for i in range(1, len(sets)):
        shared = both[i, :i].astype(np.float64)
        near = np.flatnonzero(100 * shared >= percent * (size[i] + size[:i] - shared))
        groups, at = np.unique(label[near], return_index=True)
        for j in near[at[groups != label[i]]].tolist():
            links.append((int(nodes[i]), int(nodes[j])))
        if len(groups):
            label[np.isin(label, groups) | (label == label[i])] = groups[0] if groups[0] < label[i] else label[i]
    return links


def _tiles(members: DataFrame, sets: DataFrame, carried: list[str]) -> DataFrame:
    """Rows (key, x, y, carried...) of all tiles of (key, blocks, node, ...), tile by tile.

    The sets of a key fall into `blocks` by hash; every two blocks make a tile, so that no task holds more than a tile
    whatever the number of sets.
    """
    placed = members.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiles = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = ["key", "x", "y"]
    tiles = tiles.withColumns({"x": F.least("i", "j"), "y": F.greatest("i", "j")}).drop("i", "j", "blocks")
    filled = sets.join(small(stored(tiles)), "node").select(*tile, *carried)
    return filled.repartition(*tile).sortWithinPartitions(*tile)


def _over_tiles(work):
    """For mapInArrow: `work` gets the carried columns of one tile at a time and gives pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*columns):
                if row[:3] != current:
                    if held:
                        yield _links(work(*zip(*held)))
                    current, held = row[:3], []
                held.append(row[3:])
        if held:
            yield _links(work(*zip(*held)))

    return run


def tiled(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the sets of every key of (key, blocks, node): all pairs, tile by tile."""

    def work(nodes, features):
        return tile_links(np.array(nodes, np.int64), [np.frombuffer(f, np.uint64) for f in features], percent)

    return _tiles(members, sets, ["node", "features"]).mapInArrow(_over_tiles(work), "a bigint, b bigint")


def likely_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, partner) of the pairs of different labels within a key of (key, blocks, node, label) that may be similar."""

    def work(nodes, labels, sizes, sketches):
        parts = [np.frombuffer(s, np.uint8) for s in sketches]
        return sketched_pairs(np.array(nodes, np.int64), np.array(labels), np.array(sizes), parts, percent)

    found = _tiles(members, sets, ["node", "label", "n", "sketch"]).mapInArrow(_over_tiles(work), "a bigint, b bigint")
    return found.distinct().select(F.col("a").alias("node"), F.col("b").alias("partner"))


def clusters(open_: DataFrame, sizes: DataFrame, dense: float = DENSE) -> DataFrame:
    """(kind, key, blocks, node): the keys within which all pairs of open sets are to be compared.

    `open_` holds (signature, node, partner) of the signatures with sets of different groups. Signatures that share sets
    make a cluster. It is one key (kind 0) if most of its sets share signatures, as copies of one text do; sets that a passage
    here and there has chained together are compared by signature (kind 1).
    """

    def blocks(rows, size):
        return F.greatest(F.ceil(rows / BLOCK_SETS), F.ceil(size / BLOCK_BYTES)).cast("int")

    found = components(open_.select(F.col("node").alias("a"), F.col("partner").alias("b")))
    rows = open_.join(small(stored(found)), "node").join(small(sizes), "node")
    rows = stored(rows.select("signature", "component", "node", "size"))
    own = rows.groupBy("component", "signature").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    own = own.withColumn("blocks", blocks(F.col("n"), F.col("size")))
    whole = rows.select("component", "node", "size").distinct()
    cost = whole.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    cost = cost.withColumn("blocks", blocks(F.col("n"), F.col("size")))
    pairs = own.groupBy("component").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
    choice = cost.join(pairs, "component").withColumn("one", F.col("n").cast("double") * F.col("n") <= dense * F.col("pairs"))
    choice = stored(choice.select("component", "blocks", "one"))
    together = whole.join(small(choice.where("one")), "component")
    together = together.select(F.lit(0).alias("kind"), F.col("component").alias("key"), "blocks", "node")
    rest = rows.join(small(choice.where("NOT one").select("component")), "component", "left_semi")
    rest = rest.select("signature", "node").join(own.select("signature", "blocks"), "signature")
    return together.unionByName(rest.select(F.lit(1).alias("kind"), F.col("signature").alias("key"), "blocks", "node"))


def _between(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """(node, partner, x, y): pairs with the labels of both sides, the smaller one first."""
    for side, name in (("node", "_one"), ("partner", "_two")):
        found = label.select(F.col("node").alias(side), F.col("component").alias(name))
        pairs = pairs.join(small(found), side, "left").withColumn(name, F.coalesce(name, side))
    return pairs.select("node", "partner", F.least("_one", "_two").alias("x"), F.greatest("_one", "_two").alias("y"))


def _labelled(label: DataFrame, between: DataFrame, joined: DataFrame) -> DataFrame:
    """(x, y) of the pairs of labels that the links `joined` connect, directly or through others."""
    met = _between(joined.select(F.col("a").alias("node"), F.col("b").alias("partner")), label)
    found = stored(components(met.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    pairs = between.select("x", "y").distinct()
    for side, name in (("x", "_one"), ("y", "_two")):
        own = found.select(F.col("node").alias(side), F.col("component").alias(name))
        pairs = pairs.join(small(own), side)
    return pairs.where("_one = _two").select("x", "y")


def set_groups(docs: DataFrame, text: str, seed: int, percent: int, reps: DataFrame) -> DataFrame:
    """(node, component) of the sets that are linked with another one. `reps`: one (node, doc_id) for every set."""
    signed = set_signatures(docs, text, seed, Bands.of(percent))
    shared = Table(shared_signatures(signed), "shared")
    nodes = shared.rows.select("node").distinct()
    sets = Table(needed_sets(docs, text, seed, stored(reps.join(nodes, "node"))), "sets")
    whole = once(sets.rows)

    points = shared.rows.where("node <> partner").groupBy("node", "partner").agg(F.count(F.lit(1)).alias("times"))
    best = stored(points.groupBy("node").agg(F.max_by("partner", F.struct("times", "partner")).alias("partner")))
    links = stored(verified(best, whole, percent))

    # Signatures are open where a set and the smallest one have no common group yet.
    label = stored(components(links))
    seen = shared.rows.join(small(label.withColumnRenamed("component", "own")), "node", "left")
    other = label.select(F.col("node").alias("partner"), F.col("component").alias("theirs"))
    seen = seen.join(small(other), "partner", "left")
    split = F.coalesce("own", "node") != F.coalesce("theirs", "partner")
    undecided = stored(seen.where(split).select("signature").distinct())
    open_ = Table(shared.rows.join(small(undecided), "signature", "left_semi"), "open")
    sizes = stored(whole.select("node", F.octet_length("features").alias("size")))
    keyed = stored(clusters(open_.rows, sizes))
    alike = tiled(keyed.where("kind = 0").drop("kind"), whole, percent)
    apart = keyed.where("kind = 1").drop("kind").join(small(label), "node", "left")
    apart = apart.select("key", "blocks", "node", F.coalesce("component", "node").alias("label"))
    likely = stored(likely_pairs(apart, whole, percent))
    # One pair for every two groups first; only where that does not join them, their other pairs.
    between = stored(_between(likely, label))
    one = between.groupBy("x", "y").agg(F.min(F.struct("node", "partner")).alias("p")).select("p.node", "p.partner")
    joined = stored(verified(stored(one), whole, percent))
    again = stored(_labelled(label, between, joined))
    rest = stored(between.join(small(again), ["x", "y"], "left_anti").select("node", "partner"))
    more = stored(alike.unionByName(joined).unionByName(verified(rest, whole, percent)).distinct())
    for table in (shared, sets, open_):
        table.drop()
    return components(links.unionByName(more))


def jaccard_groups(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable by links).

    A set: distinct four-word shingles of the text with A-Z lower-cased; the whole sequence if it has fewer words. Two
    documents link when 100 |a and b| >= percent |a or b|. Without words a document is linked with nothing. Rows with one
    doc_id count as one document; a row without doc_id links with nothing and has no component.
    """
    for seed in range(SEEDS):
        named = stored(set_names(docs, text, seed))
        classes = named.where(F.col("node").isNotNull()).groupBy("node")
        both = (F.min("check") != F.max("check")).alias("two")
        reps = stored(classes.agg(F.min("doc_id").alias("doc_id"), both))
        if not reps.where("two").limit(1).collect():
            break
    else:
        raise RuntimeError("two different sets have one name under every seed")
    groups = set_groups(docs, text, seed, percent, reps.select("node", "doc_id"))
    whole = named.join(groups, "node", "left")
    whole = whole.withColumn("label", F.coalesce("component", "node"))
    least = whole.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("least"))
    whole = whole.join(least, "label", "left")
    return whole.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def distinct_documents(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents of which each group keeps one: the rows whose doc_id is the group's; repeated ids stay repeated.

    Rows that a bitmap of the ids to drop lets pass are not shuffled; the others are checked by an exact join.
    """
    groups = jaccard_groups(docs, text, percent)
    drop = stored(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    marks = SetFilter(drop.select(F.xxhash64("doc_id").alias("node")), drop.count())
    mark = next(n for n in (f"mark_{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    marked = docs.withColumn(mark, F.xxhash64("doc_id"))

    def listed(wanted: bool):
        return lambda: lambda column: marks.passes(column.to_numpy()) == wanted

    clear = filtered(marked, mark, listed(False)).select(docs.columns)
    unsure = filtered(marked, mark, listed(True)).select(docs.columns)
    return clear.unionByName(unsure.join(drop, "doc_id", "left_anti").select(docs.columns))
