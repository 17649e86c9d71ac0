"""How the sources of a language differ in their use of terms, exactly, over the terms that enough documents hold.

Kept terms are found by iceberg prefix refinement: a first pass counts, per language, the documents that hold a prefix of
LEVELS[0] bytes; a pass per further level counts longer prefixes, only of terms whose prefix is in enough documents so far;
the last pass counts whole terms. A prefix is in at least as many documents as each of its terms, so no kept term is
lost. Passes count hashes of prefixes, and survivors travel as bitmaps of bounded size: both can only let too much pass, and
the last pass counts the terms themselves. Rare terms, most of a vocabulary, are never shuffled as texts.

Every map task adds up its own documents first, so a hot source or term is one row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mixloom.cluster import small, stored
from mixloom.llm.arrow import slices
from mixloom.llm.hashing import mixed
from mixloom.llm.jaccard import SetFilter
from mixloom.llm.storage import Table
from mixloom.llm.terms import NO_LETTER, Counted, counted, lengths, prefix_hashes

MIN_DOCS = 10
TOP_TERMS = 10
# Prefix bytes of the passes before the last one.
LEVELS = (4, 8)
# Rows that a task holds before it adds them up, and after that before it sends them on.
HELD_ROWS = 1 << 19
# Cells of a block of terms, and sources of a side of a tile.
BLOCK_CELLS = 100_000
TILE_SOURCES = 256
# Numbers of a matrix of a tile.
MATRIX_CELLS = 1 << 20
# Fixed values of the measure: scale of shares, and what is added to every count.
SCALE = 1_000_000_000
PRIOR = 2


def _named(value: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little"))


class Passing:
    """Which (row, term) pairs of a slice are still in play: bitmaps of the prefixes of each level that are frequent."""

    def __init__(self):
        self.levels: list[tuple[int, SetFilter]] = []

    def add(self, size: int, survivors: DataFrame) -> None:
        self.levels.append((size, SetFilter(survivors.select(F.col("place").alias("node")), survivors.count())))

    def pairs(self, found: Counted, langs: np.ndarray) -> np.ndarray:
        """Every pair's prefixes have survived, up to the level at which its term was complete."""
        stay, length, before = np.ones(len(found.row), bool), lengths(found.terms), 0
        for size, survivors in self.levels:
            at = np.flatnonzero(stay & (length > before)[found.term])
            stay[at] = survivors.passes(places(prefix_hashes(found.terms, size), found.term[at], langs[found.row[at]]))
            before = size
        return stay


def places(hashes: np.ndarray, term: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mixed(hashes[term] + lang).view(np.int64)


class Sums:
    """Counts per 64-bit key, added up in a task."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate(self.counts), minlength=len(keys)).astype(np.int64)
        self.__init__()
        return keys, counts


def _row_langs(column: pa.Array) -> np.ndarray:
    coded = column.dictionary_encode()
    names = np.array([_named(v) for v in coded.dictionary.to_pylist()], np.uint64)
    return names[coded.indices.to_numpy()]


def prefix_documents(docs: DataFrame, size: int, passing: Passing) -> DataFrame:
    """(place, docs): documents of (lang, text) that hold a prefix of `size` bytes or a term that is not longer.

    Only terms that pass are looked at, and of these only those that the levels before have not seen whole.
    """
    before = passing.levels[-1][0] if passing.levels else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()

        def sent():
            keys, counts = sums.take()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["place", "docs"])

        for batch in batches:
            langs = _row_langs(batch.column(0))
            for start, stop in slices(batch.column(1)):
                found = counted(batch.column(1).slice(start, stop - start), NO_LETTER)
                lang = langs[start:stop]
                at = np.flatnonzero(passing.pairs(found, lang) & (lengths(found.terms) > before)[found.term])
                if not len(at):
                    continue
                hashes, item = np.unique(prefix_hashes(found.terms, size), return_inverse=True)
                once = np.unique(found.row[at] * len(hashes) + item[found.term[at]])
                keys, times = np.unique(places(hashes, once % len(hashes), lang[once // len(hashes)]), return_counts=True)
                sums.add(keys, times)
                if sums.held > HELD_ROWS:
                    keys, times = sums.take()
                    sums.add(keys, times)
                    if sums.held > HELD_ROWS // 2:
                        yield sent()
        if sums.held:
            yield sent()

    made = docs.select("lang", "text").mapInArrow(run, "place bigint, docs bigint")
    return made.groupBy("place").agg(F.sum("docs").alias("docs"))


def term_counts(docs: DataFrame, passing: Passing) -> DataFrame:
    """(lang, source, term, docs, times): documents that hold a passing term, and how often it occurs in them."""
    keys, names = ["group", "term"], ["group", "term", "docs", "times"]

    def merged(parts: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(parts).group_by(keys).aggregate([("docs", "sum"), ("times", "sum")])
        return whole.select([*keys, "docs_sum", "times_sum"]).rename_columns(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, known = [], 0, {}

        def sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
            langs, sources = (pa.array(column, pa.string()) for column in zip(*known))
            for batch in table.to_batches(max_chunksize=1 << 14):
                group, term, count, times = batch.columns
                own = [langs.take(group), sources.take(group), term.cast(pa.string()), count, times]
                yield pa.RecordBatch.from_arrays(own, ["lang", "source", *names[1:]])

        for batch in batches:
            langs = _row_langs(batch.column(0))
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            group = np.array([known.setdefault(pair, len(known)) for pair in pairs], np.int64)
            for start, stop in slices(batch.column(2)):
                found = counted(batch.column(2).slice(start, stop - start), NO_LETTER)
                at = np.flatnonzero(passing.pairs(found, langs[start:stop]))
                if not len(at):
                    continue
                count = len(found.terms)
                pair, cell = np.unique(group[start:stop][found.row[at]] * count + found.term[at], return_inverse=True)
                times = np.bincount(cell, weights=found.times[at]).astype(np.int64)
                term = found.terms.take(pa.array(pair % count)).cast(pa.binary())
                columns = [pa.array(pair // count), term, pa.array(np.bincount(cell)), pa.array(times)]
                parts.append(pa.Table.from_arrays(columns, names))
                held += len(pair)
                if held > HELD_ROWS:
                    parts = [merged(parts)]
                    held = len(parts[0])
                    if held > HELD_ROWS // 2:
                        yield from sent(parts[0])
                        parts, held = [], 0
        if parts:
            yield from sent(merged(parts))

    shape = "lang string, source string, term string, docs bigint, times bigint"
    made = docs.select("lang", "source", "text").mapInArrow(run, shape)
    return made.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times"))


def kept_cells(docs: DataFrame, min_docs: int = MIN_DOCS, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(lang, source, term, times) of the terms that at least `min_docs` documents of their language hold."""
    passing = Passing()
    for size in levels:
        found = prefix_documents(docs, size, passing).where(F.col("docs") >= min_docs)
        passing.add(size, stored(found.select("place")))
    cells = Table(term_counts(docs, passing), "terms")
    # Bitmaps let some rare terms pass; this is the exact count.
    kept = cells.rows.groupBy("lang", "term").agg(F.sum("docs").alias("all_docs")).where(F.col("all_docs") >= min_docs)
    exact = stored(cells.rows.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "times"))
    cells.drop()
    return exact


def _share(times, total, terms):
    """1 + floor(SCALE (times + PRIOR) / (total + PRIOR terms)), in whole numbers of any size."""
    whole = f"CAST({SCALE} AS DECIMAL(10,0)) * CAST({times} + {PRIOR} AS DECIMAL(20,0))"
    return F.expr(f"1 + (({whole}) div CAST({total} + {PRIOR} * {terms} AS DECIMAL(20,0)))")


def _distance(p, q):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def pair_sums(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distances of every two sources of a language, summed over its kept terms.

    `cells` holds (lang, source, term, p) where a source has a term, `groups` (lang, source, p0) with the share of the terms
    that it has not. Terms fall into blocks and sources into sides, both by hash; a task adds up one tile, a block and two
    sides, at a time and holds small matrices of it. `cells` is stored.
    """
    counts = cells.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK_CELLS).cast("int").alias("blocks"))
    sides = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE_SOURCES).cast("int").alias("sides"))
    plan = stored(counts.join(sides, "lang"))
    own = F.pmod(F.xxhash64("source"), F.col("sides")).cast("int")

    def tiled(rows):
        rows = rows.withColumn("i", own).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
        return rows.withColumns({"x": F.least("i", "j"), "y": F.greatest("i", "j")})

    tile = ["lang", "block", "x", "y"]
    shape = [*tile, "kind", "term", "source", "i", "p"]
    heads = groups.join(small(plan), "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    heads = tiled(heads).withColumns({"kind": F.lit(0), "term": F.lit(""), "p": F.col("p0")}).select(shape)
    found = cells.join(small(plan), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    found = tiled(found).withColumn("kind", F.lit(1)).select(shape)
    dealt = heads.unionByName(found).repartition(*tile).sortWithinPartitions(*tile, "kind", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, work = None, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if row[:4] != current:
                    if work:
                        yield work.result(current[0])
                    current, work = row[:4], _Tile(row[2], row[3])
                work.add(*row[4:])
        if work:
            yield work.result(current[0])

    sums = dealt.mapInArrow(run, "lang string, source string, item string, value bigint")
    sums = stored(sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    return sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


class _Tile:
    """Distances between the sources of two sides over the terms of a block, some terms at a time."""

    def __init__(self, x: int, y: int):
        self.x, self.y = x, y
        self.names: list[list[str]] = [[], []]
        self.zero: list[list[int]] = [[], []]
        self.sums = None
        self.cells: list[tuple[int, int, int, int]] = []
        self.last, self.width = None, 0

    def add(self, kind: int, term: str, source: str, side: int, p: int) -> None:
        if kind == 0:
            for k in {0 if side == self.x else 1, 1 if side == self.y else 0}:
                self.names[k].append(source)
                self.zero[k].append(p)
            return
        if self.sums is None:
            self.sums = np.zeros((len(self.names[0]), len(self.names[1])), np.int64)
            self.at = [{s: i for i, s in enumerate(names)} for names in self.names]
        if term != self.last:
            if self.width * max(1, *self.sums.shape) >= MATRIX_CELLS:
                self._flush()
            self.last, self.width = term, self.width + 1
        for k in {0 if side == self.x else 1, 1 if side == self.y else 0}:
            self.cells.append((k, self.at[k][source], self.width - 1, p))

    def _flush(self) -> None:
        sides = [np.repeat(np.array(z, np.int64)[:, None], self.width, axis=1) for z in self.zero]
        which, row, column, p = np.array(self.cells, np.int64).reshape(-1, 4).T
        for k in (0, 1):
            own = which == k
            sides[k][row[own], column[own]] = p[own]
        for i, one in enumerate(sides[0]):
            gap = sides[1] - one
            self.sums[i] += (gap * gap // (sides[1] + one)).sum(axis=1)
        self.cells, self.last, self.width = [], None, 0

    def result(self, lang: str) -> pa.RecordBatch:
        if self.width:
            self._flush()
        out = []
        for i, a in enumerate(self.names[0]):
            for j, b in enumerate(self.names[1]):
                if self.sums is not None and (self.x != self.y or a < b):
                    out.append((lang, a, b, int(self.sums[i, j])))
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate([pa.string()] * 3 + [pa.int64()])]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how every source of a language stands to the other ones and to the whole.

    Part `pair`: the distance to each other source of the language over all kept terms. Part `term`: the `top` terms that the
    source uses more than its language. Null texts, languages and sources are empty ones; an empty table has no rows;
    repeated rows are documents of their own; other columns of `docs` have no effect.
    """
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    cells = kept_cells(docs, min_docs)
    whole = stored(cells.groupBy("lang", "term").agg(F.sum("times").alias("lang_times")))
    known = whole.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_times").alias("lang_total"))
    own = cells.groupBy("lang", "source").agg(F.sum("times").alias("total"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(known, "lang", "left")
    groups = stored(groups.fillna(0, ["total", "terms", "lang_total"]))
    with_terms = groups.where("terms > 0").withColumn("p0", _share("CAST(0 AS BIGINT)", "total", "terms"))

    shares = cells.join(small(with_terms.select("lang", "source", "total", "terms", "lang_total", "p0")), ["lang", "source"])
    shares = shares.withColumn("p", _share("times", "total", "terms"))
    sums = pair_sums(stored(shares.select("lang", "source", "term", "p")), with_terms.select("lang", "source", "p0"))
    # Sources of languages without kept terms meet at distance 0.
    bare = groups.where("terms = 0").select("lang", "source")
    others = bare.withColumnRenamed("source", "item")
    sums = sums.unionByName(bare.join(others, "lang").where("source <> item").withColumn("value", F.lit(0).cast("bigint")))
    in_order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.withColumn("rank", F.row_number().over(in_order)).withColumn("part", F.lit("pair"))

    marked = shares.join(whole, ["lang", "term"]).withColumn("q", _share("lang_times", "lang_total", "terms"))
    marked = marked.where("p > q").select("lang", "source", F.col("term").alias("item"), _distance("p", "q").alias("value"))
    marked = marked.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(marked.withColumn("part", F.lit("term")).select(columns))
