"""Ranked lexical search of a set of items over all documents: MaxScore whose bounds know pairs of terms.

1. Documents become blocks, one row per slice of texts: postings of the items' terms and the lengths of the documents. Counts
   of documents and terms are added up from the blocks.
2. With them every posting has its impact, and every block its index: the largest impact of each term, and for pairs of terms of
   one item the list of documents that hold both with the largest joint impact. An item's terms are paired by weight,
   each in one pair, so bounds of its pairs add up.
3. The items run over the index. A pair's documents score at most its joint maximum, or that of the one term they hold, which is
   less than the sum of both maxima unless one document reaches both. Blocks, then terms, then documents are skipped
   when such bounds stay below the score that a task's best documents already have. Every task sends its best documents of every
   item, and the best of these are the result.

Skipping is exact: what could still tie is scored. Items travel in parts of bounded size, each a pass of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mixloom.llm.arrow import slices
from mixloom.llm.storage import Table
from mixloom.llm.terms import NO_LETTER_OR_DIGIT, counted

TOP = 10
# Distinct terms and bytes of the items of a part.
PART_TERMS = 4096
PART_BYTES = 1 << 20
BLOCK_BYTES = 2 << 20
# Fixed values of the score: scale of weights and impacts, saturation and length normalisation in hundredths.
WEIGHT_SCALE = 1000
IMPACT_SCALE = 1_000_000_000
TF_SCALE, LENGTH_SCALE = 1000, 8
LENGTH_BASE, LENGTH_SHARE = 100, 90

BLOCK = (
    "docs bigint, terms bigint, known array<int>, holding array<bigint>,"
    " doc binary, length binary, term binary, at binary, times binary"
)
INDEX = (
    "doc binary, term binary, at binary, impact binary, highest binary,"
    " pair binary, joint binary, pair_first binary, pair_at binary"
)


@dataclass
class Items:
    """Items of a part: ids, terms of all of them, and per item the numbers of its terms."""

    ids: pa.Array
    vocabulary: list[bytes]
    terms: list[np.ndarray]


def item_parts(items: DataFrame, max_terms: int, max_bytes: int) -> Iterator[Items]:
    """The items part by part; the driver holds one part at a time. Items without a term are left out."""
    ids, numbers, terms, held = [], {}, [], 0
    kind = pa.string() if items.schema["item_id"].dataType.simpleString() == "string" else pa.int64()

    def part():
        return Items(pa.array(ids, kind), list(numbers), terms)

    for row in items.toLocalIterator():
        found = counted(pa.array([row["text"]], pa.string()), NO_LETTER_OR_DIGIT).terms.to_pylist()
        size = sum(map(len, found))
        if ids and (len(numbers) + len(found) > max_terms or held + size > max_bytes):
            yield part()
            ids, numbers, terms, held = [], {}, [], 0
        if found:
            ids.append(row["item_id"])
            terms.append(np.array([numbers.setdefault(t, len(numbers)) for t in found], np.int64))
            held += size
    if ids:
        yield part()


def _packed(values, kind=np.int64) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def _numbers(packed: pa.Scalar, kind=np.int64) -> np.ndarray:
    return np.frombuffer(packed.as_py(), kind)


def blocks(docs: DataFrame, text: str, vocabulary: list[bytes]) -> DataFrame:
    """One row per slice of texts: counts, and postings of the vocabulary in order of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(vocabulary, pa.large_binary())
        names = [f.split()[0] for f in BLOCK.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())] + [pa.binary()] * 5
        for batch in batches:
            for start, stop in slices(batch.column(1), BLOCK_BYTES):
                part = batch.slice(start, stop - start)
                found = counted(part.column(1), NO_LETTER_OR_DIGIT)
                if not len(found.row):
                    continue
                length = np.bincount(found.row, weights=found.times, minlength=len(part)).astype(np.int64)
                number = pc.fill_null(pc.index_in(found.terms, wanted), -1).to_numpy(zero_copy_only=False)
                known = np.flatnonzero(number[found.term] >= 0)
                row, term, times = found.row[known], number[found.term[known]], found.times[known]
                present, holding = np.unique(term, return_counts=True)
                # Documents without an id count, but cannot be named.
                named = ~part.column(0).is_null().to_numpy(zero_copy_only=False)
                row, term, times = (x[named[row]] for x in (row, term, times))
                order = np.lexsort((row, term))
                rows, at = np.unique(row[order], return_inverse=True)
                ids = pc.fill_null(part.column(0), 0).to_numpy(zero_copy_only=False)[rows]
                values = [
                    int((length > 0).sum()), int(length.sum()), present.astype(np.int32), holding,
                    _packed(ids), _packed(length[rows]), _packed(term[order], np.int32), _packed(at, np.int32),
                    _packed(times[order]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    return docs.select(F.col("doc_id").cast("bigint"), text).mapInArrow(run, BLOCK)


@dataclass
class Plan:
    """What the tasks need of a part: term weights, corpus counts, pairs of terms, and the units of every item.

    A unit is a pair or a single term of an item: `left` and `right` are its terms (equal for a single one), `pair` its pair or
    -1; units of item i are first[i] to first[i + 1].
    """

    weight: np.ndarray
    documents: int
    total: int
    pairs: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pair: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(items: Items, documents: int, total: int, holding: np.ndarray) -> Plan:
        weight = np.array(
            [math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in holding], np.int64
        )
        pairs: dict[tuple[int, int], int] = {}
        units, first = [], [0]
        for terms in items.terms:
            # Terms of like weight are paired: their maxima are of like size, so joint ones save most.
            order = terms[np.lexsort((terms, -weight[terms]))].tolist()
            for a, b in zip(order[::2], order[1::2]):
                a, b = min(a, b), max(a, b)
                units.append((a, b, pairs.setdefault((a, b), len(pairs))))
            if len(order) % 2:
                units.append((order[-1], order[-1], -1))
            first.append(len(units))
        left, right, pair = np.array(units, np.int64).T
        return Plan(weight, documents, total, np.array(list(pairs), np.int64).reshape(-1, 2), left, right, pair, np.array(first))

    def impacts(self, term: np.ndarray, times: np.ndarray, length: np.ndarray) -> np.ndarray:
        relative = [LENGTH_SHARE * int(n) * self.documents // self.total for n in length.tolist()]
        norm = LENGTH_BASE - LENGTH_SHARE + np.array(relative, np.int64)
        return self.weight[term] * (IMPACT_SCALE * times // (TF_SCALE * times + LENGTH_SCALE * norm))


def _matrix(term: np.ndarray, at: np.ndarray, impact: np.ndarray, terms: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Impacts of the terms of a block by document, and the line of every term (an empty line if it is not there)."""
    present, line = np.unique(term, return_inverse=True)
    lines = np.full(terms, len(present), np.int64)
    lines[present] = np.arange(len(present))
    matrix = np.zeros((len(present) + 1, docs), np.int64)
    matrix[line, at] = impact
    return matrix, lines


def indexed(blocks_: DataFrame, plan: Plan) -> DataFrame:
    """The index of every block: impacts, largest impacts, and the pair lists with their largest joint impacts."""
    names = [f.split()[0] for f in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                doc, length, times = (_numbers(batch.column(c)[i]) for c in (0, 1, 4))
                term, at = (_numbers(batch.column(c)[i], np.int32) for c in (2, 3))
                if not len(doc):
                    continue
                impact = plan.impacts(term, times, length[at])
                matrix, lines = _matrix(term, at, impact, len(plan.weight), len(doc))
                there = np.flatnonzero((lines[plan.pairs] < len(matrix) - 1).all(axis=1)) if len(plan.pairs) else []
                pair, joint, first, lists = [], [], [0], [np.zeros(0, np.int64)]
                for p in there:
                    one, two = (matrix[lines[t]] for t in plan.pairs[p])
                    both = np.flatnonzero((one > 0) & (two > 0))
                    if len(both):
                        pair.append(p)
                        joint.append(int((one + two)[both].max()))
                        first.append(first[-1] + len(both))
                        lists.append(both)
                values = [
                    _packed(doc), _packed(term, np.int32), _packed(at, np.int32), _packed(impact), _packed(matrix.max(axis=1)),
                    _packed(pair), _packed(joint), _packed(first), _packed(np.concatenate(lists), np.int32),
                ]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names)

    return blocks_.select("doc", "length", "term", "at", "times").mapInArrow(run, INDEX)


class Search:
    """The best documents of every item of a part over the index blocks that a task sees."""

    def __init__(self, plan: Plan, top: int):
        self.plan, self.top = plan, top
        count = len(plan.first) - 1
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * count
        # What a document must reach: the last of the best ones, 1 as long as there are fewer.
        self.least = np.ones(count, np.int64)
        self.scored = 0

    def block(self, doc, term, at, impact, highest, pair, joint, pair_first, pair_at) -> None:
        plan = self.plan
        matrix, lines = _matrix(term, at, impact, len(plan.weight), len(doc))
        one, two = lines[plan.left], lines[plan.right]
        bound = np.maximum(highest[one], highest[two])
        if len(plan.pairs):
            together = np.zeros(len(plan.pairs) + 1, np.int64)
            together[pair] = joint
            bound = np.maximum(bound, together[plan.pair])
        reach = np.add.reduceat(bound, plan.first[:-1])
        where = np.full(len(plan.pairs) + 1, -1, np.int64)
        where[pair] = np.arange(len(pair))
        for item in np.flatnonzero(reach >= self.least).tolist():
            units = np.arange(plan.first[item], plan.first[item + 1])
            units = units[np.argsort(bound[units], kind="stable")]
            below = np.cumsum(bound[units])
            # Documents that hold only terms of the first units cannot reach what is needed.
            essential = units[np.searchsorted(below, self.least[item], side="left") :]
            if not len(essential):
                continue
            singles = essential[plan.pair[essential] < 0]
            score = matrix[one[singles]].sum(axis=0)
            pairs = essential[plan.pair[essential] >= 0]
            score += matrix[one[pairs]].sum(axis=0) + matrix[two[pairs]].sum(axis=0)
            found = np.flatnonzero(score)
            score = score[found]
            rest = units[: len(units) - len(essential)]
            for k in range(len(rest) - 1, -1, -1):
                unit = rest[k]
                limit, listed = bound[unit], where[plan.pair[unit]]
                if listed >= 0:
                    # Only documents of the pair's list can reach the joint maximum.
                    alone = max(highest[one[unit]], highest[two[unit]])
                    both = np.isin(found, pair_at[pair_first[listed] : pair_first[listed + 1]])
                    limit = np.where(both, joint[listed], alone)
                stay = score + limit + (below[k] - bound[unit]) >= self.least[item]
                found, score = found[stay], score[stay]
                if not len(found):
                    break
                more = matrix[one[unit]][found]
                if plan.pair[unit] >= 0:
                    more = more + matrix[two[unit]][found]
                score = score + more
            self.scored += len(found)
            self._keep(item, doc[found], score)

    def _keep(self, item: int, doc: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.least[item]
        if not good.any():
            return
        held = self.best[item]
        doc, score = np.concatenate([held[0], doc[good]]), np.concatenate([held[1], score[good]])
        order = np.lexsort((doc, -score))[: self.top]
        self.best[item] = doc[order], score[order]
        if len(order) == self.top:
            self.least[item] = score[order[-1]]


def best_of_tasks(index: DataFrame, plan: Plan, top: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of every item, `item` its number in the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(plan, top)
        kinds = [np.int64, np.int32, np.int32] + [np.int64] * 5 + [np.int32]
        for batch in batches:
            for i in range(len(batch)):
                search.block(*(_numbers(batch.column(c)[i], k) for c, k in enumerate(kinds)))
        sizes = [len(d) for d, _ in search.best]
        if sum(sizes):
            item = np.repeat(np.arange(len(sizes)), sizes)
            doc, score = (np.concatenate([b[k] for b in search.best]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (item, doc, score)], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def _ranked(docs: DataFrame, text: str, items: Items, top: int) -> DataFrame | None:
    spark = docs.sparkSession
    made = Table(blocks(docs, text, items.vocabulary), "blocks")
    total = made.rows.agg(F.sum("docs"), F.sum("terms")).first()
    if not total[0]:
        made.drop()
        return None
    each = made.rows.select(F.explode(F.arrays_zip("known", "holding")).alias("t"))
    each = each.groupBy("t.known").agg(F.sum("t.holding").alias("holding"))
    holding = np.zeros(len(items.vocabulary), np.int64)
    for row in each.collect():
        holding[row["known"]] = row["holding"]
    plan = Plan.of(items, total[0], total[1], holding)
    index = Table(indexed(made.rows, plan), "index")
    found = best_of_tasks(index.rows, plan, top)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ids = pa.table({"item": pa.array(np.arange(len(items.ids))), "item_id": items.ids})
    # One row per item of the part, so at most `top` per item are kept.
    result = Table(found.join(F.broadcast(spark.createDataFrame(ids)), "item"), "ranked")
    made.drop()
    index.drop()
    return result.rows


def search(docs: DataFrame, items: DataFrame, text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of every item with the highest scores above 0, all if fewer.

    Equal scores come by ascending doc_id. Null texts have no terms; an item without terms, or whose terms no document
    holds, has no rows. Rows without doc_id count in the statistics but are not ranked; rows that repeat a doc_id are documents of
    their own, as are items that repeat an id. Empty tables give an empty result; other columns have no effect.
    """
    items = items.select("item_id", F.col(text).alias("text"))
    parts = [_ranked(docs, text, part, top) for part in item_parts(items, PART_TERMS, PART_BYTES)]
    kind = items.schema["item_id"].dataType.simpleString()
    result = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for part in parts:
        if part is not None:
            result = result.unionByName(part.select(F.col("item_id").cast(kind), "rank", "doc_id", "score"))
    return result
