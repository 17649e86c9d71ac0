"""Greedy orders of one set of rows of any size: distributed passes against a small state, exact like the one-task greedy.

A pass scores all rows where they lie and brings the best few to the driver with their vectors. Gains only shrink (graph cut:
grow by at most twice its weight per pick, where cosines are negative), so every further pick whose gain beats the best
gain that any other row can still have is final: one pass gives many picks. Facility location is in `facility.py`.

Picks are appended to a table in the shared folder, and rows that are picked leave the stored rows from time to time: the
driver holds the state of the objective, the few rows of a pass and the picks since the last of these times, however
many picks there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.cluster import scratch_path, stored
from mixloom.config import GAIN_DIGITS, GRAPH_CUT_LAMBDA, LOG_DET_LAMBDA
from mixloom.functions.greedy import unit_rows
from mixloom.operators.facility import Facility
from mixloom.operators.similarity import matrix, unit_vector

# Rows that a pass brings to the driver, and picks after which they are written and taken out of the rows.
HEADS = 256
WRITTEN_AT = 1 << 16
CANDIDATES = "row_idx bigint, gain double, embedding array<double>"


class Picks:
    """Picks in order, in a table in the shared folder but for the last few."""

    shape = "place bigint, row_idx bigint, gain double"

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, scratch_path(spark, "picks")
        self.open: list[tuple[int, int, float]] = []
        self.count = 0

    def add(self, row: int, gain: float) -> None:
        self.open.append((self.count, row, gain))
        self.count += 1

    def write(self) -> None:
        frame = self.spark.createDataFrame(self.open, self.shape)
        frame.coalesce(1).write.mode("append").parquet(self.path)
        self.open = []

    def append(self, frame: DataFrame) -> None:
        """Picks that a frame (place, row_idx, gain) holds, after all others."""
        frame.write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        self.write()
        return self.spark.read.schema(self.shape).parquet(self.path)


def _heads(rows: DataFrame, columns: list[str], score, heads: int) -> list:
    """The rows with the highest scores, ties by row_idx; each task sends `heads` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            ids = table["row_idx"].to_numpy()
            gains = score(table, ids)
            order = np.lexsort((ids, -np.round(gains, GAIN_DIGITS)))[:heads]
            order = order[gains[order] > -np.inf]
            part = table.select(["row_idx", "embedding"]).take(pa.array(order))
            part = part.add_column(1, "gain", pa.array(gains[order]))
            best = part if best is None else pa.concat_tables([best, part])
            if best.num_rows > 4 * heads:
                best = _first(best, heads)
        if best is not None:
            yield from _first(best, heads).cast(_arrow()).to_batches()

    found = rows.select(columns).mapInArrow(run, CANDIDATES)
    return found.orderBy(F.round("gain", GAIN_DIGITS).desc(), "row_idx").limit(heads).collect()


def _arrow() -> pa.Schema:
    return pa.schema([("row_idx", pa.int64()), ("gain", pa.float64()), ("embedding", pa.list_(pa.float64()))])


def _first(table: pa.Table, count: int) -> pa.Table:
    gains = np.round(table["gain"].to_numpy(), GAIN_DIGITS)
    return table.take(pa.array(np.lexsort((table["row_idx"].to_numpy(), -gains))[:count]))


def without(rows: DataFrame, taken: np.ndarray) -> DataFrame:
    """The rows whose row_idx is not in the sorted `taken`, filtered where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("row_idx")).to_numpy()
            yield batch.filter(pa.array(~np.isin(ids, taken)))

    return rows.mapInArrow(run, rows.schema)


class _Scored:
    """Objectives whose gain is a function of the row and a small state: many picks per pass."""

    slack = 0.0

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def picks(self, count: int, heads: int) -> DataFrame:
        out = Picks(self.rows.sparkSession)
        while out.count < count:
            # Picked rows have no part in later gains.
            taken = np.sort(np.array([i for _, i, _ in out.open], np.int64))
            if len(taken) >= WRITTEN_AT:
                self.rows, taken = stored(without(self.rows, taken)), taken[:0]
                out.write()
            score = self.score()

            def open_gains(table, ids, score=score, taken=taken):
                gains = score(unit_rows(matrix(table["embedding"], table["row_idx"])))
                return np.where(np.isin(ids, taken), -np.inf, gains)

            found = _heads(self.rows, ["row_idx", "embedding"], open_gains, heads)
            if not found:
                break
            ids, x = [r["row_idx"] for r in found], unit_rows(np.array([r["embedding"] for r in found]))
            others = found[-1]["gain"] if len(found) == heads else -math.inf
            free = np.ones(len(ids), bool)
            for step in range(len(ids)):
                gains = np.where(free, np.round(self.score()(x), GAIN_DIGITS), -np.inf)
                j = min(np.flatnonzero(gains == gains.max()), key=lambda i: ids[i])
                if step and gains[j] <= round(others + self.slack * step, GAIN_DIGITS) + 10.0**-GAIN_DIGITS:
                    break
                out.add(ids[j], float(self.score()(x[j : j + 1])[0]))
                free[j] = False
                self.add(x[j])
                if out.count == count:
                    break
        return out.rows()


class _GraphCut(_Scored):
    slack = 2.0 * GRAPH_CUT_LAMBDA

    def __init__(self, rows: DataFrame):
        super().__init__(rows)
        total = rows.select(array_to_vector(unit_vector()).alias("u")).agg(Summarizer.sum(F.col("u"))).head()[0]
        self.pull = total.toArray()

    def score(self):
        pull, weight = self.pull, GRAPH_CUT_LAMBDA
        return lambda x: x @ pull - weight * (x * x).sum(axis=1)

    def add(self, x: np.ndarray):
        self.pull = self.pull - 2.0 * GRAPH_CUT_LAMBDA * x


class _LogDet(_Scored):
    def __init__(self, rows: DataFrame):
        super().__init__(rows)
        self.inverse = np.eye(rows.agg(F.max(F.size("embedding"))).head()[0]) / LOG_DET_LAMBDA

    def score(self):
        inverse = self.inverse
        return lambda x: math.log(LOG_DET_LAMBDA) + np.log1p(np.maximum(((x @ inverse) * x).sum(axis=1), 0.0))

    def add(self, x: np.ndarray):
        u = self.inverse @ x
        self.inverse = self.inverse - np.outer(u, u) / (1.0 + x @ u)


class _FacilityLocation:
    def __init__(self, rows: DataFrame, one_task_rows: int = 0):
        self.facility = Facility(rows, one_task_rows)

    def picks(self, count: int, heads: int) -> DataFrame:
        return self.facility.picks(count, Picks(self.facility.rows.sparkSession))


def facility_picks(rows: DataFrame, count: int, one_task_rows: int) -> DataFrame:
    """`exact_picks` of facility location; sets of blocks that come apart are ordered in tasks of `one_task_rows` rows at most."""
    rows = rows.select("row_idx", F.col("embedding").cast("array<double>").alias("embedding"))
    return _FacilityLocation(rows, one_task_rows).picks(count, HEADS)


def exact_picks(rows: DataFrame, objective: str, count: int, heads: int = HEADS) -> DataFrame:
    """(place, row_idx, gain) of the first `count` picks of a stored (row_idx, embedding), places from 0.

    Ties go to the lower row_idx. `count` must not exceed the rows. Facility location brings rows per block instead of `heads`.
    """
    rows = rows.select("row_idx", F.col("embedding").cast("array<double>").alias("embedding"))
    return {"gc": _GraphCut, "logdet": _LogDet, "fl": _FacilityLocation}[objective](rows).picks(count, heads)
