"""Greedy orders of many large groups at once, by graph cut or log-determinant: passes over rows in parts, picks made in tasks.

A cycle scores the rows of every open group where their parts lie and sends each part's best to one task per group, with a bound
on what it keeps back. There a pick is final as long as its gain beats what any row that was kept back can still have: gains
of log-determinant only shrink, those of graph cut grow by at most twice its weight times the length of the sum of the
picks since they were scored. The task holds HEAD_BYTES of vectors or a few more, whatever the group's size; a group that is not
larger is done in one cycle. Inside the task log-determinant goes on in the same way: picks are made among the best few rows
until one that was left aside may come before. Picks, and the state after them, go to the shared folder. The driver sees no row.
"""

from __future__ import annotations

from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.cluster import scratch_path, small, stored
from mixloom.config import GAIN_DIGITS, GRAPH_CUT_LAMBDA, GROUP_KEY, LOG_DET_LAMBDA
from mixloom.functions.greedy import unit_rows
from mixloom.operators.similarity import matrix, unit_vector

# Rows of a part, bytes of vectors that a group's task gets in a cycle, and rows that every part may send besides its share of
# twice that.
PART_ROWS = 16_384
HEAD_BYTES = 64 << 20
SPARE = 64
# Best rows that picks of log-determinant are made of before the task scores its other rows again.
NEAR_ROWS = 4096
STEP = 10.0**-GAIN_DIGITS


class _GraphCut:
    near_rows = None

    def __init__(self, x: np.ndarray, state: list[float]):
        self.x, self.pull, self.sum = x, np.array(state), np.zeros(len(state))
        self.gain = x @ self.pull - GRAPH_CUT_LAMBDA * (x * x).sum(axis=1)

    def keep(self, rows: np.ndarray) -> None:
        self.x, self.gain = self.x[rows], self.gain[rows]

    def add(self, j: int) -> None:
        self.sum += self.x[j]
        self.gain -= 2.0 * GRAPH_CUT_LAMBDA * (self.x @ self.x[j])

    def grown(self) -> float:
        return 2.0 * GRAPH_CUT_LAMBDA * float(np.sqrt(self.sum @ self.sum))

    def state(self) -> np.ndarray:
        return self.pull - 2.0 * GRAPH_CUT_LAMBDA * self.sum


class _LogDet:
    near_rows = NEAR_ROWS

    def __init__(self, x: np.ndarray, state: list[float]):
        width = x.shape[1]
        self.x, self.added = x, []
        self.inverse = np.array(state).reshape(width, width) if state else np.eye(width) / LOG_DET_LAMBDA
        self.spread = np.maximum(((x @ self.inverse) * x).sum(axis=1), 0.0)
        self.gain = np.log(LOG_DET_LAMBDA) + np.log1p(self.spread)

    def keep(self, rows: np.ndarray) -> None:
        self.x, self.spread, self.gain = self.x[rows], self.spread[rows], self.gain[rows]

    def near(self, rows: np.ndarray) -> _LogDet:
        """Some of the rows, in the same state."""
        made = copy(self)
        made.added = []
        made.keep(rows)
        return made

    def add(self, j: int) -> None:
        u = self.inverse @ self.x[j]
        u /= np.sqrt(1.0 + self.x[j] @ u)
        self._lower((self.x @ u) ** 2)
        self.inverse = self.inverse - np.outer(u, u)
        self.added.append(u)

    def follow(self, made: _LogDet) -> None:
        """Come to the state of `made`, which picks were added to."""
        along = self.x @ np.array(made.added).T
        self._lower(np.einsum("ij,ij->i", along, along))
        self.inverse = made.inverse

    def _lower(self, by: np.ndarray) -> None:
        self.spread = np.maximum(self.spread - by, 0.0)
        self.gain = np.log(LOG_DET_LAMBDA) + np.log1p(self.spread)

    def grown(self) -> float:
        return 0.0

    def state(self) -> np.ndarray:
        return self.inverse.ravel()


SCORED = {"gc": _GraphCut, "logdet": _LogDet}


def sure_picks(scored, ids: np.ndarray, count: int, kept_back: float) -> tuple[list[int], list[float]]:
    """row_idx and gains of the next picks, `count` at most, that no row with a gain up to `kept_back` can come before.

    `ids` ascend, so the first of equal gains wins. The first pick is always sure: what is kept back comes after it. `scored` is
    in the state after the picks.
    """
    if scored.near_rows is None or scored.near_rows >= len(ids):
        return _picks_among(scored, ids, count, kept_back)
    rows: list[int] = []
    gains: list[float] = []
    free = np.ones(len(ids), bool)
    while len(rows) < count and free.any():
        rounded = np.where(free, np.round(scored.gain, GAIN_DIGITS), -np.inf)
        if rows and rounded.max() <= kept_back + 2.0 * STEP:
            break
        # Of equal gains those with lower ids are near.
        least = -np.inf
        near = np.flatnonzero(free)
        if len(near) > scored.near_rows:
            least = -np.partition(-rounded, scored.near_rows)[scored.near_rows]
            near = np.flatnonzero(rounded > least)
            equal = np.flatnonzero(rounded == least)[: scored.near_rows - len(near)]
            near = np.sort(np.concatenate([near, equal]))
        among = scored.near(near)
        found, made = _picks_among(among, ids[near], count - len(rows), max(kept_back, float(least)))
        rows += found
        gains += made
        scored.follow(among)
        free[np.searchsorted(ids, found)] = False
        if 2 * free.sum() < len(ids):
            scored.keep(free)
            ids, free = ids[free], np.ones(free.sum(), bool)
    return rows, gains


def _picks_among(scored, ids: np.ndarray, count: int, kept_back: float) -> tuple[list[int], list[float]]:
    rows: list[int] = []
    gains: list[float] = []
    free = np.ones(len(ids), bool)
    left = len(ids)
    while left and len(rows) < count:
        rounded = np.where(free, np.round(scored.gain, GAIN_DIGITS), -np.inf)
        j = int(rounded.argmax())
        if rows and rounded[j] <= kept_back + scored.grown() + 2.0 * STEP:
            break
        rows.append(int(ids[j]))
        gains.append(float(scored.gain[j]))
        free[j] = False
        left -= 1
        scored.add(j)
        if 2 * left < len(ids):
            scored.keep(free)
            ids, free = ids[free], np.ones(left, bool)
    return rows, gains


def group_picks(rows: DataFrame, objective: str, part_rows: int = PART_ROWS, head_rows: int | None = None) -> DataFrame:
    """(group..., place, row_idx, gain) of every group of a stored (group..., row_idx, embedding, quota), places from 0.

    All rows of a group are picked, or as many as its quota says. Ties go to the lower row_idx, which is unique in a group.
    `head_rows` overrides how many rows of HEAD_BYTES a group's task gets.
    """
    spark, keys = rows.sparkSession, list(GROUP_KEY)
    if head_rows is None:
        first = rows.select(F.size("embedding")).head()
        head_rows = HEAD_BYTES // (8 * max(1, first[0] if first else 1))
    make = SCORED[objective]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    group = ", ".join(f"{c} {types[c]}" for c in keys)
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.max("quota").alias("_quota"))
    shape = stored(
        counted.select(
            *keys,
            F.least("_rows", F.coalesce("_quota", "_rows")).cast("bigint").alias("_wanted"),
            F.ceil(F.col("_rows") / part_rows).cast("int").alias("_parts"),
        )
    )
    part = F.pmod(F.xxhash64("row_idx"), F.col("_parts")).cast("int").alias("_part")
    dealt = rows.select(*keys, F.col("row_idx").cast("bigint").alias("row_idx"), "embedding").join(small(shape), keys)
    dealt = dealt.select(*keys, part, "row_idx", "embedding")
    if objective == "gc":
        pull = vector_to_array(Summarizer.sum(array_to_vector(unit_vector()))).alias("_state")
        first = rows.groupBy(*keys).agg(pull)
    else:
        first = rows.select(*keys).distinct().withColumn("_state", F.array().cast("array<double>"))
    states = stored(first.withColumn("_done", F.lit(0).cast("bigint")))

    heads_shape = f"{group}, row_idx bigint, embedding {types['embedding']}, _floor double"
    picks_shape = f"{group}, place bigint, row_idx bigint, gain double, _state array<double>"
    no_heads, no_picks = (spark.createDataFrame([], s).toArrow().schema.empty_table() for s in (heads_shape, picks_shape))

    def best(part: pa.Table, known: pa.Table) -> pa.Table:
        state = known.filter(pc.is_valid(known["r_state"]))
        part = part.sort_by("row_idx")
        taken = known["r_taken"].drop_null().to_numpy()
        if len(state) and len(part) and len(taken):
            part = part.filter(pa.array(~np.isin(part["row_idx"].to_numpy(), taken)))
        if not len(state) or not len(part):
            return no_heads
        parts = state["r_parts"][0].as_py()
        share = len(part) if parts == 1 else -(-2 * head_rows // parts) + SPARE
        gain = make(unit_rows(matrix(part["embedding"], part["row_idx"])), state["r_state"][0].as_py()).gain
        order = np.lexsort((part["row_idx"].to_numpy(), -np.round(gain, GAIN_DIGITS)))[: share + 1]
        sent = part.select([*keys, "row_idx", "embedding"]).take(pa.array(order[:share]))
        # What a part keeps back is at most its first row that is not sent.
        floor = float(gain[order[share]]) if len(order) > share else -np.inf
        return sent.append_column("_floor", pa.array(np.full(len(sent), floor)))

    def commit(heads: pa.Table, state: pa.Table) -> pa.Table:
        if not len(heads) or not len(state):
            return no_picks
        heads = heads.sort_by("row_idx")
        kept_back = float(np.round(heads["_floor"].to_numpy().max(), GAIN_DIGITS))
        done, wanted = state["r_done"][0].as_py(), state["r_wanted"][0].as_py()
        scored = make(unit_rows(matrix(heads["embedding"], heads["row_idx"])), state["r_state"][0].as_py())
        ids, gains = sure_picks(scored, heads["row_idx"].to_numpy(), wanted - done, kept_back)
        made = heads.select(keys).slice(0, 1).take(pa.array(np.zeros(len(ids), np.int64)))
        made = made.append_column("place", pa.array(np.arange(done, done + len(ids))))
        made = made.append_column("row_idx", pa.array(ids, pa.int64())).append_column("gain", pa.array(gains, pa.float64()))
        after = [None] * (len(ids) - 1) + [scored.state().tolist()]
        return made.append_column("_state", pa.array(after, pa.list_(pa.float64())))

    path, since = scratch_path(spark, "picks"), None
    open_rows, taken_rows = rows.count(), 0
    renamed = [F.col(c).alias(f"r_{c}") for c in keys]
    r_keys = [f"r_{c}" for c in keys]
    while True:
        open_ = states.join(small(shape), keys).where("_done < _wanted")
        if open_.isEmpty():
            break
        every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("r_part")
        known = open_.select(*renamed, every, F.col("_state").alias("r_state"), F.col("_parts").alias("r_parts"), F.lit(None).cast("bigint").alias("r_taken"))
        if since is not None:
            gone = since.join(small(shape), keys).select(
                *renamed, part.alias("r_part"), F.lit(None).cast("array<double>").alias("r_state"), F.lit(None).cast("int").alias("r_parts"),
                F.col("row_idx").alias("r_taken"),
            )
            known = known.unionByName(gone)
        found = dealt.groupBy(*keys, "_part").cogroup(known.groupBy(*r_keys, "r_part")).applyInArrow(best, heads_shape)
        given = open_.select(*renamed, F.col("_state").alias("r_state"), F.col("_done").alias("r_done"), F.col("_wanted").alias("r_wanted"))
        made = stored(found.groupBy(*keys).cogroup(given.groupBy(*r_keys)).applyInArrow(commit, picks_shape))
        narrow = made.select(*keys, "place", "row_idx", "gain")
        narrow.write.mode("append").parquet(path)
        states = made.where("_state IS NOT NULL").select(*keys, "_state", (F.col("place") + 1).alias("_done"))
        since = narrow if since is None else stored(since.unionByName(narrow))
        taken_rows += made.count()
        if 2 * taken_rows >= open_rows:
            # Half of the rows have no part in later cycles; nor have those of groups that are done.
            undone = states.join(small(shape), keys).where("_done < _wanted").select(*keys)
            if undone.isEmpty():
                break
            dealt = dealt.join(small(stored(undone)), keys, "left_semi")
            dealt = stored(dealt.join(since.select(*keys, "row_idx"), [*keys, "row_idx"], "left_anti").select(*dealt.columns))
            open_rows, taken_rows, since = dealt.count(), 0, None
    return spark.read.schema(f"{group}, place bigint, row_idx bigint, gain double").parquet(path)
