"""Cosine similarity by blocks: rows meet in cells of a block grid, never by a cross join.

A cell holds two bounded blocks and does one matrix product. `cosine_pairs` emits the kernel of
the tasks, which is its result; inside groups of instances `group_similarity` reduces every cell
to per-row sums, so that pairs of instances are never emitted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from mixloom.cluster import small, stored
from mixloom.config import GROUP_KEY
from mixloom.functions.greedy import unit_rows
from mixloom.operators.prepare import known_templates

BLOCK_ROWS = 2048
# Rows around which blocks form; more parts of one pivot's rows than there can be; an angle within which a bound is not trusted.
PIVOTS = 64
MOST_PARTS = 1 << 32
MARGIN = 1e-6
# Blocks that a group is cut into at least before they are filled beyond what the caller asks, up to BLOCK_ROWS.
FULL_BLOCKS = 16
# Vectors, or lists of blocks, that may be broadcast.
VECTOR_ROWS = 16_384
# Rows of a block that go to cells without regard to angles, and side of the products that a cell makes one by one.
GRID_ROWS = 8192
SIDE = 512


def matrix(column: pa.ChunkedArray, rows: pa.ChunkedArray | None = None) -> np.ndarray:
    """A list column of equal lengths as a 2-d array; `rows` names the rows in errors.

    A null vector, a null inside one or a length of its own is an error: flattened, it would shift all rows after it. So is a
    value that is infinite or not a number, which has no place in an order of gains.
    """
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    usual = np.bincount(lengths[lengths > 0]).argmax() if (lengths > 0).any() else 0
    odd = np.flatnonzero((lengths != usual) | (lengths < 0))
    if flat.null_count and not len(odd):
        odd = np.flatnonzero(np.add.reduceat(flat.is_null().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths))
    if len(odd):
        named = [rows[int(i)].as_py() if rows is not None else int(i) for i in odd[:5]]
        raise ValueError(f"embeddings must be whole vectors of one width; {len(odd)} are not, e.g. of rows {named}")
    made = flat.to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    # A sum is finite only if all of its values are.
    odd = np.flatnonzero(~np.isfinite(made.sum(axis=1, dtype=np.float64)))
    odd = odd[~np.isfinite(made[odd]).all(axis=1)]
    if len(odd):
        named = [rows[int(i)].as_py() if rows is not None else int(i) for i in odd[:5]]
        raise ValueError(f"embeddings must be finite; {len(odd)} are not, e.g. of rows {named}")
    return made


def _grid(df: DataFrame, keys: list[str], block: Column, blocks: Column, carry: list[str]):
    """Two copies of the rows: block b of the left ones goes to cells (b, *), of the right to (*, b)."""
    rows = df.select(*keys, *carry, block.cast("int").alias("_b"), blocks.cast("int").alias("_n"))
    every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    left = rows.select(*keys, *carry, F.col("_b").alias("_left"), every.alias("_right"))
    # New names tell the right copy's columns from the left's, which come from the same rows.
    renamed = [F.col(c).alias(f"r_{c}") for c in (*keys, *carry)]
    right = rows.select(*renamed, every.alias("r_left"), F.col("_b").alias("r_right"))
    right_cell = [f"r_{c}" for c in (*keys, "left", "right")]
    return left.groupBy(*keys, "_left", "_right").cogroup(right.groupBy(*right_cell))


def cosine_pairs(tasks: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Kernel of the task vectors as (i, j, s) over `task_pos`; a zero vector is similar to none."""
    last = tasks.agg(F.max("task_pos")).head()[0] or 0

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        s = unit_rows(matrix(left["embedding"])) @ unit_rows(matrix(right["r_embedding"])).T
        i, j = left["task_pos"].to_numpy(), right["r_task_pos"].to_numpy()
        return pa.table(
            {"i": pa.array(np.repeat(i, len(j)), pa.int64()), "j": pa.array(np.tile(j, len(i)), pa.int64()), "s": s.ravel()}
        )

    grid = _grid(
        tasks, [], F.floor(F.col("task_pos") / block_rows), F.lit(last // block_rows + 1), ["task_pos", "embedding"]
    )
    return grid.applyInArrow(cell, "i bigint, j bigint, s double")


def unit_vector(column: str = "embedding") -> Column:
    """The vector at length one, as doubles; a zero vector stays zero."""
    values = F.col(column).cast("array<double>")
    length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(values, lambda v: F.when(length > 0, v / length).otherwise(F.lit(0.0)))


def similarity_sums(df: DataFrame, keys: Sequence[str] = GROUP_KEY) -> DataFrame:
    """(group..., row_idx, sim_sum): each row's similarity to all rows of its group.

    The sum of x . y over y is x . (sum of y): one aggregate per group and one join with it, linear in the rows.
    """
    keys = list(keys)
    rows = known_templates(df) if "template_type" in keys else df
    rows = rows.select(*keys, "row_idx", unit_vector().alias("_unit"))
    totals = rows.groupBy(*keys).agg(vector_to_array(Summarizer.sum(array_to_vector("_unit"))).alias("_total"))
    product = F.aggregate(F.arrays_zip("_unit", "_total"), F.lit(0.0), lambda a, p: a + p["_unit"] * p["_total"])
    return rows.join(small(stored(totals)), keys).select(*keys, "row_idx", product.alias("sim_sum"))


def _positive_cells(spread: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """(group..., row_idx, _positive) of every cell, for rows (..., embedding, _b, _low, _high) sent to cells of two blocks.

    Similarities are symmetric, so a cell serves the rows of both its blocks.
    """

    def cell(rows: pa.Table) -> pa.Table:
        x = unit_rows(matrix(rows["embedding"], rows["row_idx"]))
        low = np.flatnonzero(rows["_b"].to_numpy() == rows["_low"][0].as_py())
        one = rows["_low"][0].as_py() == rows["_high"][0].as_py()
        high = low if one else np.setdiff1d(np.arange(len(x)), low)
        sums = np.zeros(len(x))
        for start in range(0, len(low), SIDE):
            own = low[start : start + SIDE]
            for first in range(start if one else 0, len(high), SIDE):
                other = high[first : first + SIDE]
                s = np.maximum(x[own] @ x[other].T, 0.0)
                sums[own] += s.sum(axis=1)
                if not one or first > start:
                    sums[other] += s.sum(axis=0)
        return rows.select([*keys, "row_idx"]).append_column("_positive", pa.array(sums))

    return spread.groupBy(*keys, "_low", "_high").applyInArrow(cell, f"{schema}, _positive double")


def nearest_pivots(rows: DataFrame, keys: list[str], count: int = PIVOTS) -> DataFrame:
    """`rows` with `_pivot`, the nearest of `count` rows that their hash chooses; -1 for a zero vector, which is near to none."""
    chosen = rows.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64(*keys, "row_idx"), *keys, "row_idx")
    chosen = chosen.select("row_idx", "embedding").limit(count).toArrow()
    pivots = unit_rows(matrix(chosen["embedding"], chosen["row_idx"]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                x = unit_rows(matrix(table["embedding"], table["row_idx"]))
                near = np.where(x.any(axis=1), (x @ pivots.T).argmax(axis=1), -1)
                yield from table.append_column("_pivot", pa.array(near, pa.int32())).to_batches()

    return rows.mapInArrow(assign, StructType([*rows.schema.fields, StructField("_pivot", IntegerType())]))


def blocks_of(rows: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """Stored rows with their `_block`: those with one nearest pivot lie together, in as many blocks as `block_rows` asks for,
    or, where rows have it, their group's own `_block_rows`."""
    own = "_block_rows" in rows.columns
    near = stored(nearest_pivots(rows, keys))
    by = [*keys, "_pivot"]
    filled = F.first("_block_rows") if own else F.lit(block_rows)
    parts = near.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / filled).alias("_parts"))
    near = near.drop("_block_rows")
    part = F.pmod(F.xxhash64("row_idx"), F.col("_parts"))
    block = (F.col("_pivot").cast("bigint") * MOST_PARTS + part).cast("bigint")
    return near.join(small(stored(parts)), by).withColumn("_block", block).drop("_parts")


def block_bounds(blocked: DataFrame, keys: list[str], schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(group..., _block, _open, _linear), stored, a few per block: what its rows meet in the other blocks of the group.

    All rows of a block lie within an angle of its centroid. Where these angles keep two blocks on one side of the right angle,
    all of their similarities are positive, and the sum with a whole block is a product with its `_linear` total, or none is.
    `_open` lists the blocks of which neither is known.
    """

    def measure(rows: pa.Table) -> pa.Table:
        x = unit_rows(matrix(rows["embedding"], rows["row_idx"]))
        total = x.sum(axis=0)
        length = np.sqrt(total @ total)
        radius = np.arccos(np.clip((x @ (total / length)).min(), -1, 1)) if length > 0 else np.pi
        made = rows.select([*keys, "_block"]).slice(0, 1)
        made = made.append_column("_total", pa.array([total.tolist()], pa.list_(pa.float64())))
        return made.append_column("_radius", pa.array([float(radius)]))

    measured = stored(
        blocked.groupBy(*keys, "_block").applyInArrow(measure, f"{schema}, _block bigint, _total array<double>, _radius double")
    )
    counts = measured.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_chunks"))
    chunked = measured.join(small(stored(counts)), keys)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        made = left.select([*keys, "_block"])
        if not len(left) or not len(right):
            far, linear = [[]] * len(left), [[]] * len(left)
        else:
            totals = matrix(right["r__total"])
            angle = np.arccos(np.clip(unit_rows(matrix(left["_total"])) @ unit_rows(totals).T, -1, 1))
            reach = left["_radius"].to_numpy()[:, None] + right["r__radius"].to_numpy()
            positive = angle + reach <= np.pi / 2 - MARGIN
            unknown = ~positive & (angle - reach < np.pi / 2 + MARGIN)
            others = right["r__block"].to_numpy()
            far = [others[row].tolist() for row in unknown]
            linear = (positive.astype(np.float64) @ totals).tolist()
        made = made.append_column("_open", pa.array(far, pa.list_(pa.int64())))
        return made.append_column("_linear", pa.array(linear, pa.list_(pa.float64())))

    chunk = F.pmod(F.xxhash64("_block"), F.col("_chunks"))
    grid = _grid(chunked, keys, chunk, F.col("_chunks"), ["_block", "_total", "_radius"])
    return stored(grid.applyInArrow(compare, f"{schema}, _block bigint, _open array<bigint>, _linear array<double>"))


def positive_sums(df: DataFrame, keys: Sequence[str] = GROUP_KEY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(group..., row_idx, positive_sum): the positive part of each row's similarities to all rows of its group.

    Exact for any group size. A group beyond `block_rows` is cut into blocks of rows that lie together: rows meet only those
    blocks of which their angles do not tell that all similarities are positive, which is a linear sum, or none is. Blocks of a
    larger group are fuller, up to BLOCK_ROWS: a row is sent to every open block, so their number must not grow with the group.
    """
    keys = list(keys)
    rows = known_templates(df) if "template_type" in keys else df
    count = F.count(F.lit(1))
    filled = F.greatest(F.lit(block_rows).cast("bigint"), F.least(F.lit(BLOCK_ROWS).cast("bigint"), F.ceil(count / FULL_BLOCKS)))
    sizes = stored(rows.groupBy(*keys).agg(filled.alias("_block_rows"), F.ceil(count / filled).alias("_n")))
    sized = rows.select(*keys, "row_idx", "embedding").join(small(sizes), keys)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    group = ", ".join(f"{c} {types[c]}" for c in keys)
    schema = f"{group}, row_idx {types['row_idx']}"
    alone = sized.where("_n = 1").drop("_n", "_block_rows").withColumns({c: F.lit(0) for c in ("_b", "_low", "_high")})
    found = _positive_cells(alone, keys, schema)
    if not sizes.where("_n > 1").isEmpty():
        blocked = blocks_of(sized.where("_n > 1").drop("_n"), keys, block_rows)
        nothing = blocked.where("_pivot < 0").select(*keys, "row_idx", F.lit(0.0).alias("_positive"))
        blocked = blocked.where("_pivot >= 0").drop("_pivot")
        bounds = block_bounds(blocked, keys, group)
        by = [*keys, "_block"]
        linear = bounds.where(F.size("_linear") > 0).groupBy(*by)
        linear = linear.agg(vector_to_array(Summarizer.sum(array_to_vector("_linear"))).alias("_linear"))
        product = F.aggregate(F.arrays_zip(unit_vector().alias("_unit"), "_linear"), F.lit(0.0), lambda a, p: a + p["_unit"] * p["_linear"])
        sums = blocked.join(small(stored(linear), limit=VECTOR_ROWS), by).select(*keys, "row_idx", product.alias("_positive"))
        spread = blocked.join(small(bounds.select(*by, "_open"), limit=VECTOR_ROWS), by)
        spread = spread.withColumn("_other", F.explode("_open")).select(
            *keys, "row_idx", "embedding", F.col("_block").alias("_b"),
            F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"),
        )
        found = found.unionByName(nothing).unionByName(sums).unionByName(_positive_cells(spread, keys, schema))
    return found.groupBy(*keys, "row_idx").agg(F.sum("_positive").alias("positive_sum"))


def grid_sums(rows: DataFrame, keys: Sequence[str], block_rows: int = GRID_ROWS) -> DataFrame:
    """`positive_sums` of stored rows, by cells of all pairs of even blocks.

    A row goes to as many cells as its group has blocks, so full blocks send it to few; where angles tell nothing, as of vectors
    of many columns, this is what remains to be done, and the pivots of `positive_sums` send every row to more cells.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, "row_idx"))
    sizes = stored(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_n")))
    sized = rows.select(*keys, "row_idx", "embedding").join(small(sizes), keys)
    block = F.pmod(F.xxhash64("row_idx"), F.col("_n")).cast("int")
    spread = sized.select(
        *keys, "row_idx", "embedding", block.alias("_b"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_other")
    ).withColumns({"_low": F.least("_b", "_other"), "_high": F.greatest("_b", "_other")})
    found = _positive_cells(spread.drop("_other"), keys, schema)
    return found.groupBy(*keys, "row_idx").agg(F.sum("_positive").alias("positive_sum"))


def group_similarity(
    df: DataFrame, keys: Sequence[str] = GROUP_KEY, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Per row, its similarity to all rows of its group: the sum, and the sum of the positive part."""
    keys = [*keys, "row_idx"]
    return similarity_sums(df, keys[:-1]).join(positive_sums(df, keys[:-1], block_rows), keys)
