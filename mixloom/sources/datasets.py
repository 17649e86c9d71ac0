"""Reading sources and prepared datasets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixloom.cluster import small, stored
from mixloom.operators.checks import PAIR_COLUMNS, require_columns
from mixloom.operators.ranking import PLACE_BITS
from mixloom.operators.selection import assemble


def load_submixtures(
    spark: SparkSession, paths: Mapping[str, str], split: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Read each named source, keep one split of it, tag its rows with the name.

    Parquet rows without a `row_idx` get their position among the rows kept: files in name order, rows in file order. A scan of
    narrow columns counts the kept rows of every piece of a file that a task reads; what lies before a piece is broadcast,
    and a row's place in it is a running count in its task, so no row is shuffled. Other formats have no row order; bring a
    `row_idx` or number the rows with `with_row_idx`.
    """
    sources = {name: spark.read.format(fmt).load(path) for name, path in paths.items()}
    kept = F.lit(True) if split is None else F.col("split") == split
    if fmt != "parquet" or any("row_idx" in rows.columns for rows in sources.values()):
        return assemble(
            (rows if split is None else rows.where(kept).drop("split")).withColumn("submixture", F.lit(name))
            for name, rows in sources.items()
        )
    located = assemble(
        rows.where(kept).select(
            F.lit(name).alias("submixture"),
            *(c for c in rows.columns if c != "split" or split is None),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_piece"),
            F.monotonically_increasing_id().alias("_id"),
        )
        for name, rows in sources.items()
    )
    piece = ["submixture", "_file", "_piece"]
    before = Window.partitionBy("submixture").orderBy("_file", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = stored(
        located.groupBy(*piece)
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .select(*piece, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    placed = located.join(small(pieces), piece)
    # Both scans must deal the pieces over tasks alike, as they do under the same settings.
    alike = F.shiftright("_id", PLACE_BITS) == F.shiftright("_first", PLACE_BITS)
    number = F.when(alike, F.col("_start") + F.col("_id") - F.col("_first"))
    number = F.coalesce(number, F.raise_error(F.lit("files were read in other pieces than they were counted")).cast("bigint"))
    return placed.withColumn("row_idx", number).drop("_file", "_piece", "_id", "_first", "_start")


def load_instruction_dataset(
    spark: SparkSession, path: str, fmt: str = "parquet"
) -> dict[str, DataFrame]:
    """A prepared dataset: both splits, each with a prompt and a response."""
    splits = {s: spark.read.format(fmt).load(f"{path}/split={s}") for s in ("train", "validation")}
    return {s: require_columns(rows, PAIR_COLUMNS) for s, rows in splits.items()}
