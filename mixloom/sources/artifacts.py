"""Artifacts of the stages: written once, read when complete."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mixloom.config import GROUP_KEY, SUBMIXTURES, MixtureConfig
from mixloom.functions.columns import of_setting, whole


# Train rows of a file that `write_mixtures` writes.
FILE_ROWS = 100_000


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return None
    return rows.withColumn("submixture", F.col("submixture").cast("string"))


def _missing(rows: DataFrame | None, submixtures: Sequence[str]) -> set[str]:
    """Declared submixtures without rows; reads the partition column only."""
    if rows is None:
        return set(submixtures)
    wanted = rows.select("submixture").where(F.col("submixture").isin(*submixtures))
    return set(submixtures) - {r["submixture"] for r in wanted.distinct().collect()}


MANIFEST = "submixture string, rows bigint, inputs string, shape string"


def fingerprint(df: DataFrame) -> str:
    """What a frame holds, whatever its order and partitioning: its columns, its rows and the sum of their hashes."""
    hashed = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
    rows, total = df.agg(F.count(F.lit(1)), hashed).head()
    return f"{','.join(sorted(df.columns))}:{rows}:{total or 0}"


def _manifest(spark: SparkSession, path: str) -> list:
    try:
        return spark.read.schema(MANIFEST).parquet(path).collect()
    except AnalysisException:
        return []


def stage(
    spark: SparkSession,
    name: str,
    build: Callable[[], DataFrame],
    root: str,
    submixtures: Sequence[str] = SUBMIXTURES,
    inputs: str = "",
) -> DataFrame:
    """The stage's artifact if it is complete and was made from the same inputs, else `build()`, written first.

    A manifest names all submixtures, empty ones too, with their rows, what the inputs were (`inputs`, e.g. of `fingerprint`) and
    the columns. It is emptied before the artifact is written and filled after, so an interrupted stage is built again. Where
    nothing is known of the inputs, a submixture without rows counts as missing.
    """
    path, listed = f"{root}/{name}", f"{root}/{name}.manifest"
    manifest = _manifest(spark, listed)
    known = {r["submixture"] for r in manifest if r["rows"] or inputs}
    if set(submixtures) - known or any(r["inputs"] != inputs for r in manifest):
        spark.createDataFrame([], MANIFEST).write.mode("overwrite").parquet(listed)
        made = build()
        made.write.mode("overwrite").partitionBy("submixture").parquet(path)
        shape = StructType([*(f for f in made.schema if f.name != "submixture"), StructField("submixture", StringType())])
        done = spark.read.schema(shape).parquet(path)
        rows = {r["submixture"]: r["count"] for r in done.groupBy("submixture").count().collect()}
        names = sorted({*submixtures, *rows})
        manifest = [Row(submixture=s, rows=rows.get(s, 0), inputs=inputs, shape=shape.json()) for s in names]
        spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.mode("overwrite").parquet(listed)
    shape = StructType.fromJson(json.loads(manifest[0]["shape"]))
    return spark.read.schema(shape).parquet(path)


def write_ordering(ordering: DataFrame, objective: str, root: str) -> str:
    path = f"{root}/{objective}_ordering"
    ordering.write.mode("overwrite").partitionBy("submixture").parquet(path)
    return path


def load_ordering(
    spark: SparkSession,
    objective: str,
    root: str,
    submixtures: Sequence[str] = SUBMIXTURES,
    groups: DataFrame | None = None,
) -> DataFrame:
    """A written ordering. One that lacks a submixture or a wanted group is an error."""
    ordering = _existing(spark, f"{root}/{objective}_ordering")
    missing = _missing(ordering, submixtures)
    if missing:
        raise FileNotFoundError(f"no {objective} ordering of {', '.join(sorted(missing))}")
    if groups is not None:
        first = ordering.where("rank = 1").select(*GROUP_KEY)
        lost = groups.select(*GROUP_KEY).join(first, list(GROUP_KEY), "left_anti").head()
        if lost:
            raise FileNotFoundError(f"no {objective} ordering of {'/'.join(lost)}")
    return ordering


def write_mixture(train: DataFrame, validation: DataFrame, root: str, cfg: MixtureConfig) -> str:
    """Write both splits below a name made of the settings; train files follow the shuffled order."""
    path = f"{root}/{cfg.name}"
    ordered = train.repartitionByRange("pos").sortWithinPartitions("pos")
    ordered.write.mode("overwrite").parquet(f"{path}/split=train")
    validation.write.mode("overwrite").parquet(f"{path}/split=validation")
    return path


def dataset_names(grid: Sequence[MixtureConfig]) -> list[str]:
    """A name of its own for every setting; those that differ in nothing a name shows carry their place in the grid."""
    names: list[str] = []
    for i, cfg in enumerate(grid):
        names.append(f"{cfg.name}-{i}" if cfg.name in names else cfg.name)
    return names


def write_mixtures(train: DataFrame, validation: DataFrame, root: str, grid: Sequence[MixtureConfig]) -> list[str]:
    """Write the datasets of a sweep in one job and return their paths, in the order of the grid.

    `train` is that of `build_sweep`. A row goes to each dataset whose setting takes it. Positions are dense, so they say which
    file a row belongs to and nothing is sampled; files follow the shuffled order and hold up to FILE_ROWS rows of the sweep.
    Columns `mixture`, `split` and `pos` of the inputs are replaced; a dataset of the same name is overwritten.
    """
    names = dataset_names(grid)
    starts = [0]
    for cfg in grid:
        starts.append(starts[-1] + cfg.num_instances)
    texts = [c for c in train.columns if c not in ("taken", "config_id", "pos", "mixture", "split")]
    each = train.select(F.explode("taken").alias("_to"), *texts).select("_to.config_id", "_to.pos", *texts)
    place = (of_setting(starts).cast("bigint") + F.col("pos")).cast("bigint")
    dealt = each.repartitionById(-(-starts[-1] // FILE_ROWS), whole(place, FILE_ROWS).cast("int"))
    held_out = validation.drop("config_id", "pos", "mixture", "split")
    held_out = held_out.withColumn("config_id", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    rows = dealt.withColumn("split", F.lit("train")).unionByName(
        held_out.withColumn("split", F.lit("validation")), allowMissingColumns=True
    )
    # Names are never null, so the writer keeps this order instead of sorting again.
    named = rows.withColumn("mixture", F.coalesce(of_setting(names), F.lit(""))).drop("config_id")
    ordered = named.sortWithinPartitions("mixture", "split", "pos")
    writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("mixture", "split").parquet(root)
    paths = [f"{root}/mixture={name}" for name in names]
    if validation.isEmpty():
        # A partition without rows leaves no folder, but every dataset has both splits.
        for path in paths:
            validation.limit(0).write.mode("overwrite").parquet(f"{path}/split=validation")
    return paths


def write_metrics(metrics: DataFrame, path: str) -> str:
    """One JSON line per epoch."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
    return path
