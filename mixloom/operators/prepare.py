"""Instances to tasks: decoding, positions, the task index and everything known per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixloom.cluster import small
from mixloom.config import GROUP_KEY, ROW_KEY, SUBMIXTURES, TASK_KEY, TEMPLATE_TYPES
from mixloom.functions.columns import ordinal
from mixloom.operators.ranking import index_bucket, positions, range_positions


def known_templates(df: DataFrame) -> DataFrame:
    """Keep the rows of the four known template types (pushed down to the scan)."""
    return df.where(F.col("template_type").isin(*TEMPLATE_TYPES))


def decode_labels(df: DataFrame, names: DataFrame, label: str = "task_label") -> DataFrame:
    """Replace the integer class label by its task name; `names` holds (submixture, label, name).

    Labels without a name keep their rows, with a null task name for `violations` to report.
    """
    lookup = names.select("submixture", F.col("label").alias(label), F.col("name").alias("task_name"))
    return df.join(small(lookup), ["submixture", label], "left").drop(label)


def with_row_idx(df: DataFrame, order: Sequence[str], name: str = "row_idx") -> DataFrame:
    """Number the rows of each submixture from 0 along `order`, which must be total; see `range_positions`.

    Sources in file order get the same numbers without a shuffle from `load_submixtures`.
    """
    return range_positions(df, ["submixture"], order, name)


def task_index(df: DataFrame) -> DataFrame:
    """Rows of each (submixture, task, template) with their place in that list, in long form.

    One row per instance, never an array: a list of a hot group would not fit into a task.
    """
    rows = known_templates(df).select(*GROUP_KEY, "row_idx")
    return positions(rows, GROUP_KEY, index_bucket(), ["row_idx"], "place")


def task_totals(df: DataFrame) -> DataFrame:
    return known_templates(df).groupBy(*TASK_KEY).agg(F.count(F.lit(1)).alias("total"))


def _count_of(template: str):
    return F.count_if(F.col("template_type") == template).alias(template)


def template_counts(df: DataFrame) -> DataFrame:
    """Rows per task in each of the four template types, 0 where there are none."""
    return known_templates(df).groupBy(*TASK_KEY).agg(*[_count_of(t) for t in TEMPLATE_TYPES])


def group_counts(counts: DataFrame) -> DataFrame:
    """Template counts in long form, without the empty groups."""
    return counts.unpivot(list(TASK_KEY), list(TEMPLATE_TYPES), "template_type", "rows").where("rows > 0")


def task_positions(df: DataFrame, submixtures: Sequence[str] = SUBMIXTURES) -> DataFrame:
    """Order of the tasks: submixtures as declared, tasks by first occurrence of any row.

    First occurrences are aggregated first; what the window sorts is one narrow row per task.
    """
    known = F.count_if(F.col("template_type").isin(*TEMPLATE_TYPES))
    tasks = df.groupBy(*TASK_KEY).agg(F.min("row_idx").alias("first_row"), known.alias("_known"))
    order = Window.orderBy(ordinal("submixture", tuple(submixtures)), "submixture", "first_row", "task_name")
    return tasks.where("_known > 0").select(
        *TASK_KEY, "first_row", (F.row_number().over(order) - 1).alias("task_pos")
    )


def task_embeddings(df: DataFrame) -> DataFrame:
    """Element-wise mean of the row embeddings of each task, not normalised again."""
    return (
        known_templates(df)
        .groupBy(*TASK_KEY)
        .agg(Summarizer.mean(array_to_vector("embedding")).alias("_mean"))
        .select(*TASK_KEY, vector_to_array("_mean").alias("embedding"))
    )


def task_profile(
    df: DataFrame, submixtures: Sequence[str] = SUBMIXTURES, vectors: bool = True
) -> DataFrame:
    """Totals, template counts, first row and mean vector of every task, in one scan.

    All of them are decomposable, so each map task sends one row per task it saw and no hot task
    is ever gathered. (submixture_ord, first_row) orders tasks like `task_positions`: rows of
    other template types count for the first occurrence only, hence the flag in the inner key.
    """
    parts = [F.min("row_idx").alias("first_row"), *[_count_of(t) for t in TEMPLATE_TYPES]]
    merged = [F.min("first_row").alias("first_row"), *[F.sum(t).alias(t) for t in TEMPLATE_TYPES]]
    if vectors:
        parts.append(Summarizer.mean(array_to_vector("embedding")).alias("_mean"))
        merged.append(F.max_by(vector_to_array("_mean"), "_known").alias("embedding"))
    total = sum((F.col(t) for t in TEMPLATE_TYPES), F.lit(0))
    return (
        df.withColumn("_known", F.col("template_type").isin(*TEMPLATE_TYPES))
        .groupBy(*TASK_KEY, "_known")
        .agg(*parts)
        .groupBy(*TASK_KEY)
        .agg(*merged)
        .withColumn("total", total)
        .where("total > 0")
        .withColumn("submixture_ord", ordinal("submixture", tuple(submixtures)))
    )


def with_embeddings(index: DataFrame, vectors: DataFrame) -> DataFrame:
    """Attach to each indexed row its embedding, stored per (submixture, row_idx)."""
    return index.join(vectors.select(*ROW_KEY, "embedding"), list(ROW_KEY))


def strip_metadata(df: DataFrame) -> DataFrame:
    return df.drop("task_source", "task_name", "template_type")


def as_pairs(df: DataFrame) -> DataFrame:
    """Name the two texts the way tuning expects them."""
    return df.withColumnsRenamed({"inputs": "prompt", "targets": "response"})
