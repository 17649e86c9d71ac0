"""Checks of inputs and of intermediate results, as data or as errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.config import ROW_KEY, TASK_KEY, MixtureConfig
from mixloom.operators.prepare import known_templates

INSTANCE_COLUMNS = ("submixture", "row_idx", "task_name", "template_type", "inputs", "targets")
PAIR_COLUMNS = ("prompt", "response")


def require_columns(df: DataFrame, columns: Sequence[str] = INSTANCE_COLUMNS) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def violations(
    df: DataFrame,
    cfg: MixtureConfig,
    not_null: Sequence[str] = ("submixture", "row_idx", "task_name"),
    contents: Sequence[str] = ("inputs", "targets", "embedding"),
) -> DataFrame:
    """(rule, violations) of the instances under the settings.

    Nulls of `not_null` and of those `contents` that there are, vectors of another width than most wide ones or with a value
    that is null, infinite or not a number, and rows
    whose (submixture, row_idx) an earlier row has. Tasks and row keys are counted exactly by group-bys with partial
    aggregation, then summed up.
    """
    require_columns(df, not_null)
    checked = [*not_null, *(c for c in contents if c in df.columns and c not in not_null)]
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in checked]
    parts = [df.agg(*nulls)]
    if "embedding" in checked:
        widths = df.where(F.col("embedding").isNotNull()).groupBy(F.size("embedding").alias("width")).count()
        odd = F.coalesce(F.sum("count") - F.max("count"), F.lit(0)).alias("ragged_embedding")
        parts.append(widths.agg(odd))
        odd = F.exists(F.col("embedding"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
        parts.append(df.agg(F.count_if(odd).alias("not_finite_embedding")))
    keys = df.groupBy(*ROW_KEY).agg((F.count(F.lit(1)) - 1).alias("more"))
    parts.append(keys.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("repeated_row")))
    known = known_templates(df.select(*TASK_KEY, "template_type")).groupBy(*TASK_KEY).count()
    sizes = known.agg(F.count(F.lit(1)).alias("tasks"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows"))
    bounds = sizes.select(
        (F.lit(cfg.num_tasks) >= F.col("tasks")).cast("bigint").alias("num_tasks"),
        (F.lit(cfg.num_instances) > F.col("rows")).cast("bigint").alias("num_instances"),
    )
    result = _long(bounds)
    for part in parts:
        result = result.unionAll(_long(part))
    return result


def refuse_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`df` with columns that fail on a null as soon as they are read, naming the row: a check without a scan."""

    def sure(c: str):
        row = F.concat_ws(" row ", F.col("submixture"), F.col("row_idx").cast("string"))
        return F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit(f"null {c} in "), row))).otherwise(F.col(c))

    return df.withColumns({c: sure(c) for c in columns if c in df.columns})


def _long(row: DataFrame) -> DataFrame:
    return row.unpivot([], row.columns, "rule", "violations")


def validate(df: DataFrame, cfg: MixtureConfig, **kw) -> DataFrame:
    """`df` itself, or an error that names the broken rules."""
    broken = violations(df, cfg, **kw).where("violations > 0").collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['violations']}" for r in sorted(broken)))
    return df


def feasibility(picks: DataFrame, totals: DataFrame, num_instances: int) -> DataFrame:
    """(available, wanted, feasible): do the picked tasks hold enough rows?"""
    held = totals.select(*TASK_KEY, "total").join(picks.select(*TASK_KEY), list(TASK_KEY), "left_semi")
    return held.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("available")).select(
        "available",
        F.lit(num_instances).cast("bigint").alias("wanted"),
        (F.col("available") >= num_instances).alias("feasible"),
    )


def conservation(budgets: DataFrame, split: DataFrame) -> DataFrame:
    """(task_sum, template_sum, conserved) of task budgets and their template budgets."""
    sides = budgets.select(F.col("budget").alias("task"), F.lit(0).alias("template")).unionAll(
        split.select(F.lit(0), F.col("budget"))
    )
    return sides.agg(
        F.sum("task").alias("task_sum"), F.sum("template").alias("template_sum")
    ).withColumn("conserved", F.col("task_sum") == F.col("template_sum"))


def size_check(train: DataFrame, num_instances: int) -> DataFrame:
    """(rows, wanted, complete) of the train split."""
    return train.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(num_instances).cast("bigint").alias("wanted"),
        (F.col("rows") == num_instances).alias("complete"),
    )


def require(check: DataFrame, flag: str, message: str) -> None:
    """Raise unless the one-row `check` holds."""
    row = check.head()
    if not row[flag]:
        raise ValueError(f"{message}: {row.asDict()}")
