"""Exact row positions and per-group prefixes when one group may hold a third of the data.

A plain `row_number() over (partition by group)` sorts a whole group in one task. Here a group is
cut into ordered buckets, the buckets are counted (with map-side combine), and a row's position is
the size of the buckets before its own plus its place inside it. The window then runs per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixloom.cluster import small, stored
from mixloom.functions.columns import whole

# Digests are cut by their leading hex digits: 16^3 even buckets per group.
DIGEST_DIGITS = 3
# Rows of a bucket when cutting by row_idx, which is unique and dense inside a submixture.
BUCKET_ROWS = 100_000
# Bits of `monotonically_increasing_id` that count the rows of a task.
PLACE_BITS = 33


def digest_bucket(digest: str) -> Column:
    return F.substring(F.col(digest), 1, DIGEST_DIGITS)


def index_bucket(row_idx: str = "row_idx") -> Column:
    return whole(F.col(row_idx), BUCKET_ROWS)


def positions(
    df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str | Column], name: str = "pos"
) -> DataFrame:
    """Add the 0-based position of each row in its group.

    `bucket` must not decrease along `order`, and `order` must be total inside a group. `df` is
    read twice (once for the counts, which need only keys), so pass a scan or a stored frame.
    """
    by = list(by)
    tagged = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        tagged.groupBy(*by, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*by, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    return (
        tagged.join(starts, [*by, "_bucket"])
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_start")
    )


def leading_rows(
    df: DataFrame,
    quotas: DataFrame,
    by: Sequence[str],
    bucket: Column,
    order: Sequence[str | Column],
    groups_bound: int | None = None,
) -> DataFrame:
    """The first `quota` rows of each group; `quotas` holds (by..., quota) with quota >= 1.

    Counting buckets tells the one bucket in which a group's quota ends. Rows beyond it are
    dropped by a filter on the scan side, so about as many rows are shuffled as are returned.
    `groups_bound` is a proven bound on the rows of `quotas`.
    """
    by = list(by)
    tagged = df.withColumn("_bucket", bucket)
    upto = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        tagged.join(small(quotas, groups_bound), by)
        .groupBy(*by, "quota", "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_left", F.col("quota") - F.coalesce(F.sum("_rows").over(upto), F.lit(0)))
        .where("_left > 0")
        .groupBy(*by)
        .agg(F.max("_bucket").alias("_last"), F.max_by("_left", "_bucket").alias("_left"))
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    return (
        tagged.join(small(last, groups_bound), by)
        .where("_bucket <= _last")
        .withColumn("_place", F.row_number().over(inside))
        .where("_bucket < _last OR _place <= _left")
        .drop("_bucket", "_last", "_left", "_place")
    )


def range_positions(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """Add the 0-based position of each row in its group along columns of any type and distribution.

    The rows are dealt over tasks by sampled ranges of (by..., order...) and stored, so no task gets more than its share,
    however the values lie; ties of all these columns stay together and get some order. A row's position is its place in
    its task, plus the rows of its group in the tasks before. Pass narrow rows and join wide ones afterwards.
    """
    by, order = list(by), list(order)
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt = stored(dealt.withColumn("_id", F.monotonically_increasing_id()))
    task = F.shiftright("_id", PLACE_BITS).alias("_task")
    before = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*by, task)
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .select(*by, "_task", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    )
    keyed = dealt.withColumn("_task", task)
    same = F.lit(True)
    starts = starts.withColumnsRenamed({c: f"_by_{c}" for c in [*by, "_task"]})
    for c in [*by, "_task"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    placed = keyed.join(small(stored(starts)), same)
    return placed.withColumn(name, F.col("_id") + F.col("_shift")).select(*df.columns, name)
