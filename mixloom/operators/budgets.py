"""Exact integer budgets: gains to task budgets, task budgets to template budgets.

Budget frames hold one row per picked task (and setting, in a sweep), so their windows sort at
most `num_tasks` rows; `by` names the columns that separate settings.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixloom.cluster import small
from mixloom.config import GAIN_DIGITS, TASK_KEY, TEMPLATE_TYPES


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def taylor_softmax(
    df: DataFrame, by: Sequence[str] = (), order: int = 2, temperature: float = 1.0, log: bool = False
) -> DataFrame:
    """Add `prob`, proportional to the Taylor polynomial of exp(gain / temperature)."""
    if order < 2 or order % 2:
        raise ValueError("the Taylor order must be even and positive")
    x = F.col("gain") / temperature
    # x^k / k! for k = 0..order
    terms = [F.lit(1.0)]
    for k in range(1, order + 1):
        terms.append(terms[-1] * x / float(k))
    weight = reduce(lambda a, b: a + b, terms)
    share = weight / F.sum(weight).over(Window.partitionBy(*by))
    return df.withColumn("prob", F.log(share) if log else share)


def budget_split(
    df: DataFrame, total: Column, ratio: str, order: str, by: Sequence[str] = (), name: str = "budget"
) -> DataFrame:
    """Split the integer `total` by `ratio`; the leftover goes +1 to the first parts in `order`.

    Quotients are rounded at the ninth digit before the floor, so noise of the ratio's sum cannot
    push an exact quotient below its integer.
    """
    everyone = Window.partitionBy(*by)
    exact = total.cast("double") * F.col(ratio) / F.sum(ratio).over(everyone)
    parts = df.withColumn("_part", F.floor(F.round(exact, GAIN_DIGITS)).cast("bigint"))
    left = total.cast("bigint") - F.sum("_part").over(everyone)
    extra = F.row_number().over(everyone.orderBy(order)) <= left
    return parts.withColumn(name, F.col("_part") + extra.cast("bigint")).drop("_part")


def cap_redistribute(
    df: DataFrame,
    order: str = "pick",
    by: Sequence[str] = (),
    budget: str = "budget",
    cap: str = "total",
) -> DataFrame:
    """Clip budgets at their caps; the excess goes +1 per pass, in order, to parts with room.

    Closed form of those passes: filling rises evenly over all rooms, so there is one water level
    L; every part gains min(L, room) and the first few parts with more room gain one more.
    """
    group = Window.partitionBy(*by)
    rising = group.orderBy(F.col("_room") <= 0, "_room", order)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    kept = F.least(budget, cap)
    ranked = df.withColumns({"_kept": kept, "_room": F.col(cap) - kept}).withColumns(
        {
            "_excess": F.sum(F.col(budget) - F.col("_kept")).over(group),
            "_rooms": F.count_if(F.col("_room") > 0).over(group),
            "_nth": F.row_number().over(rising),
            "_below": F.coalesce(F.sum("_room").over(before), F.lit(0)),
        }
    )
    fuller = F.col("_rooms") - F.col("_nth") + 1
    missing = F.col("_excess") - F.col("_below")
    reaches = (F.col("_room") > 0) & (F.col("_room") * fuller >= missing)
    # The first room, rising, that holds the level; `_below` rises along.
    level = F.struct("_below", _div(missing, fuller).alias("level"), (missing % F.nullif(fuller, F.lit(0))).alias("rest"))
    filled = ranked.withColumn("_level", F.min(F.when(reaches, level)).over(group))
    more = F.coalesce(F.col("_room") > F.col("_level.level"), F.lit(False))
    turn = F.count_if(more).over(group.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    # Without a level the excess exceeds all rooms: everything is filled up.
    even = F.least(F.coalesce(F.col("_level.level"), F.col("_room")), F.col("_room"))
    extra = F.coalesce((more & (turn <= F.col("_level.rest"))).cast("bigint"), F.lit(0))
    return filled.withColumn(budget, F.col("_kept") + even + extra).drop(
        "_kept", "_room", "_excess", "_rooms", "_nth", "_below", "_level"
    )


def zero_fill(tasks: DataFrame, budgets: DataFrame, budget_rows: int | None = None) -> DataFrame:
    """Budgets of all tasks: 0 where none was given. `budget_rows` bounds the rows of `budgets`."""
    given = budgets.select(*TASK_KEY, "budget")
    return tasks.join(small(given, budget_rows), list(TASK_KEY), "left").withColumn(
        "budget", F.coalesce("budget", F.lit(0))
    )


def task_budgets(
    picks: DataFrame,
    totals: DataFrame,
    num_instances: int,
    order: int = 2,
    temperature: float = 1.0,
    picks_bound: int | None = None,
) -> DataFrame:
    """(pick, task..., gain, total, prob, budget) of the picked tasks."""
    sized = totals.select(*TASK_KEY, "total").join(small(picks, picks_bound), list(TASK_KEY))
    shares = taylor_softmax(sized, order=order, temperature=temperature)
    split = budget_split(shares, F.lit(num_instances), "prob", "pick")
    return cap_redistribute(split)


def _split2(total: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """`budget_split` of two parts in integers; parts never exceed a and b if total <= a + b.

    Decimals keep total * a exact where both are in the billions.
    """
    wide = total.cast("decimal(18,0)") * a.cast("decimal(18,0)")
    both = (a + b).cast("decimal(18,0)")
    first = F.coalesce(_div(wide + both - 1, both), F.lit(0))
    return first, F.when(a + b > 0, total - first).otherwise(F.lit(0))


def template_budgets(budgets: DataFrame, counts: DataFrame, budget_rows: int | None = None) -> DataFrame:
    """(task..., template_type, rows, budget) from task budgets and template counts.

    A budget is split over zero-shot and few-shot rows by their counts, then each half over rows
    with and without options. Keeps other columns of `budgets`, e.g. the setting of a sweep.
    """
    zs_opt, zs_noopt, fs_opt, fs_noopt = (F.col(t) for t in TEMPLATE_TYPES)
    sized = counts.select(*TASK_KEY, *TEMPLATE_TYPES).join(small(budgets, budget_rows), list(TASK_KEY))
    zs, fs = _split2(F.col("budget"), zs_opt + zs_noopt, fs_opt + fs_noopt)
    halves = sized.withColumns({"_zs": zs, "_fs": fs})
    parts = [*_split2(F.col("_zs"), zs_opt, zs_noopt), *_split2(F.col("_fs"), fs_opt, fs_noopt)]
    cells = F.array(
        *[
            F.struct(F.lit(t).alias("template_type"), F.col(t).alias("rows"), part.alias("budget"))
            for t, part in zip(TEMPLATE_TYPES, parts)
        ]
    )
    kept = [c for c in budgets.columns if c not in (*TASK_KEY, "budget")]
    return halves.select(*TASK_KEY, *kept, F.inline(cells))
