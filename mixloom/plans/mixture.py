"""From instances to a mixture: the whole plan, a sweep over settings, and the baselines."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixloom.cluster import small, stored
from mixloom.config import GROUP_KEY, ROW_KEY, TASK_KEY, TEMPLATE_TYPES, MixtureConfig
from mixloom.operators.budgets import (
    budget_split,
    cap_redistribute,
    task_budgets,
    taylor_softmax,
    template_budgets,
    zero_fill,
)
from mixloom.operators.checks import refuse_nulls, require_columns
from mixloom.operators.ordering import order_instances, random_leaders
from mixloom.operators.prepare import task_profile
from mixloom.operators.selection import select_subset, train_split, train_splits, validation_split, whole_groups
from mixloom.operators.tasks import select_tasks

GROUPS_PER_TASK = len(TEMPLATE_TYPES)


@dataclass
class Mixture:
    """What a run produced. `budgets` is small and stored, `rows` are narrow and stored, the splits
    are lazy."""

    budgets: DataFrame
    rows: DataFrame
    train: DataFrame
    validation: DataFrame | None = None


@dataclass
class GroupBudgets:
    """Stored (pick, task..., gain, task_budget, template_type, rows, budget) of the picked tasks,
    with what is known about it."""

    split: DataFrame
    partial: DataFrame
    groups: int
    largest: int

    @property
    def tasks(self) -> DataFrame:
        """(pick, task..., gain, budget) of the picked tasks."""
        return self.split.select("pick", *TASK_KEY, "gain", F.col("task_budget").alias("budget")).distinct()


@dataclass
class Sweep:
    """Mixtures of many settings. `rows` (config_id, group..., row_idx) are narrow and stored; `train` is lazy and holds each
    picked row once, `taken` naming its settings and its position in each."""

    grid: list[MixtureConfig]
    rows: DataFrame
    train: DataFrame
    validation: DataFrame | None = None


def profile_of(instances: DataFrame, cfg: MixtureConfig) -> DataFrame:
    """Stored profile of all tasks. Everything about tasks is derived from it, not from the rows."""
    needs_vectors = cfg.task_objective != "random"
    return stored(task_profile(instances, cfg.submixtures, vectors=needs_vectors))


def checked_budgets(split: DataFrame, num_instances: int) -> GroupBudgets:
    """Run the checks on the stored template budgets of one setting: feasible and conserved."""
    in_part = (F.col("budget") > 0) & (F.col("budget") < F.col("rows"))
    held, given, groups, largest = split.agg(
        F.sum("rows"), F.sum("budget"), F.count(F.lit(1)), F.max(F.when(in_part, F.col("rows")))
    ).head()
    if (held or 0) < num_instances:
        raise ValueError(f"the picked tasks hold {held or 0} rows, {num_instances} are wanted")
    if given != num_instances:
        raise ValueError(f"template budgets add up to {given} instead of {num_instances}")
    return GroupBudgets(split, split.where(in_part), groups, largest or 0)


def group_budgets(profile: DataFrame, cfg: MixtureConfig) -> GroupBudgets:
    """Pick tasks and split the rows wanted over them and their templates."""
    picks = select_tasks(profile, cfg.task_objective, cfg.num_tasks, cfg.task_seed)
    given = task_budgets(
        picks, profile, cfg.num_instances, cfg.taylor_order, cfg.temperature, picks_bound=cfg.num_tasks
    )
    given = given.select("pick", *TASK_KEY, "gain", F.col("budget").alias("task_budget"), "budget")
    split = template_budgets(given, profile, cfg.num_tasks).where("rows > 0")
    return checked_budgets(stored(split), cfg.num_instances)


def pick_rows(
    instances: DataFrame,
    budgets: GroupBudgets,
    cfg: MixtureConfig,
    ordering: DataFrame | None = None,
) -> DataFrame:
    """(group..., row_idx) of the mixture. Only groups taken in part are ordered.

    A loaded `ordering` is cut to the budgets; without one, rows are ordered up to the budgets.
    """
    quotas = budgets.partial.select(*GROUP_KEY, F.col("budget").alias("quota"))
    if ordering is not None:
        ordered = select_subset(ordering, budgets.partial.select(*GROUP_KEY, "budget"), budgets.groups)
    elif cfg.instance_objective == "random":
        ordered = random_leaders(instances, quotas, budgets.groups, cfg.ordering_seed)
    else:
        ordered = order_instances(
            instances,
            cfg.instance_objective,
            quotas,
            budgets.groups,
            budgets.largest,
            budgets.partial.select(*GROUP_KEY, "rows"),
            threshold=cfg.chunk_threshold,
            chunk_rows=cfg.chunk_rows,
        )
    whole = whole_groups(instances, budgets.split, budgets.groups)
    return whole.unionByName(ordered.select(*GROUP_KEY, "row_idx"))


def build_mixture(
    instances: DataFrame,
    cfg: MixtureConfig,
    validation: DataFrame | None = None,
    vectors: DataFrame | None = None,
    ordering: DataFrame | None = None,
) -> Mixture:
    """Pick `num_instances` rows of `num_tasks` tasks and shuffle them.

    Null vectors and texts fail in the scan that reads them, vectors of unequal width when they are averaged or ordered,
    repeated row keys when the picks are counted; `violations` lists all of them beforehand.
    Scans: one for the task profile, one for the ordered groups (keys and vectors), one for the
    texts of the picked rows. What lies between is stored, so nothing is worked out twice.
    `vectors` (group..., row_idx, embedding) stands in for `instances` wherever no text is needed.
    """
    keyed = instances if vectors is None else vectors
    needs_vectors = cfg.task_objective != "random" or (ordering is None and cfg.instance_objective != "random")
    require_columns(instances, [*ROW_KEY, "inputs", "targets"])
    require_columns(keyed, [*GROUP_KEY, "row_idx", *(["embedding"] if needs_vectors else [])])
    keyed = refuse_nulls(keyed, ["embedding"] if needs_vectors else [])
    instances = refuse_nulls(instances, ["inputs", "targets"])
    budgets = group_budgets(profile_of(keyed, cfg), cfg)
    rows = stored(pick_rows(keyed, budgets, cfg, ordering))
    picked, keys = rows.select(F.count(F.lit(1)), F.count_distinct(*ROW_KEY)).head()
    if picked != cfg.num_instances or keys != picked:
        raise ValueError(f"the mixture has {picked} rows with {keys} keys instead of {cfg.num_instances}")
    train = train_split(instances, rows, cfg.shuffle_seed, picks_bound=cfg.num_instances)
    held_out = None if validation is None else validation_split(validation)
    return Mixture(budgets.tasks, rows, train, held_out)


def sweep(
    instances: DataFrame, grid: Iterable[MixtureConfig], orderings: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """(config_id, group..., row_idx) of many settings at once; config_id is the place in the grid.

    Greedy orders are nested, so each task objective (and seed) runs once, to the largest `num_tasks`, and each instance
    objective (with its seed and chunks) once, to the largest budget any of its settings gives a group. Objectives with a
    loaded ordering in `orderings` are not run. All settings must name the same submixtures, and each must hold the
    rows it wants and split all of them over the templates.
    """
    grid = list(grid)
    if not grid:
        raise ValueError("a sweep needs at least one setting")
    if len({c.submixtures for c in grid}) > 1:
        raise ValueError("the settings of a sweep must name the same submixtures")
    spark = instances.sparkSession
    needs_vectors = any(c.task_objective != "random" for c in grid)
    profile = stored(task_profile(instances, grid[0].submixtures, vectors=needs_vectors))
    split = stored(_sweep_budgets(spark, profile, grid))
    given = {r["config_id"]: r["given"] for r in split.groupBy("config_id").agg(F.sum("budget").alias("given")).collect()}
    lost = [i for i, c in enumerate(grid) if given.get(i, 0) != c.num_instances]
    if lost:
        raise ValueError(f"template budgets of settings {lost} add up to {[given.get(i, 0) for i in lost]}")
    bound = GROUPS_PER_TASK * sum(c.num_tasks for c in grid)
    parts = [whole_of_sweep(instances, split, bound)]
    partial = split.where("budget > 0 AND budget < rows")
    orders: dict[tuple, list[int]] = {}
    for i, c in enumerate(grid):
        key = (c.instance_objective, c.ordering_seed, c.chunk_threshold, c.chunk_rows)
        orders.setdefault(key, []).append(i)
    for (objective, seed, threshold, chunk_rows), settings in orders.items():
        given = partial.where(F.col("config_id").isin(settings))
        quotas = given.groupBy(*GROUP_KEY).agg(F.max("budget").alias("quota"))
        ordering = (orderings or {}).get(objective)
        if ordering is None:
            ordering = order_instances(
                instances,
                objective,
                quotas,
                bound,
                given.agg(F.max("rows")).head()[0] or 0,
                given.select(*GROUP_KEY, "rows").distinct(),
                seed,
                threshold,
                chunk_rows,
            )
        chosen = select_subset(ordering, given, bound)
        parts.append(chosen.select("config_id", *GROUP_KEY, "row_idx"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def build_sweep(
    instances: DataFrame,
    grid: Iterable[MixtureConfig],
    validation: DataFrame | None = None,
    vectors: DataFrame | None = None,
    orderings: Mapping[str, DataFrame] | None = None,
) -> Sweep:
    """The mixtures of many settings, with their texts, for `write_mixtures`.

    What `build_mixture` does for one setting, at the cost of one profile, one ordering per instance objective and one scan of
    the texts: the picks of all settings are stored as keys, each setting's are counted, then every picked row is read once
    with the settings that take it and its position in each. `vectors` and `orderings` (by instance objective) stand in as there.
    """
    grid = list(grid)
    keyed = instances if vectors is None else vectors
    loaded = orderings or {}
    needs_vectors = any(
        c.task_objective != "random" or (c.instance_objective != "random" and c.instance_objective not in loaded) for c in grid
    )
    require_columns(instances, [*ROW_KEY, "inputs", "targets"])
    require_columns(keyed, [*GROUP_KEY, "row_idx", *(["embedding"] if needs_vectors else [])])
    keyed = refuse_nulls(keyed, ["embedding"] if needs_vectors else [])
    instances = refuse_nulls(instances, ["inputs", "targets"])
    rows = stored(sweep(keyed, grid, loaded))
    counted = rows.groupBy("config_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(*ROW_KEY).alias("keys"))
    found = {r["config_id"]: (r["rows"], r["keys"]) for r in counted.collect()}
    for i, c in enumerate(grid):
        picked, keys = found.get(i, (0, 0))
        if picked != c.num_instances or keys != picked:
            raise ValueError(f"setting {i} has {picked} rows with {keys} keys instead of {c.num_instances}")
    train = train_splits(instances, rows, [c.shuffle_seed for c in grid], sum(c.num_instances for c in grid))
    return Sweep(grid, rows, train, None if validation is None else validation_split(validation))


def whole_of_sweep(instances: DataFrame, split: DataFrame, bound: int) -> DataFrame:
    taken = split.where("budget > 0 AND budget = rows").select("config_id", *GROUP_KEY)
    rows = instances.select(*GROUP_KEY, "row_idx")
    return rows.join(small(taken, bound), list(GROUP_KEY)).select("config_id", *GROUP_KEY, "row_idx")


def _sweep_budgets(spark: SparkSession, profile: DataFrame, grid: Sequence[MixtureConfig]) -> DataFrame:
    """(config_id, group..., rows, budget) of all settings."""
    largest: dict[tuple[str, int], int] = {}
    for c in grid:
        key = (c.task_objective, c.task_seed)
        largest[key] = max(largest.get(key, 0), c.num_tasks)
    numbers = {key: n for n, key in enumerate(largest)}
    settings = spark.createDataFrame(
        [
            (i, numbers[c.task_objective, c.task_seed], c.num_tasks, c.num_instances, c.temperature, c.taylor_order)
            for i, c in enumerate(grid)
        ],
        "config_id int, list_id int, num_tasks int, num_instances bigint, temperature double, taylor_order int",
    )
    lists = None
    for (objective, seed), most in largest.items():
        picks = select_tasks(profile, objective, most, seed)
        picks = picks.withColumn("list_id", F.lit(numbers[objective, seed]))
        lists = picks if lists is None else lists.unionByName(picks)
    lists = stored(lists)
    each = lists.join(F.broadcast(settings), "list_id").where("pick <= num_tasks")
    rows = sum(c.num_tasks for c in grid)
    sized = profile.select(*TASK_KEY, "total").join(small(each, rows), list(TASK_KEY))
    by = ["config_id"]
    scaled = sized.withColumn("gain", F.col("gain") / F.col("temperature"))
    shares = None
    for order in sorted({c.taylor_order for c in grid}):
        part = taylor_softmax(scaled.where(F.col("taylor_order") == order), by, order=order)
        shares = part if shares is None else shares.unionByName(part)
    budgets = stored(cap_redistribute(budget_split(shares, F.col("num_instances"), "prob", "pick", by), by=by))
    short = budgets.groupBy(*by).agg(
        F.sum("total").alias("available"), F.first("num_instances").alias("wanted")
    ).where("available < wanted").head()
    if short:
        raise ValueError(f"the picked tasks hold fewer rows than wanted: {short.asDict()}")
    given = budgets.select("config_id", *TASK_KEY, "budget")
    return template_budgets(given, profile, rows).where("rows > 0")


def baseline_budgets(profile: DataFrame, kind: str, num_instances: int) -> DataFrame:
    """(pick, task..., total, gain, budget) of all tasks, mixed equally or in proportion to their rows.

    Leftovers and redistribution follow the order of the tasks.
    """
    if kind not in ("equal", "proportional"):
        raise ValueError(f"unknown baseline {kind!r}")
    place = F.struct("submixture_ord", "submixture", "first_row", "task_name")
    ratio = F.lit(1.0) if kind == "equal" else F.col("total").cast("double")
    tasks = profile.select(
        F.row_number().over(Window.orderBy(place)).alias("pick"), *TASK_KEY, "total", ratio.alias("gain")
    )
    return cap_redistribute(budget_split(tasks, F.lit(num_instances), "gain", "pick"))


def baseline_mixture(instances: DataFrame, kind: str, cfg: MixtureConfig) -> DataFrame:
    """(group..., row_idx) of a baseline mixture of all tasks, with random rows of each group."""
    profile = stored(task_profile(instances, cfg.submixtures, vectors=False))
    given = baseline_budgets(profile, kind, cfg.num_instances)
    given = given.select("pick", *TASK_KEY, "gain", F.col("budget").alias("task_budget"), "budget")
    split = stored(template_budgets(given, profile, profile.count()).where("rows > 0"))
    budgets = checked_budgets(split, cfg.num_instances)
    return pick_rows(instances, budgets, replace(cfg, instance_objective="random"))


def all_task_budgets(profile: DataFrame, budgets: DataFrame, cfg: MixtureConfig) -> DataFrame:
    """Budgets of every task, 0 for those not picked."""
    return zero_fill(profile.select(*TASK_KEY), budgets.select(*TASK_KEY, "budget"), cfg.num_tasks)
