"""Stage 1: pick the tasks that represent the collection, with their marginal gains."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixloom.cluster import small, stored
from mixloom.config import SHUFFLE_SEED, TASK_KEY
from mixloom.functions.columns import seeded_digest
from mixloom.functions.greedy import fits_one_task, greedy
from mixloom.operators.exact import exact_picks
from mixloom.operators.ranking import range_positions
from mixloom.operators.similarity import matrix

PICK_SCHEMA = "pick int, submixture string, task_name string, gain double"


def select_tasks(
    profile: DataFrame,
    objective: str,
    num_tasks: int,
    seed: int = SHUFFLE_SEED,
    one_task: bool | None = None,
) -> DataFrame:
    """(pick, submixture, task_name, gain): the `num_tasks` best tasks in pick order.

    `profile` is a stored task profile. The work that its vectors mean decides where the greedy runs, unless `one_task`
    does; both ways take the same picks.
    """
    random = objective == "random"
    width = F.lit(0) if random else F.max(F.size("embedding"))
    tasks, width = profile.agg(F.count(F.lit(1)), width).head()
    if num_tasks >= tasks:
        raise ValueError(f"num_tasks must be below the {tasks} tasks there are")
    if random:
        return random_tasks(profile, num_tasks, seed)
    vectors = profile.select(*TASK_KEY, "submixture_ord", "first_row", "embedding")
    if fits_one_task(tasks, width or 0, objective) if one_task is None else one_task:
        return _picks_in_one_task(vectors, objective, num_tasks)
    return picks_by_jobs(vectors, objective, num_tasks)


def random_tasks(profile: DataFrame, num_tasks: int, seed: int = SHUFFLE_SEED) -> DataFrame:
    """A uniform sample of tasks without replacement, all gains 1."""
    sample = (
        profile.select(*TASK_KEY, seeded_digest(seed, *TASK_KEY).alias("_digest"))
        .orderBy("_digest", *TASK_KEY)
        .limit(num_tasks)
    )
    order = Window.orderBy("_digest", *TASK_KEY)
    return sample.select(F.row_number().over(order).alias("pick"), *TASK_KEY, F.lit(1.0).alias("gain"))


def _picks_in_one_task(vectors: DataFrame, objective: str, num_tasks: int) -> DataFrame:
    def pick(tasks: pa.Table) -> pa.Table:
        tasks = tasks.sort_by([(c, "ascending") for c in ("submixture_ord", "submixture", "first_row", "task_name")])
        places, gains = greedy(matrix(tasks["embedding"], tasks["task_name"]), objective, num_tasks)
        chosen = tasks.select(list(TASK_KEY)).take(pa.array(places))
        ranks = pa.array(range(1, len(places) + 1), pa.int32())
        return chosen.add_column(0, "pick", ranks).append_column("gain", pa.array(gains))

    return vectors.groupBy().applyInArrow(pick, PICK_SCHEMA)


def picks_by_jobs(vectors: DataFrame, objective: str, num_tasks: int) -> DataFrame:
    """The same greedy for vectors of any number, by distributed passes; see `exact_picks`."""
    order = ["submixture_ord", "submixture", "first_row", "task_name"]
    rows = stored(range_positions(vectors.select(*order, "embedding"), [], order, "row_idx"))
    picks = exact_picks(rows, objective, num_tasks)
    found = picks.select((F.col("place") + 1).cast("int").alias("pick"), "row_idx", "gain")
    return rows.join(small(found, num_tasks), "row_idx").select("pick", *TASK_KEY, "gain")
