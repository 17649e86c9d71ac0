"""Stage 2: order the rows of every (submixture, task, template) group.

Groups are independent. A group that is work for one task is ordered there; a larger one by distributed passes with the same
result. Only where the caller asks for chunks, groups above a threshold are cut by position into chunks, each ordered apart,
and the chunk orders are merged round-robin.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixloom.cluster import shared_dir, small, stored
from mixloom.config import CHUNK_ROWS, CHUNK_THRESHOLD, GROUP_KEY, ORDERING_SEED
from mixloom.functions.columns import seeded_digest, whole
from mixloom.functions.greedy import fits_one_task, greedy
from mixloom.operators.exact import facility_picks
from mixloom.operators.facility import whole_picks
from mixloom.operators.passes import SCORED, group_picks
from mixloom.operators.prepare import known_templates
from mixloom.operators.ranking import digest_bucket, index_bucket, leading_rows, positions
from mixloom.operators.similarity import matrix

# Groups whose facility location runs at the same time.
GROUPS_AT_ONCE = 6
# Tasks that chunks are dealt over by their rows, and rows below which their work needs no dealing.
CHUNK_TASKS = 1024
DEALT_ROWS = 1024
ORDERING_COLUMNS = (*GROUP_KEY, "rank", "row_idx", "gain")
# Names of a group's keys beside those of its rows.
OF_GROUP = tuple(f"_of_{c}" for c in GROUP_KEY)


def order_instances(
    df: DataFrame,
    objective: str,
    quotas: DataFrame | None = None,
    quota_groups: int | None = None,
    largest: int | None = None,
    sizes: DataFrame | None = None,
    seed: int = ORDERING_SEED,
    threshold: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
    one_task_rows: int | None = None,
) -> DataFrame:
    """(group..., rank, row_idx, gain) with ranks from 1.

    Every row is ranked, unless `quotas` (group..., quota) asks for the first ranks of some groups
    only: greedy orders are nested, so ordering stops there, and rows of other groups are dropped
    before any embedding is shuffled. `quota_groups` bounds the rows of `quotas`; `largest` (a bound
    on the rows of a group) and `sizes` (a stored frame of group..., rows) save counting them. Orders are exact whatever a
    group's size, unless `threshold` asks for chunks of `chunk_rows` above it. `one_task_rows` overrides how many rows one
    task orders; row_idx must be unique in a group.
    """
    if objective == "random":
        return random_ordering(df, quotas, quota_groups, seed)
    rows = known_templates(df).select(*GROUP_KEY, "row_idx", "embedding")
    if quotas is not None:
        rows = rows.join(small(quotas.select(*GROUP_KEY, "quota"), quota_groups), list(GROUP_KEY))
    else:
        rows = rows.withColumn("quota", F.lit(None).cast("bigint"))
    if threshold is None:
        return _order_exactly(rows, objective, largest, sizes, one_task_rows)
    chunked = with_chunks(rows, threshold, chunk_rows, largest, sizes)
    ranked = interleave(_order_chunks(chunked, objective))
    return ranked.where("quota IS NULL OR rank <= quota").select(*ORDERING_COLUMNS)


def _order_exactly(
    rows: DataFrame, objective: str, largest: int | None, sizes: DataFrame | None, one_task_rows: int | None
) -> DataFrame:
    """Groups that fit into a task together, each other one by passes over its stored rows."""
    limit = one_task_rows
    if limit is None:
        width = rows.select(F.size("embedding")).head()
        limit = _one_task_rows(width[0] if width else 1, objective)
    within = with_chunks(rows, limit, limit, limit)
    hot = []
    dealt = objective == "fl" and limit > DEALT_ROWS and (largest is None or largest > DEALT_ROWS)
    if sizes is None and (dealt or largest is None or largest > limit):
        sizes = rows.groupBy(*GROUP_KEY).agg(F.count(F.lit(1)).alias("rows"))
        sizes = stored(sizes) if dealt else sizes
    if largest is None or largest > limit:
        # Every such group has more than `limit` rows, so their list is short.
        hot = sizes.where(F.col("rows") > limit).orderBy(F.col("rows").desc(), *GROUP_KEY).collect()
    parts = []
    if hot:
        shape = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in GROUP_KEY)
        out = rows.sparkSession.createDataFrame([tuple(g[c] for c in GROUP_KEY) for g in hot], shape)
    if hot and objective in SCORED:
        picks = group_picks(stored(rows.join(small(out, len(hot)), list(GROUP_KEY), "left_semi")), objective)
        parts.append(picks.select(*GROUP_KEY, (F.col("place") + 1).alias("rank"), "row_idx", "gain"))
    elif hot:
        parts += _hot_facility(rows, hot)
    if hot and objective in SCORED:
        within = within.join(small(out, len(hot)), list(GROUP_KEY), "left_anti")
    elif hot:
        within = within.join(small(out.toDF(*OF_GROUP), len(hot)), _same_group(), "left_anti")
    sizes = sizes.where(F.col("rows") <= limit).withColumn("chunk_id", F.lit(0).cast("bigint")) if dealt else None
    ranked = interleave(_order_chunks(within, objective, sizes))
    result = ranked.where("quota IS NULL OR rank <= quota").select(*ORDERING_COLUMNS)
    for part in parts:
        result = result.unionByName(part.withColumn("row_idx", F.col("row_idx").cast(rows.schema["row_idx"].dataType)))
    return result


def _same_group() -> Column:
    """Whether a row is of the group that OF_GROUP names, null keys included."""
    same = F.lit(True)
    for c, of in zip(GROUP_KEY, OF_GROUP):
        same = same & F.col(c).eqNullSafe(F.col(of))
    return same


def _hot_facility(rows: DataFrame, hot: list) -> list[DataFrame]:
    """Orders of `hot` groups, the largest first, by facility location.

    First gains are made by cells. Groups that are work for one task then need one each, in one job; larger ones go on by cycles.
    """
    spark = rows.sparkSession
    in_task = _one_task_rows(rows.select(F.size("embedding")).head()[0], "fl")
    parts, fitting = [], [g for g in hot if g["rows"] <= in_task]
    if fitting:
        shape = ", ".join(f"{of} {rows.schema[c].dataType.simpleString()}" for c, of in zip(GROUP_KEY, OF_GROUP))
        numbered = spark.createDataFrame([(i, *(g[c] for c in GROUP_KEY)) for i, g in enumerate(fitting)], f"_group int, {shape}")
        own = rows.join(small(numbered, len(fitting)), _same_group())
        own = stored(own.select("_group", F.col("row_idx").cast("bigint").alias("row_idx"), "embedding", "quota"))
        picks = stored(whole_picks(own, len(fitting))).join(small(numbered, len(fitting)), "_group")
        names = [F.col(of).alias(c) for c, of in zip(GROUP_KEY, OF_GROUP)]
        parts.append(picks.select(*names, (F.col("place") + 1).alias("rank"), "row_idx", "gain"))

    def ordered(group) -> DataFrame:
        same = F.lit(True)
        for c in GROUP_KEY:
            same = same & F.col(c).eqNullSafe(F.lit(group[c]))
        own = stored(rows.where(same).select("row_idx", "embedding", "quota"))
        count, quota = own.agg(F.count(F.lit(1)), F.max("quota")).head()
        picks = facility_picks(own, min(count, quota or count), in_task)
        names = [F.lit(group[c]).cast(rows.schema[c].dataType).alias(c) for c in GROUP_KEY]
        return picks.select(*names, (F.col("place") + 1).alias("rank"), "row_idx", "gain")

    # Jobs of one group leave most cores idle, so a few groups go on at the same time.
    shared_dir(spark)
    with ThreadPoolExecutor(GROUPS_AT_ONCE) as pool:
        parts += pool.map(ordered, [g for g in hot if g["rows"] > in_task])
    return parts


def _one_task_rows(width: int, objective: str) -> int:
    """The most rows that `fits_one_task`."""
    rows, step = 0, 1
    while fits_one_task(2 * step, max(1, width), objective):
        step *= 2
    while step:
        if fits_one_task(rows + step, max(1, width), objective):
            rows += step
        step //= 2
    return max(1, rows)


def _shuffled(df: DataFrame, seed: int) -> DataFrame:
    return known_templates(df).select(
        *GROUP_KEY, "row_idx", seeded_digest(seed, "row_idx").alias("_digest")
    )


def random_leaders(
    df: DataFrame, quotas: DataFrame, quota_groups: int | None = None, seed: int = ORDERING_SEED
) -> DataFrame:
    """(group..., row_idx): the first `quota` rows of each group in random order, unranked."""
    rows = leading_rows(
        _shuffled(df, seed),
        quotas.select(*GROUP_KEY, "quota"),
        GROUP_KEY,
        digest_bucket("_digest"),
        ["_digest", "row_idx"],
        quota_groups,
    )
    return rows.select(*GROUP_KEY, "row_idx")


def random_ordering(
    df: DataFrame,
    quotas: DataFrame | None = None,
    quota_groups: int | None = None,
    seed: int = ORDERING_SEED,
) -> DataFrame:
    """A shuffle of each group, keyed by row and so stable under repartitioning; all gains 1."""
    # The leaders are narrow and few: stored, they are ranked without reading `df` again.
    leaders = df if quotas is None else stored(random_leaders(df, quotas, quota_groups, seed))
    rows = _shuffled(leaders, seed)
    order = ["_digest", "row_idx"]
    placed = positions(rows, GROUP_KEY, digest_bucket("_digest"), order, "_place")
    return placed.select(
        *GROUP_KEY, (F.col("_place") + 1).alias("rank"), "row_idx", F.lit(1.0).alias("gain")
    )


def with_chunks(
    rows: DataFrame,
    threshold: int = CHUNK_THRESHOLD,
    chunk_rows: int = CHUNK_ROWS,
    largest: int | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Add `chunk_id`, the group's number of `chunks` and the rows of the last one.

    Chunk c holds positions c * chunk_rows and up; groups within the threshold are one chunk.
    Groups are counted unless `largest` rules out large ones, and positions are worked out for the
    large groups only.
    """
    single = {
        "chunk_id": F.lit(0).cast("bigint"),
        "chunks": F.lit(1).cast("bigint"),
        "last_rows": F.lit(threshold).cast("bigint"),
    }
    if largest is not None and largest <= threshold:
        return rows.withColumns(single)
    if sizes is None:
        counted = rows.groupBy(*GROUP_KEY).agg(F.count(F.lit(1)).alias("rows"))
        large = stored(counted.where(F.col("rows") > threshold))
    else:
        large = sizes.where(F.col("rows") > threshold)
    groups = large.count()
    if not groups:
        return rows.withColumns(single)
    chunks = whole(F.col("rows") + (chunk_rows - 1), chunk_rows)
    shape = large.select(
        *GROUP_KEY, chunks.alias("chunks"), (F.col("rows") - (chunks - 1) * chunk_rows).alias("last_rows")
    )
    shape = small(shape, groups)
    exact = rows.join(shape, list(GROUP_KEY), "left_anti").withColumns(single)
    hot = rows.join(shape, list(GROUP_KEY))
    placed = positions(hot, GROUP_KEY, index_bucket(), ["row_idx"], "_place")
    return exact.unionByName(
        placed.withColumn("chunk_id", whole(F.col("_place"), chunk_rows)).drop("_place")
    )


def interleave(ranked: DataFrame) -> DataFrame:
    """Merge chunk orders round-robin: rank 1 of every chunk, then rank 2, ...; tails are kept.

    All chunks but the last are full, so the merged rank has a closed form and needs no window:
    before (rank r, chunk c) come r - 1 rows of each full chunk, what the last chunk has of
    them, and rank r of the c chunks ahead.
    """
    done = F.col("chunk_rank") - 1
    merged = (F.col("chunks") - 1) * done + F.least("last_rows", done) + F.col("chunk_id") + 1
    return ranked.withColumn("rank", merged)


def chunked_random_ordering(
    df: DataFrame, seed: int = ORDERING_SEED, threshold: int = CHUNK_THRESHOLD, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Random ordering through the chunks: each chunk shuffled apart, then merged."""
    rows = known_templates(df).select(*GROUP_KEY, "row_idx", seeded_digest(seed, "row_idx").alias("_digest"))
    chunked = with_chunks(rows, threshold, chunk_rows)
    by = [*GROUP_KEY, "chunk_id"]
    placed = positions(chunked, by, digest_bucket("_digest"), ["_digest", "row_idx"], "_place")
    ranked = interleave(placed.withColumn("chunk_rank", F.col("_place") + 1))
    return ranked.withColumn("gain", F.lit(1.0)).select(*ORDERING_COLUMNS)


def _quota_of_chunk() -> Column:
    """Ranks each chunk must give so that the first `quota` merged ranks are covered."""
    chunks, even = F.col("chunks"), F.col("chunks") * F.col("last_rows")
    others = F.nullif(chunks - 1, F.lit(0))
    beyond = F.col("last_rows") + F.ceil((F.col("quota") - even) / others)
    return F.when(F.col("quota") <= even, F.ceil(F.col("quota") / chunks)).otherwise(
        F.coalesce(beyond, F.col("quota"))
    )


def _dealt(chunked: DataFrame, sizes: DataFrame) -> DataFrame:
    """`chunked` with every chunk in a task of its own, or the larger ones in different tasks, the largest first.

    Work grows with the square of the rows: by hash, a few large chunks meet in one task, and small partitions are put together
    by their bytes. `sizes` is a stored (group..., chunk_id, rows).
    """
    keys = [*GROUP_KEY, "chunk_id"]
    chunks = sizes.count()
    slot = F.row_number().over(Window.orderBy(F.col("rows").desc(), *keys)) - 1
    slots = sizes.select(*[F.col(c).alias(f"_slot_{c}") for c in keys], slot.alias("_slot"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_slot_{c}"))
    placed = chunked.join(small(slots, chunks), same).drop(*[f"_slot_{c}" for c in keys])
    return placed.repartitionById(max(1, min(chunks, CHUNK_TASKS)), F.col("_slot"))


def _order_chunks(chunked: DataFrame, objective: str, sizes: DataFrame | None = None) -> DataFrame:
    """Greedy order of every (group, chunk); a Spark task holds one chunk at a time. With `sizes` (see `_dealt`), chunks of much
    work lie in tasks of their own."""
    types = {f.name: f.dataType.simpleString() for f in chunked.schema.fields}
    kept = [*GROUP_KEY, "row_idx", "chunk_id", "chunks", "last_rows", "quota"]
    schema = ", ".join(f"{c} {types[c]}" for c in kept)

    def order(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("row_idx")
        wanted = chunk["_wanted"][0].as_py() or chunk.num_rows
        places, gains = greedy(matrix(chunk["embedding"], chunk["row_idx"]), objective, wanted)
        ranks = pa.array(range(1, len(places) + 1), pa.int64())
        picked = chunk.select(kept).take(pa.array(places))
        return picked.append_column("chunk_rank", ranks).append_column("gain", pa.array(gains))

    wanted = chunked.withColumn("_wanted", _quota_of_chunk().cast("bigint"))
    by = [*GROUP_KEY, "chunk_id"]
    if sizes is not None:
        wanted, by = _dealt(wanted, sizes), ["_slot"]
    return wanted.groupBy(*by).applyInArrow(order, f"{schema}, chunk_rank bigint, gain double")
