"""Selection and assembly of the mixture."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.cluster import BROADCAST_ROWS, small, stored
from mixloom.config import GROUP_KEY, ROW_KEY, SHUFFLE_SEED
from mixloom.functions.columns import of_setting, seeded_digest, whole
from mixloom.operators.prepare import as_pairs, known_templates, strip_metadata
from mixloom.operators.ranking import digest_bucket, positions


# Row numbers of a bitmap, its bytes, and bytes of all bitmaps that may be broadcast.
BITMAP_ROWS = 32_768
BITMAP_BYTES = BITMAP_ROWS // 8
BITMAPS_LIMIT = 64 << 20


def row_bitmaps(keys: DataFrame) -> DataFrame:
    """(submixture, _part, _bits): per 32,768 row numbers of a submixture the bitmap of those that `keys` holds."""
    rows = keys.select("submixture", F.col("row_idx").cast("bigint").alias("row_idx"))
    bit = F.pmod("row_idx", F.lit(BITMAP_ROWS))
    part = whole(F.col("row_idx") - bit, BITMAP_ROWS)
    return rows.groupBy("submixture", part.alias("_part")).agg(F.bitmap_construct_agg(bit).alias("_bits"))


def only_picked(df: DataFrame, keys: DataFrame, limit: int = BITMAPS_LIMIT) -> DataFrame:
    """Rows of `df` whose key is in `keys`, filtered where they are scanned, by bitmaps of the row numbers.

    The bitmaps are stored and counted; above `limit` bytes of them `df` is returned as it is, so an exact join must follow.
    """
    bitmaps = stored(row_bitmaps(keys))
    if bitmaps.count() * BITMAP_BYTES > limit:
        return df
    row = F.col("row_idx").cast("bigint")
    bit = F.pmod(row, F.lit(BITMAP_ROWS))
    bitmaps = bitmaps.withColumnRenamed("submixture", "_of")
    same = (F.col("submixture") == F.col("_of")) & (whole(row - bit, BITMAP_ROWS) == F.col("_part"))
    byte = F.conv(F.hex(F.expr(f"substring(_bits, CAST(pmod(CAST(row_idx AS BIGINT), {BITMAP_ROWS}) div 8 AS INT) + 1, 1)")), 16, 10)
    held = F.getbit(byte.cast("int"), F.pmod(bit, F.lit(8)).cast("int")) == 1
    return df.join(F.broadcast(bitmaps), same).where(held).select(df.columns)


def _joined(df: DataFrame, keys: DataFrame, bound: int | None, how: str = "inner") -> DataFrame:
    """Join with stored keys; where they are too many for a broadcast, only rows that have one are shuffled."""
    count = keys.count() if bound is None else bound
    if count > BROADCAST_ROWS:
        df = only_picked(df, keys)
    return df.join(small(keys, count), list(ROW_KEY), how)


def select_rows(df: DataFrame, picks: DataFrame, picks_bound: int | None = None) -> DataFrame:
    """Rows of `df` whose (submixture, row_idx) is picked. Without a bound the picks are stored, to be counted once made."""
    keys = picks.select(*ROW_KEY)
    if picks_bound is None or picks_bound > BROADCAST_ROWS:
        keys = stored(keys)
    return _joined(df, keys, picks_bound, "left_semi")


def select_subset(
    ordering: DataFrame, budgets: DataFrame, groups_bound: int | None = None
) -> DataFrame:
    """The first `budget` ranks of each group; other columns of `budgets` are kept."""
    given = budgets.drop("rows").where("budget > 0")
    chosen = ordering.join(small(given, groups_bound), list(GROUP_KEY)).where("rank <= budget")
    return chosen.drop("budget")


def whole_groups(df: DataFrame, budgets: DataFrame, groups_bound: int | None = None) -> DataFrame:
    """(group..., row_idx) of the groups taken whole, which need no ordering."""
    taken = budgets.where("budget > 0 AND budget = rows").select(*GROUP_KEY)
    rows = known_templates(df).select(*GROUP_KEY, "row_idx")
    return rows.join(small(taken, groups_bound), list(GROUP_KEY), "left_semi")


def assemble(parts: Iterable[DataFrame]) -> DataFrame:
    """Bag union of the selections of all submixtures."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def shuffle(df: DataFrame, seed: int = SHUFFLE_SEED, name: str = "pos") -> DataFrame:
    """Add a random but repeatable position to each row. Pass narrow rows, join text afterwards."""
    keyed = df.withColumn("_digest", seeded_digest(seed, *ROW_KEY))
    return positions(keyed, [], digest_bucket("_digest"), ["_digest", *ROW_KEY], name).drop("_digest")


def train_split(
    instances: DataFrame, picks: DataFrame, seed: int = SHUFFLE_SEED, picks_bound: int | None = None
) -> DataFrame:
    """(pos, prompt, response, ...) of the picked rows; `picks` is a stored frame of row keys."""
    placed = shuffle(picks.select(*ROW_KEY), seed)
    if picks_bound is None or picks_bound > BROADCAST_ROWS:
        placed = stored(placed)
    rows = _joined(instances, placed, picks_bound)
    return as_pairs(strip_metadata(rows)).drop("embedding")


def train_splits(instances: DataFrame, picks: DataFrame, seeds: Sequence[int], picks_bound: int | None = None) -> DataFrame:
    """(taken, prompt, response, ...): each row that any setting picks once, so its texts are read and moved once.

    `picks` is a stored frame of (config_id, row key), `seeds` the shuffle seed of each setting, `taken` an array of
    (config_id, pos) by config_id, with no more entries than there are settings; `picks_bound` bounds the rows of `picks`.
    """
    keyed = picks.select("config_id", *ROW_KEY).withColumn("_digest", seeded_digest(of_setting(seeds), *ROW_KEY))
    placed = positions(keyed, ["config_id"], digest_bucket("_digest"), ["_digest", *ROW_KEY])
    takes = placed.groupBy(*ROW_KEY).agg(F.array_sort(F.collect_list(F.struct("config_id", "pos"))).alias("taken"))
    if picks_bound is None or picks_bound > BROADCAST_ROWS:
        takes = stored(takes)
    rows = _joined(instances.drop("taken"), takes, picks_bound)
    return as_pairs(strip_metadata(rows)).drop("embedding")


def validation_split(validation: DataFrame) -> DataFrame:
    """All validation rows of all submixtures, neither selected nor shuffled."""
    return as_pairs(strip_metadata(validation)).drop("embedding")
