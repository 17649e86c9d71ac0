"""Prompt-response pairs to padded training batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixloom.config import IGNORE_INDEX, UNSET_MAX_LENGTH
from mixloom.functions.columns import seeded_digest, whole
from mixloom.functions.hashing import token_ids
from mixloom.operators.ranking import digest_bucket, positions, range_positions

Tokenizer = Callable[[list[str]], list[list[int]]]


def concat_pair(df: DataFrame) -> DataFrame:
    """Add `text`: prompt, a space, response. A null side makes it null instead of vanishing."""
    return df.withColumn("text", F.concat("prompt", F.lit(" "), "response"))


def resolve_max_len(requested: int | None, tokenizer_max: int) -> int:
    """Effective length: never above the tokenizer's; a moderate default if none is requested."""
    return min(UNSET_MAX_LENGTH if requested is None else requested, tokenizer_max)


def tokenize(
    df: DataFrame,
    max_len: int,
    tokenizer: Callable[[], Tokenizer] | None = None,
    columns: Sequence[tuple[str, str]] = (("text", "input_ids"), ("prompt", "prompt_ids")),
) -> DataFrame:
    """Ids of the pair and of the prompt alone, each cut to `max_len`.

    `tokenizer` makes a function from texts to id lists; it is called once per Python worker. By
    default ids are hashes of whitespace tokens, computed in the JVM.
    """
    if tokenizer is None:
        ids = {out: token_ids(F.col(source), max_len) for source, out in columns}
    else:
        run = _tokenizer_udf(tokenizer, max_len)
        ids = {out: run(source) for source, out in columns}
    return df.withColumns(ids)


def _tokenizer_udf(tokenizer: Callable[[], Tokenizer], max_len: int):
    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer()
        for texts in batches:
            yield pd.Series([list(ids)[:max_len] for ids in encode(texts.tolist())])

    return run


def mask_labels(df: DataFrame) -> DataFrame:
    """Keep ids, mask and labels; labels are the ids with the prompt's part ignored."""
    size = F.size("input_ids")
    hidden = F.least(F.size("prompt_ids"), size)
    labels = F.concat(
        F.array_repeat(F.lit(IGNORE_INDEX), hidden), F.slice("input_ids", hidden + 1, size)
    )
    return (
        df.withColumn("attention_mask", F.array_repeat(F.lit(1), size))
        .withColumn("labels", labels)
        .drop("text", "prompt", "response", "prompt_ids")
    )


def batch_plan(
    df: DataFrame,
    keys: Sequence[str],
    batch_size: int,
    devices: int = 1,
    accumulation: int = 1,
    epochs: int = 1,
    seed: int | None = 0,
    order: str | None = None,
) -> DataFrame:
    """Where each row goes in each epoch: (epoch, keys..., place, batch_id, device, step, update).

    Train rows are shuffled anew in every epoch by `seed`; eval rows (`seed=None`) keep `order`, a
    dense position. `step` counts the batches of one device, `update` its optimizer steps. Plan
    on keys and join the ids later: the whole epoch is then placed without moving them.
    """
    keys = list(keys)
    every = df.select(*keys, *([order] if order else []), F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    if seed is None:
        placed = every.withColumn("place", F.col(order))
    else:
        # The epoch belongs into the digest: every epoch has its own order.
        keyed = every.withColumn("_digest", seeded_digest(seed, "epoch", *keys))
        placed = positions(keyed, ["epoch"], digest_bucket("_digest"), ["_digest", *keys], "place")
    return placed.select(
        "epoch",
        *keys,
        "place",
        whole(F.col("place"), batch_size).alias("batch_id"),
    ).select(
        "*",
        (F.col("batch_id") % devices).alias("device"),
        whole(F.col("batch_id"), devices).alias("step"),
        whole(F.col("batch_id"), devices * accumulation).alias("update"),
    )


def given_order(df: DataFrame, order: str, name: str = "place") -> DataFrame:
    """Dense positions along a unique column of any distribution, e.g. for eval rows."""
    return range_positions(df, [], [order], name)


def collate(df: DataFrame, pad_id: int, by: Sequence[str] = ("epoch", "batch_id")) -> DataFrame:
    """Right-pad ids, mask and labels to the longest row of the batch (a bounded group)."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(*by))

    def padded(column: str, fill: int) -> Column:
        gap = F.col("_longest") - F.size(column)
        return F.concat(column, F.array_repeat(F.lit(fill), gap))

    return (
        df.withColumn("_longest", longest)
        .withColumn("input_ids", padded("input_ids", pad_id))
        .withColumn("attention_mask", padded("attention_mask", 0))
        .withColumn("labels", padded("labels", IGNORE_INDEX))
        .drop("_longest")
    )


def skip_batches(plan: DataFrame, epoch: int, done: int) -> DataFrame:
    """Resume inside `epoch` after the first `done` steps of each device."""
    return plan.where((F.col("epoch") > epoch) | ((F.col("epoch") == epoch) & (F.col("step") >= done)))


def peek(df: DataFrame, keys: Sequence[str], rows: int = 3, seed: int = 0) -> DataFrame:
    """A few random rows for inspection."""
    keys = list(keys)
    return df.withColumn("_d", seeded_digest(seed, *keys)).orderBy("_d", *keys).limit(rows).drop("_d")


def resume_point(updates: int, accumulation: int, steps_per_epoch: int) -> tuple[int, int]:
    """Epoch and steps to skip in it after `updates` optimizer steps, for `skip_batches`."""
    return divmod(updates * accumulation, steps_per_epoch)


def step_summary(
    df: DataFrame,
    batch_size: int,
    devices: int,
    accumulation: int,
    epochs: int,
    warmup: float,
    max_updates: int | None = None,
) -> DataFrame:
    """Batches and updates of a run over the rows of `df`.

    Warm-up is a share of the updates one device would make alone; `updates` is what each of the
    devices makes. `max_updates` sets the updates instead of the epochs.
    """

    def ceil_div(a: Column, b: int | Column) -> Column:
        b = b if isinstance(b, Column) else F.lit(b)
        return F.call_function("div", a + b - 1, F.nullif(b, F.lit(0)))

    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    sized = rows.withColumn("batches", ceil_div(F.col("rows"), batch_size)).withColumn(
        "device_batches", ceil_div(F.col("batches"), devices)
    )
    per_epoch = F.col("updates_per_epoch")
    if max_updates is None:
        alone = ceil_div(F.col("batches"), accumulation) * epochs
        run = {"epochs": F.lit(epochs).cast("bigint"), "updates": per_epoch * epochs}
    else:
        alone = F.lit(max_updates).cast("bigint")
        run = {"epochs": ceil_div(alone, per_epoch), "updates": alone}
    return (
        sized.withColumn("updates_per_epoch", ceil_div(F.col("device_batches"), accumulation))
        .withColumns(run)
        .withColumn("warmup_updates", F.floor(alone * F.lit(warmup)))
        .withColumn("total_batch", F.lit(batch_size * devices * accumulation).cast("bigint"))
    )
