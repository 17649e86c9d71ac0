"""From a prepared dataset to padded batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from mixloom.cluster import stored
from mixloom.functions.hashing import PAD_ID
from mixloom.operators.checks import PAIR_COLUMNS, require_columns
from mixloom.operators.tuning import (
    Tokenizer,
    batch_plan,
    collate,
    concat_pair,
    given_order,
    mask_labels,
    resolve_max_len,
    step_summary,
    tokenize,
)


@dataclass(frozen=True)
class TuningConfig:
    """Settings of a run; `seed` orders the train rows, `model_max_length` is the tokenizer's."""

    max_seq_length: int | None = 512
    model_max_length: int = 4096
    train_batch_size: int = 4
    eval_batch_size: int = 4
    devices: int = 1
    accumulation: int = 16
    epochs: int = 3
    warmup: float = 0.01
    max_updates: int | None = None
    seed: int = 0
    pad_id: int = PAD_ID


def labelled_ids(
    pairs: DataFrame, keys: Sequence[str], cfg: TuningConfig, tokenizer: Callable[[], Tokenizer] | None = None
) -> DataFrame:
    """(keys..., input_ids, attention_mask, labels) of each pair, without shuffles."""
    texts = concat_pair(require_columns(pairs, [*keys, *PAIR_COLUMNS]).select(*keys, *PAIR_COLUMNS))
    length = resolve_max_len(cfg.max_seq_length, cfg.model_max_length)
    return mask_labels(tokenize(texts, length, tokenizer))


def training_batches(
    pairs: DataFrame, keys: Sequence[str], cfg: TuningConfig, tokenizer: Callable[[], Tokenizer] | None = None
) -> DataFrame:
    """Padded batches of all epochs. Rows are placed by their keys, stored once; ids move once per epoch."""
    plan = batch_plan(
        stored(pairs.select(*keys)), keys, cfg.train_batch_size, cfg.devices, cfg.accumulation, cfg.epochs, cfg.seed
    )
    return collate(plan.join(labelled_ids(pairs, keys, cfg, tokenizer), list(keys)), cfg.pad_id)


def eval_batches(
    pairs: DataFrame, order: str, cfg: TuningConfig, tokenizer: Callable[[], Tokenizer] | None = None
) -> DataFrame:
    """Padded batches of the held-out rows along `order`, a unique integer column."""
    placed = given_order(pairs.select(order), order)
    plan = batch_plan(placed, [order], cfg.eval_batch_size, cfg.devices, seed=None, order="place")
    return collate(plan.join(labelled_ids(pairs, [order], cfg, tokenizer), order), cfg.pad_id)


def run_steps(pairs: DataFrame, cfg: TuningConfig) -> DataFrame:
    """Batches, updates and warm-up of the run."""
    return step_summary(
        pairs, cfg.train_batch_size, cfg.devices, cfg.accumulation, cfg.epochs, cfg.warmup, cfg.max_updates
    )
