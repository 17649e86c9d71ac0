"""Loss metrics per epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def eval_metrics(losses: DataFrame) -> DataFrame:
    """(epoch, eval_loss, perplexity); a batch weighs as much as it has rows.

    `losses` holds (epoch, batch_id, n, loss). exp overflows to infinity.
    """
    mean = F.sum(F.col("loss") * F.col("n")) / F.sum("n")
    return losses.groupBy("epoch").agg(mean.alias("eval_loss")).withColumn("perplexity", F.exp("eval_loss"))


def train_loss(losses: DataFrame) -> DataFrame:
    """(epoch, train_loss): total loss by number of batches."""
    mean = F.sum("loss") / F.count(F.lit(1))
    return losses.groupBy("epoch").agg(mean.alias("train_loss"))
