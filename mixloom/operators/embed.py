"""Prompts to vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.config import ENCODE_BATCH_ROWS
from mixloom.functions.hashing import HashingEncoder

Encoder = Callable[[list[str]], np.ndarray]


def embed(
    df: DataFrame,
    column: str = "inputs",
    encoder: Callable[[], Encoder] = HashingEncoder,
    batch_rows: int = ENCODE_BATCH_ROWS,
    name: str = "embedding",
) -> DataFrame:
    """Add one float vector per row.

    `encoder` makes a function from texts to a (texts, width) matrix. It is made once per Python
    worker and sees at most `batch_rows` texts per call; partitions spread the work.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for texts in batches:
            texts = texts.tolist()
            parts = [encode(texts[i : i + batch_rows]) for i in range(0, len(texts), batch_rows)]
            yield pd.Series([row for part in parts for row in np.asarray(part, dtype=np.float32)])

    return df.withColumn(name, run(column))
