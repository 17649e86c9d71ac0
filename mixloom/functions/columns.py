"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_digest(seed: int | Column, *columns: str) -> Column:
    """Hex digest that orders rows at random but alike on every run and partitioning."""
    seed = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed, *[F.col(c).cast("string") for c in columns]))


def of_setting(values: Sequence[object]) -> Column:
    """The value at the place `config_id`; never null inside the list."""
    return F.element_at(F.array(*map(F.lit, values)), F.col("config_id") + 1)


def whole(a: Column, b: int) -> Column:
    """Integer division."""
    return F.call_function("div", a, F.lit(b))


def ordinal(column: str, values: tuple[str, ...]) -> Column:
    """Place of a value in a short declared list; values outside it come last."""
    place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
    return F.when(place > 0, place - 1).otherwise(F.lit(len(values))).cast("int")
