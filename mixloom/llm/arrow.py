"""Arrow batches inside tasks: bounded slices, string buffers, added columns, tables kept per worker.

Rules that all operators share: a null text counts as empty; repeated rows are rows of their own; an empty table
gives an empty result; a column of the input that has the name of an added column is replaced by it.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# Texts of a slice together, so that arrays of a few words per byte stay small whatever the batch.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 1024


def kept(key: tuple, make: Callable):
    """What `make` gives, made once per Python worker: functions travel by value, so module globals would not last.

    Of every kind, key[0], a worker keeps the latest only.
    """
    store = sys.modules.setdefault("_mixloom_llm_kept", types.ModuleType("_mixloom_llm_kept")).__dict__
    if store.get(key[0], (None,))[0] != key:
        store.pop(key[0], None)
        store[key[0]] = key, make()
    return store[key[0]][1]


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (length + 1) of a string array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of SLICE_ROWS rows and about `limit` bytes at most; a longer text is a run of its own."""
    start, rows = 0, len(column)
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        yield from ((i, min(rows, i + SLICE_ROWS)) for i in range(0, rows, SLICE_ROWS))
        return
    _, offsets = strings(column)
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(rows, start + SLICE_ROWS, max(stop, start + 1))
        yield start, stop
        start = stop


def with_columns(df: DataFrame, text: str, added: str, kernel: Callable[[], Callable]) -> DataFrame:
    """`df` with the columns of the DDL `added`.

    `kernel()` makes, once per task, a function from a string array to one array per added column. It sees slices of
    SLICE_BYTES, so a task holds one Arrow batch and the work of one slice.
    """
    new = StructType.fromDDL(added)
    names = [f.name for f in new]
    rest = [c for c in df.columns if c not in names or c == text]
    shape = StructType([f for f in df.schema if f.name in rest and f.name not in names] + list(new))
    passed = [c for c in rest if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = kernel()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for start, stop in slices(column):
                made = [pa.array(a) if not isinstance(a, pa.Array) else a for a in work(column.slice(start, stop - start))]
                own = [batch.column(batch.schema.get_field_index(c)).slice(start, stop - start) for c in passed]
                yield pa.RecordBatch.from_arrays(own + made, passed + names)

    return df.select(*{c: None for c in [*passed, text]}).mapInArrow(run, shape)


def filtered(df: DataFrame, column: str, kernel: Callable[[], Callable]) -> DataFrame:
    """The rows of `df`, with its own columns, for which the function of `kernel()` over `column` is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = kernel()
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column))
            for start, stop in slices(values):
                rows = keep(values.slice(start, stop - start))
                yield batch.slice(start, stop - start).filter(pa.array(rows, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def gathered(starts: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The pieces data[start : start + length] one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total, dtype=np.int64)
    index += np.repeat(starts - (ends - lengths), lengths)
    return data[index]
