"""Helpers for operators that run Python over Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType


def type_name(df: DataFrame, column: str) -> str:
    """The SQL name of a column's type, to be put into a result schema."""
    kind: DataType = df.schema[column].dataType
    return kind.simpleString()


def small_batches(df: DataFrame) -> DataFrame:
    """The rows, of which at most 1,000 go to Python at a time from now on in this session: texts can be long, and
    executors hold a batch several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= 1000:
        df.sparkSession.conf.set(name, "1000")
    return df


def give_back() -> None:
    """Return freed memory to the system: workers go on to other tasks, and what they hold counts against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int, column: int = 1, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice has at most `rows` rows and about `size` bytes in a string column;
    a single longer text is a slice of its own."""
    for batch in batches:
        at = 0
        offsets = None
        if batch.num_rows:
            column_data = batch.column(column)
            if pa.types.is_string(column_data.type) or pa.types.is_large_string(column_data.type):
                wide = np.int64 if pa.types.is_large_string(column_data.type) else np.int32
                offsets = np.frombuffer(column_data.buffers()[1], wide)[column_data.offset : column_data.offset + batch.num_rows + 1]
        while at < batch.num_rows:
            to = min(at + rows, batch.num_rows)
            if offsets is not None:
                to = min(to, max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + size, side="right")) - 1))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def per_slice(
    function: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 2000
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that applies `function` to small slices, which bounds a worker's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows):
            yield function(part)

    return run


def lists(values: np.ndarray, lengths: np.ndarray, null: np.ndarray | None = None) -> pa.ListArray:
    """A list column from flat values and the length of each list; `null` marks lists that are null."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    mask = None if null is None or not null.any() else pa.array(null)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=mask)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and the length of each text."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.fromiter(map(len, texts), np.int64, len(texts))
