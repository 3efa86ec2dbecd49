"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovecast.sources.fixtures import materialize, table

__all__ = ["materialize", "table", "binary_views", "per_row", "input_bytes", "fresh", "tidy"]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names not used in ``df`` yet (extra input columns may clash)."""
    used = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in used:
            n = "_" + n
        used.add(n.lower())
        out.append(n)
    return out


def input_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column, one aggregate row (sizes shard counts)."""
    row = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    return int(row["b"])


def binary_views(column: pa.Array) -> Iterator[memoryview | None]:
    """The values of a string or binary array as byte views, without copies."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    col = column.cast(kind) if not pa.types.is_large_binary(column.type) else column
    width = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    if not len(col):
        return
    offsets = np.frombuffer(col.buffers()[1], width, len(col) + 1, col.offset * np.dtype(width).itemsize)
    data = memoryview(col.buffers()[2]) if col.buffers()[2] is not None else memoryview(b"")
    valid = col.is_valid().to_numpy(zero_copy_only=False)
    for i, ok in enumerate(valid):
        yield data[offsets[i]:offsets[i + 1]] if ok else None


def per_row(fn, schema: pa.Schema):
    """``mapInArrow`` function that appends columns: ``fn(batch)`` gives a dict
    of arrays as long as the batch for the fields of ``schema``."""
    def apply(batches):
        for batch in batches:
            if batch.num_rows:
                cols = fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[f.name], f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name].cast(f.type)
                     for f in schema], schema=schema)
    return tidy(apply)


def hand_back() -> None:
    """Give the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its own way
        pass


#: Arrow batches between executors and their Python workers are at most about this large.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession | None) -> None:
    """Have this session cut Arrow batches at ``BATCH_BYTES`` (rows of megabytes, and the 10,000
    rows that are usual otherwise, would fill a worker and the JVM's buffers beside it)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is not None and str(spark.conf.get(key)).rstrip("b") != str(BATCH_BYTES):
        spark.conf.set(key, BATCH_BYTES)


def tidy(fn: Callable) -> Callable:
    """``fn`` for ``mapInArrow`` (a generator) or ``applyInArrow`` (one or two tables), which gets
    small batches and after which the worker hands its freed memory back.  Workers
    outlive their tasks, so what one stage has freed would else be held all through the next ones."""
    small_batches(SparkSession.getActiveSession())
    if inspect.isgeneratorfunction(fn):
        def run(batches):
            try:
                yield from fn(batches)
            finally:
                hand_back()
    elif len(inspect.signature(fn).parameters) == 1:
        def run(rows):
            try:
                return fn(rows)
            finally:
                hand_back()
    else:
        def run(left, right):
            try:
                return fn(left, right)
            finally:
                hand_back()
    return run


def worker_memory() -> dict:
    """A dict that lives as long as the Python worker process, across its tasks
    (functions arrive by value, so the globals of their modules don't)."""
    import sys
    import types
    name = "_grovecast_llm_worker"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def tokenizer_json(path: str) -> str:
    """A tokenizer file's text, read once on the driver: a file of fixed size
    (a few MB), shipped with the tasks so executors need no local copy."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def broadcast_text(spark: SparkSession, text: str):
    return spark.sparkContext.broadcast(text)
