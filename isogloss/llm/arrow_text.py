"""Arrow batches of texts for operators whose kernels run in Python."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and about how many bytes, that a kernel gets at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Rows of a batch that a kernel sends back, at most.
SENT_ROWS = 1 << 16

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def bounded_batches(spark: SparkSession) -> None:
    """Has Spark make Arrow batches of about BATCH_BYTES, unless the session already says how large they are to be. The
    value is the same for all operators, so that it doesn't matter which was called last."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of `rows` rows at most, and of fewer where rows are large. No batch is copied."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def frugal(run: Kernel) -> Kernel:
    """The kernel, whose batches are sent in pieces of SENT_ROWS rows at most, so that the JVM never holds a large one, and
    which at its end gives memory that is free, but kept by Arrow or the allocator, back to the machine: workers live on,
    beside those of the next tasks."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for made in run(batches):
                for at in range(0, max(1, made.num_rows), SENT_ROWS):
                    yield made.slice(at, SENT_ROWS)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
                ctypes.CDLL(None).malloc_trim(0)

    return task


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (long) and text (UTF-8 bytes); no other column is read."""
    bounded_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))


def map_texts(df: DataFrame, fn: Callable[[list[int | None], list[bytes | None]], dict[str, list]], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `schema` per row of df: fn gets some rows' ids and their texts as UTF-8 (None where null) and
    gives the columns. Only the two named columns are read; others, whatever their names, don't matter."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = fn(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return texts_of(df, id_col, text_col).mapInArrow(run, schema)
