"""Shared by the operators of this folder: reading, folds, Arrow slices, copies in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.session import cut_lineage

#: Text bytes that a numpy step works on at once; a longer document is worked on alone.
SLICE_BYTES = 1 << 20
#: Rows in an Arrow batch: texts may be long, and a batch is held whole by a Python worker.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone (null text: empty), so that other columns can't clash."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64-bit name of a row from its id and its text: rows that share an id (or have none) but not a text stay apart."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` text bytes (or one row)."""
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1]
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def text_array(column: pa.Array) -> pa.StringArray:
    return column.cast(pa.string()) if column.type != pa.string() else column


def arrow_schema(ddl_df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(ddl_df.schema)


def batch(names: list[str], arrays: list, types: list[pa.DataType]) -> pa.RecordBatch:
    cols = [a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(arrays, types, strict=True)]
    return pa.RecordBatch.from_arrays([c.cast(t) if c.type != t else c for c, t in zip(cols, types, strict=True)],
                                      names=names)


def give_back() -> None:
    """Returns to the system what Arrow and the allocator hold without use: a Python worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def rewritten(df: DataFrame) -> DataFrame:
    """A copy in the shared folder, so that several readers share one run and lost executors cost little."""
    return cut_lineage(df)
