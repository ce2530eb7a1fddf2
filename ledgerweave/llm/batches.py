"""Arrow batches in and out of tasks, and the keys of document rows."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 512
#: Bytes of a batch that goes to Python, where `small_batches` was called; after so many a worker gives back what it has freed.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches have at most `BATCH` bytes: by rows alone, one of long texts has tens of MB, and a task holds several copies."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def give_back() -> None:
    """Freed memory that the allocators of Arrow and C keep goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, in a worker that gives memory back: workers outlive their tasks, and idle ones count as well."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = 0
        for batch in batches:
            met += batch.nbytes
            yield batch
            del batch
            if met >= BATCH:
                give_back()
                met = 0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(read(batches))
        give_back()

    return task


def over_batches(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, rows: int = ROWS) -> DataFrame:
    """Apply `work` to slices of at most `rows` rows; it returns the columns of `schema` by name.

    The memory of a task follows one slice, not its partition.
    """
    names = re.findall(r"(\w+) [^,<]+(?:<.*?>+)?(?:, |$)", schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                made = work(batch.slice(start, rows))
                yield pa.RecordBatch.from_arrays([as_array(made[name]) for name in names], names=names)

    return df.mapInArrow(frugal(run), schema)


def as_array(values) -> pa.Array:
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values if isinstance(values, pa.Array) else pa.array(values)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of each text; null counts as the empty text."""
    return [text or b"" for text in batch.column(column).cast(pa.binary()).to_pylist()]


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def free_name(taken: list[str], name: str) -> str:
    """A column name like `name` that none of the taken ones equals, in any case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def row_key() -> list[Column]:
    """Names a row by its id and its text, both without null: rows that agree in both get equal results."""
    return [
        F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("row_id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row_hash"),
    ]
