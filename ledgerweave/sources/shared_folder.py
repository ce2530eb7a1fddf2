"""The folder for checkpoints: the one the cluster names, else a temporary one in local runs."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column that names the folder a row of a sliced table lies in.
SLICE = "slice"
# Rows of a group of a sliced table: with many slices open at once, smaller groups keep the memory of a writer in bounds.
_GROUP_BYTES = 16 << 20
# The shuffle files of a query go when it ends, and not when the driver collects its garbage.
_FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure checkpoints have a folder that survives the loss of an executor."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
        named = tempfile.mkdtemp(prefix="run-")
    context.setCheckpointDir(named)
    return named


def _new_table(spark: SparkSession) -> str:
    return posixpath.join(ensure_checkpoint_dir(spark), f"table-{uuid.uuid4().hex}")


def stored(df: DataFrame) -> DataFrame:
    """Compute once, write compressed columns to the shared folder, and go on from the files."""
    spark = df.sparkSession
    path = _new_table(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def written(df: DataFrame) -> str:
    """As `stored`, and the shuffle files of this write go when it ends. Returns the folder."""
    path = _new_table(df.sparkSession)
    with _settings(df.sparkSession, _FREED):
        df.write.option("compression", "zstd").parquet(path)
    return path


def read_back(spark: SparkSession, schema: T.StructType, *paths: str) -> DataFrame:
    """The rows of all these folders as one table."""
    return spark.read.schema(schema).parquet(*paths)


def written_in_slices(df: DataFrame, slices: int) -> str:
    """As `written`, with a folder for each value of the integer column `slice` (0 to `slices` - 1): a filter on it reads those folders alone.

    A task writes all slices side by side, so its rows are neither sorted nor shuffled.
    """
    spark = df.sparkSession
    path = _new_table(spark)
    with _settings(spark, _FREED | {"spark.sql.maxConcurrentOutputFileWriters": str(slices)}):
        df.write.partitionBy(SLICE).option("compression", "zstd").option("parquet.block.size", _GROUP_BYTES).parquet(path)
    return path


def empty_slice(spark: SparkSession, schema: T.StructType, path: str, number: int) -> None:
    """Take the rows of one slice off the disk. The table still reads, without them."""
    nothing = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name != SLICE])
    nothing.coalesce(1).write.mode("overwrite").parquet(posixpath.join(path, f"{SLICE}={number}"))
