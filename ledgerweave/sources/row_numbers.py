"""1-based source row numbers without sorting or a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.sources.shared_folder import stored

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row inside its partition in the low 33 bits


def with_source_row(df: DataFrame, name: str = "source_row") -> DataFrame:
    """Number the rows of a freshly scanned table, in scan order.

    Two passes, no shuffle of rows: one counts rows per scan partition, the other
    adds the offset of the partition to the position inside it. The offset table
    has one row per partition, so its size is the number of tasks. Both passes
    must see the same partitions; that holds for a scan of unchanged files, also
    when an executor is lost and its tasks run again. Write the result of a
    shuffle to a table first, or checkpoint it.
    """
    spark = df.sparkSession
    position = F.monotonically_increasing_id()
    counts = df.groupBy(F.spark_partition_id().alias("p")).count().collect()  # one row per task, not per record
    offsets, start = [], 0
    for row in sorted(counts):
        offsets.append((row["p"], start))
        start += row["count"]
    table = spark.createDataFrame(offsets or [(0, 0)], "_p int, _start long")
    numbered = df.withColumn("_id", position).withColumn("_p", F.shiftright("_id", _POSITION_BITS).cast("int"))
    within = F.col("_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        numbered.join(F.broadcast(table), "_p")
        .withColumn(name, F.col("_start") + within + 1)
        .drop("_id", "_p", "_start")
    )


def with_file_row(df: DataFrame, file: str, block: str, name: str = "source_row") -> DataFrame:
    """Number the rows of each file of a scan from 1, whatever other files are read beside it.

    `file` and `block` name columns that hold `_metadata.file_path` and `_metadata.file_block_start`. The driver holds one
    row per split.
    """
    numbered = df.withColumn("_id", F.monotonically_increasing_id())
    splits = numbered.groupBy(file, block).agg(F.min("_id").alias("low"), F.count("*").alias("n")).collect()
    offsets, start, last = [], 0, None
    for r in sorted(splits, key=lambda r: (r[file], r[block])):
        start = 0 if r[file] != last else start
        offsets.append((r[file], r[block], start - r["low"]))
        start, last = start + r["n"], r[file]
    table = df.sparkSession.createDataFrame(offsets, f"{file} string, {block} long, _shift long")
    return numbered.join(table, [file, block]).withColumn(name, F.col("_id") + F.col("_shift") + 1).drop("_id", "_shift", block)


def with_ordinal(df: DataFrame, by: list[str], name: str = "ordinal") -> DataFrame:
    """Number rows from 0 in the order of `by`, without one task that sees them all.

    A range sort is written to the shared folder with the slice and the place of each row in it; a prefix sum over
    slices, one row each, gives where a slice begins. The sort runs when this is called. Rows that tie in `by` are numbered
    in any order.
    """
    slices = df.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "*", F.spark_partition_id().alias("_slice"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("_at"))
    slices = stored(slices)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    starts = slices.groupBy("_slice").count().select("_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return slices.join(starts, "_slice").withColumn(name, F.col("_start") + F.col("_at")).drop("_slice", "_at", "_start")


def read_parquet_numbered(spark: SparkSession, path: str, name: str = "source_row") -> DataFrame:
    """Read parquet with 1-based row numbers taken from the files' own row index.

    Files are ordered by path; a file's offset is the row count of the files before
    it. With one file there is no second pass at all. The counts come from the
    parquet footers (no column is read) and hold one row per file.
    """
    df = spark.read.parquet(path)
    row = F.col("_metadata.row_index") + 1
    files = df.inputFiles()
    if len(files) <= 1:
        return df.select("*", row.alias(name))
    counts = df.groupBy(F.col("_metadata.file_path").alias("f")).count().collect()  # one row per file
    offsets, start = [], 0
    for r in sorted(counts):
        offsets.append((r["f"], start))
        start += r["count"]
    table = spark.createDataFrame(offsets, "_f string, _start long")
    return (
        df.select("*", row.alias("_row"), F.col("_metadata.file_path").alias("_f"))
        .join(F.broadcast(table) if len(offsets) <= 100_000 else table, "_f")
        .withColumn(name, F.col("_start") + F.col("_row"))
        .drop("_f", "_row", "_start")
    )
