"""Run voucher imports on files as they arrive.

Row rules run unchanged on a stream. A voucher needs all of its lines, and a
file holds whole vouchers, so grouping runs per micro-batch of complete files.
Rows are numbered per file and vouchers are keyed by file, so the result does not
depend on which files meet in a batch.
The batch id is part of every output path: a batch that is repeated after a
failure overwrites its own output and duplicates nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerweave.operators.vouchers import VoucherResult, build_vouchers
from ledgerweave.sources.row_numbers import with_file_row


def build_vouchers_from(
    spark: SparkSession,
    source: str,
    columns: list[str],
    target: str,
    checkpoint: str,
    build: Callable[[DataFrame], VoucherResult] = build_vouchers,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Read canonical CSV files from `source`, write vouchers, lines and errors below `target` per batch.

    `upload` in all three is the path of the file.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    stream = (
        spark.readStream.schema(schema).option("header", "true").option("maxFilesPerTrigger", files_per_batch).csv(source)
        .select("*", F.col("_metadata.file_path").alias("upload"), F.col("_metadata.file_block_start").alias("_block"))
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        result = build(with_file_row(batch, "upload", "_block"))
        for name, df in (("vouchers", result.vouchers), ("lines", result.lines), ("errors", result.errors)):
            df.write.mode("overwrite").parquet(f"{target}/{name}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
