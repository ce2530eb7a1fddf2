"""Staging area for raw rows: sink, tenant scan, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.sources.shared_folder import stored

# Columns that may hold the order id, and the retention.
ORDER_COLUMNS = ("order_id", "voucher_number", "Name")
RETENTION_DAYS = 30


def stage_records(df: DataFrame, org_id: Column | str, job_id: Column | str, created_at: Column | None = None) -> DataFrame:
    """Each raw row as JSON with tenant, job, order id and time. A projection, nothing more."""
    fields = [c for c in df.columns if c != "source_row"]
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    candidates = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ORDER_COLUMNS if c in df.columns]
    order = F.btrim(F.coalesce(*candidates)) if candidates else F.lit(None).cast("string")
    return df.select(
        lit(org_id).alias("org_id"),
        lit(job_id).alias("job_id"),
        order.alias("order_id"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields]), {"ignoreNullFields": "false"}).alias("data"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
    )


def write_staged(records: DataFrame, path: str) -> None:
    """Append, one folder per tenant and job. Readers of one tenant open its folders only."""
    records.write.mode("append").partitionBy("org_id", "job_id").parquet(path)


def for_org(df: DataFrame, org_id: str) -> DataFrame:
    """Rows of one tenant; on a table partitioned by tenant this prunes folders."""
    return df.filter(F.col("org_id") == org_id)


def _expired(now: Column | str, days: int) -> Column:
    at = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    return F.coalesce(F.col("created_at") < at - F.make_dt_interval(F.lit(days)), F.lit(False))


def expire_staged(df: DataFrame, now: Column | str, days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, one row with the number of rows to delete)."""
    expired = _expired(now, days)
    return df.filter(~expired), df.agg(F.count_if(expired).alias("deleted"))


def rewrite_staged(spark: SparkSession, path: str, target: str, now: Column | str, days: int = RETENTION_DAYS) -> int:
    """Write the surviving rows to a new path and return the number left out.

    The old path stays readable until the caller switches, so a lost job loses nothing.
    """
    kept, deleted = expire_staged(spark.read.parquet(path), now, days)
    kept.write.partitionBy("org_id", "job_id").parquet(target)
    return deleted.first()["deleted"]


def expire_in_place(spark: SparkSession, path: str, now: Column | str, days: int = RETENTION_DAYS) -> int:
    """Drop expired rows from the table itself and return their number. Only folders that hold one are written or removed.

    Survivors of those folders are first written to the shared folder, so a job that is lost can be run again.
    """
    table = spark.read.parquet(path)
    expired, keys = _expired(now, days), ["org_id", "job_id"]
    folder = F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]+$", 1).alias("folder")
    counted = table.select(*keys, folder, expired.alias("old")).groupBy(*keys, "folder").agg(
        F.count_if("old").alias("n_old"), F.count_if(~F.col("old")).alias("n_kept")
    )
    touched = stored(counted.filter("n_old > 0"))
    partly = touched.filter("n_kept > 0").select(*keys)
    survivors = stored(table.join(partly, keys).filter(~expired).select(*table.columns))
    survivors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    for row in touched.filter("n_kept = 0").select("folder").toLocalIterator():
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(row["folder"])
        place.getFileSystem(configuration).delete(place, True)
    return touched.agg(F.coalesce(F.sum("n_old"), F.lit(0)).alias("n")).first()["n"]
