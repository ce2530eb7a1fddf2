"""Column profiling: one row of signals per column.

The table is unpivoted, and counted per (column, comparison form) first. That
count combines on the map side, so a value that fills a third of a column stays
small. Whether a value is numeric or yes/no depends on its comparison form only,
so those tests run once per distinct value and are weighted by its count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions.numbers import is_numeric_text
from ledgerweave.functions.text import BOOLISH_WORDS, norm

# Shares that decide type and candidate key.
TYPE_SHARE = 0.8
KEY_DISTINCT = 0.99
KEY_NULL = 0.01
SAMPLES = 3


def _unpivoted(df: DataFrame, columns: list[str], row: str) -> DataFrame:
    """One (source_row, column, value) row per non-blank cell."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    )
    return df.select(F.col(row).alias("source_row"), cells.alias("cell")).select("source_row", "cell.column", "cell.value")


def profile(df: DataFrame, row: str = "source_row", approx: bool = False, samples: bool = True) -> DataFrame:
    """Profile every column but `row`: counts, distinct share, type, samples, candidate key.

    `approx` replaces the exact distinct count by a sketch, which needs no shuffle
    of the distinct values. Without `samples` the table is read once.
    """
    columns = [c for c in df.columns if c != row]
    total = df.agg(F.count("*").alias("total"))
    cells = _unpivoted(df, columns, row).withColumn("key", norm("value"))
    cells = cells.filter(F.coalesce(F.col("key"), F.lit("")) != "")
    if approx:
        per_column = cells.groupBy("column").agg(
            F.count("*").alias("n"),
            F.approx_count_distinct("key").alias("n_distinct"),
            F.count_if(is_numeric_text("key")).alias("n_numeric"),
            F.count_if(F.col("key").isin(*BOOLISH_WORDS)).alias("n_boolish"),
        )
    else:
        # a value travels as its digest, with the marks that its type is told by: its length does not matter
        marked = cells.select(
            "column", "source_row", F.unhex(F.md5("key")).alias("digest"), is_numeric_text("key").cast("int").alias("numeric"),
            F.col("key").isin(*BOOLISH_WORDS).cast("int").alias("boolish"),
        )
        values = marked.groupBy("column", "digest").agg(
            F.count("*").alias("n"), F.min("source_row").alias("first_row"), F.max("numeric").alias("numeric"), F.max("boolish").alias("boolish")
        )
        per_column = values.groupBy("column").agg(
            F.sum("n").alias("n"),
            F.count("*").alias("n_distinct"),
            F.sum(F.col("n") * F.col("numeric")).alias("n_numeric"),
            F.sum(F.col("n") * F.col("boolish")).alias("n_boolish"),
        )
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)], "position int, column string")
    # one row per column on both sides here; the table size is a single row
    joined = names.join(per_column, "column", "left").join(F.broadcast(total), F.lit(True))
    n = F.coalesce("n", F.lit(0))
    distinct = F.coalesce("n_distinct", F.lit(0))
    share = lambda part: F.when(n > 0, F.col(part) / n).otherwise(F.lit(0.0))
    null_share = F.when(n == 0, F.lit(1.0)).otherwise(F.lit(1.0) - n / F.col("total"))
    distinct_share = F.when(n > 0, distinct / n).otherwise(F.lit(0.0))
    kind = (
        F.when(n == 0, F.lit("empty"))
        .when(share("n_boolish") >= TYPE_SHARE, F.lit("boolean"))
        .when(share("n_numeric") >= TYPE_SHARE, F.lit("numeric"))
        .otherwise(F.lit("string"))
    )
    signals = joined.select(
        "column",
        "position",
        F.col("total").alias("row_count"),
        F.lit(len(columns)).alias("column_count"),
        n.alias("n"),
        distinct.alias("n_distinct"),
        kind.alias("inferred_type"),
        F.round(null_share, 4).alias("null_pct"),
        F.round(distinct_share, 4).alias("distinct_pct"),
        ((n > 0) & (distinct_share >= KEY_DISTINCT) & (null_share <= KEY_NULL)).alias("is_candidate_key"),
        share("n_numeric").alias("numeric_share"),
        share("n_boolish").alias("boolish_share"),
        distinct_share.alias("distinct_share"),
        null_share.alias("null_share"),
    )
    if approx or not samples:
        return signals
    return signals.join(_samples(values, df, row, columns), "column", "left").withColumn(
        "samples", F.coalesce("samples", F.array().cast("array<string>"))
    )


def _samples(values: DataFrame, df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """The first three distinct values of each column in file order, in their own spelling.

    The ranking keeps three rows per column before its shuffle. At most three rows
    per column are then looked up in the table, so that side is broadcast.
    """
    first = Window.partitionBy("column").orderBy("first_row")
    wanted = (
        values.select("column", "first_row", F.row_number().over(first).alias("rank"))
        .filter(F.col("rank") <= SAMPLES)
        .select("column", F.col("first_row").alias("source_row"))
    )
    spelled = _unpivoted(df, columns, row).join(F.broadcast(wanted), ["source_row", "column"])
    return spelled.groupBy("column").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("source_row", "value"))), lambda x: x["value"]).alias("samples")
    )
