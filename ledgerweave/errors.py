"""One error row shape for every stage, and the result of a stage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Error codes.
EMPTY_FILE = "empty_file"
FILE_TOO_LARGE = "file_too_large"
TOO_MANY_COLUMNS = "too_many_columns"
PARSE_FAILED = "parse_failed"
REQUIRED_MISSING = "required_missing"
NAME_TOO_LONG = "name_too_long"
BAD_UNIT_NAME = "bad_unit_name"
DUPLICATE_IN_FILE = "duplicate_in_file"
UNKNOWN_GROUP = "unknown_group"
UNKNOWN_UNIT = "unknown_unit"
BAD_DECIMAL = "bad_decimal"
BAD_GSTIN = "bad_gstin"
BAD_HSN = "bad_hsn"
BAD_PAN = "bad_pan"
GROUP_CYCLE = "group_cycle"
BAD_DATE = "bad_date"
VOUCHER_UNBALANCED = "voucher_unbalanced"
VOUCHER_CONFLICT = "voucher_conflict"
INVENTORY_MISMATCH = "inventory_mismatch"
VALUE_NOT_ALLOWED = "value_not_allowed"
MISSING_COLUMN = "missing_column"
VALIDATION_ERROR = "validation_error"

ERROR_SCHEMA = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("source_row", T.LongType()),
        T.StructField("source_column", T.StringType()),
        T.StructField("target_field", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("suggestion", T.StringType()),
        T.StructField("upload", T.StringType()),
    ]
)
ERROR_COLUMNS = ERROR_SCHEMA.fieldNames()


def _quoted(value: str | None) -> str:
    return "cast(null as string)" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _part(value: Column | str | None) -> Column:
    return value if isinstance(value, Column) else F.expr(_quoted(value))


def issue(
    code: Column | str,
    column: Column | str | None,
    message: Column | str,
    severity: str = "error",
    raw: Column | None = None,
    suggestion: Column | None = None,
) -> Column:
    """The part of an error row that differs between rules. Constants form one literal struct."""
    if isinstance(code, Column) or isinstance(column, Column):
        kind = F.struct(
            _part(code).alias("code"), _part(severity).alias("severity"), _part(column).alias("source_column")
        )
    else:
        kind = F.expr(
            f"named_struct('code', {_quoted(code)}, 'severity', {_quoted(severity)}, 'source_column', {_quoted(column)})"
        )
    if raw is None and suggestion is None:
        more = F.expr("named_struct('raw', cast(null as string), 'suggestion', cast(null as string))")
    else:
        more = F.struct(_part(raw).alias("raw"), _part(suggestion).alias("suggestion"))
    return F.struct(kind.alias("kind"), _part(message).alias("message"), more.alias("more"))


def issue_sql(code: str, column: str | None, message: str, severity: str = "error") -> str:
    """As issue(), as SQL text for rules written in SQL; `message` is an SQL expression."""
    return (
        f"named_struct('kind', named_struct('code', {_quoted(code)}, 'severity', {_quoted(severity)}, "
        f"'source_column', {_quoted(column)}), 'message', {message}, "
        "'more', named_struct('raw', cast(null as string), 'suggestion', cast(null as string)))"
    )


def error_rows(df: DataFrame, issues: Column, stage: str, entity: str, row: str | None = "source_row") -> DataFrame:
    """Explode an array of issues (null entries allowed) into error rows. A column `upload` says which file they are about.

    The outer explode keeps the optimizer from adding a size check on the array,
    which would push a second copy of all rules below the projections.
    """
    exploded = df.select(
        (F.col(row) if row else F.lit(None)).cast("long").alias("source_row"),
        (F.col("upload") if "upload" in df.columns else F.lit(None)).cast("string").alias("upload"),
        F.explode_outer(issues).alias("issue"),
    ).filter(F.col("issue").isNotNull())
    return exploded.select(
        "issue.kind.code",
        "issue.kind.severity",
        F.lit(stage).alias("stage"),
        F.lit(entity).alias("entity"),
        "source_row",
        "issue.kind.source_column",
        F.col("issue.kind.source_column").alias("target_field"),
        "issue.message",
        "issue.more.raw",
        "issue.more.suggestion",
        "upload",
    )


def literal_errors(spark, rows: list[dict], stage: str, entity: str | None) -> DataFrame:
    """Error rows about the table as a whole (a missing column, an empty file)."""
    records = [
        tuple({**{c: None for c in ERROR_COLUMNS}, "severity": "error", "stage": stage, "entity": entity, **r}[c]
              for c in ERROR_COLUMNS)
        for r in rows
    ]
    return spark.createDataFrame(records, ERROR_SCHEMA)


def error_counts(errors: DataFrame) -> DataFrame:
    """error_count, warning_count and ok (no errors) as one row."""
    return errors.agg(
        F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
    ).withColumn("ok", F.col("error_count") == 0)


def error_summary(errors: DataFrame) -> DataFrame:
    """One row per code: count, first message and suggestion; errors sort before warnings.

    'First' is by source row, then message, so the result does not depend on
    the order in which tasks finish.
    """
    first = F.struct(F.coalesce("source_row", F.lit(0)), "severity", "message", "suggestion")
    return (
        errors.groupBy("code")
        .agg(F.count("*").alias("n"), F.min(first).alias("first"))
        .select(
            "code", F.col("first.severity").alias("severity"), "n",
            F.col("first.message").alias("message"), F.col("first.suggestion").alias("suggestion"),
        )
        .orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "code")
    )


@dataclass
class StageResult:
    """Lazy output of a stage. Nothing runs until a caller writes or counts."""

    data: DataFrame
    errors: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def stats(self) -> dict:
        counts = error_counts(self.errors).first().asDict()
        return {"rows": self.data.count(), **counts}

    def ok(self) -> bool:
        return self.errors.filter(F.col("severity") == "error").isEmpty()
