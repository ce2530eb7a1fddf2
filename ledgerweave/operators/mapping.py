"""Source columns to canonical fields: scores, one-to-one assignment, checks, projection.

A profile has one row per column of an upload, so everything up to the projection
works on a few rows per upload. Many uploads are mapped in one pass: every step
is keyed by `upload`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.functions.similarity import token_set_ratio
from ledgerweave.functions.text import norm
from ledgerweave.sources.catalog import catalog, fields

# Thresholds of the mapping status.
AUTO_ACCEPT, NEEDS_CONFIRM, NEAR_TIE = 0.85, 0.62, 0.07
ALTERNATIVES = 3
TEMPLATE_CONFIDENCE = 0.99
# Targets that are not in every catalog but may be mapped.
EXTRA_TARGETS = ("opening_balance_drcr", "guid", "old_name")


def header_scores(headers: DataFrame, entity: str) -> DataFrame:
    """(header, target_field, header_score): best token-set ratio against label, key and synonyms.

    `headers` has a column `header`. Distinct headers are scored once each, in
    Arrow batches; a header returns the scores of all fields as one array.
    """
    targets = [[" ".join(t.lower().split()) for t in (f.label, f.key, *f.synonyms)] for f in fields(entity)]
    keys = [f.key for f in fields(entity)]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(column: pd.Series) -> pd.Series:
        return column.map(lambda h: [max(token_set_ratio(h, t) for t in ts) / 100.0 for ts in targets])

    distinct = headers.select("header").distinct()
    scored = distinct.select("header", score(F.coalesce(norm("header"), F.lit(""))).alias("scores"))
    names = F.array(*[F.lit(k) for k in keys])
    return scored.select("header", F.explode(F.arrays_zip(names.alias("target_field"), F.col("scores").alias("header_score"))).alias("s")).select(
        "header", "s.target_field", "s.header_score"
    )


def type_multiplier() -> Column:
    """How well the values of a column fit the type of a field, from the profile's shares."""
    numeric, distinct = F.col("numeric_share"), F.col("distinct_share")
    return (
        F.when(F.col("n") == 0, F.lit(1.0))
        .when(
            F.col("dtype").isin("amount", "decimal", "integer"),
            F.when(numeric >= 0.8, F.lit(1.0)).when(numeric >= 0.4, F.lit(0.8)).otherwise(F.lit(0.3)),
        )
        .when(F.col("dtype") == "bool", F.when(F.col("boolish_share") >= 0.8, F.lit(1.0)).otherwise(F.lit(0.5)))
        .when(
            F.col("unique"),
            F.when((distinct >= 0.95) & (F.col("null_share") <= 0.05), F.lit(1.0))
            .when(distinct < 0.5, F.lit(0.6))
            .otherwise(F.lit(0.9)),
        )
        .otherwise(F.lit(1.0))
    )


def mapping_scores(profiles: DataFrame, entity: str) -> DataFrame:
    """(upload, target_field, column, confidence) for every field and column of an upload."""
    if "upload" not in profiles.columns:
        profiles = profiles.withColumn("upload", F.lit(""))
    wanted = catalog(profiles.sparkSession, entity).select(
        F.col("key").alias("target_field"), F.col("position").alias("field_position"), "label", "dtype", "required", "unique"
    )
    scores = header_scores(profiles.select(F.col("column").alias("header")), entity)
    return (
        profiles.join(scores.withColumnRenamed("header", "column"), "column")
        .join(F.broadcast(wanted), "target_field")  # at most 24 rows
        .select(
            "upload", "target_field", "field_position", "label", "required", "column", "position",
            (type_multiplier() * F.col("header_score")).alias("confidence"),
        )
    )


def _best_assignment(gain: np.ndarray) -> list[int]:
    """Column of each row with the largest total gain, -1 for none: shortest augmenting paths with potentials."""
    n, m = gain.shape
    if n > m:
        turned = _best_assignment(gain.T)
        out = [-1] * n
        for column, row in enumerate(turned):
            out[row] = column
        return out
    cost = gain.max() - gain if gain.size else gain
    left, right = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        slack = np.full(m, np.inf)
        before = np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        current, at = row, -1
        while True:
            reduced = cost[current] - left[current] - right
            offset = 0.0 if at < 0 else slack[at]
            better = ~done & (reduced + offset < slack)
            slack[better], before[better] = (reduced + offset)[better], at
            at = int(np.where(done, np.inf, slack).argmin())
            done[at] = True
            if owner[at] < 0:
                break
            current = owner[at]
        reach = slack[at]
        closed = done & (np.arange(m) != at)
        left[row] += reach
        left[owner[closed]] += reach - slack[closed]
        right[closed] -= reach - slack[closed]
        while at >= 0:
            previous = before[at]
            owner[at] = row if previous < 0 else owner[previous]
            at = previous
    out = [-1] * n
    for column, row in enumerate(owner):
        if row >= 0:
            out[row] = column
    return out


def assign_columns(scores: DataFrame) -> DataFrame:
    """(upload, target_field, source_column): the one-to-one assignment with the largest total confidence.

    A group is one upload: fields times columns, bounded by the width of a table
    and never by its rows.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index=["field_position", "target_field"], columns=["position", "column"], values="confidence")
        chosen = _best_assignment(grid.to_numpy())
        rows = [
            (pdf["upload"].iloc[0], grid.index[i][1], grid.columns[c][1]) for i, c in enumerate(chosen) if c >= 0
        ]
        return pd.DataFrame(rows, columns=["upload", "target_field", "assigned"])

    slim = scores.select("upload", "target_field", "field_position", "column", "position", "confidence")
    return slim.groupBy("upload").applyInPandas(solve, schema="upload string, target_field string, assigned string")


def suggest_mapping(profiles: DataFrame, entity: str) -> DataFrame:
    """One suggestion per upload and field: source column, confidence, status, alternatives."""
    scores = mapping_scores(profiles, entity)
    assigned = assign_columns(scores)
    order = Window.partitionBy("upload", "target_field").orderBy(F.desc("confidence"), "position")
    ranked = scores.withColumn("rank", F.row_number().over(order)).join(assigned, ["upload", "target_field"], "left")
    mine = F.col("column") == F.col("assigned")
    # fields times columns of one upload: a few rows per group
    grouped = ranked.groupBy("upload", "target_field").agg(
        F.first("field_position").alias("field_position"),
        F.first("label").alias("label"),
        F.first("required").alias("required"),
        F.first("assigned").alias("assigned"),
        F.max(F.when(mine, F.col("confidence"))).alias("best"),
        F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col("confidence"))).alias("second"),
        F.sort_array(
            F.collect_list(
                F.when((F.col("rank") <= ALTERNATIVES + 1) & ~F.coalesce(mine, F.lit(False)),
                       F.struct("rank", "column", F.round("confidence", 4).alias("score")))
            )
        ).alias("others"),
    )
    best = F.coalesce("best", F.lit(0.0))
    tie = F.coalesce((F.col("first") - F.col("second") < NEAR_TIE) & (F.col("second") >= NEEDS_CONFIRM), F.lit(False))
    status = (
        F.when(best < NEEDS_CONFIRM, F.lit("unmapped"))
        .when((best < AUTO_ACCEPT) | tie | F.col("required"), F.lit("needs_confirm"))
        .otherwise(F.lit("auto_accept"))
    )
    return grouped.select(
        "upload", "target_field", "field_position", "label", "required",
        F.when(best >= NEEDS_CONFIRM, F.col("assigned")).alias("source_column"),
        F.round(best, 4).alias("confidence"),
        status.alias("status"),
        F.lit("fuzzy").alias("method"),
        F.transform(F.slice("others", 1, ALTERNATIVES),
                    lambda x: F.struct(x["column"].alias("column"), x["score"].alias("score"))).alias("alternatives"),
    )


def unmapped_sources(profiles: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Columns of an upload that no suggestion uses."""
    if "upload" not in profiles.columns:
        profiles = profiles.withColumn("upload", F.lit(""))
    used = suggestions.select("upload", F.col("source_column").alias("column"))
    return profiles.select("upload", "column", "position").join(used, ["upload", "column"], "left_anti")


def unmapped_required(suggestions: DataFrame) -> DataFrame:
    return suggestions.filter(F.col("required") & F.col("source_column").isNull()).select("upload", "target_field")


def mapping_plan(suggestions: DataFrame) -> DataFrame:
    """The assigned columns of a proposal."""
    return suggestions.filter(F.col("source_column").isNotNull()).select(
        "upload", "source_column", "target_field", "confidence", "method"
    )


def proposal_stats(suggestions: DataFrame) -> DataFrame:
    return suggestions.groupBy("upload").agg(
        F.count_if(F.col("status") == "auto_accept").alias("auto_accepted"),
        F.count_if(F.col("status") == "needs_confirm").alias("needs_confirm"),
        F.count_if(F.col("required") & F.col("source_column").isNull()).alias("unmapped_required"),
    )


def overlay_template(suggestions: DataFrame, template: DataFrame, columns: DataFrame) -> DataFrame:
    """Let the template of an upload win over the fuzzy proposal where its column is present.

    template: upload, name, mapping (target -> source). columns: upload, column.
    `shared` marks a source column that the overlay gives to two fields.
    """
    entries = template.select("upload", F.explode("mapping").alias("target_field", "template_column"))
    present = entries.join(
        columns.select("upload", F.col("column").alias("template_column")).distinct(), ["upload", "template_column"], "left_semi"
    )
    won = F.col("template_column").isNotNull()
    merged = suggestions.join(present, ["upload", "target_field"], "left").select(
        *[c for c in suggestions.columns if c not in ("source_column", "confidence", "status", "method")],
        F.coalesce("template_column", "source_column").alias("source_column"),
        F.when(won, F.greatest("confidence", F.lit(TEMPLATE_CONFIDENCE))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(won, F.lit("auto_accept")).otherwise(F.col("status")).alias("status"),
        F.when(won, F.lit("template")).otherwise(F.col("method")).alias("method"),
    )
    # an upload has at most 24 fields, so these windows are tiny
    same = Window.partitionBy("upload", "source_column")
    return merged.withColumn("shared", F.col("source_column").isNotNull() & (F.count("*").over(same) > 1))


class MappingError(ValueError):
    """A mapping that names unknown columns or targets, or leaves required fields open."""


def apply_mapping(
    df: DataFrame,
    entity: str,
    mapping: dict[str, str | None] | None = None,
    constants: dict[str, str] | None = None,
    template: str | None = None,
) -> DataFrame:
    """Project source columns to canonical names; `source_row` rides along. Checks run before any job."""
    from ledgerweave.operators.templates import builtin_template

    mapping, constants = dict(mapping or {}), dict(constants or {})
    if template:
        base_mapping, base_constants = builtin_template(template)
        mapping, constants = {**base_mapping, **mapping}, {**base_constants, **constants}
    used = {target: source for target, source in mapping.items() if source}
    unknown = sorted({s for s in used.values() if s not in df.columns})
    if unknown:
        raise MappingError(f"Columns not in the file: {unknown}")
    allowed = {f.key for f in fields(entity)} | set(EXTRA_TARGETS)
    strange = sorted((set(used) | set(constants)) - allowed)
    if strange:
        raise MappingError(f"Unknown target fields for {entity}: {strange}")
    open_fields = [f.key for f in fields(entity) if f.required and f.key not in used and f.key not in constants]
    if open_fields:
        raise MappingError(f"Required fields are not mapped: {open_fields}")
    return project(df, used, constants)


def project(df: DataFrame, mapping: dict[str, str | None], constants: dict[str, str] | None = None) -> DataFrame:
    """Rename without checks: one source may feed many targets, a constant replaces a column."""
    constants = constants or {}
    keep = ["source_row"] if "source_row" in df.columns else []
    columns = [
        F.col(f"`{s}`").alias(t) for t, s in mapping.items() if s and s in df.columns and t not in constants
    ]
    return df.select(*keep, *columns, *[F.lit(v).alias(t) for t, v in constants.items()])
