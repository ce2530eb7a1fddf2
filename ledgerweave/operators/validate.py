"""Master validation: required values, duplicates, value sets, formats, group cycles.

Every row rule is one entry of an array of issues, so all rules run in a single
projection. Only duplicates, value sets given as tables and cycles add joins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave import errors as E
from ledgerweave.errors import StageResult
from ledgerweave.functions.numbers import is_numeric_text
from ledgerweave.functions.text import norm_or_empty, trimmed_or_null
from ledgerweave.operators.groups import cyclic_groups
from ledgerweave.operators.joins import hot_safe_join
from ledgerweave.operators.suggest import suggestions
from ledgerweave.operators.vouchers import build_vouchers

# Formats and limits.
GSTIN = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1}$"
PAN = r"^[A-Z]{5}[0-9]{4}[A-Z]$"
HSN = r"^[0-9]{4,8}$"
PINCODE = r"^[0-9]{6}$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
MAX_NAME = 100
SIDES = ("Dr", "Cr", "DR", "CR", "dr", "cr")
REQUIRED = {
    "unit": ("name",), "group": ("name", "parent"), "stock_item": ("name", "base_units"), "ledger": ("name", "parent"),
}
NUMBERS = {
    "unit": ("decimal_places", "conversion"),
    "group": (),
    "stock_item": ("opening_qty", "opening_rate", "opening_value", "gst_rate"),
    "ledger": ("opening_balance", "credit_limit"),
}
FORMATS = {
    "unit": (),
    "group": (),
    "stock_item": (("hsn", HSN, E.BAD_HSN),),
    "ledger": (
        ("gstin", GSTIN, E.BAD_GSTIN), ("pan", PAN, E.BAD_PAN), ("email", EMAIL, E.VALUE_NOT_ALLOWED),
        ("pincode", PINCODE, E.VALUE_NOT_ALLOWED),
    ),
}

ValueSet = DataFrame | Iterable[str] | None
_LITERAL_LIMIT = 1000  # value lists up to this size become an IN test; larger ones become a join


def _say(column: str, tail: str) -> Column:
    return F.concat(F.lit(f"'{column}' value '"), F.col(column), F.lit(f"' {tail}"))


def _value_set(df: DataFrame, values: ValueSet) -> DataFrame | None:
    """A value set as a one-column table of distinct values; None when there is none to check against."""
    if values is None:
        return None
    if isinstance(values, DataFrame):
        return values.select(F.col(values.columns[0]).cast("string").alias("value")).dropna().distinct()
    listed = sorted(set(values))
    if not listed:
        return None
    return df.sparkSession.createDataFrame([(v,) for v in listed], "value string")


def _with_known(df: DataFrame, column: str, values: ValueSet) -> tuple[DataFrame, Column]:
    """The table and a condition that is true where `column` is not in the value set."""
    if not isinstance(values, DataFrame):
        listed = sorted(set(values))
        if len(listed) <= _LITERAL_LIMIT:
            return df, F.col(column).isNotNull() & ~F.col(column).isin(*listed)
    mark = f"_known_{column}"
    table = _value_set(df, values).select(F.col("value").alias(column), F.lit(True).alias(mark))
    return hot_safe_join(df, table, [column], "left"), F.col(column).isNotNull() & F.col(mark).isNull()


def validate(
    df: DataFrame,
    entity: str,
    known_groups: ValueSet = None,
    known_units: ValueSet = None,
    known_states: ValueSet = None,
    known_stock_groups: ValueSet = None,
) -> StageResult:
    """Check mapped rows (`source_row` plus canonical columns). `data` is the input, unchanged."""
    fields = [c for c in df.columns if c != "source_row"]
    work = df.select(F.col("source_row").cast("long").alias("source_row"),
                     *[trimmed_or_null(F.col(c).cast("string")).alias(c) for c in fields])
    if entity == "voucher":
        built = build_vouchers(work, stage="validate")
        return StageResult(df, built.errors, {"vouchers": built.vouchers})

    present = set(fields)
    missing = [c for c in REQUIRED[entity] if c not in present]
    rules: list[Column] = []
    for column in REQUIRED[entity]:
        if column in present:
            rules.append(F.when(F.col(column).isNull(), E.issue(E.REQUIRED_MISSING, column, f"'{column}' is required.")))
    if "name" in present:
        rules.append(
            F.when(F.length("name") > MAX_NAME, E.issue(E.NAME_TOO_LONG, "name", _say("name", "is too long.")))
        )
        if entity == "unit":
            rules.append(
                F.when(
                    F.col("name").rlike(r"\s"),
                    E.issue(E.BAD_UNIT_NAME, "name", _say("name", "is a unit symbol with spaces in it.")),
                )
            )
    for column in NUMBERS[entity]:
        if column in present:
            bad = F.col(column).isNotNull() & ~is_numeric_text(column)
            rules.append(
                F.when(bad, E.issue(E.BAD_DECIMAL, column, _say(column, "is not a plain number."), "warning"))
            )
    for column, pattern, code in FORMATS[entity]:
        if column in present:
            rules.append(
                F.when(~F.col(column).rlike(pattern),
                       E.issue(code, column, _say(column, "does not have the expected form."), "warning"))
            )
    if entity == "ledger" and "opening_balance_drcr" in present:
        rules.append(
            F.when(
                ~F.col("opening_balance_drcr").isin(*SIDES),
                E.issue(E.VALUE_NOT_ALLOWED, "opening_balance_drcr", _say("opening_balance_drcr", "is not Dr or Cr."),
                        "warning"),
            )
        )
    sets = {
        "ledger": (("parent", known_groups, E.UNKNOWN_GROUP, "error"),
                   ("state", known_states, E.VALUE_NOT_ALLOWED, "warning")),
        "stock_item": (("base_units", known_units, E.UNKNOWN_UNIT, "error"),
                       ("parent", known_stock_groups, E.VALUE_NOT_ALLOWED, "warning")),
    }.get(entity, ())
    checked = work
    for column, values, code, severity in sets:
        if column not in present or values is None or (not isinstance(values, DataFrame) and not list(values)):
            continue
        checked, unknown = _with_known(checked, column, values)
        hints = suggestions(work.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")),
                            _value_set(df, values))
        hints = hints.select(F.col("value").alias(column), F.col("suggestion").alias(f"_hint_{column}"))
        checked = hot_safe_join(checked, hints, [column], "left")
        hint = F.col(f"_hint_{column}")
        rules.append(
            F.when(
                unknown,
                E.issue(code, column, _say(column, f"is not a known {column}."), severity,
                        suggestion=F.when(hint.isNotNull(), F.concat(F.lit("Did you mean '"), hint, F.lit("'?")))),
            )
        )
    errors = E.error_rows(checked, F.array(*rules), "validate", entity) if rules else E.literal_errors(
        df.sparkSession, [], "validate", entity
    )
    if "name" in present:
        errors = errors.unionByName(duplicate_names(work, entity))
    if missing:
        errors = errors.unionByName(
            E.literal_errors(
                df.sparkSession,
                [
                    {"code": E.MISSING_COLUMN, "source_column": c, "target_field": c,
                     "message": f"Column '{c}' is missing."}
                    for c in missing
                ],
                "validate", entity,
            )
        )
    if entity == "group" and {"name", "parent"} <= present:
        errors = errors.unionByName(_cycle_error(work))
    return StageResult(df, errors)


def duplicate_names(df: DataFrame, entity: str) -> DataFrame:
    """An error for every copy of a name that occurs more than once (exact text after trimming; groups in any case).

    Counting combines on the map side. The repeated names then meet the rows in a
    join whose right side has one row per name; adaptive execution broadcasts it
    when small and splits a name that fills many rows.
    """
    # groups are found by name in any case, so variants of one name are copies too
    key = norm_or_empty("name") if entity == "group" else F.col("name")
    keyed = df.filter(F.col("name").isNotNull()).select("source_row", "name", key.alias("_key"))
    repeated = keyed.groupBy("_key").agg(F.count("*").alias("_copies")).filter(F.col("_copies") > 1)
    twin = F.xxhash64("_key").alias("_twin")  # gives the aggregate side its own shuffle, see vouchers
    rows = keyed.select("*", twin).join(repeated.select("_key", twin), ["_key", "_twin"], "left_semi")
    return E.error_rows(
        rows, F.array(E.issue(E.DUPLICATE_IN_FILE, "name", _say("name", "occurs more than once."))), "validate", entity
    )


def _cycle_error(work: DataFrame) -> DataFrame:
    """One table-level error when group parents form a cycle; it names the first group involved."""
    cyclic = cyclic_groups(work.filter(F.col("name").isNotNull()))
    found = cyclic.agg(F.count("*").alias("n"), F.min("name_key").alias("name")).filter(F.col("n") > 0)
    message = E.issue(
        E.GROUP_CYCLE, None, F.lit("The group hierarchy has a cycle."),
        raw=F.concat(F.col("n").cast("string"), F.lit(" groups, first '"), "name", F.lit("'")),
    )
    return E.error_rows(found, F.array(message), "validate", "group", row=None)
