"""Mapped rows to typed master tables: units, groups, ledgers, stock items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave import errors as E
from ledgerweave.errors import StageResult
from ledgerweave.functions.numbers import is_bad_decimal, side_of, to_decimal
from ledgerweave.functions.xml_text import NOT_XML
from ledgerweave.functions.text import NO_WORDS, YES_WORDS, clean_columns, is_one_of

# Defaults.
PRIMARY = "Primary"
COUNTRY = "India"

_COMMON = ("name", "guid", "old_name", "_action")
_TEXT = {
    "unit": ("base_units", "additional_units"),
    "group": ("parent",),
    "ledger": ("parent", "gstin", "gst_registration_type", "state", "mailing_name", "pincode", "email", "phone",
               "opening_balance", "opening_balance_drcr", "country", "address", "pan"),
    "stock_item": ("parent", "base_units", "hsn", "category", "description"),
}
_NUMBERS = {
    "unit": ("decimal_places", "conversion"),
    "group": (),
    "ledger": ("credit_limit",),
    "stock_item": ("opening_qty", "opening_rate", "opening_value"),
}
_FLAGS = {
    "unit": (),
    "group": ("is_revenue", "is_deemed_positive", "is_billwise", "affects_gross_profit"),
    "ledger": ("is_billwise",),
    "stock_item": ("gst_applicable",),
}
_REQUIRED = {"unit": (), "group": (), "ledger": ("parent",), "stock_item": ("base_units",)}
# Catalog fields that the plain conversion leaves aside; extra_fields=True reads them.
_EXTRA = ("affects_gross_profit", "country", "address", "pan", "category", "description")


def _flag(c: str) -> Column:
    word = F.lower(F.col(c))
    return F.when(is_one_of(word, YES_WORDS), F.lit(True)).when(is_one_of(word, NO_WORDS), F.lit(False))


def convert_masters(df: DataFrame, entity: str, extra_fields: bool = False) -> StageResult:
    """Typed master rows, and an error row for each cell or row that could not be converted.

    A bad optional cell becomes null and is reported. A row without its required
    values, or a ledger with an unreadable opening balance, is left out. All of it
    is one projection over the input.
    """
    names = [*_COMMON, *_TEXT[entity], *_NUMBERS[entity], *_FLAGS[entity]]
    usable = {c for c in df.columns if extra_fields or c not in _EXTRA}
    rows = df.select(
        F.col("source_row").cast("long").alias("source_row"),
        *[(F.col(c) if c in usable else F.lit(None)).cast("string").alias(c) for c in names],
    )
    rows = clean_columns(rows, [c for c in names if c in usable])
    parsed = {f"{c}_value": to_decimal(c, clean=True) for c in _NUMBERS[entity]}
    parsed |= {f"{c}_value": _flag(c) for c in _FLAGS[entity]}
    if entity == "ledger":
        parsed["opening_value"] = to_decimal("opening_balance", clean=True)
    rows = rows.withColumns(parsed) if parsed else rows
    texts = [c for c in (*_COMMON, *_TEXT[entity]) if c in usable]

    fatal = F.when(F.col("name").isNull(), E.issue(E.REQUIRED_MISSING, "name", "A name is needed."))
    fatal = fatal.when(
        F.concat_ws("", *texts).rlike(NOT_XML), E.issue(E.VALUE_NOT_ALLOWED, None, "A cell holds a character that XML cannot carry.")
    )
    for c in _REQUIRED[entity]:
        fatal = fatal.when(F.col(c).isNull(), E.issue(E.REQUIRED_MISSING, c, f"'{c}' is needed."))
    if entity == "ledger":
        fatal = fatal.when(
            is_bad_decimal("opening_balance", F.col("opening_value"), clean=True),
            E.issue(E.VALIDATION_ERROR, "name",
                    F.concat(F.lit("The opening balance '"), "opening_balance", F.lit("' is not a number."))),
        )
    soft = [
        F.when(
            is_bad_decimal(c, F.col(f"{c}_value"), clean=True),
            E.issue(E.BAD_DECIMAL, c, F.concat(F.lit("'"), c, F.lit("' is not a number."))),
        )
        for c in _NUMBERS[entity]
    ] + [
        F.when(
            F.col(c).isNotNull() & F.col(f"{c}_value").isNull(),
            E.issue(E.VALUE_NOT_ALLOWED, c, F.concat(F.lit("'"), c, F.lit("' is not yes or no."))),
        )
        for c in _FLAGS[entity]
    ]
    if entity == "unit":
        places = F.col("decimal_places_value")
        soft.append(F.when(
            places.isNotNull() & places.try_cast("int").isNull(),
            E.issue(E.BAD_DECIMAL, "decimal_places", F.concat(F.lit("'"), "decimal_places", F.lit("' is too large a number of places."))),
        ))
    rows = rows.withColumn("fatal", fatal)
    # a row without its name or parent reports that alone; an unreadable balance reports the cells as well
    lone = F.col("fatal.kind.code") == E.REQUIRED_MISSING
    issues = F.array(F.col("fatal"), *[F.when(~F.coalesce(lone, F.lit(False)), s) for s in soft])
    errors = E.error_rows(rows, issues, "convert", entity)

    kept = rows.filter(F.col("fatal").isNull())
    action = F.when(F.lower("_action") == "alter", F.lit("Alter")).otherwise(F.lit("Create"))
    head = ["source_row", "name", action.alias("action"), "guid", "old_name"]
    data = kept.select(*head, *_typed(entity))
    return StageResult(data, errors)


def _typed(entity: str) -> list[Column]:
    if entity == "unit":
        return [
            F.col("base_units").isNull().alias("is_simple"),
            F.coalesce(F.col("decimal_places_value").try_cast("int"), F.lit(0)).alias("decimal_places"),
            F.col("base_units"),
            F.col("additional_units"),
            F.col("conversion_value").alias("conversion"),
        ]
    if entity == "group":
        return [F.coalesce("parent", F.lit(PRIMARY)).alias("parent"),
                *[F.col(f"{c}_value").alias(c) for c in _FLAGS["group"]]]
    if entity == "ledger":
        value = F.col("opening_value")
        return [
            F.col("parent"),
            F.coalesce(F.abs(value), F.lit(0)).cast("decimal(38,6)").alias("opening_balance"),
            F.when(value.isNull(), F.lit(True))
            .otherwise(side_of("opening_balance", "opening_balance_drcr", value, clean=True))
            .alias("opening_is_debit"),
            F.col("gst_registration_type"), F.col("gstin"), F.col("state"),
            F.coalesce("country", F.lit(COUNTRY)).alias("country"),
            F.col("is_billwise_value").alias("is_billwise"),
            F.col("mailing_name"), F.col("address"), F.col("pincode"), F.col("email"), F.col("phone"),
            F.col("credit_limit_value").alias("credit_limit"),
        ]
    return [
        F.coalesce("parent", F.lit(PRIMARY)).alias("parent"),
        F.col("base_units"), F.col("category"), F.col("description"),
        F.col("opening_qty_value").alias("opening_qty"),
        F.col("opening_rate_value").alias("opening_rate"),
        F.col("opening_value_value").alias("opening_value"),
        F.col("hsn").alias("hsn_code"),
        F.coalesce("gst_applicable_value", F.lit(False)).alias("gst_applicable"),
    ]


def to_units(df: DataFrame, **options) -> StageResult:
    return convert_masters(df, "unit", **options)


def to_groups(df: DataFrame, **options) -> StageResult:
    return convert_masters(df, "group", **options)


def to_ledgers(df: DataFrame, **options) -> StageResult:
    return convert_masters(df, "ledger", **options)


def to_stock_items(df: DataFrame, **options) -> StageResult:
    return convert_masters(df, "stock_item", **options)


def conversion_counts(rows: DataFrame, held: DataFrame, result: StageResult) -> DataFrame:
    """generated / held / skipped / errors of a conversion as one row; ok is false when nothing came out.

    `rows` went into the conversion, `held` were kept back as conflicts.
    """
    one = F.lit(1)
    parts = (
        rows.select(one.alias("i"), F.lit(0).alias("h"), F.lit(0).alias("g"), F.lit(0).alias("e"))
        .unionByName(held.select(F.lit(0).alias("i"), one.alias("h"), F.lit(0).alias("g"), F.lit(0).alias("e")))
        .unionByName(result.data.select(F.lit(0).alias("i"), F.lit(0).alias("h"), one.alias("g"), F.lit(0).alias("e")))
        .unionByName(result.errors.select(F.lit(0).alias("i"), F.lit(0).alias("h"), F.lit(0).alias("g"), one.alias("e")))
    )
    sums = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "ihge"])
    return sums.select(
        F.col("g").alias("generated"), F.col("h").alias("held"), (F.col("i") - F.col("g")).alias("skipped"),
        F.col("e").alias("errors"), (F.col("g") > 0).alias("ok"),
    )
