"""Fill in what a table of HSN codes knows about items: the entry with the longest code that begins an item's code wins.

Codes have 2, 4, 6 or 8 digits, each a refinement of the shorter one. The table is folded into one row per chapter (the first two
digits) with a map from code to entry, so items need one join on the chapter, and the choice between the four lengths is an
expression on the joined row: nothing is exploded, and nothing is grouped by item. A chapter that holds a third of all items is split
by the join; a chapter's map is bounded by the codes that exist in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave import errors as E
from ledgerweave.functions.text import to_text
from ledgerweave.operators.joins import hot_safe_join

# The lengths of HSN codes, longest first.
LENGTHS = (8, 6, 4, 2)
ENTITY = "stock_item"


def _digits(c: str):
    """The code without blanks and dots; null unless it has two to eight digits."""
    code = F.regexp_replace(to_text(c), r"[ .]", "")
    return F.when(code.rlike(r"^\d{2,8}$"), code)


def fold_codes(codes: DataFrame, code_col: str = "hsn", rate_col: str = "gst_rate", text_col: str = "description") -> DataFrame:
    """One row per chapter: a map from code to (gst_rate, description). Of equal codes the smallest entry counts; codes of odd length do not."""
    entry = F.struct(F.col(rate_col).cast("decimal(20,6)").alias("gst_rate"), F.col(text_col).cast("string").alias("description"))
    rows = codes.select(_digits(code_col).alias("code"), entry.alias("entry")).filter(F.length("code").isin(*LENGTHS))
    single = rows.groupBy("code").agg(F.min("entry").alias("entry"))
    return single.groupBy(F.substring("code", 1, 2).alias("chapter")).agg(F.map_from_entries(F.collect_list(F.struct("code", "entry"))).alias("codes"))


def enrich(items: DataFrame, codes: DataFrame, hsn_col: str = "hsn") -> DataFrame:
    """The items with hsn_matched, hsn_gst_rate and hsn_description of the longest code of the table that begins theirs; null without one.

    Blank and unreadable codes match nothing. Every item stays once.
    """
    code = _digits(hsn_col)
    keyed = items.withColumns({"_hsn_code": code, "_hsn_chapter": F.substring(code, 1, 2)})
    # items without a code must not meet in one task
    spread = F.coalesce("_hsn_chapter", F.concat(F.lit("none "), F.pmod(F.xxhash64(*items.columns), F.lit(1024)).cast("string")))
    joined = hot_safe_join(keyed.withColumn("_hsn_chapter", spread), fold_codes(codes).select(F.col("chapter").alias("_hsn_chapter"), F.col("codes").alias("_hsn_codes")), ["_hsn_chapter"], "left")
    found = F.coalesce(*[
        F.when(F.length("_hsn_code") >= n, F.when(F.try_element_at("_hsn_codes", F.substring("_hsn_code", 1, n)).isNotNull(), F.substring("_hsn_code", 1, n))) for n in LENGTHS
    ])
    entry = F.try_element_at("_hsn_codes", "_hsn_found")
    return joined.withColumn("_hsn_found", found).select(
        *items.columns, F.col("_hsn_found").alias("hsn_matched"), entry["gst_rate"].alias("hsn_gst_rate"), entry["description"].alias("hsn_description")
    )


def rate_differences(enriched: DataFrame, rate_col: str = "gst_rate", stage: str = "validate") -> DataFrame:
    """A warning for every item whose own rate is not that of its code."""
    differs = F.col(rate_col).cast("decimal(20,6)") != F.col("hsn_gst_rate")
    issue = F.when(differs, E.issue(
        E.VALIDATION_ERROR, "gst_rate",
        F.concat(F.lit("The rate of HSN "), F.col("hsn_matched"), F.lit(" is "), F.format_string("%.2f", F.col("hsn_gst_rate").cast("double")), F.lit(".")), "warning"))
    return E.error_rows(enriched, F.array_compact(F.array(issue)), stage, ENTITY)
