"""Compare two trial balances: which accounts agree, which differ, and which stand on one side only.

Accounts are matched in three steps, each on what the step before left over: by code, by normalized name, and (if asked for) by the name
that resolution finds closest. Each side is summed per code and name first, so matching works on accounts, not on postings, and no join
sees a hot key. Amounts are signed (debit positive).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.text import norm_or_empty, to_text
from ledgerweave.operators.resolve import resolve

AMOUNT = "decimal(38,6)"
TOLERANCE = "0.01"


def accounts(rows: DataFrame) -> DataFrame:
    """One row per account (code, or name where there is no code): code, name as first spelled, key of the name, amount, postings.

    rows: code, name, amount. Rows without code and name are one account; a missing amount counts as zero.
    """
    code, key = to_text("code"), norm_or_empty("name")
    keyed = rows.select(
        code.alias("code"), key.alias("key"), to_text("name").alias("name"), F.coalesce(F.col("amount").cast(AMOUNT), F.lit(0).cast(AMOUNT)).alias("amount")
    )
    by_code = F.coalesce(F.concat(F.lit("c"), F.col("code")), F.concat(F.lit("n"), F.col("key")))
    return keyed.groupBy(by_code.alias("account")).agg(
        F.max("code").alias("code"), F.min("key").alias("key"), F.min("name").alias("name"), F.sum("amount").cast(AMOUNT).alias("amount"), F.count(F.lit(1)).alias("postings")
    )


def _side(found: DataFrame, tag: str) -> DataFrame:
    return found.select(*[F.col(c).alias(f"{tag}_{c}") for c in ("account", "code", "key", "name", "amount", "postings")])


def _left_over(side: DataFrame, matched: DataFrame, tag: str) -> DataFrame:
    return side.join(matched.select(f"{tag}_account"), f"{tag}_account", "left_anti")


def _by_name(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Pairs of accounts whose names are equal; accounts that share a name on one side (under several codes) are not paired."""
    def single(side: DataFrame, tag: str) -> DataFrame:
        named = side.filter(F.col(f"{tag}_key") != "").groupBy(f"{tag}_key").agg(F.count(F.lit(1)).alias("n"), F.max(f"{tag}_account").alias(f"{tag}_account"))
        return named.filter("n = 1").drop("n")

    pairs = single(ours, "our").join(single(theirs, "their"), F.col("our_key") == F.col("their_key")).select("our_account", "their_account")
    return ours.join(pairs, "our_account").join(theirs, "their_account")


def _by_likeness(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Pairs where resolution finds a name at least as close as a name conflict, and no other account wants the same one."""
    incoming = ours.select(F.xxhash64("our_account").alias("source_row"), F.col("our_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    existing = theirs.select(
        F.xxhash64("their_account").alias("ex_id"), F.col("their_name").alias("name"), F.lit(None).cast("string").alias("parent"), F.col("their_account").alias("guid")
    )
    marks = resolve(incoming, existing).filter(F.col("decision").isin("update", "conflict") & F.col("matched_guid").isNotNull())
    wanted = marks.select("source_row", F.col("matched_guid").alias("their_account"))
    alone = wanted.groupBy("their_account").agg(F.count(F.lit(1)).alias("n"), F.max("source_row").alias("source_row")).filter("n = 1").drop("n")
    return ours.withColumn("source_row", F.xxhash64("our_account")).join(alone, "source_row").drop("source_row").join(theirs, "their_account")


def compare_balances(ours: DataFrame, theirs: DataFrame, tolerance: str = TOLERANCE, similar: bool = False) -> DataFrame:
    """One row per account of either side: status (equal, different, only_ours, only_theirs), matched_by, names, amounts and their difference.

    Amounts are equal if they differ by the tolerance at most. `similar` adds the third step; its threshold is that of a name conflict.
    """
    left, right = _side(accounts(ours), "our"), _side(accounts(theirs), "their")
    columns = [*left.columns, *right.columns]
    pair = lambda df, how: df.select(*columns, F.lit(how).alias("matched_by"))
    by_code = pair(left.filter("our_code is not null").join(right.filter("their_code is not null"), F.col("our_code") == F.col("their_code")), "code")
    left, right = _left_over(left, by_code, "our"), _left_over(right, by_code, "their")
    by_name = pair(_by_name(left, right), "name")
    left, right = _left_over(left, by_name, "our"), _left_over(right, by_name, "their")
    matched = by_code.unionByName(by_name)
    if similar:
        alike = pair(_by_likeness(left, right), "similar name")
        left, right = _left_over(left, alike, "our"), _left_over(right, alike, "their")
        matched = matched.unionByName(alike)
    alone = left.unionByName(right, allowMissingColumns=True).withColumn("matched_by", F.lit(None).cast("string"))
    every = matched.unionByName(alone)
    difference = (F.coalesce("our_amount", F.lit(0).cast(AMOUNT)) - F.coalesce("their_amount", F.lit(0).cast(AMOUNT))).cast(AMOUNT)
    status = (
        F.when(F.col("their_account").isNull(), F.lit("only_ours")).when(F.col("our_account").isNull(), F.lit("only_theirs"))
        .when(F.abs(difference) <= F.lit(tolerance).cast(AMOUNT), F.lit("equal")).otherwise(F.lit("different"))
    )
    return every.select(
        status.alias("status"), "matched_by", F.coalesce("our_code", "their_code").alias("code"), "our_name", "their_name", "our_amount", "their_amount",
        difference.alias("difference"), F.coalesce("our_postings", F.lit(0)).alias("our_postings"), F.coalesce("their_postings", F.lit(0)).alias("their_postings"),
    )


def summary(compared: DataFrame) -> DataFrame:
    """Accounts and the sum of differences by status."""
    return compared.groupBy("status").agg(F.count(F.lit(1)).alias("accounts"), F.sum("difference").cast(AMOUNT).alias("difference"))
