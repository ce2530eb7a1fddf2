"""Voucher roll-ups: daily retail summaries, settlements, cutover balances, totals, preview."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave import errors as E
from ledgerweave.functions import dates
from ledgerweave.functions.numbers import MONEY, to_decimal
from ledgerweave.functions.text import norm
from ledgerweave.operators.vouchers import (
    B2C_LEDGER,
    ENTITY,
    INPUT_COLUMNS,
    LINE_COLUMNS,
    UPLOAD,
    UPLOAD_MARK,
    LINE_ORDER,
    PARTY_SECTION,
    ROW_SECTION,
    VOUCHER_COLUMNS,
    VoucherResult,
    is_b2c,
    parse_amounts,
    with_input_columns,
)


# --- daily retail summaries ---------------------------------------------------------------------
def b2c_daily(vouchers: DataFrame, lines: DataFrame, ledger: str = B2C_LEDGER) -> tuple[DataFrame, DataFrame]:
    """Replace sales to buyers without a GSTIN by one summary voucher per day.

    Lines already carry the date, the party and the retail mark of their voucher,
    so the split needs no join. A busy day shrinks on the map side to one partial
    row per ledger and side. The party's own lines fall away; one leg on `ledger`
    takes their place. Everything else passes through.
    """
    retail = lines.filter("b2c")
    own = F.col("party_ledger").isNotNull() & (F.col("ledger_name") == F.col("party_ledger"))
    lead = (F.col("section") == ROW_SECTION) & (F.col("seq") == 0) & (F.col("source_row") == F.col("first_row"))
    totals = retail.groupBy("date", "ledger_name", "is_debit").agg(
        F.sum(F.when(~own, F.col("amount"))).cast("decimal(38,6)").alias("amount"),
        F.sum(lead.cast("int")).alias("orders"),
    )
    amount = F.coalesce("amount", F.lit(0))
    days = totals.groupBy("date").agg(
        F.sum(F.when(F.col("is_debit"), amount).otherwise(F.lit(0))).cast("decimal(38,6)").alias("dr"),
        F.sum(F.when(~F.col("is_debit"), amount).otherwise(F.lit(0))).cast("decimal(38,6)").alias("cr"),
        F.count_if(amount > 0).alias("legs"),
        F.sum("orders").alias("orders"),
    )
    day = F.date_format("date", "yyyy-MM-dd")
    gap = F.col("cr") - F.col("dr")
    top = F.greatest("dr", "cr").cast("decimal(38,6)")
    summaries = days.select(
        F.concat(F.lit("b2c-"), day).alias("voucher_key"),
        F.lit(None).cast("long").alias("first_row"),
        F.concat(F.lit("B2C-"), day).alias("reference"),
        F.lit("Sales").alias("voucher_type"),
        "date",
        F.concat(F.lit("B2C daily summary — "), F.col("orders").cast("string"), F.lit(" order(s)")).alias("narration"),
        F.lit(ledger).alias("party_ledger"),
        F.lit(None).cast("string").alias("party_gstin"),
        F.lit(False).alias("has_inventory"),
        (F.col("legs") + F.when(gap != 0, 1).otherwise(0)).alias("n_lines"),
        top.alias("debit_total"),
        top.alias("credit_total"),
    )
    balance = days.filter(gap != 0).select(
        "date", F.lit(PARTY_SECTION).alias("section"), F.lit(ledger).alias("ledger_name"),
        (gap > 0).alias("is_debit"), F.abs(gap).cast("decimal(38,6)").alias("amount"),
    )
    merged = totals.filter(F.col("amount") > 0).select(
        "date", F.lit(ROW_SECTION).alias("section"), "ledger_name", "is_debit", "amount"
    ).unionByName(balance)
    summary_lines = merged.select(
        F.concat(F.lit("b2c-"), day).alias("voucher_key"),
        F.lit(None).cast("long").alias("first_row"),
        "section",
        F.lit(None).cast("long").alias("source_row"),
        F.lit(0).alias("seq"),
        "ledger_name", "is_debit", "amount",
        F.lit(None).cast("string").alias("stock_item"),
        F.lit(None).cast("decimal(38,6)").alias("quantity"),
        F.lit(None).cast("decimal(38,6)").alias("rate"),
        F.lit(None).cast("string").alias("unit"),
        "date",
        F.lit("Sales").alias("voucher_type"),
        F.lit(ledger).alias("party_ledger"),
        F.lit(False).alias("b2c"),
        F.lit(False).alias("invoice"),
    )
    kept = vouchers.filter(~is_b2c("voucher_type", "party_gstin"))
    return (
        kept.select(*VOUCHER_COLUMNS).unionByName(summaries),
        lines.filter(~F.col("b2c")).select(*LINE_COLUMNS).unionByName(summary_lines),
    )


# --- settlements --------------------------------------------------------------------------------
SETTLEMENT_COLUMNS = (
    "order_id", "voucher_number", "date", "amount", "commission", "marketplace_fee", "tcs", "party_ledger",
    "ledger_name", "voucher_type",
)
# Ledgers and voucher type of a settlement entry.
COMMISSION, FEES, TCS = "Commission", "Marketplace Fees", "TCS Receivable"
MARKETPLACE, BANK, JOURNAL = "Marketplace", "Bank", "Journal"


def settlements(df: DataFrame, bank: str = BANK, stage: str = "convert") -> VoucherResult:
    """Expand each marketplace settlement row into one journal of up to five lines.

    Row-local: no shuffle. Each row is a voucher of its own, so the row number is
    part of the voucher key.
    """
    rows = with_input_columns(df, SETTLEMENT_COLUMNS)

    def positive(c: str) -> Column:
        return F.abs(to_decimal(c, clean=True)).try_cast(MONEY)

    def deduction(c: str) -> Column:
        return F.coalesce(positive(c), F.lit(0).cast(MONEY))

    rows = rows.withColumns(
        {
            "sid": F.coalesce("order_id", "voucher_number"),
            "gross": positive("amount"),
            "day": dates.to_date_dayfirst("date", clean=True),
            "fee_a": deduction("commission"),
            "fee_b": deduction("marketplace_fee"),
            "fee_c": deduction("tcs"),
            "party": F.coalesce("party_ledger", F.lit(MARKETPLACE)),
            "deposit": F.coalesce("ledger_name", F.lit(bank)),
            "kind": F.coalesce("voucher_type", F.lit(JOURNAL)),
        }
    )
    rows = rows.withColumn("fees", F.col("fee_a") + F.col("fee_b") + F.col("fee_c"))
    rows = rows.withColumn("net", F.col("gross") - F.col("fees"))
    label = F.concat(F.lit("Settlement '"), "sid", F.lit("' "))
    rows = rows.withColumn(
        "issue",
        F.when(
            F.col("sid").isNull(),
            E.issue(E.REQUIRED_MISSING, "voucher_number", "A settlement or order id is needed."),
        )
        .when(
            F.col("gross").isNull() | (F.col("gross") <= 0),
            E.issue(E.REQUIRED_MISSING, "amount", F.concat(label, F.lit("needs a gross amount above zero."))),
        )
        .when(F.col("day").isNull(), E.issue(E.REQUIRED_MISSING, "date", F.concat(label, F.lit("has no date."))))
        .when(
            F.col("net") < 0,
            E.issue(
                E.VALIDATION_ERROR, "amount",
                F.concat(label, F.lit("has deductions of "), F.col("fees").cast("string"),
                         F.lit(" that exceed gross "), F.col("gross").cast("string")),
            ),
        ),
    )
    # the one remaining way to be refused: gross alone, with nothing on the debit side, cannot occur here
    rows = rows.withColumn("kept", F.col("issue").isNull())
    own_file = [F.col(UPLOAD), F.lit(UPLOAD_MARK)] if UPLOAD in rows.columns else []
    rows = rows.withColumn("voucher_key", F.concat(*own_file, norm("sid", clean=True), F.lit("@"), F.col("source_row")))
    legs = [
        (F.col("party"), False, "gross"), (F.col("deposit"), True, "net"), (F.lit(COMMISSION), True, "fee_a"),
        (F.lit(FEES), True, "fee_b"), (F.lit(TCS), True, "fee_c"),
    ]
    n_lines = sum(F.when(F.col(c) > 0, 1).otherwise(0) for _, _, c in legs)
    gross = F.col("gross").cast("decimal(38,6)")
    headers = rows.filter("kept").select(
        "voucher_key",
        F.col("source_row").alias("first_row"),
        F.col("sid").alias("reference"),
        F.col("kind").alias("voucher_type"),
        F.col("day").alias("date"),
        F.concat(F.lit("Marketplace settlement "), "sid").alias("narration"),
        F.col("party").alias("party_ledger"),
        F.lit(None).cast("string").alias("party_gstin"),
        F.lit(False).alias("has_inventory"),
        n_lines.cast("long").alias("n_lines"),
        gross.alias("debit_total"),
        gross.alias("credit_total"),
    )
    leg = F.explode_outer(
        F.array(
            *[
                F.when(
                    F.col("kept") & (F.col(c) > 0),
                    F.struct(
                        F.lit(i).alias("seq"), name.alias("ledger_name"), F.lit(debit).alias("is_debit"),
                        F.col(c).cast("decimal(38,6)").alias("amount"),
                    ),
                )
                for i, (name, debit, c) in enumerate(legs)
            ]
        )
    )
    lines = (
        rows.select("voucher_key", "source_row", "day", "kind", "party", leg.alias("leg"))
        .filter(F.col("leg").isNotNull())
        .select(
            "voucher_key",
            F.col("source_row").alias("first_row"),
            F.lit(ROW_SECTION).alias("section"),
            "source_row", "leg.seq", "leg.ledger_name", "leg.is_debit", "leg.amount",
            F.lit(None).cast("string").alias("stock_item"),
            F.lit(None).cast("decimal(38,6)").alias("quantity"),
            F.lit(None).cast("decimal(38,6)").alias("rate"),
            F.lit(None).cast("string").alias("unit"),
            F.col("day").alias("date"),
            F.col("kind").alias("voucher_type"),
            F.col("party").alias("party_ledger"),
            (norm("kind", clean=True) == "sales").alias("b2c"),
            F.lit(False).alias("invoice"),
        )
    )
    return VoucherResult(headers, lines, E.error_rows(rows, F.array("issue"), stage, ENTITY))


# --- cutover ------------------------------------------------------------------------------------
def split_cutover(df: DataFrame, cutover: date | str) -> tuple[DataFrame, DataFrame]:
    """(rows dated before the cutover, the others). Rows without a readable date stay with the others."""
    day = dates.to_date_dayfirst("date")
    before = F.coalesce(day < F.lit(str(cutover)).cast("date"), F.lit(False))
    return df.filter(before), df.filter(~before)


def opening_balances(df: DataFrame, cutover: date | str) -> tuple[DataFrame, DataFrame]:
    """(ledgers with their net balance before the cutover, error rows).

    Debit adds, credit subtracts; the party moves the other way. Ledgers that are
    a party anywhere in the file go under Sundry Debtors, others under Primary.
    One aggregate does it all: every row contributes its ledger, its party and the
    mark "this name is a party", so no join with the parties is needed and a name
    on a third of the rows is combined on the map side.
    """
    rows = parse_amounts(with_input_columns(df, INPUT_COLUMNS))
    day = dates.to_date_dayfirst("date", clean=True)
    rows = rows.withColumn("before", F.coalesce(day < F.lit(str(cutover)).cast("date"), F.lit(False)))
    counted = F.col("before") & F.col("ledger_name").isNotNull() & F.col("amount_issue").isNull()
    change = F.when(F.col("is_debit"), F.col("amount_value")).otherwise(-F.col("amount_value"))
    zero = F.lit(0).cast(MONEY)
    posting = F.explode_outer(
        F.array(
            F.when(
                counted,
                F.struct(F.col("ledger_name").alias("name"), change.cast(MONEY).alias("change"),
                         F.lit(False).alias("party")),
            ),
            F.when(
                F.col("party_ledger").isNotNull(),
                F.struct(
                    F.col("party_ledger").alias("name"),
                    F.when(counted, -change).otherwise(zero).cast(MONEY).alias("change"),
                    F.lit(True).alias("party"),
                ),
            ),
        )
    )
    sums = (
        rows.select(posting.alias("p"))
        .filter(F.col("p").isNotNull())
        .groupBy(F.col("p.name").alias("name"))
        .agg(F.sum("p.change").alias("net"), F.bool_or("p.party").alias("party"))
        .filter(F.col("net") != 0)
    )
    balances = sums.select(
        "name",
        F.when(F.col("party"), F.lit("Sundry Debtors")).otherwise(F.lit("Primary")).alias("parent"),
        F.abs(F.col("net")).cast("decimal(38,6)").alias("opening_balance"),
        (F.col("net") > 0).alias("opening_is_debit"),
    )
    missing = F.when(
        F.col("ledger_name").isNull(), E.issue(E.REQUIRED_MISSING, "ledger_name", "A ledger is needed.")
    ).otherwise(F.col("amount_issue"))
    errors = E.error_rows(rows, F.array(F.when(F.col("before"), missing)), "convert", ENTITY)
    return balances, errors


# --- totals and preview -------------------------------------------------------------------------
def control_totals(vouchers: DataFrame) -> DataFrame:
    """Vouchers, lines, total debit and total credit as one row; the headers hold all of it."""
    return vouchers.agg(
        F.count("*").alias("vouchers"),
        F.coalesce(F.sum("n_lines"), F.lit(0)).alias("voucher_lines"),
        F.coalesce(F.sum("debit_total"), F.lit(0)).alias("debit_total"),
        F.coalesce(F.sum("credit_total"), F.lit(0)).alias("credit_total"),
    )


def preview(vouchers: DataFrame, lines: DataFrame, n: int = 100) -> DataFrame:
    """The first n vouchers by source row with all their lines, one row per line.

    n bounds the vouchers (a top-n, never a full sort), so that side is broadcast.
    The lines stay rows: a voucher of any length is never gathered in one cell.
    """
    top = vouchers.orderBy("first_row", "voucher_key").limit(n).select(
        "voucher_key", "reference", "debit_total", "credit_total"
    )
    return lines.join(F.broadcast(top), "voucher_key").select(
        "reference", "date", "voucher_type", "party_ledger", "debit_total", "credit_total", "first_row",
        *LINE_ORDER, "ledger_name", F.when(F.col("is_debit"), "Dr").otherwise("Cr").alias("dr_cr"), "amount",
        "stock_item", "quantity", "unit",
    )
