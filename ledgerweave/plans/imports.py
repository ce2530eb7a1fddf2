"""Whole imports: from mapped rows to envelope rows. The input of a voucher import is evaluated once, into the shared folder."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.errors import StageResult
from ledgerweave.operators import masters, resolve, rollups, vouchers
from ledgerweave.operators.groups import group_depths, unordered_groups
from ledgerweave.operators.validate import validate
from ledgerweave.sources.envelopes import envelope_rows
from ledgerweave.sources.shared_folder import stored


@dataclass
class Import:
    """Envelope rows to write, problems, and the counts of the import as one row."""

    envelope: DataFrame
    errors: DataFrame
    counts: DataFrame


def import_masters(
    rows: DataFrame, entity: str, company: str, existing: DataFrame | None = None, extra_fields: bool = False,
    gate: bool = True, **known,
) -> Import:
    """Masters with create-or-update decisions against `existing`, if given. Conflicts are held back.

    With `gate`, rows are validated first (`known` holds the value sets, see `validate`): rows with an error are held back, and
    an error about the table as a whole holds back all of them.
    """
    if "parent" not in rows.columns:
        rows = rows.withColumn("parent", F.lit(None).cast("string"))
    nothing = rows.filter(F.lit(False))
    usable, stopped, problems = _gated(rows, entity, known) if gate else (rows, nothing, None)
    held = nothing
    if existing is not None:
        usable, held = resolve.apply_verdicts(usable, resolve.resolve(usable, existing))
    converted = masters.convert_masters(usable, entity, extra_fields=extra_fields)
    if entity == "group":
        # only groups that can be ordered are written; the others say why
        placed = converted.data.join(group_depths(converted.data).select("source_row"), "source_row", "left_semi")
        converted = StageResult(placed, converted.errors.unionByName(unordered_groups(converted.data)))
    errors = converted.errors if problems is None else problems.unionByName(converted.errors)
    # rows that validation stopped count as skipped; `held` are conflicts
    entered = usable.select("source_row").unionByName(stopped.select("source_row"))
    return Import(
        envelope_rows(company, {entity: converted.data}),
        errors,
        masters.conversion_counts(entered, held, StageResult(converted.data, errors)),
    )


def _gated(rows: DataFrame, entity: str, known: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows that may be converted, rows held back, what validation found)."""
    found = validate(rows, entity, **known).errors
    blocking = found.filter(F.col("severity") == "error")
    bad = blocking.filter("source_row is not null").groupBy("source_row").agg(F.lit(True).alias("_bad"))
    whole = blocking.filter("source_row is null").agg((F.count("*") > 0).alias("_all"))  # one row
    marked = rows.join(bad, "source_row", "left").crossJoin(F.broadcast(whole))
    stop = F.col("_all") | F.coalesce("_bad", F.lit(False))
    return marked.filter(~stop).select(*rows.columns), marked.filter(stop).select(*rows.columns), found


def import_vouchers(
    rows: DataFrame,
    company: str,
    cutover: date | str | None = None,
    b2c_summary: bool = False,
    settlement_mode: bool = False,
    chunk: int | None = None,
) -> Import:
    """Vouchers, with opening balances for rows before the cutover and daily retail summaries if asked for."""
    rows = stored(rows)
    opening, problems = None, None
    if cutover is not None and not settlement_mode:
        balances, problems = rollups.opening_balances(rows, cutover)
        _, rows = rollups.split_cutover(rows, cutover)
        opening = _opening_ledgers(balances)
    built = rollups.settlements(rows) if settlement_mode else vouchers.build_vouchers(rows, store=True)
    heads, lines = built.vouchers, built.lines
    if b2c_summary:
        heads, lines = rollups.b2c_daily(heads, lines)
    errors = built.errors if problems is None else built.errors.unionByName(problems)
    envelope = envelope_rows(company, {"ledger": opening} if opening is not None else None, (heads, lines), chunk=chunk)
    return Import(envelope, errors, rollups.control_totals(heads))


def _opening_ledgers(balances: DataFrame) -> DataFrame:
    """Opening balances as ledgers to create. They have no source row; the name hash spreads and orders them."""
    return balances.select(
        F.abs(F.xxhash64("name")).alias("source_row"), "name", F.lit("Create").alias("action"),
        *[F.lit(None).cast("string").alias(c) for c in ("guid", "old_name")],
        "parent", "opening_balance", "opening_is_debit",
        *[F.lit(None).cast("string").alias(c) for c in ("gst_registration_type", "gstin", "state")],
        F.lit(masters.COUNTRY).alias("country"),
        F.lit(None).cast("boolean").alias("is_billwise"),
        *[F.lit(None).cast("string").alias(c) for c in ("mailing_name", "address", "pincode", "email", "phone")],
        F.lit(None).cast("decimal(38,6)").alias("credit_limit"),
    )
