"""Group ledger lines into balanced vouchers with tax, party and round-off legs.

Shape of the plan:

1. Row work is one projection: key, amount, side, date, tax and the row's issues.
2. Headers are an aggregate with map-side combine (min/max/min_by/sum only), so
   a voucher that holds a third of all rows reaches the reducer as one partial
   row per map task. Nothing collects the rows of a voucher.
3. Lines are the rows joined back to their header. Synthesized legs (party,
   round-off) ride on the voucher's first row, so lines need no union and no
   second join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave import errors as E
from ledgerweave.functions import dates, gst
from ledgerweave.functions.numbers import CENTS, MONEY, is_bad_decimal, side_of, to_decimal
from ledgerweave.functions.text import clean_columns, norm, norm_or_empty
from ledgerweave.functions.xml_text import NOT_XML
from ledgerweave.operators.joins import hot_safe_join
from ledgerweave.sources.shared_folder import SLICE, empty_slice, read_back, written, written_in_slices

ENTITY = "voucher"

# Words that mark a sale reversal, and the names of synthesized ledgers.
REFUND_WORDS = ("refund", "return", "credit note", "creditnote", "reversal", "chargeback", "cancel")
CREDIT_NOTE = "Credit Note"
ROUND_OFF = "Round Off"
B2C_LEDGER = "B2C Sales"
# Fixed value: the largest imbalance that is rounded off instead of refused.
ROUND_OFF_LIMIT = "0.99"

INPUT_COLUMNS = (
    "order_id", "voucher_number", "date", "voucher_type", "ledger_name", "amount", "dr_cr", "debit", "credit",
    "narration", "party_ledger", "stock_item", "quantity", "rate", "unit", "gst_rate", "shipping_state",
    "home_state", "party_gstin", "transaction_type",
)

# Rows of several uploads keep apart if they carry this column: it is part of their vouchers' keys.
UPLOAD = "upload"
UPLOAD_MARK = "\x1f"

# Places of a line inside its voucher: rows first, then the party leg, then the round-off leg.
ROW_SECTION, PARTY_SECTION, ROUND_OFF_SECTION = 0, 1, 2
LINE_ORDER = ("section", "source_row", "seq")


@dataclass
class VoucherResult:
    """Lazy output: one row per voucher, one row per line, one row per problem."""

    vouchers: DataFrame
    lines: DataFrame
    errors: DataFrame


def is_refund(c: Column | str) -> Column:
    return norm_or_empty(c).rlike("|".join(REFUND_WORDS))


def with_input_columns(df: DataFrame, columns=INPUT_COLUMNS, plain: str | None = None) -> DataFrame:
    """Keep the known columns as trimmed text (null when blank) and add the absent ones as null; `plain` as in `clean_columns`."""
    present = {c for c in df.columns}
    known = df.select(
        F.col("source_row").cast("long").alias("source_row"),
        *[F.col(c).cast("string").alias(c) for c in (UPLOAD,) if c in present],
        *[(F.col(c) if c in present else F.lit(None)).cast("string").alias(c) for c in columns],
    )
    return clean_columns(known, [c for c in columns if c in present], plain)


_rule = E.issue_sql


def _says(column: str, tail: str) -> str:
    """SQL text of a message that quotes a cell."""
    return f"concat(\"'\", coalesce({column}, ''), \"' {tail}\")"


def parse_amounts(df: DataFrame) -> DataFrame:
    """Add `amount_value`, `is_debit` and the first amount problem (`amount_issue`) of each row.

    The debit and credit columns win over amount with its side.
    """
    staged = df.withColumns(
        {
            "_has_debit": F.col("debit").isNotNull(),
            "_has_credit": F.col("credit").isNotNull(),
        }
    ).withColumns(
        {
            "_amount_column": F.when(F.col("_has_debit"), F.lit("debit"))
            .when(F.col("_has_credit"), F.lit("credit"))
            .otherwise(F.lit("amount")),
            "_amount_text": F.when(F.col("_has_debit"), F.col("debit"))
            .when(F.col("_has_credit"), F.col("credit"))
            .otherwise(F.col("amount")),
        }
    )
    staged = staged.withColumn("_parsed", to_decimal("_amount_text", clean=True))
    staged = staged.withColumn("_money", F.abs(F.col("_parsed")).try_cast(MONEY))
    bad = is_bad_decimal("_amount_text", F.col("_parsed"), clean=True) | (
        F.col("_parsed").isNotNull() & F.col("_money").isNull()
    )
    both = "'The line has a debit and a credit amount; give one of them.'"
    number = _says("_amount_text", "is not a number.")
    staged = staged.withColumn("_bad", bad)
    kind = "named_struct('code', '{}', 'severity', 'error', 'source_column', _amount_column)"
    more = "named_struct('raw', cast(null as string), 'suggestion', cast(null as string))"
    issue = F.expr(
        f"""case
        when _has_debit and _has_credit then {_rule(E.VALIDATION_ERROR, "debit", both)}
        when _bad then named_struct('kind', {kind.format(E.BAD_DECIMAL)}, 'message', {number}, 'more', {more})
        when _money is null or _money = 0 then named_struct('kind', {kind.format(E.REQUIRED_MISSING)},
            'message', 'The line needs an amount other than zero.', 'more', {more})
        end"""
    )
    side = (
        F.when(F.col("_has_debit"), F.lit(True))
        .when(F.col("_has_credit"), F.lit(False))
        .otherwise(side_of("amount", "dr_cr", F.col("_parsed"), clean=True))
    )
    return staged.withColumns({"amount_value": F.col("_money"), "is_debit": side, "amount_issue": issue}).drop(
        "_has_debit", "_has_credit", "_amount_column", "_amount_text", "_parsed", "_money", "_bad"
    )


def parse_rows(df: DataFrame) -> DataFrame:
    """Row-local work: every text cell becomes a typed column, problems become `issues`.

    `kept` is false for a row whose problem leaves it out of its voucher.
    """
    rows, plain = parse_amounts(with_input_columns(df, plain="plain")), F.col("plain")
    rows = rows.withColumns(
        {
            "vnum": F.coalesce("order_id", "voucher_number"),
            "ledger": F.col("ledger_name"),
            "item": F.col("stock_item"),
            "day": dates.to_date_dayfirst("date", clean=True),
            "gstin": F.col("party_gstin"),
            "vtype": F.col("voucher_type"),
            "party": F.col("party_ledger"),
            "note": F.col("narration"),
            "has_rate": F.col("gst_rate").isNotNull(),
            "buyer_text": F.coalesce("shipping_state", gst.state_of_gstin("party_gstin", clean=True)),
        }
    )
    rows = rows.withColumns(
        {
            "buyer_key": F.when(F.col("has_rate"), norm_or_empty("buyer_text", clean=True, plain=plain)),
            "home_key": F.when(F.col("has_rate"), norm_or_empty("home_state", clean=True, plain=plain)),
        }
    )
    rows = rows.withColumns(
        {
            "qty": F.when(F.col("item").isNotNull(), to_decimal("quantity", clean=True)),
            "unit_rate": F.when(F.col("item").isNotNull(), to_decimal("rate", clean=True)),
            "unit_name": F.when(F.col("item").isNotNull(), F.col("unit")),
            "buyer": gst.state_of_key(F.col("buyer_key")),
            "home": gst.state_of_key(F.col("home_key")),
            "percent": F.when(F.col("has_rate"), gst.tax_rate("gst_rate")),
        }
    )
    rows = rows.withColumn("intra", gst.same_state(F.col("buyer"), F.col("home")))

    rows = rows.withColumns(
        {
            "bad_qty": F.col("item").isNotNull() & is_bad_decimal("quantity", F.col("qty"), clean=True),
            "bad_rate": F.col("item").isNotNull() & is_bad_decimal("rate", F.col("unit_rate"), clean=True),
            # quantity * rate is compared half-even; both factors are narrowed so the product stays exact
            "expected": F.expr("bround(try_cast(abs(qty) as decimal(18,6)) * try_cast(abs(unit_rate) as decimal(18,6)), 2)"),
            "tax_due": F.when(F.expr("intra is not null and percent is not null"), gst.total_tax(F.col("amount_value"), F.col("percent"))),
        }
    )
    cells = ("vnum", "ledger", "vtype", "party", "note", "item", "unit_name")
    rows = rows.withColumn("unprintable", ~plain & F.concat_ws("", *cells).rlike(NOT_XML))
    fatal = f"""case
        when unprintable then array({_rule(E.VALUE_NOT_ALLOWED, None, "'A cell holds a character that XML cannot carry.'")})
        when vnum is null then array({_rule(E.REQUIRED_MISSING, "voucher_number", "'A voucher number or order id is needed.'")})
        when ledger is null then array({_rule(E.REQUIRED_MISSING, "ledger_name", "'A ledger is needed.'")})
        when amount_issue is not null then array(amount_issue)
        when bad_qty or bad_rate then array(
            if(bad_qty, {_rule(E.BAD_DECIMAL, "quantity", _says("quantity", "is not a number."))}, null),
            if(bad_rate, {_rule(E.BAD_DECIMAL, "rate", _says("rate", "is not a number."))}, null))
        when item is not null and qty is not null and try_cast(abs(qty) as decimal(18,6)) is null then array(
            {_rule(E.BAD_DECIMAL, "quantity", _says("quantity", "is too large a number."))})
        when item is not null and unit_rate is not null and try_cast(abs(unit_rate) as decimal(18,6)) is null then array(
            {_rule(E.BAD_DECIMAL, "rate", _says("rate", "is too large a number."))})
        when percent is not null and intra is not null and (tax_due is null or try_cast(amount_value + tax_due as decimal(21,6)) is null)
            then array({_rule(E.BAD_DECIMAL, "gst_rate", _says("gst_rate", "makes a tax too large to post."))})
        when item is not null and (qty is null or qty <= 0) then array(
            {_rule(E.INVENTORY_MISMATCH, "quantity", _says("item", "needs a quantity above zero."))})
        end"""
    off = "concat(\"'\", item, \"': quantity times rate is \", expected, ', the line says ', amount_value)"
    place = "'A GST rate is given but the place of supply is unknown; no tax was added.'"
    soft = f"""array(
        if(item is not null and abs(expected - amount_value) > 0.01,
           {_rule(E.INVENTORY_MISMATCH, "amount", off, "warning")}, null),
        if(day is null and date is not null, {_rule(E.BAD_DATE, "date", _says("date", "is not a date."))}, null),
        if(item is not null and unit_name is null,
           {_rule(E.INVENTORY_MISMATCH, "unit", _says("item", "needs a unit."))}, null),
        case when has_rate and intra is null then {_rule(E.VALIDATION_ERROR, "gst_rate", place, "warning")}
             when has_rate and percent is null then
                  {_rule(E.BAD_DECIMAL, "gst_rate", _says("gst_rate", "is not a GST rate."))} end)"""
    rows = rows.withColumns({"fatal": F.expr(fatal), "taxed": F.expr("intra is not null and percent is not null")})
    rows = rows.withColumns(
        {
            "kept": F.col("fatal").isNull(),
            "issues": F.expr(f"if(fatal is not null, fatal, {soft})"),
            "tax": F.when(F.col("taxed"), F.coalesce("tax_due", F.lit(0).cast(CENTS))).otherwise(F.lit(0).cast(CENTS)),
        }
    )
    key = norm("vnum", clean=True, plain=plain)
    return rows.withColumns(
        {
            "cgst": F.when(F.col("intra"), gst.half_tax(F.col("tax"))).otherwise(F.lit(0).cast(CENTS)),
            "voucher_key": F.concat(F.col(UPLOAD), F.lit(UPLOAD_MARK), key) if UPLOAD in rows.columns else key,
            "refund": F.col("transaction_type").isNotNull() & is_refund("transaction_type"),
        }
    )


def headers_of(rows: DataFrame) -> DataFrame:
    """One row per voucher key with header candidates, totals and the verdict."""
    own = "if(kept, source_row, null)"
    first = "min_by({0}, if(kept and {0} is not null, source_row, null))"
    side_total = "try_cast(amount_value + tax as decimal(21,6))"
    cents = "cast(0 as decimal(21,6))"
    # Rows that are left out are ignored inside the aggregates. A filter on `kept` would be pushed
    # down through the projections and evaluate every parsing rule a second time.
    aggregates = {
        "first_row": f"min({own})",
        "reference": first.format("vnum"),
        "day_low": "min(if(kept, day, null))",
        "day_high": "max(if(kept, day, null))",
        "first_type": first.format("vtype"),
        "type_low": "min(if(kept, type_key, null))",
        "type_high": "max(if(kept, type_key, null))",
        "party_ledger": first.format("party"),
        "party_low": "min(if(kept, party_key, null))",
        "party_high": "max(if(kept, party_key, null))",
        "note": first.format("note"),
        "party_gstin": f"min_by(gstin, if(kept and length(gstin) = {gst.GSTIN_LENGTH}, source_row, null))",
        "refund": "bool_or(if(kept, refund, null))",
        "tax_mode": "bool_or(if(kept, taxed, null))",
        "has_inventory": "bool_or(if(kept, item is not null, null))",
        "dr": f"sum(if(kept, if(is_debit, {side_total}, {cents}), null))",
        "cr": f"sum(if(kept, if(is_debit, {cents}, {side_total}), null))",
        "row_legs": """sum(if(kept, 1 + if(cgst <> 0, 1, 0) + if(intra and tax <> cgst, 1, 0)
            + if(taxed and not intra and tax <> 0, 1, 0), null))""",
    }
    if UPLOAD in rows.columns:
        aggregates[UPLOAD] = f"min({UPLOAD})"
    keyed = rows.withColumns({"type_key": norm("vtype", clean=True), "party_key": norm("party", clean=True)})
    grouped = keyed.groupBy("voucher_key").agg(*[F.expr(sql).alias(name) for name, sql in aggregates.items()])
    steps = [
        {
            "gap": "cr - dr",
            "party_leg": f"tax_mode and party_ledger is not null and abs(cr - dr) > {ROUND_OFF_LIMIT}",
        },
        {"round_leg": f"not party_leg and gap <> 0 and abs(gap) <= {ROUND_OFF_LIMIT}", "flip": "refund and tax_mode"},
        {
            "n_lines": "row_legs + int(party_leg) + int(round_leg)",
            "debit": "dr + if((party_leg or round_leg) and gap > 0, gap, 0)",
            "credit": "cr + if((party_leg or round_leg) and gap < 0, -gap, 0)",
        },
        {
            "debit_total": "cast(if(flip, credit, debit) as decimal(38,6))",
            "credit_total": "cast(if(flip, debit, credit) as decimal(38,6))",
        },
        {"balanced": "n_lines >= 2 and debit_total > 0 and debit_total = credit_total"},
    ]
    grouped = grouped.filter("first_row is not null")
    for step in steps:
        grouped = grouped.withColumns({name: F.expr(sql) for name, sql in step.items()})

    def label(*parts: str) -> str:
        return "concat(\"Voucher '\", reference, \"' \", " + ", ".join(parts) + ")"

    blocking = f"""case
        when day_low is null then {_rule(E.REQUIRED_MISSING, "date", label("'has no date.'"))}
        when day_low <> day_high then
            {_rule(E.VOUCHER_CONFLICT, "date", label("'has lines with different dates, from '", "day_low", "' to '", "day_high"))}
        when type_low is null then {_rule(E.REQUIRED_MISSING, "voucher_type", label("'has no voucher type.'"))}
        when type_low <> type_high then
            {_rule(E.VOUCHER_CONFLICT, "voucher_type",
                   label("'has lines with different voucher types, such as '", "type_low", "' and '", "type_high"))}
        end"""
    parties = _rule(
        E.VOUCHER_CONFLICT, "party_ledger", label("\"names more than one party; using '\"", "party_ledger", "\"'.\""), "warning"
    )
    unbalanced = _rule(
        E.VOUCHER_UNBALANCED, "amount", label("'does not balance: debit '", "debit_total", "', credit '", "credit_total")
    )
    grouped = grouped.withColumns(
        {
            "blocking": F.expr(blocking),
            "date": F.col("day_low"),
            "voucher_type": F.expr(f"if(refund, '{CREDIT_NOTE}', first_type)"),
            "narration": F.expr(
                "if(refund, concat('Refund of order ', reference, coalesce(concat('. ', note), '')), note)"
            ),
        }
    )
    return grouped.withColumns(
        {
            "issues": F.expr(
                f"""if(blocking is not null, array(blocking), array(
                    if(party_low <> party_high, {parties}, null), if(not balanced, {unbalanced}, null)))"""
            ),
            "ok": F.expr("blocking is null and balanced"),
        }
    )


def is_b2c(voucher_type: Column | str, gstin: Column | str) -> Column:
    """A sale to a buyer without a GSTIN."""
    return (norm_or_empty(voucher_type) == "sales") & F.col(gstin).isNull()


VOUCHER_COLUMNS = (
    "voucher_key", "first_row", "reference", "voucher_type", "date", "narration", "party_ledger", "party_gstin",
    "has_inventory", "n_lines", "debit_total", "credit_total",
)
LINE_COLUMNS = (
    "voucher_key", "first_row", "section", "source_row", "seq", "ledger_name", "is_debit", "amount", "stock_item",
    "quantity", "rate", "unit", "date", "voucher_type", "party_ledger", "b2c", "invoice",
)


def _leg(section: int, seq: int, ledger: str, debit: str, amount: str, item: bool = False) -> str:
    """SQL text of one leg; the field types are those of the line table."""
    stock = ("item", "qty", "unit_rate", "unit_name") if item else (
        "cast(null as string)", "cast(null as decimal(38,6))", "cast(null as decimal(38,6))", "cast(null as string)"
    )
    names = ("section", "seq", "ledger_name", "is_debit", "amount", "stock_item", "quantity", "rate", "unit")
    values = (section, seq, ledger, debit, f"cast({amount} as decimal(38,6))", *stock)
    return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(names, values)) + ")"


def lines_of(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """All lines of the accepted vouchers, one output row per leg."""
    kept = rows.select(
        "voucher_key", "kept", "source_row", "ledger", "is_debit", "amount_value", "item", "qty", "unit_rate", "unit_name",
        "intra", "taxed", "tax", "cgst",
    )
    own = [c for c in (UPLOAD,) if c in headers.columns]
    facts = headers.filter("ok").select(
        *own,
        "voucher_key", "first_row", "flip", "gap", "party_leg", "round_leg", "date", "voucher_type", "party_ledger",
        is_b2c("voucher_type", "party_gstin").alias("b2c"), F.col("has_inventory").alias("invoice"),
    )
    joined = hot_safe_join(kept, facts, ["voucher_key"])
    side, closing_side = "(is_debit <> flip)", "((gap > 0) <> flip)"
    lead = "source_row = first_row"
    party = _leg(PARTY_SECTION, 0, "party_ledger", closing_side, "abs(gap)")
    rounding = _leg(ROUND_OFF_SECTION, 0, f"'{ROUND_OFF}'", closing_side, "abs(gap)")
    legs = F.expr(
        f"""array(
            if(kept, {_leg(ROW_SECTION, 0, "ledger", side, "amount_value", item=True)}, null),
            if(kept and taxed and intra and cgst <> 0, {_leg(ROW_SECTION, 1, "'Output CGST'", side, "cgst")}, null),
            if(kept and taxed and intra and tax <> cgst, {_leg(ROW_SECTION, 2, "'Output SGST'", side, "tax - cgst")}, null),
            if(kept and taxed and not intra and tax <> 0, {_leg(ROW_SECTION, 3, "'Output IGST'", side, "tax")}, null),
            if({lead} and party_leg, {party}, null),
            if({lead} and round_leg, {rounding}, null))"""
    )
    exploded = joined.select(
        *own, "voucher_key", "first_row", "source_row", "date", "voucher_type", "party_ledger", "b2c", "invoice",
        F.explode_outer(legs).alias("leg"),
    ).filter(F.col("leg").isNotNull())
    return exploded.select(
        "voucher_key", "first_row", "leg.section", "source_row", "leg.seq", "leg.ledger_name", "leg.is_debit",
        "leg.amount", "leg.stock_item", "leg.quantity", "leg.rate", "leg.unit", "date", "voucher_type",
        "party_ledger", "b2c", "invoice", *own,
    )


#: What headers and lines read of a parsed row.
_PARSED = (
    "source_row", "voucher_key", "kept", "vnum", "ledger", "day", "gstin", "vtype", "party", "note", "is_debit", "amount_value",
    "item", "qty", "unit_rate", "unit_name", "intra", "taxed", "tax", "cgst", "refund",
)
#: What vouchers, lines and errors read of a header. Only balanced vouchers show their totals, so one of the two is kept.
_HEADER = (
    "voucher_key", "first_row", "reference", "voucher_type", "date", "narration", "party_ledger", "party_gstin", "has_inventory",
    "n_lines", "debit_total", "flip", "gap", "party_leg", "round_leg", "ok", "issues",
)
# Parsed rows are stored in so many slices by voucher key. Beyond PASS_ROWS they are settled in passes of about that many
# rows, at most one a slice, so that the shuffles of one pass alone are on disk.
SLICES, PASS_ROWS = 8, 8_000_000
# Files are small for the rows they hold; so many headers are not broadcast, whatever the size of their files.
_MANY_HEADERS = 500_000


def _thin(df: DataFrame, name: str) -> DataFrame:
    """A voucher's number is most often its key; it is stored only where it differs."""
    return df.withColumn(name, F.nullif(name, "voucher_key"))


def _whole(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(name, "voucher_key"))


class _Stored:
    """Parsed rows in slices on disk, and the headers and lines that passes over them make."""

    def __init__(self, parsed: DataFrame, columns: list[str]):
        self.spark, self.own = parsed.sparkSession, [c for c in (UPLOAD,) if c in columns]
        table = _thin(parsed.select(*columns), "vnum").withColumn(SLICE, F.expr(f"int(pmod(xxhash64(voucher_key), {SLICES}))"))
        self.path, self.schema = written_in_slices(table, SLICES), table.schema
        self.rows = _whole(read_back(self.spark, self.schema, self.path), "vnum")
        self.passes = max(1, min(SLICES, -(-self.rows.count() // PASS_ROWS)))  # the files' own row counts

    def settle(self, lines: bool, rows: bool) -> tuple[DataFrame, DataFrame]:
        """(headers, lines), both stored; with one pass, or if they are not wanted, lines are lazy. Rows that nobody reads again go."""
        headers, made, lines = [], [], lines and self.passes > 1
        for k in range(self.passes):
            slices = [s for s in range(SLICES) if s * self.passes // SLICES == k]
            some = self.rows.filter(F.col(SLICE).isin(slices)).drop(SLICE)
            table = _thin(headers_of(some).select(*_HEADER, *self.own), "reference")
            headers.append(written(table))
            if not lines:
                continue
            found = lines_of(some, self._for_join(self._headers(table.schema, headers[-1:])))
            made.append(written(found))
            for s in slices if not rows else ():
                empty_slice(self.spark, self.schema, self.path, s)
        whole = self._headers(table.schema, headers)
        return whole, read_back(self.spark, found.schema, *made) if lines else lines_of(self.rows.drop(SLICE), self._for_join(whole))

    def _headers(self, schema: T.StructType, paths: list[str]) -> DataFrame:
        return _whole(read_back(self.spark, schema, *paths), "reference").withColumn("credit_total", F.col("debit_total"))

    @staticmethod
    def _for_join(headers: DataFrame) -> DataFrame:
        return headers.hint("merge") if headers.count() > _MANY_HEADERS else headers


def build_vouchers(
    df: DataFrame, stage: str = "convert", store: bool = False, store_issues: bool = True, store_lines: bool = True,
) -> VoucherResult:
    """Group line-format rows (`source_row` plus any of INPUT_COLUMNS) into balanced vouchers.

    With a column `upload`, vouchers of different uploads never meet, and vouchers, lines and errors carry it.
    With `store`, parsed rows and headers are written to the shared folder once, and lines, headers and errors read them there;
    otherwise everything is lazy and each output evaluates the input for itself. Callers that do not ask for errors save
    writing the rows' problems without `store_issues`; errors then parse the input again. Large inputs are settled in passes over
    slices of the keys, and their lines are stored as well; callers that do not ask for lines save that without `store_lines`.
    """
    parsed = rows = parse_rows(df)
    if store:
        kept = _Stored(rows, [*_PARSED, *[c for c in (UPLOAD,) if c in rows.columns], *["issues"] * store_issues])
        headers, lines = kept.settle(store_lines, rows=store_issues)
        parsed = kept.rows if store_issues else parsed
    else:
        headers = headers_of(rows)
        lines = lines_of(rows, headers)
    errors = E.error_rows(parsed, F.col("issues"), stage, ENTITY).unionByName(
        E.error_rows(headers, F.col("issues"), stage, ENTITY, row="first_row")
    )
    return VoucherResult(headers.filter("ok").select(*VOUCHER_COLUMNS, *[c for c in (UPLOAD,) if c in headers.columns]), lines, errors)
