"""Numbers written by people: lenient parsing, debit/credit sides and fixed formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerweave.functions.text import WHITESPACE, as_col, is_blank, is_one_of, strip, to_text

WIDE = "decimal(38,6)"
MONEY = "decimal(20,6)"
CENTS = "decimal(20,2)"

# Currency marks and the debit/credit words that may sit inside an amount.
CURRENCY_PATTERN = r"[₹$€£¥]|\b(?i:rs|inr|usd|eur)\b\.?"
SIDE_PATTERN = r"(?i)\b(dr|cr|debit|credit)\b\.?"
DEBIT_WORDS = ("dr", "debit", "d")
CREDIT_WORDS = ("cr", "credit", "c")

# An optional '+', one leading or trailing minus, the digits in between.
_SIGNED = r"(?s)^\+?(-?)\+?(.*?)(-?)$"
_SYMBOLS_ONLY = r"^\+?-?\.?-?$"


def _digits(c: Column | str, clean: bool = False) -> Column:
    """The cell without brackets, currency, side words and separators; '(5)' becomes '-5'."""
    text = F.regexp_replace(as_col(c) if clean else strip(c), r"(?s)^\((.*)\)$", "-$1")
    text = F.regexp_replace(text, CURRENCY_PATTERN, "")
    text = F.regexp_replace(text, SIDE_PATTERN, "")
    return F.btrim(F.translate(text, ",_ ", ""), F.lit(WHITESPACE))


def to_decimal(c: Column | str, clean: bool = False) -> Column:
    """decimal(38,6) of a messy number; null when blank or not a number.

    Cells that already are plain numbers take the cast alone. `clean` says that the
    cell is trimmed and null when blank.
    """
    signed = F.regexp_replace(_digits(c, clean), _SIGNED, "$1$3$2")
    plain = F.regexp_replace(signed, r"^--(?!-)", "").try_cast(WIDE)  # two minus signs cancel out
    return F.coalesce(as_col(c).try_cast(WIDE), plain if clean else F.when(~is_blank(c), plain))


def is_bad_decimal(c: Column | str, parsed: Column | None = None, clean: bool = False) -> Column:
    """True when the cell holds something that is not a number. Bare symbols count as blank."""
    parsed = to_decimal(c, clean) if parsed is None else parsed
    present = as_col(c).isNotNull() if clean else ~is_blank(c)
    return parsed.isNull() & present & ~_digits(c, clean).rlike(_SYMBOLS_ONLY)


def is_numeric_text(c: Column | str) -> Column:
    """Strict number test of validation and profiling: only thousands commas are forgiven."""
    return strict_decimal(c).isNotNull()


def strict_decimal(c: Column | str) -> Column:
    plain = F.btrim(F.translate(as_col(c), ",", ""), F.lit(WHITESPACE)).try_cast(WIDE)
    return F.coalesce(as_col(c).try_cast(WIDE), plain)


def side_of(amount: Column | str, side: Column | str | None, parsed: Column, clean: bool = False) -> Column:
    """True for debit. The side cell decides, else a word inside the amount, else the sign."""
    inside = F.lower(F.regexp_extract(as_col(amount), SIDE_PATTERN, 1))
    choice = F.when(inside != "", inside.startswith("d")).otherwise(parsed >= 0)
    if side is None:
        return choice
    word = F.lower(as_col(side) if clean else to_text(side))
    return (
        F.when(is_one_of(word, DEBIT_WORDS), F.lit(True))
        .when(is_one_of(word, CREDIT_WORDS), F.lit(False))
        .otherwise(choice)
    )


def to_amount_side(amount: Column | str, side: Column | str | None = None) -> Column:
    """struct(amount >= 0, is_debit); null when the amount is blank or bad."""
    parsed = to_decimal(amount)
    return F.when(
        parsed.isNotNull(),
        F.struct(F.abs(parsed).alias("amount"), side_of(amount, side, parsed).alias("is_debit")),
    )


def fmt_amount(c: Column | str) -> Column:
    """Two decimals, half up, as text."""
    return F.round(as_col(c).cast(WIDE), 2).cast("decimal(38,2)").cast("string")


def fmt_number(c: Column | str) -> Column:
    """Plain decimal text without exponent or padding zeros."""
    return F.regexp_replace(as_col(c).cast(WIDE).cast("string"), r"\.?0+$", "")


def fmt_yes_no(c: Column | str) -> Column:
    return F.when(as_col(c), F.lit("Yes")).otherwise(F.lit("No"))


def fmt_day(c: Column | str) -> Column:
    return F.date_format(as_col(c), "yyyyMMdd")


def signed_opening(amount: Column | str, is_debit: Column | str) -> Column:
    """Opening balances: debit positive, credit negative."""
    value = F.abs(as_col(amount))
    return fmt_amount(F.when(as_col(is_debit), value).otherwise(-value))


def signed_line(amount: Column | str, is_debit: Column | str) -> Column:
    """Voucher entries use the opposite sign: debit negative, credit positive."""
    value = F.abs(as_col(amount))
    return fmt_amount(F.when(as_col(is_debit), -value).otherwise(value))
