"""Indian GST: place of supply and the CGST/SGST/IGST split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerweave.functions.numbers import CENTS, strict_decimal
from ledgerweave.functions.text import as_col, norm_or_empty, strip

# GST state codes 01 to 38, in code order.
STATE_BY_CODE = (
    "Jammu and Kashmir", "Himachal Pradesh", "Punjab", "Chandigarh", "Uttarakhand", "Haryana", "Delhi",
    "Rajasthan", "Uttar Pradesh", "Bihar", "Sikkim", "Arunachal Pradesh", "Nagaland", "Manipur", "Mizoram",
    "Tripura", "Meghalaya", "Assam", "West Bengal", "Jharkhand", "Odisha", "Chhattisgarh", "Madhya Pradesh",
    "Gujarat", "Daman and Diu", "Dadra and Nagar Haveli", "Maharashtra", "Andhra Pradesh", "Karnataka", "Goa",
    "Lakshadweep", "Kerala", "Tamil Nadu", "Puducherry", "Andaman and Nicobar Islands", "Telangana",
    "Andhra Pradesh", "Ladakh",
)
# Two-letter abbreviations.
STATE_BY_LETTERS = {
    "ap": "Andhra Pradesh", "ar": "Arunachal Pradesh", "as": "Assam", "br": "Bihar", "cg": "Chhattisgarh",
    "ch": "Chandigarh", "dl": "Delhi", "ga": "Goa", "gj": "Gujarat", "hp": "Himachal Pradesh", "hr": "Haryana",
    "jh": "Jharkhand", "jk": "Jammu and Kashmir", "ka": "Karnataka", "kl": "Kerala", "la": "Ladakh",
    "mh": "Maharashtra", "ml": "Meghalaya", "mn": "Manipur", "mp": "Madhya Pradesh", "mz": "Mizoram",
    "nl": "Nagaland", "od": "Odisha", "or": "Odisha", "pb": "Punjab", "py": "Puducherry", "rj": "Rajasthan",
    "sk": "Sikkim", "tg": "Telangana", "tn": "Tamil Nadu", "tr": "Tripura", "ts": "Telangana",
    "ua": "Uttarakhand", "uk": "Uttarakhand", "up": "Uttar Pradesh", "wb": "West Bengal",
}
GSTIN_LENGTH = 15


def _by_code(code: Column) -> Column:
    """State of a one- or two-digit code; null when there is none (codes start at 1)."""
    states = F.expr("array(" + ", ".join(f"'{s}'" for s in STATE_BY_CODE) + ")")
    index = code.try_cast("int")
    return F.when((F.length(code) <= 2) & index.between(1, len(STATE_BY_CODE)), F.try_element_at(states, index))


def norm_state(c: Column | str) -> Column:
    """Canonical state of a name, two-letter code or number; other text in comparison form; '' if blank."""
    return state_of_key(norm_or_empty(c))


def state_of_key(key: Column) -> Column:
    """As norm_state, for text that is already in comparison form.

    Numbers are found by array position; only two-letter cells pay for a map lookup.
    """
    names = F.expr("map(" + ", ".join(f"'{s.lower()}', '{s}'" for s in sorted(set(STATE_BY_CODE))) + ")")
    letters = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in STATE_BY_LETTERS.items()) + ")")
    return (
        F.when(key.rlike("^[0-9]+$"), F.coalesce(_by_code(key), key))
        .when(F.length(key) == 2, F.coalesce(F.try_element_at(letters, key), key))
        .otherwise(F.coalesce(F.try_element_at(names, key), key))
    )


def state_of_gstin(c: Column | str, clean: bool = False) -> Column:
    """State in the first two digits of a 15-character GSTIN, else ''."""
    text = as_col(c) if clean else strip(c)
    digits = F.substring(text, 1, 2)
    return F.when(
        (F.length(text) == GSTIN_LENGTH) & digits.rlike("^[0-9]{2}$"), F.coalesce(_by_code(digits), F.lit(""))
    ).otherwise(F.lit(""))


def is_intra(buyer: Column | str, home: Column | str) -> Column:
    """True inside one state, False between states, null when one side is unknown."""
    return same_state(norm_state(buyer), norm_state(home))


def same_state(buyer_state: Column, home_state: Column) -> Column:
    return F.when((buyer_state != "") & (home_state != ""), buyer_state == home_state)


def tax_rate(c: Column | str) -> Column:
    """Rate in percent; null when not a number, negative, or beyond decimal(11,6)."""
    rate = strict_decimal(c).try_cast("decimal(11,6)")
    return F.when(rate >= 0, rate)


def total_tax(amount: Column, rate: Column) -> Column:
    """round(amount * rate / 100, 2), half up; null beyond decimal(20,2). The product is exact before it is rounded once."""
    product = F.abs(amount).cast("decimal(20,6)") * rate.cast("decimal(11,6)")
    return F.round(product * F.lit("0.01").cast("decimal(2,2)"), 2).try_cast(CENTS)


def half_tax(total: Column) -> Column:
    return F.round(total * F.lit("0.5").cast("decimal(2,1)"), 2).cast(CENTS)


def gst_split(amount: Column | str, rate: Column | str, intra: Column) -> Column:
    """struct(taxable, rate, intra, cgst, sgst, igst); null when amount or rate cannot be read.

    cgst + sgst equals the rounded total: the second half takes the odd hundredth.
    """
    taxable = F.abs(strict_decimal(as_col(amount).cast("string"))).try_cast("decimal(20,6)")
    percent = tax_rate(as_col(rate).cast("string"))
    total = total_tax(taxable, percent)
    zero = F.lit(0).cast(CENTS)
    return F.when(
        taxable.isNotNull() & percent.isNotNull() & intra.isNotNull(),
        F.struct(
            taxable.alias("taxable"),
            percent.alias("rate"),
            intra.alias("intra"),
            F.when(intra, half_tax(total)).otherwise(zero).alias("cgst"),
            F.when(intra, (total - half_tax(total)).cast(CENTS)).otherwise(zero).alias("sgst"),
            F.when(intra, zero).otherwise(total).alias("igst"),
        ),
    )


def gst_legs(split: Column) -> Column:
    """The non-zero parts of a split as array<struct<ledger, amount>>, in posting order."""
    legs = [
        F.struct(F.lit(f"Output {name}").alias("ledger"), split[name.lower()].alias("amount"))
        for name in ("CGST", "SGST", "IGST")
    ]
    return F.filter(F.array(*legs), lambda leg: leg["amount"] != 0)
