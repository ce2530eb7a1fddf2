"""Scalar functions: Column in, Column out."""

from ledgerweave.functions.dates import is_bad_date, to_date_dayfirst
from ledgerweave.functions.gst import gst_legs, gst_split, is_intra, norm_state, state_of_gstin
from ledgerweave.functions.numbers import (
    fmt_amount,
    fmt_day,
    fmt_number,
    fmt_yes_no,
    is_bad_decimal,
    is_numeric_text,
    signed_line,
    signed_opening,
    to_amount_side,
    to_decimal,
)
from ledgerweave.functions.text import (
    is_bad_flag,
    is_blank,
    norm,
    norm_or_empty,
    strip,
    to_flag,
    to_text,
    trimmed_or_null,
)

__all__ = [
    "fmt_amount", "fmt_day", "fmt_number", "fmt_yes_no", "gst_legs", "gst_split", "is_bad_date",
    "is_bad_decimal", "is_bad_flag", "is_blank", "is_intra", "is_numeric_text", "norm", "norm_or_empty",
    "norm_state", "signed_line", "signed_opening", "state_of_gstin", "strip", "to_amount_side",
    "to_date_dayfirst", "to_decimal", "to_flag", "to_text", "trimmed_or_null",
]
