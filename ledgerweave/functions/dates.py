"""Day-first date parsing.

One regular expression per written form selects the parts, so a cell is parsed
once by the branch that fits and never tried against every format in turn.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerweave.functions.text import as_col, is_blank, strip

_TIME = r"(?:[ T]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:\s*[AaPp][Mm])?\s*(?:Z|[+-]\d{2}:?\d{2})?)?"
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}" + _TIME + "$"
_YEAR_FIRST = r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})" + _TIME + "$"
_COMPACT = r"^\d{8}$"
_NUMERIC = r"^(\d{1,2})([/\-. ])(\d{1,2})\2(\d{4}|\d{2})" + _TIME + "$"
_MONTH = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    r"|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_DAY_MONTH = r"(?i)^(\d{1,2})(?:st|nd|rd|th)?[ \-/.]*" + _MONTH + r"\.?[ \-/.,]*(\d{4}|\d{2})" + _TIME + "$"
_MONTH_DAY = r"(?i)^" + _MONTH + r"\.?[ \-/.]*(\d{1,2})(?:st|nd|rd|th)?[ \-/.,]+(\d{4}|\d{2})" + _TIME + "$"
# The two forms that exports write most, told apart without the long patterns.
_PLAIN_ISO = r"^\d{4}-\d\d-\d\d$"
_PLAIN_DAY_MONTH = r"^\d{1,2} [A-Za-z]{3} \d{4}$"
_MONTH_ORDER = "janfebmaraprmayjunjulaugsepoctnovdec"
_PIVOT_YEAR = 69  # two-digit years below this belong to the 2000s


def _year(text: Column) -> Column:
    century = F.when(F.length(text) == 4, F.lit("")).when(text < str(_PIVOT_YEAR), F.lit("20")).otherwise(F.lit("19"))
    return F.concat(century, text)


def _month(text: Column) -> Column:
    at = F.position(F.lower(F.substring(text, 1, 3)), F.lit(_MONTH_ORDER))
    return ((at + 2) / 3).cast("int")


def _ymd(year: Column, month: Column, day: Column) -> Column:
    """Parts are digits; the cast reads them without a pattern."""
    return F.concat_ws("-", year, month, day).try_cast("date")


def to_date_dayfirst(c: Column | str, clean: bool = False) -> Column:
    """Date of a cell; null when blank or not a date. ISO and year-first win, then day-first.

    `clean` says that the cell is already trimmed. Blank words never look like a date.
    """
    text = as_col(c) if clean else strip(c)

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    first, second, year = part(_NUMERIC, 1), part(_NUMERIC, 3), _year(part(_NUMERIC, 4))
    numeric = F.coalesce(_ymd(year, second, first), _ymd(year, first, second))
    letters = F.substring(text, -8, 3)
    is_month = F.position(F.lower(letters), F.lit(_MONTH_ORDER)) % 3 == 1
    return (
        F.when((F.length(text) == 10) & (F.substring(text, 5, 1) == "-") & text.rlike(_PLAIN_ISO), text.try_cast("date"))
        .when(F.length(text).between(10, 11) & (F.substring(text, -5, 1) == " ") & text.rlike(_PLAIN_DAY_MONTH) & is_month, _ymd(F.right(text, F.lit(4)), _month(letters), F.substring_index(text, " ", 1)))
        .when(text.rlike(_ISO), F.substring_index(F.substring_index(text, "T", 1), " ", 1).try_cast("date"))
        .when(text.rlike(_NUMERIC), numeric)
        .when(text.rlike(_COMPACT), F.try_to_date(text, "yyyyMMdd"))
        .when(text.rlike(_YEAR_FIRST), _ymd(part(_YEAR_FIRST, 1), part(_YEAR_FIRST, 2), part(_YEAR_FIRST, 3)))
        .when(
            text.rlike(_DAY_MONTH), _ymd(_year(part(_DAY_MONTH, 3)), _month(part(_DAY_MONTH, 2)), part(_DAY_MONTH, 1))
        )
        .when(
            text.rlike(_MONTH_DAY), _ymd(_year(part(_MONTH_DAY, 3)), _month(part(_MONTH_DAY, 1)), part(_MONTH_DAY, 2))
        )
    )


def is_bad_date(c: Column | str, parsed: Column, clean: bool = False) -> Column:
    return parsed.isNull() & (as_col(c).isNotNull() if clean else ~is_blank(c))
