"""Text cells: trimming, blanks, yes/no flags and the comparison form of names.

Every helper maps a Column to a Column, so Catalyst sees plain expressions and
keeps them inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Unicode calls white space.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
_SPACE_RUN = f"[{WHITESPACE}]+"
# White space of ASCII other than the space: with it, two spaces, and characters beyond ASCII, all that a space collapse may change is told.
_CONTROL = r"[\x00-\x1f]"

# Cells that mean "nothing here", and the yes/no spellings.
BLANK_WORDS = ("", "na", "n/a", "nan", "none", "null", "nil", "-", "--")
YES_WORDS = ("yes", "y", "true", "t", "1", "on")
NO_WORDS = ("no", "n", "false", "f", "0", "off")
# The narrower yes/no set that column profiling looks for.
BOOLISH_WORDS = ("yes", "no", "true", "false", "1", "0", "y", "n")


def is_one_of(c: Column, words) -> Column:
    """Membership in a short fixed list, built as one constant array instead of a literal per word."""
    listed = ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)
    return F.array_contains(F.expr(f"array({listed})"), c)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space (any kind) at both ends. Cells without any are passed through untouched."""
    c = as_col(c)
    spaces, one = F.lit(WHITESPACE), F.lit(1)
    edge = spaces.contains(F.left(c, one)) | spaces.contains(F.right(c, one))
    return F.when(edge, F.btrim(c, spaces)).otherwise(c)


def trimmed_or_null(c: Column | str) -> Column:
    """The validation view of a cell: trimmed, and null when only white space is left."""
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column | str) -> Column:
    c = as_col(c)
    return c.isNull() | _is_blank_word(strip(c))


def _is_blank_word(stripped: Column) -> Column:
    return (F.length(stripped) <= 4) & is_one_of(F.lower(stripped), BLANK_WORDS)


def to_text(c: Column | str) -> Column:
    """Trimmed text, or null when the cell is blank.

    Stages apply this once per input column; later rules then test for null.
    """
    return F.when(~is_blank(c), strip(c))


def to_flag(c: Column | str) -> Column:
    """Boolean of a yes/no cell; null when blank or not a yes/no word."""
    word = F.lower(strip(c))
    return F.when(is_one_of(word, YES_WORDS), F.lit(True)).when(is_one_of(word, NO_WORDS), F.lit(False))


def is_bad_flag(c: Column | str) -> Column:
    return ~is_blank(c) & ~is_one_of(F.lower(strip(c)), (*YES_WORDS, *NO_WORDS))


def norm(c: Column | str, clean: bool = False, plain: Column | None = None) -> Column:
    """Comparison form of a name: trimmed, lower case, single spaces. Null stays null.

    `clean` says that the cell is already trimmed, which keeps the expression small; `plain` says where it `is_plain`.
    """
    text = F.lower(as_col(c)) if clean else strip(F.lower(as_col(c)))
    odd = (F.octet_length(text) != F.char_length(text)) | text.rlike(_CONTROL) if plain is None else ~plain
    return F.when(text.contains("  ") | odd, F.regexp_replace(text, _SPACE_RUN, " ")).otherwise(text)


def norm_or_empty(c: Column | str, clean: bool = False, plain: Column | None = None) -> Column:
    return F.coalesce(norm(c, clean, plain), F.lit(""))


def is_plain(columns) -> Column:
    """True if all cells of the row are ASCII without control characters, told by one scan of them all: the only white space is the space."""
    row = F.concat_ws("|", *columns)
    return (F.octet_length(row) == F.char_length(row)) & ~row.rlike(_CONTROL)


def clean_columns(df, columns, plain: str | None = None) -> "DataFrame":  # noqa: F821
    """Trim the columns and null their blanks, in one projection. Rows that hold plain cells without a space at an end skip the exact trim.

    `plain` names a column to add: whether the row `is_plain`.
    """
    if not columns:
        return df if plain is None else df.withColumn(plain, F.lit(True))
    row = F.concat(F.lit("|"), F.concat_ws("|", *columns), F.lit("|"))
    whole = is_plain(columns) & ~row.contains("| ") & ~row.contains(" |")
    trimmed = {c: F.when(whole, F.col(c)).otherwise(strip(c)) for c in columns}
    made = {c: F.when(~_is_blank_word(t), t) for c, t in trimmed.items()}
    return df.withColumns(made | ({plain: is_plain(columns)} if plain else {}))
