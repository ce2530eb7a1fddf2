"""XML as text: escaping and element building with string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerweave.functions.text import as_col


# Fixed value: characters that no XML 1.0 text may hold, escaped or not.
NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"


def ascii_only(text: Column) -> Column:
    """Characters beyond ASCII as numeric references; plain ASCII text is passed through.

    Markup is ASCII, so emitters apply this once to a finished row and not to every element.
    """
    each = F.transform(
        F.split(text, ""),
        lambda ch: F.when(F.ascii(ch) > 127, F.concat(F.lit("&#"), F.ascii(ch).cast("string"), F.lit(";"))).otherwise(ch),
    )
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(each, "")).otherwise(text)


def _replaced(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escaped(c: Column | str) -> Column:
    """Element text with its markup characters escaped."""
    return _replaced(as_col(c), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")))


def escaped_attribute(c: Column | str) -> Column:
    """Attribute value with its markup characters escaped, without the quotes."""
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
             ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#9;"))
    return _replaced(as_col(c), pairs)


def xml_text(c: Column | str) -> Column:
    """Complete element text: escaped and ASCII."""
    return ascii_only(escaped(c))


def element(tag: str, text: Column) -> Column:
    """<tag>text</tag> for text that is already escaped; null stays null."""
    return F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))


def text_element(tag: str, c: Column | str) -> Column:
    return element(tag, escaped(c))


def optional(tag: str, c: Column | str) -> Column:
    """The element, or null when the value is null or empty."""
    c = as_col(c)
    return F.when(c.isNotNull() & (c.cast("string") != ""), text_element(tag, c.cast("string")))


def joined(*parts: Column) -> Column:
    """The non-null parts, one after the other."""
    return F.concat_ws("", *parts)
