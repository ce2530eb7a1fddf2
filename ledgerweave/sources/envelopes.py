"""XML sinks: ordered text files that together form complete import envelopes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xml.sax.saxutils import escape

from ledgerweave.operators.emit import (
    HEADER,
    IMPORT_DUPS,
    POSITION,
    VOUCHER_SECTION,
    master_fragments,
    voucher_fragments,
    voucher_place,
)
from ledgerweave.operators.groups import group_depths
from ledgerweave.operators.joins import hot_safe_join
from ledgerweave.sources.row_numbers import with_ordinal

_LAST = 99


def _company(name: str) -> str:
    return escape(name).encode("ascii", "xmlcharrefreplace").decode("ascii")


def _open(report: str, company: str, dups: str | None) -> str:
    extra = f"<IMPORTDUPS>{escape(dups)}</IMPORTDUPS>" if dups else ""
    return (
        f"<IMPORTDATA><REQUESTDESC><REPORTNAME>{report}</REPORTNAME><STATICVARIABLES><SVCURRENTCOMPANY>"
        f"{_company(company)}</SVCURRENTCOMPANY>{extra}</STATICVARIABLES></REQUESTDESC><REQUESTDATA>"
    )


_CLOSE = "</REQUESTDATA></IMPORTDATA>"


def masters_body(masters: dict[str, DataFrame]) -> DataFrame:
    """Master rows in dependency order: units, groups (parents first), stock items, ledgers."""
    parts = []
    for entity, df in masters.items():
        if entity == "group":
            # parents first: a child is one level deeper
            position = group_depths(df).select("source_row", F.concat(F.lpad(F.col("depth").cast("string"), 12, "0"), "name_key").alias("place"))
            parts.append(master_fragments(df.join(position, "source_row"), "group", F.col("place")))
        else:
            parts.append(master_fragments(df, entity))
    return reduce(DataFrame.unionByName, parts)


def _frame_rows(chunks: DataFrame, section: int, opening: str, closing: str) -> DataFrame:
    """Opening and closing rows of one section in each chunk. `chunks` names chunks, not their text."""
    ends = F.explode(
        F.array(
            F.struct(F.lit(section).alias("section"), F.lit("").alias("place"), F.lit(-9).alias("part"), F.lit(opening).alias("xml")),
            F.struct(F.lit(section).alias("section"), F.lit("\U0010ffff").alias("place"), F.lit(_LAST).alias("part"),
                     F.lit(closing).alias("xml")),
        )
    )
    return chunks.select("chunk").distinct().select("chunk", ends.alias("e")).select(
        "chunk", "e.section", "e.place", "e.part", F.lit(0).cast("long").alias("row"), F.lit(0).alias("seq"), "e.xml"
    )


def envelope_rows(
    company: str,
    masters: dict[str, DataFrame] | None = None,
    vouchers: tuple[DataFrame, DataFrame] | None = None,
    import_dups: str | None = IMPORT_DUPS,
    chunk: int | None = None,
    unified: bool = True,
) -> DataFrame:
    """All text rows of the envelopes, with `chunk` and the POSITION columns to sort by.

    `chunk=None` gives one envelope. A number gives complete envelopes of exactly that many vouchers in source order, the
    last one of the rest; masters travel in the first one. The keys of the vouchers are then sorted and numbered when this is called
    (`with_ordinal`); their texts are not. No vouchers give no voucher section.
    """
    parts = []
    section_open, filled = 0, []
    if masters:
        # one row tells that there are masters; their text is not needed for the tags
        some = reduce(DataFrame.unionByName, [df.select(F.lit(0).alias("chunk")).limit(1) for df in masters.values()])
        filled.append(some)
        body = masters_body(masters).withColumn("chunk", F.lit(0))
        parts += [body, _frame_rows(some, section_open, _open("All Masters", company, import_dups), "").filter("part < 0"),
                  _frame_rows(some, 5, "", _CLOSE).filter("part > 0")]
    if vouchers:
        heads, lines = vouchers
        if chunk is None:
            heads, lines = (df.withColumn("chunk", F.lit(0)) for df in (heads, lines))
            numbers = heads.select("chunk").distinct()
        else:
            keys = with_ordinal(heads.select("voucher_key", voucher_place(heads).alias("place")), ["place", "voucher_key"])
            keys = keys.select("voucher_key", F.expr(f"cast(ordinal div {int(chunk)} as int)").alias("chunk"))
            numbers = keys.select("chunk").distinct()
            heads, lines = (hot_safe_join(df, keys, ["voucher_key"]) for df in (heads, lines))
        body = voucher_fragments(heads, lines)
        filled.append(numbers)
        frame = _frame_rows(numbers, VOUCHER_SECTION, _open("Vouchers", company, None), _CLOSE)
        parts += [body, frame]
    columns = ["chunk", *POSITION, "xml"]
    body = reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])
    chunks = reduce(DataFrame.unionByName, filled)
    outer = _frame_rows(chunks, -1, f"<ENVELOPE>{HEADER}<BODY>", "").filter("part < 0").unionByName(
        _frame_rows(chunks, _LAST, "", "</BODY></ENVELOPE>").filter("part > 0")
    )
    return body.unionByName(outer.select(*columns))


def write_envelopes(rows: DataFrame, path: str, folders: int = 1000) -> None:
    """Write the rows as text, ordered within and across the part files of a folder.

    Up to `folders` chunks have a folder each (`chunk=<number>`). More share them: a folder then holds a range of chunks in order,
    each a complete envelope that begins on a line of its own, and is named after the first. The sort is a range partitioning over the full position,
    so a voucher with very many lines spreads over several files. Line breaks fall between elements only.
    """
    last = rows.filter("section = -1").agg(F.max("chunk")).first()[0]  # opening rows only, one per chunk
    span = 1 if last is None else -(-(last + 1) // folders)
    (
        rows.withColumn("number", F.col("chunk"))
        .withColumn("chunk", F.expr(f"cast(chunk - chunk % {span} as int)"))
        .orderBy("chunk", "number", *POSITION)
        .select("chunk", F.col("xml").alias("value"))
        .write.partitionBy("chunk").text(path)
    )
