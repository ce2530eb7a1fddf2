"""Import results that come back as XML, their outcome, and the replay guard."""

from __future__ import annotations

import re
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Counter tags of a response and the columns they become.
COUNTERS = {
    "CREATED": "created", "ALTERED": "altered", "DELETED": "deleted", "COMBINED": "combined", "IGNORED": "ignored",
    "ERRORS": "errors", "CANCELLED": "cancelled", "EXCEPTIONS": "exceptions", "LASTVCHID": "last_vch_id",
    "LASTMID": "last_master_id",
}
_NUMBER = re.compile(r"[+-]?[0-9]+")
_LARGEST = 2**63 - 1
_PARSED = "rejected string, " + ", ".join(f"{name} long" for name in COUNTERS.values()) + ", line_errors array<string>"


def _read(xml: str | None) -> tuple:
    """(reason or None, the counters, line errors) of one response, in one pass of an XML parser."""
    zeros = dict.fromkeys(COUNTERS, 0)
    if xml is None:
        return "malformed", *zeros.values(), []
    if "<!DOCTYPE" in xml.upper():
        return "doctype", *zeros.values(), []
    counters, lines = dict(zeros), []
    open_: list[list] = []  # [name, text before the first child, has a child]

    def start(tag: str, _: dict) -> None:
        if open_:
            open_[-1][2] = True
        open_.append([tag.rpartition(":")[2].upper(), [], False])

    def text(data: str) -> None:
        if open_ and not open_[-1][2]:
            open_[-1][1].append(data)

    def end(_: str) -> None:
        name, parts, _ = open_.pop()
        value = "".join(parts).strip()
        if name in counters:
            number = int(value) if _NUMBER.fullmatch(value) and len(value) < 21 else 0
            counters[name] = number if abs(number) <= _LARGEST else 0
        elif name == "LINEERROR" and value:
            lines.append(value)

    parser = expat.ParserCreate(encoding="utf-8")
    parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = start, text, end
    try:
        parser.Parse(xml.strip().encode("utf-8", "replace"), True)
    except expat.ExpatError:
        return "malformed", *zeros.values(), []
    return None, *counters.values(), lines


def parse_responses(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Add the ten counters (long), `line_errors`, and `rejected` (the reason) to a table of responses.

    A DOCTYPE or malformed text is rejected: its counters stay zero and the
    outcome treats it as unreadable. Tag names match in any case and prefix; the last
    occurrence of a counter counts. CDATA and character references are read as text.
    Each response is parsed once, in Arrow batches.
    """

    @F.pandas_udf(_PARSED)
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read(t) for t in texts], columns=["rejected", *COUNTERS.values(), "line_errors"])

    staged = df.withColumn("_parsed", parse(F.col(xml).cast("string")))
    return staged.withColumns({c: F.col(f"_parsed.{c}") for c in ("rejected", *COUNTERS.values(), "line_errors")}).drop("_parsed")


def import_outcome(parsed: DataFrame) -> DataFrame:
    """Add `is_success` and `status`: pushed, pushed_partial or push_failed."""
    success = (
        F.col("rejected").isNull() & (F.col("errors") == 0) & (F.col("exceptions") == 0) & (F.col("cancelled") == 0)
        & (F.size("line_errors") == 0)
    )
    imported = F.col("created") + F.col("altered") + F.col("combined")
    return parsed.withColumn("is_success", success).withColumn(
        "status",
        F.when(F.col("is_success"), F.lit("pushed"))
        .when(imported == 0, F.lit("push_failed"))
        .otherwise(F.lit("pushed_partial")),
    )


def pending_artifacts(artifacts: DataFrame, completed: DataFrame) -> DataFrame:
    """Artifacts still to import: jobs not completed yet, with the payload check in `intact`.

    artifacts: job_id, xml, xml_sha256 (null or empty when none was issued). completed: job_id.
    """
    issued = F.coalesce("xml_sha256", F.lit(""))
    waiting = artifacts.join(completed.select("job_id").distinct(), "job_id", "left_anti")
    return waiting.withColumn("intact", (issued == "") | (F.sha2("xml", 256) == issued))
