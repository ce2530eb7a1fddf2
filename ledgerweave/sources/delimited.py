"""Delimited text files to all-string tables, with delimiter, encoding and header rules."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave import errors as E
from ledgerweave.errors import StageResult
from ledgerweave.sources.row_numbers import with_file_row, with_source_row
from ledgerweave.sources.split_records import number_records, read_records

# Separators that are tried (earlier wins a tie), texts read as null, limits.
DELIMITERS = (",", ";", "\t", "|")
NULL_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
MAX_ROWS, MAX_COLUMNS = 200_000, 1_000
_BOM = "\ufeff"
_OVERFLOW = "_overflow"
#: Encodings in which line feeds, quotes and separators are single bytes, so that files split anywhere.
BYTEWISE = ("UTF-8", "ISO-8859-1", "US-ASCII")
_MARKS = {"EFBBBF": "UTF-8", "FFFE": "UTF-16LE", "FEFF": "UTF-16BE"}
_UNNAMED = re.compile(r"^Unnamed: \d+$")


def delimiter_of(line: Column) -> Column:
    """The separator that occurs most often in a line; comma when none does."""
    counts = [F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))) for d in DELIMITERS]
    most = F.greatest(*counts)
    choice = F.when(most == 0, F.lit(","))
    for delimiter, count in zip(DELIMITERS, counts):
        choice = choice.when(count == most, F.lit(delimiter))
    return choice


def _heads(spark: SparkSession, paths: str | list[str], encoding: str | None) -> list[tuple[str, str, str]]:
    """(file, encoding, first line that is not blank) of each file with a byte in it.

    Without an encoding, a byte order mark decides, else UTF-8 if all lines are valid, else ISO-8859-1: a line never ends
    inside a character of UTF-8, so lines are checked one by one, wherever a file is split. Two scans of lines, no file
    is held as one value; the driver sees one row per file.
    """
    reader = spark.read.option("lineSep", "\n")
    if encoding is not None and encoding not in BYTEWISE:
        reader = reader.option("encoding", encoding)
    raw = F.col("value").cast("binary")
    lines = reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        (F.col("value") if encoding is None else F.decode(raw, encoding)).alias("text"), raw.alias("raw"), F.monotonically_increasing_id().alias("at"),
    )
    mark, at = F.hex(F.substring("raw", 1, 3)), F.col("at")
    splits = lines.groupBy("file", "block").agg(
        F.min("at").alias("first"), F.min(F.when(F.regexp_replace("text", f"^{_BOM}", "").rlike(r"\S"), at)).alias("filled"),
        *[F.min(F.when(mark.startswith(m), at)).alias(m) for m in _MARKS], F.bool_and(F.is_valid_utf8("text")).alias("valid"),
    )
    top = F.col("filled").isNotNull()
    files = splits.groupBy("file").agg(
        F.min_by("filled", F.when(top, F.col("block"))).alias("at"), F.bool_and("valid").alias("valid"),
        *[F.min_by(F.coalesce(F.col(m) == F.col("first"), F.lit(False)), "block").alias(m) for m in _MARKS],
    )
    kind = F.lit(encoding)
    if encoding is None:
        kind = F.when(F.col("valid"), F.lit("UTF-8")).otherwise(F.lit("ISO-8859-1"))
        for m, name in _MARKS.items():
            kind = F.when(F.col(m), F.lit(name)).otherwise(kind)
    found = files.select("file", kind.alias("encoding"), "at").collect()
    own = spark.createDataFrame([(r["at"],) for r in found if r["at"] is not None], "at long")
    texts = {r["at"]: bytes(r["raw"]) for r in lines.join(F.broadcast(own), "at").select("at", "raw").collect()}
    return [(r["file"], r["encoding"], texts.get(r["at"], b"").decode(r["encoding"], "replace").lstrip(_BOM)) for r in found]


def sniff(spark: SparkSession, paths: str | list[str], encoding: str | None = None) -> DataFrame:
    """(file, encoding, header, line_end, delimiter, empty) per file, one row each. Files without a byte have none.

    A file whose first line holds carriage returns ends its lines with them alone.
    """
    found = _heads(spark, paths, encoding)
    if encoding is None:
        wide: dict[str, list[str]] = {}
        for file, kind, _ in found:
            if kind not in BYTEWISE:
                wide.setdefault(kind, []).append(_reader_path(file))
        found = [f for f in found if f[1] in BYTEWISE] + [f for kind, own in wide.items() for f in _heads(spark, own, kind)]
    rows = []
    for file, kind, line in found:
        parts = [p for p in line.rstrip("\r").split("\r") if p.strip()]
        rows.append((file, kind, parts[0] if parts else "", "\r" if "\r" in line.rstrip("\r") else "\n"))
    table = spark.createDataFrame(rows, "file string, encoding string, header string, line_end string")
    return table.withColumns({"delimiter": delimiter_of(F.col("header")), "empty": F.trim("header") == ""})


def header_names(raw: list[str | None]) -> list[str]:
    """Column names of a header record: blanks become 'Unnamed: N', repeats get '.1', '.2'; all trimmed."""
    names: list[str] = []
    seen: dict[str, int] = {}
    taken = {r for r in raw if r}
    for i, cell in enumerate(raw):
        name = cell if cell not in (None, "") else f"Unnamed: {i}"
        count = seen.get(name, 0)
        final = name
        while count and final in taken | set(names):
            final = f"{name}.{count}"
            count += 1
        seen[name] = max(count, 1)
        names.append(final)
    return [n.strip() for n in names]


@dataclass
class Upload:
    """A scanned upload: the table, its problems, and notes for the person who sent it."""

    result: StageResult
    notes: list[str]
    dropped: list[str]


META = ("source_row", "upload")


def read_delimited(
    spark: SparkSession,
    paths: str | list[str],
    delimiter: str | None = None,
    encoding: str | None = None,
    multi_line: bool = True,
) -> StageResult:
    """All-string table with `source_row`, and an error row for each record with too many fields and each empty file.

    Every file is read by its own encoding, delimiter and header; files that agree in them are read together, and
    columns of all files are aligned by name (null where a file lacks one). With more than one file the table and the
    errors have `upload`, the path, and rows are numbered per file. The driver sees one row per file.

    `multi_line` allows line breaks in quoted cells. Files still split (`split_records`), but for those in UTF-16, which are
    read in one task each. A record above `split_records.MAX_RECORD` bytes is an error row: most likely a quote was never
    closed. Records with too few fields are padded with null.
    """
    files = sniff(spark, paths, encoding).orderBy("file").collect()
    # files without a byte yield no row; the listing has them
    seen = {_plain_path(f["file"]) for f in files}
    bare = [f for f in spark.read.text(paths).inputFiles() if _plain_path(f) not in seen]
    many = len(files) + len(bare) > 1
    empty = [f["file"] for f in files if f["empty"]] + bare
    variants: dict[tuple, list[str]] = {}
    for f in files:
        if not f["empty"]:
            variants.setdefault((delimiter or f["delimiter"], f["encoding"], f["line_end"], f["header"]), []).append(_reader_path(f["file"]))
    problems = [{"code": E.EMPTY_FILE, "message": "The file is empty.", "upload": f if many else None} for f in empty or ([] if files else [None])]
    nothing = spark.createDataFrame([], "source_row long, upload string" if many else "source_row long")
    data, errors = [], [E.literal_errors(spark, problems, "parse", None)]
    for (separator, kind, line_end, _), own in variants.items():
        one = _read_alike(spark, own, separator, kind, line_end, multi_line, many)
        data.append(one.data)
        errors.append(one.errors)
    if len(data) == 1:
        return StageResult(data[0], reduce(DataFrame.unionByName, errors))
    return StageResult(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), data, nothing), reduce(DataFrame.unionByName, errors))


def _plain_path(path: str) -> str:
    """A path as listings and rows agree on it: one slash behind the scheme, nothing quoted."""
    return re.sub(r"^(\w+):/+", r"\1:/", unquote(path))


def _reader_path(path: str) -> str:
    """A path of `_metadata` as readers take it."""
    return unquote(path)


def _read_alike(spark: SparkSession, paths: list[str], delimiter: str, encoding: str, line_end: str, multi_line: bool, by_file: bool) -> StageResult:
    """Files with one encoding, delimiter, line end and header."""
    options = {
        "sep": delimiter, "multiLine": str(multi_line).lower(), "mode": "PERMISSIVE", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": "",
    }
    scan = spark.read.options(encoding=encoding, inferSchema="false", **options)
    # the header record alone; quoted line breaks in it are handled by the same reader
    record = scan.option("header", "false").csv(paths).first()
    raw = [(c or "").replace(_BOM, "") if i == 0 else c for i, c in enumerate(record)]
    names = header_names(raw)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
                          + [T.StructField(_OVERFLOW, T.StringType())])
    cells = [
        F.when(~F.col(f"c{i}").isin(*NULL_TEXTS), F.col(f"c{i}")).alias(f"c{i}") for i in range(len(names))
    ]
    filled = F.coalesce(*[F.col(f"c{i}") for i in range(len(names))], F.col(_OVERFLOW)).isNotNull()
    long = F.lit(False)
    if multi_line and encoding in BYTEWISE:
        long = F.col("_long")

        def parsed(records: DataFrame) -> DataFrame:
            text = F.regexp_replace(F.decode("text", encoding) if encoding != "UTF-8" else F.col("text").cast("string"), r"\r\z", "")
            row = F.from_csv(text, schema.simpleString()[7:-1].replace(":", " "), options)
            table = records.select("file", "block", F.col("long").alias("_long"), row.alias("row")).select("file", "block", "_long", "row.*")
            return table.select("file", "block", "_long", *cells, _OVERFLOW).filter(filled)

        whole, crossing = read_records(spark, paths, delimiter, line_end)
        # the header is the first record of a file, and counts as one unless all of its names read as null
        skip = int(any(c is not None and c not in NULL_TEXTS for c in raw))
        numbered = number_records(parsed(whole), None if crossing is None else parsed(crossing), "source_row", skip).withColumnRenamed("file", "upload")
    else:
        table = scan.schema(schema).options(header="true", enforceSchema="true").csv(paths)
        place = [F.col("_metadata.file_path").alias("upload"), F.col("_metadata.file_block_start").alias("_block")] if by_file else []
        rows = table.select(*cells, _OVERFLOW, *place).filter(filled)
        numbered = with_file_row(rows, "upload", "_block") if by_file else with_source_row(rows)
    ragged = F.when(long, E.issue(E.PARSE_FAILED, None, "The record is too long; a quote may not be closed.", raw=F.col("c0"))).when(
        F.col(_OVERFLOW).isNotNull(),
        E.issue(E.PARSE_FAILED, None, "The record has more fields than the header.", raw=F.col(_OVERFLOW)),
    )
    errors = E.error_rows(numbered, F.array(ragged), "parse", None)
    good = numbered.filter(F.col(_OVERFLOW).isNull() & ~long)
    lead = ["source_row", *["upload"] * by_file]
    data = good.select(*lead, *[F.col(f"c{i}") for i in range(len(names))]).toDF(*lead, *names)
    return StageResult(data, errors)


def clean_table(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Trim headers and drop columns and rows without a value; report dropped columns that had a real header.

    One aggregate counts the values of all columns; its result is a single row.
    """
    names = [c.strip() for c in df.columns]
    df = df.toDF(*names)
    columns = [c for c in names if c not in META]
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    kept = [c for i, c in enumerate(columns) if counts[f"n{i}"]]
    dropped = [c for c in columns if c not in kept and c and not c.startswith("Unnamed:")]
    chosen = df.select(*[c for c in names if c in META], *[F.col(f"`{c}`") for c in kept])
    if not kept:
        return chosen.limit(0), dropped
    return chosen.filter(F.coalesce(*[F.col(f"`{c}`") for c in kept]).isNotNull()), dropped


def check_intake(
    df: DataFrame, max_rows: int | None = None, max_columns: int | None = None
) -> tuple[DataFrame, list[str]]:
    """(error rows, notes) about an upload as a whole. No limit holds unless the caller sets it (MAX_ROWS and MAX_COLUMNS are customary ones)."""
    columns = [c for c in df.columns if c not in META]
    problems = []
    if not columns or df.isEmpty():
        problems.append({"code": E.EMPTY_FILE, "message": "The file has no data rows."})
    elif max_rows is not None and df.select(F.lit(1)).limit(max_rows + 1).count() > max_rows:
        problems.append({"code": E.FILE_TOO_LARGE, "message": f"The file has more than {max_rows:,} rows."})
    if max_columns is not None and len(columns) > max_columns:
        problems.append({"code": E.TOO_MANY_COLUMNS, "message": f"The file has more than {max_columns:,} columns."})
    notes = []
    unnamed = [c for c in columns if _UNNAMED.match(c)]
    if unnamed:
        notes.append(f"{len(unnamed)} unnamed column(s)")
    if len(set(columns)) != len(columns):
        notes.append("duplicate column headers")
    return E.literal_errors(df.sparkSession, problems, "parse", None), notes


def read_upload(spark: SparkSession, paths: str | list[str], max_rows: int | None = None, **options) -> Upload:
    """Scan, clean and check one upload."""
    scanned = read_delimited(spark, paths, **options)
    if not set(scanned.data.columns) - set(META):
        return Upload(scanned, [], [])
    data, dropped = clean_table(scanned.data)
    problems, notes = check_intake(data, max_rows)
    if dropped:
        notes.insert(0, f"{len(dropped)} empty column(s) ignored: {', '.join(dropped)}")
    return Upload(StageResult(data, scanned.errors.unionByName(problems)), notes, dropped)
