import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerweave import errors as E
from ledgerweave.sources.delimited import check_intake, clean_table, header_names, read_delimited, read_upload, sniff
from ledgerweave.sources.responses import import_outcome, parse_responses, pending_artifacts
from ledgerweave.sources.row_numbers import read_parquet_numbered, with_source_row
from ledgerweave.sources.staging import expire_staged, for_org, rewrite_staged, stage_records, write_staged
from test_vouchers import frame


def put(tmp_path, content, name="x.csv"):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def rows(df):
    return [tuple(r)[1:] for r in df.orderBy("source_row").collect()]


@pytest.mark.parametrize(
    ("content", "columns", "values"),
    [
        (b"Ledger Name,Under\nCust A,Sundry Debtors\nCust B,Bank\n", ["Ledger Name", "Under"],
         [("Cust A", "Sundry Debtors"), ("Cust B", "Bank")]),
        (b"name;parent\nA;S D\n\nB;Bank\n", ["name", "parent"], [("A", "S D"), ("B", "Bank")]),
        (b"Ledger Name\nCash\nHDFC Bank\n", ["Ledger Name"], [("Cash",), ("HDFC Bank",)]),
        (b"\nname\tparent\nCash\tCash-in-Hand\n", ["name", "parent"], [("Cash", "Cash-in-Hand")]),
        ("name,city\nCafé,Señor\n".encode("latin-1"), ["name", "city"], [("Café", "Señor")]),
        ("\ufeffLedger Name,Under\nAcmé,x\n".encode(), ["Ledger Name", "Under"], [("Acmé", "x")]),
        (b"  Ledger Name ,  Under \nA,1000\n", ["Ledger Name", "Under"], [("A", "1000")]),
        (b'a,a,\n"x\ny","p ""q""",NA\nnil,-\n', ["a", "a.1", "Unnamed: 2"], [("x\ny", 'p "q"', None), ("nil", "-", None)]),
    ],
)
def test_read(spark, tmp_path, content, columns, values):
    result = read_delimited(spark, put(tmp_path, content))
    assert result.data.columns == ["source_row", *columns]
    assert rows(result.data) == values
    assert [r.source_row for r in result.data.orderBy("source_row").collect()] == list(range(1, len(values) + 1))
    assert result.errors.count() == 0


def test_too_many_fields_is_an_error_row(spark, tmp_path):
    result = read_delimited(spark, put(tmp_path, "a,b\n1,2\n3,4,5\n6\n"))
    assert rows(result.data) == [("1", "2"), ("6", None)]
    assert [(e.source_row, e.code) for e in result.errors.collect()] == [(2, E.PARSE_FAILED)]


def test_many_files_and_large_file_mode(spark, tmp_path):
    put(tmp_path, "a|b\n1|2\n", "1.csv")
    put(tmp_path, "a|b\n3|4\n5|6\n", "2.csv")
    found = sniff(spark, str(tmp_path), encoding="UTF-8").orderBy("file").collect()
    assert [(r.delimiter, r.header) for r in found] == [("|", "a|b")] * 2
    result = read_delimited(spark, str(tmp_path), encoding="UTF-8", multi_line=False)
    assert sorted(rows(result.data.drop("upload"))) == [("1", "2"), ("3", "4"), ("5", "6")]
    assert sorted((r.upload[-5:], r.source_row) for r in result.data.collect()) == [("1.csv", 1), ("2.csv", 1), ("2.csv", 2)]


def test_upload_checks(spark, tmp_path):
    upload = read_upload(spark, put(tmp_path, "name,unit,parent,\nA,,SD,\nB,,SD,\n"))
    assert upload.dropped == ["unit"] and upload.result.data.columns == ["source_row", "name", "parent"]
    assert upload.notes == ["1 empty column(s) ignored: unit"]
    empty = read_upload(spark, put(tmp_path, "", "e.csv")).result
    assert [e.code for e in empty.errors.collect()] == [E.EMPTY_FILE]
    only_header = read_upload(spark, put(tmp_path, "a,b\n", "h.csv")).result
    assert [e.code for e in only_header.errors.collect()] == [E.EMPTY_FILE]
    assert read_upload(spark, put(tmp_path, "a,b\n" + "x,y\n" * 5, "n.csv")).result.ok()
    big = read_upload(spark, put(tmp_path, "a,b\n" + "x,y\n" * 5, "b.csv"), max_rows=2).result
    assert [e.code for e in big.errors.collect()] == [E.FILE_TOO_LARGE]
    errors, notes = check_intake(frame(spark, [{"Unnamed: 1": "x", "b": "y"}]), max_columns=1)
    assert [e.code for e in errors.collect()] == [E.TOO_MANY_COLUMNS] and notes == ["1 unnamed column(s)"]
    assert header_names(["a", None, "a", "a.1", "b "]) == ["a", "Unnamed: 1", "a.2", "a.1", "b"]
    cleaned, dropped = clean_table(frame(spark, [{" a ": "1", "b": None}, {" a ": None, "b": None}]))
    assert dropped == ["b"] and cleaned.count() == 1


def test_row_numbers(spark, tmp_path):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 3).alias("v"))
    got = with_source_row(df).collect()
    assert sorted((r.source_row, r.v) for r in got) == [(i + 1, 3 * i) for i in range(1000)]
    path = str(tmp_path / "p")
    df.write.parquet(path)
    numbered = read_parquet_numbered(spark, path).collect()
    assert sorted((r.source_row, r.v) for r in numbered) == [(i + 1, 3 * i) for i in range(1000)]


def test_staging(spark, tmp_path):
    df = frame(spark, [dict(order_id="", voucher_number=" V1 ", x="é"), dict(order_id="O2", voucher_number="V2", x=None)])
    at = F.when(F.col("order_id") == "O2", F.lit("2024-01-31 00:00:00")).otherwise(F.lit("2024-01-01 00:00:00")).cast("timestamp")
    records = stage_records(df, "org", F.concat(F.lit("job"), F.col("source_row")), at)
    got = {r.order_id: json.loads(r.data) for r in records.collect()}
    assert got["V1"] == {"order_id": "", "voucher_number": " V1 ", "x": "é"} and got["O2"]["x"] is None
    path, target = str(tmp_path / "s"), str(tmp_path / "t")
    write_staged(records, path)
    stored = spark.read.parquet(path)
    assert for_org(stored, "org").count() == 2 and for_org(stored, "other").count() == 0
    kept, deleted = expire_staged(stored, "2024-01-31 00:00:01")
    assert [r.order_id for r in kept.collect()] == ["O2"] and deleted.first().deleted == 1
    assert rewrite_staged(spark, path, target, "2024-01-31 00:00:01") == 1
    assert spark.read.parquet(target).count() == 1


RESPONSES = [
    ("<ENVELOPE><HEADER><VERSION>1</VERSION></HEADER><BODY><DATA><IMPORTRESULT><CREATED>12</CREATED><ALTERED>3</ALTERED>"
     "<IGNORED>1</IGNORED><ERRORS>1</ERRORS><LASTMID>41233</LASTMID><LINEERROR>Parent 'A &amp; B' missing</LINEERROR>"
     "</IMPORTRESULT></DATA></BODY></ENVELOPE>", None, 12, 3, 1, ["Parent 'A & B' missing"], "pushed_partial"),
    ("<A><CREATED>0</CREATED><ERRORS>2</ERRORS><LINEERROR>err one</LINEERROR><LINEERROR> err two </LINEERROR><LINEERROR/></A>",
     None, 0, 0, 2, ["err one", "err two"], "push_failed"),
    ("<RESPONSE>\n <CREATED>2</CREATED>\n <ERRORS>0</ERRORS>\n</RESPONSE>\n", None, 2, 0, 0, [], "pushed"),
    ("<envelope><body><created> 7 </created><altered>x</altered></body></envelope>", None, 7, 0, 0, [], "pushed"),
    ('<?xml version="1.0"?><!DOCTYPE foo [<!ENTITY x SYSTEM "file:///e">]><ENVELOPE><A>&x;</A></ENVELOPE>', "doctype",
     0, 0, 0, [], "push_failed"),
    ("<ENVELOPE><UNCLOSED>", "malformed", 0, 0, 0, [], "push_failed"),
    ("<A><CREATED>1</CREATED></A><B></B>", "malformed", 0, 0, 0, [], "push_failed"),
    ("<A><CREATED>1</CREATED><!-- <CREATED>9</CREATED> --></A>", None, 1, 0, 0, [], "pushed"),
    ("<A><CREATED>0</CREATED><LINEERROR><![CDATA[bad <ledger>]]></LINEERROR></A>", None, 0, 0, 0, ["bad <ledger>"], "push_failed"),
    ("<A><CREATED>1</CREATED><LINEERROR>caf&#233; &#x41;</LINEERROR></A>", None, 1, 0, 0, ["caf\u00e9 A"], "pushed_partial"),
    ("<A><CREATED>3000000000</CREATED><ns:ALTERED>2</ns:ALTERED></A>", None, 3000000000, 2, 0, [], "pushed"),
    ('<?xml version="1.0" encoding="UTF-16"?><A><CREATED>1</CREATED></A>', None, 1, 0, 0, [], "pushed"),
    ("plain", "malformed", 0, 0, 0, [], "push_failed"), (None, "malformed", 0, 0, 0, [], "push_failed"),
]


def test_responses(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RESPONSES)], "i int, xml string")
    got = import_outcome(parse_responses(df)).orderBy("i").collect()
    assert [(r.rejected, r.created, r.altered, r.errors, r.line_errors, r.status) for r in got] == [r[1:] for r in RESPONSES]
    assert got[0].last_master_id == 41233 and got[0].ignored == 1 and not got[0].is_success


def test_pending(spark):
    good = hashlib.sha256(b"<a/>").hexdigest()
    artifacts = spark.createDataFrame(
        [("1", "<a/>", good), ("2", "<a/>", "bad"), ("3", "<a/>", None), ("4", "<a/>", good)],
        "job_id string, xml string, xml_sha256 string")
    done = spark.createDataFrame([("4",), ("4",)], "job_id string")
    got = {r.job_id: r.intact for r in pending_artifacts(artifacts, done).collect()}
    assert got == {"1": True, "2": False, "3": True}


def test_files_of_one_call_are_read_by_their_own_rules(spark, tmp_path):
    one = put(tmp_path, "Name,Under\nA,Bank\nB,Cash,extra\n", "1.csv")
    put(tmp_path, "Under;Name;Pan\nBank;C;x\n", "2.csv")
    (tmp_path / "3.csv").write_bytes("Name\tUnder\nD\u00e9\tBank\nE\tBank\n".encode("latin-1"))
    put(tmp_path, "", "4.csv")
    import os
    made = read_delimited(spark, os.path.dirname(one) + "/*.csv")
    rows = sorted((r.upload[-5:], r.source_row, r.Name, r.Under, r.Pan) for r in made.data.collect())
    assert rows == [("1.csv", 1, "A", "Bank", None), ("2.csv", 1, "C", "Bank", "x"), ("3.csv", 1, "D\u00e9", "Bank", None), ("3.csv", 2, "E", "Bank", None)]
    assert sorted((r.upload[-5:], r.source_row or 0, r.code) for r in made.errors.collect()) == [("1.csv", 2, "parse_failed"), ("4.csv", 0, "empty_file")]


def test_profile_reads_long_values(spark):
    from ledgerweave.operators.profile import profile
    df = spark.createDataFrame([(1, "x" * 50000, "1"), (2, "x" * 50000, "2"), (3, "y", "a")], "source_row long, a string, b string")
    got = {r.column: (r.n_distinct, r.inferred_type, [s[:1] for s in r.samples]) for r in profile(df).collect()}
    assert got == {"a": (2, "string", ["x", "y"]), "b": (3, "string", ["1", "2", "a"])}
    assert "samples" not in profile(df, samples=False).columns


def test_retention_touches_only_folders_with_expired_rows(spark, tmp_path):
    import glob
    from ledgerweave.sources.staging import expire_in_place, write_staged
    path = str(tmp_path / "staged")
    rows = [("a", "j1", "1", "2024-01-01 00:00:00"), ("a", "j1", "2", "2024-03-01 00:00:00"), ("a", "j2", "3", "2024-01-01 00:00:00"), ("b", "j1", "4", "2024-03-01 00:00:00")]
    df = spark.createDataFrame(rows, "org_id string, job_id string, order_id string, at string").selectExpr("org_id", "job_id", "order_id", "'{}' as data", "cast(at as timestamp) as created_at")
    write_staged(df, path)
    before = set(glob.glob(path + "/org_id=b/*/*.parquet"))
    assert expire_in_place(spark, path, "2024-03-02 00:00:00") == 2
    left = spark.read.parquet(path)
    assert sorted((r.org_id, r.job_id, r.order_id) for r in left.collect()) == [("a", "j1", "2"), ("b", "j1", "4")]
    assert set(glob.glob(path + "/org_id=b/*/*.parquet")) == before and not glob.glob(path + "/org_id=a/job_id=j2")
    assert expire_in_place(spark, path, "2024-03-02 00:00:00") == 0


def _quoted_file(rng, n, end):
    """Records with every kind of cell that quotes allow, in the form a careful writer gives them."""
    pieces = ["a", "b c", ",", ";", '"', "\n", "\r\n", "é", "", " ", "x" * 30]
    lines, wanted = ["k,v,w"], []
    for i in range(n):
        cells = [f"r{i}", *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) for _ in range(2))]
        if i % 50 == 7:
            cells[1] = "long\n" * 150 + "end"
        wanted.append(tuple(cells))
        lines.append(",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\n\r') or rng.random() < 0.2 else c for c in cells))
        if i % 31 == 5:
            lines.append("")
    return end.join(lines) + end * rng.randint(0, 1), wanted


@pytest.mark.parametrize(("end", "encoding"), [("\n", "utf-8"), ("\r\n", "utf-8"), ("\n", "latin-1"), ("\n", "utf-8-sig")])
def test_a_file_with_line_breaks_in_cells_is_read_by_many_tasks(spark, tmp_path, end, encoding):
    """Splits far smaller than some records; the result is that of a reader that sees each file whole."""
    import csv
    import io
    import random
    from ledgerweave.sources import split_records
    rng = random.Random(len(end) + len(encoding))
    made = {f"{n}.csv": _quoted_file(rng, n, end) for n in (120, 61)}
    for name, (text, _) in made.items():
        put(tmp_path, text.encode(encoding), name)
    nulls = ("", "NA")
    want = sorted((name, i, *(None if c in nulls else c for c in row)) for name, (text, _) in made.items()
                  for i, row in enumerate([r for r in csv.reader(io.StringIO(text, newline="")) if r][1:], 1))
    assert [w[2:] for w in want if w[0] == "61.csv"] == [tuple(c or None for c in r) for r in made["61.csv"][1]]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert split_records.lines_of(spark, str(tmp_path)).select("file", "block").distinct().count() > 20
        result = read_delimited(spark, str(tmp_path))
        got = sorted((r.upload.rsplit("/", 1)[1], r.source_row, r.k, r.v, r.w) for r in result.data.collect())
        assert result.errors.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == want


def test_encodings_and_line_ends_of_one_call(spark, tmp_path):
    text = 'name,note\nCafé,"two\nlines"\nB,x\n'
    files = {"utf16le": b"\xff\xfe" + text.encode("utf-16-le"), "utf16be": b"\xfe\xff" + text.encode("utf-16-be"), "bom": text.encode("utf-8-sig"),
             "latin": text.encode("latin-1"), "plain file": text.encode(), "mac": text.replace("\n", "\r").encode()}
    for name, content in files.items():
        put(tmp_path, content, name + ".csv")
    kinds = {r.file.rsplit("/", 1)[1]: (r.encoding, r.line_end) for r in sniff(spark, str(tmp_path)).collect()}
    assert kinds == {"utf16le.csv": ("UTF-16LE", "\n"), "utf16be.csv": ("UTF-16BE", "\n"), "bom.csv": ("UTF-8", "\n"),
                     "latin.csv": ("ISO-8859-1", "\n"), "plain%20file.csv": ("UTF-8", "\n"), "mac.csv": ("UTF-8", "\r")}
    made = read_delimited(spark, str(tmp_path))
    got = {}
    for r in made.data.orderBy("source_row").collect():
        got.setdefault(r.upload.rsplit("/", 1)[1], []).append((r.source_row, r.name, r.note.replace("\r", "\n")))
    assert got == {name: [(1, "Café", "two\nlines"), (2, "B", "x")] for name in kinds}
    assert made.errors.count() == 0


def test_a_quote_that_is_never_closed(spark, tmp_path, monkeypatch):
    from ledgerweave.sources import split_records
    path = put(tmp_path, 'a,b\n1,2\n3,"open\n' + "x,y\n" * 200)
    whole = read_delimited(spark, path).data.orderBy("source_row").collect()
    assert [(r.a, r.b.strip()) for r in whole] == [("1", "2"), ("3", "open\n" + "x,y\n" * 199 + "x,y")]
    monkeypatch.setattr(split_records, "MAX_RECORD", 100)
    monkeypatch.setattr(split_records, "CUT", 10)
    result = read_delimited(spark, path)
    assert rows(result.data) == [("1", "2")]
    assert [(e.source_row, e.code) for e in result.errors.collect()] == [(2, E.PARSE_FAILED)]


@pytest.mark.parametrize(("line", "outside", "inside"), [
    (b"a,b", False, True), (b'"a', True, False), (b'a,"b""', True, False), (b'"a","b', True, True), (b'a"b,c', False, False), (b'"a""', True, False),
    (b'x","y"', False, False), (b"", False, True), (b'""', False, True), (b'a,""', False, True)])
def test_ends_inside(line, outside, inside):
    from ledgerweave.sources.split_records import ends_inside
    assert (ends_inside(line, False, b","), ends_inside(line, True, b",")) == (outside, inside)
