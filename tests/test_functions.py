from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerweave import functions as fn


def one(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", expr("v").alias("out")).orderBy("i").collect()]


def test_decimals(spark):
    cases = {
        "1,234.50": "1234.50", "(500)": "-500", "₹1,00,000": "100000", "Rs. 2,500": "2500", "-250": "-250",
        "1.5e3": "1500", "100-": "-100", "+50": "50", "1000": "1000", "12.5": "12.5", "(-5)": "5", "-+5": "-5",
        "(+5)": "-5", "--5": "5", "-5-": "5", "1000 Cr": "1000", "USD 7": "7", "(Rs. 5)": "-5", ".5": "0.5",
    }
    got = one(spark, list(cases), fn.to_decimal)
    assert got == [Decimal(v).quantize(Decimal("0.000001")) for v in cases.values()]


def test_blank_and_bad_decimals(spark):
    blank = ["", "  ", "NA", "n/a", "-", "nil", None, "$$", "+", ".", "()"]
    bad = ["abc", "12.3.4", "1,2,x", "1.2.3", "Rs500", "---5", "NaN5"]
    assert one(spark, blank, fn.to_decimal) == [None] * len(blank)
    assert one(spark, blank, fn.is_bad_decimal) == [False] * len(blank)
    assert one(spark, bad, fn.is_bad_decimal) == [True] * len(bad)


def test_amount_side(spark):
    cases = [
        ("15000", "Cr", "15000", False), ("15000", "Dr", "15000", True), ("-15000", None, "15000", False),
        ("15000", None, "15000", True), ("15000 Cr", None, "15000", False), ("8,000.50", "credit", "8000.50", False),
        ("(7)", "?", "7", False),
    ]
    df = spark.createDataFrame([(i, a, s) for i, (a, s, _, _) in enumerate(cases)], "i int, a string, s string")
    rows = df.select("i", fn.to_amount_side("a", "s").alias("x")).orderBy("i").collect()
    assert [(r.x.amount, r.x.is_debit) for r in rows] == [(Decimal(a), d) for _, _, a, d in cases]
    assert one(spark, ["", "abc"], fn.to_amount_side) == [None, None]


def test_flags(spark):
    values = ["Yes", "no", "Y", "N", "1", "0", "true", "FALSE", "on", "", "maybe"]
    assert one(spark, values, fn.to_flag) == [True, False] * 4 + [True, None, None]
    assert one(spark, values, fn.is_bad_flag)[-2:] == [False, True]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2026-04-01", date(2026, 4, 1)), ("01-04-2026", date(2026, 4, 1)), ("1/4/2026", date(2026, 4, 1)),
        ("01.04.26", date(2026, 4, 1)), ("31/12/99", date(1999, 12, 31)), ("12/25/2026", date(2026, 12, 25)),
        ("20260401", date(2026, 4, 1)), ("2026-4-1 10:20:30", date(2026, 4, 1)),
        ("2026-04-01T10:20:30Z", date(2026, 4, 1)), ("1 Apr 2026", date(2026, 4, 1)),
        ("01-Apr-26", date(2026, 4, 1)), ("April 1, 2026", date(2026, 4, 1)), ("2026/04/01", date(2026, 4, 1)),
        ("nonsense", None), ("31/02/2026", None), ("2026-13-45", None), ("2026-04-01 junk", None), ("NA", None),
    ],
)
def test_dates(spark, text, expected):
    assert one(spark, [text], fn.to_date_dayfirst) == [expected]


def test_names(spark):
    assert one(spark, ["  HDFC \t Bank ", None, "ß"], fn.norm) == ["hdfc bank", None, "ß"]
    assert one(spark, ["  ", "NA", " x "], fn.to_text) == [None, None, "x"]


def test_states(spark):
    values = ["Maharashtra", "MH", "27", "karnataka", "1", "99", "Atlantis ", None, "andaman  AND nicobar islands"]
    assert one(spark, values, fn.norm_state) == [
        "Maharashtra", "Maharashtra", "Maharashtra", "Karnataka", "Jammu and Kashmir", "99", "atlantis", "",
        "Andaman and Nicobar Islands",
    ]
    assert one(spark, ["27ABCDE1234F1Z5", "29ABCDE1234F1Z5", "bad", None], fn.state_of_gstin) == [
        "Maharashtra", "Karnataka", "", "",
    ]
    df = spark.createDataFrame(
        [("Maharashtra", "MH"), ("27", "Maharashtra"), ("Karnataka", "Maharashtra"), ("", "MH"), ("MH", None)],
        "b string, h string",
    )
    assert [r[0] for r in df.select(fn.is_intra("b", "h")).collect()] == [True, True, False, None, None]


def test_gst(spark):
    cases = [
        ("1000", "18", True, ("90.00", "90.00", "0.00"), ["Output CGST", "Output SGST"]),
        ("1000", "18", False, ("0.00", "0.00", "180.00"), ["Output IGST"]),
        ("100.28", "5", True, ("2.51", "2.50", "0.00"), ["Output CGST", "Output SGST"]),
        ("500", "0", True, ("0.00", "0.00", "0.00"), []),
        ("1,000.00", "12", False, ("0.00", "0.00", "120.00"), ["Output IGST"]),
        ("abc", "18", True, None, None), ("100", "n/a", False, None, None), ("100", "-5", True, None, None),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, a string, r string, x boolean")
    rows = (
        df.withColumn("g", fn.gst_split("a", "r", F.col("x")))
        .withColumn("legs", F.when(F.col("g").isNotNull(), fn.gst_legs(F.col("g"))))
        .orderBy("i").collect()
    )
    for row, (_, _, _, split, legs) in zip(rows, cases):
        if split is None:
            assert row.g is None
        else:
            assert tuple(str(x) for x in (row.g.cgst, row.g.sgst, row.g.igst)) == split
            assert [x.ledger for x in row.legs] == legs


def test_formats(spark):
    df = spark.createDataFrame([(Decimal("12345.005"), True), (Decimal("54321"), False)], "a decimal(20,6), d boolean")
    assert [r[0] for r in df.select(fn.signed_opening("a", "d")).collect()] == ["12345.01", "-54321.00"]
    assert [r[0] for r in df.select(fn.signed_line("a", "d")).collect()] == ["-12345.01", "54321.00"]
    assert one(spark, ["100", "1.50", "0", "1e3", "10.05"], lambda c: fn.fmt_number(fn.to_decimal(c))) == [
        "100", "1.5", "0", "1000", "10.05",
    ]


def test_short_ways_of_dates(spark):
    cells = {"2 Jan 1998": "1998-01-02", "31 dec 2020": "2020-12-31", "30 Feb 2001": None, "2 Xyz 1998": None, "2 Ebm 1998": None, "2001-02-29": None,
             "2000-02-29": "2000-02-29", "1 Jan 0000": "0000-01-01", "0000-01-01": "0000-01-01", "01/01/0000": "0000-01-01", "2 Jan 98": "1998-01-02", "2 January 1998": "1998-01-02"}
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select("c", fn.to_date_dayfirst("c").cast("string").alias("d"))
    assert {r.c: r.d for r in rows.collect()} == cells
