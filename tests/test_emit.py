import os
from decimal import Decimal
from xml.etree import ElementTree

from pyspark.sql import functions as F

from ledgerweave import errors as E
from ledgerweave.operators.emit import POSITION
from ledgerweave.operators.masters import conversion_counts, convert_masters, to_groups, to_ledgers, to_stock_items, to_units
from ledgerweave.operators.vouchers import build_vouchers
from ledgerweave.sources.envelopes import envelope_rows, write_envelopes
from test_vouchers import entry, frame, sale


def text(rows):
    return "".join(r.xml for r in rows.orderBy("chunk", *POSITION).collect())


# A request the importing package accepts, byte for byte.
ACCEPTED = (
    '<ENVELOPE><HEADER><TALLYREQUEST>Import Data</TALLYREQUEST></HEADER><BODY><IMPORTDATA><REQUESTDESC>'
    '<REPORTNAME>All Masters</REPORTNAME><STATICVARIABLES><SVCURRENTCOMPANY>Test1</SVCURRENTCOMPANY>'
    '<IMPORTDUPS>@@DupModify</IMPORTDUPS></STATICVARIABLES></REQUESTDESC><REQUESTDATA>'
    '<TALLYMESSAGE xmlns:UDF="TallyUDF"><LEDGER NAME="AA TM Debit Test" ACTION="Create"><NAME>AA TM Debit Test</NAME>'
    '<PARENT>Sundry Debtors</PARENT><COUNTRYNAME>India</COUNTRYNAME><OPENINGBALANCE>12345.00</OPENINGBALANCE></LEDGER>'
    '</TALLYMESSAGE><TALLYMESSAGE xmlns:UDF="TallyUDF"><LEDGER NAME="AA TM Credit Test" ACTION="Create">'
    '<NAME>AA TM Credit Test</NAME><PARENT>Sundry Creditors</PARENT><COUNTRYNAME>India</COUNTRYNAME>'
    '<OPENINGBALANCE>-54321.00</OPENINGBALANCE></LEDGER></TALLYMESSAGE></REQUESTDATA></IMPORTDATA></BODY></ENVELOPE>'
)


def test_accepted_request(spark):
    ledgers = to_ledgers(frame(spark, [
        dict(name="AA TM Debit Test", parent="Sundry Debtors", opening_balance="12345"),
        dict(name="AA TM Credit Test", parent="Sundry Creditors", opening_balance="54321", opening_balance_drcr="Cr"),
    ])).data
    assert text(envelope_rows("Test1", {"ledger": ledgers})) == ACCEPTED


def test_master_order_and_elements(spark):
    xml = text(envelope_rows("A & Co é", {
        "ledger": to_ledgers(frame(spark, [
            dict(name="Café", parent="Sundry Debtors", credit_limit="10.005", is_billwise="y", mailing_name="M"),
            dict(name="Cust New", parent="P", _action="alter", old_name="Cust Old", guid="g1", opening_balance="5"),
        ])).data,
        "stock_item": to_stock_items(frame(spark, [
            dict(name="Shirt", base_units="Pcs", gst_applicable="Yes", hsn="61052010", opening_qty="25.50",
                 opening_rate="490", opening_value="12250"),
            dict(name="X", base_units="Pcs", parent="Apparel"),
        ])).data,
        "unit": to_units(frame(spark, [
            dict(name="Pcs"), dict(name="Box", base_units="Pcs", additional_units="Box", conversion="12"),
        ])).data,
        "group": to_groups(frame(spark, [
            dict(name="Trade", parent="Sundry"), dict(name="Sundry", is_revenue="no"),
        ])).data,
    }))
    assert "A &amp; Co &#233;" in xml and 'NAME="Caf&#233;"' in xml and "Café" not in xml
    root = ElementTree.fromstring(xml.replace("&#4;", "*"))
    masters = [m[0] for m in root.iter("TALLYMESSAGE")]
    assert [(m.tag, m.get("NAME")) for m in masters] == [
        ("UNIT", "Pcs"), ("UNIT", "Box"), ("GROUP", "Sundry"), ("GROUP", "Trade"), ("STOCKITEM", "Shirt"),
        ("STOCKITEM", "X"), ("LEDGER", "Café"), ("LEDGER", "Cust New"),
    ]
    unit, group, shirt, x, cafe, new = masters[1], masters[2], *masters[4:]
    assert unit.findtext("CONVERSION") == "12" and unit.findtext("ISSIMPLEUNIT") == "No"
    assert group.findtext("PARENT") == "Primary" and group.findtext("ISREVENUE") == "No"
    assert shirt.find("PARENT") is None and shirt.findtext("OPENINGBALANCE") == "25.5 Pcs"
    assert shirt.findtext("OPENINGRATE") == "490.00/Pcs" and shirt.findtext("GSTAPPLICABLE") == "* Applicable"
    assert x.findtext("PARENT") == "Apparel" and x.findtext("GSTAPPLICABLE") == "* Not Applicable"
    assert cafe.findtext("CREDITLIMIT") == "10.01" and cafe.findtext("MAILINGNAME.LIST/MAILINGNAME") == "M"
    assert new.find("OPENINGBALANCE") is None and new.get("ACTION") == "Alter" and new.findtext("GUID") == "g1"
    assert [n.text for n in new.find("NAME.LIST")] == ["Cust New", "Cust Old"]


def test_voucher_envelope(spark, tmp_path):
    rows = [
        entry("R<1>", "Cash", "5000", "Dr", narration="n&m"), entry("R<1>", "Customer 1", "5000", "Cr"),
        entry("INV", "Customer 1", "5000", "Dr", party_ledger="Customer 1"),
        entry("INV", "Sales", "5000", "Cr", stock_item="Widget", quantity="100", rate="50", unit="Nos"),
        sale(),
    ]
    built = build_vouchers(frame(spark, rows))
    envelope = envelope_rows("T", vouchers=(built.vouchers, built.lines))
    root = ElementTree.fromstring(text(envelope))
    assert root.findtext(".//REPORTNAME") == "Vouchers" and root.find(".//IMPORTDUPS") is None
    first, invoice, taxed = root.iter("VOUCHER")
    assert first.get("OBJVIEW") == "Accounting Voucher View" and first.findtext("VOUCHERNUMBER") == "R<1>"
    assert first.findtext("DATE") == first.findtext("EFFECTIVEDATE") == "20260401"
    assert [(e.findtext("LEDGERNAME"), e.findtext("ISDEEMEDPOSITIVE"), e.findtext("AMOUNT"))
            for e in first.findall("ALLLEDGERENTRIES.LIST")] == [("Cash", "Yes", "-5000.00"), ("Customer 1", "No", "5000.00")]
    assert invoice.get("OBJVIEW") == "Invoice Voucher View" and len(invoice.findall("LEDGERENTRIES.LIST")) == 1
    item = invoice.find("ALLINVENTORYENTRIES.LIST")
    assert (item.findtext("ACTUALQTY"), item.findtext("RATE")) == ("100 Nos", "50.00/Nos")
    assert item.findtext("ACCOUNTINGALLOCATIONS.LIST/LEDGERNAME") == "Sales"
    for voucher in root.iter("VOUCHER"):
        entries = voucher.findall("./*/AMOUNT")
        assert sum(Decimal(e.text) for e in entries) == 0
    assert [e.findtext("LEDGERNAME") for e in taxed.findall("ALLLEDGERENTRIES.LIST")] == [
        "Sales", "Output CGST", "Output SGST", "Customer A",
    ]
    chunked = str(tmp_path / "chunked")
    write_envelopes(envelope_rows("T", vouchers=(built.vouchers, built.lines), chunk=1), chunked)
    found = []
    for folder in sorted(d for d in os.listdir(chunked) if d.startswith("chunk=")):
        parts = sorted(f for f in os.listdir(f"{chunked}/{folder}") if f.startswith("part"))
        whole = "".join(open(f"{chunked}/{folder}/{f}", encoding="utf-8").read() for f in parts)
        found += [v.findtext("VOUCHERNUMBER") for v in ElementTree.fromstring(whole).iter("VOUCHER")]
    assert sorted(found) == ["1001", "INV", "R<1>"]


def test_conversion_errors(spark):
    rows = [
        dict(name="Cust", parent="P", opening_balance="(15000)"), dict(name="  ", parent="X"),
        dict(name="Cust", parent="P", credit_limit="abc", is_billwise="maybe"), dict(name="A", parent="-"),
        dict(name="B", parent="P", opening_balance="x", credit_limit="y"),
    ]
    df = frame(spark, rows)
    result = convert_masters(df, "ledger")
    got = {r.source_row: r for r in result.data.collect()}
    assert set(got) == {1, 3}
    assert (got[1].opening_balance, got[1].opening_is_debit) == (Decimal("15000"), False)
    assert (got[3].opening_balance, got[3].opening_is_debit, got[3].credit_limit) == (0, True, None)
    assert {(e.source_row, e.code, e.source_column) for e in result.errors.collect()} == {
        (2, E.REQUIRED_MISSING, "name"), (3, E.BAD_DECIMAL, "credit_limit"), (3, E.VALUE_NOT_ALLOWED, "is_billwise"),
        (4, E.REQUIRED_MISSING, "parent"), (5, E.VALIDATION_ERROR, "name"), (5, E.BAD_DECIMAL, "credit_limit"),
    }
    counts = conversion_counts(df, df.limit(0), result).first()
    assert (counts.generated, counts.held, counts.skipped, counts.errors, counts.ok) == (2, 0, 3, 6, True)


def test_chunks_are_exact_and_in_order(spark, tmp_path):
    rows = []
    for n in range(23):
        # numbers fall while rows rise, so the order by number, by key and by row differ
        rows += [entry(f"V{90 - n}", "Cash", "100", "Dr"), entry(f"V{90 - n}", "Sales", "100", "Cr")]
    built = build_vouchers(frame(spark, rows))
    units = to_units(frame(spark, [dict(name="Nos")])).data
    made = envelope_rows("T", {"unit": units}, (built.vouchers, built.lines), chunk=5)
    folder = str(tmp_path / "ranges")
    write_envelopes(made, folder, folders=2)
    names = sorted(d for d in os.listdir(folder) if d.startswith("chunk="))
    assert names == ["chunk=0", "chunk=3"]
    found = []
    for name in names:
        parts = sorted(f for f in os.listdir(f"{folder}/{name}") if f.startswith("part"))
        whole = "".join(open(f"{folder}/{name}/{f}", encoding="utf-8").read() for f in parts)
        found += [ElementTree.fromstring(f"<ENVELOPE>{t}") for t in whole.split("<ENVELOPE>")[1:]]
    assert [[v.findtext("VOUCHERNUMBER") for v in e.iter("VOUCHER")] for e in found] == [
        [f"V{90 - n}" for n in range(first, min(first + 5, 23))] for first in range(0, 23, 5)]
    assert [[u.get("NAME") for u in e.iter("UNIT")] for e in found] == [["Nos"], [], [], [], []]
    assert all(len(v.findall("ALLLEDGERENTRIES.LIST")) == 2 for e in found for v in e.iter("VOUCHER"))
    nothing = envelope_rows("T", None, (built.vouchers.limit(0), built.lines.limit(0)), chunk=5)
    assert nothing.count() == 0
    write_envelopes(nothing, str(tmp_path / "none"))


def test_vouchers_of_several_uploads_do_not_mix(spark):
    rows = [entry(n, ledger, "10", side) for n in "12" for ledger, side in (("Cash", "Dr"), ("Sales", "Cr"))]
    one = frame(spark, rows)
    both = one.withColumn("upload", F.lit("b")).unionByName(one.withColumn("upload", F.lit("a")))
    built = build_vouchers(both)
    found = []
    chunks = envelope_rows("T", None, (built.vouchers, built.lines), chunk=3).orderBy("chunk", *POSITION).collect()
    for number in (0, 1):
        root = ElementTree.fromstring("".join(r.xml for r in chunks if r.chunk == number))
        found.append([(v.findtext("VOUCHERNUMBER"), len(v.findall("ALLLEDGERENTRIES.LIST"))) for v in root.iter("VOUCHER")])
    assert found == [[("1", 2), ("2", 2), ("1", 2)], [("2", 2)]]
