from decimal import Decimal
from xml.etree import ElementTree

from ledgerweave.operators.emit import POSITION
from ledgerweave.plans.imports import import_masters, import_vouchers
from ledgerweave.streaming.uploads import build_vouchers_from
from test_vouchers import entry, frame, sale


def tree(rows):
    return ElementTree.fromstring("".join(r.xml for r in rows.orderBy("chunk", *POSITION).collect()))


def test_masters_with_resolution(spark):
    rows = frame(spark, [
        dict(name="hdfc bank", parent="Bank", opening_balance="5"), dict(name="HDFC Bnk", parent="Bank"),
        dict(name="New", parent="Bank", opening_balance="7"), dict(name="", parent="Bank"),
    ])
    existing = spark.createDataFrame([(1, "HDFC Bank", "Bank", "g1")], "ex_id long, name string, parent string, guid string")
    out = import_masters(rows, "ledger", "Co", existing)
    found = [(e.get("NAME"), e.get("ACTION"), e.findtext("GUID")) for e in tree(out.envelope).iter("LEDGER")]
    assert found == [("hdfc bank", "Alter", "g1"), ("New", "Create", None)]
    counts = out.counts.first()
    assert (counts.generated, counts.held, counts.skipped, counts.ok) == (2, 1, 1, True)


def test_vouchers_with_cutover_and_summary(spark):
    rows = [
        sale(order_id="0", date="2026-03-01", gst_rate=None), sale(order_id="1"), sale(order_id="2", amount="500"),
        sale(order_id="3", amount="5000", party_gstin="27ABCDE1234F1Z5"), entry("4", "A", "1", "Dr"),
    ]
    out = import_vouchers(frame(spark, rows), "Co", cutover="2026-04-01", b2c_summary=True)
    root = tree(out.envelope)
    assert [e.text for e in root.iter("REPORTNAME")] == ["All Masters", "Vouchers"]
    assert {(e.get("NAME"), e.findtext("PARENT"), e.findtext("OPENINGBALANCE")) for e in root.iter("LEDGER")} == {
        ("Sales", "Primary", "-1000.00"), ("Customer A", "Sundry Debtors", "1000.00"),
    }
    assert [v.findtext("VOUCHERNUMBER") for v in root.iter("VOUCHER")] == ["3", "B2C-2026-04-01"]
    totals = out.counts.first()
    assert totals.vouchers == 2 and totals.debit_total == totals.credit_total == Decimal("7670")
    assert [e.code for e in out.errors.collect()] == ["voucher_unbalanced"]


def test_settlement_import(spark):
    rows = [dict(order_id="S1", date="2026-04-05", amount="1000", commission="120", party_ledger="Amazon")]
    root = tree(import_vouchers(frame(spark, rows), "Co", settlement_mode=True).envelope)
    assert [e.findtext("LEDGERNAME") for e in root.iter("ALLLEDGERENTRIES.LIST")] == ["Amazon", "Bank", "Commission"]


def test_files_that_arrive(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    columns = ["voucher_number", "date", "voucher_type", "ledger_name", "amount", "dr_cr"]
    head = ",".join(columns) + "\n"

    def run():
        query = build_vouchers_from(spark, str(source), columns, str(tmp_path / "out"), str(tmp_path / "ck"), files_per_batch=1)
        query.awaitTermination(120)
        return sorted(r.reference for r in spark.read.parquet(str(tmp_path / "out/vouchers")).collect())

    (source / "a.csv").write_text(head + "1,2026-04-01,Journal,A,5,Dr\n1,2026-04-01,Journal,B,5,Cr\n2,2026-04-01,Journal,A,5,Dr\n")
    assert run() == ["1"]
    (source / "b.csv").write_text(head + "3,2026-04-01,Journal,A,5,Dr\n3,2026-04-01,Journal,B,5,Cr\n")
    assert run() == ["1", "3"]
    assert [r.code for r in spark.read.parquet(str(tmp_path / "out/errors")).collect()] == ["voucher_unbalanced"]


def test_batches_do_not_change_the_result(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    columns = ["voucher_number", "date", "voucher_type", "ledger_name", "amount", "dr_cr"]
    for i in range(4):  # every file has a voucher 1 of its own, and a line that cannot be read
        (source / f"f{i}.csv").write_text(",".join(columns) + f"\n1,2026-04-0{i + 1},Journal,A,{i + 5},Dr\n1,2026-04-0{i + 1},Journal,B,{i + 5},Cr\n9,2026-04-01,Journal,A,x{i},Dr\n")
    seen = []
    for n in (1, 10):
        build_vouchers_from(spark, str(source), columns, str(tmp_path / f"out{n}"), str(tmp_path / f"ck{n}"), files_per_batch=n).awaitTermination(120)
        read = lambda name: sorted(map(str, spark.read.parquet(str(tmp_path / f"out{n}/{name}")).drop("batch").collect()))  # noqa: B023, E731
        seen.append([read(name) for name in ("vouchers", "lines", "errors")])
    assert seen[0] == seen[1] and [len(x) for x in seen[0]] == [4, 8, 4]
    assert {r.source_row for r in spark.read.parquet(str(tmp_path / "out10/errors")).collect()} == {3}


def test_groups_that_cannot_be_ordered_are_reported(spark):
    rows = frame(spark, [
        dict(name="Alpha", parent="Primary"), dict(name="ALPHA", parent="Primary"), dict(name="Loop1", parent="Loop2"),
        dict(name="Loop2", parent="Loop1"), dict(name="Child", parent="loop1"), dict(name="Beta", parent="alpha"),
    ])
    out = import_masters(rows, "group", "Co", gate=False)
    assert [e.get("NAME") for e in tree(out.envelope).iter("GROUP")] == ["Alpha", "Beta"]
    assert sorted((r.source_row, r.code) for r in out.errors.collect()) == [(2, "duplicate_in_file"), (3, "group_cycle"), (4, "group_cycle"), (5, "group_cycle")]
    gated = import_masters(rows, "group", "Co")  # a cycle is an error of the whole table
    assert not list(tree_or_none(gated.envelope)) and gated.counts.first().skipped == 6


def tree_or_none(rows):
    return rows.collect()


def test_gate_holds_back_bad_rows(spark):
    rows = frame(spark, [dict(name="A", parent="Bank"), dict(name="B", parent="Bnk"), dict(name="A", parent="Bank"), dict(name="C", parent="Bank")])
    out = import_masters(rows, "ledger", "Co", known_groups=["Bank"])
    assert [e.get("NAME") for e in tree(out.envelope).iter("LEDGER")] == ["C"]
    assert sorted((r.source_row, r.code) for r in out.errors.collect()) == [(1, "duplicate_in_file"), (2, "unknown_group"), (3, "duplicate_in_file")]
    assert out.counts.first().skipped == 3


def test_units_without_a_parent_column(spark):
    rows = frame(spark, [dict(name="Nos", decimal_places="2"), dict(name="Kg", decimal_places="99999999999")])
    existing = spark.createDataFrame([(1, "nos", None, "g1")], "ex_id long, name string, parent string, guid string")
    out = import_masters(rows, "unit", "Co", existing)
    assert [(e.get("NAME"), e.get("ACTION"), e.findtext("DECIMALPLACES")) for e in tree(out.envelope).iter("UNIT")] == [("Nos", "Alter", "2"), ("Kg", "Create", "0")]
    assert [(r.source_row, r.code) for r in out.errors.collect()] == [(2, "bad_decimal")]


def test_oversized_and_unprintable_cells_are_error_rows(spark):
    good = dict(date="2026-04-01", voucher_type="Sales", dr_cr="Cr", ledger_name="Sales")
    rows = [
        {**good, "order_id": "1", "amount": "10", "party_ledger": "P", "gst_rate": "18", "shipping_state": "MH", "home_state": "MH"},
        {**good, "order_id": "2", "amount": "10", "stock_item": "X", "quantity": "9999999999999", "rate": "1", "unit": "Nos"},
        {**good, "order_id": "3", "amount": "99999999999999", "party_ledger": "P", "gst_rate": "99999", "shipping_state": "MH", "home_state": "KA"},
        {**good, "order_id": "4", "amount": "10", "party_ledger": "P\x0bQ", "gst_rate": "18", "shipping_state": "MH", "home_state": "MH"},
    ]
    out = import_vouchers(frame(spark, rows), "Co")
    assert [v.findtext("VOUCHERNUMBER") for v in tree(out.envelope).iter("VOUCHER")] == ["1"]
    assert sorted((r.source_row, r.code, r.source_column) for r in out.errors.collect() if r.severity == "error") == [
        (2, "bad_decimal", "quantity"), (3, "bad_decimal", "gst_rate"), (4, "value_not_allowed", None)]
    ledgers = frame(spark, [dict(name="A", parent="Bank", credit_limit="1" + "0" * 25), dict(name="B\x00", parent="Bank")])
    made = import_masters(ledgers, "ledger", "Co")
    assert [e.findtext("CREDITLIMIT") for e in tree(made.envelope).iter("LEDGER")] == ["1" + "0" * 25 + ".00"]
    assert [(r.source_row, r.code) for r in made.errors.collect()] == [(2, "value_not_allowed")]


def test_long_chains_hot_parents_and_cycles(spark):
    from pyspark.sql import functions as F

    from ledgerweave.operators.groups import cyclic_groups, group_depths

    n = 20_000
    chain = spark.range(n).select(F.col("id").alias("source_row"), F.concat(F.lit("c"), "id").alias("name"), F.when(F.col("id") == 0, F.lit("Primary")).otherwise(F.concat(F.lit("c"), F.col("id") - 1)).alias("parent"))
    hot = spark.range(n).select((F.col("id") + n).alias("source_row"), F.concat(F.lit("h"), "id").alias("name"), F.lit("c0").alias("parent"))
    loop = spark.createDataFrame([(10 * n, "l1", "l2"), (10 * n + 1, "l2", "l1"), (10 * n + 2, "below", "l1")], "source_row long, name string, parent string")
    rows = chain.union(hot).union(loop)
    depths = group_depths(rows).agg(F.count("*"), F.max("depth"), F.sum("depth")).first()
    assert tuple(depths) == (2 * n, n - 1, n * (n - 1) // 2 + n)
    assert sorted(r.name_key for r in cyclic_groups(rows).collect()) == ["below", "l1", "l2"]


def test_an_import_reads_its_input_once(spark, tmp_path):
    rows = frame(spark, [sale(order_id=str(i), date="2026-04-01") for i in range(4)] + [sale(order_id="9", date="2026-03-01", gst_rate=None)])
    path = str(tmp_path / "rows")
    rows.write.parquet(path)
    out = import_vouchers(spark.read.parquet(path), "Co", cutover="2026-04-01", b2c_summary=True)
    for df in (out.envelope, out.errors, out.counts):
        assert path not in df._jdf.queryExecution().optimizedPlan().toString() and "/rows" not in str(df.inputFiles())
