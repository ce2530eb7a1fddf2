import pytest

from ledgerweave import errors as E
from ledgerweave.functions import similarity as sim
from ledgerweave.operators.groups import cyclic_groups, order_groups
from ledgerweave.operators.profile import profile
from ledgerweave.operators.validate import validate
from test_vouchers import entry, frame


def check(spark, entity, rows, **sets):
    result = validate(frame(spark, rows), entity, **sets)
    return result, sorted((e.source_row, e.code, e.source_column, e.severity) for e in result.errors.collect()
                          if e.source_row is not None)


def test_ledgers(spark):
    rows = [
        dict(name="Cust A", parent="Sundry Debtors", opening_balance="12,000.50"),
        dict(name=" ", parent="Sundry Debtors"), dict(name="Dup", parent="Sundry Debtors"),
        dict(name="Dup ", parent="Sundry Debtors", gstin="NOT-A-GSTIN"), dict(name="B", parent="Sundry Debtrs"),
        dict(name="x" * 101, parent="Sundry Debtors", opening_balance="abc", email="a@b", pincode="12"),
        dict(name="C", parent="Sundry Debtors", pan="nil", opening_balance_drcr="debit", credit_limit="(500)"),
    ]
    result, got = check(spark, "ledger", rows, known_groups=["Sundry Debtors", "Bank Accounts"])
    assert got == sorted([
        (2, E.REQUIRED_MISSING, "name", "error"), (3, E.DUPLICATE_IN_FILE, "name", "error"),
        (4, E.DUPLICATE_IN_FILE, "name", "error"), (4, E.BAD_GSTIN, "gstin", "warning"),
        (5, E.UNKNOWN_GROUP, "parent", "error"), (6, E.NAME_TOO_LONG, "name", "error"),
        (6, E.BAD_DECIMAL, "opening_balance", "warning"), (6, E.VALUE_NOT_ALLOWED, "email", "warning"),
        (6, E.VALUE_NOT_ALLOWED, "pincode", "warning"), (7, E.BAD_PAN, "pan", "warning"),
        (7, E.VALUE_NOT_ALLOWED, "opening_balance_drcr", "warning"), (7, E.BAD_DECIMAL, "credit_limit", "warning"),
    ])
    hint = [e.suggestion for e in result.errors.collect() if e.code == E.UNKNOWN_GROUP]
    assert hint == ["Did you mean 'Sundry Debtors'?"]
    stats = result.stats()
    assert (stats["error_count"], stats["warning_count"], stats["ok"]) == (5, 7, False) and not result.ok()


def test_value_set_as_table_gives_the_same(spark):
    rows = [dict(name="A", base_units="Nos", parent="Food"), dict(name="B", base_units="Noss", parent="Fod")]
    listed = check(spark, "stock_item", rows, known_units=["Nos", "Kg"], known_stock_groups=["Food"])[1]
    tables = {k: spark.createDataFrame([(v,) for v in vs], "value string")
              for k, vs in {"known_units": ["Nos", "Kg"], "known_stock_groups": ["Food"]}.items()}
    assert listed == check(spark, "stock_item", rows, **tables)[1] == [
        (2, E.UNKNOWN_UNIT, "base_units", "error"), (2, E.VALUE_NOT_ALLOWED, "parent", "warning"),
    ]


def test_units_and_missing_column(spark):
    result, got = check(spark, "unit", [dict(name="QA Nos"), dict(name="Kg", )])
    assert got == [(1, E.BAD_UNIT_NAME, "name", "error")]
    result = validate(frame(spark, [dict(name="A")]), "ledger")
    assert [(e.code, e.source_column) for e in result.errors.collect()] == [(E.MISSING_COLUMN, "parent")]


def test_group_cycle_and_order(spark):
    rows = [dict(name=n, parent=p) for n, p in [
        ("Trade", "Sundry"), ("Sundry", "Primary"), ("B", "A"), ("A", "Primary"), ("a1", "A"), ("Self", "Self"),
        ("Deep1", "Trade"), ("Deep2", "Deep1"), ("Deep3", "Deep2"), ("Deep4", "deep3 "),
    ]]
    df = frame(spark, rows)
    ordered = [r.name_key for r in order_groups(df).orderBy("depth", "path").collect()]
    assert ordered == ["a", "self", "sundry", "a1", "b", "trade", "deep1", "deep2", "deep3", "deep4"]
    assert cyclic_groups(df).count() == 0
    bad = frame(spark, rows + [dict(name="X", parent="Y"), dict(name="Y", parent="X"), dict(name="Z", parent="X")])
    assert sorted(r.name_key for r in cyclic_groups(bad).collect()) == ["x", "y", "z"]
    codes = [e.code for e in validate(bad, "group").errors.collect()]
    assert codes == [E.GROUP_CYCLE]


def test_voucher_entity(spark):
    rows = [entry("1", "A", "5", "Dr"), entry("1", "B", "4", "Cr")]
    result = validate(frame(spark, rows), "voucher")
    assert [e.code for e in result.errors.collect()] == [E.VOUCHER_UNBALANCED]
    assert result.extra["vouchers"].count() == 0


def test_profile(spark):
    rows = [
        dict(name="Cust A", amount="1000", flag="Yes", note="x", blank=""),
        dict(name="Cust B", amount="-250", flag="No", note="", blank=" "),
        dict(name="cust  b", amount="30.5", flag="Yes", note="y", blank=None),
    ]
    got = {r["column"]: r for r in profile(frame(spark, rows)).collect()}
    assert {k: v.inferred_type for k, v in got.items()} == {
        "name": "string", "amount": "numeric", "flag": "boolean", "note": "string", "blank": "empty",
    }
    assert (got["note"].n, got["note"].null_pct, got["blank"].null_pct) == (2, 0.3333, 1.0)
    assert (got["name"].n_distinct, got["name"].distinct_pct, got["name"].is_candidate_key) == (2, 0.6667, False)
    assert got["amount"].is_candidate_key and got["name"].samples == ["Cust A", "Cust B"]
    assert got["blank"].samples == [] and got["name"].row_count == 3 and got["name"].column_count == 5
    rough = {r["column"]: r for r in profile(frame(spark, rows), approx=True).collect()}
    assert {k: v.inferred_type for k, v in rough.items()} == {k: v.inferred_type for k, v in got.items()}


@pytest.mark.parametrize(
    ("fn", "a", "b", "expected"),
    [
        (sim.ratio, "abcd", "abce", 75.0), (sim.token_sort_ratio, "b a", "a b", 100.0),
        (sim.token_set_ratio, "gst no", "gst number", 2 * 5 / 16 * 100), (sim.token_set_ratio, "a b", "b a c", 100.0),
        (sim.token_set_ratio, "", "x", 0.0), (sim.partial_ratio, "abc", "xxabcxx", 100.0),
        (sim.weighted_ratio, "Sundry Debtrs", "Sundry Debtors", 2 * 13 / 27 * 100),
        (sim.weighted_ratio, "Debtors", "Sundry Debtors", 90.0),
    ],
)
def test_ratios(fn, a, b, expected):
    assert fn(a, b) == pytest.approx(expected) or fn is sim.token_set_ratio and fn(a, b) >= expected


def test_jaro_winkler_matches_published_values():
    got = sim.jaro_winkler(["MARTHA", "DWAYNE", "DIXON", "hdfc bnk", "", "a", "same"],
                           ["MARHTA", "DUANE", "DICKSONX", "hdfc bank", "", "b", "same"])
    assert got == pytest.approx([0.961111, 0.84, 0.813333, 0.977778, 1.0, 0.0, 1.0], abs=1e-6)
