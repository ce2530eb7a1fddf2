"""The registered queries against their SQL on the smallest dataset, and the shape of the registry."""

import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from __spark_entry__ import entry, oracle_sql, queries
from compare import TABLES, compare
from ledgerweave.functions.gst import STATE_BY_CODE, norm_state
from ledgerweave.functions.similarity import weighted_ratio

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
CHECKED = [
    "voucher_lines_gst", "b2c_daily", "journal_errors", "settlements", "cutover_opening_balances", "coerce_amounts",
    "coerce_dates", "profile_customer", "best_template", "upsert_templates", "validate_ledgers", "resolve_customers",
    "ordered_groups", "convert_ledgers", "emit_stock_item_xml", "parse_responses", "stage_records", "did_you_mean", "resolve_summary",
    "delimited_customers", "delimited_encodings", "validate_stock_items", "validate_units", "validate_suppliers", "emit_unit_xml", "emit_group_xml", "emit_renamed_xml",
    "emit_invoice_xml", "voucher_envelope", "unified_chunks", "unreadable_cells", "vouchers_beside_unreadable_cells", "responses_with_cdata", "profile_shares",
    "suggest_mapping", "overlay_template", "mapping_plan", "mapping_stats", "mapping_leftovers", "hsn_enrichment", "trial_balance",
]


def test_registry():
    assert set(oracle_sql()) <= set(queries())
    own = {name for name in queries() if not re.match(r"op\d+_|pipeline$", name)}
    assert own <= set(oracle_sql())


@needs_data
@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, name):
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    state, _, _, detail = compare(spark, connection, name, SF)
    assert state == "ok", detail


@needs_data
@pytest.mark.parametrize("name", ["voucher_lines_gst", "validate_ledgers", "emit_invoice_xml"])
def test_query_with_compiled_code(spark, name):
    """Most tests run interpreted; production compiles."""
    settings = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        test_query(spark, name)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@needs_data
def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "debit_total" in df.columns


@needs_data
def test_did_you_mean_against_brute_force(spark):
    parts = [r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name").collect()]
    known = sorted(set(parts))
    expected = {}
    for value in {p[:2] + p[3:] for p in parts} - set(known):
        best = max(weighted_ratio(value, k) for k in known)
        if best >= 80:
            expected[value] = min(k for k in known if weighted_ratio(value, k) == best)
    got = {r.value: r.suggestion for r in queries()["did_you_mean"](spark, SF).collect()}
    assert got == expected


@needs_data
@pytest.mark.parametrize("name", ["voucher_lines_gst", "b2c_daily", "b2c_daily_headers", "preview_100", "emit_voucher_xml", "emit_invoice_xml"])
def test_line_items_are_parsed_once(spark, name):
    """Headers and lines read stored rows: nothing of the plan goes back to the line items."""
    assert not [f for f in queries()[name](spark, SF).inputFiles() if "lineitem" in f]


@needs_data
def test_states_are_looked_up_once(spark):
    """A state in canonical form is not normalized again, and names come from a list rather than from title case."""
    plan = queries()["gst_components"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "initcap" not in plan.lower() and all(norm_states(spark)[s.lower()] == s for s in STATE_BY_CODE)


def norm_states(spark):
    cells = spark.createDataFrame([(s.lower(),) for s in STATE_BY_CODE], "t string")
    return {r.t: r.s for r in cells.select("t", norm_state("t").alias("s")).collect()}


@needs_data
@pytest.mark.parametrize("name", ["invoice_lines", "invoice_errors", "journal_lines", "journal_errors"])
def test_rows_are_parsed_once(spark, name):
    """Headers and lines, or headers and errors, read the parsed rows and not the input."""
    plan = queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan and "RLIKE" not in plan.upper().split("VOUCHER_KEY", 1)[0]
