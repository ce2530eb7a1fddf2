"""Queries on the given tables. Money leaves as double and dates as text, so results compare across engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave import errors as E
from ledgerweave import functions as fn
from ledgerweave.functions.gst import same_state
from ledgerweave.operators import emit, mapping, masters, resolve, rollups, templates, vouchers
from ledgerweave.operators.groups import cyclic_groups, order_groups
from ledgerweave.operators.profile import profile
from ledgerweave.operators.suggest import suggestions
from ledgerweave.operators.validate import validate
from ledgerweave.plans import shapes
from ledgerweave.sources import responses, staging

S = SparkSession


def _money(c: str | Column, name: str | None = None) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return column.cast("double").alias(name or c)


def _day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def _lines(df: DataFrame) -> DataFrame:
    return df.select("voucher_key", "section", "source_row", "seq", "ledger_name", "is_debit", _money("amount"), _day("date"))


def _headers(df: DataFrame) -> DataFrame:
    return df.select(
        "voucher_key", "first_row", "reference", "voucher_type", _day("date"), "narration", "party_ledger", "party_gstin",
        "n_lines", _money("debit_total"), _money("credit_total"),
    )


def _errors(df: DataFrame) -> DataFrame:
    return df.select("source_row", "code", "severity", "source_column")


# --- vouchers -----------------------------------------------------------------------------------
def _sales(spark: S, d: str, store: bool = False) -> vouchers.VoucherResult:
    """With `store`, the line items are joined and parsed once for headers and lines."""
    return vouchers.build_vouchers(shapes.sale_lines(spark, d), store=store, store_issues=False)


def voucher_lines_gst(spark: S, d: str) -> DataFrame:
    return _lines(_sales(spark, d, store=True).lines)


def voucher_headers(spark: S, d: str) -> DataFrame:
    return _headers(_sales(spark, d).vouchers)


def refunds_credit_notes(spark: S, d: str) -> DataFrame:
    return _headers(_sales(spark, d).vouchers.filter(F.col("voucher_type") == vouchers.CREDIT_NOTE))


def b2c_daily(spark: S, d: str) -> DataFrame:
    built = _sales(spark, d, store=True)
    _, lines = rollups.b2c_daily(built.vouchers, built.lines)
    summary = lines.filter(F.col("voucher_key").startswith("b2c-"))
    return summary.select("voucher_key", _day("date"), "ledger_name", "is_debit", _money("amount"))


def b2c_daily_headers(spark: S, d: str) -> DataFrame:
    built = _sales(spark, d, store=True)
    heads, _ = rollups.b2c_daily(built.vouchers, built.lines)
    return heads.select("voucher_key", "reference", "voucher_type", _day("date"), "party_ledger", "n_lines", _money("debit_total"))


def control_totals(spark: S, d: str) -> DataFrame:
    totals = rollups.control_totals(_sales(spark, d).vouchers)
    return totals.select("vouchers", F.col("voucher_lines").cast("long").alias("voucher_lines"), _money("debit_total"), _money("credit_total"))


def preview_100(spark: S, d: str) -> DataFrame:
    built = _sales(spark, d, store=True)
    shown = rollups.preview(built.vouchers, built.lines, 100)
    return shown.select("reference", _day("date"), "voucher_type", "party_ledger", _money("debit_total"), _money("credit_total"),
                        "section", "source_row", "seq", "ledger_name", "dr_cr", _money("amount"))


def journal_vouchers(spark: S, d: str) -> DataFrame:
    return _headers(vouchers.build_vouchers(shapes.journal_rows(spark, d)).vouchers)


def journal_lines(spark: S, d: str) -> DataFrame:
    return _lines(vouchers.build_vouchers(shapes.journal_rows(spark, d), store=True, store_issues=False).lines)


def journal_errors(spark: S, d: str) -> DataFrame:
    return _errors(vouchers.build_vouchers(shapes.journal_rows(spark, d), store=True, store_lines=False).errors)


def journal_error_summary(spark: S, d: str) -> DataFrame:
    checked = validate(shapes.journal_rows(spark, d), "voucher")
    return E.error_summary(checked.errors).select("code", "severity", "n")


def invoice_lines(spark: S, d: str) -> DataFrame:
    lines = vouchers.build_vouchers(shapes.invoice_rows(spark, d), store=True, store_issues=False).lines
    return lines.select("voucher_key", "source_row", "ledger_name", "is_debit", _money("amount"), "stock_item",
                        _money("quantity"), _money("rate"), "unit", _day("date"))


def invoice_errors(spark: S, d: str) -> DataFrame:
    return _errors(vouchers.build_vouchers(shapes.invoice_rows(spark, d), store=True, store_lines=False).errors)


def settlements(spark: S, d: str) -> DataFrame:
    return _lines(rollups.settlements(shapes.settlement_rows(spark, d)).lines)


def settlement_errors(spark: S, d: str) -> DataFrame:
    return _errors(rollups.settlements(shapes.settlement_rows(spark, d)).errors)


def cutover_opening_balances(spark: S, d: str) -> DataFrame:
    balances, _ = rollups.opening_balances(shapes.cutover_rows(spark, d), shapes.CUTOVER)
    return balances.select("name", "parent", _money("opening_balance"), "opening_is_debit")


def cutover_split(spark: S, d: str) -> DataFrame:
    before, after = rollups.split_cutover(shapes.cutover_rows(spark, d), shapes.CUTOVER)
    both = before.select(F.lit("before").alias("part"), "amount").unionByName(after.select(F.lit("after").alias("part"), "amount"))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum(fn.to_decimal("amount")).cast("double").alias("amount"))


# --- scalar functions ---------------------------------------------------------------------------
def coerce_amounts(spark: S, d: str) -> DataFrame:
    key, value = F.col("c_custkey"), shapes.money("c_acctbal")
    size = F.abs(value).cast("string")
    text = (
        F.when(key % 9 == 0, F.format_number(F.abs(value), 2)).when(key % 9 == 1, F.concat(F.lit("("), size, F.lit(")")))
        .when(key % 9 == 2, F.concat(size, F.lit(" Cr"))).when(key % 9 == 3, F.concat(F.lit("Rs. "), size))
        .when(key % 9 == 4, F.concat(F.lit(" ₹ "), size, F.lit(" "))).when(key % 9 == 5, F.concat(size, F.lit("-")))
        .when(key % 9 == 6, F.concat(size, F.lit("x"))).when(key % 9 == 7, F.lit("nil")).otherwise(F.concat(size, F.lit("e0")))
    )
    rows = shapes.table(spark, d, "customer").select("c_custkey", text.alias("text"))
    return rows.select(
        "c_custkey", _money(fn.to_decimal("text"), "amount"), fn.is_bad_decimal("text").alias("bad"),
        F.coalesce(fn.to_amount_side("text")["is_debit"], F.lit(False)).alias("is_debit"),
    )


def coerce_dates(spark: S, d: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.lit(None).cast("string")
    formats = ("yyyy-MM-dd", "dd/MM/yyyy", "d-M-yy", "d MMM yyyy", "MMMM d, yyyy", "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "dd.MM.yyyy")
    for i, form in enumerate(formats):
        text = F.when(key % 10 == i, F.date_format(day, form)).otherwise(text)
    text = F.when(key % 10 == 8, F.lit("31/02/1999")).otherwise(text)
    rows = shapes.table(spark, d, "orders").select("o_orderkey", text.alias("text"))
    parsed = fn.to_date_dayfirst("text")
    return rows.select("o_orderkey", F.date_format(parsed, "yyyy-MM-dd").alias("day"), fn.is_bad_date("text", parsed).alias("bad"))


def gst_components(spark: S, d: str) -> DataFrame:
    """Tax by place of supply from state spellings and GSTINs, over all line items."""
    lines = shapes.spread(shapes.numbered(spark, d, "lineitem")).select("source_row", "l_suppkey", "l_partkey", "l_extendedprice", "l_tax")
    code = F.lpad((F.col("l_suppkey") % 38 + 1).cast("string"), 2, "0")
    lines = lines.withColumns({
        "buyer": F.when(F.col("l_partkey") % 2 == 0, fn.state_of_gstin(F.concat(code, F.lit("ABCDE1234F1Z5")))).otherwise(code),
        "home": F.when(F.col("l_partkey") % 3 == 0, F.lit("MH")).otherwise(F.lit("  maharashtra ")),
    }).withColumns({"buyer": fn.norm_state("buyer"), "home": fn.norm_state("home")})
    split = fn.gst_split(shapes.money("l_extendedprice"), F.col("l_tax").cast("decimal(6,2)") * 100, same_state(F.col("buyer"), F.col("home")))
    return lines.withColumn("g", split).groupBy("buyer", "home", F.col("g.intra").alias("intra")).agg(
        F.count("*").alias("n"), F.sum("g.taxable").cast("double").alias("taxable"), F.sum("g.cgst").cast("double").alias("cgst"),
        F.sum("g.sgst").cast("double").alias("sgst"), F.sum("g.igst").cast("double").alias("igst"),
        F.sum(F.size(fn.gst_legs(F.col("g")))).alias("legs"),
    )


# --- profile and mapping ------------------------------------------------------------------------
def _profile(df: DataFrame, samples: bool = True) -> DataFrame:
    return profile(df, samples=samples).select("column", "row_count", "column_count", "n", "n_distinct", "inferred_type", "null_pct", "distinct_pct",
                                               "is_candidate_key", *["samples"] * samples)


def _customer_upload(spark: S, d: str) -> DataFrame:
    return shapes.numbered(spark, d, "customer").select(
        "source_row", F.col("c_name").alias("Ledger Name"), F.col("c_mktsegment").alias("Under"),
        shapes.money("c_acctbal").cast("string").alias("Opening Bal"),
        F.when(F.col("c_custkey") % 4 != 0, F.lit("Yes")).alias("Billwise"), F.col("c_nationkey").cast("string").alias("Random Notes"),
    )


def profile_customer(spark: S, d: str) -> DataFrame:
    return _profile(_customer_upload(spark, d)).withColumn("samples", F.array_join("samples", "|"))


def profile_documents(spark: S, d: str) -> DataFrame:
    docs = shapes.numbered(spark, d, "documents").select("source_row", *[F.col(c).cast("string").alias(c) for c in ("doc_id", "text", "lang", "source", "n_chars")])
    return _profile(docs, samples=False)


def suggest_mapping(spark: S, d: str) -> DataFrame:
    found = mapping.suggest_mapping(profile(_customer_upload(spark, d)), "ledger")
    return found.select("target_field", "required", "source_column", "confidence", "status", "method",
                        F.array_join(F.transform("alternatives", lambda x: x["column"]), "|").alias("alternatives"))


def apply_mapping(spark: S, d: str) -> DataFrame:
    return mapping.apply_mapping(
        _customer_upload(spark, d), "ledger",
        {"name": "Ledger Name", "parent": "Under", "opening_balance": "Opening Bal", "mailing_name": "Ledger Name", "pan": None},
        {"country": "India", "opening_balance_drcr": "Dr"},
    )


def _template_uploads(spark: S, d: str) -> DataFrame:
    key = F.col("c_custkey")
    columns = F.array_compact(F.array(
        F.lit("Name"), F.when(key % 2 == 0, F.lit("Group")), F.when(key % 3 == 0, F.lit("Opening")), F.when(key % 5 == 0, F.lit("State"))))
    return shapes.table(spark, d, "customer").select(
        key.cast("string").alias("upload"), F.col("c_nationkey").cast("string").alias("org_id"), F.lit("ledger").alias("entity"), columns.alias("columns"))


def _saved_templates(spark: S, d: str) -> DataFrame:
    key = F.col("n_nationkey")
    variants = F.array(
        F.struct(F.lit("b full").alias("name"), F.array(*map(F.lit, ("Name", "Group", "Opening"))).alias("cols")),
        F.struct(F.lit("a pair").alias("name"), F.array(*map(F.lit, ("Name", "Group"))).alias("cols")),
        F.struct(F.lit("c wide").alias("name"), F.array(*map(F.lit, ("Name", "State", "Opening", "Group", "Pan"))).alias("cols")),
        F.struct(F.lit("single").alias("name"), F.array(F.lit("Name")).alias("cols")),
    )
    return shapes.table(spark, d, "nation").withColumn("v", F.explode(variants)).select(
        F.concat_ws("-", key, "v.name").alias("template_id"), key.cast("string").alias("org_id"), F.lit("ledger").alias("entity"),
        F.col("v.name").alias("name"), F.create_map(F.lit("name"), F.lit("Name"), F.lit("parent"), F.lit("Group")).alias("mapping"),
        F.create_map(F.lit("country"), F.lit("India")).alias("constants"), F.col("v.cols").alias("source_columns"))


def best_template(spark: S, d: str) -> DataFrame:
    best = templates.best_template(_template_uploads(spark, d), _saved_templates(spark, d))
    return best.select("upload", "name", F.round("score", 4).alias("score"))


def overlay_template(spark: S, d: str) -> DataFrame:
    """The proposal for the customer file after a saved template is laid over it."""
    profiles = profile(_customer_upload(spark, d)).withColumn("upload", F.lit(""))
    saved = _saved_templates(spark, d).filter(F.col("org_id") == "0").select(
        "template_id", "org_id", "entity", "name",
        F.create_map(F.lit("mailing_name"), F.lit("Ledger Name"), F.lit("state"), F.lit("Random Notes"), F.lit("pan"), F.lit("Gone")).alias("mapping"),
        "constants", F.array(F.lit("Ledger Name"), F.lit("Random Notes")).alias("source_columns"))
    upload = profiles.groupBy("upload").agg(F.collect_set("column").alias("columns")).select(
        "upload", F.lit("0").alias("org_id"), F.lit("ledger").alias("entity"), "columns")
    best = templates.best_template(upload, saved)
    merged = mapping.overlay_template(mapping.suggest_mapping(profiles, "ledger"), best, profiles)
    return merged.select("target_field", "source_column", "confidence", "status", "method", "shared")


def upsert_templates(spark: S, d: str) -> DataFrame:
    """A template per customer; every third is saved again with an empty source among its entries."""
    customers = shapes.table(spark, d, "customer")
    key = F.col("c_custkey")
    old = customers.select(
        key.cast("string").alias("template_id"), F.col("c_nationkey").cast("string").alias("org_id"), F.lit("ledger").alias("entity"),
        F.col("c_name").alias("name"), F.create_map(F.lit("name"), F.lit("Old")).alias("mapping"),
        F.create_map(F.lit("country"), F.lit("India")).alias("constants"), F.array(F.lit("Old")).alias("source_columns"))
    new = customers.filter(key % 3 == 0).select(
        F.concat(F.lit("n"), key.cast("string")).alias("template_id"), F.col("c_nationkey").cast("string").alias("org_id"), F.lit("ledger").alias("entity"),
        F.concat(F.col("c_name"), F.when(key % 2 == 0, F.lit(" new")).otherwise(F.lit(" "))).alias("name"),
        F.create_map(F.lit("name"), F.col("c_mktsegment"), F.lit("pan"), F.lit("")).alias("mapping"),
        F.create_map(F.lit("country"), F.lit(" ")).alias("constants"), F.array(F.col("c_mktsegment"), F.lit("x")).alias("source_columns"))
    after = templates.delete_templates(templates.upsert_templates(old, new), "1", "1")
    return after.select("template_id", "org_id", "name", F.try_element_at("mapping", F.lit("name")).alias("mapped_name"),
                        F.size("mapping").alias("n_mapping"), F.size("constants").alias("n_constants"), F.array_join("source_columns", "|").alias("source_columns"))


# --- validation, resolution, masters ------------------------------------------------------------
def _checked(spark: S, d: str):
    groups = shapes.table(spark, d, "customer").select("c_mktsegment").distinct()
    return validate(shapes.ledger_rows(spark, d), "ledger", known_groups=groups)


def validate_ledgers(spark: S, d: str) -> DataFrame:
    return _checked(spark, d).errors.select("source_row", "code", "severity", "source_column", F.coalesce("suggestion", F.lit("")).alias("suggestion"))


def error_summary(spark: S, d: str) -> DataFrame:
    return E.error_summary(_checked(spark, d).errors).select("code", "severity", "n", F.coalesce("suggestion", F.lit("")).alias("suggestion"))


def error_counts(spark: S, d: str) -> DataFrame:
    return E.error_counts(_checked(spark, d).errors)


def did_you_mean(spark: S, d: str) -> DataFrame:
    """Part names with a letter lost against the known part names."""
    parts = shapes.table(spark, d, "part")
    known = parts.select(F.col("p_name").alias("value")).distinct()
    unknown = parts.select(F.concat(F.substring("p_name", 1, 2), F.substr("p_name", F.lit(4))).alias("value"))
    return suggestions(unknown, known).select("value", "suggestion", F.round("score", 4).alias("score"))


def resolve_customers(spark: S, d: str) -> DataFrame:
    marks = resolve.resolve(shapes.incoming_masters(spark, d), shapes.existing_masters(spark, d), kinds=("prefix",))
    return marks.select("source_row", "decision", "action", "matched_name", "matched_guid", "score",
                        F.array_join(F.transform(F.coalesce("candidates", F.array().cast("array<struct<name:string,parent:string,guid:string,score:double>>")), lambda x: x["guid"]), "|").alias("candidates"))


def resolve_summary(spark: S, d: str) -> DataFrame:
    marks = resolve.resolve(shapes.incoming_masters(spark, d), shapes.existing_masters(spark, d))
    return resolve.resolve_summary(marks)


def apply_verdicts(spark: S, d: str) -> DataFrame:
    incoming = shapes.incoming_masters(spark, d)
    marks = resolve.resolve(incoming, shapes.existing_masters(spark, d), kinds=("prefix",))
    kept, held = resolve.apply_verdicts(incoming, marks)
    return kept.select("source_row", F.lit(False).alias("held"), "_action", "guid", "old_name").unionByName(
        held.select("source_row", F.lit(True).alias("held"), F.lit(None).cast("string").alias("_action"),
                    F.lit(None).cast("string").alias("guid"), F.lit(None).cast("string").alias("old_name")))


def ordered_groups(spark: S, d: str) -> DataFrame:
    return order_groups(shapes.group_rows(spark, d)).select("name_key", "depth", F.array_join("path", ">").alias("path"))


def group_cycles(spark: S, d: str) -> DataFrame:
    return cyclic_groups(shapes.chained_groups(spark, d)).select("source_row", "name_key")


def convert_ledgers(spark: S, d: str) -> DataFrame:
    return masters.to_ledgers(shapes.ledger_rows(spark, d)).data.select(
        "source_row", "name", "action", "parent", _money("opening_balance"), "opening_is_debit", "gstin", "pincode", "country",
        F.coalesce("is_billwise", F.lit(False)).alias("is_billwise"), _money("credit_limit"))


def convert_ledger_errors(spark: S, d: str) -> DataFrame:
    return _errors(masters.to_ledgers(shapes.ledger_rows(spark, d)).errors)


def conversion_counts(spark: S, d: str) -> DataFrame:
    rows = shapes.ledger_rows(spark, d)
    return masters.conversion_counts(rows, rows.filter(F.lit(False)), masters.to_ledgers(rows))


def _part_items(spark: S, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return shapes.table(spark, d, "part").select(
        (key + 1).alias("source_row"), F.concat_ws(" ", "p_name", key).alias("name"),
        F.when(key % 25 == 3, F.lit("-")).otherwise(F.lit("Nos")).alias("base_units"), F.when(key % 4 != 0, F.col("p_brand")).alias("parent"),
        (key % 90000000 + 1000).cast("string").alias("hsn"), F.col("p_size").cast("string").alias("opening_qty"),
        shapes.money("p_retailprice").cast("string").alias("opening_rate"),
        F.when(key % 30 == 1, F.lit("1.2.3")).otherwise((F.col("p_size") * shapes.money("p_retailprice")).cast("string")).alias("opening_value"),
        F.when(key % 2 == 0, F.lit("Yes")).otherwise(F.lit("No")).alias("gst_applicable"))


def convert_stock_items(spark: S, d: str) -> DataFrame:
    return masters.to_stock_items(_part_items(spark, d)).data.select(
        "source_row", "name", "parent", "base_units", "hsn_code", _money("opening_qty"), _money("opening_rate"), _money("opening_value"), "gst_applicable")


def convert_units(spark: S, d: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = shapes.table(spark, d, "part").select(
        (key + 1).alias("source_row"), F.concat(F.lit("U"), key.cast("string")).alias("name"), (key % 4).cast("string").alias("decimal_places"),
        F.when(key % 3 == 0, F.lit("Pcs")).alias("base_units"), F.when(key % 3 == 0, F.lit("Box")).alias("additional_units"),
        F.when(key % 3 == 0, F.col("p_size").cast("string")).alias("conversion"))
    return masters.to_units(rows).data.select("source_row", "name", "is_simple", "decimal_places", "base_units", "additional_units", _money("conversion"))


def convert_groups(spark: S, d: str) -> DataFrame:
    rows = shapes.group_rows(spark, d).withColumns({
        "is_revenue": F.when(F.col("source_row") % 2 == 0, F.lit("Y")).otherwise(F.lit("off")), "parent": F.nullif("parent", F.lit("Primary"))})
    return masters.to_groups(rows).data.select("source_row", "name", "parent", "is_revenue")


# --- XML, responses, staging --------------------------------------------------------------------
def emit_ledger_xml(spark: S, d: str) -> DataFrame:
    rows = emit.master_fragments(masters.to_ledgers(shapes.ledger_rows(spark, d)).data, "ledger")
    return rows.select("row", "xml")


def emit_stock_item_xml(spark: S, d: str) -> DataFrame:
    return emit.master_fragments(masters.to_stock_items(_part_items(spark, d)).data, "stock_item").select("row", "xml")


def emit_voucher_xml(spark: S, d: str) -> DataFrame:
    built = _sales(spark, d, store=True)
    rows = emit.voucher_fragments(built.vouchers, built.lines)
    return rows.select("voucher_key", "part", "row", "seq", "xml")


def parse_responses(spark: S, d: str) -> DataFrame:
    parsed = responses.parse_responses(shapes.response_rows(spark, d))
    return parsed.select("job_id", F.coalesce("rejected", F.lit("")).alias("rejected"), "created", "altered", "errors", "last_master_id",
                         F.array_join("line_errors", "|").alias("line_errors"))


def import_outcome(spark: S, d: str) -> DataFrame:
    done = responses.import_outcome(responses.parse_responses(shapes.response_rows(spark, d)))
    return done.groupBy("status").agg(F.count("*").alias("n"), F.count_if("is_success").alias("n_success"))


def pending_artifacts(spark: S, d: str) -> DataFrame:
    rows = shapes.response_rows(spark, d)
    key = F.col("job_id")
    artifacts = rows.withColumn("xml_sha256", F.when(key % 3 == 0, F.sha2("xml", 256)).when(key % 3 == 1, F.lit("0")))
    return responses.pending_artifacts(artifacts, rows.filter(key % 7 == 0).select("job_id")).select("job_id", "intact")


def stage_records(spark: S, d: str) -> DataFrame:
    return _stage_events(spark, d).select("org_id", "job_id", "order_id", "data", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


def _stage_events(spark: S, d: str) -> DataFrame:
    rows = shapes.table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("order_id"), "event_type", "props",
        F.col("user_id").cast("string").alias("user_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    org = F.concat(F.lit("org"), (F.col("user_id").cast("long") % 3).cast("string"))
    return staging.stage_records(rows, org, F.col("event_type"), F.to_timestamp("ts"))


def tenant_scan(spark: S, d: str) -> DataFrame:
    return staging.for_org(_stage_events(spark, d), "org1").groupBy("org_id", "job_id").agg(F.count("*").alias("n"))


def expire_staged(spark: S, d: str) -> DataFrame:
    kept, deleted = staging.expire_staged(_stage_events(spark, d), "2024-02-10 00:00:00")
    return kept.agg(F.count("*").alias("kept")).join(F.broadcast(deleted), F.lit(True)).select("kept", "deleted")


_NAMES = (
    "voucher_lines_gst", "voucher_headers", "refunds_credit_notes", "b2c_daily", "b2c_daily_headers", "control_totals",
    "preview_100", "journal_vouchers", "journal_lines", "journal_errors", "journal_error_summary", "invoice_lines",
    "invoice_errors", "settlements", "settlement_errors", "cutover_opening_balances", "cutover_split", "coerce_amounts",
    "coerce_dates", "gst_components", "profile_customer", "profile_documents", "suggest_mapping", "apply_mapping",
    "best_template", "overlay_template", "upsert_templates", "validate_ledgers", "error_summary", "error_counts",
    "did_you_mean", "resolve_customers", "resolve_summary", "apply_verdicts", "ordered_groups", "group_cycles",
    "convert_ledgers", "convert_ledger_errors", "conversion_counts", "convert_stock_items", "convert_units",
    "convert_groups", "emit_ledger_xml", "emit_stock_item_xml", "emit_voucher_xml", "parse_responses", "import_outcome",
    "pending_artifacts", "stage_records", "tenant_scan", "expire_staged",
)
QUERIES = {name: globals()[name] for name in _NAMES}
