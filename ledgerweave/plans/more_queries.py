"""Further queries on the given tables: files, validation of all masters, remaining XML, envelopes, and cells that cannot be read."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.operators import emit, hsn, mapping, masters, reconcile, vouchers
from ledgerweave.operators.emit import POSITION
from ledgerweave.operators.profile import profile
from ledgerweave.operators.validate import validate
from ledgerweave.plans import shapes
from ledgerweave.plans.imports import import_vouchers
from ledgerweave.sources import responses
from ledgerweave.sources.delimited import read_delimited
from ledgerweave.sources.envelopes import envelope_rows
from ledgerweave.sources.shared_folder import ensure_checkpoint_dir

S = SparkSession


def _found(df: DataFrame) -> DataFrame:
    return df.select("source_row", "code", "severity", "source_column")


def delimited_customers(spark: S, d: str) -> DataFrame:
    """Customers as delimited files with three delimiters and header orders, written and read back in one call."""
    folder = posixpath.join(ensure_checkpoint_dir(spark), f"files-{uuid.uuid4().hex}")
    rows = shapes.table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("Key"), F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("Under"),
        F.concat(F.lit('say "'), "c_name", F.lit('", or; not')).alias("Note"), (F.col("c_custkey") % 3).alias("part"))
    variants = ((",", ["Key", "Name", "Under"]), (";", ["Under", "Note", "Key"]), ("\t", ["Name", "Key", "Note", "Under"]))
    for k, (separator, columns) in enumerate(variants):
        rows.filter(F.col("part") == k).select(*columns).write.options(header="true", sep=separator, quote='"', escape='"').csv(posixpath.join(folder, str(k)))
    read = read_delimited(spark, [posixpath.join(folder, str(k), "*.csv") for k in range(len(variants))])
    return read.data.select("Key", "Name", "Under", "Note")


def delimited_encodings(spark: S, d: str) -> DataFrame:
    """Customers in files of three encodings, two of them with a byte order mark, and with line breaks and quotes in a cell."""
    folder = posixpath.join(ensure_checkpoint_dir(spark), f"files-{uuid.uuid4().hex}")
    note = F.concat(F.lit("Café\n"), "c_name", F.lit('\n"'), "c_mktsegment", F.lit('", or; not'))
    for k, (encoding, mark) in enumerate((("UTF-16LE", "\ufeff"), ("UTF-8", "\ufeff"), ("ISO-8859-1", ""))):
        rows = shapes.table(spark, d, "customer").filter(F.col("c_custkey") % 3 == k).select(
            F.col("c_custkey").cast("string").alias(mark + "Key"), F.col("c_name").alias("Name"), note.alias("Note"))
        rows.write.options(header="true", encoding=encoding, quote='"', escape='"').csv(posixpath.join(folder, str(k)))
    return read_delimited(spark, [posixpath.join(folder, str(k), "*.csv") for k in range(3)]).data.select("Key", "Name", "Note")


def validate_stock_items(spark: S, d: str) -> DataFrame:
    key, parts = F.col("p_partkey"), shapes.table(spark, d, "part")
    rows = parts.select(
        (key + 1).alias("source_row"),
        F.when(key % 40 == 7, F.lpad(key.cast("string"), 120, "n")).when(key % 41 == 8, F.lit("Twice")).when(key % 43 == 9, F.lit(" "))
        .otherwise(F.concat(F.lit("Item "), key.cast("string"))).alias("name"),
        F.when(key % 25 == 3, F.lit("Furlong")).when(key % 47 != 10, F.lit("Nos")).alias("base_units"), F.col("p_brand").alias("parent"),
        F.when(key % 17 == 4, F.lit("12AB")).otherwise((key % 9000 + 1000).cast("string")).alias("hsn"),
        F.when(key % 19 == 5, F.lit("a few")).otherwise(F.lit("1,200")).alias("opening_qty"))
    brands = parts.filter(key % 2 == 0).select("p_brand").distinct()
    return _found(validate(rows, "stock_item", known_units=["Nos", "Kg"], known_stock_groups=brands).errors)


def validate_units(spark: S, d: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = shapes.table(spark, d, "part").select(
        (key + 1).alias("source_row"), F.when(key % 6 == 0, F.concat(F.lit("U "), key.cast("string"))).otherwise(F.concat(F.lit("U"), key.cast("string"))).alias("name"),
        F.when(key % 9 == 1, F.lit("two")).otherwise(F.lit("2")).alias("decimal_places"))
    return _found(validate(rows, "unit").errors)


def validate_suppliers(spark: S, d: str) -> DataFrame:
    """Suppliers as ledgers without the parent column."""
    key = F.col("s_suppkey")
    rows = shapes.table(spark, d, "supplier").select(
        (key + 1).alias("source_row"), F.concat(F.lit("Supplier "), key.cast("string")).alias("name"),
        F.when(key % 5 == 0, F.lit("ABCDE12345")).otherwise(F.lit("ABCDE1234F")).alias("pan"),
        F.when(key % 7 == 1, F.lit("mail at home")).otherwise(F.lit("a@b.in")).alias("email"),
        F.when(key % 11 == 2, F.lit("Atlantis")).otherwise(F.lit("Goa")).alias("state"),
        F.when(key % 13 == 3, F.lit("X")).otherwise(F.lit("Dr")).alias("opening_balance_drcr"))
    return _found(validate(rows, "ledger", known_states=["Goa", "Kerala"]).errors)


def _unit_rows(spark: S, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return shapes.table(spark, d, "part").select(
        (key + 1).alias("source_row"), F.concat(F.lit("U<"), key.cast("string")).alias("name"), (key % 4).cast("string").alias("decimal_places"),
        F.when(key % 3 == 0, F.lit("Pcs")).alias("base_units"), F.when(key % 3 == 0, F.lit("Box")).alias("additional_units"),
        F.when(key % 3 == 0, F.concat((F.col("p_size") + 10).cast("string"), F.lit(".50"))).alias("conversion"))


def emit_unit_xml(spark: S, d: str) -> DataFrame:
    return emit.master_fragments(masters.to_units(_unit_rows(spark, d)).data, "unit").select("row", "xml")


def emit_group_xml(spark: S, d: str) -> DataFrame:
    rows = shapes.group_rows(spark, d).withColumn("is_revenue", F.when(F.col("source_row") % 2 == 0, F.lit("Y")).when(F.col("source_row") % 3 == 0, F.lit("off")))
    return emit.master_fragments(masters.to_groups(rows).data, "group").select("row", "xml")


def emit_renamed_xml(spark: S, d: str) -> DataFrame:
    """Groups with identity, old names, and letters beyond ASCII."""
    key = F.col("c_custkey")
    rows = shapes.table(spark, d, "customer").select(
        key.alias("source_row"), F.concat(F.lit("Café & "), "c_name").alias("name"), F.lit("₹ Group").alias("parent"),
        F.concat(F.lit("g"), key.cast("string")).alias("guid"), F.lit("Alter").alias("_action"),
        F.when(key % 2 == 0, F.concat(F.lit("Old "), "c_name")).when(key % 3 == 0, F.concat(F.lit("CAFé & "), "c_name")).alias("old_name"))
    return emit.master_fragments(masters.to_groups(rows).data, "group").select("row", "xml")


def emit_invoice_xml(spark: S, d: str) -> DataFrame:
    built = vouchers.build_vouchers(shapes.invoice_rows(spark, d), store=True, store_issues=False)
    return emit.voucher_fragments(built.vouchers, built.lines).select("voucher_key", "part", "row", "seq", "xml")


def voucher_envelope(spark: S, d: str) -> DataFrame:
    """A whole import of the journals as ordered text rows."""
    return import_vouchers(shapes.journal_rows(spark, d), "A & B").envelope.select("chunk", *POSITION, "xml")


def unified_chunks(spark: S, d: str) -> DataFrame:
    """Units and journals in envelopes of 200 vouchers in source order."""
    built = vouchers.build_vouchers(shapes.journal_rows(spark, d), store=True)
    units = masters.to_units(_unit_rows(spark, d)).data
    return envelope_rows("A & B", {"unit": units}, (built.vouchers, built.lines), chunk=200)


def _wild_rows(spark: S, d: str) -> DataFrame:
    """One invoice line per order and its party line; quantities, rates and taxes beyond what fits, and control characters."""
    orders, key, side = shapes.spread(shapes.numbered(spark, d, "orders")), F.col("o_orderkey"), F.col("side")
    rows = orders.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    total, stock = shapes.money("o_totalprice"), side == 0
    return rows.select(
        (F.col("source_row") * 2 - 1 + side).alias("source_row"), key.cast("string").alias("voucher_number"), F.lit("2024-01-05").alias("date"),
        F.lit("Sales").alias("voucher_type"), F.when(stock & (key % 9 == 4), F.lit("Sa\x0bles")).when(stock, F.lit("Sales")).otherwise(F.lit("Customer")).alias("ledger_name"),
        total.cast("string").alias("amount"), F.when(stock, F.lit("Cr")).otherwise(F.lit("Dr")).alias("dr_cr"), F.when(stock, F.lit("Thing")).alias("stock_item"),
        F.when(stock, F.when(key % 9 == 1, F.lit("9999999999999")).otherwise(F.lit("1"))).alias("quantity"),
        F.when(stock, F.when(key % 9 == 2, F.lit("9999999999999")).otherwise(total.cast("string"))).alias("rate"), F.when(stock, F.lit("Nos")).alias("unit"),
        F.when(stock & (key % 9 == 3), F.lit("99999")).alias("gst_rate"),
        F.lit("MH").alias("shipping_state"), F.lit("KA").alias("home_state"))


def unreadable_cells(spark: S, d: str) -> DataFrame:
    """What goes wrong in wild rows, with the amounts of tax that no longer fit among it."""
    rows = _wild_rows(spark, d).withColumn("amount", F.when(F.col("gst_rate").isNotNull(), F.lit("99999999999999")).otherwise(F.col("amount")))
    return _found(vouchers.build_vouchers(rows).errors)


def vouchers_beside_unreadable_cells(spark: S, d: str) -> DataFrame:
    rows = _wild_rows(spark, d).filter(F.col("gst_rate").isNull())
    built = vouchers.build_vouchers(rows).vouchers
    return built.select("voucher_key", "first_row", "n_lines", F.col("debit_total").cast("double").alias("debit_total"))


def responses_with_cdata(spark: S, d: str) -> DataFrame:
    """Results whose errors sit in CDATA or behind character references, with counters beyond 32 bits."""
    key = F.col("o_orderkey")
    error = (
        F.when(key % 4 == 0, F.concat(F.lit("<LINEERROR><![CDATA[bad <"), key.cast("string"), F.lit(">]]></LINEERROR>")))
        .when(key % 4 == 1, F.concat(F.lit("<t:LineError>caf&#233; &#x41; "), key.cast("string"), F.lit("</t:LineError>"))).otherwise(F.lit(""))
    )
    rows = shapes.table(spark, d, "orders").select(key.alias("job_id"), F.concat(
        F.lit("<R><CREATED>0</CREATED><CREATED>1</CREATED><LASTVCHID>"), (key + 3_000_000_000).cast("string"), F.lit("</LASTVCHID>"), error, F.lit("</R>")).alias("xml"))
    done = responses.import_outcome(responses.parse_responses(rows))
    return done.select("job_id", "status", "created", "last_vch_id", F.array_join("line_errors", "|").alias("line_errors"))


def profile_shares(spark: S, d: str) -> DataFrame:
    """The shares behind type and key decisions, over the whole customer table."""
    rows = shapes.numbered(spark, d, "customer").select(
        "source_row", "c_name", F.when(F.col("c_custkey") % 4 != 0, F.lit("Yes")).alias("flag"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).otherwise(F.lit("x")).alias("mixed"))
    made = profile(rows, samples=False)
    return made.select("column", *[F.round(c, 6).alias(c) for c in ("numeric_share", "boolish_share", "distinct_share", "null_share")])



def _mapping_uploads(spark: S, d: str) -> DataFrame:
    """Profiles of three uploads of the same customers: plain headers, headers that fit two fields, and one without a name."""
    customers = shapes.numbered(spark, d, "customer")
    key, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    uploads = {
        "plain": customers.select("source_row", name.alias("Ledger Name"), segment.alias("Under"), shapes.money("c_acctbal").cast("string").alias("Opening Bal"),
                                  F.lit("29ABCDE1234F1Z5").alias("GSTIN"), segment.alias("Random Notes")),
        "twofold": customers.select("source_row", name.alias("Party"), segment.alias("Group Name"), F.lit("560001").alias("Pin Code"), segment.alias("Opening Bal")),
        "nameless": customers.select("source_row", segment.alias("Foobar"), segment.alias("Under"), F.when(key % 2 == 0, F.lit("Yes")).alias("Billwise")),
    }
    made = None
    for upload, rows in uploads.items():
        part = profile(rows).withColumn("upload", F.lit(upload))
        made = part if made is None else made.unionByName(part)
    return made


def mapping_plan(spark: S, d: str) -> DataFrame:
    return mapping.mapping_plan(mapping.suggest_mapping(_mapping_uploads(spark, d), "ledger"))


def mapping_stats(spark: S, d: str) -> DataFrame:
    return mapping.proposal_stats(mapping.suggest_mapping(_mapping_uploads(spark, d), "ledger"))


def mapping_leftovers(spark: S, d: str) -> DataFrame:
    """Columns that no field takes, and required fields without a column."""
    profiles = _mapping_uploads(spark, d)
    found = mapping.suggest_mapping(profiles, "ledger")
    columns = mapping.unmapped_sources(profiles, found).select("upload", F.lit("column").alias("kind"), F.col("column").alias("name"))
    return columns.unionByName(mapping.unmapped_required(found).select("upload", F.lit("required").alias("kind"), F.col("target_field").alias("name")))


def hsn_enrichment(spark: S, d: str) -> DataFrame:
    """Parts with codes of all lengths against a code table made from every third part."""
    key, parts = F.col("p_partkey"), shapes.table(spark, d, "part")
    full = F.lpad((key * 7919 % 100000000).cast("string"), 8, "0")
    code = (
        F.when(key % 5 == 0, full).when(key % 5 == 1, F.substring(full, 1, 6)).when(key % 5 == 2, F.concat(F.substring(full, 1, 2), F.lit("."), F.substring(full, 3, 2)))
        .when(key % 5 == 3, F.substring(full, 1, 2)).otherwise(F.lit("12AB"))
    )
    items = parts.select((key + 1).alias("source_row"), F.col("p_name").alias("name"), code.alias("hsn"))
    own = F.substr(full, F.lit(1), 2 + 2 * (key % 4).cast("int"))
    codes = parts.filter(key % 3 == 0).select(own.alias("hsn"), (key % 5 * 6).alias("gst_rate"), F.concat(F.lit("HSN "), own).alias("description"))
    return hsn.enrich(items, codes).select("source_row", "hsn_matched", "hsn_gst_rate", "hsn_description")


def trial_balance(spark: S, d: str) -> DataFrame:
    """Customers' balances, posted in two parts, against a second book that lacks codes, spells names otherwise, and has other amounts and accounts."""
    key, amount, customers = F.col("c_custkey"), shapes.money("c_acctbal"), shapes.table(spark, d, "customer")
    code, name = F.when(key % 9 != 8, key.cast("string")).alias("code"), F.col("c_name").alias("name")
    ours = customers.select(code, name, (amount - 10).alias("amount")).unionByName(customers.select(code, name, F.lit(10).cast("decimal(20,2)").alias("amount")))
    moved = F.when(key % 7 == 3, F.lit("1.5")).when(key % 7 == 5, F.lit("0.01")).otherwise(F.lit("0")).cast("decimal(10,2)")
    theirs = customers.filter(key % 11 != 4).select(
        F.when(key % 5 != 0, key.cast("string")).alias("code"), F.concat(F.lit("  "), F.upper("c_name")).alias("name"), (amount + moved).alias("amount"))
    other = shapes.table(spark, d, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("code"), F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string")).alias("name"),
        shapes.money("s_acctbal").alias("amount"))
    return reconcile.compare_balances(ours, theirs.unionByName(other)).drop("our_name", "their_name")


QUERIES = {f.__name__: f for f in (
    delimited_customers, delimited_encodings, validate_stock_items, validate_units, validate_suppliers, emit_unit_xml, emit_group_xml, emit_renamed_xml,
    emit_invoice_xml, voucher_envelope, unified_chunks, unreadable_cells, vouchers_beside_unreadable_cells, responses_with_cdata, profile_shares,
    mapping_plan, mapping_stats, mapping_leftovers, hsn_enrichment, trial_balance,
)}
