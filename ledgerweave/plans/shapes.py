"""Accounting-shaped text tables derived from the star-schema tables.

Money columns arrive as doubles; they are cast to decimal(20,2) first and then
rendered as text, because every import starts from text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.sources.row_numbers import read_parquet_numbered

CUTOVER = "1998-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet_numbered(spark, f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str = "source_row") -> DataFrame:
    """Use every core when the files give fewer splits than cores; large tables pass unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def money(c: str) -> Column:
    return F.col(c).cast("decimal(20,2)")


def gstin_of(key: Column) -> Column:
    """A made-up 15-character GSTIN with a two-digit state code in front."""
    code = F.lpad((key % 38 + 1).cast("string"), 2, "0")
    return F.concat(code, F.lit("ABCDE"), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("F1Z5"))


def sale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sales line per lineitem row, with buyer, place of supply and GST rate."""
    lines = spread(
        numbered(spark, sf_dir, "lineitem").select(
            "source_row", "l_orderkey", "l_extendedprice", "l_tax", "l_returnflag"
        )
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, orders.o_custkey == customers.c_custkey)
        .join(nations, customers.c_nationkey == nations.n_nationkey)
    )
    return joined.select(
        "source_row",
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.lit("Sales").alias("voucher_type"),
        F.lit("Sales").alias("ledger_name"),
        money("l_extendedprice").cast("string").alias("amount"),
        F.lit("Cr").alias("dr_cr"),
        F.col("c_name").alias("party_ledger"),
        (F.col("l_tax").cast("decimal(6,2)") * 100).cast("decimal(6,0)").cast("string").alias("gst_rate"),
        F.col("n_name").alias("shipping_state"),
        F.lit("NATION_0").alias("home_state"),
        F.when(F.col("l_returnflag") == "R", F.lit("refund")).alias("transaction_type"),
        F.when(F.col("c_mktsegment") == "MACHINERY", gstin_of(F.col("c_custkey"))).alias("party_gstin"),
    )


def settlement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One marketplace settlement per order; every 50th has deductions above gross, every 60th no date."""
    total = money("o_totalprice")
    key = F.col("o_orderkey")
    return spread(numbered(spark, sf_dir, "orders")).select(
        "source_row",
        key.cast("string").alias("order_id"),
        F.when(key % 60 != 7, F.date_format("o_orderdate", "dd/MM/yyyy")).alias("date"),
        F.concat(F.lit("Rs. "), total.cast("string")).alias("amount"),
        F.round(F.when(key % 50 == 3, total * 2).otherwise(total * F.lit("0.10").cast("decimal(3,2)")), 2)
        .cast("string").alias("commission"),
        F.round(total * F.lit("0.02").cast("decimal(3,2)"), 2).cast("string").alias("marketplace_fee"),
        F.round(total * F.lit("0.01").cast("decimal(3,2)"), 2).cast("string").alias("tcs"),
        F.col("o_orderpriority").alias("party_ledger"),
        F.lit("HDFC Bank").alias("ledger_name"),
    )


def cutover_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per order, debit and credit in turn, with the customer as party; every 90th amount is unreadable."""
    orders = spread(numbered(spark, sf_dir, "orders"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    key = F.col("o_orderkey")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        "source_row",
        key.cast("string").alias("voucher_number"),
        F.date_format("o_orderdate", "dd-MM-yyyy").alias("date"),
        F.lit("Journal").alias("voucher_type"),
        F.col("c_mktsegment").alias("ledger_name"),
        F.when(key % 90 == 5, F.lit("n.a.?")).otherwise(money("o_totalprice").cast("string")).alias("amount"),
        F.when(key % 3 == 0, F.lit("Dr")).otherwise(F.lit("Cr")).alias("dr_cr"),
        F.col("c_name").alias("party_ledger"),
    )


def journal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines per order, customer against sales, with faults planted by order key."""
    orders = spread(numbered(spark, sf_dir, "orders"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    key, total = F.col("o_orderkey"), money("o_totalprice")
    second = F.col("side") == 1
    credit = (
        F.when(key % 11 == 0, total + 5).when(key % 11 == 1, total + F.lit("0.50").cast("decimal(3,2)")).otherwise(total)
    )
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).withColumn(
        "side", F.explode(F.array(F.lit(0), F.lit(1)))
    )
    return rows.select(
        (F.col("source_row") * 2 - 1 + F.col("side")).alias("source_row"),
        key.cast("string").alias("voucher_number"),
        F.when(key % 13 == 2, F.lit("not a date"))
        .when(second & (key % 29 == 6), F.lit("2001-01-01"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"),
        F.when(second & (key % 31 == 7), F.lit("Payment")).otherwise(F.lit("Journal")).alias("voucher_type"),
        F.when(second & (key % 17 == 3), F.lit(" ")).when(second, F.lit("Sales")).otherwise(F.col("c_name"))
        .alias("ledger_name"),
        F.when(~second & (key % 23 != 5), total.cast("string")).when(~second, F.lit("12.3.4")).alias("debit"),
        F.when(second & (key % 19 == 4), F.lit("0")).when(second, credit.cast("decimal(20,2)").cast("string"))
        .alias("credit"),
        F.when(second & (key % 37 == 8), F.lit("Someone else")).otherwise(F.col("c_name")).alias("party_ledger"),
    )


def invoice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines per lineitem row: a stock line and its party line. The rate loses its cents, so totals drift."""
    lines = spread(numbered(spark, sf_dir, "lineitem").select(
        "source_row", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    price, quantity = money("l_extendedprice"), F.col("l_quantity").cast("decimal(10,0)")
    rate = F.round(price / quantity, 2).cast("decimal(20,2)")
    stock = F.col("side") == 0
    rows = lines.withColumns({"_price": price, "_rate": rate, "_qty": quantity}).withColumn(
        "side", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select(
        (F.col("source_row") * 2 - 1 + F.col("side")).alias("source_row"),
        F.concat_ws("-", "l_orderkey", "source_row").alias("voucher_number"),
        F.date_format("l_shipdate", "d MMM yyyy").alias("date"),
        F.lit("Sales").alias("voucher_type"),
        F.when(stock, F.lit("Sales")).otherwise(F.lit("Customer")).alias("ledger_name"),
        F.col("_price").cast("string").alias("amount"),
        F.when(stock, F.lit("Cr")).otherwise(F.lit("Dr")).alias("dr_cr"),
        F.when(stock, F.concat(F.lit("Part "), F.col("l_partkey"))).alias("stock_item"),
        F.when(stock, F.when(F.col("l_orderkey") % 40 == 9, F.lit("-1")).otherwise(F.col("_qty").cast("string"))).alias("quantity"),
        F.when(stock, F.col("_rate").cast("string")).alias("rate"),
        F.when(stock & (F.col("l_orderkey") % 70 != 11), F.lit("Nos")).alias("unit"),
    )


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as ledger rows with faults planted by key."""
    key = F.col("c_custkey")
    balance = money("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        (key + 1).alias("source_row"),
        F.when(key % 50 == 0, F.lit("   ")).when(key % 97 == 5, F.lit("Customer#same")).otherwise(F.col("c_name")).alias("name"),
        F.when(key % 30 == 1, F.lit("MACHINRY")).when(key % 61 == 4, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("parent"),
        F.when(key % 40 == 3, F.lit("abc")).when(key % 41 == 5, F.concat(F.lit("("), F.abs(balance).cast("string"), F.lit(")")))
        .otherwise(F.abs(balance).cast("string")).alias("opening_balance"),
        F.when(balance < 0, F.lit("Cr")).otherwise(F.lit("Dr")).alias("opening_balance_drcr"),
        F.when(key % 7 == 0, F.lit("BAD")).when(F.col("c_mktsegment") == "MACHINERY", gstin_of(key)).alias("gstin"),
        F.when(key % 45 == 2, F.lit("12a")).otherwise(F.lit("560068")).alias("pincode"),
        F.when(key % 33 == 9, F.lit("lots")).otherwise(F.lit("1,000")).alias("credit_limit"),
        F.when(key % 21 == 8, F.lit("perhaps")).when(key % 2 == 0, F.lit("Yes")).otherwise(F.lit("n")).alias("is_billwise"),
    )


def group_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, nation/segment and customer as groups: four levels."""
    nations = table(spark, sf_dir, "nation")
    customers = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    regions = table(spark, sf_dir, "region")
    segment = F.concat_ws("/", "n_name", "c_mktsegment")
    levels = [
        regions.select(F.col("r_regionkey").cast("long").alias("source_row"), F.col("r_name").alias("name"), F.lit("Primary").alias("parent")),
        nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
            (F.col("n_nationkey") + 100).cast("long"), "n_name", "r_name"),
        customers.groupBy("n_nationkey", "n_name", "c_mktsegment").agg(F.min("c_custkey").alias("k")).select(
            F.col("k") + 1000, segment, "n_name"),
        customers.select(F.col("c_custkey") + 1_000_000_000, "c_name", segment),
    ]
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def chained_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in chains of ten; every tenth chain closes into a cycle."""
    key = F.col("c_custkey")
    name = lambda k: F.concat(F.lit("Group "), k.cast("string"))
    return table(spark, sf_dir, "customer").select(
        key.alias("source_row"),
        name(key).alias("name"),
        F.when(key % 10 != 9, name(key + 1)).when(key % 100 == 9, name(key - 9)).otherwise(F.lit("Primary")).alias("parent"),
    )


def existing_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ex_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("parent"),
        F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("guid"),
    )


def incoming_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer again: as is, in capitals with spaces, with a letter dropped, or under a new name."""
    key, name = F.col("c_custkey"), F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        key.alias("source_row"),
        F.when(key % 4 == 0, name)
        .when(key % 4 == 1, F.concat(F.lit("  "), F.upper(name), F.lit(" ")))
        .when(key % 4 == 2, F.concat(F.substring(name, 1, 4), F.substr(name, F.lit(6))))
        .otherwise(F.concat(F.lit("Vendor "), key.cast("string"))).alias("name"),
        F.col("c_mktsegment").alias("parent"),
    )


def response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One import result per order; some broken, some with a DOCTYPE, some with line errors."""
    key = F.col("o_orderkey")
    number = lambda m: (key % m).cast("string")
    body = F.concat(
        F.lit("<CREATED>"), number(7), F.lit("</CREATED><altered> "), number(3), F.lit(" </altered><ERRORS>"),
        F.when(key % 5 == 0, F.lit("1")).otherwise(F.lit("0")), F.lit("</ERRORS><LASTMID>"), key.cast("string"), F.lit("</LASTMID>"),
        F.when(key % 5 == 0, F.concat(F.lit("<LINEERROR>Order "), key.cast("string"), F.lit(" &lt;refused&gt;</LINEERROR>"))).otherwise(F.lit("")),
    )
    whole = F.concat(F.lit("<ENVELOPE><BODY><DATA><IMPORTRESULT>"), body, F.lit("</IMPORTRESULT></DATA></BODY></ENVELOPE>"))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select(
        key.alias("job_id"),
        F.when(key % 41 == 1, F.lit("<ENVELOPE><UNCLOSED>"))
        .when(key % 43 == 2, F.concat(F.lit("<!DOCTYPE x>"), whole)).otherwise(whole).alias("xml"),
    )
