"""Saved mapping templates: best match, upsert, list, delete, built-ins.

A template table has template_id, org_id, entity, name, mapping, constants and
source_columns. Table operations return the new state of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.operators.joins import hot_safe_join

# Least overlap of a template with an upload.
MIN_COLUMNS, MIN_SHARE = 2, 0.6
# The built-in template.
BUILTIN = {
    "shopify": {
        "entity": "voucher",
        "mapping": {
            "voucher_number": "Name", "date": "Created at", "ledger_name": "Lineitem name",
            "amount": "Lineitem price", "party_ledger": "Billing Name", "narration": "Name",
        },
        "constants": {"voucher_type": "Sales", "dr_cr": "Cr", "opening_balance_drcr": "Cr"},
    }
}
SCHEMA = (
    "template_id string, org_id string, entity string, name string, mapping map<string,string>, "
    "constants map<string,string>, source_columns array<string>"
)
_COLUMNS = ["template_id", "org_id", "entity", "name", "mapping", "constants", "source_columns"]


def builtin_template(name: str) -> tuple[dict[str, str], dict[str, str]]:
    found = BUILTIN.get(name.lower())
    if found is None:
        raise ValueError(f"Unknown template: {name}")
    return found["mapping"], found["constants"]


def builtin_templates(spark: SparkSession, entity: str) -> DataFrame:
    rows = [
        (f"builtin:{name}", None, entity, name, t["mapping"], t["constants"], list(t["mapping"].values()))
        for name, t in BUILTIN.items()
        if t["entity"] == entity
    ]
    return spark.createDataFrame(rows, SCHEMA)


def list_templates(templates: DataFrame, org_id: str, entity: str) -> DataFrame:
    """Built-ins first, then the saved templates of the tenant by name."""
    saved = templates.filter((F.col("org_id") == org_id) & (F.col("entity") == entity)).select(*_COLUMNS)
    both = builtin_templates(templates.sparkSession, entity).withColumn("builtin", F.lit(True)).unionByName(
        saved.withColumn("builtin", F.lit(False))
    )
    return both.orderBy(F.desc("builtin"), "name")


def upsert_templates(templates: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert or overwrite by (org_id, entity, name). Empty sources and blank constants are dropped.

    Several changes to one key in a batch: the last one counts, by `seq` where the changes have that column, else by
    template_id.
    """
    order = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(0).cast("long")
    clean = changes.select(
        "template_id", "org_id", "entity", F.btrim("name").alias("name"),
        F.map_filter("mapping", lambda _, v: v.isNotNull() & (v != "")).alias("mapping"),
        F.map_filter("constants", lambda _, v: F.coalesce(F.btrim(v), F.lit("")) != "").alias("constants"),
        F.coalesce("source_columns", F.array().cast("array<string>")).alias("source_columns"), order.alias("seq"),
    )
    key = ["org_id", "entity", "name"]
    rest = F.struct("template_id", "mapping", "constants", "source_columns")
    # maps cannot be compared; their entries as text settle a tie
    rank = F.struct("seq", F.coalesce("template_id", F.lit("")), F.to_json("mapping"), F.to_json("constants"))
    clean = clean.groupBy(*key).agg(F.max_by(rest, rank).alias("last")).select(*key, "last.*")
    ids = templates.select(*key, F.col("template_id").alias("old_id"))
    kept_id = clean.join(ids, key, "left").withColumn("template_id", F.coalesce("old_id", "template_id"))
    return templates.join(clean.select(*key), key, "left_anti").select(*_COLUMNS).unionByName(kept_id.select(*_COLUMNS))


def delete_templates(templates: DataFrame, org_id: str, template_id: str) -> DataFrame:
    return templates.filter(~((F.col("org_id") == org_id) & (F.col("template_id") == template_id)))


def best_template(uploads: DataFrame, templates: DataFrame) -> DataFrame:
    """The best template of each upload, for uploads that have one.

    uploads: upload, org_id, entity, columns (array). A template needs two source columns and 60 percent of them
    present; ties go to the first name. A column that a template lists twice counts twice.

    Tenants with many uploads and templates do not meet pair by pair. Uploads with the same columns are one header, and of
    templates with the same columns only the first by name can win. Headers and templates then join on a column, of which
    a template offers only its rarest: those before the rest of its list weighs less than 60 percent, since an
    upload that has none of them cannot reach the share. Pairs that meet are compared in full.
    """
    tenant = ["org_id", "entity"]
    real = uploads.filter(F.col("org_id").isNotNull() & F.col("entity").isNotNull()).select(
        "upload", *tenant, F.array_sort(F.array_distinct(F.filter("columns", lambda c: c.isNotNull() & (c != "")))).alias("present"))
    heads = real.select(*tenant, "present").distinct().withColumn("head", _digest(*tenant, "present"))
    wanted = F.array_sort(F.filter("source_columns", lambda c: c.isNotNull() & (c != "")))
    kinds = (
        templates.select(*tenant, "name", "mapping", "constants", wanted.alias("wanted"))
        .filter((F.size("wanted") >= MIN_COLUMNS) & F.col("org_id").isNotNull() & F.col("entity").isNotNull())
        .groupBy(*tenant, "wanted")
        .agg(F.min_by(F.struct("name", "mapping", "constants"), F.coalesce("name", F.lit(""))).alias("template"))
        .withColumn("kind", _digest(*tenant, "wanted"))
    )
    offered = heads.select("head", *tenant, F.explode("present").alias("column"))
    rarity = offered.groupBy(*tenant, "column").count()
    weighed = kinds.select("kind", *tenant, F.size("wanted").alias("total"), F.explode("wanted").alias("column"))
    weighed = weighed.groupBy("kind", *tenant, "column").agg(F.count("*").alias("weight"), F.min("total").alias("total"))
    weighed = hot_safe_join(weighed, rarity, [*tenant, "column"], "left")
    onward = Window.partitionBy("kind").orderBy(F.coalesce("count", F.lit(0)), "column").rowsBetween(0, Window.unboundedFollowing)
    # one row of state per column of one template
    leading = weighed.withColumn("rest", F.sum("weight").over(onward) / F.col("total")).filter(F.col("rest") >= MIN_SHARE)
    met = hot_safe_join(offered, leading.select("kind", *tenant, "column"), [*tenant, "column"]).select("head", "kind").distinct()
    pairs = hot_safe_join(met, heads.select("head", "present"), ["head"])
    pairs = hot_safe_join(pairs, kinds.select("kind", "wanted", F.col("template.name").alias("name")), ["kind"])
    hits = F.size(F.filter("wanted", lambda c: F.array_contains("present", c)))
    scored = pairs.select("head", "kind", "name", (hits / F.size("wanted")).alias("score")).filter(F.col("score") >= MIN_SHARE)
    rank = F.struct((-F.col("score")).alias("score"), F.coalesce("name", F.lit("")).alias("name"), "kind")
    best = scored.groupBy("head").agg(F.min(rank).alias("rank")).select("head", "rank.kind", (-F.col("rank.score")).alias("score"))
    best = best.join(kinds.select("kind", "template"), "kind").select("head", "score", "template.*")
    chosen = hot_safe_join(real.withColumn("head", _digest(*tenant, "present")).select("upload", "head"), best, ["head"])
    first = F.struct(-F.col("score"), F.coalesce("name", F.lit("")), "head")
    return (
        chosen.groupBy("upload").agg(F.min_by(F.struct("name", "score", "mapping", "constants"), first).alias("best"))
        .select("upload", "best.*")
    )


def _digest(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)
