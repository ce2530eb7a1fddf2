"""Group hierarchy: parent-before-child order and cycle detection by pointer doubling.

Each round joins every open group to the ancestor it points at and jumps there,
so a chain of depth d closes after log2(d) rounds instead of d. Rounds cut their
lineage with a checkpoint in the shared folder of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave import errors as E
from ledgerweave.functions.text import norm_or_empty
from ledgerweave.operators.joins import hot_safe_join
from ledgerweave.sources.shared_folder import ensure_checkpoint_dir

_MAX_ROUNDS = 64  # 2**64 levels; the loop ends long before


def _edges(df: DataFrame) -> DataFrame:
    """One row per group (first row wins among equal names) with the key of its parent, if that is in the file."""
    groups = (
        df.select("source_row", norm_or_empty("name").alias("name_key"), norm_or_empty("parent").alias("parent_key"))
        .filter(F.col("name_key") != "")
        .groupBy("name_key")
        .agg(F.min("source_row").alias("source_row"), F.min_by("parent_key", "source_row").alias("parent_key"))
    )
    known = groups.select(F.col("name_key").alias("parent_key"), F.lit(True).alias("inside"))
    inside = hot_safe_join(groups, known, ["parent_key"], "left")
    root = F.col("inside").isNull() | (F.col("parent_key") == F.col("name_key"))
    return inside.select("name_key", "source_row", F.when(~root, F.col("parent_key")).alias("up"))


def _depths(df: DataFrame) -> DataFrame:
    """Every group with its `parent_key` (null at a root) and `depth`: null on and below a cycle.

    A row holds one ancestor and the steps to it, never a path. Groups whose depth is known are set aside and are only looked up;
    each round at least halves the steps that the others still have to go.
    """
    ensure_checkpoint_dir(df.sparkSession)
    edges = _edges(df).checkpoint()
    root = F.col("up").isNull()
    done = edges.filter(root).select("name_key", F.lit(0).cast("long").alias("depth"))
    open_ = edges.filter(~root).select("name_key", F.col("up").alias("ancestor"), F.lit(1).cast("long").alias("hops")).checkpoint()
    left = open_.count()
    for _ in range(_MAX_ROUNDS):
        if left == 0:
            break
        known = done.select("name_key", F.lit(None).cast("string").alias("next"), F.lit(0).cast("long").alias("more"), "depth").unionByName(
            open_.select("name_key", F.col("ancestor").alias("next"), F.col("hops").alias("more"), F.lit(None).cast("long").alias("depth"))
        )
        moved = hot_safe_join(open_, known.withColumnRenamed("name_key", "ancestor"), ["ancestor"]).select(
            "name_key", F.col("next").alias("ancestor"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("hops") + F.col("depth")).alias("depth")
        ).checkpoint()
        done = done.unionByName(moved.filter("depth is not null").select("name_key", "depth"))
        open_ = moved.filter("depth is null").select("name_key", "ancestor", "hops")
        # a round that closes no group proves that the open ones are on or below a cycle
        now = open_.count()
        if now == left:
            break
        left = now
    return edges.withColumnRenamed("up", "parent_key").join(done, "name_key", "left")


def group_depths(df: DataFrame) -> DataFrame:
    """Groups outside cycles with `depth`: sorted by it, parents come before their children."""
    return _depths(df).filter(F.col("depth").isNotNull()).select("source_row", "name_key", "depth")


def order_groups(df: DataFrame) -> DataFrame:
    """Groups outside cycles with `depth` and `path`; sort by (depth, path) for parents first.

    Breadth-first with siblings in name order is the same as ordering by depth and
    then by the path from the root. A path is as long as the group is deep; where parents first is enough,
    `group_depths` does without.
    """
    placed = _depths(df).filter(F.col("depth").isNotNull())
    state = placed.select("source_row", "name_key", "depth", F.col("parent_key").alias("up"), F.array("name_key").alias("path")).checkpoint()
    deepest = state.agg(F.max("depth")).first()[0] or 0
    for _ in range(int(deepest).bit_length()):
        above = state.select(F.col("name_key").alias("up"), F.col("up").alias("next_up"), F.col("path").alias("head"))
        # the ancestor's path goes in front
        state = (
            state.join(above, "up", "left")
            .select(
                "source_row", "name_key", "depth", F.col("next_up").alias("up"),
                F.when(F.col("head").isNull(), F.col("path")).otherwise(F.concat("head", "path")).alias("path"),
            )
            .checkpoint()
        )
    return state.select("source_row", "name_key", F.col("depth").cast("int").alias("depth"), "path")


def unordered_groups(df: DataFrame) -> DataFrame:
    """An error row for every group that `order_groups` cannot place: later copies of a name, and groups on or below a cycle."""
    rows = df.select(F.col("source_row").cast("long").alias("source_row"), "name", norm_or_empty("name").alias("name_key")).filter(F.col("name_key") != "")
    first = rows.groupBy("name_key").agg(F.min("source_row").alias("first_row"))
    copies = hot_safe_join(rows, first, ["name_key"]).filter(F.col("source_row") != F.col("first_row"))
    said = F.concat(F.lit("Group '"), "name", F.lit("' occurs more than once."))
    repeated = E.error_rows(copies, F.array(E.issue(E.DUPLICATE_IN_FILE, "name", said)), "convert", "group")
    cycle = F.concat(F.lit("Group '"), "name_key", F.lit("' never reaches a root."))
    return repeated.unionByName(E.error_rows(cyclic_groups(df), F.array(E.issue(E.GROUP_CYCLE, "parent", cycle)), "convert", "group"))


def cyclic_groups(df: DataFrame) -> DataFrame:
    """Groups that never reach a root."""
    return _depths(df).filter(F.col("depth").isNull()).select("source_row", "name_key")
