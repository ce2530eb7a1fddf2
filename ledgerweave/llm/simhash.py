"""SimHash near-duplicates with pivot distance tables.

A text's fingerprint has 64 bits; a bit is set if it is set in over half of the hashes of the text's word shingles. Distinct
fingerprints are linked if they differ in at most `MOST` bits:

1. Bits are cut into five blocks. Fingerprints that differ in three bits agree in two blocks at least, so every link lies in
   one of ten buckets (two blocks and their bits). Buckets with one member are dropped by a count.
2. A bucket that exceeds `BUCKET` members is cut again: within it the other bits form four blocks of which one agrees, so
   its members move to four narrower buckets each.
3. Inside a bucket a table holds the Hamming distances of each member to the pivots. A distance obeys the triangle
   inequality, so a pair whose table rows differ by more than `MOST` in any column is discarded; survivors are
   verified bit by bit. Links that would only join what is already joined are not written.

Components come from alternating stars over distinct fingerprints, so copies never multiply links. Null texts are empty
texts; fingerprint zero of texts without words links like any other. Rows without doc_id take part; their component is
named by the smallest id in it (null if there is none). Repeated rows give repeated results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.batches import free_name, frugal, id_and_text, over_batches, row_key, texts_of
from ledgerweave.llm.components import components
from ledgerweave.llm.shared import hot_safe_join, written

SHINGLE, MOST, SEED = 3, 3, 42
#: Members of a bucket that are compared with each other without cutting the bucket again.
BUCKET = 4096
#: The first bit of each block.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Reference fingerprints: halves, quarters, ... of the 64 bits, and fixed random ones.
_WALSH = [sum(1 << b for b in range(64) if bin(b & r).count("1") % 2) for r in (1, 2, 4, 8, 16, 32, 63, 21)]
PIVOTS = np.array([0, *_WALSH, *(((2 * k + 1) * 0x9E3779B97F4A7C15) % (1 << 64) for k in range(7))], dtype=np.uint64)


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    width = min(shingle, len(words))
    hashes = np.array(
        [xxhash.xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], dtype=np.uint64
    )
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    total = np.zeros(64, dtype=np.int64)
    for low in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the key of the row (its id and a hash of its text) and the fingerprint as a signed long."""

    def work(batch: pa.RecordBatch) -> dict:
        made = np.array([fingerprint(text, shingle, seed) for text in texts_of(batch)], dtype=np.uint64)
        return {**{name: batch.column(name) for name in ("doc_id", "row_id", "row_hash")}, "fp": made.view(np.int64)}

    source = id_and_text(docs, id_col, text_col).select("doc_id", "text", *row_key())
    return over_batches(source, work, "doc_id long, row_id long, row_hash long, fp long")


def _bits(start: int, size: int):
    return F.shiftrightunsigned("fp", start).bitwiseAND((1 << size) - 1)


def buckets(fps: DataFrame) -> DataFrame:
    """(bucket, fp): ten buckets for each distinct fingerprint; a bucket's name holds which blocks, and their bits."""
    names = []
    for k, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2)):
        (sa, na), (sb, nb) = BLOCKS[a], BLOCKS[b]
        names.append(F.lit(k << 32).cast("long").bitwiseOR(F.shiftleft(_bits(sa, na), nb).bitwiseOR(_bits(sb, nb))))
    return fps.select("fp", F.explode(F.array(*names)).alias("bucket"))


def _free_blocks(pair: int) -> list[tuple[int, int]]:
    """The bits outside a bucket's two blocks, in four parts."""
    used = list(combinations(range(len(BLOCKS)), 2))[pair]
    free = [b for i, (s, n) in enumerate(BLOCKS) if i not in used for b in range(s, s + n)]
    cuts = [round(len(free) * k / 4) for k in range(5)]
    return [free[cuts[k] : cuts[k + 1]] for k in range(4)]


def _narrower(members: DataFrame) -> DataFrame:
    """Each member of a hot bucket in four narrower ones: fingerprints that differ in three bits agree in one of four parts."""
    masks = [[sum(1 << b for b in part) for part in _free_blocks(k)] for k in range(10)]
    signed = [[m - (1 << 64) if m >> 63 else m for m in row] for row in masks]
    pair = F.shiftright("bucket", 32).cast("int")
    table = F.array(*[F.array(*[F.lit(m) for m in row]) for row in signed])
    parts = F.element_at(table, pair + 1)
    return members.select("fp", "bucket", F.posexplode(parts).alias("part", "mask")).select(
        "fp", F.xxhash64("bucket", "part", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"), F.lit(True).alias("narrow")
    )


def link_sorted(bucket: np.ndarray, fp: np.ndarray, most: int = MOST) -> np.ndarray:
    """Links (pairs of indices) that join what lies within `most` bits inside each bucket; input sorted by bucket.

    Members are compared with the d-th next one of their bucket for d = 1, 2, ... A pair whose ends are already joined
    needs no link; no more links than members are made.
    """
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    root = np.arange(len(fp))
    links = []
    live = np.arange(len(fp))
    ends = np.searchsorted(bucket, bucket, side="right")
    step = 1
    while True:
        live = live[live + step < ends[live]]
        if not len(live):
            return np.array(links, dtype=np.int64).reshape(-1, 2)
        other = live + step
        apart = root[live] != root[other]
        a, b = live[apart], other[apart]
        for column in range(table.shape[1]):  # column by column, so that most pairs go after a few
            near = np.abs(table[a, column] - table[b, column]) <= most
            a, b = a[near], b[near]
        close = np.bitwise_count(fp[a] ^ fp[b]) <= most
        for x, y in zip(a[close].tolist(), b[close].tolist()):
            while root[x] != x:
                root[x] = root[root[x]]
                x = int(root[x])
            while root[y] != y:
                root[y] = root[root[y]]
                y = int(root[y])
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((x, y))
        if close.any():
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
        step += 1


def _links_in(members: DataFrame, most: int) -> DataFrame:
    """Links of buckets whose members lie together and sorted in a partition."""

    def run(batches):
        kept_bucket, kept_fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            bucket = np.concatenate([kept_bucket, batch.column("bucket").to_numpy()])
            fp = np.concatenate([kept_fp, batch.column("fp").to_numpy().view(np.uint64)])
            if not len(bucket):
                continue
            last = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            yield _made(bucket[:last], fp[:last])
            kept_bucket, kept_fp = bucket[last:], fp[last:]
        if len(kept_bucket):
            yield _made(kept_bucket, kept_fp)

    def _made(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        pairs = link_sorted(bucket, fp, most)
        signed = fp.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[pairs[:, 0]]), pa.array(signed[pairs[:, 1]])], names=["u", "v"])

    return members.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "fp").mapInArrow(frugal(run), "u long, v long")


def links(fps: DataFrame, most: int = MOST, bucket: int = BUCKET) -> DataFrame:
    """Links between distinct fingerprints that join all that differ in at most `most` (3 or fewer) bits."""
    if most > 3:
        raise ValueError("Five blocks find fingerprints that differ in three bits at most.")
    every = buckets(fps)
    sizes = every.groupBy("bucket").count().where("count > 1")
    shared = written(hot_safe_join(every, sizes, ["bucket"]))
    small = shared.where(F.col("count") <= bucket).select("bucket", "fp")
    # fingerprints of a hot bucket are dealt to four narrower ones each, again dropping those with one member
    narrow = _narrower(shared.where(F.col("count") > bucket)).select("bucket", "fp")
    narrow = hot_safe_join(narrow, narrow.groupBy("bucket").count().where("count > 1"), ["bucket"]).select("bucket", "fp")
    return _links_in(small.unionByName(narrow), most)


def groups(prints: DataFrame, most: int = MOST) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint: one root per group, and the smallest doc_id in it."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(nodes.select("fp"), most))
    # fingerprints without a link are groups of their own
    of_node = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    of_root = of_node.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(hot_safe_join(of_node, of_root, ["root"]).select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    prints = written(fingerprints(docs, shingle, SEED, id_col, text_col))
    named = groups(prints, most)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, rooted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, unchanged, that have the smallest doc_id (then the smallest hash of the text) of their root."""
    # rows without an id come last
    first = F.struct(F.col("doc_id").isNull().alias("absent"), "row_id", "row_hash")
    keys = [free_name(docs.columns, "_row_id"), free_name(docs.columns, "_row_hash")]
    kept = rooted.groupBy("root").agg(F.min(first).alias("k")).select(F.col("k.row_id").alias(keys[0]), F.col("k.row_hash").alias(keys[1]))
    row_id, row_hash = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    keyed = docs.withColumn(keys[0], row_id).withColumn(keys[1], row_hash)
    return keyed.join(written(kept), keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, unchanged: the one with the smallest doc_id (then the smallest hash of the text)."""
    prints = written(fingerprints(docs, shingle, SEED, id_col, text_col))
    return first_of_each(docs, prints.join(groups(prints, most).select("fp", "root"), "fp"), id_col, text_col)
