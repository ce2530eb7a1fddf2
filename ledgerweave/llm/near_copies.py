"""Near copies by Jaccard similarity of word shingles: every pair of at least the similarity is found, and verified exactly.

A text's set holds the 64-bit names of its runs of `WORDS` words (ASCII letters in lower case; a shorter text is one run). Two sets
are linked if they share at least `SIMILAR` of their union:

1. SimHash comes first: sets with one fingerprint (64 bits, of their names), and fingerprints that differ in three bits or fewer, found by
   blocks of equal bits and pivot tables as in `simhash`, are candidates. What is verified on whole sets is joined and not compared again.
2. SimHash alone would lose links: at five words and 0.8 fingerprints differ in ten of 64 bits on average, and blocks of equal bits are exact for
   three. So the sets that are not joined meet once more. Names stand in one order for all texts, rarest first. Two sets that are similar enough share
   a name in the first n - ceil(n * similarity) + 1 of each, so every such pair meets in the bucket of one of these names.
   Names that a sample of the texts holds often come last in the order. The sample decides what buckets cost, never what is found.
3. Pairs of a bucket of up to `BUCKET` sets are written if their sizes allow the similarity. In larger ones a set that leads is compared with all
   others, in `ROUNDS` rounds with another leader each, which joins large groups without their pairs. Then all pairs of a bucket that are not joined
   are compared by size and by parities, a lower bound on how many names they differ in; only pairs that may be similar are written.
   Buckets are read as a stream, and their pairs are compared in tiles of at most `TILE` sets on a side, so no task holds a bucket.
4. Pairs whose parities allow the similarity are verified on whole sets, made again from the texts that have a pair. Pairs are grouped by
   their first set, which is made once for up to `MEMBERS` of its partners; partners stream by. Texts that have no pair are left out before the
   shuffle, by a bitmap of `MARKED` bits on their hashes: it may let others pass, which then meet no pair.

Equal sets are one node, so exact copies never multiply pairs. Null texts are empty texts; those without words are one group. Rows that agree
in id and text are one row; rows without an id stay only where no other row of the group has one. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm import simhash
from ledgerweave.llm.batches import frugal, id_and_text, over_batches, row_key, texts_of
from ledgerweave.llm.components import components
from ledgerweave.llm.repeats import unpacked
from ledgerweave.llm.shared import hot_safe_join, stored, written
from ledgerweave.llm.simhash import first_of_each
from ledgerweave.llm.words import NOT_SPACE, windows, words_of

WORDS, SIMILAR = 5, Fraction(4, 5)
#: Sets of a bucket that are compared with each other at once.
BUCKET = 8
#: How often the sets of a larger bucket are compared with one of them; bits of the bound on differences.
ROUNDS, BITS = 2, 1024
#: Sets on a side that a task compares with each other; partners that share one copy of a set; texts a task remembers.
TILE, MEMBERS, SEEN = 4096, 256, 100_000
#: One in so many sets is read for the order of names; names that it holds `COMMON` times or more come last, at most `LISTED`.
SAMPLE, COMMON, LISTED = 16, 4, 1 << 17
#: Bits of the map of texts that have a pair, 64 at least. It stays this large; where it fills up, more texts travel.
MARKED = 1 << 24


def shingles(texts: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted names of each text's runs of words."""
    found = words_of([text.lower() for text in texts], NOT_SPACE)
    for low, high in zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist()):
        yield np.unique(windows(found.first[low:high], min(words, max(high - low, 1))))


def _digest(names: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(names.tobytes()), dtype=np.uint64).view(np.int64))


def prefix_length(n: int, similar: Fraction = SIMILAR) -> int:
    """How many names of a set of n hold one of every set that is similar enough, if both are in one order."""
    return n + (-n * similar.numerator // similar.denominator) + 1 if n else 0


def alike(shared, n, m, similar: Fraction = SIMILAR):
    """Whether sets of n and m names that share some are similar enough, in whole numbers."""
    return shared * (similar.denominator + similar.numerator) >= (n + m) * similar.numerator


def sets_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, the key of the row, the digest of its set, the set's size, its parities and its fingerprint."""

    def work(batch: pa.RecordBatch) -> dict:
        made = [(_digest(names), len(names), parities(names), simhash.majority(names)) for names in shingles(texts_of(batch), words)]
        return {
            **{name: batch.column(name) for name in ("doc_id", "row_id", "row_hash")},
            "node": pa.array([m[0] for m in made], pa.int64()), "n": pa.array([m[1] for m in made], pa.int64()), "bits": pa.array([m[2] for m in made], pa.binary()),
            "fp": np.array([m[3] for m in made], dtype=np.uint64).view(np.int64),
        }

    return over_batches(docs, work, "doc_id long, row_id long, row_hash long, node long, n long, bits binary, fp long", 128)


def common_names(docs: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent names of a sample of the texts, sorted, and how often each was met."""

    def work(batch: pa.RecordBatch) -> dict:
        every = [names for names in shingles(texts_of(batch), words)]
        return {"name": np.concatenate([*every, np.zeros(0, dtype=np.uint64)]).view(np.int64)}

    sample = docs.where(F.pmod("row_hash", F.lit(SAMPLE)) == 0).dropDuplicates(["row_hash"]) if SAMPLE > 1 else docs
    counts = over_batches(sample.select("text"), work, "name long", 128).groupBy("name").count().where(f"count >= {COMMON}")
    top = counts.orderBy(F.desc("count"), "name").limit(LISTED).collect()
    made = sorted((row["name"] % (1 << 64), row["count"]) for row in top)
    return np.array([m[0] for m in made], dtype=np.uint64), np.array([m[1] for m in made], dtype=np.int64)


def _met(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], words: int, similar: Fraction, bucket: int) -> DataFrame:
    """(name, u, n, v, m): pairs of sets u and v of n and m names for small buckets (name is null), and the sets of larger ones (v is null)."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, often = sent.value
        seen: set[int] = set()  # a copy in the same partition adds nothing
        for whole in batches:
            for low in range(0, whole.num_rows, 128):
                made: list[tuple[int, int, np.ndarray]] = []
                for names in shingles(texts_of(whole.slice(low, 128)), words):
                    node = _digest(names)
                    if not len(names) or node in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    if len(listed):
                        at = np.minimum(np.searchsorted(listed, names), len(listed) - 1)
                        names = names[np.argsort(np.where(listed[at] == names, often[at], 0), kind="stable")]
                    made.append((node, len(names), names[: prefix_length(len(names), similar)]))
                sizes = [len(m[2]) for m in made]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([*[m[2] for m in made], np.zeros(0, dtype=np.uint64)]).view(np.int64)),
                        pa.array(np.repeat(np.array([m[0] for m in made], dtype=np.int64), sizes)),
                        pa.array(np.repeat(np.array([m[1] for m in made], dtype=np.int32), sizes)),
                    ],
                    names=["name", "node", "n"],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64)]
        lead = None  # name, leader and its size of a large bucket that goes on
        for batch in batches:
            columns = [np.concatenate([k, batch.column(i).to_numpy().astype(np.int64)]) for i, k in enumerate(kept)]
            columns = _once(*columns)
            if lead is not None:
                more = int(np.searchsorted(columns[0], lead[0], side="right"))
                yield from _led(*(c[:more] for c in columns), *lead[1:], similar)
                columns = [c[more:] for c in columns]
            kept = columns
            if not len(columns[0]):
                continue
            lead = None
            last = int(np.searchsorted(columns[0], columns[0][-1]))  # the last bucket may go on in the next batch
            yield from _bucket_pairs(*(c[:last] for c in columns), similar, bucket)
            kept = [c[last:] for c in columns]
            if len(kept[0]) > bucket:
                lead = tuple(int(c[0]) for c in kept)
                yield from _led(*kept, *lead[1:], similar)
                kept = [c[:0] for c in kept]
        yield from _bucket_pairs(*kept, similar, bucket)

    every = docs.select("text").mapInArrow(frugal(run), "name long, node long, n int")
    dealt = every.repartition("name").sortWithinPartitions("name", "node")
    return dealt.mapInArrow(frugal(meet), "name long, u long, n long, v long, m long")


def _once(name: np.ndarray, node: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Sorted rows without repeats."""
    new = np.ones(len(name), dtype=bool)
    new[1:] = (name[1:] != name[:-1]) | (node[1:] != node[:-1])
    return [name[new], node[new], n[new]]


def _rows(*columns: np.ndarray | None) -> pa.RecordBatch:
    size = next(len(c) for c in columns if c is not None)
    return pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()) if c is None else pa.array(c) for c in columns], names=["name", "u", "n", "v", "m"])


def _led(name: np.ndarray, node: np.ndarray, n: np.ndarray, leader, leader_n, similar: Fraction) -> Iterator[pa.RecordBatch]:
    """Rows of large buckets, and the pairs of their sets with the sets that lead."""
    yield _rows(name, node, n, None, None)
    fits = alike(np.minimum(n, leader_n), n, leader_n, similar) & (node != leader)
    leader, leader_n = (np.broadcast_to(x, len(n))[fits] for x in (leader, leader_n))
    yield _rows(None, leader, leader_n, node[fits], n[fits])


def _bucket_pairs(name: np.ndarray, node: np.ndarray, n: np.ndarray, similar: Fraction, bucket: int) -> Iterator[pa.RecordBatch]:
    """Whole buckets, sorted by name and node."""
    if not len(name):
        return
    begin, end = np.searchsorted(name, name), np.searchsorted(name, name, side="right")
    large = end - begin > bucket
    if large.any():
        yield from _led(name[large], node[large], n[large], node[begin[large]], n[begin[large]], similar)
    live = np.flatnonzero((end - begin > 1) & ~large)
    for step in range(1, bucket):
        live = live[live + step < end[live]]
        if not len(live):
            break
        a, b = live, live + step
        fits = alike(np.minimum(n[a], n[b]), n[a], n[b], similar)
        a, b = a[fits], b[fits]
        yield _rows(None, node[a], n[a], node[b], n[b])


def _possible(pairs: DataFrame, marks: DataFrame, similar: Fraction) -> DataFrame:
    """(u, v) of the pairs whose sizes and parities allow the similarity."""
    left, right = (marks.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "uv")
    joined = hot_safe_join(hot_safe_join(pairs, left, ["u"]), right, ["v"])

    def work(batch: pa.RecordBatch) -> dict:
        one, two = (np.frombuffer(b"".join(batch.column(f"bits_{c}").to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1) for c in "uv")
        n, m = (batch.column(f"n_{c}").to_numpy() for c in "uv")
        keep = pa.array(alike((n + m - np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)) // 2, n, m, similar))
        return {c: batch.column(c).filter(keep) for c in "uv"}

    return stored(over_batches(joined.select("u", "v", "n_u", "n_v", "bits_u", "bits_v"), work, "u long, v long", 4096))


def _packed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row_id, row_hash, z): compressed texts of all rows whose hash is wanted, and of few others."""
    size = MARKED
    slot = F.col("row_hash").bitwiseAND(F.lit(size - 1))
    words = wanted.select(F.shiftright(slot, 6).alias("at"), F.expr("shiftleft(1L, cast(row_hash & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    marked = np.zeros(size // 64, dtype=np.uint64)
    marked[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(marked)

    def work(batch: pa.RecordBatch) -> dict:
        own = batch.column("row_hash").to_numpy() & (size - 1)
        hit = (sent.value[own >> 6] >> (own & 63).astype(np.uint64)) & np.uint64(1)
        batch = batch.filter(pa.array(hit.astype(bool)))
        squeeze = zstandard.ZstdCompressor(level=1)
        return {**{n: batch.column(n) for n in ("row_id", "row_hash")}, "z": pa.array([squeeze.compress(t) for t in texts_of(batch)], pa.binary())}

    return over_batches(docs.select("text", "row_id", "row_hash"), work, "row_id long, row_hash long, z binary")


def _contents(docs: DataFrame, prints: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, z): one compressed text of each wanted node."""
    least = prints.select("node", "row_id", "row_hash").join(wanted.distinct(), "node").groupBy("node").agg(F.min(F.struct("row_id", "row_hash")).alias("k"))
    least = written(least.select("node", "k.row_id", "k.row_hash"))
    joined = _packed(docs, least).join(least, ["row_id", "row_hash"])
    # rows that agree in id and text have the same set
    return stored(joined.select("node", "z").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, docs: DataFrame, prints: DataFrame, words: int, similar: Fraction) -> DataFrame:
    """(u, v) of the pairs that are similar enough, by whole sets; texts travel compressed, which takes less than names."""
    texts = _contents(docs, prints, pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))))
    copies = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("copies")).where("copies > 1")
    dealt = hot_safe_join(pairs, copies, ["u"], "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("copies", F.lit(1))).alias("part"))
    partners = hot_safe_join(dealt, texts.select(F.col("node").alias("v"), "z"), ["v"]).select("u", "part", F.lit(1).alias("kind"), "v", "z")
    leaders = hot_safe_join(dealt.select("u", "part").distinct(), texts.select(F.col("node").alias("u"), "z"), ["u"])
    both = leaders.select("u", "part", F.lit(0).alias("kind"), F.col("u").alias("v"), "z").unionByName(partners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, dtype=np.uint64)
        for whole in batches:
            for low in range(0, whole.num_rows, 64):
                batch = whole.slice(low, 64)
                hit = []
                for kind, names in zip(batch.column("kind").to_pylist(), shingles(unpacked(batch.column("z").to_pylist()), words)):
                    if not kind:
                        own = names
                        hit.append(False)
                        continue
                    met = np.sort(np.concatenate([own, names]))  # names are unique within a set
                    hit.append(bool(alike(int((met[1:] == met[:-1]).sum()), len(own), len(names), similar)))
                keep = pa.array(hit, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in "uv"], names=["u", "v"])

    # a set leads its partners in every partition
    return written(both.repartition("u", "part").sortWithinPartitions("u", "part", "kind").mapInArrow(frugal(run), "u long, v long"))


def by_fingerprint(marks: DataFrame) -> DataFrame:
    """(u, v): sets of one fingerprint with the smallest of them, and the smallest sets of linked fingerprints."""
    filled = marks.where("n > 0").select("fp", "node")
    least = written(filled.groupBy("fp").agg(F.min("node").alias("least")))
    same = hot_safe_join(filled, least, ["fp"]).select(F.col("node").alias("u"), F.col("least").alias("v")).where("u <> v")
    near = simhash.links(least.select("fp"))
    for end in "uv":
        near = near.join(least.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_node")), end)
    return same.unionByName(near.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")))


def _unjoined(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    for end in "uv":
        pairs = hot_safe_join(pairs, joined.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), [end], "left")
    return pairs.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v")


def links(docs: DataFrame, prints: DataFrame, words: int = WORDS, similar: Fraction = SIMILAR, bucket: int = BUCKET) -> DataFrame:
    """Links between sets that join all that are similar enough. `docs` has text and the key of the row."""
    met = stored(_met(docs, common_names(docs, words), words, similar, bucket))
    pairs = met.where("v is not null").select("u", "v").distinct()
    hot = met.where("v is null").select("name", F.col("u").alias("node"), "n")
    marks = stored(prints.select("node", "n", "bits", "fp").dropDuplicates(["node"]))
    verified = lambda some: _verified(_possible(some, marks, similar), docs, prints, words, similar)
    found = verified(by_fingerprint(marks))
    # the first round of the rest: buckets are led by their smallest node
    found = found.unionByName(verified(_unjoined(pairs, components(found))))
    for turn in range(1, ROUNDS):
        joined = components(found)
        found = joined.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        hot = _apart(hot, joined)
        if hot.isEmpty():
            return found
        # the order of sets is the same in all buckets, so buckets of one group agree on the set that leads
        lead = hot.groupBy("name").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), "node", "n", "root")).alias("lead"))
        lead = lead.select("name", F.col("lead.node").alias("u"), F.col("lead.n").alias("u_n"), F.col("lead.root").alias("u_root"))
        fits = alike(F.least("n", "u_n"), F.col("n"), F.col("u_n"), similar)
        led = hot_safe_join(hot, lead, ["name"]).where((F.col("root") != F.col("u_root")) & fits)
        found = found.unionByName(verified(led.select("u", F.col("node").alias("v")).distinct()))
    joined = components(found)
    found = joined.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    hot = _apart(hot, joined)
    if hot.isEmpty():
        return found
    return found.unionByName(verified(_across(hot, marks, similar).distinct()))


def _apart(hot: DataFrame, joined: DataFrame) -> DataFrame:
    """(name, node, n, root) of the buckets whose sets are not one component yet."""
    now = hot_safe_join(hot.select("name", "node", "n"), joined, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    now = written(now.select("name", "node", "n", "root"))
    open_ = now.groupBy("name").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("name")
    return written(hot_safe_join(now, open_, ["name"]).select("name", "node", "n", "root"))


def parities(names: np.ndarray) -> bytes:
    """One bit for each of `BITS` parts of all names: whether the set holds an odd number of them.

    Sets differ in as many names as these bits at least.
    """
    return np.packbits(np.bincount((names % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes()


def _across(now: DataFrame, marks: DataFrame, similar: Fraction) -> DataFrame:
    """(u, v): the pairs of each bucket that are not joined yet, and whose sizes and parities allow the similarity.

    A bucket of many sets is cut into parts, and each pair of parts is a tile of its own.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        of = None
        for batch in batches:
            name, tile = (batch.column(c).to_numpy() for c in ("name", "tile"))
            cuts = [0, *(np.flatnonzero((name[1:] != name[:-1]) | (tile[1:] != tile[:-1])) + 1).tolist(), len(name)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if held and of != (name[a], tile[a]):
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
                of = (name[a], tile[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        part, node, n, root = (table.column(c).to_numpy() for c in ("part", "node", "n", "root"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype=np.uint64).reshape(len(n), -1)
        one = bool((part == part[0]).all())
        # sorted by size: sets behind the first that is too large are too large as well
        end = np.searchsorted(n, n * similar.denominator // similar.numerator, side="right")
        live, step = np.arange(len(n)), 1
        while len(live := live[live + step < end[live]]):
            a, b = live, live + step
            open_ = (root[a] != root[b]) & (one | (part[a] != part[b]))
            a, b = a[open_], b[open_]
            differ = np.zeros(len(a), dtype=np.int64)
            for column in range(bits.shape[1]):
                differ += np.bitwise_count(bits[a, column] ^ bits[b, column])
            fits = alike((n[a] + n[b] - differ) // 2, n[a], n[b], similar)
            if fits.any():
                left, right = node[a[fits]], node[b[fits]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], names=["u", "v"])
            step += 1

    parts = now.groupBy("name").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"))
    joined = hot_safe_join(hot_safe_join(now, marks.select("node", "bits"), ["node"]), parts, ["name"])
    joined = joined.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    tiled = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiled = tiled.withColumn("tile", F.least("part", "other").cast("long") * F.col("parts") + F.greatest("part", "other"))
    dealt = tiled.select("name", "tile", "part", "node", "n", "root", "bits").repartition("name", "tile")
    return dealt.sortWithinPartitions("name", "tile", "n", "node").mapInArrow(frugal(meet), "u long, v long")


def keep_one(docs: DataFrame, words: int = WORDS, similar: Fraction = SIMILAR, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, unchanged: the one with the smallest doc_id (then the smallest hash of the text)."""
    source = id_and_text(docs, id_col, text_col).select("doc_id", "text", *row_key())
    prints = stored(sets_of(source, words))
    joined = components(links(source, prints, words, similar, bucket))
    rooted = prints.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return first_of_each(docs, rooted, id_col, text_col)
