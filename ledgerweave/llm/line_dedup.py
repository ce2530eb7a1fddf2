"""Line dedup by a sharded minimal perfect hash over all distinct lines.

A line's key is the line without white space at its ends, ASCII letters in lower case. Keys of at least `least` code points lose
all their lines, except in the document with the smallest id that holds them.

1. `index`: each task merges the keys of about a million lines (name, smallest document, number of rows), then Spark deals them to
   shards by name. A shard is one row: a minimal perfect hash over its keys, and arrays by place: a 32-bit fingerprint, the count,
   and the smallest document of each key that more than one row holds. A shard has the keys of about `SHARD` bytes of text.
2. `probe`: documents send the 128-bit names of their keys, once each, to the shard of the name, where they are looked up in the arrays;
   lines never travel. Shards that more than one in `HOT` of all probes ask for (so at most `HOT` of them), and four times the average,
   are copied as often as their share demands, and their probes are dealt to the copies.
3. The first line of every key to drop goes back to its text; lines with an equal key fall with it.

Memory: a task holds one shard, or the keys of a million lines, or a slice of texts. Names are 128-bit XXH3 hashes; two keys are
taken for equal if they agree. Null and empty texts are one empty line. A missing id counts as the largest one. Rows with one id are
one document: its copies keep the same lines. Equal rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm import perfect_hash
from ledgerweave.llm.batches import over_batches, texts_of
from ledgerweave.llm.repeats import packed_texts, rows_of, unpacked
from ledgerweave.llm.shared import hot_safe_join, stored
from ledgerweave.llm.synchronise import U

LEAST = 10
#: Bytes of text whose keys make a shard; names a task merges at once; shards that probes are dealt for.
SHARD, MERGE, HOT = 4 << 20, 1 << 20, 1024
SPACE = b" \t\n\v\f\r"
_CONTINUES = bytes(range(0x80, 0xC0))
_INDEX = "shard long, n_keys long, probes long, sizes binary, levels binary, prints binary, counts binary, lows binary"


def keys_of(text: bytes) -> list[bytes]:
    return [line.strip(SPACE).lower() for line in text.split(b"\n")]


def _counts(key: bytes, least: int) -> bool:
    """Whether a key has enough code points; bytes tell in most cases."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.translate(None, _CONTINUES)) >= least)


def named_keys(text: bytes, least: int) -> dict[bytes, int]:
    """The name of each key that counts, and the first line that has it."""
    found: dict[bytes, int] = {}
    for number, key in enumerate(keys_of(text)):
        if _counts(key, least):
            found.setdefault(xxhash.xxh3_128_digest(key), number)
    return found


def _names(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _merged(first: np.ndarray, second: np.ndarray, low: np.ndarray, n: np.ndarray, ordered: bool = False) -> tuple[np.ndarray, ...]:
    """Equal names as one, with their smallest document and number of rows; `ordered` if they are sorted already."""
    if not len(first):
        return first, second, low, n
    if not ordered:
        order = np.lexsort((second, first))
        first, second, low, n = (x[order] for x in (first, second, low, n))
    new = np.ones(len(first), dtype=bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    at = np.flatnonzero(new)
    return first[at], second[at], np.minimum.reduceat(low, at), np.add.reduceat(n, at)


def _met(rows: DataFrame, least: int) -> DataFrame:
    """(first, second, low, n) of keys, merged inside each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: list[bytes] = []
        ids: list[int] = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            first, second = _names(digests)
            low = np.repeat(np.array(ids, dtype=np.int64), sizes)
            merged = _merged(first, second, low, np.ones(len(low), dtype=np.int64))
            for held in (digests, ids, sizes):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in merged], names=["first", "second", "low", "n"])

        for batch in batches:
            for text, row_id in zip(texts_of(batch), batch.column("row_id").to_pylist()):
                found = named_keys(text, least)
                digests.extend(found)
                ids.append(row_id)
                sizes.append(len(found))
                if len(digests) >= MERGE:
                    yield flush()
        yield flush()

    return rows.select("text", "row_id").mapInArrow(run, "first long, second long, low long, n long")


def _shard(shards: int):
    return F.pmod(F.col("first"), F.lit(shards)).alias("shard")


def _packed(shard: int, first: np.ndarray, second: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple:
    words, sizes = perfect_hash.build(first, second)
    at = perfect_hash.places(words, sizes, first, second)
    prints, counts, lows = np.zeros(len(at), dtype=np.uint32), np.zeros(len(at), dtype=np.uint32), np.zeros(len(at), dtype=np.int64)
    prints[at], counts[at], lows[at] = second >> U(32), np.minimum(n, 0xFFFFFFFF), low
    return (shard, len(at), int(n.sum()), *(x.tobytes() for x in (sizes, words, prints, counts, lows[counts > 1])))


def index(docs: DataFrame, least: int = LEAST, shard_bytes: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """One row per shard that has keys, written to the shared folder, and the number of shards."""
    rows = rows_of(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard_bytes))
    names = [part.split()[0] for part in _INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def close() -> pa.RecordBatch:
            made = _packed(shard, *_merged(*(np.concatenate(part) for part in zip(*held)), ordered=True))
            types = [pa.int64()] * 3 + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, types)], names=names)

        for batch in batches:
            of = batch.column("shard").to_numpy()
            columns = [batch.column(c).to_numpy() for c in ("first", "second", "low", "n")]
            columns[:2] = [c.view(U) for c in columns[:2]]
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if shard is not None and of[a] != shard:
                    yield close()
                    held = []
                shard = int(of[a])
                held.append(_merged(*(c[a:b] for c in columns), ordered=True))  # a hot key stays one row a batch
                if len(held) > 256:
                    held = [_merged(*(np.concatenate(part) for part in zip(*held)), ordered=True)]
        if held:
            yield close()

    dealt = _met(rows, least).select(_shard(shards), "first", "second", "low", "n").repartition("shard").sortWithinPartitions("shard", "first", "second")
    return stored(dealt.mapInArrow(run, _INDEX)), shards


class _Arrays:
    """A shard's arrays, ready to be probed."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        self.sizes, self.words = read("sizes", np.int64), read("levels", U)
        self.prints, self.counts, self.lows = read("prints", np.uint32), read("counts", np.uint32), read("lows", np.int64)
        self.owner = np.cumsum(self.counts > 1) - 1

    def lows_of(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which names more than one row of the index holds, and the smallest document of those."""
        at = perfect_hash.places(self.words, self.sizes, first, second)
        hit = np.flatnonzero(at >= 0)
        hit = hit[(self.prints[at[hit]] == (second[hit] >> U(32)).astype(np.uint32)) & (self.counts[at[hit]] > 1)]
        return hit, self.lows[self.owner[at[hit]]]


def _probes(rows: DataFrame, shards: int, least: int) -> DataFrame:
    """(shard, first, second, row_id, row_hash, line) of each key of each row."""

    def work(batch: pa.RecordBatch) -> dict:
        found = [named_keys(text, least) for text in texts_of(batch)]
        first, second = _names([name for f in found for name in f])
        sizes = [len(f) for f in found]
        return {
            "first": first.view(np.int64), "second": second.view(np.int64),
            **{c: np.repeat(batch.column(c).to_numpy(), sizes) for c in ("row_id", "row_hash")},
            "line": np.array([line for f in found for line in f.values()], dtype=np.int32),
        }

    made = over_batches(rows.select("text", "row_id", "row_hash"), work, "first long, second long, row_id long, row_hash long, line int")
    return made.select(_shard(shards), "*")


def probe(rows: DataFrame, indexed: DataFrame, shards: int, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """(row_id, row_hash, lines): the first line of each key that a row must drop."""
    total = indexed.agg(F.sum("probes").alias("n"), F.count(F.lit(1)).alias("shards")).first()
    most = max((total["n"] or 0) / hot, 4 * (total["n"] or 0) / max(total["shards"], 1), 1)
    copies = indexed.where(F.col("probes") > most).select("shard", F.ceil(F.col("probes") / F.lit(most)).cast("int").alias("copies"))
    copies = F.broadcast(copies.orderBy(F.desc("copies")).limit(hot))  # `most` lets no more than `hot` shards through
    salts = F.coalesce("copies", F.lit(1))
    asked = _probes(rows, shards, least).join(copies, "shard", "left").withColumn("salt", F.pmod(F.xxhash64("row_id", "row_hash"), salts).cast("int"))
    arrays = indexed.join(copies, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    asked = asked.select("shard", "salt", F.lit(1).alias("kind"), "first", "second", "row_id", "row_hash", "line")
    arrays = arrays.select("shard", "salt", F.lit(0).alias("kind"), "sizes", "levels", "prints", "counts", "lows")
    both = arrays.unionByName(asked, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, of = None, None
        for batch in batches:
            kind, shard = batch.column("kind").to_numpy(), batch.column("shard").to_numpy()
            own = shard * 2 + (1 - kind)  # an array row starts a stretch of its own
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(kind)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if kind[a] == 0:
                    # copies of one shard may follow each other where it has no probes
                    arrays, of = _Arrays(batch.slice(a, 1).to_pylist()[0]), shard[a]
                    continue
                if of != shard[a]:
                    continue  # the index has no key of this shard
                part = batch.slice(a, b - a)
                first, second, row_id, row_hash, line = (part.column(c).to_numpy() for c in ("first", "second", "row_id", "row_hash", "line"))
                hit, low = arrays.lows_of(first.view(U), second.view(U))
                hit = hit[low < row_id[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(c[hit]) for c in (row_id, row_hash, line)], names=["row_id", "row_hash", "line"])

    hits = both.mapInArrow(run, "row_id long, row_hash long, line int").distinct()
    return hits.groupBy("row_id", "row_hash").agg(F.collect_list("line").alias("lines"))


def remove(docs: DataFrame, least: int = LEAST, shard_bytes: int = SHARD, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its lines, those dropped, and the text that is left."""
    rows = rows_of(docs, id_col, text_col)
    indexed, shards = index(docs, least, shard_bytes, id_col, text_col)
    dropped = stored(probe(rows, indexed, shards, least, hot))
    joined = hot_safe_join(packed_texts(rows), dropped, ["row_id", "row_hash"], "left")

    def work(batch: pa.RecordBatch) -> dict:
        lines, gone, kept = [], [], []
        for text, numbers in zip(unpacked(batch.column("z").to_pylist()), batch.column("lines").to_pylist()):
            every = text.split(b"\n")
            left = every
            if numbers:
                fall = {every[k].strip(SPACE).lower() for k in numbers}
                left = [line for line in every if line.strip(SPACE).lower() not in fall]
            lines.append(len(every))
            gone.append(len(every) - len(left))
            kept.append(b"\n".join(left).decode("utf-8", "replace"))
        return {"doc_id": batch.column("doc_id"), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.string())}

    return over_batches(joined.select("doc_id", "z", "lines"), work, "doc_id long, n_lines long, n_dropped long, kept string")
