"""Benchmark decontamination with an FM-index per shard of training texts.

Each slice of documents is one shard. Its words are numbered by the benchmark's vocabulary; a word outside it, or a pair of
neighbours that no benchmark text has, cannot lie inside an occurrence, so the shard's sequence keeps only the runs
between such places that are long enough for a window, with a separator behind each. The shard is indexed by its suffix
order: the last column in a wavelet matrix, first-column counts, and every eighth text position sampled. All
benchmark windows are searched backwards at once through the matrix's ranks; their occurrences are located by
walking to sampled positions and merged into removal spans.

The benchmark is sent to the tasks in blocks of a checked size, one pass over the documents for each block. Null texts
have no words; an item without words has no window; repeated items count once per id; a null id is written as an empty
text. Repeated documents give repeated rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.batches import free_name, frugal, id_and_text, over_batches, row_key, texts_of
from ledgerweave.llm.shared import stored
from ledgerweave.llm.tokens import spread
from ledgerweave.llm.words import ALPHANUMERIC, Words, words_of

WINDOW = 13
#: Most bytes of benchmark text in one block.
BLOCK_BYTES = 16 << 20
SAMPLE = 8
SHARD_ROWS = 1024


class FmIndex:
    """Suffix order of a sequence of symbols 1 .. sigma - 1, with an end of its own, symbol 0, behind it."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        sequence = np.append(sequence, 0)
        self.n = n = len(sequence)
        rank, width = np.unique(sequence, return_inverse=True)[1].astype(np.int64), 1
        while True:  # doubling: ranks of 2 * width symbols from pairs of ranks of width
            after = np.full(n, -1, dtype=np.int64)
            after[: n - width] = rank[width:] if width < n else 0
            pair = rank * (n + 1) + after + 1
            order = np.argsort(pair, kind="stable")
            new = np.empty(n, dtype=np.int64)
            new[order] = np.concatenate([[0], np.cumsum(pair[order][1:] != pair[order][:-1])])
            rank, width = new, width * 2
            if width >= n or rank[order[-1]] == n - 1:
                break
        last = sequence[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=sigma))])
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        column = last.astype(np.int64)
        for level in reversed(range(self.levels)):
            bit = (column >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            column = np.concatenate([column[bit == 0], column[bit == 1]])
        self.sampled = order % SAMPLE == 0
        self.sampled_before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before a place of the last column."""
        start = np.zeros_like(at)
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            one_at, one_start = self.ones[k][at], self.ones[k][start]
            at = np.where(bit == 1, self.zeros[k] + one_at, at - one_at)
            start = np.where(bit == 1, self.zeros[k] + one_start, start - one_start)
        return at - start

    def step(self, at: np.ndarray) -> np.ndarray:
        """The row whose suffix is one symbol longer."""
        symbol, place = np.zeros_like(at), at.copy()
        start = np.zeros_like(at)
        for k in range(self.levels):
            one = self.ones[k][place]
            bit = self.ones[k][place + 1] - one
            one_start = self.ones[k][start]
            symbol = symbol * 2 + bit
            place = np.where(bit == 1, self.zeros[k] + one, place - one)
            start = np.where(bit == 1, self.zeros[k] + one_start, start - one_start)
        return self.before[symbol] + place - start

    def search(self, patterns: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows low .. high of the suffixes that begin with each pattern (rows of symbols, padded at the end)."""
        low, high = np.zeros(len(size), dtype=np.int64), np.full(len(size), self.n, dtype=np.int64)
        for back in range(1, int(size.max(initial=0)) + 1):
            live = np.flatnonzero((size >= back) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, size[live] - back].astype(np.int64)
            base = self.before[symbol]
            low[live], high[live] = base + self.rank(symbol, low[live]), base + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps to the next sampled position."""
        place, steps = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        live, at = np.arange(len(rows)), rows.copy()
        while len(live):
            hit = self.sampled[at]
            place[live[hit]] = self.samples[self.sampled_before[at[hit]]] + steps[live[hit]]
            live, at = live[~hit], at[~hit]
            steps[live] += 1
            at = self.step(at)
        return place


@dataclass
class Benchmark:
    """Windows of a block of items over the block's vocabulary (numbers from 2; 1 separates runs, 0 is no word of it)."""

    first: np.ndarray
    second: np.ndarray
    number: np.ndarray
    pairs: np.ndarray
    patterns: np.ndarray
    size: np.ndarray
    items: list[list[str]]

    @property
    def sigma(self) -> int:
        return len(self.first) + 2

    def numbers(self, words: Words) -> np.ndarray:
        """The vocabulary's number of each word, 0 if it has none."""
        place = np.minimum(np.searchsorted(self.first, words.first), len(self.first) - 1)
        return np.where((self.first[place] == words.first) & (self.second[place] == words.second), self.number[place], 0)


def prepare(items: list[tuple[str, bytes]], window: int = WINDOW) -> Benchmark | None:
    """None if no item has a word."""
    words = words_of([text.lower() for _, text in items], ALPHANUMERIC)
    if not len(words.first):
        return None
    first, pick, number = np.unique(words.first, return_index=True, return_inverse=True)
    number = number + 2
    found: dict[tuple[int, ...], set[str]] = {}
    for k, (name, _) in enumerate(items):
        own = number[words.offsets[k] : words.offsets[k + 1]].tolist()
        for at in range(max(1, len(own) - window + 1) if own else 0):
            found.setdefault(tuple(own[at : at + window]), set()).add(name)
    patterns = np.zeros((len(found), window), dtype=np.int32)
    for row, phrase in enumerate(found):
        patterns[row, : len(phrase)] = phrase
    owner, sigma = words.owner(), len(first) + 2
    joint = owner[1:] == owner[:-1]
    return Benchmark(
        first, words.second[pick], np.arange(2, sigma), np.unique((number[:-1] * sigma + number[1:])[joint]), patterns,
        np.array([len(p) for p in found]), [sorted(names) for names in found.values()],
    )


def occurrences(words: Words, benchmark: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """Each occurrence of a window in a shard: the word it begins at, and the window."""
    none = np.zeros(0, dtype=np.int64)
    number = benchmark.numbers(words)
    owner = words.owner()
    known = np.flatnonzero((number[:-1] > 0) & (number[1:] > 0) & (owner[:-1] == owner[1:]))
    pair = number[known] * benchmark.sigma + number[known + 1]
    place = np.minimum(np.searchsorted(benchmark.pairs, pair), len(benchmark.pairs) - 1) if len(benchmark.pairs) else None
    linked = np.zeros(len(number) + 1, dtype=bool)  # this word and the next may stand inside an occurrence
    if place is not None:
        linked[known[benchmark.pairs[place] == pair]] = True
    # runs of words linked to each other, and whether they are long enough
    begins = np.flatnonzero((number > 0) & ~np.concatenate([[False], linked[: len(number) - 1]])) if len(number) else none
    ends = np.flatnonzero((number > 0) & ~linked[: len(number)]) + 1
    long = ends - begins >= benchmark.size.min()
    begins, ends = begins[long], ends[long]
    if not len(begins):
        return none, none
    size = ends - begins + 1
    at = spread(begins, size)  # each run and the separator behind it
    sequence = np.where(at == np.repeat(ends, size), 1, number[np.minimum(at, len(number) - 1)])
    index = FmIndex(sequence, benchmark.sigma)
    low, high = index.search(benchmark.patterns, benchmark.size)
    rows = spread(low, np.maximum(high - low, 0))
    return at[index.locate(rows)], np.repeat(np.arange(len(low)), np.maximum(high - low, 0))


def hits(texts: list[bytes], benchmark: Benchmark | None) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Words of each text, its merged spans of words inside occurrences, and the items that occur."""
    words = words_of([text.lower() for text in texts], ALPHANUMERIC)
    counts = words.counts()
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if benchmark is None or not len(words.first):
        return counts, spans, items
    start, window = occurrences(words, benchmark)
    if len(start):
        change = np.zeros(len(words.first) + 1, dtype=np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + benchmark.size[window], -1)
        inside = np.cumsum(change[:-1]) > 0
        owner = words.owner()
        here = np.flatnonzero(inside)
        new = np.concatenate([[True], (np.diff(here) > 1) | (np.diff(owner[here]) > 0)])
        firsts, lasts = here[new], here[np.append(np.flatnonzero(new)[1:] - 1, len(here) - 1)]
        for a, b in zip(firsts.tolist(), lasts.tolist()):
            spans[owner[a]].append((int(a - words.offsets[owner[a]]), int(b + 1 - words.offsets[owner[a]])))
        sets: dict[int, set[str]] = {}
        for text, w in set(zip(owner[start].tolist(), window.tolist())):
            sets.setdefault(text, set()).update(benchmark.items[w])
        for text, names in sets.items():
            items[text] = sorted(names)
    return counts, spans, items


@dataclass
class Blocks:
    """A benchmark cut into blocks, none of which holds much more than `block_bytes` of text (one item at least)."""

    source: DataFrame
    count: int
    window: int

    def __getitem__(self, block: int) -> Benchmark | None:
        """Collect and prepare one block."""
        part = self.source.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.count)) == block)
        return prepare([(row["item"], row["text"].encode()) for row in part.collect()], self.window)


def blocks_of(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "item_id", text_col: str = "text") -> Blocks:
    source = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = source.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return Blocks(source, -(-total // block_bytes) or 1, window)


_SPANS = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _send(df: DataFrame, block: Benchmark | None):
    """A function that gives the block inside tasks; its fields are broadcast as plain values."""
    sent = df.sparkSession.sparkContext.broadcast(None if block is None else vars(block))
    return lambda: None if sent.value is None else Benchmark(**sent.value)


def _one_block(source: DataFrame, block: Benchmark | None, keyed: bool) -> DataFrame:
    sent = _send(source, block)
    names = ["doc_id", "row_id", "row_hash"] if keyed else ["doc_id"]

    def work(batch: pa.RecordBatch) -> dict:
        counts, spans, items = hits(texts_of(batch), sent())
        listed = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return {**{n: batch.column(n) for n in names}, "n_words": counts, "spans": listed, "items": pa.array(items, pa.list_(pa.string()))}

    return over_batches(source, work, ", ".join(f"{n} long" for n in names) + ", " + _SPANS, SHARD_ROWS)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: words, merged spans of hit words, and the ids of the items that occur."""
    source, blocks = id_and_text(docs, id_col, text_col), blocks_of(benchmark, window, block_bytes)
    if blocks.count == 1:
        return _one_block(source, blocks[0], False)
    # one pass for each block; its rows are written, so the driver holds one block at a time
    source = source.select("doc_id", "text", *row_key())
    parts = [stored(_one_block(source, blocks[k], True)) for k in range(blocks.count)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # rows that agree in id and text agree in all that is found, so one of each block stands for them
    merged = every.groupBy("row_id", "row_hash").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        (F.count(F.lit(1)) / len(parts)).cast("int").alias("copies"),
    )
    joined = F.expr(
        "aggregate(spans, cast(array() as array<struct<start:long,end:long>>), (a, s) -> if(size(a) > 0 and a[size(a) - 1].end >= s.start, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', greatest(a[size(a) - 1].end, s.end)))), concat(a, array(s))))"
    )
    return merged.select("doc_id", "n_words", joined.alias("spans"), "items", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def contaminated(n_hit, n_words):
    """A twentieth of the words or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest(found: DataFrame) -> DataFrame:
    """Counts, a digest of the items and the verdict, from the rows of `find`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans").select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows whose texts are not contaminated, unchanged. Several blocks add up only inside `find`; then it decides."""
    blocks, names = blocks_of(benchmark, window, block_bytes), docs.columns
    if blocks.count > 1:
        id_col = "doc_id"
        bad = find(docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(id_col), text_col), benchmark, window, id_col, text_col, block_bytes)
        name = free_name(names, "_hash")
        bad = digest(bad).where("contaminated").select(F.col(id_col).alias(name)).distinct()
        return docs.join(bad, F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == bad[name], "left_anti")
    sent = _send(docs, blocks[0])

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, SHARD_ROWS):
                batch = whole.slice(low, SHARD_ROWS)
                texts = [t or b"" for t in batch.column(names.index(text_col)).cast(pa.binary()).to_pylist()]
                counts, spans, _ = hits(texts, sent())
                n_hit = np.array([sum(b - a for a, b in s) for s in spans], dtype=np.int64)
                yield batch.filter(pa.array(~contaminated(n_hit, counts)))

    return docs.mapInArrow(frugal(run), docs.schema)
