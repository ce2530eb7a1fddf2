"""Ranked lexical search over bit-sliced Bloom signatures: bounds first, exact scores for all that the bounds cannot exclude.

1. `signatures` indexes documents without regard to any query. Documents of like size form a block: a bit matrix with a column for each
   document, in which a term sets `PROBES` rows, and sets them again under another hash for each of `LEVELS` that its frequency reaches.
   Ands of rows are bitmaps that hold every document with the term (or level), and a few more.
2. `bounds` sums the bitmaps, as slices weighted by what a level adds to the score. No document scores more than its sum. The documents
   with the highest sums are scored exactly, and the score at rank `top` becomes an item's threshold.
3. Every document whose sum reaches the threshold of an item is scored exactly, on its whole text; the best go to the result.

The score of a document is the sum over an item's distinct terms of weight * ((10^9 * tf) div (1000 * tf + 20 * m)), where
weight = floor(1000 * ln((2N + 2) / (2 df + 1))) and m = 50 + (50 * n * N) div L; N, L and df are counted over all documents.

Items are taken in blocks of at most `ITEMS` and of `ITEM_BYTES` of text, one pass over the signatures each. A missing document id comes last
among equal scores, a null text has no terms; items without terms, or whose terms no document has, give no rows. Rows that
agree in id and text rank as rows of their own; repeated items give repeated results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.batches import over_batches, texts_of
from ledgerweave.llm.repeats import rows_of
from ledgerweave.llm.shared import hot_safe_join, stored
from ledgerweave.llm.synchronise import U, mix
from ledgerweave.llm.words import ALPHANUMERIC, words_of

TOP, PROBES = 50, 3
#: A term's bits are set for each of these frequencies that it reaches.
LEVELS = (1, 2, 3, 4, 5, 6, 8, 12, 16, 24, 32, 64, 128)
#: Bits a document has for each of its entries; bits of a block; documents a task looks at together, and bytes of their texts.
ROOM, BLOCK_BITS, ROWS, BYTES = 8, 1 << 24, 512, 4 << 20
ITEMS, ITEM_BYTES = 256, 1 << 20
#: Up to so many candidates are sent to all tasks; more are joined.
SENT = 100_000
_UPPER = bytes(range(0x41, 0x5B))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())


def terms_of(texts: list[bytes]):
    """Names of the terms of all texts."""
    return words_of([t.translate(_FOLD) for t in texts], ALPHANUMERIC)


def _parts(text: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about `size` bytes, cut behind terms."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and ALPHANUMERIC[_FOLD[text[cut]]]:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def entries(texts: list[bytes], size: int = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, frequency) of the distinct terms of up to 512 texts, and the number of terms of each text.

    Two terms of a text whose 55-bit hashes agree count as one with both frequencies, which is a bound still.
    """
    total = np.zeros(len(texts), dtype=np.int64)
    codes, counts = [], []
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        found = terms_of([part for _, part in held])
        owners = np.array([owner for owner, _ in held], dtype=np.int64)
        np.add.at(total, owners, found.counts())
        code, count = np.unique((found.first & ~U(511)) | owners[found.owner()].astype(U), return_counts=True)
        codes.append(code)
        counts.append(count)
        held.clear()

    waiting = 0
    for owner, text in enumerate(texts):
        for part in _parts(text, size):
            held.append((owner, part))
            waiting += len(part)
            if waiting >= size:
                flush()
                waiting = 0
    flush()
    if len(codes) == 1:
        code, count = codes[0], counts[0]
    else:
        code, where = np.unique(np.concatenate(codes), return_inverse=True)
        count = np.bincount(where, np.concatenate(counts), minlength=len(code)).astype(np.int64)
    return (code & U(511)).astype(np.int64), code & ~U(511), count, total


def rows_for(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """The rows that a term sets for a level: one column for each probe."""
    salts = np.array([((level * PROBES + probe + 1) * 0x9E3779B97F4A7C15) % (1 << 64) for probe in range(PROBES)], dtype=U)
    return (mix(hashes[:, None] + salts[None, :]) & U(width - 1)).astype(np.int64)


def _blocks(owner: np.ndarray, hashes: np.ndarray, frequency: np.ndarray, documents: int) -> Iterator[tuple[np.ndarray, int, bytes]]:
    """(documents, width, bits) of blocks of documents of like size."""
    reached = np.searchsorted(np.array(LEVELS), frequency, side="right")
    size = np.bincount(owner, reached, minlength=documents).astype(np.int64)
    widths = 1 << np.ceil(np.log2(np.maximum(size * ROOM, 64))).astype(np.int64)
    for width in np.unique(widths).tolist():
        members = np.flatnonzero(widths == width)
        step = max(8, min(ROWS, BLOCK_BITS // width) // 8 * 8)
        for low in range(0, len(members), step):
            block = members[low : low + step]
            column = np.full(documents, -1, dtype=np.int64)
            column[block] = np.arange(len(block))
            mine = np.flatnonzero(column[owner] >= 0)
            columns = -(-len(block) // 8) * 8
            bits = np.zeros((width, columns), dtype=bool)
            for level in range(len(LEVELS)):
                mine = mine[reached[mine] > level]
                if not len(mine):
                    break
                rows = rows_for(hashes[mine], level, width)
                bits[rows, column[owner[mine]][:, None]] = True
            yield block, width, np.packbits(bits, axis=1, bitorder="little").tobytes()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block of documents: their keys, numbers of terms, and the bit matrix; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                owner, hashes, frequency, total = entries(texts_of(batch))
                row_id, row_hash = (batch.column(c).to_numpy() for c in ("row_id", "row_hash"))
                for block, width, bits in _blocks(owner, hashes, frequency, batch.num_rows):
                    columns = [pa.array([v], pa.binary()) for v in (row_id[block].tobytes(), row_hash[block].tobytes(), total[block].tobytes(), bits)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([width], pa.int64())], names=["row_ids", "row_hashes", "sizes", "bits", "width"])

    rows = rows_of(docs, id_col, text_col).select("text", "row_id", "row_hash")
    return stored(rows.mapInArrow(run, "row_ids binary, row_hashes binary, sizes binary, bits binary, width long"))


@dataclass
class Items:
    """A block of items as arrays: terms by name, and the weight of each pair of an item and one of its terms."""

    ids: list
    first: np.ndarray
    second: np.ndarray
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray | None = None
    documents: int = 0
    length: int = 0

    def matrix(self, kind) -> np.ndarray:
        made = np.zeros((len(self.ids), len(self.first)), dtype=kind)
        made[self.item, self.term] = self.weight
        return made

    def most(self) -> int:
        return int(np.bincount(self.item, self.weight, minlength=1).max()) if len(self.item) else 0

    def norm(self, sizes: np.ndarray) -> np.ndarray:
        """m of documents of so many terms."""
        if self.documents * int(sizes.max(initial=0)) < 1 << 56:
            return 50 + (50 * sizes * self.documents) // max(self.length, 1)
        return np.array([50 + (50 * n * self.documents) // max(self.length, 1) for n in sizes.tolist()], dtype=np.int64)


def items_of(rows: list[tuple]) -> Items:
    """Items of (id, text)."""
    found = terms_of([(text or "").encode() for _, text in rows])
    pairs = np.unique(np.stack([found.first, found.second], axis=1), axis=0) if len(found.first) else np.zeros((0, 2), dtype=U)
    first, second = pairs[:, 0].copy(), pairs[:, 1].copy()
    at = _lookup(first, second, found.first, found.second)
    both = np.unique(np.stack([found.owner(), at], axis=1), axis=0) if len(at) else np.zeros((0, 2), dtype=np.int64)
    return Items([i for i, _ in rows], first, second, both[:, 0], both[:, 1])


def _lookup(first: np.ndarray, second: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The place of each name among sorted ones, or -1."""
    out = np.full(len(one), -1, dtype=np.int64)
    if not len(first):
        return out
    # equal first halves are rare: step over them
    at = np.searchsorted(first, one)
    live = np.flatnonzero((at < len(first)) & (first[np.minimum(at, len(first) - 1)] == one))
    at = at[live]
    while len(live):
        same = second[at] == two[live]
        out[live[same]] = at[same]
        live, at = live[~same], at[~same] + 1
        on = at < len(first)
        live, at = live[on], at[on]
        on = first[at] == one[live]
        live, at = live[on], at[on]
    return out


def _sent(df: DataFrame, **values):
    return df.sparkSession.sparkContext.broadcast(values)


def with_statistics(items: Items, docs: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Items:
    """Items with the weights of their terms, from counts over all documents. Every task sends one row per term it has met."""
    sent = _sent(docs, first=items.first, second=items.second)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = sent.value["first"], sent.value["second"]
        total = np.zeros(len(first), dtype=np.int64)
        for whole in batches:
            for low in range(0, whole.num_rows, 64):
                texts = texts_of(whole.slice(low, 64))
                owners, terms = [], []
                for owner, text in enumerate(texts):
                    for part in _parts(text, BYTES):
                        owners.append(owner)
                        terms.append(part)
                found = terms_of(terms)
                at = _lookup(first, second, found.first, found.second)
                hit = np.flatnonzero(at >= 0)
                owner = np.array(owners, dtype=np.int64)[found.owner()[hit]]
                total += np.bincount(np.unique(at[hit] * 64 + owner) // 64, minlength=len(first))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["term", "n"])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = length = 0
        for batch in batches:
            every = np.frombuffer(b"".join(batch.column("sizes").to_pylist()), dtype=np.int64)
            n, length = n + int((every > 0).sum()), length + int(every.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([length], pa.int64())], names=["n", "length"])

    whole = index.select("sizes").mapInArrow(sizes, "n long, length long").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
    held = np.zeros(len(items.first), dtype=np.int64)
    for row in rows_of(docs, id_col, text_col).select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        held[row["term"]] = row["n"]
    items.documents, items.length = whole["n"] or 0, whole["length"] or 0
    of_term = np.array([math.floor(1000 * math.log((2 * items.documents + 2) / (2 * df + 1))) for df in held.tolist()], dtype=np.int64)
    items.weight = of_term[items.term]
    return items


def part_of_score(frequency, norm):
    """What a term adds to a document's score for each unit of weight."""
    return (1_000_000_000 * frequency) // (1000 * frequency + 20 * norm)


class _Bounds:
    """Weighted sums of slices: an upper bound for each item and document of a block."""

    def __init__(self, items: Items):
        self.items = items
        self.weights = items.matrix(np.float32 if items.most() < 1 << 24 else np.float64)

    def of(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row_id, row_hash, sizes = (np.frombuffer(row[c], dtype=np.int64) for c in ("row_ids", "row_hashes", "sizes"))
        width, n = row["width"], len(row_id)
        bits = np.frombuffer(row["bits"], dtype=np.uint8).reshape(width, -1)
        norm = self.items.norm(sizes)
        bound = np.zeros((len(self.items.ids), n))
        terms, before, under = np.arange(len(self.items.first)), None, np.zeros(n, dtype=np.int64)
        hashes = self.items.first & ~U(511)
        for level in range(len(LEVELS)):
            rows = rows_for(hashes[terms], level, width)
            held = np.bitwise_and.reduce(bits[rows], axis=1)
            if before is not None:
                held &= before
            some = held.any(axis=1)
            terms, before = terms[some], held[some]
            if not len(terms):
                break
            most = part_of_score(LEVELS[level + 1] - 1, norm) if level + 1 < len(LEVELS) else np.full(n, 1_000_000)
            slices = np.unpackbits(before, axis=1, count=n, bitorder="little").astype(self.weights.dtype)
            bound += (self.weights[:, terms] @ slices).astype(np.float64) * (most - under)
            under = most
        return row_id, row_hash, bound


def _highest(index: DataFrame, items: Items, top: int) -> DataFrame:
    """(item, bound, row_id, row_hash): documents with the highest sums of each item; every task sends its own `top` of each."""
    sent = _sent(index, items=vars(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Bounds(Items(**sent.value["items"]))
        q = len(sums.items.ids)
        best = [np.zeros((q, 0)), np.zeros((q, 0), dtype=np.int64), np.zeros((q, 0), dtype=np.int64)]
        for batch in batches:
            for at in range(batch.num_rows):
                row_id, row_hash, bound = sums.of(batch.slice(at, 1).to_pylist()[0])
                both = [np.concatenate([b, np.broadcast_to(new, (q, len(row_id)))], axis=1) for b, new in zip(best, (bound, row_id, row_hash))]
                if both[0].shape[1] > top:
                    take = np.argpartition(-both[0], top - 1, axis=1)[:, :top]
                    both = [np.take_along_axis(b, take, axis=1) for b in both]
                best = both
        item, place = np.nonzero(best[0] > 0)
        columns = [pa.array(item), *(pa.array(b[item, place]) for b in best)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "bound", "row_id", "row_hash"])

    made = index.mapInArrow(run, "item long, bound double, row_id long, row_hash long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "row_id", "row_hash")
    return made.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top).drop("k")


def _not_excluded(index: DataFrame, items: Items, least: np.ndarray) -> DataFrame:
    """(row_id, row_hash, wanted) of the documents whose sum reaches the threshold of an item; `wanted` has a bit for each item."""
    sent = _sent(index, items=vars(items), least=least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Bounds(Items(**sent.value["items"]))
        for batch in batches:
            for at in range(batch.num_rows):
                row_id, row_hash, bound = sums.of(batch.slice(at, 1).to_pylist()[0])
                open_ = bound >= sent.value["least"][:, None]
                some = np.flatnonzero(open_.any(axis=0))
                wanted = np.packbits(open_[:, some].T, axis=1, bitorder="little")
                columns = [pa.array(row_id[some]), pa.array(row_hash[some]), pa.array([w.tobytes() for w in wanted], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["row_id", "row_hash", "wanted"])

    # rows that agree in id and text score the same, so the bits of one stand for all
    return index.mapInArrow(run, "row_id long, row_hash long, wanted binary").dropDuplicates(["row_id", "row_hash"])


def _scored(docs: DataFrame, wanted: DataFrame, items: Items, least: np.ndarray, id_col: str, text_col: str, few: bool = False) -> DataFrame:
    """(item, doc_id, row_id, score) of wanted items and documents with at least the threshold, on whole texts.

    `few` says that the number of items bounds the wanted rows, whatever the number of documents.
    """
    wanted = stored(wanted)
    rows, keys = rows_of(docs, id_col, text_col), ["row_id", "row_hash"]
    # one way for all sizes: a broadcast that gives way to a shuffle of texts would make disk jump as tables grow
    joined = rows.join(F.broadcast(wanted), keys) if few else hot_safe_join(rows, wanted.hint("merge"), keys)
    sent = _sent(docs, items=vars(items), least=least)

    def work(batch: pa.RecordBatch) -> dict:
        own = Items(**sent.value["items"])
        owners, parts = [], []
        for owner, text in enumerate(texts_of(batch)):
            for part in _parts(text, BYTES):
                owners.append(owner)
                parts.append(part)
        found = terms_of(parts)
        owner = np.array(owners, dtype=np.int64)
        n, q, t = batch.num_rows, len(own.ids), len(own.first)
        sizes = np.bincount(owner, found.counts(), minlength=n).astype(np.int64)
        at = _lookup(own.first, own.second, found.first, found.second)
        hit = np.flatnonzero(at >= 0)
        frequency = np.bincount(at[hit] * n + owner[found.owner()[hit]], minlength=t * n).reshape(t, n)
        # whole numbers below 2^53 are exact in doubles
        kind = np.float64 if own.most() * 1_000_000 < 1 << 53 else np.int64
        score = (own.matrix(kind) @ part_of_score(frequency, own.norm(sizes)).astype(kind)).astype(np.int64)
        bits = np.frombuffer(b"".join(batch.column("wanted").to_pylist()), dtype=np.uint8).reshape(n, -1)
        open_ = np.unpackbits(bits, axis=1, count=q, bitorder="little").T.astype(bool)
        item, place = np.nonzero(open_ & (score >= sent.value["least"][:, None]))
        return {"item": pa.array(item), "doc_id": batch.column("doc_id").take(pa.array(place)), "row_id": batch.column("row_id").take(pa.array(place)), "score": pa.array(score[item, place])}

    return over_batches(joined.select("doc_id", "text", "row_id", "wanted"), work, "item long, doc_id long, row_id long, score long", 128)


def _best(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "row_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search_block(items: Items, docs: DataFrame, index: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item, rank, doc_id, score) for one block of items; `item` is its place in the block."""
    items = with_statistics(items, docs, index, id_col, text_col)
    every, least = len(items.ids), np.ones(len(items.ids), dtype=np.int64)
    first = _highest(index, items, top).groupBy("row_id", "row_hash").agg(F.collect_set("item").alias("listed"))
    # all items of the documents taken are scored; more scores only raise the threshold
    everyone = F.lit(np.packbits(np.ones(every, dtype=bool), bitorder="little").tobytes())
    tried = _best(_scored(docs, first.select("row_id", "row_hash", everyone.alias("wanted")), items, least, id_col, text_col, few=every * top <= SENT), top)
    for row in tried.where(F.col("rank") == top).select("item", "score").collect():
        least[row["item"]] = row["score"]
    return _best(_scored(docs, _not_excluded(index, items, least), items, least, id_col, text_col), top).select("item", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, index: DataFrame | None = None, item_col: str = "item_id", query_col: str = "text",
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the best documents for each item. `index` is what `signatures(docs)` gave, else it is made."""
    asked = queries.select(F.col(item_col).alias("item_id"), F.col(query_col).cast("string").alias("text"))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // ITEMS), -(-size["bytes"] // ITEM_BYTES))
    index = signatures(docs, id_col, text_col) if index is None else index
    deal = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(blocks))
    made = None
    for block in range(blocks):
        rows = [(row["item_id"], row["text"]) for row in asked.where(deal == block).collect()]
        names = docs.sparkSession.createDataFrame([(k, i) for k, (i, _) in enumerate(rows)], f"item long, item_id {asked.schema['item_id'].dataType.simpleString()}")
        found = search_block(items_of(rows), docs, index, top, id_col, text_col) if rows else docs.sparkSession.createDataFrame([], "item long, rank int, doc_id long, score long")
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = found if blocks == 1 else stored(found)
        made = found if made is None else made.unionByName(found)
    return made
