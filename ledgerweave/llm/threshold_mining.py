"""Hard negatives by Fagin's threshold algorithm over sorted lists of vector components.

Vectors are integers: floor(256 * x) of each component. `candidates` packs rows into blocks of up to `BLOCK_CELLS` components; a block keeps, for each
dimension, the list of its rows in order of that component. An anchor walks all lists of a block at once, from the large end where its
own component is positive and from the small end where it is negative, and scores every row it meets by its whole inner product
(random access). The threshold, the sum over dimensions of anchor times the last component met, bounds the score of all rows it
has not met. It stops once the threshold is strictly below the score that decides: for positives that of the fifth, for negatives, window by
window, that of the tenth or the window's lower end. Kept scores go on from block to block of a task, then Spark merges the tasks' best.

Rows without a label or vector, or with a null or non-finite component, take no part, nor do those with a component so large that an inner
product may not fit 64 bits (for 64 dimensions, 2^28 / 256 and more). Shorter vectors count as if filled up with zeros. A missing
vec_id is no anchor and comes last among equal scores. Repeated rows are rows of their own: each may be an anchor, or another's positive.

Anchors reach the tasks in blocks of at most `ANCHOR_BYTES`, one pass over the candidates each; a task holds one block of candidates at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.shared import stored

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 10
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
BLOCK_CELLS, BLOCK_ROWS, ANCHOR_BYTES = 1 << 20, 1 << 14, 8 << 20
#: Rows of each list that are met in the first step; each further step meets as many as all before.
DEPTH = 64
LAST_ID = 2**63 - 1
_BLOCK = "n long, rows binary, ids binary, labels binary, components binary, orders binary"


def _numbers(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The integer components of vectors without nulls, and which rows fit."""
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = vectors.offsets.to_numpy()
    sizes = np.diff(offsets)
    whole = np.zeros((len(sizes), dims))
    if sizes.sum():
        owner = np.repeat(np.arange(len(sizes)), sizes)
        whole[owner, np.arange(offsets[0], offsets[-1]) - offsets[owner]] = values[offsets[0] : offsets[-1]]
    whole = np.floor(whole * SCALE)
    fits = (np.abs(whole) <= math.isqrt((2**63 - 1) // max(dims, 1))).all(axis=1)
    whole[~fits] = 0
    return whole.astype(np.int64), fits


def candidates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, int]:
    """One row per block, written to the shared folder, and the number of dimensions. A row's name is its place in the table."""
    vector, label = F.col(vector_col).cast("array<double>"), F.col(label_col).cast("long")
    good = label.isNotNull() & vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    shifted = F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = table.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.when(good, shifted).alias("label"), F.when(good, vector).alias("vector"))
    rows = rows.where("vector is not null and label is not null").withColumn("row", F.monotonically_increasing_id())
    dims = rows.agg(F.max(F.size("vector")).alias("n")).first()["n"] or 0
    most = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(dims, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            row, ids, labels, components = (np.concatenate(part) for part in zip(*held))
            orders = np.argsort(components, axis=0, kind="stable").astype(np.uint16)
            columns = [row, ids, labels, components, np.ascontiguousarray(orders.T)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([len(row)], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names=[c.split()[0] for c in _BLOCK.split(", ")])

        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                components, fits = _numbers(batch.column("vector"), dims)
                part = [batch.column(c).to_numpy()[fits] for c in ("row", "id", "label")] + [components[fits]]
                while len(part[0]):
                    room = most - sum(len(h[0]) for h in held)
                    held.append(tuple(c[:room] for c in part))
                    part = [c[room:] for c in part]
                    if sum(len(h[0]) for h in held) == most:
                        yield flush()
        if held:
            yield flush()

    return stored(rows.mapInArrow(run, _BLOCK)), dims


class Block:
    """Rows with their components, and the lists sorted by each component."""

    def __init__(self, row: dict, dims: int):
        n = row["n"]
        self.rows, self.ids, self.labels = (np.frombuffer(row[c], dtype=np.int64) for c in ("rows", "ids", "labels"))
        self.components = np.frombuffer(row["components"], dtype=np.int64).reshape(n, dims)
        self.orders = np.frombuffer(row["orders"], dtype=np.uint16).reshape(dims, n)
        self.n, self.largest = n, int(np.abs(self.components).max(initial=0))
        self.doubles = self.components.astype(np.float64)

    def scores(self, anchor: np.ndarray, some: np.ndarray) -> np.ndarray:
        # whole numbers below 2^53 are exact in doubles
        if self.largest * int(np.abs(anchor).max(initial=0)) * max(len(anchor), 1) < 1 << 53:
            return (self.doubles[some] @ anchor.astype(np.float64)).astype(np.int64)
        return self.components[some] @ anchor

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """Rows met for the first time with their scores, and the threshold then; None once all are met."""
        live = np.flatnonzero(anchor)
        orders, signs = self.orders[live], anchor[live] > 0
        met = np.zeros(self.n, dtype=bool)
        depth = 0
        while depth < self.n:
            upto = min(self.n, DEPTH if not depth else depth * 2)
            new = np.zeros(self.n, dtype=bool)
            if not len(live):
                upto, new[:] = self.n, True
            if upto == self.n:
                new[:] = True
            else:
                new[orders[signs, self.n - upto : self.n - depth].ravel()] = True
                new[orders[~signs, depth:upto].ravel()] = True
            some = np.flatnonzero(new & ~met)
            met |= new
            if upto == self.n:
                yield some, self.scores(anchor, some), None
                return
            last = np.where(signs, orders[:, self.n - upto], orders[:, upto - 1])
            yield some, self.scores(anchor, some), int((anchor[live] * self.components[last, live]).sum())
            depth = upto


class Best:
    """The first `most` rows by score, largest first, then by id and place."""

    def __init__(self, most: int):
        self.most, self.score, self.id, self.row = most, *(np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(self.score) == self.most:
            good = score >= self.score[-1]
            score, ids, rows = score[good], ids[good], rows[good]
        if not len(score):
            return
        score, ids, rows = (np.concatenate(pair) for pair in ((self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, -score))[: self.most]
        self.score, self.id, self.row = score[order], ids[order], rows[order]

    def closed(self, threshold: int) -> bool:
        """Whether no row that scores at most the threshold can enter."""
        return len(self.score) == self.most and threshold < int(self.score[-1])


def nearest(block: Block, anchor: np.ndarray, row: int, label: int, best: Best) -> None:
    """Positives: rows of the anchor's label but itself."""
    for some, score, threshold in block.walk(anchor):
        good = (block.labels[some] == label) & (block.rows[some] != row)
        best.add(score[good], block.ids[some[good]], block.rows[some[good]])
        if threshold is not None and best.closed(threshold):
            return


def window_of(positive: int) -> tuple[int, int]:
    """Lowest and highest score that a negative may have."""
    return -(-LOW * positive // 100), HIGH * positive // 100


def negatives(block: Block, anchor: np.ndarray, label: int, windows: list[tuple[int, int]], best: list[Best]) -> None:
    """Rows of other labels in each window."""
    open_ = [k for k, (low, high) in enumerate(windows) if low <= high]
    for some, score, threshold in block.walk(anchor):
        if not open_:
            return
        other = block.labels[some] != label
        some, score = some[other], score[other]
        for k in open_:
            good = (score >= windows[k][0]) & (score <= windows[k][1])
            best[k].add(score[good], block.ids[some[good]], block.rows[some[good]])
        if threshold is not None:
            open_ = [k for k in open_ if threshold >= windows[k][0] and not best[k].closed(threshold)]


def _anchors(blocks: DataFrame, dims: int, every: int, part: int, parts: int) -> list[tuple[int, int, int, bytes]]:
    """(row, id, label, components) of the anchors of one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                block = Block(batch.slice(at, 1).to_pylist()[0], dims)
                some = np.flatnonzero((block.ids % every == 0) & (block.ids != LAST_ID) & (block.rows % parts == part))
                columns = [pa.array(x[some]) for x in (block.rows, block.ids, block.labels)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([c.tobytes() for c in block.components[some]], pa.binary())], names=["row", "id", "label", "components"])

    return sorted(tuple(r) for r in blocks.mapInArrow(run, "row long, id long, label long, components binary").collect())


def _found(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = [np.concatenate([np.asarray(r[k], dtype=np.int64) for r in rows] or [np.zeros(0, dtype=np.int64)]) for k in range(len(names))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _best_of(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _positives(blocks: DataFrame, dims: int, anchors: list[tuple], most: int) -> DataFrame:
    """(anchor, rank, score, id, row) of each anchor's positives; `anchor` is its place in the list."""
    sent = blocks.sparkSession.sparkContext.broadcast(anchors)
    names = ["anchor", "score", "id", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(row, label, np.frombuffer(c, dtype=np.int64), Best(most)) for row, _, label, c in sent.value]
        for batch in batches:
            for at in range(batch.num_rows):
                block = Block(batch.slice(at, 1).to_pylist()[0], dims)
                for row, label, anchor, best in own:
                    nearest(block, anchor, row, label, best)
        yield _found([(np.full(len(b.score), k), b.score, b.id, b.row) for k, (*_, b) in enumerate(own)], names)

    return _best_of(blocks.mapInArrow(run, "anchor long, score long, id long, row long"), ["anchor"], most)


def _negatives(blocks: DataFrame, dims: int, anchors: list[tuple], positives: dict[int, list[int]], most: int) -> DataFrame:
    """(anchor, positive, rank, score, id, row); `positive` is its rank, from 1."""
    sent = blocks.sparkSession.sparkContext.broadcast((anchors, positives))
    names = ["anchor", "positive", "score", "id", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, scores = sent.value
        own = []
        for k, listed in scores.items():
            _, _, label, c = every[k]
            own.append((k, label, np.frombuffer(c, dtype=np.int64), [window_of(s) for s in listed], [Best(most) for _ in listed]))
        for batch in batches:
            for at in range(batch.num_rows):
                block = Block(batch.slice(at, 1).to_pylist()[0], dims)
                for _, label, anchor, windows, best in own:
                    negatives(block, anchor, label, windows, best)
        yield _found([(np.full(len(b.score), k), np.full(len(b.score), p), b.score, b.id, b.row) for k, *_, best in own for p, b in enumerate(best, 1)], names)

    return _best_of(blocks.mapInArrow(run, "anchor long, positive long, score long, id long, row long"), ["anchor", "positive"], most)


def mine(table: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives_: int = NEGATIVES, anchor_bytes: int = ANCHOR_BYTES,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the hard negatives."""
    blocks, dims = candidates(table, id_col, vector_col, label_col)
    n = blocks.agg(F.sum("n").alias("n")).first()["n"] or 0
    # ids need not be spread evenly, so all rows may be anchors in the worst case; they are counted
    count = table.where(F.col(id_col) % every == 0).count() if n else 0
    parts = max(1, -(-count * max(dims, 1) * 8 // anchor_bytes))
    spark, made = table.sparkSession, None
    for part in range(parts):
        anchors = _anchors(blocks, dims, every, part, parts)
        first = _positives(blocks, dims, anchors, positives).collect()  # a few for each anchor of the block
        scores: dict[int, list[int]] = {}
        for row in sorted(first, key=lambda r: (r["anchor"], r["rank"])):
            scores.setdefault(row["anchor"], []).append(row["score"])
        named = [(r["anchor"], r["rank"], anchors[r["anchor"]][1], None if r["id"] == LAST_ID else r["id"], r["score"]) for r in first]
        pairs = spark.createDataFrame(named, "anchor long, positive int, anchor_id long, positive_id long, positive_score long")
        found = _negatives(blocks, dims, anchors, scores, negatives_).join(F.broadcast(pairs), ["anchor", "positive"])
        found = found.select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("id") != LAST_ID, F.col("id")).alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
        found = found if parts == 1 else stored(found)
        made = found if made is None else made.unionByName(found)
    return made
