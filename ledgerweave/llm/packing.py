"""Best-fit packing with certified bin counts.

Documents become token ids followed by an end id; only those longer than a sequence are cut. Pieces are dealt at random to
partitions, and each partition packs its own by best-fit decreasing. Dual-feasible functions give every partition
a lower bound on its bins: a partition that meets it is certified. Sequences that are exactly full are final.
The pieces of all others are exchanged: dealt anew to fewer partitions, mixed with those of other partitions, and
packed again, as long as the whole is not certified (total bins = bound of the whole) and a round still saves a sequence.

Null texts are empty documents: one piece, the end id. Repeated rows are pieces of their own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.batches import id_and_text, over_batches, texts_of
from ledgerweave.llm.shared import written
from ledgerweave.llm.tokens import word_bpe

VOCABULARY, CAPACITY, END_ID = "word_bpe_49k.json", 2048, 0
#: Pieces that a task packs at once.
GROUP = 20_000
PIECE_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document's ids before it, its length and a checksum of its ids."""

    def work(batch: pa.RecordBatch) -> dict:
        ids, ends = word_bpe(vocabulary).by_text(texts_of(batch))
        out: dict[str, list] = {name: [] for name in PIECE_COLUMNS}
        for doc, low, high in zip(batch.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
            own = np.append(ids[low:high], np.uint32(end_id)).astype("<u4")
            for k, start in enumerate(range(0, len(own), capacity)):
                part = own[start : start + capacity]
                for name, value in zip(PIECE_COLUMNS, (doc, k, start, len(part), zlib.crc32(part.tobytes()))):
                    out[name].append(value)
        types = {"piece": pa.int32()}
        return {name: pa.array(values, types.get(name, pa.int64())) for name, values in out.items()}

    return over_batches(id_and_text(docs, id_col, text_col), work, _PIECE, 1024)


def bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The largest lower bound on the bins among families of dual-feasible functions.

    `sizes` are distinct, `counts` says how many items have each. A dual-feasible function f keeps the sum of f over any
    bin at most 1, so the sum over all items bounds the bins. Numbers are scaled to integers, so rounding is exact.
    """
    if not len(sizes):
        return 0
    x, n = sizes.astype(np.int64), counts.astype(np.int64)
    best = -(-int((x * n).sum()) // capacity)
    for k in range(1, 21):  # floor((k + 1) x) / k, and x itself where (k + 1) x is whole
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    small = np.unique(np.concatenate([x[x * 2 <= capacity], [0]]))
    for least in small[:: max(1, len(small) // 256)]:  # 1 for items that leave less than `least`, 0 below `least`
        value = np.where(x > capacity - least, capacity, np.where(x < least, 0, x))
        best = max(best, -(-int((value * n).sum()) // capacity))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin, by best-fit decreasing."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what they still hold
    left: list[int] = []
    some = 0  # bit r: a bin has room r
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = some >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            chosen = room[space].pop()
            if not room[space]:
                some &= ~(1 << space)
        else:
            space, chosen = capacity, len(left)
            left.append(capacity)
        bins[item], offsets[item] = chosen, capacity - space
        left[chosen] = space - size
        if space > size:
            room[space - size].append(chosen)
            some |= 1 << (space - size)
    return bins, offsets, capacity - np.array(left, dtype=np.int64)


_PACKED = _PIECE + ", sequence_id long, offset long, fill long, gap long"


def _pack_round(table: DataFrame, number: int, groups: int, capacity: int) -> DataFrame:
    """Deal the pieces at random to groups and pack each; `gap` is the group's bins beyond its bound."""

    def work(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        gap = len(fill) - bound(*np.unique(lengths, return_counts=True), capacity)
        key = group.column("_group")[0].as_py()
        made = {name: group.column(name) for name in PIECE_COLUMNS}
        return pa.table({
            **made, "sequence_id": bins + (number << 58) + (key << 32), "offset": offsets, "fill": fill[bins],
            "gap": np.full(len(bins), gap, dtype=np.int64),
        })

    dealt = table.select(*PIECE_COLUMNS, F.floor(F.rand(number + 7) * groups).cast("long").alias("_group"))
    return dealt.groupBy("_group").applyInArrow(work, _PACKED)


def _histogram(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pieces by length: at most `capacity` rows."""
    rows = table.groupBy("length").count().collect()
    return np.array([r["length"] for r in rows], dtype=np.int64), np.array([r["count"] for r in rows], dtype=np.int64)


def pack(table: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Sequence and offset of every piece of a table with `PIECE_COLUMNS` (lengths from 1 to the capacity)."""
    rest = written(table)
    sizes, counts = _histogram(rest)
    wanted, remaining = bound(sizes, counts, capacity), int(counts.sum())
    done, final, before, number, earlier = [], 0, None, 0, None
    while remaining:
        packed = written(_pack_round(rest, number, -(-remaining // group), capacity))
        full = F.col("fill") == capacity
        # a sequence has one piece at offset 0
        first = F.col("offset") == 0
        seen = packed.agg(
            F.count(F.when(first & full, 1)).alias("full"), F.count(F.when(first & ~full, 1)).alias("open"), F.count(F.when(~full, 1)).alias("left"),
            F.max("gap").alias("gap"),
        ).first()
        total = final + seen["full"] + seen["open"]
        one_group = remaining <= group
        if total == wanted or seen["open"] <= 1 or one_group or (before is not None and total >= before):
            done.append(earlier if before is not None and total > before else packed)
            break
        done.append(packed.where(full))
        rest = earlier = packed.where(~full)
        remaining, final, before, number = seen["left"], final + seen["full"], total, number + 1
    result = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if not done:
        return rest.select(*PIECE_COLUMNS, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.select(*result)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int | bool]:
    """Sequences of a packing, the bound on any packing of its pieces, and whether they meet."""
    used = packed.where("offset = 0").count()
    least = bound(*_histogram(packed), capacity)
    return {"sequences": used, "bound": least, "certified": used == least}


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return pack(pieces(docs, vocabulary, capacity, end_id, id_col, text_col), capacity, group)
