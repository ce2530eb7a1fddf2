"""Substring dedup by names of strings over synchronised positions, in place of prefix doubling.

Every byte that a string of `length` bytes covers which also starts anywhere else is removed. A name is a hash of a string's
bytes, read from prefix sums; it has 128 bits where it decides, and is the same in every task. No ranks are doubled, and
Spark sorts no pairs of ranks:

1. Positions that synchronise windows are named by their first `key` bytes; Spark groups the names. A position whose name
   is unique is done: no window around it is repeated.
2. The rest are named by all that their windows touch, past the threshold. Shared names are repeated as a whole.
3. What is left are places where copies begin, end or differ. There window starts are named at growing lengths (key, 2 key,
   4 key, ... up to the length), in one task for a group of one key. The last length alone decides; shorter ones drop
   unique starts early. Groups too large for one task go through Spark window by window.

Doubling over all byte positions would move sixteen bytes or more for each byte of text in every round; the synchronised
positions are about one in 170.

Null texts are empty. Texts shorter than the threshold stay whole. Rows that agree in id and text are copies of each
other. Bytes are counted on UTF-8; `kept_sha256` digests what is left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerweave.llm import repeats
from ledgerweave.llm.batches import over_batches
from ledgerweave.llm.shared import stored
from ledgerweave.llm.synchronise import Prefix

LENGTH, KEY = 400, 64
#: Classes of one key that a task ranks together.
GROUP = 4096


def shared_ranks(names: list[np.ndarray]) -> np.ndarray:
    """Which positions share their rank, the tuple of names, with another."""
    order = np.lexsort(names[::-1])
    same = np.ones(max(len(order) - 1, 0), dtype=bool)
    for name in names:
        same &= name[order][1:] == name[order][:-1]
    hit = np.zeros(len(order), dtype=bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    return hit


def doubled(group: repeats.Group, length: int, key: int) -> np.ndarray:
    """Window starts of a group whose windows occur more than once."""
    prefix = Prefix(group.first, group.second)
    starts, owner = group.starts()
    whole = group.whole[owner]  # repeated already, but other classes may hold the same windows
    live, size = np.arange(len(starts)), key
    while len(live):
        last = size >= length
        size = min(size, length)
        place = starts[live]
        first, second = prefix.name(place, place + size)
        shared = shared_ranks([first, second] if last else [first])
        if last:
            hit = np.zeros(len(starts), dtype=bool)
            hit[live[shared]] = True
            return hit | whole
        live, size = live[shared], size * 2
    return whole


def repeated_spans(docs: DataFrame, length: int = LENGTH, key: int = KEY, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text"):
    """The rows, and (row_id, row_hash, spans): the byte ranges of each row to remove."""
    unit = repeats.Unit(False, length, min(key, length))
    rows = repeats.rows_of(docs, id_col, text_col)
    found = stored(repeats.find_runs(rows, unit))
    classes = repeats.classes_of(found, False)
    open_ = repeats.contents(rows, classes, unit)
    ranges = repeats.ranges_in_groups(open_.where(f"m <= {group}"), unit, lambda g: doubled(g, length, unit.key))
    ranges = ranges.unionByName(repeats.ranges_by_window(open_.where(f"m > {group}"), unit, False))
    return rows, repeats.spans(found, classes, ranges, unit, False)


def remove(docs: DataFrame, length: int = LENGTH, key: int = KEY, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its bytes, those removed, the maximal removed runs, what is left and its digest."""
    rows, spans = repeated_spans(docs, length, key, group, id_col, text_col)
    joined = repeats.packed_texts(rows).join(spans, ["row_id", "row_hash"], "left")

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for text, listed in zip(repeats.unpacked(batch.column("z").to_pylist()), batch.column("spans").to_pylist()):
            hit = repeats.covered(listed, len(text))
            edge = np.flatnonzero(np.diff(hit.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            kept, at = [], 0
            for low, high in zip(edge[::2].tolist(), edge[1::2].tolist()):
                kept.append(text[at:low])
                at = high
            left = b"".join([*kept, text[at:]])
            for name, value in (("n_bytes", len(text)), ("n_removed", int(hit.sum())), ("n_spans", len(edge) // 2), ("kept_sha256", hashlib.sha256(left).hexdigest()), ("kept", left)):
                out[name].append(value)
        types = {"kept_sha256": pa.string(), "kept": pa.binary()}
        return {"doc_id": batch.column("doc_id"), **{n: pa.array(v, types.get(n, pa.int64())) for n, v in out.items()}}

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return over_batches(joined.select("doc_id", "z", "spans"), work, schema)
