"""Substring dedup on words with prefix-partitioned suffix trees.

A window is `length` consecutive words of one document; each word is removed that a window covers whose word sequence also
starts in a document with a smaller id.

Suffixes are partitioned by prefixes of varying length. The first prefix is the `key`-word string that synchronises a
window; partitions with one document go. A partition that a task can hold becomes a subtree: its suffixes are sorted by
doubling, and the maximal intervals whose neighbours share `length` words or more are the tree's deep internal nodes,
whose strings are repeats. Every leaf below a node starts one; all but those of the smallest document are removed. A
partition too large for a task is split by the longest prefix that matters, all words of the window; such a partition
is one node, and only its smallest document is needed.

Words are parted by the bytes 0x20 and 0x09-0x0D. Null texts have no words. Rows that share an id are one document: neither
is smaller. A missing id counts as the largest. `kept_sha256` digests the kept words joined by spaces.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerweave.llm import repeats
from ledgerweave.llm.batches import over_batches
from ledgerweave.llm.shared import stored

LENGTH, KEY = 50, 8
#: Classes of one prefix that make up a subtree.
GROUP = 4096


def deep_nodes(group: repeats.Group, starts: np.ndarray, length: int) -> np.ndarray:
    """For each suffix the deep internal node (or leaf) it hangs below: equal numbers share `length` words.

    Suffixes of a group are sorted by pairs of ranks at doubled offsets up to the length; contents are parted by
    never reading beyond the last window of each.
    """
    rank = np.unique(group.first, return_inverse=True)[1].astype(np.int64)
    n, width = len(rank), 1

    def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.unique(left * (n + 1) + right, return_inverse=True)[1].astype(np.int64)

    while width * 2 <= length:
        ahead = np.full(n, n, dtype=np.int64)
        ahead[: n - width] = rank[width:]
        rank, width = paired(rank, ahead), width * 2
    return paired(rank[starts], rank[starts + length - width])


def repeated(group: repeats.Group, length: int) -> np.ndarray:
    """Window starts whose words also start in a document with a smaller id."""
    starts, owner = group.starts()
    node, document = deep_nodes(group, starts, length), group.row_id[owner]
    least = np.full(int(node.max(initial=-1)) + 1, repeats.LAST_ID, dtype=np.int64)
    np.minimum.at(least, node, document)
    return least[node] < document


def repeated_spans(docs: DataFrame, length: int = LENGTH, key: int = KEY, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text"):
    """The rows, and (row_id, row_hash, spans): the word ranges of each row to remove."""
    unit = repeats.Unit(True, length, min(key, length))
    rows = repeats.rows_of(docs, id_col, text_col)
    found = stored(repeats.find_runs(rows, unit))
    classes = repeats.classes_of(found, True)
    open_ = repeats.contents(rows, classes, unit)
    ranges = repeats.ranges_in_groups(open_.where(f"m <= {group}"), unit, lambda g: repeated(g, length))
    ranges = ranges.unionByName(repeats.ranges_by_window(open_.where(f"m > {group}"), unit, True))
    return rows, repeats.spans(found, classes, ranges, unit, True)


def remove(docs: DataFrame, length: int = LENGTH, key: int = KEY, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its words, those removed, what is left and its digest."""
    rows, spans = repeated_spans(docs, length, key, group, id_col, text_col)
    joined = repeats.packed_texts(rows).join(spans, ["row_id", "row_hash"], "left")

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {name: [] for name in ("n_words", "n_removed", "kept_sha256", "kept")}
        for text, listed in zip(repeats.unpacked(batch.column("z").to_pylist()), batch.column("spans").to_pylist()):
            words = text.split()
            hit = repeats.covered(listed, len(words))
            left = b" ".join(compress(words, (~hit).tolist()))
            for name, value in (("n_words", len(words)), ("n_removed", int(hit.sum())), ("kept_sha256", hashlib.sha256(left).hexdigest()), ("kept", left.decode("utf-8", "replace"))):
                out[name].append(value)
        types = {"kept_sha256": pa.string(), "kept": pa.string()}
        return {"doc_id": batch.column("doc_id"), **{n: pa.array(v, types.get(n, pa.int64())) for n, v in out.items()}}

    return over_batches(joined.select("doc_id", "z", "spans"), work, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
