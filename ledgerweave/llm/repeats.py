"""Repeated windows of a fixed length over a corpus: what substring and suffix-array dedup have in common.

1. Every text is cut into runs of windows around synchronising places (`synchronise`). A run's *key* names the string at
   its place, its *class* names everything its windows touch. Runs of one class hold equal windows at equal offsets;
   windows of runs with different keys differ.
2. Classes are counted with map-side combine, then the classes of each key. A key with one class needs no more work:
   its windows are repeated as a whole or not at all. Of the classes of other keys one run each is *open*.
3. The contents of open classes are fetched from their texts and grouped by key. The operators differ in how they
   find the repeated windows of a group.
4. A class's answer (a range of units around its place) goes back to all of its runs, and the ranges of a text
   to the text.

Windows of one run lie closer than a window is long, so all that a run covers is one range.

Texts travel compressed. Rows that agree in id and text are named alike and get equal answers; a missing id counts as
the largest one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.batches import id_and_text, over_batches, texts_of
from ledgerweave.llm.shared import hot_safe_join, stored
from ledgerweave.llm.synchronise import Prefix, byte_values, pieces, runs
from ledgerweave.llm.words import NOT_SPACE, words_of

LAST_ID = 2**63 - 1
#: Units of content that a task works on at once; groups stay whole.
CHUNK = 1 << 18


@dataclass(frozen=True)
class Unit:
    """What windows are made of, how long they are, and how long the strings that synchronise them."""

    words: bool
    length: int
    key: int


def rows_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the name of the row."""
    return id_and_text(docs, id_col, text_col).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(LAST_ID)).alias("row_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash")
    )


def sequences(texts: list[bytes], words: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two hash values of each unit of each text."""
    if not words:
        first, second = byte_values(0), byte_values(1)
        for text in texts:
            raw = np.frombuffer(text, dtype=np.uint8)
            yield first[raw], second[raw]
        return
    found = words_of(texts, NOT_SPACE)
    for low, high in zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist()):
        yield found.first[low:high], found.second[low:high]


def spot(at: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A run in one number: its place, and how many window starts lie before and behind it (fewer than 4096)."""
    return (at << 24) | (before << 12) | after


def _runs_of(first: np.ndarray, second: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    made = []
    for start, end in pieces(len(first), unit.length):
        prefix = Prefix(first[start:end], second[start:end])
        at, low, high = runs(prefix, unit.length, unit.key)
        key = prefix.name(at, at + unit.key)[0]
        whole = prefix.name(low, high + unit.length, at - low)[1]
        made.append((key, whole, at + start, at - low, high - at))
    return tuple(np.concatenate(columns) for columns in zip(*made))


def find_runs(rows: DataFrame, unit: Unit) -> DataFrame:
    """(k, s, row_id, row_hash, spot) of every run. `after` may be negative: it is stored with 4096/2 added."""
    half = 1 << 11

    def work(batch: pa.RecordBatch) -> dict:
        ids, hashes = batch.column("row_id").to_numpy(), batch.column("row_hash").to_numpy()
        out: list[tuple] = []
        for place, (first, second) in enumerate(sequences(texts_of(batch), unit.words)):
            if len(first) >= unit.length:
                out.append((place, *_runs_of(first, second, unit)))
        owner = np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64)
        k, s, at, before, after = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, dtype=np.int64) for c in range(1, 6))
        return {
            "k": k.view(np.int64), "s": s.view(np.int64), "row_id": ids[owner], "row_hash": hashes[owner],
            "spot": spot(at, before, after + half),
        }

    return over_batches(rows.select("text", "row_id", "row_hash"), work, "k long, s long, row_id long, row_hash long, spot long")


def classes_of(found: DataFrame, smaller_only: bool) -> DataFrame:
    """Classes that are repeated themselves (`whole`) or share their key with other classes (`m` > 1).

    `smaller_only`: a run is repeated only if an equal one stands in a row with a smaller id.
    """
    repeated = F.max("row_id") > F.min("row_id") if smaller_only else F.count(F.lit(1)) > 1
    # both min_by see the rows in one order, so they pick the same row of a class
    rep = [F.min("row_id").alias("least"), F.min_by("row_hash", "row_id").alias("row_hash"), F.min_by("spot", "row_id").alias("spot")]
    each = found.groupBy("k", "s").agg(*rep, repeated.alias("whole"))
    by_key = each.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("least").alias("low"), F.max("least").alias("high"))
    by_key = by_key.where("m > 1 and low < high" if smaller_only else "m > 1").select("k", "m")
    joined = hot_safe_join(each, by_key, ["k"], "left").where("whole or m is not null")
    return stored(joined.select("k", "s", "whole", F.coalesce("m", F.lit(0)).alias("m"), F.col("least").alias("row_id"), "row_hash", "spot"))


def packed_texts(rows: DataFrame) -> DataFrame:
    """The rows with their texts compressed, for a shuffle."""

    def work(batch: pa.RecordBatch) -> dict:
        squeeze = zstandard.ZstdCompressor(level=1)
        return {**{n: batch.column(n) for n in ("doc_id", "row_id", "row_hash")}, "z": pa.array([squeeze.compress(t) for t in texts_of(batch)], pa.binary())}

    return over_batches(rows, work, "doc_id long, row_id long, row_hash long, z binary")


def unpacked(values: list[bytes]) -> list[bytes]:
    open_ = zstandard.ZstdDecompressor()
    return [open_.decompress(v, max_output_size=1 << 31) if v else b"" for v in values]


def contents(rows: DataFrame, classes: DataFrame, unit: Unit) -> DataFrame:
    """What the windows of one run of each open class touch: bytes, or 64-bit names of words."""
    wanted = classes.where("m > 0").groupBy("row_id", "row_hash").agg(F.collect_list(F.struct("k", "s", "whole", "m", "spot")).alias("open"))
    joined = packed_texts(rows).join(wanted, ["row_id", "row_hash"])

    def work(batch: pa.RecordBatch) -> dict:
        texts = unpacked(batch.column("z").to_pylist())
        listed, owners = batch.column("open"), batch.column("row_id").to_pylist()
        out: dict[str, list] = {n: [] for n in ("k", "s", "whole", "m", "row_id", "before", "content")}
        names = sequences(texts, True) if unit.words else ((text, None) for text in texts)
        for owner, open_, (own, _) in zip(owners, listed.to_pylist(), names):
            for item in open_:
                at, before, after = item["spot"] >> 24, (item["spot"] >> 12) & 4095, (item["spot"] & 4095) - 2048
                part = own[at - before : at + after + unit.length]
                for name, value in (("k", item["k"]), ("s", item["s"]), ("whole", item["whole"]), ("m", item["m"]), ("row_id", owner), ("before", before)):
                    out[name].append(value)
                out["content"].append(part if isinstance(part, bytes) else part.tobytes())
        types = {"whole": pa.bool_(), "content": pa.binary(), "before": pa.int32()}
        return {name: pa.array(values, types.get(name, pa.int64())) for name, values in out.items()}

    schema = "k long, s long, whole boolean, m long, row_id long, before int, content binary"
    return stored(over_batches(joined.select("row_id", "z", "open"), work, schema))


@dataclass
class Group:
    """Contents of whole groups, one after the other; `begin` and `end` are the window starts of each in `first`."""

    key: np.ndarray
    s: np.ndarray
    whole: np.ndarray
    row_id: np.ndarray
    before: np.ndarray
    first: np.ndarray
    second: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Every window start, and the class it belongs to."""
        counts = self.end - self.begin
        owner = np.repeat(np.arange(len(counts)), counts)
        return np.arange(len(owner)) + np.repeat(self.begin - (np.cumsum(counts) - counts), counts), owner


def _group(table: pa.Table, unit: Unit) -> Group:
    raw = table.column("content").to_pylist()
    if unit.words:
        first = np.frombuffer(b"".join(raw), dtype=np.uint64)
        second = first
        size = np.array([len(x) // 8 for x in raw], dtype=np.int64)
    else:
        buffer = np.frombuffer(b"".join(raw), dtype=np.uint8)
        first, second = byte_values(0)[buffer], byte_values(1)[buffer]
        size = np.array([len(x) for x in raw], dtype=np.int64)
    begin = np.cumsum(size) - size
    take = lambda name: table.column(name).to_numpy()
    return Group(take("k"), take("s"), take("whole"), take("row_id"), take("before").astype(np.int64), first, second, begin, begin + size - unit.length + 1)


def ranges_in_groups(open_: DataFrame, unit: Unit, repeated: Callable[[Group], np.ndarray]) -> DataFrame:
    """(k, s, a, b): the units around a class's place that its repeated windows cover.

    `repeated` says which window starts of a group (in the order of `Group.starts`) are repeated. Groups are read one after
    the other from partitions sorted by key; a task holds about CHUNK units.
    """
    width = 8 if unit.words else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                held.append(whole.slice(low, 512))
                size += held[-1].column("content").nbytes // width
                if size >= CHUNK:
                    table = pa.Table.from_batches(held).combine_chunks()
                    keys = table.column("k").to_numpy()
                    cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
                    if cut:
                        yield answer(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size = sum(b.column("content").nbytes for b in held) // width
        if held:
            yield answer(pa.Table.from_batches(held).combine_chunks())

    def answer(table: pa.Table) -> pa.RecordBatch:
        group = _group(table, unit)
        starts, owner = group.starts()
        hit = repeated(group)
        starts, owner = starts[hit], owner[hit]
        known, first = np.unique(owner, return_index=True)
        last = np.searchsorted(owner, known, side="right") - 1
        place = group.begin[known] + group.before[known]
        return pa.RecordBatch.from_arrays(
            [pa.array(group.key[known]), pa.array(group.s[known]), pa.array(starts[first] - place), pa.array(starts[last] - place + unit.length)],
            names=["k", "s", "a", "b"],
        )

    columns = ["k", "s", "whole", "row_id", "before", "content"]
    return open_.select(*columns).repartition("k").sortWithinPartitions("k").mapInArrow(run, "k long, s long, a long, b long")


def ranges_by_window(open_: DataFrame, unit: Unit, smaller_only: bool) -> DataFrame:
    """The same for groups too large for a task: every window travels by its full name, and names are counted."""

    def work(batch: pa.RecordBatch) -> dict:
        group = _group(pa.Table.from_batches([batch]), unit)
        starts, owner = group.starts()
        name = Prefix(group.first, group.second).name(starts, starts + unit.length)
        return {
            "w1": name[0].view(np.int64), "w2": name[1].view(np.int64), "k": group.key[owner], "s": group.s[owner], "whole": pa.array(group.whole[owner]),
            "row_id": group.row_id[owner], "a": starts - group.begin[owner] - group.before[owner],
        }

    every = over_batches(open_.drop("m"), work, "w1 long, w2 long, k long, s long, whole boolean, row_id long, a long", 256)
    names = every.groupBy("w1", "w2").agg(F.min("row_id").alias("least"), F.count(F.lit(1)).alias("n"), F.max("whole").alias("any_whole"))
    met = hot_safe_join(every, names, ["w1", "w2"]).where(F.col("least") < F.col("row_id") if smaller_only else "n > 1 or any_whole")
    return met.groupBy("k", "s").agg(F.min("a").alias("a"), (F.max("a") + unit.length).alias("b"))


def spans(found: DataFrame, classes: DataFrame, ranges: DataFrame, unit: Unit, smaller_only: bool) -> DataFrame:
    """(row_id, row_hash, spans) of every row with repeated windows; spans are ranges of units that may overlap."""
    info = classes.select("k", "s", "whole", F.col("row_id").alias("least"))
    info = stored(info.join(ranges, ["k", "s"], "left").where("whole or a is not null"))
    met = found.join(info, ["k", "s"])
    at, before = F.shiftright("spot", 24), F.shiftright("spot", 12).bitwiseAND(4095)
    after = F.col("spot").bitwiseAND(4095) - 2048
    all_of_it = F.col("row_id") > F.col("least") if smaller_only else F.col("whole")
    low, high = F.when(all_of_it, at - before).otherwise(at + F.col("a")), F.when(all_of_it, at + after + unit.length).otherwise(at + F.col("b"))
    each = met.select("row_id", "row_hash", low.alias("low"), high.alias("high")).where("low is not null")
    # copies share id and text and would each add the same ranges
    return each.groupBy("row_id", "row_hash").agg(F.collect_set(F.struct("low", "high")).alias("spans"))


def covered(spans_: list[dict] | None, n: int) -> np.ndarray:
    """Which of n units lie in a span."""
    change = np.zeros(n + 1, dtype=np.int64)
    if spans_:
        np.add.at(change, [s["low"] for s in spans_], 1)
        np.add.at(change, [s["high"] for s in spans_], -1)
    return np.cumsum(change[:-1]) > 0
