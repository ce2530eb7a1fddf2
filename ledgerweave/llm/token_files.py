"""Token counts of flat, unindexed token files.

A token file is one long row of ids, little-endian, in blocks of equal size; documents follow each other with an
end-of-document id behind each, and nothing says where they begin. Blocks are scanned by themselves: a vectorized
comparison finds the separators. What a document has in earlier blocks is known from a prefix scan over block summaries
(separators so far, and the place of the last one), first inside stretches of blocks, then over stretches, so no file
of any size is walked by one task.

The end id lies outside the vocabulary, so no text can contain it. Null texts are documents of no tokens. Ids behind the
last separator of a file belong to no complete document and are not counted. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.batches import id_and_text, over_batches, texts_of
from ledgerweave.llm.shared import stored
from ledgerweave.llm.tokens import word_bpe

VOCABULARY, END_ID = "word_bpe_49k.json", 49_408
#: Ids in a block, and blocks in a stretch of the prefix scan.
BLOCK, STRETCH = 1 << 18, 4096
DTYPE = np.dtype("<u2")


def write_files(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"):
    """Tokenize into flat files, one for each partition. Gives the blocks (file, block, data), and which document was
    written at which place (file, ordinal, doc_id)."""

    def run(batches):
        file, number, ordinal = TaskContext.get().partitionId(), 0, 0
        held = np.zeros(0, dtype=DTYPE)

        def rows(blocks: list[bytes], ids: list) -> pa.RecordBatch:
            n, m = len(blocks), len(ids)
            return pa.RecordBatch.from_arrays([
                pa.array([file] * (n + m), pa.int64()), pa.array([*range(number - n, number), *[None] * m], pa.int64()), pa.array([*blocks, *[None] * m], pa.binary()),
                pa.array([*[None] * n, *range(ordinal - m, ordinal)], pa.int64()), pa.array([*[None] * n, *ids], pa.int64()),
            ], names=["file", "block", "data", "ordinal", "doc_id"])

        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                ids, ends = word_bpe(vocabulary).by_text(texts_of(batch))
                flat = np.insert(ids, ends[1:], end_id).astype(DTYPE)
                held = np.concatenate([held, flat])
                full = len(held) // block
                made = [held[k * block : (k + 1) * block].tobytes() for k in range(full)]
                held = held[full * block :]
                number, ordinal = number + full, ordinal + batch.num_rows
                yield rows(made, batch.column("doc_id").to_pylist())
        if len(held):
            number += 1
            yield rows([held.tobytes()], [])

    schema = "file long, block long, data binary, ordinal long, doc_id long"
    both = stored(id_and_text(docs, id_col, text_col).mapInArrow(run, schema))
    return both.where("block is not null").select("file", "block", "data"), both.where("block is null").select("file", "ordinal", "doc_id")


def scan(blocks: DataFrame, end_id: int = END_ID, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every complete document; `blocks` has file, block (from 0) and data."""

    def work(batch: pa.RecordBatch) -> dict:
        places = [np.flatnonzero(np.frombuffer(data, dtype=DTYPE) == end_id) for data in batch.column("data").to_pylist()]
        start = batch.column("block").to_numpy() * block
        ends = [p + s for p, s in zip(places, start.tolist())]
        return {"file": batch.column("file"), "block": batch.column("block"), "ends": pa.array([e.tolist() for e in ends], pa.list_(pa.int64()))}

    found = stored(over_batches(blocks, work, "file long, block long, ends array<long>", 16))
    part = F.floor(F.col("block") / stretch).alias("stretch")
    summary = found.select("file", "block", part, F.size("ends").cast("long").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))

    # exclusive prefix: documents ended before, and where the last of them ended
    def before(keys: list[str], order: str, name: str):
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum("n").over(window), F.lit(0)).alias(f"n_{name}"), F.max("last").over(window).alias(f"last_{name}")]

    stretches = summary.groupBy("file", "stretch").agg(F.sum("n").alias("n"), F.max("last").alias("last")).select("file", "stretch", *before(["file"], "stretch", "outer"))
    inner = summary.select("file", "block", "stretch", *before(["file", "stretch"], "block", "inner"))
    carried = inner.join(stretches, ["file", "stretch"]).select(
        "file", "block", (F.col("n_outer") + F.col("n_inner")).alias("done"), F.coalesce("last_inner", "last_outer", F.lit(-1)).alias("carry")
    )
    return (
        found.join(carried, ["file", "block"]).select("file", "done", "carry", "ends", F.posexplode("ends").alias("k", "end"))
        .select("file", (F.col("done") + F.col("k")).alias("ordinal"), (F.when(F.col("k") > 0, F.expr("ends[k - 1]")).otherwise(F.col("carry")) + 1).alias("start"), "end")
        .select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"))
    )


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, block: int = BLOCK, stretch: int = STRETCH,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, file, ordinal, start and n_tokens of every document, from the scan of its token file."""
    blocks, placed = write_files(docs, vocabulary, end_id, block, id_col, text_col)
    return placed.join(scan(blocks, end_id, block, stretch), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
