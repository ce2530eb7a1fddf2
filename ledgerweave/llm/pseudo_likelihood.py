"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

A text's score is the sum over its tokens of log P(token | tokens on both sides), each token hidden in turn. The network
looks at `SIDE` tokens on either side:

    h = tanh(sum over offsets of mix[offset] * embed[class of neighbour] + bias)
    P(token) = softmax(group, h) * softmax(member of group, h) * count(token) / count(class)

Classes come from counts over the whole corpus: frequent tokens have one of their own, the rest share classes
by their id; the last factor is the token's share of its class (one count is added to each token, so all have a probability).

Documents are dealt to shards by their content, in an order of their own, and written as chunks of tokens, so that a chunk holds the
same documents however the input lies in partitions. The corpus is cut into `SLICES` slices of shards. Training starts at the
frequencies of the classes and takes a step for each slice: every task sums the gradients of its chunks, with every token of the
slice as a target once, Spark adds the tasks' sums, and the driver moves the weights. So each token of the corpus is a target
once, and weights and scores are the same for any layout of the input. The driver sees the vocabulary's counts, one gradient and
one set of weights, all of fixed size.

Null and empty texts have no tokens, log likelihood 0 and no mean. Repeated rows get equal scores. An empty table gives no rows.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.batches import id_and_text, over_batches, texts_of
from ledgerweave.llm.shared import ensure_checkpoint_dir
from ledgerweave.llm.tokens import word_bpe

VOCABULARY, TOKENS = "word_bpe_49k.json", 49_408
SIDE, WIDTH, GROUPS, MEMBERS = 3, 16, 32, 32
EDGE = GROUPS * MEMBERS  # the class of places before and behind a text
OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]
#: Steps of training, one for each slice of the corpus; the first step's length, and that of the last as a share of it.
SLICES, RATE, LAST = 16, 0.3, 0.2
#: Bytes of text in a shard; tokens of a chunk, and of what is computed at once; tasks that add up what all others send.
SHARD, CHUNK, WINDOW, FAN = 4 << 20, 1 << 17, 1 << 15, 8


def token_table(docs: DataFrame, vocabulary: str = VOCABULARY, slices: int = SLICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of documents: their ids, the numbers of their tokens, and all token ids, two bytes each; one folder a slice."""
    rows = id_and_text(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = slices * max(1, -(-total // (SHARD * slices)))

    def work(batch: pa.RecordBatch) -> dict:
        ids, ends = word_bpe(vocabulary).by_text(texts_of(batch))
        small = ids.astype("<u2")
        return {"doc_id": batch.column("doc_id"), "name": batch.column("name"), "ids": pa.array([small[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, docs_, held, size = None, [], [], 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(h) // 2 for h in held], dtype=np.int64)
            made = [pa.array([shard % slices], pa.int32()), pa.array([docs_], pa.list_(pa.int64())), pa.array([lengths.tobytes()], pa.binary()), pa.array([b"".join(held)], pa.binary())]
            return pa.RecordBatch.from_arrays(made, names=["slice", "docs", "lengths", "ids"])

        for batch in batches:
            for of, doc, ids in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                if held and (of != shard or size >= 2 * CHUNK):
                    yield close()
                    docs_, held, size = [], [], 0
                shard = of
                docs_.append(doc)
                held.append(ids)
                size += len(ids)
        if held:
            yield close()

    # copies with ids of their own go to different shards
    named = rows.withColumn("name", F.xxhash64(F.coalesce("text", F.lit("")), "doc_id"))
    tokens = over_batches(named, work, "doc_id long, name long, ids binary", 1024)
    dealt = tokens.withColumn("shard", F.pmod("name", F.lit(shards)).cast("int")).repartition("shard").sortWithinPartitions("shard", "name", "ids")
    path = posixpath.join(ensure_checkpoint_dir(docs.sparkSession), f"table-{uuid.uuid4().hex}")
    schema = "slice int, docs array<long>, lengths binary, ids binary"
    dealt.select("shard", "name", "doc_id", "ids").mapInArrow(pack, schema).sortWithinPartitions("slice").write.partitionBy("slice").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of vectors, one row each; a few tasks add them up before the driver does."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for value in batch.column("value").to_pylist():
                total += np.frombuffer(value, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["value"])

    every = parts.repartition(FAN).mapInArrow(add, "value binary").collect()
    return np.sum([np.frombuffer(row["value"], dtype=np.float64) for row in every] or [np.zeros(size)], axis=0)


def _over_chunks(table: DataFrame, size: int, work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of what `work` gives for the ids and lengths of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size), False
        for batch in batches:
            for ids, lengths in zip(batch.column("ids").to_pylist(), batch.column("lengths").to_pylist()):
                total += work(np.frombuffer(ids, dtype="<u2").astype(np.int64), np.frombuffer(lengths, dtype=np.int64))
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["value"])

    return _summed(table.select("ids", "lengths").mapInArrow(run, "value binary"), size)


def token_counts(table: DataFrame, tokens: int = TOKENS) -> np.ndarray:
    """How often each token stands in the corpus."""
    return _over_chunks(table, tokens, lambda ids, _: np.bincount(ids, minlength=tokens)).astype(np.int64)


def classes(counts: np.ndarray, own: int = EDGE - 64) -> tuple[np.ndarray, np.ndarray]:
    """The class of each token, and the logarithm of its share of the class.

    The `own` most frequent tokens get a class each; the others share the remaining 64 by their id.
    """
    order = np.lexsort((np.arange(len(counts)), -counts))
    which = EDGE - 64 + np.arange(len(counts)) % 64
    which[order[:own]] = np.arange(min(own, len(counts)))
    smooth = counts + 1.0
    return which, np.log(smooth / np.bincount(which, smooth, minlength=EDGE)[which])


def initial(of_class: np.ndarray | None = None, seed: int = 11) -> dict[str, np.ndarray]:
    """Random weights; with the counts of the classes, a network that gives their frequencies whatever the context."""
    random = np.random.default_rng(seed)
    shape = {"embed": (EDGE + 1, WIDTH), "mix": (len(OFFSETS), WIDTH), "bias": (WIDTH,), "group": (GROUPS, WIDTH + 1), "member": (GROUPS, MEMBERS, WIDTH + 1)}
    made = {name: random.normal(0, 0.1, size).astype(np.float32) for name, size in shape.items()}
    made["mix"] += 1.0
    if of_class is not None:
        by_group = (of_class + 1.0).reshape(GROUPS, MEMBERS)
        made["group"][:, :-1] = made["member"][:, :, :-1] = 0
        made["group"][:, -1] = np.log(by_group.sum(axis=1) / by_group.sum())
        made["member"][:, :, -1] = np.log(by_group / by_group.sum(axis=1, keepdims=True))
    return made


def _steady(w: dict[str, np.ndarray]) -> bool:
    """Whether no logit can leave the range of a float's exponential; hidden values lie between -1 and 1."""
    return max(float(np.abs(w[name]).sum(axis=-1).max()) for name in ("group", "member")) < 80


class _Window:
    """A stretch of places, with `SIDE` more before and behind it; targets are sorted by the group of their class."""

    def __init__(self, w: dict[str, np.ndarray], around: np.ndarray, steady: bool):
        self.w, self.around, self.n, self.steady = w, around, len(around) - 2 * SIDE, steady
        goal = around[SIDE : SIDE + self.n]
        at = np.flatnonzero(goal != EDGE)
        group = (goal[at] // MEMBERS).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        self.at = at[order]
        self.group, self.member = group[order].astype(np.int64), goal[self.at] % MEMBERS
        self.cuts = np.searchsorted(self.group, np.arange(GROUPS + 1)).tolist()
        self.vectors = np.take(np.ascontiguousarray(w["embed"].T), around, axis=1)
        mixed, part = np.empty((WIDTH, self.n), dtype=np.float32), np.empty((WIDTH, self.n), dtype=np.float32)
        mixed[:] = w["bias"][:, None]
        for k, offset in enumerate(OFFSETS):
            np.multiply(self.vectors[:, SIDE + offset : SIDE + offset + self.n], w["mix"][k][:, None], out=part)
            mixed += part
        self.h = np.ones((WIDTH + 1, len(self.at)), dtype=np.float32)
        np.tanh(np.take(mixed, self.at, axis=1, out=part[:, : len(self.at)], mode="clip"), out=self.h[:-1])

    def softmax(self, weights: np.ndarray, h: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The logarithm of each goal's probability, and all probabilities as shares and their sums."""
        x = weights @ h
        if not self.steady:
            x -= x.max(axis=0)
        aim = x[goal, np.arange(len(goal))]
        np.exp(x, out=x)
        total = np.ones(len(x), dtype=np.float32) @ x
        return aim - np.log(total), x, total

    def parts(self) -> Iterator[tuple[int, slice]]:
        """Groups with targets, and those targets."""
        return ((g, slice(a, b)) for g, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:])) if a < b)

    def log_probabilities(self) -> np.ndarray:
        """Of the class of each place; 0 where there is no token."""
        found = self.softmax(self.w["group"], self.h, self.group)[0].astype(np.float64)
        for g, own in self.parts():
            found[own] += self.softmax(self.w["member"][g], self.h[:, own], self.member[own])[0]
        out = np.zeros(self.n)
        out[self.at] = found
        return out

    def slope(self, weights: np.ndarray, h: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Probabilities, less one at the goals."""
        _, shares, total = self.softmax(weights, h, goal)
        shares *= 1 / total
        shares[goal, np.arange(len(goal))] -= 1
        return shares

    def gradient(self) -> dict[str, np.ndarray]:
        """Of the sum of negative log probabilities."""
        w, h = self.w, self.h
        slope = self.slope(w["group"], h, self.group)
        made = {"group": slope @ h.T, "member": np.zeros_like(w["member"])}
        back = w["group"][:, :-1].T @ slope
        for g, own in self.parts():
            inner = self.slope(w["member"][g], h[:, own], self.member[own])
            made["member"][g] = inner @ h[:, own].T
            back[:, own] += w["member"][g][:, :-1].T @ inner
        part = np.empty((WIDTH, self.n), dtype=np.float32)
        inside = part[:, : len(self.at)]
        np.multiply(h[:-1], h[:-1], out=inside)
        np.subtract(1, inside, out=inside)
        back *= inside
        down = np.zeros((WIDTH, self.n), dtype=np.float32)
        down[:, self.at] = back
        made["bias"] = down.sum(axis=1)
        # every place is a neighbour of the places around it, so a shift takes the place of a gather
        mix, to = np.zeros_like(w["mix"]), np.zeros(self.vectors.shape, dtype=np.float32)
        for k, offset in enumerate(OFFSETS):
            near = slice(SIDE + offset, SIDE + offset + self.n)
            mix[k] = [np.dot(x, y) for x, y in zip(self.vectors[:, near], down)]
            np.multiply(down, w["mix"][k][:, None], out=part)
            to[:, near] += part
        made["mix"] = mix
        made["embed"] = np.stack([np.bincount(self.around, row, minlength=EDGE + 1) for row in to], axis=1)
        return made


def _places(of: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts with `SIDE` edges before, between and behind them; the place of each token."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(of)) + SIDE * (owner + 1)
    out = np.full(len(of) + SIDE * (len(lengths) + 1), EDGE, dtype=np.int64)
    out[at] = of
    return out, at


def _windows(w: dict[str, np.ndarray], places: np.ndarray) -> Iterator[_Window]:
    steady = _steady(w)
    for low in range(0, len(places) - 2 * SIDE, WINDOW):
        yield _Window(w, places[low : low + WINDOW + 2 * SIDE], steady)


def log_probabilities(w: dict[str, np.ndarray], of: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log P(class) of each token of texts, given the classes of all tokens and how many each text has."""
    places, at = _places(of, lengths)
    found = np.concatenate([np.zeros(0), *(window.log_probabilities() for window in _windows(w, places))])
    return found[at - SIDE]


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[name].ravel() for name in sorted(w)]).astype(np.float64)


def _shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    made, at = {}, 0
    like = initial()
    for name in sorted(like):
        size = like[name].size
        made[name] = values[at : at + size].reshape(like[name].shape).astype(np.float32)
        at += size
    return made


def gradient(table: DataFrame, which: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """The sum of gradients over all tokens of the table, and how many there are."""
    sent = table.sparkSession.sparkContext.broadcast({"which": which, "weights": weights})

    def work(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        w, total = _shaped(sent.value["weights"]), np.zeros(len(sent.value["weights"]) + 1)
        places, _ = _places(sent.value["which"][ids], lengths)
        for window in _windows(w, places):
            total[:-1] += _flat(window.gradient())
        total[-1] = len(ids)
        return total

    total = _over_chunks(table, len(weights) + 1, work)
    return total[:-1], total[-1]


def train(table: DataFrame, which: np.ndarray, w: dict[str, np.ndarray], slices: int = SLICES, rate: float = RATE) -> dict[str, np.ndarray]:
    """Weights after one step (by moments of the gradient) for each slice."""
    weights = _flat(w)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for number in range(slices):
        total, n = gradient(table.where(F.col("slice") == number), which, weights)
        if not n:
            continue
        mean = total / n
        first, second = 0.8 * first + 0.2 * mean, 0.95 * second + 0.05 * mean * mean
        move = (first / (1 - 0.8 ** (number + 1))) / (np.sqrt(second / (1 - 0.95 ** (number + 1))) + 1e-5)
        weights = weights - rate * (1 - (1 - LAST) * number / max(slices - 1, 1)) * move
    return _shaped(np.round(weights, 6))


def score_table(table: DataFrame, which: np.ndarray, share: np.ndarray, w: dict[str, np.ndarray]) -> DataFrame:
    sent = table.sparkSession.sparkContext.broadcast({"which": which, "share": share, "weights": _flat(w)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            own = own or _shaped(sent.value["weights"])
            for row in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[row].as_py(), dtype="<u2").astype(np.int64)
                n = np.frombuffer(batch.column("lengths")[row].as_py(), dtype=np.int64)
                found = np.concatenate([[0], np.cumsum(log_probabilities(own, sent.value["which"][ids], n) + sent.value["share"][ids])])
                ends = np.cumsum(n)
                total = found[ends] - found[ends - n]
                mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays([batch.column("docs")[row].values, pa.array(n), pa.array(total), mean], names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return table.select("docs", "lengths", "ids").mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def fit(table: DataFrame, slices: int = SLICES, rate: float = RATE):
    """Classes and shares from the counts of the corpus, and the trained weights."""
    counts = token_counts(table)
    which, share = classes(counts)
    return which, share, train(table, which, initial(np.bincount(which, counts, minlength=EDGE)), slices, rate)


def score(docs: DataFrame, vocabulary: str = VOCABULARY, slices: int = SLICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its tokens, and the sum and mean of their conditional log-probabilities."""
    table = token_table(docs, vocabulary, slices, id_col, text_col)
    return score_table(table, *fit(table, slices))
