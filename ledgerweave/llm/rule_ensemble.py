"""Quality classifier as a sparse rule ensemble.

Statistics of every text are computed once. Shallow regression trees are boosted on a bounded sample of labelled
rows; every path from a root is a conjunctive rule over statistics. A lasso logistic regression gives weights to the
rules, most of them zero, and the rest are compiled into one Spark column expression that scores all texts.

Rows are labelled training rows if crc32 of the id as text, modulo `FOLDS`, is not 0, and the label is not null. At most
`SAMPLE` of them are used: of more, those with the smallest hashes of the id. Labels, language, source and id never enter a
score. Null texts are empty and get a score like any other. Without two classes to learn from, every score is the
share of good labels, drawn to one half. Repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.batches import id_and_text, over_batches, texts_of
from ledgerweave.llm.shared import stored
from ledgerweave.llm.synchronise import U, mix
from ledgerweave.llm.words import NOT_SPACE, covered, per_text, windows, words_of

FOLDS, THRESHOLD = 5, 0.3
#: Most labelled rows that trees and weights are fitted on.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, PENALTY = 40, 3, 48, 0.3, 0.002

STATISTICS = (
    "n_words", "mean_word", "longest_word", "distinct_share", "top_word_share", "repeat_share", "dup_line_share", "words_per_line",
    "symbol_share", "upper_share", "digit_share", "stop_share", "bang_share", "wide_share", "signed_word_share", "sentence_words", "byte_entropy",
)

_ALL = np.arange(256)
_IS = {
    "symbol": np.isin(_ALL, [ord(c) for c in "#*$%&|<>@^~_=+{}[]\\/"]),
    "upper": (_ALL >= 65) & (_ALL <= 90),
    "lower": (_ALL >= 97) & (_ALL <= 122),
    "digit": (_ALL >= 48) & (_ALL <= 57),
    "stop": np.isin(_ALL, [ord(c) for c in ".,;:"]),
    "bang": np.isin(_ALL, [ord(c) for c in "!?"]),
    "end": np.isin(_ALL, [ord(c) for c in ".!?"]),
    "wide": _ALL >= 0xC0,
    "char": (_ALL & 0xC0) != 0x80,
}


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The statistics of a list of texts."""
    words = words_of(texts, NOT_SPACE)
    n = words.counts()
    one = np.maximum(n, 1)
    buffer = np.frombuffer(words.joined, dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
    begin[-1] = len(buffer)
    totals = {name: per_text(table[buffer], begin) for name, table in _IS.items()}
    chars = np.maximum(totals["char"] - 1, 1)  # each text has one separator behind it
    letters = np.maximum(totals["upper"] + totals["lower"], 1)
    sizes = words.ends - words.starts
    owner = words.owner()

    longest = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(longest, owner, sizes)
    salt = mix(owner.astype(U) + U(1))
    distinct, top = np.zeros(len(texts)), np.zeros(len(texts))
    if len(sizes):
        _, first, times = np.unique(words.first ^ salt, return_index=True, return_counts=True)
        distinct = np.bincount(owner[first], minlength=len(texts))
        np.maximum.at(top, owner[first], times)
    repeat = np.zeros(len(sizes), dtype=np.int64)
    names = windows(words.first, 5)
    inside = np.flatnonzero(owner[: len(names)] == owner[4 : 4 + len(names)])
    if len(inside):
        _, back, times = np.unique(names[inside] ^ salt[inside], return_inverse=True, return_counts=True)
        repeat = covered(inside[times[back] > 1], 5, len(sizes)).astype(np.int64)
    signs = np.concatenate([[0], np.cumsum((_IS["symbol"] | _IS["bang"])[buffer])])
    signed = per_text((signs[words.ends] - signs[words.starts] >= 2).astype(np.int64), words.offsets)
    lines, dup = np.ones(len(texts)), np.zeros(len(texts))
    entropy = np.zeros(len(texts))
    for k, text in enumerate(texts):
        own = [line for line in text.split(b"\n") if line.strip()]
        lines[k], dup[k] = max(len(own), 1), len(own) - len(set(own))
        if text:
            p = np.bincount(np.frombuffer(text, dtype=np.uint8)) / len(text)
            p = p[p > 0]
            entropy[k] = -(p * np.log2(p)).sum()
    made = (
        n, per_text(sizes, words.offsets) / one, longest, distinct / one, top / one, per_text(repeat, words.offsets) / one, dup / lines, n / lines,
        totals["symbol"] / chars, totals["upper"] / letters, totals["digit"] / chars, totals["stop"] / chars, totals["bang"] / chars,
        totals["wide"] / chars, signed / one, n / np.maximum(totals["end"], 1), entropy,
    )
    return {name: np.round(np.asarray(values, dtype=np.float64), 9) for name, values in zip(STATISTICS, made)}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def work(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), **measure(texts_of(batch))}

    return over_batches(id_and_text(docs, id_col, text_col), work, "doc_id long, " + ", ".join(f"{name} double" for name in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, is above, threshold), all of which hold; and the rule's weight."""

    conditions: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        tests = [F.col(STATISTICS[k]) > t if above else F.col(STATISTICS[k]) <= t for k, above, t in self.conditions]
        return reduce(lambda a, b: a & b, tests)

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([x[:, k] > t if above else x[:, k] <= t for k, above, t in self.conditions])


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        total = reduce(lambda a, b: a + b, [F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0)) for r in self.rules], F.lit(self.intercept))
        return 1.0 / (1.0 + F.exp(-total))

    def apply(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.intercept + sum((r.weight * r.holds(x) for r in self.rules), np.zeros(len(x))))))


def _grow(binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, path: tuple, depth: int, paths: list, value: np.ndarray) -> None:
    """Split the rows of a node by the best gain over all statistics; leaves write their step into `value`."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-3, -1, -1)
    if depth:
        for k in range(binned.shape[1]):
            own = binned[rows, k]
            gs = np.cumsum(np.bincount(own, gradient[rows], minlength=BINS + 1))[:-1]
            hs = np.cumsum(np.bincount(own, hessian[rows], minlength=BINS + 1))[:-1]
            size = np.cumsum(np.bincount(own, minlength=BINS + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(size < 10) | (len(rows) - size < 10)] = -1
            at = int(gain[: len(cuts[k])].argmax()) if len(cuts[k]) else 0
            if len(cuts[k]) and gain[at] > best[0]:
                best = (float(gain[at]), k, at)
    _, k, at = best
    if k < 0:
        value[rows] = -g / (h + 1)
        return
    for above in (False, True):
        side = rows[(binned[rows, k] > at) == above]
        longer = (*path, (k, above, float(cuts[k][at])))
        paths.append(longer)
        _grow(binned, cuts, gradient, hessian, side, longer, depth - 1, paths, value)


def _simplified(path: tuple) -> tuple:
    """One condition per statistic and side: the tightest."""
    tight: dict[tuple[int, bool], float] = {}
    for k, above, t in path:
        old = tight.get((k, above), t)
        tight[(k, above)] = max(old, t) if above else min(old, t)
    return tuple(sorted((k, above, t) for (k, above), t in tight.items()))


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """The distinct paths of boosted trees."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    rate = (y.sum() + 1) / (len(y) + 2)
    margin = np.full(len(y), np.log(rate / (1 - rate)))
    random, found = np.random.default_rng(7), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.sort(random.choice(len(y), size=max(1, len(y) * 7 // 10), replace=False))
        paths: list = []
        value = np.zeros(len(y))
        _grow(binned, cuts, p - y, p * (1 - p), rows, (), depth, paths, value)
        # rows outside the sample take the step of the leaf they fall into
        step = {}
        for path in paths:
            held = Rule(path).holds(x)
            inside = held[rows]
            if inside.any() and len(set(value[rows[inside]].tolist())) == 1:
                step[path] = (held, value[rows[inside]][0])
        for held, leaf in step.values():
            margin[held] += RATE * leaf
        found |= {_simplified(path): None for path in paths}
    return [Rule(path) for path in found]


def fit_lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty by accelerated proximal steps; the intercept is not penalized."""
    n, m = z.shape
    design = np.concatenate([np.ones((n, 1)), z], axis=1)
    v = np.ones(m + 1) / np.sqrt(m + 1)
    for _ in range(30):
        v = design.T @ (design @ v)
        v /= np.linalg.norm(v)
    step = 1.0 / (0.25 * np.linalg.norm(design.T @ (design @ v)) / n + 1e-9)
    w, old, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    for _ in range(rounds):
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = w + (t - 1) / grown * (w - old)
        slope = design.T @ (1 / (1 + np.exp(-(design @ ahead))) - y) / n
        old, t = w, grown
        w = ahead - step * slope
        w[1:] = np.sign(w[1:]) * np.maximum(np.abs(w[1:]) - step * penalty, 0)
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    rate = (y.sum() + 1) / (len(y) + 2)
    flat = Ensemble(float(np.log(rate / (1 - rate))), ())
    if not len(y) or y.min() == y.max():
        return flat
    rules = tree_rules(x, y)
    if not rules:
        return flat
    intercept, weights = fit_lasso(np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64), y)
    chosen = sorted(((r, w) for r, w in zip(rules, weights) if abs(w) > 1e-4), key=lambda rw: -abs(rw[1]))
    return Ensemble(round(intercept, 9), tuple(Rule(r.conditions, round(float(w), 9)) for r, w in chosen))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> Ensemble:
    """Fit on at most `sample` labelled rows outside the held-out fold; which ones does not depend on partitions."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y"))
    usable = stats.where(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("_id"))
    count = usable.count()
    if count > sample:
        # a cut through the hashes of the ids: no task sends more than its share, and six deviations keep the rows below
        # `sample`, so that the limit behind it, which takes any rows, has nothing to do
        part, wanted = F.shiftrightunsigned(F.xxhash64("doc_id"), 1), max(sample - 6 * sample**0.5, 0.0)
        usable = usable.where(part < int((2**63 - 1) * (wanted / count)))
    rows = usable.select("doc_id", *STATISTICS, "_y").limit(sample).toPandas()
    rows = rows.sort_values(["doc_id", *STATISTICS, "_y"], kind="stable")
    return fit(rows[list(STATISTICS)].to_numpy(dtype=np.float64), (rows["_y"].to_numpy() == 1).astype(np.float64))


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fold, score and prediction."""
    stats = stored(statistics(docs, id_col, text_col))
    made = train(stats, labels, label_col, sample)
    return stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), made.score().alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
