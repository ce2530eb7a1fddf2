"""'Did you mean': the best value of a set for each unknown value."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.similarity import weighted_ratio

CUTOFF = 80.0  # fixed value: weighted ratio a suggestion must reach
_BLOCK = 4000  # values of the set, and unknown values, that one task compares at a time
_CLASSES = 64  # letters are counted by code point modulo this; classes that meet only loosen the bound
_SLACK = 1e-6  # rounding of bounds

_OUT = "value string, choice string, score double"


class _Letters:
    """Letter counts, lengths and words of some texts."""

    def __init__(self, texts: list[str]):
        words = [t.split() for t in texts]
        self.words = [set(w) for w in words]
        self.size = np.array([len(t) for t in texts], dtype=np.float64)
        self.own = np.array([sum(map(len, w)) for w in words], dtype=np.float64)
        self.gaps = np.array([max(len(w) - 1, 0) for w in words], dtype=np.float64)
        self.blanks = self.size - self.own
        # texts without words, or with one twice, are compared whatever the bound
        self.odd = np.array([not w or len(w) != len(set(w)) for w in words], dtype=bool)
        self.counts = np.zeros((len(texts), _CLASSES), dtype=np.int32)
        codes = np.fromiter((ord(c) % _CLASSES for w in words for part in w for c in part), dtype=np.int64)
        np.add.at(self.counts, (np.repeat(np.arange(len(texts)), self.own.astype(np.int64)), codes), 1)


def _bounds(one: _Letters, i: int, many: _Letters, share: np.ndarray) -> np.ndarray:
    """Upper bounds of the weighted ratio of text `i` of `one` with each of `many`; `share` marks those with a word in common.

    A common subsequence is no longer than the letters in common, and the words in any order have the same letters. A part
    of the longer text that meets c letters of the shorter one (s letters) is c letters long at best, so its ratio is 2c / (s + c).
    """
    letters = np.minimum(one.counts[i], many.counts).sum(axis=1)
    common = letters + np.minimum(one.blanks[i], many.blanks)
    short, long = np.minimum(one.size[i], many.size), np.maximum(one.size[i], many.size)
    plain = 200 * common / np.maximum(short + long, 1)
    words = letters + np.minimum(one.gaps[i], many.gaps)
    left, right = one.own[i] + one.gaps[i], many.own + many.gaps
    sure = share | one.odd[i] | many.odd
    sorted_words = np.where(sure, 100, 200 * words / np.maximum(left + right, 1))
    part = 200 * common / np.maximum(short + common, 1)
    part_words = np.where(sure, 100, 200 * words / np.maximum(np.minimum(left, right) + words, 1))
    alike = long < 1.5 * short
    scale = np.where(long <= 8 * short, 0.9, 0.6)
    return np.where(alike, np.maximum(plain, 0.95 * sorted_words), np.maximum(plain, np.maximum(scale * part, 0.95 * scale * part_words)))


def best_choices(values: list[str], choices: list[str], cutoff: float) -> list[tuple[str, str, float]]:
    """(value, choice, score) of the best choice of each value that reaches the cutoff, the first by name of several.

    Choices are scored from the highest bound down, until no bound reaches the best score.
    """
    one, many, out = _Letters(values), _Letters(choices), []
    where: dict[str, list[int]] = {}
    for j, words in enumerate(many.words):
        for word in words:
            where.setdefault(word, []).append(j)
    for i, value in enumerate(values):
        share = np.zeros(len(choices), dtype=bool)
        for word in one.words[i]:
            share[where.get(word, [])] = True
        bound = _bounds(one, i, many, share)
        near = np.flatnonzero(bound >= cutoff - _SLACK)
        top, name = -1.0, ""
        for j in near[np.argsort(-bound[near], kind="stable")]:
            if bound[j] < top - _SLACK:
                break
            score = weighted_ratio(value, choices[j])
            if score > top or (score == top and choices[j] < name):
                top, name = score, choices[j]
        if top >= cutoff:
            out.append((value, name, top))
    return out


def suggestions(values: DataFrame, choices: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(value, suggestion, score) for distinct unknown values with a close choice; ties go to the first by name.

    Nothing runs while this is planned. Unknown values and the set are cut into blocks of about `_BLOCK`, by counts that
    are one row each; a task compares one block with one other. A bound from letter counts leaves few pairs to score in full.
    A value leaves a task at most once per block; pairs are never emitted. Nulls and repeated choices count for nothing.
    """
    known = choices.select(F.col("value").alias("choice")).filter(F.col("choice").isNotNull()).distinct()
    unknown = values.select("value").filter(F.col("value").isNotNull()).distinct()
    unknown = unknown.join(known, unknown["value"] == known["choice"], "left_anti")
    cut = F.expr(f"cast(greatest(1, ceil(count(*) / {_BLOCK})) as int)")
    counts = known.agg(cut.alias("blocks")).crossJoin(F.broadcast(unknown.agg(cut.alias("cells"))))  # one row
    left = unknown.crossJoin(F.broadcast(counts)).select(
        "value", F.pmod(F.xxhash64("value"), "cells").cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = known.crossJoin(F.broadcast(counts)).select(
        "choice", F.pmod(F.xxhash64("choice"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(best_choices(a["value"].tolist(), b["choice"].tolist(), cutoff), columns=["value", "choice", "score"])

    found = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInPandas(compare, schema=_OUT)
    return found.groupBy("value").agg(
        F.min_by("choice", F.struct(-F.col("score"), F.col("choice"))).alias("suggestion"), F.max("score").alias("score"))
