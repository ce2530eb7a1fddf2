"""Near copies against brute-force Jaccard, alone and as the stage of the pipeline."""

import os
import random
import sys

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain

import corpus_pipeline
from ledgerweave.llm import near_copies


def kept_ids(rows):
    """Brute force: five words, similarity 0.8, groups by way of others, the smallest id (missing ones last)."""
    sets = []
    for _, text, _ in rows:
        w = plain.words(plain.fold(text))
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                group[root(i)] = root(j)
    best = {}
    for i, (doc, _, _) in enumerate(rows):
        best.setdefault(root(i), []).append((doc is None, doc or 0))
    return sorted(min(v) for v in best.values())


def edited():
    """Copies with more and more changed words, from above the similarity to below it, and texts that share a long passage."""
    r = random.Random(8)
    rows = []
    for base in range(6):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 200))]
        rows.append((1000 + base * 100, " ".join(words), "en"))
        for k in range(1, 12):
            own = list(words)
            for at in r.sample(range(len(own)), k):
                own[at] = f"e{r.randrange(5000)}"
            rows.append((1000 + base * 100 + k, " ".join(own), "en"))
    passage = " ".join(f"p{k}" for k in range(80))
    return rows + [(3000 + k, passage + " " + " ".join(f"q{k}x{j}" for j in range(k)), "en") for k in range(1, 60)]


@pytest.mark.parametrize("bucket", [8, 2])
def test_stage_against_brute_force(spark, monkeypatch, bucket):
    rows = plain.documents() + edited()
    if bucket == 8:
        made = corpus_pipeline.near_dedup(spark, plain.table(spark, rows), "")
    else:
        monkeypatch.setattr(near_copies, "SAMPLE", 1)  # every text in the sample: many common names
        monkeypatch.setattr(near_copies, "TILE", 5)
        monkeypatch.setattr(near_copies, "MEMBERS", 3)
        made = near_copies.keep_one(plain.table(spark, rows), bucket=bucket)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in made.select("doc_id").collect()) == kept_ids(rows)


def test_prefixes_are_as_long_as_needed():
    for n in range(1, 200):
        need = next(o for o in range(1, n + 1) if 5 * o >= 4 * n)
        assert near_copies.prefix_length(n) == n - need + 1
    assert near_copies.alike(8, 8, 10) and not near_copies.alike(79, 80, 99)


def test_no_rows(spark):
    assert near_copies.keep_one(plain.table(spark, [], 1)).count() == 0


def test_parities_bound_the_difference():
    r = random.Random(2)
    texts = [" ".join(f"w{r.randrange(40)}" for _ in range(n)).encode() for n in (3, 30, 300, 3000)]
    sets = list(near_copies.shingles(texts))
    for a in sets:
        for b in sets:
            bits = int.from_bytes(near_copies.parities(a)) ^ int.from_bytes(near_copies.parities(b))
            assert bits.bit_count() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_fingerprints_find_copies_first(spark, monkeypatch):
    """Copies with few changed words are joined by fingerprints alone, and what fingerprints say is verified."""
    r = random.Random(3)
    words = [f"w{r.randrange(9000)}" for _ in range(4000)]
    rows = [(1, " ".join(words), "en"), (2, " ".join([*words[:2000], "other", *words[2001:]]), "en"), (3, " ".join(words[:2000] + words[2001:]), "en")]
    rows += [(10, "a b c d e f g", "en"), (11, "q r s t u v w", "en")]
    source = plain.table(spark, rows)
    marks = near_copies.sets_of(near_copies.id_and_text(source).select("doc_id", "text", *near_copies.row_key()))
    assert marks.select("fp").distinct().count() >= 2
    none = near_copies._met(source.limit(0), near_copies.common_names(source.limit(0).select("text", F.lit(0).alias("row_hash"))), 5, near_copies.SIMILAR, 8)
    monkeypatch.setattr(near_copies, "_met", lambda *_: none)  # nothing from the prefix filter
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, source, "").collect()) == [1, 10, 11]
    monkeypatch.setattr(near_copies, "by_fingerprint", lambda marks: marks.select(F.col("node").alias("u"), F.min("node").over(Window.partitionBy()).alias("v")).where("u <> v"))
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, source, "").collect()) == [1, 10, 11]


def test_only_texts_with_a_pair_travel(spark, monkeypatch):
    source = near_copies.id_and_text(plain.table(spark, [(k, f"text {k} " * 9, "en") for k in range(2000)], 3)).select("doc_id", "text", *near_copies.row_key())
    wanted = source.where("doc_id % 100 = 0").select("row_hash")
    ids = {r.row_id for r in near_copies._packed(source, wanted).collect()}
    assert {k for k in range(2000) if k % 100 == 0} <= ids and len(ids) < 40
    assert near_copies._packed(source, wanted.limit(0)).count() == 0
    monkeypatch.setattr(near_copies, "MARKED", 64)  # a map that is full: all may travel, the result stays
    rows = plain.documents() + edited()[:30]
    made = corpus_pipeline.near_dedup(spark, plain.table(spark, rows), "")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in made.select("doc_id").collect()) == kept_ids(rows)
