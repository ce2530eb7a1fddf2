"""Line dedup, ranked search and hard negatives against plain versions, with nulls, ties, repeats, empty tables and clashing names."""

import math
import os
import re
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain

from ledgerweave.llm import bloom_search, line_dedup, perfect_hash, threshold_mining

ROWS = plain.documents() + [
    (700, "  Shared LINE of some length \nnine char\nonly here once\n\nshared line OF some length\t", "en"),
    (701, "shared line of some length\nnine char\nÄäÖöÜüßßßé\nend", "en"), (702, "x\nÄäÖöÜüßßßé\x0b\nÄÄÖöÜüßßßé", "en"), (703, "\n\n", None),
    (None, "shared line of some length", "en"), (703, "shared line of some length\nbut not this line", "en"), (699, "Shared Line Of Some Length", "en"),
] + [(800 + k, f"the licence line that all of them have\nown line {k} of them\nthe licence line that all of them have", "en") for k in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    return plain.table(spark, ROWS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return plain.table(spark, [], 1)


# 11: lines

def test_perfect_hash_is_minimal():
    random = np.random.default_rng(4)
    for n in (0, 1, 2, 63, 5000):
        first, second = (random.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
        first[: n // 2] = 9  # keys that differ in the second half only
        words, sizes = perfect_hash.build(first, second)
        assert sorted(perfect_hash.places(words, sizes, first, second).tolist()) == list(range(n))
        assert n < 5000 or len(words) * 64 < 5 * n
        others = perfect_hash.places(words, sizes, second + np.uint64(1), first)
        assert ((others >= -1) & (others < max(n, 1))).all()


def plain_lines(rows, least=10):
    key = lambda line: plain.fold(line.strip(" \t\n\v\f\r"))
    low = {}
    for doc, text, _ in rows:
        for line in (text or "").split("\n"):
            low[key(line)] = min(low.get(key(line), plain.LAST), plain.LAST if doc is None else doc)
    out = []
    for doc, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if len(key(line)) < least or low[key(line)] >= (plain.LAST if doc is None else doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("shard", "hot", "merge"), [(1 << 22, 1024, 1 << 20), (3000, 1024, 50), (40000, 2, 7)])
def test_lines_against_plain(docs, monkeypatch, shard, hot, merge):
    monkeypatch.setattr(line_dedup, "MERGE", merge)
    made = line_dedup.remove(docs, shard_bytes=shard, hot=hot)
    plain.same(made, ["doc_id", "n_lines", "n_dropped", "kept"], plain_lines(ROWS))


def test_lines_keep_what_is_short_and_what_is_first(docs):
    made = {}
    for row in line_dedup.remove(docs).collect():
        made.setdefault(row.doc_id, []).append((row.n_lines, row.n_dropped))
    assert made[699] == [(1, 0)] and made[700] == [(5, 2)] and made[701] == [(4, 1)] and made[702] == [(3, 1)]
    assert sorted(made[703]) == [(2, 1), (3, 0)] and made[800] == [(3, 0)] and made[859] == [(3, 2)]


def test_hot_shards_are_copied_within_a_bound(docs):
    indexed, shards = line_dedup.index(docs, shard_bytes=500)
    sizes = [(r.n_keys, r.probes) for r in indexed.collect()]
    assert shards > 50 and sum(n for n, _ in sizes) == len({plain.fold(x.strip(" \t\n\v\f\r")) for _, t, _ in ROWS for x in (t or "").split("\n") if len(x.strip(" \t\n\v\f\r")) >= 10})
    rows = line_dedup.rows_of(docs)
    one, many = (sorted((r.row_id, r.row_hash, sorted(r.lines)) for r in line_dedup.probe(rows, indexed, shards, hot=h).collect()) for h in (1, 1024))
    assert one == many


def test_no_lines(empty):
    assert line_dedup.remove(empty).count() == 0


# 12: search

ITEMS = [
    (1, ROWS[3][1][:200]), (2, None), (3, ""), (4, "words that nobody has written"), (5, ROWS[10][1] + " " + ROWS[11][1]), (5, ROWS[10][1]), (6, "ab"), (6, "ab"),
    (None, "テスト the re an"), (7, "the THE The re"), (8, ROWS[60][1] or "x"), (9, "licence line"),
]


def plain_search(rows, items, top):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", plain.fold(t))
    counts = [Counter(split(t)) for _, t, _ in rows]
    sizes = [sum(c.values()) for c in counts]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    out = []
    for item, text in items:
        terms = set(split(text))
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for c in counts) + 1))) for t in terms}
        scored = []
        for (doc, _, _), c, size in zip(rows, counts, sizes):
            m = 50 + (50 * size * n) // length
            score = sum(w * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weight.items() if t in c)
            scored.append((-score, plain.LAST if doc is None else doc, doc))
        scored = sorted((s for s in scored if s[0] < 0), key=lambda s: s[:2])[:top]
        out += [(item, k, doc, -score) for k, (score, _, doc) in enumerate(scored, 1)]
    return out


def asked(spark, items):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in items], "item_id long, text string, doc_id string, score int")


@pytest.mark.parametrize(("top", "items", "sent", "size"), [(50, 256, 100_000, 4 << 20), (7, 4, 0, 300), (1, 256, 100_000, 4 << 20)])
def test_search_against_plain(spark, docs, monkeypatch, top, items, sent, size):
    monkeypatch.setattr(bloom_search, "ITEMS", items)
    monkeypatch.setattr(bloom_search, "SENT", sent)
    monkeypatch.setattr(bloom_search, "BYTES", size)
    made = bloom_search.search(docs, asked(spark, ITEMS), top)
    plain.same(made, ["item_id", "rank", "doc_id", "score"], plain_search(ROWS, ITEMS, top))


def test_sums_are_never_below_scores(docs):
    items = bloom_search.items_of([(k, t) for k, (_, t) in enumerate(ITEMS)])
    index = bloom_search.signatures(docs)
    items = bloom_search.with_statistics(items, docs, index)
    once = Counter(d for d, _, _ in ROWS if d is not None)
    exact = {(i, d): s for i, _, d, s in plain_search(ROWS, [(k, t) for k, (_, t) in enumerate(ITEMS)], 10**6) if once[d] == 1}
    sums, seen, closest = bloom_search._Bounds(items), 0, []
    for row in index.collect():
        ids, _, bound = sums.of(row.asDict())
        for (item, doc), score in exact.items():
            for column in np.flatnonzero(ids == doc):
                seen += 1
                assert bound[item, column] >= score
                closest.append(score / bound[item, column])
    assert seen == len(exact) and np.median(closest) > 0.7


def test_frequencies_of_cut_texts():
    text = ("alpha beta gamma " * 50 + "delta").encode()
    whole, cut = (bloom_search.entries([text, b"", b"alpha"], size) for size in (1 << 20, 16))
    assert all((a == b).all() for a, b in zip(whole, cut)) and whole[3].tolist() == [151, 0, 1]


def test_search_of_nothing(spark, docs, empty):
    assert bloom_search.search(empty, asked(spark, ITEMS)).count() == 0
    assert bloom_search.search(docs, asked(spark, [])).count() == 0


# 13: hard negatives

def vectors():
    random = np.random.default_rng(8)
    rows = []
    for k in range(160):
        label = k % 5
        rows.append((k, [float(x) for x in np.round(random.normal(label / 4, 0.4, 6), 2)], label))
    rows += [(300 + k, list(rows[20][1]), 3) for k in range(30)]  # a common vector
    rows += [(20, list(rows[20][1]), 0), (40, list(rows[40][1]), 1), (40, list(rows[40][1]), 1)]
    rows += [(None, list(rows[7][1]), 2), (None, None, 2), (200, None, 1), (210, [0.1] * 6, None), (220, [0.1, None, 0.2, 0.3, 0.4, 0.5], 1)]
    rows += [(230, [float("nan")] * 6, 1), (240, [float("inf")] + [0.0] * 5, 1), (250, [1.0, 0.5], 1), (260, [], 4), (270, [0.0] * 6, 2), (280, [-1.5] * 6, 2), (290, [1e30] * 6, 2)]
    return rows


def plain_negatives(rows, every=10, first=5, most=10):
    good = [(LAST if i is None else i, [math.floor(256 * x) for x in v], (l + 1) % 10 if i is not None and i % 7 == 0 else l, i) for i, v, l in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x) < 1e6 for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a[1], b[1]))
    out = []
    for k, a in enumerate(good):
        if a[3] is None or a[3] % every:
            continue
        order = lambda some: sorted(some, key=lambda x: (-x[0], x[1]))
        same = order([(dot(a, b), b[0], b[3]) for j, b in enumerate(good) if j != k and b[2] == a[2]])[:first]
        other = order([(dot(a, b), b[0], b[3]) for b in good if b[2] != a[2]])
        for ps, _, positive in same:
            out += [(a[3], positive, r, n, ps, s) for r, (s, _, n) in enumerate([o for o in other if 30 * ps <= 100 * o[0] <= 90 * ps][:most], 1)]
    return out


LAST = plain.LAST
VECTORS = "vec_id long, embedding array<float>, label int, id string, score int, rows int"


def embeddings(spark, rows, parts):
    return spark.createDataFrame([(i, v, l, "clash", 1, 2) for i, v, l in rows], VECTORS).repartition(parts)


@pytest.mark.parametrize(("parts", "rows", "depth", "room"), [(3, 1 << 14, 64, 8 << 20), (2, 16, 2, 8 << 20), (1, 1 << 14, 1, 200)])
def test_negatives_against_plain(spark, monkeypatch, parts, rows, depth, room):
    monkeypatch.setattr(threshold_mining, "BLOCK_ROWS", rows)
    monkeypatch.setattr(threshold_mining, "DEPTH", depth)
    table = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for i, v, l in vectors()]
    made = threshold_mining.mine(embeddings(spark, vectors(), parts), every=10, anchor_bytes=room)
    plain.same(made, ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"], plain_negatives(table))


def test_walk_stops_before_it_has_met_all():
    random = np.random.default_rng(2)
    components = random.integers(-200, 200, (4000, 3))
    orders = np.ascontiguousarray(np.argsort(components, axis=0, kind="stable").astype(np.uint16).T)
    names = np.arange(4000)
    block = threshold_mining.Block({"n": 4000, "rows": names.tobytes(), "ids": names.tobytes(), "labels": (names % 4).tobytes(), "components": components.tobytes(), "orders": orders.tobytes()}, 3)
    anchor, met = components[0], []
    walked = block.walk
    block.walk = lambda a: ((met.append(len(step[0])), step)[1] for step in walked(a))
    best = threshold_mining.Best(5)
    threshold_mining.nearest(block, anchor, 0, 0, best)
    exact = sorted((-int(components[j] @ anchor), j) for j in range(4, 4000, 4))[:5]
    assert [(-s, i) for s, i in zip(best.score.tolist(), best.id.tolist())] == exact and sum(met) < 2000


def test_large_components_are_exact(spark):
    big = 2.0**19
    rows = [(10, [big, 1.0], 1), (20, [big, 0.5], 1), (31, [big * 0.5, 0.25], 2), (32, [big * 0.5, 0.5], 2)]
    plain.same(threshold_mining.mine(embeddings(spark, rows, 1), every=10), ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"], plain_negatives(rows))


def test_no_vectors(spark):
    assert threshold_mining.mine(embeddings(spark, [], 1)).count() == 0
    assert threshold_mining.mine(embeddings(spark, [(100, None, 1), (200, [None], 1)], 1)).count() == 0


def test_texts_meet_candidates_in_one_way(spark, docs):
    """Whether texts are shuffled does not depend on how many candidates there are; only what the items bound is broadcast."""
    made = bloom_search.search(docs, asked(spark, ITEMS), 5)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
