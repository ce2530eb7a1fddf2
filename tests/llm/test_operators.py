"""Every operator against a plain version on documents with nulls, empty and long texts, ties, repeats and clashing names."""

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain

from ledgerweave.llm import (
    components, fm_decontam, packing, pseudo_likelihood, quality_rules, rule_ensemble, secret_scans, simhash, suffix_dedup, suffix_trees, token_files, tokens, words,
)

ROWS = plain.documents()
BENCH = "item_id long, text string, words string"


@pytest.fixture(scope="module")
def docs(spark):
    return plain.table(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return plain.table(spark, [], 1)


# 1: secrets

def test_base_spans(docs):
    want = []
    for doc, text, _ in ROWS:
        spans = plain.base_secrets(text)
        listed = ",".join(f"{secret_scans.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want.append((doc, *(sum(s[1] == k for s in spans) for k in range(3)), plain.sha(listed.encode())))
    plain.same(secret_scans.scan(docs), ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"], want)


@pytest.mark.parametrize("text", [
    "secret=token: abcdefg", "PASSWORD: 'abcdef", "tſoken=abcdefgh", "api_key=\"x\" apikey = y-12345", "AKIAAKIA" + "A" * 11, "AKIA" + "9" * 15, "f" * 23, "token = " + "ab" * 30,
])
def test_base_spans_of_odd_texts(text):
    assert secret_scans.spans_of(text.encode())[0] == plain.base_secrets(text)


@pytest.mark.parametrize(("text", "found"), [
    ('DB_PWD = "Tr0ub4dor&3x"', ["Tr0ub4dor&3x"]),
    ('const seed = "q8Zr7Lw2Kp90"\nauthToken = seed', ["q8Zr7Lw2Kp90"]),
    ('head = "Zx81kQ"\nsigning_key = head + "77pLmW2r"', ["Zx81kQ", "77pLmW2r"]),
    ("{'client_secret': 'aZ4-91kdkQ2'}", []),  # the base shape has it already
    ('private_key: "${VAULT_KEY}"', []),
    ('token_type = "bearer-v2-long"', []),
    ('title = "Tr0ub4dor&3x"', []),
    ("the key: rest", []),
])
def test_pairs_reach_sensitive_names(text, found):
    base, spans = secret_scans.spans_of(text.encode())
    assert set(base) <= set(spans)
    short = [text[a:b] for a, k, b in spans if k == 3]
    assert [s for s in short if len(s) >= 6] == [f for f in found if len(f) >= 6]


def test_redaction_leaves_no_base_span(docs):
    kept = secret_scans.redact(docs)
    assert kept.schema == docs.schema and kept.count() == len(ROWS)
    for row in kept.collect():
        assert plain.base_secrets(row.text) == [] and (row.text is None or row.n_chars == len(row.text))


# 2: token counts

@pytest.mark.parametrize(("block", "stretch"), [(1 << 18, 4096), (64, 3), (7, 1)])
def test_token_counts_round_trip(docs, block, stretch):
    made = token_files.count_tokens(docs, block=block, stretch=stretch)
    plain.same(made, ["doc_id", "n_tokens"], [(d, len(ids)) for (d, _, _), ids in zip(ROWS, plain.token_ids(ROWS))])
    starts = {}
    for row in made.collect():
        starts.setdefault(row.file, []).append((row.ordinal, row.start, row.n_tokens))
    for listed in starts.values():
        listed.sort()
        assert [o for o, _, _ in listed] == list(range(len(listed)))
        assert all(a[1] + a[2] + 1 == b[1] for a, b in zip(listed, listed[1:]))


def test_scan_of_blocks_without_separators(spark):
    block = lambda *ids: np.array(ids, dtype="<u2").tobytes()
    df = spark.createDataFrame([(0, 0, block(1, 2)), (0, 1, block(3, 4)), (0, 2, block(9, 9)), (0, 3, block(5, 6)), (1, 0, block(7, 8))], "file long, block long, data binary")
    plain.same(token_files.scan(df, 9, 2, 2), ["file", "ordinal", "start", "n_tokens"], [(0, 0, 0, 4), (0, 1, 5, 0)])


# 3: SimHash

def test_simhash(docs):
    want, _ = plain.simhash_rows(ROWS)
    plain.same(simhash.near_duplicates(docs), ["doc_id", "fingerprint", "component_id"], want)


def test_links_of_random_and_hot_buckets(spark):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 30, dtype=np.uint64)
    prints = set(base.tolist())
    for x in base[:10]:
        for _ in range(60):
            flips = r.choice(64, r.integers(1, 5), replace=False)
            prints.add(int(x) ^ sum(1 << int(b) for b in flips))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows, roots = [], list(range(len(prints)))

    def root(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                roots[root(i)] = root(j)
    want = {}
    for i in range(len(prints)):
        want.setdefault(root(i), set()).add(signed[i])
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    for size in (4096, 4):  # 4: buckets are cut again
        made = {}
        for node, top in components.components(simhash.links(df, bucket=size)).collect():
            made.setdefault(top, set()).add(node)
        assert sorted(map(sorted, made.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_one_document_of_each_group_stays(docs):
    _, roots = plain.simhash_rows(ROWS)
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    best = {}
    for k, (d, t, _) in zip(roots, ROWS):
        best.setdefault(k, []).append((d is None, d or 0))
    assert sorted((d is None, d or 0) for d, _ in kept) == sorted(min(v) for v in best.values())


def test_long_chain_of_links(spark):
    n = 200
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (1000, 1001)], "u long, v long")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


# 4 and 9: repeated windows

@pytest.mark.parametrize(("length", "key", "group"), [(400, 64, 4096), (100, 20, 4096), (90, 16, 2), (60, 60, 4096)])
def test_suffix_dedup(docs, length, key, group):
    made = suffix_dedup.remove(docs, length, key, group)
    plain.same(made, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], plain.repeated_bytes(ROWS, length))


@pytest.mark.parametrize(("length", "key", "group"), [(50, 8, 4096), (12, 3, 4096), (12, 3, 1)])
def test_suffix_trees(docs, length, key, group):
    plain.same(suffix_trees.remove(docs, length, key, group), ["doc_id", "n_words", "n_removed", "kept_sha256"], plain.removed_words(ROWS, length))


def test_groups_without_a_repeated_window(spark):
    """Texts share their synchronising strings, but no window."""
    core = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{i} " * 30 + core + f" {i}" * 30, "en") for i in range(6)]
    df = plain.table(spark, rows, 2)
    plain.same(suffix_trees.remove(df), ["doc_id", "n_words", "n_removed", "kept_sha256"], plain.removed_words(rows, 50))
    core = "".join(chr(97 + (i * 7 + i // 5) % 26) for i in range(380))
    rows = [(i, chr(65 + i) * 300 + core + chr(70 + i) * 300, "en") for i in range(4)]
    plain.same(suffix_dedup.remove(plain.table(spark, rows, 2)), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], plain.repeated_bytes(rows, 400))


def test_texts_longer_than_a_piece(spark, monkeypatch):
    from ledgerweave.llm import synchronise

    monkeypatch.setattr(synchronise, "PIECE", 700)
    plain.same(suffix_dedup.remove(plain.table(spark), 100, 20), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], plain.repeated_bytes(ROWS, 100))


# 5: quality rules

def test_quality_base(docs):
    want = [(d, *plain.quality_base(t)) for d, t, _ in ROWS]
    made = quality_rules.quality_rules(docs)
    plain.same(made, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], want)
    assert not made.where("base_failed and kept").count()


def test_fertility(docs):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    made = {(r.doc_id, r.n_words, r.word_chars): r for r in quality_rules.quality_rules(docs).collect()}
    for doc, text, _ in ROWS:
        split = plain.words(text)
        if not split:
            continue
        ids = [i for w in split for i in model.encode(w)]
        row = made[(doc, len(split), sum(map(len, split)))]
        assert row.chars_per_token == pytest.approx(sum(map(len, split)) / len(ids))
        assert row.byte_share == pytest.approx(sum(model.is_byte(i) for i in ids) / len(ids))
        p = np.unique(ids, return_counts=True)[1] / len(ids)
        assert row.token_entropy == pytest.approx(-(p * np.log2(p)).sum())


def test_bands_decide(docs):
    strict = {name: quality_rules.Band(0, 99, 0.0, 0.0) for name in quality_rules.BANDS}
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, bands=strict).collect()}
    assert kept[601] is False  # most of its characters are fallback bytes of the vocabulary or the band says so
    assert quality_rules.script_of("日本語".encode()) == "cjk" and quality_rules.script_of("привет".encode()) == "cyrillic" and quality_rules.script_of(b"abc") == "latin"
    good = quality_rules.keep_good(docs)
    assert good.schema == docs.schema and good.count() == quality_rules.quality_rules(docs).where("kept").count()


# 6: packing

@pytest.mark.parametrize(("capacity", "group"), [(2048, 20_000), (300, 10), (16, 50)])
def test_packing(docs, capacity, group):
    made = packing.pack_documents(docs, capacity=capacity, group=group)
    plain.same(made, ["doc_id", "piece", "start", "length", "ids_crc32"], plain.pieces(ROWS, capacity))
    bins = {}
    for r in made.collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for listed in bins.values():
        at = 0
        for offset, length in sorted(listed):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(p[3] for p in plain.pieces(ROWS, capacity))
    shown = packing.certificate(made, capacity)
    assert shown["sequences"] == len(bins) >= shown["bound"] >= -(-total // capacity)
    assert len(bins) <= -(-total // capacity) * 1.03 + 2


def test_bounds_and_best_fit():
    r = np.random.default_rng(5)
    for _ in range(150):
        sizes = r.integers(1, 30, r.integers(1, 8))
        best = [len(sizes)]

        def place(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(rooms)
                return
            for j in range(len(rooms)):
                if rooms[j] >= sizes[i]:
                    place(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
            place(i + 1, [*rooms, 30 - sizes[i]])

        place(0, [])
        assert packing.bound(*np.unique(sizes, return_counts=True), 30) <= best[0] <= len(packing.best_fit(sizes, 30)[2])
    assert packing.bound(np.array([16]), np.array([10]), 30) == 10


# 7: rule ensemble

def test_rule_ensemble_on_held_out(spark):
    r = np.random.default_rng(2)
    good = ["word", "other", "plain", "text", "more", "here", "goes", "along"]
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        w = [good[k] + ("***" if bad and k % 2 else "") for k in r.integers(0, 8, r.integers(20, 90))]
        rows.append((i, " ".join(w), "en"))
        labels.append((i, None if i % 50 == 0 else int(not bad), "x"))
    rows += [(5000, None, None), (5001, "", None), (None, "abc", None)]
    lab = spark.createDataFrame([*labels, (None, 1, "x"), (9999, 0, "x")], "doc_id long, quality int, text string")
    docs = plain.table(spark, rows)
    made = rule_ensemble.score(docs, lab).collect()
    assert len(made) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in made)
    import zlib
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in made if x.doc_id is not None)
    held = [x for x in made if x.held_out and x.doc_id is not None and x.doc_id < 900]
    assert np.mean([(x.predicted == 1) == (x.doc_id % 4 != 0) for x in held]) > 0.97


def test_the_sample_is_bounded_and_spread(spark):
    rows = [(i, "good words here " * (3 + i % 7) if i % 2 else "bad### words### " * (2 + i % 5), "en") for i in range(600)]
    lab = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")
    stats = rule_ensemble.statistics(plain.table(spark, rows))
    seen = []
    keep, rule_ensemble.fit = rule_ensemble.fit, lambda x, y: seen.append((len(y), y.mean()))
    try:
        rule_ensemble.train(stats, lab, sample=100)
        rule_ensemble.train(stats.repartition(7), lab, sample=100)
    finally:
        rule_ensemble.fit = keep
    assert seen[0] == seen[1] and 15 <= seen[0][0] <= 100 and 0.2 < seen[0][1] < 0.8


def test_compiled_rules_equal_numpy(spark, docs):
    stats = rule_ensemble.statistics(docs).where("doc_id is not null").cache()
    rows = stats.toPandas()
    x = rows[list(rule_ensemble.STATISTICS)].to_numpy(dtype=float)
    made = rule_ensemble.fit(x, (x[:, 3] > np.median(x[:, 3])).astype(float))
    got = stats.select("doc_id", made.score().alias("score")).toPandas()
    assert made.rules and sorted(got["score"]) == pytest.approx(sorted(made.apply(x)))


def test_labels_of_one_class(spark, docs):
    lab = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    assert {r.predicted for r in rule_ensemble.score(docs, lab).collect()} == {1}
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in rule_ensemble.score(docs, none).collect()} == {0.5}


# 8: pseudo-likelihood

def plain_log_probability(w, near, target):
    """The formula of the network for one place, in doubles."""
    h = np.tanh(w["bias"] + sum(w["mix"][k] * w["embed"][c] for k, c in enumerate(near)).astype(float))
    logs = 0.0
    for weights, goal in ((w["group"], target // pseudo_likelihood.MEMBERS), (w["member"][target // pseudo_likelihood.MEMBERS], target % pseudo_likelihood.MEMBERS)):
        x = weights[:, :-1].astype(float) @ h + weights[:, -1]
        logs += x[goal] - np.log(np.exp(x - x.max()).sum()) - x.max()
    return logs


def near_of(of, k):
    return [of[k + o] if 0 <= k + o < len(of) else pseudo_likelihood.EDGE for o in pseudo_likelihood.OFFSETS]


def test_scores_are_sums_of_log_probabilities(docs, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "CHUNK", 200)
    monkeypatch.setattr(pseudo_likelihood, "WINDOW", 100)
    table = pseudo_likelihood.token_table(docs, slices=3)
    which, share, w = pseudo_likelihood.fit(table, slices=3)
    ids = plain.token_ids(ROWS)
    counts = np.bincount(np.concatenate([np.array(i, dtype=int) for i in ids]), minlength=pseudo_likelihood.TOKENS)
    assert (pseudo_likelihood.token_counts(table) == counts).all()
    made = sorted((str(r.doc_id), r.n_tokens, r.log_likelihood, r.mean_log_likelihood) for r in pseudo_likelihood.score_table(table, which, share, w).collect())
    assert sorted((d, n) for d, n, _, _ in made) == sorted((str(d), len(own)) for (d, _, _), own in zip(ROWS, ids))
    want = {}
    for (doc, _, _), own in zip(ROWS, ids):
        if len(own) <= 300:
            of = which[np.array(own, dtype=int)]
            want.setdefault((str(doc), len(own)), []).append(sum(plain_log_probability(w, near_of(of, k), of[k]) + share[token] for k, token in enumerate(own)))
    assert sum(map(len, want.values())) > 10
    for doc, n, total, mean in made:
        if (doc, n) in want:
            assert min(abs(total - t) for t in want[doc, n]) < 1e-3 * max(n, 1)
            assert mean is None if n == 0 else mean == pytest.approx(total / n)


def test_probabilities_sum_to_one():
    w = pseudo_likelihood.initial()
    total = 0.0
    for low in range(0, pseudo_likelihood.EDGE, 64):
        texts = np.stack([np.array([3, 3, 3, c, 3, 3, 3]) for c in range(low, low + 64)])
        total += np.exp(pseudo_likelihood.log_probabilities(w, texts.ravel(), np.full(64, 7)).reshape(64, 7)[:, 3]).sum()
    assert total == pytest.approx(1, abs=1e-4)
    which, share = pseudo_likelihood.classes(np.arange(pseudo_likelihood.TOKENS))
    assert np.bincount(which, np.exp(share)).sum() == pytest.approx(pseudo_likelihood.EDGE)
    counts = np.arange(pseudo_likelihood.EDGE) % 50
    start = pseudo_likelihood.log_probabilities(pseudo_likelihood.initial(counts), np.arange(pseudo_likelihood.EDGE), np.array([pseudo_likelihood.EDGE]))
    assert np.allclose(np.exp(start), (counts + 1) / (counts + 1).sum(), rtol=1e-4)


def test_unsteady_weights_are_exact_too():
    w = pseudo_likelihood.initial()
    w["group"] *= 400
    assert not pseudo_likelihood._steady(w)
    of = np.random.default_rng(5).integers(0, pseudo_likelihood.EDGE, 40)
    found = pseudo_likelihood.log_probabilities(w, of, np.array([15, 0, 25]))
    want = [plain_log_probability(w, near_of(part, k), part[k]) for part in (of[:15], of[15:]) for k in range(len(part))]
    assert np.allclose(found, want, rtol=1e-3, atol=1e-2)


def test_gradient_against_differences():
    random = np.random.default_rng(6)
    w = pseudo_likelihood.initial()
    of, lengths = random.integers(0, 40, 60), np.array([20, 1, 39])
    places, _ = pseudo_likelihood._places(of, lengths)
    made = pseudo_likelihood._Window(w, places, True).gradient()
    loss = lambda: -pseudo_likelihood.log_probabilities(w, of, lengths).sum()
    for name, at in (("embed", (of[3], 2)), ("embed", (pseudo_likelihood.EDGE, 5)), ("mix", (1, 4)), ("bias", (7,)), ("group", (0, 3)), ("member", (1, of[25] % 32, 16)), ("member", (0, 5, 6))):
        old = w[name][at]
        w[name][at] = old + 0.02
        up = loss()
        w[name][at] = old - 0.02
        down = loss()
        w[name][at] = old
        assert (up - down) / 0.04 == pytest.approx(made[name][at], rel=0.05, abs=0.02)


def test_training_learns(spark):
    text = "the cat sat on the mat and the dog sat on the log "
    df = plain.table(spark, [(i, text * (3 + i % 5), "en") for i in range(400)], 2)
    table = pseudo_likelihood.token_table(df)
    which, share, w = pseudo_likelihood.fit(table)
    start = pseudo_likelihood.initial(np.bincount(which, pseudo_likelihood.token_counts(table), minlength=pseudo_likelihood.EDGE))
    mean = lambda weights: pseudo_likelihood.score_table(table, which, share, weights).agg({"mean_log_likelihood": "avg"}).first()[0]
    assert mean(w) > mean(start) + 1


def test_scores_do_not_depend_on_partitions(spark):
    made = []
    for parts in (1, 7):
        rows = [r for r in ROWS if r[0] is not None]
        scored = pseudo_likelihood.score(plain.table(spark, rows if parts == 1 else rows[::-1], parts))
        made.append(sorted((r.doc_id, r.n_tokens, r.log_likelihood) for r in scored.collect()))
    assert [m[:2] for m in made[0]] == [m[:2] for m in made[1]]
    assert all(a[2] == pytest.approx(b[2], rel=1e-6) for a, b in zip(*made))


# 10: decontamination

def bench_items():
    return [(1, ROWS[100 - 60][1]), (2, " ".join(ROWS[10][1].split()[:30])), (3, ROWS[3][1]), (4, None), (5, ""), (6, "Hunter2secret"), (7, "the same"), (None, ROWS[20][1]), (2, "one two three four five one two three four five one two three four")]


@pytest.mark.parametrize(("window", "block"), [(13, 1 << 24), (4, 1 << 24), (13, 700)])
def test_decontamination(spark, docs, window, block):
    items = bench_items()
    bench = spark.createDataFrame([(i, t, "w") for i, t in items], BENCH)
    made = fm_decontam.digest(fm_decontam.find(docs, bench, window, block_bytes=block))
    want = plain.contamination(ROWS, items, window)
    plain.same(made, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], want)
    kept = fm_decontam.drop_contaminated(docs, bench, window, block_bytes=block)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want if not w[-1])


def test_fm_index_against_scans():
    r = np.random.default_rng(4)
    for n, sigma in ((1, 3), (40, 3), (300, 5), (200, 900), (64, 2)):
        sequence = r.integers(1, sigma, n)
        index = fm_decontam.FmIndex(sequence, sigma)
        size = r.integers(1, 5, 60)
        patterns = r.integers(1, sigma, (60, 4)).astype(np.int32)
        for k in range(0, 60, 2):
            at = int(r.integers(0, n))
            size[k] = min(size[k], n - at)
            patterns[k, : size[k]] = sequence[at : at + size[k]]
        low, high = index.search(patterns, size)
        for k in range(60):
            want = [i for i in range(n - size[k] + 1) if (sequence[i : i + size[k]] == patterns[k, : size[k]]).all()]
            assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


# shared parts

def test_word_bpe_equals_the_tokenizer():
    memory = tokens.word_bpe("word_bpe_49k.json")
    texts = [t or "" for _, t, _ in ROWS] + ["it's don't'll", "²3ª", "ΑΣ", "\x01a \xa0a q­z", "a1b22!!Z", "é" * 40, "x" * 300, "ÀÉÑ×ß", "é é"]
    ids, ends = memory.by_text([t.encode() for t in texts])
    for k, text in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == memory.encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    memory = tokens.Memory(tokens.WordBpe("word_bpe_49k.json"))
    for _, text, _ in ROWS[:30]:
        ids, _ = memory.by_text([(text or "").encode()])
        assert ids.tolist() == memory.encode.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_do_not_depend_on_segments(monkeypatch):
    texts = [(t or "").encode() for _, t, _ in ROWS]
    whole = words.words_of(texts, words.NOT_SPACE)
    monkeypatch.setattr(words, "SEGMENT", 50)
    cut = words.words_of(texts, words.NOT_SPACE)
    assert (whole.first == cut.first).all() and (whole.second == cut.second).all() and (whole.offsets == cut.offsets).all()
    assert whole.counts().tolist() == [len(t.split()) for t in texts]


def test_empty_tables(spark, empty):
    bench, labels = spark.createDataFrame([], BENCH), spark.createDataFrame([], "doc_id long, quality int")
    for made in (
        secret_scans.scan(empty), secret_scans.redact(empty), token_files.count_tokens(empty), simhash.near_duplicates(empty), simhash.keep_one(empty),
        suffix_dedup.remove(empty), suffix_trees.remove(empty), quality_rules.quality_rules(empty), quality_rules.keep_good(empty), packing.pack_documents(empty),
        rule_ensemble.score(empty, labels), pseudo_likelihood.score(empty), fm_decontam.find(empty, bench), fm_decontam.drop_contaminated(empty, bench),
    ):
        assert made.count() == 0


def test_names_that_clash_with_keys(spark):
    text = " ".join(f"word{k * k % 977}" for k in range(40))
    clash = [(1, text, 77, 88, 5, 6), (2, text, 78, 89, 6, 7), (3, "another text of its own that nobody else has written down", 79, 90, 7, 8)]
    df = spark.createDataFrame(clash, "doc_id long, text string, _row_id long, _ROW_HASH long, _hash long, _twin long")
    assert sorted(tuple(r) for r in simhash.keep_one(df).collect()) == [clash[0], clash[2]]
    bench = spark.createDataFrame([(1, text, "w"), (2, "some other phrase of the benchmark", "w")], BENCH)
    for block in (1 << 24, 40):
        assert [tuple(r) for r in fm_decontam.drop_contaminated(df, bench, block_bytes=block).collect()] == clash[2:]


def test_empty_benchmark(spark, docs):
    bench = spark.createDataFrame([], BENCH)
    assert fm_decontam.digest(fm_decontam.find(docs, bench)).where("contaminated or n_hit > 0").count() == 0
