import random

import numpy as np
import pandas as pd

from ledgerweave.functions import similarity as sim
from ledgerweave.functions.text import norm
from ledgerweave.operators import resolve as R
from test_vouchers import frame


def masters(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "ex_id long, name string, parent string, guid string")


EXISTING = [("HDFC Bank", "Bank Accounts", "g-hdfc"), ("Cash", "Cash-in-Hand", "g-cash")]


def verdicts(spark, incoming, existing=EXISTING, **options):
    rows = R.resolve(frame(spark, incoming), masters(spark, existing), **options).orderBy("source_row").collect()
    return rows


def test_decisions(spark):
    got = verdicts(spark, [
        dict(name="HDFC Bank", parent="Bank Accounts"), dict(name="HDFC Bank", parent="Sundry Debtors"),
        dict(name="  hdfc   bank ", parent=None), dict(name="Reliance Industries", parent="Sundry Debtors"),
        dict(name="HDFC Bnk", parent="Bank Accounts"), dict(name=None, parent=None),
    ])
    assert [(r.decision, r.action, r.matched_name, r.matched_guid) for r in got] == [
        ("update", "Alter", "HDFC Bank", "g-hdfc"), ("update", "Alter", "HDFC Bank", "g-hdfc"),
        ("update", "Alter", "HDFC Bank", "g-hdfc"), ("create", "Create", None, None),
        ("conflict", None, "HDFC Bank", "g-hdfc"), ("create", "Create", None, None),
    ]
    assert [r.score for r in got] == [1.0, 0.9, 0.9, 0.0, 0.3933, 0.0]
    assert [c.name for c in got[0].candidates] == ["HDFC Bank"]


def test_duplicates_conflict_and_sound_block(spark):
    existing = [("Cash", "A", "1"), ("cash ", "B", "2"), ("Philips", "C", "3")]
    got = verdicts(spark, [dict(name="Cash", parent=None), dict(name="Filips", parent="C")], existing)
    assert (got[0].decision, [c.guid for c in got[0].candidates]) == ("conflict", ["1", "2"])
    assert got[1].matched_name == "Philips"  # F and Ph sound alike; the prefixes differ
    assert verdicts(spark, [dict(name="Filips", parent="C")], existing, kinds=("prefix",))[0].matched_name is None


def test_empty_snapshot(spark):
    existing = masters(spark, EXISTING).limit(0)
    rows = R.resolve(frame(spark, [dict(name="Cash", parent="x")]), existing).collect()
    assert [r.decision for r in rows] == ["create"]


def test_tiles_match_brute_force(spark, monkeypatch):
    """One block holds nearly all names; tiny tiles must give what scoring every pair gives."""
    rng = random.Random(5)
    names = [f"Cust {rng.randint(0, 400):03d}{rng.choice('abc')}" for _ in range(120)] + ["Kash", "Qash", "other"]
    existing = [(n, rng.choice(["P", "Q", ""]), str(i)) for i, n in enumerate(names)]
    incoming = [dict(name=rng.choice(names) + rng.choice(["", "x", " "]), parent=rng.choice(["p", "Q", None])) for _ in range(60)]
    monkeypatch.setattr(R, "_TILE", 16)
    monkeypatch.setattr(R, "_PAIRS", 50)
    got = verdicts(spark, incoming, existing)
    texts = sorted({n.lower().strip() for n in names} | {r["name"].lower().strip() for r in incoming})
    sound = {r.t: r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", sim.metaphone(norm("t")).alias("m")).collect()}
    for row, source in zip(got, incoming):
        a, pa = source["name"].lower().strip(), (source["parent"] or "").lower()
        scored = []
        for i, (name, parent, guid) in enumerate(existing, 1):
            b = name.lower()
            if a[:4] != b[:4] and sound[a] != sound[b]:
                continue
            jw = float(sim.jaro_winkler([a], [b])[0])
            score = 0.6 * (a == b) + 0.3 * jw + 0.1 * (pa != "" and pa == parent.lower())
            scored.append((-round(score, 10), i, guid, jw, a == b))
        scored.sort()
        assert [(c.guid, c.score) for c in row.candidates or []] == [(g, round(-s, 4)) for s, _, g, _, _ in scored[:3]]
        best, second = scored[0], scored[1] if len(scored) > 1 else None
        ambiguous = bool(second) and -second[0] >= 0.85 and (second[0] - best[0]) < 0.05
        if (best[4] or -best[0] >= 0.95) and not ambiguous:
            expected = "update"
        else:
            expected = "conflict" if ambiguous or -best[0] >= 0.85 or best[3] >= 0.9 else "create"
        assert row.decision == expected


def test_large_tile_ranks_few_pairs(monkeypatch):
    """Names that differ in a few digits: the best three of every key are those of all pairs, yet few pairs are made."""
    rng = random.Random(3)
    members = [(f"customer#{i:09d}", "pqrst"[rng.randrange(5)], i) for i in rng.sample(range(10000), 1500)]
    keys = [(n if i % 2 else n[:4] + n[5:], p) for n, p, i in members[:300]] + [("customers", ""), ("custom", "p")]
    row = lambda side, name, parent, first: ("p:cust", 0, 0, side, name, parent, first, np.nan)
    data = pd.DataFrame([row(0, *m) for m in members] + [row(1, *k, None) for k in keys],
                        columns=["block", "c", "r", "side", "name", "parent", "ex_first", "floor"])
    done = []
    plain = R._rank_in_runs
    monkeypatch.setattr(R, "_rank_in_runs", lambda values: done.append(len(values)) or plain(values))
    got = pd.concat(R._score_tiles(iter([data])))
    best = {k: sorted(zip(-g["score"], g["ex_first"])) for k, g in got.groupby(["in_name", "in_parent"])}
    assert len(best) == len(set(keys)) and sum(done) < 0.25 * len(keys) * len(members), sum(done)
    for name, parent in keys:
        jw = sim.jaro_winkler([name] * len(members), [m[0] for m in members])
        every = sorted((-round(0.6 * (name == n) + 0.1 * (parent == p and p != "") + 0.3 * float(x), 10), i) for x, (n, p, i) in zip(jw, members))
        assert [i for _, i in best[name, parent]] == [i for _, i in every[:3]]


def test_apply(spark):
    incoming = frame(spark, [dict(name="cash", parent="x"), dict(name="HDFC Bnk", parent="y"), dict(name="New", parent="z")])
    marks = R.resolve(incoming, masters(spark, EXISTING))
    kept, held = R.apply_verdicts(incoming, marks)
    assert {(r.name, r._action, r.guid, r.old_name) for r in kept.collect()} == {
        ("cash", "Alter", "g-cash", None), ("New", "Create", None, None),
    }
    assert [r.name for r in held.collect()] == ["HDFC Bnk"]
    assert {(r.decision, r.n) for r in R.resolve_summary(marks).collect()} == {("update", 1), ("conflict", 1), ("create", 1)}


def test_metaphone(spark):
    cases = {
        "hdfc bank": "HTFK BNK", "thumb": "0M", "knight": "NT", "philips": "FLPS", "school": "SKL", "science": "SNS", "scene": "SN", "scythe": "S0",
        "cash": "KX", "wright": "RT", "xavier": "SFR", "judge": "JJ", "whale": "WL", "city": "ST", "acacia": "AKX",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.m for r in df.select("t", sim.metaphone("t").alias("m")).collect()}
    assert got == cases
    assert got["philips"] == sim_code(spark, "filips") and got["cash"] == sim_code(spark, "kash")
    assert got["hdfc bank"] == "HTFK BNK" and got["wright"][0] == "R" and got["city"] == "ST" and got["thumb"] == "0M"


def sim_code(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(sim.metaphone("t")).first()[0]
