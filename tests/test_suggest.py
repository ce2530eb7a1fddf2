"""Suggestions against the comparison of all pairs."""

import random

import pytest

from ledgerweave.functions.similarity import weighted_ratio
from ledgerweave.operators import suggest

WORDS = "acme bank of india ltd traders a b sales tax café ₹ hdfc bnk receivable receivables x".split()


def names(rng, n):
    made = {" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5))) for _ in range(n)}
    made |= {t[:k] + t[k + 1:] for t in list(made)[: n // 2] for k in [rng.randrange(len(t))]}
    return sorted(made | {"", " ", "  \t", "a  b", "zzz", "sales " * 12})


def expected(values, choices, cutoff):
    out = {}
    for value in set(values) - set(choices):
        scored = [(-weighted_ratio(value, c), c) for c in choices]
        if scored and -min(scored)[0] >= cutoff:
            out[value] = (min(scored)[1], -min(scored)[0])
    return out


@pytest.mark.parametrize("cutoff", [0.0, 40.0, 80.0, 95.0])
def test_bounds_leave_the_best(cutoff):
    rng = random.Random(7)
    values, choices = names(rng, 120), names(rng, 120)
    want = expected(values, choices, cutoff)
    unknown = sorted(set(values) - set(choices))
    assert {v: (c, s) for v, c, s in suggest.best_choices(unknown, choices, cutoff)} == want and want
    one, many = suggest._Letters(unknown), suggest._Letters(choices)
    for i, value in enumerate(unknown):
        share = suggest.np.array([bool(one.words[i] & w) for w in many.words])
        bound = suggest._bounds(one, i, many, share)
        assert all(weighted_ratio(value, c) <= b + 1e-6 for c, b in zip(choices, bound))


def test_suggestions_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suggest, "_BLOCK", 25)
    rng = random.Random(3)
    values, choices = names(rng, 50), names(rng, 50)
    frame = lambda texts: spark.createDataFrame([(t,) for t in [*texts, *texts[:5], None]], "value string")
    got = suggest.suggestions(frame(values), frame(choices), 80.0).collect()
    assert {r.value: (r.suggestion, r.score) for r in got} == expected(values, choices, 80.0) and got
    assert suggest.suggestions(frame(values), frame(choices).limit(0)).count() == 0
    assert suggest.suggestions(frame(values).limit(0), frame(choices)).count() == 0
