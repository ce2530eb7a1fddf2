"""Places where an operator once did less than its whole job."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain

from ledgerweave.llm import pseudo_likelihood, secret_scans, suffix_dedup, suffix_trees


def test_every_position_is_a_target_once(spark, monkeypatch):
    table = pseudo_likelihood.token_table(plain.table(spark), slices=4)
    taken = []
    whole = pseudo_likelihood.gradient
    monkeypatch.setattr(pseudo_likelihood, "gradient", lambda *args: (lambda made: (taken.append(made[1]), made)[1])(whole(*args)))
    pseudo_likelihood.fit(table, slices=4)
    assert len(taken) == 4 and all(taken) and sum(taken) == sum(map(len, plain.token_ids(plain.documents())))


def test_names_added_to_themselves():
    doubled = 'a = "k3Jd92mZq81xPw"\n' + "a = a + a\n" * 60 + "api_secret = a\n"
    assert secret_scans.pair_spans(doubled) == [(5, 19)]
    grown = 's = "k3Jd92mZq81xPw"\n' + 't = s + "x"\ns = t + "y"\n' * 20000 + "api_secret = s\n"
    assert secret_scans.pair_spans(grown) == [(5, 19)]


@pytest.mark.parametrize(("operator", "args"), [(suffix_dedup, (100, 20)), (suffix_trees, (12, 3))])
def test_ranges_of_copies_are_listed_once(spark, operator, args):
    text = " ".join(f"word{k * k % 977}" for k in range(300))
    sizes = []
    for copies in (2, 30):
        rows = [(1, text, "en")] + [(None, text, "en")] * copies
        _, spans = operator.repeated_spans(plain.table(spark, rows), *args)
        sizes.append(sorted(len(r.spans) for r in spans.collect()))
    assert sizes[0] == sizes[1] and sizes[0]
