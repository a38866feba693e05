import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm.quality import keep_by_rules, maximal_repeats, quality_rules, repetition, suffix_array

from .tables import awkward, docs, prose


def brute(seq, least):
    n = len(seq)
    inside, longest, maximal = set(), 0, 0
    for k in range(1, n):
        seen = {}
        for i in range(n - k + 1):
            seen.setdefault(tuple(seq[i : i + k]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                longest = max(longest, k)
                if k >= least:
                    inside |= {i + j for i in at for j in range(k)}
                    left = {seq[i - 1] if i else None for i in at}
                    right = {seq[i + k] if i + k < n else None for i in at}
                    ends = lambda s, edge: len(s) > 1 or edge
                    maximal += bool(ends(left, 0 in at) and ends(right, n - k in at))
    return (len(inside) / n if n else 0.0), longest, maximal


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=40))
def test_against_brute_force(seq):
    ids = np.array(seq, np.uint64)
    covered, longest, n = repetition(ids, 3)
    want = brute(seq, 3)
    if len(seq) > 3:
        assert (round(covered, 9), longest, n) == (round(want[0], 9), want[1], want[2])


def test_suffix_array():
    r = random.Random(0)
    for n in (0, 1, 2, 50, 300):
        ids = np.array([r.randrange(4) for _ in range(n)], np.int64)
        sa, lcp = suffix_array(ids)
        assert list(sa) == sorted(range(n), key=lambda i: list(ids[i:]))
        for a, b, k in zip(sa, sa[1:], lcp):
            assert list(ids[a : a + k]) == list(ids[b : b + k]) and list(ids[a : a + k + 1]) != list(ids[b : b + k + 1])


def test_rules(spark):
    once = prose(5, 400, 10**6)
    rows = [(1, once), (2, once + " " + once), (3, " ".join([once] + once.split()[:60])), (4, "spam spam spam spam spam spam spam")]
    got = {r.doc_id: r for r in quality_rules(docs(spark, rows)).collect()}
    assert got[1].kept and got[1].covered_fraction == 0
    assert not got[2].kept and got[2].covered_fraction == 1 and got[2].longest_repeat == 400
    assert not got[3].kept and got[3].longest_repeat == 60
    assert not got[4].kept
    assert sorted(r.doc_id for r in keep_by_rules(docs(spark, rows)).collect()) == [1]


def test_awkward_rows(spark):
    got = quality_rules(docs(spark, awkward(), extra=True)).collect()
    assert len(got) == len(awkward()) and sum(r.doc_id is None for r in got) == 1
    assert all(r.kept and r.n_words == 0 for r in got if r.doc_id in (1, 2, 3))
    d = docs(spark, awkward(), extra=True)
    assert keep_by_rules(d).columns == d.columns and keep_by_rules(d).count() == len(awkward())


def test_empty_table(spark):
    assert quality_rules(docs(spark, [])).count() == 0 and keep_by_rules(docs(spark, [])).count() == 0
