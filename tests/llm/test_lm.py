import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from auditlake.llm import lm
from auditlake.llm.common import hash64, words

from .tables import awkward, docs, prose, shuffled

LOW = (1 << 48) - 1


def pairs(rows):
    out = Counter()
    for _, t in rows:
        w = [hash64(x) & LOW for x in words(t)]
        out.update(zip([0, *w], w))
    return out


def test_the_corpus_is_counted_whole(spark):
    rows = [(i, prose(i, 50, 40)) for i in range(30)] + [(None, "the end"), (31, None)]
    got = Counter()
    for _, group in lm.blobs(docs(spark, rows), 5).toPandas().groupby("part"):
        p = lm.Part(group)
        got.update({(int(p.contexts[o]), int(w)): int(n) for o, w, n in zip(p.of, p.word, p.c)})
    assert got == pairs(rows)


def test_chunks_do_not_matter(spark, monkeypatch):
    rows = [(i, prose(i, 50, 40)) for i in range(30)]
    want = sorted(map(tuple, lm.lm_scores(docs(spark, rows), parts=3).select("doc_id", "n_words").collect()))
    monkeypatch.setattr(lm, "CHUNK_WORDS", 100)
    got = lm.lm_scores(docs(spark, rows), parts=3)
    assert sorted(map(tuple, got.select("doc_id", "n_words").collect())) == want == [(i, 50) for i in range(30)]


def plain(rows, d=lm.DISCOUNT, theta=lm.STRENGTH, sweeps=40):
    """The same model, a customer at a time: bits per word of every row, averaged over seatings."""
    rng = np.random.default_rng(5)
    c = pairs(rows)
    total = Counter()
    for (x, _), n in c.items():
        total[x] += n
    t = {k: 1 for k in c}
    mean = Counter()
    for s in range(sweeps):
        cust = Counter()
        for (_, w), k in t.items():
            cust[w] += k
        every, v = sum(cust.values()), len(cust)
        base = {w: (k - d + (theta + d * v) * lm.BASE) / (theta + every) for w, k in cust.items()}
        tables = Counter()
        for (x, _), k in t.items():
            tables[x] += k
        for (x, w), n in c.items():
            others, k = tables[x] - t[x, w], 1
            for done in range(1, n):
                new = (theta + d * (k + others)) * base[w]
                k += rng.random() < new / (done - d * k + new)
            tables[x] += k - t[x, w]
            t[x, w] = k
        if s >= 10:
            for (x, w), n in c.items():
                mean[x, w] += (n - d * t[x, w] + (theta + d * tables[x]) * base[w]) / (theta + total[x]) / (sweeps - 10)
    out = {}
    for i, text in rows:
        w = [hash64(x) & LOW for x in words(text)]
        out[i] = -sum(math.log2(mean[k]) for k in zip([0, *w], w)) / len(w)
    return out


def test_against_a_plain_sampler(spark):
    rows = [(i, prose(i, 60, 25)) for i in range(40)]
    want = plain(rows)
    got = {r.doc_id: r.bits_per_word for r in lm.lm_scores(docs(spark, rows), parts=4).collect()}
    assert all(got[i] == pytest.approx(want[i], rel=0.04) for i in want)
    assert np.mean(list(got.values())) == pytest.approx(np.mean(list(want.values())), rel=0.01)


def test_probabilities_of_a_context_sum_to_less_than_one():
    rows = [(i, prose(i, 200, 30)) for i in range(10)]
    from auditlake.llm.common import WordHashes

    h = WordHashes()
    names = [x.split()[0] for x in lm.BLOB.split(", ")]
    p = lm.Part(pd.DataFrame(lm.pack(0, [i for i, _ in rows], [h(words(t)) for _, t in rows], 1), columns=names))
    base = np.full(len(p.c), 1 / 30)
    p.sweep(base, 0.7, 1.0, 0)
    sums = np.bincount(p.of, p.predictive(base, 0.7, 1.0))
    assert sums.max() <= 1 + 1e-9 and sums[p.contexts != 0].min() > 0.8


def expected(c, base, others, d, theta):
    """The exact distribution of the number of tables."""
    p = np.zeros(c + 2)
    p[1] = 1.0
    k = np.arange(c + 2)
    for done in range(1, c):
        new = (theta + d * (k + others)) * base
        x = np.where(p > 0, new / np.maximum(done - d * k + new, 1e-12), 0)
        q = p * (1 - x)
        q[1:] += (p * x)[:-1]
        p = q
    return p


@pytest.mark.parametrize("c, base, others", [(20, 0.1, 0), (33, 0.1, 3), (400, 0.05, 10), (3000, 0.3, 0), (500, 1e-4, 50)])
def test_seating_follows_the_exact_law(c, base, others):
    n = 6000
    t = lm.seat(np.full(n, c), np.full(n, base), np.full(n, float(others)), 0.5, 1.0, lm.mix(np.arange(n, dtype=np.uint64) + np.uint64(12345)))
    p = expected(c, base, others, 0.5, 1.0)
    k = np.arange(c + 2)
    mean, sd = (p * k).sum(), np.sqrt((p * k * k).sum() - (p * k).sum() ** 2)
    assert t.min() >= 1 and t.max() <= c
    assert abs(t.mean() - mean) < 4 * sd / n**0.5 + 1e-9 and t.std() == pytest.approx(sd, rel=0.06, abs=0.02)
    half = np.searchsorted(np.cumsum(p), 0.5)
    assert abs((t <= half).mean() - np.cumsum(p)[half]) < 0.03


def test_parts_do_not_matter(spark):
    rows = [(i, prose(i, 60, 25)) for i in range(40)] + [(50, "the cat and the dog and " * 200)]
    a, b = ({r.doc_id: r.bits_per_word for r in lm.lm_scores(docs(spark, rows), parts=n).collect()} for n in (1, 5))
    assert a == pytest.approx(b, rel=1e-5)


def test_likely_text_has_lower_perplexity(spark):
    rows = [(i, "the cat sat on the mat and the dog sat on the rug " * 5) for i in range(20)] + [(99, " ".join(f"odd{k}" for k in range(60)))]
    got = {r.doc_id: r for r in lm.lm_scores(docs(spark, rows)).collect()}
    assert got[0].perplexity < got[99].perplexity / 3
    assert got[0].perplexity == pytest.approx(2 ** got[0].bits_per_word)


def test_awkward_rows(spark):
    got = lm.lm_scores(docs(spark, awkward(), extra=True)).collect()
    assert len(got) == len(awkward())
    by = {r.doc_id: r for r in got}
    assert all(by[i].perplexity is None and by[i].n_words == 0 for i in (1, 2, 3, 5))
    assert all(math.isfinite(r.perplexity) for i, r in by.items() if i not in (1, 2, 3, 5)) and None in by


def test_empty_table(spark):
    assert lm.lm_scores(docs(spark, [])).count() == 0


def test_crowds_are_seated_as_one_by_one():
    r = np.random.default_rng(4)
    n = 300
    c, base, others = np.append(r.integers(33, 3000, n), 40), np.append(10.0 ** r.uniform(-4, -0.5, n), 0.2), np.append(10.0 ** r.uniform(0, 4, n), 50.0)
    key = lm.mix(np.arange(n + 1, dtype=np.uint64))
    one_by_one = lm.seat(c, base, others, 0.7, 1.0, key, steps=3000)
    start = lm.seat(np.minimum(c, 32), base, others, 0.7, 1.0, key)
    assert (lm.seat_crowds(c, start, base, others, 0.7, 1.0, key, 32) == one_by_one).all() and one_by_one.max() > 500


def test_a_dish_of_many_tables_takes_few_steps(monkeypatch):
    calls = []
    monkeypatch.setattr(lm, "uniform", lambda key, step, f=lm.uniform: calls.append(step) or f(key, step))
    t = lm.seat(np.array([600_000]), np.array([0.05]), np.array([2e4]), 0.7, 1.0, lm.mix(np.arange(1, dtype=np.uint64)))
    assert 5000 < t[0] < 8000 and len(calls) < 100


def test_the_next_to_open_is_found_exactly():
    r = np.random.default_rng(5)
    n = 2000
    x, a, left = r.uniform(10, 1e4, n), 10.0 ** r.uniform(-4, 2, n), r.integers(1, 20_000, n).astype(float)
    limit = np.log(r.uniform(size=n)) - lm.lgamma(x + a) + lm.lgamma(x)
    some = lm.lgamma(x + left) - lm.lgamma(x + left + a) < limit
    x, a, left, limit = x[some], a[some], left[some], limit[some]
    got = lm.first_to_open(x, a, limit, left)
    for i, m in enumerate(got):
        every = np.arange(0, left[i] + 1)
        assert m == np.flatnonzero(lm.lgamma(x[i] + every) - lm.lgamma(x[i] + every + a[i]) < limit[i])[0]


def test_tables_are_worked_out_and_shuffled_once_a_round(spark):
    rows = [(i, prose(i, 500)) for i in range(40)]
    v = len({w for _, t in rows for w in words(t)})
    _, n = shuffled(spark, lambda: lm.lm_scores(docs(spark, rows), parts=1).write.format("noop").mode("overwrite").save())
    assert v > 2000 and 2 * lm.ROUNDS * v <= n < 2.5 * lm.ROUNDS * v  # tables to the words, probabilities back
