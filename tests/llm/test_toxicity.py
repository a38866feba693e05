import random
from itertools import combinations

import numpy as np

from auditlake.llm import toxicity
from auditlake.llm.toxicity import kernel, toxic_documents, train

from .tables import awkward, docs, prose

BAD = ["grumbatz", "volkrint", "schnurbel"]
R = random.Random(0)
CLEAN = ["".join(R.choice("bcdfglmnprst") + R.choice("aeiou") for _ in range(R.randrange(1, 5))) for _ in range(1500)]


def disguised(word: str, r: random.Random) -> str:
    kind = r.randrange(4)
    if kind == 0:
        return word
    i = r.randrange(1, len(word))
    if kind == 1:
        return word[:i] + r.choice("*.-x") + word[i:]
    if kind == 2:
        return "-".join(word)
    return word[:i] + "".join(r.choice("aeiou") for _ in range(1)) + word[i:]


def sentences(seed: int, toxic: bool) -> str:
    r = random.Random(seed)
    out = [" ".join(r.choice(CLEAN) for _ in range(8)) + "." for _ in range(5)]
    if toxic:
        out[r.randrange(5)] = f"{r.choice(CLEAN)} {disguised(r.choice(BAD), r)} {r.choice(CLEAN)} {disguised(r.choice(BAD), r)}."
    return " ".join(out)


def test_the_kernel_is_that_of_gapped_subsequences():
    def brute(a, b, decay=0.6):
        def phi(w):
            v = {}
            for at in combinations(range(len(w)), 3):
                k = "".join(w[i] for i in at)
                v[k] = v.get(k, 0) + decay ** (at[2] - at[0] + 1)
            return v

        dot = lambda x, y: sum(v * y.get(k, 0) for k, v in x.items())
        x, y = phi(a), phi(b)
        return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5

    ws = ["idiot", "idxiot", "banana", "abc", "cba"]
    got = kernel(ws, ws)
    want = np.array([[brute(a, b) for b in ws] for a in ws])
    assert np.allclose(got, want, atol=1e-5)
    assert got[0, 1] > 0.5 > got[0, 2]


def test_held_out_accuracy():
    texts, y = zip(*[(sentences(i, i % 4 == 0), int(i % 4 == 0)) for i in range(600)])
    m = train(list(texts[:400]), list(y[:400]))
    said = np.array([m.text_score(t) > 0 for t in texts[400:]])
    truth = np.array(y[400:]) == 1
    assert said[truth].mean() >= 0.9 and said[~truth].mean() <= 0.01


def test_long_texts_are_read_whole():
    texts, y = zip(*[(sentences(i, i % 4 == 0), int(i % 4 == 0)) for i in range(400)])
    m = train(list(texts), list(y))
    clean = " ".join(random.Random(1).choice(CLEAN) for _ in range(50_000))
    assert m.text_score(clean) <= 0 < m.text_score(clean + " grumbatz volkrint schnurbel grumbatz")


def test_awkward_rows(spark):
    rows = [(100 + i, sentences(i, i % 4 == 0)) for i in range(200)]
    d = docs(spark, rows + awkward(), extra=True)
    labels = spark.createDataFrame([(100 + i, None, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    got = toxic_documents(d, labels).collect()
    assert len(got) == 200 + len(awkward())
    by = {r.doc_id: r for r in got}
    assert all(by[i].score is None and not by[i].toxic for i in (1, 2, 3, 5))
    assert sum(by[100 + i].toxic == (i % 4 == 0) for i in range(200)) >= 190


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxic_documents(docs(spark, []), none).count() == 0
    got = toxic_documents(docs(spark, [(1, prose(1, 20))]), none).collect()
    assert [r.toxic for r in got] == [False]


def test_letters_are_scored_once_and_many_texts_together(monkeypatch):
    calls = []
    monkeypatch.setattr(toxicity.Model, "_score", lambda self, ws, f=toxicity.Model._score: calls.append(len(ws)) or f(self, ws))
    r = np.random.default_rng(2)
    model = toxicity.Model(r.normal(size=(2, toxicity.LETTERS_N**3)) * 0.01, [-0.1, -0.1], need=0.5)
    texts = [prose(i, 80) + f" Word{i % 7}, word. WORD! été s t u p i d" for i in range(50)] + [None, "", "a b", "x" * 300_000 + " end"]
    got = model.text_scores(texts)
    scored = {w for t in texts if t for x in toxicity.tokens(t) for w in toxicity.windows(x)}
    assert sum(calls) == len(scored) and len(calls) <= 2
    for bound in (120_000, 50):  # a cache that is too small changes nothing
        alone = toxicity.Model(model.tables, model.biases, need=0.5, bound=bound)
        assert np.allclose(got, [alone.text_score(t) for t in texts], atol=1e-6)
        assert np.allclose(got, toxicity.Model(model.tables, model.biases, need=0.5, bound=bound).text_scores(texts), atol=1e-6)
