import random

import numpy as np
import pytest

from auditlake.llm.pieces import MODEL, PieceCoder, decode_column, encode_documents, scan, times

from .tables import awkward, docs, prose


@pytest.fixture(scope="module")
def own():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_the_scan_is_that_of_single_steps():
    r = np.random.default_rng(0)
    ms = [r.random((3, 3)) for _ in range(9)]
    step = [ms[0]]
    for m in ms[1:]:
        step.append(times(step[-1], m))
    assert all(np.allclose(a, b) for a, b in zip(scan(ms), step))


def test_ids_are_the_models_own(own):
    coder, r = PieceCoder(), random.Random(3)
    letters = "abc dé  ñ文\n\t.,▁\U0001f600"
    for n in [0, 1, 2, 5, 30, 200] * 20:
        t = "".join(r.choice(letters) for _ in range(n))
        assert coder.encode(t).tolist() == own.encode(t)
        assert coder.decode(own.encode(t)) == own.decode(own.encode(t))


@pytest.mark.parametrize("chunk", [64, 100, 1000])
def test_giant_texts_in_chunks(spark, own, chunk):
    r = random.Random(chunk)
    texts = [prose(1, 700), "a" * 700, " " * 500, "x" + "  y" * 300, "".join(r.choice("ab文 \n\U0001f600é") for _ in range(1500)), "Thé quick brown fox. " * 60, "0123456789" * 90]
    got = {x.doc_id: x for x in encode_documents(docs(spark, list(enumerate(texts))), chunk=chunk).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == own.encode(t), (i, t[:40])
        assert got[i].n_ids == len(got[i].ids) and got[i].exact == (own.decode(own.encode(t)) == t)


def test_round_trip(spark):
    rows = [(i, prose(i, 50 + 40 * i)) for i in range(20)] + [(50, "naïve Ünïcode 文字 \U0001f600\n\nend ")]
    got = encode_documents(docs(spark, rows), chunk=500)
    assert {r.doc_id: r.t for r in got.select("doc_id", decode_column()("ids").alias("t")).collect()} == dict(rows)
    assert all(r.exact for r in got.collect())


def test_awkward_rows(spark, own):
    got = encode_documents(docs(spark, awkward(), extra=True), chunk=5000).collect()
    assert len(got) == len(awkward())
    by = {r.doc_id: r for r in got}
    assert by[1].ids is None and by[1].n_ids is None and by[2].ids == [] and by[2].exact
    for i, t in awkward():
        if t is not None:
            assert by[i].ids == own.encode(t)


def test_empty_table(spark):
    assert encode_documents(docs(spark, [])).count() == 0
