"""The pipeline against a plain version of the same rules."""

import pytest

from auditlake.llm.common import words
from auditlake.llm.pieces import PieceCoder
from auditlake.llm.quality import repetition
from auditlake.llm.common import WordHashes, small_batches

from . import test_paragraphs
from .tables import awkward, docs, prose

pipeline = pytest.importorskip("corpus_pipeline")


def plain(rows, items):
    hashes = WordHashes()

    def fine(t):
        covered, longest, _ = repetition(hashes((t or "").split()))
        return covered <= 0.3 and longest <= 50

    rows = [r for r in rows if fine(r[1])]
    from auditlake.llm.simhash import LIMIT, _Prints
    import numpy as np

    p, fp = _Prints(), {}
    for i, t in rows:
        if i is not None and (x := p(t)) is not None:
            fp[i] = np.unpackbits(np.frombuffer(x, np.uint8))
    root = {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fp)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fp[a] != fp[b]).sum() <= LIMIT:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = [r for r in rows if r[0] not in root or find(r[0]) == r[0]]
    heads = test_paragraphs.brute(rows)
    gone = {k for k, v in heads.items() if k != v}
    cut = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for n, x in enumerate(lines) if (i, n) not in gone]
        if len(left) == len(lines):
            cut.append((i, t))
        elif "".join(left).strip():
            cut.append((i, "\n".join(left)))

    def leaked(t):
        d = words(t)
        for _, item in items:
            q = words(item)
            w = min(5, len(q))
            want = {tuple(q[k : k + w]) for k in range(len(q) - w + 1)}
            sh = [tuple(d[k : k + w]) for k in range(len(d) - w + 1)]
            span = len(q) - w + 1
            if want and max((len(want & set(sh[k : k + span])) for k in range(len(sh))), default=0) >= -(-len(want) * 6 // 10):
                return True
        return False

    coder = PieceCoder()
    return {(i, None if t is None else tuple(coder.encode(t).tolist())) for i, t in cut if i is None or not leaked(t)}


def test_against_a_plain_version(spark, tmp_path):
    items = [(i, prose(900 + i, 30)) for i in range(5)]
    shared = prose(800, 60)
    rows = [(i, prose(5000 + i, 120)) for i in range(40)]
    rows += [(100 + i, prose(5000 + i, 120) + " more") for i in range(10)]  # near copies
    rows += [(200 + i, prose(200 + i, 90) + "\n" + shared + "\n" + prose(300 + i, 70)) for i in range(6)]  # a shared passage
    rows += [(300 + i, prose(400 + i, 60) + " " + items[i][1] + " " + prose(500 + i, 60)) for i in range(5)]  # leaks
    rows += [(400, "spam and eggs " * 50)]
    odd = [(i and 1000 + i, t) for i, t in awkward() if i not in (7, 8)][:-1]
    rows += [r for n, r in enumerate(odd) if r not in odd[:n]] + [(2000, prose(77, 3000, 10**6))]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, None if r.ids is None else tuple(r.ids)) for r in got} == plain(rows, items)
    assert len(got) == 40 + 6 + 7 + 1


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([(1, "an item of a few words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], awkward()):
        d = docs(spark, rows, extra=True)
        for _, stage in pipeline.STAGES[:-1]:
            assert stage(spark, d, str(tmp_path)).columns == d.columns
        assert pipeline.STAGES[-1][1](spark, d, str(tmp_path)).count() == len(rows)


def test_an_empty_corpus(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name, stage", pipeline.STAGES, ids=[k for k, _ in pipeline.STAGES])
def test_every_stage_bounds_the_texts_sent_at_once(spark, tmp_path, name, stage):
    """All texts arrive, the longest whole, but no frame holds thousands of them, as one of 10 000 rows did."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = [(i, prose(i, 60)) for i in range(2)]
    spark.createDataFrame([(1, prose(99, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    many = spark.range(3000, numPartitions=1).selectExpr("id", "if(id = 1500, repeat('long ', 1000000), repeat('word ', 400)) text")

    def lengths(batches):
        for b in batches:
            yield b.text.str.len().to_frame("n").groupby(lambda _: 0).agg(list)

    old = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        stage(spark, docs(spark, rows), str(tmp_path))
        frames = [r.n for r in many.mapInPandas(lengths, "n array<long>").collect()]
        assert sorted(n for f in frames for n in f) == [2000] * 2999 + [5_000_000]
        assert max(sum(f[:-1]) for f in frames) <= 1 << 20
        spark.conf.set(key, "4096")
        small_batches(spark)
        assert spark.conf.get(key) == "4096"  # the session's own bound stays
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)
