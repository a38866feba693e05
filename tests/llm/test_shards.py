import random

import numpy as np

from auditlake.llm.pieces import PieceCoder
from auditlake.llm.shards import PerfectHash, build_index, fingerprint, lookup, token_index, write_index, write_shards

from .tables import awkward, docs, prose


def test_the_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 17, 5000):
        keys = np.random.default_rng(n).choice(1 << 60, n, replace=False).astype(np.int64) - (1 << 59)
        h = PerfectHash.build(keys)
        assert sorted(h(keys).tolist()) == list(range(n))


def test_lookup_reads_what_the_encoder_makes(spark, tmp_path):
    rows = [(i * 7919 - 300, prose(i, 5 + i)) for i in range(200)]
    folder, coder = f"file://{tmp_path}/ids", PieceCoder()
    index = write_index(build_index(write_shards(docs(spark, rows), folder), bucket_keys=30), folder)
    assert index.count() == 7 and {r.buckets for r in index.collect()} == {7}
    want = {i: coder.encode(t).tolist() for i, t in rows}
    got = lookup(spark, folder, [*want, 5, -77, 10**15])
    assert {k: v.tolist() for k, v in got.items()} == want


def test_lookup_where_buckets_are_empty(spark, tmp_path):
    for seed in range(3):
        rows = [(i + 1000 * seed, prose(i, 5)) for i in range(12)]
        folder = f"file://{tmp_path}/{seed}"
        write_index(build_index(write_shards(docs(spark, rows), folder), bucket_keys=1), folder)
        assert sorted(lookup(spark, folder, [i for i, _ in rows])) == [i for i, _ in rows]
    folder = f"file://{tmp_path}/none"
    write_index(build_index(write_shards(docs(spark, []), folder)), folder)
    assert lookup(spark, folder, [1]) == {}


def test_a_repeated_id_keeps_the_same_ids_in_every_run(spark):
    rows = [(1, prose(i, 20 + i)) for i in range(9)] + [(2, prose(50, 10))]
    runs = {tuple(sorted((r.doc_id, r.n_ids, r.id_sum) for r in token_index(docs(spark, rows).repartition(5)).collect())) for _ in range(3)}
    assert len(runs) == 1 and [x[0] for x in next(iter(runs))] == [1, 2]


def test_index_rows_against_brute_force(spark):
    rows = [(i, prose(i, i)) for i in range(120)]
    coder = PieceCoder()
    got = {r.doc_id: r for r in token_index(docs(spark, rows)).collect()}
    assert sorted(got) == list(range(120)) and sorted(r.slot for r in got.values()) == list(range(120))
    for i, t in rows:
        ids = coder.encode(t)
        assert (got[i].n_ids, got[i].id_sum, got[i].fingerprint) == (len(ids), int(ids.sum()), int(fingerprint(np.array([i]))[0]))


def test_texts_are_encoded_with_one_call_for_each_part():
    coder, plain = PieceCoder(), PieceCoder()

    class Counted:
        calls = 0

        def encode(self, text, **options):
            Counted.calls += 1
            return plain.sp.encode(text, **options)

    coder.sp = Counted()
    text = prose(1, 20_000, 1_000_000)
    assert coder.encode_whole(text).tolist() == plain.sp.encode(text) and Counted.calls <= len(text) // 32_768 + 1


def test_parts_of_a_text_have_the_ids_of_the_whole():
    coder, r = PieceCoder(), random.Random(3)
    texts = ["", " ", "    ", "\u2581", " \u2581 ", "a", "a ", " a", "a" * 50, "a" * 20 + " ", "ab  cd   ef    ", "naïve\n\n文字 \U0001f600 x", *(t or "" for _, t in awkward()[:7])]
    texts += ["".join(r.choice(["a", "the", "é", "文", " ", " ", "  ", "\u2581", "\n", "\t", "9", "ing"]) for _ in range(r.randrange(200))) for _ in range(400)]
    for t in texts:
        want = coder.sp.encode(t)
        for chunk in (1, 2, 3, 7, 40, 32_768):
            assert coder.encode_whole(t, chunk).tolist() == want == coder.encode(t).tolist(), (t, chunk)


def test_awkward_rows(spark):
    got = {r.doc_id: r for r in token_index(docs(spark, awkward(), extra=True)).collect()}
    assert sorted(got) == list(range(1, 10)) and got[1].n_ids == got[2].n_ids == 0
    assert got[7].n_ids > 30_000


def test_empty_table(spark):
    assert token_index(docs(spark, [])).count() == 0
