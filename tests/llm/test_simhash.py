import numpy as np

from auditlake.llm.simhash import LIMIT, RECALL, _Prints, ball_plan, block_plan, drop_near_duplicates, fingerprints, near_duplicate_groups, similar_prints
from pyspark.sql import functions as F

from .tables import awkward, docs, prose, shuffled


def _copies(seed, text, share):
    r = np.random.default_rng(seed)
    w = text.split()
    for i in r.choice(len(w), max(1, int(len(w) * share)), replace=False):
        w[i] = f"x{r.integers(10_000)}"
    return " ".join(w)


def _corpus():
    rows = [(i, prose(i, 120)) for i in range(150)]
    return rows + [(1000 + i, _copies(i, rows[i % 150][1], 0.01 + 0.06 * (i % 7))) for i in range(300)]


def _brute(rows):
    p = _Prints()
    fp = {i: np.unpackbits(np.frombuffer(p(t), np.uint8)) for i, t in rows if p(t) is not None}
    ids = sorted(fp)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (fp[a] != fp[b]).sum() <= LIMIT}


def test_pairs_reach_nearly_all_of_brute_force(spark):
    rows = _corpus()
    word = [F.conv(F.hex(F.substring("fp", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"f{i}") for i in range(4)]
    prints = fingerprints(docs(spark, rows)).select(F.col("doc_id").alias("id"), "fp", *word)
    want = _brute(rows)
    got = {(r.a, r.b) for r in similar_prints(prints).collect()}
    assert len(want) > 80 and got <= want
    assert len(got) >= 0.93 * len(want)


def test_groups_are_components_of_brute_force(spark):
    rows = _corpus()
    got = {r.doc_id: r for r in near_duplicate_groups(docs(spark, rows)).collect()}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in _brute(rows):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    same = sum(got[i].group_id == find(i) for i, _ in rows)
    assert len(got) == len(rows) and same >= 0.95 * len(rows)
    assert all(r.kept == (r.doc_id == r.group_id) for r in got.values())


def test_thousands_of_copies_make_one_group(spark):
    rows = [(i, "the same short text again and again") for i in range(3000)] + [(5000, prose(1, 50))]
    got = near_duplicate_groups(docs(spark, rows)).collect()
    assert {(r.group_id, r.group_size) for r in got} == {(0, 3000), (5000, 1)}


def test_recall_is_the_same_at_every_size():
    from math import comb

    for n in (2, 10**4, 10**7, 10**10):
        width, permutations = block_plan(n)
        p = comb(256 - LIMIT, width) / comb(256, width)
        assert 1 - (1 - p) ** (permutations * (256 // width)) >= RECALL


def test_awkward_rows(spark):
    got = {r.doc_id: r for r in near_duplicate_groups(docs(spark, awkward(), extra=True)).collect()}
    assert set(got) == {None, 1, 2, 3, 4, 5, 6, 7, 8, 9}
    assert got[8].group_id == 7 and not got[8].kept
    assert all(got[i].group_size == 1 for i in (None, 1, 2, 3, 4, 5, 6, 9))
    d = docs(spark, awkward(), extra=True)
    kept = drop_near_duplicates(d)
    assert kept.columns == d.columns and kept.count() == len(awkward()) - 2  # 8, and one of the equal rows


def test_one_id_with_two_texts_and_rows_without_id(spark):
    p, q = prose(1, 60), prose(2, 60)
    left = lambda rows: sorted((str(r.doc_id), r.text or "") for r in drop_near_duplicates(docs(spark, rows)).collect())
    assert left([(1, p), (2, p), (2, q)]) == [("1", p), ("2", q)]
    assert left([(1, p), (1, p), (None, p)]) == [("1", p)]
    assert left([(None, p), (None, p), (None, None), (None, None)]) == [("None", ""), ("None", ""), ("None", p)]
    assert len(left([(1, "")] * 2)) == 1


def test_many_near_copies_are_linked_through_few(spark):
    rows = [(i, _copies(i, prose(5, 200), 0.02)) for i in range(400)] + [(1000 + i, prose(100 + i, 200)) for i in range(50)]
    got = near_duplicate_groups(docs(spark, rows)).collect()
    assert {(r.group_id, r.group_size) for r in got if r.doc_id < 1000} == {(0, 400)} and all(r.kept for r in got if r.doc_id >= 1000)


def test_empty_table(spark):
    d = docs(spark, [])
    assert near_duplicate_groups(d).count() == 0 and drop_near_duplicates(d).count() == 0


def _rows(bits):
    f = np.packbits(bits, axis=1).view(">u8").astype(np.uint64).view(np.int64)
    return [(i, *map(int, r)) for i, r in enumerate(f)]


def test_no_pair_at_the_limit_is_left_out(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 2, (1500, 256), np.uint8)
    far = base.copy()
    for i, row in enumerate(far):
        row[r.choice(256, LIMIT + i % 2, replace=False)] ^= 1  # every other one lies beyond the limit
    prints = spark.createDataFrame(_rows(np.vstack([base, far])), "id long, f0 long, f1 long, f2 long, f3 long")
    got = sorted((p.a, p.b) for p in similar_prints(prints).collect())
    assert got == [(i, 1500 + i) for i in range(0, 1500, 2)]


def test_every_pair_of_brute_force_and_every_group(spark):
    rows = _corpus()
    p = _Prints()
    prints = spark.createDataFrame(_rows(np.stack([np.unpackbits(np.frombuffer(p(t), np.uint8)) for _, t in rows])), "n long, f0 long, f1 long, f2 long, f3 long")
    ids = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(rows)], "n long, id long")
    want = _brute(rows)
    assert {(r.a, r.b) for r in similar_prints(prints.join(ids, "n")).collect()} == want
    root = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.doc_id: r.group_id for r in near_duplicate_groups(docs(spark, rows)).collect()} == root


def test_radii_leave_no_way_out():
    for limit in (0, 3, 36, 60):
        plan = ball_plan(limit)
        assert sum(r + 1 for _, _, r in plan) == limit + 1 and all(a[1] <= b[0] for a, b in zip(plan, plan[1:]))


def test_pipeline_stage_drops_copies_that_share_no_plain_block(spark):
    from corpus_pipeline import near_duplicates

    seeds = (3, 137, 685, 1359, 1793, 1938, 2710, 2796)  # 31 to 36 bits apart
    rows = [(i, prose(i, 120)) for i in seeds]
    rows += [(10_000 + i, _copies(i, t, 0.13)) for i, t in rows]
    assert {r.doc_id for r in near_duplicates(spark, docs(spark, rows), "").collect()} == set(seeds)


def test_a_row_that_may_go_is_shuffled_with_its_text_once(spark):
    rows = [(i, prose(i % 10, 20_000, 10**6)) for i in range(20)]
    size, _ = shuffled(spark, lambda: drop_near_duplicates(docs(spark, rows)).write.format("noop").mode("overwrite").save())
    assert size < 1.5 * sum(len(t) for _, t in rows)
