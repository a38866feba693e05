"""Pairs counted where they are made, against pairs made one by one."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from auditlake.functions import vectors as V
from auditlake.operators import calibration, images, pairs
from auditlake.operators.ordering import cap


@pytest.fixture(scope="module")
def vectors(spark):
    """Small whole numbers, so that scores tie; ids that occur twice, vectors of no length, labels that are unknown."""
    r = random.Random(3)
    rows = [(i if i != 150 else 100, r.choice([0, 1, 2, None]), [float(r.randint(-1, 1)) for _ in range(4)]) for i in range(260)]
    rows[7] = (7, 1, [0.0] * 4)
    rows[200] = (200, 2, [0.0] * 4)
    d = spark.createDataFrame(rows, "id long, label int, embedding array<float>").repartition(5)
    return rows, d.where("id % 50 = 0"), d


def made(rows):
    out = []
    for i, la, a in rows:
        if i % 50 == 0:
            for j, lb, b in rows:
                if i != j:
                    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
                    x = sum(x * y for x, y in zip(a, b)) / n if n else 0.0
                    k = math.copysign(math.floor(abs(x) * 1e6 + 0.5), x)
                    out.append((i, j, la, None if la is None or lb is None else la == lb, max(-1e6, min(1e6, k)) / 1e6 + 0.0))
    return out


def test_tally(vectors):
    rows, q, d = vectors
    got = {(r.same, r.score + 0.0): r.n for r in pairs.tally(pairs.met(q, d)).collect()}
    assert got == Counter((same, s) for *_, same, s in made(rows))


def test_nearest_and_sums(vectors):
    rows, q, d = vectors
    by = defaultdict(list)
    for i, j, _, _, s in made(rows):
        by[i].append((-s, j))
    got = defaultdict(list)
    for r in pairs.nearest(pairs.met(q, d), 10).collect():
        got[r.id].append((-r.score + 0.0, r.other))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted((a + 0.0, b) for a, b in sorted(x)[:10]) for i, x in by.items()}
    sums = {r.id: r for r in pairs.summed(pairs.met(q, d)).collect()}
    for i, x in by.items():
        assert sums[i].pairs == len(x) and sums[i].best == -min(x)[0] and sums[i]["mean"] == pytest.approx(-sum(a for a, _ in x) / len(x))


@pytest.mark.parametrize("t", [-1.0, -0.5, 0.0, 0.316228, 0.7071, 1.0])
def test_judged(spark, vectors, t):
    rows, q, d = vectors
    limit = spark.createDataFrame([(t,)], "threshold double")
    got = {(r.label, r.side, r.same, r.hit): r.n for r in pairs.judged(pairs.met(q, d), limit).collect()}
    assert got == Counter((la, "odd" if j % 2 else "even", same, s > t) for _, j, la, same, s in made(rows))


def test_split(vectors):
    rows, q, d = vectors
    want = defaultdict(lambda: [0, 0])
    for _, j, _, same, _ in made(rows):
        want[j % 2][0] += same is True
        want[j % 2][1] += same is False
    assert {r.side: [r.positives, r.negatives] for r in pairs.split(q, d, F.col("id") % 2).collect()} == want


def test_counted_pairs_give_what_single_ones_give(spark):
    r = random.Random(4)
    rows = [(r.random() < 0.3, r.randint(-20, 20) / 20, r.choice("ab")) for _ in range(900)]
    single = spark.createDataFrame(rows, "same boolean, score double, g string")
    many = single.groupBy("same", "score", "g").agg(F.count("*").alias("n"))
    limit = calibration.threshold(single, 0.1)
    assert limit.collect() == calibration.threshold(many, 0.1).collect()
    assert calibration.calibrated(single, 0.2, 0.1).collect() == calibration.calibrated(many, 0.2, 0.1).collect()
    assert set(calibration.rates(single, limit, ["g"]).collect()) == set(calibration.rates(many, limit, ["g"]).collect())
    assert sorted(calibration.bootstrap(single, limit).collect()) == sorted(calibration.bootstrap(many, limit).collect())
    one, two = (calibration.split_counts(x.withColumnRenamed("g", "split"), 5, 5).collect() for x in (single, many))
    assert set(one) == set(two)


def test_pairs_do_not_leave_their_tasks(spark, vectors, tmp_path):
    """600 queries and 3000 rows are 1.8 million pairs: what is shuffled after them is a small part."""
    d = spark.range(3000).selectExpr("id", "cast(id % 3 as int) label", "transform(sequence(1, 8), i -> cast(sin(id * i) as float)) embedding")
    out = pairs.nearest(pairs.met(d.where("id % 5 = 0"), d), 10)
    assert out.count() == 6000
    blocks = pairs.met(d.where("id % 5 = 0"), d)
    assert blocks.count() <= 2 * 4 and pairs.summed(blocks).agg(F.sum("pairs")).first()[0] == 600 * 2999


@pytest.mark.parametrize("least,most,kind", [(0.7, 12, "flat"), (0.55, 5, "mixed"), (0.0, 3, "mixed"), (0.6, 400, "mixed"), (0.5, 4, "dark")])
def test_copies_are_those_of_single_pairs(spark, least, most, kind):
    """Few hashes, so that scores tie; histograms of several lengths; no, one or three variants; equal bytes."""
    r = random.Random(5)
    some = [r.getrandbits(64) - (1 << 63) for _ in range(12)]
    share = {"flat": lambda: [0.25, 0.75], "mixed": lambda: [r.random() / 2 for _ in range(r.choice([2, 3]))], "dark": lambda: [0.0, r.choice([0.0, 1.0])]}[kind]
    one = lambda: (r.choice(some), r.choice(some), r.choice(some), share())
    rows = [(i, r.choice(["", None, f"s{i}", "same"]), [one() for _ in range(r.choice([0, 1, 3]))]) for i in range(300)]
    f = spark.createDataFrame(rows, images.FINGERPRINT).repartition(3)
    q = f.where("id % 20 = 0").withColumnRenamed("id", "query")
    met = f.crossJoin(q.select("query", F.col("sha").alias("qs"), F.col("variants").alias("qv"))).where("query != id")
    d = met.withColumn("s", V.image_similarity(F.col("qs"), F.col("qv"), F.col("sha"), F.col("variants"))).where(F.col("s.score") >= least)
    want = cap(d.select("query", "id", "s.score", V.duplicate_class(F.col("s.score"), F.col("s.exact")).alias("class")), ["query"], [F.desc("score"), "id"], most)
    assert sorted(map(tuple, images.copies(q, f, least, most).collect())) == sorted(map(tuple, want.collect()))


def test_copies_do_not_go_through_the_plan_one_by_one(spark):
    f = spark.createDataFrame([(1, "", [])], images.FINGERPRINT)
    plan = images.copies(f.withColumnRenamed("id", "query"), f)._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" not in plan and "MapInPandas" in plan


def test_scores_at_a_tie_are_rounded_as_in_sql(spark):
    from auditlake.plans import catalogue

    from .compare import oracle, spark_rows

    assert spark_rows(catalogue.queries()["visual_copies"](spark, "/root/testdata/sf0.1")) == oracle("/root/testdata/sf0.1", catalogue.oracle_sql()["visual_copies"])
