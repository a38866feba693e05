"""Snapshots of cases: differences, set deltas, lists, and scans that resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators.exposure import weight

KEY = ["case_id", "type", "value", "url"]


def _match(a: str = "a", b: str = "b"):
    return F.expr(" and ".join(f"{a}.{k} <=> {b}.{k}" for k in KEY))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(case_id, type, value, url, change, delta) of findings added, removed or changed in risk or confidence; null values are equal to each other. Added and removed ones come as often as they are there; of repeated keys that are in both, the last by ord counts."""
    last = lambda d: d.groupBy(*KEY).agg(F.max_by(F.struct(weight(F.col("risk")).alias("w"), F.col("confidence").cast("float").alias("c")), "ord").alias("x"))
    a, b = last(before).alias("a"), last(after).alias("b")
    only = lambda x, y, word, sign: x.alias("a").join(y.alias("b"), _match(), "left_anti").select(*KEY, F.lit(word).alias("change"), (weight(F.col("risk")) * sign).cast("long").alias("delta"))
    both = a.join(b, _match()).where("not (a.x.w <=> b.x.w and a.x.c <=> b.x.c)").select(*[F.col(f"a.{k}") for k in KEY], F.lit("changed").alias("change"), (F.col("b.x.w") - F.col("a.x.w")).cast("long").alias("delta"))
    return only(after, before, "added", 1).unionByName(only(before, after, "removed", -1)).unionByName(both)


def deltas(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """(case_id, added, removed): the sizes of both set differences of a column, in one pass over both sides; cases without any difference have 0."""
    sides = before.select("case_id", column, F.lit(1).alias("side")).unionByName(after.select("case_id", column, F.lit(2).alias("side")))
    each = sides.groupBy("case_id", column).agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    return each.groupBy("case_id").agg(F.count_if(F.expr("lo = 2")).alias("added"), F.count_if(F.expr("hi = 1")).alias("removed"))


def score_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(case_id, risk_delta, exposure_delta) of scores (case_id, weight, overall) of the cases that both snapshots have; a missing exposure counts 0."""
    a, b = before.select("case_id", F.col("weight").alias("w0"), F.col("overall").alias("e0")), after.select("case_id", F.col("weight").alias("w1"), F.col("overall").alias("e1"))
    return a.join(b, "case_id").select("case_id", (F.col("w1") - F.col("w0")).cast("long").alias("risk_delta"), (F.coalesce("e1", F.lit(0)) - F.coalesce("e0", F.lit(0))).cast("long").alias("exposure_delta"))


def listed(cases: DataFrame) -> DataFrame:
    """Cases (case_id, created as text) with rank, the newest first; of equal times by id."""
    from pyspark.sql import Window as W

    return cases.withColumn("rank", F.row_number().over(W.orderBy(F.desc("created"), "case_id")).cast("long"))


def resumable(identities: DataFrame, deep: bool) -> DataFrame:
    """What a scan that was broken off is begun again with: the seeds without aliases, as the original keeps them, and whether it was a deep one."""
    return identities.select("subject_id", "full_name", "handles", "emails", "phones", "organizations", "locations", "profile_urls", F.lit(deep).alias("deep"))
