"""Thresholds of a similarity score by its error rates: of any two things compared, by supplied scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS, LEAST_POSITIVE, LEAST_NEGATIVE = 10_000, 500, 10_000


def counted(pairs: DataFrame) -> DataFrame:
    """The pairs with n, how many each row stands for: 1 where they don't say."""
    return pairs if "n" in pairs.columns else pairs.withColumn("n", F.lit(1).cast("long"))


def total(when: Column | None = None) -> Column:
    """The number of pairs for which the condition holds."""
    return F.coalesce(F.sum("n" if when is None else F.when(when, F.col("n"))), F.lit(0))


def share(of: Column, hit: Column) -> Column:
    """The share of pairs of a kind for which hit holds; null where there is none of the kind."""
    n = total(of)
    return F.when(n > 0, total(of & hit).cast("double") / n)


def next_up(x: Column) -> Column:
    """The least float above a float: by its bits, as an unsigned step away from zero or towards it."""
    f = x.cast("float")

    @F.pandas_udf("float")
    def up(v: pd.Series) -> pd.Series:
        return pd.Series(np.nextafter(v.to_numpy(np.float32), np.float32(np.inf)))

    return up(f)


def threshold(pairs: DataFrame, rate: float) -> DataFrame:
    """(negatives, allowed, threshold): scores above the threshold are accepted, and at most floor(rate * negatives) of the negatives lie above it.

    The threshold is the least score of a negative with so few above it, and -1 where all may. Counts by ten-thousandth say in which of these it lies, and
    only that one's scores are put in order, so no task sorts all pairs. No row where there is no negative. A row of `pairs` may stand for n pairs, here and below.
    """
    neg = counted(pairs).where("not same").select("score", "n", F.floor(F.col("score") * BINS).alias("bin"))
    bins = neg.groupBy("bin").agg(total().alias("n"))
    allowed = F.floor(F.lit(rate) * F.col("negatives"))
    before = lambda c: F.coalesce(F.sum("n").over(W.orderBy(F.desc(c)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("n").over(W.partitionBy())
    here = bins.withColumns({"higher": before("bin"), "negatives": every}).where(F.col("higher") <= allowed).orderBy("bin").limit(1)
    inside = neg.join(F.broadcast(here.select("bin", "higher", "negatives")), "bin").groupBy("score", "higher", "negatives").agg(total().alias("n"))
    least = inside.withColumn("above", F.col("higher") + before("score")).where(F.col("above") <= allowed).groupBy("negatives").agg(F.min("score").alias("threshold"))
    return least.select("negatives", allowed.alias("allowed"), F.when(allowed >= F.col("negatives"), F.lit(-1.0)).otherwise(F.col("threshold")).alias("threshold"))


def calibrated(pairs: DataFrame, review: float = 0.05, high: float = 0.001) -> DataFrame:
    """One row: both thresholds (a score at or above one is accepted: the next float above the boundary), the pairs they rest on, and the rates of false and true acceptance at each.

    Scores (float) must lie between -1 and 1; pairs of both kinds are needed, `high` must be at least as strict as `review`, and no threshold may lie above 1: else an error.
    """
    if not 0 <= high <= review <= 1:
        raise ValueError("rates must lie between 0 and 1, the high one below the review one")
    at = lambda r, n: threshold(pairs, r).select(F.when(F.col("threshold") <= -1, F.lit(-1.0).cast("float")).otherwise(next_up(F.col("threshold"))).alias(n))
    both = at(review, "review_threshold").crossJoin(at(high, "high_threshold"))
    d = counted(pairs).crossJoin(F.broadcast(both))
    rate = lambda same, t: share(F.col("same") == same, F.col("score").cast("float") >= F.col(t))
    g = d.groupBy("review_threshold", "high_threshold").agg(
        total(F.col("same")).alias("positives"), total(~F.col("same")).alias("negatives"), total(~F.coalesce(F.col("score").between(-1, 1), F.lit(False))).alias("bad"),
        rate(False, "review_threshold").alias("review_false"), rate(True, "review_threshold").alias("review_true"), rate(False, "high_threshold").alias("high_false"), rate(True, "high_threshold").alias("high_true"),
    )
    sound = (F.col("bad") == 0) & (F.col("positives") > 0) & (F.col("negatives") > 0) & (F.col("high_threshold") <= 1)
    return g.withColumn("sound", F.when(sound, F.lit(True)).otherwise(F.raise_error(F.lit("the scores allow no such thresholds")).cast("boolean"))).where("sound").drop("bad", "sound")


def problems(c: DataFrame) -> DataFrame:
    """(problem) of each rule that a calibration breaks; none where it is sound. A measured one needs 500 held-out pairs of one person and 10,000 of two."""
    unit = lambda x: F.coalesce(F.col(x).between(0, 1), F.lit(False))
    rules = {
        "thresholds beyond -1 to 1": F.coalesce(F.col("review_threshold").between(-1, 1) & F.col("high_threshold").between(-1, 1), F.lit(False)),
        "review above high": F.coalesce(F.col("review_threshold") <= F.col("high_threshold"), F.lit(False)),
        "too few positive pairs": ~F.col("measured") | (F.col("positives") >= LEAST_POSITIVE),
        "too few negative pairs": ~F.col("measured") | (F.col("negatives") >= LEAST_NEGATIVE),
        "rates beyond 0 to 1": ~F.col("measured") | (unit("review_false") & unit("review_true") & unit("high_false") & unit("high_true")),
        "high less strict than review": ~F.col("measured") | F.coalesce((F.col("high_false") <= F.col("review_false")) & (F.col("high_true") <= F.col("review_true")), F.lit(False)),
    }
    return c.select("*", F.explode(F.array_compact(F.array(*[F.when(~ok, F.lit(k)) for k, ok in rules.items()]))).alias("problem"))


def parsed(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Calibrations out of JSON, in either spelling of its keys and in older ones; one that lacks a threshold has null there. Measured where pairs and all four rates are given."""
    def field(*keys: str) -> Column:
        return F.coalesce(*[F.get_json_object(column, f"$.{k}") for k in keys])

    n = lambda *k: field(*k).cast("double")
    c = {
        "review_threshold": n("reviewThreshold", "review_threshold"), "high_threshold": n("highSimilarityThreshold", "high_similarity_threshold", "samePersonThreshold"),
        "positives": F.coalesce(field("positivePairCount", "positive_pair_count").cast("long"), F.lit(0)), "negatives": F.coalesce(field("negativePairCount", "negative_pair_count").cast("long"), F.lit(0)),
        "review_false": n("reviewFalseMatchRate", "review_false_match_rate", "reviewFalseAcceptRate"), "high_false": n("highFalseMatchRate", "high_false_match_rate", "samePersonFalseAcceptRate"),
        "review_true": n("reviewTrueMatchRate", "review_true_match_rate", "reviewTrueAcceptRate"), "high_true": n("highTrueMatchRate", "high_true_match_rate", "samePersonTrueAcceptRate"),
        "pipeline": field("pipelineVersion", "pipeline_version"), "source": F.coalesce(field("source"), F.lit("imported")),
    }
    d = bodies.withColumns(c)
    return d.withColumn("measured", (F.col("positives") > 0) & (F.col("negatives") > 0) & F.col("review_false").isNotNull() & F.col("high_false").isNotNull() & F.col("review_true").isNotNull() & F.col("high_true").isNotNull())


def rates(pairs: DataFrame, limit: DataFrame, by: list[str]) -> DataFrame:
    """(field, group, positives, negatives, true_accept, false_accept) above the threshold, by each of the columns, in one pass; a rate is null where a group lacks pairs of either kind."""
    return judged_rates(pairs.crossJoin(F.broadcast(limit.select("threshold"))).withColumn("hit", F.col("score") > F.col("threshold")), by)


def judged_rates(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The same of pairs (same, hit, and what they are grouped by) that were held against a threshold already."""
    d = counted(pairs).select("same", "hit", "n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("group")) for c in by])).alias("g"))
    g = d.groupBy("g.field", "g.group").agg(total(F.col("same")).alias("positives"), total(~F.col("same")).alias("negatives"), share(F.col("same"), F.col("hit")).alias("t"), share(~F.col("same"), F.col("hit")).alias("f"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return g.select("field", "group", "positives", "negatives", F.round(F.when(both, F.col("t")), 6).alias("true_accept"), F.round(F.when(both, F.col("f")), 6).alias("false_accept"))


def bootstrap(pairs: DataFrame, limit: DataFrame, samples: int = 2000, confidence: float = 0.95, seed: int = 7) -> DataFrame:
    """(same, pairs, rate, low, high): the rate of accepted pairs of each kind, and its interval by resampling.

    Drawing n of n pairs with replacement accepts a binomial number of them, with n and the rate: so each resample is one draw, whatever the number of pairs, and only two counts leave the cluster.
    """
    d = counted(pairs).crossJoin(F.broadcast(limit.select("threshold"))).groupBy("same").agg(total().alias("pairs"), total(F.col("score") > F.col("threshold")).alias("accepted"))

    def run(batches):
        for b in batches:
            out = []
            for same, n, k in zip(b["same"], b["pairs"], b["accepted"]):
                draws = np.random.default_rng(seed + int(same)).binomial(n, k / n, samples) / n
                out.append((same, n, k / n, *np.quantile(draws, [(1 - confidence) / 2, (1 + confidence) / 2])))
            yield pd.DataFrame(out, columns=["same", "pairs", "rate", "low", "high"])

    return d.mapInPandas(run, "same boolean, pairs long, rate double, low double, high double")


def split_counts(pairs: DataFrame, least_positive: int, least_negative: int) -> DataFrame:
    """(split, positives, negatives, enough) of scored pairs."""
    return enough(counted(pairs).groupBy("split").agg(total(F.col("same")).alias("positives"), total(~F.col("same")).alias("negatives")), least_positive, least_negative)


def enough(counts: DataFrame, least_positive: int, least_negative: int) -> DataFrame:
    return counts.withColumn("enough", (F.col("positives") >= least_positive) & (F.col("negatives") >= least_negative))


def rejections(pairs: DataFrame, reason: str = "reason") -> DataFrame:
    """(reason, pairs, share) of pairs that could not be scored, by why."""
    every = pairs.agg(F.count("*").alias("all"))
    g = pairs.where(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("pairs"))
    return g.crossJoin(F.broadcast(every)).select("reason", "pairs", F.round(F.col("pairs") / F.col("all"), 6).alias("share"))
