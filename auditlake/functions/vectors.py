"""Similarity of vectors, hashes and histograms, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = {"p": 0.55, "d": 0.24, "a": 0.09, "c": 0.12}
#: name -> (column, least, greatest): gates of an input's quality, the first that fails gives the reason.
GATES = [("low score", "score", 0.82, None), ("too small", "size", 72.0, None), ("too little of the picture", "share", 0.012, None), ("points too close", "spread", 20.0, None), ("turned too far", "turn", -28.0, 28.0), ("too dark or too bright", "light", 28.0, 232.0), ("blurred", "sharp", 18.0, None)]


def dot(a: Column, b: Column, kind: str = "double") -> Column:
    zero = F.lit(0.0).cast(kind)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast(kind) * y.cast(kind)), zero, lambda s, v: (s + v).cast(kind))


def cosine(a: Column, b: Column) -> Column:
    """Summed in double; 0 for vectors of other lengths, empty, null or of no length; between -1 and 1."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    sound = (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(sound, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(F.lit(0.0))


def strict_cosine(a: Column, b: Column) -> Column:
    """Summed in float, and not held to -1 to 1; 0 without length; an error for vectors that are empty or of other lengths."""
    x, y = dot(a, a, "float"), dot(b, b, "float")
    norm = (F.sqrt(x).cast("float") * F.sqrt(y).cast("float")).cast("float")
    bad = (F.size(a) == 0) | (F.size(a) != F.size(b))
    return F.when(bad, F.raise_error(F.lit("vectors of other lengths")).cast("float")).when((x == 0) | (y == 0), F.lit(0.0).cast("float")).otherwise((dot(a, b, "float") / norm).cast("float"))


def remapped(raw: Column) -> Column:
    """The useful part of a similarity that clusters high: 0.55 to 1, as 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw - 0.55) / 0.45))


def remapped_band(score: Column) -> Column:
    return F.when(score >= 0.90, "high").when(score >= 0.74, "review").otherwise("low")


def hash_similarity(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def histogram_intersection(a: Column, b: Column) -> Column:
    """The part that two histograms share, over the bins of the shorter one; between 0 and 1."""
    sum_ = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.least(x, y)).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum_))


def variant_similarity(x: Column, y: Column) -> Column:
    """Weighted similarity of two variants, struct(p, d, a: 64-bit hashes, c: histogram)."""
    hashes = reduce(lambda s, k: s + hash_similarity(x[k], y[k]) * WEIGHTS[k], ("d", "a"), hash_similarity(x["p"], y["p"]) * WEIGHTS["p"])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), hashes + histogram_intersection(x["c"], y["c"]) * WEIGHTS["c"]))


def image_similarity(sha_a: Column, variants_a: Column, sha_b: Column, variants_b: Column) -> Column:
    """struct(score, exact): 1 for equal bytes; else the best of any variant with any, 0 without."""
    best = F.array_max(F.flatten(F.transform(variants_a, lambda x: F.transform(variants_b, lambda y: variant_similarity(x, y)))))
    exact = F.coalesce((sha_a == sha_b) & (sha_a != ""), F.lit(False))
    return F.struct(F.when(exact, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"), exact.alias("exact"))


def duplicate_class(score: Column, exact: Column) -> Column:
    return F.when(exact, "exact").when(score >= 0.94, "near_exact").when(score >= 0.87, "strong").when(score >= 0.80, "possible").otherwise("different")


def decision(score: Column, review: Column, high: Column) -> Column:
    return F.when(score >= high, "high").when(score >= review, "review").otherwise("none")


def gate(gates: list = GATES) -> Column:
    """The first gate that fails, or null."""
    fails = lambda c, lo, hi: (F.lit(False) if lo is None else F.col(c) < lo) | (F.lit(False) if hi is None else F.col(c) > hi)
    return F.coalesce(*[F.when(F.coalesce(fails(c, lo, hi), F.lit(True)), F.lit(n)) for n, c, lo, hi in gates])
