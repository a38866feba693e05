"""States of fetched pages, and metrics of a rule that says whose they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text as T


def page_state(html: Column) -> Column:
    """blocked, not_found, thin, ok, or null for a null page."""
    visible = F.trim(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)>", " "), r"<[^>]*>|\s+", " "))
    low = F.lower(html)
    return F.when(html.isNull(), F.lit(None)).when(low.rlike("|".join(T.CHALLENGES)), "blocked").when(low.rlike("|".join(T.MISSING)), "not_found").when(F.length(visible) < 60, "thin").otherwise("ok")


def confusion(d: DataFrame, said: str, truth: str, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, specificity and F1 of a rule; 1 where nothing is divided by nothing."""
    n = {"tp": f"{said} and {truth}", "fp": f"{said} and not {truth}", "fn": f"not {said} and {truth}", "tn": f"not {said} and not {truth}"}
    g = d.groupBy(*(by or [])).agg(*[F.count_if(F.expr(x)).alias(k) for k, x in n.items()])
    ratio = lambda a, b: F.expr(f"round(if({b} = 0, 1.0, {a} / ({b})), 6)")
    return g.withColumns({"precision": ratio("tp", "tp + fp"), "recall": ratio("tp", "tp + fn"), "specificity": ratio("tn", "tn + fp"), "f1": ratio("2 * tp", "2 * tp + fp + fn")})


def outcomes(d: DataFrame, expected: str, actual: str, by: list[str] | None = None) -> DataFrame:
    """(tp, fp, fn, tn, unverifiable, total, accuracy) of rows whose expected is belongs, other or unverifiable, and actual verified, plausible, not_found or unverifiable.

    What can't be verified counts in no cell but total and its own, unless it is said to be verified, which is false; accuracy is the part of all rows that are rightly said to be unverifiable.
    """
    e, a = F.col(expected), F.col(actual)
    n = {"tp": (e == "belongs") & (a == "verified"), "fp": (e != "belongs") & (a == "verified"), "fn": (e == "belongs") & (a != "verified"), "tn": (e == "other") & (a != "verified"), "unverifiable": (e == "unverifiable") & (a == "unverifiable")}
    g = d.groupBy(*(by or [])).agg(*[F.count_if(x).alias(k) for k, x in n.items()], F.count("*").alias("total"))
    return g.withColumn("accuracy", F.round(F.when(F.col("total") == 0, 1.0).otherwise(F.col("unverifiable") / F.col("total")), 6))
