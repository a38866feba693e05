"""Keep-first, keep-last and caps: the order decides, so every one needs a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """One row of each key: the first in the order. A min of structs, which combines before the shuffle, where a window would not."""
    n = [k if k in df.columns else f"__k{i}" for i, k in ((i, k if isinstance(k, str) else "") for i, k in enumerate(keys))]
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*df.columns).alias("row"))
    best = df.groupBy(*[F.col(k) if k == a else F.expr(k).alias(a) if isinstance(k, str) else k.alias(a) for k, a in zip(keys, n)]).agg(F.min(row).alias("__best"))
    # keys that are columns come from the groups, so that rows which lie together by them are still known to
    return best.select(*[F.col(c) if c in n else F.col(f"__best.row.{c}").alias(c) for c in df.columns])


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*df.columns).alias("row"))
    return df.groupBy(*keys).agg(F.max(row).alias("best")).select("best.row.*")


def tasks(df: DataFrame, rows: int, least: int = 500) -> int:
    """How many tasks of so many rows: one for each core where there are rows enough, more where there are more rows."""
    n = df.count()
    return max(1, -(-n // rows), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // least)))


def spread(df: DataFrame, key: str, rows: int = 5_000) -> DataFrame:
    """The rows by key, in tasks of some 5000, before each unfolds into hundreds that are sorted: a task's memory then doesn't grow with the input, and what groups by the key shuffles no more."""
    return df.repartition(tasks(df, rows), key)


def cap(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """At most so many rows of each group; Spark keeps a group's leading rows only, on both sides of the shuffle."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= most).drop("__rank")
