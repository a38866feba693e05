"""Retry delays, circuit breakers with a cooldown, caches by age and failover between providers; event counts as a stream (an extension of our own)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FAILURES, COOLDOWN_S = 3, 120.0


def retry_delay(attempt: Column, retry_after: Column | None = None, base: int = 600, most: int = 6000) -> Column:
    """Milliseconds before a new attempt: what the server asks for, 60 s at most; else doubling for attempts 0 to 4, with a fixed spread, never above the limit."""
    held = F.least(F.greatest(attempt, F.lit(0)), F.lit(4))
    own = F.least(F.lit(most), (base * F.pow(F.lit(2), held) + ((attempt + 1) * 137) % 311).cast("long"))
    if retry_after is None:
        return own
    asked = F.when(F.trim(retry_after).rlike("^[+-]?[0-9]{1,18}$"), F.trim(retry_after)).cast("long")
    return F.when(asked.isNotNull(), F.least(F.greatest(asked, F.lit(0)), F.lit(60)) * 1000).otherwise(own)


def walk(at: np.ndarray, failed: np.ndarray, start: tuple[int, float], limit: int, cooldown: float) -> tuple[np.ndarray, np.ndarray, tuple[int, float]]:
    """(failures before each event, allowed, state after): one breaker's events in order. The state is (failures, open until); an open breaker forgets all when its time is over."""
    failures, until = start
    before, allowed = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    for i, (t, bad) in enumerate(zip(at.tolist(), failed.tolist())):
        if until and t >= until:
            failures, until = 0, 0.0
        before[i], allowed[i] = failures, not until
        if not allowed[i]:
            continue  # an attempt that isn't made changes nothing
        if bad:
            failures += 1
            if failures >= limit:
                until = t + cooldown
        else:
            failures, until = 0, 0.0
    return before, allowed, (failures, until)


def breaker(events: DataFrame, by: str = "user_id", limit: int = FAILURES, cooldown: float = COOLDOWN_S) -> DataFrame:
    """(event_id, by, failures, allowed) of events (event_id, by, at: seconds, failed), in the order of (at, event_id): whether the breaker lets the attempt through, and the failures that it knows of then.

    Three failures open it for the cooldown; a success closes it, and so does time. A state by which every event depends on those before it is kept by provider, whose events
    come sorted, in batches: a provider's history never needs to be in memory as a whole.
    """

    def run(batches):
        key, state = None, (0, 0.0)
        for b in batches:
            out = []
            for k, part in b.groupby(by, sort=False):
                if k != key:
                    key, state = k, (0, 0.0)
                before, allowed, state = walk(part["at"].to_numpy(float), part["failed"].to_numpy(bool), state, limit, cooldown)
                out.append(pd.DataFrame({"event_id": part["event_id"], by: k, "failures": before, "allowed": allowed}))
            if out:
                yield pd.concat(out)

    kind = dict(events.dtypes)[by]
    d = events.select("event_id", by, "at", "failed").repartition(by).sortWithinPartitions(by, "at", "event_id")
    return d.mapInPandas(run, f"event_id long, {by} {kind}, failures long, allowed boolean")


def streaks(events: DataFrame, failed: Column, by: str = "user_id") -> DataFrame:
    """Adds streak, the failures in a row up to each event. Ties in time go by event_id."""
    w = W.partitionBy(by).orderBy("ts", "event_id")
    f = failed.cast("int")
    island = events.withColumn("bad", f).withColumn("island", F.sum(1 - f).over(w))
    return island.withColumn("streak", F.sum("bad").over(W.partitionBy(by, "island").orderBy("ts", "event_id"))).drop("bad", "island")


def cache_hits(requests: DataFrame, key: str, ttl: float, at: str = "at") -> DataFrame:
    """Adds hit: whether a request finds what an earlier one stored less than ttl seconds before. A hit stores nothing anew, so an entry's age counts from its miss.

    Requests of a key come sorted, in batches, and only the time of the last miss is kept.
    """
    schema = requests.schema.add("hit", "boolean")

    def run(batches):
        held, since = None, -np.inf
        for b in batches:
            hit = np.zeros(len(b), bool)
            for i, (k, t) in enumerate(zip(b[key].tolist(), b[at].tolist())):
                hit[i] = k == held and t - since < ttl
                if not hit[i]:
                    held, since = k, t
            yield b.assign(hit=hit)

    return requests.repartition(key).sortWithinPartitions(key, at).mapInPandas(run, schema)


def failover(answers: DataFrame, providers: int, deep: bool = False) -> DataFrame:
    """Rows (query_id, start, provider, url_key, high, open) of all that providers would answer -> those that are asked for, with `turn`.

    A query asks the providers in their circle from `start` on, leaving out those whose breaker is open; 2 of them, 3 where it is telling (high), 4 and 5 in deep search. It
    stops earlier: with 5 different pages; a telling one with 3 providers that gave any and 2 pages.
    """
    turn = F.pmod(F.col("provider") - F.col("start"), F.lit(providers))
    asked = answers.where("not open").withColumn("circle", turn)
    slots = asked.select("query_id", "circle").distinct().withColumn("turn", F.row_number().over(W.partitionBy("query_id").orderBy("circle")))
    d = asked.join(slots, ["query_id", "circle"])
    budget = F.when(F.col("high"), 5 if deep else 3).otherwise(4 if deep else 2)
    new = d.where("url_key is not null").groupBy("query_id", "url_key").agg(F.min("turn").alias("turn")).groupBy("query_id", "turn").agg(F.count("*").alias("fresh"))
    gave = d.groupBy("query_id", "turn", "high").agg(F.max(F.col("url_key").isNotNull().cast("int")).alias("gave"))
    before = W.partitionBy("query_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    sums = gave.join(new, ["query_id", "turn"], "left").withColumns({"pages": F.coalesce(F.sum(F.coalesce("fresh", F.lit(0))).over(before), F.lit(0)), "sources": F.coalesce(F.sum("gave").over(before), F.lit(0))})
    done = F.when(F.col("high"), (F.col("sources") >= 3) & (F.col("pages") >= 2)).otherwise(F.col("pages") >= 5)
    made = sums.where((F.col("turn") <= budget) & ~done).select("query_id", "turn")
    return d.join(made, ["query_id", "turn"])


def windowed_counts(events: DataFrame, watermark: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """(window start, event_type, n) of a stream; rows later than the watermark are left out."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
