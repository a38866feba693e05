"""Scores of all pairs of stated queries and rows, counted where they are made: what leaves a task are counts, sums or the best, never a row for each pair.

A score is a cosine to six digits, so a whole number of millionths from -1 to 1, and pairs can be counted by it without loss. Rows and queries are packed into blocks of bounded size; each block of
rows meets each block of queries in one matrix product, taken in stripes. Time is that of all pairs, divided among the tasks; memory is that of two blocks and, for the tally, of its counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators.ordering import cap

BLOCK, STRIPE, BROADCAST = 2048, 64, 20_000
UNIT, NONE = 1_000_000, -2_000_000
BATCH_BYTES, BATCH_KEY = 16 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def chunks(batches):
    """A task's rows, 2048 at a time."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= BLOCK:
            every = pd.concat(held, ignore_index=True)
            full = len(every) // BLOCK * BLOCK
            yield from (every.iloc[i : i + BLOCK] for i in range(0, full, BLOCK))
            held = [every.iloc[full:]]
    if sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def packed(d: DataFrame, p: str) -> DataFrame:
    """The rows (id, label, embedding) in blocks: one row of bytes for each 2048 or fewer of a task."""

    def block(b: pd.DataFrame) -> pd.DataFrame:
        known = b["label"].notna()
        v = np.array(b["embedding"].tolist(), np.float64)
        return pd.DataFrame({f"{p}ids": [b["id"].to_numpy(np.int64).tobytes()], f"{p}labels": [b["label"].fillna(0).to_numpy(np.int64).tobytes()], f"{p}known": [known.to_numpy(bool).tobytes()], f"{p}vectors": [v.tobytes()]})

    def run(batches):
        yield from map(block, chunks(batches))

    return d.select("id", "label", "embedding").mapInPandas(run, f"{p}ids binary, {p}labels binary, {p}known binary, {p}vectors binary")


def beside(queries: DataFrame, rows: DataFrame, pack) -> DataFrame:
    """Each block of queries beside each block of rows, as pack(rows, prefix) makes them."""
    spark = rows.sparkSession
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))  # bounds what goes to a Python worker at once, as blocks are large rows
    n = queries.count()
    q = pack(queries.repartition(n // (BLOCK * 8) + 1), "q")
    return pack(rows.repartition(spark.sparkContext.defaultParallelism), "r").crossJoin(F.broadcast(q) if n <= BROADCAST else q)


def met(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Each block of queries beside each block of rows; both are (id, label, embedding)."""
    return beside(queries, rows, packed)


class Side:
    def __init__(self, x, p: str):
        self.ids, self.labels, self.known = np.frombuffer(x[f"{p}ids"], np.int64), np.frombuffer(x[f"{p}labels"], np.int64), np.frombuffer(x[f"{p}known"], bool)
        self.vectors = np.frombuffer(x[f"{p}vectors"], np.float64).reshape(len(self.ids), -1)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))

    def cut(self, order) -> "Side":
        s = object.__new__(Side)
        for k in ("ids", "labels", "known", "vectors", "norms"):
            setattr(s, k, getattr(self, k)[order])
        return s


def own_places(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of equal ids in both."""
    order = np.argsort(q, kind="stable")
    lo, hi = np.searchsorted(q[order], r, "left"), np.searchsorted(q[order], r, "right")
    times = hi - lo
    j = np.repeat(np.arange(len(r)), times)
    i = order[np.repeat(lo, times) + np.arange(len(j)) - np.repeat(np.cumsum(times) - times, times)] if len(j) else j
    return i, j


def _stripes(q: Side, r: Side):
    """(first, last, millionths, own): the scores of some queries with all rows of the block, rounded half away from zero; own are the places of rows that are the query itself."""
    i, j = own_places(q.ids, r.ids)
    turned = np.ascontiguousarray(r.vectors.T)
    for a in range(0, len(q.ids), STRIPE):
        b = min(a + STRIPE, len(q.ids))
        norm = q.norms[a:b, None] * r.norms[None, :]
        x = q.vectors[a:b] @ turned
        some = norm > 0
        if some.all():
            x /= norm
        else:
            x = np.where(some, x / np.where(some, norm, 1), 0.0)
        x *= UNIT
        x += np.copysign(0.5, x)
        k = x.astype(np.int32)
        np.clip(k, -UNIT, UNIT, out=k)
        mine = (i >= a) & (i < b)
        yield a, b, k, (i[mine] - a, j[mine])


def _run(work, columns: list[str], finish=None):
    def run(batches):
        state: dict = {}
        for batch in batches:
            for x in batch.to_dict("records"):
                for out in work(Side(x, "q"), Side(x, "r"), x, state):
                    yield pd.DataFrame(out, columns=columns)
        if finish is not None and state:
            yield finish(state)

    return run


def _same(q: Side, r: Side, a: int, b: int) -> np.ndarray:
    """0 for labels that differ, 1 for equal ones, 2 where one is unknown."""
    s = (q.labels[a:b, None] == r.labels[None, :]).view(np.uint8)
    if not (q.known[a:b].all() and r.known.all()):
        s = np.where(q.known[a:b, None] & r.known[None, :], s, 2).astype(np.uint8)
    return s


SAME = "CASE s WHEN 1 THEN true WHEN 0 THEN false END AS same"


def tally(blocks: DataFrame) -> DataFrame:
    """(same, score, n): how many pairs have a score, by whether the labels are equal (null where one is unknown)."""
    size = 2 * UNIT + 1

    def work(q, r, x, state):
        count = state.setdefault("n", np.zeros(3 * size, np.int64))
        at = np.empty((len(q.ids), len(r.ids)), np.int64)
        for a, b, k, own in _stripes(q, r):
            c = at[a:b]
            np.add(k, UNIT, out=c)
            c += _same(q, r, a, b).astype(np.int64) * size
            np.subtract.at(count, c[own], 1)
        got = np.bincount(at.ravel())
        count[: len(got)] += got
        return ()

    def finish(state):
        n = state["n"]
        at = np.flatnonzero(n)
        return pd.DataFrame({"s": (at // size).astype(np.int32), "k": (at % size - UNIT).astype(np.int32), "n": n[at]})

    g = blocks.mapInPandas(_run(work, [], finish), "s int, k int, n long").groupBy("s", "k").agg(F.sum("n").alias("n"))
    return g.select(F.expr(SAME), (F.col("k") / F.lit(float(UNIT))).alias("score"), "n")


def judged(blocks: DataFrame, limit: DataFrame) -> DataFrame:
    """(label, side, same, hit, n): how many pairs lie above the limit (one row, threshold), by the query's label and whether the other's id is even or odd."""

    def work(q, r, x, state):
        t = x["threshold"]
        top = int(np.floor(t * UNIT)) + 1
        while top / UNIT > t:
            top -= 1  # the greatest number of millionths that is not above the limit
        found: dict[tuple, int] = {}
        odd = r.ids % 2 != 0
        for side, part in (("even", ~odd), ("odd", odd)):
            some = r.cut(part)
            if not len(some.ids):
                continue
            for a, b, k, own in _stripes(q, some):
                code = _same(q, some, a, b) * np.uint8(2) + (k > top).view(np.uint8)
                code[own] = 6
                per = np.stack([np.count_nonzero(code == c, axis=1) for c in range(6)], axis=1)
                for i, row in enumerate(per):
                    label = int(q.labels[a + i]) if q.known[a + i] else None
                    for c in np.flatnonzero(row):
                        key = (label, side, int(c) // 2, bool(c % 2))
                        found[key] = found.get(key, 0) + int(row[c])
        if found:
            yield pd.DataFrame([(*key, n) for key, n in found.items()], columns=["label", "side", "s", "hit", "n"]).astype({"label": "Int64"})

    columns = ["label", "side", "s", "hit", "n"]
    g = blocks.crossJoin(F.broadcast(limit.select("threshold"))).mapInPandas(_run(work, columns), "label long, side string, s int, hit boolean, n long")
    return g.groupBy("label", "side", "s", "hit").agg(F.sum("n").alias("n")).select("label", "side", F.expr(SAME), "hit", "n")


def summed(blocks: DataFrame) -> DataFrame:
    """(id, pairs, mean, best) of each query."""

    def work(q, r, x, state):
        for a, b, k, own in _stripes(q, r):
            k[own] = NONE
            mine = np.bincount(own[0], minlength=b - a)
            total, pairs = k.sum(axis=1, dtype=np.int64) - NONE * mine, k.shape[1] - mine
            some = pairs > 0
            yield {"id": q.ids[a:b][some], "pairs": pairs[some], "total": total[some], "best": k.max(axis=1)[some]}

    g = blocks.mapInPandas(_run(work, ["id", "pairs", "total", "best"]), "id long, pairs long, total long, best long").groupBy("id")
    return g.agg(F.sum("pairs").alias("pairs"), (F.sum("total") / F.lit(float(UNIT)) / F.sum("pairs")).alias("mean"), (F.max("best") / F.lit(float(UNIT))).alias("best"))


def nearest(blocks: DataFrame, most: int) -> DataFrame:
    """(id, other, score): each query's best rows, equal scores by id."""

    def work(q, r, x, state):
        m = len(r.ids)
        for a, b, k, own in _stripes(q, r):
            k[own] = NONE
            least = np.partition(k, m - most, axis=1)[:, m - most] if m > most else k.min(axis=1)
            i, j = np.nonzero((k >= least[:, None]) & (k != NONE))
            order = np.lexsort((r.ids[j], -k[i, j], i))
            i, j = i[order], j[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i, "left") < most
            i, j = i[keep], j[keep]
            yield {"id": q.ids[a:b][i], "other": r.ids[j], "score": k[i, j] / UNIT}

    d = blocks.mapInPandas(_run(work, ["id", "other", "score"]), "id long, other long, score double")
    return cap(d, ["id"], [F.desc("score"), "other"], most)


def split(queries: DataFrame, rows: DataFrame, side) -> DataFrame:
    """(side, positives, negatives): how many pairs there are of equal and of other labels, by a property of the row. These are products of counts, so no pair is made; pairs of a row with itself are taken off."""
    q = queries.where("label is not null").groupBy("label").agg(F.count("*").alias("qn"))
    r = rows.withColumn("side", side)
    known = r.where("label is not null").groupBy("side", "label").agg(F.count("*").alias("rn"))
    total = q.agg(F.sum("qn").alias("all"))
    own = r.join(queries.select("id", F.col("label").alias("ql")), "id").groupBy("side").agg(F.count_if(F.col("label") == F.col("ql")).alias("p"), F.count_if(F.col("label") != F.col("ql")).alias("x"), F.count("*").alias("own"))
    every = r.groupBy("side").agg(F.count("*").alias("rows")).crossJoin(F.broadcast(queries.agg(F.count("*").alias("queries"))))
    g = known.join(q, "label", "left").groupBy("side").agg(F.sum(F.coalesce(F.col("rn") * F.col("qn"), F.lit(0))).alias("same"), F.sum("rn").alias("rn"))
    d = every.join(g, "side", "left").join(own, "side", "left").crossJoin(F.broadcast(total)).na.fill(0)
    d = d.where(F.col("rows") * F.col("queries") > F.col("own"))
    return d.select("side", (F.col("same") - F.col("p")).alias("positives"), (F.col("rn") * F.col("all") - F.col("same") - F.col("x")).alias("negatives"))
