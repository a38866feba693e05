"""Operator 3: benchmark decontamination, a prefix-filtered set join over item-sized windows."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.llm.common import WordHashes, cut, held, per_doc, shingle_hashes, words

SHINGLE, CONTAINMENT, BROADCAST_SHINGLES = 5, 0.6, 2_000_000


def item_shingles(benchmark: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(item, item_id, span, w, h): the distinct shingles of each distinct (item_id, text), which the hash `item` tells apart; an item of fewer words than n has one of all its words; w is the words in a shingle."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            out = []
            for item, id_, text in zip(b["item"], b.item_id.astype(object), b.text):
                toks = words(text)
                if toks:
                    w = min(n, len(toks))
                    sh = np.unique(shingle_hashes(hashes(toks), w)).view(np.int64)
                    out += [(item, id_, len(toks) - w + 1, w, x) for x in sh.tolist()]
            d = pd.DataFrame(out, columns=["item", "item_id", "span", "w", "h"])
            yield d.astype({"item_id": "Int64"})

    b = benchmark.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    return per_doc(b, run, "item long, item_id long, span int, w int, h long", "item", "item_id", "text").distinct()


def _doc_shingles(docs: DataFrame, widths: list[int], keep) -> DataFrame:
    """(doc_id, th, w, pos, h, n) of the documents' shingles, th the hash of the text; keep: a broadcast {w: sorted hashes}, or None for all of them."""
    names = ("doc_id", "th", "w", "pos", "h", "n")

    def frame(parts: list) -> pd.DataFrame:
        d = pd.DataFrame({c: np.concatenate(x) for c, x in zip(("none", *names), zip(*parts))})
        d["doc_id"] = d["doc_id"].astype("Int64").mask(d["none"])
        return d[list(names)]

    def run(batches):
        hashes = WordHashes()
        tables = {}
        if keep is not None:
            for w, known in keep.value.items():
                size = 1 << max(16, int(len(known) * 16).bit_length())
                seen = np.zeros(size, bool)
                seen[(known & np.uint64(size - 1)).astype(np.int64)] = True
                tables[w] = (known, seen, np.uint64(size - 1))
        for b in batches:
            parts, held = [], 0
            for doc, none, th, text in zip(b.doc_id, b.none, b.th, b.text):
                h = hashes(words(text))
                for w in widths:
                    sh = shingle_hashes(h, w)
                    at = np.arange(len(sh))
                    if keep is not None:
                        known, seen, low = tables[w]
                        at = at[seen[(sh & low).astype(np.int64)]]
                        near = np.searchsorted(known, sh[at])
                        at = at[known[np.minimum(near, len(known) - 1)] == sh[at]]
                    if len(at):
                        k = len(at)
                        parts.append((np.full(k, none), np.full(k, doc, np.int64), np.full(k, th, np.int64), np.full(k, w, np.int32), at, sh[at].view(np.int64), np.full(k, len(sh), np.int64)))
                        held += k
                if held > 500_000:
                    yield frame(parts)
                    parts, held = [], 0
            if parts:
                yield frame(parts)

    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("th"), "text").where("text is not null")
    return per_doc(d, run, "doc_id long, th long, w int, pos long, h long, n long", "doc_id", "none", "th", "text")


def _best_window(pos: np.ndarray, h: np.ndarray, span: int) -> tuple[int, int]:
    """(most distinct shingles in any window of `span` positions, its least start)."""
    order = np.argsort(pos, kind="stable")
    p, x = pos[order].tolist(), h[order].tolist()
    inside: Counter = Counter()
    best, start, j = 0, 0, 0
    for i in range(len(p)):
        inside[x[i]] += 1
        while p[j] <= p[i] - span:
            inside[x[j]] -= 1
            if not inside[x[j]]:
                del inside[x[j]]
            j += 1
        if len(inside) > best:
            best, start = len(inside), p[j]
    return best, start


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, n: int = SHINGLE, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """(doc_id, item_id, matched, shingles, start): document and item pairs where a window of the item's length holds at least `containment` of the item's distinct shingles.

    Shingles are runs of n lower-case words. Rarity is the number of documents with a shingle, over all documents; an item of
    m shingles needs o = ceil(containment * m) of them, so any match holds one of its m - o + 1 rarest, the prefix,
    which alone is joined. A document with fewer than o shingles is dropped (length), and so is a candidate
    with fewer than o hits around the prefix hit (position). What is left is counted exactly, window by window.
    `start` is the least position of the first hit in a best window. Null or empty texts match nothing. Each distinct (doc_id, text), and
    each distinct (item_id, text), stands for itself, those without an id too; equal rows count once, and equal items each match. No document or
    no item: no rows. Other columns are never read. The items' shingles are broadcast up to `broadcast_shingles`
    of them, and joined by a shuffle beyond that, with the same result.
    """
    return _contaminated(docs, benchmark, containment, n, broadcast_shingles).drop("th")


def _contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, n: int = SHINGLE, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """The rows of contaminated(), with the hash of the text."""
    spark = docs.sparkSession
    items = cut(item_shingles(benchmark, n))
    sized = items.withColumn("m", F.count("*").over(W.partitionBy("item", "w"))).withColumn("o", F.ceil(F.col("m") * F.lit(containment) - F.lit(1e-9)).cast("int"))
    total, widths = items.agg(F.count("*"), F.collect_set("w")).first()
    if not total:
        widths = []
    if total <= broadcast_shingles:
        t = items.select("w", "h").distinct().toArrow()
        w, h = t.column("w").to_numpy(), t.column("h").to_numpy()
        keep = spark.sparkContext.broadcast({x: np.sort(h[w == x].astype(np.int64).view(np.uint64)) for x in widths})
        hits = _doc_shingles(docs, widths, keep)
    else:
        hits = _doc_shingles(docs, widths, None).join(items.select("w", "h").distinct(), ["w", "h"], "left_semi")
    doc = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "th")
    hits = cut(hits.distinct().select(doc.alias("doc"), "w", "pos", "h", "n"))
    rarity = hits.groupBy("w", "h").agg(F.countDistinct("doc").alias("df"))
    ranked = sized.join(rarity, ["w", "h"], "left").withColumn("rank", F.row_number().over(W.partitionBy("item", "w").orderBy(F.coalesce("df", F.lit(0)), "h")))
    prefix = ranked.where("rank <= m - o + 1 and df is not null").select("item", "item_id", "w", "h", "span", "m", "o")
    joined = hits.where("n > 0").join(prefix, ["w", "h"]).where("n >= o").select("doc", "item", "item_id", "w", "span", "m", "o", F.col("pos").alias("at"))
    ours = items.select("item", "w", "h")
    around = joined.join(ours, ["item", "w"]).join(hits.select("doc", "w", "h", "pos"), ["doc", "w", "h"]).where("pos > at - span and pos < at + span")
    enough = around.select("doc", "item", "item_id", "w", "span", "m", "o", "at", "pos", "h").distinct()
    per_at = enough.withColumn("k", F.size(F.collect_set("h").over(W.partitionBy("doc", "item", "w", "at")))).where("k >= o")
    near = per_at.groupBy("doc", "item", "item_id", "m", "o", "span").agg(F.collect_set(F.struct("pos", "h")).alias("hits"))
    near = near.select(F.when(~F.col("doc.none"), F.col("doc.id")).alias("doc_id"), "doc.th", "item_id", "m", "o", "span", "hits")

    def verify(batches):
        for b in batches:
            rows = []
            for doc, th, item, m, o, span, found in zip(b.doc_id.astype("Int64").astype(object), b.th, b.item_id.astype("Int64").astype(object), b.m, b.o, b.span, b.hits):
                best, start = _best_window(np.array([x["pos"] for x in found], np.int64), np.array([x["h"] for x in found], np.int64), span)
                if best >= o:
                    rows.append((doc, th, item, best, m, start))
            d = pd.DataFrame(rows, columns=["doc_id", "th", "item_id", "matched", "shingles", "start"])
            yield d.astype({"doc_id": "Int64", "item_id": "Int64"})

    return near.mapInPandas(verify, "doc_id long, th long, item_id long, matched int, shingles int, start long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, each row by its own text; columns of any name stay. Only rows that may go are shuffled."""
    gone = cut(_contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("__of"), F.col("th").alias("__of_th")).distinct())
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    some, others = held(d, F.col("th"), gone, F.col("__of_th"))
    clean = some.join(gone, F.expr("doc_id <=> __of and th = __of_th and text is not null"), "left_anti")
    return clean.select("row").union(others.select("row")).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
