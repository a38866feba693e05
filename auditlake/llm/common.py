"""Shared pieces of the training-data operators: tokens, hashing, scratch space, components."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
MASK = (1 << 64) - 1
FILTER_BITS = 1 << 24
BATCH_BYTES, BATCH_KEY = 1 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores; [] for null or empty text."""
    return WORD.findall(text.lower()) if text else []


def hash64(word: str) -> int:
    """First 8 bytes of the word's MD5, big-endian; DuckDB can compute the same."""
    return int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[:8], "big")


class WordHashes:
    """Word -> 64-bit hash with a bounded cache; the bound limits memory only, never results."""

    def __init__(self, bound: int = 120_000):
        self.bound, self.known = bound, {}

    def __call__(self, toks: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.bound:
            known.clear()
        for w in set(toks).difference(known):
            known[w] = hash64(w)
        return np.fromiter(map(known.__getitem__, toks), np.uint64, len(toks))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words in order; empty if there are fewer words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m])
    return out


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master, as in tests, may have a temporary one instead."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        context = spark.sparkContext
        have = context._jsc.sc().getCheckpointDir()
        if have.isDefined():
            d = have.get()
        elif not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            d = "file://" + tempfile.mkdtemp(prefix="auditlake-")
            context.setCheckpointDir(d)
    return d.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint in the shared folder."""
    scratch(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{scratch(spark)}/{what}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tidy(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of batches, which gives the memory of its caches back to the system when its task ends: a worker lives on for other tasks."""

    def run(batches):
        yield from fn(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not every C library has it
            pass

    return run


def small_batches(spark: SparkSession) -> None:
    """Texts go to the Python workers and back about BATCH_BYTES at once, a longer one by itself and whole: the bound limits memory only, never results.

    Else as many rows as a task has, up to 10 000, are one frame, which the JVM and the worker both hold. A bound that the session has is kept.
    """
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def per_doc(docs: DataFrame, fn: Callable[[Iterator], Iterator], schema: str, *columns: str) -> DataFrame:
    """mapInPandas over the named columns only, so that extra columns never travel or clash."""
    return docs.select(*columns).mapInPandas(tidy(fn), schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of the connected components of an undirected edge list; root is the least node.

    Alternating large-star and small-star rounds, O(log n) of them in practice. A star's least node is an aggregate, combined before
    its shuffle and joined back, so that Spark can split the edges of a hub over tasks. No rows in: no rows out. Loops and repeats are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.join(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u")
        large = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
        if now == before or not now[0]:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def held(df: DataFrame, key: Column, of: DataFrame, of_key: Column, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among those of `of`, rows whose key is certainly not), by a bitmap of fixed size, sent to all tasks 64 bits a row: so that few rows need a shuffle to meet `of`."""
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(bits))
    bit = of.select(place(of_key).alias("__at"))
    maps = bit.groupBy(F.shiftright("__at", 6).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(__at & 63 as int)))").alias("__bits"))
    d = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), place(key).alias("__at")).withColumn("__word", F.shiftright("__at", 6)).join(F.broadcast(maps), "__word", "left")
    there = F.coalesce(F.expr("(shiftright(__bits, cast(__at & 63 as int)) & 1) != 0"), F.lit(False))
    return d.where(there).select("__row.*"), d.where(~there).select("__row.*")


class Identity:
    """Numbers for rows of (doc_id, text): a row's number is its doc_id, but for rows without one, or that share it with another text; these have numbers
    beyond all doc_ids, one for each distinct pair. Where a table has no such rows, nothing is joined."""

    def __init__(self, docs: DataFrame):
        d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th")).where("text is not null")
        odd = d.groupBy("doc_id").agg(F.min("th").alias("lo"), F.max("th").alias("hi"))
        odd = cut(odd.where("doc_id is null or lo != hi").select("doc_id"))
        self.numbers = None
        if not odd.isEmpty():
            top = docs.agg(F.max("doc_id")).first()[0] or 0
            pairs = d.alias("d").join(odd.alias("o"), F.expr("d.doc_id <=> o.doc_id"), "left_semi").distinct()
            self.numbers = cut(pairs.select("doc_id", "th", (F.monotonically_increasing_id() + F.lit(int(top) + 1)).alias("number")))

    def add(self, df: DataFrame, name: str = "id") -> DataFrame:
        """df, which has doc_id and text, with the number."""
        if self.numbers is None:
            return df.withColumn(name, F.col("doc_id").cast("long"))
        n = self.numbers.select(F.col("doc_id").alias("__of"), "th", "number")
        return df.withColumn("__th", F.xxhash64("text")).join(n, F.expr("doc_id <=> __of and __th = th"), "left").withColumn(name, F.coalesce("number", "doc_id")).drop("__th", "__of", "th", "number")

    def back(self, df: DataFrame, *names: str) -> DataFrame:
        """df with doc_ids in place of the numbers in these columns."""
        if self.numbers is None:
            return df
        for c in names:
            n = self.numbers.select(F.col("number").alias("__n"), F.col("doc_id").alias("__d"))
            df = df.join(n, F.col(c) == F.col("__n"), "left").withColumn(c, F.when(F.col("__n").isNotNull(), F.col("__d")).otherwise(F.col(c))).drop("__n", "__d")
        return df


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of least hash of the key: the documented bound on labelled rows that a classifier is fitted on."""
    return df.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(n)
