"""Operator 5: language-model scoring by a hierarchical Pitman-Yor model over words.

The restaurants of all contexts of one word share a parent, the restaurant of no context, whose dishes come from a base
measure of 2^-64 for every possible word. Text is cut into chunks; a chunk's word pairs, with the documents that they occur in, are
packed by context into parts, and shuffled once: the same exchange serves both the counts and the scores. What is gathered is every
word pair of the corpus, and all words' tables, so it grows with the corpus, and nothing that grows is ever broadcast.

Parent and children are sampled in turn: the tables of all contexts are the parent's customers, and the parent's probabilities the base by which all contexts are seated again. Every draw is a
hash of context, word, sweep and step, so the seating is the same however contexts are spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import MASK, WordHashes, mix, words

DISCOUNT, STRENGTH, BURN_IN, SAMPLES, ROUNDS, CHUNK_WORDS, CHUNK_ROWS = 0.7, 1.0, 2, 3, 2, 2_000_000, 60_000
BASE = 2.0**-64
MANY, CROWD, SEAT_BITS = 32, 1 << 16, 40
BLOB = "part int, chunk long, ctx binary, per binary, word binary, times binary, at binary, docs binary"
_DOC = np.dtype([("at", "<u2"), ("known", "?"), ("id", "<i8"), ("words", "<i8")])


def _six(x: np.ndarray) -> bytes:
    """The low six bytes of each number: 48 bits of hash, so that two of a billion words are seldom one."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def pack(chunk: int, ids: list, hashed: list[np.ndarray], parts: int) -> list[tuple]:
    """Rows of a chunk, one for each part that it has pairs or documents in. A text's first word has the context 0."""
    low = np.uint64((1 << 48) - 1)
    n = np.array([len(h) for h in hashed], np.int64)
    word = np.concatenate([*hashed, np.zeros(0, np.uint64)]) & low
    ctx = np.concatenate([np.zeros(1, np.uint64), word[:-1]]) if len(word) else word.copy()
    ctx[(np.cumsum(n) - n)[n > 0]] = 0
    at = np.repeat(np.arange(len(n)), n).astype(np.uint16)
    part = (mix(ctx + np.uint64(1)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((word, ctx, part))
    word, ctx, at, part = word[order], ctx[order], at[order], part[order]
    edges = np.searchsorted(part, np.arange(parts + 1))
    home = np.arange(len(n)) % parts
    rows = []
    for p in range(parts):
        lo, hi = edges[p], edges[p + 1]
        mine = np.nonzero(home == p)[0]
        if lo == hi and not len(mine):
            continue
        c, w = ctx[lo:hi], word[lo:hi]
        new = np.ones(hi - lo, bool)
        new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
        first = np.nonzero(new)[0]
        own, per = np.unique(c[first], return_counts=True)
        docs = np.array([(i, ids[i] is not None and ids[i] == ids[i], int(ids[i]) if ids[i] is not None and ids[i] == ids[i] else 0, n[i]) for i in mine], _DOC)
        times = np.diff(np.append(first, hi - lo))
        rows.append((p, chunk, _six(own), per.astype("<u4").tobytes(), _six(w[first]), times.astype("<u4").tobytes(), at[lo:hi].tobytes(), docs.tobytes()))
    return rows


def blobs(docs: DataFrame, parts: int) -> DataFrame:
    """The packed chunks of all texts, whole."""

    def run(batches):
        hashes, task, count = WordHashes(), TaskContext.get().partitionId(), 0
        names = [x.split()[0] for x in BLOB.split(", ")]
        ids, held, size = [], [], 0
        for b in batches:
            for i, text in zip(b.doc_id.astype(object), b.text):
                ids.append(i)
                held.append(hashes(words(text)))
                size += len(held[-1])
                if size >= CHUNK_WORDS or len(ids) >= CHUNK_ROWS:
                    yield pd.DataFrame(pack((task << 32) + count, ids, held, parts), columns=names)
                    ids, held, size, count = [], [], 0, count + 1
        if ids:
            yield pd.DataFrame(pack((task << 32) + count, ids, held, parts), columns=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, BLOB)


class Part:
    """The restaurants of some contexts: all pairs of a part, summed over chunks."""

    def __init__(self, pdf: pd.DataFrame):
        ctx = [np.repeat(_from_six(c), np.frombuffer(p, "<u4")) for c, p in zip(pdf.ctx, pdf.per)]
        word = [_from_six(w) for w in pdf.word]
        self.times = [np.frombuffer(t, "<u4") for t in pdf.times]
        c, w = np.concatenate([*ctx, np.zeros(0, "<u8")]), np.concatenate([*word, np.zeros(0, "<u8")])
        order = np.lexsort((w, c))
        new = np.ones(len(c), bool)
        new[1:] = (c[order][1:] != c[order][:-1]) | (w[order][1:] != w[order][:-1])
        self.pair = np.empty(len(c), np.int64)  # of each chunk's pairs, one chunk after the other
        self.pair[order] = np.cumsum(new) - 1
        keys = order[new]
        self.word = w[keys]
        self.contexts, self.of = np.unique(c[keys], return_inverse=True)
        self.c = np.bincount(self.pair, np.concatenate([*self.times, np.zeros(0)]), len(keys)).astype(np.int64)
        self.t = np.minimum(self.c, 1).astype(np.float64)
        self.key = mix(self.contexts[self.of] * np.uint64(0x9E3779B97F4A7C15) + mix(self.word + np.uint64(1))) if len(keys) else np.zeros(0, np.uint64)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Of each pair's context."""
        return np.bincount(self.of, x, len(self.contexts))[self.of]

    def sweep(self, base: np.ndarray, d: float, theta: float, turn: int) -> None:
        """Seats all customers again, given the parent's predictive probabilities; turn tells one sweep's draws from another's."""
        self.t = seat(self.c, base, self.sums(self.t) - self.t, d, theta, mix(self.key + np.uint64(turn * 0xD1342543DE82EF95 & MASK)))

    def predictive(self, base: np.ndarray, d: float, theta: float) -> np.ndarray:
        return (self.c - d * self.t + (theta + d * self.sums(self.t)) * base) / (theta + self.sums(self.c.astype(float)))


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    """A number in (0, 1) for each key, by hash."""
    return uniforms(key, np.uint64(step * 0x9E3779B97F4A7C15 & MASK))


def uniforms(key: np.ndarray, by: np.ndarray | np.uint64) -> np.ndarray:
    return ((mix(key + by) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def lgamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for numbers of 5 or more, by Stirling's series."""
    y = 1 / x
    z = y * y
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + y * (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680)))


def first_to_open(x: np.ndarray, a: np.ndarray, limit: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The least m from 1 to `left` with lgamma(x + m) - lgamma(x + m + a) below the limit, where `left` is known to have it.

    That difference is nearly -a log(x + m + (a - 1) / 2), whose root, mended once, is mostly m itself; what it misses is found by halving.
    """

    def stay(m: np.ndarray, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        low, high = lgamma(np.concatenate([x[i] + m, x[i] + m + a[i]])).reshape(2, -1)
        return low - high

    shift = x + (a - 1) / 2
    root = np.clip(np.exp(np.minimum(-limit / a, 700.0)) - shift, 1, left)
    guess = np.clip(np.ceil((root + shift) * np.exp(np.clip((stay(root) - limit) / a, -700.0, 700.0)) - shift), 1, left)
    low, high = lgamma(np.concatenate([x + guess, x + guess - 1, x + guess + a, x + guess - 1 + a])).reshape(2, -1)
    yes, before = (low - high).reshape(2, -1) < limit
    before &= guess > 1
    lo, hi = np.where(before, 0.0, np.where(yes, guess - 1, guess)), np.where(before, guess - 1, np.where(yes, guess, left))
    wide = np.flatnonzero(hi - lo > 1)
    while len(wide):  # none opens within lo, one does within hi
        mid = np.floor((lo[wide] + hi[wide]) / 2)
        yes = stay(mid, wide) < limit[wide]
        hi[wide], lo[wide] = np.where(yes, mid, hi[wide]), np.where(yes, lo[wide], mid)
        wide = wide[hi[wide] - lo[wide] > 1]
    return hi


def seat_crowds(c: np.ndarray, t: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, theta: float, key: np.ndarray, done: int) -> np.ndarray:
    """Tables after all c customers, of dishes that have t tables after the first `done`: what seating one after the other by the same numbers gives.

    A block of customers is seated at once, given who opened a table before each of them, again and again until nobody changes. Each time at least one more of the first is
    right, and mostly nearly all are, for a block is small beside those who sit.
    """
    t, live = t.copy(), np.arange(len(c))
    while len(live):
        k = int(min(max(32, done // 4), CROWD, c[live].max() - done))
        n = done + np.arange(k)
        step = n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for lo in range(0, len(live), max(1, CROWD // k)):
            some = live[lo : lo + max(1, CROWD // k)]
            u = uniforms(key[some, None], step)
            u[n >= c[some, None]] = 2.0  # nobody sits there
            scale, rest = base[some, None], others[some, None]
            opened = np.zeros(u.shape, bool)
            while True:
                tl = t[some, None] + (np.cumsum(opened, axis=1) - opened)
                new = (theta + d * (tl + rest)) * scale
                now = u < new / (np.maximum(n - d * tl, 1e-9) + new)
                if (now == opened).all():
                    break
                opened = now
            t[some] += opened.sum(axis=1)
        done += k
        live = live[c[live] > done]
    return t


def seat(c: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, theta: float, key: np.ndarray, steps: int = 32) -> np.ndarray:
    """Tables of each dish after its c customers are seated anew, one after the other, given the other dishes' tables.

    The first customer opens a table; the next joins one of the dish's t tables with weight (seated - d t), or
    opens one with weight (theta + d (t + others)) base. The first `steps` customers are drawn one by one. Of the rest, the next one to open a table is drawn at once: that m in a row
    join has a chance that is a ratio of gamma functions. Both follow the same law exactly; the second takes as many draws as there are tables, not customers.
    Dishes that will open many more tables are seated one by one to the end, but block by block at once: the time of both grows with the text, not faster.
    """
    t = np.minimum(c, 1).astype(np.float64)
    live = np.nonzero(c > 1)[0]
    for done in range(1, steps):
        if not len(live):
            return t
        tl = t[live]
        new = (theta + d * (tl + others[live])) * base[live]
        t[live] = tl + (uniform(key[live], done) < new / (np.maximum(done - d * tl, 1e-9) + new))
        live = live[c[live] > done + 1]
    many = (theta + d * (t[live] + others[live])) * base[live] * np.log(c[live] / steps) > MANY
    crowd, live = live[many], live[~many]
    t[crowd] = seat_crowds(c[crowd], t[crowd], base[crowd], others[crowd], d, theta, key[crowd], steps)
    live_n, turn = np.full(len(live), float(steps)), steps
    while len(live):
        tl = t[live]
        a = (theta + d * (tl + others[live])) * base[live]
        x, left = live_n - d * tl, c[live] - live_n
        now, then, after, at_end = lgamma(np.concatenate([x, x + a, x + left, x + left + a])).reshape(4, -1)
        limit = np.log(uniform(key[live], turn)) - then + now
        opens = after - at_end < limit
        live, live_n, x, a, limit, left = live[opens], live_n[opens], x[opens], a[opens], limit[opens], left[opens]
        if not len(live):
            return t
        live_n = live_n + first_to_open(x, a, limit, left)
        t[live] += 1
        more = c[live] > live_n
        live, live_n, turn = live[more], live_n[more], turn + 1
    return t


def word_probabilities(tables: DataFrame, d: float, theta: float) -> DataFrame:
    """(part, word, p): the predictive probability, in the restaurant of no context, of each part's words.

    Its customers are the tables of all contexts. Under the base of 2^-64 each word has one table there: that a
    second opens has a chance below 10^-10 for a billion words. The tables come as (word, seats), seats being the part times 2^SEAT_BITS plus its
    number of tables of the word: all three uses take both columns and none adds a filter, so there is one exchange, and the tables are worked out once.
    """
    spread = tables.where("word is not null").repartition("word")
    totals = spread.groupBy("word").agg(F.sum(F.col("seats").bitwiseAND(F.lit((1 << SEAT_BITS) - 1))).alias("customers"))
    whole = F.broadcast(totals.agg(F.sum("customers").alias("all"), F.count("*").alias("words")))
    p = (F.col("customers") - d + (theta + d * F.col("words")) * BASE) / (theta + F.col("all"))
    parts = spread.select(F.shiftright("seats", SEAT_BITS).cast("int").alias("part"), "word")
    return parts.join(totals.crossJoin(whole).select("word", p.alias("p")), "word").select("part", "word", "p")


def lm_scores(docs: DataFrame, d: float = DISCOUNT, theta: float = STRENGTH, burn_in: int = BURN_IN, samples: int = SAMPLES, rounds: int = ROUNDS, seed: int = 7, parts: int | None = None) -> DataFrame:
    """(doc_id, n_words, bits_per_word, perplexity) of every row: the corpus fits the model, and the model scores each of its texts, whole.

    The parent is sampled `rounds` times from the contexts' tables, the first time by seatings under a base that is the same for all words, then by seatings under itself. A word's probability after the word before it is averaged over `samples` seatings by Gibbs sampling, after `burn_in`
    others; perplexity is per word. Words are lower-case runs of letters, digits and underscores. A text without any, or null, counts nothing
    and scores null; repeated rows count and score each time, also those without doc_id. Other columns are
    never read. An empty table gives an empty result. The number of parts changes nothing but the order of sums. A context's pairs are in one part, so one context must fit in a task's memory.
    """
    spark = docs.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = blobs(docs, parts)
    turns = burn_in + samples

    def tables(part: Part, number: int) -> pd.DataFrame:
        own, at = np.unique(part.word, return_inverse=True)
        return pd.DataFrame({"word": own.view(np.int64), "seats": np.bincount(at, part.t, len(own)).astype(np.int64) + (int(number) << SEAT_BITS)})

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        part = Part(pdf)
        guess = np.full(len(part.c), 1e-6)
        for k in range(burn_in):
            part.sweep(guess, d, theta, seed * 1000 + k)
        return tables(part, pdf.part.iloc[0])

    def based(part: Part, base: pd.DataFrame) -> np.ndarray:
        known = base.sort_values("word")
        return known.p.to_numpy()[np.searchsorted(known.word.to_numpy(), part.word.view(np.int64))] if len(part.c) else np.zeros(0)

    table = "word long, seats long"
    probabilities = word_probabilities(packed.groupBy("part").applyInPandas(first, table), d, theta)

    def resampled(r: int):
        def again(pdf: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
            part = Part(pdf)
            p = based(part, base)
            for k in range(burn_in):
                part.sweep(p, d, theta, seed * 1000 + r * turns + k)
            return tables(part, pdf.part.iloc[0])

        return again

    for r in range(1, rounds):
        probabilities = word_probabilities(packed.groupBy("part").cogroup(probabilities.groupBy("part")).applyInPandas(resampled(r), table), d, theta)

    def last(pdf: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        part = Part(pdf)
        p = based(part, base)
        mean = np.zeros(len(p))
        for k in range(turns):
            part.sweep(p, d, theta, seed * 1000 + rounds * turns + k)
            if k >= burn_in:
                mean += part.predictive(p, d, theta) / samples
        bits = -np.log2(mean)
        rows, start = [], 0
        for chunk, times, at, own in zip(pdf.chunk, part.times, pdf["at"], pdf.docs):
            each = np.repeat(bits[part.pair[start : start + len(times)]], times)
            start += len(times)
            sums = np.bincount(np.frombuffer(at, "<u2"), each)
            there = np.nonzero(sums)[0]
            rows.append((chunk, there.astype("<u2").tobytes(), sums[there].astype("<f4").tobytes(), own))
        return pd.DataFrame(rows, columns=["chunk", "at", "bits", "docs"])

    scored = packed.groupBy("part").cogroup(probabilities.groupBy("part")).applyInPandas(last, "chunk long, at binary, bits binary, docs binary")

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        docs = np.sort(np.concatenate([np.frombuffer(x, _DOC) for x in pdf.docs]), order="at")
        total = np.zeros(len(docs))
        for at, bits in zip(pdf["at"], pdf.bits):
            total[np.frombuffer(at, "<u2")] += np.frombuffer(bits, "<f4")
        out = pd.DataFrame({"doc_id": pd.array(docs["id"], "Int64"), "n_words": docs["words"]})
        out.loc[~docs["known"], "doc_id"] = pd.NA
        out["bits_per_word"] = pd.array(total / np.maximum(docs["words"], 1), "Float64")
        out.loc[docs["words"] == 0, "bits_per_word"] = pd.NA
        return out

    return scored.groupBy("chunk").applyInPandas(together, "doc_id long, n_words long, bits_per_word double").withColumn("perplexity", F.pow(F.lit(2.0), "bits_per_word"))
