"""Operator 1: near-duplicate groups by SimHash; no pair within the limit is left out, by pigeonhole blocks of small radius."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import components, cut, held, per_doc, words

BITS, LIMIT, RECALL, HUB_ROUNDS = 256, 36, 0.93, 2
PARTS, GROUPS, GROUP, AT_ONCE = 13, 8, 1 << 18, 1 << 17


class _Prints:
    """Fingerprints of texts. A word votes on 256 bits, those of MD5(word#0) and MD5(word#1), with weight 1 + floor(log2(its count))."""

    def __init__(self, bound: int = 100_000):
        self.bound, self.row = bound, {}
        self.bits = np.zeros((bound + 1, BITS // 8), np.uint8)

    def rows(self, keys: list[str]) -> np.ndarray:
        """The vote bits of each word; words beyond the cache's bound are computed and not kept."""
        out, row = np.zeros((len(keys), BITS // 8), np.uint8), self.row
        if len(row) + len(keys) > self.bound:
            row.clear()
        keep = len(keys) <= self.bound
        at, to = [], []
        for i, w in enumerate(keys):
            r = row.get(w)
            if r is None:
                b = w.encode("utf-8", "surrogatepass")
                d = np.frombuffer(hashlib.md5(b + b"#0", usedforsecurity=False).digest() + hashlib.md5(b + b"#1", usedforsecurity=False).digest(), np.uint8)
                if keep:
                    r = row[w] = len(row)
                    self.bits[r] = d
                out[i] = d
            else:
                at.append(i)
                to.append(r)
        out[at] = self.bits[to]
        return out

    def __call__(self, text: str | None) -> bytes | None:
        counts = Counter(words(text))
        if not counts:
            return None
        keys = list(counts)
        weight = np.fromiter((n.bit_length() for n in counts.values()), np.float32, len(keys))
        votes = np.zeros(BITS, np.float32)
        for i in range(0, len(keys), 4096):  # bounds memory on very long texts
            votes += weight[i : i + 4096] @ np.unpackbits(self.rows(keys[i : i + 4096]), axis=1).astype(np.float32)
        return np.packbits(votes * 2 > weight.sum()).tobytes()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp binary(32)); th is the text's hash, fp is null where the text has no word."""

    def run(batches):
        prints = _Prints()
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "th": b.th.astype("Int64"), "fp": [prints(t) for t in b.text]})

    d = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return per_doc(d, run, "doc_id long, th long, fp binary", "doc_id", "th", "text")


def block_plan(n: int, limit: int = LIMIT, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a block, permutations of the bits) for n prints, of blocks that are looked up as they are: linked_prints takes its hubs from such.

    A block has about log2(n) - 4 bits, 16 at least, so chance partners stay a few dozen at any n. Wider blocks are shared by fewer
    close pairs; with so many permutations, pairs exactly `limit` bits apart would have the same recall at every size. Pairs don't depend on it: see similar_prints.
    """
    width = min(40, max(16, math.ceil(math.log2(max(2, n))) - 4))
    shared = math.comb(BITS - limit, width) / math.comb(BITS, width)
    return width, max(1, math.ceil(math.log(1 - recall) / math.log(1 - shared) / (BITS // width)))


def _blocks(fp: pd.Series, width: int, permutations: int) -> list[list[int]]:
    out = []
    raw = np.frombuffer(b"".join(fp), np.uint8).reshape(len(fp), BITS // 8)
    bits = np.unpackbits(raw, axis=1)
    power = (1 << np.arange(width, dtype=np.int64))[::-1]
    for p in range(permutations):
        order = np.arange(BITS) if p == 0 else np.random.default_rng(p).permutation(BITS)
        per = BITS // width
        for k in range(per):
            key = bits[:, order[k * width : (k + 1) * width]].astype(np.int64) @ power
            out.append(key + ((p * per + k) << 40))
    return np.stack(out, 1)


def _block_rows(prints: DataFrame, width: int, permutations: int, some: slice = slice(None)) -> DataFrame:
    """(block, root, id, f0..f3): a row for each block of a print."""

    def run(batches):
        for b in batches:
            if len(b):
                keys = _blocks(b.fp, width, permutations)[:, some]
                n, m = keys.shape
                rep = {c: np.repeat(b[c].to_numpy(), m) for c in ("root", "id", "f0", "f1", "f2", "f3")}
                yield pd.DataFrame({"block": keys.ravel(), **rep})

    return prints.select("root", "id", "fp", "f0", "f1", "f2", "f3").mapInPandas(run, "block long, root long, id long, f0 long, f1 long, f2 long, f3 long")


def _apart(a: str, b: str) -> str:
    return "+".join(f"bit_count({a}.f{i} ^ {b}.f{i})" for i in range(4))


def ball_plan(limit: int = LIMIT) -> list[tuple[int, int, int]]:
    """(first bit, end, radius) of blocks such that two prints within `limit` bits differ in at most `radius` bits of one block at least, for certain: radii plus one add up to limit + 1."""
    edges = [BITS * k // PARTS for k in range(PARTS + 1)]
    more, rest = divmod(limit + 1, PARTS)
    return [(lo, hi, r) for k, (lo, hi) in enumerate(zip(edges, edges[1:])) if (r := more - (k >= rest)) >= 0]


def _key(f: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Bits lo to hi, fewer than 64, of prints of four 64-bit numbers."""
    i, j = lo // 64, (hi - 1) // 64
    end = np.uint64(hi - 64 * j)
    key = f[:, j] >> (np.uint64(64) - end)
    if i != j:
        key |= f[:, i] << end
    return (key & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64)


def close_pairs(a: np.ndarray, b: np.ndarray, limit: int):
    """Arrays (places in a, places in b) of the prints, rows of four uint64, within `limit` bits: all such pairs, some more than once.

    Prints are sorted by a block's bits; for each way to change up to `radius` of these, the changed ones of a meet the equal ones of b.
    """
    for lo, hi, radius in ball_plan(limit):
        ka, kb = _key(a, lo, hi), _key(b, lo, hi)
        oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
        ka, sa, sb = ka[oa], a[oa], b[ob]
        a0, a1, b0, b1 = (np.ascontiguousarray(x[:, i]) for x in (sa, sb) for i in (0, 1))
        size = np.bincount(kb, minlength=1 << (hi - lo)).astype(np.int32)
        start = (np.cumsum(size) - size).astype(np.int32)
        for flips in (f for r in range(radius + 1) for f in combinations(range(hi - lo), r)):
            key = ka ^ sum(1 << f for f in flips)
            there = np.flatnonzero(size[key])
            n = size[key[there]].astype(np.int64)
            ends, at = np.cumsum(n), start[key[there]]
            begin = 0
            while begin < len(there):  # bounds memory where many prints share a block
                done = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
                own = n[begin:end]
                x = np.repeat(there[begin:end], own)
                y = np.repeat(at[begin:end] - (ends[begin:end] - own - done), own)
                y += np.arange(len(x))
                begin = end
                near = np.flatnonzero(np.bitwise_count(a0.take(x) ^ b0.take(y)) + np.bitwise_count(a1.take(x) ^ b1.take(y)) <= limit)  # of half the bits
                x, y = x[near], y[near]
                near = np.bitwise_count(sa[x] ^ sb[y]).sum(axis=1, dtype=np.int64) <= limit
                if near.any():
                    yield oa[x[near]], ob[y[near]]


def similar_prints(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, b), a < b, of the roots of distinct prints (id, f0..f3, root or else their own id) within `limit` bits, every one of them; those of one root make none.

    Prints are dealt into groups, and each two groups meet in one task, so a print is sent once for each group. That every print meets every other costs
    time by the square of their number, of which close_pairs looks at few: one in 30 on prose, whose prints are alike.
    """
    if "root" not in prints.columns:
        prints = prints.withColumn("root", F.col("id"))
    n = prints.count()
    groups = max(1, min(GROUPS, n // 1000), -(-n // GROUP))
    mine, other = F.pmod(F.xxhash64("id"), F.lit(groups)), F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    words = [f"f{i}" for i in range(4)]
    dealt = prints.select("root", *words, mine.cast("int").alias("mine"), other.alias("other")).withColumn("cell", F.least("mine", "other") * F.lit(groups).cast("long") + F.greatest("mine", "other"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = divmod(int(pdf.cell.iloc[0]), groups)
        sides = [pdf[pdf.mine == g] for g in (low, high)]
        (a, b), (ra, rb) = [x[words].to_numpy(np.int64).view(np.uint64) for x in sides], [x.root.to_numpy() for x in sides]
        found, held_ = np.zeros((0, 2), np.int64), []
        for x, y in close_pairs(a, b, limit):
            p = np.stack([np.minimum(ra[x], rb[y]), np.maximum(ra[x], rb[y])], 1)
            held_.append(p[p[:, 0] < p[:, 1]])
            if sum(map(len, held_)) > AT_ONCE:
                found, held_ = np.unique(np.concatenate([found, *held_]), axis=0), []
        return pd.DataFrame(np.unique(np.concatenate([found, *held_]), axis=0), columns=["a", "b"])

    cells = dealt.repartition(groups * (groups + 1), "cell")
    return cells.groupBy("cell").applyInPandas(meet, "a long, b long").distinct()


def linked_prints(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(id, root) of the prints (id, fp, f0..f3) that any other is linked to: components of similar_prints.

    A group of many near copies would make pairs by its square. So each print is first compared with one other of each of a few blocks, that of
    the least root, and takes its root if they are close; then again by other blocks. Only prints of different roots are paired last. What
    has one root is linked through it, so the components are those of all pairs.
    """
    width, _ = block_plan(prints.count(), limit)
    each = max(1, BITS // width // HUB_ROUNDS)
    rooted, edges = prints.withColumn("root", F.col("id")), []
    for k in range(HUB_ROUNDS):
        rows = _block_rows(rooted, width, 1, slice(k * each, (k + 1) * each))
        hubs = rows.groupBy("block").agg(F.min(F.struct("root", "f0", "f1", "f2", "f3")).alias("h"), F.max("root").alias("last")).where("h.root < last")
        links = rows.alias("l").join(hubs.select("block", "h.*").alias("h"), F.expr(f"l.block = h.block and l.root != h.root and {_apart('l', 'h')} <= {limit}"))
        edges.append(cut(links.select(F.col("h.root").alias("a"), F.col("l.root").alias("b")).distinct()))
        up = edges[-1].groupBy(F.col("b").alias("root")).agg(F.min("a").alias("up"))
        rooted = cut(rooted.join(up, "root", "left").select("id", "fp", "f0", "f1", "f2", "f3", F.coalesce("up", "root").alias("root")))
    edges.append(cut(similar_prints(rooted, limit)))
    return components(reduce(DataFrame.unionByName, edges)).select(F.col("node").alias("id"), "root")


def _grouped(docs: DataFrame, limit: int) -> DataFrame:
    """(doc_id, th, n, group_id, group_size, kept) of every distinct (doc_id, text): n is how many rows are equal."""
    fps = cut(fingerprints(docs).groupBy("doc_id", "th").agg(F.min("fp").alias("fp"), F.count("*").alias("n")))
    word = [F.conv(F.hex(F.substring("fp", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"f{i}") for i in range(4)]
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    prints = cut(fps.where("fp is not null").groupBy("fp").agg(F.min(who).alias("head"), F.count("*").alias("docs")).select(F.monotonically_increasing_id().alias("id"), "fp", "head", "docs", *word))
    linked = linked_prints(prints.select("id", "fp", "f0", "f1", "f2", "f3"), limit)
    rooted = cut(prints.select("id", "fp", "head", "docs").join(linked, "id", "left").withColumn("root", F.coalesce("root", "id")))
    groups = rooted.groupBy("root").agg(F.min("head").alias("head"), F.sum("docs").alias("size"))
    named = rooted.select("root", "fp").join(groups, "root").select("fp", "head", "size")
    own = F.coalesce("head", who)
    return fps.join(named, "fp", "left").select("doc_id", "th", "n", own["doc_id"].alias("group_id"), F.coalesce("size", F.lit(1)).alias("group_size"), F.coalesce(who == F.col("head"), F.lit(True)).alias("kept"))


def near_duplicate_groups(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, group_id, group_size, kept) for every distinct (doc_id, text): groups are the components of pairs within `limit` bits.

    group_id is the group's least doc_id, and that document is kept; a row without doc_id only where no other is in the group, whose
    group_id is then null. Equal prints are one node, so thousands of exact copies make no pairs. A null or wordless text is a
    group of its own. Equal rows count as one; one doc_id with different texts gives a row for each of them. Other columns are
    never read. An empty table gives an empty result.
    """
    return _grouped(docs, limit).select("doc_id", "group_id", "group_size", "kept")


def drop_near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The documents without those that near_duplicate_groups doesn't keep; of equal rows (doc_id and text) one stays, but all of them where the text is null.

    Only rows that may go are shuffled; columns of any name stay.
    """
    touched = cut(_grouped(docs, limit).where("not kept or n > 1").select(F.col("doc_id").alias("__of"), F.col("th").alias("__of_th"), "kept"))
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").isNull().alias("blank"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # a row has its text once
    some, others = held(d, F.col("th"), touched, F.col("__of_th"))
    met = some.join(touched, F.expr("doc_id <=> __of and th = __of_th"), "left")
    free = met.where("kept is null or blank").select("row")
    plain = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    once = met.where("kept and not blank").groupBy("doc_id", "th").agg(F.min_by("row", F.xxhash64(*(F.col(f"row.`{c}`") for c in plain))).alias("row")).select("row")
    return others.select("row").union(free).union(once).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
