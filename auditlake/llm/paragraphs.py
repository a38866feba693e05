"""Operator 4: substring dedup of paragraphs, by MinHash banding, exact Jaccard and components.

A passage that two otherwise different paragraphs share leaves their Jaccard similarity low. Such passages are found by winnowing:
of every 31 runs of 20 words in a row of a document, that of least hash is marked, so any 50 words that two documents have in common
hold a mark that both have, wherever they and their line breaks stand. Around the marks that recur, every run of 50 words is compared: the words of those
that occur earlier are the passage, whole to its ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from auditlake.llm.common import WORD, Identity, WordHashes, components, cut, held, mix, per_doc, shingle_hashes, tidy, words

LEAST_WORDS, SHINGLE, BANDS, ROWS, JACCARD, CHUNK_WORDS = 20, 3, 12, 4, 0.7, 100_000
RUN, WINDOW = 20, 31
PASSAGE = RUN + WINDOW - 1  # a shared run of so many words, 50, holds a mark for certain
MARK = np.dtype([("at", "<u4"), ("line", "<u4"), ("upto", "<u4"), ("run", "<u8")])
PART = np.dtype([("line", "<u4"), ("first", "<u4"), ("words", "<u4")])
KEY_BITS, FRAME_RUNS = 40, 20_000


def recall(jaccard: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """The chance that two paragraphs of this Jaccard similarity share a band."""
    return 1 - (1 - jaccard**rows) ** bands


def _lines(text: str | None) -> list[tuple[int, list[str]]]:
    return [(i, w) for i, p in enumerate((text or "").split("\n")) if (w := words(p))]


def _shingles(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of paragraphs laid end to end, one at each word, and which of them lie within one paragraph."""
    padded = np.concatenate([h, np.zeros(SHINGLE - 1, np.uint64)])
    inside = np.ones(len(h), bool)
    ends = np.append(starts[1:], len(h))
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    return shingle_hashes(padded, SHINGLE), inside


def _names(h: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums that name each paragraph's sequence of words."""
    at = (np.arange(len(h)) - np.repeat(starts, lengths)).astype(np.uint64)
    return [np.add.reduceat(mix((h + np.uint64(s)) * mix(at + np.uint64(1 + s))), starts) for s in (1, 2)]


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words in order, by doubling."""
    m = len(h) - n + 1
    out, at, power, by = None, 0, h, 1
    while True:
        if n & by:
            out = power[:m] if out is None else mix(out * np.uint64(0x9E3779B97F4A7C15) + power[at : at + m])
            at += by
        if 2 * by > n:
            return out
        power = mix(power[:-by] * np.uint64(0x9E3779B97F4A7C15) + power[by:])
        by *= 2


def _marks(h: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the winnowed runs of RUN words, each within a document; of equal runs in a window the first."""
    n = len(h)
    if n < RUN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)

    run = _runs(h, RUN)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    order = ((run >> bits) << bits) | np.arange(len(run), dtype=np.uint64)
    inside = np.arange(len(run)) - np.repeat(starts, lengths)[: len(run)] <= np.repeat(lengths, lengths)[: len(run)] - RUN
    order[~inside] = np.iinfo(np.uint64).max
    order = np.concatenate([order, np.full(WINDOW - 1, np.iinfo(np.uint64).max, np.uint64)])
    least = order
    for by in (1, 2, 4, 8):
        least = np.minimum(least[:-by], least[by:])
    least = np.minimum(least[: len(run)], least[WINDOW - 16 : WINDOW - 16 + len(run)])
    at = np.unique(least)
    at = np.sort(at[at != np.iinfo(np.uint64).max] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return at, run[at]


def paragraph_signatures(docs: DataFrame, least: int = LEAST_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, para, p1, p2, bands, marks): a row for each paragraph of `least` words or more; p1 and p2 name its words, bands holds 5 bytes a band. And a row of para -1 for each document with marks: place in the document, lines of first and last word, hash.

    Forty bits a band are enough: a chance collision, one for 10^12 paragraphs, only adds a pair that is then verified.
    """
    least = max(least, SHINGLE)
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    power = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)

    def signed(ids: list, of: list, line: list, count: list, toks: list, hashes: WordHashes) -> pd.DataFrame:
        every, of, line, count = hashes(toks), np.array(of, np.int64), np.array(line, np.int64), np.array(count, np.int64)
        long_ = count >= least
        h, lengths = every[np.repeat(long_, count)], count[long_]
        starts = np.cumsum(lengths) - lengths
        paras = pd.DataFrame({"doc_id": [], "para": [], "p1": [], "p2": [], "bands": []})
        if len(h):
            sh, inside = _shingles(h, starts)
            p1, p2 = _names(h, starts, lengths)
            keys = np.zeros((len(lengths), bands), np.uint64)
            none = np.uint64(0xFFFFFFFF)
            for b in range(bands):
                for r in range(rows):
                    v = ((sh ^ seeds[b * rows + r]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                    v[~inside] = none
                    keys[:, b] += np.minimum.reduceat(v, starts) * power[r]
            raw = mix(keys).view(np.uint8).reshape(len(lengths), bands, 8)[:, :, :5].reshape(len(lengths), -1)
            paras = pd.DataFrame({"doc_id": [ids[i] for i in of[long_]], "para": line[long_], "p1": p1.view(np.int64), "p2": p2.view(np.int64), "bands": [r.tobytes() for r in np.ascontiguousarray(raw)]})
        first = np.cumsum(count) - count
        each = np.bincount(of, count, len(ids)).astype(np.int64)
        at, run = _marks(every, np.cumsum(each) - each, each)
        begin = np.searchsorted(first, at, "right") - 1
        both = np.zeros(len(at), MARK)
        both["at"], both["line"], both["upto"], both["run"] = at - first[np.searchsorted(of, of[begin])], line[begin], line[np.searchsorted(first, at + RUN - 1, "right") - 1], run
        cuts = np.searchsorted(of[begin], np.arange(len(ids) + 1))
        marked = [i for i in range(len(ids)) if cuts[i] < cuts[i + 1]]
        marks = pd.DataFrame({"doc_id": [ids[i] for i in marked], "para": -1, "marks": [both[cuts[i] : cuts[i + 1]].tobytes() for i in marked]})
        out = pd.concat([paras.assign(marks=None), marks.assign(p1=0, p2=0, bands=None)], ignore_index=True)
        return out.astype({"doc_id": "int64", "para": "int32", "p1": "int64", "p2": "int64"})[["doc_id", "para", "p1", "p2", "bands", "marks"]]

    def run(batches):
        hashes = WordHashes()
        ids, of, line, count, toks = [], [], [], [], []
        for b in batches:
            for doc, text in zip(b.doc_id, b.text):
                for i, w in _lines(text):
                    of.append(len(ids))
                    line.append(i)
                    count.append(len(w))
                    toks += w
                ids.append(doc)
                if len(toks) >= CHUNK_WORDS:
                    yield signed(ids, of, line, count, toks, hashes)
                    ids, of, line, count, toks = [], [], [], [], []
        if toks:
            yield signed(ids, of, line, count, toks, hashes)

    return per_doc(docs.where("doc_id is not null and text is not null"), run, "doc_id long, para int, p1 long, p2 long, bands binary, marks binary", "doc_id", "text")


def _texts(docs: DataFrame, per: DataFrame) -> DataFrame:
    """The texts of the documents of `per`, with its columns; most others go by a filter of fixed size, before the shuffle."""
    some, _ = held(docs.select("doc_id", "text").where("text is not null"), F.col("doc_id"), per, F.col("doc_id"))
    return some.join(per, "doc_id")


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, sh): the shingles of the wanted (id, doc_id, para); the text of no other document is shuffled to them."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            ids, sets = [], []
            for text, want in zip(b.text, b.want):
                lines = (text or "").split("\n")
                for w in want:
                    if w["para"] < len(lines):
                        ids.append(w["id"])
                        sets.append(np.unique(shingle_hashes(hashes(words(lines[w["para"]])), SHINGLE)).view(np.int64))
            yield pd.DataFrame({"id": np.array(ids, np.int64), "sh": sets})

    per = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("para", "id")).alias("want"))
    return _texts(docs, cut(per)).select("text", "want").mapInPandas(tidy(run), "id long, sh array<long>").dropDuplicates(["id"])


def repeated_paragraphs(docs: DataFrame, least: int = LEAST_WORDS, jaccard: float = JACCARD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, para, first, words, cluster_doc, cluster_para, kept): every paragraph that has a copy or near copy anywhere, and every passage.

    A paragraph is a line of at least `least` words; words are lower-case, without punctuation. Clusters are
    components of equal paragraphs and of pairs whose sets of 3-word shingles have at least the given Jaccard
    similarity, found by bands (recall 0.96 at 0.7, 0.99 at 0.76) and verified exactly. The cluster's first
    paragraph by (doc_id, para) names it and is kept; words is null. Of the lines that stay, every word in a run of 50 words that occurs
    earlier too, in another document or from another line on, is in the row of a passage, whatever line breaks and short lines
    the run goes over: `words` words of the line from word `first` on, and the line where its first run begins for the first time; these aren't kept. A null text has no paragraphs; equal rows count once. Rows without doc_id, and those that share one
    with another text, are documents of their own, which come after all others. Other columns are never read. An empty table gives an empty result.

    Pairs are verified in two steps, with the same components as if all were: first each paragraph with the least of those it
    shares a band with; then only the pairs that these edges have not joined yet. So thousands of near copies make
    about as many pairs as there are copies.
    """
    who = Identity(docs)
    return who.back(_repeated(who.add(docs.select("doc_id", "text"), "id").select(F.col("id").alias("doc_id"), "text"), least, jaccard, bands, rows), "doc_id", "cluster_doc")


def _repeated(docs: DataFrame, least: int, jaccard: float, bands: int, rows: int) -> DataFrame:
    all_ = cut(paragraph_signatures(docs, least, bands, rows))
    place = F.struct("doc_id", "para")
    paras = all_.where("para >= 0")
    distinct = cut(paras.groupBy("p1", "p2").agg(F.min(F.struct("doc_id", "para", "bands")).alias("at")).select(F.monotonically_increasing_id().alias("id"), "p1", "p2", "at.*"))
    key = lambda i: F.conv(F.hex(F.substring("bands", 5 * i + 1, 5)), 16, 10).cast("long") + F.lit(i << KEY_BITS)
    keyed = distinct.select("id", F.explode(F.array(*[key(i) for i in range(bands)])).alias("key"))
    hubs = cut(keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub"))
    shared = cut(held(keyed, F.col("key"), hubs, F.col("key"))[0].join(hubs, "key").select("key", "id", "hub"))
    wanted = distinct.join(shared.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "para")
    sets = cut(_shingle_sets(docs, wanted))
    both = F.size(F.array_intersect("x.sh", "y.sh"))

    def verified(pairs: DataFrame) -> DataFrame:
        return pairs.join(sets.alias("x"), F.expr("a = x.id")).join(sets.alias("y"), F.expr("b = y.id")).where(both >= jaccard * (F.size("x.sh") + F.size("y.sh") - both)).select("a", "b")

    first = cut(verified(shared.where("hub < id").groupBy("id").agg(F.min("hub").alias("a")).select("a", F.col("id").alias("b"))))
    roots = cut(components(first))
    known = shared.select("key", "id").join(roots, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    left, right = known.alias("l"), known.alias("r")
    rest = left.join(right, F.expr("l.key = r.key and l.root < r.root")).select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
    more = cut(verified(rest))
    found = roots if more.isEmpty() else components(first.unionByName(more))
    named = paras.select("doc_id", "para", "p1", "p2").distinct().join(distinct.select("p1", "p2", "id"), ["p1", "p2"]).join(found, F.col("id") == F.col("node"), "left").select("doc_id", "para", "id", F.coalesce("root", "id").alias("root"))
    clusters = named.groupBy("root").agg(F.min(place).alias("head"), F.count("*").alias("n"))
    placed = cut(named.join(clusters, "root").select("doc_id", "para", "id", "head", "n", F.expr("doc_id = head.doc_id and para = head.para").alias("kept")))
    whole = placed.where("n > 1").select("doc_id", "para", F.lit(0).alias("first"), F.lit(None).cast("int").alias("words"), F.col("head.doc_id").alias("cluster_doc"), F.col("head.para").alias("cluster_para"), "kept")
    return whole.unionByName(_passages(docs, all_.where("para < 0").select("doc_id", "marks"), placed.where("not kept").select("doc_id", "para")))


def _lasting(batches):
    """(doc_id, at, run) of the marks that touch no line of `gone`."""
    for b in batches:
        ids, out = [], []
        for doc, raw, gone in zip(b.doc_id, b.marks, b.gone):
            m = np.frombuffer(raw, MARK)
            if gone is not None:
                g = np.sort(np.asarray(gone, np.int64))
                m = m[np.searchsorted(g, m["line"]) == np.searchsorted(g, m["upto"], "right")]
            ids.append(np.full(len(m), doc, np.int64))
            out.append(m)
        m = np.concatenate(out) if out else np.zeros(0, MARK)
        yield pd.DataFrame({"doc_id": np.concatenate(ids) if ids else np.zeros(0, np.int64), "at": m["at"].astype(np.int32), "run": m["run"].astype(np.int64)})


def _parts(at: np.ndarray, i: np.ndarray, j: np.ndarray, number: np.ndarray, start: np.ndarray, count: np.ndarray) -> list:
    """Which words of each line the runs from words `at` on hold, from line i to line j, all runs at once; None for a run within one line."""
    parts: list = [None] * len(at)
    k = np.flatnonzero(i != j)
    if len(k):
        n = j[k] - i[k] + 1
        ends = np.cumsum(n)
        begins = ends - n
        of = np.arange(ends[-1]) + np.repeat(i[k] - begins, n)
        p = np.zeros(len(of), PART)
        p["line"], p["words"] = number[of], count[of]
        p["first"][begins] = at[k] - start[i[k]]
        p["words"][begins] -= p["first"][begins]
        p["words"][ends - 1] = at[k] + PASSAGE - start[j[k]]
        raw = p.tobytes()
        for x, lo, hi in zip(k.tolist(), (begins * PART.itemsize).tolist(), (ends * PART.itemsize).tolist()):
            parts[x] = raw[lo:hi]
    return parts


def _around(batches):
    """(doc_id, at, line, first, r1, r2, parts): the runs of PASSAGE words that hold a mark of `marks` and touch no line of `gone`; parts, where they lie in several lines, says which words of each."""
    hashes = WordHashes()
    names = ["doc_id", "at", "line", "first", "r1", "r2"]
    found: list[list] = []
    parts: list = []

    def frame() -> pd.DataFrame:
        out = pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*found)))) | {"parts": pd.Series(parts, dtype=object)})
        found.clear()
        parts.clear()
        return out

    for b in batches:
        for doc, text, marks, gone in zip(b.doc_id, b.text, b.marks, b.gone):
            lines = _lines(text)
            count = np.array([len(w) for _, w in lines], np.int64)
            n = int(count.sum())
            if n < PASSAGE:
                continue
            h = hashes([x for _, w in lines for x in w])
            number, start = np.array([i for i, _ in lines], np.int64), np.cumsum(count) - count
            edges = np.zeros(n + 1, np.int64)
            marks = np.asarray(marks, np.int64)
            np.add.at(edges, np.maximum(marks - (PASSAGE - RUN), 0), 1)
            np.add.at(edges, np.minimum(marks + 1, n), -1)
            lost = np.append(0, np.cumsum(np.repeat(np.isin(number, [] if gone is None else list(gone)), count)))
            at = np.flatnonzero(np.cumsum(edges)[: n - PASSAGE + 1] > 0)
            at = at[lost[at] == lost[at + PASSAGE]]
            if len(at):
                i, j = np.searchsorted(start, at, "right") - 1, np.searchsorted(start, at + PASSAGE - 1, "right") - 1
                r1, r2 = _runs(h, PASSAGE)[at], _runs(mix(h ^ np.uint64(0xD1342543DE82EF95)), PASSAGE)[at]
                found.append([np.full(len(at), doc, np.int64), at, number[i], at - start[i], r1.view(np.int64), r2.view(np.int64)])
                parts += _parts(at, i, j, number, start, count)
                if len(parts) >= FRAME_RUNS:
                    yield frame()
    if found:
        yield frame()


def _parted(batches):
    """Each run's words by line."""
    for b in batches:
        several = b.parts.notna().to_numpy()
        split = b.parts[several]
        n = np.ones(len(b), np.int64)
        n[several] = [len(p) // PART.itemsize for p in split]
        flat = np.zeros(int(n.sum()), PART)
        many = np.repeat(several, n)
        flat[many] = np.frombuffer(b"".join(split), PART)
        one = b[~several]
        flat["line"][~many], flat["first"][~many], flat["words"][~many] = one.line, one["first"], PASSAGE
        yield pd.DataFrame({c: np.repeat(b[c].to_numpy(), n) for c in ("doc_id", "at", "head_doc", "head_line")} | {"para": flat["line"], "first": flat["first"], "words": flat["words"]}).astype({"para": "int32", "first": "int32", "words": "int32"})


def _passages(docs: DataFrame, marks: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows for the words of runs of PASSAGE words that occur earlier in lines that stay, too; marks say where such runs can be."""
    gone = cut(dropped.groupBy("doc_id").agg(F.collect_list("para").alias("gone")))
    some, others = held(marks, F.col("doc_id"), gone, F.col("doc_id"))  # marks of most documents need no shuffle
    lasting = some.join(gone, "doc_id", "left").unionByName(others, allowMissingColumns=True).mapInPandas(_lasting, "doc_id long, at int, run long")
    place = F.struct("doc_id", "at")
    again = cut(lasting.groupBy("run").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo < hi").select("run"))
    shared = held(lasting, F.col("run"), again, F.col("run"))[0].join(again, "run", "left_semi").groupBy("doc_id").agg(F.collect_set("at").alias("marks"))
    wanted = cut(shared.join(gone, "doc_id", "left"))
    around = _texts(docs, wanted).mapInPandas(tidy(_around), "doc_id long, at int, line int, first int, r1 long, r2 long, parts binary")
    around = cut(around)
    heads = around.join(around.groupBy("r1", "r2").agg(F.min(F.struct("doc_id", "at", "line")).alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"), ["r1", "r2"])
    again = heads.where(f"doc_id != head.doc_id or line != head.line and at >= head.at + {PASSAGE}")
    pieces = again.select("doc_id", "at", "line", "first", "parts", F.col("head.doc_id").alias("head_doc"), F.col("head.line").alias("head_line")).mapInPandas(_parted, "doc_id long, at int, head_doc long, head_line int, para int, first int, words int")
    line = W.partitionBy("doc_id", "para").orderBy("first", "at")
    fresh = (F.col("first") > F.coalesce(F.max(F.col("first") + F.col("words")).over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    islands = pieces.withColumn("new", fresh).withColumn("island", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    spans = islands.groupBy("doc_id", "para", "island").agg(F.min("first").alias("begin"), F.max(F.col("first") + F.col("words")).alias("end"), F.min(F.struct("at", "head_doc", "head_line")).alias("of"))
    return spans.select("doc_id", "para", F.col("begin").alias("first"), (F.col("end") - F.col("begin")).alias("words"), F.col("of.head_doc").alias("cluster_doc"), F.col("of.head_line").alias("cluster_para"), F.lit(False).alias("kept"))


def _spans(line: str) -> list[tuple[int, int]]:
    """Where each of words(line) stands; a letter whose lower case is longer can make two words of one."""
    low = line.lower()
    found = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(line):
        return found
    back = [i for i, c in enumerate(line) for _ in c.lower()]
    return [(back[a], back[b - 1] + 1) for a, b in found]


@F.pandas_udf(StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the given lines and words of lines; null where none are given."""
    out = []
    for text, parts in zip(texts, gone):
        if parts is None:
            out.append(None)
            continue
        lines: list = text.split("\n")
        for p in sorted(parts, key=lambda p: (p["para"], -p["first"])):
            i = p["para"]
            if i >= len(lines) or lines[i] is None:
                continue
            if p["words"] is None or p["words"] != p["words"]:
                lines[i] = None
                continue
            at = _spans(lines[i])[int(p["first"]) : int(p["first"] + p["words"])]
            if at:
                lines[i] = lines[i][: at[0][0]] + lines[i][at[-1][1] :]
        out.append("\n".join(x for x in lines if x is not None))
    return pd.Series(out, dtype=object)


_without = _without.asNondeterministic()


def drop_repeated_paragraphs(docs: DataFrame, least: int = LEAST_WORDS, jaccard: float = JACCARD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The documents without the paragraphs and passages that repeated_paragraphs doesn't keep; n_chars, where there is one, follows the text.

    A document of which nothing but white space is left goes; one that lost nothing stays as it is. Equal rows
    lose the same lines. Columns of any name stay. Only the documents that may lose something are shuffled.
    """
    who = Identity(docs)
    packed = who.add(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), "id").select("id", "text", "row")
    found = _repeated(packed.select(F.col("id").alias("doc_id"), "text"), least, jaccard, bands, rows)
    gone = cut(found.where("not kept").groupBy("doc_id").agg(F.collect_list(F.struct("para", "first", "words")).alias("gone")).select(F.col("doc_id").alias("of"), "gone"))
    some, others = held(packed.select("id", "row"), F.col("id"), gone, F.col("of"))  # a row has its text once
    joined = some.join(gone, F.expr("id = of and row.text is not null"), "left")
    # not deterministic by name only: else the filter would be pushed below, and the texts cut twice; one frame for all rows, so that texts are shuffled once
    met = joined.select("row", F.col("gone").isNotNull().alias("lost"), _without("row.text", "gone").alias("left")).where(~F.col("lost") | F.col("left").rlike(r"\S"))
    new = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("left").cast(docs.schema["n_chars"].dataType)
    old = {c: F.col(f"row.`{c}`") for c in docs.columns}
    after = [F.when(F.col("lost"), new[c]).otherwise(old[c]).alias(c) if c in new else old[c].alias(c) for c in docs.columns]
    return met.select(*after).union(others.select(*(old[c].alias(c) for c in docs.columns)))
