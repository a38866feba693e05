"""Operator 7: quality rules on repetition, by suffix arrays and longest-common-prefix intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import WordHashes, per_doc, tidy

LEAST, MOST_COVERED, MOST_LONG = 5, 0.3, 50
SCHEMA = "doc_id long, n_words long, covered_fraction double, longest_repeat long, n_repeats long, kept boolean"


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sa, lcp) of a sequence of integers, by prefix doubling; lcp[i] is that of sa[i] and sa[i + 1].

    The order of symbols is that of the integers. The ranks of every round are kept, and give the
    common prefixes from the longest power of two downwards.
    """
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    levels, k = [rank.astype(np.int32)], 1
    while rank.max() < n - 1:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        levels.append(rank.astype(np.int32))
        k *= 2
    sa = np.argsort(rank)
    i, j = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        r, step = levels[level], 1 << level
        inside = np.maximum(i, j) < n
        same = inside.copy()
        same[inside] = r[i[inside]] == r[j[inside]]
        lcp += same * step
        i += same * step
        j += same * step
    return sa, lcp


def maximal_repeats(ids: np.ndarray, sa: np.ndarray, lcp: np.ndarray, least: int) -> int:
    """Repeated substrings of at least `least` symbols that can be extended neither left nor right: LCP intervals whose left symbols differ."""
    n, count = len(sa), 0
    left = np.where(sa > 0, ids[np.maximum(sa, 1) - 1].astype(np.int64), -1).tolist()
    first = (sa == 0).tolist()
    mixed = object()
    stack: list[list] = []  # [lcp, the left symbol that all suffixes so far share, or mixed]
    values = lcp.tolist() + [0]

    def join(a, b):
        return a if a == b and a is not mixed else mixed

    for i in range(n):
        own = mixed if first[i] else left[i]
        here, carry = values[i], own
        while stack and stack[-1][0] > here:
            depth, seen = stack.pop()
            carry = join(seen, carry)
            count += depth >= least and carry is mixed
        if here >= least:
            if stack and stack[-1][0] == here:
                stack[-1][1] = join(stack[-1][1], carry)
            else:
                stack.append([here, carry])
        elif stack:
            stack[-1][1] = join(stack[-1][1], carry)
    return count


def repetition(ids: np.ndarray, least: int = LEAST) -> tuple[float, int, int]:
    """(fraction of symbols inside repeated substrings of at least `least`, longest repeat, number of maximal repeats)."""
    n = len(ids)
    if n <= least:
        return 0.0, 0, 0
    sa, lcp = suffix_array(ids)
    longest = int(lcp.max())
    if longest < least:
        return 0.0, longest, 0
    at = np.zeros(n, np.int64)
    at[:-1] = lcp
    at[1:] = np.maximum(at[1:], lcp)
    hit = at >= least
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, sa[hit], 1)
    np.add.at(edge, sa[hit] + at[hit], -1)
    return float((np.cumsum(edge)[:n] > 0).sum()) / n, longest, maximal_repeats(ids.view(np.int64), sa, lcp, least)


def quality_rules(docs: DataFrame, least: int = LEAST, most_covered: float = MOST_COVERED, most_long: int = MOST_LONG) -> DataFrame:
    """(doc_id, n_words, covered_fraction, longest_repeat, n_repeats, kept) for every row of docs.

    Words are runs between white space. A document is kept if at most `most_covered` of its words lie in
    substrings of `least` words or more that occur twice in it, and none of these is longer than
    `most_long` words. A null or empty text has no words, no repeats and is kept; one of up to `least` words
    too, with 0 as its longest repeat. Repeated rows, and rows without doc_id, give a row each. Other
    columns are never read. An empty table gives an empty result.
    """

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            rows = []
            for text in b.text:
                ids = hashes((text or "").split())
                covered, longest, n = repetition(ids, least)
                rows.append((len(ids), covered, longest, n, covered <= most_covered and longest <= most_long))
            out = pd.DataFrame(rows, columns=["n_words", "covered_fraction", "longest_repeat", "n_repeats", "kept"])
            out.insert(0, "doc_id", b.doc_id.to_numpy())
            yield out

    return per_doc(docs, run, SCHEMA, "doc_id", "text")


def keep_by_rules(docs: DataFrame, **rules) -> DataFrame:
    """The documents that quality_rules keeps, decided row by row without a join; all columns stay as they are."""
    least, covered, longest = (rules.get(k, d) for k, d in (("least", LEAST), ("most_covered", MOST_COVERED), ("most_long", MOST_LONG)))

    def each(batches):
        hashes = WordHashes()
        for texts in batches:
            out = []
            for text in texts:
                c, n, _ = repetition(hashes((text or "").split()), least)
                out.append(c <= covered and n <= longest)
            yield pd.Series(out, dtype=bool)

    @F.pandas_udf("boolean")
    def kept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(each)(batches)

    return docs.where(kept("text"))
