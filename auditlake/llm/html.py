"""Operator 9: HTML extraction with removal of site templates, found as element subtrees that recur across a host's pages."""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import cut, per_doc

LEAST_PAGES, LEAST_SHARE, MANY_PAGES, SHORT, SHORT_SHARE, BROADCAST_ROWS = 5, 0.005, 50, 12, 0.05, 1_000_000
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PLAIN = re.compile(r"[^>\"'=]*")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg".split())
BLOCK = frozenset("address article aside blockquote body br center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - {"br", "option", "td", "th", "title", "body", "html", "head"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
NEVER_REMOVED = frozenset(("html", "body"))
MARKUP = frozenset("a button form img input nav script select style svg iframe".split())
SPACE = re.compile(r"[ \t\r\f\v]+")
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "attrs", "parts", "hash", "size", "linked")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs, self.parts, self.hash, self.size, self.linked = tag, attrs, [], 0, 0, False


def _tag_end(html: str, pos: int, last: dict[str, int]) -> tuple[int, int]:
    """(end of the attributes, place after the tag) of a tag whose attributes begin at pos. A quote counts after an equals sign, and where it is closed later on: else the tag ends
    at the next >. Every character is looked at once."""
    n = len(html)
    while pos < n:
        pos = PLAIN.match(html, pos).end()
        if pos >= n:
            break
        c = html[pos]
        if c == ">":
            return pos, pos + 1
        if c == "=":
            at = pos + 1
            while at < n and html[at].isspace():
                at += 1
            if at < n and html[at] in "\"'" and last[html[at]] > at:
                at = html.index(html[at], at + 1) + 1
            pos = at if at > pos + 1 else pos + 1
        else:
            pos += 1
    return n, n


def _until(html: str, mark: str, pos: int) -> int:
    """The place after the next mark, or the end."""
    at = html.find(mark, pos)
    return len(html) if at < 0 else at + len(mark)


def parse(html: str) -> Node:
    """The element tree, in one pass; unclosed elements end with their parent, li, td and the like with the next of their kind, p before any block."""
    root = Node("", "")
    stack, pos, n = [root], 0, len(html)
    open_: dict[str, int] = {}
    last = {q: html.rfind(q) for q in "\"'"}

    def close(i: int) -> None:
        for x in stack[i:]:
            open_[x.tag] -= 1
        del stack[i:]

    while pos < n:
        at = html.find("<", pos)
        if at < 0:
            stack[-1].parts.append(html[pos:])
            break
        if at > pos:
            stack[-1].parts.append(html[pos:at])
        if html.startswith("<!--", at):
            pos = _until(html, "-->", at + 4)
            continue
        if html.startswith("<![CDATA[", at):
            pos = _until(html, "]]>", at + 9)
            continue
        if html[at + 1 : at + 2] in ("!", "?"):
            pos = _until(html, ">", at + 2)
            continue
        closing = html[at + 1 : at + 2] == "/"
        name = NAME.match(html, at + 1 + closing)
        if not name:
            stack[-1].parts.append("<")
            pos = at + 1
            continue
        tag = name.group().lower()
        end, pos = _tag_end(html, name.end(), last)
        if closing:
            if open_.get(tag):
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            continue
        if tag in CLOSES_P and open_.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in SIBLINGS and any(open_.get(t) for t in SIBLINGS[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SIBLINGS[tag]:
                    close(i)
                    break
                if stack[i].tag in SCOPE[tag]:
                    break
        node = Node(tag, html[name.end() : end].strip())
        stack[-1].parts.append(node)
        if tag in RAW:
            stop = _ENDS[tag].search(html, pos)
            node.parts.append(html[pos : stop.start() if stop else n])
            pos = stop.end() if stop else n
        elif tag not in VOID and not node.attrs.endswith("/"):
            stack.append(node)
            open_[tag] = open_.get(tag, 0) + 1
    return root


def subtrees(root: Node) -> list[Node]:
    """All elements, each after its descendants, with the hash of tag, attributes, text and children; without recursion."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in x.parts if type(c) is Node]
    order.reverse()
    for x in order:
        inner = [f"<{x.tag} {' '.join(sorted(x.attrs.split()))}>"]
        inner += [f"\0{c.hash:x}\0" if type(c) is Node else " ".join(c.split()) for c in x.parts]
        x.size = sum(c.size if type(c) is Node else len(c.strip()) for c in x.parts)
        x.linked = x.tag in MARKUP or any(c.linked for c in x.parts if type(c) is Node)
        x.hash = xxhash.xxh3_64_intdigest("\1".join(inner).encode("utf-8", "surrogatepass"))
    return order


def removable(order: list[Node]) -> dict[int, bool]:
    """Hashes of the subtrees that can be a template: elements that hold anything, but for html and body. True for those of a few letters without any link or control, as a cell's "yes"."""
    return {x.hash: x.size < SHORT and not x.linked for x in order if x.tag and x.tag not in NEVER_REMOVED and x.parts}


def text_of(root: Node, gone: set[int]) -> tuple[str, int]:
    """(visible text without the removed subtrees, their number); a line for each block."""
    out: list[str] = []
    removed = 0
    todo: list = [root]
    while todo:
        x = todo.pop()
        if type(x) is str:
            out.append(x)
        elif x.hash in gone and x.tag not in NEVER_REMOVED and x.parts:
            removed += 1
        elif x.tag not in RAW:
            if x.tag in BLOCK:
                out.append("\n")
                todo.append("\n")
            todo += [c if type(c) is Node else unescape(c).replace("\n", " ") for c in reversed(x.parts)]
    lines = (SPACE.sub(" ", s).strip() for s in "".join(out).split("\n"))
    return "\n".join(s for s in lines if s), removed


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def with_host(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "html", F.lower(F.expr("try_parse_url(url, 'HOST')")).alias("host"))


def _hashes(keyed: DataFrame, key: str) -> DataFrame:
    """(key, hash, short) of each page's removable subtrees."""

    def run(batches):
        for b in batches:
            keys, hashes, short = [], [], []
            for k, html in zip(b[key], b["html"]):
                got = removable(subtrees(parse(html))) if html else {}
                hashes += [_signed(h) for h in got]
                short += got.values()
                keys += [k] * len(got)
            yield pd.DataFrame({key: np.array(keys, object), "hash": np.array(hashes, np.int64), "short": np.array(short, bool)})

    return keyed.select(key, "html").mapInPandas(run, f"{key} {dict(keyed.dtypes)[key]}, hash long, short boolean")


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, hash, pages): the subtrees that recur across a host. Pages without a host have none.

    Five pages are enough, and on larger hosts 0.5 % of them, but never more than 50: what recurs on so many is a template on a host of any size. Of a few letters without a link, as
    a cell of a table, only what 5 % of the pages have is one.
    """
    hosted = with_host(pages).where("host is not null")
    totals = hosted.groupBy("host").agg(F.count("*").alias("all_pages"))
    counts = _hashes(hosted, "host").groupBy("host", "hash").agg(F.count("*").alias("pages"), F.bool_and("short").alias("short")).where(F.col("pages") >= least_pages)
    many = F.least(least_share * F.col("all_pages"), F.lit(MANY_PAGES))
    return counts.join(totals, "host").where((F.col("pages") >= many) & (~F.col("short") | (F.col("pages") >= SHORT_SHARE * F.col("all_pages")))).select("host", "hash", "pages")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, host, text, removed) of every page: its visible text without the host's templates, and how many subtrees went.

    The templates' number is counted first: up to `broadcast_rows` of them are sent to all tasks, host by host; beyond that each page's own subtrees meet
    them by (host, hash), and come back to the page: a page is never sent with more than it holds.
    Null html gives null text, empty html empty text; a page without a host loses nothing; repeated rows give a row each and
    count as pages; rows without page_id too. Scripts, styles and comments aren't text; a quote that is never closed ends at its tag's end. Other columns are never
    read. An empty table gives an empty result.
    """
    found = cut(templates(pages, least_pages, least_share))
    if found.count() <= broadcast_rows:
        per = found.groupBy("host").agg(F.collect_list("hash").alias("gone"))
        joined = with_host(pages).join(F.broadcast(per), "host", "left").select("page_id", "host", "html", "gone")
    else:
        # pages of equal host and html lose the same, so their hash names them
        keyed = with_host(pages).withColumn("page_key", F.xxhash64("host", "html"))
        own = keyed.where("host is not null and html is not null")
        hosts = own.select("page_key", "host").distinct()
        met = _hashes(own.dropDuplicates(["page_key"]), "page_key").join(hosts, "page_key").join(found.select("host", "hash"), ["host", "hash"], "left_semi")
        per = met.groupBy("page_key").agg(F.collect_set("hash").alias("gone"))
        joined = keyed.join(per, "page_key", "left").select("page_id", "host", "html", "gone")

    def run(batches):
        held: tuple = (None, set())
        for b in batches:
            rows = []
            for page, host, html, gone in zip(b.page_id, b.host, b.html, b.gone):
                if html is None:
                    rows.append((page, host, None, 0))
                    continue
                root = parse(html)
                order = subtrees(root)
                if gone is None:
                    lost = set()
                else:
                    own = removable(order)
                    if held[0] is not gone:
                        held = (gone, np.sort(np.asarray(gone, np.int64)))
                    mine = np.array([_signed(h) for h in own], np.int64)
                    at = np.minimum(np.searchsorted(held[1], mine), len(held[1]) - 1)
                    lost = {h for h, yes in zip(own, held[1][at] == mine) if yes} if len(mine) else set()
                rows.append((page, host, *text_of(root, lost)))
            out = pd.DataFrame(rows, columns=["page_id", "host", "text", "removed"])
            out["page_id"] = out["page_id"].astype("Int64")
            yield out

    return joined.mapInPandas(run, "page_id long, host string, text string, removed long")
