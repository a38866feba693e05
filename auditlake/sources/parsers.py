"""Parsers of stored bodies: search result pages, image results, profile answers, archive answers, web pages. Nothing here fetches anything."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import fields as N
from auditlake.functions import profiles as P
from auditlake.functions import text as T
from auditlake.functions import urls as U
from auditlake.operators.ordering import cap, keep_first

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("noscript script style svg template".split())
#: provider -> (blocks, links, snippets), as CSS selectors: the first link of a block is the hit, the snippets' texts its snippet.
RESULTS = {
    "duck": (".result, .results_links, .web-result", "h2 a[href], .result__a[href]", ".result-snippet, .result__snippet"),
    "bing": (".b_algo", "h2 a[href], h3 a[href]", ".b_caption p, .b_snippet, p"),
    "yandex": (".serp-item, .organic, .Organic", "h2 a[href], h3 a[href], .OrganicTitle-Link[href], a.Link[href], a.organic__url[href]", ".organic__text, .organic__content-wrapper, .OrganicTextContentSpan, .TextContainer, .serp-item__text, p"),
    "brave": (".result, .search-result, .snippet, article, [data-type=web]", ".snippet-title a[href], a.result-header[href], a[data-testid=result-header][href], h2 a[href], h3 a[href]", ".description, .snippet-content, .snippet-description, p"),
    "mojeek": (".result, .results li, .results-standard li, article", "a.title[href], h2 a[href], h3 a[href]", ".description, .s, .snippet, p"),
    "qwant": (".result, .web-result, article, [data-testid*=webResult]", "a[data-testid*=title][href], h2 a[href], h3 a[href], a[href]", ".description, .snippet, [data-testid*=description], p"),
}
ANY = (".result, .results_links, .search-result, .serp-item, .snippet, .web-result, .b_algo, div.g, .organic, .Organic, article", "a.title[href], .result__a[href], h2 a[href], h3 a[href], a[href]", ".b_caption p, .description, .organic__content-wrapper, .organic__text, .OrganicTextContentSpan, .result__snippet, .snippet, .VwiC3b, p")
MOST_HITS, MOST_IMAGES = 12, 18


class Element:
    """at and end: its own place and that of the last element below it, in the order of the page; set by the page's index."""

    __slots__ = ("tag", "attrs", "up", "parts", "at", "end", "index")

    def __init__(self, tag: str, attrs: dict, up: "Element | None"):
        self.tag, self.attrs, self.up, self.parts, self.index = tag, attrs, up, [], None

    def walk(self):
        """This element and all below it, in the order of the page; without recursion."""
        todo = [self]
        while todo:
            x = todo.pop()
            yield x
            todo += [c for c in reversed(x.parts) if isinstance(c, Element)]

    def text(self) -> str:
        out: list[str] = []
        todo: list = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in HIDDEN:
                out.append(" " if x.tag in ("br", "p", "div", "li", "td", "th", "tr", "h1", "h2", "h3", "h4", "section", "article", "body", "title") else "")
                todo += reversed(x.parts)
        return " ".join("".join(out).split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Element("", {}, None)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.parts.append(e)
        if tag not in VOID:
            self.here = e
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.here.parts.append(Element(tag, {k: v or "" for k, v in attrs}, self.here))

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        while self.here.tag != tag:
            self.open[self.here.tag] -= 1
            self.here = self.here.up
        self.open[tag] -= 1
        self.here = self.here.up

    def handle_data(self, data):
        self.here.parts.append(data)


_W = r"[\t\n\r\f ]"
_ATTR = rf"""{_W}+([a-zA-Z_:][-\w:.]*)=(?:"([^"&]*)"|'([^'&]*)')"""
_TOKEN = re.compile(rf"""([^<]+)|<([a-zA-Z][a-zA-Z0-9]*)((?:{_ATTR.replace("(", "(?:").replace("(?:?:", "(?:")})*){_W}*>|</([a-zA-Z][a-zA-Z0-9]*){_W}*>|<!(?i:doctype)[^>]*>""")
_ATTRS = re.compile(_ATTR)
#: Elements whose content is no markup: left to the library's parser.
RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())


def _plain_tree(html: str) -> Element | None:
    """The tree of a page that is all plain tags, quoted attributes without entities, and text, in one pass; None for any other page. It is the tree that the library's parser gives."""
    root = here = Element("", {}, None)
    open_: dict[str, int] = {}
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        if m is None:
            return None
        at = m.end()
        text, tag, attrs, shut = m.groups()
        if text is not None:
            here.parts.append(unescape(text) if "&" in text else text)
        elif tag is not None:
            tag = tag.lower()
            if tag in RAW:
                return None
            e = Element(tag, {k.lower(): a or b for k, a, b in _ATTRS.findall(attrs)} if attrs else {}, here)
            here.parts.append(e)
            if tag not in VOID:
                here = e
                open_[tag] = open_.get(tag, 0) + 1
        elif shut is not None and open_.get(shut := shut.lower()):
            while here.tag != shut:
                open_[here.tag] -= 1
                here = here.up
            open_[shut] -= 1
            here = here.up
    return root


def tree(html: str) -> Element:
    root = _plain_tree(html)
    if root is None:
        t = _Tree()
        t.feed(html)
        t.close()
        root = t.root
    return root


def _index(top: Element) -> dict:
    """(places, elements) of the page by tag, by .class and by [attribute, in the order of the page."""
    if top.index is None:
        every = list(top.walk())
        found: dict[str, list[Element]] = {"*": every}
        for i, e in enumerate(every):
            e.at = e.end = i
            found.setdefault(e.tag, []).append(e)
            for a, v in e.attrs.items():
                found.setdefault("[" + a, []).append(e)
                if a == "class":
                    for c in dict.fromkeys(v.split()):
                        found.setdefault("." + c, []).append(e)
        top.index = {k: ([e.at for e in v], v) for k, v in found.items()}
        for e in reversed(every):
            if e.up is not None and e.up.end < e.end:
                e.up.end = e.end
    return top.index


_STEP = re.compile(r"([a-z0-9]*)((?:\.[\w-]+|\[[\w-]+(?:\*?=[^\]]*)?\])*)$", re.I)


@lru_cache(maxsize=None)
def _step(step: str) -> tuple | None:
    """A selector's step as (tag, classes, (attribute, sign, value)...); None for what is no step."""
    m = _STEP.match(step)
    if not m:
        return None
    parts = re.findall(r"\.[\w-]+|\[[^\]]*\]", m.group(2))
    tests = tuple(re.match(r"\[([\w-]+)(\*?=)?([^\]]*)\]", x).groups() for x in parts if x[0] != ".")
    return m.group(1).lower(), tuple(x[1:] for x in parts if x[0] == "."), tests


def matches(e: Element, step: str) -> bool:
    s = _step(step)
    if s is None or (s[0] and e.tag != s[0]):
        return False
    if s[1]:
        have = e.attrs.get("class", "").split()
        if not all(c in have for c in s[1]):
            return False
    for k, sign, v in s[2]:
        have = e.attrs.get(k)
        if have is None or (sign == "=" and have != v) or (sign == "*=" and v not in have):
            return False
    return True


@lru_cache(maxsize=None)
def _selectors(text: str) -> tuple:
    """(key of the index, whether it asks for no more, steps) of each selector: the key is what its last step asks for first: .class, [attribute, or tag."""
    out = []
    for steps in (x.split() for x in text.split(",")):
        s = _step(steps[-1])
        if s is not None:
            key = "." + s[1][0] if s[1] else "[" + s[2][0][0] if s[2] else s[0] or "*"
            sure = (s[0] != "") + len(s[1]) + len(s[2]) < 2 and not any(sign for _, sign, _ in s[2])
            out.append((key, sure, tuple(steps)))
    return tuple(out)


def select(root: Element, selectors: str) -> list[Element]:
    """The elements below root that any of the selectors names, in the order of the page: tags, classes and attributes, and descendants of such."""
    top = root
    while top.up is not None:
        top = top.up
    index = _index(top)
    out = {}
    for key, sure, steps in _selectors(selectors):
        some = index.get(key)
        if some is None:
            continue
        places, some = some
        lo, hi = bisect_right(places, root.at), bisect_right(places, root.end)
        for e in some[lo:hi] if lo < hi else ():
            if e.at in out or not (sure or matches(e, steps[-1])):
                continue
            up, left = e.up, len(steps) - 1
            while left and up is not None:
                if matches(up, steps[left - 1]):
                    left -= 1
                up = up.up
            if not left:
                out[e.at] = e
    return [out[i] for i in sorted(out)]


def hits_of(source: str, html: str) -> list[tuple[str, str, str]]:
    """(href, title, snippet) of a result page's hits, by its provider's selectors, else by those common to all, else of all links with a text of four characters or more."""
    root = tree(html)
    name = next((k for k in RESULTS if k in source.lower()), None)
    for blocks, links, snippets in ([RESULTS[name]] if name else []) + [ANY]:
        out = []
        for b in select(root, blocks):
            a = next(iter(select(b, links)), None)
            if a is None:
                continue
            title = a.text() or " ".join(x.text() for x in select(b, "h2, h3"))
            said = " ".join(x.text() for x in select(b, snippets))
            if not said:
                whole = b.text()
                said = (whole[len(title) :] if whole.startswith(title) else whole).strip()
            out.append((a.attrs.get("href", ""), title, said))
        if out:
            return out
    return [(a.attrs["href"], a.text(), "") for a in select(root, "a[href]") if len(a.text()) >= 4]


def search_results(pages: DataFrame, most: int = MOST_HITS) -> DataFrame:
    """(page_id, ord, source, query, url, title, snippet) of result pages (page_id, source, query, html): hits with a usable URL, each once, `most` of a page. Blocked and empty pages have none."""

    def run(batches):
        for b in batches:
            rows = []
            for page, source, query, html in zip(b["page_id"], b["source"], b["query"], b["html"]):
                rows += [(page, i, source, query, *h) for i, h in enumerate(hits_of(source, html))]
            yield pd.DataFrame(rows, columns=["page_id", "ord", "source", "query", "href", "title", "snippet"])

    ok = pages.where(F.coalesce(F.trim("html") != "", F.lit(False)) & ~F.lower("html").rlike("|".join(T.CHALLENGES)))
    d = ok.select("page_id", "source", "query", "html").mapInPandas(run, "page_id long, ord long, source string, query string, href string, title string, snippet string")
    # a generated column: a condition on it stays above, where the URL is worked out already
    url = F.explode(F.array(F.substring_index(U.unwrap_redirect(F.col("href")), "#", 1))).alias("url")
    d = d.where("title != '' or snippet != ''").select("page_id", "ord", "source", "query", "title", "snippet", url).where(F.col("url").isNotNull() & ~P.noisy(F.col("url")))
    one = keep_first(d.withColumn("page", U.canonical_key(F.col("url"))), ["page_id", "page"], ["ord"])
    return cap(one, ["page_id"], ["ord"], most).select("page_id", "ord", "source", "query", "url", F.left(F.when(F.col("title") == "", "Untitled result").otherwise(F.col("title")), F.lit(160)).alias("title"), F.left("snippet", F.lit(320)).alias("snippet"))


def _found(x, keys: set):
    """The first string under one of the keys, anywhere in a JSON value."""
    todo = [x]
    while todo:
        x = todo.pop(0)
        if isinstance(x, dict):
            for k, v in x.items():
                if k in keys and isinstance(v, str) and v:
                    return v
            todo = list(x.values()) + todo
        elif isinstance(x, list):
            todo = x + todo
    return None


def images_of(html: str) -> list[tuple]:
    """(image, thumbnail, page, title) of an image result page: metadata in the links' JSON; JSON in data attributes; pictures inside links."""
    root, out = tree(html), []
    for a in select(root, "a.iusc[m]"):
        try:
            m = json.loads(a.attrs["m"])
        except ValueError:
            continue
        if isinstance(m, dict) and m.get("murl"):
            out.append((m["murl"], m.get("turl"), m.get("purl") or m["murl"], m.get("t") or a.attrs.get("aria-label", "")))
    for e in select(root, "[data-bem]"):
        raw = e.attrs["data-bem"]
        if "img" not in raw.lower() and "serp" not in raw.lower():
            continue
        try:
            x = json.loads(raw)
        except ValueError:
            continue
        if image := _found(x, {"img_href", "originUrl", "imageUrl", "url"}):
            out.append((image, _found(x, {"thumb", "preview", "thumbnail", "previewUrl"}), _found(x, {"snippetUrl", "pageUrl", "sourceUrl"}) or image, _found(x, {"title", "text", "description"}) or ""))
    for i in select(root, "a[href] img[src], a[href] img[data-src], a[href] img[data-lazy-src], article img[src], .tile img[src]"):
        src = next((i.attrs[k].strip() for k in ("data-src", "data-lazy-src", "src") if i.attrs.get(k, "").strip()), "")
        up = i.up
        while up is not None and not (up.tag == "a" and "href" in up.attrs):
            up = up.up
        out.append((src, src, up.attrs["href"] if up is not None else src, i.attrs.get("alt", "").strip() or (up.attrs.get("title", "") if up is not None else "")))
    return out


def image_results(pages: DataFrame, most: int = MOST_IMAGES) -> DataFrame:
    """(page_id, ord, source, query, image, thumbnail, page, title) of image result pages, each image and page once; engines' own pictures and what isn't http are left out."""

    def run(batches):
        for b in batches:
            rows = []
            for page, source, query, html in zip(b["page_id"], b["source"], b["query"], b["html"]):
                rows += [(page, i, source, query, *h) for i, h in enumerate(images_of(html))]
            yield pd.DataFrame(rows, columns=["page_id", "ord", "source", "query", "image", "thumbnail", "page", "title"])

    ok = pages.where(F.coalesce(F.trim("html") != "", F.lit(False)) & ~F.lower("html").rlike("|".join(T.CHALLENGES)))
    d = ok.select("page_id", "source", "query", "html").mapInPandas(run, "page_id long, ord long, source string, query string, image string, thumbnail string, page string, title string")
    d = d.where(N.is_http(F.col("image")) & ~P.noisy_image(F.col("image"))).withColumn("page", F.when(N.is_http(F.col("page")) & ~P.noisy_image(F.col("page")), F.col("page")).otherwise(F.col("image")))
    one = keep_first(d.withColumn("pair", N.pair_key(N.uri_canonical(F.col("image")), N.uri_canonical(F.col("page")))), ["page_id", "pair"], ["ord"])
    title = F.when(F.trim("title") == "", "Public image result").otherwise(F.col("title"))
    return cap(one, ["page_id"], ["ord"], most).select("page_id", "ord", "source", "query", "image", F.when(N.is_http(F.col("thumbnail")), F.col("thumbnail")).alias("thumbnail"), "page", F.left(title, F.lit(160)).alias("title"))


def html_fields(pages: DataFrame, most: int = 8000) -> DataFrame:
    """(page_id, title, description, text, links) of pages (page_id, html), by a parser: the text is what a reader sees, without scripts and the like, cut; links are the http addresses it leads to, each once. Null html gives nulls."""

    def run(batches):
        for b in batches:
            rows = []
            for page, html in zip(b["page_id"], b["html"]):
                if html is None:
                    rows.append((page, None, None, None, None))
                    continue
                root = tree(html)
                title = next((e.text() for e in select(root, "title")), "")
                about = next((e.attrs.get("content", "").strip() for e in select(root, "meta[name=description], meta[property=og:description], meta[name=twitter:description]")), "")
                body = next(iter(select(root, "body")), root)
                links = list(dict.fromkeys(u for a in select(root, "a[href]") if (u := a.attrs["href"].strip()).lower().startswith(("http://", "https://"))))
                rows.append((page, title, about, body.text()[:most], links))
            yield pd.DataFrame(rows, columns=["page_id", "title", "description", "text", "links"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, title string, description string, text string, links array<string>")


#: kind -> field -> JSON paths, the first that is there counts.
PROFILE_FIELDS = {
    "github": {"username": ["$.login"], "name": ["$.name"], "bio": ["$.bio"], "location": ["$.location"], "avatar": ["$.avatar_url"], "link": ["$.html_url"], "site": ["$.blog"]},
    "reddit": {"username": ["$.data.name"], "name": ["$.data.subreddit.title"], "bio": ["$.data.subreddit.public_description"], "avatar": ["$.data.subreddit.icon_img"]},
    "bluesky": {"username": ["$.handle"], "name": ["$.displayName"], "bio": ["$.description"], "avatar": ["$.avatar"], "site": ["$.did"]},
    "gitlab": {"username": ["$[0].username"], "name": ["$[0].name"], "bio": ["$[0].bio"], "location": ["$[0].location"], "avatar": ["$[0].avatar_url"], "link": ["$[0].web_url"], "site": ["$[0].website_url"]},
    "hackernews": {"username": ["$.id"], "bio": ["$.about"]},
    "devto": {"username": ["$.username"], "name": ["$.name"], "bio": ["$.summary"], "location": ["$.location"], "avatar": ["$.profile_image"], "site": ["$.website_url"]},
    "youtube": {"name": ["$.author_name", "$.title"], "avatar": ["$.thumbnail_url"], "link": ["$.author_url"]},
    "fediverse": {"username": ["$.subject"], "name": ["$.subject"], "link": ["$.aliases[0]"], "site": ["$.links[0].href"]},
    "stackoverflow": {"name": ["$.items[0].display_name"], "location": ["$.items[0].location"], "avatar": ["$.items[0].profile_image"], "link": ["$.items[0].link"], "site": ["$.items[0].website_url"]},
    "keybase": {"username": ["$.them[0].basics.username"], "name": ["$.them[0].profile.full_name"], "bio": ["$.them[0].profile.bio"], "location": ["$.them[0].profile.location"], "avatar": ["$.them[0].pictures.primary.url"]},
}
#: What an answer must hold to be one.
NEEDED = {"reddit": "$.data", "gitlab": "$[0].username", "hackernews": "$.id", "fediverse": "$.subject", "stackoverflow": "$.items[0]", "keybase": "$.them[0]"}


def profile_payloads(answers: DataFrame) -> DataFrame:
    """(answer_id, kind, username, name, bio, location, avatar, link, site) of stored profile answers (answer_id, kind, username, url, body) of ten kinds; answers of no kind, and those without what their kind needs, have no row.

    GitLab's are those whose username is the one asked for; a fediverse account's name is what stands between acct: and @; a Reddit icon goes without its query.
    """
    def field(f: str) -> Column:
        out = F.lit(None).cast("string")
        for kind, paths in PROFILE_FIELDS.items():
            if f in paths:
                out = F.when(F.col("kind") == kind, F.coalesce(*[F.nullif(F.trim(F.get_json_object("body", p)), F.lit("")) for p in paths[f]])).otherwise(out)
        return out

    there = F.col("kind").isin(list(PROFILE_FIELDS)) & F.coalesce(F.trim("body").rlike(r"(?s)^[\[{].*[\]}]$"), F.lit(False))
    for kind, path in NEEDED.items():
        there = there & ((F.col("kind") != kind) | F.get_json_object("body", path).isNotNull())
    d = answers.where(there).withColumns({f"__{f}": field(f) for f in ("username", "name", "bio", "location", "avatar", "link", "site")})
    d = d.where((F.col("kind") != "gitlab") | (F.lower("__username") == F.lower("username")))
    account = F.nullif(F.substring_index(F.regexp_replace("__username", "^.*acct:", ""), "@", 1), F.lit(""))
    user = F.coalesce(F.when(F.col("kind") == "fediverse", account).otherwise(F.col("__username")), "username")
    plain = F.when(F.col("kind").isin("hackernews", "stackoverflow"), F.trim(F.regexp_replace(F.regexp_replace("__bio", "<[^>]*>", " "), r"\s+", " "))).otherwise(F.col("__bio"))
    return d.select("answer_id", "kind", user.alias("username"), F.col("__name").alias("name"), plain.alias("bio"), F.col("__location").alias("location"), F.when(F.col("kind") == "reddit", F.substring_index("__avatar", "?", 1)).otherwise(F.col("__avatar")).alias("avatar"), F.coalesce("__link", "url").alias("link"), F.col("__site").alias("site"))


def captures(answers: DataFrame) -> DataFrame:
    """(answer_id, url, stamp, shown) of an archive's answers (answer_id, body): the nearest capture that is there, was answered by 200 and has a time stamp of 4 to 14 digits; its address by https."""
    at = lambda k: F.get_json_object("body", f"$.archived_snapshots.closest.{k}")
    d = answers.select("answer_id", at("available").alias("there"), at("status").alias("status"), at("url").alias("url"), at("timestamp").alias("stamp"))
    d = d.where("there = 'true' and status = '200' and trim(url) != '' and length(stamp) between 4 and 14")
    return d.select("answer_id", N.capture_url(F.col("url")).alias("url"), "stamp", N.capture_date(F.col("stamp")).alias("shown")).where("url is not null")


def followed(pages: DataFrame, roots: DataFrame, most: int = 5) -> DataFrame:
    """(root, ord, url) of the pages to read after a site's own: those that its page links to on the same host, under a word like about or contact, each once, five at most. Pages are (url, links)."""
    d = roots.select(F.col("url").alias("root")).distinct().join(pages.select(F.col("url").alias("root"), "links"), "root")
    d = d.select("root", F.posexplode("links").alias("ord", "url")).where(F.lower(F.regexp_extract("url", "^https?://([^/?#:]+)", 1)) == F.lower(F.regexp_extract("root", "^https?://([^/?#:]+)", 1)))
    d = d.where(P.priority_path(P.path(F.col("url")))).where(F.lower("url") != F.lower("root"))
    return cap(keep_first(d, ["root", "lower(url)"], ["ord"]), ["root"], ["ord"], most).select("root", F.col("ord").cast("long").alias("ord"), "url")


def email_ranges(bodies: DataFrame) -> DataFrame:
    """(prefix, suffix, breach) of answers by hash prefix: JSON lists of {hashSuffix, websites}; of equal suffixes the first, each website once. What isn't such a list has no rows."""
    d = bodies.select("prefix", F.posexplode(F.from_json("body", "array<struct<hashSuffix:string,websites:array<string>>>")).alias("ord", "r"))
    one = keep_first(d.select("prefix", "ord", F.upper("r.hashSuffix").alias("suffix"), "r.websites").where("suffix is not null"), ["prefix", "suffix"], ["ord"])
    return one.select("prefix", "suffix", F.explode(F.array_distinct(F.filter("websites", lambda w: F.trim(w) != ""))).alias("breach"))


def models(bodies: DataFrame) -> DataFrame:
    """(body_id, model, shown) of stored model lists of either form (data or models), each once; those of the first form that don't chat are left out."""
    a = bodies.select("body_id", F.posexplode(F.from_json(F.get_json_object("body", "$.data"), "array<struct<id:string,name:string,display_name:string>>")).alias("ord", "m"))
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    a = a.select("body_id", "ord", full("m.id").alias("model"), F.coalesce(full("m.name"), full("m.display_name"), full("m.id")).alias("shown")).where(~F.lower("model").rlike("|".join(N.NO_CHAT)))
    b = bodies.select("body_id", F.posexplode(F.from_json(F.get_json_object("body", "$.models"), "array<struct<model:string,name:string,details:struct<parameter_size:string>>>")).alias("ord", "m"))
    b = b.select("body_id", "ord", F.coalesce(full("m.model"), full("m.name")).alias("model"), F.concat_ws(" ", F.coalesce(full("m.model"), full("m.name")), F.concat(F.lit("("), full("m.details.parameter_size"), F.lit(")"))).alias("shown"))
    return keep_first(a.unionByName(b).where("model is not null"), ["body_id", "model"], ["ord"]).select("body_id", "model", "shown")


def profile_image(html: Column) -> Column:
    """The address of a page's own picture: what its meta elements name, in their order, else an image that looks like an avatar; https, without fragment; null for none."""
    meta = lambda k, v: F.coalesce(*[F.nullif(F.regexp_extract(html, rx, 1), F.lit("")) for rx in (rf"""(?is)<meta[^>]*\b{k}=["']?{re.escape(v)}["'\s][^>]*\bcontent=["']([^"']*)["']""", rf"""(?is)<meta[^>]*\bcontent=["']([^"']*)["'][^>]*\b{k}=["']?{re.escape(v)}["'\s/>]""")])
    img = lambda rx: F.nullif(F.regexp_extract(F.regexp_extract(html, rx, 0), r"""(?is)\bsrc=["']([^"']*)["']""", 1), F.lit(""))
    found = [meta("property", "og:image"), meta("name", "og:image"), meta("name", "twitter:image"), meta("property", "twitter:image"), meta("name", "twitter:image:src"), meta("property", "twitter:image:src"), F.nullif(F.regexp_extract(html, r"""(?is)<link[^>]*\brel=["']?image_src["'\s][^>]*\bhref=["']([^"']*)["']""", 1), F.lit(""))]
    found += [img(r"""(?is)<img[^>]*\bclass=["'][^"']*\bavatar\b[^>]*>"""), *[img(rf"""(?is)<img[^>]*\b{a}=["'][^"']*{w}[^>]*>""") for a, w in (("alt", "avatar"), ("alt", "profile"), ("src", "avatar"), ("src", "profile"))]]
    return F.coalesce(*[F.when(N.is_http(F.trim(x)), F.substring_index(U.ensure_https(x), "#", 1)) for x in found])
