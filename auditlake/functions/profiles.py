"""Profile URLs and handles, as column expressions: which platform a URL is of, whose handle it has, what isn't a profile."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.sources.tables import PLATFORMS

#: First path segments that no profile has.
RESERVED = sorted("about directory explore feed hashtag help home intent login logout messages notifications policies privacy register search settings share shorts signin signup tags terms topics tos watch".split())
#: Words that are no handle in a mention or a link.
NO_HANDLE = sorted({*RESERVED, *"c channel i posts r user users aspx com html http https net org php www".split()})
ALIASES = {"fb.com": "facebook.com", "m.facebook.com": "facebook.com", "m.youtube.com": "youtube.com", "mobile.twitter.com": "x.com", "old.reddit.com": "reddit.com", "twitter.com": "x.com"}
ENGINES = sorted("bing.com brave.com duckduckgo.com google.com mojeek.com qwant.com search.brave.com yandex.com yandex.ru".split())
EXPOSURE_HOSTS = sorted("4chan.org boards.4chan.org bsky.app dev.to github.com gitlab.com instagram.com linkedin.com mastodon.social medium.com news.ycombinator.com reddit.com twitch.tv twitter.com x.com youtube.com".split())
FILES = sorted(f".{x}" for x in "css gif ico jpeg jpg js png svg".split())
PRIORITY = sorted("about bio contact cv me portfolio resume".split())
#: word in a text -> platform; the first by this order counts. The bare words x and hn are too common to introduce a handle.
MENTIONS = [("twitch", "Twitch"), ("github", "GitHub"), ("gitlab", "GitLab"), ("reddit", "Reddit"), ("instagram", "Instagram"), ("x", "X"), ("twitter", "X"), ("youtube", "YouTube"), ("tiktok", "TikTok"), ("telegram", "Telegram"), ("bluesky", "Bluesky"), ("mastodon", "Mastodon"), ("linkedin", "LinkedIn"), ("medium", "Medium"), ("threads", "Threads"), ("snapchat", "Snapchat"), ("discord", "Discord"), ("hacker news", "HackerNews"), ("hn", "HackerNews"), ("dev.to", "DevTo"), ("pinterest", "Pinterest"), ("facebook", "Facebook")]


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once and named, however often it is used: without this, expressions of expressions grow by powers."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bare_host(url: Column) -> Column:
    """Lower-case host without www; null where the URL has none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", ""), F.lit(""))


def path(url: Column) -> Column:
    """Path without slashes around it; empty where there is none."""
    return F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _on(host: Column, names: list[str]) -> Column:
    return let(host, lambda h: F.exists(F.array(*map(F.lit, names)), lambda n: (h == n) | F.endswith(h, F.concat(F.lit("."), n))))


def noisy(url: Column) -> Column:
    """Search engines' own pages, files that are no page, and what has no host."""
    def said(v: Column) -> Column:
        return v["h"].isNull() | _on(v["h"], ENGINES) | F.exists(F.array(*map(F.lit, FILES)), lambda e: F.endswith(v["p"], e))

    return let(url, lambda u: let(F.struct(bare_host(u).alias("h"), F.lower(path(u)).alias("p")), said))


def known_host(url: Column) -> Column:
    return F.coalesce(_on(bare_host(url), EXPOSURE_HOSTS), F.lit(False))


def noisy_image(url: Column) -> Column:
    return let(url, lambda u: let(bare_host(u), lambda h: h.isNull() | h.contains("bing.com") | h.contains("duckduckgo.com") | F.lower(u).contains("base64")))


def clean(handle: Column) -> Column:
    """Trimmed, without the sign before it."""
    return F.regexp_replace(F.trim(handle), "^@", "")


def handle_in_url(url: Column, handle: Column) -> Column:
    """Whether a whole segment of the path, or a whole value of the query, is the handle, whatever its case."""
    h = F.lower(clean(handle))
    segments = F.transform(F.split(path(url), "/"), lambda s: F.lower(F.regexp_replace(s, "^@", "")))
    values = F.transform(F.split(query(url), "&"), lambda s: F.when(s.contains("="), F.lower(F.regexp_replace(F.regexp_replace(s, "^[^=]*=", ""), "^@", ""))).otherwise(""))
    return F.coalesce((h != "") & (F.array_contains(segments, h) | F.array_contains(values, h)), F.lit(False))


def no_profile_handle(handle: Column) -> Column:
    """Reserved words, handles without a letter, mail hosts."""
    h = F.lower(handle)
    return h.isin(NO_HANDLE) | ~h.rlike(r"\p{L}") | F.endswith(h, F.lit("noreply.github.com"))


def priority_path(p: Column) -> Column:
    """Whether a word of the path, between slashes, hyphens and underscores and without extension, is one under which people tell of themselves."""
    bases = F.transform(F.filter(F.split(F.lower(p), "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, r"\.[^.]*$", ""))
    return F.arrays_overlap(F.flatten(F.transform(bases, lambda s: F.split(s, "[-_]"))), F.array(*map(F.lit, PRIORITY)))


def resolved(raw: Column) -> Column:
    """struct(platform, handle, url) of a profile URL; null where it is of no platform, or of none of its profiles. No two platforms share a host, so a URL's host, or the shortest end of it that is a platform's, tells which it is."""
    t = F.trim(raw)
    url = F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    twins = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    known = F.create_map(*[x for name, pattern, _, host, prefix in PLATFORMS for x in (F.lit(host), F.struct(F.lit(name).alias("name"), F.lit(pattern).alias("pattern"), F.lit(prefix.removeprefix("user?")).alias("prefix")))])

    def parts(u: Column) -> Column:
        return F.struct(bare_host(u).alias("host"), F.regexp_replace(F.regexp_extract(u, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "^/+", "").alias("p"), query(u).alias("q"))

    def placed(v: Column) -> Column:
        labels = F.split(v["host"], r"\.")
        ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        where = F.get(F.filter(F.concat(F.array(F.coalesce(twins[v["host"]], v["host"])), ends), lambda h: F.map_contains_key(known, h)), F.lit(0))
        first = F.substring_index(v["p"], "/", 1)
        fits = (F.length(v["p"]) >= 2) & ~F.lower(first).isin(RESERVED)
        return F.struct(v["host"].alias("host"), v["p"].alias("p"), v["q"].alias("q"), F.regexp_replace(first, "^@", "").alias("own"), F.when(fits, known[where]).alias("t"))

    def handled(v: Column) -> Column:
        p, q, prefix = v["p"], v["q"], v["t"]["prefix"]
        id_ = F.trim(F.substring_index(F.when(F.instr(q, "id=") > 0, F.substr(q, F.instr(q, "id=") + 3)).otherwise(""), "&", 1))
        after = F.when(F.position(prefix, p) > 0, F.substr(p, F.position(prefix, p) + F.length(prefix))).otherwise("")
        inside = F.substring_index(F.regexp_replace(after, "^/+", ""), "/", 1)
        h = F.when(prefix == "id=", id_).when(prefix == "", v["own"]).when(F.startswith(F.lower(p), prefix), inside).when(prefix == "@", v["own"]).otherwise("")
        return F.struct(v["host"].alias("host"), v["t"].alias("t"), F.regexp_replace(h, "^@", "").alias("h"))

    def chosen(v: Column) -> Column:
        good = (F.length(v["h"]) >= 2) & (F.lower(v["h"]) != "www") & (F.lower(v["h"]) != v["host"])
        return F.when(v["t"].isNotNull() & good, F.struct(v["t"]["name"].alias("platform"), v["h"].alias("handle"), F.replace(v["t"]["pattern"], F.lit("{u}"), v["h"]).alias("url")))

    return let(url, lambda u: let(parts(u), lambda v: let(placed(v), lambda w: let(handled(w), chosen))))


def mention_phrases() -> str:
    """A pattern of what introduces a handle: a platform's name, perhaps a word or sign, then the handle, its only group but the name."""
    names = "|".join(n.replace(".", r"\.") for n, _ in MENTIONS if n not in ("x", "hn"))
    return rf"(?i)({names})\s*(?:as|:|@|->|is|id)?\s*@?([a-z0-9][a-z0-9._-]{{1,29}})"


def platform_of_word(word: Column) -> Column:
    """The platform that a text's beginning names."""
    w = F.lower(word)
    return F.coalesce(*[F.when(F.startswith(w, F.lit(n)), F.lit(p)) for n, p in MENTIONS])


def platform_nearby(window: Column) -> Column:
    w = F.lower(window)
    return F.coalesce(*[F.when(w.contains(n), F.lit(p)) for n, p in MENTIONS if n != "x"])
