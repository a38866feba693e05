"""Small normalizers and parsers of single values, as column expressions: keys, ids, labelled fields, lists, and the texts of queries (which nothing here sends)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

GENERIC = sorted("background building car ceiling chair cloud door fabric floor flower food foreground grass material people person plant road rock sand sky stone table textile tree wall water window".split())
NO_PLACE = sorted(["about", "click", "duckduckgo", "google", "here", "image", "log in", "maps", "photo", "picture", "results", "search", "sign in", "that", "the", "these", "their", "this", "those", "your"])
PLACE = r"\b([A-Z][a-zA-Z]+(?:(?:\s+(?:da|de|di|du|el|la|las|le|los|of|san|st|the|van|von))??\s+[A-Z][a-zA-Z]+){0,3})\b"
NO_CHAT = sorted("babbage dall-e davinci embed embedding image moderation omni-moderation tts whisper".split())
RELIABLE = sorted("bsky.app/profile dev.to github.com gitlab.com news.ycombinator.com/user reddit.com/user youtube.com".split())
PROFILE_SITES = sorted("bsky.app/profile dev.to github.com gitlab.com instagram.com linkedin.com/in mastodon.social medium.com reddit.com/user twitch.tv twitter.com x.com youtube.com".split())
FORUMS = sorted("4chan.org boards.4chan.org reddit.com".split())


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike("(?i)^https?://"), F.lit(False))


def uri_canonical(url: Column) -> Column:
    """Scheme and host in lower case, without fragment and closing slash; path and query keep their case. What has no scheme is lower-cased as a whole."""
    bare = F.regexp_replace(F.substring_index(F.trim(url), "#", 1), "/$", "")
    head = F.regexp_extract(bare, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)", 1)
    user = F.regexp_extract(head, "://([^@]*@)", 1)
    return F.when(head == "", F.lower(bare)).otherwise(F.concat(F.lower(F.replace(head, user, F.lit(""))).substr(F.lit(1), F.instr(head, "://") + 2), user, F.lower(F.substr(F.replace(head, user, F.lit("")), F.instr(head, "://") + 3)), F.substr(bare, F.length(head) + 1)))


def pair_key(a: Column, b: Column) -> Column:
    """One key of an image and the page that it is on."""
    return F.concat_ws("|", a, b)


def evidence_id(type_: Column, value: Column, url: Column) -> Column:
    return F.concat(F.lit("ev:"), type_, F.lit(":"), value, F.lit(":"), F.coalesce(url, F.lit("")))


def signals_text(signals: Column) -> Column:
    """Signals as the remediation of a finding; signals_list() is the way back."""
    return F.array_join(signals, "; ")


def signals_list(remediation: Column) -> Column:
    return F.when(F.coalesce(F.trim(remediation), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(remediation))


def mail_hash(email: Column, length: int = 6) -> Column:
    """struct(prefix, suffix) of the upper-case SHA-1 of the address, trimmed and in lower case: the prefix alone is asked for."""
    h = F.upper(F.sha1(F.lower(F.trim(email))))
    return F.struct(F.left(h, F.lit(length)).alias("prefix"), F.substr(h, F.lit(length + 1)).alias("suffix"))


def capture_date(stamp: Column) -> Column:
    n = F.length(stamp)
    part = lambda a, k: F.substr(stamp, F.lit(a), F.lit(k))
    return F.when(n >= 8, F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2))).when(n >= 6, F.concat_ws("-", part(1, 4), part(5, 2))).when(n >= 4, part(1, 4)).otherwise("unknown date")


def capture_url(raw: Column) -> Column:
    """An archive's address by https; null for any other host."""
    up = F.regexp_replace(F.trim(raw), "^http://web[.]archive[.]org", "https://web.archive.org")
    host = F.lower(F.regexp_extract(up, "^https://([^/?#:]+)", 1))
    return F.when((host == "web.archive.org") | F.endswith(host, F.lit(".web.archive.org")), up)


def safe_field(value: Column, most: int = 500) -> Column:
    """Without control characters, white space collapsed, cut."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(value, r"[\x00-\x1F\x7F]", " "), r"\s+", " ")), F.lit(most))


def distinct_ignoring_case(items: Column) -> Column:
    """The first of each spelling."""
    return F.aggregate(items, F.array().cast("array<string>"), lambda acc, x: F.when(F.array_contains(F.transform(acc, F.lower), F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def signal_list(raw: Column) -> Column:
    """Entries between commas, lines and tabs, trimmed, each once whatever its case."""
    return distinct_ignoring_case(F.filter(F.transform(F.split(raw, "[,\n\t]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""))


def exact_lines(raw: Column) -> Column:
    """Lines that aren't empty, with all their blanks."""
    return F.filter(F.transform(F.split(raw, "\n"), lambda x: F.regexp_replace(x, "\r$", "")), lambda x: x != "")


def labelled(raw: Column, label: str) -> Column:
    """What follows LABEL: up to the next label; null where there is no such label, and for `none`."""
    v = F.regexp_extract(raw, rf"(?i)\b{label}\s*:\s*(.*?)(?=\s+\b(?:TEXT|LANDMARKS|FACE)\s*:|$)", 1)
    has = raw.rlike(rf"(?i)\b{label}\s*:")
    return F.when(has & ~F.lower(F.regexp_replace(F.trim(v), "[.]$", "")).isin("none", ""), F.trim(v))


def analysis(raw: Column) -> Column:
    """struct(text, landmarks, face) of an answer of labelled fields; without any TEXT label, all of it is text."""
    text = F.when(raw.rlike(r"(?i)\bTEXT\s*:"), labelled(raw, "TEXT")).otherwise(F.nullif(F.trim(raw), F.lit("")))
    marks = F.coalesce(F.filter(F.transform(F.split(labelled(raw, "LANDMARKS"), ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))
    return F.struct(text.alias("text"), marks.alias("landmarks"), F.coalesce(F.lower(labelled(raw, "FACE")).rlike("^(yes|true)"), F.lit(False)).alias("face"))


def place_query(gps: Column, text: Column, landmarks: Column) -> Column:
    """What to look for on a map: a position, else landmarks and the first letters of a text; null for nothing."""
    letters = F.trim(F.regexp_replace(F.left(F.coalesce(text, F.lit("")), F.lit(50)), "[^a-zA-Z0-9 ]", ""))
    return F.coalesce(gps, F.nullif(F.trim(F.concat_ws(" ", F.nullif(F.array_join(landmarks, " "), F.lit("")), F.nullif(letters, F.lit("")))), F.lit("")))


def scene_query(text: Column, labels: Column) -> Column:
    """A sign's words, 60 characters at most, and up to three labels that say more than "tree"."""
    toks = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: (F.length(w) >= 2) & w.rlike("^[A-Za-z][A-Za-z0-9'.-]*$"))
    run = F.nullif(F.trim(F.left(F.array_join(toks, " "), F.lit(60))), F.lit(""))
    some = F.slice(F.filter(labels, lambda x: (F.length(x) >= 3) & ~F.lower(x).isin(GENERIC)), 1, 3)
    return F.trim(F.concat_ws(" ", run, F.array_join(some, " ")))


def place_phrases(text: Column) -> Column:
    """Runs of capitalized words of 4 to 40 characters that may name a place."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PLACE), F.lit(1)), lambda x: F.trim(x))
    return F.filter(found, lambda p: F.length(p).between(4, 40) & ~F.lower(p).isin(NO_PLACE))


def high_signal(query: Column) -> Column:
    """Queries for an address, a number of 8 digits or more, or one quoted term."""
    bare = F.replace(query, F.lit('"'), F.lit(""))
    return bare.contains("@") | (F.length(F.regexp_replace(bare, "[^0-9]", "")) >= 8) | (~F.lower(query).contains("site:") & F.startswith(query, F.lit('"')) & F.endswith(query, F.lit('"')))


def quoted(term: Column) -> Column:
    return F.concat(F.lit('"'), F.left(F.trim(F.replace(term, F.lit('"'), F.lit(" "))), F.lit(90)), F.lit('"'))


def _terms(c: str) -> Column:
    return F.filter(F.transform(c, lambda x: F.regexp_replace(F.trim(x), "^@", "")), lambda x: x != "")


def _handles() -> Column:
    return distinct_ignoring_case(F.filter(F.transform(F.concat("handles", "aliases"), lambda x: F.regexp_replace(F.trim(x), "^@", "")), lambda x: F.length(x).between(2, 40)))


def _each(items: Column, most: int, make) -> Column:
    return F.flatten(F.transform(F.slice(items, 1, most), make))


def search_queries(deep: bool = False) -> Column:
    """The queries that an identity's owner would put to a search engine, most telling first; each once."""
    name, handles = F.trim("full_name"), _handles()
    named = (name != "") & name.isNotNull()
    site = lambda x, s: F.concat(quoted(x), F.lit(f" site:{s}"))
    local = lambda e: F.regexp_replace(F.trim(F.substring_index(e, "@", 1)), r"^\+", "")
    mails = _each(_terms("emails"), 4 if deep else 2, lambda e: F.array_compact(F.array(quoted(e), F.when(F.length(local(e)) >= 3, quoted(local(e))), site(e, "github.com"), *([site(e, "pastebin.com"), site(e, "gitlab.com")] if deep else []))))
    numbers = F.array_distinct(F.filter(F.transform("phones", lambda p: F.regexp_replace(p, "[^0-9]", "")), lambda p: F.length(p) >= 8))
    calls = _each(numbers, 3 if deep else 2, lambda p: F.array_compact(F.array(quoted(p), F.when(F.length(p) >= 10, quoted(F.right(p, F.lit(10)))))))
    users = _each(handles, 8 if deep else 5, lambda h: F.array(quoted(h), *[site(h, s) for s in RELIABLE], F.concat(quoted(h), F.lit(" github reddit gitlab dev.to bluesky youtube"))))
    both = lambda items: F.transform(F.slice(items, 1, 2), lambda x: F.concat_ws(" ", quoted(name), quoted(x)))
    alone = F.array(quoted(name), F.concat(quoted(name), F.lit(" github linkedin x twitter reddit twitch instagram youtube")), *[site(name, s) for s in (*PROFILE_SITES, *FORUMS)])
    person = F.when(named, F.concat(both(_terms("organizations")), both(_terms("locations")), both(handles), alone)).otherwise(F.array().cast("array<string>"))
    others = _each(_terms("aliases"), 6 if deep else 3, lambda a: F.array(quoted(a), site(a, "reddit.com"), *([site(a, "4chan.org"), site(a, "boards.4chan.org")] if deep else [])))
    return F.array_distinct(F.concat(mails, calls, users, person, others))


def image_queries(deep: bool = False) -> Column:
    """The same for pictures: name, handles, aliases."""
    name = F.trim("full_name")
    word = lambda x, w: F.concat(quoted(x), F.lit(f" {w}"))
    person = F.when((name != "") & name.isNotNull(), F.array(quoted(name), word(name, "profile photo"), word(name, "avatar"), word(name, "github linkedin twitter x"))).otherwise(F.array().cast("array<string>"))
    users = _each(_handles(), 8 if deep else 4, lambda h: F.array(word(h, "avatar"), word(h, "profile photo")))
    return F.array_distinct(F.concat(person, users, _each(_terms("aliases"), 5 if deep else 2, lambda a: F.array(word(a, "avatar")))))


def reverse_image_queries(text: Column, labels: Column, deep: bool = False) -> Column:
    """By what a picture shows: lines of its text, labels; then the identity's name and handles."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.regexp_replace(F.trim(x), r"\s+", " ")), lambda x: F.length(x).between(4, 100))
    said = _each(distinct_ignoring_case(lines), 6 if deep else 3, lambda x: F.array(quoted(x), F.concat(quoted(x), F.lit(" image"))))
    tags = F.slice(distinct_ignoring_case(F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: F.length(x).between(3, 40))), 1, 7 if deep else 4)
    seen = F.when(F.size(tags) > 0, F.array(F.array_join(F.transform(F.slice(tags, 1, 3), quoted), " "), F.concat(F.array_join(F.slice(tags, 1, 4), " "), F.lit(" photo")))).otherwise(F.array().cast("array<string>"))
    name = F.trim("full_name")
    person = F.when((name != "") & name.isNotNull(), F.array(F.concat(quoted(name), F.lit(" avatar")), F.concat(quoted(name), F.lit(" profile photo")))).otherwise(F.array().cast("array<string>"))
    users = _each(_handles(), 6 if deep else 3, lambda h: F.array(F.concat(quoted(h), F.lit(" avatar")), F.concat(quoted(h), F.lit(" profile photo"))))
    return F.array_distinct(reduce(lambda a, b: F.concat(a, b), [said, seen, person, users]))
