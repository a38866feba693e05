"""Search hits of an identity: one hit a page, its score by what the index says, by what the page says, and the rank of both.

Identities have lists: handles, aliases, emails, phones, organizations, locations, profile_urls. An empty list or name matches nothing, and no
rule is ever null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import profiles as P
from auditlake.functions import text as T
from auditlake.functions import urls as U
from auditlake.operators.ordering import cap, keep_first

LEAST_INDEX, LEAST_SCORE, CEILING, OPENED, READ, SHOWN = 0.22, 0.30, 0.58, 58, 28, 34


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _any(items: Column, rule) -> Column:
    return _true(F.exists(items, rule))


def names(d: Column) -> Column:
    """The parts of a name that have three letters or more, in lower case."""
    return F.filter(F.split(F.lower(F.trim(d)), r"\s+"), lambda w: F.length(w) >= 3)


def terms(*lists: str) -> Column:
    """Handles of these lists without signs, in lower case, of 2 to 40 characters, each once."""
    every = F.transform(F.flatten(F.array(*lists)), lambda h: F.lower(P.clean(h)))
    return F.array_distinct(F.filter(every, lambda h: F.length(h).between(2, 40)))


def phone_digits() -> Column:
    return F.filter(F.transform("phones", T.digits), lambda p: F.length(p) >= 8)


def bonus(providers: Column) -> Column:
    """For providers that agree: 0.04 for each after the first, 0.12 at most."""
    return F.least(F.greatest(providers - 1, F.lit(0)) * 0.04, F.lit(0.12))


def one_hit(hits: DataFrame, key: str = "subject_id") -> DataFrame:
    """A row for each subject and page: the hit whose title and snippet are longest together, the first of equal ones, with all its providers (sources) and their number."""
    d = hits.withColumn("page", U.canonical_key(F.col("url")))
    best = F.struct((-F.length("title") - F.length("snippet")).alias("l"), "ord")
    row = F.struct("url", "title", "snippet", "query", "ord")
    g = d.groupBy(key, "page").agg(F.min_by(row, best).alias("r"), F.array_sort(F.collect_set(F.struct(F.col("ord"), F.col("source")))).alias("s"))
    sources = F.array_distinct(F.transform("s", lambda x: x["source"]))
    return g.select(key, "page", "r.*", F.array_join(sources, "+").alias("sources"), F.size(sources).cast("long").alias("providers"))


def index_signals() -> dict[str, tuple[Column, float]]:
    """rule -> (holds, weight) of a hit joined with its identity; those under `identity` speak of the person."""
    said = F.lower(F.concat_ws(" ", "title", "snippet", "url"))
    who, parts = F.lower(F.trim("full_name")), names(F.col("full_name"))
    handles = terms("handles", "aliases")
    return {
        "name": (_true((who != "") & F.contains(said, who)), 0.30),
        "parts": (_true((F.size(parts) >= 2) & F.forall(parts, lambda w: F.contains(said, w))), 0.18),
        "handle": (_any(handles, lambda h: F.contains(said, h)), 0.20),
        "path": (_any(handles, lambda h: P.handle_in_url(F.col("url"), h)), 0.18),
        "profile": (P.resolved(F.col("url")).isNotNull(), 0.14),
        "host": (P.known_host(F.col("url")), 0.05),
        "site": (_true(F.lower("query").contains("site:")), 0.03),
    }


def index_score(hits: DataFrame, identities: DataFrame, key: str = "subject_id") -> DataFrame:
    """Hits of one_hit joined with their identity, with `index`: 0.08, the rules' weights, 0.25 for each e-mail address, 0.20 for each number of 8 digits, 0.10 for each alias, the bonus, less 0.20 where nothing speaks of the person; between 0 and 0.95."""
    d = hits.join(identities, key)
    said = F.lower(F.concat_ws(" ", "title", "snippet", "url"))
    rules = index_signals()
    count = lambda items, rule: F.coalesce(F.size(F.filter(items, rule)), F.lit(0))
    mails = count(F.col("emails"), lambda e: F.contains(said, F.lower(e)) & (F.trim(e) != ""))
    calls = count(phone_digits(), lambda p: F.contains(T.digits(said), p))
    others = count(F.transform("aliases", lambda a: F.lower(P.clean(a))), lambda a: F.contains(said, a) & (a != ""))
    total = F.lit(0.08) + mails * 0.25 + calls * 0.20 + others * 0.10 + bonus(F.col("providers"))
    for holds, weight in rules.values():
        total = total + holds.cast("int") * weight
    personal = reduce(lambda a, b: a | b, [rules[k][0] for k in ("name", "parts", "handle", "path")]) | (mails + calls + others > 0)
    return d.withColumn("index", F.greatest(F.lit(0.0), F.least(F.lit(0.95), total - (~personal).cast("int") * 0.20)))


def direct_signals(url: str = "page_url", text: str = "text") -> dict[str, tuple[Column, float]]:
    """rule -> (holds, weight) of what a page itself says, joined with the identity."""
    said, at = F.lower(text), F.col(url)
    handles = terms("handles")
    place = lambda u: F.concat(F.coalesce(P.bare_host(u), F.lit("")), F.lit("/"), F.lower(P.path(u)))
    who, parts = F.lower(F.trim("full_name")), names(F.col("full_name"))
    full = _true((F.size(parts) >= 2) & F.contains(said, who))
    both = _true((F.size(parts) >= 2) & F.forall(parts, lambda w: F.contains(said, w)))
    known = lambda c: _any(F.col(c), lambda x: (F.length(F.trim(x)) >= 3) & F.contains(said, F.lower(F.trim(x))))
    return {
        "supplied": (_any(F.col("profile_urls"), lambda u: place(U.ensure_https(u)) == place(at)), 0.95),
        "path": (_any(handles, lambda h: P.handle_in_url(at, h)), 0.50),
        "handle": (_any(handles, lambda h: T.contains_token(F.col(text), h)), 0.14),
        "email": (_any(F.col("emails"), lambda e: e.contains("@") & F.contains(said, F.lower(F.trim(e)))), 0.72),
        "phone": (_any(phone_digits(), lambda p: F.contains(T.digits(said), p)), 0.70),
        "name": (full, 0.34),
        "parts": (both & ~full, 0.24),
        "alias": (_any(F.filter(F.transform("aliases", lambda a: F.lower(P.clean(a))), lambda a: F.length(a) >= 3), lambda a: T.contains_token(F.col(text), a)), 0.18),
        "organization": (known("organizations"), 0.12),
        "location": (known("locations"), 0.08),
    }


def direct_score(d: DataFrame, url: str = "page_url", text: str = "text") -> DataFrame:
    """Adds direct, ceiling and signals; null where text is null. The ceiling is that of the strongest evidence: a supplied URL, an address or number, the handle in the URL and something else as strong, and so on down."""
    rules = direct_signals(url, text)
    n = lambda keys: reduce(lambda a, b: a + b, [rules[k][0].cast("int") for k in keys])
    strong = n(("supplied", "path", "email", "phone", "name", "parts"))
    total = reduce(lambda a, b: a + b, [holds.cast("int") * w for holds, w in rules.values()])
    is_ = lambda k: rules[k][0]
    named = is_("name") | is_("parts")
    ceiling = F.when(is_("supplied"), 0.99).when(is_("email") | is_("phone"), 0.97).when(is_("path") & (strong >= 2), 0.95).when(is_("path"), 0.82).when(named & (n(rules) >= 2), 0.86).when(named, 0.60).otherwise(0.48)
    there = F.col(text).isNotNull()
    return d.withColumns({"direct": F.when(there, F.least(F.lit(1.0), total)), "ceiling": F.when(there, ceiling), "signals": F.when(there, n(rules).cast("long"))})


def outcome(status: Column) -> Column:
    """What an answer means: gone, unavailable or readable; transient ones are worth another try (transient())."""
    return F.when(status.isin(404, 410), "gone").when(status.between(200, 299), "readable").otherwise("unavailable")


def transient(status: Column) -> Column:
    return status.isin(408, 425, 429) | status.between(500, 599)


def historical_ceiling(ceiling: Column) -> Column:
    """Of a page's archived copy."""
    return F.least(ceiling, F.lit(0.78))


def historical_score(direct: Column, ceiling: Column) -> Column:
    return F.when(direct.isNotNull(), F.least(direct * 0.90, historical_ceiling(ceiling)))


def banded(scored: DataFrame, key: str = "subject_id") -> DataFrame:
    """A subject's 58 best hits of an index score of 0.22 or more, with `band`: read for the first 28, listed for the rest."""
    from pyspark.sql import Window as W

    best = W.partitionBy(key).orderBy(F.desc(F.round("index", 9)), "ord")
    d = scored.where(F.round("index", 9) >= LEAST_INDEX).withColumn("place", F.row_number().over(best)).where(F.col("place") <= OPENED)
    return d.withColumn("band", F.when(F.col("place") <= READ, "read").otherwise("listed"))


def ranked(scored: DataFrame, pages: DataFrame, identities: DataFrame, key: str = "subject_id") -> DataFrame:
    """(key, page, outcome, verified, score, providers, title): a subject's 34 best hits. Those whose page (key, url, status, text) could be read are scored by page and index together, up to the page's
    ceiling; pages that are gone go; others keep their index score, 0.58 at most. Verified ones first, then by score, providers and title."""
    met = pages.select(key, F.col("url").alias("page_url"), "status", "text", U.canonical_key(F.col("url")).alias("page"))
    met = keep_first(met, [key, "page"], ["page_url"])
    d = banded(index_score(scored, identities, key), key).join(met, [key, "page"], "left")
    what = F.when((F.col("band") == "listed") | F.col("status").isNull(), "listed").otherwise(outcome(F.col("status")))
    # what the index says of a page that can be read is part of its evidence
    d = d.withColumn("outcome", what).withColumn("text", F.when(F.col("outcome") == "readable", F.concat_ws(" ", "title", "snippet", "text")))
    d = direct_score(d.where("outcome != 'gone'"))
    blend = F.least(F.col("ceiling"), F.greatest(F.lit(0.0), 0.42 * F.col("index") + 0.68 * F.col("direct") + bonus(F.col("providers"))))
    score = F.round(F.when(F.col("direct").isNotNull(), blend).otherwise(F.least(F.col("index"), F.lit(CEILING))), 9)
    d = d.withColumn("score", score).withColumn("verified", F.col("direct").isNotNull()).where(F.col("score") >= LEAST_SCORE)
    return cap(d, [key], [F.desc("verified"), F.desc("score"), F.desc("providers"), "title", "page"], SHOWN)


def belongs(d: DataFrame, username: str, url: str, text: str) -> Column:
    """Whether a page that was seen to exist is the identity's: a supplied URL or handle; the name, an address or a number in its text; what else is known of someone with a full name; a handle made of both names."""
    said = F.lower(text)
    given = lambda c: F.filter(F.col(c), lambda x: F.trim(x) != "")
    words = F.filter(F.split(F.lower(F.trim("full_name")), r"\s+"), lambda w: w != "")
    many, name = F.size(words) > 1, F.lower(F.trim("full_name"))
    first, last = F.get(words, F.lit(0)), F.try_element_at(words, F.lit(-1))
    supplied = _any(F.col("profile_urls"), lambda u: F.lower(F.trim(u)) == F.lower(F.trim(F.col(url))))
    ours = _any(given("handles"), lambda h: F.lower(h) == F.lower(username))
    has = lambda c: F.size(given(c)) > 0
    strong = many | has("emails") | has("aliases") | has("profile_urls") | has("handles")
    meant = many | has("handles") | has("emails") | has("aliases")
    inside = lambda c: _any(given(c), lambda x: F.contains(said, F.lower(x)))
    called = _any(given("phones"), lambda p: F.contains(T.digits(said), T.digits(p)))
    named = _true((name != "") & F.contains(said, name)) & (many | has("emails") | has("aliases"))
    apart = many & F.contains(said, first) & F.contains(said, last)
    slug = many & (F.length(first) >= 3) & (F.length(last) >= 3) & F.contains(F.lower(username), first) & F.contains(F.lower(username), last)
    known = meant & (inside("aliases") | inside("locations") | inside("organizations"))
    return _true(supplied | (ours & strong) | (strong & (named | apart | inside("emails") | called | known | slug)))
