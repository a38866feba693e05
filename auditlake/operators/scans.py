"""Rows of scanned profiles: their confidence, what a hit or picture makes of them, and the evidence they give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import fields as N
from auditlake.functions import profiles as P
from auditlake.functions import urls as U
from auditlake.operators.ordering import cap, keep_first

#: match -> confidence, by where a candidate comes from.
BASE = {
    "handle": {"Exact": 1.0, "": 0.8},
    "email": {"Exact": 0.85, "Fuzzy": 0.65, "": 0.75},
    "name": {"Exact": 0.90, "Dot": 0.85, "Underscore": 0.85, "Hyphen": 0.80, "Fuzzy": 0.65, "": 0.75},
    "word": {"Exact": 0.35, "": 0.20},
    "url": {"": 1.0},
}


def base_confidence(seed: Column, match: Column) -> Column:
    table = F.create_map(*[F.lit(x) for s, d in BASE.items() for m, v in d.items() for x in (f"{s}:{m}", v)])
    return F.coalesce(table[F.concat_ws(":", seed, match)], table[F.concat(seed, F.lit(":"))])


def profile_confidence(base: Column, name: Column, text: Column, title: Column, username: Column, findings: Column) -> Column:
    """A profile's confidence after it was read: more for name, parts of it, its title, its handle, and each finding (0.05, 0.20 at most); never above 1. An empty text adds nothing."""
    has = lambda t, x: F.coalesce(F.contains(F.lower(t), F.lower(x)) & (x != ""), F.lit(False))
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    many, first, last = F.size(words) > 1, F.get(words, F.lit(0)), F.try_element_at(words, F.lit(-1))
    a, b = has(text, first), many & has(text, last)
    named = F.when(has(text, F.trim(name)) & many, 0.15).when(a & b, 0.10).when(a & many, 0.05).when(~many & a, 0.02).otherwise(0.0)
    slug = many & has(username, first) & has(username, last)
    more = named + has(title, username).cast("int") * 0.08 + slug.cast("int") * 0.03 + F.least(findings * 0.05, F.lit(0.20))
    return F.when(F.coalesce(F.trim(text) != "", F.lit(False)), F.least(F.lit(1.0), base + more)).otherwise(base)


def profile_risk(confidence: Column) -> Column:
    return F.when(confidence > 0.85, "High").when(confidence > 0.70, "Medium").otherwise("Low")


def soft_confidence(base: Column) -> Column:
    """Of an account that exists but isn't known to be the identity's."""
    return F.greatest(F.lit(0.1), F.least(F.lit(0.35), base * 0.25))


def from_hits(hits: DataFrame, key: str = "subject_id") -> tuple[DataFrame, DataFrame]:
    """(profiles, findings) of search hits (key, ord, url, title, snippet, sources, score): nothing of them is verified. A hit whose URL is a profile's is a plausible match besides."""
    r = P.resolved(F.col("url"))
    d = hits.withColumn("r", r).withColumns({"at": F.coalesce("r.url", "url"), "platform": F.coalesce("r.platform", F.lit("Website")), "username": F.coalesce("r.handle", P.bare_host(F.col("url")), F.lit("web"))})
    profiles = d.select(key, "ord", F.col("at").alias("url"), "platform", "username", F.nullif(F.trim("title"), F.lit("")).alias("title"), "score", F.lit(False).alias("verified"), F.when(F.col("r").isNotNull(), "plausible").otherwise("indexed").alias("status"))
    row = lambda t, v, risk: F.struct(F.lit(t).alias("type"), v.alias("value"), risk.alias("risk"))
    found = F.array_compact(F.array(F.when(F.col("r").isNotNull(), row("PlausibleProfileMatch", F.col("at"), F.when(F.col("score") >= 0.70, "Medium").otherwise("Low"))), row("PublicSearchEvidence", F.coalesce(F.nullif(F.trim("title"), F.lit("")), "at"), F.when(F.col("score") >= 0.75, "Medium").otherwise("Low"))))
    findings = d.select(key, "ord", "at", "score", F.posexplode(found).alias("i", "f")).select(key, (F.col("ord") * 10 + F.col("i")).cast("long").alias("ord"), "f.type", "f.value", F.col("at").alias("url"), F.col("score").alias("confidence"), "f.risk")
    return profiles, findings


def snippet_confidence(confidence: Column, score: Column) -> Column:
    """Of personal data in a hit's text: as sure as both, 0.35 at least."""
    return F.greatest(F.lit(0.35), confidence * score)


def image_score(name: str = "full_name") -> Column:
    """Of a picture (title, image, page, query) found for an identity: 0.10, name 0.28, all parts 0.16, a handle 0.18 and in the page's address 0.12, a known host 0.08, a query for pictures 0.05; 0.90 at most."""
    said, who = F.lower(F.concat_ws(" ", "title", "image", "page")), F.lower(F.trim(name))
    parts = F.filter(F.split(who, r"\s+"), lambda w: F.length(w) >= 3)
    users = F.filter(F.transform(F.concat("handles", "aliases"), lambda h: F.lower(P.clean(h))), lambda h: F.length(h).between(2, 40))
    yes = lambda c, w: F.coalesce(c, F.lit(False)).cast("int") * w
    visual = [h for h in P.EXPOSURE_HOSTS if h in ("dev.to", "github.com", "instagram.com", "linkedin.com", "medium.com", "reddit.com", "twitch.tv", "twitter.com", "x.com", "youtube.com")]
    total = 0.10 + yes((who != "") & F.contains(said, who), 0.28) + yes((F.size(parts) >= 2) & F.forall(parts, lambda w: F.contains(said, w)), 0.16) + yes(F.exists(users, lambda h: F.contains(said, h)), 0.18) + yes(F.exists(users, lambda h: F.contains(F.lower("page"), h)), 0.12)
    return F.least(F.lit(0.90), total + yes(P._on(P.bare_host(F.col("page")), visual), 0.08) + yes(F.lower("query").contains("avatar") | F.lower("query").contains("profile photo"), 0.05))


def ranked_images(images: DataFrame, key: str = "subject_id", least: float = 0.0, most: int = 18) -> DataFrame:
    """Pictures by score, source and title, one of each image and page, `most` of an identity."""
    pair = N.pair_key(U.canonical_key(F.col("image")), U.canonical_key(F.col("page")))
    one = keep_first(images.where(F.col("score") >= least).withColumn("pair", pair), [key, "pair"], ["ord"])
    return cap(one, [key], [F.desc("score"), "source", "title", "pair"], most)


def image_rows(images: DataFrame, surfaced: DataFrame, key: str = "subject_id") -> DataFrame:
    """(key, title, page, thumbnail, score, risk) of pictures as evidence; one without its own thumbnail or image goes where its page has surfaced (key, url) already."""
    known = surfaced.select(key, U.canonical_key(F.col("url")).alias("place"), F.lit(True).alias("known")).distinct()
    d = images.withColumn("place", U.canonical_key(F.col("page"))).withColumn("picture", F.coalesce("thumbnail", "image")).join(known, [key, "place"], "left")
    d = keep_first(d.where("known is null or picture is not null"), [key, "coalesce(picture, '')", "place"], ["ord"])
    return d.select(key, F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Public image result")).alias("title"), "page", F.col("picture").alias("thumbnail"), "score", F.when(F.col("score") >= 0.65, "Medium").otherwise("Low").alias("risk"))


def picked_images(profiles: DataFrame, most: int = 12) -> DataFrame:
    """The profiles (case_id, ord, url, image, there, verified, confidence) whose pictures are worth a look: verified ones first, then by confidence."""
    return cap(profiles.where("there and trim(image) != ''"), ["case_id"], [F.desc("verified"), F.desc("confidence"), "ord"], most).select("case_id", "url", "image")


def evidence(profiles: DataFrame, findings: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence, relations) of profiles (case_id, ord, url, username, platform, there, verified, confidence), their findings (case_id, ord, type, value, url: the profile's, confidence, risk) and seeds (case_id, ord, kind, value); the first of each id, and of each (source, target, relation)."""
    c = F.col
    none = F.lit(None).cast("string")
    a = profiles.select("case_id", (c("ord") * 1000).cast("long").alias("ord"), F.concat(F.lit("profile:"), "url").alias("id"), F.lit("Profile").alias("type"), c("url").alias("value"), "url", c("confidence").cast("float").alias("confidence"), F.when(c("verified") & c("there"), "High").otherwise("Low").alias("risk"))
    met = findings.join(profiles.select("case_id", "url", c("ord").alias("p"), "there"), ["case_id", "url"])
    b = met.select("case_id", (c("p") * 1000 + 1 + c("ord")).cast("long").alias("ord"), N.evidence_id(c("type"), c("value"), c("url")).alias("id"), "type", "value", "url", c("confidence").cast("float").alias("confidence"), "risk")
    s = seeds.where("kind in ('Email', 'Phone', 'Username')").select("case_id", (c("ord") + 100_000_000).cast("long").alias("ord"), F.concat(F.lit("seed:"), F.lower("kind"), F.lit(":"), "value").alias("id"), c("kind").alias("type"), "value", none.alias("url"), F.lit(1.0).cast("float").alias("confidence"), F.lit("Low").alias("risk"))
    named = profiles.where("trim(username) != '' and username not in ('unknown', 'web')").select("case_id", (c("ord") * 1000).cast("long").alias("ord"), c("username").alias("source"), c("url").alias("target"), F.lit("username_on_profile").alias("relation"), c("platform").alias("evidence"))
    seen = met.select("case_id", (c("p") * 1000 + 1 + c("ord")).cast("long").alias("ord"), c("url").alias("source"), c("value").alias("target"), F.lit("mentions").alias("relation"), c("type").alias("evidence"))
    return keep_first(reduce(DataFrame.unionByName, [a, b, s]), ["case_id", "id"], ["ord"]), keep_first(named.unionByName(seen), ["case_id", "source", "target", "relation"], ["ord"])


def observed(seeds: DataFrame, findings: DataFrame) -> DataFrame:
    """(case_id, ord, type, value) that edges are scored with: seeds, then findings; the first of each kind and value, whatever its case."""
    a = seeds.where("kind in ('Email', 'Phone', 'Username')").select("case_id", F.col("ord").cast("long").alias("ord"), F.col("kind").alias("type"), "value")
    b = findings.select("case_id", (F.col("ord") + 1_000_000).cast("long").alias("ord"), "type", "value")
    return keep_first(a.unionByName(b), ["case_id", "type", "lower(value)"], ["ord"])


def breach_rows(checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digests, findings) of checked addresses (case_id, ord, email, titles, pages: arrays, error): a High finding where any breach is known, a Medium one where a page mentions the address; each address of a case once, whatever its case."""
    one = keep_first(checks.withColumn("email", F.trim("email")).where("email != ''"), ["case_id", "lower(email)"], ["ord"])
    n, hits = F.size("titles"), F.size("pages")
    digests = one.select("case_id", "email", n.cast("long").alias("records"), F.array_distinct(F.concat("titles", "pages")).alias("sources"), F.col("error").alias("note"))
    known = F.struct(F.lit("Email").alias("type"), F.lit(0.95).alias("confidence"), F.lit("High").alias("risk"), F.lit(None).cast("string").alias("url"), F.concat(F.lit("in "), n.cast("string"), F.lit(" breaches: "), F.array_join(F.slice("titles", 1, 5), ", ")).alias("snippet"))
    said = F.struct(F.lit("SensitiveSnippet").alias("type"), F.lit(0.55).alias("confidence"), F.lit("Medium").alias("risk"), F.get("pages", F.lit(0)).alias("url"), F.trim(F.concat(F.lit("on "), hits.cast("string"), F.lit(" pages "), F.coalesce("error", F.lit("")))).alias("snippet"))
    f = one.withColumn("f", F.when(n > 0, known).when(hits > 0, said)).where("f is not null")
    return digests, f.select("case_id", "f.type", F.col("email").alias("value"), "f.url", "f.confidence", "f.risk", "f.snippet")
