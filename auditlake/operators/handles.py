"""Handles that a page's owner names: links to other profiles, then mentions in the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import profiles as P
from auditlake.functions import text as T
from auditlake.operators.ordering import keep_first

CONFIDENCE = (0.7, 0.6)  # of a link, of a mention


def links_in(text):
    """URLs of a text, without the punctuation that follows them."""
    return F.transform(F.regexp_extract_all(text, F.lit(T.URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[,.)\]};:!]+$", ""))


def mentions(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, handle, platform): "platform as handle" phrases first, then @handles with a platform's name within 40 characters; each (handle, platform) of a page once, whatever its case.

    Both are read from the text itself, links included. (The original reads its window from a copy without links, by the places of the text with
    them; here both are one text.)
    """
    said = pages.select(*keys, F.posexplode(T.spans(F.col("text"), P.mention_phrases())).alias("i", "m")).select(*keys, F.col("i").cast("long").alias("ord"), F.regexp_extract("m.value", P.mention_phrases(), 2).alias("handle"), P.platform_of_word(F.col("m.value")).alias("platform"))
    bare = pages.select(*keys, "text", F.posexplode(T.spans(F.col("text"), "(?i)@[a-z0-9._-]{2,30}")).alias("i", "m"))
    lo = F.greatest(F.col("m.start") - 40, F.lit(1))
    window = F.substr("text", lo, F.col("m.start") + F.length("m.value") + 39 - lo)
    near = bare.select(*keys, (F.col("i") + 1_000_000).cast("long").alias("ord"), F.substr("m.value", F.lit(2)).alias("handle"), P.platform_nearby(window).alias("platform"))
    both = said.unionByName(near).where("platform is not null and length(handle) between 2 and 40").where(~P.no_profile_handle(F.col("handle")))
    return keep_first(both, [*keys, "lower(handle)", "platform"], ["ord"])


def pivots(pages: DataFrame, scanned: DataFrame, platforms: DataFrame, key: str = "subject_id") -> DataFrame:
    """(key, source, username, platform, url, confidence, provenance): profiles that pages (key, url, text) name and nobody has looked at, each URL of a page once; links before mentions."""
    d = pages.select(key, F.col("url").alias("source"), "text", F.coalesce(P.resolved(F.col("url"))["platform"], F.lit("Website")).alias("label"))
    linked = d.select(key, "source", "label", F.posexplode(links_in(F.col("text"))).alias("ord", "link")).withColumn("r", P.resolved(F.col("link"))).where("r is not null")
    a = linked.select(key, "source", "label", F.col("ord").cast("long").alias("ord"), F.col("r.handle").alias("username"), "r.platform", "r.url", F.lit(CONFIDENCE[0]).alias("confidence"))
    p = F.broadcast(platforms.select("platform", "pattern"))
    m = mentions(d, [key, "source", "label"]).join(p, "platform")
    b = m.select(key, "source", "label", (F.col("ord") + 10_000_000).alias("ord"), F.col("handle").alias("username"), "platform", F.replace("pattern", F.lit("{u}"), F.col("handle")).alias("url"), F.lit(CONFIDENCE[1]).alias("confidence"))
    found = a.unionByName(b).where("length(username) between 2 and 40").where(~P.no_profile_handle(F.col("username"))).withColumn("k", F.lower("url")).where(F.col("k") != F.lower("source"))
    fresh = found.join(scanned.select(key, F.lower("url").alias("k")), [key, "k"], "left_anti")
    one = keep_first(fresh.drop("k"), [key, "source", "lower(url)"], ["ord"])
    return one.select(key, "source", "username", "platform", "url", "confidence", F.concat(F.lit("named on a "), "label", F.lit(" page")).alias("provenance"), "ord")
