"""Personal data that a page shows of an identity: addresses, numbers, places, employers, names, and how surely they are theirs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import profiles as P
from auditlake.functions import text as T
from auditlake.operators.ordering import keep_first
from auditlake.operators.pii import rated
from auditlake.operators.search import _any, _true, phone_digits, terms

ORGANIZATIONS = sorted(["apple", "amazon", "anthropic", "azul", "azul systems", "github", "gitlab", "google", "iit delhi", "meta", "microsoft", "mit", "openai", "replit", "stanford"])
LOCATIONS = sorted(["bangalore", "bengaluru", "berlin", "chennai", "delhi", "gurgaon", "gurugram", "hyderabad", "india", "kolkata", "london", "mumbai", "new delhi", "new york", "noida", "paris", "pune"])
ORG_ENDS = tuple(f" {x}" for x in sorted("college corp inc labs llc ltd systems technologies university".split()))
LOCATION_ENDS = tuple(f" {x}" for x in sorted("city county district province state".split()))
AT_WORK = tuple(sorted(["developer at", "employed at", "engineer at", "member of", "studied at", "works at"]))
AT_HOME = tuple(sorted(["based in", "lives in", "located in", "location"]))


def url_names(url: str = "url") -> Column:
    """Whether a segment of the URL's path is a handle or alias of the identity."""
    segments = F.transform(F.split(P.path(F.col(url)), "/"), lambda s: F.lower(F.regexp_replace(s, "^@", "")))
    return _true(F.arrays_overlap(segments, terms("handles", "aliases")))


def signal_count(text: str = "text") -> Column:
    """Two for an address or number of the identity, one for name, handle, employer and place."""
    said = F.lower(text)
    inside = lambda c, least=1: _any(F.col(c), lambda x: (F.length(F.trim(x)) >= least) & F.contains(said, F.lower(F.trim(x)))).cast("int")
    name = F.lower(F.trim("full_name"))
    called = _any(phone_digits(), lambda p: F.contains(T.digits(F.col(text)), p)).cast("int")
    return _true((F.length(name) >= 3) & F.contains(said, name)).cast("int") + 2 * inside("emails") + 2 * called + _any(terms("handles", "aliases"), lambda h: F.contains(said, h)).cast("int") + inside("organizations", 3) + inside("locations", 3)


def same(items: str, value: Column) -> Column:
    return _any(F.col(items), lambda x: F.lower(F.trim(x)) == F.lower(F.trim(value)))


def place_type(value: Column, evidence: Column, preferred: str) -> Column:
    """Location or Organization: what the identity supplied, known names and endings, the words before it, else the preferred one."""
    low, said = F.lower(F.trim(value)), F.lower(evidence)
    ends = lambda xs: reduce(lambda a, b: a | b, [F.endswith(low, F.lit(x)) for x in xs])
    has = lambda xs: reduce(lambda a, b: a | b, [said.contains(x) for x in xs])
    return F.when(same("organizations", value), "Organization").when(same("locations", value), "Location").when(low.isin(ORGANIZATIONS) | ends(ORG_ENDS), "Organization").when(low.isin(LOCATIONS) | ends(LOCATION_ENDS), "Location").when(has(AT_WORK), "Organization").when(has(AT_HOME), "Location").otherwise(preferred)


def canonical_value(type_: Column, value: Column) -> Column:
    return F.when(type_ == "Phone", T.digits(value)).otherwise(F.lower(F.trim(value)))


def _term(text: Column, value: Column) -> Column:
    """Whether the value stands in the text, between characters that are no letters or digits."""
    quoted = F.concat(F.lit(r"(?i)(?<![\p{L}0-9])\Q"), value, F.lit(r"\E(?![\p{L}0-9])"))
    return (F.length(value) >= 2) & F.rlike(text, quoted)


def extract(pages: DataFrame, identities: DataFrame, key: str = "subject_id") -> DataFrame:
    """(key, url, ord, type, value, confidence float, risk) of pages (key, url, text) of consenting identities; of equal values the first. An empty text has none.

    An address or number that the identity supplied is their own (tier 0); others count more where the page speaks of them otherwise (tier 1: a handle in its URL, or two signals).
    Numbers that they didn't supply need a word nearby, or a plus. Then names, aliases, and supplied places and employers, where they stand as words.
    """
    d = pages.join(identities, key).withColumns({"by_url": url_names(), "signs": signal_count()}).withColumn("strong", F.col("by_url") | (F.col("signs") >= 2))
    ids = [key, "url"]
    tier = lambda own: F.when(own, 0).when(F.col("strong"), 1).otherwise(2)

    def at(base: int) -> Column:
        return (F.lit(base) + F.col("i")).cast("long").alias("ord")

    mails = d.select("*", F.posexplode(F.regexp_extract_all("text", F.lit(T.EMAIL), F.lit(0))).alias("i", "value"))
    mails = mails.select(*ids, at(0), F.lit("Email").alias("type"), "value", tier(same("emails", F.col("value"))).alias("tier"))
    calls = d.select("*", F.posexplode(T.spans(F.col("text"), T.PHONE)).alias("i", "m")).withColumn("value", F.trim("m.value")).withColumn("n", T.digits(F.col("m.value")))
    own = F.coalesce(F.array_contains(phone_digits(), F.col("n")), F.lit(False))
    near = T.snippet(F.col("text"), F.col("m.start"), F.length("m.value")).rlike(T.PHONE_CONTEXT) | F.startswith("value", F.lit("+"))
    calls = calls.where(F.length("n").between(8, 15) & ~T.date_or_counter(F.col("m.value")) & (own | near)).select(*ids, at(100_000), F.lit("Phone").alias("type"), "value", tier(own).alias("tier"))

    def places(pattern: str, preferred: str, base: int) -> DataFrame:
        m = d.select("*", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("i", "said"))
        m = m.withColumn("value", F.regexp_replace(F.trim(F.regexp_extract("said", pattern, 1)), "[.,;:]+$", "")).withColumn("type", place_type(F.col("value"), F.col("said"), preferred))
        mine = F.when(F.col("type") == "Location", same("locations", F.col("value"))).otherwise(same("organizations", F.col("value")))
        return m.select(*ids, at(base), "type", "value", tier(mine).alias("tier"))

    seen = rated(mails.unionByName(calls).unionByName(places(T.LOCATION, "Location", 200_000)).unionByName(places(T.ORGANIZATION, "Organization", 300_000)))
    seen = seen.select(*ids, "ord", "type", "value", "confidence", F.when((F.col("type") == "Location") & (F.col("tier") == 0), "High").otherwise(F.col("risk")).alias("risk"))

    def exposed(items: Column, label: str, base: int, confidence: Column, risk: Column) -> DataFrame:
        m = d.select("*", F.posexplode(items).alias("i", "said")).withColumn("said", F.trim("said")).where(_term(F.col("text"), F.col("said")))
        return m.select(*ids, at(base), F.lit("SensitiveSnippet").alias("type"), F.concat(F.lit(label + ": "), "said").alias("value"), confidence.cast("float").alias("confidence"), risk.alias("risk"))

    many, by = F.col("signs") >= 2, F.col("by_url")
    name = exposed(F.array("full_name"), "Name Exposure", 400_000, F.when(many, 0.95).otherwise(0.65), F.when(many, "High").otherwise("Medium"))
    alias = exposed(F.col("aliases"), "Alias Exposure", 500_000, F.when(by, 0.90).otherwise(0.62), F.when(by, "Medium").otherwise("Low"))

    def supplied(items: str, type_: str, risk: str, base: int) -> DataFrame:
        m = d.select("*", F.posexplode(items).alias("i", "said")).withColumn("value", F.trim("said")).where(_term(F.col("text"), F.col("value")))
        return m.select(*ids, at(base), F.lit(type_).alias("type"), "value", F.when(F.col("strong"), 0.92).otherwise(0.80).cast("float").alias("confidence"), F.lit(risk).alias("risk"))

    every = reduce(DataFrame.unionByName, [seen, name, alias, supplied("locations", "Location", "High", 600_000), supplied("organizations", "Organization", "Medium", 700_000)])
    every = every.where(F.trim("value") != "").withColumn("canonical", canonical_value(F.col("type"), F.col("value")))
    return keep_first(every, [*ids, "type", "canonical"], ["ord"]).drop("canonical")
