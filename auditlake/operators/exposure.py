"""Risk, exposure by dimension, remediation and caps of a case's findings (case_id, ord, type, value, url, confidence float, risk, snippet, remediation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.operators.ordering import cap, keep_first

WEIGHT = {"Low": 25, "Medium": 50, "High": 80, "Critical": 100}
DIMENSIONS = ["Contact", "Identity", "Location", "Personal", "Professional", "Image"]
_BOTH = {"Email": "Contact Identity", "Phone": "Contact", "Address": "Location Personal", "Location": "Location Personal", "Username": "Identity", "UsernameReuse": "Identity", "Profile": "Professional Identity", "PlausibleProfileMatch": "Professional Identity", "Organization": "Professional", "PublicSearchEvidence": "Professional Personal", "PublicImageEvidence": "Professional Personal", "ImageConsistency": "Image", "SensitiveSnippet": "Personal Identity"}
BRIDGE = [(t, d) for t, ds in _BOTH.items() for d in ds.split()]
#: type -> (what is wrong, what to do where the finding itself doesn't say)
ADVICE = {
    "Email": ("An e-mail address is public", "Give a forwarding address in public."),
    "Phone": ("A phone number is public", "Take the number down; log in by an authenticator app."),
    "Location": ("A place of living is public", "Name a wider area only."),
    "Address": ("A postal address is public", "Take the address down."),
    "Username": ("One username on several sites", "Use another name on each site."),
    "UsernameReuse": ("One username on several sites", "Use another name on each site."),
    "Profile": ("A profile leads to the person", "Check who can see the profile."),
    "PlausibleProfileMatch": ("A profile may lead to the person", "Check who can see the profile."),
    "Organization": ("An employer or club is public", "Mention it to contacts only."),
    "PublicSearchEvidence": ("Search engines list the person", "Ask for the page's removal from the index."),
    "PublicImageEvidence": ("Image indexes list the person", "Ask for the picture's removal."),
    "ImageConsistency": ("One picture on several sites", "Use another picture on each site."),
    "SensitiveSnippet": ("A private detail is public", "Have the detail taken out."),
}
IMPACT = {"Critical": "opens accounts, or the door, to others", "High": "makes the person easy to find and to deceive", "Medium": "ties accounts together", "Low": "a matter of tidiness"}
#: tip -> the type that calls for it.
TIPS = {"email": "Email", "phone": "Phone", "location": "Location", "reuse": "UsernameReuse", "search": "PublicSearchEvidence", "images": "PublicImageEvidence", "avatars": "ImageConsistency"}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def weight(risk: Column) -> Column:
    return _map(WEIGHT)[risk]


def overall(findings: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, weight, risk): the worst finding; Low for a case without any."""
    worst = findings.groupBy("case_id").agg(F.max(weight(F.col("risk"))).alias("w"))
    w = F.coalesce("w", F.lit(25)).cast("long")
    back = _map({v: k for k, v in WEIGHT.items()})
    return cases.select("case_id").join(worst, "case_id", "left").select("case_id", w.alias("weight"), back[w.cast("int")].alias("risk"))


def dimensions(findings: DataFrame, cases: DataFrame, breaches: DataFrame | None = None) -> DataFrame:
    """(case_id, dimension, score, types): six rows for every case; 0 where nothing is found. A finding's type counts in each of its dimensions.

    A case with any breach (records or sources) is exposed by its first e-mail finding in Contact and Identity, or as High where it has none.
    """
    bridge = F.broadcast(findings.sparkSession.createDataFrame(BRIDGE, "type string, dimension string"))
    every = cases.select("case_id", F.explode(F.array(*map(F.lit, DIMENSIONS))).alias("dimension"))
    hits = findings.join(bridge, "type").select("case_id", "dimension", "type", weight(F.col("risk")).alias("w"))
    if breaches is not None:
        hurt = breaches.where("records > 0 or size(sources) > 0").select("case_id").distinct()
        first = findings.where("type = 'Email'").groupBy("case_id").agg(F.min_by("risk", "ord").alias("risk"))
        proxy = hurt.join(first, "case_id", "left").select("case_id", F.explode(F.array(F.lit("Contact"), F.lit("Identity"))).alias("dimension"), F.lit("Email").alias("type"), weight(F.coalesce("risk", F.lit("High"))).alias("w"))
        hits = hits.unionByName(proxy)
    got = hits.groupBy("case_id", "dimension").agg(F.max("w").alias("s"), F.count_distinct("type").alias("t"))
    return every.join(got, ["case_id", "dimension"], "left").select("case_id", "dimension", F.coalesce("s", F.lit(0)).cast("long").alias("score"), F.coalesce("t", F.lit(0)).alias("types"))


def exposed(dims: DataFrame) -> DataFrame:
    """(case_id, overall, touched): the greatest score of any dimension, and how many have one."""
    return dims.groupBy("case_id").agg(F.max("score").alias("overall"), F.count_if(F.col("score") > 0).alias("touched"))


def top(findings: DataFrame, most: int = 10) -> DataFrame:
    """A case's gravest findings by weight and whole percent of confidence, which is cut off as a float, not a double."""
    key = weight(F.col("risk")) * 100 + (F.col("confidence") * F.lit(100).cast("float")).cast("int")
    return cap(findings.withColumn("key", key.cast("long")), ["case_id"], [F.desc("key"), "ord"], most)


def tips(findings: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, tip): the tips that a case's types call for; `credentials` where a finding speaks of a breach or of MFA; `none` where nothing calls for any."""
    has = lambda c, w: F.coalesce(F.lower(c).contains(w), F.lit(False))
    flags = {k: F.col("type") == t for k, t in TIPS.items()} | {"credentials": has("snippet", "breach") | has("remediation", "mfa")}
    g = findings.groupBy("case_id").agg(*[F.bool_or(x).alias(k) for k, x in flags.items()])
    said = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in flags]))
    all_ = cases.select("case_id").join(g.select("case_id", said.alias("said")), "case_id", "left")
    return all_.select("case_id", F.explode(F.when(F.size(F.coalesce("said", F.array())) > 0, F.col("said")).otherwise(F.array(F.lit("none")))).alias("tip"))


def items(findings: DataFrame) -> DataFrame:
    """Findings with problem, evidence, what to do and what it would change, gravest first (rank)."""
    rank = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc(weight(F.col("risk"))), "ord"))
    fix = F.coalesce(F.nullif(F.trim("remediation"), F.lit("")), _map({k: v[1] for k, v in ADVICE.items()})[F.col("type")])
    return findings.select("case_id", rank.cast("long").alias("rank"), F.coalesce("snippet", "value").alias("evidence"), "risk", "type", fix.alias("fix"), _map({k: v[0] for k, v in ADVICE.items()})[F.col("type")].alias("problem"), _map(IMPACT)[F.col("risk")].alias("impact"))


def kept(findings: DataFrame, most: int = 500) -> DataFrame:
    """A case's first distinct findings by type, value and URL, in the order they came. (The original joins the three without a sign between them, so that some differing ones are one.)"""
    return cap(keep_first(findings, ["case_id", "type", "value", "url"], ["ord"]), ["case_id"], ["ord"], most)


def retained(findings: DataFrame, most: int = 500) -> DataFrame:
    """(case_id, kept, dropped): distinct findings up to the limit, and how many are beyond it."""
    n = keep_first(findings, ["case_id", "type", "value", "url"], ["ord"]).groupBy("case_id").agg(F.count("*").alias("n"))
    return n.select("case_id", F.least("n", F.lit(most)).alias("kept"), F.greatest(F.col("n") - most, F.lit(0)).alias("dropped"))
