"""Personal data in texts: e-mail addresses, phone numbers, places, employers, and what is attributed to whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text as T
from auditlake.operators.ordering import keep_first

#: type -> ((confidence, risk) where it is the subject's own, where the page is theirs, elsewhere)
LADDER = {
    "Email": ((0.99, "High"), (0.72, "Medium"), (0.42, "Low")),
    "Phone": ((0.99, "Critical"), (0.68, "High"), (0.36, "Low")),
    "Location": ((0.90, "High"), (0.64, "Medium"), (0.44, "Low")),
    "Organization": ((0.90, "Medium"), (0.64, "Medium"), (0.44, "Low")),
}


def emails(docs: DataFrame) -> DataFrame:
    """(doc_id, value): each address of a text once, whatever its case; the first spelling by order in the text. Null texts have none."""
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(T.EMAIL), F.lit(0))).alias("ord", "value"))
    return keep_first(found, ["doc_id", "lower(value)"], ["ord", "value"]).select("doc_id", "value", "ord")


def phones(docs: DataFrame) -> DataFrame:
    """(doc_id, start, raw, digits, context): spans of 8 to 15 digits that are no date or counter, and whether a word nearby, or a plus, says that it is a number to call."""
    found = docs.select("doc_id", "text", F.explode(T.spans(F.col("text"), T.PHONE)).alias("m")).select("doc_id", "text", "m.*")
    d = T.digits(F.col("value"))
    near = T.snippet(F.col("text"), F.col("start"), F.length("value"))
    good = found.where(F.length(d).between(8, 15) & ~T.date_or_counter(F.col("value")))
    return good.select("doc_id", "start", F.col("value").alias("raw"), d.alias("digits"), (near.rlike(T.PHONE_CONTEXT) | F.startswith("value", F.lit("+"))).alias("context"))


def places(docs: DataFrame) -> DataFrame:
    """(doc_id, type, value, ord) of places and organizations named after words such as "lives in" and "works at"."""
    each = lambda rx, kind: docs.select("doc_id", F.lit(kind).alias("type"), F.posexplode(F.regexp_extract_all("text", F.lit(rx), F.lit(1))).alias("ord", "raw"))
    both = each(T.LOCATION, "Location").unionByName(each(T.ORGANIZATION, "Organization"))
    return keep_first(both.select("doc_id", "type", T.trimmed(F.col("raw")).alias("value"), "ord"), ["doc_id", "type", "lower(value)"], ["ord", "value"])


def rated(found: DataFrame) -> DataFrame:
    """Adds confidence and risk to (type, tier); tier 0 is the subject's own value, 1 on a page about them, 2 any other."""
    keys = [(k, i, c, r) for k, v in LADDER.items() for i, (c, r) in enumerate(v)]
    ladder = found.sparkSession.createDataFrame(keys, "type string, tier int, confidence float, risk string")
    return found.join(F.broadcast(ladder), ["type", "tier"])


def attributed_emails(docs: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, value, subject_id, confidence, risk) of all addresses: tier 0 where it is that of a subject who consented, else no subject and the lowest tier."""
    mine = subjects.where("authorized").select(F.lower("email").alias("key"), "subject_id")
    found = emails(docs).join(mine, F.lower("value") == F.col("key"), "left")
    return rated(found.select("doc_id", "value", "subject_id", F.lit("Email").alias("type"), F.when(F.col("subject_id").isNull(), 2).otherwise(0).alias("tier"))).select("doc_id", "value", "subject_id", F.round(F.col("confidence").cast("double"), 6).alias("confidence"), "risk")


def findings(pages: DataFrame, subjects: DataFrame) -> DataFrame:
    """(case_id, ord, type, value, url, confidence float, risk) of the consenting subjects' own pages."""
    ours = pages.join(subjects.where("authorized").select(F.col("subject_id").alias("doc_id")), "doc_id", "left_semi")
    parts = [
        emails(ours).select("doc_id", F.lit(0).alias("kind"), "ord", F.lit("Email").alias("type"), "value"),
        phones(ours).where("context").select("doc_id", F.lit(1).alias("kind"), F.col("start").alias("ord"), F.lit("Phone").alias("type"), F.col("raw").alias("value")),
        places(ours).select("doc_id", F.when(F.col("type") == "Location", 2).otherwise(3).alias("kind"), "ord", "type", "value"),
    ]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(ours.select("doc_id", "url"), "doc_id")
    tier = F.when((F.col("type") == "Phone") & ~F.startswith("value", F.lit("+")), 2).when(F.col("type").isin("Email", "Phone"), 0).otherwise(1)
    return rated(found.withColumn("tier", tier)).select(F.col("doc_id").alias("case_id"), (F.col("kind") * 100000 + F.col("ord")).cast("long").alias("ord"), "type", "value", "url", "confidence", "risk")
