"""All queries over the reference's operators, with the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import text as T
from auditlake.functions import urls as U
from auditlake.functions import vectors as V
from auditlake.operators import discovery, pii
from auditlake.operators.ordering import keep_first
from auditlake.plans import audit, graphs, oracle, packages, rules  # noqa: F401
from auditlake.sources import tables as S
from auditlake.streaming import breaker

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _findings(s: SparkSession, d: str) -> DataFrame:
    return pii.findings(S.subject_pages(s, d), S.subjects(s, d))


def _r(c: str):
    return F.round(F.col(c).cast("double"), 6).alias(c)


# personal data


@query
def pii_email_findings(s, d):
    return pii.emails(S.table(s, d, "documents")).select("doc_id", "value", F.col("ord").cast("long").alias("ord"))


@query
def pii_email_attributed(s, d):
    texts = S.table(s, d, "documents").select("doc_id", "text").unionByName(S.subject_pages(s, d).select((-F.col("doc_id")).alias("doc_id"), "text"))
    return pii.attributed_emails(texts, S.subjects(s, d))


@query
def pii_phone_candidates(s, d):
    return pii.phones(S.subject_pages(s, d)).select("doc_id", F.col("start").cast("long").alias("start"), "raw", "digits", "context")


@query
def pii_document_numbers(s, d):
    return pii.phones(S.table(s, d, "documents")).select("doc_id", F.col("start").cast("long").alias("start"), "raw", "digits", "context")


@query
def pii_location_org(s, d):
    return pii.places(S.subject_pages(s, d)).select("doc_id", "type", "value", F.col("ord").cast("long").alias("ord"))


@query
def findings(s, d):
    return _findings(s, d).select("case_id", "ord", "type", "value", "url", _r("confidence"), "risk")


# URLs and pages


@query
def url_https(s, d):
    return S.table(s, d, "pages").select("page_id", U.ensure_https(F.regexp_replace("url", "^https?:", F.when(F.col("page_id") % 2 == 0, "http:").otherwise(""))).alias("url"))


@query
def url_canonical(s, d):
    return S.table(s, d, "pages").select("page_id", U.canonical_key(F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_source=A&q=1#x"))).alias("key"), U.host_and_path(F.col("url")).alias("place"))


@query
def url_registrable_domain(s, d):
    return S.table(s, d, "pages").groupBy(U.registrable_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


@query
def url_redirect_unwrap(s, d):
    p = S.table(s, d, "pages")
    href = F.concat(F.lit("https://search.example/l?uddg="), F.replace(F.replace(F.substring_index(F.substring_index("url", "?", 1), "#", 1), F.lit(":"), F.lit("%3A")), F.lit("/"), F.lit("%2F")), F.lit("&rut=1"))
    return p.select("page_id", U.unwrap_redirect(href).alias("target"))


@query
def html_title_links(s, d):
    return S.table(s, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<a [^>]*href="), F.lit(0))).cast("long").alias("links"))


@query
def page_states(s, d):
    return S.table(s, d, "pages").select("page_id", discovery.page_state(F.col("html")).alias("state"))


# discovery


@query
def discovery_metrics(s, d):
    one = S.table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    j = S.table(s, d, "documents").select("doc_id", "lang", F.expr("length(text) >= 400").alias("said")).join(one, "doc_id").withColumn("truth", F.expr("quality = 1"))
    return discovery.confusion(j, "said", "truth", ["lang"])


# identity


# breaches and cases


@query
def breach_prefix_join(s, d):
    h = F.upper(F.sha1(F.lower(F.trim("email"))))
    mine = S.subjects(s, d).where("authorized").select("subject_id", F.left(h, F.lit(5)).alias("prefix"), F.substr(h, F.lit(6)).alias("suffix"))
    return mine.join(S.breach_ranges(s, d), ["prefix", "suffix"], "left").select("subject_id", "prefix", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


# vectors, hashes, calibration


def _hashes(s, d):
    h = lambda k: F.expr(f"((vec_id * {k}) % 1000003) * 4294967 + (vec_id * {k + 2}) % 65537")
    return S.table(s, d, "embeddings").select("vec_id", h(7919).alias("p"), h(104729).alias("q"))


@query
def hash_similarity(s, d):
    return _hashes(s, d).select("vec_id", F.round(V.hash_similarity(F.col("p"), F.col("q")), 6).alias("similarity"))


@query
def duplicate_class(s, d):
    sim = V.hash_similarity(F.col("p"), F.col("q"))
    return _hashes(s, d).select("vec_id", V.duplicate_class(F.round(sim + 0.35, 6), F.col("vec_id") % 50 == 0).alias("class"))


# frames, events


@query
def label_mode(s, d):
    g = S.table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return g.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("first"))).alias("mode"), F.max("n").alias("n"))


@query
def frame_label_merge(s, d):
    g = S.table(s, d, "events").groupBy("user_id", F.lower("event_type").alias("label")).agg(F.max("value").alias("confidence"))
    from auditlake.operators.ordering import cap

    return cap(g, ["user_id"], [F.desc("confidence"), "label"], 8).select("user_id", "label", _r("confidence"))


@query
def frame_text_merge(s, d):
    t = S.table(s, d, "conversations").withColumn("clean", F.trim(F.regexp_replace("text", r"\s+", " "))).where("clean != ''")
    one = keep_first(t.select("conv_id", "turn", "clean"), ["conv_id", "lower(clean)"], ["turn", "clean"])
    rows = F.array_sort(F.collect_list(F.struct("turn", "clean")))
    return one.groupBy("conv_id").agg(F.left(F.array_join(F.transform(rows, lambda r: r["clean"]), " "), F.lit(1500)).alias("text"))


@query
def frame_timestamps(s, d):
    n = F.least(F.col("turns"), F.lit(5))
    c = S.table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    return c.select("conv_id", F.explode(F.array_distinct(F.expr("transform(sequence(1, cast(least(turns, 5) as int)), i -> cast(floor(turns * 1000 * i / (least(turns, 5) + 1)) as bigint))"))).alias("at_ms"))


def queries() -> dict[str, Query]:
    return QUERIES | audit.QUERIES


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.SQL.items() if k in QUERIES} | audit.SQL
