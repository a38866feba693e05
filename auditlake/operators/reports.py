"""What a case comes to, as numbers, lines of text and a package with hashes. Every report is a row for each line, numbered, so that no text is put together in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.functions import fields as N
from auditlake.operators.exposure import weight
from auditlake.operators.ordering import keep_first

LINE, PAGE = 94, 62


def status(there: Column, verified: Column, said: Column) -> Column:
    return F.when(there & verified, "VERIFIED").when(there, "REVIEW").when(F.lower(said).contains("unverifiable"), "UNAVAILABLE").otherwise("NOT FOUND")


def counters(cases: DataFrame, profiles: DataFrame, breaches: DataFrame) -> DataFrame:
    """(case_id, verified, review, unavailable, records): a row for every case."""
    s = status(F.col("there"), F.col("verified"), F.coalesce("status", F.lit("")))
    p = profiles.groupBy("case_id").agg(*[F.count_if(s == k).alias(n) for n, k in (("verified", "VERIFIED"), ("review", "REVIEW"), ("unavailable", "UNAVAILABLE"))])
    b = breaches.groupBy("case_id").agg(F.sum("records").cast("long").alias("records"))
    return cases.select("case_id").join(p, "case_id", "left").join(b, "case_id", "left").na.fill(0)


def ordered(findings: DataFrame) -> DataFrame:
    """Adds rank, by risk, confidence and order, and key, the finding's own name."""
    rank = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc(weight(F.col("risk"))), F.desc("confidence"), "ord"))
    return findings.withColumn("rank", rank.cast("long")).withColumn("key", F.concat_ws("|", "type", "value", F.coalesce("url", F.lit(""))))


def percent(c: str) -> Column:
    """Whole percent, cut off as a float."""
    return (F.col(c) * F.lit(100).cast("float")).cast("int").cast("string")


def graph_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, part, ord, line): vertices by confidence, then edges; an end without a vertex is named by its id."""
    v = vertices.select("case_id", F.lit(0).alias("part"), F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("confidence"), "ord", "id")).cast("long").alias("ord"), F.concat("type", F.lit(": "), "label", F.lit(" ("), percent("confidence"), F.lit("%)")).alias("line"))
    names = vertices.select("case_id", "id", "label")
    e = edges.join(names.toDF("case_id", "src", "a"), ["case_id", "src"], "left").join(names.toDF("case_id", "dst", "b"), ["case_id", "dst"], "left")
    line = F.concat(F.coalesce("a", "src"), F.lit(" -"), "relation", F.lit("-> "), F.coalesce("b", "dst"), F.coalesce(F.concat(F.lit(" ["), "evidence", F.lit("]")), F.lit("")))
    return v.unionByName(e.select("case_id", F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), line.alias("line")))


def fallback_lines(findings: DataFrame, profiles: DataFrame) -> DataFrame:
    """(case_id, part, ord, line) without a graph: each finding once, then the profiles that exist."""
    f = keep_first(findings, ["case_id", "type", "value"], ["ord"]).select("case_id", F.lit(0).alias("part"), F.col("ord").cast("long").alias("ord"), F.concat("type", F.lit(": "), "value", F.lit(" ("), percent("confidence"), F.lit("%)")).alias("line"))
    p = profiles.where("there").select("case_id", F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), F.concat(F.lit("Profile: "), "url", F.lit(", "), status(F.col("there"), F.col("verified"), F.coalesce("status", F.lit("")))).alias("line"))
    return f.unionByName(p)


def breach_lines(breaches: DataFrame) -> DataFrame:
    """(case_id, ord, line) of breaches (case_id, ord, email, records, sources, note)."""
    more = F.when(F.size("sources") > 0, F.concat(F.lit(", "), F.array_join("sources", ", "))).otherwise("")
    return breaches.select("case_id", F.col("ord").cast("long").alias("ord"), F.concat("email", F.lit(": "), F.col("records").cast("string"), F.lit(" breach record(s)"), more, F.coalesce(F.concat(F.lit(", "), "note"), F.lit(""))).alias("line"))


def breach_finding_lines(findings: DataFrame) -> DataFrame:
    has = F.coalesce(F.lower("snippet").contains("breach"), F.lit(False)) | F.coalesce(F.lower("remediation").contains("mfa"), F.lit(False))
    return findings.where(has).select("case_id", F.col("ord").cast("long").alias("ord"), F.concat("value", F.lit(": "), F.coalesce("snippet", F.lit(""))).alias("line"))


def summary(cases: DataFrame, profiles: DataFrame, findings: DataFrame) -> DataFrame:
    """(case_id, verified, review, top, actions): the numbers of profiles, the five gravest findings and up to five different things to do, for a summary without any model."""
    p = profiles.groupBy("case_id").agg(F.count_if(F.expr("there and verified")).alias("verified"), F.count_if(F.expr("there and not verified")).alias("review"))
    best = ordered(findings).where("rank <= 5")
    line = F.concat("type", F.lit(": "), N.safe_field(F.col("value")), F.lit(" ("), percent("confidence"), F.lit("%, "), "risk", F.lit(")"))
    rows = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), F.trim("remediation").alias("fix"))))
    g = best.groupBy("case_id").agg(rows.alias("r"))
    top = F.array_join(F.transform("r", lambda x: x["line"]), " | ")
    fixes = F.array_join(F.array_distinct(F.transform("r", lambda x: x["fix"])), " | ")
    return cases.select("case_id").join(p, "case_id", "left").join(g.select("case_id", top.alias("top"), fixes.alias("actions")), "case_id", "left").select("case_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("verified", "review")], F.coalesce("top", F.lit("none")).alias("top"), F.coalesce("actions", F.lit("search deeper and check what is listed")).alias("actions"))


def report_lines(subjects: DataFrame, findings: DataFrame, profiles: DataFrame) -> DataFrame:
    """(case_id, part, ord, line) of the text report: head, findings by rank, profile checks. Subjects are (case_id, label)."""
    def fixed(part: int, ord_: int, line) -> DataFrame:
        return subjects.select("case_id", F.lit(part).alias("part"), F.lit(ord_).cast("long").alias("ord"), line.alias("line"))

    name = F.upper(F.left(F.regexp_replace("label", "[^A-Za-z0-9]", ""), F.lit(6)))
    head = [fixed(0, 0, F.lit("PRIVACY AUDIT")), fixed(0, 1, F.concat(F.lit("REPORT: PA-"), F.when(name == "", "SUBJECT").otherwise(name))), fixed(0, 2, F.concat(F.lit("SUBJECT: "), "label")), fixed(1, 0, F.lit("FINDINGS"))]
    f = ordered(findings)
    rows = F.array(F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "risk", F.lit(" "), "type"), F.concat(F.lit("    "), "value"), F.concat(F.lit("    from "), F.coalesce("url", F.lit("supplied or derived"))), F.concat(F.lit("    "), F.round(F.col("confidence").cast("double") * 100).cast("int").cast("string"), F.lit("% sure")))
    body = f.select("case_id", "rank", F.posexplode(rows).alias("i", "line")).select("case_id", F.lit(1).alias("part"), (F.col("rank") * 10 + F.col("i")).cast("long").alias("ord"), "line")
    p = profiles.select("case_id", F.lit(2).alias("part"), (F.col("ord") + 1).cast("long").alias("ord"), F.concat("platform", F.lit(": "), "url", F.lit(", "), status(F.col("there"), F.col("verified"), F.coalesce("status", F.lit("")))).alias("line"))
    return reduce(DataFrame.unionByName, [*head, body, fixed(2, 0, F.lit("PROFILES")), p])


def wrapped(lines: DataFrame, width: int = LINE, per_page: int = PAGE) -> DataFrame:
    """(case_id, page, row, line): lines broken at the last blank within the width, or at the width where there is none, in pages of so many rows."""
    from pyspark.sql.types import ArrayType, StringType

    @F.pandas_udf(ArrayType(StringType()))
    def broken(texts):
        def one(t: str) -> list[str]:
            out = []
            while len(t) > width:
                at = t.rfind(" ", 0, width + 1)
                at = at if at > 0 else width
                out.append(t[:at])
                t = t[at:].lstrip()
            return [*out, t]

        return texts.map(one)

    d = lines.select("case_id", "part", "ord", F.posexplode(broken("line")).alias("i", "line"))
    n = F.row_number().over(W.partitionBy("case_id").orderBy("part", "ord", "i"))
    return d.withColumn("n", n).select("case_id", (F.floor((F.col("n") - 1) / per_page) + 1).alias("page"), F.col("n").cast("long").alias("row"), "line")


def manifest(sections: DataFrame) -> DataFrame:
    """(case_id, sections, manifest) of sections (case_id, position, name, body): SHA-256 of each, and of their list as "name:hash" lines."""
    rows = F.array_sort(F.collect_list(F.struct("position", "name", F.sha2("body", 256).alias("hash"))))
    lines = F.array_join(F.transform("r", lambda x: F.concat(x["name"], F.lit(":"), x["hash"])), "\n")
    return sections.groupBy("case_id").agg(rows.alias("r")).select("case_id", lines.alias("sections"), F.sha2(lines, 256).alias("manifest"))


def sections(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """The sections of a case's package: its findings as JSON in their order, and the report's text."""
    json = F.to_json(F.struct("type", "value", "url", "risk"))
    f = findings.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ord", json.alias("j")))).alias("r")).select("case_id", F.lit(0).alias("position"), F.lit("findings").alias("name"), F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["j"]), ","), F.lit("]")).alias("body"))
    t = lines.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("part", "ord", "line"))).alias("r")).select("case_id", F.lit(1).alias("position"), F.lit("report").alias("name"), F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("body"))
    return f.unionByName(t)
