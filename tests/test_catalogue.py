"""Every query of the catalogue beside its SQL, over whole tables."""

import pytest

from auditlake.plans import catalogue

from .compare import oracle as run_sql
from .compare import spark_rows

FOLDER = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, name):
    assert spark_rows(catalogue.queries()[name](spark, FOLDER)) == run_sql(FOLDER, SQL[name])


def test_queries_without_sql_are_few_and_named():
    assert sorted(set(catalogue.queries()) - set(SQL)) == ["bootstrap_intervals", "cached_requests", "circuit_breaker_states", "evidence_package", "html_text", "image_page_hits", "pii_document_numbers", "report_text", "search_page_hits"]


def _rows(spark, name):
    return [r.asDict() for r in catalogue.queries()[name](spark, FOLDER).collect()]


def _events(spark):
    rows = spark.read.parquet(f"{FOLDER}/events.parquet").collect()
    return sorted(rows, key=lambda r: (r.user_id, r.ts, r.event_id))


def test_breaker_against_a_plain_one(spark):
    want, state = {}, {}
    for r in _events(spark):
        t = r.ts.timestamp()
        failures, until = state.get(r.user_id, (0, 0))
        if until and t >= until:
            failures, until = 0, 0
        want[r.event_id] = (failures, not until)
        if not until:
            failures = failures + 1 if r.event_type == "error" else 0
            until = t + 86_400 if failures >= 3 else 0
        state[r.user_id] = (failures, until)
    assert {r["event_id"]: (r["failures"], r["allowed"]) for r in _rows(spark, "circuit_breaker_states")} == want


def test_cache_against_a_plain_one(spark):
    want, held = {}, {}
    for r in _events(spark):
        t = r.ts.timestamp()
        want[r.event_id] = r.user_id in held and t - held[r.user_id] < 86_400
        if not want[r.event_id]:
            held[r.user_id] = t
    assert {r["event_id"]: r["hit"] for r in _rows(spark, "cached_requests")} == want


def test_bootstrap_holds_the_rate(spark):
    got = {r["same"]: r for r in _rows(spark, "bootstrap_intervals")}
    for r in got.values():
        sd = (r["rate"] * (1 - r["rate"]) / r["pairs"]) ** 0.5
        assert r["low"] < r["rate"] < r["high"] and r["high"] - r["low"] == pytest.approx(2 * 1.96 * sd, rel=0.15)


def test_numbers_against_plain_matching(spark):
    import re

    from auditlake.functions import text as T

    want = set()
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect():
        for m in re.finditer(T.PHONE, r.text or ""):
            n = re.sub("[^0-9]", "", m.group())
            dated = len(n) == 8 and 1900 <= int(n[:4]) <= 2100 or len(re.sub("[^-/]", "", m.group())) >= 2 and "+" not in m.group() or len(set(n)) == 1
            if 8 <= len(n) <= 15 and not dated:
                want.add((r.doc_id, m.start() + 1, m.group()))
    assert {(r["doc_id"], r["start"], r["raw"]) for r in _rows(spark, "pii_document_numbers")} == want


def test_reports_hold_every_finding_within_the_width(spark):
    lines = _rows(spark, "report_text")
    assert max(len(r["line"]) for r in lines) <= 94 and all(r["page"] == (r["row"] - 1) // 62 + 1 for r in lines)
    said = {}
    for r in sorted(lines, key=lambda r: (r["case_id"], r["row"])):
        said[r["case_id"]] = said.get(r["case_id"], "") + r["line"].strip() + " "
    for r in _rows(spark, "top_findings"):
        assert " ".join(r["value"].split()) in " ".join(said[r["case_id"]].split())


def test_package_hashes_are_those_of_the_sections(spark):
    import hashlib

    from auditlake.operators import reports
    from auditlake.plans import packages
    from auditlake.sources.fixtures import fixture

    bodies = reports.sections(fixture(spark, FOLDER, "finding"), packages._lines(spark, FOLDER)).collect()
    for r in _rows(spark, "evidence_package"):
        own = sorted((b.position, b.name, b.body) for b in bodies if b.case_id == r["case_id"])
        lines = "\n".join(f"{n}:{hashlib.sha256(b.encode()).hexdigest()}" for _, n, b in own)
        assert r["sections"] == lines and r["manifest"] == hashlib.sha256(lines.encode()).hexdigest()


def test_page_text_against_plain_stripping(spark):
    import html
    import re

    got = {r["page_id"]: r for r in _rows(spark, "html_text")}
    for p in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        bare = re.sub(r"(?is)<(script|style|noscript|svg|template)\b.*?</\1>|<!--.*?-->", " ", p.html)
        body = re.sub(r"(?is)^.*?<body[^>]*>|</body>.*$", "", bare)
        words = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        assert "".join(got[p.page_id]["text"].split())[:2000] == "".join(words)[:2000]


def test_hits_of_result_pages_are_those_put_in(spark):
    from auditlake.functions import urls as U
    from auditlake.sources.fixtures import fixture
    from pyspark.sql import functions as F

    want = {(r.subject_id, r.k) for r in fixture(spark, FOLDER, "hit").select("subject_id", U.canonical_key(F.col("url")).alias("k"), "url").collect() if "yandex.com" not in r.url}
    rows = catalogue.queries()["search_page_hits"](spark, FOLDER)
    got = {(r.page_id, r.k) for r in rows.select("page_id", U.canonical_key(F.col("url")).alias("k")).collect()}
    assert got == want and rows.where("trim(title) = '' or length(title) > 160").count() == 0
    pictures = catalogue.queries()["image_page_hits"](spark, FOLDER)
    assert pictures.count() == 3 * fixture(spark, FOLDER, "ident").count() and pictures.where("thumbnail is null or title != 'Picture'").count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["case_id", "dimension", "score", "types"]
    assert set(e.oracle_sql()) <= set(e.queries())
