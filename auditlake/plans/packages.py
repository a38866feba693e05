"""Queries over snapshots, reports, breaches and stored bodies, each beside its SQL where SQL can read such bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import profiles as P
from auditlake.operators import cases, exposure, identity, reports, scans
from auditlake.plans.audit import PIVOT, _pivots, _r, cte, fixture, identities, path, q, query
from auditlake.plans.graphs import GRAPH, WEIGHT, graph, parts
from auditlake.sources import parsers
from auditlake.sources import tables as S

# pivots in two hops: those named on pages read first, and on the rest


@query(f"WITH {PIVOT}, h AS (SELECT subject_id, CASE WHEN starts_with(url, 'https://github.com') THEN 0 ELSE 1 END AS hop, profile AS url, o AS ord FROM fresh), k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY subject_id, lower(url) ORDER BY hop, ord) = 1) SELECT subject_id, hop, url FROM k QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY hop, ord, url) <= 4")
def pivot_budget(s, d):
    p = _pivots(s, d).select("subject_id", F.when(F.startswith("source", F.lit("https://github.com")), 0).otherwise(1).cast("long").alias("hop"), "url", "ord")
    return identity.budgeted(p, p.limit(0), 4).select("subject_id", "hop", "url")


# snapshots: the findings, and what a later scan found

LATER = """later AS (SELECT case_id, ord, type, value, url, CASE WHEN type = 'Location' THEN CAST(0.64 AS FLOAT) ELSE confidence END AS confidence, CASE WHEN type = 'Phone' AND risk = 'Low' THEN 'High' ELSE risk END AS risk FROM finding WHERE type <> 'Email'
    UNION ALL SELECT case_id, ord + 100, type, lower(value), url, confidence, risk FROM finding WHERE type = 'Organization' UNION ALL SELECT case_id, ord + 200, type, lower(value), url, confidence, risk FROM finding WHERE type = 'Organization')"""


def _later(s, d):
    f = fixture(s, d, "finding")
    return f, s.sql("SELECT * FROM (WITH " + LATER.replace("FROM finding", "FROM {finding}") + " SELECT * FROM later)", finding=f)


@query(f"""WITH {cte('finding')}, {LATER}, ka AS (SELECT *, {WEIGHT} AS w, concat_ws('|', case_id, type, value, coalesce(url, '-')) AS k FROM finding), kb AS (SELECT *, {WEIGHT} AS w, concat_ws('|', case_id, type, value, coalesce(url, '-')) AS k FROM later),
  la AS (SELECT * FROM ka QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord DESC) = 1), lb AS (SELECT * FROM kb QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord DESC) = 1)
  SELECT case_id, type, value, url, 'added' AS change, w AS delta FROM kb WHERE k NOT IN (SELECT k FROM ka) UNION ALL SELECT case_id, type, value, url, 'removed', -w FROM ka WHERE k NOT IN (SELECT k FROM kb) UNION ALL SELECT a.case_id, a.type, a.value, a.url, 'changed', b.w - a.w FROM la a JOIN lb b USING (k) WHERE a.w != b.w OR a.confidence != b.confidence""")
def case_diff(s, d):
    return cases.diff(*_later(s, d))


@query(f"WITH {cte('finding')}, {LATER} SELECT case_id, (SELECT count(*) FROM (SELECT value FROM later l WHERE l.case_id = c.case_id EXCEPT SELECT value FROM finding f WHERE f.case_id = c.case_id)) AS added, (SELECT count(*) FROM (SELECT value FROM finding f WHERE f.case_id = c.case_id EXCEPT SELECT value FROM later l WHERE l.case_id = c.case_id)) AS removed FROM (SELECT DISTINCT case_id FROM finding) c")
def case_set_deltas(s, d):
    return cases.deltas(*_later(s, d), "value")


@query(f"WITH {cte('finding')}, {LATER}, a AS (SELECT case_id, max({WEIGHT}) AS w FROM finding GROUP BY 1), b AS (SELECT case_id, max({WEIGHT}) AS w FROM later GROUP BY 1) SELECT i.subject_id AS case_id, coalesce(b.w, 25) - coalesce(a.w, 25) AS risk_delta FROM ident i LEFT JOIN a ON a.case_id = i.subject_id LEFT JOIN b ON b.case_id = i.subject_id WHERE authorized")
def case_risk_deltas(s, d):
    c = fixture(s, d, "ident").where("authorized").select(F.col("subject_id").alias("case_id"))
    score = lambda f: exposure.overall(f, c).join(exposure.exposed(exposure.dimensions(f, c)), "case_id").select("case_id", "weight", "overall")
    a, b = _later(s, d)
    return cases.score_deltas(score(a), score(b)).select("case_id", "risk_delta")


@query(f"WITH {cte('ident')} SELECT subject_id AS case_id, '2024-0' || (subject_id % 9 + 1) || '-11 10:00' AS created, row_number() OVER (ORDER BY '2024-0' || (subject_id % 9 + 1) || '-11 10:00' DESC, subject_id) AS rank FROM ident WHERE authorized")
def case_list(s, d):
    c = fixture(s, d, "ident").where("authorized").select(F.col("subject_id").alias("case_id"), F.concat(F.lit("2024-0"), (F.col("subject_id") % 9 + 1).cast("string"), F.lit("-11 10:00")).alias("created"))
    return cases.listed(c)


@query(f"WITH {cte('ident')} SELECT subject_id, coalesce(full_name, '') AS full_name, concat_ws('|', handle, other) AS handles, coalesce(email, '') AS emails, true AS deep FROM ident WHERE authorized")
def resume_states(s, d):
    return cases.resumable(identities(s, d), True).select("subject_id", "full_name", F.array_join("handles", "|").alias("handles"), F.array_join("emails", "|").alias("emails"), "deep")


# evidence of scanned profiles

EVID = f"""{cte('profile', 'finding')}, pf AS (SELECT f.*, p.ord AS po, p.there FROM finding f JOIN profile p ON p.case_id = f.case_id AND p.url = f.url), seed AS (SELECT subject_id AS case_id, unnest([0, 1, 2, 3]) AS ord, unnest(['Email', 'Phone', 'Username', 'Username']) AS kind, unnest([email, phone, handle, other]) AS value FROM ident WHERE authorized),
  ev AS (SELECT * FROM (SELECT case_id, ord * 1000 AS ord, 'profile:' || url AS id, 'Profile' AS type, url AS value, url, confidence::FLOAT AS confidence, CASE WHEN verified AND there THEN 'High' ELSE 'Low' END AS risk FROM profile UNION ALL SELECT case_id, po * 1000 + 1 + ord, 'ev:' || type || ':' || value || ':' || url, type, value, url, confidence::FLOAT, risk FROM pf
      UNION ALL SELECT case_id, ord + 100000000, 'seed:' || lower(kind) || ':' || value, kind, value, NULL, 1.0::FLOAT, 'Low' FROM seed WHERE value IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY case_id, id ORDER BY ord) = 1)"""


def _evidence(s, d):
    _, seeds, profiles, _, findings, *_ = parts(s, d)
    return scans.evidence(profiles, findings, seeds)


@query(f"WITH {EVID} SELECT case_id, id, type, value, url, round(confidence::DOUBLE, 6) AS confidence, risk FROM ev")
def evidence_union(s, d):
    return _evidence(s, d)[0].select("case_id", "id", "type", "value", "url", _r("confidence"), "risk")


@query(f"WITH {EVID} SELECT DISTINCT case_id, username AS source, url AS target, 'username_on_profile' AS relation FROM profile WHERE username NOT IN ('unknown', 'web') UNION SELECT case_id, url, value, 'mentions' FROM pf")
def evidence_relations(s, d):
    return _evidence(s, d)[1].select("case_id", "source", "target", "relation")


@query(f"WITH {EVID}, o AS (SELECT case_id, ord, kind AS type, value FROM seed WHERE value IS NOT NULL UNION ALL SELECT case_id, 1000000 + ord, type, value FROM finding) SELECT case_id, type, value FROM o QUALIFY row_number() OVER (PARTITION BY case_id, type, lower(value) ORDER BY ord) = 1")
def observed_evidence(s, d):
    _, seeds, _, _, findings, *_ = parts(s, d)
    return scans.observed(seeds, findings).select("case_id", "type", "value")


@query(f"WITH {cte('finding')} SELECT case_id, count(*) AS reused, string_agg(value, '|' ORDER BY ord) AS names FROM finding WHERE type = 'UsernameReuse' GROUP BY 1")
def username_reuse(s, d):
    f = fixture(s, d, "finding").where("type = 'UsernameReuse'")
    return f.groupBy("case_id").agg(F.count("*").alias("reused"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), "|").alias("names"))


# breaches


def _checks(s, d):
    i = fixture(s, d, "ident").where("authorized").select(F.col("subject_id").alias("case_id"), "email", "letters")
    rows = i.where("email is not null").select("case_id", F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.col("email").alias("email")), F.struct(F.lit(1).alias("ord"), F.upper(F.concat(F.lit(" "), "email")).alias("email")), F.struct(F.lit(2).alias("ord"), F.concat("letters", F.lit("@old.example")).alias("email")))).alias("e"), "letters").select("case_id", "e.*", "letters")
    n = (F.col("case_id") + F.col("ord")) % 4
    none = F.array().cast("array<string>")
    return rows.select("case_id", "ord", "email", F.when(n == 1, F.array(F.lit("Alpha"), F.lit("Beta"))).otherwise(none).alias("titles"), F.when(n >= 1, F.array(F.concat(F.lit("https://paste.example/"), "letters"))).otherwise(none).alias("pages"), F.when(n == 3, F.lit("no key")).alias("error"))


CHECKS = f"""{cte('ident')}, ck AS (SELECT subject_id AS case_id, o AS ord, CASE o WHEN 0 THEN email ELSE letters || '@old.example' END AS email, (subject_id + o) % 4 AS n, letters FROM ident, (VALUES (0), (2)) v(o) WHERE authorized AND email IS NOT NULL)"""


@query(f"WITH {CHECKS} SELECT case_id, email, CASE WHEN n = 1 THEN 2 ELSE 0 END AS records, CASE WHEN n = 1 THEN 'Alpha|Beta|https://paste.example/' || letters WHEN n >= 1 THEN 'https://paste.example/' || letters ELSE '' END AS sources, CASE WHEN n = 3 THEN 'no key' END AS note FROM ck")
def breach_digests(s, d):
    return scans.breach_rows(_checks(s, d))[0].select("case_id", "email", "records", F.array_join("sources", "|").alias("sources"), "note")


@query(f"WITH {CHECKS} SELECT case_id, CASE WHEN n = 1 THEN 'Email' ELSE 'SensitiveSnippet' END AS type, email AS value, CASE WHEN n = 1 THEN NULL ELSE 'https://paste.example/' || letters END AS url, CASE WHEN n = 1 THEN 0.95 ELSE 0.55 END AS confidence, CASE WHEN n = 1 THEN 'High' ELSE 'Medium' END AS risk, CASE WHEN n = 1 THEN 'in 2 breaches: Alpha, Beta' WHEN n = 3 THEN 'on 1 pages no key' ELSE 'on 1 pages' END AS snippet FROM ck WHERE n >= 1")
def breach_findings(s, d):
    return scans.breach_rows(_checks(s, d))[1]


@query(f"""WITH {cte('ident')}, c AS (SELECT * FROM (VALUES ('alpha', 'Emails|Passwords'), ('beta', 'Names')) v(k, classes)), h AS (SELECT subject_id, unnest(['Alpha', 'BETA', 'Other' || letters]) AS breach FROM ident WHERE authorized) SELECT subject_id, breach, coalesce(classes, 'unknown') AS classes FROM h LEFT JOIN c ON lower(breach) = k""")
def breach_catalog_join(s, d):
    known = F.broadcast(s.createDataFrame([("alpha", "Emails|Passwords"), ("beta", "Names")], "k string, classes string"))
    h = fixture(s, d, "ident").where("authorized").select("subject_id", F.explode(F.array(F.lit("Alpha"), F.lit("BETA"), F.concat(F.lit("Other"), "letters"))).alias("breach"))
    return h.join(known, F.lower("breach") == F.col("k"), "left").select("subject_id", "breach", F.coalesce("classes", F.lit("unknown")).alias("classes"))


RANGES = """b AS (SELECT left(h, 6) AS prefix, substr(h, 7) AS suffix, k FROM (SELECT upper(sha1(lower(trim(email)))) AS h, subject_id AS k FROM ident WHERE email IS NOT NULL)),
  j AS (SELECT prefix, '[{"hashSuffix":"' || lower(suffix) || '","websites":["Alpha","Beta","Alpha"," "]},{"hashSuffix":"' || suffix || '","websites":["Late"]}' || CASE WHEN k % 3 = 0 THEN '' ELSE ']' END AS body, suffix, k FROM b)"""


@query(f"WITH {cte('ident')}, {RANGES} SELECT prefix, suffix, unnest(['Alpha', 'Beta']) AS breach FROM j WHERE k % 3 != 0")
def breach_email_ranges(s, d):
    i = fixture(s, d, "ident").where("email is not null").select(F.upper(F.sha1(F.lower(F.trim("email")))).alias("h"), F.col("subject_id").alias("k"))
    body = F.concat(F.lit('[{"hashSuffix":"'), F.lower(F.expr("substr(h, 7)")), F.lit('","websites":["Alpha","Beta","Alpha"," "]},{"hashSuffix":"'), F.expr("substr(h, 7)"), F.lit('","websites":["Late"]}'), F.when(F.col("k") % 3 == 0, "").otherwise("]"))
    return parsers.email_ranges(i.select(F.left("h", F.lit(6)).alias("prefix"), body.alias("body")))


# reports

ST = "CASE WHEN there AND verified THEN 'VERIFIED' WHEN there THEN 'REVIEW' WHEN contains(lower(status), 'unverifiable') THEN 'UNAVAILABLE' ELSE 'NOT FOUND' END"


@query(f"WITH {cte('profile', 'leak')} SELECT i.subject_id AS case_id, coalesce(v, 0) AS verified, coalesce(r, 0) AS review, coalesce(u, 0) AS unavailable, coalesce(n, 0) AS records FROM ident i LEFT JOIN (SELECT case_id, count_if({ST} = 'VERIFIED') AS v, count_if({ST} = 'REVIEW') AS r, count_if({ST} = 'UNAVAILABLE') AS u FROM profile GROUP BY 1) p ON p.case_id = i.subject_id LEFT JOIN (SELECT case_id, sum(records)::BIGINT AS n FROM leak GROUP BY 1) l ON l.case_id = i.subject_id WHERE authorized")
def report_counters(s, d):
    c = fixture(s, d, "ident").where("authorized").select(F.col("subject_id").alias("case_id"))
    return reports.counters(c, fixture(s, d, "profile"), fixture(s, d, "leak"))


@query(f"WITH {cte('finding')} SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY {WEIGHT} DESC, confidence DESC, ord) AS rank, type || '|' || value || '|' || coalesce(url, '') AS key FROM finding")
def finding_order(s, d):
    return reports.ordered(fixture(s, d, "finding")).select("case_id", "rank", "key")


@query(f"WITH {GRAPH}, la AS (SELECT case_id, id, label FROM vert) SELECT case_id, 0 AS part, type || ': ' || label || ' (' || trunc(confidence * 100::FLOAT)::INT || '%)' AS line FROM vert UNION ALL SELECT e.case_id, 1, coalesce(a.label, src) || ' -' || relation || '-> ' || coalesce(b.label, dst) FROM edge e LEFT JOIN la a ON a.case_id = e.case_id AND a.id = src LEFT JOIN la b ON b.case_id = e.case_id AND b.id = dst")
def graph_lines(s, d):
    v, e = graph(s, d)
    return reports.graph_lines(v, e.withColumn("evidence", F.lit(None).cast("string"))).select("case_id", "part", "line")


@query(f"WITH {cte('finding', 'profile')}, o AS (SELECT * FROM finding QUALIFY row_number() OVER (PARTITION BY case_id, type, value ORDER BY ord) = 1) SELECT case_id, 0 AS part, type || ': ' || value || ' (' || trunc(confidence * 100::FLOAT)::INT || '%)' AS line FROM o UNION ALL SELECT case_id, 1, 'Profile: ' || url || ', ' || {ST} FROM profile WHERE there")
def fallback_lines(s, d):
    return reports.fallback_lines(fixture(s, d, "finding"), fixture(s, d, "profile")).select("case_id", "part", "line")


@query(f"WITH {cte('leak', 'finding')} SELECT case_id, email || ': ' || records || ' breach record(s)' || CASE WHEN source_list != '' THEN ', ' || replace(source_list, '|', ', ') ELSE '' END || coalesce(', ' || note, '') AS line FROM leak UNION ALL SELECT case_id, value || ': ' || coalesce(snippet, '') FROM finding WHERE contains(lower(snippet), 'breach') OR contains(lower(remediation), 'mfa')")
def breach_lines(s, d):
    leaks = parts(s, d)[-1]
    return reports.breach_lines(leaks).select("case_id", "line").unionByName(reports.breach_finding_lines(fixture(s, d, "finding")).select("case_id", "line"))


@query(f"""WITH {cte('finding', 'profile')}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {WEIGHT} DESC, confidence DESC, ord) AS rank FROM finding), t AS (SELECT case_id, string_agg(type || ': ' || value || ' (' || trunc(confidence * 100::FLOAT)::INT || '%, ' || risk || ')', ' | ' ORDER BY rank) AS top FROM r WHERE rank <= 5 GROUP BY 1),
  a AS (SELECT case_id, string_agg(fix, ' | ' ORDER BY k) AS actions FROM (SELECT case_id, trim(remediation) AS fix, min(rank) AS k FROM r WHERE rank <= 5 GROUP BY ALL) GROUP BY 1), p AS (SELECT case_id, count_if(there AND verified) AS v, count_if(there AND NOT verified) AS w FROM profile GROUP BY 1)
  SELECT subject_id AS case_id, coalesce(v, 0) AS verified, coalesce(w, 0) AS review, coalesce(top, 'none') AS top, coalesce(actions, 'search deeper and check what is listed') AS actions FROM ident LEFT JOIN p ON p.case_id = subject_id LEFT JOIN t ON t.case_id = subject_id LEFT JOIN a ON a.case_id = subject_id WHERE authorized""")
def case_summary(s, d):
    c = fixture(s, d, "ident").where("authorized").select(F.col("subject_id").alias("case_id"))
    return reports.summary(c, fixture(s, d, "profile"), fixture(s, d, "finding"))


def _lines(s, d):
    return reports.report_lines(parts(s, d)[0], fixture(s, d, "finding"), fixture(s, d, "profile"))


@query()
def report_text(s, d):
    return reports.wrapped(_lines(s, d))


@query()
def evidence_package(s, d):
    return reports.manifest(reports.sections(fixture(s, d, "finding"), _lines(s, d)))


# stored bodies


@query(f"""WITH {cte('ident')} SELECT subject_id AS answer_id, 'github' AS kind, letters AS username, 'Name ' || letters AS name, CAST(NULL AS VARCHAR) AS bio, 'Town' AS location, 'https://github.com/' || letters AS link FROM ident WHERE subject_id % 4 = 0 AND subject_id % 12 != 0 UNION ALL SELECT subject_id, 'reddit', 'r' || letters, 'T', 'about', NULL, 'https://p.example/' || letters FROM ident WHERE subject_id % 4 = 1 UNION ALL SELECT subject_id, 'gitlab', upper(letters), NULL, 'b', NULL, 'https://p.example/' || letters FROM ident WHERE subject_id % 8 = 2 UNION ALL SELECT subject_id, 'fediverse', letters, 'acct:' || letters || '@m.example', NULL, NULL, 'https://m.example/@' || letters FROM ident WHERE subject_id % 4 = 3""")
def profile_payloads(s, d):
    i = fixture(s, d, "ident")
    k = F.col("subject_id") % 4
    js = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    n = F.col("letters")
    body = F.when(F.col("subject_id") % 12 == 0, "{broken").when(k == 0, js('{"login":"', n, '","name":"Name ', n, '","bio":null,"location":"Town","html_url":"https://github.com/', n, '"}')).when(k == 1, js('{"data":{"name":"r', n, '","subreddit":{"title":"T","public_description":"about","icon_img":"https://i.example/a.png?x=1"}}}')).when(k == 2, js('[{"username":"', F.when(F.col("subject_id") % 8 == 2, F.upper(n)).otherwise("someone"), '","bio":"b"}]')).otherwise(js('{"subject":"acct:', n, '@m.example","aliases":["https://m.example/@', n, '"]}'))
    a = i.select(F.col("subject_id").alias("answer_id"), F.when(k == 0, "github").when(k == 1, "reddit").when(k == 2, "gitlab").otherwise("fediverse").alias("kind"), n.alias("username"), F.concat(F.lit("https://p.example/"), n).alias("url"), body.alias("body"))
    return parsers.profile_payloads(a).select("answer_id", "kind", "username", "name", "bio", "location", "link")


@query(f"WITH {cte('ident')} SELECT subject_id AS answer_id, 'https://web.archive.org/web/2024/' || letters AS url, '202401' AS stamp, '2024-01' AS shown FROM ident WHERE subject_id % 3 = 0")
def archive_captures(s, d):
    js = F.concat(F.lit('{"archived_snapshots":{"closest":{"available":'), F.when(F.col("subject_id") % 3 == 1, "false").otherwise("true"), F.lit(',"status":"'), F.when(F.col("subject_id") % 3 == 2, "404").otherwise("200"), F.lit('","url":"http://web.archive.org/web/2024/'), "letters", F.lit('","timestamp":"202401"}}}'))
    return parsers.captures(fixture(s, d, "ident").select(F.col("subject_id").alias("answer_id"), js.alias("body")))


SITE = "h AS (SELECT page_id, url, html FROM pages)"


@query()
def html_text(s, d):
    return parsers.html_fields(S.table(s, d, "pages")).select("page_id", "title", "description", "text", F.size("links").cast("long").alias("links"))


@query()
def search_page_hits(s, d):
    """Result pages of six providers, made of the search hits."""
    # parsing costs time, not bytes: a stated number of tasks, which no plan merges by its bytes
    h = fixture(s, d, "hit").withColumn("source", F.lower(F.regexp_replace("source", "Duck", "DuckDuckGo"))).repartition(4 * s.sparkContext.defaultParallelism, "subject_id")
    block = F.concat(F.lit('<li class="b_algo"><div class="result snippet"><h2><a class="title result__a" href="/l?uddg='), F.replace(F.replace(F.replace("url", F.lit("?"), F.lit("%3F")), F.lit("&"), F.lit("%26")), F.lit("#"), F.lit("%23")), F.lit('">'), "title", F.lit('</a></h2><p class="description result__snippet">'), "snippet", F.lit("</p></div></li>"))
    pages = h.groupBy(F.col("subject_id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("ord", block.alias("b")))).alias("r"))
    kinds = F.array(*map(F.lit, ["DuckDuckGo", "Bing", "Yandex", "Brave", "Mojeek", "Qwant", "Other"]))
    return parsers.search_results(pages.select("page_id", F.element_at(kinds, (F.col("page_id") % 7 + 1).cast("int")).alias("source"), F.lit("q").alias("query"), F.concat(F.lit("<html><body>"), F.array_join(F.transform("r", lambda x: x["b"]), ""), F.lit("</body></html>")).alias("html"))).select("page_id", "source", "url", "title", "snippet")


@query()
def image_page_hits(s, d):
    h = fixture(s, d, "hit").where("ord < 3").repartition(4 * s.sparkContext.defaultParallelism, "subject_id")
    meta = F.concat(F.lit("<a class='iusc' m='{\"murl\":\"https://img.example/"), F.col("subject_id").cast("string"), F.lit("-"), F.col("ord").cast("string"), F.lit(".png\",\"turl\":\"https://t.example/x\",\"purl\":\""), "url", F.lit("\",\"t\":\"Picture\"}'></a>"))
    pages = h.groupBy(F.col("subject_id").alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list(meta)), "").alias("html"))
    return parsers.image_results(pages.select("page_id", F.lit("Bing").alias("source"), F.lit("q").alias("query"), "html")).select("page_id", "image", "thumbnail", "page", "title")


@query(f"""WITH {cte('ident')}, l AS (SELECT subject_id, 'https://s' || letters || '.example/' AS root, unnest(['about-me.html', 'contact', 'home', 'media/me', 'ABOUT-me.html', 'blog/cv.pdf', 'https://other.example/about']) AS t, unnest([0, 1, 2, 3, 4, 5, 6]) AS o FROM ident)
  SELECT root, o::BIGINT AS ord, root || t AS url FROM l WHERE o IN (0, 1, 3, 5)""")
def followed_links(s, d):
    i = fixture(s, d, "ident").select(F.concat(F.lit("https://s"), "letters", F.lit(".example/")).alias("url"))
    pages = i.select("url", F.transform(F.array(*map(F.lit, ["about-me.html", "contact", "home", "media/me", "ABOUT-me.html", "blog/cv.pdf", "https://other.example/about"])), lambda t: F.when(F.startswith(t, F.lit("http")), t).otherwise(F.concat("url", t))).alias("links"))
    return parsers.followed(pages, i)


@query(f"""WITH {cte('ident')} SELECT subject_id AS body_id, 'chat-' || letters AS model, 'Chat' AS shown FROM ident WHERE subject_id % 2 = 0 UNION ALL SELECT subject_id, 'm' || letters, 'm' || letters || ' (7B)' FROM ident WHERE subject_id % 2 = 1""")
def model_lists(s, d):
    a = F.concat(F.lit('{"data":[{"id":"chat-'), "letters", F.lit('","name":"Chat"},{"id":"text-embedding-3"},{"id":"chat-'), "letters", F.lit('"}]}'))
    b = F.concat(F.lit('{"models":[{"model":"m'), "letters", F.lit('","details":{"parameter_size":"7B"}},{"name":null}]}'))
    return parsers.models(fixture(s, d, "ident").select(F.col("subject_id").alias("body_id"), F.when(F.col("subject_id") % 2 == 0, a).otherwise(b).alias("body")))


@query(f"""WITH {cte('ident')} SELECT subject_id, CASE subject_id % 4 WHEN 0 THEN 'https://i.example/' || letters WHEN 1 THEN 'https://i.example/tw' WHEN 2 THEN 'https://i.example/av.png' END AS image FROM ident""")
def profile_image_urls(s, d):
    h = F.when(F.col("subject_id") % 4 == 0, F.concat(F.lit('<meta name="twitter:image" content="https://i.example/tw"><meta property="og:image" content="http://i.example/'), "letters", F.lit('#x">'))).when(F.col("subject_id") % 4 == 1, F.lit('<meta property="og:image" content="/rel.png"><meta name="twitter:image" content="https://i.example/tw">')).when(F.col("subject_id") % 4 == 2, F.lit('<img alt="me"><img alt="avatar of me" src="https://i.example/av.png">')).otherwise(F.lit("<p>no picture</p>"))
    return fixture(s, d, "ident").select("subject_id", parsers.profile_image(h).alias("image"))
