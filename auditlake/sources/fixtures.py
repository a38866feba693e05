"""Tables that no file holds, derived from those that one does: identities with gaps, search hits, fetched pages, profile rows.

Each is one SELECT in the SQL that Spark and DuckDB share, so both engines read the same rows; what operators make of them is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.lineage import cut
from auditlake.operators.ordering import tasks
from auditlake.sources.tables import table

BASE = ("customer", "nation", "region")
FIXTURES = {
    "ident": """
SELECT k AS subject_id, CASE WHEN k % 13 = 5 THEN NULL WHEN k % 11 = 0 THEN given ELSE given || CASE WHEN k % 5 = 0 THEN ' van ' ELSE ' ' END || family END AS full_name, given, family,
  CASE WHEN k % 6 = 5 THEN NULL ELSE 'user' || letters END AS handle, CASE WHEN k % 4 = 1 THEN 'Alt_' || letters END AS other, CASE WHEN k % 3 = 0 THEN 'nick' || letters END AS alias,
  CASE WHEN k % 5 = 4 THEN NULL ELSE given || '.' || letters || '@' || lower(seg) || '.example' END AS email,
  CASE WHEN k % 8 = 7 THEN NULL WHEN k % 3 = 0 THEN '+1 415 555 ' || last4 WHEN k % 3 = 1 THEN '(415) 555-' || last4 ELSE '415.555.' || last4 END AS phone,
  CASE WHEN k % 9 = 8 THEN NULL ELSE upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) END AS location, CASE WHEN k % 9 = 7 THEN NULL ELSE upper(substr(seg, 1, 1)) || lower(substr(seg, 2)) || ' Labs' END AS organization,
  CASE WHEN k % 10 = 0 THEN 'https://people.example/' || letters END AS profile_url, letters, k % 2 = 0 AS authorized
FROM (SELECT c_custkey AS k, translate(CAST(c_custkey AS STRING), '0123456789', 'abcdefghij') AS letters, c_mktsegment AS seg, r_name, lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS last4,
    CASE c_custkey % 7 WHEN 0 THEN 'Alex' WHEN 1 THEN 'Robin' WHEN 2 THEN 'Sam' WHEN 3 THEN 'Kim' WHEN 4 THEN 'Li' WHEN 5 THEN 'Noa' ELSE 'Max' END AS given,
    upper(substr(n_name, 1, 1)) || lower(substr(replace(replace(n_name, ' ', ''), '_', ''), 2)) || translate(CAST(c_custkey AS STRING), '0123456789', 'abcdefghij') AS family
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey) w""",
    "hit": """
SELECT subject_id, 0 AS ord, 'Duck' AS source, 'https://github.com/' || coalesce(handle, letters) AS url, coalesce(full_name, 'Someone') || ' - code' AS title, 'Write to ' || coalesce(email, 'nobody') AS snippet, coalesce(handle, letters) AS query FROM {ident}
UNION ALL SELECT subject_id, 1, 'Bing', 'https://www.reddit.com/user/' || coalesce(handle, letters) || '/?utm_source=Mail&ref=x#top', 'Profile of @' || coalesce(handle, letters), 'Call ' || coalesce(phone, 'no one'), 'site:reddit.com' FROM {ident}
UNION ALL SELECT subject_id, 2, 'Qwant', 'https://blog.example/posts?author=' || coalesce(handle, letters), family || ', ' || given || ' on stage', coalesce(organization, 'A firm') || ' in ' || coalesce(location, 'town'), family FROM {ident}
UNION ALL SELECT subject_id, 3, 'Bing', 'https://github.com/' || coalesce(handle, letters) || '/?ref=search', coalesce(full_name, 'Someone'), 'Write to ' || coalesce(email, 'nobody') || ' or to the team that keeps this page', coalesce(handle, letters) FROM {ident}
UNION ALL SELECT subject_id, 4, 'Mojeek', 'https://news.example/' || letters || '.html', 'Daily news', 'nothing of note', 'site:news.example' FROM {ident}
UNION ALL SELECT subject_id, 5, 'Duck', 'https://dev.to/' || coalesce(alias, 'other' || letters), 'Posts by ' || coalesce(alias, 'another'), 'a blog', coalesce(alias, 'x') FROM {ident}
UNION ALL SELECT subject_id, 6, 'Brave', coalesce(profile_url, 'https://yandex.com/search?text=' || letters), 'Home page', coalesce(other, 'a site') || ' speaks', letters FROM {ident}""",
    "fetched": """
SELECT subject_id, 'https://github.com/' || coalesce(handle, letters) AS url, CASE subject_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 503 WHEN 3 THEN 429 ELSE 200 END AS status, coalesce(full_name, 'Someone') AS title,
  'Hello, I am ' || coalesce(full_name, given) || ' from ' || coalesce(location, 'town') || '. ' || coalesce('Mail: ' || email || '. ', '') || CASE WHEN subject_id % 4 = 0 THEN coalesce('Phone ' || phone || '. ', '') ELSE '' END || coalesce('I work for ' || organization || '. ', '') || 'Also on twitch as ' || letters || 'tv, reddit: @' || letters || '_r and https://gitlab.com/' || letters || 'gl, see https://twitter.com/' || letters || '.' AS text FROM {ident}
UNION ALL SELECT subject_id, 'https://blog.example/posts?author=' || coalesce(handle, letters), 200, family || ' on stage', family || ' met ' || given || ' and spoke of ' || coalesce(alias, 'things') || '; ' || coalesce(handle, 'they') || ' left for medium: ' || letters || 'writes. Mastodon -> ' || letters || 'social' FROM {ident}
UNION ALL SELECT subject_id, 'https://dev.to/' || coalesce(alias, 'other' || letters), CASE WHEN subject_id % 5 = 0 THEN 410 ELSE 200 END, 'Posts by ' || coalesce(alias, 'another'), 'A blog about ' || coalesce(organization, 'nothing') || ' with the username ' || coalesce(other, 'hidden') FROM {ident}
UNION ALL SELECT subject_id, profile_url, 200, 'Home page', 'Welcome' FROM {ident} WHERE profile_url IS NOT NULL""",
    "profile": """
SELECT subject_id AS case_id, 0 AS ord, 'https://github.com/' || coalesce(handle, letters) AS url, coalesce(handle, letters) AS username, 'GitHub' AS platform, full_name AS title, CAST(0.9 AS FLOAT) AS confidence, true AS there, subject_id % 3 <> 0 AS verified, 'seen' AS status, CASE WHEN subject_id % 5 <> 0 THEN 'https://img.example/' || letters || '.png' END AS image FROM {ident} WHERE authorized
UNION ALL SELECT subject_id, 1, 'https://www.reddit.com/user/' || letters, CASE WHEN subject_id % 4 = 0 THEN 'unknown' ELSE letters END, 'Reddit', NULL, CAST(0.42 AS FLOAT), subject_id % 6 <> 0, false, CASE WHEN subject_id % 6 = 0 THEN 'Unverifiable: blocked' ELSE 'seen, not attributed' END, NULL FROM {ident} WHERE authorized
UNION ALL SELECT subject_id, 2, 'https://gitlab.com/' || coalesce(other, 'x' || letters), coalesce(other, 'x' || letters), 'GitLab', ' ', CAST(0.7 AS FLOAT), other IS NOT NULL, other IS NOT NULL, 'checked', 'https://img.example/' || letters || '-2.png' FROM {ident} WHERE authorized""",
    "finding": """
SELECT subject_id AS case_id, 0 AS ord, 'Email' AS type, email AS value, 'https://github.com/' || coalesce(handle, letters) AS url, CAST(0.99 AS FLOAT) AS confidence, 'High' AS risk, 'Appears in a breach' AS snippet, 'Enable MFA' AS remediation FROM {ident} WHERE authorized AND email IS NOT NULL
UNION ALL SELECT subject_id, 1, 'Phone', phone, 'https://blog.example/posts?author=' || letters, CAST(0.36 AS FLOAT), CASE WHEN subject_id % 3 = 0 THEN 'Critical' ELSE 'Low' END, 'call', '' FROM {ident} WHERE authorized AND phone IS NOT NULL
UNION ALL SELECT subject_id, 2, 'Location', location, NULL, CAST(0.29 AS FLOAT), 'Medium', NULL, 'Generalize it' FROM {ident} WHERE authorized AND location IS NOT NULL
UNION ALL SELECT subject_id, 3, 'SensitiveSnippet', 'Name Exposure: ' || full_name, 'https://blog.example/posts?author=' || letters, CAST(0.65 AS FLOAT), 'Medium', 'name', 'Reduce it' FROM {ident} WHERE authorized AND full_name IS NOT NULL
UNION ALL SELECT subject_id, 4, 'UsernameReuse', coalesce(alias, letters), 'https://www.reddit.com/user/' || letters, CAST(0.7 AS FLOAT), 'Medium', NULL, '' FROM {ident} WHERE authorized AND subject_id % 4 = 0
UNION ALL SELECT subject_id, 5, 'PublicSearchEvidence', 'Home of ' || given, 'https://people.example/' || letters, CAST(0.58 AS FLOAT), 'Low', 'listed', 'Review it' FROM {ident} WHERE authorized AND subject_id % 3 = 2
UNION ALL SELECT subject_id, 6, 'Organization', organization, 'https://blog.example/posts?author=' || letters, CAST(0.64 AS FLOAT), 'Medium', 'works', '' FROM {ident} WHERE authorized AND organization IS NOT NULL
UNION ALL SELECT subject_id, 7, 'Email', email, 'https://github.com/' || coalesce(handle, letters), CAST(0.42 AS FLOAT), 'Low', NULL, '' FROM {ident} WHERE authorized AND email IS NOT NULL AND subject_id % 4 = 2
UNION ALL SELECT subject_id, 8, 'PlausibleProfileMatch', 'https://dev.to/' || letters, 'https://dev.to/' || letters, CAST(0.81 AS FLOAT), 'Medium', 'found', 'Review it' FROM {ident} WHERE authorized AND subject_id % 5 = 1
UNION ALL SELECT subject_id, 9, 'ImageConsistency', 'Picture of ' || letters, 'https://img.example/' || letters || '.png', CAST(0.9 AS FLOAT), 'Medium', 'same picture', 'Use another' FROM {ident} WHERE authorized AND subject_id % 7 = 3""",
    "shown": """
SELECT case_id, ord * 100 AS ord, 'Username' AS type, username AS value, confidence, 'name on the page' AS snippet, url AS of FROM {profile} WHERE there
UNION ALL SELECT i.subject_id, 1, 'Email', upper(i.email), CAST(0.72 AS FLOAT), 'mail on the page', 'https://github.com/' || coalesce(i.handle, i.letters) FROM {ident} i WHERE authorized AND email IS NOT NULL
UNION ALL SELECT i.subject_id, 2, 'Organization', ' ' || i.organization || '  ', CAST(0.44 AS FLOAT), 'work on the page', 'https://github.com/' || coalesce(i.handle, i.letters) FROM {ident} i WHERE authorized AND organization IS NOT NULL""",
    "relation": """
SELECT subject_id AS case_id, 0 AS ord, coalesce(handle, letters) AS source, 'https://github.com/' || coalesce(handle, letters) AS target, 'username_on_profile' AS relation, 'GitHub' AS evidence FROM {ident} WHERE authorized
UNION ALL SELECT subject_id, 1, letters, upper(letters), 'same_as', NULL FROM {ident} WHERE authorized
UNION ALL SELECT subject_id, 2, 'https://github.com/' || coalesce(handle, letters), coalesce(email, 'none'), 'mentions', 'Email' FROM {ident} WHERE authorized""",
    "observed": """
SELECT subject_id AS case_id, 0 AS ord, 'Email' AS type, coalesce(handle, letters) || '@mail.example' AS value, 'https://gist.example/' || letters AS url, CAST(0.5 AS FLOAT) AS confidence, 'gist' AS snippet FROM {ident} WHERE authorized AND subject_id % 3 = 1
UNION ALL SELECT subject_id, 1, 'Username', upper(coalesce(handle, letters)), NULL, CAST(0.8 AS FLOAT), NULL FROM {ident} WHERE authorized
UNION ALL SELECT subject_id, 2, 'Profile', 'https://github.com/' || coalesce(handle, letters), 'https://github.com/' || coalesce(handle, letters), CAST(0.6 AS FLOAT), 'own page' FROM {ident} WHERE authorized
UNION ALL SELECT subject_id, 3, 'SensitiveSnippet', 'nothing to draw', NULL, CAST(0.6 AS FLOAT), NULL FROM {ident} WHERE authorized""",
    "leak": """
SELECT subject_id AS case_id, 0 AS ord, coalesce(email, letters || '@old.example') AS email, subject_id % 4 AS records, CASE WHEN subject_id % 3 = 0 THEN 'Alpha|https://paste.example/' || letters ELSE '' END AS source_list, CASE WHEN subject_id % 5 = 0 THEN 'partial' END AS note FROM {ident} WHERE authorized AND subject_id % 6 <> 2""",
}
#: Fixtures that a fixture reads.
NEEDS = {"hit": ("ident",), "fetched": ("ident",), "profile": ("ident",), "finding": ("ident",), "shown": ("profile", "ident"), "relation": ("ident",), "observed": ("ident",), "leak": ("ident",)}


_MADE: dict[tuple, DataFrame] = {}


def fixture(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A fixture, written once for each session and folder: others read it many times."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _MADE:
        tables = {n: fixture(spark, folder, n) for n in NEEDS[name]} if name in NEEDS else {t: table(spark, folder, t) for t in BASE}
        made = spark.sql(FIXTURES[name], **tables)
        # one partition for each core, and more where there are more subjects, so that none grows with the input; a union has the partitions of all its parts
        n = tasks(tables["customer"] if "customer" in tables else tables["ident"], 25_000)
        _MADE[key] = cut(made.repartition(n, "subject_id") if name == "ident" else made.coalesce(n))
    return _MADE[key]


def cte(*names: str) -> str:
    """The fixtures as common table expressions for DuckDB."""
    wanted = set(names)
    while more := {m for n in wanted for m in NEEDS.get(n, ())} - wanted:
        wanted |= more
    order = [n for n in FIXTURES if n in wanted]
    return ", ".join(f"{n} AS ({FIXTURES[n].format(**{t: t for t in (*BASE, *FIXTURES)})})" for n in order)


def identities(spark: SparkSession, folder: str) -> DataFrame:
    """Identity seeds with lists, as operators take them: handles, aliases, emails, phones, organizations, locations, profile_urls; of consenting subjects only."""
    some = lambda *c: F.array_compact(F.array(*c))
    d = fixture(spark, folder, "ident").where("authorized")
    lists = {"handles": some("handle", "other"), "aliases": some("alias"), "emails": some("email"), "phones": some("phone"), "organizations": some("organization"), "locations": some("location"), "profile_urls": some("profile_url")}
    return d.select("subject_id", F.coalesce("full_name", F.lit("")).alias("full_name"), *(v.alias(k) for k, v in lists.items()))
