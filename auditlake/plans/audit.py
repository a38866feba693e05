"""Queries over identities with gaps, each beside the SQL that it is checked against. The SQL follows the rules' text, not the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import profiles as P
from auditlake.operators import handles, search
from auditlake.sources import tables as S
from auditlake.sources.fixtures import cte, fixture, identities

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def names(xs) -> str:
    return ", ".join(map(q, xs))


def _r(c: str):
    return F.round(F.col(c).cast("double"), 6).alias(c)


# SQL of shared rules

PLAT = "plat AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(n)}, {q(p)}, {str(by).lower()}, {q(h)}, {q(pre)})" for i, (n, p, by, h, pre) in enumerate(S.PLATFORMS)) + ") v(pord, platform, pattern, by_default, phost, prefix))"
TRACK = names("utm_source utm_medium utm_campaign utm_term utm_content gclid fbclid msclkid ref ref_src ved source yclid".split())


def key(u: str) -> str:
    kept = f"list_filter(string_split(regexp_extract(split_part({u}, '#', 1), '\\?(.*)$', 1), '&'), lambda x: x != '' AND lower(split_part(x, '=', 1)) NOT IN ({TRACK}))"
    return f"lower(regexp_replace(split_part(split_part({u}, '#', 1), '?', 1) || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END, '/+$', ''))"


def host(u: str) -> str:
    return rf"regexp_replace(lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '')"


def path(u: str) -> str:
    return f"regexp_replace(regexp_extract({u}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g')"


def in_url(u: str, h: str) -> str:
    """A whole segment or query value equals the handle."""
    segment = f"list_contains(list_transform(string_split({path(u)}, '/'), lambda s: lower(ltrim(s, '@'))), lower({h}))"
    value = f"list_contains(list_transform(string_split(regexp_extract({u}, '\\?([^#]*)', 1), '&'), lambda s: lower(ltrim(split_part(s, '=', 2), '@'))), lower({h}))"
    return f"coalesce({h} != '' AND ({segment} OR {value}), false)"


def on(u: str, hosts) -> str:
    return "(" + " OR ".join(f"{host(u)} = {q(h)} OR ends_with({host(u)}, {q('.' + h)})" for h in hosts) + ")"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def resolve(rel: str, keys: str, u: str) -> str:
    """SELECT keys, platform, handle, profile of a relation's URLs, by the first platform that fits."""
    alias = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in P.ALIASES.items())
    return f"""SELECT {keys}, arg_min(platform, pord) AS platform, arg_min(h, pord) AS handle, arg_min(replace(pattern, '{{u}}', h), pord) AS profile FROM (
    SELECT *, CASE WHEN prefix = 'user?id=' THEN trim(regexp_extract(qs, 'id=([^&]*)', 1)) WHEN prefix = '' THEN ltrim(split_part(pt, '/', 1), '@') WHEN starts_with(lower(pt), prefix) THEN ltrim(split_part(ltrim(regexp_extract(pt, '^[^/]*?' || CASE prefix WHEN '@' THEN '@' ELSE prefix END || '(.*)$', 1), '/'), '/', 1), '@') WHEN prefix = '@' THEN split_part(pt, '/', 1) ELSE '' END AS h
    FROM (SELECT *, {host('full_url')} AS ho, regexp_replace(regexp_extract(full_url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '^/+', '') AS pt, regexp_extract(full_url, '\\?([^#]*)', 1) AS qs FROM (SELECT *, CASE WHEN regexp_matches(trim({u}), '^(?i)https?://') THEN trim({u}) ELSE 'https://' || trim({u}) END AS full_url FROM {rel})) x, plat
    WHERE len(pt) >= 2 AND lower(split_part(pt, '/', 1)) NOT IN ({names(P.RESERVED)}) AND (ho = phost OR ends_with(ho, '.' || phost) OR CASE ho {alias} ELSE ho END = phost)) y
  WHERE len(h) >= 2 AND lower(h) != 'www' AND lower(h) != ho GROUP BY {keys}"""


ONE = f"""keyed AS (SELECT *, {key('url')} AS page FROM hit),
  srcs AS (SELECT subject_id, page, string_agg(source, '+' ORDER BY o) AS sources, count(*) AS providers FROM (SELECT subject_id, page, source, min(ord) AS o FROM keyed GROUP BY ALL) GROUP BY ALL),
  one AS (SELECT k.*, s.sources, s.providers FROM keyed k JOIN srcs s USING (subject_id, page) QUALIFY row_number() OVER (PARTITION BY k.subject_id, k.page ORDER BY len(title) + len(snippet) DESC, ord) = 1)"""


def parts_in(said: str) -> str:
    p = "list_filter(string_split(lower(trim(full_name)), ' '), lambda w: len(w) >= 3)"
    return f"coalesce(len({p}) >= 2 AND len(list_filter({p}, lambda w: contains({said}, w))) = len({p}), false)"


SAID = "lower(title || ' ' || snippet || ' ' || url)"
IDX = f"""{cte('hit')}, {PLAT}, {ONE}, res AS ({resolve('one', 'subject_id, page', 'url')}),
  rule AS (SELECT one.*, ident.* EXCLUDE (subject_id), coalesce(contains({SAID}, lower(full_name)), false)::INT AS r_name, {parts_in(SAID)}::INT AS r_parts,
      (coalesce(contains({SAID}, lower(handle)), false) OR coalesce(contains({SAID}, lower(other)), false) OR coalesce(contains({SAID}, lower(alias)), false))::INT AS r_handle,
      ({in_url('url', 'handle')} OR {in_url('url', 'other')} OR {in_url('url', 'alias')})::INT AS r_path, coalesce(contains({SAID}, lower(email)), false)::INT AS r_mail,
      coalesce(len({digits('phone')}) >= 8 AND contains({digits(SAID)}, {digits('phone')}), false)::INT AS r_phone, coalesce(contains({SAID}, lower(alias)), false)::INT AS r_alias, {on('url', P.EXPOSURE_HOSTS)}::INT AS r_host, contains(lower(query), 'site:')::INT AS r_site
    FROM one JOIN ident USING (subject_id) WHERE authorized),
  idx AS (SELECT rule.*, (res.platform IS NOT NULL)::INT AS r_profile, least((providers - 1) * 0.04::DOUBLE, 0.12::DOUBLE) AS bonus, greatest(0, least(0.95::DOUBLE, 0.08::DOUBLE + 0.30::DOUBLE * r_name + 0.18::DOUBLE * r_parts + 0.20::DOUBLE * r_handle + 0.18::DOUBLE * r_path + 0.25::DOUBLE * r_mail + 0.20::DOUBLE * r_phone + 0.10::DOUBLE * r_alias
      + 0.14::DOUBLE * (res.platform IS NOT NULL)::INT + 0.05::DOUBLE * r_host + 0.03::DOUBLE * r_site + least((providers - 1) * 0.04::DOUBLE, 0.12::DOUBLE) - CASE WHEN r_name + r_parts + r_handle + r_path + r_mail + r_phone + r_alias = 0 THEN 0.20::DOUBLE ELSE 0 END)) AS "index"
    FROM rule LEFT JOIN res USING (subject_id, page))"""
TOK = lambda text, t: f"coalesce({t} != '' AND strpos(lower({text}), lower({t})) > 0 AND NOT regexp_matches(substr(' ' || lower({text}), strpos(lower({text}), lower({t})), 1), '[\\p{{L}}0-9]') AND NOT regexp_matches(substr(lower({text}) || ' ', strpos(lower({text}), lower({t})) + len({t}), 1), '[\\p{{L}}0-9]'), false)"


def direct(rel: str, url: str, text: str) -> str:
    """SELECT *, direct, ceiling, signals of a relation that has the identity's columns."""
    place = lambda u: f"{host(u)} || '/' || lower({path(u)})"
    low = f"lower({text})"
    return f"""SELECT *, CASE WHEN {text} IS NOT NULL THEN least(1.0::DOUBLE, 0.95::DOUBLE * d_url + 0.5::DOUBLE * d_path + 0.14::DOUBLE * d_tok + 0.72::DOUBLE * d_mail + 0.7::DOUBLE * d_phone + 0.34::DOUBLE * d_full + 0.24::DOUBLE * d_parts + 0.18::DOUBLE * d_alias + 0.12::DOUBLE * d_org + 0.08::DOUBLE * d_loc) END AS direct,
    CASE WHEN {text} IS NULL THEN NULL WHEN d_url = 1 THEN 0.99::DOUBLE WHEN d_mail + d_phone > 0 THEN 0.97::DOUBLE WHEN d_path = 1 AND d_url + d_path + d_mail + d_phone + d_full + d_parts >= 2 THEN 0.95::DOUBLE WHEN d_path = 1 THEN 0.82::DOUBLE
      WHEN d_full + d_parts > 0 AND d_url + d_path + d_tok + d_mail + d_phone + d_full + d_parts + d_alias + d_org + d_loc >= 2 THEN 0.86::DOUBLE WHEN d_full + d_parts > 0 THEN 0.6::DOUBLE ELSE 0.48::DOUBLE END AS ceiling,
    CASE WHEN {text} IS NOT NULL THEN d_url + d_path + d_tok + d_mail + d_phone + d_full + d_parts + d_alias + d_org + d_loc END AS signals
  FROM (SELECT *, (d_both AND NOT d_whole)::INT AS d_parts, d_whole::INT AS d_full FROM (SELECT *, coalesce({place('profile_url')} = {place(url)}, false)::INT AS d_url, ({in_url(url, 'handle')} OR {in_url(url, 'other')})::INT AS d_path, ({TOK(text, 'handle')} OR {TOK(text, 'other')})::INT AS d_tok, coalesce(contains({low}, lower(email)), false)::INT AS d_mail,
    coalesce(len({digits('phone')}) >= 8 AND contains({digits(text)}, {digits('phone')}), false)::INT AS d_phone, {parts_in(low)} AS d_both, coalesce(len(list_filter(string_split(lower(full_name), ' '), lambda w: len(w) >= 3)) >= 2 AND contains({low}, lower(full_name)), false) AS d_whole, {TOK(text, 'alias')}::INT AS d_alias,
    coalesce(contains({low}, lower(organization)), false)::INT AS d_org, coalesce(contains({low}, lower(location)), false)::INT AS d_loc FROM {rel}))"""


def _one(s, d):
    return search.one_hit(fixture(s, d, "hit"))


@query(f"""WITH {cte('hit')}, {ONE} SELECT subject_id, page, title, ord::BIGINT AS ord, sources, providers, round(least((providers - 1) * 0.04::DOUBLE, 0.12::DOUBLE), 6) AS bonus FROM one""")
def provider_consensus(s, d):
    return _one(s, d).select("subject_id", "page", "title", F.col("ord").cast("long").alias("ord"), "sources", "providers", F.round(search.bonus(F.col("providers")), 6).alias("bonus"))


@query(f"""WITH {IDX} SELECT subject_id, page, round("index", 6) AS "index" FROM idx""")
def index_score(s, d):
    return search.index_score(_one(s, d), identities(s, d)).select("subject_id", "page", _r("index"))


@query(f"""WITH {cte('fetched')}, j AS (SELECT f.subject_id, f.url, f.text, i.* EXCLUDE (subject_id) FROM fetched f JOIN ident i USING (subject_id) WHERE authorized), dir AS ({direct('j', 'url', 'text')}) SELECT subject_id, url, round(direct, 6) AS direct, round(ceiling, 6) AS ceiling, signals::BIGINT AS signals FROM dir""")
def direct_score(s, d):
    pages = fixture(s, d, "fetched").select("subject_id", "url", "text")
    return search.direct_score(pages.join(identities(s, d), "subject_id"), "url", "text").select("subject_id", "url", _r("direct"), _r("ceiling"), "signals")


@query("SELECT status, CASE WHEN status IN (404, 410) THEN 'gone' WHEN status BETWEEN 200 AND 299 THEN 'readable' ELSE 'unavailable' END AS outcome, status IN (408, 425, 429) OR status BETWEEN 500 AND 599 AS again, count(*) AS pages FROM (" + f"WITH {cte('fetched')} SELECT * FROM fetched) GROUP BY ALL")
def page_outcomes(s, d):
    st = F.col("status")
    return fixture(s, d, "fetched").groupBy(st.cast("long").alias("status"), search.outcome(st).alias("outcome"), search.transient(st).alias("again")).agg(F.count("*").alias("pages"))


BAND = f"""{IDX}, best AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY round("index", 9) DESC, ord) AS place FROM idx WHERE round("index", 9) >= 0.22)"""


@query(f"""WITH {BAND} SELECT subject_id, page, place, CASE WHEN place <= 28 THEN 'read' ELSE 'listed' END AS band FROM best WHERE place <= 58""")
def verification_bands(s, d):
    return search.banded(search.index_score(_one(s, d), identities(s, d))).select("subject_id", "page", F.col("place").cast("long").alias("place"), "band")


@query(f"""WITH {BAND.replace(cte('hit'), cte('hit', 'fetched'))},
  met AS (SELECT subject_id, {key('url')} AS page, url AS page_url, status, text AS page_text FROM fetched QUALIFY row_number() OVER (PARTITION BY subject_id, {key('url')} ORDER BY url) = 1),
  seen AS (SELECT b.*, m.page_url, m.status, CASE WHEN place > 28 OR status IS NULL THEN 'listed' WHEN status IN (404, 410) THEN 'gone' WHEN status BETWEEN 200 AND 299 THEN 'readable' ELSE 'unavailable' END AS outcome, page_text FROM best b LEFT JOIN met m USING (subject_id, page) WHERE place <= 58),
  texted AS (SELECT * EXCLUDE (page_text), CASE WHEN outcome = 'readable' THEN title || ' ' || snippet || ' ' || page_text END AS body FROM seen WHERE outcome != 'gone'), dir AS ({direct('texted', 'page_url', 'body')}),
  fin AS (SELECT *, direct IS NOT NULL AS verified, round(coalesce(least(ceiling, 0.42::DOUBLE * "index" + 0.68::DOUBLE * direct + bonus), least("index", 0.58::DOUBLE)), 9) AS score FROM dir)
  SELECT subject_id, page, outcome, verified, round(score, 6) AS score, providers FROM fin WHERE score >= 0.30 QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY verified DESC, score DESC, providers DESC, title, page) <= 34""")
def blended_rank(s, d):
    return search.ranked(_one(s, d), fixture(s, d, "fetched"), identities(s, d)).select("subject_id", "page", "outcome", "verified", _r("score"), "providers")


@query(f"""WITH {cte('fetched')}, j AS (SELECT f.subject_id, f.url, f.text, i.* EXCLUDE (subject_id) FROM fetched f JOIN ident i USING (subject_id) WHERE authorized), dir AS ({direct('j', 'url', 'text')}) SELECT subject_id, url, round(least(direct * 0.9, ceiling, 0.78), 6) AS score FROM dir""")
def archived_score(s, d):
    d2 = search.direct_score(fixture(s, d, "fetched").select("subject_id", "url", "text").join(identities(s, d), "subject_id"), "url", "text")
    return d2.select("subject_id", "url", F.round(search.historical_score(F.col("direct"), F.col("ceiling")), 6).alias("score"))


@query(f"""WITH {cte('fetched')}, j AS (SELECT i.subject_id AS who, f.url, lower(f.text) AS said, regexp_extract(f.url, '([^/=]+)$', 1) AS username, string_split(lower(full_name), ' ') AS w, i.* EXCLUDE (subject_id) FROM fetched f JOIN ident i ON i.subject_id IN (f.subject_id, f.subject_id + 2) WHERE authorized),
  k AS (SELECT *, coalesce(len(w) > 1, false) AS many, email IS NOT NULL OR alias IS NOT NULL AS known, handle IS NOT NULL OR other IS NOT NULL AS handled FROM j),
  m AS (SELECT *, many OR known OR handled OR profile_url IS NOT NULL AS strong, many OR known OR handled AS meant FROM k)
  SELECT who AS subject_id, url, coalesce(lower(profile_url) = lower(url), false) OR (strong AND coalesce(lower(handle) = lower(username), false)) OR (strong AND coalesce(lower(other) = lower(username), false)) OR (strong AND (
      (coalesce(contains(said, lower(full_name)), false) AND (many OR known)) OR (many AND contains(said, w[1]) AND contains(said, w[-1])) OR coalesce(contains(said, lower(email)), false) OR coalesce(contains({digits('said')}, {digits('phone')}), false)
      OR (meant AND (coalesce(contains(said, lower(alias)), false) OR coalesce(contains(said, lower(location)), false) OR coalesce(contains(said, lower(organization)), false)))
      OR (many AND len(w[1]) >= 3 AND len(w[-1]) >= 3 AND contains(lower(username), w[1]) AND contains(lower(username), w[-1])))) AS belongs FROM m""")
def belongs_to_subject(s, d):
    """Each page beside its own subject and the next but one."""
    pages = fixture(s, d, "fetched").select(F.explode(F.array("subject_id", F.col("subject_id") + 2)).alias("subject_id"), "url", "text", F.regexp_extract("url", "([^/=]+)$", 1).alias("username"))
    j = pages.join(identities(s, d), "subject_id")
    return j.select("subject_id", "url", search.belongs(j, "username", "url", "text").alias("belongs"))


LINKS = """raw AS (SELECT subject_id, 0 AS k, url AS u FROM hit UNION ALL SELECT subject_id, 1, replace(url, 'https://github.com/', 'www.github.com/@') FROM hit UNION ALL SELECT subject_id, 2, 'https://old.reddit.com/user/' || letters || '/about' FROM ident UNION ALL SELECT subject_id, 3, 'https://m.youtube.com/@' || letters FROM ident
    UNION ALL SELECT subject_id, 4, 'https://news.ycombinator.com/user?id=' || letters FROM ident UNION ALL SELECT subject_id, 5, 'https://github.com/settings/keys' FROM ident UNION ALL SELECT subject_id, 6, 'https://uk.linkedin.com/in/' || letters || '?x=1' FROM ident UNION ALL SELECT subject_id, 7, 'https://bsky.app/profile/' || letters || '.example' FROM ident)"""


@query(f"WITH {cte('hit')}, {PLAT}, {LINKS} " + resolve("(SELECT raw.* FROM raw JOIN ident USING (subject_id) WHERE authorized)", "subject_id, k, u", "u"))
def profile_resolve(s, d):
    i, h = fixture(s, d, "ident"), fixture(s, d, "hit")
    more = lambda k, x: i.select("subject_id", F.lit(k).alias("k"), F.expr(x).alias("u"))
    raw = h.select("subject_id", F.lit(0).alias("k"), F.col("url").alias("u")).unionByName(h.select("subject_id", F.lit(1).alias("k"), F.replace("url", F.lit("https://github.com/"), F.lit("www.github.com/@")).alias("u")))
    for k, x in enumerate(["'https://old.reddit.com/user/' || letters || '/about'", "'https://m.youtube.com/@' || letters", "'https://news.ycombinator.com/user?id=' || letters", "'https://github.com/settings/keys'", "'https://uk.linkedin.com/in/' || letters || '?x=1'", "'https://bsky.app/profile/' || letters || '.example'"]):
        raw = raw.unionByName(more(k + 2, x))
    raw = raw.distinct().join(i.where("authorized").select("subject_id"), "subject_id", "left_semi").withColumn("r", P.resolved(F.col("u"))).where("r is not null")
    return raw.select("subject_id", F.col("k").cast("long").alias("k"), "u", "r.platform", "r.handle", F.col("r.url").alias("profile"))


@query(f"""WITH {cte('hit')} SELECT DISTINCT url, {host('url')} = '' OR {on('url', P.ENGINES)} OR {' OR '.join(f"ends_with(lower({path('url')}), {q(e)})" for e in P.FILES)} AS noisy, {on('url', P.EXPOSURE_HOSTS)} AS known, contains({host('url')}, 'bing.com') OR contains({host('url')}, 'duckduckgo.com') OR contains(lower(url), 'base64') OR {host('url')} = '' AS noisy_image FROM hit JOIN ident USING (subject_id) WHERE authorized""")
def result_filters(s, d):
    u = F.col("url")
    d = fixture(s, d, "hit").join(identities(s, d).select("subject_id"), "subject_id", "left_semi").select("url").distinct()
    return d.select("url", P.noisy(u).alias("noisy"), P.known_host(u).alias("known"), P.noisy_image(u).alias("noisy_image"))


NO_HANDLE = f"(lower(h) IN ({names(P.NO_HANDLE)}) OR NOT regexp_matches(lower(h), '\\p{{L}}') OR ends_with(lower(h), 'noreply.github.com'))"
WORDS = [(w, p) for w, p in P.MENTIONS]
STARTS = " ".join(f"WHEN starts_with(lower(m), {q(w)}) THEN {q(p)}" for w, p in WORDS)
NEAR = " ".join(f"WHEN contains(lower(win), {q(w)}) THEN {q(p)}" for w, p in WORDS if w != "x")
PHRASE = "(?i)(?:" + "|".join(w.replace(".", "[.]") for w, _ in WORDS if w not in ("x", "hn")) + r")\s*(?:as|:|@|->|is|id)?\s*@?([a-z0-9][a-z0-9._-]{1,29})"
MENTION = f"""page AS (SELECT f.* FROM fetched f JOIN ident i USING (subject_id) WHERE authorized),
  said AS (SELECT subject_id, url, unnest(regexp_extract_all(text, {q(PHRASE)}, 0)) AS m, unnest(regexp_extract_all(text, {q(PHRASE)}, 1)) AS h, generate_subscripts(regexp_extract_all(text, {q(PHRASE)}, 0), 1) - 1 AS o FROM page),
  ats AS (SELECT subject_id, url, text, unnest(regexp_extract_all(text, '(?i)@[a-z0-9._-]{{2,30}}')) AS m, generate_subscripts(regexp_extract_all(text, '(?i)@[a-z0-9._-]{{2,30}}'), 1) - 1 AS o FROM page),
  nears AS (SELECT subject_id, url, substr(m, 2) AS h, 1000000 + o AS o, substr(text, greatest(strpos(text, m) - 40, 1), strpos(text, m) + len(m) + 39 - greatest(strpos(text, m) - 40, 1)) AS win FROM ats),
  ment AS (SELECT * FROM (SELECT subject_id, url, o, h, CASE {STARTS} END AS platform FROM said UNION ALL SELECT subject_id, url, o, h, CASE {NEAR} END FROM nears) WHERE platform IS NOT NULL AND len(h) BETWEEN 2 AND 40 AND NOT {NO_HANDLE} QUALIFY row_number() OVER (PARTITION BY subject_id, url, lower(h), platform ORDER BY o) = 1)"""


@query(f"WITH {cte('fetched')}, {MENTION} SELECT subject_id, url, h AS handle, platform, o AS ord FROM ment")
def mention_handles(s, d):
    pages = fixture(s, d, "fetched").join(identities(s, d).select("subject_id"), "subject_id", "left_semi")
    return handles.mentions(pages, ["subject_id", "url"]).select("subject_id", "url", "handle", "platform", "ord")


URLRX = r"https?://[-\w.~:/?#@!$&'()*+,;=%\[\]]+"


@query(rf"WITH {cte('fetched')} SELECT f.subject_id, f.url AS page, regexp_replace(unnest(regexp_extract_all(text, {q(URLRX)})), '[,.)\]}};:!]+$', '') AS link FROM fetched f JOIN ident i USING (subject_id) WHERE authorized")
def url_extract_mentions(s, d):
    pages = fixture(s, d, "fetched").join(identities(s, d).select("subject_id"), "subject_id", "left_semi")
    return pages.select("subject_id", F.col("url").alias("page"), F.explode(handles.links_in(F.col("text"))).alias("link"))


PIVOT = f"""{cte('fetched')}, {PLAT}, {MENTION}, lnk AS (SELECT subject_id, url, regexp_replace(unnest(regexp_extract_all(text, {q(URLRX)})), '[,.)\\]}};:!]+$', '') AS link, generate_subscripts(regexp_extract_all(text, {q(URLRX)}), 1) - 1 AS o FROM page),
  lres AS ({resolve('lnk', 'subject_id, url, o', 'link')}), scanned AS (SELECT subject_id, lower('https://github.com/' || handle) AS k FROM ident WHERE handle IS NOT NULL UNION SELECT subject_id, lower('https://gitlab.com/' || letters || 'gl') FROM ident WHERE subject_id % 8 = 0),
  found AS (SELECT subject_id, url, handle AS h, platform, profile, 0.7::DOUBLE AS confidence, o FROM lres UNION ALL SELECT subject_id, m.url, h, platform, replace(pattern, '{{u}}', h), 0.6::DOUBLE, 10000000 + o FROM ment m JOIN plat USING (platform)),
  fresh AS (SELECT f.* FROM found f WHERE len(h) BETWEEN 2 AND 40 AND NOT {NO_HANDLE} AND lower(profile) != lower(url) AND NOT EXISTS (SELECT 1 FROM scanned s WHERE s.subject_id = f.subject_id AND s.k = lower(f.profile)) QUALIFY row_number() OVER (PARTITION BY f.subject_id, f.url, lower(profile) ORDER BY o) = 1)"""


def _pivots(s, d):
    i = fixture(s, d, "ident")
    scanned = i.where("handle is not null").select("subject_id", F.concat(F.lit("https://github.com/"), "handle").alias("url")).unionByName(i.where("subject_id % 8 = 0").select("subject_id", F.expr("'https://gitlab.com/' || letters || 'gl'").alias("url"))).distinct()
    pages = fixture(s, d, "fetched").join(identities(s, d).select("subject_id"), "subject_id", "left_semi")
    return handles.pivots(pages, scanned, S.platforms(s))


@query(f"WITH {PIVOT} SELECT subject_id, url AS source, h AS username, platform, profile AS url, confidence FROM fresh")
def handle_pivots(s, d):
    return _pivots(s, d).select("subject_id", "source", "username", "platform", "url", "confidence")
