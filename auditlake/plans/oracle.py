"""The catalogue's queries as DuckDB SQL, over views of the same tables."""

from __future__ import annotations

from auditlake.functions import text as T
from auditlake.functions.urls import TRACKING
from auditlake.sources.tables import FIRST_NAMES, PLATFORMS


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(rows) -> str:
    one = lambda v: q(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


PLAT = f"plat AS (SELECT * FROM (VALUES {values((i, *p) for i, p in enumerate(PLATFORMS))}) v(ord, platform, pattern, by_default, host, prefix))"
SUBJ = f"""subj AS (SELECT c_custkey AS subject_id,
    concat_ws(' ', [{', '.join(map(q, FIRST_NAMES))}][c_custkey % 7 + 1], CASE WHEN c_custkey % 5 = 0 THEN 'van' END, lower(regexp_replace(n_name, '[ _]', '', 'g')) || c_custkey) AS full_name,
    'user' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') AS handle,
    'user' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') || '@' || lower(c_mktsegment) || '.example' AS email,
    '+1 415 555 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone,
    substr(r_name, 1, 1) || lower(substr(r_name, 2)) AS location,
    substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2)) || ' Labs' AS organization,
    c_custkey % 2 = 0 AS authorized
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
PAGE = """page AS (SELECT subject_id AS doc_id, 'https://people.example/' || handle AS url,
    full_name || ' lives in ' || location || ', works at ' || organization || '; please call ' || phone || ' or write to ' || email || CASE WHEN subject_id % 3 = 0 THEN ' / github: @' || handle ELSE '' END AS text FROM subj)"""
PLACES = f"""raw AS (SELECT doc_id, 'Location' AS type, unnest(regexp_extract_all(text, {q(T.LOCATION)}, 1)) AS raw, generate_subscripts(regexp_extract_all(text, {q(T.LOCATION)}, 1), 1) - 1 AS ord FROM page
    UNION ALL SELECT doc_id, 'Organization', unnest(regexp_extract_all(text, {q(T.ORGANIZATION)}, 1)), generate_subscripts(regexp_extract_all(text, {q(T.ORGANIZATION)}, 1), 1) - 1 FROM page),
  places AS (SELECT doc_id, type, regexp_replace(trim(raw), {q("[-.,;:!)" + chr(92) + "]}']+$")}, '') AS value, ord FROM raw QUALIFY row_number() OVER (PARTITION BY doc_id, type, lower(regexp_replace(trim(raw), {q("[-.,;:!)" + chr(92) + "]}']+$")}, '')) ORDER BY ord) = 1)"""
FIND = f"""{SUBJ}, {PAGE}, {PLACES},
  find AS (SELECT subject_id AS case_id, 0 AS ord, 'Email' AS type, email AS value, 'https://people.example/' || handle AS url, CAST(0.99 AS FLOAT) AS confidence, 'High' AS risk FROM subj WHERE authorized
    UNION ALL SELECT doc_id, 100000 + strpos(text, phone), 'Phone', phone, url, CAST(0.99 AS FLOAT), 'Critical' FROM page JOIN subj ON doc_id = subject_id WHERE authorized
    UNION ALL SELECT doc_id, CASE type WHEN 'Location' THEN 200000 ELSE 300000 END + ord, type, value, url, CAST(0.64 AS FLOAT), 'Medium' FROM places JOIN page USING (doc_id) JOIN subj ON doc_id = subject_id WHERE authorized),
  weighed AS (SELECT *, CASE risk WHEN 'Low' THEN 25 WHEN 'Medium' THEN 50 WHEN 'High' THEN 80 ELSE 100 END AS w FROM find)"""


def key(u: str) -> str:
    kept = f"list_filter(string_split(regexp_extract(split_part({u}, '#', 1), '\\?(.*)$', 1), '&'), lambda x: x != '' AND lower(split_part(x, '=', 1)) NOT IN ({', '.join(map(q, TRACKING))}))"
    return f"lower(regexp_replace(split_part(split_part({u}, '#', 1), '?', 1) || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END, '/+$', ''))"


HOST = lambda u: rf"regexp_replace(lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '')"
H = lambda k: f"(((vec_id * {k}) % 1000003) * 4294967 + (vec_id * {k + 2}) % 65537)"
CLASS = " ".join(f"WHEN s >= {x} THEN {q(k)}" for x, k in ((0.94, "near_exact"), (0.87, "strong"), (0.8, "possible")))

SQL = {
    "pii_email_findings": rf"""SELECT doc_id, value, ord FROM (SELECT doc_id, unnest(regexp_extract_all(text, {q(T.EMAIL)})) AS value, generate_subscripts(regexp_extract_all(text, {q(T.EMAIL)}), 1) - 1 AS ord FROM documents) QUALIFY row_number() OVER (PARTITION BY doc_id, lower(value) ORDER BY ord) = 1""",
    "pii_email_attributed": rf"""WITH {SUBJ}, {PAGE}, t AS (SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id, text FROM page),
  e AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {q(T.EMAIL)})) AS value FROM t)
  SELECT doc_id, value, subject_id, CASE WHEN subject_id IS NULL THEN 0.42 ELSE 0.99 END::DOUBLE AS confidence, CASE WHEN subject_id IS NULL THEN 'Low' ELSE 'High' END AS risk FROM e LEFT JOIN (SELECT * FROM subj WHERE authorized) s ON lower(e.value) = lower(s.email)""",
    "pii_phone_candidates": f"WITH {SUBJ}, {PAGE} SELECT doc_id, strpos(text, phone) AS start, phone AS raw, regexp_replace(phone, '[^0-9]', '', 'g') AS digits, true AS context FROM page JOIN subj ON doc_id = subject_id",
    "pii_location_org": f"WITH {SUBJ}, {PAGE}, {PLACES} SELECT doc_id, type, value, ord FROM places",
    "findings": f"WITH {FIND} SELECT case_id, ord, type, value, url, round(confidence::DOUBLE, 6) AS confidence, risk FROM find",
    "url_https": "SELECT page_id, 'https:' || regexp_replace(url, '^https?:', '') AS url FROM pages",
    "url_canonical": rf"""WITH p AS (SELECT page_id, url, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=A&q=1#x' AS u FROM pages) SELECT page_id, {key('u')} AS key, {HOST('url')} || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS place FROM p""",
    "url_registrable_domain": f"WITH h AS (SELECT string_split({HOST('url')}, '.') AS l FROM pages) SELECT array_to_string(l[greatest(len(l) - 1, 1):], '.') AS domain, count(*) AS pages FROM h GROUP BY 1",
    "url_redirect_unwrap": "SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS target FROM pages",
    "html_title_links": "SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, len(regexp_extract_all(html, '<a [^>]*href=')) AS links FROM pages",
    "page_states": rf"""SELECT page_id, CASE WHEN html IS NULL THEN NULL WHEN regexp_matches(lower(html), {q('|'.join(T.CHALLENGES))}) THEN 'blocked' WHEN regexp_matches(lower(html), {q('|'.join(T.MISSING))}) THEN 'not_found'
  WHEN len(trim(regexp_replace(regexp_replace(html, '<(script|style|noscript)\b.*?</(script|style|noscript)>', ' ', 'gis'), '<[^>]*>|\s+', ' ', 'g'))) < 60 THEN 'thin' ELSE 'ok' END AS state FROM pages""",
    "discovery_metrics": """WITH t AS (SELECT lang, length(text) >= 400 AS said, quality = 1 AS truth FROM documents JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)),
  n AS (SELECT lang, count_if(said AND truth) AS tp, count_if(said AND NOT truth) AS fp, count_if(NOT said AND truth) AS fn, count_if(NOT said AND NOT truth) AS tn FROM t GROUP BY 1)
  SELECT *, round(CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp)::DOUBLE END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn)::DOUBLE END, 6) AS recall, round(CASE WHEN tn + fp = 0 THEN 1.0::DOUBLE ELSE tn / (tn + fp)::DOUBLE END, 6) AS specificity, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0::DOUBLE ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1 FROM n""",
    "breach_prefix_join": f"WITH {SUBJ}, h AS (SELECT *, upper(sha1(lower(trim(email)))) AS h FROM subj) SELECT m.subject_id, left(m.h, 5) AS prefix, coalesce(r.subject_id % 100 + 1, 0) AS count FROM h m LEFT JOIN (SELECT * FROM h WHERE subject_id % 3 = 0) r ON left(m.h, 5) = left(r.h, 5) AND substr(m.h, 6) = substr(r.h, 6) WHERE m.authorized",
    "hash_similarity": f"SELECT vec_id, round(1 - bit_count(xor({H(7919)}, {H(104729)})) / 64.0::DOUBLE, 6) AS similarity FROM embeddings",
    "duplicate_class": f"SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN 'exact' {CLASS} ELSE 'different' END AS class FROM (SELECT vec_id, round(1 - bit_count(xor({H(7919)}, {H(104729)})) / 64.0::DOUBLE + 0.35::DOUBLE, 6) AS s FROM embeddings)",
    "label_mode": "SELECT user_id, arg_max(event_type, (n, -first)) AS mode, max(n) AS n FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY 1",
    "frame_label_merge": "SELECT user_id, lower(event_type) AS label, round(max(value), 6) AS confidence FROM events GROUP BY user_id, lower(event_type) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY max(value) DESC, lower(event_type)) <= 8",
    "frame_text_merge": r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean FROM conversations), o AS (SELECT * FROM t WHERE clean != '' QUALIFY row_number() OVER (PARTITION BY conv_id, lower(clean) ORDER BY turn, clean) = 1) SELECT conv_id, left(string_agg(clean, ' ' ORDER BY turn, clean), 1500) AS text FROM o GROUP BY 1""",
    "frame_timestamps": "WITH c AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1) SELECT DISTINCT conv_id, CAST(floor(turns * 1000 * i / (least(turns, 5) + 1)) AS BIGINT) AS at_ms FROM c, range(1, 6) r(i) WHERE i <= least(turns, 5)",
}
