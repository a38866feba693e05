"""Queries over small normalizers, profile rows, policies, similarity and calibration, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import fields as N
from auditlake.functions import profiles as P
from auditlake.functions import urls as U
from auditlake.functions import vectors as V
from auditlake.operators import calibration, images, pairs, scans
from auditlake.operators.lineage import cut
from auditlake.operators.ordering import keep_first
from auditlake.plans.audit import PLAT, TRACK, _r, cte, fixture, host, identities, key, names, path, q, query, resolve
from auditlake.sources import tables as S
from auditlake.streaming import breaker

# names and candidates

FORMS = [("f || l", "Exact"), ("f || '.' || l", "Dot"), ("f || '_' || l", "Underscore"), ("f || '-' || l", "Hyphen"), ("l || '.' || f", "Dot"), ("l || '_' || f", "Underscore"), ("l || f", "Fuzzy"), ("f", "Fuzzy"), ("l", "Fuzzy"), ("left(f, 1) || l", "Fuzzy"), ("left(f, 1) || '.' || l", "Dot"), ("l || left(f, 1)", "Fuzzy"), ("f || left(l, 1)", "Fuzzy"), ("f || m || l", "Fuzzy"), ("f || '.' || m || '.' || l", "Dot")]
MAILFORMS = [("lower(regexp_replace(loc, '[^A-Za-z0-9._-]', '', 'g'))", "Exact", 1), ("array_to_string(t, '.')", "Dot", 2), ("array_to_string(t, '_')", "Underscore", 2), ("array_to_string(t, '-')", "Hyphen", 2), ("array_to_string(t, '')", "Exact", 1)]
SEEDS = f"""{cte('ident')}, w AS (SELECT subject_id, list_transform(string_split(lower(full_name), ' '), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')) AS p FROM ident WHERE authorized AND full_name IS NOT NULL),
  n AS (SELECT subject_id, p[1] AS f, p[-1] AS l, CASE WHEN len(p) > 2 THEN p[2] END AS m, len(p) AS k FROM w), e AS (SELECT subject_id, split_part(email, '@', 1) AS loc, list_filter(string_split_regex(lower(split_part(email, '@', 1)), '[^a-z0-9]+'), lambda x: x != '') AS t FROM ident WHERE authorized AND email IS NOT NULL),
  su AS (SELECT subject_id, 0 AS ord, handle AS username, 'Exact' AS match FROM ident WHERE authorized AND handle IS NOT NULL UNION ALL SELECT subject_id, 200, other, 'Exact' FROM ident WHERE authorized AND other IS NOT NULL
    UNION ALL SELECT subject_id, 100, f, 'Exact' FROM n WHERE k = 1 UNION ALL {' UNION ALL '.join(f"SELECT subject_id, {100 + i}, {x}, {q(k)} FROM n WHERE k > 1" for i, (x, k) in enumerate(FORMS))}
    UNION ALL {' UNION ALL '.join(f"SELECT subject_id, {300 + i}, {x}, {q(k)} FROM e WHERE len(t) >= {least}" for i, (x, k, least) in enumerate(MAILFORMS))} UNION ALL SELECT subject_id, 310, unnest(list_filter(t, lambda x: len(x) >= 3)), 'Fuzzy' FROM e WHERE len(t) > 1),
  seeds AS (SELECT * FROM su WHERE username IS NOT NULL AND (len(username) >= 2 OR ord IN (0, 100, 200)) QUALIFY row_number() OVER (PARTITION BY subject_id, lower(username) ORDER BY ord) = 1)"""


def _seeds(s, d):
    from auditlake.operators import identity

    return identity.all_seeds(identities(s, d))


@query(f"WITH {SEEDS} SELECT subject_id, username, match FROM seeds")
def username_variants(s, d):
    return _seeds(s, d).select("subject_id", "username", "match")


CAND = f"""{cte('ident')}, {PLAT}, {SEEDS.split(', w AS', 1)[1].join([' w AS', ''])}, src AS (SELECT *, CASE WHEN ord = 0 OR ord = 200 THEN 'handle' WHEN ord >= 300 THEN 'email' ELSE 'name' END AS seed FROM seeds),
  keep AS (SELECT s.* FROM src s JOIN ident i USING (subject_id) WHERE seed != 'name' OR (handle IS NULL AND other IS NULL)),
  cd AS (SELECT k.subject_id, platform, replace(pattern, '{{u}}', username) AS url, CASE WHEN seed = 'handle' THEN 1.0 WHEN seed = 'email' THEN CASE match WHEN 'Exact' THEN 0.85 WHEN 'Fuzzy' THEN 0.65 ELSE 0.75 END WHEN contains(coalesce(full_name, ''), ' ') THEN CASE match WHEN 'Exact' THEN 0.9 WHEN 'Dot' THEN 0.85 WHEN 'Underscore' THEN 0.85 WHEN 'Hyphen' THEN 0.8 ELSE 0.65 END ELSE 0.35 END::DOUBLE AS confidence, k.ord * 100 + pord AS ord
    FROM keep k JOIN ident USING (subject_id), plat WHERE by_default AND (seed != 'name' OR contains(coalesce(full_name, ''), ' ') OR platform IN ('GitHub', 'Reddit')))
  , one AS (SELECT * FROM cd QUALIFY row_number() OVER (PARTITION BY subject_id, url ORDER BY ord, platform) = 1)"""


def _candidates(s, d):
    from auditlake.operators import identity

    return identity.candidates(_seeds(s, d), identities(s, d), S.platforms(s))


@query(f"WITH {CAND} SELECT subject_id, platform, count(*) AS candidates, round(max(confidence), 6) AS best FROM one GROUP BY ALL")
def candidate_fanout(s, d):
    return _candidates(s, d).groupBy("subject_id", "platform").agg(F.count("*").alias("candidates"), F.round(F.max("confidence"), 6).alias("best"))


@query(f"WITH {CAND} SELECT subject_id, platform, url, round(confidence, 6) AS confidence FROM one QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY confidence DESC, ord, url) <= 20")
def candidate_cap(s, d):
    from auditlake.operators import identity

    return identity.capped(_candidates(s, d), 20).select("subject_id", "platform", "url", _r("confidence"))


# values


@query(rf"""WITH {cte('hit')}, u AS (SELECT DISTINCT replace(url, 'https://github.com/', 'HTTPS://Git@GitHub.com/') AS url FROM hit JOIN ident USING (subject_id) WHERE authorized)
  SELECT url, regexp_matches(url, '^(?i)https?://') AS http, split_part(url, '#', 1) AS bare, CASE WHEN contains(url, '://') THEN lower(regexp_extract(url, '^([^:]+://)', 1)) || regexp_extract(url, '://([^@/]*@)', 1) || lower(regexp_extract(url, '://(?:[^@/]*@)?([^/?]*)', 1)) || regexp_replace(regexp_extract(split_part(url, '#', 1), '^[^:]+://[^/?]*(.*)$', 1), '/$', '') END AS canonical FROM u""")
def url_forms(s, d):
    u = fixture(s, d, "hit").join(identities(s, d).select("subject_id"), "subject_id", "left_semi").select(F.replace("url", F.lit("https://github.com/"), F.lit("HTTPS://Git@GitHub.com/")).alias("url")).distinct()
    return u.select("url", N.is_http(F.col("url")).alias("http"), U.strip_fragment(F.col("url")).alias("bare"), N.uri_canonical(F.col("url")).alias("canonical"))


@query(f"""WITH {cte('finding')}, e AS (SELECT case_id, ord, 'ev:' || type || ':' || value || ':' || coalesce(url, '') AS id, CASE type WHEN 'Phone' THEN regexp_replace(value, '[^0-9]', '', 'g') ELSE lower(trim(value)) END AS canonical, CASE WHEN trim(remediation) = '' THEN 0 ELSE 1 END AS signals, remediation AS back FROM finding) SELECT case_id, ord::BIGINT AS ord, id, canonical, signals::BIGINT AS signals, back FROM e""")
def evidence_ids(s, d):
    from auditlake.operators.extract import canonical_value

    f = fixture(s, d, "finding").withColumn("sig", N.signals_list(F.col("remediation")))
    return f.select("case_id", F.col("ord").cast("long").alias("ord"), N.evidence_id(F.col("type"), F.col("value"), F.col("url")).alias("id"), canonical_value(F.col("type"), F.col("value")).alias("canonical"), F.size("sig").cast("long").alias("signals"), N.signals_text(F.col("sig")).alias("back"))


@query(f"WITH {cte('ident')} SELECT subject_id, left(upper(sha1(lower(trim(email)))), 6) AS prefix, substr(upper(sha1(lower(trim(email)))), 7) AS suffix FROM ident WHERE authorized AND email IS NOT NULL")
def mail_hashes(s, d):
    return identities(s, d).select("subject_id", F.explode("emails").alias("e")).select("subject_id", N.mail_hash(F.col("e")).alias("h")).select("subject_id", "h.*")


STAMPS = "SELECT doc_id, substr('20240131235959', 1, (doc_id % 15)::INT) AS stamp, CASE doc_id % 4 WHEN 0 THEN 'http://web.archive.org/web/' WHEN 1 THEN ' https://web.archive.org/web/' WHEN 2 THEN 'https://other.example/web/' ELSE 'https://sub.web.archive.org/x/' END || doc_id AS raw FROM documents"


@query(f"SELECT doc_id, CASE WHEN len(stamp) >= 8 THEN '2024-01-31' WHEN len(stamp) >= 6 THEN '2024-01' WHEN len(stamp) >= 4 THEN '2024' ELSE 'unknown date' END AS shown, CASE doc_id % 4 WHEN 2 THEN NULL ELSE replace(trim(raw), 'http://web', 'https://web') END AS url FROM ({STAMPS})")
def capture_forms(s, d):
    t = S.table(s, d, "documents").select("doc_id", F.expr("substr('20240131235959', 1, cast(doc_id % 15 as int))").alias("stamp"), F.concat(F.element_at(F.array(*map(F.lit, ["http://web.archive.org/web/", " https://web.archive.org/web/", "https://other.example/web/", "https://sub.web.archive.org/x/"])), (F.col("doc_id") % 4 + 1).cast("int")), F.col("doc_id").cast("string")).alias("raw"))
    return t.select("doc_id", N.capture_date(F.col("stamp")).alias("shown"), N.capture_url(F.col("raw")).alias("url"))


@query(r"SELECT conv_id, turn, left(trim(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), '\s+', ' ', 'g')), 500) AS safe FROM conversations")
def safe_fields(s, d):
    return S.table(s, d, "conversations").select("conv_id", "turn", N.safe_field(F.col("text")).alias("safe"))


@query(f"""WITH {cte('ident')}, r AS (SELECT subject_id, coalesce(handle, '') || ', ' || coalesce(upper(handle), 'x') || chr(10) || ' ' || letters || chr(9) || ',' || letters AS raw FROM ident WHERE authorized), p AS (SELECT subject_id, trim(v) AS v, o FROM (SELECT subject_id, unnest(string_split_regex(raw, '[,\\n\\t]')) AS v, generate_subscripts(string_split_regex(raw, '[,\\n\\t]'), 1) AS o FROM r) WHERE trim(v) != '' QUALIFY row_number() OVER (PARTITION BY subject_id, lower(trim(v)) ORDER BY o) = 1)
  SELECT r.subject_id, (SELECT string_agg(v, '|' ORDER BY o) FROM p WHERE p.subject_id = r.subject_id) AS signals, len(list_filter(string_split(raw, chr(10)), lambda x: x != '')) AS lines FROM r""")
def signal_lists(s, d):
    r = fixture(s, d, "ident").where("authorized").select("subject_id", F.expr("coalesce(handle, '') || ', ' || coalesce(upper(handle), 'x') || '\n' || ' ' || letters || '\t' || ',' || letters").alias("raw"))
    return r.select("subject_id", F.array_join(N.signal_list(F.col("raw")), "|").alias("signals"), F.size(N.exact_lines(F.col("raw"))).cast("long").alias("lines"))


@query(f"""WITH {cte('ident')}, r AS (SELECT subject_id, CASE subject_id % 4 WHEN 0 THEN 'TEXT: ' || letters || ' shop LANDMARKS: Tower, ' || coalesce(location, 'Bridge') || ' FACE: yes' WHEN 2 THEN 'TEXT: none LANDMARKS: none FACE: no' END AS raw, letters, location FROM ident WHERE authorized)
  SELECT subject_id, CASE subject_id % 4 WHEN 0 THEN letters || ' shop' END AS text, CASE subject_id % 4 WHEN 0 THEN 'Tower|' || coalesce(location, 'Bridge') ELSE '' END AS landmarks, subject_id % 4 = 0 AS face, CASE subject_id % 4 WHEN 0 THEN 'Tower ' || coalesce(location, 'Bridge') || ' ' || letters || ' shop' END AS query FROM r""")
def labelled_fields(s, d):
    r = fixture(s, d, "ident").where("authorized").select("subject_id", F.expr("case subject_id % 4 when 0 then 'TEXT: ' || letters || ' shop LANDMARKS: Tower, ' || coalesce(location, 'Bridge') || ' FACE: yes' else 'TEXT: none LANDMARKS: none FACE: no' end").alias("raw"))
    a = r.select("subject_id", N.analysis(F.col("raw")).alias("a")).select("subject_id", "a.*")
    return a.select("subject_id", "text", F.array_join("landmarks", "|").alias("landmarks"), "face", N.place_query(F.lit(None).cast("string"), F.col("text"), F.col("landmarks")).alias("query"))


QUOTE = lambda x: f"""'"' || left(trim({x}), 90) || '"'"""


@query(f"""WITH {cte('ident')}, i AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS n, list_filter([handle, other, alias], lambda x: x IS NOT NULL) AS hs FROM ident WHERE authorized),
  t AS (SELECT subject_id, {QUOTE('email')} AS query FROM i UNION ALL SELECT subject_id, {QUOTE("split_part(email, '@', 1)")} FROM i WHERE len(split_part(email, '@', 1)) >= 3 UNION ALL SELECT subject_id, {QUOTE('email')} || ' site:github.com' FROM i UNION ALL SELECT subject_id, {QUOTE('n')} FROM i WHERE len(n) >= 8 UNION ALL SELECT subject_id, {QUOTE('right(n, 10)')} FROM i WHERE len(n) >= 10
    UNION ALL SELECT subject_id, {QUOTE('h')} || x FROM (SELECT subject_id, unnest(hs) AS h FROM i), (VALUES (''), (' github reddit gitlab dev.to bluesky youtube'), {', '.join(f"(' site:{s}')" for s in N.RELIABLE)}) v(x)
    UNION ALL SELECT subject_id, {QUOTE('full_name')} || ' ' || {QUOTE('organization')} FROM i UNION ALL SELECT subject_id, {QUOTE('full_name')} || ' ' || {QUOTE('location')} FROM i UNION ALL SELECT subject_id, {QUOTE('full_name')} || ' ' || {QUOTE('h')} FROM (SELECT subject_id, full_name, unnest(hs[:2]) AS h FROM i)
    UNION ALL SELECT subject_id, {QUOTE('full_name')} || x FROM i, (VALUES (''), (' github linkedin x twitter reddit twitch instagram youtube'), {', '.join(f"(' site:{s}')" for s in (*N.PROFILE_SITES, *N.FORUMS))}) v(x) UNION ALL SELECT subject_id, {QUOTE('alias')} || x FROM i, (VALUES (''), (' site:reddit.com')) v(x))
  SELECT DISTINCT subject_id, query, contains(query, '@') OR len(regexp_replace(query, '[^0-9]', '', 'g')) >= 8 OR (NOT contains(query, 'site:') AND ends_with(query, '"')) AS telling FROM t WHERE query IS NOT NULL""")
def search_query_texts(s, d):
    x = identities(s, d).select("subject_id", F.explode(N.search_queries()).alias("query"))
    return x.select("subject_id", "query", N.high_signal(F.col("query")).alias("telling"))


@query(f"""WITH {cte('ident')}, i AS (SELECT *, list_filter([handle, other, alias], lambda x: x IS NOT NULL) AS hs FROM ident WHERE authorized), t AS (SELECT subject_id, {QUOTE('full_name')} || x AS query FROM i, (VALUES (''), (' profile photo'), (' avatar'), (' github linkedin twitter x')) v(x) UNION SELECT subject_id, {QUOTE('h')} || x FROM (SELECT subject_id, unnest(hs) AS h FROM i), (VALUES (' avatar'), (' profile photo')) v(x)) SELECT * FROM t WHERE query IS NOT NULL""")
def image_query_texts(s, d):
    return identities(s, d).select("subject_id", F.explode(N.image_queries()).alias("query"))


@query(f"""WITH {cte('ident')}, i AS (SELECT *, list_filter([handle, other, alias], lambda x: x IS NOT NULL) AS hs FROM ident WHERE authorized), t AS (SELECT subject_id, {QUOTE("'Open ' || letters")} || x AS query FROM i, (VALUES (''), (' image')) v(x) UNION SELECT subject_id, '"Sign" "Tower"' FROM i UNION SELECT subject_id, 'Sign Tower photo' FROM i UNION SELECT subject_id, {QUOTE('full_name')} || x FROM i, (VALUES (' profile photo'), (' avatar')) v(x) UNION SELECT subject_id, {QUOTE('h')} || x FROM (SELECT subject_id, unnest(hs[:3]) AS h FROM i), (VALUES (' avatar'), (' profile photo')) v(x)),
  sc AS (SELECT subject_id, 'Open ' || CASE WHEN len(letters) > 1 THEN letters || ' ' ELSE '' END || 'Tower' AS scene FROM i) SELECT t.subject_id, query, scene FROM t JOIN sc USING (subject_id) WHERE query IS NOT NULL""")
def reverse_image_query_texts(s, d):
    i = identities(s, d).join(fixture(s, d, "ident").select("subject_id", "letters"), "subject_id")
    text, labels = F.concat(F.lit("  Open   "), F.col("letters"), F.lit("\nx\n")), F.array(F.lit("Sign"), F.lit("Tower"), F.lit("sign"))
    d2 = i.select("subject_id", "letters", F.explode(N.reverse_image_queries(text, labels)).alias("query"))
    return d2.select("subject_id", "query", N.scene_query(F.concat(F.lit("Open "), F.col("letters"), F.lit(" 12")), F.array(F.lit("Tree"), F.lit("Tower"))).alias("scene"))


@query(rf"""WITH p AS (SELECT conv_id, trim(v) AS phrase, turn * 1000 + o AS ord FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, {q(N.PLACE)}, 1)) AS v, generate_subscripts(regexp_extract_all(text, {q(N.PLACE)}, 1), 1) AS o FROM (SELECT conv_id, turn, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') AS text FROM conversations)) WHERE len(trim(v)) BETWEEN 4 AND 40 AND lower(trim(v)) NOT IN ({names(N.NO_PLACE)})), c AS (SELECT conv_id, phrase, count(*) AS n, min(ord) AS first FROM p GROUP BY ALL)
  SELECT conv_id, arg_max(phrase, (n, -first)) AS place, max(n) AS n FROM c GROUP BY 1""")
def place_mode(s, d):
    t = S.table(s, d, "conversations").select("conv_id", "turn", F.posexplode(N.place_phrases(F.regexp_replace("text", r"[^\x00-\x7F]", "x"))).alias("o", "phrase"))
    g = t.groupBy("conv_id", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("turn", "o")).alias("first"))
    # of equal counts the first: struct order can't be negated, so its parts are
    return g.groupBy("conv_id").agg(F.max_by("phrase", F.struct("n", -F.col("first.turn"), -F.col("first.o"))).alias("place"), F.max("n").alias("n"))


# profile rows


@query(f"""WITH {cte('profile')}, w AS (SELECT p.*, i.full_name, i.given, i.family, coalesce(contains(trim(i.full_name), ' '), false) AS many, 'My page. ' || CASE p.case_id % 4 WHEN 0 THEN coalesce(i.full_name, '') WHEN 1 THEN '' WHEN 2 THEN i.family || ' and ' || i.given ELSE i.given END AS text FROM profile p JOIN ident i ON i.subject_id = p.case_id)
  SELECT case_id, url, round(least(1.0, confidence::DOUBLE + CASE WHEN many AND contains(lower(text), lower(full_name)) THEN 0.15 WHEN many AND contains(lower(text), lower(given)) AND contains(lower(text), lower(family)) THEN 0.10 WHEN many AND contains(lower(text), lower(given)) THEN 0.05 WHEN NOT many AND full_name IS NOT NULL AND contains(lower(text), lower(given)) THEN 0.02 ELSE 0 END + CASE WHEN contains(lower(coalesce(title, '')), lower(username)) THEN 0.08 ELSE 0 END
    + CASE WHEN many AND contains(lower(username), lower(given)) AND contains(lower(username), lower(family)) THEN 0.03 ELSE 0 END + least(ord * 0.15, 0.20)), 6) AS confidence, round(greatest(0.1, least(0.35, confidence::DOUBLE * 0.25)), 6) AS soft FROM w""")
def profile_confidence(s, d):
    i = fixture(s, d, "ident").select(F.col("subject_id").alias("case_id"), "full_name", "given", "family")
    p = fixture(s, d, "profile").join(i, "case_id").withColumn("text", F.expr("'My page. ' || case case_id % 4 when 0 then coalesce(full_name, '') when 1 then '' when 2 then family || ' and ' || given else given end"))
    c = scans.profile_confidence(F.col("confidence").cast("double"), F.coalesce("full_name", F.lit("")), F.col("text"), F.coalesce("title", F.lit("")), F.col("username"), F.col("ord") * 3)
    return p.select("case_id", "url", F.round(c, 6).alias("confidence"), F.round(scans.soft_confidence(F.col("confidence").cast("double")), 6).alias("soft"))


HITROWS = f"""{cte('hit')}, {PLAT}, h AS (SELECT hit.*, 0.4::DOUBLE + ord * 0.1 AS score FROM hit JOIN ident USING (subject_id) WHERE authorized), res AS ({resolve('h', 'subject_id, ord', 'url')}),
  m AS (SELECT h.*, res.platform, res.handle AS rh, coalesce(res.profile, h.url) AS at_ FROM h LEFT JOIN res USING (subject_id, ord))"""


@query(f"""WITH {HITROWS} SELECT subject_id, ord * 10 AS ord, 'PlausibleProfileMatch' AS type, at_ AS value, at_ AS url, round(score, 6) AS confidence, CASE WHEN score >= 0.7 THEN 'Medium' ELSE 'Low' END AS risk FROM m WHERE platform IS NOT NULL
  UNION ALL SELECT subject_id, ord * 10 + (platform IS NOT NULL)::INT, 'PublicSearchEvidence', title, at_, round(score, 6), CASE WHEN score >= 0.75 THEN 'Medium' ELSE 'Low' END FROM m""")
def hit_findings(s, d):
    h = fixture(s, d, "hit").join(identities(s, d).select("subject_id"), "subject_id", "left_semi").withColumn("score", F.lit(0.4) + F.col("ord") * F.lit(0.1))
    return scans.from_hits(h)[1].select("subject_id", "ord", "type", "value", "url", _r("confidence"), "risk")


@query(f"WITH {HITROWS} SELECT subject_id, at_ AS url, coalesce(platform, 'Website') AS platform, coalesce(rh, {host('url')}) AS username, CASE WHEN platform IS NULL THEN 'indexed' ELSE 'plausible' END AS status FROM m")
def hit_profiles(s, d):
    h = fixture(s, d, "hit").join(identities(s, d).select("subject_id"), "subject_id", "left_semi").withColumn("score", F.lit(0.5))
    return scans.from_hits(h)[0].select("subject_id", "url", "platform", "username", "status")


@query(f"""WITH {cte('hit')}, h AS (SELECT hit.* FROM hit JOIN ident USING (subject_id) WHERE authorized), seen AS (SELECT DISTINCT subject_id, {key('url')} AS k FROM h WHERE ord IN (0, 4)) SELECT subject_id, ord::BIGINT AS ord, url FROM h WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.subject_id = h.subject_id AND k = {key('h.url')})""")
def unverified_hits(s, d):
    """Hits whose page isn't among those known already: that of the first hit and of the fifth."""
    h = fixture(s, d, "hit").join(identities(s, d).select("subject_id"), "subject_id", "left_semi").withColumn("k", U.canonical_key(F.col("url")))
    return h.join(h.where("ord in (0, 4)").select("subject_id", "k").distinct(), ["subject_id", "k"], "left_anti").select("subject_id", F.col("ord").cast("long").alias("ord"), "url")


PICS = f"""{cte('hit')}, pic AS (SELECT h.subject_id, h.ord, h.source, h.title, 'https://img.example/' || i.letters || h.ord % 3 || '.png' AS image, CASE WHEN h.ord % 2 = 0 THEN 'https://t.example/' || h.ord END AS thumbnail, h.url AS page, CASE WHEN h.ord % 3 = 0 THEN 'x avatar' ELSE 'x' END AS query, i.* EXCLUDE (subject_id) FROM hit h JOIN ident i USING (subject_id) WHERE authorized),
  sc AS (SELECT *, lower(title || ' ' || image || ' ' || page) AS said, list_filter(string_split(lower(coalesce(full_name, '')), ' '), lambda w: len(w) >= 3) AS w3, list_transform(list_filter([handle, other, alias], lambda x: x IS NOT NULL), lambda x: lower(x)) AS hs FROM pic),
  scored AS (SELECT *, least(0.9, 0.10 + CASE WHEN full_name IS NOT NULL AND contains(said, lower(full_name)) THEN 0.28 ELSE 0 END + CASE WHEN len(w3) >= 2 AND len(list_filter(w3, lambda w: contains(said, w))) = len(w3) THEN 0.16 ELSE 0 END + CASE WHEN len(list_filter(hs, lambda h: contains(said, h))) > 0 THEN 0.18 ELSE 0 END + CASE WHEN len(list_filter(hs, lambda h: contains(lower(page), h))) > 0 THEN 0.12 ELSE 0 END
    + CASE WHEN {' OR '.join(f"{host('page')} = {q(h)} OR ends_with({host('page')}, {q('.' + h)})" for h in ('github.com', 'linkedin.com', 'x.com', 'twitter.com', 'instagram.com', 'reddit.com', 'youtube.com', 'twitch.tv', 'medium.com', 'dev.to'))} THEN 0.08 ELSE 0 END + CASE WHEN contains(query, 'avatar') THEN 0.05 ELSE 0 END)::DOUBLE AS score FROM sc)"""


def _pictures(s, d):
    h = fixture(s, d, "hit").join(fixture(s, d, "ident").select("subject_id", "letters"), "subject_id")
    p = h.select("subject_id", "ord", "source", "title", F.concat(F.lit("https://img.example/"), "letters", (F.col("ord") % 3).cast("string"), F.lit(".png")).alias("image"), F.when(F.col("ord") % 2 == 0, F.concat(F.lit("https://t.example/"), F.col("ord").cast("string"))).alias("thumbnail"), F.col("url").alias("page"), F.when(F.col("ord") % 3 == 0, "x avatar").otherwise("x").alias("query"))
    return p.join(identities(s, d), "subject_id").withColumn("score", F.round(scans.image_score(), 9))


@query(f"WITH {PICS}, o AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY subject_id, {key('image')}, {key('page')} ORDER BY ord) = 1) SELECT subject_id, ord::BIGINT AS ord, round(score, 6) AS score FROM o QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY round(score, 9) DESC, source, title, {key('image')} || '|' || {key('page')}) <= 4")
def image_hit_rank(s, d):
    return scans.ranked_images(_pictures(s, d), most=4).select("subject_id", F.col("ord").cast("long").alias("ord"), _r("score"))


@query(f"WITH {PICS} SELECT subject_id, title, page, coalesce(thumbnail, image) AS thumbnail, round(score, 6) AS score, CASE WHEN round(score, 9) >= 0.65 THEN 'Medium' ELSE 'Low' END AS risk FROM (SELECT * REPLACE (CASE WHEN ord = 3 THEN NULL ELSE image END AS image) FROM scored) WHERE coalesce(thumbnail, image) IS NOT NULL OR {key('page')} NOT IN (SELECT {key('page')} FROM scored x WHERE x.ord = 0) QUALIFY row_number() OVER (PARTITION BY subject_id, coalesce(thumbnail, image, ''), {key('page')} ORDER BY ord) = 1")
def image_hit_rows(s, d):
    p = _pictures(s, d).withColumn("image", F.when(F.col("ord") != 3, F.col("image")))
    return scans.image_rows(p, p.where("ord = 0").select("subject_id", F.col("page").alias("url"))).select("subject_id", "title", "page", "thumbnail", _r("score"), "risk")


@query(f"WITH {cte('profile')} SELECT case_id, url, image FROM profile WHERE there AND trim(image) != '' QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY verified DESC, confidence DESC, ord) <= 2")
def picked_profile_images(s, d):
    return scans.picked_images(fixture(s, d, "profile"), 2)


@query("SELECT k AS lang, count_if(e = 'belongs' AND a = 'verified') AS tp, count_if(e != 'belongs' AND a = 'verified') AS fp, count_if(e = 'belongs' AND a != 'verified') AS fn, count_if(e = 'other' AND a != 'verified') AS tn, count_if(e = 'unverifiable' AND a = 'unverifiable') AS unverifiable, count(*) AS total, round(count_if(e = 'unverifiable' AND a = 'unverifiable') / count(*)::DOUBLE, 6) AS accuracy FROM (SELECT lang AS k, ['belongs', 'other', 'unverifiable'][(doc_id % 3 + 1)::INT] AS e, ['verified', 'plausible', 'not_found', 'unverifiable'][(n_chars % 4 + 1)::INT] AS a FROM documents) GROUP BY 1")
def discovery_outcomes(s, d):
    from auditlake.operators import discovery

    at = lambda names_, i: F.element_at(F.array(*map(F.lit, names_)), (i + 1).cast("int"))
    x = S.table(s, d, "documents").select("lang", at(["belongs", "other", "unverifiable"], F.col("doc_id") % 3).alias("e"), at(["verified", "plausible", "not_found", "unverifiable"], F.col("n_chars") % 4).alias("a"))
    return discovery.outcomes(x, "e", "a", ["lang"])


# policies


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN least(60, greatest(0, event_id % 90 - 10)) * 1000 ELSE least(6000, 600 * pow(2, least(4, greatest(0, event_id % 7)))::BIGINT + (event_id % 7 + 1) * 137 % 311) END AS delay FROM events")
def retry_delays(s, d):
    after = F.when(F.col("user_id") % 5 == 0, F.concat(F.lit(" "), (F.col("event_id") % 90 - 10).cast("string"))).otherwise(F.when(F.col("user_id") % 5 == 1, "soon"))
    return S.table(s, d, "events").select("event_id", breaker.retry_delay(F.col("event_id") % 7, after).alias("delay"))


@query()
def circuit_breaker_states(s, d):
    e = S.table(s, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_type") == "error").alias("failed")).withColumn("at", F.col("us") / 1e6)
    return breaker.breaker(e, "user_id", 3, 86_400.0)


@query("""WITH i AS (SELECT *, sum((event_type != 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events) SELECT event_id, user_id, CAST(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS streak FROM i""")
def failure_streaks(s, d):
    return breaker.streaks(S.table(s, d, "events"), F.col("event_type") == "error").select("event_id", "user_id", "streak")


@query()
def cached_requests(s, d):
    e = S.table(s, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return breaker.cache_hits(e, "user_id", 86_400.0).select("event_id", "user_id", "hit")


@query("""WITH a AS (SELECT user_id % 400 AS query_id, user_id % 7 AS start, event_id % 5 AS provider, CASE WHEN event_type != 'error' THEN event_id % 11 END AS url_key, user_id % 3 = 0 AS high, (user_id + event_id) % 13 = 0 AS open FROM events), x AS (SELECT DISTINCT query_id, start % 5 AS start, provider, url_key, high, open FROM a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY start, provider) <= 1000000),
  y AS (SELECT query_id, min(start) AS start FROM x GROUP BY 1), b AS (SELECT DISTINCT query_id, (provider - y.start + 5) % 5 AS circle, url_key, high FROM (SELECT query_id, provider, url_key, bool_or(high) OVER (PARTITION BY query_id) AS high, open FROM x WHERE NOT open) JOIN y USING (query_id)),
  t AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY circle) AS turn FROM b), n AS (SELECT query_id, turn, count(*) AS fresh FROM (SELECT query_id, url_key, min(turn) AS turn FROM t WHERE url_key IS NOT NULL GROUP BY ALL) GROUP BY ALL),
  g AS (SELECT query_id, turn, high, max((url_key IS NOT NULL)::INT) AS gave FROM t GROUP BY ALL), c AS (SELECT g.*, coalesce(sum(coalesce(fresh, 0)) OVER w, 0) AS pages, coalesce(sum(gave) OVER w, 0) AS sources FROM g LEFT JOIN n USING (query_id, turn) WINDOW w AS (PARTITION BY query_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT query_id, turn, count(*) AS asked FROM c WHERE turn <= CASE WHEN high THEN 3 ELSE 2 END AND NOT CASE WHEN high THEN sources >= 3 AND pages >= 2 ELSE pages >= 5 END GROUP BY ALL""")
def provider_failover(s, d):
    from pyspark.sql import Window as W

    a = S.table(s, d, "events").select((F.col("user_id") % 400).alias("query_id"), ((F.col("user_id") % 7) % 5).alias("start"), (F.col("event_id") % 5).alias("provider"), F.when(F.col("event_type") != "error", F.col("event_id") % 11).alias("url_key"), (F.col("user_id") % 3 == 0).alias("high"), ((F.col("user_id") + F.col("event_id")) % 13 == 0).alias("open")).distinct()
    one = W.partitionBy("query_id")
    a = a.withColumn("start", F.min("start").over(one)).where("not open").withColumn("high", F.bool_or("high").over(one)).distinct()
    return breaker.failover(a, 5).select("query_id", F.col("turn").cast("long").alias("turn")).distinct().withColumn("asked", F.lit(1).cast("long"))


# similarity: queries are the rows whose id is divisible by 50, against all rows

COS = """list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"""
PAIRS = f"""pairs AS (SELECT a.vec_id, b.vec_id AS other, a.label = b.label AS same, a.label::BIGINT AS label, CASE WHEN b.vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS side, round(greatest(-1, least(1, {COS})), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id != a.vec_id WHERE a.vec_id % 50 = 0),
  lim AS (SELECT score, count(*) AS n, (SELECT count(*) FROM pairs WHERE NOT same) AS negatives, sum(count(*)) OVER (ORDER BY score DESC) - count(*) AS above FROM pairs WHERE NOT same GROUP BY score)"""
THR = "thr AS (SELECT negatives, min(score) AS threshold FROM lim WHERE above <= floor({r} * negatives) GROUP BY negatives)"


def _vectors(s, d):
    """(queries, rows) as (id, label, embedding)."""
    e = S.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return e.where("id % 50 = 0"), e


def _blocks(s, d):
    return pairs.met(*_vectors(s, d))


def _tally(s, d):
    """Written once: thresholds and rates read it more than once."""
    return cut(pairs.tally(_blocks(s, d)))


@query(f"WITH {PAIRS} SELECT vec_id, other, score FROM pairs QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) <= 10")
def embedding_neighbours(s, d):
    return pairs.nearest(_blocks(s, d), 10).select(F.col("id").alias("vec_id"), "other", "score")


@query(f"WITH {PAIRS} SELECT vec_id, count(*) AS pairs, round(avg(score), 4) AS mean, max(score) AS best FROM pairs GROUP BY 1")
def embedding_cosine_pairs(s, d):
    return pairs.summed(_blocks(s, d)).select(F.col("id").alias("vec_id"), "pairs", F.round("mean", 4).alias("mean"), "best")


@query(f"WITH {PAIRS}, {THR.format(r='0.05')} SELECT negatives, CAST(floor(0.05 * negatives) AS BIGINT) AS allowed, threshold FROM thr")
def embedding_threshold(s, d):
    return calibration.threshold(_tally(s, d), 0.05).select("negatives", "allowed", "threshold")


@query(f"""WITH {PAIRS}, {THR.format(r='0.05')}, g AS (SELECT 'label' AS field, label::VARCHAR AS g, same, score FROM pairs UNION ALL SELECT 'side', side, same, score FROM pairs) SELECT field, g AS "group", count_if(same) AS positives, count_if(NOT same) AS negatives, round(avg(CASE WHEN same THEN (score > threshold)::INT::DOUBLE END), 6) AS true_accept, round(avg(CASE WHEN NOT same THEN (score > threshold)::INT::DOUBLE END), 6) AS false_accept FROM g, thr GROUP BY ALL""")
def embedding_rates_by_group(s, d):
    return calibration.judged_rates(pairs.judged(_blocks(s, d), calibration.threshold(_tally(s, d), 0.05)), ["label", "side"])


@query(f"""WITH {PAIRS}, {THR.format(r='0.05')}, th2 AS (SELECT min(score) AS t2 FROM lim WHERE above <= floor(0.001 * negatives)) SELECT count_if(same) AS positives, count_if(NOT same) AS negatives, round(avg(CASE WHEN NOT same THEN (score > threshold)::INT::DOUBLE END), 6) AS review_false, round(avg(CASE WHEN same THEN (score > threshold)::INT::DOUBLE END), 6) AS review_true, round(avg(CASE WHEN NOT same THEN (score > t2)::INT::DOUBLE END), 6) AS high_false, round(avg(CASE WHEN same THEN (score > t2)::INT::DOUBLE END), 6) AS high_true FROM pairs, thr, th2""")
def calibration_rates(s, d):
    p = _tally(s, d).withColumn("score", F.col("score").cast("float"))
    return calibration.calibrated(p).select("positives", "negatives", *[_r(c) for c in ("review_false", "review_true", "high_false", "high_true")])


@query()
def bootstrap_intervals(s, d):
    p = _tally(s, d)
    return calibration.bootstrap(p, calibration.threshold(p, 0.05))


@query(f"WITH {PAIRS} SELECT CASE WHEN score >= 0.2 THEN 'high' WHEN score >= 0.1 THEN 'review' ELSE 'none' END AS band, count(*) AS pairs FROM pairs GROUP BY 1")
def similarity_bands(s, d):
    return pairs.tally(_blocks(s, d)).groupBy(V.decision(F.col("score"), F.lit(0.1), F.lit(0.2)).alias("band")).agg(F.sum("n").alias("pairs"))


@query(f"WITH {PAIRS} SELECT side AS split, count_if(same) AS positives, count_if(NOT same) AS negatives, count_if(same) >= 500 AND count_if(NOT same) >= 10000 AS enough FROM pairs GROUP BY 1")
def split_counts(s, d):
    g = pairs.split(*_vectors(s, d), F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    return calibration.enough(g.withColumnRenamed("side", "split"), 500, 10_000)


BODY = """CASE vec_id % 3 WHEN 0 THEN '{"reviewThreshold": 0.5, "highSimilarityThreshold": 0.7, "positivePairCount": ' || vec_id || ', "negativePairCount": 20000, "reviewFalseMatchRate": 0.05, "highFalseMatchRate": 0.01, "reviewTrueMatchRate": 0.9, "highTrueMatchRate": 0.8}' WHEN 1 THEN '{"review_threshold": 0.9, "high_similarity_threshold": 0.7}' ELSE '{"review_threshold": 0.1}' END"""


@query("""SELECT vec_id, CASE WHEN p = 'x' THEN NULL ELSE p END AS problem FROM (SELECT vec_id, 'review above high' AS p FROM embeddings WHERE vec_id % 3 >= 1 UNION ALL SELECT vec_id, 'too few positive pairs' FROM embeddings WHERE vec_id % 3 = 0 AND vec_id BETWEEN 1 AND 499 UNION ALL SELECT vec_id, 'thresholds beyond -1 to 1' FROM embeddings WHERE vec_id % 3 = 2)""")
def calibration_problems(s, d):
    b = S.table(s, d, "embeddings").select("vec_id", F.expr(BODY).alias("body"))
    return calibration.problems(calibration.parsed(b)).select("vec_id", "problem")


@query("SELECT CASE vec_id % 7 WHEN 0 THEN 'blurred' WHEN 1 THEN 'too small' ELSE 'turned too far' END AS reason, count(*) AS pairs, round(count(*) / (SELECT count(*) FROM embeddings)::DOUBLE, 6) AS share FROM embeddings WHERE vec_id % 7 < 3 GROUP BY 1")
def rejection_reasons(s, d):
    e = S.table(s, d, "embeddings").select("vec_id", F.lit(0.9).alias("score"), F.when(F.col("vec_id") % 7 == 1, 10.0).otherwise(100.0).alias("size"), F.lit(0.5).alias("share"), F.lit(50.0).alias("spread"), F.when(F.col("vec_id") % 7 == 2, -40.0).otherwise(3.0).alias("turn"), F.lit(100.0).alias("light"), F.when(F.col("vec_id") % 7 == 0, 3.0).otherwise(60.0).alias("sharp"))
    return calibration.rejections(e.select("vec_id", V.gate().alias("reason")))


@query(f"""SELECT a.vec_id, b.vec_id AS other, round({COS}, 4) AS score, round(greatest(0, least(1, ({COS} - 0.55) / 0.45)), 4) AS mapped FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings)""")
def strict_cosines(s, d):
    e = S.table(s, d, "embeddings").select("vec_id", "embedding")
    n = e.agg(F.count("*").alias("n"))
    a = e.crossJoin(F.broadcast(n)).withColumn("other", (F.col("vec_id") * 7 + 3) % F.col("n"))
    j = a.join(e.select(F.col("vec_id").alias("other"), F.col("embedding").alias("e2")), "other")
    return j.select("vec_id", "other", F.round(V.strict_cosine(F.col("embedding"), F.col("e2")).cast("double"), 4).alias("score"), F.round(V.remapped(V.cosine(F.col("embedding"), F.col("e2"))), 4).alias("mapped"))


H = lambda k: f"(((vec_id * {k}) % 1000003) * 4294967 + (vec_id * {k + 2}) % 65537)"
SET = f"fp AS (SELECT vec_id, CASE WHEN vec_id % 40 = 0 THEN 'same' ELSE vec_id::VARCHAR END AS sha, {H(7919)} AS p, {H(104729)} AS dd, {H(15485863)} AS a, [0.25, 0.75] AS c FROM embeddings)"
SIM = lambda x, y: f"(1 - bit_count(xor(x.{x}, y.{y})) / 64.0::DOUBLE)"


def _sets(s, d):
    h = lambda k: F.expr(f"((vec_id * {k}) % 1000003) * 4294967 + (vec_id * {k + 2}) % 65537")
    c = F.array(F.lit(0.25), F.lit(0.75))
    v = lambda p, q_: F.struct(h(p).alias("p"), h(q_).alias("d"), h(15485863).alias("a"), c.alias("c"))
    return S.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 40 == 0, "same").otherwise(F.col("vec_id").cast("string")).alias("sha"), F.array(v(7919, 104729), v(104729, 7919)).alias("variants"))


VS = lambda a, b, c, d: f"({SIM(a, b)} * 0.55 + {SIM(c, d)} * 0.24 + {SIM('a', 'a')} * 0.09 + 0.12)"


@query(f"""WITH {SET}, j AS (SELECT x.vec_id AS query, y.vec_id AS id, x.sha = y.sha AS exact, greatest({VS('p', 'p', 'dd', 'dd')}, {VS('p', 'dd', 'dd', 'p')}, {VS('dd', 'p', 'p', 'dd')}, {VS('dd', 'dd', 'p', 'p')}) AS best FROM fp x JOIN fp y ON x.vec_id != y.vec_id WHERE x.vec_id % 50 = 0),
  k AS (SELECT query, id, CASE WHEN exact THEN 1.0 ELSE best END::DOUBLE AS score, exact FROM j) SELECT query, id, round(score, 6) AS score, CASE WHEN exact THEN 'exact' WHEN score >= 0.94 THEN 'near_exact' WHEN score >= 0.87 THEN 'strong' WHEN score >= 0.80 THEN 'possible' ELSE 'different' END AS class FROM k WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 12""")
def visual_copies(s, d):
    f = _sets(s, d)
    d = images.copies(f.where("id % 50 = 0").withColumnRenamed("id", "query"), f, 0.7)
    # rounded as SQL does, by a product: scores like 0.8178125 lie a last bit below a tie
    return d.select("query", "id", (F.floor(F.col("score") * 1e6 + 0.5) / F.lit(1e6)).alias("score"), "class")


@query("""WITH o AS (SELECT vec_id % 97 AS image, vec_id AS object, (vec_id * 31 % 100)::DOUBLE AS area, 0.7 + (vec_id % 30) / 100.0::DOUBLE AS score FROM embeddings), r AS (SELECT *, row_number() OVER w AS rank, lead(area) OVER w AS a2, lead(score) OVER w AS s2 FROM o WHERE area > 0 AND score >= 0.82 WINDOW w AS (PARTITION BY image ORDER BY area * score DESC, object))
  SELECT i.image, CASE WHEN coalesce(a2 >= area * 0.58 AND s2 >= score - 0.08, false) THEN NULL ELSE object END AS object, CASE WHEN rank IS NULL THEN 'none' WHEN coalesce(a2 >= area * 0.58 AND s2 >= score - 0.08, false) THEN 'ambiguous' ELSE 'selected' END AS verdict FROM (SELECT DISTINCT image FROM o) i LEFT JOIN (SELECT * FROM r WHERE rank = 1) r USING (image)""")
def prominent_objects(s, d):
    o = S.table(s, d, "embeddings").select((F.col("vec_id") % 97).alias("image"), F.col("vec_id").alias("object"), (F.col("vec_id") * 31 % 100).cast("double").alias("area"), (F.lit(0.7) + (F.col("vec_id") % 30) / F.lit(100.0)).alias("score"))
    return images.prominent(o)
