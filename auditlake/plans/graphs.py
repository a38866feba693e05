"""Queries over what pages show of identities, the fused graph of a case, and its exposure, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import text as T
from auditlake.operators import exposure, extract, fusion
from auditlake.operators.lineage import cut
from auditlake.plans.audit import _r, cte, digits, fixture, identities, names, path, q, query

# personal data of pages

HANDLES = "list_transform(list_filter([handle, other, alias], lambda h: h IS NOT NULL), lambda h: lower(h))"
ATTR = f"""pg AS (SELECT f.subject_id, f.url, f.text, i.* EXCLUDE (subject_id) FROM fetched f JOIN ident i USING (subject_id) WHERE authorized),
  attr AS (SELECT *, len(list_intersect(list_transform(string_split({path('url')}, '/'), lambda s: lower(ltrim(s, '@'))), {HANDLES})) > 0 AS by_url, coalesce(len(full_name) >= 3 AND contains(lower(text), lower(full_name)), false)::INT + 2 * coalesce(contains(lower(text), lower(email)), false)::INT + 2 * coalesce(contains({digits('text')}, {digits('phone')}), false)::INT
      + (len(list_filter({HANDLES}, lambda h: contains(lower(text), h))) > 0)::INT + coalesce(contains(lower(text), lower(organization)), false)::INT + coalesce(contains(lower(text), lower(location)), false)::INT AS signs FROM pg),
  att AS (SELECT *, by_url OR signs >= 2 AS strong FROM attr)"""
MAIL = r"(?i)\b[\w.%+-]+@[a-z\d.-]+\.[a-z]{2,}\b"
CALL = "(?:[+][0-9]{1,3}[-. ]?)?(?:[(]?[0-9]{2,4}[)]?[-. ]?){2,5}[0-9]{2,4}"


def many(rx: str, group: int, kind: str, base: int) -> str:
    return f"SELECT *, {q(kind)} AS k, unnest(regexp_extract_all(text, {q(rx)}, 0)) AS m, unnest(regexp_extract_all(text, {q(rx)}, {group})) AS v, {base} + generate_subscripts(regexp_extract_all(text, {q(rx)}, 0), 1) - 1 AS ord FROM att"


def word(v: str) -> str:
    return f"regexp_matches(lower(text), '(^|[^\\p{{L}}0-9])' || regexp_escape(lower({v})) || '($|[^\\p{{L}}0-9])')"


ENDS = lambda xs: " OR ".join(f"ends_with(lower(v), {q(x)})" for x in xs)
HAS = lambda xs: " OR ".join(f"contains(lower(m), {q(x)})" for x in xs)
EXTRACT = f"""{cte('fetched')}, {ATTR},
  em AS (SELECT subject_id, url, ord, 'Email' AS type, v AS value, CASE WHEN lower(v) = lower(email) THEN 0 WHEN strong THEN 1 ELSE 2 END AS tier FROM ({many(MAIL, 0, 'e', 0)})),
  ph AS (SELECT subject_id, url, ord, 'Phone' AS type, trim(v) AS value, CASE WHEN coalesce({digits('v')} = {digits('phone')}, false) THEN 0 WHEN strong THEN 1 ELSE 2 END AS tier FROM ({many(CALL, 0, 'p', 100000)}) WHERE len({digits('v')}) BETWEEN 8 AND 15 AND NOT (len({digits('v')}) = 8 AND substr({digits('v')}, 1, 4)::INT BETWEEN 1900 AND 2100) AND NOT (len(regexp_replace(v, '[^-/]', '', 'g')) >= 2 AND NOT contains(v, '+'))
      AND (coalesce({digits('v')} = {digits('phone')}, false) OR starts_with(trim(v), '+') OR regexp_matches(substr(text, greatest(strpos(text, v) - 60, 1), len(v) + 60 + least(60, strpos(text, v) - 1)), {q(T.PHONE_CONTEXT)}))),
  pl AS (SELECT *, CASE WHEN lower(v) = lower(organization) THEN 'Organization' WHEN lower(v) = lower(location) THEN 'Location' WHEN lower(v) IN ({names(extract.ORGANIZATIONS)}) OR {ENDS(extract.ORG_ENDS)} THEN 'Organization' WHEN lower(v) IN ({names(extract.LOCATIONS)}) OR {ENDS(extract.LOCATION_ENDS)} THEN 'Location' WHEN {HAS(extract.AT_WORK)} THEN 'Organization' WHEN {HAS(extract.AT_HOME)} THEN 'Location' ELSE k END AS type
    FROM (SELECT * REPLACE (regexp_replace(trim(v), '[.,;:]+$', '') AS v) FROM ({many(T.LOCATION, 1, 'Location', 200000)} UNION ALL {many(T.ORGANIZATION, 1, 'Organization', 300000)}))),
  pt AS (SELECT subject_id, url, ord, type, v AS value, CASE WHEN coalesce(CASE type WHEN 'Location' THEN lower(v) = lower(location) ELSE lower(v) = lower(organization) END, false) THEN 0 WHEN strong THEN 1 ELSE 2 END AS tier FROM pl),
  tiered AS (SELECT *, CASE type WHEN 'Email' THEN [0.99, 0.72, 0.42][tier + 1] WHEN 'Phone' THEN [0.99, 0.68, 0.36][tier + 1] ELSE [0.90, 0.64, 0.44][tier + 1] END AS confidence, CASE WHEN type = 'Email' THEN ['High', 'Medium', 'Low'][tier + 1] WHEN type = 'Phone' THEN ['Critical', 'High', 'Low'][tier + 1] WHEN type = 'Location' THEN ['High', 'Medium', 'Low'][tier + 1] ELSE ['Medium', 'Medium', 'Low'][tier + 1] END AS risk FROM (SELECT * FROM em UNION ALL SELECT * FROM ph UNION ALL SELECT * FROM pt)),
  every AS (SELECT subject_id, url, ord, type, value, confidence, risk FROM tiered
    UNION ALL SELECT subject_id, url, 400000, 'SensitiveSnippet', 'Name Exposure: ' || full_name, CASE WHEN signs >= 2 THEN 0.95 ELSE 0.65 END, CASE WHEN signs >= 2 THEN 'High' ELSE 'Medium' END FROM att WHERE full_name IS NOT NULL AND {word('full_name')}
    UNION ALL SELECT subject_id, url, 500000, 'SensitiveSnippet', 'Alias Exposure: ' || alias, CASE WHEN by_url THEN 0.90 ELSE 0.62 END, CASE WHEN by_url THEN 'Medium' ELSE 'Low' END FROM att WHERE alias IS NOT NULL AND {word('alias')}
    UNION ALL SELECT subject_id, url, 600000, 'Location', location, CASE WHEN strong THEN 0.92 ELSE 0.80 END, 'High' FROM att WHERE location IS NOT NULL AND {word('location')}
    UNION ALL SELECT subject_id, url, 700000, 'Organization', organization, CASE WHEN strong THEN 0.92 ELSE 0.80 END, 'Medium' FROM att WHERE organization IS NOT NULL AND {word('organization')}),
  pii AS (SELECT * FROM every WHERE trim(value) != '' QUALIFY row_number() OVER (PARTITION BY subject_id, url, type, CASE type WHEN 'Phone' THEN {digits('value')} ELSE lower(trim(value)) END ORDER BY ord) = 1)"""


@query(f"WITH {cte('fetched')}, {ATTR} SELECT subject_id, url, by_url, signs::BIGINT AS signs FROM att")
def attribution_signals(s, d):
    j = fixture(s, d, "fetched").select("subject_id", "url", "text").join(identities(s, d), "subject_id")
    return j.select("subject_id", "url", extract.url_names().alias("by_url"), extract.signal_count().cast("long").alias("signs"))


@query(f"WITH {EXTRACT} SELECT subject_id, url, ord::BIGINT AS ord, type, value, round(confidence::DOUBLE, 6) AS confidence, risk FROM pii")
def pii_extract(s, d):
    return extract.extract(fixture(s, d, "fetched").select("subject_id", "url", "text"), identities(s, d)).select("subject_id", "url", "ord", "type", "value", _r("confidence"), "risk")


# the graph

KEYS = ("profile", "shown", "finding", "relation", "observed", "leak")
VKIND = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in fusion.VERTEX.items())
REL = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in fusion.RELATION.items())
ID = lambda kind, v: f"lower({kind}) || ':' || lower(trim({v}))"
GRAPH = f"""{cte(*KEYS)}, subj AS (SELECT subject_id AS case_id, coalesce(full_name, handle, other, email, 'Subject') AS label FROM ident WHERE authorized), who AS (SELECT case_id, {ID("'person'", 'label')} AS subject FROM subj),
  seed AS (SELECT case_id, rank_ AS ord, kind, value FROM (SELECT subject_id AS case_id, unnest([0, 1, 2, 3, 4, 5, 6]) AS rank_, unnest(['Email', 'Phone', 'Username', 'Username', 'Organization', 'Location', 'Profile']) AS kind, unnest([email, phone, handle, other, organization, location, profile_url]) AS value FROM ident WHERE authorized) WHERE value IS NOT NULL),
  att AS (SELECT case_id, 2 AS p, ord, type, value, confidence, snippet, of AS url FROM shown UNION ALL SELECT case_id, 3, ord, type, value, confidence, snippet, url FROM finding UNION ALL SELECT case_id, 5, ord, type, value, confidence, snippet, url FROM observed),
  atk AS (SELECT *, CASE type {VKIND} END AS kind FROM att WHERE trim(value) != ''),
  vr AS (SELECT case_id, {ID("'person'", 'label')} AS id, 'Person' AS type, label, 1.0 AS confidence, []::VARCHAR[] AS urls, 0::BIGINT AS pos, false AS fresh FROM subj
    UNION ALL SELECT case_id, {ID('kind', 'value')}, kind, trim(value), CASE WHEN kind IN ('Organization', 'Location') THEN 0.9 ELSE 1.0 END, CASE kind WHEN 'Profile' THEN [trim(value)] ELSE [] END, 100000000 + ord * 50, false FROM seed
    UNION ALL SELECT case_id, {ID("'profile'", 'url')}, 'Profile', CASE WHEN trim(coalesce(title, '')) != '' THEN title ELSE platform || ': ' || username END, confidence, [url], 200000000 + ord * 50, false FROM profile
    UNION ALL SELECT case_id, {ID("'username'", 'username')}, 'Username', username, confidence, [url], 200000000 + ord * 50 + 1, false FROM profile WHERE username NOT IN ('unknown', 'web')
    UNION ALL SELECT case_id, {ID('kind', 'value')}, kind, trim(value), confidence, list_filter([url], lambda u: u IS NOT NULL), p * 100000000 + ord * 50 + 10, false FROM atk WHERE kind IS NOT NULL
    UNION ALL SELECT case_id, {ID("'profile'", 'url')}, 'Profile', url, confidence, [url], 300000000 + ord * 50, true FROM finding WHERE url IS NOT NULL
    UNION ALL SELECT case_id, 'value:' || lower(trim(source)), 'Website', source, 0.7, [], 400000000 + ord * 50, false FROM relation UNION ALL SELECT case_id, 'value:' || lower(trim(target)), 'Website', target, 0.7, [], 400000000 + ord * 50 + 1, false FROM relation
    UNION ALL SELECT case_id, {ID("'email'", 'email')}, 'Email', email, 0.9, [], 700000000 + ord * 50, true FROM leak
    UNION ALL SELECT case_id, {ID("'breach'", 'email')}, 'Breach', CASE WHEN records > 0 THEN records || ' breach(es) for ' || email ELSE 'Exposure signals for ' || email END, CASE WHEN records > 0 THEN 0.95 ELSE 0.6 END, CASE WHEN source_list = '' THEN [] ELSE string_split(source_list, '|') END, 700000000 + ord * 50 + 1, false FROM leak WHERE records > 0 OR source_list != ''),
  vk AS (SELECT *, min(pos) OVER (PARTITION BY case_id, id) AS first FROM vr), vs AS (SELECT * FROM vk WHERE NOT fresh OR pos = first),
  vert AS (SELECT case_id, id, arg_min(type, pos) AS type, arg_min(label, (-len(label), pos)) AS label, max(confidence::FLOAT) AS confidence, list_sort(list_distinct(flatten(list(urls)))) AS urls, min(pos) AS ord FROM vs GROUP BY ALL),
  er AS (SELECT case_id, subject AS src, {ID('kind', 'value')} AS dst, CASE kind WHEN 'Profile' THEN 'owns_profile' ELSE CASE kind {REL} END END AS relation, 100000000 + ord * 50 AS pos FROM seed JOIN who USING (case_id)
    UNION ALL SELECT case_id, subject, {ID("'profile'", 'url')}, CASE WHEN there AND verified THEN 'has_profile' WHEN there THEN 'possible_profile' ELSE 'candidate_profile' END, 200000000 + ord * 50 FROM profile JOIN who USING (case_id)
    UNION ALL SELECT case_id, subject, {ID("'username'", 'username')}, 'uses_username', 200000000 + ord * 50 + 1 FROM profile JOIN who USING (case_id) WHERE there AND username NOT IN ('unknown', 'web')
    UNION ALL SELECT case_id, {ID("'profile'", 'url')}, {ID("'username'", 'username')}, 'username_on_profile', 200000000 + ord * 50 + 2 FROM profile WHERE username NOT IN ('unknown', 'web')
    UNION ALL SELECT case_id, subject, {ID('kind', 'value')}, CASE kind {REL} END, p * 100000000 + ord * 50 + 11 FROM atk JOIN who USING (case_id) WHERE kind IS NOT NULL
    UNION ALL SELECT case_id, {ID("'profile'", 'url')}, {ID('kind', 'value')}, 'mentions', p * 100000000 + ord * 50 + 12 FROM atk WHERE kind IS NOT NULL AND url IS NOT NULL
    UNION ALL SELECT v.case_id, subject, id, 'related_profile', pos FROM vs v JOIN who USING (case_id) WHERE fresh AND v.type = 'Profile'
    UNION ALL SELECT case_id, 'value:' || lower(trim(source)), 'value:' || lower(trim(target)), relation, 400000000 + ord * 50 + 2 FROM relation
    UNION ALL SELECT v.case_id, subject, id, 'has_email', pos FROM vs v JOIN who USING (case_id) WHERE fresh AND v.type = 'Email'
    UNION ALL SELECT case_id, {ID("'email'", 'email')}, {ID("'breach'", 'email')}, 'exposed_in', 700000000 + ord * 50 + 1 FROM leak WHERE records > 0 OR source_list != ''
    UNION ALL SELECT case_id, subject, {ID("'breach'", 'email')}, 'has_breach_exposure', 700000000 + ord * 50 + 2 FROM leak JOIN who USING (case_id) WHERE records > 0 OR source_list != ''),
  edge AS (SELECT case_id, src, dst, relation, min(pos) AS ord FROM er WHERE src != dst GROUP BY ALL)"""


def parts(s, d):
    i = identities(s, d)
    first = lambda *c: F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in c], F.lit("Subject"))
    subjects = i.select(F.col("subject_id").alias("case_id"), first(F.col("full_name"), F.get("handles", F.lit(0)), F.get("emails", F.lit(0))).alias("label"))
    lists = [("Email", "emails", 0), ("Phone", "phones", 1), ("Organization", "organizations", 4), ("Location", "locations", 5), ("Profile", "profile_urls", 6)]

    def seed(kind: str, column: str, at: int):
        return F.transform(column, lambda v: F.struct(F.lit(at).alias("ord"), F.lit(kind).alias("kind"), v.alias("value")))

    every = F.concat(*[seed(*x) for x in lists], F.transform("handles", lambda v, j: F.struct((j + 2).alias("ord"), F.lit("Username").alias("kind"), v.alias("value"))))
    seeds = i.select(F.col("subject_id").alias("case_id"), F.explode(every).alias("e")).select("case_id", "e.*")
    f = {n: fixture(s, d, n) for n in KEYS}
    leaks = f["leak"].withColumn("sources", F.filter(F.split("source_list", r"\|"), lambda x: x != ""))
    return subjects, seeds, f["profile"], f["shown"], f["finding"], f["relation"], f["observed"], leaks


def graph(s, d):
    """Vertices and edges, made once and written: both are read more than once."""
    v, e = fusion.fused(*parts(s, d))
    return cut(v), cut(e)


@query(f"WITH {GRAPH} SELECT case_id, id, type, label, round(confidence::DOUBLE, 6) AS confidence, array_to_string(urls, ',') AS urls FROM vert")
def graph_vertices(s, d):
    return fusion.fused(*parts(s, d))[0].select("case_id", "id", "type", "label", _r("confidence"), F.array_join("urls", ",").alias("urls"))


@query(f"WITH {GRAPH} SELECT case_id, src, dst, relation, ord FROM edge")
def graph_edges(s, d):
    return fusion.fused(*parts(s, d))[1].select("case_id", "src", "dst", "relation", "ord")


@query(f"WITH {GRAPH} SELECT case_id, id, count(*) AS degree FROM (SELECT case_id, src AS id FROM edge UNION ALL SELECT case_id, dst FROM edge) GROUP BY ALL")
def vertex_degree(s, d):
    e = fusion.fused(*parts(s, d))[1]
    return e.select("case_id", F.explode(F.array("src", "dst")).alias("id")).groupBy("case_id", "id").agg(F.count("*").alias("degree"))


KINDS = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in fusion.KIND.items())
DOM = r"regexp_extract(regexp_replace(regexp_replace(lower({x}), '^https?://', ''), '^www\.', ''), '^(?:[^/@]*@)?([^/]*)', 1)"
LAST2 = lambda x: f"CASE WHEN contains({DOM.format(x=x)}, '.') THEN array_to_string(string_split({DOM.format(x=x)}, '.')[-2:], '.') END"
SCORED = f"""{GRAPH}, lastev AS (SELECT case_id, lower(value) AS low, arg_max(type, ord) AS k, arg_max(value, ord) AS v FROM observed GROUP BY ALL),
  ends AS (SELECT vert.case_id, vert.id, coalesce(l.v, label) AS v, coalesce(l.k, CASE vert.type {KINDS} END) AS k FROM vert LEFT JOIN lastev l ON l.case_id = vert.case_id AND l.low = lower(label)),
  je AS (SELECT edge.*, a.v AS a, b.v AS b, a.k AS ka, b.k AS kb, lower(trim(a.v)) AS x, lower(trim(b.v)) AS y FROM edge JOIN ends a ON a.case_id = edge.case_id AND a.id = src JOIN ends b ON b.case_id = edge.case_id AND b.id = dst),
  said AS (SELECT *, list_filter([CASE WHEN ka = 'Username' AND kb = 'Username' AND x != y AND translate(x, '._-', '') = translate(y, '._-', '') THEN {{'s': 0.85::DOUBLE, 'r': 'same username but for separators'}} END, CASE WHEN ka = 'Username' AND kb = 'Username' AND x != y AND translate(x, '._-', '') != translate(y, '._-', '') AND (contains(x, y) OR contains(y, x)) THEN {{'s': 0.6::DOUBLE, 'r': 'one username holds the other'}} END,
      CASE WHEN ka = 'Email' AND kb = 'Email' AND regexp_extract(x, '@(.*)$', 1) = regexp_extract(y, '@(.*)$', 1) AND contains(x, '@') THEN {{'s': 0.7::DOUBLE, 'r': 'same mail domain'}} END, CASE WHEN (ka = 'Username' AND kb != 'Username' AND contains(lower(b), x)) OR (kb = 'Username' AND ka != 'Username' AND contains(lower(a), y)) THEN {{'s': 0.65::DOUBLE, 'r': 'value holds the username'}} END,
      CASE WHEN ka IN ({names(fusion.WEB)}) AND kb IN ({names(fusion.WEB)}) AND {LAST2('a')} = {LAST2('b')} THEN {{'s': 0.6::DOUBLE, 'r': 'same domain'}} END], lambda z: z IS NOT NULL) AS said FROM je),
  scored AS (SELECT case_id, src, dst, relation, ord, list_max(list_transform(said, lambda z: z.s)) AS score, array_to_string(list_transform(said, lambda z: z.r), '; ') AS reasons FROM said WHERE len(said) > 0)"""


@query(f"WITH {SCORED} SELECT case_id, src, dst, relation, round(score, 6) AS score, reasons FROM scored")
def edge_confidence(s, d):
    v, e = graph(s, d)
    return fusion.edge_confidence(e, v, fixture(s, d, "observed")).select("case_id", "src", "dst", "relation", _r("score"), "reasons")


CHAIN = """ch AS (SELECT subject_id AS case_id, subject_id % 12 + 2 AS n FROM ident WHERE authorized),
  cv AS (SELECT case_id, CASE WHEN i = 0 THEN 'person:p' WHEN i = n THEN 'breach:b' ELSE 'profile:' || i END AS id, CASE WHEN i = 0 THEN 'Person' WHEN i = n THEN 'Breach' ELSE 'Profile' END AS type, CASE WHEN i = 0 THEN 'P' WHEN i = n THEN 'B' ELSE 'N' || i END AS label, i AS ord FROM ch, range(0, 20) r(i) WHERE i <= n UNION ALL SELECT case_id, 'breach:c', 'Breach', 'C', 90 FROM ch WHERE case_id % 4 = 0 UNION ALL SELECT case_id, 'breach:far', 'Breach', 'Far', 91 FROM ch),
  ce AS (SELECT a.case_id, CASE WHEN a.ord % 3 = 1 THEN b.id ELSE a.id END AS src, CASE WHEN a.ord % 3 = 1 THEN a.id ELSE b.id END AS dst, 'r' || a.ord AS relation, 100 + a.ord AS ord FROM cv a JOIN cv b ON a.case_id = b.case_id AND b.ord = a.ord + 1 WHERE b.ord < 90
    UNION ALL SELECT case_id, 'profile:1', 'breach:c', 'direct', 200 FROM ch WHERE case_id % 4 = 0 AND n > 2 UNION ALL SELECT case_id, 'profile:2', 'breach:c', 'late', 50 FROM ch WHERE case_id % 8 = 0 AND n > 2)"""


@query(f"""WITH RECURSIVE {cte('ident')}, {CHAIN}, adj AS (SELECT case_id, a, b, min(ord) AS pos FROM (SELECT case_id, src AS a, dst AS b, ord FROM ce UNION ALL SELECT case_id, dst, src, ord FROM ce) GROUP BY ALL),
  walk AS (SELECT case_id, 'person:p' AS id, ['person:p'] AS path, []::BIGINT[] AS way FROM ch UNION ALL SELECT w.case_id, b, list_append(path, b), list_append(way, pos) FROM walk w JOIN adj ON adj.case_id = w.case_id AND a = w.id WHERE NOT list_contains(path, b)),
  best AS (SELECT case_id, id, arg_min(path, (len(path), way)) AS path FROM walk GROUP BY ALL), hit AS (SELECT b.case_id, b.id, path, len(path) - 1 AS hops, v.label AS endpoint, row_number() OVER (PARTITION BY b.case_id ORDER BY len(path) DESC, v.ord) AS rank FROM best b JOIN cv v ON v.case_id = b.case_id AND v.id = b.id WHERE v.type = 'Breach'),
  leg AS (SELECT case_id, rank, endpoint, hops, i, path[i] AS x, path[i + 1] AS y FROM hit, range(1, 30) r(i) WHERE i <= hops), txt AS (SELECT l.case_id, rank, endpoint, hops, i, arg_min(f.label || ' -' || relation || '-> ' || t.label || CASE WHEN relation = 'r0' THEN ' (0.65)' ELSE '' END, e.ord) AS t FROM leg l JOIN ce e ON e.case_id = l.case_id AND ((e.src = x AND e.dst = y) OR (e.src = y AND e.dst = x)) JOIN cv f ON f.case_id = e.case_id AND f.id = e.src JOIN cv t ON t.case_id = e.case_id AND t.id = e.dst GROUP BY ALL)
  SELECT case_id, rank, endpoint, hops, string_agg(t, ' | ' ORDER BY i) AS steps FROM txt WHERE rank <= 5 GROUP BY ALL""")
def attack_paths(s, d):
    """Hand-made chains of 2 to 13 hops, with a nearer and an unreachable end: graphs that the engine fuses itself have every breach one hop away."""
    ch = fixture(s, d, "ident").where("authorized").select(F.col("subject_id").alias("case_id"), (F.col("subject_id") % 12 + 2).cast("int").alias("n"))
    c = ch.select("case_id", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i"))
    end = F.col("i") == F.col("n")
    v = c.select("case_id", F.when(F.col("i") == 0, "person:p").when(end, "breach:b").otherwise(F.concat(F.lit("profile:"), "i")).alias("id"), F.when(F.col("i") == 0, "Person").when(end, "Breach").otherwise("Profile").alias("type"), F.when(F.col("i") == 0, "P").when(end, "B").otherwise(F.concat(F.lit("N"), "i")).alias("label"), F.col("i").cast("long").alias("ord"))
    fixed = lambda w, i, k, o: ch.where(w).select("case_id", F.lit(i).alias("id"), F.lit("Breach").alias("type"), F.lit(k).alias("label"), F.lit(o).cast("long").alias("ord"))
    vertices = cut(v.unionByName(fixed("case_id % 4 = 0", "breach:c", "C", 90)).unionByName(fixed("true", "breach:far", "Far", 91)))
    b = v.select("case_id", F.col("id").alias("to"), (F.col("ord") - 1).alias("ord"))
    turned = F.col("ord") % 3 == 1
    e = v.join(b, ["case_id", "ord"]).select("case_id", F.when(turned, F.col("to")).otherwise(F.col("id")).alias("src"), F.when(turned, F.col("id")).otherwise(F.col("to")).alias("dst"), F.concat(F.lit("r"), F.col("ord").cast("string")).alias("relation"), (F.col("ord") + 100).alias("ord"))
    more = lambda w, i, r, o: ch.where(w).where("n > 2").select("case_id", F.lit(i).alias("src"), F.lit("breach:c").alias("dst"), F.lit(r).alias("relation"), F.lit(o).cast("long").alias("ord"))
    edges = cut(e.unionByName(more("case_id % 4 = 0", "profile:1", "direct", 200)).unionByName(more("case_id % 8 = 0", "profile:2", "late", 50)))
    return fusion.attack_paths(edges, vertices, edges.where("relation = 'r0'").withColumn("score", F.lit(0.65)))


@query(f"WITH {GRAPH} SELECT case_id, 1::BIGINT AS rank, label AS endpoint, 1::BIGINT AS hops FROM vert WHERE type = 'Breach'")
def breach_paths(s, d):
    """Paths in the fused graph."""
    v, e = graph(s, d)
    return fusion.attack_paths(e, v, fusion.edge_confidence(e, v, fixture(s, d, "observed"))).select("case_id", "rank", "endpoint", "hops")


# exposure

WEIGHT = "CASE risk WHEN 'Low' THEN 25 WHEN 'Medium' THEN 50 WHEN 'High' THEN 80 WHEN 'Critical' THEN 100 END"
BRIDGE = {"Email": "Contact Identity", "Phone": "Contact", "Address": "Location Personal", "Location": "Location Personal", "Username": "Identity", "UsernameReuse": "Identity", "Profile": "Professional Identity", "PlausibleProfileMatch": "Professional Identity", "Organization": "Professional", "PublicSearchEvidence": "Professional Personal", "PublicImageEvidence": "Professional Personal", "ImageConsistency": "Image", "SensitiveSnippet": "Personal Identity"}
PAIRS = ", ".join(f"({q(t)}, {q(x)})" for t, ds in BRIDGE.items() for x in ds.split())
BYDIM = f"""{cte('finding', 'leak')}, subj AS (SELECT subject_id AS case_id FROM ident WHERE authorized), bridge AS (SELECT * FROM (VALUES {PAIRS}) v(type, dimension)), hurt AS (SELECT DISTINCT case_id FROM leak WHERE records > 0 OR source_list != ''),
  proxy AS (SELECT h.case_id, coalesce(arg_min(f.risk, f.ord), 'High') AS risk FROM hurt h LEFT JOIN (SELECT * FROM finding WHERE type = 'Email') f USING (case_id) GROUP BY 1),
  hits AS (SELECT case_id, dimension, type, {WEIGHT} AS w FROM finding JOIN bridge USING (type) UNION ALL SELECT case_id, dimension, 'Email', {WEIGHT} FROM proxy, (VALUES ('Contact'), ('Identity')) v(dimension)),
  dims AS (SELECT s.case_id, x.dimension, coalesce(max(w), 0) AS score, count(DISTINCT type) AS types FROM subj s CROSS JOIN (VALUES ('Contact'), ('Identity'), ('Location'), ('Personal'), ('Professional'), ('Image')) x(dimension) LEFT JOIN hits h ON h.case_id = s.case_id AND h.dimension = x.dimension GROUP BY ALL)"""


def _case(s, d):
    return fixture(s, d, "finding"), fixture(s, d, "ident").where("authorized").select(F.col("subject_id").alias("case_id")), fixture(s, d, "leak").withColumn("sources", F.filter(F.split("source_list", r"\|"), lambda x: x != ""))


@query(f"WITH {BYDIM} SELECT case_id, dimension, score, types FROM dims")
def exposure_dimensions(s, d):
    return exposure.dimensions(*_case(s, d))


@query(f"WITH {BYDIM} SELECT case_id, max(score) AS overall, count(*) FILTER (score > 0) AS touched FROM dims GROUP BY 1")
def exposure_overall(s, d):
    return exposure.exposed(exposure.dimensions(*_case(s, d)))


@query(f"WITH {cte('finding')} SELECT subject_id AS case_id, coalesce(max({WEIGHT}), 25) AS weight, CASE coalesce(max({WEIGHT}), 25) WHEN 25 THEN 'Low' WHEN 50 THEN 'Medium' WHEN 80 THEN 'High' ELSE 'Critical' END AS risk FROM ident LEFT JOIN finding ON case_id = subject_id WHERE authorized GROUP BY 1")
def risk_overall(s, d):
    f, c, _ = _case(s, d)
    return exposure.overall(f, c)


@query(f"WITH {cte('finding')} SELECT case_id, {WEIGHT} * 100 + trunc(confidence * 100::FLOAT)::INT AS key, ord::BIGINT AS ord, type, value FROM finding QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY {WEIGHT} * 100 + trunc(confidence * 100::FLOAT)::INT DESC, ord) <= 10")
def top_findings(s, d):
    return exposure.top(fixture(s, d, "finding")).select("case_id", "key", F.col("ord").cast("long").alias("ord"), "type", "value")


TIPS = {"Email": "email", "Phone": "phone", "Location": "location", "UsernameReuse": "reuse", "PublicSearchEvidence": "search", "PublicImageEvidence": "images", "ImageConsistency": "avatars"}


@query(f"WITH {cte('finding')}, t AS (SELECT case_id, CASE type {' '.join(f'WHEN {q(a)} THEN {q(b)}' for a, b in TIPS.items())} END AS tip FROM finding UNION SELECT case_id, 'credentials' FROM finding WHERE contains(lower(snippet), 'breach') OR contains(lower(remediation), 'mfa')), u AS (SELECT DISTINCT case_id, tip FROM t WHERE tip IS NOT NULL) SELECT * FROM u UNION ALL SELECT subject_id, 'none' FROM ident WHERE authorized AND subject_id NOT IN (SELECT case_id FROM u)")
def remediation_tips(s, d):
    f, c, _ = _case(s, d)
    return exposure.tips(f, c)


@query(f"""WITH {cte('finding')} SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY {WEIGHT} DESC, ord) AS rank, coalesce(snippet, value) AS evidence, risk, type, coalesce(nullif(trim(remediation), ''), f.fix) AS fix, f.problem, i.impact FROM finding JOIN (VALUES {', '.join(f'({q(t)}, {q(p)}, {q(x)})' for t, (p, x) in exposure.ADVICE.items())}) f(type, problem, fix) USING (type) JOIN (VALUES {', '.join(f'({q(r)}, {q(x)})' for r, x in exposure.IMPACT.items())}) i(risk, impact) USING (risk)""")
def remediation_items(s, d):
    return exposure.items(fixture(s, d, "finding"))


@query(f"WITH {cte('finding')}, u AS (SELECT DISTINCT case_id, type, value, url FROM finding) SELECT case_id, least(count(*), 5) AS kept, greatest(count(*) - 5, 0) AS dropped FROM u GROUP BY 1")
def finding_cap(s, d):
    return exposure.retained(fixture(s, d, "finding"), 5)


@query(f"WITH {cte('finding')}, one AS (SELECT * FROM finding QUALIFY row_number() OVER (PARTITION BY case_id, type, value, url ORDER BY ord) = 1) SELECT case_id, type, value, ord::BIGINT AS ord FROM one QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY ord) <= 5")
def retained_findings(s, d):
    return exposure.kept(fixture(s, d, "finding"), 5).select("case_id", "type", "value", F.col("ord").cast("long").alias("ord"))
