"""The entity graph of a case, fused in phases: identity seeds, profiles and what they show, findings, asserted relations, evidence, breaches.

Every phase adds rows for vertices and edges, with its place in the order (at). Some vertices are made only where none of that id came before; that is decided by the least place of an id. What many
rows say of one vertex or edge is then combined once. Phases of face matching are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.functions import urls as U
from auditlake.operators.lineage import cut
from auditlake.operators.ordering import keep_first

#: type of a finding or evidence -> type of its vertex; what isn't here makes none.
VERTEX = {"Email": "Email", "Phone": "Phone", "Address": "Location", "Location": "Location", "Username": "Username", "UsernameReuse": "Username", "Profile": "Profile", "PlausibleProfileMatch": "Profile", "Organization": "Organization", "PublicSearchEvidence": "Website", "PublicImageEvidence": "Website", "ImageConsistency": "Image"}
RELATION = {"Email": "has_email", "Phone": "has_phone", "Username": "uses_username", "Organization": "affiliated_with", "Location": "associated_with_location", "Profile": "has_profile", "Website": "linked_website", "Image": "related_image", "Breach": "has_breach_exposure"}
#: type of a vertex -> kind of evidence that it stands for when its edge is scored.
KIND = {"Person": "Username", "Username": "Username", "Email": "Email", "Phone": "Phone", "Profile": "Profile", "Organization": "Organization", "Location": "Location", "Image": "ImageConsistency", "Breach": "SensitiveSnippet", "Website": "PublicSearchEvidence"}
WEB = ("Profile", "PublicSearchEvidence", "PublicImageEvidence")


def vertex_id(kind: Column, value: Column) -> Column:
    return F.concat(F.lower(kind), F.lit(":"), F.lower(F.trim(value)))


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


class Rows:
    """Vertex and edge rows, gathered phase by phase."""

    def __init__(self) -> None:
        self.vertices: list[DataFrame] = []
        self.edges: list[DataFrame] = []

    def put(self, d: DataFrame, at: Column, kind: Column, value: Column, label: Column, confidence: Column, urls: Column | None = None, only_new: bool = False, id_: Column | None = None) -> None:
        none = F.array().cast("array<string>")
        self.vertices.append(d.select("case_id", (vertex_id(kind, value) if id_ is None else id_).alias("id"), kind.alias("type"), label.alias("label"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence.cast("double"))).cast("float").alias("confidence"), F.coalesce(urls, none).alias("urls") if urls is not None else none.alias("urls"), at.cast("long").alias("at"), F.lit(only_new).alias("only_new")))

    def link(self, d: DataFrame, at: Column, src: Column, dst: Column, relation: Column, evidence: Column | None = None, made: Column | None = None) -> None:
        """made: the id of a vertex that must have been made at this place for the edge to be."""
        none = F.lit(None).cast("string")
        self.edges.append(d.select("case_id", src.alias("src"), dst.alias("dst"), relation.alias("relation"), (none if evidence is None else evidence.cast("string")).alias("evidence"), at.cast("long").alias("at"), (none if made is None else made).alias("made")))


def fused(subjects: DataFrame, seeds: DataFrame, profiles: DataFrame, shown: DataFrame, findings: DataFrame, relations: DataFrame, evidence: DataFrame, breaches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of all cases.

    subjects (case_id, label); seeds (case_id, ord, kind, value); profiles (case_id, ord, url, username, platform, title, confidence, there, verified, status);
    shown (case_id, ord, type, value, confidence, snippet, of: the profile's url) and findings (... url), evidence (... url) alike; relations (case_id, ord, source, target, relation, evidence);
    breaches (case_id, ord, email, records, sources, note). Ords are below 10^6. Blank values make nothing.
    """
    r = Rows()
    person = lambda d: d.join(subjects.select("case_id", vertex_id(F.lit("Person"), F.col("label")).alias("subject")), "case_id")
    c, phase = F.col, lambda p, step=0: F.lit(p * 100_000_000) + F.col("ord") * 50 + step
    r.put(subjects, F.lit(0), F.lit("Person"), c("label"), c("label"), F.lit(1.0))
    s = person(seeds.where(F.trim("value") != ""))
    url = F.when(c("kind") == "Profile", F.array(F.trim("value")))
    r.put(s, phase(1), c("kind"), c("value"), F.trim("value"), F.when(c("kind").isin("Organization", "Location"), 0.9).otherwise(1.0), url)
    r.link(s, phase(1), c("subject"), vertex_id(c("kind"), c("value")), F.when(c("kind") == "Profile", "owns_profile").otherwise(_map(RELATION)[c("kind")]), F.when(c("kind") == "Profile", "user-supplied"))
    p = person(profiles)
    pid, uid = vertex_id(F.lit("Profile"), c("url")), vertex_id(F.lit("Username"), c("username"))
    titled = F.when(F.trim("title") != "", c("title"))
    r.put(p, phase(2), F.lit("Profile"), c("url"), F.coalesce(titled, F.concat_ws(": ", "platform", "username")), c("confidence"), F.array("url"))
    r.link(p, phase(2), c("subject"), pid, F.when(c("verified") & c("there"), "has_profile").when(c("there"), "possible_profile").otherwise("candidate_profile"), c("status"))
    named = p.where("trim(username) != '' and username not in ('unknown', 'web')")
    r.put(named, phase(2, 1), F.lit("Username"), c("username"), c("username"), c("confidence"), F.array("url"))
    r.link(named.where("there"), phase(2, 1), c("subject"), uid, F.lit("uses_username"), c("url"))
    r.link(named, phase(2, 2), pid, uid, F.lit("username_on_profile"))

    def attach(d: DataFrame, number: int, mention: Column) -> None:
        d = d.where(F.trim("value") != "").withColumn("kind", _map(VERTEX)[c("type")]).where("kind is not null")
        id_ = vertex_id(c("kind"), c("value"))
        r.put(d, phase(number, 10), c("kind"), c("value"), F.trim("value"), c("confidence"), F.array_compact(F.array("url")))
        r.link(d, phase(number, 11), c("subject"), id_, _map(RELATION)[c("kind")], c("snippet"))
        r.link(d.where(mention.isNotNull()), phase(number, 12), vertex_id(F.lit("Profile"), mention), id_, F.lit("mentions"), c("snippet"))

    attach(person(shown.withColumn("url", c("of"))), 2, c("of"))
    f = person(findings)
    sourced = f.where(F.trim("url") != "")
    r.put(sourced, phase(3), F.lit("Profile"), c("url"), c("url"), c("confidence"), F.array("url"), only_new=True)
    r.link(sourced, phase(3), c("subject"), vertex_id(F.lit("Profile"), c("url")), F.lit("related_profile"), c("type"), made=vertex_id(F.lit("Profile"), c("url")))
    attach(f, 3, F.when(F.trim("url") != "", c("url")))
    value_id = lambda x: F.concat(F.lit("value:"), F.lower(F.trim(x)))
    for k, end in enumerate(("source", "target")):
        r.put(relations, phase(4, k), F.lit("Website"), c(end), c(end), F.lit(0.7), id_=value_id(c(end)))
    r.link(relations, phase(4, 2), value_id(c("source")), value_id(c("target")), c("relation"), c("evidence"))
    attach(person(evidence), 5, c("url"))
    b = person(breaches)
    mail, leak = vertex_id(F.lit("Email"), c("email")), vertex_id(F.lit("Breach"), c("email"))
    r.put(b, phase(7), F.lit("Email"), c("email"), c("email"), F.lit(0.9), only_new=True)
    r.link(b, phase(7), c("subject"), mail, F.lit("has_email"), made=mail)
    hit = b.where("records > 0 or size(sources) > 0")
    said = F.when(c("records") > 0, F.concat(c("records").cast("string"), F.lit(" breach(es) for "), "email")).otherwise(F.concat(F.lit("Exposure signals for "), "email"))
    r.put(hit, phase(7, 1), F.lit("Breach"), c("email"), said, F.when(c("records") > 0, 0.95).otherwise(0.6), c("sources"))
    r.link(hit, phase(7, 1), mail, leak, F.lit("exposed_in"), c("note"))
    r.link(hit, phase(7, 2), c("subject"), leak, F.lit("has_breach_exposure"), c("note"))

    every = cut(reduce(DataFrame.unionByName, r.vertices))  # read by place, by id and for what stays
    first = every.groupBy("case_id", "id").agg(F.min("at").alias("first"))
    made = every.where("only_new").select("case_id", "id", "at").join(first, ["case_id", "id"]).where("at = first").select("case_id", c("id").alias("made"), "at").distinct()
    kept = every.where("not only_new").unionByName(every.where("only_new").join(made.withColumnRenamed("made", "id"), ["case_id", "id", "at"], "left_semi").select(every.columns))
    vertices = kept.groupBy("case_id", "id").agg(F.min_by("type", "at").alias("type"), F.min_by("label", F.struct(-F.length("label"), c("at"))).alias("label"), F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("urls")))).alias("urls"), F.min("at").alias("ord"))
    links = reduce(DataFrame.unionByName, r.edges).where("src != dst")
    sure = links.where("made is null").unionByName(links.where("made is not null").join(made, ["case_id", "made", "at"], "left_semi").select(links.columns))
    edges = keep_first(sure.drop("made"), ["case_id", "src", "dst", "relation"], ["at"]).withColumnRenamed("at", "ord")
    return vertices, edges


def domain_of(email: Column) -> Column:
    """What follows the first @; null where nothing does."""
    at = F.instr(email, "@")
    return F.when(at > 0, F.nullif(F.lower(F.trim(F.substr(email, at + 1))), F.lit("")))


def crude_domain(url: Column) -> Column:
    """The last two labels of an address with or without scheme; null where there is no dot."""
    bare = F.regexp_replace(F.substring_index(F.regexp_replace(F.lower(url), r"^(https://)?(http://)?(www\.)?", ""), "/", 1), "^[^@]*@", "")
    return F.when(bare.contains("."), F.substring_index(bare, ".", -2))


def rules(a: str = "a", b: str = "b", ka: str = "ka", kb: str = "kb") -> list[Column]:
    """The contributions to an edge's confidence: struct(score, reason), or null where a rule says nothing. A rule of one's own is another such column."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    bare = lambda v: F.regexp_replace(v, "[._-]", "")
    users = (F.col(ka) == "Username") & (F.col(kb) == "Username") & (x != y) & (x != "") & (y != "")
    one = (F.col(ka) == "Username") != (F.col(kb) == "Username")
    user, other = F.when(F.col(ka) == "Username", x).otherwise(y), F.when(F.col(ka) == "Username", F.lower(b)).otherwise(F.lower(a))
    web = F.col(ka).isin(*WEB) & F.col(kb).isin(*WEB)
    said = lambda cond, score, reason: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(score).alias("score"), F.lit(reason).alias("reason")))
    return [
        said(users & (bare(x) == bare(y)), 0.85, "same username but for separators"),
        said(users & (bare(x) != bare(y)) & (F.contains(x, y) | F.contains(y, x)), 0.6, "one username holds the other"),
        said((F.col(ka) == "Email") & (F.col(kb) == "Email") & (domain_of(F.col(a)) == domain_of(F.col(b))), 0.7, "same mail domain"),
        said(one & (user != "") & F.contains(other, user), 0.65, "value holds the username"),
        said(web & (crude_domain(F.col(a)) == crude_domain(F.col(b))), 0.6, "same domain"),
    ]


def edge_confidence(edges: DataFrame, vertices: DataFrame, evidence: DataFrame, contributors: list[Column] | None = None) -> DataFrame:
    """(case_id, src, dst, relation, score, reasons): the greatest score and all reasons of the edges that any rule speaks for; those without both ends are left out.

    An end stands for the evidence (case_id, ord, type, value) whose value is its label, whatever the case, the last of equal ones; else for itself.
    """
    last = evidence.groupBy("case_id", F.lower("value").alias("low")).agg(F.max_by(F.struct("type", "value"), "ord").alias("e"))
    v = vertices.withColumn("low", F.lower("label")).join(last, ["case_id", "low"], "left")
    v = v.select("case_id", "id", F.coalesce("e.value", "label").alias("v"), F.coalesce("e.type", _map(KIND)[F.col("type")]).alias("k"))
    d = edges.join(v.toDF("case_id", "src", "a", "ka"), ["case_id", "src"]).join(v.toDF("case_id", "dst", "b", "kb"), ["case_id", "dst"])
    d = d.withColumn("said", F.array_compact(F.array(*(contributors or rules())))).where(F.size("said") > 0)
    reasons = F.array_join(F.array_distinct(F.transform("said", lambda x: x["reason"])), "; ")
    return d.select("case_id", "src", "dst", "relation", F.array_max(F.transform("said", lambda x: x["score"])).alias("score"), reasons.alias("reasons"))


def reached(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(case_id, id, path): of each vertex that the case's start reaches along edges in either direction, the path by which a breadth-first walk finds it first.

    Neighbours come in the order of their first edge (ord). Level by level, until no vertex is new: each round joins the newest vertices with their edges and keeps of each vertex the way that is
    first in order, which is that of the places taken on the way.
    """
    both = edges.select("case_id", F.col("src").alias("id"), "dst", "ord").union(edges.select("case_id", "dst", "src", "ord"))
    near = cut(both.groupBy("case_id", "id", "dst").agg(F.min("ord").alias("pos")))
    step = starts.select("case_id", "id", F.array("id").alias("path"), F.array().cast("array<bigint>").alias("way"))
    found = cut(step)
    front = found
    while not front.isEmpty():
        out = front.join(near, ["case_id", "id"]).select("case_id", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"), F.concat("way", F.array("pos")).alias("way"))
        front = cut(out.join(found, ["case_id", "id"], "left_anti").groupBy("case_id", "id").agg(F.min_by("path", "way").alias("path"), F.min("way").alias("way")))
        found = cut(found.unionByName(front))
    return found.select("case_id", "id", "path")


def attack_paths(edges: DataFrame, vertices: DataFrame, confidence: DataFrame, most: int = 5) -> DataFrame:
    """(case_id, rank, endpoint, hops, steps): a shortest path from the person to each breach, the longest first, `most` of a case; each step by its edge's own direction, with relation and confidence where there is one."""
    start = vertices.where("type = 'Person'").groupBy("case_id").agg(F.min_by("id", "ord").alias("id"))
    ends = vertices.where("type = 'Breach'").select("case_id", "id", F.col("ord").alias("end_ord"), F.col("label").alias("endpoint"))
    p = reached(edges, start).join(ends, ["case_id", "id"]).where("size(path) > 1").withColumn("hops", (F.size("path") - 1).cast("long"))
    rank = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("hops"), "end_ord"))
    p = p.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)
    pair = lambda a, b: F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    legs = p.select("case_id", "rank", "endpoint", "hops", F.posexplode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] as a, path[i] as b))")).alias("i", "leg")).withColumn("pair", pair(F.col("leg.a"), F.col("leg.b")))
    one = edges.join(confidence.select("case_id", "src", "dst", "relation", "score"), ["case_id", "src", "dst", "relation"], "left").withColumn("pair", pair(F.col("src"), F.col("dst"))).groupBy("case_id", "pair").agg(F.min_by(F.struct("src", "dst", "relation", "score"), "ord").alias("e"))
    names = vertices.select("case_id", "id", "label")
    legs = legs.join(one, ["case_id", "pair"]).select("case_id", "rank", "endpoint", "hops", "i", "e.*")
    legs = legs.join(names.toDF("case_id", "src", "from"), ["case_id", "src"]).join(names.toDF("case_id", "dst", "to"), ["case_id", "dst"])
    text = F.concat("from", F.lit(" -"), "relation", F.lit("-> "), "to", F.when(F.col("score").isNotNull(), F.format_string(" (%.2f)", "score")).otherwise(""))
    g = legs.groupBy("case_id", "rank", "endpoint", "hops").agg(F.array_sort(F.collect_list(F.struct("i", text.alias("t")))).alias("s")).where("size(s) = hops")
    return g.select("case_id", "rank", "endpoint", "hops", F.array_join(F.transform("s", lambda x: x["t"]), " | ").alias("steps"))
