"""From identity seeds to candidate profiles, and the budget of pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.ordering import cap, keep_first, spread

BASE = {"Exact": 0.90, "Dot": 0.85, "Underscore": 0.85, "Hyphen": 0.80, "Fuzzy": 0.65}


def _form(username: Column, match: str) -> Column:
    return F.struct(username.alias("username"), F.lit(match).alias("match"))


def handle_forms(handle: Column) -> Column:
    """A handle as it is; one of several words also with signs in place of the blanks, and without."""
    h = F.trim(handle)
    one = F.regexp_replace(h, r"\s+", " ")
    more = [_form(F.replace(one, F.lit(" "), F.lit(c)), k) for c, k in (("_", "Underscore"), ("-", "Hyphen"), (".", "Dot"), ("", "Exact"))]
    return F.when(h == "", F.array().cast("array<struct<username:string,match:string>>")).otherwise(F.concat(F.array(_form(h, "Exact")), F.when(F.contains(h, F.lit(" ")), F.array(*more)).otherwise(F.array().cast("array<struct<username:string,match:string>>"))))


def name_forms(name: Column) -> Column:
    """The forms of a name of two words or more, letters and digits alone; a name of one word is that word, and no other form."""
    w = F.filter(F.transform(F.split(F.lower(F.trim(name)), r"\s+"), lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]", "")), lambda x: x != "")
    f, l, m = F.get(w, F.lit(0)), F.try_element_at(w, F.lit(-1)), F.when(F.size(w) > 2, F.get(w, F.lit(1)))  # noqa: E741
    j = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    i, k = F.left(f, F.lit(1)), F.left(l, F.lit(1))
    forms = [(j(f, l), "Exact"), (j(f, ".", l), "Dot"), (j(f, "_", l), "Underscore"), (j(f, "-", l), "Hyphen"), (j(l, ".", f), "Dot"), (j(l, "_", f), "Underscore"), (j(l, f), "Fuzzy"), (f, "Fuzzy"), (l, "Fuzzy"), (j(i, l), "Fuzzy"), (j(i, ".", l), "Dot"), (j(l, i), "Fuzzy"), (j(f, k), "Fuzzy"), (j(f, m, l), "Fuzzy"), (j(f, ".", m, ".", l), "Dot")]
    many = F.filter(F.array(*[_form(x, t) for x, t in forms]), lambda x: x["username"].isNotNull() & (F.length(x["username"]) >= 2))
    empty = F.array().cast("array<struct<username:string,match:string>>")
    return F.when(F.size(w) == 1, F.array(_form(f, "Exact"))).when(F.size(w) > 1, many).otherwise(empty)


def mail_forms(email: Column) -> Column:
    """What stands before the @, without a tag after +: as it is, and its words with other signs, and alone where they have three letters."""
    local = F.substring_index(F.regexp_replace(F.substring_index(F.trim(email), "@", 1), r"^\+", ""), "+", 1)
    t = F.filter(F.split(F.lower(local), "[^a-z0-9]+"), lambda x: x != "")
    whole = _form(F.regexp_replace(F.lower(local), r"[^\p{L}\p{N}._-]", ""), "Exact")
    several = F.concat(F.array(whole, _form(F.array_join(t, "."), "Dot"), _form(F.array_join(t, "_"), "Underscore"), _form(F.array_join(t, "-"), "Hyphen"), _form(F.array_join(t, ""), "Exact")), F.transform(F.filter(t, lambda x: F.length(x) >= 3), lambda x: _form(x, "Fuzzy")))
    single = F.array(whole, _form(F.array_join(t, ""), "Exact"))
    return F.filter(F.when(~F.contains(email, F.lit("@")), F.array().cast("array<struct<username:string,match:string>>")).when(F.size(t) > 1, several).otherwise(single), lambda x: F.length(x["username"]) >= 2)


def all_seeds(identities: DataFrame, key: str = "subject_id") -> DataFrame:
    """(key, ord, seed, username, match): the first handle, the name, other handles, addresses, in this order; of equal usernames, whatever their case, the first. seed says where it comes from: handle, name or email."""
    tag = lambda forms, seed, base: F.transform(forms, lambda x, i: F.struct((i + base).alias("ord"), F.lit(seed).alias("seed"), x["username"].alias("username"), x["match"].alias("match")))
    none = F.array().cast("array<struct<username:string,match:string>>")
    first = F.coalesce(handle_forms(F.get("handles", F.lit(0))), none)
    rest = F.flatten(F.transform(F.slice("handles", 2, 1_000), handle_forms))
    mails = F.flatten(F.transform("emails", mail_forms))
    every = F.concat(tag(first, "handle", 0), tag(name_forms(F.col("full_name")), "name", 1_000), tag(rest, "handle", 2_000), tag(mails, "email", 100_000))
    flat = spread(identities, key).select(key, F.explode(every).alias("s")).select(key, F.col("s.ord").cast("long").alias("ord"), "s.seed", "s.username", "s.match").where("trim(username) != ''")
    return keep_first(flat, [key, "lower(username)"], ["ord"])


def candidates(seeds: DataFrame, identities: DataFrame, platforms: DataFrame, key: str = "subject_id") -> DataFrame:
    """(key, platform, url, confidence, ord): every seed on every platform that is fetched by default, each URL once. Names count only for an identity without handles, and one of a single word only on GitHub and Reddit."""
    from auditlake.operators.scans import base_confidence

    p = F.broadcast(platforms.where("by_default").select("platform", "pattern", F.col("ord").alias("p_ord")))
    who = identities.select(key, (F.size("handles") > 0).alias("handled"), (F.size(F.filter(F.split(F.trim("full_name"), r"\s+"), lambda w: w != "")) <= 1).alias("word"))
    # merged by key, as the seeds lie already: a broadcast would gather what follows in few tasks, by its bytes before it unfolds
    d = seeds.join(who.hint("merge"), key).where("seed != 'name' or not handled").crossJoin(p).where("seed != 'name' or not word or platform in ('GitHub', 'Reddit')")
    kind = F.when((F.col("seed") == "name") & F.col("word"), "word").otherwise(F.col("seed"))
    d = d.select(key, "platform", F.replace("pattern", F.lit("{u}"), F.col("username")).alias("url"), base_confidence(kind, F.col("match")).alias("confidence"), (F.col("ord") * 100 + F.col("p_ord")).cast("long").alias("ord"))
    return keep_first(d, [key, "url"], ["ord", "platform"])


def supplied(identities: DataFrame, platforms: DataFrame, key: str = "subject_id") -> DataFrame:
    """Candidates of supplied profile URLs: certain, on the first platform whose host the URL holds anywhere, as the original has it ("netflix.com" holds "x.com"), else a website."""
    from auditlake.functions import urls as U

    d = identities.select(key, F.explode("profile_urls").alias("u")).where("trim(u) != ''").withColumn("url", F.when(F.trim("u").rlike("(?i)^https?://"), F.trim("u")).otherwise(U.ensure_https(F.col("u"))))
    met = d.join(F.broadcast(platforms.select("platform", F.col("host").alias("h"), "ord")), F.contains(F.lower("url"), F.col("h")), "left")
    return met.groupBy(key, "url").agg(F.coalesce(F.min_by("platform", "ord"), F.lit("Website")).alias("platform")).select(key, "platform", "url", F.lit(1.0).alias("confidence"))


def capped(candidates: DataFrame, most: int = 80, key: str = "subject_id") -> DataFrame:
    """A subject's most likely candidates."""
    return cap(candidates, [key], [F.desc("confidence"), "ord", "url"], most)


def budgeted(pivots: DataFrame, scanned: DataFrame, budget: int = 30, key: str = "subject_id") -> DataFrame:
    """(key, hop, url, ord): handles found on pages, without those scanned already, and no more than the budget that both hops share: the second has what the first left."""
    fresh = keep_first(pivots, [key, "lower(url)"], ["hop", "ord"]).withColumn("k", F.lower("url"))
    fresh = fresh.join(scanned.select(key, F.lower("url").alias("k")), [key, "k"], "left_anti").drop("k")
    return cap(fresh, [key], ["hop", "ord", "url"], budget)
