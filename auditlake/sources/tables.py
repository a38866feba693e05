"""Tables that the engine reads, and those it derives: subjects with consent, their texts, search hits, breach ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name, URL pattern, fetched by default, host, path before the handle; in order of precedence.
PLATFORMS = [
    ("GitHub", "https://github.com/{u}", True, "github.com", ""),
    ("Instagram", "https://www.instagram.com/{u}/", True, "instagram.com", ""),
    ("Facebook", "https://www.facebook.com/{u}", False, "facebook.com", ""),
    ("X", "https://x.com/{u}", True, "x.com", ""),
    ("Reddit", "https://www.reddit.com/user/{u}", True, "reddit.com", "user"),
    ("StackOverflow", "https://stackoverflow.com/users/{u}", False, "stackoverflow.com", "users"),
    ("TikTok", "https://www.tiktok.com/@{u}", True, "tiktok.com", "@"),
    ("YouTube", "https://www.youtube.com/@{u}", True, "youtube.com", "@"),
    ("Medium", "https://medium.com/@{u}", True, "medium.com", "@"),
    ("LinkedIn", "https://www.linkedin.com/in/{u}", False, "linkedin.com", "in"),
    ("Pinterest", "https://www.pinterest.com/{u}/", True, "pinterest.com", ""),
    ("Telegram", "https://t.me/{u}", True, "t.me", ""),
    ("Bluesky", "https://bsky.app/profile/{u}", True, "bsky.app", "profile"),
    ("Mastodon", "https://mastodon.social/@{u}", True, "mastodon.social", "@"),
    ("DevTo", "https://dev.to/{u}", True, "dev.to", ""),
    ("Twitch", "https://www.twitch.tv/{u}", True, "twitch.tv", ""),
    ("GitLab", "https://gitlab.com/{u}", True, "gitlab.com", ""),
    ("HackerNews", "https://news.ycombinator.com/user?id={u}", True, "news.ycombinator.com", "user?id="),
    ("Threads", "https://www.threads.net/@{u}", True, "threads.net", "@"),
    ("Snapchat", "https://www.snapchat.com/add/{u}", False, "snapchat.com", "add"),
    ("Discord", "https://discord.com/users/{u}", False, "discord.com", "users"),
]
FIRST_NAMES = ["alex", "robin", "sam", "kim", "lee", "noa", "max"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def platforms(spark: SparkSession) -> DataFrame:
    """The 21 profile templates, in order of precedence (ord)."""
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PLATFORMS)], "ord int, platform string, pattern string, by_default boolean, host string, prefix string")


def subjects(spark: SparkSession, folder: str) -> DataFrame:
    """Identity seeds of every customer; `authorized` is the subject's consent, which attributed queries ask for."""
    c, n, r = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    wide = c.join(F.broadcast(n), F.expr("c_nationkey = n_nationkey")).join(F.broadcast(r), F.expr("n_regionkey = r_regionkey"))
    names = ", ".join(f"'{x}'" for x in FIRST_NAMES)
    return wide.select(
        F.col("c_custkey").alias("subject_id"),
        F.expr(f"concat_ws(' ', element_at(array({names}), cast(c_custkey % 7 as int) + 1), if(c_custkey % 5 = 0, 'van', null), concat(lower(regexp_replace(n_name, '[ _]', '')), c_custkey))").alias("full_name"),
        F.expr("concat('user', translate(cast(c_custkey as string), '0123456789', 'abcdefghij'))").alias("handle"),
        F.expr("concat('user', translate(cast(c_custkey as string), '0123456789', 'abcdefghij'), '@', lower(c_mktsegment), '.example')").alias("email"),
        F.expr("concat('+1 415 555 ', lpad(cast(c_custkey % 10000 as string), 4, '0'))").alias("phone"),
        F.expr("concat(substr(r_name, 1, 1), lower(substr(r_name, 2)))").alias("location"),
        F.expr("concat(substr(c_mktsegment, 1, 1), lower(substr(c_mktsegment, 2)), ' Labs')").alias("organization"),
        F.expr("c_custkey % 2 = 0").alias("authorized"),
    )


def subject_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A text of each subject, with an address of its own."""
    return subjects(spark, folder).select(
        F.col("subject_id").alias("doc_id"),
        F.expr("concat('https://people.example/', handle)").alias("url"),
        F.expr("concat(full_name, ' lives in ', location, ', works at ', organization, '; please call ', phone, ' or write to ', email, if(subject_id % 3 = 0, concat(' / github: @', handle), ''))").alias("text"),
    )


def search_hits(spark: SparkSession, folder: str) -> DataFrame:
    """What two providers each say of a subject's page, one of them by a URL with a tracking parameter."""
    p = subject_pages(spark, folder)
    both = F.array(F.struct((F.col("doc_id") % 6).alias("p"), F.lit("").alias("tail")), F.struct((F.col("doc_id") % 5).alias("p"), F.lit("/?utm_source=Mail&ref=x#top").alias("tail")))
    return p.select("doc_id", "url", "text", F.explode(both).alias("s")).select(F.col("doc_id").alias("subject_id"), F.concat("url", "s.tail").alias("url"), F.concat(F.lit("provider"), "s.p").alias("provider"), F.substring("text", 1, 40).alias("title"), F.when(F.col("s.tail") == "", F.col("text")).otherwise(F.substring("text", 1, 60)).alias("snippet"))


def breach_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Hash ranges by prefix, of every third subject's address."""
    h = F.upper(F.sha1(F.lower(F.trim("email"))))
    return subjects(spark, folder).where("subject_id % 3 = 0").select(F.left(h, F.lit(5)).alias("prefix"), F.substr(h, F.lit(6)).alias("suffix"), (F.col("subject_id") % 100 + 1).alias("count"))
