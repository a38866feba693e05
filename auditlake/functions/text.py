"""Text expressions: match spans with offsets, snippets, personal-data rules. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"(?i)\b[\w.%+-]+@[a-z\d.-]+\.[a-z]{2,}\b"
#: Digits that follow a letter are part of a word: of a name with a number, a code.
PHONE = r"(?<![0-9A-Za-z\u00c0-\u024f\u0370-\u052f])(?:[+][0-9]{1,3}[-. ]?)?(?:[(]?[0-9]{2,4}[)]?[-. ]?){2,5}[0-9]{2,4}(?![0-9])"
AT = r"\b(?:" + "|".join(sorted([*(f"{x} at" for x in ("intern", "lead", "works", "manager", "studied", "student", "employed", "designer", "engineer", "developer")), "member of", r"company\s*:"])) + ")"
IN = r"\b(?:" + "|".join(sorted([*(f"{x} in" for x in ("located", "lives", "based")), r"location\s*:", "from"])) + ")"
LOCATION = IN + r"\s+([A-Z][-.'\p{L}]+(?:\s+[A-Z][-.'\p{L}]+){0,4})"
ORGANIZATION = AT + r"\s+([A-Z][-&.'0-9\p{L}]+(?:\s+[A-Z][-&.'0-9\p{L}]+){0,5})"
URL = r"https?://[-\w.~:/?#@!$&'()*+,;=%\[\]]+"
PHONE_CONTEXT = "(?i)(" + "|".join(sorted("tel: signal whatsapp phone telephone contact mobile call".split())) + ")"
CHALLENGES = sorted(["captcha", "access denied", "unusual traffic", "automated queries", "just a moment", "checking your browser", "verify you are human", "cf-challenge", "enable javascript and cookies"])
MISSING = sorted(["page not found", "user not found", "profile not found", "account suspended", "this account doesn't exist", "this content isn't available", "page isn't available", "nothing to see here"])


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of all matches, start counted from 1, though the built-in functions give no offsets.

    Matches are put between two characters that are taken out of the text first; split there, every other piece is a match, and
    the pieces before it give its place. Null for null.
    """
    clean = F.translate(text, "\u0001\u0002", "  ")
    parts = F.split(F.regexp_replace(clean, pattern, "\u0001$0\u0002"), "[\u0001\u0002]")
    step = lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), p.alias("value"))))).otherwise(acc["out"]).alias("out"))
    start = F.struct(F.lit(1).alias("at"), F.lit(False).alias("hit"), F.array().cast("array<struct<start:int,value:string>>").alias("out"))
    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def snippet(text: Column, start: Column, length: Column, around: int = 60, most: int = 240) -> Column:
    """The match with its surroundings, white space collapsed."""
    lo = F.greatest(start - around, F.lit(1))
    cut = F.substr(text, lo, start + length + around - lo)
    return F.left(F.trim(F.regexp_replace(cut, r"\s+", " ")), F.lit(most))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def date_or_counter(raw: Column) -> Column:
    """Eight digits that begin like a year, two or more dashes or slashes without a plus, or one repeated digit."""
    d = digits(raw)
    year = (F.length(d) == 8) & F.substring(d, 1, 4).cast("int").between(1900, 2100)
    marks = (F.length(F.regexp_replace(raw, "[^-/]", "")) >= 2) & ~raw.contains("+")
    same = F.length(F.replace(d, F.substring(d, 1, 1), F.lit(""))) == 0
    return year | marks | same


def trimmed(value: Column) -> Column:
    """Without punctuation at the end."""
    return F.regexp_replace(F.trim(value), r"[.,;:!)\]}'-]+$", "")


def contains_token(text: Column, token: Column) -> Column:
    """Whether the token's first occurrence stands between characters that are neither letters nor digits."""
    low, t = F.lower(text), F.lower(token)
    at = F.position(t, low)
    before = F.when(at > 1, F.substr(low, at - 1, F.lit(1))).otherwise(F.lit(" "))
    after = F.substr(low, at + F.length(t), F.lit(1))
    return (at > 0) & (F.length(t) > 0) & ~before.rlike(r"[\p{L}0-9]") & ~after.rlike(r"[\p{L}0-9]")
