"""URL normalizers, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.profiles import let

TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content gclid fbclid msclkid ref ref_src ved source yclid".split()
REDIRECTS = "uddg q url u target".split()


def ensure_https(raw: Column) -> Column:
    """An https URL of whatever was typed; null stays null."""
    t = F.trim(raw)
    return F.when(t.rlike("(?i)^https://"), t).when(t.rlike("(?i)^http://"), F.concat(F.lit("https://"), F.substring(t, 8, 1 << 30))).otherwise(F.concat(F.lit("https://"), F.regexp_replace(t, "^/+", "")))


def strip_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def canonical_key(url: Column) -> Column:
    """Without fragment, tracking parameters and closing slashes, all in lower case: pages that are one have one key."""
    bare = strip_fragment(url)
    path, query = F.substring_index(bare, "?", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING)), "&")
    return F.lower(F.regexp_replace(F.concat(path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")), "/+$", ""))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")


def host_and_path(url: Column) -> Column:
    """Host without www, and path, for comparing a page with the profile it should be."""
    return F.concat(host(url), F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), "/+$", ""))


def registrable_domain(url: Column) -> Column:
    """The host's last two labels."""
    labels = F.split(host(url), r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")


def unwrap_redirect(href: Column) -> Column:
    """The target of a search engine's redirect, else the URL itself; null where it isn't http."""
    found = F.array(*[F.try_url_decode(F.regexp_extract(href, rf"[?&]{k}=([^&#]+)", 1)) for k in REDIRECTS])
    return let(F.coalesce(F.get(F.filter(found, lambda x: x.rlike("^https?://")), F.lit(0)), href), lambda out: F.when(out.rlike("^https?://[^/]+"), out))


def profile_handle(url: Column, prefix: Column) -> Column:
    """The handle of a profile URL, given what its platform puts before it; null where there is none."""
    rest = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+/([^#]*)", 1)
    after = F.when(prefix == "", rest).when(prefix.isin("@", "user?id="), F.when(F.startswith(rest, prefix), F.substr(rest, F.length(prefix) + 1))).when(F.startswith(rest, F.concat(prefix, F.lit("/"))), F.substr(rest, F.length(prefix) + 2))
    handle = F.regexp_extract(after, r"^@?([A-Za-z0-9_.\-]+)/?(?:[?].*)?$", 1)
    return F.when(handle != "", handle)
