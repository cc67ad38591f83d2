"""URL functions as column expressions; null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: query parameters that only track a visit
TRACKING = ["gclid", "fbclid", "msclkid", "dclid", "yclid", "mc_cid", "mc_eid", "_ga", "igshid"]
_SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _SPLIT, 1))


def host(u: Column) -> Column:
    """Host without user and port, in lower case; '' if the URL isn't absolute."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(u, _SPLIT, 2), r"^[^@]*@", ""), r":\d*$", ""))


def authority(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _SPLIT, 2))


def path(u: Column) -> Column:
    """Path, '/' if it is empty."""
    p = F.regexp_extract(u, _SPLIT, 3)
    return F.when(p == "", F.lit("/")).otherwise(p)


def query(u: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(u, _SPLIT, 4), r"^\?", "")


def comparison_form(u: Column) -> Column:
    """Lower scheme and host, no query or fragment, one trailing slash stripped but for the root."""
    p = path(u)
    return F.concat(scheme(u), F.lit("://"), authority(u), F.when(p == "/", p).otherwise(F.regexp_replace(p, r"/$", "")))


def identity_form(u: Column, tracking: list[str] | None = None) -> Column:
    """Crawl identity: no fragment, default port or tracking parameters; trailing slash and other query stay."""
    names = TRACKING if tracking is None else tracking
    a = F.when(scheme(u) == "http", F.regexp_replace(authority(u), r":80$", "")).when(
        scheme(u) == "https", F.regexp_replace(authority(u), r":443$", "")
    ).otherwise(authority(u))
    name = lambda q: F.lower(F.regexp_extract(q, r"^([^=]*)", 1))
    kept = F.filter(F.split(query(u), "&"), lambda q: (q != "") & ~name(q).startswith("utm_") & ~name(q).isin(names))
    return F.concat(scheme(u), F.lit("://"), a, path(u), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def host_key(u: Column) -> Column:
    """Lower host:port, 'unknown' for null and unparseable URLs."""
    a = F.regexp_replace(authority(u), r"^[^@]*@", "")
    return F.when(u.isNull() | (a == ""), F.lit("unknown")).otherwise(a)


def is_internal(u: Column, base: Column) -> Column:
    """Exact host equality: www and apex differ."""
    return host(u) == host(base)


def should_skip(href: Column) -> Column:
    return F.trim(href).rlike(r"(?i)^(?:javascript|data|mailto|tel|sms|blob|about|file):") | F.trim(href).startswith("#") | (F.trim(href) == "")


def coerce_schemeless(href: Column) -> Column:
    """example.com/x becomes an absolute https URL; all else stays."""
    t = F.trim(href)
    return F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).when(
        t.rlike(r"(?i)^(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}(?::\d+)?(?:[/?#].*)?$"), F.concat(F.lit("https://"), t)
    ).otherwise(href)


def segments(u: Column) -> Column:
    return F.filter(F.split(path(u), "/"), lambda s: s != "")


def depth(u: Column) -> Column:
    return F.size(segments(u))


def prefix(u: Column) -> Column:
    """First path segment with its slash, '/' for the root."""
    s = segments(u)
    return F.when(F.size(s) == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.element_at(s, 1)))


def pattern(u: Column) -> Column:
    """Path template: ids, dates, versions and slugs of the segments replaced by their kind."""

    def kind(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$|^(?:19|20)\d{2}$"), F.lit("{date}"))
            .when(s.rlike(r"^\d+$|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[0-9a-f]{16,}$"), F.lit("{id}"))
            .when(s.rlike(r"^v\d+(?:\.\d+)*$"), F.lit("{version}"))
            .when(s.rlike(r"^[^-]+(?:-[^-]+){2,}$"), F.lit("{slug}"))
            .otherwise(s)
        )

    return F.concat(F.lit("/"), F.array_join(F.transform(segments(u), kind), "/"))


def is_private_host(h: Column) -> Column:
    """Loopback, private, link-local and reserved IPv4 addresses, and local names."""
    return h.rlike(
        r"^(?:localhost|.*\.local|.*\.localhost|\[?::1\]?|\[?f[cd][0-9a-f]{2}:.*|\[?fe80:.*)$"
        r"|^(?:0|10|127)(?:\.\d{1,3}){3}$|^169\.254(?:\.\d{1,3}){2}$|^192\.168(?:\.\d{1,3}){2}$|^172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2}$"
        r"|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])(?:\.\d{1,3}){2}$|^(?:22[4-9]|2[3-5]\d)(?:\.\d{1,3}){3}$"
    )


def is_valid_domain(h: Column) -> Column:
    return (F.length(h) <= 253) & h.rlike(r"(?i)^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$")


def parent_domains(h: Column) -> Column:
    """The host and its parents down to two labels."""
    parts = F.split(h, r"\.")
    n = F.size(parts)
    return F.when(n < 2, F.array(h)).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, i, n), ".")))


def glob(text: Column, patterns: list[str]) -> Column:
    """Whether text matches one of the patterns, in which * stands for anything."""
    import re

    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike("^" + ".*".join(re.escape(x) for x in p.split("*")) + "$")
    return out


def in_scope(u: Column, base: Column, exclude: list[str] = [], include: list[str] = [], domains: list[str] = []) -> Column:
    """(allowed, reason): exclude comes first, then include, allowed domains, and the base's host."""
    decision = F.when(glob(u, exclude), F.lit("excluded"))
    if include:
        decision = decision.when(~glob(u, include), F.lit("not_included"))
    known = host(u) == host(base)
    for d in domains:
        known = known | (host(u) == d) | host(u).endswith("." + d)
    decision = decision.when(~known, F.lit("other_host")).otherwise(F.lit("in_scope"))
    return F.struct((decision == "in_scope").alias("allowed"), decision.alias("reason"))
