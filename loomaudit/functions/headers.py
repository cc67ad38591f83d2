"""Response headers as column expressions: security headers, cookies, freshness. Null headers give null or the absent case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def header(headers: Column, name: str) -> Column:
    """A header of a map by its name in any case."""
    hit = F.map_filter(headers, lambda k, v: F.lower(k) == name.lower())
    return F.try_element_at(F.map_values(hit), F.lit(1))


def csp_directives(csp: Column) -> Column:
    """Directive name to its sources; the first of a repeated name holds."""
    parts = F.filter(F.transform(F.split(F.lower(csp), ";"), lambda p: F.trim(p)), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\S+)", 1).alias("k"), F.trim(F.regexp_replace(p, r"^\S+", "")).alias("v")))
    names = F.transform(pairs, lambda p: p["k"])
    kept = F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1)
    return F.map_from_entries(kept)


def csp_status(csp: Column) -> Column:
    """fail without a policy, warn for unsafe-inline, unsafe-eval or * in what controls scripts, or if nothing does."""
    d = csp_directives(csp)
    scripts = F.coalesce(F.try_element_at(d, F.lit("script-src")), F.try_element_at(d, F.lit("default-src")))
    return F.when(csp.isNull() | (F.trim(csp) == ""), F.lit("fail")).when(
        scripts.isNull() | scripts.rlike(r"'unsafe-inline'|'unsafe-eval'|(?:^|\s)\*(?:\s|$)"), F.lit("warn")
    ).otherwise(F.lit("pass"))


def hsts_status(scheme: Column, value: Column) -> Column:
    """info off https; warn if absent, malformed, zero or under six months."""
    age = F.regexp_extract(value, r"(?i)max-age\s*=\s*\"?(\d{1,12})", 1).try_cast("bigint")
    return F.when(scheme != "https", F.lit("info")).when(age.isNull() | (age < 15_768_000), F.lit("warn")).otherwise(F.lit("pass"))


def cookie(set_cookie: Column) -> Column:
    """(name, secure, http_only, same_site) of one Set-Cookie value; same_site is null if it isn't given."""
    attrs = F.transform(F.slice(F.split(set_cookie, ";"), 2, 1000), lambda a: F.lower(F.trim(a)))
    site = F.try_element_at(F.filter(attrs, lambda a: a.startswith("samesite=")), F.lit(1))
    return F.struct(
        F.trim(F.regexp_extract(set_cookie, r"^([^=;]*)", 1)).alias("name"),
        F.array_contains(attrs, "secure").alias("secure"),
        F.array_contains(attrs, "httponly").alias("http_only"),
        F.regexp_replace(site, "^samesite=", "").alias("same_site"),
    )


def freshness(now: Column, fetched: Column, lifetime: Column, cap: int = 86_400) -> Column:
    """fresh within the lifetime (at most ``cap`` seconds), revalidate for a day after, else stale; all in epoch seconds."""
    age, life = now - fetched, F.least(F.coalesce(lifetime, F.lit(0)), F.lit(cap))
    return F.when(age < life, F.lit("fresh")).when(age < life + 86_400, F.lit("revalidate")).otherwise(F.lit("stale"))


def vary_matches(vary: Column, stored: Column, current: Column) -> Column:
    """Whether all named request headers agree; * never does, no Vary always."""
    names = F.filter(F.transform(F.split(F.lower(vary), ","), lambda p: F.trim(p)), lambda n: n != "")
    get = lambda m, n: F.coalesce(F.try_element_at(m, n), F.lit(""))
    return F.when(vary.isNull(), F.lit(True)).when(F.array_contains(names, "*"), F.lit(False)).otherwise(
        F.forall(names, lambda n: get(stored, n) == get(current, n))
    )
