"""The registry of rules, which of them run, and the pass that runs them over parsed pages."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Checks = list[tuple[str, Column]]


@dataclass
class Rule:
    """A page rule: ``run(options)`` gives (check name, status) columns over a parsed page; a null status gives no check."""

    id: str
    severity: str
    weight: int
    run: Callable[[dict], Checks]
    options: dict = field(default_factory=dict)
    #: left out on pages that only pretend to exist
    skip_soft_404: bool = False
    #: what a site must be for the rule: all keys, any of the values of each
    applies: dict[str, list[str]] = field(default_factory=dict)


RULES: dict[str, Rule] = {}


def rule(id: str, severity: str, weight: int, **more) -> Callable:
    def add(f: Callable[[dict], Checks]) -> Callable:
        RULES[id] = Rule(id, severity, weight, f, **more)
        return f

    return add


def register(r: Rule) -> None:
    """A rule of somebody else's; an id that is taken raises an error."""
    if r.id in RULES:
        raise ValueError(f"{r.id} is registered already")
    RULES[r.id] = r


def enabled(rule_id: str, enable: list[str], disable: list[str], config: dict | None = None) -> bool:
    """The rule's own flag comes first, then patterns that disable, then those that enable; nothing else runs."""
    own = (config or {}).get("enabled")
    if own is not None:
        return bool(own)
    if any(fnmatch.fnmatchcase(rule_id, p) for p in disable):
        return False
    return any(fnmatch.fnmatchcase(rule_id, p) for p in enable)


def options_of(r: Rule, config: dict | None) -> dict:
    """Defaults with the configured values over them; names that the rule doesn't have raise an error."""
    given = {k: v for k, v in (config or {}).items() if k != "enabled"}
    if unknown := set(given) - set(r.options):
        raise ValueError(f"{r.id} has no option {', '.join(sorted(unknown))}")
    return r.options | given


def applies(r: Rule, site: dict[str, tuple[str, str]] | None) -> bool:
    """Whether the site's metadata (value, confidence) suits the rule; what isn't known with at least medium confidence doesn't hold a rule back."""
    for key, wanted in r.applies.items():
        value, confidence = (site or {}).get(key, (None, "low"))
        if value is not None and confidence in ("medium", "high") and value not in wanted:
            return False
    return True


def run_rules(
    pages: DataFrame, enable: list[str] = ["*"], disable: list[str] = [], config: dict[str, dict] | None = None, site: dict | None = None, soft_404: str | None = None, rules: dict[str, Rule] | None = None,
    keep: list[str] = [],
) -> DataFrame:
    """(url, keep, rule_id, name, status) of all rules that run, in one pass over the parsed pages (sources.dom.SCHEMA).

    ``config`` has options by rule. A rule that doesn't apply to the site gives
    one ``skipped`` check a page, as does one that is left out on soft 404
    pages where the column ``soft_404`` is true. Pages without markup have no
    nodes and get what each rule says of nothing.
    """
    each = []
    for r in (rules or RULES).values():
        own = (config or {}).get(r.id)
        if not enabled(r.id, enable, disable, own):
            continue
        if not applies(r, site):
            each.append(F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.id.split("/")[1]).alias("name"), F.lit("skipped").alias("status")))
            continue
        for k, (name, status) in enumerate(r.run(options_of(r, own))):
            if soft_404 and r.skip_soft_404:
                status = F.when(F.coalesce(F.col(soft_404), F.lit(False)), F.lit("skipped") if k == 0 else F.lit(None)).otherwise(status)
            each.append(F.struct(F.lit(r.id).alias("rule_id"), F.lit(name).alias("name"), status.alias("status")))
    if not each:
        return pages.select("url", *keep, F.lit("").alias("rule_id"), F.lit("").alias("name"), F.lit("").alias("status")).limit(0)
    return pages.select("url", *keep, F.explode(F.array(*each)).alias("c")).select("url", *keep, "c.rule_id", "c.name", "c.status").filter("status is not null")
