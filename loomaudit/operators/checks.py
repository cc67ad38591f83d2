"""Check rows: the one shape that every rule returns, its findings across runs, scores and rollups.

A check row is (group, rule_id, name, status, message, page_url) and perhaps
items; status is pass, warn, fail, info or skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomaudit.functions.text import fingerprint

KEY = ["normalized_url", "rule_id", "check_name", "locator"]
#: fixed values of the score: curve, density and its caps, grades
CURVE, DENSITY_FROM, DENSITY_CAP, DENSITY_RATE, ITEM_CAP = 1.2, 10, 0.45, 3.0, 20
NO_ROBOTS, BLOCKED, NO_SITEMAP = 0.15, 0.5, 0.2


def unpivot_rules(rows: DataFrame, group: list[str], page: str, rules: list[str]) -> DataFrame:
    """One check row per page and rule column that holds a status."""
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule_id"), F.col(r).alias("status")) for r in rules)))
    return rows.select(*group, F.col(page).alias("page_url"), each.alias("_r")).select(
        *group, "page_url", "_r.rule_id", F.col("_r.rule_id").alias("name"), "_r.status", F.concat_ws(" ", "_r.rule_id", "_r.status").alias("message")
    )


def flatten(checks: DataFrame, group: list[str]) -> DataFrame:
    """Finding rows of failing and warning checks: one per item, or one with locator '' for a check without items."""
    kept = checks.filter(F.col("status").isin("warn", "fail"))
    locator = F.explode_outer("items") if "items" in checks.columns else F.lit(None).cast("string")
    rows = kept.select(*group, F.col("page_url").alias("normalized_url"), "rule_id", F.col("name").alias("check_name"), "status", "message", locator.alias("locator"))
    return rows.withColumn("locator", F.coalesce("locator", F.lit(""))).withColumn("fingerprint", fingerprint(F.col("status"), F.col("message")))


def merge(prior: DataFrame, fresh: DataFrame, crawled: DataFrame, removed: DataFrame, group: list[str]) -> DataFrame:
    """The findings after a run: open, resolved, stale or carried.

    Fresh findings are open. A prior one that didn't come again is resolved if
    its page was crawled, stale if its page is gone, and else carried as it
    was. prior and fresh: group, KEY, status, message, fingerprint; crawled and
    removed: group, normalized_url. Duplicate keys count once, by the largest
    fingerprint.
    """
    on = [*group, *KEY]
    one = lambda d, p: d.groupBy(*on).agg(F.max(F.struct("fingerprint", "status", "message")).alias(p))
    pair = one(prior, "_was").join(one(fresh, "_now"), on, "full")
    seen = crawled.select(*group, "normalized_url").distinct().withColumn("_seen", F.lit(True))
    gone = removed.select(*group, "normalized_url").distinct().withColumn("_gone", F.lit(True))
    pair = pair.join(seen, [*group, "normalized_url"], "left").join(gone, [*group, "normalized_url"], "left")
    state = (
        F.when(F.col("_now").isNotNull(), F.lit("open")).when(F.col("_gone"), F.lit("stale")).when(F.col("_seen"), F.lit("resolved")).otherwise(F.lit("carried"))
    )
    last = F.coalesce("_now", "_was")
    change = F.when(F.col("_was").isNull(), F.lit("added")).when(F.col("_now").isNull(), F.lit("dropped")).when(
        F.col("_was.fingerprint") != F.col("_now.fingerprint"), F.lit("changed")
    ).otherwise(F.lit("same"))
    return pair.select(*on, last["status"].alias("status"), last["message"].alias("message"), state.alias("state"), change.alias("change"))


def compact(findings: DataFrame, group: list[str], newest: int, order: str = "last_seen_at") -> DataFrame:
    """All open findings, and of the others the ``newest`` per group: retention is the feature."""
    ended = ~F.col("state").isin("open", "carried")
    n = F.row_number().over(W.partitionBy(*group, ended).orderBy(F.desc(order), *KEY))
    return findings.withColumn("_n", n).filter(~ended | (F.col("_n") <= newest)).drop("_n")


def rule_scores(checks: DataFrame, group: list[str]) -> DataFrame:
    """Per rule: counts by status and the mean of 1 for pass, 0.5 for warn, 0 for fail; info and skipped don't count."""
    value = F.when(F.col("status") == "pass", 1.0).when(F.col("status") == "warn", 0.5).when(F.col("status") == "fail", 0.0)
    return checks.groupBy(*group, "rule_id").agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warn", "fail", "info", "skipped")),
        F.avg(value).alias("ratio"),
        F.count("*").alias("checks"),
    )


def curve(base: Column) -> Column:
    return 100 * F.pow(base / 100, CURVE)


def scores(checks: DataFrame, weights: DataFrame, group: list[str], site: DataFrame | None = None) -> DataFrame:
    """(group, score, grade): weighted mean of rule ratios on the curve, less for dense issues and a missing robots file or sitemap.

    ``weights``: rule_id, weight; rules without one weigh 5. A fail counts two
    units, a warn one; once there are DENSITY_FROM raw units, up to
    DENSITY_CAP is taken off. ``site`` has group, has_robots, blocks_all,
    has_sitemap. A group whose checks were all skipped scores 100.
    """
    rules = rule_scores(checks, group).join(F.broadcast(weights), "rule_id", "left").withColumn("weight", F.coalesce("weight", F.lit(5)))
    total = rules.groupBy(*group).agg(
        (100 * F.sum(F.col("weight") * F.col("ratio")) / F.sum(F.when(F.col("ratio").isNotNull(), F.col("weight")))).alias("base"),
        F.sum(2 * F.col("fail") + F.col("warn")).alias("units"),
        F.sum(F.col("fail") + F.col("warn")).alias("raw"),
        F.sum(F.col("pass") + F.col("warn") + F.col("fail")).alias("scored"),
    )
    off = F.when(F.col("raw") >= DENSITY_FROM, F.least(F.lit(DENSITY_CAP), DENSITY_RATE * F.col("units") / F.col("scored"))).otherwise(F.lit(0.0))
    score = curve(F.col("base")) * (1 - off)
    if site is not None:
        total = total.join(site, group, "left")
        for column, part, bad in (("has_robots", NO_ROBOTS, False), ("blocks_all", BLOCKED, True), ("has_sitemap", NO_SITEMAP, False)):
            score = score * F.when(F.col(column) == F.lit(bad), F.lit(1 - part)).otherwise(F.lit(1.0))
    whole = F.coalesce(F.floor(score + 0.5), F.lit(100)).cast("int")
    grade = F.when(whole >= 90, "A").when(whole >= 80, "B").when(whole >= 70, "C").when(whole >= 60, "D").otherwise("F")
    return total.select(*group, whole.alias("score"), grade.alias("grade"))


def issue_groups(checks: DataFrame, group: list[str], samples: int = 5) -> DataFrame:
    """Failing and warning checks by rule, name, status and message with digits as #: pages, occurrences, first pages.

    The sample of pages is the report's feature; the counts are over all.
    """
    kept = checks.filter(F.col("status").isin("warn", "fail")).withColumn("pattern", F.regexp_replace("message", r"\d+", "#"))
    keys = [*group, "rule_id", "name", "status", "pattern"]
    per_page = kept.groupBy(*keys, "page_url").agg(F.count("*").alias("n"))
    ranked = per_page.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("page_url")))
    return ranked.groupBy(*keys).agg(
        F.count("page_url").alias("pages"),
        F.sum("n").alias("occurrences"),
        F.array_sort(F.collect_list(F.when(F.col("_r") <= samples, F.col("page_url")))).alias("first_pages"),
    )


def rollup(checks: DataFrame, categories: Column, group: list[str]) -> DataFrame:
    """Counts per category and, in rows with null category, over all."""
    c = checks.withColumn("category", categories)
    sets = c.rollup(*[F.col(g) for g in group], "category") if not group else None
    if sets is None:
        one = c.groupBy(*group, "category")
        every = c.groupBy(*group)
        counts = [F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warn", "fail", "info")]
        return one.agg(*counts).unionByName(every.agg(*counts).withColumn("category", F.lit(None).cast("string")))
    return sets.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warn", "fail", "info")))


def diff(baseline: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """(key, change, direction) between two reports' findings: added, removed or changed status; worse or better."""
    rank = lambda c: F.when(c == "fail", 2).when(c == "warn", 1).otherwise(0)
    one = lambda d, n: d.groupBy(*key).agg(F.max_by("status", rank(F.col("status"))).alias(n))
    pair = one(baseline, "was").join(one(current, "now"), key, "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    worse = rank(F.coalesce("now", F.lit("pass"))) - rank(F.coalesce("was", F.lit("pass")))
    return pair.select(*key, change.alias("change"), F.when(worse > 0, "regression").otherwise("improvement").alias("direction")).filter("change is not null")


def render_markdown(issues: DataFrame, limit: int = 200) -> str:
    """A short report of the largest issue groups; the limit is the report's."""
    rows = issues.orderBy(F.desc("pages"), "rule_id", "name").limit(limit).collect()
    out = ["# Audit report", "", "| Rule | Status | Pages | Example |", "|---|---|---|---|"]
    for r in rows:
        first = (r["first_pages"] or [""])[0] if r["first_pages"] else ""
        out.append(f"| {r['rule_id']} | {r['status']} | {r['pages']} | {first} |")
    return "\n".join(out) + "\n"
