"""Lookups against dimension tables, similarity to a site's baseline, and the crawl frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomaudit.functions import url


def threat_lookup(urls: DataFrame, feed: DataFrame, column: str = "url") -> DataFrame:
    """(url, kind, provider): exact URL, host and parent-domain hits, as equi-joins over exploded keys.

    ``feed``: kind (url, host, domain), value, provider. The feed's size isn't
    known, so Spark chooses the join.
    """
    u = urls.select(F.col(column).alias("url")).filter("url is not null").distinct()
    h = url.host(F.col("url"))
    keys = F.concat(
        F.array(F.struct(F.lit("url").alias("kind"), url.comparison_form(F.col("url")).alias("value")), F.struct(F.lit("host").alias("kind"), h.alias("value"))),
        F.transform(url.parent_domains(h), lambda d: F.struct(F.lit("domain").alias("kind"), d.alias("value"))),
    )
    wanted = u.select("url", F.explode(keys).alias("k")).select("url", "k.kind", "k.value")
    return wanted.join(feed, ["kind", "value"]).select("url", "kind", "value", "provider").distinct()


def baseline(markers: DataFrame, group: list[str], page: str) -> DataFrame:
    """(group, kind, token): markers on at least max(2, half) of a group's pages."""
    n = markers.groupBy(*group).agg(F.countDistinct(page).alias("_n"))
    on = markers.select(*group, page, "kind", "token").distinct().groupBy(*group, "kind", "token").agg(F.count("*").alias("_c"))
    return on.join(n, group).filter(F.col("_c") >= F.greatest(F.lit(2), F.ceil(F.col("_n") / 2))).select(*group, "kind", "token")


#: fixed values: what each kind of marker weighs in the similarity of a page to its site
MARKER_WEIGHTS = {"stylesheet": 0.35, "host": 0.25, "class": 0.15, "variable": 0.1, "chrome": 0.15}


def similarity(markers: DataFrame, base: DataFrame, group: list[str], page: str, weights: dict[str, float] = MARKER_WEIGHTS) -> DataFrame:
    """(group, page, similarity): the weighted mean, over the kinds of markers, of the Jaccard similarity of a page's with its group's baseline.

    A kind of which neither has any agrees wholly. Chrome is of two yes or no
    markers, of which the share that agrees counts: (2 - differing) / 2.
    """
    m = markers.select(*group, page, "kind", "token").distinct()
    both = m.join(base.withColumn("_in", F.lit(1)), [*group, "kind", "token"], "left").groupBy(*group, page, "kind").agg(
        F.count("*").alias("_a"), F.sum(F.coalesce("_in", F.lit(0))).alias("_i")
    )
    size = base.groupBy(*group, "kind").agg(F.count("*").alias("_b"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(w).alias("_w")) for k, w in weights.items())))
    every = m.select(*group, page).distinct().select(*group, page, kinds.alias("_k")).select(*group, page, "_k.kind", "_k._w")
    j = every.join(both, [*group, page, "kind"], "left").join(size, [*group, "kind"], "left")
    a, b, i = (F.coalesce(c, F.lit(0)) for c in ("_a", "_b", "_i"))
    union = a + b - i
    jaccard = F.when(F.col("kind") == "chrome", (2 - (union - i)) / 2).when(union == 0, 1.0).otherwise(i / union)
    return j.groupBy(*group, page).agg(F.sum(F.col("_w") * jaccard).alias("similarity"))


def priority(depth: Column, in_sitemap: Column, links: Column, path: Column | None = None) -> Column:
    """Smaller comes first: depth weighs 100, a sitemap entry -200, up to ten links -10 each, critical paths -800."""
    p = depth * 100 - F.when(in_sitemap, 200).otherwise(0) - F.least(links, F.lit(10)) * 10
    if path is not None:
        p = p - F.when(path.rlike(r"^/(?:|about|contact|pricing|products?)/?$"), 800).otherwise(0)
    return p


def next_batch(frontier: DataFrame, count: int, per_host: int | None = None, host: str = "host", order: list[str] = ["priority", "enqueued_at", "normalized_url"]) -> DataFrame:
    """The ``count`` next URLs, at most ``per_host`` of a host unless there is only one host; the limit is the feature."""
    if per_host is not None:
        ranked = frontier.withColumn("_n", F.row_number().over(W.partitionBy(host).orderBy(*order)))
        several = F.lit(frontier.select(host).distinct().limit(2).count() > 1)
        frontier = ranked.filter(~several | (F.col("_n") <= per_host)).drop("_n")
    return frontier.orderBy(*order).limit(count)


def orphans(counts: DataFrame, homepages: DataFrame, group: list[str], least: int = 1) -> DataFrame:
    """Pages with fewer than ``least`` incoming links that aren't their group's homepage."""
    return counts.filter(F.col("incoming") < least).join(homepages.select(*group, "normalized_url"), [*group, "normalized_url"], "left_anti")


def suspicious_paths(pages: DataFrame, group: list[str], most: int) -> DataFrame:
    """2xx pages: orphans first, then the latest; the first ``most`` per group (the feature)."""
    order = [F.col("orphan").desc(), F.col("lastmod").desc_nulls_last(), "normalized_url"]
    ok = pages.filter("status between 200 and 299")
    return ok.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")
