"""The query layer over page features: latest rows, duplicate groups, link counts, paging, norms.

All functions take DataFrames and group columns; a crawl or a host is just a
group, and none of them brings a group into one task as a whole unless the
result is that group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomaudit.functions import url


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the largest ``order`` per key, by a partial aggregate, not a window."""
    cols = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return best.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in cols)).select(*rows.columns)


def duplicate_groups(rows: DataFrame, group: list[str], value: Column, key: str, max_groups: int | None = None, max_urls: int | None = None) -> DataFrame:
    """(group, value, copies, key): rows whose trimmed lower-case value several keys share, by size then value.

    Empty and null values form no group. ``max_groups`` per group and
    ``max_urls`` per value are report limits; without them all come.
    """
    v = rows.select(*group, key, F.lower(F.trim(value)).alias("value")).filter(F.col("value") != "").distinct()
    sizes = v.groupBy(*group, "value").agg(F.count("*").alias("copies")).filter("copies > 1")
    if max_groups is not None:
        sizes = sizes.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("copies"), "value"))).filter(F.col("_n") <= max_groups).drop("_n")
    out = v.join(sizes, [*group, "value"])
    if max_urls is not None:
        out = out.withColumn("_n", F.row_number().over(W.partitionBy(*group, "value").orderBy(key))).filter(F.col("_n") <= max_urls).drop("_n")
    return out.select(*group, "value", "copies", key)


def homepage(rows: DataFrame, group: list[str]) -> DataFrame:
    """The shallowest page, the first by URL among equals."""
    return rows.groupBy(*group).agg(F.min(F.struct("depth", "normalized_url")).alias("_m")).select(*group, "_m.normalized_url", "_m.depth")


def pages_by_type(rows: DataFrame, group: list[str]) -> DataFrame:
    return rows.groupBy(*group, "page_type").agg(F.countDistinct("normalized_url").alias("pages"), F.min("normalized_url").alias("first_url"))


def page_of(rows: DataFrame, order: str, after: str | None = None, limit: int = 500) -> DataFrame:
    """Keyset paging: the next ``limit`` rows after a key."""
    kept = rows if after is None else rows.filter(F.col(order) > after)
    return kept.orderBy(order).limit(limit)


def incoming_links(pages: DataFrame, links: DataFrame, group: list[str]) -> DataFrame:
    """(group, normalized_url, incoming): followed internal links per page by comparison form, zero where there are none.

    ``links``: group, source, target, nofollow. Every link counts, a page's
    links to itself and repeated ones too; links from or to pages that weren't
    crawled don't.
    """
    form = pages.select(*group, "normalized_url").distinct().withColumn("_form", url.comparison_form(F.col("normalized_url")))
    to = links.filter(~F.coalesce(F.col("nofollow"), F.lit(False))).filter(url.is_internal(F.col("target"), F.col("source")))
    to = to.select(*group, F.col("source").alias("normalized_url"), url.comparison_form(F.col("target")).alias("_form"))
    to = to.join(form.select(*group, "normalized_url"), [*group, "normalized_url"], "left_semi")
    counts = to.groupBy(*group, "_form").agg(F.count("*").alias("incoming"))
    return form.join(counts, [*group, "_form"], "left").select(*group, "normalized_url", F.coalesce("incoming", F.lit(0)).alias("incoming"))


def capped_per_group(rows: DataFrame, group: list[str], order: list[Column | str], cap: int) -> DataFrame:
    """The first ``cap`` rows per group; the cap is the feature (a fair batch)."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= cap).drop("_n")


def norms(rows: DataFrame, group: list[str], value: str, least: int = 8, agreement: float = 0.7) -> DataFrame:
    """(group, median, sigma, n): the norm of each group that has one.

    The norm is the median, sigma the larger of 1.4826 MAD and a tenth of it;
    a group of fewer than ``least`` rows, or of which fewer than ``agreement``
    lie within half of the median, or whose median is 0, has no norm. The
    histogram per value is taken first, so the exact medians come from counts.
    """
    hist = rows.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    med = hist.groupBy(*group).agg(F.expr("percentile(_v, 0.5, _c)").alias("median"), F.sum("_c").alias("n"))
    dev = hist.join(med, group).groupBy(*group).agg(
        F.expr("percentile(abs(_v - median), 0.5, _c)").alias("mad"),
        F.first("median").alias("median"),
        F.first("n").alias("n"),
        (F.sum(F.when(F.abs(F.col("_v") - F.col("median")) <= 0.5 * F.col("median"), F.col("_c")).otherwise(0)) / F.sum("_c")).alias("share"),
    ).filter((F.col("n") >= least) & (F.col("share") >= agreement) & (F.col("median") > 0))
    return dev.select(*group, "median", F.greatest(1.4826 * F.col("mad"), 0.1 * F.col("median")).alias("sigma"), "n")


def norm_outliers(rows: DataFrame, group: list[str], value: str, key: str, band: float = 0.5, floor: float | None = None) -> DataFrame:
    """(group, key, value, median, sigma): rows under ``band`` of their group's median and three sigma below it; ``floor`` leaves out what lies under it, which is another rule's."""
    out = rows.filter(F.col(value).isNotNull()).join(norms(rows, group, value).drop("n"), group)
    far = (F.col(value) < band * F.col("median")) & (F.col(value) < F.col("median") - 3 * F.col("sigma"))
    return out.filter(far if floor is None else far & (F.col(value) >= floor)).select(*group, key, value, "median", "sigma")


def minority_forms(rows: DataFrame, group: list[str], form: str, key: str, least: int = 10, agreement: float = 0.7) -> DataFrame:
    """(group, key, form, usual): rows that break the form which at least ``agreement`` of their group keeps."""
    counts = rows.filter(F.col(form).isNotNull()).groupBy(*group, form).agg(F.count("*").alias("_c"))
    vote = counts.groupBy(*group).agg(F.max_by(form, F.struct("_c", form)).alias("usual"), F.max("_c").alias("_m"), F.sum("_c").alias("_n"))
    vote = vote.filter((F.col("_n") >= least) & (F.col("_m") >= agreement * F.col("_n"))).select(*group, "usual")
    return rows.join(vote, group).filter(F.col(form) != F.col("usual")).select(*group, key, form, "usual")
