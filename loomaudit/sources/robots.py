"""robots.txt and sitemaps as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def robots_rules(files: DataFrame, key: str = "site_key", content: str = "content") -> DataFrame:
    """(key, line, agent, kind, path): allow and disallow rules with the last agent named above them.

    As on the rule side of an audit, stacked agent lines lose all but the last.
    Comments are dropped; null and empty files give no rows.
    """
    lines = files.select(key, F.posexplode(F.split(F.col(content), r"\r\n|\r|\n")).alias("line", "raw"))
    clean = lines.withColumn("raw", F.trim(F.regexp_replace("raw", "#.*$", ""))).filter(F.col("raw").contains(":"))
    parts = clean.select(key, "line", F.lower(F.trim(F.regexp_extract("raw", r"^([^:]*):", 1))).alias("kind"), F.trim(F.regexp_extract("raw", r"^[^:]*:(.*)$", 1)).alias("value"))
    agent = F.last(F.when(F.col("kind") == "user-agent", F.col("value")), ignorenulls=True).over(W.partitionBy(key).orderBy("line"))
    return parts.withColumn("agent", agent).filter(F.col("kind").isin("allow", "disallow") & F.col("agent").isNotNull()).select(
        key, "line", "agent", "kind", F.col("value").alias("path")
    )


def robots_sitemaps(files: DataFrame, key: str = "site_key", content: str = "content") -> DataFrame:
    found = F.regexp_extract_all(F.col(content), F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))
    return files.select(key, F.explode(found).alias("sitemap")).distinct()


def disallowed(urls: DataFrame, rules: DataFrame, path: Column, key: str = "site_key", agent: str = "Googlebot") -> DataFrame:
    """urls with ``disallowed``: the first rule whose path the URL begins with decides, of the agent in exact case, else of *.

    Rules of a site are few lines of one file, so they are one array a site.
    """
    own = rules.filter(F.col("agent").isin(agent, "*") & (F.col("path") != ""))
    per = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "agent", "kind", "path"))).alias("_rules"))
    joined = urls.join(per, key, "left").withColumn("_p", path)
    named = F.exists("_rules", lambda r: r["agent"] == agent)
    mine = F.filter("_rules", lambda r: r["agent"] == F.when(named, F.lit(agent)).otherwise(F.lit("*")))
    first = F.try_element_at(F.filter(mine, lambda r: F.startswith(F.col("_p"), r["path"])), F.lit(1))
    return joined.withColumn("disallowed", F.coalesce(first["kind"] == "disallow", F.lit(False))).drop("_rules", "_p")


def sitemap_urls(files: DataFrame, key: str = "sitemap", content: str = "content") -> DataFrame:
    """(key, pos, loc, lastmod, priority) of the url entries of XML sitemaps; broken entries without a loc are left out."""
    block = F.regexp_extract_all(F.col(content), F.lit(r"(?is)<url>(.*?)</url>"), F.lit(1))
    e = files.select(key, F.posexplode(block).alias("pos", "b"))
    tag = lambda t: F.nullif(F.trim(F.regexp_extract("b", rf"(?is)<{t}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{t}>", 1)), F.lit(""))
    return e.select(key, "pos", F.replace(tag("loc"), F.lit("&amp;"), F.lit("&")).alias("loc"), tag("lastmod").alias("lastmod"), tag("priority").try_cast("double").alias("priority")).filter("loc is not null")


def selected_urls(urls: DataFrame, cap: int, key: str = "sitemap") -> DataFrame:
    """The first ``cap`` distinct locs, in turn from each sitemap; the cap is the feature."""
    ranked = urls.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("pos")))
    once = ranked.groupBy("loc").agg(F.min(F.struct("_n", key)).alias("_m"))
    return once.orderBy("_m").limit(cap).select("loc")
