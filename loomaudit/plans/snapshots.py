"""Queries over the snapshots operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomaudit.operators.snapshots import snapshot_changes
from loomaudit.sources.tables import table

PAGE_VALUES = ["status", "title", "description", "content_hash", "canonical"]
SITE_VALUES = ["last_status", "state"]


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    crawls = table(spark, root, "crawls")
    pages = snapshot_changes(
        table(spark, root, "page_features"), crawls, "crawl_id", "normalized_url", PAGE_VALUES, ["ingested_at", "row_id"]
    )
    sites = snapshot_changes(
        table(spark, root, "site_pages"), crawls, "snapshot_crawl_id", "normalized_url", SITE_VALUES, ["last_seen_at"]
    )
    return pages.select(F.lit("page_features").alias("table_name"), "crawl_id", "normalized_url", "change").unionByName(
        sites.select(F.lit("site_pages").alias("table_name"), "crawl_id", "normalized_url", "change")
    )


def p4_change_counts(spark: SparkSession, root: str) -> DataFrame:
    return p4_found(spark, root).groupBy("table_name", "crawl_id", "change").agg(F.count("*").alias("pages"))


def _side(name: str, source: str, crawl: str, values: list[str], newest: str) -> str:
    same = " AND ".join(f"n.{c} IS NOT DISTINCT FROM o.{c}" for c in values)
    return f"""
SELECT '{name}' AS table_name, coalesce(n.crawl, o.next_crawl) AS crawl_id, coalesce(n.url, o.url) AS normalized_url,
       CASE WHEN o.url IS NULL THEN 'added' WHEN n.url IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT * FROM {source}_rows WHERE seq > 1) n
FULL JOIN (SELECT * FROM {source}_rows WHERE next_crawl IS NOT NULL) o ON n.crawl = o.next_crawl AND n.url = o.url
WHERE n.url IS NULL OR o.url IS NULL OR NOT ({same})"""


def _rows(source: str, crawl: str, values: list[str], newest: str) -> str:
    return f"""{source}_rows AS (
  SELECT t.{crawl} AS crawl, t.normalized_url AS url, {", ".join("t." + c for c in values)}, s.seq, s.next_crawl
  FROM {source} t JOIN snaps s ON t.{crawl} = s.crawl_id WHERE t.normalized_url IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY t.{crawl}, t.normalized_url ORDER BY {newest}) = 1)"""


FOUND_SQL = f"""
WITH snaps AS (
  SELECT base_url, crawl_id, row_number() OVER w AS seq, lead(crawl_id) OVER w AS next_crawl
  FROM (SELECT DISTINCT base_url, crawl_id, started_at FROM crawls WHERE status = 'completed')
  WINDOW w AS (PARTITION BY base_url ORDER BY started_at, crawl_id)),
{_rows("page_features", "crawl_id", PAGE_VALUES, "t.ingested_at DESC, t.row_id DESC")},
{_rows("site_pages", "snapshot_crawl_id", SITE_VALUES, "t.last_seen_at DESC")}
{_side("page_features", "page_features", "crawl_id", PAGE_VALUES, "")}
UNION ALL
{_side("site_pages", "site_pages", "snapshot_crawl_id", SITE_VALUES, "")}
"""

QUERIES = {"p4_found": p4_found, "p4_change_counts": p4_change_counts}
SQL = {
    "p4_found": FOUND_SQL,
    "p4_change_counts": f"SELECT table_name, crawl_id, change, count(*) AS pages FROM ({FOUND_SQL}) GROUP BY ALL",
}
