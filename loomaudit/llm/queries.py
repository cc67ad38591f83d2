"""Registered queries of this subpackage, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomaudit.llm import cutoff, digests, duplicates, garbling, leakage, packing, prose, residue, wrappers
from loomaudit.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    content, pages = table(spark, root, "content_store"), table(spark, root, "page_features")
    model = residue.train(content, pages)
    texts = residue.residue_texts(content, pages, model).withColumn("table_name", F.lit("content_store"))
    titles = residue.residue_titles(pages, model).withColumn("table_name", F.lit("page_features"))
    return texts.unionByName(titles).select("table_name", "record_key")


FETCH_KEYS = ["site_key", "fetcher_id", "status", "day"]


def p2_fetch_percentiles(spark: SparkSession, root: str) -> DataFrame:
    rows = digests.measured(table(spark, root, "page_fetches"))
    return digests.percentiles_of(rows, FETCH_KEYS, ["load_time_ms", "size_bytes"], "event_id")


def p2_fetch_counts(spark: SparkSession, root: str) -> DataFrame:
    """The part of the result that SQL can say: groups and counts."""
    return p2_fetch_percentiles(spark, root).select("site_key", "fetcher_id", "status", F.col("day").cast("string").alias("day"), "metric", F.col("n").cast("long").alias("n"))


def p2_fetch_spans(spark: SparkSession, root: str) -> DataFrame:
    rows = digests.measured(table(spark, root, "page_fetches"))
    return digests.spans_of(rows, FETCH_KEYS, ["load_time_ms", "size_bytes"], "event_id")


def _transfers(spark: SparkSession, root: str) -> DataFrame:
    """Rows of pages whose crawl isn't known have no site and day, and are groups of their own."""
    crawls = table(spark, root, "crawls").groupBy("crawl_id").agg(F.min("site_key").alias("site_key"), F.to_date(F.min("started_at")).alias("day"))
    pages = table(spark, root, "page_features").select(
        "crawl_id", "status", "row_id", F.when(F.col("transfer_bytes") > 0, F.col("transfer_bytes")).alias("transfer_bytes")
    )
    return pages.join(crawls, "crawl_id", "left").drop("crawl_id")


def p2_transfer_percentiles(spark: SparkSession, root: str) -> DataFrame:
    return digests.percentiles_of(_transfers(spark, root), ["site_key", "status", "day"], ["transfer_bytes"], "row_id")


def p2_transfer_spans(spark: SparkSession, root: str) -> DataFrame:
    return digests.spans_of(_transfers(spark, root), ["site_key", "status", "day"], ["transfer_bytes"], "row_id")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return wrappers.body_lines(table(spark, root, "content_store"), table(spark, root, "page_features"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return prose.spam_pages(table(spark, root, "content_store"), table(spark, root, "page_features"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return duplicates.copies(table(spark, root, "page_features"))


def p6_sets(spark: SparkSession, root: str) -> DataFrame:
    return duplicates.representatives(table(spark, root, "page_features"))


def _garbled(spark: SparkSession, root: str) -> DataFrame:
    content, pages = table(spark, root, "content_store"), table(spark, root, "page_features")
    weights = garbling.train((content, "content"), (pages, "title"))
    texts = garbling.restored(content, "hash", "content", weights)
    titles = garbling.restored_titles(pages, "row_id", "title", weights)
    return texts.withColumn("table_name", F.lit("content_store")).unionByName(titles.withColumn("table_name", F.lit("page_features")))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return _garbled(spark, root).select("table_name", "record_key")


def p7_restored(spark: SparkSession, root: str) -> DataFrame:
    return _garbled(spark, root).filter("chains <> ''").select("table_name", "record_key", "chains", "restored", "whole")


def p8_packed(spark: SparkSession, root: str) -> DataFrame:
    return packing.packed(table(spark, root, "documents"), table(spark, root, "pack_limits"))


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    return packing.fill(p8_packed(spark, root))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaks(table(spark, root, "documents"), table(spark, root, "eval_items")).select("doc_id", "item_id")


def p9_evidence(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return cutoff.cut_texts(table(spark, root, "documents"))


def p10_rates(spark: SparkSession, root: str) -> DataFrame:
    return cutoff.cut_rates(table(spark, root, "documents"))


_P6 = r"""
WITH parts AS (
  SELECT row_id, crawl_id, regexp_replace(lower(upper(coalesce(title, ''))), '[^\p{L}\p{N}]+', '', 'g') AS t,
         regexp_replace(lower(upper(coalesce(description, ''))), '[^\p{L}\p{N}]+', '', 'g') AS d,
         list_filter(list_transform(regexp_split_to_array(coalesce(description, ''), '[;|·\n\r]+'), lambda p: trim(p)), lambda p: p <> '') AS f
  FROM page_features),
keyed AS (
  SELECT row_id, crawl_id, t,
         CASE WHEN len(f) >= 2 AND len(list_filter(f, lambda p: NOT regexp_full_match(p, '(?s)[^:]*[\p{L}\p{N}][^:]*:.*[\p{L}\p{N}].*'))) = 0
              THEN 'F' || array_to_string(list_sort(list_transform(f, lambda p: regexp_replace(lower(upper(p)), '[^\p{L}\p{N}]+', '', 'g'))), ';') ELSE d END AS k, d
  FROM parts WHERE t <> '' OR d <> ''),
linked AS (SELECT row_id, crawl_id, t, max(k) FILTER (WHERE k LIKE 'F%' AND k <> d) OVER (PARTITION BY crawl_id, t, d) AS fk, d FROM keyed),
sets AS (SELECT row_id, crawl_id, min(row_id) OVER w AS first_row_id, count(*) OVER w AS copies FROM linked
         WINDOW w AS (PARTITION BY crawl_id, t, coalesce(fk, d)))
"""

QUERIES = {
    "p1_found": p1_found,
    "p2_fetch_percentiles": p2_fetch_percentiles,
    "p2_fetch_counts": p2_fetch_counts,
    "p2_fetch_spans": p2_fetch_spans,
    "p2_transfer_percentiles": p2_transfer_percentiles,
    "p2_transfer_spans": p2_transfer_spans,
    "p3_found": p3_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_sets": p6_sets,
    "p7_found": p7_found,
    "p7_restored": p7_restored,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_evidence": p9_evidence,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}
_MEASURED = """
SELECT site_key, fetcher_id, status, CAST(event_ts AT TIME ZONE 'UTC' AS DATE) AS day, metric, value FROM (
  SELECT *, unnest(['load_time_ms', 'size_bytes']) AS metric, unnest([CAST(load_time_ms AS BIGINT), size_bytes]) AS value
  FROM (SELECT * FROM page_fetches QUALIFY row_number() OVER (PARTITION BY event_id) = 1)) WHERE value > 0"""

SQL = {
    "p2_fetch_counts": f"SELECT site_key, fetcher_id, status, CAST(day AS VARCHAR) AS day, metric, count(*) AS n FROM ({_MEASURED}) GROUP BY ALL",
    "p6_found": _P6 + "SELECT first_row_id, row_id FROM sets WHERE row_id <> first_row_id",
    "p6_sets": _P6 + "SELECT DISTINCT crawl_id, first_row_id, copies FROM sets WHERE copies > 1",
}
