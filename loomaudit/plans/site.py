"""URL and text functions and the query layer over the site tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomaudit.functions import text, url
from loomaudit.operators import site_query as q
from loomaudit.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def pages(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "page_features")


def latest_pages(spark: SparkSession, root: str) -> DataFrame:
    return q.latest(pages(spark, root), ["crawl_id", "normalized_url"], ["ingested_at", "row_id"])


LATEST = "(SELECT * FROM page_features QUALIFY row_number() OVER (PARTITION BY crawl_id, normalized_url ORDER BY ingested_at DESC, row_id DESC) = 1)"
_HOST = "lower(regexp_extract(normalized_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH = "regexp_extract(normalized_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_SEG = f"list_filter(string_split({_PATH}, '/'), lambda s: s <> '')"


@query(f"""SELECT url AS normalized_url, host, path, CASE WHEN path = '/' THEN 'https://' || host || path ELSE 'https://' || host || regexp_replace(path, '/$', '') END AS comparison,
 len(seg) AS depth, CASE WHEN len(seg) = 0 THEN '/' ELSE '/' || seg[1] END AS prefix
 FROM (SELECT DISTINCT normalized_url AS url, {_HOST} AS host, CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END AS path, {_SEG} AS seg FROM page_features WHERE normalized_url LIKE 'https://%')""")
def url_parts(spark: SparkSession, root: str) -> DataFrame:
    u = F.col("normalized_url")
    d = pages(spark, root).filter(u.startswith("https://")).select(u).distinct()
    return d.select(u, url.host(u).alias("host"), url.path(u).alias("path"), url.comparison_form(u).alias("comparison"), url.depth(u).cast("long").alias("depth"), url.prefix(u).alias("prefix"))


@query(f"""SELECT {_HOST} AS host, pattern, count(*) AS pages FROM (
 SELECT DISTINCT normalized_url, '/' || array_to_string(list_transform({_SEG}, lambda s: CASE
   WHEN regexp_matches(s, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$|^(?:19|20)\\d{{2}}$') THEN '{{date}}'
   WHEN regexp_matches(s, '^\\d+$|^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$|^[0-9a-f]{{16,}}$') THEN '{{id}}'
   WHEN regexp_matches(s, '^v\\d+(?:\\.\\d+)*$') THEN '{{version}}'
   WHEN regexp_matches(s, '^[^-]+(?:-[^-]+){{2,}}$') THEN '{{slug}}' ELSE s END), '/') AS pattern FROM page_features WHERE normalized_url IS NOT NULL) GROUP BY ALL""")
def url_patterns(spark: SparkSession, root: str) -> DataFrame:
    u = F.col("normalized_url")
    d = pages(spark, root).filter(u.isNotNull()).select(u).distinct()
    return d.groupBy(url.host(u).alias("host"), url.pattern(u).alias("pattern")).agg(F.count("*").alias("pages"))


@query(f"""SELECT row_id, CASE WHEN host = '' THEN 'unknown' ELSE host END AS host_key, coalesce(canonical_host = host, false) AS internal FROM (
 SELECT row_id, {_HOST} AS host, lower(regexp_extract(canonical, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS canonical_host FROM page_features)""")
def url_internal_canonical(spark: SparkSession, root: str) -> DataFrame:
    u = F.col("normalized_url")
    return pages(spark, root).select("row_id", url.host_key(u).alias("host_key"), F.coalesce(url.is_internal(F.col("canonical"), u), F.lit(False)).alias("internal"))


@query(f"""SELECT {_HOST} AS host, {_SEG}[1] AS section, count(DISTINCT normalized_url) AS pages FROM page_features WHERE len({_SEG}) > 0 GROUP BY ALL""")
def url_group_by_prefix(spark: SparkSession, root: str) -> DataFrame:
    u = F.col("normalized_url")
    d = pages(spark, root).filter(url.depth(u) > 0)
    return d.groupBy(url.host(u).alias("host"), F.element_at(url.segments(u), 1).alias("section")).agg(F.countDistinct("normalized_url").alias("pages"))


# rules over URLs that need no markup, as one narrow pass
_URL_RULES = f"""SELECT DISTINCT normalized_url,
 CASE WHEN contains(p, '_') THEN 'warn' WHEN contains(p, '-') THEN 'pass' ELSE 'info' END AS hyphens,
 CASE WHEN length(normalized_url) > 100 THEN 'warn' WHEN length(normalized_url) > 75 THEN 'info' ELSE 'pass' END AS length,
 CASE WHEN regexp_matches(p, '[A-Z]') THEN 'warn' ELSE 'pass' END AS lowercase,
 CASE WHEN len(seg) > 4 THEN 'info' ELSE 'pass' END AS depth,
 CASE WHEN n = 0 THEN 'pass' WHEN n > 3 THEN 'warn' ELSE 'info' END AS parameters
 FROM (SELECT normalized_url, len(list_filter(string_split(regexp_extract(normalized_url, '\\?([^#]*)', 1), '&'), lambda x: x <> '')) AS n, {_PATH} AS p, {_SEG} AS seg FROM page_features WHERE normalized_url IS NOT NULL)"""


@query(_URL_RULES)
def rule_url(spark: SparkSession, root: str) -> DataFrame:
    u = F.col("normalized_url")
    p = url.path(u)
    when = lambda c, a, b="pass": F.when(c, F.lit(a)).otherwise(F.lit(b))
    n = F.size(F.filter(F.split(url.query(u), "&"), lambda x: x != ""))
    d = pages(spark, root).filter(u.isNotNull()).select(u).distinct()
    return d.select(
        u,
        F.when(p.contains("_"), F.lit("warn")).when(p.contains("-"), F.lit("pass")).otherwise(F.lit("info")).alias("hyphens"),
        F.when(F.length(u) > 100, F.lit("warn")).when(F.length(u) > 75, F.lit("info")).otherwise(F.lit("pass")).alias("length"),
        when(p.rlike("[A-Z]"), "warn").alias("lowercase"),
        when(url.depth(u) > 4, "info").alias("depth"),
        F.when(n == 0, F.lit("pass")).when(n > 3, F.lit("warn")).otherwise(F.lit("info")).alias("parameters"),
    )


@query(f"""SELECT row_id, crawl_id, normalized_url, CASE WHEN coalesce(title, '') = '' THEN 'fail' WHEN length(title) < 30 OR length(title) > 75 THEN 'warn' ELSE 'pass' END AS meta_title,
 CASE WHEN coalesce(description, '') = '' THEN 'fail' WHEN length(description) < 120 OR length(description) > 160 THEN 'warn' ELSE 'pass' END AS meta_description,
 CASE WHEN word_count < 300 THEN 'warn' WHEN word_count < 500 THEN 'info' ELSE 'pass' END AS word_count_rule,
 CASE WHEN canonical IS NULL THEN 'warn' WHEN NOT starts_with(canonical, 'http') THEN 'fail' WHEN canonical <> normalized_url THEN 'info' ELSE 'pass' END AS canonical_rule,
 CASE WHEN len(indexable_reasons) > 0 THEN 'info' ELSE 'pass' END AS indexability,
 CASE WHEN len(rich_result_types) > 0 AND len(indexable_reasons) > 0 THEN 'fail' ELSE 'pass' END AS schema_noindex
 FROM {LATEST}""")
def rule_page_core(spark: SparkSession, root: str) -> DataFrame:
    c = F.col
    d = latest_pages(spark, root)
    return d.select(
        "row_id", "crawl_id", "normalized_url",
        F.when(F.coalesce("title", F.lit("")) == "", F.lit("fail")).when((F.length("title") < 30) | (F.length("title") > 75), F.lit("warn")).otherwise(F.lit("pass")).alias("meta_title"),
        F.when(F.coalesce("description", F.lit("")) == "", F.lit("fail")).when((F.length("description") < 120) | (F.length("description") > 160), F.lit("warn")).otherwise(F.lit("pass")).alias("meta_description"),
        F.when(c("word_count") < 300, F.lit("warn")).when(c("word_count") < 500, F.lit("info")).otherwise(F.lit("pass")).alias("word_count_rule"),
        F.when(c("canonical").isNull(), F.lit("warn")).when(~c("canonical").startswith("http"), F.lit("fail")).when(c("canonical") != c("normalized_url"), F.lit("info")).otherwise(F.lit("pass")).alias("canonical_rule"),
        F.when(F.size("indexable_reasons") > 0, F.lit("info")).otherwise(F.lit("pass")).alias("indexability"),
        F.when((F.size("rich_result_types") > 0) & (F.size("indexable_reasons") > 0), F.lit("fail")).otherwise(F.lit("pass")).alias("schema_noindex"),
    )


def _duplicates(column: str) -> str:
    return f"""WITH v AS (SELECT DISTINCT crawl_id, normalized_url, lower(trim({column})) AS value FROM page_features WHERE trim({column}) <> '')
SELECT crawl_id, value, copies, normalized_url FROM v JOIN (SELECT crawl_id, value, count(*) AS copies FROM v GROUP BY ALL HAVING count(*) > 1) USING (crawl_id, value)"""


@query(_duplicates("title"))
def duplicate_title(spark: SparkSession, root: str) -> DataFrame:
    return q.duplicate_groups(pages(spark, root), ["crawl_id"], F.col("title"), "normalized_url")


@query(_duplicates("description"))
def duplicate_description(spark: SparkSession, root: str) -> DataFrame:
    return q.duplicate_groups(pages(spark, root), ["crawl_id"], F.col("description"), "normalized_url")


@query("""SELECT crawl_id, CAST(sum(pages) AS BIGINT) AS pages, count(*) AS contents, count(*) FILTER (pages > 1) AS duplicate_groups FROM (
 SELECT crawl_id, lower(trim(content_hash)) AS h, count(DISTINCT normalized_url) AS pages FROM page_features WHERE trim(content_hash) <> '' GROUP BY ALL) GROUP BY crawl_id""")
def duplicate_content(spark: SparkSession, root: str) -> DataFrame:
    """Per crawl: pages with content, different contents, and contents that several pages have."""
    v = pages(spark, root).filter("trim(content_hash) <> ''").groupBy("crawl_id", F.lower(F.trim("content_hash")).alias("h")).agg(F.countDistinct("normalized_url").alias("n"))
    return v.groupBy("crawl_id").agg(F.sum("n").alias("pages"), F.count("*").alias("contents"), F.count_if(F.col("n") > 1).alias("duplicate_groups"))


@query(f"""WITH d AS ({_duplicates("template_fp")}), g AS (SELECT *, dense_rank() OVER (PARTITION BY crawl_id ORDER BY copies DESC, value) AS gr,
 row_number() OVER (PARTITION BY crawl_id, value ORDER BY normalized_url) AS ur FROM d) SELECT crawl_id, value, copies, normalized_url FROM g WHERE gr <= 3 AND ur <= 5""")
def template_clusters(spark: SparkSession, root: str) -> DataFrame:
    return q.duplicate_groups(pages(spark, root), ["crawl_id"], F.col("template_fp"), "normalized_url", max_groups=3, max_urls=5)


@query("SELECT crawl_id, arg_min(normalized_url, (depth, normalized_url)) AS normalized_url, min(depth) AS depth FROM page_features GROUP BY crawl_id")
def homepage_feature(spark: SparkSession, root: str) -> DataFrame:
    return q.homepage(pages(spark, root), ["crawl_id"])


@query("SELECT crawl_id, page_type, count(DISTINCT normalized_url) AS pages, min(normalized_url) AS first_url FROM page_features GROUP BY ALL")
def pages_by_type(spark: SparkSession, root: str) -> DataFrame:
    return q.pages_by_type(pages(spark, root), ["crawl_id"])


@query("SELECT row_id, crawl_id, normalized_url FROM page_features WHERE row_id > 100 ORDER BY row_id LIMIT 200")
def keyset_page(spark: SparkSession, root: str) -> DataFrame:
    return q.page_of(pages(spark, root).select("row_id", "crawl_id", "normalized_url"), "row_id", after=100, limit=200)


@query(f"SELECT crawl_id, count(*) AS pages, CAST(coalesce(sum(transfer_bytes), 0) AS BIGINT) AS transfer_bytes, CAST(coalesce(sum(secret_hits), 0) AS BIGINT) AS secret_hits FROM {LATEST} GROUP BY crawl_id")
def feature_sums(spark: SparkSession, root: str) -> DataFrame:
    return latest_pages(spark, root).groupBy("crawl_id").agg(
        F.count("*").alias("pages"), F.coalesce(F.sum("transfer_bytes"), F.lit(0)).alias("transfer_bytes"), F.coalesce(F.sum("secret_hits"), F.lit(0)).cast("long").alias("secret_hits")
    )


@query(f"""WITH c AS (SELECT crawl_id, min(started_at) AS started_at FROM crawls GROUP BY 1), r AS (SELECT f.normalized_url, f.crawl_id, f.row_id, c.started_at FROM {LATEST} f JOIN c USING (crawl_id) WHERE f.status BETWEEN 200 AND 299)
SELECT normalized_url, crawl_id, row_id FROM r QUALIFY row_number() OVER (PARTITION BY normalized_url ORDER BY started_at DESC, crawl_id DESC) = 1""")
def cached_page(spark: SparkSession, root: str) -> DataFrame:
    """The latest usable record of each page over all crawls."""
    crawls = table(spark, root, "crawls").groupBy("crawl_id").agg(F.min("started_at").alias("started_at"))
    good = latest_pages(spark, root).filter("status between 200 and 299").select("normalized_url", "crawl_id", "row_id").join(crawls, "crawl_id")
    return q.latest(good, ["normalized_url"], ["started_at", "crawl_id"]).select("normalized_url", "crawl_id", "row_id")


@query("""WITH want AS (SELECT DISTINCT crawl_id, canonical FROM page_features WHERE canonical IS NOT NULL), have AS (SELECT DISTINCT crawl_id, normalized_url FROM page_features)
SELECT crawl_id, count(*) AS canonicals, count(*) FILTER (normalized_url IS NULL) AS not_crawled FROM (SELECT w.*, h.normalized_url FROM want w LEFT JOIN have h ON h.crawl_id = w.crawl_id AND h.normalized_url = w.canonical) GROUP BY 1""")
def canonical_targets(spark: SparkSession, root: str) -> DataFrame:
    """Per crawl: different canonical addresses, and those that weren't crawled."""
    p = pages(spark, root)
    want = p.filter("canonical is not null").select("crawl_id", "canonical").distinct()
    have = p.filter("normalized_url is not null").select("crawl_id", F.col("normalized_url").alias("canonical"), F.lit(True).alias("crawled")).distinct()
    return want.join(have, ["crawl_id", "canonical"], "left").groupBy("crawl_id").agg(F.count("*").alias("canonicals"), F.count_if(F.col("crawled").isNull()).alias("not_crawled"))


@query("""SELECT DISTINCT f.crawl_id, f.normalized_url FROM page_features f SEMI JOIN (SELECT snapshot_crawl_id AS crawl_id, normalized_url FROM site_pages WHERE state = 'active') s
 ON f.crawl_id = s.crawl_id AND f.normalized_url = s.normalized_url WHERE f.meta_noindex""")
def noindex_in_registry(spark: SparkSession, root: str) -> DataFrame:
    known = table(spark, root, "site_pages").filter("state = 'active'").select(F.col("snapshot_crawl_id").alias("crawl_id"), "normalized_url")
    return pages(spark, root).filter("meta_noindex").select("crawl_id", "normalized_url").distinct().join(known, ["crawl_id", "normalized_url"], "left_semi")


_FORM = "regexp_replace(regexp_replace({}, '[?#].*$', ''), '([^/])/$', '\\1')"


@query(f"""WITH l AS (SELECT crawl_id, {_FORM.format("canonical")} AS form FROM page_features WHERE canonical IS NOT NULL AND normalized_url IS NOT NULL
 AND lower(regexp_extract(canonical, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) = {_HOST}),
f AS (SELECT DISTINCT crawl_id, normalized_url, {_FORM.format("normalized_url")} AS form FROM page_features), c AS (SELECT crawl_id, form, count(*) AS incoming FROM l GROUP BY ALL)
SELECT f.crawl_id, f.normalized_url, coalesce(c.incoming, 0) AS incoming FROM f LEFT JOIN c USING (crawl_id, form)""")
def incoming_links(spark: SparkSession, root: str) -> DataFrame:
    """Canonical references as the links that the tables have; each row's counts, those of a page to itself too."""
    p = pages(spark, root)
    links = p.filter("canonical is not null").select("crawl_id", F.col("normalized_url").alias("source"), F.col("canonical").alias("target"), F.lit(False).alias("nofollow"))
    return q.incoming_links(p, links, ["crawl_id"])


@query(f"""WITH p AS (SELECT crawl_id, count(*) AS pages FROM {LATEST} GROUP BY 1),
d AS (SELECT crawl_id, lower(trim(page_type)) AS t, word_count FROM {LATEST} WHERE status BETWEEN 200 AND 299 AND word_count >= 0 AND lower(trim(page_type)) NOT IN ('', 'unknown')),
m AS (SELECT crawl_id, t, median(word_count) AS median, count(*) AS n FROM d GROUP BY ALL),
a AS (SELECT crawl_id, t, median(abs(word_count - median)) AS mad, any_value(median) AS median, any_value(n) AS n, avg(CASE WHEN abs(word_count - median) <= 0.5 * median THEN 1.0 ELSE 0.0 END) AS share FROM d JOIN m USING (crawl_id, t) GROUP BY ALL),
j AS (SELECT *, greatest(1.4826 * mad, 0.1 * median) AS sigma FROM a WHERE n >= 8 AND share >= 0.7 AND median > 0),
x AS (SELECT crawl_id, count(*) AS judged, count(*) FILTER (word_count >= 300 AND word_count < 0.5 * median AND word_count < median - 3 * sigma) AS outliers FROM d JOIN j USING (crawl_id, t) GROUP BY 1)
SELECT crawl_id, pages, coalesce(judged, 0) AS judged, coalesce(outliers, 0) AS outliers,
 CASE WHEN pages < 10 OR judged IS NULL THEN 'skipped' WHEN outliers = 0 THEN 'pass' WHEN outliers >= 0.2 * judged THEN 'fail' ELSE 'warn' END AS status FROM p LEFT JOIN x USING (crawl_id)""")
def thin_vs_norm(spark: SparkSession, root: str) -> DataFrame:
    """Per crawl, whether pages are thin against the norm of their type: sites of ten pages or more, typed 2xx pages, above the floor that the word-count rule has."""
    p = latest_pages(spark, root)
    t = F.lower(F.trim("page_type"))
    d = p.filter((F.col("status") >= 200) & (F.col("status") < 300) & (F.col("word_count") >= 0) & ~t.isin("", "unknown")).select("crawl_id", t.alias("t"), "normalized_url", "word_count")
    judged = q.norms(d, ["crawl_id", "t"], "word_count").groupBy("crawl_id").agg(F.sum("n").alias("judged"))
    thin = q.norm_outliers(d, ["crawl_id", "t"], "word_count", "normalized_url", floor=300).groupBy("crawl_id").agg(F.count("*").alias("outliers"))
    out = p.groupBy("crawl_id").agg(F.count("*").alias("pages")).join(judged, "crawl_id", "left").join(thin, "crawl_id", "left")
    n, x = F.coalesce("judged", F.lit(0)), F.coalesce("outliers", F.lit(0))
    status = F.when((F.col("pages") < 10) | F.col("judged").isNull(), F.lit("skipped")).when(x == 0, F.lit("pass")).when(x >= 0.2 * n, F.lit("fail")).otherwise(F.lit("warn"))
    return out.select("crawl_id", "pages", n.alias("judged"), x.alias("outliers"), status.alias("status"))


@query(f"""WITH d AS (SELECT crawl_id, normalized_url, CASE WHEN ends_with(normalized_url, '/') THEN 'slash' WHEN ends_with(normalized_url, '.html') THEN 'html' ELSE 'bare' END AS form FROM {LATEST}),
c AS (SELECT crawl_id, form, count(*) AS c FROM d GROUP BY ALL), v AS (SELECT crawl_id, arg_max(form, (c, form)) AS usual, max(c) AS m, sum(c) AS n FROM c GROUP BY 1)
SELECT crawl_id, normalized_url, form, usual FROM d JOIN v USING (crawl_id) WHERE n >= 10 AND m >= 0.7 * n AND form <> usual""")
def slug_convention(spark: SparkSession, root: str) -> DataFrame:
    u = F.col("normalized_url")
    form = F.when(u.endswith("/"), F.lit("slash")).when(u.endswith(".html"), F.lit("html")).otherwise(F.lit("bare"))
    return q.minority_forms(latest_pages(spark, root).select("crawl_id", u, form.alias("form")), ["crawl_id"], "form", "normalized_url")


@query(f"""WITH t AS (SELECT crawl_id, normalized_url, page_type, unnest(schema_types) AS schema_type FROM {LATEST}), n AS (SELECT crawl_id, page_type, count(*) AS pages FROM {LATEST} GROUP BY ALL)
SELECT crawl_id, page_type, schema_type, count(DISTINCT normalized_url) AS having_it, any_value(pages) AS pages FROM t JOIN n USING (crawl_id, page_type) GROUP BY ALL HAVING any_value(pages) >= 8 AND count(DISTINCT normalized_url) >= 0.7 * any_value(pages)""")
def schema_coverage(spark: SparkSession, root: str) -> DataFrame:
    p = latest_pages(spark, root)
    n = p.groupBy("crawl_id", "page_type").agg(F.count("*").alias("pages"))
    t = p.select("crawl_id", "page_type", "normalized_url", F.explode("schema_types").alias("schema_type"))
    have = t.groupBy("crawl_id", "page_type", "schema_type").agg(F.countDistinct("normalized_url").alias("having_it"))
    return have.join(n, ["crawl_id", "page_type"]).filter((F.col("pages") >= 8) & (F.col("having_it") >= 0.7 * F.col("pages")))


@query("""SELECT phone_key, count(DISTINCT crawl_id) AS crawls, count(DISTINCT phone) AS spellings FROM (SELECT crawl_id, phone, right(regexp_replace(phone, '[^0-9]', '', 'g'), 9) AS phone_key
 FROM (SELECT crawl_id, unnest(nap_phones) AS phone FROM page_features)) WHERE length(phone_key) >= 7 GROUP BY 1""")
def nap_phone_keys(spark: SparkSession, root: str) -> DataFrame:
    p = pages(spark, root).select("crawl_id", F.explode("nap_phones").alias("phone"))
    p = p.withColumn("phone_key", F.right(F.regexp_replace("phone", "[^0-9]", ""), F.lit(9))).filter("length(phone_key) >= 7")
    return p.groupBy("phone_key").agg(F.countDistinct("crawl_id").alias("crawls"), F.countDistinct("phone").alias("spellings"))


@query("""SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS words, strlen(text) AS bytes, CAST(ceil(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) / 200) AS BIGINT) AS minutes,
 len(regexp_extract_all(text, 'Ã.|â€.|Â.|�')) AS mojibake FROM documents""")
def text_metrics(spark: SparkSession, root: str) -> DataFrame:
    t = F.col("text")
    return table(spark, root, "documents").select(
        "doc_id", text.word_count(t).cast("long").alias("words"), text.byte_length(t).cast("long").alias("bytes"), text.reading_time(t).cast("long").alias("minutes"), text.mojibake_count(t).cast("long").alias("mojibake")
    )


@query("SELECT doc_id, sha256(text) AS content_hash, CASE WHEN trim(text) <> '' THEN sha256(lower(trim(text))) END AS normalized_hash FROM documents WHERE text IS NOT NULL")
def text_hashes(spark: SparkSession, root: str) -> DataFrame:
    t = F.col("text")
    return table(spark, root, "documents").filter(t.isNotNull()).select("doc_id", text.content_hash(t).alias("content_hash"), text.normalized_hash(t).alias("normalized_hash"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents), t AS (SELECT doc_id, count(*) AS total FROM w GROUP BY 1), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, word, n, round(100.0 * n / total, 4) AS density FROM c JOIN t USING (doc_id) WHERE total >= 100 AND n > 5 AND 100.0 * n / total > 3""")
def keyword_density(spark: SparkSession, root: str) -> DataFrame:
    w = table(spark, root, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    c = w.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("doc_id"))
    c = c.withColumn("total", total)
    return c.filter("total >= 100 and n > 5 and 100.0 * n / total > 3").select("doc_id", "word", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).cast("double").alias("density"))


@query("""WITH x AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: greatest(1, len(regexp_extract_all(regexp_replace(lower(w), '([a-z]{2})e$', '\\1'), '[aeiouy]+')))) AS syl, len(regexp_extract_all(text, '[.!?]+')) AS s FROM documents)
SELECT doc_id, round(206.835 - 1.015 * len(syl) / s - 84.6 * list_sum(syl) / len(syl), 4) AS flesch FROM x WHERE s >= 5 AND len(syl) >= 100""")
def reading_ease(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.round(text.flesch(F.col("text")), 4).alias("flesch")).filter("flesch is not null")


@query("""WITH t AS (SELECT row_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 1)) AS a, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(description, '')), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 1)) AS b FROM page_features)
SELECT row_id, round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END, 6) AS similarity FROM t""")
def title_description_jaccard(spark: SparkSession, root: str) -> DataFrame:
    return pages(spark, root).select("row_id", F.round(text.jaccard(text.tokens(F.col("title")), text.tokens(F.col("description"))), 6).alias("similarity"))


@query("""WITH t AS (SELECT DISTINCT title FROM page_features WHERE title <> ''), c AS (SELECT title, unnest(string_split(title, '')) AS ch FROM t), n AS (SELECT title, ch, count(*) AS k FROM c GROUP BY ALL)
SELECT title, round(-sum(k / length(title) * log2(k / length(title))), 6) AS bits FROM n GROUP BY title""")
def title_entropy(spark: SparkSession, root: str) -> DataFrame:
    t = pages(spark, root).filter("title <> ''").select("title").distinct()
    return t.select("title", F.round(text.entropy(F.col("title")), 6).alias("bits"))


@query("""SELECT a.crawl_id, a.normalized_url, CASE WHEN b.normalized_url IS NULL THEN 'new' WHEN a.content_hash = b.content_hash THEN 'unchanged' WHEN a.content_hash IS NOT NULL AND b.content_hash IS NOT NULL THEN 'changed' WHEN b.content_hash IS NULL THEN 'new' ELSE 'unknown' END AS change
FROM (SELECT l.*, s.prev FROM %s l JOIN (SELECT crawl_id, lag(crawl_id) OVER (PARTITION BY base_url ORDER BY started_at, crawl_id) AS prev FROM (SELECT DISTINCT crawl_id, base_url, started_at FROM crawls WHERE status = 'completed')) s USING (crawl_id) WHERE s.prev IS NOT NULL) a
LEFT JOIN %s b ON b.crawl_id = a.prev AND b.normalized_url = a.normalized_url""" % (LATEST, LATEST))
def change_detection(spark: SparkSession, root: str) -> DataFrame:
    from loomaudit.operators.snapshots import consecutive

    p = latest_pages(spark, root).select("crawl_id", "normalized_url", "content_hash")
    steps = consecutive(table(spark, root, "crawls")).filter("next_crawl_id is not null").select(F.col("crawl_id").alias("prev"), F.col("next_crawl_id").alias("crawl_id"))
    old = p.join(steps.withColumnsRenamed({"crawl_id": "later", "prev": "crawl_id"}), "crawl_id").select(F.col("later").alias("crawl_id"), "normalized_url", F.col("content_hash").alias("was"))
    now = p.join(steps.select("crawl_id"), "crawl_id")
    none = F.lit(None).cast("string")
    return now.join(old, ["crawl_id", "normalized_url"], "left").select("crawl_id", "normalized_url", text.change_status(none, none, none, none, F.col("was"), F.col("content_hash")).alias("change"))
