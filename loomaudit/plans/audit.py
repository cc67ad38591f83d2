"""Findings, scores, rollups, detection and the frontier over the site tables, and general forms over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomaudit.functions import url
from loomaudit.operators import checks as c
from loomaudit.operators import detection as d
from loomaudit.operators import site_query as q
from loomaudit.operators.snapshots import consecutive
from loomaudit.plans import site
from loomaudit.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}
RULES = ["meta_title", "meta_description", "word_count_rule", "canonical_rule", "indexability", "schema_noindex"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def check_rows(spark: SparkSession, root: str) -> DataFrame:
    return c.unpivot_rules(site.rule_page_core(spark, root), ["crawl_id"], "normalized_url", RULES)


_CHECKS = f"""SELECT crawl_id, normalized_url, rule_id, status FROM ({site.SQL["rule_page_core"]})
 UNPIVOT (status FOR rule_id IN ({", ".join(RULES)}))"""
_VALUE = "CASE status WHEN 'pass' THEN 1.0 WHEN 'warn' THEN 0.5 WHEN 'fail' THEN 0.0 END"


@query(f"""WITH r AS (SELECT crawl_id, rule_id, avg({_VALUE}) AS ratio, count(*) FILTER (status = 'fail') AS f, count(*) FILTER (status = 'warn') AS w, count(*) FILTER (status = 'pass') AS p FROM ({_CHECKS}) GROUP BY ALL),
t AS (SELECT crawl_id, 100 * sum(CASE rule_id WHEN 'meta_title' THEN 8 WHEN 'meta_description' THEN 7 ELSE 5 END * ratio) / sum(CASE WHEN ratio IS NOT NULL THEN CASE rule_id WHEN 'meta_title' THEN 8 WHEN 'meta_description' THEN 7 ELSE 5 END END) AS base,
 sum(2 * f + w) AS units, sum(f + w) AS raw, sum(p + f + w) AS scored FROM r GROUP BY 1),
s AS (SELECT crawl_id, CAST(coalesce(floor(100 * pow(base / 100, 1.2) * (1 - CASE WHEN raw >= 10 THEN least(0.45, 3.0 * units / scored) ELSE 0.0 END) + 0.5), 100) AS INTEGER) AS score FROM t)
SELECT crawl_id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s""")
def crawl_scores(spark: SparkSession, root: str) -> DataFrame:
    weights = spark.createDataFrame([("meta_title", 8), ("meta_description", 7)], "rule_id string, weight int")
    return c.scores(check_rows(spark, root), weights, ["crawl_id"])


@query(f"""SELECT rule_id, status, count(*) AS pages, count(DISTINCT crawl_id) AS crawls FROM ({_CHECKS}) WHERE status IN ('warn', 'fail') GROUP BY ALL""")
def issue_counts(spark: SparkSession, root: str) -> DataFrame:
    kept = check_rows(spark, root).filter("status in ('warn', 'fail')")
    return kept.groupBy("rule_id", "status").agg(F.count("*").alias("pages"), F.countDistinct("crawl_id").alias("crawls"))


@query(f"""SELECT crawl_id, rule_id, rule_id AS name, status, rule_id || ' ' || status AS pattern, count(DISTINCT normalized_url) AS pages, count(*) AS occurrences,
 array_to_string(list_sort(list(normalized_url ORDER BY normalized_url)[:5]), ' ') AS first_pages FROM ({_CHECKS}) WHERE status IN ('warn', 'fail') GROUP BY ALL""")
def issue_report(spark: SparkSession, root: str) -> DataFrame:
    out = c.issue_groups(check_rows(spark, root), ["crawl_id"])
    return out.withColumn("first_pages", F.array_join("first_pages", " ")).withColumn("occurrences", F.col("occurrences").cast("long"))


@query(f"""SELECT category, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'warn') AS warn, count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'info') AS info
 FROM (SELECT CASE WHEN rule_id LIKE 'meta%' THEN 'core' WHEN rule_id = 'word_count_rule' THEN 'content' ELSE 'crawl' END AS category, status FROM ({_CHECKS})) GROUP BY ROLLUP (category)""")
def category_rollup(spark: SparkSession, root: str) -> DataFrame:
    category = F.when(F.col("rule_id").startswith("meta"), "core").when(F.col("rule_id") == "word_count_rule", "content").otherwise("crawl")
    return c.rollup(check_rows(spark, root), category, [])


_STEP = "SELECT crawl_id, lag(crawl_id) OVER (PARTITION BY base_url ORDER BY started_at, crawl_id) AS prev FROM (SELECT DISTINCT crawl_id, base_url, started_at FROM crawls WHERE status = 'completed')"
_BAD = f"SELECT crawl_id, normalized_url, rule_id, status FROM ({_CHECKS}) WHERE status IN ('warn', 'fail')"


@query(f"""WITH s AS ({_STEP}), b AS ({_BAD}), n AS (SELECT s.crawl_id, b.normalized_url, b.rule_id, b.status FROM b JOIN s USING (crawl_id) WHERE s.prev IS NOT NULL),
o AS (SELECT s.crawl_id, b.normalized_url, b.rule_id, b.status FROM b JOIN s ON b.crawl_id = s.prev), seen AS (SELECT DISTINCT crawl_id, normalized_url FROM page_features),
gone AS (SELECT DISTINCT snapshot_crawl_id AS crawl_id, normalized_url FROM site_pages WHERE state = 'removed'),
m AS (SELECT coalesce(n.crawl_id, o.crawl_id) AS crawl_id, coalesce(n.normalized_url, o.normalized_url) AS normalized_url, n.status AS now, o.status AS was FROM n FULL JOIN o USING (crawl_id, normalized_url, rule_id))
SELECT CASE WHEN now IS NOT NULL THEN 'open' WHEN gone.normalized_url IS NOT NULL THEN 'stale' WHEN seen.normalized_url IS NOT NULL THEN 'resolved' ELSE 'carried' END AS state,
 CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'dropped' WHEN now <> was THEN 'changed' ELSE 'same' END AS change, count(*) AS findings
FROM m LEFT JOIN seen USING (crawl_id, normalized_url) LEFT JOIN gone USING (crawl_id, normalized_url) GROUP BY ALL""")
def findings_merge(spark: SparkSession, root: str) -> DataFrame:
    """Every crawl after its root's first, merged with the findings of the one before."""
    found = c.flatten(check_rows(spark, root), ["crawl_id"])
    steps = consecutive(table(spark, root, "crawls"))
    later = steps.filter("seq > 1").select("crawl_id")
    old = found.join(steps.filter("next_crawl_id is not null").select("crawl_id", "next_crawl_id"), "crawl_id").drop("crawl_id").withColumnRenamed("next_crawl_id", "crawl_id")
    gone = table(spark, root, "site_pages").filter("state = 'removed'").select(F.col("snapshot_crawl_id").alias("crawl_id"), "normalized_url")
    merged = c.merge(old, found.join(later, "crawl_id"), site.pages(spark, root), gone, ["crawl_id"])
    return merged.groupBy("state", "change").agg(F.count("*").alias("findings"))


@query(f"""WITH s AS ({_STEP}), b AS ({_BAD}), n AS (SELECT s.crawl_id, b.normalized_url, b.rule_id, b.status FROM b JOIN s USING (crawl_id) WHERE s.prev IS NOT NULL),
o AS (SELECT s.crawl_id, b.normalized_url, b.rule_id, b.status FROM b JOIN s ON b.crawl_id = s.prev)
SELECT coalesce(n.crawl_id, o.crawl_id) AS crawl_id, coalesce(n.normalized_url, o.normalized_url) AS normalized_url, coalesce(n.rule_id, o.rule_id) AS rule_id,
 CASE WHEN o.status IS NULL THEN 'added' WHEN n.status IS NULL THEN 'removed' ELSE 'changed' END AS change,
 CASE WHEN coalesce(CASE n.status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 END, 0) > coalesce(CASE o.status WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 END, 0) THEN 'regression' ELSE 'improvement' END AS direction
FROM n FULL JOIN o USING (crawl_id, normalized_url, rule_id) WHERE n.status IS DISTINCT FROM o.status""")
def report_diff(spark: SparkSession, root: str) -> DataFrame:
    found = c.flatten(check_rows(spark, root), ["crawl_id"])
    steps = consecutive(table(spark, root, "crawls"))
    old = found.join(steps.filter("next_crawl_id is not null").select("crawl_id", "next_crawl_id"), "crawl_id").drop("crawl_id").withColumnRenamed("next_crawl_id", "crawl_id")
    return c.diff(old, found.join(steps.filter("seq > 1").select("crawl_id"), "crawl_id"), ["crawl_id", "normalized_url", "rule_id"])


@query("""WITH h AS (SELECT DISTINCT normalized_url AS url, lower(regexp_extract(normalized_url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM page_features WHERE normalized_url LIKE 'https://%'),
f AS (SELECT 'host' AS kind, lower(site_key) AS value, 'crawl-roots' AS provider FROM crawls UNION SELECT 'domain', 'grand-bazaar.example', 'list')
SELECT DISTINCT h.url, f.kind, f.value, f.provider FROM h JOIN f ON (f.kind = 'host' AND f.value = h.host) OR (f.kind = 'domain' AND (h.host = f.value OR h.host LIKE '%.' || f.value))""")
def feed_lookup(spark: SparkSession, root: str) -> DataFrame:
    roots = table(spark, root, "crawls").select(F.lit("host").alias("kind"), F.lower("site_key").alias("value"), F.lit("crawl-roots").alias("provider"))
    feed = roots.distinct().unionByName(spark.createDataFrame([("domain", "grand-bazaar.example", "list")], "kind string, value string, provider string"))
    urls = site.pages(spark, root).filter("normalized_url like 'https://%'").select("normalized_url")
    return d.threat_lookup(urls, feed, "normalized_url")


_MARK = f"""SELECT DISTINCT crawl_id, normalized_url, unnest(['type', 'template']) AS kind, unnest([page_type, coalesce(template_fp, 'none')]) AS token FROM {site.LATEST}
 UNION SELECT DISTINCT crawl_id, normalized_url, 'schema', unnest(schema_types) FROM {site.LATEST}"""


#: the markers that the tables have, in place of stylesheets, asset hosts and classes; the other kinds are of markup and agree wholly
_KINDS = {"template": 0.35, "type": 0.25, "schema": 0.15, "variable": 0.1, "chrome": 0.15}


@query(f"""WITH m AS (SELECT * FROM ({_MARK}) WHERE token IS NOT NULL), n AS (SELECT crawl_id, count(DISTINCT normalized_url) AS n FROM m GROUP BY 1),
b AS (SELECT crawl_id, kind, token FROM m JOIN n USING (crawl_id) GROUP BY ALL HAVING count(*) >= greatest(2, ceil(any_value(n) / 2))), bs AS (SELECT crawl_id, kind, count(*) AS b FROM b GROUP BY ALL),
x AS (SELECT m.crawl_id, m.normalized_url, kind, count(*) AS a, count(b.token) AS i FROM m LEFT JOIN b USING (crawl_id, kind, token) GROUP BY ALL),
k AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {w})" for k, w in _KINDS.items())}) AS t(kind, w)),
e AS (SELECT DISTINCT m.crawl_id, m.normalized_url, k.kind, k.w FROM m, k)
SELECT crawl_id, normalized_url, round(sum(w * CASE WHEN coalesce(a, 0) + coalesce(b, 0) - coalesce(i, 0) = 0 THEN 1.0 ELSE coalesce(i, 0) / (coalesce(a, 0) + coalesce(b, 0) - coalesce(i, 0)) END), 6) AS similarity
FROM e LEFT JOIN x USING (crawl_id, normalized_url, kind) LEFT JOIN bs USING (crawl_id, kind) GROUP BY ALL""")
def baseline_similarity(spark: SparkSession, root: str) -> DataFrame:
    p = site.latest_pages(spark, root)
    s = F.struct
    marks = F.concat(
        F.array(s(F.lit("type").alias("kind"), F.col("page_type").alias("token")), s(F.lit("template").alias("kind"), F.coalesce("template_fp", F.lit("none")).alias("token"))),
        F.coalesce(F.transform("schema_types", lambda t: s(F.lit("schema").alias("kind"), t.alias("token"))), F.array()),
    )
    m = p.select("crawl_id", "normalized_url", F.explode(marks).alias("m")).select("crawl_id", "normalized_url", "m.kind", "m.token").filter("token is not null")
    base = d.baseline(m, ["crawl_id"], "normalized_url")
    return d.similarity(m, base, ["crawl_id"], "normalized_url", _KINDS).withColumn("similarity", F.round("similarity", 6))


_FRONT = """SELECT DISTINCT crawl_id, normalized_url, depth, depth * 100 - CASE WHEN meta_noindex THEN 0 ELSE 200 END - least(coalesce(len(schema_types), 0), 10) * 10
 - CASE WHEN regexp_matches(regexp_extract(normalized_url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/(?:|about|contact|pricing|products?)/?$') THEN 800 ELSE 0 END AS priority FROM page_features WHERE normalized_url LIKE 'https://%'"""


@query(f"SELECT crawl_id, normalized_url, priority FROM (SELECT crawl_id, normalized_url, min(priority) AS priority FROM ({_FRONT}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY crawl_id ORDER BY priority, normalized_url) <= 5")
def frontier_per_crawl(spark: SparkSession, root: str) -> DataFrame:
    """The next five URLs of each crawl by priority: the batch size is the operator's feature."""
    p = site.pages(spark, root).filter("normalized_url like 'https://%'")
    u = F.col("normalized_url")
    rank = d.priority(F.col("depth"), ~F.col("meta_noindex"), F.coalesce(F.size("schema_types"), F.lit(0)), url.path(u))
    front = p.select("crawl_id", u, rank.alias("priority")).groupBy("crawl_id", "normalized_url").agg(F.min("priority").alias("priority"))
    return q.capped_per_group(front, ["crawl_id"], ["priority", "normalized_url"], 5)


@query("""SELECT fetcher_id, status, count(*) AS fetches, count(DISTINCT site_key) AS sites, CAST(sum(size_bytes) AS BIGINT) AS bytes, max(load_time_ms) AS slowest
 FROM (SELECT * FROM page_fetches QUALIFY row_number() OVER (PARTITION BY event_id) = 1) GROUP BY ALL""")
def fetch_stats(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "page_fetches").dropDuplicates(["event_id"])
    return f.groupBy("fetcher_id", "status").agg(
        F.count("*").alias("fetches"), F.countDistinct("site_key").alias("sites"), F.sum("size_bytes").alias("bytes"), F.max("load_time_ms").alias("slowest")
    )


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY ALL""")
def star_aggregate(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount")
    )


@query("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_join(spark: SparkSession, root: str) -> DataFrame:
    """nation and region are 25 and 5 rows at any scale, so they are broadcast."""
    dims = table(spark, root, "nation").join(F.broadcast(table(spark, root, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    c_ = table(spark, root, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(dims), F.col("c_nationkey") == F.col("n_nationkey"))
    j = table(spark, root, "orders").select("o_custkey").join(c_, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("r_name", "n_name").agg(F.countDistinct("c_custkey").alias("customers"), F.count("*").alias("orders"))


@query("""SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_event(spark: SparkSession, root: str) -> DataFrame:
    return q.latest(table(spark, root, "events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) // 10 AS bucket, count(*) AS n FROM events GROUP BY ALL""")
def json_buckets(spark: SparkSession, root: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, root, "events").groupBy("event_type", F.floor(k / 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, CAST(sum(fresh) AS BIGINT) AS sessions, count(*) AS events FROM s GROUP BY 1""")
def user_sessions(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").select("user_id", "event_id", "ts")
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id")), F.col("ts"))
    e = e.withColumn("fresh", F.when(gap <= 1_800_000_000, 0).otherwise(1))
    return e.groupBy("user_id").agg(F.sum("fresh").alias("sessions"), F.count("*").alias("events"))


@query("""WITH v AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, i AS dim, round(avg(x), 4) + 0.0 AS mean FROM v GROUP BY ALL""")
def embedding_centroids(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", (F.col("i") + 1).cast("long").alias("dim")).agg((F.round(F.avg(F.col("x").cast("double")), 4) + 0.0).alias("mean"))
