"""Queries over parsed markup: nodes and rules over the stored pages, and every page rule over cases with known results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomaudit.rules import delivery, page  # noqa: F401
from loomaudit.rules.cases import CASES
from loomaudit.rules.engine import run_rules
from loomaudit.session import spread
from loomaudit.sources import dom
from loomaudit.sources.tables import table


def stored(spark: SparkSession, root: str) -> DataFrame:
    """The stored HTML pages as nodes, under their hashes."""
    rows = table(spark, root, "content_store").filter("content_type = 'text/html'").select("hash", "content")
    return dom.parsed(spread(rows), "hash", "content")


def stored_elements(spark: SparkSession, root: str) -> DataFrame:
    """How many elements of each kind a stored page has."""
    n = stored(spark, root).select(F.col("url").alias("hash"), F.explode("nodes.tag").alias("tag"))
    return n.groupBy("hash", "tag").agg(F.count("*").alias("elements"))


def stored_headings(spark: SparkSession, root: str) -> DataFrame:
    """Level and number in order of each heading of a stored page."""
    h = F.filter("nodes", lambda n: n["tag"].rlike("^h[1-6]$"))
    return stored(spark, root).select(F.col("url").alias("hash"), F.posexplode(F.transform(h, lambda n: F.substring(n["tag"], 2, 1).cast("int"))).alias("pos", "level"))


def stored_rule_counts(spark: SparkSession, root: str) -> DataFrame:
    """Checks of all page rules over the stored pages, by rule, name and status; the pages have no address or headers there."""
    pages = stored(spark, root).withColumn("url", F.concat(F.lit("https://store.example/"), "url"))
    return run_rules(pages, disable=["url/*", "security/*"]).groupBy("rule_id", "name", "status").agg(F.count("*").alias("pages"))


def rule_cases(spark: SparkSession, root: str) -> DataFrame:
    """Every page rule over all cases, of which the checks of a case's own rule are kept."""
    rows = [(f"case:{i}", c[0], c[2], c[3], c[4]) for i, c in enumerate(CASES)]
    d = spark.createDataFrame(rows, "id string, wanted string, html string, address string, headers map<string,string>")
    # the parse keeps url, html and headers; the case's number rides in a header
    d = d.withColumn("headers", F.map_concat("headers", F.map_from_arrays(F.array(F.lit("x-case"), F.lit("x-wanted")), F.array("id", "wanted"))))
    p = dom.parsed(d, "address", "html", "headers")
    p = p.withColumn("case_id", F.col("headers")["x-case"]).withColumn("wanted", F.col("headers")["x-wanted"])
    checks = run_rules(p, keep=["case_id", "wanted"])
    return checks.filter("rule_id = wanted").select("case_id", "rule_id", "name", "status")


def _cases_sql() -> str:
    rows = [f"('case:{i}', '{c[0]}', '{name}', '{status}')" for i, c in enumerate(CASES) for name, status in (x.split("=") for x in c[1].split())]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(case_id, rule_id, name, status)"


_HTML = "SELECT hash, content FROM content_store WHERE content_type = 'text/html' AND content IS NOT NULL"
QUERIES = {"stored_elements": stored_elements, "stored_headings": stored_headings, "stored_rule_counts": stored_rule_counts, "rule_cases": rule_cases}
SQL = {
    "stored_elements": f"SELECT hash, tag, count(*) AS elements FROM (SELECT hash, lower(unnest(regexp_extract_all(content, '<([A-Za-z][A-Za-z0-9]*)(?:\\s[^>]*)?>', 1))) AS tag FROM ({_HTML})) GROUP BY ALL",
    "stored_headings": f"SELECT hash, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, CAST(unnest(l) AS INTEGER) AS level FROM (SELECT hash, regexp_extract_all(content, '<h([1-6])(?:\\s[^>]*)?>', 1) AS l FROM ({_HTML}))",
    "rule_cases": _cases_sql(),
}
