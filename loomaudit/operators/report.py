"""Reports from issue groups: rows for the JSON writer, and small texts rendered on the driver."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomaudit.functions import url


def breadth_first(pages: DataFrame, group: list[str], page: str, most: int) -> DataFrame:
    """Distinct pages of each group, shallowest first, then by URL; the first ``most`` (the sample is the feature)."""
    one = pages.select(*group, page).distinct()
    order = W.partitionBy(*group).orderBy(url.depth(F.col(page)), page)
    return one.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def json_rows(issues: DataFrame) -> DataFrame:
    return issues.select(F.to_json(F.struct(*sorted(issues.columns))).alias("value"))


def sarif_rows(issues: DataFrame) -> DataFrame:
    """One result object per issue group and sampled page."""
    level = F.when(F.col("status") == "fail", "error").otherwise("warning")
    each = issues.withColumn("page", F.explode_outer("first_pages"))
    place = F.array(F.struct(F.struct(F.struct(F.col("page").alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    return each.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("pattern").alias("text")).alias("message"), place.alias("locations"))).alias("value"))


def _rows(issues: DataFrame, limit: int) -> list:
    return issues.orderBy(F.desc("pages"), "rule_id", "name", "status").limit(limit).collect()


def render_text(issues: DataFrame, limit: int = 200) -> str:
    return "".join(f"[{r['status']}] {r['rule_id']}: {r['pattern']} ({r['pages']} pages)\n" for r in _rows(issues, limit))


def render_xml(issues: DataFrame, limit: int = 200) -> str:
    out = ["<report>"]
    for r in _rows(issues, limit):
        pages = "".join(f"<page>{escape(p)}</page>" for p in r["first_pages"] or [])
        out.append(f"<issue rule={quoteattr(r['rule_id'])} status={quoteattr(r['status'])} pages=\"{r['pages']}\">{pages}</issue>")
    return "\n".join([*out, "</report>"]) + "\n"
