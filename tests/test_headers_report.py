import json

from pyspark.sql import functions as F

from loomaudit.functions import headers
from loomaudit.operators import checks, report


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()["x"]


def test_headers(spark):
    assert one(spark, {"Content-Type": "a"}, lambda h: headers.header(h, "content-type"), "map<string,string>") == "a"
    assert one(spark, None, lambda h: headers.header(h, "x"), "map<string,string>") is None
    assert one(spark, "default-src 'self'; script-src a; script-src b", headers.csp_directives) == {"default-src": "'self'", "script-src": "a"}
    assert [one(spark, v, headers.csp_status) for v in (None, "script-src 'unsafe-inline'", "img-src x", "default-src 'self'")] == ["fail", "warn", "warn", "pass"]
    f = lambda v: headers.hsts_status(F.lit("https"), v)
    assert [one(spark, v, f) for v in (None, "max-age=0", "max-age=31536000; preload")] == ["warn", "warn", "pass"]
    assert one(spark, "sid=1; Secure; SameSite=Lax", headers.cookie).asDict() == {"name": "sid", "secure": True, "http_only": False, "same_site": "lax"}
    m = F.create_map(F.lit("accept"), F.lit("x"))
    assert [one(spark, v, lambda c: headers.vary_matches(c, m, m)) for v in (None, "*", "Accept, other")] == [True, False, True]
    assert one(spark, 100, lambda c: headers.freshness(c, F.lit(50), F.lit(60)), "int") == "fresh"


def test_reports(spark):
    rows = [("g", "r<1", "n", "warn", f"m {i}", f"https://e/{'a/' * (i % 3)}{i}") for i in range(9)] + [("g", "s", "n", "pass", "m", "https://e/")]
    c = spark.createDataFrame(rows, "g string, rule_id string, name string, status string, message string, page_url string")
    issues = checks.issue_groups(c, ["g"], samples=2).cache()
    assert issues.count() == 1 and issues.first()["pages"] == 9 and len(issues.first()["first_pages"]) == 2
    assert "r<1" in report.render_text(issues) and "r&lt;1" in report.render_xml(issues) and "| r<1 |" in checks.render_markdown(issues)
    assert json.loads(report.json_rows(issues).first()["value"])["pages"] == 9
    assert json.loads(report.sarif_rows(issues).first()["value"])["level"] == "warning"
    assert [r["page_url"] for r in report.breadth_first(c, ["g"], "page_url", 2).orderBy("page_url").collect()] == ["https://e/", "https://e/0"]
