import pytest
from pyspark.sql import functions as F

from loomaudit.rules import delivery, engine, page  # noqa: F401
from loomaudit.rules.cases import CASES
from loomaudit.sources import dom


def test_every_rule_has_cases():
    assert {c[0] for c in CASES} == set(engine.RULES) and len(engine.RULES) >= 84


def test_which_rules_run():
    assert engine.enabled("core/h1", ["core/*"], []) and not engine.enabled("core/h1", ["url/*"], [])
    assert not engine.enabled("core/h1", ["*"], ["core/*"]) and engine.enabled("core/h1", [], ["*"], {"enabled": True})
    r = engine.Rule("x/y", "info", 1, lambda o: [], {"most": 3}, applies={"kind": ["shop"]})
    assert engine.options_of(r, {"most": 4, "enabled": True}) == {"most": 4}
    with pytest.raises(ValueError):
        engine.options_of(r, {"least": 1})
    assert not engine.applies(r, {"kind": ("blog", "high")}) and engine.applies(r, {"kind": ("blog", "low")}) and engine.applies(r, None)
    with pytest.raises(ValueError):
        engine.register(engine.RULES["core/h1"])


def test_gates_and_odd_pages(spark):
    rows = [("https://a.example/", "<h1>A</h1>", None, False), ("https://a.example/gone", "<h1>B", {"X-Frame-Options": "DENY"}, True), (None, None, None, None), ("not a url", "<<p<><li</", {}, False)]
    d = spark.createDataFrame(rows, "url string, html string, headers map<string,string>, soft boolean")
    p = dom.parsed(d, headers="headers").join(d.select("url", "soft"), "url", "left")
    whole = engine.run_rules(p)
    assert whole.select("url").distinct().count() == 4 and whole.filter("rule_id = 'security/x-frame-options' and status = 'pass'").count() == 1
    own = {"t/a": engine.Rule("t/a", "info", 1, lambda o: [("a", F.lit("pass")), ("b", F.lit("info"))], skip_soft_404=True), "t/b": engine.Rule("t/b", "info", 1, lambda o: [("b", F.lit("pass"))], applies={"k": ["v"]})}
    got = {(r["url"], r["rule_id"], r["name"], r["status"]) for r in engine.run_rules(p, soft_404="soft", rules=own, site={"k": ("w", "high")}).collect()}
    assert ("https://a.example/gone", "t/a", "a", "skipped") in got and ("https://a.example/gone", "t/a", "b", "info") not in got
    assert ("https://a.example/", "t/a", "b", "info") in got and ("https://a.example/", "t/b", "b", "skipped") in got
    assert engine.run_rules(p, enable=[]).count() == 0
    limits = engine.run_rules(p, enable=["crawl/*"], config={"crawl/html-size": {"error_bytes": 1}})
    assert limits.filter("status = 'fail'").count() == 3


def test_nodes():
    n = dom.nodes_of("<div role=list><ul><li>A<li><b>B</b></ul><img alt=x><figure><figcaption>C</figcaption></figure></div><p>D<p>E")
    assert [x["tag"] for x in n] == ["div", "ul", "li", "li", "b", "img", "figure", "figcaption", "p", "p"]
    assert n[3]["ptag"] == "ul" and n[1]["prole"] == "list" and "figcaption+" in n[6]["holds"] and n[0]["names"] & dom.IMAGE
    assert dom.nodes_of(None) == [] and dom.nodes_of("plain") == []
