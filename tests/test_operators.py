from pyspark.sql import functions as F

from loomaudit.functions import url
from loomaudit.operators import checks, detection, site_query
from loomaudit.operators.skew import join_hot
from loomaudit.operators.snapshots import SnapshotIndex, snapshot_changes
from loomaudit.sources import html, robots

CRAWL = "crawl_id string, base_url string, started_at long, status string"
PAGE = "crawl_id string, normalized_url string, status int, title string, ingested_at long, row_id long"


def changes(spark, crawls, pages):
    out = snapshot_changes(spark.createDataFrame(pages, PAGE), spark.createDataFrame(crawls, CRAWL), "crawl_id", "normalized_url", ["status", "title"], ["ingested_at", "row_id"])
    return {(r["crawl_id"], r["normalized_url"], r["change"]) for r in out.collect()}


def test_snapshot_changes(spark):
    crawls = [("a", "r", 1, "completed"), ("x", "r", 2, "failed"), ("b", "r", 3, "completed"), ("b", "r", 3, "completed"), ("c", "r", 4, "completed")]
    pages = [
        ("a", "p", 200, None, 1, 1), ("a", "q", 200, "t", 1, 2), ("x", "z", 200, "t", 1, 3),
        ("b", "p", 200, None, 1, 4), ("b", "q", 404, "t", 1, 5), ("b", "q", 200, "t", 2, 6), ("b", "n", 200, "t", 1, 7), ("b", None, 1, "", 1, 8),
        ("c", "q", 200, None, 1, 9),
    ]
    # the later row of q holds in b; null equals null for p
    assert changes(spark, crawls, pages) == {("b", "n", "added"), ("c", "p", "removed"), ("c", "n", "removed"), ("c", "q", "changed")}
    assert changes(spark, crawls, []) == set() and changes(spark, [], pages) == set()


def test_snapshot_of_ended_and_empty_crawls(spark):
    crawls = [("a", "r", 1, "completed"), ("b", "r", 2, "completed"), ("c", "r", 3, "completed"), ("d", "s", 1, "completed"), ("e", "s", 2, "completed")]
    pages = [("a", "p", 1, "t", 1, 1), ("c", "p", 1, "t", 1, 2), ("e", "q", 1, "t", 1, 3)]
    assert changes(spark, crawls, pages) == {("b", "p", "removed"), ("c", "p", "added"), ("e", "q", "added")}


def test_snapshot_index_steps(spark, tmp_path):
    import os

    days = [[("p", 1), ("q", 1)], [("p", 2), ("n", None)], [("p", 2), ("n", 3)], []]
    index = SnapshotIndex(spark, str(tmp_path), ["k"], ["v"], buckets=4)
    frames = [spark.createDataFrame(d, "k string, v int") for d in days]
    assert index.advance(frames[0]).count() == 0
    got = index.advance(frames[1], frames[0])
    assert {(r["k"], r["change"], r["was"] and r["was"]["v"]) for r in got.collect()} == {("p", "changed", 1), ("q", "removed", None), ("n", "added", None)}
    assert {tuple(r) for r in index.advance(frames[2]).collect()} == {("n", "changed")}
    # a new session knows only the folder; old versions are gone
    spark.sql(f"DROP TABLE {index._current()['table']}")
    assert {tuple(r) for r in SnapshotIndex(spark, str(tmp_path), ["k"], ["v"], buckets=4).advance(frames[3]).collect()} == {("n", "removed"), ("p", "removed")}
    assert len([x for x in os.listdir(tmp_path) if x.startswith("loomaudit_index_")]) == 1
    plan = index.probe(*[spark.table(index._current()["table"])] * 2)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    index.drop()


def test_join_hot(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(300)], "id long, k string")
    dim = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.length("k"))
    left = join_hot(rows, dim, ["k"], "n", "id", "left", hot_keys=2, salts=5)
    assert left.count() == 300 and left.filter("x is null").count() == 50
    assert join_hot(rows, dim, ["k"], "n", "id").count() == 250


def test_query_layer(spark):
    rows = spark.createDataFrame([("g", "a", " T ", 1), ("g", "b", "t", 0), ("g", "c", "", 0), ("g", "d", None, 2)], "g string, normalized_url string, title string, depth int")
    got = site_query.duplicate_groups(rows, ["g"], F.col("title"), "normalized_url").collect()
    assert sorted(r["normalized_url"] for r in got) == ["a", "b"] and got[0]["copies"] == 2
    assert site_query.homepage(rows, ["g"]).first()["normalized_url"] == "b"
    assert [r["normalized_url"] for r in site_query.page_of(rows, "normalized_url", after="b", limit=1).collect()] == ["c"]
    links = spark.createDataFrame([("g", "https://x/a", "https://x/b/", False), ("g", "https://x/b", "https://x/b", False), ("g", "https://x/c", "https://x/b", True)], "g string, source string, target string, nofollow boolean")
    pages = spark.createDataFrame([("g", "https://x/a"), ("g", "https://x/b")], "g string, normalized_url string")
    assert {r["normalized_url"]: r["incoming"] for r in site_query.incoming_links(pages, links, ["g"]).collect()} == {"https://x/a": 0, "https://x/b": 2}


def test_norm_outliers(spark):
    rows = spark.createDataFrame([("g", f"u{i}", 100 + i) for i in range(10)] + [("g", "thin", 10), ("h", "x", 1)], "g string, u string, v int")
    got = site_query.norm_outliers(rows, ["g"], "v", "u").collect()
    assert [r["u"] for r in got] == ["thin"]
    assert site_query.norm_outliers(rows.filter("false"), ["g"], "v", "u").count() == 0


def scored(spark, rows, weights=()):
    c = spark.createDataFrame([("g", r, s) for r, s in rows], "g string, rule_id string, status string")
    w = spark.createDataFrame(list(weights) or [("-", 5)], "rule_id string, weight int")
    got = checks.scores(c, w, ["g"]).first()
    return got and got["score"]


def test_scores(spark):
    assert scored(spark, [("a", "pass"), ("b", "pass")]) == 100
    assert scored(spark, [("a", "fail")]) == 0
    assert scored(spark, [("a", "warn")]) == 44
    assert scored(spark, [("a", "pass"), ("a", "fail"), ("b", "fail")], [("a", 10), ("b", 5)]) == 27
    assert scored(spark, [("a", "skipped")]) == 100
    assert scored(spark, []) is None


def test_merge_states(spark):
    s = "g string, normalized_url string, rule_id string, check_name string, locator string, status string, message string, fingerprint string"
    prior = spark.createDataFrame([("g", u, "r", "n", "", "warn", "m", "1") for u in ("again", "fixed", "gone", "unseen")], s)
    fresh = spark.createDataFrame([("g", "again", "r", "n", "", "fail", "m", "2"), ("g", "new", "r", "n", "", "warn", "m", "1")], s)
    page = lambda *u: spark.createDataFrame([("g", x) for x in u], "g string, normalized_url string")
    got = {r["normalized_url"]: (r["state"], r["change"]) for r in checks.merge(prior, fresh, page("again", "fixed", "new"), page("gone"), ["g"]).collect()}
    assert got == {"again": ("open", "changed"), "fixed": ("resolved", "dropped"), "gone": ("stale", "dropped"), "unseen": ("carried", "dropped"), "new": ("open", "added")}


def test_detection(spark):
    urls = spark.createDataFrame([("https://a.b.bad.com/x?q",), ("https://good.com/",), (None,)], "url string")
    feed = spark.createDataFrame([("domain", "bad.com", "f"), ("url", "https://good.com/", "g")], "kind string, value string, provider string")
    assert {(r["url"], r["provider"]) for r in detection.threat_lookup(urls, feed).collect()} == {("https://a.b.bad.com/x?q", "f"), ("https://good.com/", "g")}
    front = spark.createDataFrame([("h", f"u{i}", i, 0) for i in range(5)] + [("k", "v", 9, 0)], "host string, normalized_url string, priority int, enqueued_at int")
    assert [r["normalized_url"] for r in detection.next_batch(front, 3, per_host=1).collect()] == ["u0", "v"]


def test_html(spark):
    page = """<!doctype html><html lang=en><head><title> A &amp; B </title><meta name="description" content="d"><link rel=canonical href="/c">
    <script type="application/ld+json">{"@graph":[{"@type":["Article","X"]}]}</script><script>var s = "</p>";</script></head>
    <body><h1>One</h1><p>x<p>y <a href="/in" rel="nofollow">in</a><a href="https://o.org/">out</a><img src="i.png" alt=""></body>"""
    got = html.parsed(spark.createDataFrame([("https://ex.com/p/", page), ("https://ex.com/", None), (None, "<b")], "url string, html string")).collect()
    r = got[0]
    assert (r["title"], r["description"], r["canonical"], r["h1"], r["schema_types"]) == ("A & B", "d", "https://ex.com/c", ["One"], ["Article", "X"])
    assert [(x["href"], x["internal"], x["nofollow"]) for x in r["links"]] == [("https://ex.com/in", True, True), ("https://o.org/", False, False)]
    assert r["text"] == "One x y inout" or r["text"].startswith("One x y") and r["images"][0]["src"] == "https://ex.com/p/i.png"
    assert got[1]["word_count"] == 0 and got[2]["links"] == []


def test_robots_and_sitemap(spark):
    txt = "User-agent: a\nUser-agent: *\nAllow: /x/ok\nDisallow: /x # no\nSitemap: https://e/s.xml\n"
    files = spark.createDataFrame([("s", txt), ("t", None)], "site_key string, content string")
    rules = robots.robots_rules(files)
    assert {(r["agent"], r["kind"], r["path"]) for r in rules.collect()} == {("*", "allow", "/x/ok"), ("*", "disallow", "/x")}
    assert [r["sitemap"] for r in robots.robots_sitemaps(files).collect()] == ["https://e/s.xml"]
    urls = spark.createDataFrame([("s", "https://e/x/ok"), ("s", "https://e/x/n"), ("s", "https://e/"), ("t", "https://t/x")], "site_key string, u string")
    got = robots.disallowed(urls, rules, url.path(F.col("u")))
    assert {r["u"]: r["disallowed"] for r in got.collect()} == {"https://e/x/ok": False, "https://e/x/n": True, "https://e/": False, "https://t/x": False}
    xml = "<urlset><url><loc>https://e/1?a&amp;b</loc><lastmod>2024-01-02</lastmod></url><url><priority>0.5</priority></url><url><loc>https://e/2</loc></url></urlset>"
    locs = robots.sitemap_urls(spark.createDataFrame([("m", xml)], "sitemap string, content string"))
    assert [(r["pos"], r["loc"], r["lastmod"]) for r in locs.orderBy("pos").collect()] == [(0, "https://e/1?a&b", "2024-01-02"), (2, "https://e/2", None)]
    assert robots.selected_urls(locs, 1).count() == 1
