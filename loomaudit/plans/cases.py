"""Functions and sources over small inputs with known results, for what the test tables have no columns of."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomaudit.functions import headers, text, url
from loomaudit.sources import html, robots

_LONG = "x" * 30


def _functions() -> dict[str, tuple]:
    """name: (function of two text columns, cases of first, second and result)."""
    a_list = lambda c: F.split(c, ",")
    number = lambda c: c.cast("bigint")
    return {
        "url.identity": (lambda a, b: url.identity_form(a), [
            ("https://A.example:443/x?utm_source=f&b=1&gclid=2#t", None, "https://a.example/x?b=1"), ("http://a.example:80", None, "http://a.example/"), ("http://a.example:8080/y/", None, "http://a.example:8080/y/"),
        ]),
        "url.comparison": (lambda a, b: url.comparison_form(a), [("HTTPS://A.example/x/?q=1#f", None, "https://a.example/x"), ("https://a.example/", None, "https://a.example/")]),
        "url.private": (lambda a, b: url.is_private_host(a), [
            ("10.1.2.3", None, "true"), ("172.31.0.1", None, "true"), ("172.32.0.1", None, "false"), ("169.254.1.1", None, "true"), ("localhost", None, "true"), ("a.example", None, "false"), ("192.168.0.9", None, "true"),
        ]),
        "url.domain": (lambda a, b: url.is_valid_domain(a), [("a-b.example", None, "true"), ("-a.example", None, "false"), ("localhost", None, "false"), ("a..example", None, "false")]),
        "url.schemeless": (lambda a, b: url.coerce_schemeless(a), [("shop.example/x", None, "https://shop.example/x"), ("/x", None, "/x"), ("//a.example/y", None, "https://a.example/y"), ("about", None, "about")]),
        "url.skip": (lambda a, b: url.should_skip(a), [("mailto:a@b.example", None, "true"), (" #top", None, "true"), ("", None, "true"), ("JavaScript:void(0)", None, "true"), ("/x", None, "false")]),
        "url.glob": (lambda a, b: url.glob(a, ["/blog/*", "*.pdf"]), [("/blog/x", None, "true"), ("/a.pdf", None, "true"), ("/a.pdf?x", None, "false"), ("/blo", None, "false")]),
        "url.scope": (lambda a, b: url.in_scope(a, b, exclude=["*/private/*"], domains=["cdn.example"])["reason"], [
            ("https://a.example/x", "https://a.example/", "in_scope"), ("https://a.example/private/x", "https://a.example/", "excluded"), ("https://img.cdn.example/x", "https://a.example/", "in_scope"),
            ("https://www.a.example/x", "https://a.example/", "other_host"),
        ]),
        "url.parents": (lambda a, b: F.array_join(url.parent_domains(a), " "), [("a.b.example", None, "a.b.example b.example"), ("localhost", None, "localhost")]),
        "text.truncate": (lambda a, b: text.truncate_bytes(a, 3), [("naïve", None, "na"), ("abc", None, "abc"), ("abcd", None, "abc"), ("€uro", None, "€")]),
        "text.clamp": (lambda a, b: text.clamp_id(a, 20), [(_LONG, None, "xxx~" + hashlib.sha256(_LONG.encode()).hexdigest()[:16]), ("short", None, "short")]),
        "text.normalized": (lambda a, b: text.normalized_hash(a), [(" Ab ", None, hashlib.sha256(b"ab").hexdigest()), ("  ", None, None)]),
        "text.markup": (lambda a, b: text.markup_hash(a), [("<p>  a\n</p> <p>", None, hashlib.sha256(b"<p> a </p><p>").hexdigest())]),
        "text.entropy": (lambda a, b: F.round(text.entropy(a), 4), [("aabb", None, "1.0"), ("aaaa", None, "0.0"), ("abcd", None, "2.0")]),
        "text.jaccard": (lambda a, b: text.jaccard(a_list(a), a_list(b)), [("x,y", "y,z", "0.3333333333333333"), ("x", "x", "1.0")]),
        "text.syllables": (lambda a, b: text.syllables(a), [("banana", None, "3"), ("kettle", None, "1"), ("the", None, "1"), ("strange", None, "1")]),
        "text.reading": (lambda a, b: text.reading_time(F.repeat(a, 201)), [("word ", None, "2")]),
        "cache.lifetime": (lambda a, b: text.cache_lifetime(a), [("public, max-age=60", None, "60"), ("max-age=9, s-maxage=5", None, "5"), ("Immutable", None, "31536000"), ("no-cache", None, None)]),
        "change": (lambda a, b: text.change_status(F.nullif(a, F.lit("-")), F.nullif(b, F.lit("-")), *[F.lit(None).cast("string")] * 4), [("e", "e", "unchanged"), ("e", "f", "changed"), ("-", "f", "new"), ("e", "-", "unknown")]),
        "headers.csp": (lambda a, b: headers.csp_status(a), [
            (None, None, "fail"), ("script-src 'self'", None, "pass"), ("default-src *", None, "warn"), ("script-src 'unsafe-inline'; default-src 'none'", None, "warn"), ("img-src 'self'", None, "warn"),
        ]),
        "headers.cookie": (lambda a, b: F.to_json(headers.cookie(a)), [("id=1; Secure; SameSite=Lax", None, '{"name":"id","secure":true,"http_only":false,"same_site":"lax"}'), ("x=; HttpOnly", None, '{"name":"x","secure":false,"http_only":true}')]),
        "headers.fresh": (lambda a, b: headers.freshness(number(a), F.lit(0).cast("bigint"), number(b)), [("50", "60", "fresh"), ("150", "60", "revalidate"), ("90000", "60", "stale"), ("86401", "999999", "revalidate")]),
        "headers.vary": (lambda a, b: headers.vary_matches(a, F.create_map(F.lit("accept"), F.lit("html")), F.create_map(F.lit("accept"), b)), [("Accept", "html", "true"), ("accept", "json", "false"), ("*", "html", "false"), ("Cookie", "json", "true")]),
    }


def function_cases(spark: SparkSession, root: str) -> DataFrame:
    """The result of each function, as text, for each of its cases."""
    out = None
    for name, (f, cases) in _functions().items():
        d = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "case_no int, a string, b string")
        got: Column = f(F.col("a"), F.col("b")).cast("string")
        one = d.select(F.lit(name).alias("function"), "case_no", got.alias("result"))
        out = one if out is None else out.unionByName(one)
    return out


def _values(rows: list[tuple], names: str) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS t({names})"


ROBOTS = [
    ("a", "User-agent: *\nDisallow: /private # not for all\nAllow: /\n\nUser-agent: Googlebot\r\nDisallow: /drafts\nSitemap: https://a.example/map.xml\nsitemap : https://a.example/more.xml"),
    ("b", "User-agent: x\nUser-agent: *\nDisallow:\nDisallow: /a"), ("c", None), ("d", ""),
]


def robots_cases(spark: SparkSession, root: str) -> DataFrame:
    """Which of some paths the robots files forbid, for the search engine's own agent."""
    files = spark.createDataFrame(ROBOTS, "site_key string, content string")
    paths = spark.createDataFrame([(s, p) for s in "abcd" for p in ("/private/x", "/drafts/y", "/a/b", "/")], "site_key string, path string")
    return robots.disallowed(paths, robots.robots_rules(files), F.col("path")).select("site_key", "path", "disallowed")


def robots_sitemap_cases(spark: SparkSession, root: str) -> DataFrame:
    return robots.robots_sitemaps(spark.createDataFrame(ROBOTS, "site_key string, content string"))


MAPS = [
    ("m1", "<urlset><url><loc> https://a.example/1?x=1&amp;y=2 </loc><lastmod>2025-01-02</lastmod><priority>0.5</priority></url><url><lastmod>2025</lastmod></url><url><loc><![CDATA[https://a.example/2]]></loc><priority>high</priority></url></urlset>"),
    ("m2", "<urlset><url><loc>https://a.example/2</loc></url><url><loc>https://a.example/3</loc></url></urlset>"), ("m3", None), ("m4", "<html>no map</html>"),
]


def sitemap_cases(spark: SparkSession, root: str) -> DataFrame:
    return robots.sitemap_urls(spark.createDataFrame(MAPS, "sitemap string, content string")).select("sitemap", "pos", "loc", "lastmod", F.col("priority").cast("string").alias("priority"))


def sitemap_selected(spark: SparkSession, root: str) -> DataFrame:
    """Three addresses, in turn from each sitemap: the cap is the feature."""
    return robots.selected_urls(robots.sitemap_urls(spark.createDataFrame(MAPS, "sitemap string, content string")), 3)


PAGES = [
    (
        "https://a.example/x/",
        "<html lang=de><head><title> A  title </title><meta name=Description content='Says it'><meta name=robots content=noindex><link rel=canonical href=/x><meta property=og:title content=OG>"
        "<script type='application/ld+json'>{\"@graph\": [{\"@type\": [\"Product\", \"Thing\"]}, {\"@type\": \"Offer\"}]}</script><script type='application/ld+json'>{broken</script>"
        "<link rel=stylesheet href=/s.css><script src=/s.js></script></head><body><h1>Copper <b>kettle</b></h1><p>Five words stand right here<p>and two<h2>More</h2>"
        "<a href=/y>own</a><a href='https://b.example/z' rel='nofollow noopener'>other</a><a href='mailto:x@y.example'>m</a><img src=/i.png alt=I><img src='data:x'></body></html>",
    ),
    ("https://a.example/empty", ""), ("https://a.example/null", None), ("https://a.example/broken", "<div><p>One<p>Two</div></b><h1>Late"),
]


def html_cases(spark: SparkSession, root: str) -> DataFrame:
    """What is taken from a page's markup, for a whole page, an empty, a null and a broken one."""
    p = html.parsed(spark.createDataFrame(PAGES, "url string, html string"))
    long = lambda c: F.size(c).cast("long")
    return p.select(
        "url", "title", "description", "canonical", "robots", "lang", F.array_join("h1", "|").alias("h1"), F.array_join(F.transform("headings", lambda h: F.concat(h["level"], F.lit(":"), h["text"])), "|").alias("headings"),
        F.array_join(F.transform("links", lambda x: F.concat_ws(" ", x["href"], x["text"], x["internal"], x["nofollow"])), "|").alias("links"), F.array_join(F.col("images")["src"], "|").alias("images"),
        F.array_join("scripts", "|").alias("scripts"), F.array_join("stylesheets", "|").alias("stylesheets"), F.col("og")["title"].alias("og_title"), F.array_join("schema_types", "|").alias("types"),
        F.col("json_ld_errors").cast("long").alias("errors"), long("images").alias("image_count"),
    )


_HTML_ROWS = [
    ("https://a.example/x/", "A title", "Says it", "https://a.example/x", "noindex", "de", "Copper kettle", "1:Copper kettle|2:More", "https://a.example/y own true false|https://b.example/z other false true",
     "https://a.example/i.png", "https://a.example/s.js", "https://a.example/s.css", "OG", "Product|Thing|Offer", 1, 1),
    *[(f"https://a.example/{k}", None, None, None, None, None, "", "", "", "", "", "", None, "", 0, 0) for k in ("empty", "null")],
    ("https://a.example/broken", None, None, None, None, None, "Late", "1:Late", "", "", "", "", None, "", 0, 0),
]
QUERIES = {
    "function_cases": function_cases, "robots_cases": robots_cases, "robots_sitemap_cases": robots_sitemap_cases, "sitemap_cases": sitemap_cases, "sitemap_selected": sitemap_selected, "html_cases": html_cases,
}
SQL = {
    "function_cases": _values([(n, i, c[2]) for n, (_, cases) in _functions().items() for i, c in enumerate(cases)], "function, case_no, result"),
    "robots_cases": "SELECT site_key, path, (site_key, path) IN (('a', '/drafts/y'), ('b', '/a/b')) AS disallowed FROM (SELECT unnest(['a', 'b', 'c', 'd']) AS site_key), (SELECT unnest(['/private/x', '/drafts/y', '/a/b', '/']) AS path)",
    "robots_sitemap_cases": _values([("a", "https://a.example/map.xml"), ("a", "https://a.example/more.xml")], "site_key, sitemap"),
    "sitemap_cases": _values([("m1", 0, "https://a.example/1?x=1&y=2", "2025-01-02", "0.5"), ("m1", 2, "https://a.example/2", None, None), ("m2", 0, "https://a.example/2", None, None), ("m2", 1, "https://a.example/3", None, None)], "sitemap, pos, loc, lastmod, priority"),
    "sitemap_selected": _values([("https://a.example/1?x=1&y=2",), ("https://a.example/2",), ("https://a.example/3",)], "loc"),
    "html_cases": _values(_HTML_ROWS, "url, title, description, canonical, robots, lang, h1, headings, links, images, scripts, stylesheets, og_title, types, errors, image_count"),
}
