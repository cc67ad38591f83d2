"""Page rules over how a page is delivered and linked: headers, caches, cookies, images, landmarks and what belongs to the head."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomaudit.functions import headers as H
from loomaudit.functions import text as T
from loomaudit.functions import url as U
from loomaudit.rules.engine import Checks, rule
from loomaudit.rules.page import _absolute, _attr, _property, _viewport, address, at, count, element_rule, first, header, low, named, nodes, role, some, status, tag, unnamed
from loomaudit.sources import dom

_link = lambda n: tag(n, "a") & _attr(n, "href")
_rel = lambda n: F.split(F.coalesce(low(n, "rel"), F.lit("")), r"\s+")


@rule("perf/dom-size", "warning", 6, options={"warn_threshold": 1500, "error_threshold": 3000, "max_depth": 32, "max_children": 60})
def dom_size(o: dict) -> Checks:
    n = F.size(nodes())
    most = lambda k: F.coalesce(F.array_max(F.transform(nodes(), lambda x: x[k])), F.lit(0))
    return [
        ("dom-total-nodes", status((n < o["warn_threshold"], "pass"), (n < o["error_threshold"], "warn"), other="fail")),
        ("dom-depth", status((most("depth") > o["max_depth"], "warn"), other="pass")),
        ("dom-max-children", status((most("kids") > o["max_children"], "warn"), other="pass")),
    ]


@rule("perf/compression", "warning", 6)
def compression(o: dict) -> Checks:
    coding = F.nullif(F.lower(header("content-encoding")), F.lit(""))
    fits = header("content-type").rlike(r"text/|application/(?:json|javascript|xml)|\+(?:xml|json)")
    large = F.length(F.col("html")) > 1000
    return [
        (
            "compression",
            status(
                (~F.coalesce(fits, F.lit(False)), "info"), (coding.rlike("br|gzip|deflate"), "pass"), (coding == "identity", "warn"), (coding.isNotNull(), "info"),
                (F.lower(header("transfer-encoding")).contains("chunked"), "warn"), (large, "fail"), other="info",
            ),
        )
    ]


@rule("perf/cache-headers", "warning", 4)
def cache_headers(o: dict) -> Checks:
    control, expires = F.nullif(header("cache-control"), F.lit("")), F.nullif(header("expires"), F.lit(""))
    d = T.cache_directives(control)
    has = lambda k: F.coalesce(F.map_contains_key(d, k), F.lit(False))
    age = F.try_element_at(d, F.lit("max-age")).try_cast("bigint")
    checked = control.isNotNull() & ~has("no-store") & ~has("no-cache")
    page = header("content-type").contains("text/html") | address().endswith(".html") | ~address().rlike(r"\.[a-z]{2,4}$")
    page = F.coalesce(page, address().endswith(".html") | ~address().rlike(r"\.[a-z]{2,4}$"))
    known = (header("etag") != "") | (header("last-modified") != "")
    return [
        ("cache-headers-missing", status((control.isNull() & expires.isNull(), "warn"))),
        ("cache-control", status((has("no-store"), "info"), (has("no-cache") & F.coalesce(known, F.lit(False)), "pass"), (has("no-cache"), "warn"), (control.isNotNull() & age.isNull(), "warn"))),
        ("cache-control-html", status((checked & page & (age > 3600), "info"), (checked & page & age.isNotNull(), "pass"))),
        ("cache-control-static", status((checked & ~page & (age < 86_400), "warn"), (checked & ~page & age.isNotNull(), "pass"))),
        ("cache-immutable", status((checked & has("immutable"), "pass"))),
        ("cache-expires", status((control.isNull() & expires.isNotNull(), "info"))),
    ]


@rule("security/hsts", "warning", 6)
def hsts(o: dict) -> Checks:
    return [("hsts", H.hsts_status(U.scheme(address()), header("strict-transport-security")))]


#: fixed values: hosts whose scripts change under the same address
SRI_EXEMPT = [
    "js.stripe.com", "checkout.stripe.com", "www.paypal.com", "www.paypalobjects.com", "www.google.com", "www.gstatic.com", "js.hcaptcha.com", "www.googletagmanager.com",
]


@rule("security/sri", "warning", 5)
def sri(o: dict) -> Checks:
    source = lambda n: F.when(tag(n, "script"), at(n, "src")).when(tag(n, "link") & F.array_contains(_rel(n), "stylesheet"), at(n, "href"))
    other = lambda n: source(n).rlike(r"^(?:https?:)?//") & (_absolute(source(n)) != U.host(address()))
    bare = lambda n: other(n) & ~_absolute(source(n)).isin(SRI_EXEMPT) & ~_attr(n, "integrity")
    return [("sri", status((some(bare), "warn"), (some(other), "pass"), other="info"))]


@rule("security/cookie-flags", "warning", 5)
def cookie_flags(o: dict) -> Checks:
    # a comma sets cookies apart only where a name follows
    parts = F.filter(F.transform(F.split(F.coalesce(header("set-cookie"), F.lit("")), r"\n|,(?=\s*[^;,=\s]+=)"), lambda p: F.trim(p)), lambda p: p != "")
    cookies = F.transform(parts, lambda p: H.cookie(p))
    any_ = lambda test: F.exists(cookies, lambda c: F.coalesce(test(c), F.lit(False)))
    https = address().startswith("https:")
    none = any_(lambda c: (F.lower(c["same_site"]) == "none") & ~c["secure"])
    insecure, script, site = https & any_(lambda c: ~c["secure"]), any_(lambda c: ~c["http_only"]), any_(lambda c: F.coalesce(c["same_site"], F.lit("")) == "")
    return [
        ("cookie-samesite-none-insecure", status((none, "fail"))), ("cookie-secure", status((insecure, "warn"))), ("cookie-httponly", status((script, "warn"))),
        ("cookie-samesite", status((site, "info"))), ("cookie-flags", status((none | insecure | script | site, None), other="pass")),
    ]


@rule("links/nofollow-internal", "warning", 5)
def nofollow_internal(o: dict) -> Checks:
    bad = some(lambda n: _link(n) & low(n, "rel").contains("nofollow") & (_absolute(F.trim(at(n, "href"))) == U.host(address())))
    return [("nofollow-internal", status((bad, "warn"), other="pass"))]


@rule("links/external-links", "info", 2)
def external_links(o: dict) -> Checks:
    out = some(lambda n: _link(n) & F.trim(at(n, "href")).rlike(r"^(?:https?:)?//") & (_absolute(F.trim(at(n, "href"))) != U.host(address())))
    return [("external-links", status((out, "pass"), other="info"))]


def _canonical() -> Column:
    return F.nullif(F.trim(first(lambda n: tag(n, "link") & F.array_contains(_rel(n), "canonical"), lambda n: at(n, "href"))), F.lit(""))


def _whole(u: Column) -> Column:
    """An address as the page resolves it: absolute, scheme and host in lower case, with a path."""
    root = F.concat(U.scheme(address()), F.lit("://"), U.authority(address()))
    full = F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), u).when(u.startswith("//"), F.concat(U.scheme(address()), F.lit(":"), u)).when(u.startswith("/"), F.concat(root, u)).otherwise(
        F.concat(root, F.regexp_replace(U.path(address()), r"[^/]*$", ""), u)
    )
    query = U.query(full)
    return F.concat(U.scheme(full), F.lit("://"), U.authority(full), U.path(full), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


@rule("core/canonical", "warning", 6)
def canonical(o: dict) -> Checks:
    c = _canonical()
    return [("canonical", status((c.isNull(), "warn"), (_whole(c) != _whole(address()), "info"), other="pass"))]


@rule("social/og-url-match", "warning", 3)
def og_url_match(o: dict) -> Checks:
    og, c = _property("og:url"), _canonical()
    bare = lambda u: F.regexp_replace(_whole(u), "/$", "")
    return [("og-url-match", status((og.isNull() | c.isNull(), "info"), (bare(og) == bare(c), "pass"), other="warn"))]


@rule("social/share-buttons", "info", 2)
def share_buttons(o: dict) -> Checks:
    words = F.lower(F.col("html")).rlike("share.*(?:facebook|twitter|linkedin)|(?:facebook|twitter|linkedin).*share|addthis|addtoany|shareaholic|sumo-share")
    links = some(lambda n: _link(n) & at(n, "href").rlike(r"facebook\.com/sharer|twitter\.com/intent/tweet|linkedin\.com/share"))
    return [("share-buttons", status((words | links, "pass"), other="info"))]


element_rule("a11y/select-name", "error", 8, lambda n: tag(n, "select"), unnamed(dom.FOR_TEXT, dom.LABEL_TEXT, dom.TITLE), "fail")
_toggle = lambda n: role(n, "checkbox", "radio", "switch") | (tag(n, "input") & at(n, "type").isin("checkbox", "radio") & at(n, "role").isNull())
element_rule("a11y/aria-toggle-field-name", "error", 7, _toggle, unnamed(dom.TITLE, dom.TEXT, dom.FOR_TEXT, dom.LABEL_TEXT), "fail", "pass")
element_rule("a11y/table-headers", "warning", 4, lambda n: tag(n, "table") & ~role(n, "presentation", "none"), lambda n: ~F.array_contains(n["holds"], "th"), "warn")
element_rule("content/meta-in-body", "error", 8, lambda n: tag(n, "meta"), lambda n: named(n, dom.IN_BODY), "fail", "pass")


@rule("a11y/landmark-regions", "warning", 3)
def landmark_regions(o: dict) -> Checks:
    mains = count(lambda n: tag(n, "main") | role(n, "main"))
    return [
        ("landmark-main", status((mains == 1, "pass"), other="warn")),
        ("landmark-nav", status((some(lambda n: tag(n, "nav") | role(n, "navigation")), "pass"), other="info")),
        ("landmark-footer", status((some(lambda n: tag(n, "footer") | role(n, "contentinfo")), "pass"), other="info")),
    ]


_sourced = lambda n: tag(n, "img") & at(n, "src").isNotNull()


@rule("images/lazy-loading", "info", 3)
def lazy_loading(o: dict) -> Checks:
    images = some(lambda n: tag(n, "img"))
    lazy = some(lambda n: tag(n, "img", "iframe") & (at(n, "loading") == "lazy"))
    silent = some(lambda n: tag(n, "img") & ~F.coalesce(at(n, "loading").isin("lazy", "eager"), F.lit(False)))
    return [("lazy-loading", status((~images, "skipped"), (lazy, "pass"), other="info")), ("lazy-loading-missing", status((images & lazy & silent, "info")))]


@rule("images/srcset", "info", 3)
def srcset(o: dict) -> Checks:
    bare = some(lambda n: _sourced(n) & at(n, "srcset").isNull())
    several = some(lambda n: (_sourced(n) & at(n, "srcset").isNotNull()) | tag(n, "picture"))
    return [("srcset", status((~some(_sourced), "skipped"), (several & ~bare, "pass"), other="info"))]


#: fixed values: names that cameras, phones and tools give
_POOR = r"(?i)^(?:img[_-]?\d|dsc[_-]?\d|dcim[_-]?\d|p\d{6,}|image\d|photo\d|pic\d|screenshot|screen[_-]?shot|untitled|\d{8,}|[a-f0-9]{32}|[a-f0-9-]{36})"


@rule("images/filename-quality", "info", 2)
def filename_quality(o: dict) -> Checks:
    file = lambda n: F.element_at(F.split(F.element_at(F.split(at(n, "src"), "/"), -1), r"\?"), 1)
    judged = lambda n: _sourced(n) & ~at(n, "src").startswith("data:") & ~file(n).endswith(".svg")
    stem = lambda n: F.regexp_replace(file(n), r"\.[^.]+$", "")
    poor, good = some(lambda n: judged(n) & stem(n).rlike(_POOR)), some(lambda n: judged(n) & (stem(n) != ""))
    return [("filename-quality", status((~some(_sourced), "skipped"), (poor, "info"), (good, "pass")))]


@rule("images/modern-format", "info", 3)
def modern_format(o: dict) -> Checks:
    new = r"\.webp|\.avif"
    src = lambda n: F.lower(at(n, "src"))
    modern = some(
        lambda n: (_sourced(n) & src(n).rlike(new)) | (tag(n, "source") & at(n, "srcset").isNotNull() & (F.lower(at(n, "srcset")).rlike(new) | F.coalesce(low(n, "type").rlike("webp|avif"), F.lit(False))))
    )
    old = some(lambda n: _sourced(n) & ~src(n).rlike(new) & src(n).rlike(r"\.jpg|\.jpeg|\.png|\.gif"))
    return [("modern-format", status((~some(_sourced), "skipped"), (modern & ~old, "pass"), (modern | old, "info")))]


@rule("mobile/viewport-zoom", "error", 7)
def viewport_zoom(o: dict) -> Checks:
    v = _viewport()
    return [("viewport-zoom", status((v.isNull(), "skipped"), (v.rlike(r"(?i)user-scalable\s*=\s*(?:no|0)|maximum-scale\s*=\s*1(?:\.0)?(?![0-9])"), "fail"), other="pass"))]


@rule("analytics/gtm-present", "info", 3)
def gtm_present(o: dict) -> Checks:
    inline = F.col("html").rlike(r"googletagmanager\.com|gtm\.js|gtag/js|analytics\.js|ga\.js")
    scripts = some(lambda n: tag(n, "script") & at(n, "src").rlike(r"plausible|fathom|matomo|piwik|segment|mixpanel|amplitude|heap|hotjar|clarity\.ms"))
    return [("gtm-present", status((inline | scripts, "pass"), other="info"))]


@rule("crawl/pagination", "warning", 4)
def pagination(o: dict) -> Checks:
    paged = lambda u: u.rlike(r"(?i)[?&](?:page|p|pg|offset|start)=") | U.path(u).rlike(r"/page/\d+/?$")
    links = some(lambda n: tag(n, "link") & at(n, "rel").isin("next", "prev") & at(n, "href").isNotNull())
    c = _canonical()
    here = F.coalesce(paged(address()), F.lit(False))
    return [
        ("pagination", status((~here & ~links, "skipped"))),
        ("pagination-canonical", status((here & c.isNotNull() & ~paged(_whole(c)), "warn"), (here & c.isNotNull(), "pass"))),
        ("pagination-links", status((links | here, "info"))),
    ]


@rule("i18n/hreflang", "warning", 3)
def hreflang(o: dict) -> Checks:
    alternate = lambda n: tag(n, "link") & (at(n, "rel") == "alternate") & at(n, "hreflang").isNotNull()
    any_ = some(alternate)
    default = some(lambda n: alternate(n) & (at(n, "hreflang") == "x-default"))
    own = some(lambda n: alternate(n) & (_whole(at(n, "href")) == _whole(address())))
    return [("hreflang-xdefault", status((any_ & ~default, "warn"))), ("hreflang-self", status((any_ & ~own, "warn"))), ("hreflang", status((any_, "pass"), other="info"))]
