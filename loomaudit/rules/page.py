"""Page rules over nodes, address and headers of a parsed page, each an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomaudit.functions import url as U
from loomaudit.rules.engine import Checks, rule
from loomaudit.sources import dom

def nodes() -> Column:
    return F.col("nodes")


def address() -> Column:
    return F.col("url")


def at(n: Column, name: str) -> Column:
    return F.try_element_at(n["attrs"], F.lit(name))


def low(n: Column, name: str) -> Column:
    return F.lower(F.trim(at(n, name)))


def has(n: Column, *names: str) -> Column:
    """Whether an attribute holds more than white space."""
    out = F.lit(False)
    for name in names:
        out = out | (F.coalesce(F.trim(at(n, name)), F.lit("")) != "")
    return out


def tag(n: Column, *names: str) -> Column:
    return n["tag"].isin(*names)


def role(n: Column, *names: str) -> Column:
    return F.coalesce(at(n, "role").isin(*names), F.lit(False))


def named(n: Column, *bits: int) -> Column:
    mask = 0
    for b in bits:
        mask |= b
    return n["names"].bitwiseAND(F.lit(mask)) != 0


def count(test) -> Column:
    return F.size(F.filter(nodes(), lambda n: F.coalesce(test(n), F.lit(False))))


def some(test) -> Column:
    return F.exists(nodes(), lambda n: F.coalesce(test(n), F.lit(False)))


def first(test, value) -> Column:
    return F.try_element_at(F.transform(F.filter(nodes(), lambda n: F.coalesce(test(n), F.lit(False))), value), F.lit(1))


def header(name: str) -> Column:
    return F.try_element_at(F.col("headers"), F.lit(name))


def status(*cases: tuple[Column, str], other: str | None = None) -> Column:
    """The status of the first case that holds."""
    out = None
    for test, s in cases:
        test = F.coalesce(test, F.lit(False))
        out = F.when(test, F.lit(s)) if out is None else out.when(test, F.lit(s))
    return out.otherwise(F.lit(other))


def flawed(name: str, which, flaw, worst: str, none: str | None = "info") -> Checks:
    """One check: ``worst`` if some of the elements have the flaw, pass if none of them has it, ``none`` if there are no such elements."""
    bad = some(lambda n: which(n) & F.coalesce(flaw(n), F.lit(False)))
    return [(name, status((bad, worst), (some(which), "pass"), other=none))]


def element_rule(id: str, severity: str, weight: int, which, flaw, worst: str, none: str | None = "info", name: str | None = None) -> None:
    rule(id, severity, weight)(lambda options: flawed(name or id.split("/")[1], which, flaw, worst, none))


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
hidden = lambda n: F.coalesce(at(n, "aria-hidden") == "true", F.lit(False))
decorative = lambda n: hidden(n) | role(n, "presentation", "none")
unnamed = lambda *bits: lambda n: ~named(n, dom.LABEL, dom.LABELLED, *bits)
# language codes of two or three letters pass, listed or not
code = lambda c: c.rlike(r"^[a-z]{2,3}(?:-|$)")

# accessibility: elements that need a name, a place or a value
element_rule("a11y/aria-hidden-body", "error", 10, lambda n: tag(n, "html", "body"), hidden, "fail", "pass")
element_rule("a11y/frame-title", "error", 7, lambda n: tag(n, "iframe", "frame"), lambda n: ~decorative(n) & ~has(n, "title", "aria-label", "aria-labelledby"), "fail")
element_rule("a11y/object-alt", "warning", 6, lambda n: tag(n, "object"), lambda n: ~decorative(n) & ~has(n, "aria-label", "aria-labelledby") & ~named(n, dom.TEXT), "warn")
element_rule("a11y/input-image-alt", "error", 8, lambda n: tag(n, "input") & (at(n, "type") == "image"), lambda n: ~has(n, "alt", "aria-label", "aria-labelledby"), "fail")
_button = lambda n: tag(n, "button") | role(n, "button") | (tag(n, "input") & at(n, "type").isin("button", "submit", "reset"))
element_rule("a11y/button-name", "error", 8, _button, unnamed(dom.TITLE, dom.TEXT, dom.VALUE, dom.IMAGE, dom.SVG, dom.INNER), "fail")
element_rule(
    "a11y/empty-heading", "warning", 5, lambda n: tag(n, *HEADINGS), lambda n: ~hidden(n) & ~named(n, dom.TEXT, dom.LABEL, dom.LABELLED, dom.IMAGE), "warn"
)
element_rule("a11y/listitem", "error", 7, lambda n: tag(n, "li"), lambda n: ~F.coalesce(n["ptag"].isin("ul", "ol", "menu"), F.lit(False)) & ~F.coalesce(n["prole"] == "list", F.lit(False)), "fail")
element_rule("a11y/dlitem", "error", 7, lambda n: tag(n, "dt", "dd"), lambda n: ~F.coalesce((n["ptag"] == "dl") | ((n["ptag"] == "div") & (n["pptag"] == "dl")), F.lit(False)), "fail")
element_rule("a11y/valid-lang", "warning", 5, lambda n: ~tag(n, "html") & at(n, "lang").isNotNull(), lambda n: ~code(low(n, "lang")), "warn")
element_rule("a11y/aria-meter-name", "error", 7, lambda n: role(n, "meter") | (tag(n, "meter") & at(n, "role").isNull()), unnamed(dom.TITLE, dom.FOR_TEXT), "fail")
element_rule("a11y/aria-progressbar-name", "error", 7, lambda n: role(n, "progressbar") | (tag(n, "progress") & at(n, "role").isNull()), unnamed(dom.TITLE, dom.FOR_TEXT), "fail")
element_rule("a11y/aria-tooltip-name", "error", 7, lambda n: role(n, "tooltip"), unnamed(dom.TEXT), "fail")
element_rule("a11y/aria-treeitem-name", "error", 7, lambda n: role(n, "treeitem"), unnamed(dom.TEXT, dom.IMAGE), "fail")
_command = lambda n: role(n, "button", "link", "menuitem") | (at(n, "role").isNull() & (tag(n, "button") | (tag(n, "a") & at(n, "href").isNotNull())))
element_rule("a11y/aria-command-name", "error", 7, _command, unnamed(dom.TITLE, dom.TEXT, dom.IMAGE, dom.SVG), "fail", "pass")
_field = lambda n: tag(n, "textarea", "select") | (tag(n, "input") & ~F.coalesce(at(n, "type").isin("hidden", "submit", "button", "reset", "image"), F.lit(False)))
_attr = lambda n, k: F.coalesce(at(n, k), F.lit("")) != ""
element_rule("a11y/form-labels", "error", 6, _field, lambda n: ~named(n, dom.IN_LABEL, dom.FOR) & ~_attr(n, "aria-label") & ~_attr(n, "aria-labelledby") & ~_attr(n, "title"), "fail")
#: fixed values: roles that are abstract or withdrawn
DEPRECATED = ["directory", "command", "composite", "input", "landmark", "range", "roletype", "section", "sectionhead", "select", "structure", "widget", "window"]
element_rule(
    "a11y/aria-deprecated-role", "error", 6, lambda n: at(n, "role").isNotNull(), lambda n: F.arrays_overlap(F.split(low(n, "role"), r"\s+"), F.array(*map(F.lit, DEPRECATED))), "fail"
)


def _list_rule(id: str, lists: tuple[str, ...], flaw) -> None:
    rule(id, "error", 7)(lambda o: [(id.split("/")[1], status((some(flaw), "fail"), (some(lambda n: tag(n, *lists)), "pass"), other="info"))])


_list_rule("a11y/list-structure", ("ul", "ol"), lambda n: n["ptag"].isin("ul", "ol") & ~tag(n, "li", "script", "template") & ~role(n, "listitem"))
_list_rule(
    "a11y/definition-list", ("dl",),
    lambda n: ((n["ptag"] == "dl") & ~tag(n, "dt", "dd", "div")) | ((n["ptag"] == "div") & (n["pptag"] == "dl") & ~tag(n, "dt", "dd")),
)


@rule("a11y/accesskeys", "warning", 4)
def accesskeys(o: dict) -> Checks:
    keys = F.filter(F.transform(nodes(), lambda n: F.lower(at(n, "accesskey"))), lambda k: k.isNotNull() & (k != ""))
    twice = F.size(keys) > F.size(F.array_distinct(keys))
    any_ = some(lambda n: at(n, "accesskey").isNotNull())
    return [("accesskeys-unique", status((twice, "warn"))), ("accesskeys", status((twice, None), (any_, "pass"), other="info"))]


@rule("a11y/meta-refresh", "error", 7)
def meta_refresh(o: dict) -> Checks:
    refresh = lambda n: tag(n, "meta") & (F.lower(at(n, "http-equiv")) == "refresh")
    content = first(refresh, lambda n: F.coalesce(at(n, "content"), F.lit("")))
    seconds = F.regexp_extract(content, r"^\s*([+-]?\d+)", 1).try_cast("int")
    goes = F.lower(content).contains("url=")
    return [
        ("meta-refresh-redirect", status((goes & (seconds == 0), "warn"), (goes, "fail"))),
        ("meta-refresh-auto", status((goes, None), ((seconds > 0) & (seconds < 20), "fail"), (seconds > 0, "warn"))),
        ("meta-refresh", status((content.isNull(), "pass"))),
    ]


def _viewport() -> Column:
    return first(lambda n: tag(n, "meta") & (at(n, "name") == "viewport"), lambda n: F.coalesce(at(n, "content"), F.lit("")))


@rule("a11y/zoom-disabled", "error", 7, options={"least_maximum": 5.0})
def zoom_disabled(o: dict) -> Checks:
    v = _viewport()
    most = F.regexp_extract(v, r"(?i)maximum-scale\s*=\s*([\d.]+)", 1).try_cast("double")
    least = F.regexp_extract(v, r"(?i)minimum-scale\s*=\s*([\d.]+)", 1).try_cast("double")
    bad = v.rlike(r"(?i)user-scalable\s*=\s*(?:no|0|false)") | F.coalesce(most < o["least_maximum"], F.lit(False)) | F.coalesce(least > 1, F.lit(False))
    return [("zoom-disabled", status((v.isNull(), "info"), (bad, "fail"), other="pass"))]


@rule("a11y/tabindex", "warning", 5)
def tabindex(o: dict) -> Checks:
    value = lambda n: F.regexp_extract(F.coalesce(at(n, "tabindex"), F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("int")
    high, positive = some(lambda n: value(n) > 100), some(lambda n: (value(n) > 0) & (value(n) <= 100))
    any_ = some(lambda n: at(n, "tabindex").isNotNull())
    return [
        ("tabindex-very-high", status((high, "fail"))), ("tabindex-positive", status((positive, "warn"))),
        ("tabindex", status((high | positive, None), (any_, "pass"), other="info")),
    ]


def _html(name: str) -> Column:
    return F.nullif(first(lambda n: tag(n, "html"), lambda n: at(n, name)), F.lit(""))


@rule("a11y/html-lang-valid", "error", 7)
def html_lang_valid(o: dict) -> Checks:
    lang = _html("lang")
    return [("html-has-lang", status((lang.isNull(), "fail"))), ("html-lang-valid", status((lang.isNull(), None), (code(F.lower(F.trim(lang))), "pass"), other="fail"))]


@rule("a11y/html-xml-lang-mismatch", "error", 6)
def html_xml_lang(o: dict) -> Checks:
    a, b = (F.nullif(F.lower(F.trim(_html(k))), F.lit("")) for k in ("lang", "xml:lang"))
    base = lambda c: F.element_at(F.split(c, "-"), 1)
    return [
        ("html-xml-lang-mismatch", status((a.isNotNull() & b.isNotNull() & (base(a) != base(b)), "fail"), (a != b, "warn"), (a == b, "pass"), (b.isNotNull() & a.isNull(), "warn"), other="info"))
    ]


@rule("a11y/heading-order", "warning", 4)
def heading_order(o: dict) -> Checks:
    levels = F.transform(F.filter(nodes(), lambda n: tag(n, *HEADINGS)), lambda n: F.substring(n["tag"], 2, 1).cast("int"))
    skips = F.exists(F.sequence(F.lit(1), F.greatest(F.size(levels) - 1, F.lit(1))), lambda i: F.coalesce(F.try_element_at(levels, i + 1) > F.try_element_at(levels, i) + 1, F.lit(False)))
    return [("heading-order", status((F.size(levels) == 0, "info"), (skips, "warn"), other="pass"))]


@rule("a11y/landmark-one-main", "warning", 5)
def landmark_one_main(o: dict) -> Checks:
    n = count(lambda x: tag(x, "main") | role(x, "main"))
    return [("landmark-one-main", status((n == 0, "warn"), (n == 1, "pass"), other="fail"))]


_captioned = lambda n: F.array_contains(n["holds"], "track+")


@rule("a11y/video-captions", "warning", 5)
def video_captions(o: dict) -> Checks:
    videos = some(lambda n: tag(n, "video"))
    embeds = some(lambda n: tag(n, "iframe") & at(n, "src").rlike("youtube|vimeo|wistia"))
    return [
        ("video-captions", status((some(lambda n: tag(n, "video") & ~_captioned(n)), "warn"), (videos, "pass"), (~embeds, "info"))),
        ("video-embeds", status((embeds, "info"))),
    ]


@rule("a11y/aria-dialog-name", "error", 7)
def aria_dialog_name(o: dict) -> Checks:
    aria = lambda n: role(n, "dialog", "alertdialog")
    native = lambda n: tag(n, "dialog") & ~aria(n)
    bare = unnamed(dom.TITLE)
    any_ = some(lambda n: aria(n) | native(n))
    return [
        ("aria-dialog-name", status((~any_, "info"), (some(lambda n: aria(n) & bare(n)), "fail"), (some(aria), "pass"))),
        ("dialog-name", status((some(lambda n: native(n) & bare(n)), "warn"), (some(native), "pass"))),
    ]


@rule("a11y/duplicate-id-aria", "error", 8)
def duplicate_id_aria(o: dict) -> Checks:
    refs = ["aria-labelledby", "aria-describedby", "aria-controls", "aria-owns", "aria-activedescendant", "aria-flowto", "aria-details", "aria-errormessage"]
    ids = F.filter(F.transform(nodes(), lambda n: at(n, "id")), lambda k: k.isNotNull() & (k != ""))
    used = F.array_distinct(F.filter(F.flatten(F.transform(nodes(), lambda n: F.split(F.concat_ws(" ", *(at(n, r) for r in refs)), r"\s+"))), lambda k: k != ""))
    bad = F.exists(used, lambda k: F.size(F.filter(ids, lambda x: x == k)) != 1)
    return [("duplicate-id-aria", status((bad, "fail"), (F.size(used) > 0, "pass"), other="info"))]


#: fixed values: link texts that say nothing of their target
GENERIC = (
    "click here|here|read more|learn more|more|link|click|this|go|see more|continue|details|view|download|visit|open|access|get|start|begin|sign up|signup|register|subscribe|join|login|log in|sign in"
    "|next|previous|back|forward|skip|submit|send|buy|shop|order|buy now|shop now|order now|info|information|find out|find out more|see details|view details|full details|website|page|site"
    "|check it out|discover|explore"
).split("|")


@rule("a11y/link-text", "warning", 4)
def link_text(o: dict) -> Checks:
    links = lambda n: tag(n, "a") & at(n, "href").isNotNull()
    judged = lambda n: links(n) & ~F.ltrim(at(n, "href")).startswith("#") & ~at(n, "href").rlike(r"(?i)^\s*(?:javascript|data|vbscript):")
    own = lambda n: F.coalesce(F.nullif(F.trim(at(n, "aria-label")), F.lit("")), F.nullif(F.trim(at(n, "title")), F.lit("")), n["text"])
    generic = lambda n: judged(n) & ~named(n, dom.LABELLED) & F.trim(F.regexp_replace(F.lower(own(n)), r"""[.,!?;:'"]+""", "")).isin(GENERIC)
    empty = lambda n: judged(n) & ~named(n, dom.LABELLED, dom.LABEL, dom.TITLE, dom.TEXT, dom.IMAGE, dom.SVG)
    e, g = some(empty), some(generic)
    return [("link-text-empty", status((e, "fail"))), ("link-text-generic", status((g, "warn"))), ("link-text", status((e | g, None), (some(links), "pass")))]


# core
def _meta(name: str) -> Column:
    return first(lambda n: tag(n, "meta") & (low(n, "name") == name), lambda n: at(n, "content"))


def _property(name: str) -> Column:
    return F.nullif(first(lambda n: tag(n, "meta") & ((low(n, "property") == name) | (low(n, "name") == name)), lambda n: at(n, "content")), F.lit(""))


@rule("core/charset", "warning", 5)
def charset(o: dict) -> Checks:
    is_meta = lambda n: tag(n, "meta") & at(n, "charset").isNotNull()
    own = F.nullif(first(is_meta, lambda n: at(n, "charset")), F.lit(""))
    in_content = lambda c: F.nullif(F.regexp_extract(c, r"(?i)charset=([^\s;]+)", 1), F.lit(""))
    equiv = in_content(first(lambda n: tag(n, "meta") & (low(n, "http-equiv") == "content-type"), lambda n: at(n, "content")))
    said = F.coalesce(own, equiv, in_content(header("content-type")))
    head = F.filter(nodes(), lambda n: n["ptag"] == "head")
    child = lambda k: F.try_element_at(head, F.lit(k))
    early = is_meta(child(1)) | ((child(1)["tag"] == "title") & is_meta(child(2)))
    utf8 = said.rlike(r"(?i)^utf-?8$")
    return [("charset", status((said.isNull(), "fail"), (~utf8, "warn"), (first(is_meta, lambda n: n["tag"]).isNull(), "pass"), (early, "pass"), other="warn"))]


@rule("core/doctype", "warning", 5)
def doctype(o: dict) -> Checks:
    h = F.regexp_replace(F.regexp_replace(F.col("html"), "^[﻿￾\u0000]", ""), r"(?i)^<\?xml[^>]*\?>", "")
    empty = F.coalesce(F.col("html"), F.lit("")) == ""
    return [("doctype", status((empty, "skipped"), (h.rlike(r"(?i)^\s*<!DOCTYPE\s+html\s*>"), "pass"), (h.rlike(r"(?i)<!DOCTYPE[^>]*>"), "warn"), other="fail"))]


@rule("core/favicon", "warning", 3)
def favicon(o: dict) -> Checks:
    icon = lambda n: tag(n, "link") & at(n, "rel").contains("icon") & _attr(n, "href")
    apple = some(lambda n: icon(n) & at(n, "rel").contains("apple-touch-icon"))
    return [("favicon", status((some(icon), "pass"), other="warn")), ("apple-touch-icon", status((some(icon) & ~apple, "info")))]


@rule("core/h1", "error", 7)
def h1(o: dict) -> Checks:
    n = count(lambda x: tag(x, "h1"))
    text = first(lambda x: tag(x, "h1"), lambda x: x["text"])
    return [("h1", status((n == 0, "fail"), (n > 1, "warn"), (F.coalesce(text, F.lit("")) == "", "warn"), other="pass"))]


@rule("core/og-tags", "warning", 5)
def og_tags(o: dict) -> Checks:
    have = {k: _property(f"og:{k}") for k in ("title", "description", "image", "type")}
    missing = [(f"og-{k}", status((v.isNull(), "info" if k == "type" else "warn"))) for k, v in have.items()]
    whole = have["title"].isNotNull() & have["description"].isNotNull() & have["image"].isNotNull()
    return [*missing, ("og-tags", status((whole, "pass")))]


@rule("core/twitter-cards", "info", 3)
def twitter_cards(o: dict) -> Checks:
    card = _property("twitter:card")
    og = _property("og:title").isNotNull() & _property("og:description").isNotNull()
    bare = (card == "summary_large_image") & _property("twitter:image").isNull() & _property("og:image").isNull()
    return [
        ("twitter-card", status((card.isNull() & og, "info"), (card.isNull(), "warn"), (~card.isin("summary", "summary_large_image", "app", "player"), "warn"), (bare, "warn"), other="pass"))
    ]


@rule("core/robots-meta", "warning", 5)
def robots_meta(o: dict) -> Checks:
    r = F.lower(_meta("robots"))
    return [("robots-meta", status((r.contains("noindex"), "warn"), (r.contains("nofollow"), "info"), other="pass"))]


@rule("core/nosnippet", "warning", 7)
def nosnippet(o: dict) -> Checks:
    d = F.split(F.coalesce(F.lower(_meta("robots")), F.lit("")), r"[,\s]+")
    none = F.array_contains(d, "nosnippet") | F.exists(d, lambda x: x.rlike(r"^max-snippet:0$"))
    return [("nosnippet", status((none, "warn"), (F.exists(d, lambda x: x.startswith("max-snippet:")), "info"), other="pass"))]


# images
_image = lambda n: tag(n, "img") & (_attr(n, "src") | _attr(n, "data-src")) & ~F.coalesce(at(n, "data-src"), at(n, "src")).startswith("data:")
element_rule("images/dimensions", "warning", 4, _image, lambda n: ~_attr(n, "width") | ~_attr(n, "height"), "warn", "pass", "image-dimensions")
element_rule("images/picture-element", "error", 6, lambda n: tag(n, "picture"), lambda n: ~F.array_contains(n["holds"], "img"), "fail", "skipped")


@rule("images/alt-text", "error", 5)
def alt_text(o: dict) -> Checks:
    missing = some(lambda n: _image(n) & ~has(n, "alt"))
    return [("alt-text-missing", status((missing, "fail"))), ("alt-text", status((missing, None), other="pass"))]


@rule("images/figure-figcaption", "info", 2)
def figure_figcaption(o: dict) -> Checks:
    figures = some(lambda n: tag(n, "figure"))
    loose = some(lambda n: tag(n, "img") & ~named(n, dom.IN_FIGURE))
    bare = some(lambda n: tag(n, "figure") & ~F.array_contains(n["holds"], "figcaption+"))
    return [("figure-figcaption", status((~figures & ~loose, "skipped"), (bare, "info"), (figures, "pass"))), ("figure-usage", status((loose & ~figures, "info")))]


# security
@rule("security/https", "error", 8)
def https(o: dict) -> Checks:
    return [("https", status((U.scheme(address()) == "https", "pass"), other="fail"))]


@rule("security/x-content-type", "warning", 3)
def x_content_type(o: dict) -> Checks:
    h = header("x-content-type-options")
    return [("x-content-type", status((F.lower(h) == "nosniff", "pass"), (h != "", "warn"), other="info"))]


@rule("security/x-frame-options", "warning", 5)
def x_frame_options(o: dict) -> Checks:
    h = F.nullif(F.upper(header("x-frame-options")), F.lit(""))
    guarded = header("content-security-policy").contains("frame-ancestors")
    return [("x-frame-options", status((h.isin("DENY", "SAMEORIGIN"), "pass"), (h.contains("ALLOW-FROM"), "warn"), (h.isNotNull(), None), (guarded, "pass"), other="warn"))]


@rule("security/referrer-policy", "info", 3)
def referrer_policy(o: dict) -> Checks:
    p = F.transform(F.split(F.lower(F.coalesce(header("referrer-policy"), F.lit(""))), ","), lambda x: F.trim(x))
    safe = F.arrays_overlap(p, F.array(*map(F.lit, ["no-referrer", "same-origin", "strict-origin", "strict-origin-when-cross-origin"])))
    return [("referrer-policy", status((F.array_contains(p, "unsafe-url"), "warn"), (safe, "pass"), other="info"))]


@rule("security/permissions-policy", "info", 2)
def permissions_policy(o: dict) -> Checks:
    return [("permissions-policy", status((header("permissions-policy") != "", "pass"), other="info"))]


def _absolute(href: Column) -> Column:
    """The host of an address; that of the page for relative ones."""
    return F.when(href.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"), U.host(F.regexp_replace(href, r"^//", "https://"))).otherwise(U.host(address()))


@rule("security/new-tab", "warning", 4)
def new_tab(o: dict) -> Checks:
    out = lambda n: tag(n, "a") & _attr(n, "href") & (at(n, "target") == "_blank") & (_absolute(F.trim(at(n, "href"))) != U.host(address()))
    rel = lambda n: F.coalesce(F.lower(at(n, "rel")), F.lit(""))
    any_ = some(out)
    return [
        ("noopener", status((some(lambda n: out(n) & ~rel(n).contains("noopener")), "warn"), (any_, "pass"))),
        ("noreferrer", status((some(lambda n: out(n) & ~rel(n).contains("noreferrer")), "info"), (any_, "pass"))),
        ("new-tab-security", status((~any_, "info"))),
    ]


@rule("security/form-https", "error", 6)
def form_https(o: dict) -> Checks:
    secure = U.scheme(address()) == "https"
    goes = lambda n: (tag(n, "form") & at(n, "action").isNotNull()) | (
        at(n, "formaction").isNotNull() & ((tag(n, "button") & ~F.coalesce(low(n, "type").isin("button", "reset"), F.lit(False))) | (tag(n, "input") & low(n, "type").isin("submit", "image")))
    )
    target = lambda n: F.lower(F.trim(F.when(tag(n, "form"), at(n, "action")).otherwise(at(n, "formaction"))))
    clear = lambda n: goes(n) & (target(n).startswith("http://") | (target(n).startswith("//") & ~secure))
    return [("form-https", status((some(clear) & secure, "fail"), (some(clear), "warn"), (some(goes), "pass"), other="info"))]


@rule("security/mixed-content", "error", 7)
def mixed_content(o: dict) -> Checks:
    clear = lambda n: (
        (tag(n, "img", "script", "iframe", "video", "audio", "source", "embed") & at(n, "src").startswith("http://"))
        | (tag(n, "link") & at(n, "href").startswith("http://")) | (tag(n, "object") & at(n, "data").startswith("http://"))
    )
    return [("mixed-content", status((~address().startswith("https:"), "info"), (some(clear), "fail"), other="pass"))]


@rule("links/https-downgrade", "warning", 5)
def https_downgrade(o: dict) -> Checks:
    return [("https-downgrade", status((U.scheme(address()) != "https", "info"), (some(lambda n: tag(n, "a") & at(n, "href").startswith("http://")), "warn"), other="pass"))]


@rule("i18n/lang-attribute", "warning", 4)
def lang_attribute(o: dict) -> Checks:
    lang = _html("lang")
    return [("lang-attribute", status((lang.isNull(), "warn"), (lang.rlike(r"^[a-z]{2}(-[A-Z]{2})?$"), "pass"), other="info"))]


@rule("mobile/viewport", "error", 8)
def viewport(o: dict) -> Checks:
    v = _viewport()
    return [("viewport", status((v.isNull(), "fail"), (~v.contains("width=device-width"), "warn"), (~v.contains("initial-scale="), "info"), other="pass"))]


@rule("video/video-accessible", "warning", 4)
def video_accessible(o: dict) -> Checks:
    n, good = count(lambda x: tag(x, "video")), count(lambda x: tag(x, "video") & _captioned(x))
    return [("video-accessible", status((n == 0, "info"), (good == n, "pass"), (good > 0, "info"), other="warn"))]


# addresses
@rule("url/parameters", "info", 3, options={"excessive": 3})
def parameters(o: dict) -> Checks:
    names = F.transform(F.filter(F.split(U.query(address()), "&"), lambda q: q != ""), lambda q: F.lower(F.element_at(F.split(q, "="), 1)))
    tracking = F.arrays_overlap(names, F.array(*map(F.lit, ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source"])))
    return [("url-parameters", status((F.size(names) == 0, "pass"), (F.size(names) > o["excessive"], "warn"), other="info")), ("tracking-parameters", status((tracking, "info")))]


@rule("url/special-chars", "warning", 4)
def special_chars(o: dict) -> Checks:
    p = U.path(address())
    plain = F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
    bad = p.contains("%20") | plain.rlike(r"[\s%&=#\[\]{}|\\^~`<>]|[^\x20-\x7E]")
    return [("url-special-chars", status((bad, "warn"), other="pass")), ("url-double-slash", status((p.contains("//"), "warn")))]


@rule("url/trailing-slash", "info", 3)
def trailing_slash(o: dict) -> Checks:
    p = U.path(address())
    return [("trailing-slash", status((p.rlike(r"(?i)\.[a-z0-9]{2,4}$"), "pass"), other="info"))]


#: fixed values: words that say nothing in an address
STOP_WORDS = "a an and are as at be by for from has have in is it of on or that the to was were will with this but they your our their which would there what".split()


@rule("url/stop-words", "info", 2)
def stop_words(o: dict) -> Checks:
    n = F.size(F.filter(F.split(F.lower(U.path(address())), "[-_/]"), lambda w: w.isin(STOP_WORDS)))
    return [("url-stop-words", status((n > 2, "info"), other="pass"))]


@rule("url/slug-keywords", "info", 3)
def slug_keywords(o: dict) -> Checks:
    s = U.segments(address())
    last, before = F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit("")), F.lower(F.try_element_at(s, F.lit(-2)))
    words = F.filter(F.split(last, "[-_]"), lambda w: F.length(w) > 2)
    return [
        (
            "slug-keywords",
            status(
                (before.isin("page", "pages", "p") & last.rlike(r"^\d+$"), "pass"), (last.rlike(r"(?i)^\d+$|^[a-f0-9]{8,}$|^(?:page|post|item|product|article|node)-?\d+$"), "warn"),
                (last.rlike(r"(?i)^[a-z0-9]{1,3}$") & ~last.rlike("(?i)[aeiou]{2}"), "info"), (F.size(words) > 0, "pass"), other="info",
            ),
        )
    ]


@rule("crawl/html-size", "warning", 5, options={"warn_bytes": 1024 * 1024, "error_bytes": 2 * 1024 * 1024})
def html_size(o: dict) -> Checks:
    n = F.octet_length(F.coalesce(F.col("html"), F.lit("")))
    return [("html-size", status((n >= o["error_bytes"], "fail"), (n >= o["warn_bytes"], "warn"), other="pass"))]
