"""Small pages and what each rule says of them, written down from the rules' descriptions: (rule, checks, markup, address, headers)."""

from __future__ import annotations

_PAGE = "https://shop.example/guides/copper-kettles"
_BARE = "<html><body><p>Hello</p></body></html>"


def _case(rule: str, checks: str, markup: str, address: str = _PAGE, **headers: str) -> tuple[str, str, str, str, dict[str, str]]:
    return rule, checks, markup, address, {k.replace("_", "-"): v for k, v in headers.items()}


CASES = [
    _case("a11y/accesskeys", "accesskeys-unique=warn", "<a accesskey=k href=/a>A</a><button accesskey=K>B</button>"),
    _case("a11y/accesskeys", "accesskeys=pass", "<a accesskey=k href=/a>A</a>"),
    _case("a11y/accesskeys", "accesskeys=info", _BARE),
    _case("a11y/aria-hidden-body", "aria-hidden-body=fail", "<html><body aria-hidden=true>x</body></html>"),
    _case("a11y/aria-hidden-body", "aria-hidden-body=pass", _BARE),
    _case("a11y/frame-title", "frame-title=fail", "<iframe src=/map></iframe><iframe title=Map src=/m></iframe>"),
    _case("a11y/frame-title", "frame-title=pass", "<iframe title=Map></iframe><iframe role=none></iframe>"),
    _case("a11y/frame-title", "frame-title=info", _BARE),
    _case("a11y/object-alt", "object-alt=warn", "<object data=/a.pdf></object>"),
    _case("a11y/object-alt", "object-alt=pass", "<object data=/a.pdf>The price list</object>"),
    _case("a11y/input-image-alt", "input-image-alt=fail", "<input type=image src=/go.png>"),
    _case("a11y/input-image-alt", "input-image-alt=pass", "<input type=image src=/go.png alt=Go>"),
    _case("a11y/button-name", "button-name=fail", "<button><i class=x></i></button>"),
    _case("a11y/button-name", "button-name=pass", "<button><img src=/a.png alt=Search></button><input type=submit value=Go><span id=t>Menu</span><div role=button aria-labelledby=t></div>"),
    _case("a11y/button-name", "button-name=info", _BARE),
    _case("a11y/empty-heading", "empty-heading=warn", "<h2> </h2><h1>Kettles</h1>"),
    _case("a11y/empty-heading", "empty-heading=pass", "<h1><img src=/l.png alt=Logo></h1>"),
    _case("a11y/listitem", "listitem=fail", "<div><li>A</li></div>"),
    _case("a11y/listitem", "listitem=pass", "<ul><li>A<li>B</ul><div role=list><li>C</li></div>"),
    _case("a11y/dlitem", "dlitem=fail", "<div><dt>A</dt></div>"),
    _case("a11y/dlitem", "dlitem=pass", "<dl><div><dt>A</dt><dd>B</dd></div><dt>C</dt></dl>"),
    _case("a11y/valid-lang", "valid-lang=warn", "<p lang=english1>x</p>"),
    _case("a11y/valid-lang", "valid-lang=pass", "<p lang=de-AT>x</p>"),
    _case("a11y/valid-lang", "valid-lang=info", "<html lang=e><p>x</p></html>"),
    _case("a11y/aria-meter-name", "aria-meter-name=fail", "<meter value=1></meter>"),
    _case("a11y/aria-meter-name", "aria-meter-name=pass", "<label for=m>Level</label><meter id=m value=1></meter>"),
    _case("a11y/aria-progressbar-name", "aria-progressbar-name=fail", "<div role=progressbar></div>"),
    _case("a11y/aria-progressbar-name", "aria-progressbar-name=pass", "<progress aria-label=Loading></progress>"),
    _case("a11y/aria-tooltip-name", "aria-tooltip-name=fail", "<div role=tooltip></div>"),
    _case("a11y/aria-tooltip-name", "aria-tooltip-name=pass", "<div role=tooltip>More</div>"),
    _case("a11y/aria-treeitem-name", "aria-treeitem-name=fail", "<div role=treeitem title=x></div>"),
    _case("a11y/aria-treeitem-name", "aria-treeitem-name=pass", "<div role=treeitem>Leaf</div>"),
    _case("a11y/aria-command-name", "aria-command-name=fail", "<a href=/x></a>"),
    _case("a11y/aria-command-name", "aria-command-name=pass", "<a href=/x>Shop</a><button title=Go></button><a></a>"),
    _case("a11y/form-labels", "form-labels=fail", "<input name=q>"),
    _case("a11y/form-labels", "form-labels=pass", "<label>Q <input name=q></label><label for=s></label><select id=s></select><input type=hidden><textarea title=T></textarea>"),
    _case("a11y/form-labels", "form-labels=info", "<input type=submit>"),
    _case("a11y/aria-deprecated-role", "aria-deprecated-role=fail", "<ul role='list Directory'></ul>"),
    _case("a11y/aria-deprecated-role", "aria-deprecated-role=pass", "<ul role=list></ul>"),
    _case("a11y/list-structure", "list-structure=fail", "<ul><div>A</div></ul>"),
    _case("a11y/list-structure", "list-structure=pass", "<ol><li>A</li><script></script><div role=listitem>B</div></ol>"),
    _case("a11y/definition-list", "definition-list=fail", "<dl><div><p>A</p></div></dl>"),
    _case("a11y/definition-list", "definition-list=pass", "<dl><dt>A</dt><dd><p>B</p></dd></dl>"),
    _case("a11y/meta-refresh", "meta-refresh-redirect=warn", "<meta http-equiv=Refresh content='0; URL=/x'>"),
    _case("a11y/meta-refresh", "meta-refresh-redirect=fail", "<meta http-equiv=refresh content='5;url=/x'>"),
    _case("a11y/meta-refresh", "meta-refresh-auto=fail", "<meta http-equiv=refresh content=19>"),
    _case("a11y/meta-refresh", "meta-refresh-auto=warn", "<meta http-equiv=refresh content=20>"),
    _case("a11y/meta-refresh", "meta-refresh=pass", _BARE),
    _case("a11y/zoom-disabled", "zoom-disabled=fail", "<meta name=viewport content='width=device-width, maximum-scale=4.9'>"),
    _case("a11y/zoom-disabled", "zoom-disabled=fail", "<meta name=viewport content='user-scalable = no'>"),
    _case("a11y/zoom-disabled", "zoom-disabled=pass", "<meta name=viewport content='maximum-scale=5'>"),
    _case("a11y/zoom-disabled", "zoom-disabled=info", _BARE),
    _case("a11y/tabindex", "tabindex-very-high=fail tabindex-positive=warn", "<a tabindex=101>A</a><a tabindex=1>B</a>"),
    _case("a11y/tabindex", "tabindex=pass", "<a tabindex=-1>A</a><a tabindex=0>B</a>"),
    _case("a11y/tabindex", "tabindex=info", _BARE),
    _case("a11y/html-lang-valid", "html-has-lang=fail", _BARE),
    _case("a11y/html-lang-valid", "html-lang-valid=pass", "<html lang=pt-BR></html>"),
    _case("a11y/html-lang-valid", "html-lang-valid=fail", "<html lang=english></html>"),
    _case("a11y/html-xml-lang-mismatch", "html-xml-lang-mismatch=fail", "<html lang=en xml:lang=de></html>"),
    _case("a11y/html-xml-lang-mismatch", "html-xml-lang-mismatch=warn", "<html lang=en xml:lang=en-GB></html>"),
    _case("a11y/html-xml-lang-mismatch", "html-xml-lang-mismatch=warn", "<html xml:lang=en></html>"),
    _case("a11y/html-xml-lang-mismatch", "html-xml-lang-mismatch=pass", "<html lang=en xml:lang=EN></html>"),
    _case("a11y/html-xml-lang-mismatch", "html-xml-lang-mismatch=info", "<html lang=en></html>"),
    _case("a11y/heading-order", "heading-order=warn", "<h1>A</h1><h3>B</h3>"),
    _case("a11y/heading-order", "heading-order=pass", "<h2>A</h2><h3>B</h3><h1>C</h1><h2>D</h2>"),
    _case("a11y/heading-order", "heading-order=info", _BARE),
    _case("a11y/landmark-one-main", "landmark-one-main=warn", _BARE),
    _case("a11y/landmark-one-main", "landmark-one-main=pass", "<main>x</main>"),
    _case("a11y/landmark-one-main", "landmark-one-main=fail", "<main>x</main><div role=main>y</div>"),
    _case("a11y/video-captions", "video-captions=warn", "<video src=/a.mp4></video>"),
    _case("a11y/video-captions", "video-captions=pass video-embeds=info", "<video><track kind=captions></video><iframe src=https://player.vimeo.example/vimeo/1></iframe>"),
    _case("a11y/video-captions", "video-captions=info", _BARE),
    _case("a11y/aria-dialog-name", "aria-dialog-name=fail dialog-name=warn", "<div role=dialog>x</div><dialog>y</dialog>"),
    _case("a11y/aria-dialog-name", "aria-dialog-name=pass", "<h2 id=h>Basket</h2><div role=alertdialog aria-labelledby=h>x</div>"),
    _case("a11y/aria-dialog-name", "aria-dialog-name=info", _BARE),
    _case("a11y/duplicate-id-aria", "duplicate-id-aria=fail", "<p aria-describedby='a b'></p><i id=a></i><i id=b></i><b id=b></b>"),
    _case("a11y/duplicate-id-aria", "duplicate-id-aria=fail", "<p aria-controls=gone></p>"),
    _case("a11y/duplicate-id-aria", "duplicate-id-aria=pass", "<p aria-describedby=a></p><i id=a></i><i id=c></i><i id=c></i>"),
    _case("a11y/duplicate-id-aria", "duplicate-id-aria=info", _BARE),
    _case("a11y/link-text", "link-text-empty=fail link-text-generic=warn", "<a href=/a></a><a href=/b>Read more!</a>"),
    _case("a11y/link-text", "link-text-generic=warn", "<a href=/a aria-label='Click here'>Copper kettles</a>"),
    _case("a11y/link-text", "link-text=pass", "<a href=/a>Copper kettles</a><a href='#top'></a>"),
    _case("core/charset", "charset=pass", "<html><head><meta charset=UTF-8><title>x</title></head></html>"),
    _case("core/charset", "charset=pass", "<html><head><title>x</title><meta charset=utf8></head></html>"),
    _case("core/charset", "charset=warn", "<html><head><title>x</title><meta name=a><meta charset=utf-8></head></html>"),
    _case("core/charset", "charset=warn", "<html><head><meta charset=latin1></head></html>"),
    _case("core/charset", "charset=pass", _BARE, content_type="text/html; charset=utf-8"),
    _case("core/charset", "charset=fail", _BARE),
    _case("core/doctype", "doctype=pass", "﻿<!doctype HTML><html></html>"),
    _case("core/doctype", "doctype=warn", "<p></p><!DOCTYPE html>"),
    _case("core/doctype", "doctype=fail", _BARE),
    _case("core/doctype", "doctype=skipped", ""),
    _case("core/favicon", "favicon=warn", _BARE),
    _case("core/favicon", "favicon=pass apple-touch-icon=info", "<link rel=icon href=/f.ico>"),
    _case("core/favicon", "favicon=pass", "<link rel=apple-touch-icon href=/a.png>"),
    _case("core/h1", "h1=fail", _BARE),
    _case("core/h1", "h1=warn", "<h1>A</h1><h1>B</h1>"),
    _case("core/h1", "h1=warn", "<h1></h1>"),
    _case("core/h1", "h1=pass", "<h1>A</h1>"),
    _case("core/og-tags", "og-title=warn og-description=warn og-image=warn og-type=info", _BARE),
    _case("core/og-tags", "og-type=info og-tags=pass", "<meta property=og:title content=A><meta property=og:description content=B><meta property=og:image content=/c.png>"),
    _case("core/twitter-cards", "twitter-card=warn", _BARE),
    _case("core/twitter-cards", "twitter-card=info", "<meta property=og:title content=A><meta property=og:description content=B>"),
    _case("core/twitter-cards", "twitter-card=warn", "<meta name=twitter:card content=big>"),
    _case("core/twitter-cards", "twitter-card=warn", "<meta name=twitter:card content=summary_large_image>"),
    _case("core/twitter-cards", "twitter-card=pass", "<meta name=twitter:card content=summary>"),
    _case("core/robots-meta", "robots-meta=warn", "<meta name=robots content='NOINDEX, nofollow'>"),
    _case("core/robots-meta", "robots-meta=info", "<meta name=robots content=nofollow>"),
    _case("core/robots-meta", "robots-meta=pass", _BARE),
    _case("core/nosnippet", "nosnippet=warn", "<meta name=robots content='index, max-snippet:0'>"),
    _case("core/nosnippet", "nosnippet=info", "<meta name=robots content='max-snippet:50'>"),
    _case("core/nosnippet", "nosnippet=pass", _BARE),
    _case("images/dimensions", "image-dimensions=warn", "<img src=/a.png width=10>"),
    _case("images/dimensions", "image-dimensions=pass", "<img src=/a.png width=10 height=10>"),
    _case("images/dimensions", "image-dimensions=pass", _BARE),
    _case("images/picture-element", "picture-element=fail", "<picture><source srcset=/a.webp></picture>"),
    _case("images/picture-element", "picture-element=pass", "<picture><source srcset=/a.webp><img src=/a.png></picture>"),
    _case("images/picture-element", "picture-element=skipped", _BARE),
    _case("images/alt-text", "alt-text-missing=fail", "<img src=/a.png alt=' '>"),
    _case("images/alt-text", "alt-text=pass", "<img src=/a.png alt=Kettle>"),
    _case("images/figure-figcaption", "figure-figcaption=info", "<figure><img src=/a.png></figure>"),
    _case("images/figure-figcaption", "figure-figcaption=pass", "<figure><img src=/a.png><figcaption>A kettle</figcaption></figure><img src=/b.png>"),
    _case("images/figure-figcaption", "figure-usage=info", "<img src=/b.png>"),
    _case("images/figure-figcaption", "figure-figcaption=skipped", _BARE),
    _case("security/https", "https=pass", _BARE),
    _case("security/https", "https=fail", _BARE, "http://shop.example/"),
    _case("security/x-content-type", "x-content-type=pass", _BARE, x_content_type_options="NoSniff"),
    _case("security/x-content-type", "x-content-type=warn", _BARE, x_content_type_options="none"),
    _case("security/x-content-type", "x-content-type=info", _BARE),
    _case("security/x-frame-options", "x-frame-options=pass", _BARE, x_frame_options="sameorigin"),
    _case("security/x-frame-options", "x-frame-options=warn", _BARE, x_frame_options="ALLOW-FROM https://a.example"),
    _case("security/x-frame-options", "x-frame-options=pass", _BARE, content_security_policy="frame-ancestors 'none'"),
    _case("security/x-frame-options", "x-frame-options=warn", _BARE),
    _case("security/referrer-policy", "referrer-policy=warn", _BARE, referrer_policy="no-referrer, unsafe-url"),
    _case("security/referrer-policy", "referrer-policy=pass", _BARE, referrer_policy="Same-Origin"),
    _case("security/referrer-policy", "referrer-policy=info", _BARE, referrer_policy="origin"),
    _case("security/permissions-policy", "permissions-policy=pass", _BARE, permissions_policy="camera=()"),
    _case("security/permissions-policy", "permissions-policy=info", _BARE),
    _case("security/new-tab", "noopener=warn noreferrer=info", "<a href=https://other.example/ target=_blank>x</a>"),
    _case("security/new-tab", "noopener=pass noreferrer=pass", "<a href=//other.example/ target=_blank rel='noopener noreferrer'>x</a>"),
    _case("security/new-tab", "new-tab-security=info", "<a href=/own target=_blank>x</a>"),
    _case("security/form-https", "form-https=fail", "<form action=http://shop.example/send></form>"),
    _case("security/form-https", "form-https=warn", "<form action=//shop.example/send></form>", "http://shop.example/"),
    _case("security/form-https", "form-https=pass", "<form action=/send></form>"),
    _case("security/form-https", "form-https=info", "<form></form>"),
    _case("security/mixed-content", "mixed-content=fail", "<script src=http://a.example/x.js></script>"),
    _case("security/mixed-content", "mixed-content=pass", "<a href=http://a.example/>x</a>"),
    _case("security/mixed-content", "mixed-content=info", _BARE, "http://shop.example/"),
    _case("links/https-downgrade", "https-downgrade=warn", "<a href=http://a.example/>x</a>"),
    _case("links/https-downgrade", "https-downgrade=pass", "<a href=/a>x</a>"),
    _case("links/https-downgrade", "https-downgrade=info", _BARE, "http://shop.example/"),
    _case("i18n/lang-attribute", "lang-attribute=warn", _BARE),
    _case("i18n/lang-attribute", "lang-attribute=info", "<html lang=zh-Hans></html>"),
    _case("i18n/lang-attribute", "lang-attribute=pass", "<html lang=en-GB></html>"),
    _case("mobile/viewport", "viewport=fail", _BARE),
    _case("mobile/viewport", "viewport=warn", "<meta name=viewport content='width=980'>"),
    _case("mobile/viewport", "viewport=info", "<meta name=viewport content='width=device-width'>"),
    _case("mobile/viewport", "viewport=pass", "<meta name=viewport content='width=device-width, initial-scale=1'>"),
    _case("video/video-accessible", "video-accessible=info", "<video><track kind=subtitles></video><video></video>"),
    _case("video/video-accessible", "video-accessible=warn", "<video></video>"),
    _case("video/video-accessible", "video-accessible=pass", "<video><track kind=captions></video>"),
    _case("url/parameters", "url-parameters=pass", _BARE),
    _case("url/parameters", "url-parameters=info tracking-parameters=info", _BARE, "https://shop.example/?a=1&UTM_source=x&c"),
    _case("url/parameters", "url-parameters=warn", _BARE, "https://shop.example/?a=1&b=2&c=3&d=4"),
    _case("url/special-chars", "url-special-chars=pass", _BARE),
    _case("url/special-chars", "url-special-chars=warn", _BARE, "https://shop.example/caf%C3%A9"),
    _case("url/special-chars", "url-special-chars=warn url-double-slash=warn", _BARE, "https://shop.example//a%20b"),
    _case("url/trailing-slash", "trailing-slash=info", _BARE, "https://shop.example/a/"),
    _case("url/trailing-slash", "trailing-slash=pass", _BARE, "https://shop.example/a.html"),
    _case("url/stop-words", "url-stop-words=info", _BARE, "https://shop.example/the-best-of-the-year"),
    _case("url/stop-words", "url-stop-words=pass", _BARE, "https://shop.example/the-best"),
    _case("url/slug-keywords", "slug-keywords=pass", _BARE, "https://shop.example/blog/page/12"),
    _case("url/slug-keywords", "slug-keywords=warn", _BARE, "https://shop.example/blog/12"),
    _case("url/slug-keywords", "slug-keywords=warn", _BARE, "https://shop.example/product-12"),
    _case("url/slug-keywords", "slug-keywords=info", _BARE, "https://shop.example/x1"),
    _case("url/slug-keywords", "slug-keywords=pass", _BARE),
    _case("url/slug-keywords", "slug-keywords=info", _BARE, "https://shop.example/"),
    _case("crawl/html-size", "html-size=pass", _BARE),
    _case("crawl/html-size", "html-size=warn", "<p>" + "x" * 1024 * 1024),
    _case("perf/dom-size", "dom-total-nodes=pass dom-depth=pass dom-max-children=pass", _BARE),
    _case("perf/dom-size", "dom-total-nodes=warn dom-depth=pass dom-max-children=warn", "<html><body>" + "<p>x</p>" * 1500 + "</body></html>"),
    _case("perf/dom-size", "dom-total-nodes=pass dom-depth=warn dom-max-children=pass", "<div>" * 33),
    _case("perf/compression", "compression=pass", _BARE, content_type="text/html", content_encoding="BR"),
    _case("perf/compression", "compression=warn", _BARE, content_type="text/html", content_encoding="identity"),
    _case("perf/compression", "compression=warn", _BARE, content_type="text/html", transfer_encoding="chunked"),
    _case("perf/compression", "compression=fail", "<p>" + "x" * 1001, content_type="text/html"),
    _case("perf/compression", "compression=info", _BARE, content_type="image/png"),
    _case("perf/cache-headers", "cache-headers-missing=warn", _BARE),
    _case("perf/cache-headers", "cache-control=info", _BARE, cache_control="no-store, max-age=9"),
    _case("perf/cache-headers", "cache-control=pass", _BARE, cache_control="no-cache", etag="x"),
    _case("perf/cache-headers", "cache-control=warn", _BARE, cache_control="no-cache"),
    _case("perf/cache-headers", "cache-control-html=info", _BARE, cache_control="max-age=3601"),
    _case("perf/cache-headers", "cache-control-html=pass cache-immutable=pass", _BARE, cache_control="public, max-age=60, immutable"),
    _case("perf/cache-headers", "cache-control-static=warn", _BARE, "https://shop.example/a.css", cache_control="max-age=60"),
    _case("perf/cache-headers", "cache-control=warn", _BARE, cache_control="public"),
    _case("perf/cache-headers", "cache-expires=info", _BARE, expires="0"),
    _case("security/hsts", "hsts=pass", _BARE, strict_transport_security="max-age=31536000"),
    _case("security/hsts", "hsts=warn", _BARE, strict_transport_security="max-age=15767999"),
    _case("security/hsts", "hsts=warn", _BARE),
    _case("security/hsts", "hsts=info", _BARE, "http://shop.example/"),
    _case("security/sri", "sri=warn", "<script src=https://cdn.example/x.js></script>"),
    _case("security/sri", "sri=pass", "<link rel='preload stylesheet' href=//cdn.example/x.css integrity=sha384-x>"),
    _case("security/sri", "sri=info", "<script src=/own.js></script>"),
    _case("security/cookie-flags", "cookie-flags=pass", _BARE),
    _case("security/cookie-flags", "cookie-samesite-none-insecure=fail cookie-secure=warn cookie-httponly=warn", _BARE, set_cookie="a=1; SameSite=None"),
    _case("security/cookie-flags", "cookie-samesite=info", _BARE, set_cookie="a=1; Secure; HttpOnly; Expires=Wed, 01 Jan 2025 00:00:00 GMT"),
    _case("security/cookie-flags", "cookie-flags=pass", _BARE, set_cookie="a=1; Secure; HttpOnly; SameSite=Lax, b=2; secure; httponly; samesite=strict"),
    _case("links/nofollow-internal", "nofollow-internal=warn", "<a href=/a rel='NoFollow'>x</a>"),
    _case("links/nofollow-internal", "nofollow-internal=pass", "<a href=https://other.example/ rel=nofollow>x</a>"),
    _case("links/external-links", "external-links=pass", "<a href=https://other.example/>x</a>"),
    _case("links/external-links", "external-links=info", "<a href=/a>x</a>"),
    _case("social/og-url-match", "og-url-match=pass", "<meta property=og:url content=https://shop.example/a/><link rel=canonical href=https://shop.example/a>"),
    _case("social/og-url-match", "og-url-match=warn", "<meta property=og:url content=https://shop.example/b><link rel=canonical href=https://shop.example/a>"),
    _case("social/og-url-match", "og-url-match=info", _BARE),
    _case("social/share-buttons", "share-buttons=pass", "<a href='https://www.linkedin.com/shareArticle?u=x'>x</a>"),
    _case("social/share-buttons", "share-buttons=pass", "<div class=addtoany></div>"),
    _case("social/share-buttons", "share-buttons=info", _BARE),
    _case("a11y/select-name", "select-name=fail", "<label for=s></label><select id=s></select>"),
    _case("a11y/select-name", "select-name=pass", "<label>Size <select><option>L</option></select></label>"),
    _case("a11y/select-name", "select-name=info", _BARE),
    _case("a11y/aria-toggle-field-name", "aria-toggle-field-name=fail", "<input type=checkbox><span role=switch>Dark</span>"),
    _case("a11y/aria-toggle-field-name", "aria-toggle-field-name=pass", "<label>Yes <input type=radio></label>"),
    _case("a11y/landmark-regions", "landmark-main=warn landmark-nav=info landmark-footer=info", _BARE),
    _case("a11y/landmark-regions", "landmark-main=pass landmark-nav=pass landmark-footer=pass", "<nav></nav><main></main><div role=contentinfo></div>"),
    _case("a11y/table-headers", "table-headers=warn", "<table><tr><td>1</td></tr></table>"),
    _case("a11y/table-headers", "table-headers=pass", "<table><tr><th>A</th></tr></table><table role=none></table>"),
    _case("a11y/table-headers", "table-headers=info", _BARE),
    _case("images/lazy-loading", "lazy-loading=pass lazy-loading-missing=info", "<img src=/a.png loading=lazy><img src=/b.png>"),
    _case("images/lazy-loading", "lazy-loading=info", "<img src=/a.png loading=eager>"),
    _case("images/lazy-loading", "lazy-loading=skipped", _BARE),
    _case("images/srcset", "srcset=pass", "<img src=/a.png srcset='/a2.png 2x'>"),
    _case("images/srcset", "srcset=info", "<img src=/a.png>"),
    _case("images/srcset", "srcset=skipped", _BARE),
    _case("images/filename-quality", "filename-quality=info", "<img src=/p/IMG_2041.jpg>"),
    _case("images/filename-quality", "filename-quality=pass", "<img src=/p/copper-kettle.jpg?v=2>"),
    _case("images/filename-quality", "filename-quality=skipped", _BARE),
    _case("images/modern-format", "modern-format=pass", "<img src=/a.webp>"),
    _case("images/modern-format", "modern-format=info", "<img src=/a.jpg>"),
    _case("images/modern-format", "modern-format=skipped", _BARE),
    _case("mobile/viewport-zoom", "viewport-zoom=fail", "<meta name=viewport content='maximum-scale=1.0'>"),
    _case("mobile/viewport-zoom", "viewport-zoom=pass", "<meta name=viewport content='maximum-scale=10'>"),
    _case("mobile/viewport-zoom", "viewport-zoom=skipped", _BARE),
    _case("analytics/gtm-present", "gtm-present=pass", "<script src=https://plausible.example/p.js></script>"),
    _case("analytics/gtm-present", "gtm-present=info", _BARE),
    _case("core/canonical", "canonical=pass", "<link rel=canonical href=https://shop.example/guides/copper-kettles>"),
    _case("core/canonical", "canonical=pass", "<link rel=canonical href=https://SHOP.example>", "https://shop.example/"),
    _case("core/canonical", "canonical=info", "<link rel=canonical href=https://shop.example/other>"),
    _case("core/canonical", "canonical=warn", _BARE),
    _case("crawl/pagination", "pagination=skipped", _BARE),
    _case("crawl/pagination", "pagination-canonical=warn pagination-links=info", "<link rel=canonical href=/blog>", "https://shop.example/blog?page=2"),
    _case("crawl/pagination", "pagination-canonical=pass pagination-links=info", "<link rel=canonical href=/blog/page/2/><link rel=next href=/blog/page/3/>", "https://shop.example/blog/page/2/"),
    _case("crawl/pagination", "pagination-links=info", "<link rel=next href=/b>"),
    _case("i18n/hreflang", "hreflang-xdefault=warn hreflang-self=warn hreflang=pass", "<link rel=alternate hreflang=de href=https://shop.example/de>"),
    _case("i18n/hreflang", "hreflang=pass", "<link rel=alternate hreflang=x-default href=https://shop.example/guides/copper-kettles>"),
    _case("i18n/hreflang", "hreflang=info", _BARE),
    _case("content/meta-in-body", "meta-in-body=fail", "<html><body><meta name=robots content=noindex></body></html>"),
    _case("content/meta-in-body", "meta-in-body=pass", "<html><head><meta name=a></head></html>"),
]
