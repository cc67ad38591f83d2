"""HTML pages to nested rows: one tolerant parse per page, in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = (
    "url string, title string, description string, canonical string, robots string, lang string, charset string, "
    "h1 array<string>, headings array<struct<level:int,text:string>>, "
    "links array<struct<href:string,text:string,internal:boolean,nofollow:boolean>>, "
    "images array<struct<src:string,alt:string>>, scripts array<string>, stylesheets array<string>, "
    "og map<string,string>, twitter map<string,string>, schema_types array<string>, json_ld_errors int, "
    "text string, word_count int, elements int"
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIP = {"script", "style", "noscript", "template", "svg"}
#: an open element of the key ends where one of these begins
CLOSES = {"p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "form"}, "li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


def json_ld_types(raw: str) -> list[str]:
    """All @type values of a JSON-LD text, through lists and @graph; ValueError if it is no JSON."""
    out: list[str] = []
    todo = [json.loads(raw)]
    while todo:
        x = todo.pop(0)
        if isinstance(x, list):
            todo += x
        elif isinstance(x, dict):
            t = x.get("@type")
            out += [t] if isinstance(t, str) else [y for y in t if isinstance(y, str)] if isinstance(t, list) else []
            todo += x.get("@graph", []) if isinstance(x.get("@graph"), list) else []
    return out


class Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.host = url, (urlsplit(url).hostname or "") if url else ""
        self.stack: list[str] = []
        self.text: list[str] = []
        self.title = self.description = self.canonical = self.robots = self.lang = self.charset = None
        self.headings, self.links, self.images, self.scripts, self.styles = [], [], [], [], []
        self.og, self.twitter, self.types = {}, {}, []
        self.errors = self.elements = 0
        self.open: list[tuple[str, dict, list[str]]] = []

    def _resolve(self, href: str) -> str | None:
        try:
            return urljoin(self.url, href.strip())
        except ValueError:
            return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        self.elements += 1
        while self.stack and tag in CLOSES.get(self.stack[-1], ()):
            self.handle_endtag(self.stack[-1])
        if tag == "html":
            self.lang = self.lang or a.get("lang") or None
        elif tag == "base" and a.get("href"):
            self.url = self._resolve(a["href"]) or self.url
        elif tag == "meta":
            name, content = (a.get("name") or a.get("property") or "").lower(), a.get("content")
            self.charset = self.charset or a.get("charset") or None
            if name == "description" and self.description is None:
                self.description = content
            elif name == "robots" and self.robots is None:
                self.robots = content
            elif name.startswith("og:") and content is not None:
                self.og.setdefault(name[3:], content)
            elif name.startswith("twitter:") and content is not None:
                self.twitter.setdefault(name[8:], content)
        elif tag == "link" and a.get("href"):
            rel = a.get("rel", "").lower().split()
            if "canonical" in rel and self.canonical is None:
                self.canonical = self._resolve(a["href"])
            elif "stylesheet" in rel:
                self.styles.append(self._resolve(a["href"]))
        elif tag == "img":
            src = a.get("data-src") or a.get("src") or ""
            if src and not src.startswith("data:"):
                self.images.append({"src": self._resolve(src), "alt": a.get("alt")})
        elif tag == "script" and a.get("src"):
            self.scripts.append(self._resolve(a["src"]))
        if tag not in VOID:
            self.stack.append(tag)
            if tag in ("title", "a", "script") or re.fullmatch("h[1-6]", tag):
                self.open.append((tag, a, []))

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        while self.stack:
            done = self.stack.pop()
            if self.open and self.open[-1][0] == done:
                self._close(*self.open.pop())
            if done == tag:
                break

    def _close(self, tag: str, a: dict, parts: list[str]) -> None:
        text = " ".join("".join(parts).split())
        if tag == "title":
            self.title = self.title if self.title is not None else text
        elif tag == "script":
            if a.get("type", "").lower() == "application/ld+json":
                try:
                    self.types += json_ld_types("".join(parts))
                except ValueError:
                    self.errors += 1
        elif tag == "a":
            href = self._resolve(a["href"]) if a.get("href") else None
            if href and urlsplit(href).scheme in ("http", "https"):
                self.links.append({"href": href, "text": text, "internal": urlsplit(href).hostname == self.host, "nofollow": "nofollow" in a.get("rel", "").lower().split()})
        else:
            self.headings.append({"level": int(tag[1]), "text": text})

    def handle_data(self, data: str) -> None:
        for _, _, parts in self.open:
            parts.append(data)
        if not SKIP.intersection(self.stack) and "title" not in self.stack:
            self.text.append(data)

    def row(self) -> dict:
        text = " ".join(" ".join(self.text).split())
        return {
            "title": self.title, "description": self.description, "canonical": self.canonical, "robots": self.robots, "lang": self.lang, "charset": self.charset,
            "h1": [h["text"] for h in self.headings if h["level"] == 1], "headings": self.headings, "links": self.links, "images": self.images,
            "scripts": self.scripts, "stylesheets": self.styles, "og": self.og, "twitter": self.twitter, "schema_types": list(dict.fromkeys(self.types)),
            "json_ld_errors": self.errors, "text": text, "word_count": len(text.split()), "elements": self.elements,
        }


def parse(url: str | None, html: str | None) -> dict:
    p = Page(url or "")
    p.feed(html or "")
    p.close()
    while p.stack:
        p.handle_endtag(p.stack[-1])
    return {"url": url} | p.row()


def parsed(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One wide row per page; a null page is an empty one, and broken markup never fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([parse(u, h) for u, h in zip(b["url"], b["html"])], columns=[c.split()[0] for c in re.split(r", (?=\w+ \w)", SCHEMA)])

    return pages.selectExpr(f"{url} as url", f"{html} as html").mapInPandas(run, SCHEMA)
