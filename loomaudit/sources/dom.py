"""HTML pages as arrays of nodes: one tolerant parse per page, in Arrow batches, so that rules over markup are expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from loomaudit.sources.html import CLOSES, VOID

NODE = "i:int,tag:string,attrs:map<string,string>,ptag:string,prole:string,pptag:string,text:string,names:int,holds:array<string>,depth:int,kids:int"
SCHEMA = f"url string, html string, headers map<string,string>, nodes array<struct<{NODE}>>"
#: bits of ``names``: what gives a node its name for assistive technology, and where it stands
LABEL, LABELLED, TITLE, TEXT, VALUE, IMAGE, SVG, INNER, FOR, FOR_TEXT, IN_LABEL, IN_FIGURE, IN_HEAD, IN_BODY, LABEL_TEXT = (1 << k for k in range(15))
#: elements whose text is kept, and whose descendants' names are
TEXTS = {"a", "button", "h1", "h2", "h3", "h4", "h5", "h6", "label", "title", "caption", "figcaption", "script", "th", "summary", "legend", "option"}
HOLDERS = {"picture", "figure", "video", "audio", "a", "button", "table", "form", "nav"}


class Nodes(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.stack: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        while self.stack and tag in CLOSES.get(self.stack[-1]["tag"], ()):
            self.stack.pop()
        n = {"i": len(self.nodes), "tag": tag, "attrs": a, "parent": self.stack[-1] if self.stack else None, "said": [], "holds": set(), "open": list(self.stack)}
        for up in self.stack:
            up["holds"].add(tag)
        self.nodes.append(n)
        if tag not in VOID:
            self.stack.append(n)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("path", "circle", "rect", "use", "line", "polygon", "g"):
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        if any(n["tag"] == tag for n in self.stack):
            while self.stack.pop()["tag"] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if data.strip():
            for n in self.stack:
                n["said"].append(data)

    def rows(self) -> list[dict]:
        text = {id(n): " ".join("".join(n["said"]).split()) for n in self.nodes}
        by_id: dict[str, dict] = {}
        for n in self.nodes:
            if key := n["attrs"].get("id"):
                by_id.setdefault(key, n)
        labels: dict[str, bool] = {}
        for n in self.nodes:
            if n["tag"] == "label" and (key := n["attrs"].get("for")):
                labels[key] = labels.get(key, False) or bool(text[id(n)])
        out = []
        for n in self.nodes:
            a = n["attrs"]
            bits = LABEL * bool(a.get("aria-label", "").strip()) | TITLE * bool(a.get("title", "").strip()) | TEXT * bool(text[id(n)]) | VALUE * bool(a.get("value", "").strip())
            bits |= LABELLED * any(k in by_id and text[id(by_id[k])] for k in a.get("aria-labelledby", "").split())
            key = a.get("id")
            bits |= FOR * (key in labels) | FOR_TEXT * labels.get(key, False)
            up = {u["tag"] for u in n["open"]}
            bits |= IN_LABEL * ("label" in up) | IN_FIGURE * ("figure" in up) | IN_HEAD * ("head" in up) | IN_BODY * ("body" in up)
            bits |= LABEL_TEXT * any(u["tag"] == "label" and text[id(u)] for u in n["open"])
            n["names"] = bits
        for n in self.nodes:
            a, mark = n["attrs"], 0
            if n["tag"] == "img" and a.get("alt", "").strip():
                mark |= IMAGE
            if n["tag"] == "title" and any(u["tag"] == "svg" for u in n["open"]) and text[id(n)]:
                mark |= SVG
            if a.get("aria-label", "").strip():
                mark |= INNER
            for u in n["open"]:
                u["names"] |= mark
                if n["tag"] == "figcaption" and text[id(n)]:
                    u["holds"].add("figcaption+")
                if n["tag"] == "track" and a.get("kind") in ("captions", "subtitles"):
                    u["holds"].add("track+")
        kids: dict[int, int] = {}
        for n in self.nodes:
            if n["parent"]:
                kids[n["parent"]["i"]] = kids.get(n["parent"]["i"], 0) + 1
        for n in self.nodes:
            p = n["parent"]
            out.append(
                {
                    "i": n["i"], "tag": n["tag"], "attrs": n["attrs"], "ptag": p and p["tag"], "prole": p and p["attrs"].get("role"),
                    "pptag": p and p["parent"] and p["parent"]["tag"], "text": text[id(n)] if n["tag"] in TEXTS else None, "names": n["names"],
                    "holds": sorted(n["holds"]) if n["tag"] in HOLDERS else [],
                    "depth": len(n["open"]) + 1, "kids": kids.get(n["i"], 0),
                }
            )
        return out


def nodes_of(html: str | None) -> list[dict]:
    p = Nodes()
    p.feed(html or "")
    p.close()
    return p.rows()


def parsed(pages: DataFrame, url: str = "url", html: str = "html", headers: str | None = None) -> DataFrame:
    """SCHEMA of each page; a null page has no nodes, null headers are none, header names come in lower case, broken markup never fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, h, {k.lower(): v for k, v in (dict(x) if x is not None else {}).items()}, nodes_of(h)) for u, h, x in zip(b["url"], b["html"], b["headers"])]
            yield pd.DataFrame(rows, columns=["url", "html", "headers", "nodes"])

    given = headers or "cast(map() as map<string,string>)"
    return pages.selectExpr(f"{url} as url", f"{html} as html", f"{given} as headers").mapInPandas(run, SCHEMA)
