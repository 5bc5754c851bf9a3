"""HTML pages: visible text, links, and text of chosen elements, by the standard library's parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "noscript", "template"}


def parse_selector(selector: str) -> list[tuple[str, str, str]]:
    """Comma-separated simple selectors: tag, .class, #id, tag.class, tag#id."""
    out = []
    for one in selector.split(","):
        one = one.strip()
        tag, name, key = one, "", ""
        for mark, kind in ((".", "class"), ("#", "id")):
            if mark in one:
                tag, name = one.split(mark, 1)
                key = kind
        out.append((tag, key, name))
    return out


class Page(HTMLParser):
    def __init__(self, selector: str | None = None):
        super().__init__(convert_charrefs=True)
        self.wanted = parse_selector(selector) if selector else None
        self.stack: list[tuple[str, bool]] = []
        self.parts: list[str] = []
        self.links: list[str] = []
        self.inside = 0
        self.hidden = 0

    def hit(self, tag: str, attrs: dict) -> bool:
        return any((not t or t == tag) and (not key or name in (attrs.get(key) or "").split()) for t, key, name in self.wanted or [])

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        hit = self.hit(tag, own)
        if tag == "a" and own.get("href") and (self.wanted is None or self.inside or hit):
            self.links.append(own["href"])
        if tag in VOID:
            return
        self.stack.append((tag, hit))
        self.inside += hit
        self.hidden += tag in HIDDEN

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, hit = self.stack.pop()
            self.inside -= hit
            self.hidden -= t in HIDDEN
            if t == tag:
                break

    def handle_data(self, data):
        if not self.hidden and (self.wanted is None or self.inside) and data.strip():
            self.parts.append(data.strip())


def page_text(html: str | None, selector: str | None = None, separator: str = " ") -> str:
    page = Page(selector)
    page.feed(html or "")
    page.close()
    return separator.join(page.parts)


def page_links(html: str | None, base: str | None, selector: str | None = None) -> list[str]:
    """Absolute links in order, each once."""
    page = Page(selector)
    page.feed(html or "")
    page.close()
    return list(dict.fromkeys(urljoin(base or "", link) for link in page.links))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", selector: str | None = None, link_selector: str | None = None) -> DataFrame:
    """id, page_text, links of every page."""
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "page_text": [page_text(h, selector) for h in b[html_col]], "links": [page_links(h, u, link_selector) for h, u in zip(b[html_col], b[url_col], strict=True)]})

    return pages.select(id_col, url_col, html_col).mapInPandas(run, f"`{id_col}` {kind}, page_text string, links array<string>")
