"""Catalogue pages: listing rows, link lists, PDF links and kept text, parsed once per page in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
KEPT = frozenset("h1 h2 h3 h4 h5 p a".split())


class _Node:
    __slots__ = ("attrs", "items", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.items = tag, attrs, []

    def walk(self) -> Iterator[_Node]:
        for x in self.items:
            if isinstance(x, _Node):
                yield x
                yield from x.walk()

    def strings(self) -> Iterator[str]:
        for x in self.items:
            if isinstance(x, str):
                if x.strip():
                    yield x.strip()
            elif x.tag not in ("script", "style"):
                yield from x.strings()

    def text(self, between: str = "") -> str:
        return between.join(self.strings())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].items.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].items.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        if any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.open[-1].items.append(data)


def tree(page: str | None) -> _Node:
    t = _Tree()
    t.feed(page or "")
    t.close()
    return t.root


def kept_text(page: str | None) -> str:
    """Headings, paragraphs and links of article, else main, else body; headings marked."""
    root = tree(page)
    nodes = list(root.walk())
    main = next((n for tag in ("article", "main", "body") for n in nodes if n.tag == tag), None)
    if main is None:
        return ""
    parts = [(n, n.text()) for n in main.walk() if n.tag in KEPT]
    return " ".join(f"\n## {t}" if n.tag[0] == "h" else t for n, t in parts if t).strip()


def pdf_link(page: str | None, url: str) -> str | None:
    """The first link that opens a window if it carries the PDF icon, else the first one that ends in .pdf."""
    links = [n for n in tree(page).walk() if n.tag == "a" and "href" in n.attrs]
    first = next((n for n in links if n.attrs.get("target") == "_blank"), None)
    if first is not None and any(n.tag == "span" and "fa-file-pdf-o" in n.attrs.get("class", "").split() for n in first.walk()):
        return urljoin(url, first.attrs["href"])
    return next((urljoin(url, n.attrs["href"]) for n in links if n.attrs["href"].lower().endswith(".pdf")), None)


def listing_rows(page: str | None, url: str, path: str) -> list[dict]:
    """Rows of the search results; without any, the distinct links whose address contains `path`."""
    nodes = list(tree(page).walk())
    results = [n for n in nodes if n.tag == "div" and "search-result" in n.attrs.get("class", "").split()]
    rows: list[dict] = []
    for n in results:
        name = next((h.text() for h in n.walk() if h.tag == "h5"), "")
        link = next((urljoin(url, a.attrs["href"]) for a in n.walk() if a.tag == "a" and "href" in a.attrs), "")
        if not name or not link:
            continue
        row = {"name": name, "link": link, "visible_text": n.text(" "), "species": None, "form": None, "active": None}
        for line in map(str.strip, row["visible_text"].split("\n")):
            low = line.lower()
            field = next((f for f, words in LINE_WORDS if any(w in low for w in words)), None) if low else None
            if field:
                row[field] = line
        rows.append(row)
    if results:
        return rows
    seen: dict[str, dict] = {}
    for a in nodes:
        link = urljoin(url, a.attrs["href"]) if a.tag == "a" and "href" in a.attrs else ""
        if path in link:
            name = a.text() or "Sem nome"
            seen.setdefault(name, {"name": name, "link": link, "visible_text": name, "species": None, "form": None, "active": None})
    return list(seen.values())


# Words that tell what a line of a search result is about; the first field with a word takes the line.
LINE_WORDS = [
    ("species", ["espécie", "especie", "animal"]),
    ("form", ["forma", "apresentação", "apresentacao"]),
    ("active", ["princípio", "principio", "substância", "substancia", "ativo"]),
]
LISTING = "name string, link string, visible_text string, species string, form string, active string"


def parse_listings(pages: DataFrame, key: str, html: str, url: str, path: str) -> DataFrame:
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *r.values()) for k, h, u in zip(pdf[key], pdf[html], pdf[url]) for i, r in enumerate(listing_rows(h, u or "", path))]
            yield pd.DataFrame(rows, columns=[key, "ord", "name", "link", "visible_text", "species", "form", "active"])

    return pages.select(key, html, url).mapInPandas(run, f"{key} {kind}, ord int, {LISTING}")


def page_texts(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """(key, text, pdf_url): kept text and resolved PDF link of each page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, kept_text(h), pdf_link(h, u or "")) for k, h, u in zip(pdf[key], pdf[html], pdf[url])]
            yield pd.DataFrame(rows, columns=[key, "text", "pdf_link"])

    return pages.where(F.col(html).isNotNull()).select(key, html, url).mapInPandas(run, f"{key} {kind}, text string, pdf_link string")
