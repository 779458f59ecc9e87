"""Web pages parsed once: text lines, metadata, links, headings, scripts, addresses and marked images per page."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
SILENT = frozenset(("script", "style", "noscript", "template"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: Pages that a worker holds as Python objects at once.
PAGES_AT_ONCE = 50
HEADINGS = frozenset(("h1", "h2", "h3"))
LINK_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "strong"))

PARSED = """page_id long, url string, title string, description string, site_name string, lines array<string>, headings array<string>,
links array<struct<href: string, label: string>>, jsonld array<string>, addresses array<array<string>>, logos array<string>, n_scripts int"""
TYPES = [
    ("page_id", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("description", pa.string()), ("site_name", pa.string()), ("lines", pa.list_(pa.string())),
    ("headings", pa.list_(pa.string())), ("links", pa.list_(pa.struct([("href", pa.string()), ("label", pa.string())]))), ("jsonld", pa.list_(pa.string())),
    ("addresses", pa.list_(pa.list_(pa.string()))), ("logos", pa.list_(pa.string())), ("n_scripts", pa.int32()),
]


def squeeze(text: str) -> str:
    return " ".join(text.split())


class Page(HTMLParser):
    """Collects the parts; a text line is one run of text between two tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.metas = None, {}
        self.lines, self.headings, self.links, self.jsonld, self.addresses, self.logos = [], [], [], [], [], []
        self.n_scripts, self.silent = 0, 0
        self.open: list[tuple[str, bool]] = []  # element, and whether it or one around it is marked as client or logo
        self.link: dict | None = None
        self.kept: list[str] | None = None
        self.script: list[str] | None = None
        self.heading: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in attrs}
        named, number = own.get("class", "").lower(), own.get("id", "").lower()
        marked = "client" in named or "logo" in named or "client" in number or bool(self.open and self.open[-1][1])
        if tag == "meta":
            self.metas.setdefault(own.get("name") or own.get("property") or "", own.get("content", ""))
        elif tag == "img" and marked and own.get("alt"):
            self.logos.append(squeeze(own["alt"]))
        if tag in VOID:
            return
        self.open.append((tag, marked))
        if tag in SILENT:
            self.silent += 1
        if tag == "script":
            self.n_scripts += 1
            self.script = [] if own.get("type") == "application/ld+json" else None
        elif tag == "a":
            self.link = {"href": own.get("href", ""), "title": squeeze(own.get("title", "")), "texts": [], "heading": None}
        elif tag == "address":
            self.addresses.append([])
        if tag in HEADINGS:
            self.heading = []
        if self.link is not None and tag in LINK_HEADINGS and not self.link["heading"]:
            self.link["heading"] = ""

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            last = self.open.pop()[0]
            self.closed(last)
            if last == tag:
                return

    def closed(self, tag):
        if tag in SILENT:
            self.silent -= 1
        if tag == "script" and self.script is not None:
            self.jsonld.append("".join(self.script))
            self.script = None
        elif tag == "a" and self.link is not None:
            label = self.link["heading"] or next(iter(self.link["texts"]), "") or self.link["title"]
            self.links.append({"href": self.link["href"], "label": label})
            self.link = None
        if tag in HEADINGS and self.heading is not None:
            self.headings.append(squeeze(" ".join(self.heading)))
            self.heading = None

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        if self.silent:
            return
        tags = [t for t, _ in self.open]
        if tags and tags[-1] == "title":
            self.title = (self.title or "") + data
        for line in data.split("\n"):
            text = squeeze(line)
            if not text:
                continue
            self.lines.append(text)
            if self.heading is not None:
                self.heading.append(text)
            if self.link is not None:
                self.link["texts"].append(text)
                if self.link["heading"] == "" and any(t in LINK_HEADINGS for t in tags):
                    self.link["heading"] = text
            if "address" in tags:
                self.addresses[-1].append(text)


def parsed(html: str) -> Page:
    page = Page()
    page.feed(html)
    page.close()
    while page.open:
        page.closed(page.open.pop()[0])
    return page


def sliced(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of a few pages: what a worker makes of one as Python objects takes many times the room of its markup."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows or PAGES_AT_ONCE):
            yield batch.slice(at, rows or PAGES_AT_ONCE)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rows = []
        for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            p = parsed(html or "")
            description = p.metas.get("description") or p.metas.get("og:description") or ""
            rows.append((page_id, url, squeeze(p.title or ""), squeeze(description), squeeze(p.metas.get("og:site_name", "")), p.lines, p.headings, p.links, p.jsonld, p.addresses, p.logos, p.n_scripts))
        columns = zip(*rows, strict=True) if rows else [()] * len(TYPES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, TYPES, strict=True)], [n for n, _ in TYPES])


def parse_pages(pages: DataFrame) -> DataFrame:
    """One row per page (page_id, url, html) with its parts; the only place where HTML is parsed."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_parse, PARSED)
