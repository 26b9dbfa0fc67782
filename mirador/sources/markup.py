"""Readers of XML and HTML documents in Arrow batches: sitemaps, feeds, ontologies, links to feeds.

Documents are parsed whole by the standard library; a document that is not well formed gives no rows, except feeds, which
are then read by the tolerant HTML reader. Documents that declare entities are refused.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import partial
from html.parser import HTMLParser
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

OWL, RDF, RDFS = "{http://www.w3.org/2002/07/owl#}", "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://www.w3.org/2000/01/rdf-schema#}"
LANG = "{http://www.w3.org/XML/1998/namespace}lang"
ATOM, RSS1, DC = "{http://www.w3.org/2005/Atom}", "{http://purl.org/rss/1.0/}", "{http://purl.org/dc/elements/1.1/}"


def read(docs: DataFrame, columns: list[str], schema: str, f: Callable[..., list[tuple]]) -> DataFrame:
    """Rows of ``schema``: the first of ``columns`` and what ``f`` makes of the others, for each document."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = [(k, *r) for k, *x in zip(*(c.to_pylist() for c in part.columns)) for r in f(*x)]
                cols = list(zip(*rows)) if rows else [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(cols, arrow)], schema=arrow)

    return docs.select(*columns).mapInArrow(run, schema)


def root_of(xml: str | None) -> ET.Element | None:
    """The root of a well-formed document without declared entities."""
    if not xml or "<!ENTITY" in xml:
        return None
    try:
        return ET.fromstring(xml.strip())
    except (ET.ParseError, ValueError):
        try:
            return ET.fromstring(xml.strip().encode("utf-8"))  # texts with an encoding declaration
        except (ET.ParseError, ValueError):
            return None


def local(tag: Any) -> str:
    return tag.rsplit("}", 1)[-1].lower() if isinstance(tag, str) else ""


def sitemap_rows(xml: str | None) -> list[tuple]:
    """(whether the sitemap is an index, position, location) of a sitemap's entries, in any namespace."""
    root = root_of(xml)
    if root is None:
        return []
    index = "sitemapindex" in local(root.tag)
    found = [(next((c.text or "" for c in entry if local(c.tag) == "loc"), "")).strip() for entry in root]
    return [(index, k, x) for k, x in enumerate(found) if x]


def ontology_rows(namespace: str, xml: str | None) -> list[tuple]:
    """(name, uri, label_es, label_en, parent) of the classes of RDF/XML within a namespace."""
    root = root_of(xml)
    out = []
    for c in root.iter(f"{OWL}Class") if root is not None else ():
        uri = c.get(f"{RDF}about", "")
        if not uri.startswith(namespace) or not (name := fragment(uri)):
            continue
        labels = {x.get(LANG, ""): x.text or "" for x in reversed(c.findall(f"{RDFS}label"))}
        parent = c.find(f"{RDFS}subClassOf")
        out.append((name, uri, labels.get("es", ""), labels.get("en", ""), fragment(parent.get(f"{RDF}resource", "")) if parent is not None else ""))
    return out


def fragment(uri: str) -> str:
    return uri.replace("#", "/").rsplit("/", 1)[-1]


#: The elements of feeds, by what they give; the first that is filled counts.
FEED_FIELDS = {"title": ("title",), "date": ("pubdate", "published", "updated", "date"), "link": ("link", "other", "guid"), "summary": ("description", "summary", "content"), "source": ("source",)}


def feed_rows(xml: str | None) -> list[tuple]:
    """(position, title, date, link, summary, source) of a feed's items, as they are written."""
    root = root_of(xml)
    items = [strict_item(x) for x in root.iter() if local(x.tag) in ("item", "entry")] if root is not None else tolerant_items(xml)
    return [(k, *(item.get(f, "") for f in FEED_FIELDS)) for k, item in enumerate(items)]


def strict_item(item: ET.Element) -> dict[str, str]:
    own: dict[str, str] = {}
    for c in item:
        space = c.tag[: c.tag.rfind("}") + 1] if isinstance(c.tag, str) else "?"
        if space not in ("", ATOM, RSS1, DC):
            continue
        name = local(c.tag)
        value = "".join(c.itertext()).strip()
        if name == "link" and not value:
            name, value = "link" if c.get("rel", "alternate") == "alternate" else "other", c.get("href", "")
        if value:
            own.setdefault(name, value)
    return {f: next((own[n] for n in names if own.get(n)), "") for f, names in FEED_FIELDS.items()}


class FeedReader(HTMLParser):
    """Items of feeds that are not well formed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict[str, str]] = []
        self.item: dict[str, str] | None = None
        self.open: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("item", "entry"):
            self.item, self.open = {}, None
            self.items.append(self.item)
        elif self.item is not None and self.open is None and ":" not in tag or tag == "dc:date" and self.item is not None:
            self.open = tag.removeprefix("dc:")
            if tag == "link" and (href := dict(attrs).get("href")):
                self.item.setdefault("link", href)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("item", "entry"):
            self.item = self.open = None
        elif self.open == tag.removeprefix("dc:"):
            self.open = None

    def handle_data(self, data: str) -> None:
        if self.item is not None and self.open:
            self.item[self.open] = self.item.get(self.open, "") + data

    def unknown_decl(self, data: str) -> None:
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


def tolerant_items(xml: str | None) -> list[dict[str, str]]:
    if not xml or "<!ENTITY" in xml:
        return []
    r = FeedReader()
    r.feed(xml)
    return [{f: next((v for n in names if (v := item.get(n, "").strip())), "") for f, names in FEED_FIELDS.items()} for item in r.items]


#: Types of feeds, what addresses of feeds have in them, and titles that say nothing.
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "text/xml")
FEED_PARTS, FEED_QUERIES = ("/rss", "/feed", ".rss", ".xml", "atom"), ("outputtype=xml", "format=rss")
NO_TITLES = ("ir al contenido", "copiar enlace", "copiar", "copy link", "skip to content", "")


class LinkReader(HTMLParser):
    """Alternate links and anchors of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.alternates: list[tuple[str, str]] = []
        self.anchors: list[list[str]] = []
        self.within = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "link" and "alternate" in a.get("rel", "").lower().split() and a.get("type", "").strip().lower().split(";")[0] in FEED_TYPES and a.get("href", "").strip():
            self.alternates.append((a["href"].strip(), a.get("title", "").strip()))
        elif tag == "a":
            self.within = bool(a.get("href", "").strip())
            if self.within:
                self.anchors.append([a["href"].strip(), ""])

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.within = False

    def handle_data(self, data: str) -> None:
        if self.within:
            self.anchors[-1][1] += data.strip()


def feed_links(url: str | None, html: str | None) -> list[tuple]:
    """(feed, title, prio) that a page names: alternates (0), anchors that look like feeds of its root domain (1), and such
    addresses anywhere in its source (2); the first of each address."""
    import re
    from urllib.parse import urljoin, urlsplit, urlunsplit

    if not url or not html:
        return []
    base = "{0.scheme}://{0.netloc}".format(urlsplit(url))
    root = lambda u: ".".join(urlsplit(u).netloc.lower().split(".")[-2:])
    bare = lambda u: urlunsplit(urlsplit(u)._replace(fragment=""))
    found: dict[str, tuple] = {}
    try:
        r = LinkReader()
        r.feed(html)
        for href, title in r.alternates:
            found.setdefault(urljoin(base, href), (title, 0))
        for href, title in r.anchors:
            u = urljoin(url, href)
            p = urlsplit(u)
            if (p.fragment and not p.path.strip("/")) or not any(x in p.path.lower() for x in FEED_PARTS) or root(u) != root(base) or title.lower() in NO_TITLES:
                continue
            found.setdefault(bare(u), (title, 1))
        for m in re.finditer(r"https?://[^\s\"'<>]+", html):
            u = m[0].rstrip(".,;)")
            p = urlsplit(u)
            if root(u) == root(base) and (any(x in p.path.lower() for x in FEED_PARTS) or any(x in p.query.lower() for x in FEED_QUERIES)):
                found.setdefault(bare(u), ("", 2))
    except ValueError:  # an address that can't be parsed
        pass
    return [(f, t, k) for f, (t, k) in found.items()]


def ontology(docs: DataFrame, column: str, namespace: str) -> DataFrame:
    from pyspark.sql import functions as F

    return read(docs.withColumn("_k", F.lit(0)), ["_k", column], "k int, name string, uri string, label_es string, label_en string, parent string", partial(ontology_rows, namespace)).drop("k")
