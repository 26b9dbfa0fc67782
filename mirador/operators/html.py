"""HTML pages to rows. Python only reads the markup; cleaning, filters, order and limits are columns after it."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import images as I
from ..functions.text import clean_content, compact, text
from ..functions.urls import absolute

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
SILENT = frozenset(("script", "style", "noscript", "svg"))
HEADINGS = ("h1", "h2", "h3", "h4")
# Elements and class names that hold blocks, attributes that hold an image's address, and limits.
BLOCK_TAGS = ("article", "section", "main")
BLOCK_CLASSES = ("card", "item", "noticia", "evento", "resource", "contenido")
SOURCES = ("src", "data-src", "data-lazy-src", "data-lazy", "data-original")
MOST_BLOCKS, MOST_IMAGES, BLOCK_TEXT, BLOCK_IMAGES = 80, 80, 3000, 20

_IMAGE = "struct<url:string,alt:string,idx:int,meta:string,context:string,small:boolean>"
SCHEMA = (
    "url string, title string, description string, language string, raw_text string, main_text string, status string, errors array<string>, hrefs array<string>, jsonld array<string>, "
    f"metas map<string,string>, frames array<string>, images array<{_IMAGE}>, blocks array<struct<pos:int,kind:string,title:string,text:string,images:array<struct<url:string,alt:string,idx:int>>>>"
)


class Tape(HTMLParser):
    """Records a page as a flat tape: text pieces, and elements with the span of pieces that they enclose."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.tags: list[tuple[str, dict, int, int]] = []  # name, attributes, first piece, index of parent
        self.ends: list[int] = []
        self.open: list[int] = []
        self.silent = 0
        self.jsonld: list[str] = []
        self.in_jsonld = False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        self.tags.append((tag, a, len(self.pieces), self.open[-1] if self.open else -1))
        self.ends.append(-1)
        if tag in VOID:
            self.ends[-1] = len(self.pieces)
            return
        self.open.append(len(self.tags) - 1)
        self.silent += tag in SILENT
        self.in_jsonld = tag == "script" and a.get("type", "").lower() == "application/ld+json"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not any(self.tags[i][0] == tag for i in self.open):
            return
        while self.open:
            i = self.open.pop()
            self.ends[i] = len(self.pieces)
            self.silent -= self.tags[i][0] in SILENT
            if self.tags[i][0] == tag:
                break
        self.in_jsonld = False

    def handle_data(self, data):
        if self.in_jsonld:
            self.jsonld.append(data)
        elif not self.silent and data.strip():
            self.pieces.append(data)

    def finish(self) -> None:
        self.close()
        self.ends = [len(self.pieces) if e < 0 else e for e in self.ends]

    def text(self, i: int) -> str:
        return " ".join(" ".join(self.pieces[self.tags[i][2] : self.ends[i]]).split())

    def inside(self, i: int, names: tuple[str, ...]) -> list[int]:
        """Elements of these names under element ``i``: on the tape they follow it up to the first that starts after it ends."""
        out = []
        for k in range(i + 1, len(self.tags)):
            j = k
            while j > i:
                j = self.tags[j][3]
            if j != i:
                break
            if self.tags[k][0] in names:
                out.append(k)
        return out


def read_page(url: str | None, html: str | None) -> dict:
    """One page as a row; whatever fails becomes a row of status 'error' with the message."""
    row = {"url": url, "title": "", "description": "", "language": "", "raw_text": "", "main_text": "", "status": "ok", "errors": [], "hrefs": [], "jsonld": [], "metas": [], "frames": [], "images": [], "blocks": []}
    if not html or not html.strip():
        return row | {"status": "error", "errors": ["no content"]}
    try:
        t = Tape()
        t.feed(html)
        t.finish()
        names = [x[0] for x in t.tags]
        at = lambda n: [i for i, x in enumerate(names) if x == n]
        row["raw_text"] = " ".join(" ".join(t.pieces).split())
        row["title"] = t.text(at("title")[0]) if at("title") else ""
        row["language"] = next((t.tags[i][1].get("lang", "") for i in at("html")), "")
        metas = [(t.tags[i][1].get("property") or t.tags[i][1].get("name") or "", t.tags[i][1].get("content", "")) for i in at("meta")]
        row["metas"] = list({k: v for k, v in reversed(metas) if k}.items())
        own = dict(row["metas"])
        row["description"] = next((v for k in ("description", "og:description", "twitter:description") if (v := " ".join(own.get(k, "").split()))), "")
        bodies = [t.text(i) for i, n in enumerate(names) if n in ("main", "article")]
        row["main_text"] = max(bodies, key=len, default="") or row["raw_text"]
        row["hrefs"] = [t.tags[i][1]["href"] for i in at("a") if t.tags[i][1].get("href")]
        row["frames"] = [t.tags[i][1]["src"] for i in at("iframe") if t.tags[i][1].get("src")]
        row["jsonld"] = t.jsonld
        heads = [i for i, n in enumerate(names) if n in HEADINGS]
        images = {}
        for k, i in enumerate(at("img")):
            a = t.tags[i][1]
            if not (src := next((a[s] for s in SOURCES if a.get(s)), "")):
                continue
            around, j = "", t.tags[i][3]
            for _ in range(4):
                if j < 0 or t.tags[j][0] in ("body", "html"):
                    break
                if around := t.text(j)[:600]:
                    break
                j = t.tags[j][3]
            near = [t.text(h) for h in (max((h for h in heads if h < i), default=None), min((h for h in heads if h > i), default=None)) if h is not None]
            size = [int(d) if (d := "".join(c for c in a.get(x, "") if c.isdigit())) else None for x in ("width", "height")]
            images[i] = {"url": src, "alt": " ".join(a.get("alt", "").split()), "idx": k, "meta": " ".join(a.get(x, "") for x in ("class", "id", "role", "aria-label", "title")), "context": " ".join([a.get("title", ""), a.get("aria-label", ""), around, *near]).strip()[:1000], "small": all(s is not None and s <= 80 for s in size)}
        row["images"] = list(images.values())
        found = [i for tag in BLOCK_TAGS for i in at(tag)] + [i for c in BLOCK_CLASSES for i, x in enumerate(t.tags) if c in x[1].get("class", "") and x[0] not in BLOCK_TAGS]
        for pos, i in enumerate(dict.fromkeys(found)):
            head = t.inside(i, HEADINGS)
            pics = [{"url": images[k]["url"], "alt": images[k]["alt"], "idx": images[k]["idx"]} for k in t.inside(i, ("img",)) if k in images]
            row["blocks"].append({"pos": pos, "kind": names[i], "title": t.text(head[0]) if head else "", "text": t.text(i), "images": pics})
    except Exception as e:  # noqa: BLE001 - a page must not stop the others
        return row | {"status": "error", "errors": [f"{type(e).__name__}: {e}"[:200]], "blocks": [], "images": []}
    return row


def parse(pages: DataFrame) -> DataFrame:
    """(url, html) to one row a page, unfiltered: see SCHEMA. Null and blank pages come out with status 'error'."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_pylist([read_page(u, h) for u, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist())], schema=arrow)

    return pages.select("url", "html").mapInArrow(run, SCHEMA)


def page_images(parsed: DataFrame) -> DataFrame:
    """(url, image, alt, context, idx): absolute images of each page that are no noise and no small icons, first of each address,
    the first MOST_IMAGES."""
    from .merge import first_of_group

    i = parsed.select("url", F.explode("images").alias("i")).select("url", F.replace(absolute(F.col("i.url"), F.col("url")), F.lit(" "), F.lit("%20")).alias("image"), F.col("i.alt").alias("alt"), F.col("i.meta").alias("meta"), F.col("i.context").alias("context"), F.col("i.idx").alias("idx"), F.col("i.small").alias("small"))
    good = first_of_group(i.where(~F.col("small") & ~I.is_noise(F.col("image"), F.col("alt"), F.col("meta"))), ["url", "image"], [F.col("idx")])
    from pyspark.sql import Window

    return good.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("idx"))).where(F.col("n") <= MOST_IMAGES).select("url", "image", "alt", "context", "idx")


def useful(t: Column) -> Column:
    return (F.length(t) >= 50) & ~(F.rlike(F.lower(t), F.lit("cookies|politica de privacidad|aviso legal")) & (F.length(t) < 500))


def page_blocks(parsed: DataFrame) -> DataFrame:
    """(url, block_id, kind, title, text, images, position): the page's useful blocks, first of those that begin alike, the first
    MOST_BLOCKS; a page without any is one block. Titled blocks and those with more images come first and are numbered so."""
    from pyspark.sql import Window

    from .merge import first_of_group

    b = parsed.where("status = 'ok'").select("url", F.explode("blocks").alias("b")).select("url", F.col("b.kind").alias("kind"), clean_content(F.col("b.title")).alias("title"), clean_content(F.col("b.text")).alias("text"), F.slice("b.images", 1, BLOCK_IMAGES).alias("images"), F.col("b.pos").alias("position"))
    b = first_of_group(b.where(useful(F.col("text"))).withColumn("head", F.substring("text", 1, 300)), ["url", "head"], [F.col("position")]).drop("head")
    b = b.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("position"))).where(F.col("n") <= MOST_BLOCKS).drop("n")
    none = parsed.where("status = 'ok'").join(b.select("url").distinct(), "url", "left_anti")
    whole = none.select("url", F.lit("page").alias("kind"), F.lit("").alias("title"), clean_content(F.col("raw_text")).alias("text"), F.transform(F.slice("images", 1, BLOCK_IMAGES), lambda i: F.struct(i["url"].alias("url"), i["alt"].alias("alt"), i["idx"].alias("idx"))).alias("images"), F.lit(0).alias("position")).where("text <> ''")
    out = b.unionByName(whole)
    w = Window.partitionBy("url").orderBy(F.col("title") == "", -F.size("images"), "position")
    return out.withColumn("block_id", F.concat(F.lit("block-"), F.row_number().over(w).cast("string"))).withColumn("text", F.substring("text", 1, BLOCK_TEXT))


def structured_data(parsed: DataFrame) -> DataFrame:
    """(url, pos, item): the JSON-LD objects of each page as VARIANT: items of lists and graphs, then the object itself; bad JSON is skipped."""
    s = parsed.select("url", F.posexplode("jsonld").alias("script", "raw")).withColumn("v", F.try_parse_json("raw")).where("v is not null")
    kind = F.schema_of_variant("v")
    items = F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.concat(F.coalesce(F.try_variant_get("v", "$['@graph']", "array<variant>"), F.array().cast("array<variant>")), F.array("v")))
    each = s.select("url", "script", F.posexplode(items).alias("i", "item"))
    return each.where(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT"))).select("url", (F.col("script") * 1000 + F.col("i")).alias("pos"), "item")


def structured_entities(items: DataFrame) -> DataFrame:
    """(url, pos, name, type, address, lat, lng, phone, email, description, start, end) of (url, pos, item) with a known type and a name."""
    from .. import dims

    g = lambda p, t="string": F.try_variant_get("item", p, t)
    plain = lambda f: F.trim(text(F.coalesce(F.when(~F.startswith(text(g(f"$.{f}")), F.lit("{")), g(f"$.{f}")), g(f"$.{f}['@value']"), g(f"$.{f}.name"))))
    kind = F.coalesce(g("$['@type'][0]"), g("$['@type']"))
    table = F.create_map(*[F.lit(x) for kv in dims.SCHEMA_TYPES.items() for x in kv])
    parts = F.filter(F.array(*[text(g(f"$.address.{p}")) for p in ("streetAddress", "postalCode", "addressLocality", "addressRegion")]), lambda p: p != "")
    addr = F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(F.trim(text(F.when(~F.startswith(text(g("$.address")), F.lit("{")), g("$.address")))))
    lat, lng = g("$.geo.latitude", "double"), g("$.geo.longitude", "double")
    ok = (lat != 0) & (lng != 0) & lat.between(-90, 90) & lng.between(-180, 180)
    return items.select("url", "pos", plain("name").alias("name"), F.try_element_at(table, kind).alias("type"), addr.alias("address"), F.when(ok, lat).alias("lat"), F.when(ok, lng).alias("lng"), plain("telephone").alias("phone"), plain("email").alias("email"), plain("description").alias("description"), plain("startDate").alias("start"), plain("endDate").alias("end")).where("type is not null and name <> ''")


def geo_candidates(parsed: DataFrame) -> DataFrame:
    """(url, lat, lng, source, confidence, prio): points of a page from JSON-LD, meta tags, map frames and its text, first of each place."""
    from .merge import first_of_group

    point = lambda df, a, b, s, c, p: df.select("url", a.cast("double").alias("lat"), b.cast("double").alias("lng"), F.lit(s).alias("source"), F.lit(c).alias("confidence"), F.lit(p).alias("prio"))
    g = lambda p: F.try_variant_get("item", p, "double")
    ld = point(structured_data(parsed), g("$.geo.latitude"), g("$.geo.longitude"), "json-ld", 0.9, 0)
    m = lambda k: F.expr(f"try_cast(metas['{k}'] as double)")
    pair = lambda k, i: F.expr(f"try_cast(regexp_extract(metas['{k}'], '(-?[0-9]+(?:[.][0-9]+)?) *[,;] *(-?[0-9]+(?:[.][0-9]+)?)', {i}) as double)")
    meta = point(parsed, m("place:location:latitude"), m("place:location:longitude"), "meta", 0.8, 1).unionByName(point(parsed, pair("geo.position", 1), pair("geo.position", 2), "meta", 0.8, 1)).unionByName(point(parsed, pair("ICBM", 1), pair("ICBM", 2), "meta", 0.8, 1))
    f = parsed.select("url", F.explode("frames").alias("f")).where(F.rlike("f", F.lit(r"maps\.google|google\.com/maps")))
    frame = point(f, F.expr("try_cast(regexp_extract(f, '[?&]q=(-?[0-9]+[.][0-9]+),(-?[0-9]+[.][0-9]+)', 1) as double)"), F.expr("try_cast(regexp_extract(f, '[?&]q=(-?[0-9]+[.][0-9]+),(-?[0-9]+[.][0-9]+)', 2) as double)"), "google-maps-iframe", 0.85, 2)
    all_ = ld.unionByName(meta).unionByName(frame).where("lat between -90 and 90 and lng between -180 and 180")
    return first_of_group(all_, ["url", "lat", "lng"], [F.col("prio")])


def block_names(blocks: DataFrame) -> DataFrame:
    """Candidate entities of blocks: (block_uid, name, short, long): the cleaned heading unless it is navigation, else the name after a date."""
    from .. import dims
    from ..functions.text import clean_name, key, relevant_text, word_count

    heading = clean_name(F.col("title"))
    dated = clean_name(F.regexp_extract(text(F.col("text")), r"^\s*\d{1,2}\s+de\s+[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+\s+de\s+\d{4}\s+(.+?)(?=\s+(?:Con|En|El|La|Los|Las|Una|Un|Del|Durante|Toda|Descarga|DESCARGA|Burgos Film Commission)\s)", 1))
    n = word_count(key(dated))
    name = F.when((heading != "") & ~key(heading).isin(*dims.NAVIGATION_NAMES), heading).when((dated != "") & n.between(2, 12), dated).otherwise("")
    b = blocks.withColumn("name", name).where("name <> ''").withColumn("t", relevant_text(F.col("name"), F.col("text")))
    return b.select("block_uid", "name", F.substring("t", 1, 300).alias("short"), F.substring("t", 1, 1200).alias("long"))


def title_entities(pages: DataFrame, as_of: Column) -> DataFrame:
    """(page_id, name, type, start, end): pages whose title names one place: a keyword settles its type, or it is a dated event page."""
    from .. import dims
    from ..functions.dates import event_dates
    from ..functions.text import first_title_segment, has_keyword, key, let
    from ..functions.urls import segments
    from .classify import name_type

    name = first_title_segment(F.col("title"))
    k = key(name)
    array = F.array(*[F.struct(F.lit(a).alias("keyword"), F.lit(t).alias("type"), F.lit(i).alias("ord")) for i, (a, t) in enumerate(dims.TYPE_KEYWORDS)])

    def best(hits: Column) -> Column:
        # Of the types with most keywords in the name the one whose keyword comes first.
        same = lambda x: F.filter(hits, lambda y: y["type"] == x["type"])
        return F.array_min(F.transform(hits, lambda x: F.struct((-F.size(same(x))).alias("n"), F.array_min(F.transform(same(x), lambda y: y["ord"])).alias("o"), x["type"].alias("t"))))["t"]

    by_word = let(let(k, lambda one: F.filter(array, lambda x: has_keyword(one, x["keyword"]))), best)
    own = F.coalesce(F.nullif(name_type(k), F.lit("")), by_word)
    body = text(F.col("main_text")) if "main_text" in pages.columns else F.lit("")
    event = F.arrays_overlap(segments(F.col("url")), F.array(*map(F.lit, dims.EVENT_SEGMENTS))) & F.rlike(body, F.lit(r"(?i)fecha\s+de\s+inicio"))
    dates = event_dates(body, as_of)
    p = pages.withColumns({"name": name, "k": k, "event": F.coalesce(event, F.lit(False)), "own": own})
    return p.where((F.col("k") != "") & ~F.col("k").isin(*dims.NAVIGATION_NAMES) & (F.col("event") | F.col("own").isNotNull())).select("page_id", "name", F.coalesce("own", F.lit("Event")).alias("type"), F.when(F.col("event"), dates["start"]).otherwise("").alias("start"), F.when(F.col("event"), dates["end"]).otherwise("").alias("end"))
