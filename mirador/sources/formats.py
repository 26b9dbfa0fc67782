"""Readers and writers of the formats beside parquet: JSON knowledge bases, lists of urls, feeds, sitemaps, ontologies, schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import compact, text
from ..functions.urls import domain, foreign_language, normalize, skipped
from . import markup
from .tables import cut, exists

COORDINATES = "struct<lat:double,lng:double,source:string,confidence:double>"
SOURCE = f"struct<url:string,block_id:string,source_type:string,title:string,text:string,images:array<string>,coordinates:{COORDINATES},metadata:map<string,string>,page_url:string>"
_TEXTS = ("name", "type", "sourceUrl", "url", "address", "phone", "email", "shortDescription", "longDescription", "sourceText", "description", "wikidataId", "evidence", "startDate", "endDate")
_LISTS = ("types", "relatedUrls", "images")


def entities_of_json(docs: DataFrame, column: str = "value") -> DataFrame:
    """Entities of JSON texts: a list of them, or an object with ``entities``. Bad JSON gives none.

    Read with tolerance: null becomes '', a single value a list, ``longDescriptionb`` stands for ``longDescription``.
    """
    v = F.try_parse_json(column)
    items = F.coalesce(F.try_variant_get(v, "$.entities", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    e = docs.select(F.posexplode(items).alias("pos", "e"))
    get = lambda p, t="string": F.try_variant_get("e", p, t)
    one = lambda f: text(F.coalesce(get(f"$.{f}"), get("$.longDescriptionb")) if f == "longDescription" else get(f"$.{f}")).alias(f)
    many = lambda f: F.coalesce(get(f"$.{f}", "array<string>"), F.filter(F.array(get(f"$.{f}")), lambda x: text(x) != "")).alias(f)
    return e.select("pos", *map(one, _TEXTS), *map(many, _LISTS), get("$.score", "double").alias("score"), get("$.coordinates", COORDINATES).alias("coordinates"), F.coalesce(get("$.sources", f"array<{SOURCE}>"), F.array().cast(f"array<{SOURCE}>")).alias("sources"))


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    """Entities of a JSON knowledge base; a missing file is an empty one."""
    docs = spark.read.text(path, wholetext=True) if exists(spark, path) else spark.createDataFrame([], "value string")
    return entities_of_json(docs)


def crawled_urls(docs: DataFrame, column: str = "value") -> DataFrame:
    return docs.select(F.explode(F.try_variant_get(F.try_parse_json(column), "$.crawled_urls", "array<string>")).alias("url")).distinct()


def write_kb(entities: DataFrame, path: str) -> None:
    """One JSON object a line; parquet is the store for large knowledge bases."""
    entities.write.mode("overwrite").json(path)


def url_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Urls of a text file, a line each; blank lines and lines that begin with # are left out."""
    return lines.where(~F.startswith(column, F.lit("#"))).select(F.trim(column).alias("url")).where("url <> ''")


def articles(feeds: DataFrame, since: str | None = None, limit: int | None = None, column: str = "xml", source: str = "source") -> DataFrame:
    """(source, pos, title, published, url, summary) of RSS and Atom items in (source, xml), in the feed's order.

    ``since`` drops older items and keeps undated ones; ``limit`` keeps each feed's first. Feeds that are not well formed are
    read as far as they go.
    """
    name = feeds.schema[source].dataType.simpleString()
    e = markup.read(feeds, [source, column], f"`{source}` {name}, pos int, raw_title string, raw_date string, raw_link string, raw_summary string, raw_source string", markup.feed_rows)
    bare = lambda c: compact(F.regexp_replace(c, r"(?s)<[^>]+>", " "))
    when = F.nullif("raw_date", F.lit(""))
    rfc = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(when, r"^\w{3},\s*", ""), r"\s*(?:GMT|UTC|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    date = F.coalesce(rfc, F.try_to_timestamp(when)).cast("date")
    a = e.select(source, "pos", F.coalesce(F.nullif(compact(F.col("raw_title")), F.lit("")), F.lit("(sin título)")).alias("title"), date.alias("date"), compact(F.col("raw_link")).alias("url"), bare(F.col("raw_summary")).alias("summary"))
    if since:
        a = a.where(F.col("date").isNull() | (F.col("date") >= F.lit(since).cast("date")))
    a = a.select(source, "pos", "title", text(F.date_format("date", "yyyy-MM-dd")).alias("published"), "url", "summary")
    if limit is not None:
        from pyspark.sql import Window

        a = a.withColumn("n", F.row_number().over(Window.partitionBy(source).orderBy("pos"))).where(F.col("n") <= limit).drop("n")
    return a


def feeds_of(pages: DataFrame) -> DataFrame:
    """(url, feed, title, prio): feeds that pages (url, html) link to: alternates, then anchors and addresses that look like feeds of the
    same root domain; the first of each."""
    return markup.read(pages.withColumn("_url", F.col("url")), ["url", "_url", "html"], "url string, feed string, title string, prio int", markup.feed_links)


def article_pages(articles_: DataFrame) -> DataFrame:
    """Articles as pages of one block, for the same pipeline as crawled pages."""
    about = F.when(F.col("summary") != "", F.col("summary")).otherwise(F.concat(F.lit("Fuente: "), text(F.col("source"))))
    return articles_.select("url", "title", about.alias("description"), F.lit("es").alias("language"), F.lit("ok").alias("status"), F.array(F.struct(F.lit("rss-0").alias("block_id"), F.col("title").alias("title"), about.alias("text"))).alias("blocks"))


#: Where sitemaps are by custom, in order.
SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml")


def sitemap_urls(robots: DataFrame, sitemaps: DataFrame, homes: DataFrame | str, lang: str = "", most_levels: int = 4) -> DataFrame:
    """(home, url): the pages of each site (``homes`` has a column home) by its sitemaps: those that its robots.txt (url, body) names
    if they give any page, else the first of the common places that does.

    Indexes are followed ``most_levels`` deep. ``sitemaps`` is (url, xml); each is parsed once, bad XML gives none. Pages of
    other sites, files, system pages and other languages are left out.
    """
    if isinstance(homes, str):
        homes = sitemaps.sparkSession.createDataFrame([(homes,)], "home string")
    base = homes.select("home", F.rtrim("home", F.lit("/")).alias("base"))
    lines = base.join(robots, F.concat("base", F.lit("/robots.txt")) == robots["url"]).select("home", F.explode(F.split("body", r"\r?\n")).alias("l"))
    named = lines.select("home", F.lit(0).alias("way"), F.trim(F.regexp_extract("l", r"(?i)^\s*sitemap:\s*(http.*)$", 1)).alias("sitemap")).where("sitemap <> ''")
    common = base.select("home", F.posexplode(F.array(*[F.concat("base", F.lit(p)) for p in SITEMAPS])).alias("way", "sitemap")).withColumn("way", F.col("way") + 1)
    parsed = cut(markup.read(sitemaps, ["url", "xml"], "sitemap string, index boolean, pos int, loc string", markup.sitemap_rows))
    level, out = named.unionByName(common).distinct(), None
    for _ in range(most_levels):
        here = level.join(parsed, "sitemap")
        urls = here.where("not index").select("home", "way", normalize(F.col("loc")).alias("url"))
        out = urls if out is None else out.unionByName(urls)
        level = cut(here.where("index").select("home", "way", F.col("loc").alias("sitemap")).distinct())
    good = out.where(F.col("url").isNotNull() & (domain(F.col("url")) == domain(F.col("home"))) & ~skipped(F.col("url")) & ~foreign_language(F.col("url"), lang)).distinct()
    # The first way of each site that gives a page.
    from pyspark.sql import Window

    return good.withColumn("first", F.min("way").over(Window.partitionBy("home"))).where("way = first").select("home", "url")


def ontology_of_rdf(docs: DataFrame, column: str = "xml", namespace: str = "") -> DataFrame:
    """(name, uri, label_es, label_en, parent) of the classes of RDF/XML texts within a namespace; bad XML gives none."""
    return markup.ontology(docs, column, namespace)


def graph_schema(docs: DataFrame, column: str = "value") -> DataFrame:
    """(class, mutation, required) of an introspection document: classes with an input type and a create mutation."""
    v = F.try_parse_json(column)
    s = docs.select(F.coalesce(F.try_variant_get(v, "$.data.__schema", "variant"), F.try_variant_get(v, "$.__schema", "variant")).alias("s"))
    types = "array<struct<name:string,fields:array<struct<name:string>>,inputFields:array<struct<name:string,type:struct<kind:string>>>>>"
    t = s.select(F.coalesce(F.try_variant_get("s", "$.mutationType.name", "string"), F.lit("Mutation")).alias("m"), F.explode(F.try_variant_get("s", "$.types", types)).alias("t"))
    create = t.where(F.col("t.name") == F.col("m")).select(F.explode("t.fields.name").alias("mutation")).where(F.startswith("mutation", F.lit("create"))).withColumn("k", F.lower(F.substring("mutation", F.lit(7), F.length("mutation"))))
    inputs = t.where(F.endswith("t.name", F.lit("Input"))).select(F.regexp_replace("t.name", "Input$", "").alias("class"), F.coalesce(F.transform(F.filter("t.inputFields", lambda f: f["type"]["kind"] == "NON_NULL"), lambda f: f["name"]), F.array().cast("array<string>")).alias("required"))
    return inputs.join(create, F.lower("class") == F.col("k")).select("class", "mutation", "required")


def data_url(files: DataFrame, most_bytes: int = 4 * 1024 * 1024) -> DataFrame:
    """(path, data_url) of ``binaryFile`` rows of images up to a size."""
    ext = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    kind = F.when(ext.isin("jpg", "jpeg"), "jpeg").otherwise(ext)
    return files.where(F.col("length") <= most_bytes).select("path", F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64("content")).alias("data_url"))
