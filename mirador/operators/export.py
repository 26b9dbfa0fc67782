"""Projections and payloads: golden, clean and flat records, page summaries, graph objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.geo import wkt
from ..functions.text import clean_content, distinct_filled, external_id, literal, text

CLEAN_CONFIDENCE = 0.3
_NONE = "array<string>"
EXTERNAL = ("wikidata", "openstreetmap", "wikipedia")


def golden(entities: DataFrame) -> DataFrame:
    """The nineteen scalar and list fields of the golden shape (evidence is its own table); dates of events are not among them."""
    return entities.select("entity_id", "name", "type", "types", "score", "sourceUrl", "url", "relatedUrls", "address", "phone", "email", "coordinates", "shortDescription", "longDescription", "sourceText", "description", "images", "wikidataId", "evidence", "classificationEvidence")


def clean(entities: DataFrame) -> DataFrame:
    """Eight fields; coordinates only if present and not too unsure."""
    c = F.col("coordinates")
    sure = c["lat"].isNotNull() & (c["confidence"].isNull() | (c["confidence"] >= CLEAN_CONFIDENCE))
    return entities.select("entity_id", "name", "type", "sourceUrl", "types", "shortDescription", "longDescription", "images", F.when(sure, c).alias("coordinates"))


def page_summary(pages: DataFrame, blocks: DataFrame, points: DataFrame) -> DataFrame:
    """Per page its fields and the number of its images, blocks and points."""
    count = lambda df, c, n: df.groupBy(F.col(c).alias("k")).agg(F.count("*").alias(n))
    j = pages.join(count(blocks, "page_id", "block_count").withColumnRenamed("k", "page_id"), "page_id", "left").join(count(points, "url", "geo_count").withColumnRenamed("k", "url"), "url", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return j.select("page_id", "url", "title", "language", "status", zero(F.size("images").cast("bigint")).alias("image_count"), zero(F.size("errors").cast("bigint")).alias("error_count"), zero(F.col("block_count")).alias("block_count"), zero(F.col("geo_count")).alias("geo_candidates_count"))


def distinct_texts(texts: Column) -> Column:
    """Cleaned texts in order, without those that are part of another; one that contains earlier ones replaces them."""
    cleaned = F.array_distinct(F.filter(F.transform(texts, clean_content), lambda t: t != ""))
    return F.filter(cleaned, lambda t: ~F.exists(cleaned, lambda o: (o != t) & F.contains(o, t)))


def summary(entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """(entity_id, summary): the longest of the entity's texts and its encyclopedic evidence, the first of equals."""
    own = entities.select("entity_id", F.posexplode(F.array("longDescription", "description", "shortDescription", "sourceText", "evidence")).alias("pos", "t"))
    other = evidence.where(F.col("source_type").isin("wikidata", "wikipedia")).select("entity_id", (F.col("evidence_id") + 10).alias("pos"), F.col("text").alias("t"))
    both = own.select("entity_id", F.col("pos").cast("bigint").alias("pos"), "t").unionByName(other).withColumn("t", clean_content(F.col("t"))).where("t <> ''")
    best = both.groupBy("entity_id").agg(F.max_by("t", F.struct(F.length("t"), -F.col("pos"))).alias("summary"))
    return entities.select("entity_id").join(best, "entity_id", "left").select("entity_id", text(F.col("summary")).alias("summary"))


def promoted(entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """(entity_id, lat, lng, wikidataId, referenceUrls): the entity's own coordinates and identifier, else those of its evidence;
    of wikidata before maps before others, in order. A number that is 0 counts as missing."""
    good = lambda c: (F.coalesce(c["lat"], F.lit(0.0)) != 0) & (F.coalesce(c["lng"], F.lit(0.0)) != 0)
    rank = F.when(F.col("source_type") == "wikidata", 0).when(F.col("source_type") == "openstreetmap", 1).otherwise(2)
    qid = F.regexp_extract(text(F.col("url")), r"/wiki/(Q\d+)$", 1)
    refs = F.when(F.col("source_type").isin(*EXTERNAL) & (text(F.col("url")) != ""), F.col("url"))
    e = evidence.withColumn("at", F.struct(rank.alias("r"), F.col("evidence_id").alias("i")))
    agg = e.groupBy("entity_id").agg(F.min_by("coordinates", F.when(good(F.col("coordinates")), F.col("at"))).alias("c"), F.min_by(qid, F.when((F.col("source_type") == "wikidata") & (qid != ""), F.col("evidence_id"))).alias("q"))
    urls = e.select("entity_id", "evidence_id", refs.alias("u")).where("u is not null").groupBy("entity_id", "u").agg(F.min("evidence_id").alias("i")).groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "u"))), lambda x: x["u"]).alias("refs"))
    j = entities.join(agg, "entity_id", "left").join(urls, "entity_id", "left")
    own = F.col("coordinates")
    best = F.when(good(own), own).otherwise(F.coalesce("c", own))
    return j.select("entity_id", best["lat"].alias("lat"), best["lng"].alias("lng"), F.coalesce(F.nullif("wikidataId", F.lit("")), "q", F.lit("")).alias("wikidataId"), F.coalesce("refs", F.array().cast(_NONE)).alias("referenceUrls"))


def alive(images: DataFrame, status: DataFrame) -> DataFrame:
    """Of (entity_id, pos, image) those whose check (url, ok, resolved) is good or missing, under the address they lead to, once."""
    j = images.join(status, images["image"] == status["url"], "left").where(F.coalesce("ok", F.lit(True)))
    return j.select("entity_id", "pos", F.coalesce(F.nullif("resolved", F.lit("")), "image").alias("image")).groupBy("entity_id", "image").agg(F.min("pos").alias("pos"))


def flat(entities: DataFrame, evidence: DataFrame, most_images: int = 10) -> DataFrame:
    """Typed entities as one row each: summary, promoted coordinates and identifier, references, own and evidence images."""
    from .merge import ordered_distinct

    typed = entities.where(text(F.col("type")) != "")
    pics = typed.select("entity_id", F.lit(0).cast("bigint").alias("o"), "images").unionByName(evidence.select("entity_id", F.col("evidence_id").alias("o"), "images"))
    images = ordered_distinct(pics, ["entity_id"], "images", "o", "images")
    j = typed.select("entity_id", "name", "type", "types", "address").join(summary(typed, evidence), "entity_id").join(promoted(typed, evidence), "entity_id").join(images, "entity_id", "left")
    return j.withColumn("images", F.slice(F.coalesce("images", F.array().cast(_NONE)), 1, most_images))


def related_urls() -> Column:
    wd = F.when(text(F.col("wikidataId")) != "", F.concat(F.lit("https://www.wikidata.org/wiki/"), F.col("wikidataId")))
    return distinct_filled(F.concat(F.array(F.col("sourceUrl"), F.col("url"), wd), F.coalesce("relatedUrls", F.array().cast(_NONE))))


def graph_payloads(entities: DataFrame, schema: DataFrame, prefix: str = "kb", default: str = "TourismEntity", lang: str = "es") -> DataFrame:
    """(entity_id, className, mutation, externalId, object, warnings): a nested object per named entity.

    ``schema`` is (class, mutation, required): the classes that can be created; a handful of rows, so it is a literal map.
    The class is the first of type, selected type and types that the schema has, else the default, with a warning.
    """
    rows = [r.asDict() for r in schema.collect()]  # the classes of one schema
    classes = {r["class"]: r for r in rows}
    wanted = F.filter(F.transform(F.concat(F.array(F.col("type"), F.col("classificationEvidence.selected")), F.coalesce("types", F.array().cast(_NONE))), lambda t: F.regexp_replace(text(t), "[^A-Za-z0-9]", "")), lambda t: t.isin(*classes))
    cls = F.coalesce(F.get(wanted, F.lit(0)), F.lit(default))
    mutation = F.create_map(*[F.lit(x) for k, r in classes.items() for x in (k, r["mutation"])])
    short = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("shortDescription", "description", "sourceText", "name")])
    long = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("longDescription", "description", "sourceText")], short)
    source = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("wikidataId", "sourceUrl", "url", "name")])
    e = entities.where(text(F.col("name")) != "").withColumns({"cls": cls, "xid": external_id(F.lit(prefix), cls, F.col("name"), source)})
    lat, lng = F.col("coordinates.lat"), F.col("coordinates.lng")
    placed = lat.isNotNull() & lng.isNotNull()
    link = F.coalesce(F.nullif("url", F.lit("")), F.nullif("sourceUrl", F.lit("")))
    reach = (text(F.col("email")) != "") | (text(F.col("phone")) != "") | link.isNotNull()
    one = lambda c: F.when(text(F.col(c)) != "", F.array(c)).otherwise(F.array().cast(_NONE))
    pics = F.filter("images", lambda u: text(u) != "")
    uri = F.concat(F.lit("https://schema.org/"), F.coalesce(F.get(F.filter("types", lambda t: t.isin(*dims.EVENT_URIS)), F.lit(0)), F.lit("Event")))
    event = F.col("cls") == "Event"
    obj = F.struct(
        F.col("xid").alias("externalId"), F.array(literal(F.col("name"), lang)).alias("name"),
        F.array(F.struct(F.array(literal(short, lang)).alias("shortDescription"), F.array(literal(long, lang)).alias("longDescription"), F.array_sort(distinct_filled(F.concat(F.array("type"), F.coalesce("types", F.array().cast(_NONE))))).alias("keyword"))).alias("hasDescription"),
        F.when(F.size(related_urls()) > 0, related_urls()).alias("relatedTo"),
        F.when(reach, F.array(F.struct(one("email").alias("email"), one("phone").alias("telephone"), link.alias("url")))).alias("hasContactPoint"),
        F.when(placed | (text(F.col("address")) != ""), F.array(F.struct(F.nullif("address", F.lit("")).alias("streetAddress"), F.when(placed, lat).alias("lat"), F.when(placed, lng).alias("long"), F.when(placed, wkt(lat, lng)).alias("asWkt")))).alias("hasLocation"),
        F.when(F.size(pics) > 0, F.struct(F.get(pics, F.lit(0)).alias("mainImage"), F.slice(pics, 2, F.size(pics)).alias("secondaryImage"))).alias("hasMultimedia"),
        F.when(F.size("types") > 0, F.filter("types", lambda t: text(t) != "")).alias("hasAdditionalType"),
        F.when(event, F.nullif("startDate", F.lit(""))).alias("startsAt"), F.when(event, F.nullif("endDate", F.lit(""))).alias("endsAt"), F.when(event, uri).alias("eventType"),
    )
    required = F.create_map(*[x for k, r in classes.items() for x in (F.lit(k), F.array(*map(F.lit, r["required"])).cast(_NONE))])
    out = e.withColumn("object", F.to_json(obj))
    have = F.json_object_keys("object")
    missing = F.array_sort(F.array_except(F.coalesce(F.try_element_at(required, F.col("cls")), F.array().cast(_NONE)), have))
    unknown = F.when(F.size(wanted) == 0, F.array(F.lit(f"no class of the schema; using {default}"))).otherwise(F.array().cast(_NONE))
    silent = F.when((text(F.col("shortDescription")) == "") & (text(F.col("description")) == "") & (text(F.col("sourceText")) == ""), F.array(F.lit("missing description text; using the name"))).otherwise(F.array().cast(_NONE))
    warnings = F.concat(unknown, silent, F.transform(missing, lambda m: F.concat(F.lit("missing required "), F.col("cls"), F.lit("Input."), m)))
    return out.select("entity_id", F.col("cls").alias("className"), F.try_element_at(mutation, F.col("cls")).alias("mutation"), F.col("xid").alias("externalId"), "object", warnings.alias("warnings"))


def mutation_text(mutation: Column, cls: Column) -> Column:
    """The query that creates an object of a class."""
    return F.format_string("mutation Create%s($dti: String!, $input: %sRefInput!, $org: String) {\n  %s(dti: $dti, input: $input, org: $org) {\n    uri\n  }\n}", cls, cls, mutation)


def envelope(payloads: DataFrame) -> DataFrame:
    """One row: how many payloads and warnings there are."""
    return payloads.agg(F.count("*").alias("count"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warningCount"))


def stamped(evidence: DataFrame, page: Column) -> DataFrame:
    """Evidence with its page filled in where it is missing."""
    return evidence.withColumn("page_url", F.coalesce(F.nullif("page_url", F.lit("")), page))


def checked_items(items: DataFrame, dti: str | None = None, inline: bool = False, drop: str | None = None) -> DataFrame:
    """(pos, item, valid) of (pos, item), JSON texts to send: with another ``dti``, objects inlined (no uri and externalId beside an
    ``object``), a key dropped at any depth. Valid items have a query and variables; sending is left to the caller."""
    import json
    from collections.abc import Iterator

    import pyarrow as pa

    def walk(x):
        if isinstance(x, list):
            return [walk(y) for y in x]
        if isinstance(x, dict):
            gone = {drop} | ({"uri", "externalId"} if inline and "object" in x else set())
            return {k: walk(y) for k, y in x.items() if k not in gone}
        return x

    def one(raw: str | None) -> tuple[str | None, bool]:
        try:
            x = walk(json.loads(raw or ""))
        except ValueError:
            return raw, False
        if not isinstance(x, dict):
            return raw, False
        if dti and isinstance(x.setdefault("variables", {}), dict):
            x["variables"]["dti"] = dti
        return json.dumps(x, ensure_ascii=False), bool(x.get("query") and x.get("variables"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [one(r) for r in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.bool_())], names=["pos", "item", "valid"])

    return items.select(F.col("pos").cast("bigint"), "item").mapInArrow(run, "pos bigint, item string, valid boolean")


#: What a language model is asked to do, in the language of the pages; our own wording.
TASK = "Lee la página y devuelve las entidades turísticas o culturales que describe, como JSON según el esquema."
IDENTITY = (
    "Una entidad es lo que la página describe (un lugar, un recurso, un evento, un servicio), no su dirección web.",
    "El nombre es el que se usa en el texto; nunca una URL, un dominio ni una entrada de menú.",
    "Una página puede tener varias entidades; varios bloques sobre la misma refuerzan una sola.",
)
PROCEDURE = (
    "Aparta primero lo que rodea al contenido: menús, avisos, botones, iconos y textos legales.",
    "Decide de qué trata cada bloque y qué tipos de la lista le corresponden.",
    "Toma los datos de structured_data cuando los haya; si no, del texto y de los bloques.",
    "Asigna a cada entidad las imágenes de su bloque, sin logotipos ni adornos, cada una una vez.",
)
RULES = (
    "Usa solo tipos de tourist_types.", "Deja vacío lo que la página no diga; no inventes coordenadas ni identificadores.", "Da en score tu confianza, de 0 a 1, y en evidence la frase que la sostiene.", "Prefiere pocas entidades bien fundadas.",
)
#: Limits of the prompt: images, blocks, images a block, characters of a block and of the page's text, items of structured data.
PROMPT_IMAGES, PROMPT_BLOCKS, PROMPT_BLOCK_IMAGES, PROMPT_BLOCK_TEXT, PROMPT_TEXT, PROMPT_DATA = 25, 15, 4, 400, 10_000, 8
_ANSWER = "struct<entities:array<struct<name:string,types:array<string>,score:double,sourceUrl:string,url:string,relatedUrls:array<string>,address:string,phone:string,email:string,coordinates:struct<lat:double,lng:double>,shortDescription:string,longDescription:string,description:string,images:array<string>,wikidataId:string,evidence:string>>>"


def prompts(pages: DataFrame, blocks: DataFrame, data: DataFrame | None = None, types: list[str] | None = None) -> DataFrame:
    """(page_id, prompt): what a language model is asked about a page, as JSON: task, what an entity is, procedure, types to choose from,
    form of the answer, rules, and the page with its images, text, blocks and structured data.

    The page's text is that of its block of kind page, the first by id; blocks without title and images are left out.
    ``data`` is (page_id, pos, item), JSON texts of the page's structured data. The limits are the prompt's own; nothing is sent.
    """
    from pyspark.sql import Window

    first = lambda df, by, order, n: df.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("n") <= n)
    b = first(blocks.where((F.col("kind") != "page") & ((text(F.col("title")) != "") | (F.size("images") > 0))), "page_id", ["position", "block_uid"], PROMPT_BLOCKS)
    pics = F.transform(F.slice(F.coalesce("images", F.array().cast("array<struct<url:string,alt:string,source:string,index:string,context:string>>")), 1, PROMPT_BLOCK_IMAGES), lambda i: F.struct(i["url"].alias("url"), text(i["alt"]).alias("alt")))
    one = F.struct("n", F.col("block_id").alias("id"), text(F.col("title")).alias("title"), F.substring(text(F.col("text")), 1, PROMPT_BLOCK_TEXT).alias("text"), pics.alias("images"))
    body = b.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("n")).alias("blocks"))
    whole = blocks.where("kind = 'page'").groupBy("page_id").agg(F.min_by("text", "block_uid").alias("text"))
    p = pages.join(body, "page_id", "left").join(whole, "page_id", "left")
    if data is not None:
        items = first(data, "page_id", ["pos"], PROMPT_DATA).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("data"))
        p = p.join(items, "page_id", "left")
    else:
        p = p.withColumn("data", F.lit(None).cast(_NONE))
    images = F.transform(F.slice(F.coalesce("images", F.array().cast("array<struct<url:string,alt:string,source:string,index:string,context:string>>")), 1, PROMPT_IMAGES), lambda i: F.struct(text(i["url"]).alias("url"), text(i["alt"]).alias("alt"), text(i["context"]).alias("context"), text(i["index"]).alias("index")))
    none = F.array().cast("array<struct<id:string,title:string,text:string,images:array<struct<url:string,alt:string>>>>")
    page = F.struct(*[text(F.col(c)).alias(c) for c in ("url", "title", "description", "language")], images.alias("images"), F.substring(text(F.col("text")), 1, PROMPT_TEXT).alias("text"), F.coalesce("blocks", none).alias("blocks"), F.coalesce("data", F.array().cast(_NONE)).alias("structured_data"))
    listed = lambda xs: F.array(*map(F.lit, xs))
    prompt = F.struct(F.lit(TASK).alias("task"), listed(IDENTITY).alias("identity_contract"), listed(PROCEDURE).alias("procedure"), listed(types or dims.ALLOWED).alias("tourist_types"), F.lit(_ANSWER).alias("schema"), listed(RULES).alias("rules"), page.alias("page"))
    return p.select("page_id", F.to_json(prompt).alias("prompt"))
