"""Counts, coverage and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import navigation_block, noise_block, tourist_reasons
from ..functions.text import key, text
from ..functions.urls import domain
from .merge import ordered_distinct


def primary_type() -> Column:
    return F.coalesce(F.nullif("type", F.lit("")), F.get("types", F.lit(0)))


def count_by_type(entities: DataFrame, order: str = "entity_id") -> DataFrame:
    """(type, entities, rank): by the primary type, most first, then the first seen."""
    from pyspark.sql import Window

    c = entities.select(primary_type().alias("type"), order).where(text(F.col("type")) != "").groupBy("type").agg(F.count("*").alias("entities"), F.min(order).alias("first"))
    return c.select("type", "entities", F.row_number().over(Window.orderBy(F.desc("entities"), "first")).alias("rank"))  # as many rows as types


def page_of() -> Column:
    """The page that evidence comes from: stamped, else named in its metadata, else its url."""
    return F.coalesce(F.nullif("page_url", F.lit("")), F.nullif("metadata.page_url", F.lit("")), F.nullif("url", F.lit("")), F.lit(""))


def count_by_page(evidence: DataFrame) -> DataFrame:
    pairs = evidence.select(page_of().alias("page"), "entity_id").where("page <> ''").distinct()
    return pairs.groupBy("page").agg(F.count("*").alias("entities"))


def silent_pages(pages: DataFrame, evidence: DataFrame) -> DataFrame:
    """Pages fetched well that no entity's evidence comes from."""
    used = evidence.select(page_of().alias("url")).distinct()
    return pages.where("status = 'ok'").select("url").distinct().join(used, "url", "left_anti")


def block_coverage(blocks: DataFrame, evidence: DataFrame, entities: DataFrame) -> DataFrame:
    """(block_uid, url, status, reasons, covered_by): what became of each block that tells of a place.

    In this order: evidence of an entity, named by entities of its page, navigation, noise, else unresolved. An entity
    names a block that holds its whole name, or two of its longer words (all, if it has fewer).
    """
    b = blocks.withColumn("reasons", tourist_reasons(F.col("title"), F.col("text"), F.coalesce(F.size("images"), F.lit(0)))).where(F.size("reasons") > 0)
    direct = evidence.where("block_id <> '' and block_id <> 'page'").select("url", "block_id").distinct().withColumn("direct", F.lit(True))
    named = entities.select(F.col("sourceUrl").alias("url"), "entity_id", "name", key(F.col("name")).alias("k")).withColumn("long", F.filter(F.split("k", " "), lambda w: F.length(w) >= 4)).where(F.size("long") > 0)
    body = key(F.concat_ws(" ", text(F.col("title")), text(F.col("text"))))
    hits = F.size(F.filter("long", lambda w: F.contains(F.col("body"), w)))
    # Names are distinct per page before they meet the blocks.
    names = named.groupBy("url", "k", "long").agg(F.min(F.struct("entity_id", "name")).alias("n"))
    met = b.select("block_uid", "url", body.alias("body")).join(names, "url").where(F.contains("body", "k") | (hits >= F.least(F.lit(2), F.size("long"))))
    covered = ordered_distinct(met.select("block_uid", F.array("n.name").alias("names"), F.col("n.entity_id").alias("entity_id")), ["block_uid"], "names", "entity_id", "names")
    j = b.join(direct, ["url", "block_id"], "left").join(covered, "block_uid", "left")
    status = (
        F.when(F.col("direct"), "attached_to_entity").when(F.size("names") > 0, "covered_by_related_entities")
        .when(navigation_block(F.col("title"), F.col("text")), "discarded_navigation").when(noise_block(F.col("text")), "discarded_noise").otherwise("unresolved_relevant")
    )
    return j.select("block_uid", "url", status.alias("status"), F.array_join("reasons", ",").alias("reasons"), F.when(status == "covered_by_related_entities", F.array_join(F.slice("names", 1, 8), "|")).otherwise("").alias("covered_by"))


def coverage_summary(coverage: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per page: blocks, candidates, covered and uncovered ones, their ratio, and the number of each status."""
    total = blocks.groupBy("url").agg(F.count("*").alias("total_blocks"))
    states = ("attached_to_entity", "covered_by_related_entities", "discarded_navigation", "discarded_noise", "unresolved_relevant")
    c = coverage.groupBy("url").agg(F.count("*").alias("candidates"), *[F.count_if(F.col("status") == s).alias(s) for s in states])
    covered = F.col("candidates") - F.col("unresolved_relevant")
    j = total.join(c, "url", "left")
    zero = lambda x: F.coalesce(x, F.lit(0).cast("bigint"))
    return j.select("url", "total_blocks", zero(F.col("candidates")).alias("candidates"), zero(covered).alias("covered"), zero(F.col("unresolved_relevant")).alias("uncovered"), F.round(covered / F.col("candidates"), 3).alias("ratio"), *[zero(F.col(s)).alias(s) for s in states])


def compare(actual: DataFrame, expected: DataFrame, actual_id: str, expected_id: str) -> DataFrame:
    """(key, state, type_match): names found, missing and additional; of rows of one name the last counts. Types match if they
    share one, or none is expected."""
    def side(df: DataFrame, i: str, n: str) -> DataFrame:
        types = F.transform(F.array_distinct(F.filter(F.concat(F.array("type"), F.coalesce("types", F.array().cast("array<string>"))), lambda t: text(t) != "")), key)
        return df.where(text(F.col("name")) != "").groupBy(key(F.col("name")).alias("key")).agg(F.max_by(types, F.col(i)).alias(n))

    j = side(actual, actual_id, "a").join(side(expected, expected_id, "e"), "key", "full_outer")
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "additional").otherwise("found")
    return j.select("key", state.alias("state"), F.when(state == "found", F.arrays_overlap("a", "e") | (F.size("e") == 0)).alias("type_match"))


def on_domain(entities: DataFrame, url: str) -> DataFrame:
    """Entities of which any url is on the domain of ``url``."""
    urls = F.concat(F.array("url", "sourceUrl"), F.coalesce("relatedUrls", F.array().cast("array<string>")))
    return entities.where(F.exists(urls, lambda u: domain(u) == domain(F.lit(url))))


def duplicate_groups(rows: DataFrame, name: Column, order: str) -> DataFrame:
    return rows.groupBy(key(name).alias("key")).agg(F.count("*").alias("rows"), F.min(order).alias("first")).where("rows > 1 and key <> ''")


def crawl_report(pages: DataFrame, by: str = "site") -> DataFrame:
    """Per site: pages, good and failed ones, pages without title, errors, repeated urls."""
    return pages.groupBy(by).agg(F.count("*").alias("pages"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"), F.count_if(text(F.col("title")) == "").alias("untitled"), F.sum(F.coalesce(F.size("errors"), F.lit(0))).alias("errors"), (F.count("*") - F.count_distinct("url")).alias("repeated"))


def markdown_tables(entities: DataFrame, evidence: DataFrame, pages: DataFrame, day: str) -> DataFrame:
    """(part, pos, line): the head of the report and the rows of its tables by type and by page, most entities first."""
    from pyspark.sql import Window

    row = lambda c: F.concat(F.lit("| "), c, F.lit(" | "), F.col("entities").cast("string"), F.lit(" |")).alias("line")
    types = count_by_type(entities).select(F.lit("type").alias("part"), F.col("rank").alias("pos"), row("type"))
    # Pages are ranked by how many pages have more entities (as many counts as differ), then among their equals, each count its own window.
    pages_ = count_by_page(evidence)
    counts = pages_.groupBy("entities").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("entities")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # as many rows as counts
    ranked = pages_.join(before, "entities").withColumn("pos", (F.col("before") + F.row_number().over(Window.partitionBy("entities").orderBy("page"))).cast("int"))
    total = entities.agg(F.count("*").alias("e")).crossJoin(pages.where("status = 'ok'").agg(F.count_distinct("url").alias("p")))  # one row each
    head = F.concat(F.lit(f"*Generado: {day} - "), F.col("p").cast("string"), F.lit(" paginas procesadas - "), F.col("e").cast("string"), F.lit(" entidades*"))
    return types.unionByName(ranked.select(F.lit("page").alias("part"), "pos", row("page"))).unionByName(total.select(F.lit("head").alias("part"), F.lit(1).alias("pos"), head.alias("line")))


def markdown_cards(entities: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(entity_id, card): the entity's part of the report, with the number of its ``evidence`` rows and of their pages if given."""
    if evidence is None:
        entities = entities.withColumns({"_n": F.lit(0), "_p": F.lit(0)})
    else:
        seen = evidence.groupBy("entity_id").agg(F.count("*").alias("_n"), F.count_distinct(F.nullif(page_of(), F.lit(""))).alias("_p"))
        entities = entities.join(seen, "entity_id", "left")
    t = primary_type()
    others = F.array_join(F.filter("types", lambda x: (text(x) != "") & ~x.eqNullSafe(t)), ", ")
    bold = lambda label, body: F.concat(F.lit(f"**{label}:** "), body, F.lit("  \n"))
    coords = F.concat(F.col("coordinates.lat").cast("string"), F.lit(", "), F.col("coordinates.lng").cast("string"), F.when(F.col("coordinates.confidence").isNotNull(), F.format_string(" *(confianza: %.2f)*", F.col("coordinates.confidence"))).otherwise(""))
    short = F.trim(text(F.col("shortDescription")))
    parts = [
        F.concat(F.lit("### "), F.coalesce(F.nullif("name", F.lit("")), F.lit("Sin nombre")), F.lit("\n\n")), bold("Tipo", F.coalesce(t, F.lit("-"))), F.when(others != "", bold("Tipos relacionados", others)), F.when(short != "", bold("Descripcion", F.substring(short, 1, 300))),
        F.when(F.col("coordinates.lat").isNotNull() & F.col("coordinates.lng").isNotNull(), bold("Coordenadas", coords)), F.when(F.trim(text(F.col("address"))) != "", bold("Direccion", F.trim("address"))),
        F.when(F.size("images") > 0, bold("Imagenes", F.size("images").cast("string"))), F.when(F.col("_n") > 0, bold("Fuentes", F.concat(F.col("_n").cast("string"), F.lit(" evidencias"), F.when(F.col("_p") == 1, " - 1 pagina").when(F.col("_p") > 1, F.concat(F.lit(" - "), F.col("_p").cast("string"), F.lit(" paginas"))).otherwise("")))), F.when(F.trim(text(F.col("wikidataId"))) != "", bold("Wikidata", F.trim("wikidataId"))),
    ]
    return entities.select("entity_id", F.concat(*[F.coalesce(p, F.lit("")) for p in parts], F.lit("\n---\n")).alias("card"))
