"""Grouping and merging of entities and of their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import fold_texts, key, strip, strip_articles, text


def name_key(name: Column, articles: tuple[str, ...] = dims.MERGE_ARTICLES) -> Column:
    return strip_articles(key(name), articles)


def entity_key(name: Column, wikidata: Column, articles: tuple[str, ...] = dims.MERGE_ARTICLES) -> Column:
    """The identifier if there is one, else the name without articles."""
    return F.when(text(wikidata) != "", F.concat(F.lit("wikidata:"), wikidata)).otherwise(F.concat(F.lit("name:"), name_key(name, articles)))


def ordered_distinct(rows: DataFrame, keys: list[str], values: str, order: str, out: str) -> DataFrame:
    """Per keys the distinct filled values of an array column, first seen first.

    Values are made distinct before they are gathered, so a group costs its distinct values, however many rows it has.
    """
    each = rows.select(*keys, order, F.posexplode(values).alias("pos", "v")).where(text(F.col("v")) != "")
    first = each.groupBy(*keys, "v").agg(F.min(F.struct(order, "pos")).alias("at"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(out))


def merge_entities(entities: DataFrame, order: str = "entity_id", group: str | None = None) -> DataFrame:
    """One row per entity key (within ``group``, if given): the first row is the anchor and gives name, url and type; types,
    related urls and images are united in order, texts are the longest (first of equals), contact data and coordinates the
    first present, the score the highest."""
    keyed = entities.withColumn("key", entity_key(F.col("name"), F.col("wikidataId")))
    keys = ([group] if group else []) + ["key"]
    o = F.col(order)
    first = lambda c: F.min_by(c, F.when(text(F.col(c)) != "", o)).alias(c)
    longest = lambda c: F.max_by(text(F.col(c)), F.struct(F.length(text(F.col(c))), -o)).alias(c)
    out = keyed.groupBy(*keys).agg(
        F.min(o).alias(order), F.count("*").alias("rows"), F.min_by("name", o).alias("name"), F.min_by("type", o).alias("type"), F.min_by("url", o).alias("url"), F.min_by("wikidataId", o).alias("wikidataId"),
        *[longest(c) for c in ("shortDescription", "longDescription", "sourceText", "description")], *[first(c) for c in ("address", "phone", "email")],
        F.min_by("coordinates", F.when(F.col("coordinates.lat").isNotNull(), o)).alias("coordinates"), F.max("score").alias("score"),
    )
    for c in ("types", "relatedUrls", "images"):
        out = out.join(ordered_distinct(keyed, keys, c, order, c), keys, "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out


TRIPLE = ["entity_id", "url", "block_id", "source_type"]


def merge_sources(evidence: DataFrame, order: str = "evidence_id") -> DataFrame:
    """One row per entity, url, block and kind: the longest text, the first title, all images in order, the first coordinates."""
    e = evidence.select(*[text(F.col(c)).alias(c) if c != "entity_id" else F.col(c) for c in TRIPLE], order, "title", "text", "images", "coordinates", "metadata")
    o = F.col(order)
    out = e.groupBy(*TRIPLE).agg(
        F.min(o).alias(order), F.count("*").alias("rows"), F.min_by("title", F.when(text(F.col("title")) != "", o)).alias("title"), F.max_by(text(F.col("text")), F.struct(F.length(text(F.col("text"))), -o)).alias("text"),
        F.min_by("coordinates", F.when(F.col("coordinates").isNotNull(), o)).alias("coordinates"), F.max_by("metadata", o).alias("metadata"),
    )
    return out.join(ordered_distinct(e, TRIPLE, "images", order, "images"), TRIPLE, "left").withColumn("images", F.coalesce("images", F.array().cast("array<string>")))


def accumulated_text(evidence: DataFrame, by: str = "entity_id", order: str = "evidence_id") -> DataFrame:
    """Per entity its evidence texts in order, each added unless it is a copy or part of what is there, or navigation.

    Adding depends on the order, so an entity's texts meet in one row; copies are dropped before.
    """
    texts = evidence.withColumn("text", strip(F.col("text"))).where("text <> ''").groupBy(by, "text").agg(F.min(order).alias("at"))
    ordered = texts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("texts"))
    return ordered.select(by, fold_texts(F.col("texts")).alias("text"))


def upsert(kb: DataFrame, new: DataFrame, kb_id: str, new_id: str) -> DataFrame:
    """Full outer join of two sets by entity key: (key, kb, new, state) with state kept, enriched or added; duplicates within a
    side are merged into its first row."""
    side = lambda df, i, n: df.groupBy(entity_key(F.col("name"), F.col("wikidataId")).alias("key")).agg(F.min(i).alias(n))
    out = side(kb, kb_id, "kb").join(side(new, new_id, "new"), "key", "full_outer")
    return out.withColumn("state", F.when(F.col("kb").isNull(), "added").when(F.col("new").isNull(), "kept").otherwise("enriched"))


def enriched(base: DataFrame, incoming: DataFrame, on: str = "key", most_images: int = 10) -> DataFrame:
    """Rows of ``base`` with what matched rows of ``incoming`` (one per key) add: texts, images, allowed types, surer coordinates,
    missing contact data and identifier, the higher score."""
    from ..functions.text import merge_text

    b, i = base.alias("b"), incoming.alias("i")
    arr = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    fill = lambda c: F.when(text(F.col(f"b.{c}")) != "", F.col(f"b.{c}")).otherwise(F.coalesce(F.nullif(F.col(f"i.{c}"), F.lit("")), F.col(f"b.{c}"))).alias(c)
    surer = F.col("i.coordinates.lat").isNotNull() & (F.col("b.coordinates.lat").isNull() | (F.coalesce(F.col("i.coordinates.confidence"), F.lit(0.0)) > F.coalesce(F.col("b.coordinates.confidence"), F.lit(0.0))))
    allowed = F.array(*map(F.lit, dims.ALLOWED))
    own = F.array_distinct(arr("b.images"))
    return b.join(i, on, "left").select(
        on, F.col("b.name").alias("name"), *[merge_text(F.col(f"b.{c}"), F.col(f"i.{c}")).alias(c) for c in ("shortDescription", "longDescription", "sourceText", "description")],
        F.slice(F.array_distinct(F.filter(F.concat(own, arr("i.images")), lambda u: text(u) != "")), 1, F.greatest(F.lit(most_images), F.size(own))).alias("images"),
        F.array_intersect(F.concat(arr("b.types"), arr("i.types")), allowed).alias("types"), F.when(surer, F.col("i.coordinates")).otherwise(F.col("b.coordinates")).alias("coordinates"),
        *[fill(c) for c in ("address", "phone", "email", "wikidataId")], F.greatest("b.score", "i.score").alias("score"),
    )


def first_of_group(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per keys (a window of rank one, which Spark limits per group before it shuffles)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
