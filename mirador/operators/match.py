"""Joining entities with the blocks and images of their page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import images as I
from ..functions.text import address, clean_content, key, phone, relevant_text, source_text_score, text, word_count


def block_matches(entities: DataFrame, blocks: DataFrame, most: int = 5) -> DataFrame:
    """(entity_id, block_uid, score, rank): the page's best blocks for each entity (its ``sourceUrl`` is the block's ``url``).

    A block scores by the whole name in its text (100) and title (80) and by the name's longer words (10 each, if two of
    them or all are there); scored blocks gain for being short and lose for being long. Ties: the shorter text, then the
    smaller id.
    """
    e = entities.select("entity_id", F.col("sourceUrl").alias("page"), key(F.col("name")).alias("k")).where("k <> ''")
    b = blocks.select("block_uid", F.col("url").alias("page"), key(F.concat_ws(" ", text(F.col("title")), text(F.col("text")))).alias("body"), key(F.col("title")).alias("head"), F.length(text(F.col("text"))).alias("size"))
    longer = F.filter(F.split("k", " "), lambda w: F.length(w) >= 4)
    hits = F.size(F.filter(longer, lambda w: F.contains(F.col("body"), w)))
    score = F.when(F.contains("body", "k"), 100).otherwise(0) + F.when(F.contains("head", "k"), 80).otherwise(0) + F.when((F.size(longer) > 0) & (hits >= F.least(F.lit(2), F.size(longer))), hits * 10).otherwise(0)
    n = word_count(F.col("body"))
    j = e.join(b, "page").withColumn("score", score).where("score > 0")
    j = j.withColumn("score", F.col("score") + F.when(n <= 120, 30).when(n > 600, -60).when(n > 450, -40).otherwise(0))
    w = Window.partitionBy("entity_id").orderBy(F.desc("score"), "size", "block_uid")
    return j.select("entity_id", "block_uid", "score", F.row_number().over(w).alias("rank")).where(F.col("rank") <= most)


def attached(entities: DataFrame, blocks: DataFrame) -> DataFrame:
    """Evidence rows: (entity_id, block_id, source_type, text, address, phone): matched blocks, or the page where none matches."""
    m = block_matches(entities, blocks).join(blocks.select("block_uid", "block_id", "text"), "block_uid")
    e = entities.select("entity_id", "name", F.coalesce(F.nullif("evidence", F.lit("")), F.nullif("description", F.lit("")), F.col("shortDescription")).alias("own"))
    j = e.join(m.select("entity_id", "block_id", "rank", F.col("text").alias("body")), "entity_id", "left")
    t = F.when(F.col("rank").isNotNull(), clean_content(relevant_text(F.col("name"), F.col("body")))).otherwise(text(F.col("own")))
    j = j.withColumn("t", t)
    return j.select(
        "entity_id", F.coalesce("rank", F.lit(1)).alias("rank"), F.coalesce("block_id", F.lit("page")).alias("block_id"), F.when(F.col("rank").isNull(), "page").otherwise("page_block").alias("source_type"), F.col("t").alias("text"),
        F.when(F.col("rank").isNotNull(), address(F.col("t"))).otherwise("").alias("address"), F.when(F.col("rank").isNotNull(), phone(F.col("t"))).otherwise("").alias("phone"),
    )


def best_source_text(evidence: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, evidence_id, score): the evidence whose text serves the entity's name best, the first of equals."""
    j = evidence.where(text(F.col("text")) != "").select("entity_id", "evidence_id", "text").join(entities.select("entity_id", "name"), "entity_id")
    s = j.select("entity_id", "evidence_id", source_text_score(F.col("text"), F.col("name")).alias("score"))
    best = s.groupBy("entity_id").agg(F.max(F.struct("score", (-F.col("evidence_id")).alias("first"))).alias("b"))
    return best.select("entity_id", (-F.col("b.first")).alias("evidence_id"), F.col("b.score").alias("score"))


def page_images(pages: DataFrame) -> DataFrame:
    """(page, image, alt, context, idx): the images of each page, in the order of the document."""
    p = pages.select(F.col("url").alias("page"), "page_id", F.explode("images").alias("i"))
    idx = F.coalesce(F.expr("try_cast(nullif(i.index, '') as int)"), F.lit(999999))
    return p.select("page", "page_id", F.col("i.url").alias("image"), F.col("i.alt").alias("alt"), F.col("i.context").alias("context"), idx.alias("idx")).where(text(F.col("image")) != "")


def image_matches(entities: DataFrame, images: DataFrame) -> DataFrame:
    """(entity_id, image, level, score, rank): for each entity the page's images that fit its name by path or caption, else those
    whose surroundings name it, else, where the page has this one entity only, all that are no noise.

    Within a level the better score goes first, then the document's order. ``images`` is (page, image, alt, context, idx).
    """
    e = entities.select("entity_id", F.col("sourceUrl").alias("page"), key(F.col("name")).alias("k"))
    alone = F.count("*").over(Window.partitionBy("page")) == 1
    i = images.groupBy("page", "image").agg(F.min(F.struct("idx", "alt", "context")).alias("x")).select("page", "image", "x.*")
    j = e.withColumn("alone", alone).join(i, "page").where(~I.is_generic(F.col("image")))
    direct = F.greatest(I.url_score(F.col("image"), F.col("k")), I.alt_score(F.col("alt"), F.col("k")))
    quiet = ~I.is_noise(F.col("image"))
    around = F.greatest(I.alt_score(F.col("alt"), F.col("k")), I.context_score(F.col("context"), F.col("k")))
    named = F.col("k") != ""
    level = F.when(named & (direct > 0), 1).when(named & quiet & (around > 0), 2).when(F.col("alone") & quiet, 3)
    score = F.when(level == 1, direct).when(level == 2, around).otherwise(0)
    j = j.select("entity_id", "image", "idx", level.alias("level"), score.alias("score")).where("level is not null")
    top = Window.partitionBy("entity_id")
    w = top.orderBy(F.desc("score"), "idx", "image")
    return j.withColumn("best", F.min("level").over(top)).where("level = best").select("entity_id", "image", "level", "score", F.row_number().over(w).alias("rank"))


def vision_pairs(matches: DataFrame, per_entity: int = 5, batch: int = 8) -> DataFrame:
    """(entity_id, image, pair, batch): the pairs to look at, at most ``per_entity`` each, numbered within the entity's page order."""
    m = matches.where(F.col("rank") <= per_entity)
    return m.select("entity_id", "image", "rank", F.floor((F.col("rank") - 1) / batch).cast("int").alias("batch"))
