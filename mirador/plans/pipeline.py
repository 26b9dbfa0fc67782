"""From pages to resolved, typed entities: one chain of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import quality, valid_entity
from ..functions.text import text
from ..operators import classify as C, consolidate as N, html as H, match as M, merge as R, resolve as V
from ..sources.tables import cut

_NONE = "array<string>"
COORDINATES = "struct<lat:double,lng:double,source:string,confidence:double>"


def candidates(parsed: DataFrame, as_of: str) -> DataFrame:
    """Candidate entities of parsed pages: of the title, of structured data, of blocks, in this order; normalised, and valid ones only."""
    blank = lambda c: F.lit("").alias(c)
    pages = parsed.select(F.col("url").alias("page_id"), "url", "title", "description", "main_text")
    titles = H.title_entities(pages, F.lit(as_of).cast("date")).join(pages.select("page_id", "description"), "page_id")
    a = titles.select(F.col("page_id").alias("page"), F.lit(0).alias("rank"), F.lit(0).alias("pos"), "name", F.array("type").alias("types"), F.lit(0.9).alias("score"), text(F.col("description")).alias("description"), F.col("start").alias("startDate"), F.col("end").alias("endDate"), blank("address"), blank("phone"), F.lit(None).cast(COORDINATES).alias("coordinates"))
    s = H.structured_entities(H.structured_data(parsed))
    b = s.select(F.col("url").alias("page"), F.lit(1).alias("rank"), "pos", "name", F.array("type").alias("types"), F.lit(0.9).alias("score"), "description", F.col("start").alias("startDate"), F.col("end").alias("endDate"), "address", "phone", F.struct("lat", "lng", F.lit("json-ld").alias("source"), F.lit(0.95).alias("confidence")).alias("coordinates"))
    blocks = H.page_blocks(parsed).withColumn("block_uid", F.xxhash64("url", "block_id"))
    names = H.block_names(blocks).join(blocks.select("block_uid", "url", "position"), "block_uid")
    c = names.select(F.col("url").alias("page"), F.lit(2).alias("rank"), F.col("position").alias("pos"), "name", F.array().cast(_NONE).alias("types"), F.lit(0.45).alias("score"), F.col("long").alias("description"), blank("startDate"), blank("endDate"), blank("address"), blank("phone"), F.lit(None).cast(COORDINATES).alias("coordinates"))
    u = a.unionByName(b).unionByName(c)
    e = u.select("page", "name", "types", "score", "description", "startDate", "endDate", "address", "phone", "coordinates", F.xxhash64("page", "rank", "pos", "name").alias("entity_id"), (F.col("rank") * 1_000_000 + F.col("pos")).cast("bigint").alias("order"), F.col("page").alias("sourceUrl"), *[blank(x) for x in ("type", "url", "email", "shortDescription", "longDescription", "sourceText", "wikidataId", "evidence")], *[F.array().cast(_NONE).alias(x) for x in ("relatedUrls", "images")])
    n = cut(N.normalized(cut(e)))  # else the long expressions of one step are repeated within those of the next
    return n.where(valid_entity(*[F.col(x) for x in ("name", "sourceUrl", "types", "shortDescription", "longDescription", "description", "sourceText", "evidence")]))


def process(pages: DataFrame, as_of: str) -> DataFrame:
    """(url, html) to entities merged within their page, with images, type and score."""
    parsed = cut(H.parse(pages))
    e = cut(candidates(parsed, as_of))
    merged = R.merge_entities(e, order="order", group="page").withColumn("entity_id", F.xxhash64("page", "key")).withColumn("sourceUrl", F.col("page"))
    merged = cut(merged)
    images = M.image_matches(merged, H.page_images(parsed).select(F.col("url").alias("page"), "image", "alt", "context", "idx")).where("rank <= 8")
    pics = images.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "image"))), lambda x: x["image"]).alias("found"))
    none = pages.sparkSession.createDataFrame([], "entity_id bigint, source_type string, title string, text string")
    typed = C.classify(merged, none).withColumnsRenamed({"type": "t", "types": "ts"})
    j = merged.join(pics, "entity_id", "left").join(typed, "entity_id")
    return j.withColumns({"type": F.col("t"), "types": F.col("ts"), "images": F.array_distinct(F.concat("images", F.coalesce("found", F.array().cast(_NONE))))}).drop("t", "ts", "found", "order")


def crawl(pages: DataFrame, kb: DataFrame, as_of: str, threshold: float = V.THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Entities of good quality, and what each was found to be in the knowledge base (entity_id, name, wikidataId, coordinates, address, types)."""
    e = process(pages, as_of)
    good = cut(e.where(quality(F.col("name"), F.col("coordinates.lat"), F.col("wikidataId"), F.col("url"), F.col("sourceUrl"), F.col("score"), F.col("types"))))
    return good, V.resolve(kb, good, "entity_id", "entity_id", threshold)


def empty_kb(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"entity_id bigint, name string, wikidataId string, coordinates {COORDINATES}, address string, types array<string>")
