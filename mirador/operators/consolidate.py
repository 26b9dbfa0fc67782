"""Normalising extracted entities, and letting their evidence fill them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import images as I
from ..functions.text import clean_content, clean_name, distinct_filled, key, merge_text, strip, text, valid_address

_NONE = "array<string>"


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(_NONE))


def normalized(entities: DataFrame) -> DataFrame:
    """Entities with clean names and texts; addresses only if they can be; images moved out of the urls, which lose the page's own;
    lists distinct; missing descriptions filled from the other."""
    urls = F.concat(_list("relatedUrls"), F.array("url"))
    own = F.when((text(F.col("url")) == "") | I.is_image(F.col("url")) | F.col("url").eqNullSafe(F.col("sourceUrl")), "").otherwise(F.col("url"))
    d = clean_content(F.col("description"))
    fill = lambda c, n: F.when(clean_content(F.col(c)) != "", clean_content(F.col(c))).otherwise(F.substring(d, 1, n))
    return entities.withColumns({
        "name": clean_name(F.col("name")), "shortDescription": fill("shortDescription", 300), "longDescription": fill("longDescription", 1 << 30), "description": d, "sourceText": clean_content(F.col("sourceText")), "evidence": clean_content(F.col("evidence")),
        "address": F.when(valid_address(F.col("address")), F.col("address")).otherwise(""), "images": distinct_filled(F.concat(_list("images"), F.filter(urls, lambda u: (text(u) != "") & I.is_image(u)))),
        "relatedUrls": distinct_filled(F.concat(F.filter(_list("relatedUrls"), lambda u: ~I.is_image(u)), F.array(own))), "url": own,
    })


def consolidated(entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """(entity_id, relatedUrls, images, longDescription, address, phone): evidence from beyond the pages adds its url, its images that are
    trusted or fit the name, and its text; any evidence's contact data fill gaps, the first in order."""
    out = ~F.col("source_type").isin("page", "page_block") & (text(F.col("url")) != "")
    e = evidence.join(entities.select("entity_id", key(F.col("name")).alias("k")), "entity_id")
    first = lambda c: F.min_by(f"metadata.{c}", F.when(text(F.col(f"metadata.{c}")) != "", F.col("evidence_id")))
    gaps = e.groupBy("entity_id").agg(first("address").alias("e_address"), first("phone").alias("e_phone"))
    # Distinct per entity before they are gathered.
    outer = e.where(out)
    urls = outer.groupBy("entity_id", "url").agg(F.min("evidence_id").alias("i")).groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "url"))), lambda x: x["url"]).alias("e_urls"))
    pics = outer.select("entity_id", "evidence_id", "k", F.posexplode("images").alias("p", "u")).where((text(F.col("u")) != "") & (I.is_trusted(F.col("u")) | I.fits(F.col("u"), F.col("k"))))
    images = pics.groupBy("entity_id", "u").agg(F.min(F.struct("evidence_id", "p")).alias("i")).groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "u"))), lambda x: x["u"]).alias("e_images"))
    texts = outer.select("entity_id", "evidence_id", strip(F.col("text")).alias("t")).where("t <> ''").groupBy("entity_id", "t").agg(F.min("evidence_id").alias("i")).groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("e_texts"))
    j = entities
    for other in (gaps, urls, images, texts):
        j = j.join(other, "entity_id", "left")
    own = lambda c, e_: F.when(text(F.col(c)) != "", F.col(c)).otherwise(text(F.col(e_))).alias(c)
    return j.select(
        "entity_id", distinct_filled(F.concat(_list("relatedUrls"), _list("e_urls"))).alias("relatedUrls"), distinct_filled(F.concat(_list("images"), _list("e_images"))).alias("images"),
        F.aggregate(_list("e_texts"), strip(F.col("longDescription")), merge_text).alias("longDescription"), own("address", "e_address"), own("phone", "e_phone"),
    )


def propagated(pairs: DataFrame) -> DataFrame:
    """Both sides of resolved pairs (a_wd, b_wd) get the identifier that one of them has."""
    a, b = F.nullif("a_wd", F.lit("")), F.nullif("b_wd", F.lit(""))
    return pairs.withColumns({"a_wd": text(F.coalesce(a, b)), "b_wd": text(F.coalesce(b, a))})


def seen_images(labels: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, image, how) of (page, image, label), where a label names an entity of the page: as written, else as a part of the
    name or the name as a part of it, the first entity then. Labels that say none are left out."""
    # Labels that say none.
    none = ("", "none", "ninguna", "ninguno", "null", "n/a", "no")
    l = labels.select("page", "image", F.lower(F.trim("label")).alias("l")).where(~F.col("l").isin(*none))
    e = entities.select("entity_id", F.col("sourceUrl").alias("page"), F.lower(F.trim("name")).alias("n")).where("n <> ''")
    j = l.join(e, "page")
    how = F.when(F.col("l") == F.col("n"), 0).when(F.contains("n", "l") | F.contains("l", "n"), 1)
    best = j.withColumn("how", how).where("how is not null").groupBy("page", "image").agg(F.min(F.struct("how", "entity_id")).alias("b"))
    return best.select("b.entity_id", "image", F.when(F.col("b.how") == 0, "name").otherwise("part").alias("how"))


def accepted_images(judged: DataFrame) -> DataFrame:
    """(entity_id, accepted, rejected): the images judged (entity_id, image, related) to show an entity, and not to, in order of address."""
    of = lambda yes: F.array_sort(F.collect_set(F.when(F.coalesce("related", F.lit(False)) == yes, F.col("image"))))
    return judged.groupBy("entity_id").agg(of(True).alias("accepted"), of(False).alias("rejected"))
