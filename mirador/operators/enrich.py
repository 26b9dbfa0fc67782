"""Enrichment from lookup tables: coordinates, external evidence, images near a place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import distance_km, search_radius
from ..functions.text import ascii_fold, compact, let, text


def city_of(pages: DataFrame, cities: DataFrame) -> DataFrame:
    """(page_id, city): the first known city (key, name, ord) named in a page's url, title or description. ``cities`` is a short table."""
    rows = sorted((r["ord"], r["key"], r["name"]) for r in cities.collect())  # the known cities
    known = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for _, k, n in rows])
    hay = F.lower(F.concat_ws(" ", text(F.col("url")), text(F.col("title")), text(F.col("description"))))
    hit = let(hay, lambda h: F.get(F.filter(known, lambda c: F.contains(h, c["k"])), F.lit(0))["n"])
    return pages.select("page_id", text(hit).alias("city"))


def near_cities(points: DataFrame, cities: DataFrame, degrees: float = 0.5) -> DataFrame:
    """(point_id, city_id, km): the cities within whose radius each point lies.

    Cities are copied to all cells of a grid that their radius reaches, points look up their own cell: an equi-join, with
    the exact distance after.
    """
    lat, lng = F.col("lat"), F.col("lng")
    reach = F.col("radius_km") / 111.0
    wide = reach / F.greatest(F.lit(0.05), F.cos(F.radians("lat")))
    cells = lambda c, r: F.sequence(F.floor((c - r) / degrees).cast("int"), F.floor((c + r) / degrees).cast("int"))
    c = cities.select("city_id", F.col("lat").alias("clat"), F.col("lng").alias("clng"), "radius_km", F.explode(cells(lat, reach * 1.01)).alias("y"), lat, lng, wide.alias("w")).withColumn("x", F.explode(cells(F.col("lng"), F.col("w") * 1.01))).select("city_id", "clat", "clng", "radius_km", "y", "x")
    p = points.select("point_id", "lat", "lng", F.floor(lat / degrees).cast("int").alias("y"), F.floor(lng / degrees).cast("int").alias("x"))
    km = distance_km(F.col("lat"), F.col("lng"), F.col("clat"), F.col("clng"))
    return p.join(c, ["y", "x"]).withColumn("km", km).where("km <= radius_km").select("point_id", "city_id", F.round("km", 6).alias("km"))


def nearest_city(near: DataFrame) -> DataFrame:
    return near.groupBy("point_id").agg(F.min(F.struct("km", "city_id")).alias("m")).select("point_id", "m.city_id", "m.km")


def coordinates(entities: DataFrame, candidates: DataFrame, lookups: DataFrame | None = None) -> DataFrame:
    """(entity_id, lat, lng, source, confidence): the entity's own coordinates, else its page's surest candidate (if sure enough, or
    the only one), else a lookup (entity_id, lat, lng, source, confidence)."""
    c = candidates.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).groupBy("url").agg(F.max_by(F.struct("lat", "lng", "source", "confidence"), F.struct("confidence", -F.col("point_id"))).alias("page"), F.count("*").alias("n"))
    e = entities.join(c, entities["sourceUrl"] == c["url"], "left")
    own = F.when(F.col("coordinates.lat").isNotNull() & F.col("coordinates.lng").isNotNull(), F.col("coordinates"))
    page = F.when((F.col("page.confidence") >= 0.7) | (F.col("n") == 1), F.col("page"))
    out = e.select("entity_id", F.coalesce(own, page).alias("c"))
    if lookups is not None:
        out = out.join(lookups.select("entity_id", F.struct("lat", "lng", "source", "confidence").alias("l")), "entity_id", "left").withColumn("c", F.coalesce("c", "l"))
    return out.select("entity_id", "c.lat", "c.lng", "c.source", "c.confidence")


def external_evidence(entities: DataFrame, evidence: DataFrame, summaries: DataFrame) -> DataFrame:
    """Evidence rows to append: (entity_id, url, block_id, source_type, title, text) of ``summaries`` by identifier (wikidataId, source_type,
    url, title, text) that the entity doesn't have already (same url, block and kind)."""
    new = entities.where(text(F.col("wikidataId")) != "").join(summaries, "wikidataId").select("entity_id", summaries["url"].alias("url"), F.col("name").alias("block_id"), "source_type", summaries["title"].alias("title"), summaries["text"].alias("text"))
    return new.join(evidence.select("entity_id", "url", "block_id", "source_type").distinct(), ["entity_id", "url", "block_id", "source_type"], "left_anti")


def geosearch_images(entities: DataFrame, files: DataFrame, degrees: float = 0.02) -> DataFrame:
    """(entity_id, url, metres): files (url, lat, lng) around entities without images, within the radius that their type asks for."""
    e = entities.where((F.coalesce(F.size("images"), F.lit(0)) <= 0) & F.col("coordinates.lat").between(-90, 90) & F.col("coordinates.lng").between(-180, 180)).select("entity_id", F.col("coordinates.lat").alias("elat"), F.col("coordinates.lng").alias("elng"), search_radius(F.col("types")).alias("r"))
    # The cells that the radius reaches; meridians lie closer towards the poles.
    cells = lambda c, reach: F.explode(F.sequence(F.floor((c - reach) / degrees).cast("int"), F.floor((c + reach) / degrees).cast("int")))
    reach = F.col("r") / 111_000.0
    near = e.withColumn("y", cells(F.col("elat"), reach)).withColumn("x", cells(F.col("elng"), reach / F.greatest(F.lit(0.001), F.cos(F.radians(F.least(F.lit(90.0), F.abs("elat") + reach))))))
    f = files.select("url", "lat", "lng", F.floor(F.col("lat") / degrees).cast("int").alias("y"), F.floor(F.col("lng") / degrees).cast("int").alias("x"))
    m = distance_km(F.col("elat"), F.col("elng"), F.col("lat"), F.col("lng")) * 1000
    return near.join(f, ["y", "x"]).withColumn("metres", m).where("metres <= r").select("entity_id", "url", F.round("metres", 3).alias("metres"))


def with_wikidata_images(entities: DataFrame, pictures: DataFrame) -> DataFrame:
    """(entity_id, images): the identifier's pictures (wikidataId, images) first, then the others."""
    j = entities.join(pictures.withColumnRenamed("images", "wd"), "wikidataId", "left")
    none = F.array().cast("array<string>")
    return j.select("entity_id", F.array_distinct(F.concat(F.coalesce("wd", none), F.coalesce("images", none))).alias("images"))


def candidate_ids(entities: DataFrame, searches: DataFrame, city: str = "", most: int = 8) -> DataFrame:
    """(entity_id, qids): identifiers found for an entity's queries (name, slug, both with the city) in ``searches`` (query, pos, qid), in
    order, the first ``most``."""
    from ..functions.text import slug_name
    from .merge import ordered_distinct

    slug = slug_name(F.col("sourceUrl"))
    fold = lambda c: F.lower(ascii_fold(c))
    other = (slug != "") & (fold(slug) != fold(F.col("name")))
    where = F.lit(city)
    queries = F.array(F.col("name"), F.when(other, slug), *([F.concat_ws(" ", "name", where), F.when(slug != "", F.concat_ws(" ", slug, where)), F.when(slug != "", F.concat_ws(" de ", slug, where))] if city else []))
    q = entities.select("entity_id", F.posexplode(queries).alias("q", "query")).where("query is not null").withColumn("query", compact(F.col("query")))
    hits = q.join(searches, "query").select("entity_id", (F.col("q") * 100 + F.col("pos")).alias("o"), F.array("qid").alias("ids"))
    return ordered_distinct(hits, ["entity_id"], "ids", "o", "qids").select("entity_id", F.slice("qids", 1, most).alias("qids"))


def label_matches(names: DataFrame, labels: DataFrame) -> DataFrame:
    """Of (entity_id, name, qid) those whose identifier's labels (qid, label) share a longer word with the name; identifiers without labels
    and names without such words pass."""
    from .. import dims
    from ..functions.text import key

    all_ = labels.groupBy("qid").agg(F.array_join(F.collect_set(key(F.col("label"))), " ").alias("hay"))
    n = names.withColumn("w", F.filter(F.split(key(F.col("name")), " "), lambda x: (F.length(x) >= 3) & ~x.isin(*dims.LABEL_STOPWORDS)))
    j = n.join(all_, "qid", "left")
    return j.where(F.col("hay").isNull() | (F.size("w") == 0) | F.exists("w", lambda x: F.contains(F.col("hay"), x))).select("entity_id", "name", "qid")


def wikidata_facts(docs: DataFrame) -> DataFrame:
    """(qid, p31, parent, label, image) of (qid, doc): the classes, the first parent class, the label in es or en, the picture's file name."""
    v = F.try_parse_json("doc")
    value = "struct<mainsnak:struct<datavalue:struct<value:{}>>>"
    ids = lambda p: F.filter(F.transform(F.coalesce(F.try_variant_get(v, f"$.claims.{p}", f"array<{value.format('struct<id:string>')}>"), F.array().cast(f"array<{value.format('struct<id:string>')}>")), lambda c: c["mainsnak"]["datavalue"]["value"]["id"]), lambda q: text(q) != "")
    pick = lambda p: F.coalesce(F.nullif(F.try_variant_get(v, f"$.{p}.es.value", "string"), F.lit("")), F.try_variant_get(v, f"$.{p}.en.value", "string"), F.lit(""))
    picture = F.try_variant_get(v, "$.claims.P18[0].mainsnak.datavalue.value", "string")
    return docs.select("qid", ids("P31").alias("p31"), F.get(ids("P279"), F.lit(0)).alias("parent"), pick("labels").alias("label"), pick("descriptions").alias("description"), picture.alias("image"))


def reverse_geocoded(entities: DataFrame, lookups: DataFrame) -> DataFrame:
    """(entity_id, address): missing addresses from (lat, lng, address), looked up by coordinates of five decimals."""
    at = lambda c: F.round(c, 5)
    l = lookups.groupBy(at(F.col("lat")).alias("y"), at(F.col("lng")).alias("x")).agg(F.min("address").alias("found"))
    e = entities.withColumns({"y": at(F.col("coordinates.lat")), "x": at(F.col("coordinates.lng"))})
    return e.join(l, ["y", "x"], "left").select("entity_id", F.when(text(F.col("address")) != "", F.col("address")).otherwise(text(F.col("found"))).alias("address"))


def first_lookup(queries: DataFrame, results: DataFrame, cities: DataFrame) -> DataFrame:
    """(entity_id, lat, lng): of (entity_id, pos, query, city) and (query, rank, lat, lng, importance) the first result of the first query that lies within
    its city's radius and matters enough."""
    c = cities.select(F.col("name").alias("city"), F.col("lat").alias("clat"), F.col("lng").alias("clng"), "radius_km")
    j = queries.join(results, "query").join(F.broadcast(c), "city")  # the known cities
    good = j.where((F.coalesce("importance", F.lit(0.6)) >= 0.05) & (distance_km(F.col("lat"), F.col("lng"), F.col("clat"), F.col("clng")) <= F.col("radius_km")))
    return good.groupBy("entity_id").agg(F.min_by(F.struct("lat", "lng"), F.struct("pos", "rank")).alias("b")).select("entity_id", "b.lat", "b.lng")
