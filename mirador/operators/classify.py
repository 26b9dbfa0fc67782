"""Types of entities: by wikidata class, map category, and keywords in names and trusted texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import has_keyword, key, let, text
from .merge import first_of_group


def name_type(name_key: Column) -> Column:
    """The type that a name settles by itself, in this order; '' if none."""
    c = lambda s: F.contains(name_key, F.lit(s))
    w = lambda s: has_keyword(name_key, s)
    return (
        F.when(w("ruta"), "Route")
        .when(c("museo de "), "Museum")
        .when(c("centro de interpretacion"), "TouristAttractionSite")
        .when(w("festival") | w("fiesta"), "Event")
        .when(w("mirador") | w("miradores"), "UrbanViewPoint")
        .when(c("conjunto catedralicio"), "TouristAttractionSite")
        .when(c("catedral y su entorno") | c("catedral de burgos y su entorno"), "Route")
        .otherwise("")
    )


def keyword_scores(contexts: DataFrame, entity: str = "entity_id") -> DataFrame:
    """(entity, type, score, first, signals) from contexts (entity, text, weight): per keyword and context that has it, the weight.

    A text's runs of one to four words are met with the keywords by a set, once per text, without a join.
    """
    known = F.array(*[F.lit(k) for k, _ in dims.TYPE_KEYWORDS])
    longest = max(len(k.split()) for k, _ in dims.TYPE_KEYWORDS)

    def runs(w: Column) -> Column:
        more = [F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>")) for n in range(2, longest + 1)]
        return F.array_intersect(F.concat(w, *more), known)

    # The words are computed once, though they are used for each length.
    hits = contexts.select(entity, "weight", F.explode(let(F.split(key(F.col("text")), " "), runs)).alias("keyword"))
    types = F.broadcast(dims.keywords(contexts.sparkSession))  # a few dozen keywords
    return hits.join(types, "keyword").groupBy(entity, "type").agg(F.sum("weight").alias("score"), F.min("ord").alias("first"))


def contexts(entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """(entity_id, text, weight): the name, and titles and texts of encyclopedic evidence."""
    out = entities.select("entity_id", F.col("name").alias("text"), F.lit(100).alias("weight"))
    for source, title, body in (("wikipedia", 40, 35), ("wikidata", 40, 20)):
        e = evidence.where(F.col("source_type") == source)
        out = out.unionByName(e.select("entity_id", F.col("title").alias("text"), F.lit(title).alias("weight"))).unionByName(e.select("entity_id", "text", F.lit(body).alias("weight")))
    return out


def inferred(entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """(entity_id, inferred, confidence): the name's own type, else the best scored, the earlier keyword on ties; '' and 0 if none."""
    best = keyword_scores(contexts(entities, evidence)).groupBy("entity_id").agg(F.max_by(F.struct("type", "score"), F.struct("score", -F.col("first"))).alias("b"))
    own = name_type(key(F.col("name")))
    return entities.select("entity_id", own.alias("own")).join(best, "entity_id", "left").select(
        "entity_id", F.when(F.col("own") != "", F.col("own")).otherwise(text(F.col("b.type"))).alias("inferred"), F.when(F.col("own") != "", 110).otherwise(F.coalesce("b.score", F.lit(0))).cast("int").alias("confidence")
    )


def primary(existing: Column, inferred_: Column, confidence: Column) -> Column:
    first = F.get(existing, F.lit(0))
    return F.when((inferred_ != "") & ((confidence >= 60) | (F.size(existing) == 0) | F.array_contains(existing, inferred_)), inferred_).otherwise(F.coalesce(first, inferred_))


def related(existing: Column, first: Column, second: Column) -> Column:
    return F.array_distinct(F.filter(F.concat(F.array(first, second), existing), lambda t: text(t) != ""))


def allowed(types: Column) -> Column:
    return F.array_intersect(F.coalesce(types, F.array().cast("array<string>")), F.array(*map(F.lit, dims.ALLOWED)))


def normalized(types: Column, inferred_: Column, confidence: Column) -> Column:
    """Allowed types; a sure inference replaces them, any fills a gap."""
    own = allowed(types)
    only = F.when(inferred_ != "", F.array(inferred_)).otherwise(F.array().cast("array<string>"))
    return F.when((F.size(own) > 0) & (inferred_ != "") & (confidence >= 90), only).when(F.size(own) > 0, own).otherwise(only)


def by_wikidata(classes: DataFrame, parents: DataFrame) -> DataFrame:
    """(entity_id, type, qid) of (entity_id, pos, qid): the first class in the table, itself or its parent (qid, parent)."""
    table = F.broadcast(dims.p31(classes.sparkSession))
    own = classes.join(parents, "qid", "left").join(table, "qid", "left").join(table.select(F.col("qid").alias("parent"), F.col("type").alias("ptype")), "parent", "left")
    hit = own.withColumn("t", F.coalesce("type", "ptype")).where("t is not null").withColumn("q", F.when(F.col("type").isNotNull(), F.col("qid")).otherwise(F.col("parent")))
    return first_of_group(hit, ["entity_id"], [F.col("pos")]).select("entity_id", F.col("t").alias("type"), F.col("q").alias("qid"))


def by_osm(places: DataFrame) -> DataFrame:
    """(entity_id, type, osm) of (entity_id, pos, category, kind): the first pair in the table."""
    hit = places.join(F.broadcast(dims.osm(places.sparkSession)), ["category", "kind"])
    return first_of_group(hit, ["entity_id"], [F.col("pos")]).select("entity_id", "type", F.concat_ws("/", "category", "kind").alias("osm"))


def classify(entities: DataFrame, evidence: DataFrame, wikidata: DataFrame | None = None, osm: DataFrame | None = None, by_keywords: DataFrame | None = None) -> DataFrame:
    """(entity_id, type, types, confidence): wikidata's class (120) before the map's (110) before keywords (those of
    :func:`inferred`, unless given)."""
    e = entities.select("entity_id", allowed(F.col("types")).alias("existing")).join(inferred(entities, evidence) if by_keywords is None else by_keywords, "entity_id")
    for other, name in ((wikidata, "wd"), (osm, "om")):
        e = e.join(other.where(F.col("type").isin(*dims.ALLOWED)).select("entity_id", F.col("type").alias(name)), "entity_id", "left") if other is not None else e.withColumn(name, F.lit(None).cast("string"))
    first = F.coalesce("wd", "om", primary(F.col("existing"), F.col("inferred"), F.col("confidence")))
    second = F.coalesce("wd", "om", "inferred")
    confidence = F.when(F.col("wd").isNotNull(), 120).when(F.col("om").isNotNull(), 110).otherwise(F.col("confidence"))
    return e.select("entity_id", first.alias("type"), related(F.col("existing"), first, second).alias("types"), confidence.alias("confidence"))
