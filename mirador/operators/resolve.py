"""Resolving incoming entities into a knowledge base by identity signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.geo import both, distance_km
from ..functions.text import key, significant, text
from ..sources.tables import cut
from .merge import entity_key, name_key

# Weights, distances in km, and the score from which two entities are one.
NEAR_KM, FAR_KM, THRESHOLD = 0.15, 5.0, 0.75
W_NEAR, W_ADDRESS, W_CONTAINS, W_SHARES, W_TYPE = 0.55, 0.35, 0.30, 0.20, 0.10


def features(entities: DataFrame, id_: str) -> DataFrame:
    """What scoring needs, computed once per entity: (id, key, nk, toks, wd, lat, lng, addr, t0)."""
    nk = name_key(F.col("name"), dims.RESOLVE_ARTICLES)
    return entities.select(
        F.col(id_).alias("id"), entity_key(F.col("name"), F.col("wikidataId")).alias("key"), nk.alias("nk"), F.filter(significant(nk), lambda t: t != "").alias("toks"), F.nullif("wikidataId", F.lit("")).alias("wd"),
        F.col("coordinates.lat").alias("lat"), F.col("coordinates.lng").alias("lng"), key(F.col("address")).alias("addr"), F.nullif(F.get("types", F.lit(0)), F.lit("")).alias("t0"),
    )


def names_agree(a: str, b: str) -> Column:
    """Equal names, or one's words (two or more) all among the other's."""
    x, y = F.col(f"{a}.toks"), F.col(f"{b}.toks")
    inside = F.size(F.array_intersect(x, y)) == F.least(F.size(x), F.size(y))
    return (F.col(f"{a}.nk") != "") & (F.col(f"{b}.nk") != "") & ((F.col(f"{a}.nk") == F.col(f"{b}.nk")) | (F.least(F.size(x), F.size(y)) >= 2) & inside)


def pair_score(a: str = "a", b: str = "b") -> Column:
    """1 for equal identifiers, 0 for different ones, disagreeing names or a great distance; else the sum of the signals."""
    c = lambda s, x: F.col(f"{s}.{x}")
    x, y = c(a, "toks"), c(b, "toks")
    shared, least, union = F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y)), F.size(F.array_union(x, y))
    known = both(c(a, "lat"), c(a, "lng"), c(b, "lat"), c(b, "lng"))
    km = F.when(known, distance_km(c(a, "lat"), c(a, "lng"), c(b, "lat"), c(b, "lng")))
    name = F.when((least >= 2) & (shared == least), W_CONTAINS).when((shared > 0) & (shared / union >= 0.5), W_SHARES).otherwise(0.0)
    total = F.when(km <= NEAR_KM, W_NEAR).otherwise(0.0) + F.when((c(a, "addr") != "") & (c(a, "addr") == c(b, "addr")), W_ADDRESS).otherwise(0.0) + name + F.when(c(a, "t0") == c(b, "t0"), W_TYPE).otherwise(0.0)
    return F.round(F.when(c(a, "wd") == c(b, "wd"), 1.0).when(both(c(a, "wd"), c(b, "wd")), 0.0).when(~names_agree(a, b), 0.0).when(km > FAR_KM, 0.0).otherwise(total), 6)


#: Degrees of the cells in which points within NEAR_KM meet; one step east is wider than it at any latitude below 85 degrees.
CELL = 0.0015


def near_cells(f: DataFrame, around: bool) -> DataFrame:
    """(id, cell) of features with coordinates: their cell, or all cells with points within NEAR_KM of it (of the whole row of cells
    near the poles)."""
    row = F.floor(F.col("lat") / CELL)
    # Columns are as wide as the row's own middle makes a cell; near the poles a row is one cell.
    column = lambda r: F.when(F.abs(r * CELL) > 85, F.lit(0)).otherwise(F.floor(F.pmod(F.col("lng") + 180, F.lit(360.0)) * F.cos(F.radians((r + 0.5) * CELL)) / CELL))
    last = lambda r: F.when(F.abs(r * CELL) > 85, F.lit(0)).otherwise(F.floor(360 * F.cos(F.radians((r + 0.5) * CELL)) / CELL))
    at = f.where("lat between -90 and 90 and lng between -180 and 180").select("id", "lat", "lng", F.explode(F.array(*[row + i for i in ((-1, 0, 1) if around else (0,))])).alias("r"))
    c, n = column(F.col("r")), last(F.col("r"))
    each = F.array_distinct(F.array(c - 1, c, c + 1, F.when(c <= 0, n).otherwise(c), F.when(c <= 0, n - 1).otherwise(c), F.when(c >= n - 1, F.lit(0)).otherwise(c))) if around else F.array(c)
    return at.select("id", F.explode(each).alias("c"), "r").select("id", F.concat_ws(":", F.lit("g"), "r", "c").alias("cell"))


def candidates(left: DataFrame, right: DataFrame, least: float = 0.0, later: bool = False) -> DataFrame:
    """(a, b): all pairs of features that can score ``least`` or more, by equi-joins; with ``later`` only those with a > b.

    Names must agree: equal names, equal identifiers, or the words of one among the other's; for the last, the rarest word of
    the one is looked up among all words of the other, either way. Where names and types alone don't reach ``least``, the
    place is part of the key (the address, or a cell around the coordinates), so a name that many have is not paired with
    itself everywhere.
    """
    df = left.select(F.explode("toks").alias("t")).unionByName(right.select(F.explode("toks").alias("t"))).groupBy("t").agg(F.count("*").alias("n"))

    def rarest(f: DataFrame) -> DataFrame:
        each = f.where(F.size("toks") >= 2).select("id", F.explode("toks").alias("t")).join(df, "t")
        return each.groupBy("id").agg(F.min_by("t", F.struct("n", "t")).alias("k"))

    words = lambda f: f.where(F.size("toks") >= 2).select("id", F.explode("toks").alias("k"))
    own = lambda f, c: f.where(text(F.col(c)) != "").select("id", F.col(c).alias("k"))
    named = [(own(left, "nk"), own(right, "nk")), (rarest(left), words(right)), (words(left), rarest(right))]
    ways = [(own(left, "wd"), own(right, "wd"))]
    if least > W_CONTAINS + W_TYPE:
        address = lambda f: f.where("addr <> ''").select("id", F.concat(F.lit("a"), "addr").alias("cell"))
        at = lambda f, place: f.join(place, "id").select("id", F.struct("cell", "k").alias("k"))
        for x, y in named:
            ways.append((at(x, address(left).unionByName(near_cells(left, False))), at(y, address(right).unionByName(near_cells(right, True)))))
    else:
        ways += named
    out = None
    for x, y in ways:
        pairs = x.withColumnRenamed("id", "a").join(y.withColumnRenamed("id", "b"), "k").select("a", "b")
        pairs = pairs.where("a > b") if later else pairs
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def scored_pairs(left: DataFrame, right: DataFrame, least: float = 1e-9, later: bool = False) -> DataFrame:
    """(a, b, score) of the candidates that score at least ``least`` (with ``later``: of which a is the greater). Both sides are features."""
    c = candidates(left, right, least, later)
    l, r = left.alias("a"), right.alias("b")
    j = c.alias("c").join(l, F.col("c.a") == F.col("a.id")).join(r, F.col("c.b") == F.col("b.id"))
    return j.select(F.col("c.a").alias("a"), F.col("c.b").alias("b"), pair_score().alias("score")).where(F.col("score") >= least)


def resolve(kb: DataFrame, new: DataFrame, kb_id: str, new_id: str, threshold: float = THRESHOLD) -> DataFrame:
    """(id, base, tier, score): each incoming entity, in the order of its id, and the entity that it is found to be.

    Tiers: exact_key and name_key (a row of the knowledge base), similar (the best score at or above the threshold, of the
    base or of an entity added before), added (it is its own base). Incoming rows of one key follow the first of them. Whether an incoming entity can join an earlier incoming
    one depends on whether that one was added; the rows are decided in rounds, each settling all rows whose earlier
    candidates are settled, which gives what deciding one by one would, in as many rounds as the longest chain. Signals are
    those of the rows themselves: they don't drift as rows are merged.
    """
    k, n = cut(features(kb, kb_id)), cut(features(new, new_id))
    first = lambda f, c: f.where(text(F.col(c)) != "").groupBy(c).agg(F.min("id").alias("hit"))
    exact = n.join(first(k, "key"), "key").select("id", F.col("hit").alias("base"), F.lit("exact_key").alias("tier"), F.lit(1.0).alias("score"))
    # A row without identifier has its name as its key, and found nothing under it.
    named = n.where("wd is not null").join(first(k, "nk"), "nk").select("id", F.col("hit").alias("base"), F.lit("name_key").alias("tier"), F.lit(1.0).alias("score")).join(exact.select("id"), "id", "left_anti")
    done = cut(exact.unionByName(named))
    rest = cut(n.join(done.select("id"), "id", "left_anti"))
    # The same key among the incoming rows: the first is added, the others are it.
    twin = rest.groupBy("key").agg(F.min("id").alias("base"))
    same = rest.join(twin, "key").where("id <> base").select("id", "base", F.lit("exact_key").alias("tier"), F.lit(1.0).alias("score"))
    heads = cut(rest.join(same.select("id"), "id", "left_anti"))
    to_kb = scored_pairs(heads, k, threshold).select(F.col("a").alias("id"), F.struct("score", F.lit(1).alias("old"), (-F.col("b")).alias("first")).alias("c"))
    inner = cut(scored_pairs(heads, heads, threshold, later=True).select(F.col("a").alias("id"), F.col("b").alias("earlier"), "score"))
    best_kb = cut(to_kb.groupBy("id").agg(F.max("c").alias("c")))
    open_, settled, rounds = heads.select("id"), None, 0
    while True:
        waits = inner.join(open_.select(F.col("id").alias("earlier")), "earlier").select("id").distinct()
        ready = open_.join(waits, "id", "left_anti")
        own = inner.select("id", "earlier", "score")
        if settled is not None:
            own = own.join(settled.where("tier = 'added'").select(F.col("id").alias("earlier")), "earlier")
        else:
            own = own.where("false")
        c = best_kb.unionByName(own.select("id", F.struct("score", F.lit(0).alias("old"), (-F.col("earlier")).alias("first")).alias("c"))).groupBy("id").agg(F.max("c").alias("c"))
        now = ready.join(c, "id", "left").select("id", F.coalesce(-F.col("c.first"), F.col("id")).alias("base"), F.when(F.col("c").isNull(), "added").otherwise("similar").alias("tier"), F.coalesce("c.score", F.lit(0.0)).alias("score"))
        # Each round writes its own rows only; the parts are put together now and then, so that plans stay short.
        now = cut(now)
        settled = now if settled is None else settled.unionByName(now)
        rounds += 1
        if rounds % 20 == 0:
            settled = cut(settled)
        open_ = cut(open_.join(settled.select("id"), "id", "left_anti"))
        if open_.isEmpty():
            break
    return done.unionByName(settled).unionByName(same)
