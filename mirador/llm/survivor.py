"""Problem 2: the best value of each field for each group of duplicate records.

Method: fields are unpivoted to long rows (group, field, value); each row votes for its value; votes are added up per value
before anything is shuffled and per normalised value after; the winner of each group and field comes out by ``max_by``;
``pivot`` brings the record back.

Two ways of voting go through this: ``summed`` adds up trust times recency decay over the rows of a normalised value. In
``strict`` (the statement of the problem: trust, then date, then smallest id) a vote is that triple and the sum of two
votes is the greater one, so the winner is the row that the statement names; p2_found lists the pivoted record's fields.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statements that nothing is known, folded (lower case, no accents, letters and digits only).
UNKNOWN = (
    "n a", "na", "n d", "nd", "s d", "s n d", "none", "null", "nil", "nan", "undefined", "unknown", "tbd", "todo",
    "sin datos", "sin dato", "sin informacion", "sin descripcion", "sin direccion", "sin especificar", "sin definir",
    "no disponible", "no consta", "no aplica", "no hay datos", "no hay descripcion", "no especificado", "no especificada", "no informado",
    "descripcion pendiente", "descripcion no disponible", "direccion no disponible", "direccion desconocida", "direccion pendiente",
    "informacion no disponible", "pendiente", "pendiente de completar", "por determinar", "por definir", "por confirmar", "a determinar",
    "desconocido", "desconocida", "consultar", "vacio", "not available", "no data", "no description", "no description available",
    "no address", "not known", "description pending", "pending", "non disponible", "sans description", "inconnu", "inconnue",
    "sense dades", "sense descripcio", "no disponible ara", "pendent", "desconegut", "desconeguda", "proximamente", "coming soon",
)
ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc"
#: White space to trim, and the most letters and digits of a mere statement.
BLANKS, STATEMENT = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000", 60
#: Rows of one group that share this many first characters are compared for beginnings in one task.
HEAD = 64


@dataclass(frozen=True)
class Field:
    """A column to choose. ``kind``: description (may be cut), text or coordinates (a struct of lat and lng)."""

    name: str
    kind: str
    trust: str


FIELDS = (
    Field("shortDescription", "description", "score"),
    Field("longDescription", "description", "score"),
    Field("address", "text", "score"),
    Field("coordinates", "coordinates", "coordinates.confidence"),
)


def folded(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"[^\p{L}\p{N}]+", " "))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def stripped(c: Column) -> Column:
    """Without outer blanks and a closing ellipsis."""
    t = trimmed(c)
    return F.when(F.endswith(t, F.lit("…")) | F.endswith(t, F.lit("...")), trimmed(F.regexp_replace(t, r"(?U)\s*(?:…|\.{3,}|\s)+$", ""))).otherwise(t)


def usable_value(field: Field) -> Column:
    """The value in comparable form, or null if it is missing, blank or says that nothing is known.

    Coordinates need both numbers, in range and not both 0.
    """
    c = F.col(field.name)
    if field.kind == "coordinates":
        lat, lng = c["lat"], c["lng"]
        ok = ~F.isnan(lat) & ~F.isnan(lng) & lat.between(-90, 90) & lng.between(-180, 180) & ((lat != 0) | (lng != 0))
        return F.when(ok, F.concat_ws(",", lat.cast("string"), lng.cast("string")))
    value = stripped(c) if field.kind == "description" else trimmed(c)
    # Statements have few letters, so only values with few are folded; a longer value is told by its first ones.
    few = (F.length(value) <= STATEMENT) | F.rlike(value, F.lit(rf"^(?:[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]){{0,{STATEMENT}}}[^\p{{L}}\p{{N}}]*$"))
    empty = (value == "") | few & folded(value).isin("", *UNKNOWN)
    return F.when(~empty, value)


def long_rows(records: DataFrame, fields: tuple[Field, ...], group: str, key: str, when: str) -> DataFrame:
    """Unpivot: (grp, field, value, cuttable, trust, at, id), a row for each record and field; value null if not usable."""
    grouped = records.where(F.trim(F.col(group)) != "")
    each = [
        F.struct(F.lit(f.name).alias("field"), usable_value(f).alias("value"), F.lit(f.kind == "description").alias("cuttable"), F.nanvl(F.col(f.trust).cast("double"), F.lit(None).cast("double")).alias("trust"))
        for f in fields
    ]
    return grouped.select(F.col(group).alias("grp"), F.col(key).alias("id"), F.col(when).alias("at"), F.explode(F.array(*each)).alias("x")).select("grp", "id", "at", "x.*")


def mark_beginnings(values: DataFrame) -> DataFrame:
    """Adds ``beginning``: whether a value is just the beginning of a longer one of the same group and field.

    ``values`` has (grp, field, value, cuttable, ...) with distinct values. In byte order the first longer value that
    begins with v comes right after v, so one look at the next row decides. Values of at least HEAD characters are
    compared among those with the same head only, which splits a hot group; for the few shorter ones the groups' longer
    values are cut to the lengths that occur.
    """
    from pyspark.sql import Window

    head = F.substring("value", 1, HEAD)
    order = Window.partitionBy("grp", "field", head).orderBy("value")
    marked = values.withColumn("next", F.when(F.col("cuttable") & (F.length("value") >= HEAD), F.lead("value").over(order)))
    return marked.withColumn("beginning", F.coalesce(F.startswith("next", "value"), F.lit(False))).drop("next")


def short_beginnings(values: DataFrame) -> DataFrame:
    """(grp, field, value): values under HEAD characters that are the beginning of a longer one."""
    cuttable = values.where("cuttable and value is not null").select("grp", "field", "value")
    short = cuttable.where(F.length("value") < HEAD)
    lengths = short.groupBy("grp", "field").agg(F.collect_set(F.length("value")).alias("lengths"))  # at most HEAD - 1 of them
    starts = (
        cuttable.select("grp", "field", F.substring("value", 1, HEAD).alias("start"), F.length("value").alias("n"))
        .join(lengths, ["grp", "field"])
        .select("grp", "field", F.explode(F.filter("lengths", lambda n: n < F.col("n"))).alias("k"), "start")
        .select("grp", "field", F.expr("substring(start, 1, k)").alias("value"))
        .distinct()
    )
    return short.join(starts, ["grp", "field", "value"], "left_semi")


def ballots(records: DataFrame, fields: tuple[Field, ...], group: str, key: str, when: str, vote: Column, add, norm: Column | None) -> DataFrame:
    """(grp, field, norm, votes, strongest, n): the votes of each usable value, ``strongest`` the (vote, -id) of its best row.

    ``norm`` tells values that vote together (null: each value for itself). Values that are not usable come too, without
    votes, so that n adds up to the rows of the group. Copies of a value are added up before each shuffle, so a hot group
    costs its distinct values only; after beginnings are marked the texts stay behind.
    """
    rows = long_rows(records, fields, group, key, when).withColumn("vote", vote)
    values = rows.groupBy("grp", "field", "cuttable", "value").agg(add("vote").alias("votes"), F.max(F.struct("vote", (-F.col("id")).alias("least"))).alias("strongest"), F.count("*").alias("n"))
    marked = mark_beginnings(values).withColumn("open", F.col("value").isNotNull() & ~F.col("beginning"))
    # Only short values are still asked for.
    marked = marked.select("grp", "field", (F.lit(None).cast("bigint") if norm is None else norm).alias("norm"), "votes", "strongest", "n", "open", F.when(F.col("cuttable") & (F.length("value") < HEAD), F.col("value")).alias("value"))
    marked = marked.join(short_beginnings(values).withColumn("short", F.lit(True)), ["grp", "field", "value"], "left")
    usable = F.col("open") & F.col("short").isNull()
    return marked.select("grp", "field", "norm", *[F.when(usable, F.col(c)).alias(c) for c in ("votes", "strongest")], "n")


def elected(votes: DataFrame, fields: tuple[Field, ...], order: Column, least: int = 1) -> DataFrame:
    """(grp, and per field the id of the row that wins or null): ``max_by`` over the votes, pivoted, for groups of ``least`` rows or more."""
    names = [f.name for f in fields]
    best = votes.groupBy("grp").pivot("field", names).agg(F.max_by(-F.col("strongest.least"), order).alias("id"), F.sum("n").alias("n"))
    return best.where(F.greatest(*[F.col(f"`{n}_n`") for n in names], F.lit(0)) >= least).select("grp", *[F.col(f"`{n}_id`").alias(n) for n in names])


def choose_strict(records: DataFrame, fields: tuple[Field, ...] = FIELDS, group: str = "entity_key", key: str = "entity_id", when: str = "extracted_at") -> DataFrame:
    """(grp, field_name, id): for each group of two or more rows and each field the row whose value survives.

    Highest trust (null and NaN lowest), then latest ``when`` (null lowest), then smallest key. Rows of a null or blank
    group are single and give nothing; no row if no value of the group is usable; a repeated row competes with itself.
    """
    vote = F.struct(F.coalesce("trust", F.lit(float("-inf"))).alias("trust"), F.coalesce("at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), (-F.col("id")).alias("least"))
    votes = ballots(records, fields, group, key, when, vote, F.max, None)
    record = elected(votes, fields, F.col("votes"), 2)
    return record.unpivot("grp", [f.name for f in fields], "field_name", "id").where("id is not null")


def choose_summed(records: DataFrame, as_of: str, half_life_days: float = 365.0, fields: tuple[Field, ...] = FIELDS, group: str = "entity_key", key: str = "entity_id", when: str = "extracted_at") -> DataFrame:
    """One row per group with a column per field: the value with the most votes, trust x 0.5^(age / half life) summed.

    Trust null counts 0.1. Descriptions that are just the beginning of a longer one of the group have no vote. Values vote together if they are equal when folded; of these the spelling of the strongest
    row is given (of equally strong ones that of the smallest key). Ties go to the value of the strongest row. ``as_of`` is the date from which ages count.
    A field without a usable value is null. Groups where no field has one come too.
    """
    age = F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), F.col("at").cast("date")))
    vote = F.round(F.coalesce("trust", F.lit(0.1)) * F.pow(F.lit(0.5), F.coalesce(age, F.lit(3650)) / F.lit(half_life_days)), 9)
    votes = ballots(records, fields, group, key, when, vote, F.sum, F.xxhash64(folded(F.col("value"))))
    together = votes.groupBy("grp", "field", "norm").agg(F.sum("votes").alias("votes"), F.max("strongest").alias("strongest"), F.sum("n").alias("n"))
    order = F.when(F.col("votes").isNotNull(), F.struct(F.round("votes", 6).alias("votes"), F.col("strongest")))
    record = elected(together, fields, order)
    # The winners' values are read from their rows: ids travel, texts once.
    won = record.unpivot("grp", [f.name for f in fields], "field", "id")
    values = long_rows(records, fields, group, key, when).where("value is not null").select("id", "field", "value")
    return won.join(values, ["id", "field"], "left").groupBy(F.col("grp").alias(group)).pivot("field", [f.name for f in fields]).agg(F.first("value", ignorenulls=True))
