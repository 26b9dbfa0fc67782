"""Problem 4: one postal address written in many ways.

Method: an address is parsed into its components (kind of road, street, number, city); abbreviations are expanded by the
locale's dictionary; components in any order become one canonical form; addresses are joined on hierarchical keys: city,
then street (typing errors mended against the city's other streets), then kind of road, then number. A component that is missing is
filled in by rule: a city by the postcode, else if all addresses of the street and number (else of the street) that name a
city name the same; a kind of road likewise within the city. What can't be told stays missing and joins only its equals.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Kinds of road and their abbreviations, without accents and dots.
KINDS = {
    "calle": "calle c c/ cl cll cle carrer rue street",
    "avenida": "avenida av avd avda avinguda avgda avenue ave",
    "plaza": "plaza pza plz pl plza pz placa pca place square",
    "paseo": "paseo pso po p.o p pseo passeig pg",
    "carretera": "carretera ctra crta cta cra carr cr crtra",
    "ronda": "ronda rda rnda ron",
    "travesia": "travesia trav trva trv tra tvsia travessera",
    "camino": "camino cno cmno cam cami",
    "callejon": "callejon cjon clljon",
    "cuesta": "cuesta cta. csta", "glorieta": "glorieta gta glta", "pasaje": "pasaje psje pje passatge",
    "urbanizacion": "urbanizacion urb", "poligono": "poligono pol polig", "rambla": "rambla rbla", "via": "via", "alameda": "alameda", "barrio": "barrio bo", "parque": "parque pque",
}
#: Abbreviations within names.
WORDS = {
    "dr": "doctor", "dra": "doctora", "doct": "doctor", "gral": "general", "gnral": "general", "gen": "general", "cap": "capitan", "cptan": "capitan", "capt": "capitan", "mtra": "maestra", "mtro": "maestro", "maest": "maestro",
    "ntra": "nuestra", "nra": "nuestra", "ntro": "nuestro", "sra": "senora", "sr": "senor", "sta": "santa", "sto": "santo", "s": "san", "st": "san", "prof": "profesor", "profa": "profesora", "cte": "comandante", "cmdte": "comandante", "cnel": "coronel", "tte": "teniente", "pdte": "presidente", "arq": "arquitecto", "ing": "ingeniero", "hnos": "hermanos", "fco": "francisco", "ma": "maria", "vda": "viuda", "alc": "alcalde", "marq": "marques", "exc": "excelentisimo", "d": "don", "da": "dona", "n": "nuestra", "pto": "puerto", "rgto": "regimiento", "bda": "barriada",
}
#: Statements that there is no address.
NOTHING = frozenset(("", "n/d", "n/a", "nd", "na", "s/d", "-", ".", "sin direccion", "direccion no disponible", "no disponible", "consultar", "direccion desconocida", "desconocida", "pendiente", "sin datos", "no consta", "null", "none", "por determinar", "not available"))
LINKS = frozenset(("de", "del", "la", "las", "el", "los", "d", "l", "y", "i", "a", "of", "the"))
_LADY = regex.compile(r"\bn\.?\s?a\.?\s+s\.?\s?a\b\.?")
_PARTS = regex.compile(r"\b(?:espana|spain|espanya|espagne)\b|[(),;]|\s[-–—·|/](?=\s)")
_PIECE = regex.compile(r"\||[a-z0-9/.']+")
_NO = regex.compile(r"(?:s\s*/\s*n(?:um|o)?\b\.?|\bs\.\s*n\.?(?!\w)|\bsn\b\.?|\bsin\s+n(?:umero|um)?\b\.?)")
_FLOOR = regex.compile(
    r"\b(?:piso|planta|pta|puerta|local|loc|bloque|blq|bl|esc|escalera|oficina|of|portal|despacho|apto|apartamento|nave|modulo|entresuelo|entlo|atico|sotano)\b\.?\s*(?:n\.?o\.?\s*)?(?:\d{1,3}|[a-h])?\b(?:\.?[oa]\b)?(?:\s*[-,]?\s*(?:[a-h]|izq(?:da|uierda)?|dcha|derecha|centro)\b\.?)?"
    r"|\b\d{1,2}\s*\.?\s*[oa]\.?\s*(?:planta|piso|izq(?:da|uierda)?|dcha|derecha|pta|puerta|[a-h])\b\.?|\b\d{1,2}\.[oa]\b\.?"
    r"|\bbajo\b\s*(?:[a-h]\b|izq(?:da|uierda)?\b\.?|dcha\b\.?|derecha\b|centro\b)?|\b(?:izq(?:da|uierda)?|dcha|derecha)\b\.?"
)
_NUMBER = regex.compile(r"(?:\b(?:numero|num|nro|no|n)\b[\s.]*(?:o\b\.?\s*)?|\bn\.?\s?o\.?\s*|#\s*)?\b(\d{1,4})\b\s*(bis|ter|dup)?\b")
_MARKED = regex.compile(r"(?:\b(?:numero|num|nro)\b[\s.]*|\bn\s*\.?\s*o?\s*\.?\s*|\bno\s*\.?\s*|#\s*)(\d{1,4})\b\s*(bis|ter|dup)?\b")
_POSTCODE = regex.compile(r"(?<!\d)\d{5}(?!\d)")
_ALNUM = regex.compile(r"[a-z0-9]+")


class _Bare(dict):
    """For translate(): drops combining marks. Letters met are remembered."""

    def __missing__(self, c: int) -> int | None:
        self[c] = None if unicodedata.combining(chr(c)) else c
        return self[c]


_BARE = _Bare()


def fold(text: str) -> str:
    """Lower case without accents; ordinal signs become o and a."""
    t = text.lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t.replace("º", "o").replace("ª", "a").replace("°", "o")).translate(_BARE)
    return " ".join(t.split())


def deletions(word: str) -> set[str]:
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def one_edit(a: str, b: str) -> bool:
    """Whether one letter added, dropped, changed, or two neighbours swapped, make ``a`` into ``b`` (or none)."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or x[:2] == y[1::-1] and len(y) > 1 and x[2:] == y[2:]


class Parser:
    """Parses addresses with a gazetteer of (city, province, postcode); a list of places, not of addresses."""

    def __init__(self, gazetteer: list[tuple[str, str | None, str | None]]):
        self.kinds = {a: k for k, words in KINDS.items() for a in words.split()}
        self.cities: dict[str, str] = {}
        self.near: dict[str, set[tuple[str, str]]] = {}
        self.provinces: set[str] = set()
        self.by_code: dict[str, str] = {}
        twice: set[str] = set()
        for city, province, code in gazetteer:
            key = self.place(city)
            self.cities[key] = key
            # Names one edit away, by their deletions; names two places could have meant are left out.
            for form in {key, "".join(_ALNUM.findall(fold(city)))}:
                for d in deletions(form.replace(" ", "")) if len(key) > 5 else ():
                    self.near.setdefault(d, set()).add((form.replace(" ", ""), key))
            if province:
                p = self.place(province)
                self.provinces |= {p, p.removeprefix("provincia ")}
            if code:
                if self.by_code.get(code, key) != key:
                    twice.add(code)
                self.by_code[code] = key
        for code in twice:
            del self.by_code[code]
        self.near_provinces: dict[str, set[tuple[str, str]]] = {}
        for key in self.provinces:
            for d in deletions(key.replace(" ", "")) if len(key) > 5 else ():
                self.near_provinces.setdefault(d, set()).add((key.replace(" ", ""), key))
        # The numbers of words of places, by their first word.
        self.lengths: dict[str, set[int]] = {}
        for key in [*self.cities, *self.provinces]:
            self.lengths.setdefault(key.split(" ")[0], set()).add(len(key.split(" ")))
        self.most = max((len(k.split()) for k in [*self.cities, *self.provinces]), default=1) + 2

    def place(self, name: str) -> str:
        return " ".join(w for w in _ALNUM.findall(fold(name)) if w not in LINKS)

    def _find(self, words: list[str], exact, near: dict[str, set[tuple[str, str]]]) -> tuple[int, int, str] | None:
        """The longest run of words that is a place as written; else a part (between bars) within one edit of a place."""
        kept = [(i, w) for i, w in enumerate(words) if w not in LINKS]
        best = None
        for k, (_, first) in enumerate(kept):
            for n in self.lengths.get(first, ()):
                if k + n <= len(kept) and (best is None or (n, k) > best[:2]) and (key := " ".join([w for _, w in kept[k : k + n]])) in exact:
                    best = n, k, key
        if best is not None:
            n, k, key = best
            return kept[k][0], kept[k + n - 1][0] + 1, key
        i = 0
        for part in " ".join(words).split("|"):
            run = part.split()
            if run and len(run) <= self.most + 2 and run[0] not in self.kinds:
                forms = {"".join(run), "".join(w for w in run if w not in LINKS)}
                hits = {k for x in forms if len(x) > 5 for d in deletions(x) for form, k in near.get(d, ()) if one_edit(x, form)}
                if len(hits) == 1:
                    return i, i + len(run), hits.pop()
            i += len(run) + 1
        return None

    def parse(self, address: str | None) -> tuple[str, str, str, str] | None:
        """(city, kind, street, number); '' for what is missing; None if there is no street."""
        t = fold(address or "")
        if t.strip(" .,;-") in NOTHING or t in NOTHING:
            return None
        t = _PARTS.sub(" | ", _LADY.sub("nuestra senora", t))
        code = ""
        if m := _POSTCODE.search(t):
            code = m[0]
            t = t[: m.start()] + " | " + t[m.end() :]
        number = None
        if m := _NO.search(t):
            number = "sn"
            t = t[: m.start()] + " | " + t[m.end() :]
        t = _FLOOR.sub(" | ", t)
        if number is None and (m := _MARKED.search(t) or _NUMBER.search(t)):
            number = m[1].lstrip("0") + (m[2] or "")
            t = t[: m.start()] + " | " + t[m.end() :]
        words = [w if w == "|" else w.strip("./'") for w in _PIECE.findall(t.replace("c/", "c/ "))]
        words = [w for w in words if w]
        words = [WORDS.get(w, w) if i and w in ("s", "st", "sta", "sto") else w for i, w in enumerate(words)]
        city = ""
        if found := self._find(words, self.cities, self.near):
            i, j, city = found
            words[i:j] = ["|"]
        if not city and code:
            city = self.by_code.get(code, "")
        while self.provinces and (found := self._find(words, self.provinces, self.near_provinces)):
            i, j, _ = found
            if i and words[i - 1] == "provincia":
                i -= 1
            words[i:j] = ["|"]
        parts = [p.split() for p in " ".join(words).split("|") if p.strip()]
        parts = [p for p in parts if any(w not in LINKS for w in p)]
        if not parts:
            return None
        # The street is the part that begins with a kind of road, else the first.
        street = next((p for p in parts if p[0] in self.kinds), parts[0])
        kind = ""
        if street[0] in self.kinds and any(w not in LINKS for w in street[1:]):
            kind, street = self.kinds[street[0]], street[1:]
        name = [WORDS.get(w, w) for w in (x.replace(".", "").replace("/", "") for x in street) if w not in LINKS]
        name = [w for w in name if w]
        return (city, kind, " ".join(name), number if number and number != "sn" else "") if name else None


#: A street is taken for a typing error of one with so many times its addresses.
RATIO = 4
#: A gazetteer goes to every task; the places of the world are some hundred thousand.
GAZETTEER = 400_000


def gazetteer_rows(gazetteer: DataFrame) -> tuple[tuple, ...]:
    """(city, province, postcode) of the gazetteer's places, in order; more than GAZETTEER of them are an error."""
    rows = gazetteer.select("city", "province", "postcode").where("city is not null").limit(GAZETTEER + 1).collect()
    if len(rows) > GAZETTEER:
        raise ValueError(f"a gazetteer has at most {GAZETTEER} places")
    return tuple(sorted((tuple(r) for r in rows), key=lambda r: tuple(x or "" for x in r)))


@lru_cache(maxsize=2)
def parser_of(places: tuple[tuple, ...]) -> Parser:
    """The worker's parser for a gazetteer, built once however many tasks it runs."""
    return Parser(list(places))


def parsed_addresses(records: DataFrame, gazetteer: DataFrame, key: str, address: str) -> DataFrame:
    """(id, city, kind, street, number) of the records whose address has a street.

    The gazetteer (city, province, postcode) is a list of places of the world, at most GAZETTEER rows.
    """
    places = gazetteer_rows(gazetteer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(places)
        for b in batches:
            rows = [(k, *p) for k, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (p := parser.parse(a))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), *[pa.string()] * 4))], names=["id", "city", "kind", "street", "number"])

    return records.where(F.trim(address) != "").select(F.col(key).cast("bigint"), address).mapInArrow(run, "id bigint, city string, kind string, street string, number string")


def spellings(street: Column) -> Column:
    """A name and what is left of it without each of its letters: two names within one edit share one."""
    one = F.transform(F.sequence(F.lit(0), F.length(street)), lambda i: F.when(i == 0, street).otherwise(F.concat(F.substring(street, F.lit(1), i - 1), F.substring(street, i + 1, F.length(street)))))
    return F.explode(F.array_distinct(one))


def within_edit(a: str, b: str) -> Column:
    """One letter added, dropped or changed, or two swapped."""
    swap = (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (F.levenshtein(a, b) <= 1) | swap


def mended_streets(parsed: DataFrame) -> DataFrame:
    """(city, street, mended): streets that are another one of their city but for a typing error, and that one.

    A street is mended if its name is within one edit of a commoner one of the city (of equally common ones, one that
    all cities together have more often) that has RATIO times its addresses or one of its house numbers. Where the city is missing, a name that no city
    has is mended to the commonest one within an edit. Names under six letters are left as they are. What a street is
    mended to is not mended further: the mapping is closed.
    """
    numbers = cut(parsed.where(F.length("street") >= 6).groupBy("city", "street", "number").agg(F.count("*").alias("n")))
    in_city = cut(numbers.groupBy("city", "street").agg(F.sum("n").alias("n")))
    # Streets of one name are in many cities: of two that are equally common in theirs, the one that is commoner everywhere leads.
    streets = cut(in_city.join(in_city.groupBy("street").agg(F.sum("n").alias("all")), "street").select("city", "street", "n", F.struct("n", "all", F.col("street").alias("last")).alias("order")))
    v = streets.select("city", "street", "n", "order", spellings(F.col("street")).alias("v"))
    a, b = v.alias("a"), v.select("city", "v", F.col("street").alias("mended"), F.col("n").alias("m"), F.col("order").alias("rank")).alias("b")
    near = cut(a.join(b, (F.col("a.city") == F.col("b.city")) & (F.col("a.v") == F.col("b.v")) & (F.col("b.rank") > F.col("a.order"))).select("a.city", "street", "n", "mended", "m", "rank").distinct().where(within_edit("street", "mended")))
    same = near.join(numbers.select("city", "street", "number"), ["city", "street"]).join(numbers.select("city", F.col("street").alias("mended"), "number"), ["city", "mended", "number"]).select("city", "street", "mended").distinct().withColumn("same", F.lit(True))
    sure = near.join(same, ["city", "street", "mended"], "left").where((F.col("m") >= RATIO * F.col("n")) | F.col("same"))
    best = cut(sure.groupBy("city", "street").agg(F.max_by("mended", "rank").alias("mended")))
    # A street is only mended to one that comes before it in one order, so each round halves the longest chain.
    while True:
        step = best.select("city", F.col("street").alias("mended"), F.col("mended").alias("further"))
        longer = best.join(step, ["city", "mended"])
        if longer.isEmpty():
            break
        best = cut(best.join(step, ["city", "mended"], "left").select("city", "street", F.coalesce("further", "mended").alias("mended")))
    # Addresses without a city: a spelling that some city has goes where it goes there, another to the commonest within an edit.
    whole = cut(streets.join(best, ["city", "street"], "left").select("city", "street", "n", F.coalesce("mended", "street").alias("name")))
    known = whole.where("city <> ''").groupBy("street").agg(F.max_by("name", F.struct("n", "name")).alias("to"), F.sum("n").alias("m"))
    lone = whole.where("city = ''").select("street", "name").join(known.select("street", F.col("to").alias("own")), "street", "left")
    x = lone.where("own is null").select("street", spellings(F.col("street")).alias("v"))
    y = known.select(F.col("street").alias("other"), "to", "m", spellings(F.col("street")).alias("v"))
    found = x.join(y, "v").where(within_edit("street", "other")).groupBy("street").agg(F.max_by("to", F.struct("m", "other")).alias("far"))
    # Spellings that were mended to one name go together, where the commonest of them leads.
    led = lone.join(found, "street", "left").join(known.select(F.col("to").alias("goal"), F.col("m").alias("size")).groupBy("goal").agg(F.max("size").alias("size")), F.coalesce("own", "far") == F.col("goal"), "left")
    leader = led.groupBy("name").agg(F.max_by("goal", F.struct("size", "goal")).alias("goal"))
    alone = lone.select("street", "name").join(leader, "name", "left").select(F.lit("").alias("city"), "street", F.coalesce("goal", "name").alias("mended"))
    return best.where("city <> ''").unionByName(alone).where("street <> mended")


def located(records: DataFrame, gazetteer: DataFrame, key: str = "entity_id", address: str = "address") -> DataFrame:
    """(id, city, kind, street, number): the canonical address of each record that has a street, missing parts filled in. Records of
    one location are those of one (city, kind, street, number): the classes of the problem, one row each."""
    parsed = cut(parsed_addresses(records, gazetteer, key, address))
    p = cut(parsed.join(mended_streets(parsed), ["city", "street"], "left").withColumn("street", F.coalesce("mended", "street")).drop("mended"))
    for part, levels in (("city", (["kind", "street", "number"], ["street", "number"], ["street"])), ("kind", (["city", "street", "number"], ["city", "street"]))):
        with_part, filled = p.where(F.col(part) != ""), p.where(F.col(part) == "")
        # The least and the greatest value per level, each level from the one before.
        ends = with_part.select("*", F.col(part).alias("lo"), F.col(part).alias("hi"))
        for k, by in enumerate(levels):
            ends = ends.groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            # A value counts where all addresses of the level that have one have the same.
            filled = filled.join(ends.where("lo = hi").select(*by, F.col("lo").alias(f"only{k}")), by, "left")
        value = F.coalesce(*[F.col(f"only{k}") for k in range(len(levels))], F.lit(""))
        p = with_part.select("id", "city", "kind", "street", "number").unionByName(filled.withColumn(part, value).select("id", "city", "kind", "street", "number"))
    return p


def same_address(records: DataFrame, gazetteer: DataFrame, key: str = "entity_id", address: str = "address") -> DataFrame:
    """(``key``_a, ``key``_b): all pairs of records whose addresses denote the same location, smaller key first.

    Floor, door and premises don't count, "bis" is a number of its own, and no number equals no number only. Missing and
    meaningless addresses, and those without a street, have no pairs. Records are joined on the whole canonical key by a
    shuffle join, which adaptive execution splits where one address is very common; a repeated key doesn't pair with itself.
    """
    p = cut(located(records, gazetteer, key, address).select("id", F.xxhash64("city", "kind", "street", "number").alias("at"), F.hash("street", "number", "city", "kind").alias("at2")))
    a, b = p.alias("a"), p.alias("b")
    pairs = a.join(b, (F.col("a.at") == F.col("b.at")) & (F.col("a.at2") == F.col("b.at2")) & (F.col("a.id") < F.col("b.id")))
    return pairs.select(F.col("a.id").alias(f"{key}_a"), F.col("b.id").alias(f"{key}_b"))
