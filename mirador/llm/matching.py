"""Problem 3: matching records of two tables that share no key, by name, address, coordinates and wikidataId.

Method: records, their attributes and the attributes' tokens form a graph. Random walks over all of it are the sentences of
skip-gram vectors with negative samples; no walk is drawn, each step is the mean over all ways from all records, added up in
tables of a fixed size. A token's vector is the sum of the vectors of its letter trigrams, so words never walked over have one
too. A record's name node is the idf-weighted sum
of its tokens. Records are blocked by tables of random hyperplanes over name nodes, within their city (as many tables as
the bits that its size asks for); records of no known place by tables over all, into which they look with every bit turned
once (multi-probe). Place nodes (cells of shifted grids, ends of streets with their number) are joined with a few
hyperplanes, identifier nodes by themselves. Each key carries a sketch of 64 further signs: pairs of a bucket whose sketches
differ in more than SKETCH of them go no further. The others are reranked exactly on all attributes, and the cosine is
calibrated to a confidence by logistic regression on pairs that both carry an identifier.

Rows of one group of the left table (``entity_key``) describe one thing; they are matched as one unit with all their names
and their pooled places, which is what lets a row without coordinates or with a cut name find its partner. A record
without a city has that of its coordinates.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text
from ..sources.tables import cut
from .addresses import LINKS, Parser, fold, gazetteer_rows, one_edit, parser_of

#: The fit: steps of a walk that are a token's context, dimensions, trigram buckets (2^BITS vectors), tasks that add up walks at most,
#: the part of a random vector's length by which it goes towards its context, and the visits with which it goes half of that.
STEPS, DIM, BITS, PARTS, PULL, VISITS = 2, 64, 15, 32, 0.1, 1_000
#: Directions shared by all trained vectors that are taken out of them.
COMMON = 2
#: Hyperplane tables over names: TABLES at least, and so many that names of cosine ALIKE share a bucket with probability HIT at any
#: number of bits. Shifted grids of cells of CELL degrees, with bits of the name.
TABLES, ALIKE, HIT, GRIDS, CELL, PLACE_PLANES = 8, 0.9, 0.9, 4, 0.012, 2
#: Signs of a sketch that may differ, of 64: names of cosine 0.5 differ in 21, unlike ones in 32 on average.
SKETCH = 29
#: A name of one class that more than HOT left units have meets others where places agree (tables of COMMON_BITS bits by place), a cell
#: with more than HOT names (counted in 2^CROWD buckets) is joined by pairs of blocks of its names. Neither loses a pair that would be
#: decided the same.
HOT, CROWD, COMMON_BITS = 1_000, 18, 6
#: Pairs of names under this cosine are not reranked (unless they share an identifier).
LEAST = 0.35
#: Kilometres within which coordinates agree.
NEAR_KM = 5.0
#: Words for kinds of places, by class; es, ca, en, fr and abbreviations.
CLASSES = {
    "ruralhouse": ("casa rural", "c r", "country house", "casas rurales", "gite rural", "maison rurale"),
    "naturalpark": ("parque natural", "p n", "natural park", "parc natural", "parc naturel"),
    "garden": ("jardin", "jardines", "jardi", "jardins", "garden", "gardens", "parque", "park", "parc"),
    "chapel": ("ermita", "capilla", "chapel", "capella", "erm", "chapelle", "hermitage"),
    "church": ("iglesia parroquial", "iglesia", "igl", "church", "esglesia", "parroquia", "eglise", "parish church"),
    "bar": ("cafe bar", "bar", "taberna", "cafe", "tavern", "pub"), "restaurant": ("restaurante", "restaurant", "rte", "meson", "rest"),
    "hotel": ("hotel spa", "hotel gran", "hotel", "htl", "hostal"), "museum": ("museo", "museum", "museu", "mus", "musee"),
    "square": ("plaza", "plaça", "placa", "square", "pza", "place"), "beach": ("playa", "platja", "beach", "plage"),
    "theater": ("teatro", "teatre", "theatre", "theater", "tro"), "palace": ("palacio", "palau", "palace", "pal", "palais"),
    "castle": ("castillo", "castell", "castle", "cast", "chateau"), "monastery": ("monasterio", "monestir", "monastery", "mon", "monastere"),
    "cave": ("cueva", "cuevas", "cova", "cave", "caves", "gruta", "grotte"), "route": ("ruta", "senda", "sendero", "route", "trail", "sender"),
    "event": ("festival", "fiesta", "feria", "fest", "festa", "fair", "fete"),
}
AMBIGUOUS = {"pl": ("square", "beach"), "pn": ("naturalpark",), "cr": ("ruralhouse",)}
#: The classes of values of the type column.
TYPES = {"Bar": "bar", "Restaurant": "restaurant", "Hotel": "hotel", "RuralHouse": "ruralhouse", "NaturalPark": "naturalpark", "Garden": "garden", "Park": "garden", "Chapel": "chapel", "Church": "church", "Museum": "museum", "Square": "square", "Beach": "beach", "Theater": "theater", "Palace": "palace", "Castle": "castle", "Monastery": "monastery", "Cave": "cave", "Route": "route", "Event": "event"}
_SUB = frozenset(("municipal", "gran", "spa", "parroquial", "viva", "ficha", "casa", "marques", "marquesa", "virgen", "the", "san", "santa", "santo", "sant", "sierra"))
_LABEL = regex.compile(r"^\s*(?:ficha|mas lugares de interes|lugares de interes|descubre|visita)\s*:?\s+")
_BRACKETS, _WORDS = regex.compile(r"\(([^()]*)\)"), regex.compile(r"[a-z0-9]+")
_STARTS: dict[str, list[tuple[tuple[str, ...], str, int]]] = defaultdict(list)
for _order, (_p, _c) in enumerate((p, c) for c, ps in CLASSES.items() for p in ps):
    _STARTS[_p.split()[0]].append((tuple(_p.split()), _c, _order))


class Names:
    """Splits a name into its class, its own words and the city it may carry."""

    def __init__(self, parser: Parser):
        self.parser = parser

    def parse(self, name: str | None) -> tuple[str, str, str]:
        """(classes, words, city) as blank-separated strings; '' for what is missing."""
        t = fold(name or "")
        t = _LABEL.sub("", t)
        city = ""

        def inside(m) -> str:
            nonlocal city
            city = city or self.parser.cities.get(self.parser.place(m[1]), "")
            return " "

        if "(" in t:
            t = _BRACKETS.sub(inside, t)
        words = _WORDS.findall(t)
        classes: tuple[str, ...] = ()
        # The longest phrase for a class at either end of the name (inside, it may be part of the name itself).
        best = None
        for i, w in enumerate(words):
            for phrase, c, order in _STARTS.get(w, ()):
                k = len(phrase)
                if (i <= 1 or i == len(words) - k) and tuple(words[i : i + k]) == phrase and (best is None or (-k, order, i) < best[0]):
                    best = ((-k, order, i), c, k)
        if best is not None:
            classes = (best[1],)
            del words[best[0][2] : best[0][2] + best[2]]
        else:
            for i in (0, len(words) - 1):
                if words and words[i] in AMBIGUOUS:
                    classes = AMBIGUOUS[words.pop(i)]
                    break
        own = [w for w in words if w not in LINKS]
        if not classes and own[:1] == ["casa"]:
            classes, own = ("ruralhouse",), own[1:]
        if not city:
            for k in range(min(4, len(own) - 1), 0, -1):
                if (c := self.parser.cities.get(" ".join(own[-k:]))) and len(own) > k:
                    city, own = c, own[:-k]
                    break
        return " ".join(classes), " ".join(own), city


def trigrams(word: str) -> list[int]:
    w = f"<{word}>"
    return [zlib.crc32(w[i : i + 3].encode()) & ((1 << BITS) - 1) for i in range(len(w) - 2)]


def crowd_bucket(token: str) -> int:
    return zlib.crc32(token.encode()) & ((1 << CROWD) - 1)


def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) & ((1 << BITS) - 1)


def attributes(words: str, kind: str, lat: float | None, lng: float | None, street: str, city: str) -> list[list[str]]:
    """The tokens of each attribute that a record has."""
    return [a for a in (words.split() + kind.split(), cells(lat, lng) if lat is not None and lng is not None else [], street.split() + city.split()) if a]


#: The checksum of three letters is the sum (xor) of one number for each, as CRC-32 is linear.
_THREE = [np.array([zlib.crc32(bytes(c if k == i else 0 for k in range(3))) & ((1 << BITS) - 1) for c in range(128)], np.int64) for i in range(3)]
#: Rows of a run that are added up one by one for all runs together; the rest of a run is added up by itself.
LONG = 64


def grams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams() of all tokens, one after the other, and the number of each token's."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    letters = np.frombuffer("".join([f"<{t}>" for t in tokens]).encode(), np.uint8)
    if len(letters) > size.sum() + 2 * len(size):  # not all are ASCII
        return np.array([h for t in tokens for h in trigrams(t)], np.int64), size
    at = np.arange(size.sum()) + np.repeat(2 * np.arange(len(size)), size)
    return _THREE[0][letters[at]] ^ _THREE[1][letters[at + 1]] ^ _THREE[2][letters[at + 2]], size


def run_sums(table: np.ndarray, index: np.ndarray, n: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Sums of ``table[index]``, times ``weight``, over runs of ``n`` rows. Runs are added up side by side, the longest first: reduceat
    takes many times as long for short runs."""
    order = np.argsort(-n, kind="stable")
    start, n = (np.cumsum(n) - n)[order], n[order]
    out = np.zeros((len(n), table.shape[1]), table.dtype)
    for k in range(min(LONG, int(n[0]) if len(n) else 0)):
        at = start[: np.searchsorted(-n, -k)] + k
        x = table.take(index[at], axis=0)
        if weight is not None:
            x *= weight[at][:, None]
        out[: len(at)] += x
    for i in range(np.searchsorted(-n, -LONG)):
        at = slice(start[i] + LONG, start[i] + n[i])
        x = table.take(index[at], axis=0)
        if weight is not None:
            x *= weight[at][:, None]
        out[i] += x.sum(axis=0, dtype=np.float64)
    sums = np.empty_like(out)
    sums[order] = out
    return sums


def occurrences(records: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, token, record, chance): the distinct tokens of :func:`attributes` of all records (words, class, lat, lng, street, city),
    and for each that a record has, by record, the chance that a walk takes it from there."""

    def split(name: str) -> tuple[pa.Array, np.ndarray]:
        parts = pc.utf8_split_whitespace(records[name].combine_chunks())
        of = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        tokens = parts.flatten()
        full = pc.not_equal(tokens, "")
        return tokens.filter(full), of[full.to_numpy(zero_copy_only=False)]

    lat, lng = (records[c].to_numpy().astype(float) for c in ("lat", "lng"))
    here = np.flatnonzero(pc.and_(pc.is_valid(records["lat"]), pc.is_valid(records["lng"])).to_numpy())
    groups = [[split("words"), split("class")], [(c, here) for c in cell_columns(lat[here], lng[here])], [split("street"), split("city")]]
    had = [np.bincount(np.concatenate([of for _, of in g]), minlength=records.num_rows) for g in groups]
    full = sum((h > 0).astype(np.int64) for h in had)
    record = np.concatenate([of for g in groups for _, of in g])
    chance = np.concatenate([1 / (full[of] * h[of]) for g, h in zip(groups, had) for _, of in g])
    tokens = pa.concat_arrays([t for g in groups for t, _ in g]).dictionary_encode()
    order = np.argsort(record, kind="stable")
    return tokens.dictionary.to_pylist(), tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order], record[order], chance[order].astype(np.float32)


class Walks:
    """One step of all walks through records: per trigram bucket the visits and the sum of the vectors met.

    A walk goes from a token to a record that has it, by an attribute, to another token of the record. All ways are added up,
    each with its chance, so no walk is drawn. ``vectors`` are those of trigram buckets; a token's is their sum by the root of
    their number. Sums are made per token and spread over its trigrams, BYTES of records at a time.
    """

    BYTES = 3 << 20

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.float32)
        self.visits, self.sums = np.zeros(1 << BITS, np.int64), np.zeros((1 << BITS, DIM))

    def add_all(self, batches: Iterable[pa.RecordBatch]) -> None:
        """Adds the records of all batches; they are gathered, as a token is worked out once for all its records at hand."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            rows = max(1, b.num_rows * self.BYTES // max(1, b.nbytes))
            for lo in range(0, b.num_rows, rows):
                held.append(b.slice(lo, rows))
                if len(held) > 1 and sum(x.nbytes for x in held) > self.BYTES:
                    self.add(pa.Table.from_batches(held[:-1]))
                    held = held[-1:]
        if held:
            self.add(pa.Table.from_batches(held))

    def add(self, records: pa.Table) -> None:
        tokens, at, record, p = occurrences(records)
        if not len(at):
            return
        gram, size = grams(tokens)
        root = np.sqrt(np.maximum(1, size), dtype=np.float32)[:, None]
        own = run_sums(self.vectors, gram, size) / root
        here = run_sums(own, at, np.bincount(record, minlength=records.num_rows), p)
        # What each token meets in its records, but not itself.
        order = np.argsort(at, kind="stable")
        seen = np.bincount(at, minlength=len(size))
        met = run_sums(here, record[order], seen) - np.bincount(at, weights=p, minlength=len(size)).astype(np.float32)[:, None] * own
        order = np.argsort(gram, kind="stable")
        key, n = np.unique(gram, return_counts=True)
        self.visits += np.bincount(gram, weights=np.repeat(seen, size), minlength=1 << BITS).astype(np.int64)
        self.sums[key] += run_sums(met / root, np.repeat(np.arange(len(size)), size)[order], n)


def step(named: DataFrame, vectors: tuple[np.ndarray, np.ndarray] | int) -> tuple[np.ndarray, np.ndarray]:
    """(visits, mean vector met) per trigram bucket, of one step of all walks over all records. ``vectors`` are buckets and their
    vectors, or the seed of :func:`random_vectors`. Each of at most PARTS tasks sends one table of at most 2^BITS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if isinstance(vectors, int):
            table = random_vectors(vectors)
        else:
            table = np.zeros((1 << BITS, DIM), np.float32)
            table[vectors[0]] = vectors[1]
        walks = Walks(table)
        walks.add_all(batches)
        key = np.flatnonzero(walks.visits)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(walks.visits[key]), pa.array([x.tobytes() for x in walks.sums[key].astype(np.float32)], pa.binary())], names=["g", "n", "v"])

    parts = named.select("words", "class", "lat", "lng", "street", "city").coalesce(min(PARTS, named.sparkSession.sparkContext.defaultParallelism))
    visits, sums = np.zeros(1 << BITS, np.int64), np.zeros((1 << BITS, DIM))
    for g, n, v in parts.mapInArrow(run, "g bigint, n bigint, v binary").collect():
        visits[g] += n
        sums[g] += np.frombuffer(v, np.float32)
    return visits, sums / np.maximum(1, visits)[:, None]


def random_vectors(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 1 / math.sqrt(DIM), (1 << BITS, DIM)).astype(np.float32)


def fit(named: DataFrame, seed: int = 11) -> np.ndarray:
    """Skip-gram vectors of trigram buckets, from the random walks over record - attribute - token of all records.

    A token's context are the tokens that walks reach from it in one to STEPS steps, against those that walks meet anywhere (the
    negative samples). Both are means over all walks, none drawn: the bucket's random vector goes towards the first and away
    from the second, as far as it was met often.
    """
    inner = random_vectors(seed).astype(float)
    at: tuple[np.ndarray, np.ndarray] | int = seed
    for _ in range(STEPS):
        visits, met = step(named, at)
        seen = visits > 0
        if not seen.any():
            break
        away = met[seen] - np.average(met[seen], axis=0, weights=visits[seen])
        away /= max(1e-9, math.sqrt(np.average((away**2).sum(axis=1), weights=visits[seen])))
        inner[seen] += PULL / STEPS * away * (visits[seen] / (visits[seen] + VISITS))[:, None]
        at = np.flatnonzero(seen), away.astype(np.float32)
    if not seen.any():
        return inner.astype(np.float32)
    # What all vectors share tells nothing apart, and would put all names on one side of a plane.
    own = inner[seen] - inner[seen].mean(axis=0)
    top = np.linalg.svd(own, full_matrices=False)[2][:COMMON]
    inner[seen] = own - own @ top.T @ top
    return inner.astype(np.float32)


def grown(table: np.ndarray, full: int, more: int) -> np.ndarray:
    """The table, or one twice as long at least, with room for so many rows more than are full."""
    if full + more <= len(table):
        return table
    out = np.zeros((max(2 * len(table), full + more), table.shape[1]), table.dtype)
    out[:full] = table[:full]
    return out


class Nodes:
    """Unit vectors of attributes: their tokens' vectors by squared idf. Tokens' vectors are remembered."""

    def __init__(self, vectors: np.ndarray, frequency: np.ndarray, total: float):
        self.vectors, self.frequency, self.total = vectors, frequency, total
        self.weights: dict[str, float] = {}
        self.known: dict[str, int] = {}
        self.tokens = np.zeros((1024, DIM), np.float32)
        self.at: dict[str, int] = {}
        self.matrix = np.zeros((1024, DIM), np.float32)

    def weight(self, w: str) -> float:
        x = self.weights.get(w)
        if x is None:
            if len(self.weights) > 400_000:
                self.weights.clear()
            x = self.weights[w] = math.log(1 + self.total / (1 + float(self.frequency[bucket("n:" + w)]))) ** 2
        return x

    def words(self, words: list[str]) -> np.ndarray:
        """Rows of ``self.tokens`` for the words; words seen before are not computed again."""
        if len(self.known) > 200_000:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            x = run_sums(self.vectors, *grams(new))
            length = np.sqrt(np.einsum("ij,ij->i", x, x))
            old = len(self.known)
            self.tokens = grown(self.tokens, old, len(new))
            self.tokens[old : old + len(new)] = x * (np.fromiter(map(self.weight, new), float, len(new)) / np.where(length, length, 1.0)).astype(np.float32)[:, None]
            self.known.update(zip(new, range(old, old + len(new))))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def of(self, names: list[str]) -> np.ndarray:
        words = [n.split() for n in names]
        at = self.words([w for x in words for w in x])
        v = run_sums(self.tokens, at, np.fromiter(map(len, words), np.int64, len(words)))
        return v / np.maximum(1e-9, np.sqrt((v * v).sum(axis=1)))[:, None]

    def rows(self, names: list[str], most: int = 200_000) -> np.ndarray:
        """Rows of ``self.matrix`` for the names; names seen before are not computed again."""
        if len(self.at) > most:
            self.at.clear()
        new = [n for n in dict.fromkeys(names) if n not in self.at]
        if new:
            old = len(self.at)
            self.matrix = grown(self.matrix, old, len(new))
            self.matrix[old : old + len(new)] = self.of(new)
            self.at.update(zip(new, range(old, old + len(new))))
        return np.fromiter(map(self.at.__getitem__, names), np.int64, len(names))


def soft_containment(a: tuple, b: tuple) -> float:
    """The weight of words that both have (within an edit; two if long), by that of the lighter side. Both are (words, weights,
    their sum), the heaviest word first."""
    x, wx, sx = a
    y, wy, sy = b
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    got, open_, left = 0.0, list(range(len(y))), []
    for i, w in enumerate(x):
        for k in open_:
            if y[k] == w:
                open_.remove(k)
                got += (wx[i] + wy[k]) / 2
                break
        else:
            left.append(i)
    least = max(1e-9, min(sx, sy))
    for i in left:
        for k in open_:
            if close(x[i], y[k]):
                open_.remove(k)
                got += (wx[i] + wy[k]) / 2
                break
    return min(1.0, got / least)


def close(w: str, o: str) -> bool:
    """Whether two words are the same but for a slip."""
    n, m = len(w), len(o)
    if n < 6 or m < 6 or abs(n - m) > 2 or w[0] != o[0] and w[-1] != o[-1] or len(set(w) ^ set(o)) > 4:
        return False
    return one_edit(w, o) or n > 8 and edits(w, o) <= 2


def edits(a: str, b: str, most: int = 2) -> int:
    """Levenshtein distance with neighbours swapped as one, exact up to ``most``; ``most`` + 1 for all beyond."""
    far = most + 1
    if a == b:
        return 0
    # Equal beginnings and ends cost nothing.
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    k = 0
    while k < n - i and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[i : len(a) - k], b[i : len(b) - k]
    if abs(len(a) - len(b)) > most:
        return far
    before, last = None, [min(j, far) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        # Only so near the diagonal can a distance be within ``most``.
        row = [min(i, far), *[far] * len(b)]
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y), far)
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row[j] = v
        if min(row) > most:
            return far
        before, last = last, row
    return last[-1]


def centers_of(gazetteer: DataFrame) -> tuple[tuple, ...]:
    """(city, lat, lng, radius_km) of the gazetteer's places, if it has these columns; at most as many as :func:`gazetteer_rows`."""
    if not {"lat", "lng", "radius_km"} <= set(gazetteer.columns):
        return ()
    gazetteer_rows(gazetteer)
    return tuple(tuple(r) for r in gazetteer.select("city", "lat", "lng", "radius_km").where("city is not null and lat is not null and lng is not null").orderBy("city", "lat", "lng").collect())


class Centers:
    """The nearest city within whose radius a point lies, by a grid of whole degrees."""

    def __init__(self, centers: tuple[tuple, ...], parser: Parser):
        self.at: dict[tuple[int, int], list[tuple]] = defaultdict(list)
        for city, lat, lng, radius in centers:
            high = (radius or 0.0) / 111.0
            wide = high / max(0.01, math.cos(math.radians(min(89.0, abs(lat) + high))))
            for y in range(math.floor(lat - high), math.floor(lat + high) + 1):
                for x in range(math.floor(lng - wide), math.floor(lng + wide) + 1):
                    # Beyond so many degrees no point is within the radius (near the poles longitudes tell nothing).
                    self.at[y, x].append((parser.place(city), lat, lng, radius or 0.0, high, wide if abs(lat) + high <= 89 else 360.0))

    def of(self, lat: float | None, lng: float | None) -> str:
        if lat is None or lng is None or not self.at:
            return ""
        best = min(((km, city) for city, y, x, radius, high, wide in self.at.get((math.floor(lat), math.floor(lng)), ()) if abs(lat - y) <= high and abs(lng - x) <= wide and (km := distance(lat, lng, y, x)) <= radius), default=None)
        return best[1] if best else ""


def parsed(records: DataFrame, gazetteer: DataFrame, key: str, side: int, group: str | None) -> DataFrame:
    """(side, id, unit, class, words, city, near, street, number, lat, lng, wd) of all rows; ``near`` is the city around the coordinates,
    where the gazetteer (city, province, postcode) has lat, lng and radius_km too."""
    places = gazetteer_rows(gazetteer)
    centers = centers_of(gazetteer)
    unit: Column = F.when(F.trim(F.col(group)) != "", F.xxhash64(F.lit("g"), F.col(group))).otherwise(F.xxhash64(F.lit("r"), F.col(key))) if group else F.col(key).cast("bigint")
    lat, lng = F.col("coordinates.lat").cast("double"), F.col("coordinates.lng").cast("double")
    ok = ~F.isnan(lat) & ~F.isnan(lng) & lat.between(-90, 90) & lng.between(-180, 180) & ((lat != 0) | (lng != 0))
    rows = records.select(
        F.col(key).cast("bigint").alias("id"), unit.alias("unit"), "name", F.col("type").alias("kind"), "address",
        F.when(ok, lat).alias("lat"), F.when(ok, lng).alias("lng"), F.regexp_extract(F.coalesce("wikidataId", F.lit("")), r"(Q\d+)", 1).alias("wd"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_of(places)
        names, around = Names(parser), Centers(centers, parser)
        for b in batches:
            out = []
            for name, kind, address, lat, lng in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5, 6))):
                c, words, city = names.parse(name)
                # Of an address the street and number are matched within its city only.
                a = parser.parse(address)
                out.append((c or TYPES.get(kind or "", ""), words, city or (a[0] if a else ""), around.of(lat, lng), a[2] if a else "", a[3] if a else ""))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(list(c), pa.string()) for c in cols], b.column(5), b.column(6), b.column(7)], names=["id", "unit", "class", "words", "city", "near", "street", "number", "lat", "lng", "wd"])

    out = rows.mapInArrow(run, "id bigint, unit bigint, class string, words string, city string, near string, street string, number string, lat double, lng double, wd string")
    return out.withColumn("side", F.lit(side))


def units(rows: DataFrame) -> DataFrame:
    """One row per side, unit and distinct name, with the unit's places: median coordinates, commonest city, street, identifier.

    All are aggregates that combine within each task first, so a hot unit costs its distinct values.
    """
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    pooled = rows.groupBy("side", "unit").agg(
        F.collect_set(blank("words")).alias("names"), F.percentile_approx("lat", 0.5).alias("lat"), F.percentile_approx("lng", 0.5).alias("lng"),
        F.mode(blank("city"), deterministic=True).alias("city"), F.mode(blank("near"), deterministic=True).alias("near"), F.mode(F.when(F.col("street") != "", F.struct("street", "number")), deterministic=True).alias("at"), F.mode(blank("wd"), deterministic=True).alias("wd"), F.mode(blank("class"), deterministic=True).alias("class"),
    )
    return pooled.select("side", "unit", F.explode("names").alias("words"), text(F.col("class")).alias("class"), "lat", "lng", text(F.coalesce("city", "near")).alias("city"), text(F.col("near")).alias("near"), text(F.col("at.street")).alias("street"), text(F.col("at.number")).alias("number"), text(F.col("wd")).alias("wd"))


def singles(rows: DataFrame) -> DataFrame:
    """Rows that are a unit each, in the form of :func:`units`: nothing is to be pooled, so nothing is shuffled."""
    filled = lambda c: text(F.col(c)).alias(c)
    return rows.where("words <> ''").select("side", "unit", "words", filled("class"), "lat", "lng", text(F.coalesce(F.nullif("city", F.lit("")), F.col("near"))).alias("city"), filled("near"), filled("street"), F.when(F.col("street") != "", F.col("number")).otherwise("").alias("number"), filled("wd"))


def name_tables(bits: int) -> int:
    """The number of tables of so many bits: more records need more bits, which names of one cosine share less often."""
    share = (1 - math.acos(ALIKE) / math.pi) ** bits
    return max(TABLES, math.ceil(math.log(1 - HIT) / math.log(1 - share)))


def cells(lat: float, lng: float, size: float = CELL) -> list[str]:
    """The cells of a point in shifted grids (of equal width in kilometres at any latitude, as far as cells need)."""
    band = max(1e-3, math.cos(math.radians(round(lat))))
    return [f"{g}:{math.floor(lat / size + g / GRIDS)}:{math.floor(lng * band / size + (g * 2 % GRIDS + g // 2) / GRIDS)}" for g in range(GRIDS)]


def cell_columns(lat: np.ndarray, lng: np.ndarray, size: float = CELL) -> list[pa.Array]:
    """The :func:`cells` of many points, one column for each grid."""
    rounded, at = np.unique(np.rint(lat), return_inverse=True)
    band = np.array([max(1e-3, math.cos(math.radians(x))) for x in rounded])[at] if len(lat) else lat
    number = lambda x: pc.cast(pa.array(np.floor(x).astype(np.int64)), pa.string())
    return [pc.binary_join_element_wise(str(g), number(lat / size + g / GRIDS), number(lng * band / size + (g * 2 % GRIDS + g // 2) / GRIDS), ":") for g in range(GRIDS)]


def coarse(lat: float, lng: float) -> list[str]:
    """Wide cells in shifted grids, for points in no city; two points within NEAR_KM share one at least."""
    return cells(lat, lng, 0.2)


#: Degrees of the cells of nearby(): a bit more than NEAR_KM.
WIDE = 1.1 * NEAR_KM / 111.19


def nearby(lat: float, lng: float, halo: bool) -> set[str]:
    """The cell of a point, or with ``halo`` all cells with points within NEAR_KM of it (one cell a row beyond 85 degrees)."""
    row, out = math.floor(lat / WIDE), set()
    for r in (row - 1, row, row + 1) if halo else (row,):
        middle = (r + 0.5) * WIDE
        if abs(middle) > 85:
            out.add(f"{r}:")
            continue
        for x in (lng, lng - 360, lng + 360) if halo and abs(lng) > 179 else (lng,):
            c = math.floor(x * math.cos(math.radians(middle)) / WIDE)
            out.update(f"{r}:{k}" for k in ((c - 1, c, c + 1) if halo else (c,)))
    return out


def place_tokens(side: int, lat: float | None, lng: float | None, city: str, street: str, number: str) -> set[str]:
    """Two rows of different sides share a token if decided() may find that their places agree: coordinates within NEAR_KM, or,
    where one has none, the city or the number of a street."""
    here = lat is not None and lng is not None
    out = {f"n{c}" for c in nearby(lat, lng, side == 1)} if here else set()
    vague = [*([f"c{city}"] if city else ()), *([f"s{number}"] if street else ())]
    # Two bits: whether left and right have coordinates; not both.
    states = ((1, 0),) if here and side == 0 else ((0, 1),) if here else ((0, 0), (0, 1)) if side == 0 else ((0, 0), (1, 0))
    return out | {f"{t}|{a}{b}" for t in vague for a, b in states}


def block_pairs(side: int, nid: int, blocks: int) -> list[str]:
    """The pairs of blocks that a row takes part in: each left row meets each right row in exactly one."""
    own = zlib.crc32(str(nid).encode()) % blocks
    return [f"{own}.{k}" if side == 0 else f"{k}.{own}" for k in range(blocks)]


def common_names(named: DataFrame, buckets: np.ndarray) -> list[tuple[str, str, int, int]]:
    """(words, class, first unit, last unit) of the names that more than HOT left units have; at most one in HOT rows.

    ``buckets`` are the crowd buckets in which such names can be, so mostly there is nothing to count.
    """
    if not len(buckets):
        return []
    some = F.broadcast(named.sparkSession.createDataFrame([(int(b),) for b in buckets], "b bigint"))
    left = named.where("side = 0").select("words", "class", "unit", F.crc32(F.concat_ws("|", "words", "class").cast("binary")).bitwiseAND(F.lit((1 << CROWD) - 1)).alias("b"))
    rows = left.join(some, "b").groupBy("words", "class").agg(F.count("*").alias("n"), F.min("unit"), F.max("unit")).where(F.col("n") > HOT).drop("n").collect()
    return [tuple(r) for r in rows]


_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(*parts) -> np.ndarray:
    """One 63-bit key of several numbers (arrays or single ones)."""
    h = np.uint64(0x165667B19E3779F9)
    with np.errstate(over="ignore"):
        for x in parts:
            h = (h ^ np.asarray(x).astype(np.uint64)) * _P1
            h = (h ^ (h >> np.uint64(29))) * _P2
            h = h ^ (h >> np.uint64(32))
    return (h >> np.uint64(1)).astype(np.int64)


def named_key(token: str) -> int:
    c = token.encode()
    return (zlib.crc32(c) << 32 | zlib.adler32(c)) & ((1 << 63) - 1)


class Blocks:
    """The keys under which name nodes and places are looked up. Sent to the tasks: planes and the cities' sizes (one number each)."""

    def __init__(self, total: int, cities: dict[str, int], wide: np.ndarray, blocks: np.ndarray, common: list[tuple[str, str, int, int]]):
        bits = lambda n: max(4, round(math.log2(max(1, n))) + 1)
        self.bits = {c: bits(n) for c, n in cities.items()}
        self.wide_bits = np.array([bits(n) for n in wide], np.int64)
        self.over = max(8, round(math.log2(max(2, total))) - 4)  # bits of the tables over all
        self.width = max([*self.bits.values(), int(self.wide_bits.max()), self.over, COMMON_BITS])
        # With every bit turned once, names share a bucket of one table more often.
        p = 1 - math.acos(ALIKE) / math.pi
        once = p**self.over + self.over * p ** (self.over - 1) * (1 - p)
        self.over_tables = math.ceil(math.log(1 - HIT) / math.log(1 - once))
        self.count = max([name_tables(self.width), self.over_tables])
        self.blocks, self.crowded = blocks, bool((blocks > 1).any())
        self.witnesses = {(w, c): (a, b) for w, c, a, b in common}
        rng = np.random.default_rng(3)
        self.planes = rng.normal(size=(DIM, self.count * self.width)).astype(np.float32)
        self.place_planes = rng.normal(size=(DIM, GRIDS * PLACE_PLANES)).astype(np.float32)
        self.sketch_planes = rng.normal(size=(DIM, 64)).astype(np.float32)
        self.busy = np.zeros(0, np.int64)

    def codes(self, v: np.ndarray) -> np.ndarray:
        """(names, tables): the signs of each table's planes; fewer bits are its lowest ones."""
        signs = (v @ self.planes > 0).reshape(-1, self.width).astype(np.float32)
        return (signs @ (2.0 ** np.arange(self.width)).astype(np.float32)).astype(np.int64).reshape(len(v), self.count) if self.width <= 24 else (signs.astype(np.int64) @ (1 << np.arange(self.width))).reshape(len(v), self.count)

    def sketch(self, v: np.ndarray) -> np.ndarray:
        return np.packbits(v @ self.sketch_planes > 0, axis=1).view(np.int64).ravel() if len(v) else np.zeros(0, np.int64)

    def common_buckets(self, codes: np.ndarray) -> np.ndarray:
        """(names, tables): the buckets of COMMON_BITS bits."""
        few = name_tables(COMMON_BITS)
        return (codes[:, :few] & ((1 << COMMON_BITS) - 1)) | np.arange(few) << 40

    def keys(self, side: int, d: dict, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, key, sketch) of a batch."""
        n = len(v)
        codes, sketch = self.codes(v), self.sketch(v)
        place = (v @ self.place_planes > 0).reshape(-1, GRIDS, PLACE_PLANES) @ (1 << np.arange(PLACE_PLANES))
        common = np.array([side == 0 and (w, c) in self.witnesses for w, c in zip(d["words"], d["class"])], bool)
        witness = np.array([side == 1 or u in self.witnesses.get((w, c), (u,)) for w, c, u in zip(d["words"], d["class"], d["unit"])], bool)
        rows: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        # Tables within a city.
        by_bits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, (city, near, lat, lng) in enumerate(zip(d["city"], d["near"], d["lat"], d["lng"])):
            if common[i]:
                continue
            for c in {city, near} - {""}:
                by_bits[self.bits[c]].append((i, named_key("c|" + c)))
            if lat is not None and lng is not None and not near:
                for c in coarse(lat, lng):
                    by_bits[int(self.wide_bits[crowd_bucket(c)])].append((i, named_key("g|" + c)))
        for b, own in by_bits.items():
            i, c = (np.array(x, np.int64) for x in zip(*own))
            t = np.arange(name_tables(b))
            rows.append(np.repeat(i, len(t)))
            keys.append(mixed(1, c[:, None], t[None, :], codes[i][:, : len(t)] & ((1 << b) - 1)).ravel())
        # Tables over all: every record stands in its buckets, those of no place look around them.
        t = np.arange(self.over_tables)
        own = codes[:, : len(t)] & ((1 << self.over) - 1)
        i = np.flatnonzero(witness)
        rows.append(np.repeat(i, len(t)))
        keys.append(mixed(2 + side, t[None, :], own[i]).ravel())
        i = np.flatnonzero(witness & np.array([la is None and not c for la, c in zip(d["lat"], d["city"])], bool))
        turned = own[i][:, :, None] ^ np.concatenate([[0], 1 << np.arange(self.over)])[None, None, :]
        rows.append(np.repeat(i, len(t) * (self.over + 1)))
        keys.append(mixed(3 - side, np.broadcast_to(t[None, :, None], turned.shape), turned).ravel())
        more: list[tuple[int, int]] = []
        # The right rows look around the buckets of common names with every bit turned once.
        around = self.common_buckets(codes) if len(self.busy) else np.zeros((n, 0), np.int64)
        if side and len(self.busy):
            around = np.concatenate([around, *(around ^ (1 << k) for k in range(COMMON_BITS))], axis=1)
        shared = np.isin(around, self.busy) if len(self.busy) else None
        for i, (lat, lng, city, street, number) in enumerate(zip(*(d[c] for c in ("lat", "lng", "city", "street", "number")))):
            if shared is not None and shared[i].any():
                for token in place_tokens(side, lat, lng, city, street, number):
                    h = named_key("h|" + token)
                    more += [(i, int(k)) for k in mixed(4, h, around[i][shared[i]])]
            if lat is not None and lng is not None:
                for g, cell in enumerate(cells(lat, lng)):
                    k = int(self.blocks[crowd_bucket(cell)]) if self.crowded else 1
                    for c in [cell] if k == 1 else [f"{cell}|{x}" for x in block_pairs(side, d["nid"][i], k)]:
                        more.append((i, named_key(f"{c}|{place[i, g]}")))
            if street:
                # Beginning and end of the street's own name with the number: one slip leaves the other whole.
                last = street.split()[-1]
                for g, part in enumerate((last[:5], last[-5:])):
                    more.append((i, named_key(f"a{g}|{number}|{part}|{place[i, g]}")))
        rows.append(np.array([x for x, _ in more], np.int64))
        keys.append(np.array([x for _, x in more], np.int64))
        at = np.concatenate(rows)
        signs = sketch[at]
        wd = [(i, named_key("w|" + x)) for i, x in enumerate(d["wd"]) if x]
        # Equal identifiers meet whatever the names.
        return np.concatenate([at, np.array([i for i, _ in wd], np.int64)]), np.concatenate([*keys, np.array([k for _, k in wd], np.int64)]), np.concatenate([signs, np.zeros(len(wd), np.int64)])


def matches(left: DataFrame, right: DataFrame, gazetteer: DataFrame, left_key: str = "entity_id", right_key: str = "kb_id", left_group: str | None = "entity_key") -> DataFrame:
    """(unit, kb, confidence, cosine): units of the left table and rows of the right one that mean the same thing."""
    own = parsed(left, gazetteer, left_key, 0, left_group)
    named = cut((units(own) if left_group else singles(own)).unionByName(singles(parsed(right, gazetteer, right_key, 1, None))))
    # Frequencies over all records, in buckets: of name tokens, of whole names and of cells.
    total = max(1, named.count())
    frequency, same, crowd, wide = np.zeros(1 << BITS), np.zeros(1 << CROWD), np.zeros(1 << CROWD), np.zeros(1 << CROWD)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = defaultdict(int)
        for b in batches:
            for words, kind, side, lat, lng, near in zip(*(b.column(i).to_pylist() for i in range(6))):
                for w in set(words.split()):
                    seen[bucket("n:" + w)] += 1
                if side == 0:
                    seen[1 << 20 | crowd_bucket(f"{words}|{kind}")] += 1
                if lat is not None and lng is not None:
                    for c in cells(lat, lng):
                        seen[1 << 21 | crowd_bucket(c)] += 1
                    for c in () if near else coarse(lat, lng):
                        seen[3 << 20 | crowd_bucket(c)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["b", "n"])

    counted = named.select("words", "class", "side", "lat", "lng", "near").mapInArrow(count, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).where((F.col("b") < 1 << 20) | (F.col("b") >= 3 << 20) | (F.col("n") > HOT)).toPandas()
    at, n = counted["b"].to_numpy(dtype=np.int64), counted["n"].to_numpy(dtype=float)
    for table, flag in ((frequency, 0), (same, 1 << 20), (crowd, 1 << 21), (wide, 3 << 20)):
        own = (at & (3 << 20)) == flag
        table[at[own] ^ flag] = n[own]
    # One number per city of the gazetteer.
    cities = {r["c"]: r["n"] for r in named.select(F.explode(F.array_distinct(F.array("city", "near"))).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n")).collect()}
    common = common_names(named, np.flatnonzero(same > HOT))
    vectors = fit(named)
    blocks = Blocks(total, cities, wide, np.ceil(np.maximum(crowd, 1) / HOT).astype(np.int64), common)
    blocks.busy = np.unique(blocks.common_buckets(blocks.codes(Nodes(vectors, frequency, total).of(sorted({w for w, *_ in common})))))
    named = named.withColumn("nid", F.xxhash64("side", "unit", "words"))

    def hashed(side: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = Nodes(vectors, frequency, total)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                d = b.slice(lo, 2000).to_pydict()
                at, keys, sketch = blocks.keys(side, d, nodes.of(d["words"]))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(d["nid"], np.int64)[at]), pa.array(keys), pa.array(sketch)], names=["nid", "key", "sk"])

    def side(s: int, nid: str) -> DataFrame:
        return named.where(F.col("side") == s).select("nid", "unit", "words", "class", "lat", "lng", "city", "near", "street", "number", "wd").mapInArrow(partial(hashed, s), "nid bigint, key bigint, sk bigint").select(F.col("nid").alias(nid), "key", F.col("sk").alias(f"{nid}_sk"))

    alike_signs = F.bit_count(F.col("l_sk").bitwiseXOR(F.col("r_sk"))) <= SKETCH
    # Laid out by the left node before they are made distinct, so that the join with its name needs no further shuffle.
    pairs = side(0, "l").join(side(1, "r"), "key").where(alike_signs).select("l", "r").repartition("l").distinct()
    attributes = ["unit", "class", "lat", "lng", "city", "street", "number", "wd"]
    of = lambda s, nid, p, cs: named.where(F.col("side") == s).select(F.col("nid").alias(nid), *[F.col(c).alias(p + c) for c in cs])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = Nodes(vectors, frequency, total)
        known: dict[str, tuple] = {}

        def weighed(name: str) -> tuple:
            x = known.get(name)
            if x is None:
                if len(known) > 200_000:
                    known.clear()
                w = sorted(((nodes.weight(w) * (0.3 if w in _SUB else 1), k, w) for k, w in enumerate(name.split())), key=lambda z: (-z[0], z[1]))
                x = known[name] = ([z[2] for z in w], [z[0] for z in w], sum(z[0] for z in w))
            return x

        for b in batches:
            l, r = (b.column(c).dictionary_encode() for c in ("l_words", "r_words"))
            names = [x.dictionary.to_pylist() for x in (l, r)]
            at = [nodes.rows(x) for x in names] if b.num_rows else [np.zeros(0, np.int64)] * 2
            il, ir = (x.indices.to_numpy(zero_copy_only=False) for x in (l, r))
            cosine = np.einsum("ij,ij->i", nodes.matrix[at[0][il]], nodes.matrix[at[1][ir]])
            same = pc.and_(pc.equal(b.column("l_wd"), b.column("r_wd")), pc.not_equal(b.column("l_wd"), "")).to_numpy(zero_copy_only=False).astype(bool)
            keep = np.flatnonzero((cosine >= LEAST) | same)
            name = np.array([soft_containment(weighed(names[0][i]), weighed(names[1][k])) for i, k in zip(il[keep].tolist(), ir[keep].tolist())])
            keep, name = keep[name >= 0.4], name[name >= 0.4]
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column("l").take(take), b.column("r").take(take), pa.array(cosine[keep].astype(np.float64)), pa.array(name, pa.float64())], names=["l", "r", "cosine", "name"])

    near = pairs.join(of(0, "l", "l_", ["words", "wd"]), "l").join(of(1, "r", "r_", ["words", "wd"]), "r").mapInArrow(alike, "l bigint, r bigint, cosine double, name double")
    # How many left units have just this name.
    namesakes = named.where("side = 0").groupBy("words").agg(F.count_distinct("unit").alias("k"))
    l = of(0, "l", "l_", [*attributes, "words"]).join(namesakes.select(F.col("words").alias("l_words"), F.col("k").alias("l_same")), "l_words")
    r = of(1, "r", "r_", [*attributes, "words"]).join(namesakes.select(F.col("words").alias("r_words"), F.col("k").alias("r_same")), "r_words", "left")
    full = near.join(l, "l").join(r, "r").withColumn("others", F.col("l_same") - 1 + F.when(F.col("l_words") != F.col("r_words"), F.coalesce("r_same", F.lit(0))).otherwise(0)).drop("l_words", "r_words", "l_same", "r_same")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            out = []
            for i in range(b.num_rows):
                cl, cr = set(d["l_class"][i].split()), set(d["r_class"][i].split())
                kind = 0 if not cl or not cr else 1 if cl & cr else -1
                km = distance(d["l_lat"][i], d["l_lng"][i], d["r_lat"][i], d["r_lng"][i])
                city = 0 if not d["l_city"][i] or not d["r_city"][i] else 1 if d["l_city"][i] == d["r_city"][i] else -1
                street = 0
                if d["l_street"][i] and d["r_street"][i]:
                    same = edits(d["l_street"][i], d["r_street"][i]) <= 2 and d["l_number"][i] == d["r_number"][i]
                    street = 1 if same else -1
                wd = 0 if not d["l_wd"][i] or not d["r_wd"][i] else 1 if d["l_wd"][i] == d["r_wd"][i] else -1
                out.append((d["l_unit"][i], d["r_unit"][i], d["cosine"][i], d["name"][i], kind, -1.0 if km is None else km, city, street, wd, d["others"][i]))
            cols = list(zip(*out)) if out else [[]] * 10
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["unit", "kb", "cosine", "name", "kind", "km", "city", "street", "wd", "others"])

    scored = full.mapInArrow(rerank, "unit bigint, kb bigint, cosine double, name double, kind int, km double, city int, street int, wd int, others bigint")
    best = cut(scored.groupBy("unit", "kb").agg(F.max(F.struct("name", "cosine", "kind", "km", "city", "street", "wd", "others")).alias("s")).select("unit", "kb", "s.*"))
    return calibrated(decided(best))


def distance(a: float | None, b: float | None, c: float | None, d: float | None) -> float | None:
    if None in (a, b, c, d):
        return None
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def decided(best: DataFrame) -> DataFrame:
    """Adds ``same``. Names must agree and classes must not differ; then places decide, from the surest to the vaguest: near
    coordinates, street and number, city; where no place is known an identifier, or a name that fits one unit only, and that no
    other unit has letter by letter (``others``)."""
    named = (F.col("name") >= 0.75) & (F.col("kind") >= 0)
    placed = F.when(F.col("km") >= 0, F.col("km") <= NEAR_KM).when(F.col("street") != 0, (F.col("street") == 1) & (F.col("city") >= 0)).when(F.col("city") != 0, F.col("city") == 1)
    alone = best.where(named).groupBy("kb").agg(F.count("*").alias("fits"))
    b = best.join(alone, "kb", "left")
    vague = F.when(F.col("wd") != 0, F.col("wd") == 1).otherwise((F.col("fits") == 1) & (F.col("others") == 0))
    known = (F.col("wd") == 1) & (F.col("km") >= 0) & (F.col("km") <= 1) & (F.col("kind") >= 0)
    return b.withColumn("same", named & F.coalesce(placed, vague) | known)


def weights(best: DataFrame) -> np.ndarray:
    """Logistic regression of identifier agreement on cosine, name, class and places, fit on all pairs that both carry one, by
    Newton's method.

    Tasks send sums of a fixed size: pairs, agreeing ones, loss, gradient and Hessian. With under 20 pairs, or all of one kind,
    the weights are those of the start.
    """
    rows = best.where("wd <> 0").select("cosine", "name", "kind", "km", "city", "street", "wd")
    start = np.array([-1.0, 1.0, 1.0, 0.5, 2.0, 0.5, 1.0])
    k = len(start)

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(3 + k + k * k)
            for b in batches:
                c = [x.to_numpy(zero_copy_only=False).astype(float) for x in b.columns]
                x = np.column_stack([np.ones(len(c[0])), *c[:3], np.where(c[3] > NEAR_KM, -1.0, np.where(c[3] < 0, 0.0, 1.0)), c[4], c[5]])
                y, z = c[6] == 1, x @ w
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                total += np.concatenate([[len(y), y.sum(), (np.logaddexp(0, z) - y * z).sum()], x.T @ (p - y), (x.T * (p * (1 - p)) @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

        return sum((np.array(r["s"]) for r in rows.mapInArrow(run, "s array<double>").collect()), np.zeros(3 + k + k * k))

    w, s = start, sums(start)
    n = s[0]
    if n < 20 or s[1] in (0, n):
        return start
    penalty = 1e-3
    cost = lambda w, s: s[2] / n + penalty * w @ w / 2
    while True:
        gradient = s[3 : 3 + k] / n + penalty * w
        move = np.linalg.solve(s[3 + k :].reshape(k, k) / n + penalty * np.eye(k), gradient)
        if gradient @ move < 1e-12:
            return w
        part, old = 1.0, cost(w, s)
        while True:
            s = sums(w - part * move)
            if cost(w - part * move, s) <= old + 1e-12 or part < 1e-6:
                break
            part /= 2
        w = w - part * move
        if part < 1e-6:
            return w


def calibrated(best: DataFrame) -> DataFrame:
    """The pairs that are the same, with a confidence: logistic regression of identifier agreement on cosine, name and places, fit on
    all pairs that both carry one."""
    w = weights(best)
    place = F.when(F.col("km") > NEAR_KM, -1.0).when(F.col("km") < 0, 0.0).otherwise(1.0)
    z = sum((F.lit(float(a)) * c for a, c in zip(w[1:], (F.col("cosine"), F.col("name"), F.col("kind"), place, F.col("city"), F.col("street")))), F.lit(float(w[0])))
    return best.where("same").select("unit", "kb", F.round(1 / (1 + F.exp(-z)), 4).alias("confidence"), F.round("cosine", 4).alias("cosine"))


def match_records(left: DataFrame, right: DataFrame, gazetteer: DataFrame, left_key: str = "entity_id", right_key: str = "kb_id", left_group: str | None = "entity_key") -> DataFrame:
    """(``left_key``, ``right_key``, confidence): every pair of rows that mean the same thing.

    Rows without a name can only match as part of their group. Null attributes count as unknown, out-of-range coordinates
    too. A row may have several partners on either side; repeated rows each have theirs. Hot units are spread by row when
    they are expanded, as the units' pairs are joined to the rows by a shuffle that adaptive execution splits.
    """
    found = matches(left, right, gazetteer, left_key, right_key, left_group)
    unit = F.when(F.trim(F.col(left_group)) != "", F.xxhash64(F.lit("g"), F.col(left_group))).otherwise(F.xxhash64(F.lit("r"), F.col(left_key))) if left_group else F.col(left_key).cast("bigint")
    rows = left.select(F.col(left_key).cast("bigint").alias("id"), unit.alias("unit"))
    return rows.join(found, "unit").select(F.col("id").alias(left_key), F.col("kb").alias(right_key), "confidence")
