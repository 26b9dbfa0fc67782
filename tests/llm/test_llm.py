"""The operators for training text, against brute force, other libraries, or small known cases."""

import collections
import datetime
import math
import random
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mirador.llm import addresses, boilerplate, cutoff, leaks, matching, queries, residue, site_lines, survivor, tokenize
from mirador.sources.tables import table

COORD = "struct<lat:double,lng:double,source:string,confidence:double>"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_runs_on_the_small_tables(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, small, name):
    df = queries.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(map(str, ([r[c] for c in cols] for r in df.collect())))
    want = sorted(map(str, (list(r) for r in duck.execute(f"select {', '.join(cols)} from ({queries.SQL[name]})").fetchall())))
    assert got == want


# 1: repeated lines of a site


def test_repeated_lines(spark):
    rows = [(k, f"https://www.A.es:80/x{k}", f"Aviso  Legal {k}\nTexto {'abcdefghij'[k % 10]}{k}x" + ("\naviso\xa0legal 7" if k % 2 else ""), "extra") for k in range(10)]
    rows += [(100, "http://a.es/y", None, ""), (101, "http://a.es/z", "\n \n", ""), (102, None, "aviso legal 1", ""), (103, "http://b.es/z", "Aviso legal 1", "")]
    df = spark.createDataFrame(rows, "block_uid bigint, url string, text string, lines string")
    got = {tuple(r) for r in site_lines.find_repeated_lines(df).collect()}
    assert got == {(k, 0) for k in range(10)} | {(k, 2) for k in range(10) if k % 2}
    clean = {r["block_uid"]: (r["text"], r["removed"]) for r in site_lines.remove_repeated_lines(df).collect()}
    assert clean[3] == ("Texto d3x", 2) and clean[100] == (None, 0) and clean[103] == ("Aviso legal 1", 0)
    assert site_lines.find_repeated_lines(df.where("false")).count() == 0


def test_share_and_number_both_count(spark):
    rows = [(k, "http://a.es/", "una" if k < 8 else f"w{'abcdefghijklmnop'[k % 16]}{'abcdefghijklmnop'[k // 16]}") for k in range(170)]
    df = spark.createDataFrame(rows, "block_uid bigint, url string, text string")
    assert site_lines.find_repeated_lines(df).count() == 0
    assert site_lines.find_repeated_lines(df.where("block_uid < 160")).count() == 8


def test_trees_of_two_partitions_merge_by_path():
    lines = [["aviso legal de la villa", "hoy 0 grados"], ["aviso legal de la aldea", "hoy 0 grados"], ["hoy 0 grados", "aviso legal"]]
    whole, left, right = site_lines.TokenTree(), site_lines.TokenTree(), site_lines.TokenTree()
    for k, ls in enumerate(lines):
        for tree in (whole, left if k == 0 else right):
            tree.insert("a.es", ls)
    left.merge(right)
    assert sorted(left.templates(), key=str) == sorted(whole.templates(), key=str) and left.rows == whole.rows == {"a.es": 3}
    # The rest of a line is a slot where lines of one path differ.
    assert {(p, rest, n) for _, p, rest, n in left.templates()} == {("5 aviso legal de", None, 2), ("3 hoy 0 grados", "", 3), ("2 aviso legal", "", 1)}


def test_lines_under_a_slot_count_by_themselves(spark):
    rows = [(k, "http://a.es/", f"lee la ficha de {'abcdefghij'[k % 10] if k < 40 else 'siempre'}\nlee la ficha de {'abc'[k % 3]}z") for k in range(60)]
    df = spark.createDataFrame(rows, "block_uid bigint, url string, text string").repartition(5)
    assert {tuple(r) for r in site_lines.find_repeated_lines(df).collect()} == {(k, 0) for k in range(40, 60)} | {(k, 1) for k in range(60)}


# 2: best value


ENTITY = f"entity_id bigint, entity_key string, score double, extracted_at timestamp_ntz, shortDescription string, longDescription string, address string, coordinates {COORD}, value string, field string"


def test_survivor_equals_brute_force(spark):
    r = random.Random(4)
    texts = [None, "", "  ", "Sin datos", "N/D", "...", "Una plaza", "Una plaza…", "Una plaza grande y antigua de la ciudad vieja con fuentes y muchas flores de colores", "Una plaza grande y antigua de la ciudad vieja con fuentes y muchas flores de colores y bancos", "Una plaza grande y antigua de la ciudad vieja con fuentes y muchas flores de colores ...", "Otra"]
    day = datetime.datetime(2025, 1, 1)
    rows = []
    for k in range(400):
        c = r.choice([None, (0.0, 0.0, "", 1.0), (float("nan"), 1.0, "", 1.0), (91.0, 1.0, "", 1.0), (40.0, None, "", 0.9), (40.0, -3.0, "", r.choice([None, 0.5, 0.9]))])
        rows.append((k, r.choice([None, "", *[f"k{i}" for i in range(60)]]), r.choice([None, 0.5, 0.9]), r.choice([None, day, day + datetime.timedelta(days=1)]), r.choice(texts), r.choice(texts), r.choice(texts), c, "x", "y"))
    df = spark.createDataFrame(rows, ENTITY)
    got = {tuple(x) for x in survivor.choose_strict(df).collect()}
    unknown = {"", "sin datos", "n/d", "..."}
    strip = lambda s: re.sub(r"\s*(…|\.{3,})+$", "", s.strip())
    groups = collections.defaultdict(list)
    for x in rows:
        if x[1]:
            groups[x[1]].append(x)
    want = set()
    low = datetime.datetime(1, 1, 1)
    for g, xs in groups.items():
        if len(xs) < 2:
            continue
        for name, i in (("shortDescription", 4), ("longDescription", 5), ("address", 6)):
            us = [(x, strip(x[i]) if i < 6 else x[i].strip()) for x in xs if x[i] and x[i].strip().lower() not in unknown]
            if i < 6:
                us = [(x, s) for x, s in us if not any(len(o) > len(s) and o.startswith(s) for _, o in us)]
            if us:
                want.add((g, name, max(us, key=lambda z: (-1 if z[0][2] is None else z[0][2], z[0][3] or low, -z[0][0]))[0][0]))
        us = [x for x in xs if x[7] and None not in x[7][:2] and x[7][0] == x[7][0] and abs(x[7][0]) <= 90 and x[7][:2] != (0.0, 0.0)]
        if us:
            want.add((g, "coordinates", max(us, key=lambda z: (-1 if z[7][3] is None else z[7][3], z[3] or low, -z[0]))[0]))
    assert got == want
    assert survivor.choose_strict(df.where("false")).count() == 0
    assert survivor.choose_summed(df, "2026-01-01").columns == ["entity_key", "shortDescription", "longDescription", "address", "coordinates"]


def test_votes_add_up(spark):
    day = datetime.datetime(2025, 1, 1)
    rows = [(1, "k", 0.9, day, "Sola", None, None, None, "", ""), (2, "k", 0.5, day, "Dos", None, None, None, "", ""), (3, "k", 0.5, day, "dos.", None, None, None, "", ""), (4, "k", 5.0, day - datetime.timedelta(days=9000), "Vieja", None, None, None, "", "")]
    assert survivor.choose_summed(spark.createDataFrame(rows, ENTITY), "2025-01-01").first()["shortDescription"] in ("Dos", "dos.")


def test_beginnings_have_no_vote(spark):
    day = datetime.datetime(2025, 1, 1)
    long = "Una plaza grande y antigua de la ciudad vieja con fuentes y muchas flores de colores y bancos"
    rows = [(k, "k", 0.9, day, "Una plaza gran...", long[:80], "Calle Sol", None, "", "") for k in range(3)] + [(3, "k", 0.5, day, "Una plaza grande", long, "Calle Sol 5", None, "", "")]
    got = survivor.choose_summed(spark.createDataFrame(rows, ENTITY), "2025-01-01").first()
    assert (got["shortDescription"], got["longDescription"], got["address"]) == ("Una plaza grande", long, "Calle Sol")


# 3: matching


def test_matching(spark):
    gz = spark.createDataFrame([("Burgos", "Provincia de Burgos", "09001"), ("Lerma", None, "09340")], "city string, province string, postcode string")
    s = f"{{}} bigint, name string, type string, address string, coordinates {COORD}, wikidataId string, entity_key string, words string"
    at = lambda a, b: (a, b, "", 1.0)
    left = [(1, "Castillo de Tolmarrén", "Castle", "Calle Mayor 3, Burgos", at(42.34, -3.70), "", "k1", "x"), (2, "Tolmarrén, Castell", "", None, None, None, "k1", "x"), (3, "Castillo de Tolmarrén", "Castle", None, at(40.0, -3.0), "", None, "x"), (4, None, None, None, None, None, None, None), (5, "Museo Berlanga", "Museum", "", at(42.0, -3.75), "Q5", "k5", "x"), (6, "Hotel Zurbarán", "Hotel", "C/ Sol 5, Lerma", None, "", "k6", ""), (7, "Iglesia Zurbarán", "Church", "C/ Sol 5, Lerma", None, "", "k7", "")]
    right = [(10, "Castle Tolmarren", "Castle", "", at(42.3401, -3.7001), "", "", ""), (11, "Museu Berlanga", "Museum", None, None, "Q5", "", ""), (12, "Htl. Zurbaran", "", "Calle del Sol, 5 - 09340", None, None, "", ""), (13, "Castillo de Tolmarrén", "Castle", None, at(10.0, 10.0), None, "", ""), (14, "", "", "", None, "", "", "")]
    l, r = spark.createDataFrame(left, s.format("entity_id")), spark.createDataFrame(right, s.format("kb_id"))
    got = matching.match_records(l, r, gz)
    assert {(x["entity_id"], x["kb_id"]) for x in got.collect()} == {(1, 10), (2, 10), (5, 11), (6, 12)}
    assert all(0 <= x["confidence"] <= 1 for x in got.collect())
    assert matching.match_records(l.where("false"), r, gz).count() == 0 == matching.match_records(l, r.where("false"), gz).count()


def test_edits():
    assert matching.edits("abcdef", "abdcef") == 1 and matching.edits("abcdef", "abcdef") == 0 and matching.edits("abcdef", "xyzdef") == 3


def test_all_records_are_walked_over(spark):
    cols = "words string, class string, lat double, lng double, street string, city string"
    rows = [("torre vieja", "castle", 42.3, -3.7, "mayor", "lerma"), ("torre", "", None, None, "", ""), ("vieja vieja", "", None, None, "sol", "lerma"), ("", "", None, None, "", "")]
    vectors = matching.random_vectors(1)
    own = lambda t: vectors[matching.trigrams(t)].sum(axis=0) / math.sqrt(len(matching.trigrams(t)))
    visits, sums = collections.Counter(), {}
    for r in rows:
        a = matching.attributes(*r)
        for k, tokens in enumerate(a):
            for i, t in enumerate(tokens):
                met = sum(own(o) / len(a) / len(os) for n, os in enumerate(a) for j, o in enumerate(os) if (n, j) != (k, i))
                for g in matching.trigrams(t):
                    visits[g] += 1
                    sums[g] = sums.get(g, 0) + met / math.sqrt(len(matching.trigrams(t)))
    for parts in (1, 3):
        n, mean = matching.step(spark.createDataFrame(rows, cols).repartition(parts), 1)
        assert {g: n[g] for g in np.flatnonzero(n)} == visits
        assert all(np.allclose(mean[g], sums[g] / visits[g], atol=1e-5) for g in visits)
    many = spark.range(9000).selectExpr("'torre' words", "if(id < 8999, '', 'castle') class", "cast(null as double) lat", "cast(null as double) lng", "'' street", "'' city")
    n, mean = matching.step(many, (np.arange(1 << matching.BITS), vectors))
    assert n[matching.trigrams("torre")[0]] == 9000 and n[matching.trigrams("castle")[0]] == 1 and mean[matching.trigrams("castle")[0]].any()
    assert np.allclose(matching.fit(many), matching.fit(many.repartition(7)), atol=1e-5)
    assert not matching.step(many.where("false"), 1)[0].any()


class Here:
    """A table whose batches mapInArrow takes here, counting calls of functions."""

    def __init__(self, batches):
        self.batches, self.calls = batches, 0
        self.sparkSession = self.sparkContext = self
        self.defaultParallelism = 1

    def select(self, *names):
        return self

    def coalesce(self, n):
        return self

    def mapInArrow(self, f, schema):
        def count(frame, event, arg):
            self.calls += event in ("call", "c_call")

        sys.setprofile(count)
        try:
            self.batches = list(f(iter(self.batches)))
        finally:
            sys.setprofile(None)
        return self

    def collect(self):
        return [tuple(r.values()) for b in self.batches for r in b.to_pylist()]


def test_a_step_of_walks_takes_no_call_a_token(monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = [(f"{word()} {word()}", "castle", rng.uniform(36, 43), rng.uniform(-9, 3), word(), "lerma") for _ in range(6000)]
    columns = [pa.array(list(c)) for c in zip(*rows)]
    b = pa.RecordBatch.from_arrays(columns, names=["words", "class", "lat", "lng", "street", "city"])
    whole = Here([b])
    visits, mean = matching.step(whole, 1)
    assert visits[matching.trigrams("castle")[0]] >= 6000
    assert whole.calls < 5 * len(rows)
    # Records of several batches, gathered or cut.
    parts = [b.slice(lo, 1300) for lo in range(0, 6000, 1300)]
    for size in (250_000, 40_000):
        monkeypatch.setattr(matching.Walks, "BYTES", size)
        n, other = matching.step(Here([*parts, b.slice(0, 0)]), 1)
        assert (n == visits).all() and np.allclose(mean, other, atol=1e-5)


def test_columns_of_tokens_agree_with_single_ones():
    rng = np.random.default_rng(2)
    tokens = ["a", "torre", "0:-3:12", "d'or", "", "peñón", "日本"]
    for some in (tokens[:5], tokens, []):
        g, n = matching.grams(some)
        assert g.tolist() == [h for t in some for h in matching.trigrams(t)] and n.tolist() == [len(t) for t in some]
    lat, lng = np.r_[rng.uniform(-90, 90, 300), 0.5, 1.5, -0.5, 90, -90], np.r_[rng.uniform(-180, 180, 300), 180, -180, 0, 1, 2]
    assert list(zip(*(c.to_pylist() for c in matching.cell_columns(lat, lng)))) == [tuple(matching.cells(a, b)) for a, b in zip(lat.tolist(), lng.tolist())]
    n = np.array([0, 3, 1, 200, 0, 64, 65])
    x, at, w = rng.normal(size=(50, 4)), rng.integers(50, size=n.sum()), rng.uniform(size=n.sum())
    ends = np.cumsum(n)
    assert np.allclose(matching.run_sums(x, at, n), [x[at[e - k : e]].sum(axis=0) for e, k in zip(ends, n)])
    assert np.allclose(matching.run_sums(x, at, n, w), [(x[at[e - k : e]] * w[e - k : e, None]).sum(axis=0) for e, k in zip(ends, n)])
    nodes = matching.Nodes(matching.random_vectors(1), np.zeros(1 << matching.BITS), 9.0)
    v = nodes.of(["torre vieja", "", "torre"])
    own = [matching.random_vectors(1)[matching.trigrams(t)].sum(axis=0) for t in ("torre", "vieja")]
    both = sum(x / np.sqrt(x @ x) for x in own)
    assert np.allclose(v, [both / np.sqrt(both @ both), 0 * both, own[0] / np.sqrt(own[0] @ own[0])], atol=1e-5)


def test_edits_agree_with_the_whole_table():
    def whole(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(4)
    for _ in range(5000):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(8))) for _ in range(2))
        for most in (1, 2, 3):
            assert matching.edits(a, b, most) == min(whole(a, b), most + 1)


def test_a_point_is_in_the_nearest_city_that_reaches_it():
    rng = random.Random(6)
    places = tuple((f"c{k}", rng.uniform(-90, 90), rng.uniform(-180, 180), rng.choice((None, 5, 80, 900))) for k in range(200))
    # At the date line a city reaches no further.
    places = tuple(p for p in places if abs(p[2]) < 150 and abs(p[1]) < 80)
    centers = matching.Centers(places, addresses.Parser([(p[0], None, None) for p in places]))
    for _ in range(2000):
        _, y, x, _ = rng.choice(places)
        lat, lng = y + rng.uniform(-1, 1), x + rng.uniform(-1, 1)
        near = [(km, c) for c, la, lo, r in places if (km := matching.distance(lat, lng, la, lo)) <= (r or 0)]
        assert centers.of(lat, lng) == min(near, default=(0, ""))[1]


def test_confidence_is_fit_on_all_pairs(spark):
    pairs = spark.range(24_000).selectExpr("id unit", "id kb", "0.5D + (id % 7) / 20D cosine", "0.4D + (id % 11) / 20D name", "1 kind", "-1D km", "0 city", "0 street", "if(id % 11 + id % 5 > 6, 1, -1) wd", "id < 5 same")
    r = pairs.toPandas()
    x = np.column_stack([np.ones(len(r)), r.cosine, r.name, r.kind, np.zeros(len(r)), r.city, r.street])
    w = matching.weights(pairs)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (p - (r.wd == 1)) / len(r) + 1e-3 * w).max() < 1e-5
    got = {a["unit"]: a["confidence"] for a in matching.calibrated(pairs).collect()}
    assert set(got) == set(range(5)) and all(abs(got[k] - p[k]) < 1e-4 for k in got)


# 4: addresses


def test_fold_drops_marks_of_all_scripts():
    rng = random.Random(8)
    for _ in range(3000):
        t = "".join(rng.choices("abC 1Éñüºª°ßİﬁ①x\u0327\u0301日本Σ\t", k=rng.randrange(9)))
        plain = unicodedata.normalize("NFKD", t.lower().replace("º", "o").replace("ª", "a").replace("°", "o"))
        assert addresses.fold(t) == " ".join("".join(c for c in plain if not unicodedata.combining(c)).split())


def test_the_longest_place_of_an_address_counts_then_the_last():
    p = addresses.Parser([("Burgos", None, None), ("Villa Burgos Alta", None, None), ("Lerma", None, None), ("Villa Lerma", None, None)])
    assert [p.parse(f"Calle Sol 3, {x}")[0] for x in ("Villa de Burgos Alta, Villa Lerma", "Villa Lerma, Burgos", "Burgos, Lerma", "Lerma Villa Burgos", "Villa")] == ["villa burgos alta", "villa lerma", "lerma", "burgos", ""]


def parser():
    return addresses.Parser([("San Lucas", "Provincia de Alta", "12345"), ("Villa Real", "Alta", "23456")])


@pytest.mark.parametrize("text", ["C/ del Dr. Ruiz, 7, San Lucas", "CALLE DOCTOR RUIZ Nº7 - 12345 SAN LUCAS (ALTA)", "12345; c. dr ruiz num 7, 2º B", "San Lucas, Cl. de la Doctor Ruiz 7 bajo izq.", "7, calle Dr. Ruiz (San Lcuas), España", "Calle Doctor Ruiz n.o 7, piso 3, local 2; San Lucas"])
def test_one_address_many_ways(text):
    assert parser().parse(text) == ("san lucas", "calle", "doctor ruiz", "7")


def test_addresses_that_differ():
    p = parser().parse
    assert p("C/ Ruiz 7 bis, San Lucas")[3] == "7bis" and p("C/ Ruiz s/n, San Lucas")[3] == "" == p("C/ Ruiz, San Lucas")[3]
    assert p("Plaza Ruiz 7, San Lucas")[1] == "plaza" and p("Ruiz 7, Villa Real")[:2] == ("villa real", "")
    assert all(p(x) is None for x in (None, "", " ", "N/D", "Sin dirección", "-", "San Lucas", "12345"))


def test_same_address_pairs(spark):
    rows = [(1, "C/ Tormenta 4, San Lucas"), (2, "calle tormenta nº 4"), (3, "Tormenta 4 - 12345"), (4, "C/ Tormneta, 4, 12345 San Lucas"), (5, "C/ Tormenta 4 bis, San Lucas"), (6, "C/ Mayor 4, San Lucas"), (7, "C/ Mayor 4, Villa Real"), (8, "C/ Mayor 4"), (9, None), (10, "Consultar"), (11, "Plaza Mayor 4, San Lucas"), (2, "calle tormenta nº 4")]
    gz = spark.createDataFrame([("San Lucas", "Alta", "12345"), ("Villa Real", "Alta", "23456")], "city string, province string, postcode string")
    df = spark.createDataFrame([(*r, "c", "s") for r in rows], "entity_id bigint, address string, city string, street string")
    got = {tuple(r) for r in addresses.same_address(df, gz).distinct().collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert addresses.same_address(df.where("false"), gz).count() == 0


def test_streets_are_mended_within_their_city(spark):
    rows = [("San Lucas", "Moreno", k) for k in range(12)] + [("San Lucas", "Morena", 20 + k) for k in range(10)] + [("Villa Real", "Morena", 3), ("San Lucas", "Moerno", 50), ("", "Morreno", 4)]
    rows += [("Villa Real", s, 1) for s in ("Laurelas", "Laurelas", "Laurelas", "Laurelass", "Laurelass", "Laurelasss")]
    df = spark.createDataFrame([(k, f"Calle {s} {n}{', ' + c if c else ''}") for k, (c, s, n) in enumerate(rows)], "entity_id bigint, address string")
    gz = spark.createDataFrame([("San Lucas", "Alta", "12345"), ("Villa Real", "Alta", "23456")], "city string, province string, postcode string")
    got = collections.Counter((r["city"], r["street"]) for r in addresses.located(df, gz).collect())
    # Two real streets of a city stay apart; a rare one is mended, a chain of errors to its end.
    assert got == {("san lucas", "moreno"): 14, ("san lucas", "morena"): 10, ("villa real", "morena"): 1, ("villa real", "laurelas"): 6}
    many = gz.unionByName(gz)
    assert addresses.gazetteer_rows(many) == (("San Lucas", "Alta", "12345"),) * 2 + (("Villa Real", "Alta", "23456"),) * 2


# 5: boilerplate


def test_tree_matching_is_order_preserving_and_heaviest():
    a = boilerplate.lines_of("Inicio | Contacto\nUna frase muy larga que habla de la villa y de su río.\n© 2020 Villa")
    b = boilerplate.lines_of("© 2020 Villa\nInicio | Contacto\nOtra frase muy larga que habla de la villa y de su monte.\n© 2021 Villa")
    assert [(i, j) for i, j, _ in boilerplate.match(a, b)] == [(0, 1), (2, 3)]


def test_boilerplate(spark, small):
    pages = boilerplate.whole_pages(table(spark, small, "content_blocks"), table(spark, small, "evidence"))
    found = boilerplate.find_boilerplate(pages).collect()
    lines = {(r["table_name"], r["record_id"]): r["text"].split("\n") for r in pages.where("text is not null").collect()}
    out = [lines[r["table_name"], r["record_id"]][r["line_no"]] for r in found]
    assert all(x.strip() for x in out)
    assert not any(re.search(r"€$", x) and x.startswith("- ") for x in out)
    more = pages.unionByName(spark.createDataFrame([("evidence", -1, None, None), ("evidence", -2, "http://x.es", " \n"), *[("evidence", -3 - k, None, "Inicio | Contacto\n") for k in range(3)]], pages.schema))
    assert {r["record_id"] for r in boilerplate.find_boilerplate(more).where("record_id < 0").collect()} == {-3, -4, -5}
    assert boilerplate.find_boilerplate(pages.where("false")).count() == 0


# 6: residue


RESIDUE = ["{{ nombre }} {{ nombre }}", "La plaza de [[ciudad]] es antigua y bella.", "Horario de ${precio} en verano, con visitas guiadas por el centro.", "Error 404. Volver a la portada", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit sed do.", "undefined, undefined (NaN km) - null", "HTTP/1.1 500 Internal Server Error", "%%title%% - Villa", "Texto de relleno: bla bla bla", "Bienvenido a [INSERTAR NOMBRE] en la villa", "XX_nombre_XX visita"]
GOOD = ["La habitación 404 de la posada no se encontró hasta la reforma de 1912, y hoy se visita.", "En el panel se lee [sic] «aqua», con llaves { } pintadas a mano en 1500.", "El precio es de 19 $ o 100% gratis para curiosos.", "Quienes buscan queso acuden a la villa, donde el horno sigue abierto desde 1911.", "Nadie sabe con certeza quién encargó la torre."]


def test_residue(spark):
    prose = [f"La ruta {k} suma kilómetros y pasa por la ermita, el huerto y el barranco, donde el recinto abre en verano y cierra en invierno." for k in range(300)] + GOOD * 20
    rows = [("p", k, t) for k, t in enumerate(prose)] + [("r", k, t) for k, t in enumerate(RESIDUE)] + [("g", k, t) for k, t in enumerate(GOOD)] + [("n", 0, None), ("n", 1, ""), ("n", 2, " \n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "table_name string, record_id bigint, text string, kind string")
    got = {tuple(r) for r in residue.find_residue(df).collect()}
    assert {k for n, k in got if n == "r"} == set(range(len(RESIDUE)))
    assert {n for n, _ in got} == {"r"}
    assert residue.find_residue(df.where("false")).count() == 0


def test_very_long_text(spark):
    df = spark.createDataFrame([("a", 1, "palabra corriente " * 100_000), ("a", 2, "x " * 10 + "{{nombre}}")], "table_name string, record_id bigint, text string")
    assert (2,) in {(r["record_id"],) for r in residue.find_residue(df).collect()}


# 8: tokens


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenize.VOCABULARY)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_tokens_equal_the_library(spark):
    r = random.Random(3)
    alphabet = "ab '\n\t é1.=日\xa0Ñß😀_|<>endoftxt"
    texts = [None, "", " ", "<|endoftext|>", "a" * 3000, " " * 70, "don't  WE'LL\r\n\r\n x", "ab" * 900 + "=" * 200] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {x["doc_id"]: x["ids"] for x in tokenize.encode_documents(df).collect()}
    assert [got[k] for k in range(len(texts))] == reference_ids(texts)
    assert tokenize.encode_documents(df.where("false")).count() == 0


def test_tokens_round_trip(spark, small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenize.VOCABULARY)
    docs = table(spark, small, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in tokenize.encode_documents(docs).collect():
        assert t.decode(r["ids"]) == (text[r["doc_id"]] or "")


# 9: leaks


def words(t):
    t = "".join(c for c in unicodedata.normalize("NFD", (t or "").casefold()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))


def test_leaks_equal_brute_force(spark, monkeypatch):
    r = random.Random(5)
    bag = ["el", "la", "a", "niño", "Ángel", "casa", "1492", "río", "y", "de", "torre", "o"]
    items = [(k, " ".join(r.choice(bag) for _ in range(r.choice([5, 12, 13, 40])))) for k in range(40)] + [(100, None), (101, "")]
    docs = [(0, None), (1, ""), (2, "x")]
    for k in range(3, 300):
        _, t = items[r.randrange(40)]
        w = t.split()
        a = r.randrange(len(w))
        part = w[a : a + r.choice([11, 12, 13, 30])]
        part = [r.choice([str.upper, str.lower, lambda x: unicodedata.normalize("NFD", x)])(x) for x in part]
        docs.append((k, " ".join(r.choice(bag) for _ in range(r.randrange(20))) + r.choice([" — ", "\n", ". "]) + r.choice([", ", " ", " "]).join(part) + " " + " ".join(r.choice(bag) for _ in range(r.randrange(5)))))
    grams = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 11):
            grams[tuple(w[k : k + 12])].add(i)
    want = {(d, i) for d, t in docs for w in [words(t)] for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    D, I = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string")
    assert {tuple(x) for x in leaks.find_leaks(D, I).collect()} == want and want
    monkeypatch.setattr(leaks, "ITEM_CHARS", 0)
    assert {tuple(x) for x in leaks.find_leaks(D, I).collect()} == want
    assert leaks.find_leaks(D.where("false"), I).count() == 0 == leaks.find_leaks(D, I.where("false")).count()


def within(window, text):
    """The least edits that make ``window`` a part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(window, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@pytest.mark.parametrize("edits", [1, 2])
def test_leaks_within_edits_equal_brute_force(spark, monkeypatch, edits):
    r = random.Random(edits)
    bag = ["el", "castillo", "de", "la", "villa", "torre", "vieja", "y", "muralla"]
    items = [(k, " ".join(r.choice(bag) for _ in range(r.choice([5, 7])))) for k in range(6)]
    docs = []
    for k in range(60):
        part = list(" ".join(items[r.randrange(6)][1].split()[: r.choice([4, 5, 7])]))
        for _ in range(r.randrange(4)):
            at = r.randrange(len(part))
            part[at : at + r.choice([0, 1, 1])] = r.choice(["", "x", " "])
        docs.append((k, " ".join(r.choice(bag) for _ in range(r.randrange(4))) + " " + "".join(part) + " " + r.choice(bag)))
    windows = {(i, " " + " ".join(w[a : a + 5]) + " ") for i, t in items for w in [t.split()] for a in range(len(w) - 4)}
    want = {(d, i) for d, t in docs for i, w in windows if within(w, leaks.framed(t)) <= edits}
    D, I = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string")
    for chars in (10**6, 0):
        monkeypatch.setattr(leaks, "ITEM_CHARS", chars)
        assert {tuple(x) for x in leaks.find_leaks(D, I, words=5, edits=edits).collect()} == want
    assert 0 < len(want) < 360


# 10: cuts


def test_cuts(spark):
    r = random.Random(6)
    subject = ["La plaza", "El museo", "La ermita", "Un panel", "El camino", "La torre"]
    verb = ["guarda", "recuerda", "muestra", "conserva", "esconde"]
    thing = ["una colección", "la historia", "un tesoro", "el archivo", "la leyenda"]
    end = ["de la comarca", "del antiguo barrio", "de los vecinos", "del monasterio"]
    sentence = lambda: f"{r.choice(subject)} {r.choice(verb)} {r.choice(thing)} {r.choice(end)}."
    whole = [" ".join(sentence() for _ in range(r.randint(2, 5))) for _ in range(400)]
    whole = [t + r.choice(["", "", "\nTel. 000 111 222", " ¡Te esperamos!", " Pasen y vean…", "\nEtiquetas: museo, plaza, comarca"]) for t in whole]
    cut = []
    for t in [" ".join(sentence() for _ in range(4)) for _ in range(60)]:
        k = t.rindex(" ", 0, len(t) - 12)
        inside = next(j for j in range(k + 2, len(t)) if t[j].isalpha() and t[j - 1].isalpha() and t[j + 1].isalpha())
        cut.append(t[:inside] if r.random() < 0.6 else t[:k] + r.choice(["…", "...", " [+]", " (sigue)"]))
    rows = [(k, t, "a") for k, t in enumerate(whole)] + [(1000 + k, t, "b") for k, t in enumerate(cut)] + [(5000, None, "a"), (5001, " \n", None), (5002, "", "a")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id bigint, text string, source string, size int")
    got = {x["doc_id"] for x in cutoff.find_cut(df).collect()}
    assert len(got & set(range(1000, 1060))) >= 54 and len(got & set(range(400))) <= 8 and not got & {5000, 5001, 5002}
    rates = {x["source"]: x["texts"] for x in cutoff.cut_rates(df).collect()}
    assert rates == {"a": 400, "b": 60}
    assert cutoff.find_cut(df.where("false")).count() == 0


def test_common_names_meet_at_their_places(spark, monkeypatch):
    gz = spark.createDataFrame([("Burgos", None, "09001"), ("Lerma", None, "09340")], "city string, province string, postcode string")
    s = f"{{}} bigint, name string, type string, address string, coordinates {COORD}, wikidataId string, entity_key string"
    at = lambda a, b: (a, b, "", 1.0)
    places = [(36.0 + 0.13 * k, -8.0 + 0.17 * k) for k in range(40)]
    left = [(k, "Iglesia de San Juan", "Church", "", at(*p), "", None) for k, p in enumerate(places)] + [(100, "Iglesia San Juan", "", "C/ Mayor 2, Lerma", None, "", None), (101, "Iglesia de San Juan", "", None, None, "", None)]
    right = [(1000 + k, "San Juan, Iglesia", "Church", "", at(p[0] + 0.03, p[1]), "", None) for k, p in enumerate(places)] + [(2000, "Iglesia de San Juan", "", "Calle Mayor, 2 - 09340 Lerma", None, "", None), (2001, "Iglesia de San Juan", "", "", None, "", None)]
    l, r = spark.createDataFrame(left, s.format("entity_id")), spark.createDataFrame(right, s.format("kb_id"))
    monkeypatch.setattr(matching, "HOT", 3)
    got = {(x["entity_id"], x["kb_id"]) for x in matching.match_records(l, r, gz).collect()}
    assert got == {(k, 1000 + k) for k in range(40)} | {(100, 2000)}


def test_common_names_and_crowded_cells_lose_no_pair(spark, monkeypatch):
    gz = spark.createDataFrame([("Burgos", None, "09001"), ("Lerma", None, "09340")], "city string, province string, postcode string")
    s = f"{{}} bigint, name string, type string, address string, coordinates {COORD}, wikidataId string, entity_key string"
    at = lambda a, b: (a, b, "", 1.0)
    places = [(36.0 + 0.13 * k, -8.0 + 0.17 * k) for k in range(30)]
    left = [(k, "Ermita de Valdezarcón", "Chapel", "", at(*p), "", None) for k, p in enumerate(places)] + [(100, "Ermita de Valdezarcón", "", "C/ Mayor 2, Lerma", None, "", None), (101, "Ermita de Valdezarcón", "", None, None, "", None)]
    # Misspelt names: 4 km away, of the same city without coordinates, of no place.
    right = [(1000 + k, "Ermita Valdezarcno", "Chapel", "", at(p[0] + 0.036, p[1]), "", "") for k, p in enumerate(places)] + [(2000, "Ermita de Valdezracón", "", "Plaza del Sol 9, Lerma", None, "", ""), (2002, "Ermita de Valdezracón", "", "Lerma, C/ Mayro 2", None, "", ""), (2001, "Ermita de Valdezarcno", "", "", None, "", "")]
    # A crowded cell with pairs of names that are only alike.
    words = [f"{a}{b}{c}" for a in ("torm", "quind", "zurb") for b in ("abel", "oril", "ufen") for c in ("dar", "mis", "pon")]
    left += [(300 + k, f"Hotel {w}", "Hotel", "", at(42.0, -3.7), "", None) for k, w in enumerate(words)]
    right += [(3000 + k, f"Hotel {w[:4]}{w[5]}{w[4]}{w[6:]} Sur", "Hotel", "", at(42.0, -3.7), "", "") for k, w in enumerate(words)]
    l, r = spark.createDataFrame(left, s.format("entity_id")), spark.createDataFrame(right, s.format("kb_id"))
    got = {}
    for hot in (3, 10**9):
        monkeypatch.setattr(matching, "HOT", hot)
        got[hot] = {(x["entity_id"], x["kb_id"]) for x in matching.match_records(l, r, gz).collect()}
    assert got[3] == got[10**9]
    assert {(k, 1000 + k) for k in range(30)} | {(100, 2002)} <= got[3] and not any(b == 2001 for _, b in got[3])


def test_near_points_share_a_cell():
    r = random.Random(8)
    for k in range(20_000):
        lat, lng = (r.uniform(-89.9, 89.9), r.choice([r.uniform(-180, 180), 179.999, -179.999])) if k % 2 else (40.5 + r.uniform(-0.02, 0.02), r.uniform(-9, 4))
        d = r.uniform(0, 0.0449)
        a = r.uniform(0, 6.3)
        o = (lat + d * math.sin(a), (lng + d * math.cos(a) / math.cos(math.radians(lat)) + 180) % 360 - 180)
        if abs(o[0]) < 90 and matching.distance(lat, lng, *o) <= matching.NEAR_KM:
            assert matching.nearby(lat, lng, False) & matching.nearby(*o, True)


def test_alike_names_share_a_table_at_every_size():
    rng = np.random.default_rng(1)
    for bits in (8, 15, 18, 22):
        a, b = rng.normal(size=(2, 600, matching.DIM))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = 0.9 * a + math.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
        planes = rng.normal(size=(matching.DIM, matching.name_tables(bits) * bits))
        same = ((a @ planes > 0) == (b @ planes > 0)).reshape(600, -1, bits).all(axis=2).any(axis=1)
        assert same.mean() > 0.85
    assert all(matching.name_tables(b) >= matching.TABLES for b in range(8, 30))


def site_pages(n=60):
    """Pages of two sites: (record_id, lines, which lines are no main body)."""
    r = random.Random(4)
    name = lambda: "".join(r.choice(["ba", "lo", "mir", "tu", "ver", "za"]) for _ in range(3)).capitalize()
    frames = (
        lambda: f"Desde la torre se divisa la sierra de {name()} y los tejados de {name()}.", lambda: f"La leyenda de {name()} cuenta que el molino ardió una noche de {name()}.",
        lambda: f"Los vecinos de {name()} guardan en el horno un traje bordado por {name()}.", lambda: f"El abono incluye la visita de {name()} y un paseo por {name()} al atardecer.",
    )
    out = []
    for k in range(n):
        site = "abcd"[k % 2]
        mine = r.sample(frames, 4)
        lines = [("Inicio | Rutas | Contacto | Agenda", True), (f"Este portal lo mantiene la oficina de turismo de la villa {site} y de su comarca.", True), (f"Usamos cookies para medir {name()} en la red. Consulta siempre la política de la casa {site}.", True), (f"{mine[0]()} {mine[1]()}", False), (mine[2](), False), (f"{mine[3]()} {frames[k % 4]()}", False), (f"- Entrada de {name()}: 7 €", False)]
        if k % 3 == 0:
            lines.append((f"Una casa única de {name()} acogió {name()} durante {k} inviernos que ya nadie recuerda ni en {name()}.", False))
        out.append((k, site, lines))
    return out


def test_wrapper_induction_decides(spark, monkeypatch):
    pages = site_pages()
    rows = [("p", k, f"http://{s}.es/{k}", "\n".join(x for x, _ in ls)) for k, s, ls in pages]
    df = spark.createDataFrame(rows, "table_name string, record_id bigint, url string, text string")
    found = {(r["record_id"], r["line_no"]) for r in boilerplate.find_boilerplate(df).collect()}
    want = {(k, i) for k, _, ls in pages for i, (_, outside) in enumerate(ls) if outside}
    assert found == want
    assert found == {(r["record_id"], r["line_no"]) for r in boilerplate.find_boilerplate(df.repartition(3)).collect()}
    # A page that was loaded often is no evidence for a template.
    once = [("q", k, "http://x.es/", rows[0][3].replace("Inicio", "Portada")) for k in range(20)]
    assert boilerplate.find_boilerplate(spark.createDataFrame(once, df.schema)).count() == 0


def test_nothing_is_wrapper_without_matches():
    from mirador.llm.boilerplate import _COUNTS

    assert boilerplate.match([], []) == [] and "matched" in _COUNTS
    long = boilerplate.lines_of("\n".join(f"Frase número {k} de la página larga que se repite." for k in range(2000)))
    assert len(boilerplate.match(long, long)) == 2000


def test_partners_that_are_no_neighbours_count(spark, monkeypatch):
    rows = [("p", k, f"http://{s}.es/{k}", "\n".join(x for x, _ in ls)) for k, s, ls in site_pages(120)]
    # Three pages in sixty of a host have a notice; one that is there three times over has another.
    for k in (1, 41, 81):
        rows[k] = (*rows[k][:3], rows[k][3] + "\nPueden pedir la hoja mensual de la comarca en cualquier oficina del valle.")
    rows += [("q", k, "http://b.es/x", rows[3][3] + "\nQuien quiera copias del plano puede pedirlas en la tienda de la villa.") for k in range(3)]
    df = spark.createDataFrame(rows, "table_name string, record_id bigint, url string, text string")
    found = {}
    for n in (1, 8, 200):
        monkeypatch.setattr(boilerplate, "NEIGHBOURS", n)
        found[n] = {tuple(r) for r in boilerplate.find_boilerplate(df).collect()}
    assert found[1] == found[8] == found[200]
    last = {(r[0], r[1]): r[3].count("\n") for r in rows}
    assert all(("p", k, last["p", k]) in found[1] for k in (1, 41, 81)) and not any(("q", k, last["q", k]) in found[1] for k in range(3))
