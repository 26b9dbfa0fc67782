"""Resolution in rounds gives what deciding one row after the other gives."""

import random

from pyspark.sql import functions as F

from mirador.operators import resolve as V

SCHEMA = "id bigint, name string, wikidataId string, coordinates struct<lat:double,lng:double>, address string, types array<string>"
WORDS = ["catedral", "santa", "maria", "burgos", "camino", "santiago", "museo", "real"]


def rows(r, start, n):
    out = []
    for k in range(n):
        name = " ".join(r.sample(WORDS, r.choice([1, 2, 2, 3, 3])))
        if r.random() < 0.3:
            name = "La " + name
        wd = f"Q{r.randint(1, 6)}" if r.random() < 0.25 else ""
        at = (42.0 + r.choice([0, 0.0005, 0.1]), -3.7) if r.random() < 0.8 else (None, None)
        out.append((start + k, name, wd, at, r.choice(["", "Calle Mayor 1", "calle mayor, 1"]), [r.choice(["Museum", "Church"])]))
    return out


def fold(spark, kb, new, threshold):
    both = V.features(spark.createDataFrame(kb + new, SCHEMA), "id").collect()
    f = {x["id"]: x for x in both}
    scores = {(x["a"], x["b"]): x["score"] for x in spark.createDataFrame([], "a bigint, b bigint, score double").collect()}
    left = V.features(spark.createDataFrame(new, SCHEMA), "id")
    for x in left.alias("a").crossJoin(V.features(spark.createDataFrame(kb + new, SCHEMA), "id").alias("b")).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), V.pair_score().alias("s")).collect():
        scores[x["x"], x["y"]] = x["s"]
    base = [x[0] for x in kb]
    keys, names = {}, {}
    for i in base:
        keys.setdefault(f[i]["key"], i)
        names.setdefault(f[i]["nk"], i)
    out, added = {}, []
    for row in new:
        i = row[0]
        x = f[i]
        if x["key"] in keys:
            out[i] = keys[x["key"]]
            continue
        if x["wd"] and x["nk"] in names and x["nk"]:
            out[i] = names[x["nk"]]
            continue
        best = None
        for rank, c in enumerate(base + added):
            s = scores[i, c]
            if s >= threshold and (best is None or s > best[0]):
                best = (s, c)
        if best:
            out[i] = best[1]
            # a later row of the same key joins this one
        else:
            out[i] = i
            added.append(i)
            keys.setdefault(x["key"], i)
    return out


def test_rounds_equal_the_sequence(spark):
    for seed in range(3):
        r = random.Random(seed)
        kb, new = rows(r, 1, 12), rows(r, 100, 40)
        # Rows of one key follow the first of them; here each key comes once.
        seen, single = set(), []
        for x in new:
            k = x[2] or x[1].removeprefix("La ")
            if k not in seen:
                seen.add(k)
                single.append(x)
        want = fold(spark, kb, single, 0.75)
        got = V.resolve(spark.createDataFrame(kb, SCHEMA), spark.createDataFrame(single, SCHEMA), "id", "id").collect()
        assert {x["id"]: x["base"] for x in got} == want


def test_every_row_is_decided_once_and_empty_sides_work(spark):
    new = spark.createDataFrame(rows(random.Random(9), 1, 30), SCHEMA)
    empty = spark.createDataFrame([], SCHEMA)
    out = V.resolve(empty, new, "id", "id")
    assert out.count() == out.select("id").distinct().count() == 30
    assert V.resolve(new, empty, "id", "id").count() == 0


def test_pair_score_rules(spark):
    def score(a, b):
        mk = lambda x: V.features(spark.createDataFrame([x], SCHEMA), "id")
        return mk(a).alias("a").crossJoin(mk(b).alias("b")).select(V.pair_score()).first()[0]

    near, far = (42.34, -3.7), (40.0, -3.7)
    e = lambda name, wd="", at=(None, None), types=("Museum",): (1, name, wd, at, "", list(types))
    assert score(e("A", "Q123"), e("B", "Q123")) == 1.0
    assert score(e("Catedral", "Q1"), e("Catedral", "Q2")) == 0.0
    assert score(e("Catedral de Burgos", at=near), e("La Catedral", at=near)) == 0.0
    assert score(e("Camino de Santiago", at=near), e("Camino de Santiago (por Burgos)", at=near)) == 0.95
    assert score(e("Camino de Santiago", at=near), e("Camino de Santiago", at=far)) == 0.0
