import json

from mirador.__main__ import main
from mirador.operators import consolidate as N, enrich as E, export as X
from mirador.plans import pipeline

HTML = """<html lang="es"><head><title>Museo de la Villa - Turismo</title><meta name="description" content="Un museo con salas de arte y de historia de la villa y su comarca"></head><body>
<section><h2>Catedral de Santa Lucía</h2><p>La catedral de Santa Lucía se levanta en el centro de la villa y conserva un retablo muy antiguo.</p><img src="/catedral-de-santa-lucia.jpg"></section>
<section><h2>Inicio</h2><p>Esta es una parte de navegación del sitio que no habla de ninguna cosa en concreto.</p></section></body></html>"""


def test_pages_to_entities(spark, tmp_path):
    pages = spark.createDataFrame([("https://a.es/p", HTML), ("https://a.es/q", HTML.replace("Santa Lucía", "Santa Lucia")), ("https://a.es/bad", None)], "url string, html string")
    good, resolved = pipeline.crawl(pages, pipeline.empty_kb(spark), "2026-01-01")
    rows = {(r["page"], r["name"]): r for r in good.collect()}
    assert ("https://a.es/p", "Catedral de Santa Lucía") in rows and ("https://a.es/p", "Museo de la Villa") in rows
    r = rows["https://a.es/p", "Catedral de Santa Lucía"]
    assert r["type"] == "Cathedral" and r["images"] == ["https://a.es/catedral-de-santa-lucia.jpg"]
    t = {x["id"]: x["tier"] for x in resolved.collect()}
    assert sorted(t.values()) == ["added", "added", "exact_key", "exact_key"]
    pages.write.parquet(str(tmp_path / "pages"))
    main(["crawl", str(tmp_path / "pages"), str(tmp_path / "out"), "--as-of", "2026-01-01"])
    assert spark.read.parquet(str(tmp_path / "out" / "entities")).count() == len(rows)


def test_consolidated(spark):
    e = spark.createDataFrame([(1, "Arco", ["u"], [], "uno", "", None), (2, "B", None, None, None, "x", "y")], "entity_id bigint, name string, relatedUrls array<string>, images array<string>, longDescription string, address string, phone string")
    s = "evidence_id bigint, entity_id bigint, source_type string, url string, text string, images array<string>, metadata struct<address:string,phone:string>"
    v = spark.createDataFrame([(1, 1, "wikipedia", "w", "dos", ["https://a/arco.jpg", "https://a/z.jpg", "https://upload.wikimedia.org/q.jpg"], ("", "9")), (2, 1, "page_block", "p", "tres", ["https://a/arco2.jpg"], ("C/ 1", "8")), (3, 1, "wikidata", "w", "dos", None, None)], s)
    r = {x["entity_id"]: x for x in N.consolidated(e, v).collect()}
    assert (r[1]["relatedUrls"], r[1]["images"], r[1]["longDescription"], r[1]["address"], r[1]["phone"]) == (["u", "w"], ["https://a/arco.jpg", "https://upload.wikimedia.org/q.jpg"], "uno dos", "C/ 1", "9")
    assert (r[2]["longDescription"], r[2]["address"]) == ("", "x")
    p = spark.createDataFrame([("Q1", ""), (None, "Q2"), ("", None)], "a_wd string, b_wd string")
    assert [tuple(x) for x in N.propagated(p).collect()] == [("Q1", "Q1"), ("Q2", "Q2"), ("", "")]


def test_vision_tables(spark):
    e = spark.createDataFrame([(1, "Arco de Santa María", "p"), (2, "Museo", "p")], "entity_id bigint, name string, sourceUrl string")
    l = spark.createDataFrame([("p", "i1", " museo "), ("p", "i2", "Arco"), ("p", "i3", "none"), ("p", "i4", "otra cosa")], "page string, image string, label string")
    assert {tuple(x) for x in N.seen_images(l, e).collect()} == {(2, "i1", "name"), (1, "i2", "part")}
    j = spark.createDataFrame([(1, "a", True), (1, "b", False), (1, "c", None)], "entity_id bigint, image string, related boolean")
    assert [tuple(x) for x in N.accepted_images(j).collect()] == [(1, ["a"], ["b", "c"])]


def test_wikidata_and_lookups(spark):
    doc = {"labels": {"es": {"value": "Museo A"}}, "claims": {"P31": [{"mainsnak": {"datavalue": {"value": {"id": "Q33506"}}}}], "P279": [], "P18": [{"mainsnak": {"datavalue": {"value": "f.jpg"}}}]}}
    w = E.wikidata_facts(spark.createDataFrame([("Q1", json.dumps(doc)), ("Q2", "{bad"), ("Q3", None)], "qid string, doc string"))
    r = {x["qid"]: x for x in w.collect()}
    assert (r["Q1"]["p31"], r["Q1"]["label"], r["Q1"]["image"], r["Q2"]["p31"]) == (["Q33506"], "Museo A", "f.jpg", [])
    n = spark.createDataFrame([(1, "La Catedral", "Q1"), (2, "Arco", "Q1"), (3, "Arco", "Q9")], "entity_id bigint, name string, qid string")
    assert {x["entity_id"] for x in E.label_matches(n, spark.createDataFrame([("Q1", "Catedral de Burgos")], "qid string, label string")).collect()} == {1, 3}
    e = spark.createDataFrame([(1, "", (42.123456, -3.0)), (2, "x", (42.123456, -3.0)), (3, None, (None, None))], "entity_id bigint, address string, coordinates struct<lat:double,lng:double>")
    l = spark.createDataFrame([(42.1234561, -3.0, "C/ 1")], "lat double, lng double, address string")
    assert {x["entity_id"]: x["address"] for x in E.reverse_geocoded(e, l).collect()} == {1: "C/ 1", 2: "x", 3: ""}
    q = spark.createDataFrame([(1, 0, "a", "Burgos"), (1, 1, "b", "Burgos")], "entity_id bigint, pos int, query string, city string")
    g = spark.createDataFrame([("a", 0, 10.0, 10.0, 0.9), ("a", 1, 42.35, -3.7, 0.01), ("b", 0, 42.34, -3.7, None)], "query string, rank int, lat double, lng double, importance double")
    from mirador import dims

    assert [tuple(x) for x in E.first_lookup(q, g, dims.cities(spark)).collect()] == [(1, 42.34, -3.7)]


def test_upload_check(spark):
    items = spark.createDataFrame([(0, json.dumps({"query": "q", "variables": {"a": [{"uri": 1, "object": {"relatedTo": [1], "externalId": 2, "b": 3}}]}})), (1, "{}"), (2, "bad"), (3, None)], "pos int, item string")
    r = {x["pos"]: x for x in X.checked_items(items, dti="D", inline=True, drop="relatedTo").collect()}
    assert json.loads(r[0]["item"])["variables"] == {"a": [{"object": {"externalId": 2, "b": 3}}], "dti": "D"}
    assert [r[k]["valid"] for k in range(4)] == [True, False, False, False]
