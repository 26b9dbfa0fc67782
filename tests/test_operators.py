import inspect
import json

from pyspark.sql import functions as F

from mirador import dims
from mirador.operators import classify as C, enrich as E, export as X, graph as G, match as M, merge as R, report as A
from mirador.sources.tables import checked_broadcast, cut, table

COORD = "struct<lat:double,lng:double,source:string,confidence:double>"


def test_wikidata_and_map_types(spark):
    classes = spark.createDataFrame([(1, 0, "Q999"), (1, 1, "Q2977"), (2, 0, "Q2298524x"), (3, 0, "Q0")], "entity_id bigint, pos int, qid string")
    parents = spark.createDataFrame([("Q2298524x", "Q44613")], "qid string, parent string")
    assert {tuple(r) for r in C.by_wikidata(classes, parents).collect()} == {(1, "Cathedral", "Q2977"), (2, "Monastery", "Q44613")}
    places = spark.createDataFrame([(1, 0, "tourism", "x"), (1, 1, "tourism", "museum")], "entity_id bigint, pos int, category string, kind string")
    assert [tuple(r) for r in C.by_osm(places).collect()] == [(1, "Museum", "tourism/museum")]
    e = spark.createDataFrame([(1, "Cosa", ["Event"]), (2, "Ruta del vino", []), (3, "Nada", None)], "entity_id bigint, name string, types array<string>")
    v = spark.createDataFrame([(3, "wikipedia", "Nada", "una iglesia")], "entity_id bigint, source_type string, title string, text string")
    got = {r["entity_id"]: (r["type"], r["types"], r["confidence"]) for r in C.classify(e, v, wikidata=spark.createDataFrame([(1, "Cathedral")], "entity_id bigint, type string")).collect()}
    assert got == {1: ("Cathedral", ["Cathedral", "Event"], 120), 2: ("Route", ["Route"], 110), 3: ("Church", ["Church"], 35)}


def test_image_levels(spark):
    e = spark.createDataFrame([(1, "Catedral de Burgos", "p"), (2, "Arco", "p"), (3, "Museo Alto", "q")], "entity_id bigint, name string, sourceUrl string")
    i = spark.createDataFrame([("p", "https://a/catedral-de-burgos.jpg", "", "", 1), ("p", "https://a/foto2.jpg", "", "el arco de piedra", 2), ("p", "https://a/logo.png", "", "arco", 0), ("q", "https://a/foto9.jpg", "", "", 5), ("q", "https://a/foto8.jpg", "", "", 4)], "page string, image string, alt string, context string, idx int")
    got = {(r["entity_id"], r["image"]): (r["level"], r["rank"]) for r in M.image_matches(e, i).collect()}
    assert got == {(1, "https://a/catedral-de-burgos.jpg"): (1, 1), (2, "https://a/foto2.jpg"): (2, 1), (3, "https://a/foto8.jpg"): (3, 1), (3, "https://a/foto9.jpg"): (3, 2)}
    assert M.vision_pairs(M.image_matches(e, i), per_entity=1).count() == 3


def test_lookups(spark):
    e = spark.createDataFrame([(1, "A", "Q1", "https://a/b-c", (42.0, -3.0, "", 1.0), [], ["Museum"]), (2, "B", "", "https://a/", (None, None, "", None), ["x"], None)], f"entity_id bigint, name string, wikidataId string, sourceUrl string, coordinates {COORD}, images array<string>, types array<string>")
    files = spark.createDataFrame([("near", 42.001, -3.0), ("far", 42.1, -3.0)], "url string, lat double, lng double")
    assert [r["url"] for r in E.geosearch_images(e, files).collect()] == ["near"]
    pics = spark.createDataFrame([("Q1", ["w1", "w2"])], "wikidataId string, images array<string>")
    assert {r["entity_id"]: r["images"] for r in E.with_wikidata_images(e, pics).collect()} == {1: ["w1", "w2"], 2: ["x"]}
    s = spark.createDataFrame([("A", 0, "Q5"), ("b c", 0, "Q6"), ("A", 1, "Q5"), ("A Burgos", 0, "Q7")], "query string, pos int, qid string")
    assert {r["entity_id"]: r["qids"] for r in E.candidate_ids(e, s, city="Burgos").collect()} == {1: ["Q5", "Q6", "Q7"]}
    pages = spark.createDataFrame([(1, "https://turismoburgos.es", "x", None), (2, "https://x.es", None, None)], "page_id bigint, url string, title string, description string")
    assert {r["page_id"]: r["city"] for r in E.city_of(pages, dims.cities(spark)).collect()} == {1: "Burgos", 2: ""}
    status = spark.createDataFrame([("a", False, ""), ("b", True, "c")], "url string, ok boolean, resolved string")
    img = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d")], "entity_id bigint, pos int, image string")
    assert sorted(r["image"] for r in X.alive(img, status).collect()) == ["c", "d"]


def test_enriched(spark):
    schema = f"key string, name string, shortDescription string, longDescription string, sourceText string, description string, images array<string>, types array<string>, coordinates {COORD}, address string, phone string, email string, wikidataId string, score double"
    b = spark.createDataFrame([("k", "A", "uno", "", None, "", ["i"], ["Museum", "Nope"], (1.0, 1.0, "", 0.2), "", "1", None, "", 0.4)], schema)
    n = spark.createDataFrame([("k", "A2", "dos", "l", "s", "", ["i", "j"], ["Church"], (2.0, 2.0, "", 0.9), "C/ 1", "2", "e", "Q1", 0.9)], schema)
    r = R.enriched(b, n).first()
    assert (r["name"], r["shortDescription"], r["images"], r["types"], r["coordinates"]["lat"], r["address"], r["phone"], r["wikidataId"], r["score"]) == ("A", "uno dos", ["i", "j"], ["Museum", "Church"], 2.0, "C/ 1", "1", "Q1", 0.9)
    assert R.enriched(b, n.where("false")).first()["shortDescription"] == "uno"


def test_graph_payload_and_cards(spark, small):
    e = table(spark, small, "entities").where("name is not null")
    schema = spark.createDataFrame([("Museum", "createMuseum", ["name", "hasFoo"]), ("TourismEntity", "createTourismEntity", [])], "class string, mutation string, required array<string>")
    p = X.graph_payloads(e, schema)
    assert p.count() == e.where("name <> ''").count()
    o = json.loads(p.first()["object"])
    assert o["name"][0]["lang"] == "es" and "externalId" in o
    assert all("missing required MuseumInput.hasFoo" in r["warnings"] for r in p.where("className = 'Museum'").collect())
    assert "input: $input" in spark.range(1).select(X.mutation_text(F.lit("createMuseum"), F.lit("Museum"))).first()[0]
    assert X.envelope(p).first()["count"] == p.count()
    card = A.markdown_cards(e).first()["card"]
    assert card.startswith("### ") and "**Tipo:**" in card


def test_links_and_order(spark):
    pages = spark.createDataFrame([("https://a.es/", "<a href='/b'>b</a><a href='c?x=1#z'>c</a><a href=\"mailto:x@y\">m</a><a href='https://z.es/'>z</a><a href='/d.pdf'>d</a><a href='#t'>t</a><a href='/b'>again</a>"), ("https://a.es/b", None)], "url string, html string")
    assert sorted(r["link"] for r in G.page_links(pages).collect()) == ["https://a.es/b", "https://a.es/c"]
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "page string, link string")
    s = spark.createDataFrame([("a",)], "url string")
    assert {tuple(r) for r in G.crawl_order(e, s).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 2)}
    assert {r["url"] for r in G.crawl_order(e, s, done=spark.createDataFrame([("b",)], "url string")).collect()} == {"a"}


def test_traversals_have_no_bound(spark):
    names = [f"c{k}" for k in range(36)]
    o = spark.createDataFrame([*zip(names[1:], names), ("c0", "c35")], "name string, parent string")
    assert {tuple(r) for r in G.subtrees(o, roots=("c0",)).collect()} == {("c0", n, k) for k, n in enumerate(names)}
    # A chain of more levels than its old bound of 1000 takes minutes.
    assert "most_rounds" not in inspect.signature(G.crawl_order).parameters


def test_broadcast_is_checked(spark):
    small = cut(spark.range(10))
    assert "Broadcast" in spark.range(1000).join(checked_broadcast(small, 10), "id")._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "Broadcast" not in spark.range(1000).join(checked_broadcast(small, 9), "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_core_does_not_need_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(__file__).parents[1] / "mirador"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s+.*\bllm\b", f.read_text(), re.M), f


def test_a_crawl_ends_at_its_number_of_pages(spark):
    edges = spark.createDataFrame([("h", f"p{k}") for k in range(4)] + [("p0", "q"), ("q", "r")], "page string, link string")
    seeds = spark.createDataFrame([("h",)], "url string")
    got = lambda **k: sorted(r["url"] for r in G.crawl_order(edges, seeds, **k).collect())
    assert len(got()) == 7 and got(most_pages=2) == ["h", "p0"] and got(most_pages=6) == ["h", "p0", "p1", "p2", "p3", "q"]
    assert got(most_pages=0) == [] and got(most_pages=3, done=spark.createDataFrame([("p0",), ("x",)], "url string")) == ["h"]


def test_prompts_hold_the_page_and_its_limits(spark):
    image = "struct<url:string,alt:string,source:string,index:string,context:string>"
    pages = spark.createDataFrame([(1, "u", "T", None, "es", [("i", None, "", "0", "c")] * 30), (2, None, None, None, None, None)], f"page_id bigint, url string, title string, description string, language string, images array<{image}>")
    blocks = spark.createDataFrame([(k, 1, f"b{k}", "page" if k == 9 else "article", "" if k == 3 else f"t{k}", "x" * 12_000, 20 - k, None) for k in range(20)], f"block_uid bigint, page_id bigint, block_id string, kind string, title string, text string, position int, images array<{image}>")
    data = spark.createDataFrame([(1, k, "{}") for k in range(9)], "page_id bigint, pos int, item string")
    got = {r["page_id"]: json.loads(r["prompt"]) for r in X.prompts(pages, blocks, data).collect()}
    assert all(got[1][k] for k in ("task", "identity_contract", "procedure", "tourist_types", "schema", "rules"))
    p = got[1]["page"]
    assert (len(p["images"]), len(p["text"]), len(p["blocks"]), len(p["structured_data"])) == (25, 10_000, 15, 8)
    assert p["blocks"][0]["id"] == "b19" and len(p["blocks"][0]["text"]) == 400 and not any(b["id"] in ("b3", "b9") for b in p["blocks"])
    assert got[2]["page"] == {"url": "", "title": "", "description": "", "language": "", "images": [], "text": "", "blocks": [], "structured_data": []} or got[2]["page"]["title"] == ""


def test_a_cluster_must_name_its_checkpoint_folder():
    from mirador.sources.tables import is_local

    assert is_local("local") and is_local("local[8]") and not is_local("local-cluster[2,1,512]") and not is_local("spark://h:7077") and not is_local("yarn")
