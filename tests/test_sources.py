import json

from pyspark.sql import functions as F

from mirador.operators import html as H
from mirador.sources import fetch, formats as R
from mirador.streaming import ingest

PAGE = """<html lang="es"><head><title>Arco</title><meta name="description" content=" Un  arco "><meta name="geo.position" content="42.3;-3.7">
<script type="application/ld+json">{"@graph":[{"@type":"Museum","name":"Museo A","address":{"streetAddress":"C/ B 1","addressLocality":"Burgos"},"geo":{"latitude":"42.1","longitude":"-3.5"}}],"@type":"WebSite","name":"x"}</script>
<script type="application/ld+json">{bad</script><style>p{}</style></head><body><nav><a href="/x">x</a></nav>
<section class="card"><h2>Arco de Santa María</h2><p>El arco es una de las antiguas puertas de acceso a la ciudad, muy visitada.</p><img src="/fotos/arco.jpg" alt="Arco"><img src="/logo.svg"><img src="/mini.png" width="20" height="20"></section>
<iframe src="https://maps.google.com/maps?q=42.30,-3.71"></iframe><p>Fin<br>de página"""


def test_page(spark):
    p = H.parse(spark.createDataFrame([("https://a.es/p/", PAGE), ("https://a.es/q", None), ("https://a.es/r", " ")], "url string, html string")).cache()
    a = p.where("url = 'https://a.es/p/'").first()
    assert (a["title"], a["description"], a["language"], a["status"]) == ("Arco", "Un arco", "es", "ok")
    assert "{" not in a["raw_text"] and a["raw_text"].endswith("Fin de página")
    assert p.where("status = 'error'").count() == 2
    assert [r["image"] for r in H.page_images(p).collect()] == ["https://a.es/fotos/arco.jpg"]
    b = H.page_blocks(p).collect()
    assert len(b) == 1 and b[0]["title"] == "Arco de Santa María" and b[0]["block_id"] == "block-1" and b[0]["kind"] == "section"
    e = H.structured_entities(H.structured_data(p)).collect()
    assert [(x["name"], x["type"], x["address"], x["lat"]) for x in e] == [("Museo A", "Museum", "C/ B 1, Burgos", 42.1)]
    assert {(x["lat"], x["source"]) for x in H.geo_candidates(p).collect()} == {(42.1, "json-ld"), (42.3, "meta"), (42.30, "google-maps-iframe")}


def test_block_and_title_entities(spark):
    b = spark.createDataFrame([(1, "Inicio", "02 de abril de 2026 Centro de Arte Moderno En el centro"), (2, "Catedral | Web", "texto"), (3, "", "")], "block_uid bigint, title string, text string")
    assert {r["block_uid"]: r["name"] for r in H.block_names(b).collect()} == {1: "Centro de Arte Moderno", 2: "Web"}
    p = spark.createDataFrame([(1, "https://a.es/x", "Museo de la Evolución - Turismo"), (2, "https://a.es/y", "Quiénes somos"), (3, "https://a.es/z", None)], "page_id bigint, url string, title string")
    assert [(r["page_id"], r["name"], r["type"]) for r in H.title_entities(p, F.lit("2026-01-01").cast("date")).collect()] == [(1, "Museo de la Evolución", "Museum")]


RSS = """<rss><channel><title>F</title><item><title>Uno</title><link>https://a.es/1</link><pubDate>Mon, 05 Jan 2026 10:00:00 +0000</pubDate><description><![CDATA[<p>Hola <b>mundo</b></p>]]></description></item>
<item><link>https://a.es/2</link></item><item><title>Tres</title><link>https://a.es/3</link><pubDate>Wed, 01 Jan 2020 10:00:00 GMT</pubDate></item></channel></rss>"""


def test_feeds(spark, tmp_path):
    f = spark.createDataFrame([("f", RSS), ("g", "<bad"), ("h", None)], "source string, xml string")
    a = [tuple(r) for r in R.articles(f).orderBy("pos").collect()]
    assert a == [("f", 0, "Uno", "2026-01-05", "https://a.es/1", "Hola mundo"), ("f", 1, "(sin título)", "", "https://a.es/2", ""), ("f", 2, "Tres", "2020-01-01", "https://a.es/3", "")]
    assert [r["title"] for r in R.articles(f, since="2025-01-01").collect()] == ["Uno", "(sin título)"]
    assert R.articles(f, limit=1).count() == 1
    assert R.article_pages(R.articles(f)).where("description = 'Fuente: f'").count() == 2
    atom = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:m="http://m/"><title>F</title><entry><m:title>no</m:title><title>A &amp; B &lt;c&gt;</title><link rel="self" href="https://a.es/self"/><link href="https://a.es/a?x=1&amp;y=2"/><updated>2026-02-03T10:00:00Z</updated></entry></feed>'
    broken = "<rss><channel><item><title>Caf&eacute; <![CDATA[<b>]]></title><link>https://a.es/z</link><item><title>Otro</title>"
    g = spark.createDataFrame([("a", atom), ("b", broken), ("c", '<!DOCTYPE x [<!ENTITY e "boom">]><rss><item><title>&e;</title></item></rss>')], "source string, xml string")
    assert [(r["source"], r["title"], r["published"], r["url"]) for r in R.articles(g).orderBy("source", "pos").collect()] == [("a", "A & B <c>", "2026-02-03", "https://a.es/a?x=1&y=2"), ("b", "Café <b>", "", "https://a.es/z"), ("b", "Otro", "", "")]
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.xml").write_text(RSS)
    stream = ingest.feed_drops(spark, str(drop)).select(F.col("title").alias("name"), F.lit("").alias("wikidataId"), "url")
    kb, check = str(tmp_path / "kb"), str(tmp_path / "check")
    ingest.upsert_stream(stream, kb, check).awaitTermination()
    assert spark.read.parquet(kb).count() == 3
    (drop / "b.xml").write_text(RSS.replace("Uno", "Cuatro"))
    ingest.upsert_stream(ingest.feed_drops(spark, str(drop)).select(F.col("title").alias("name"), F.lit("").alias("wikidataId"), "url"), kb, check).awaitTermination()
    assert sorted(r["name"] for r in spark.read.parquet(kb).collect()) == ["(sin título)", "Cuatro", "Tres", "Uno"]


def test_windows_and_repeats_of_a_stream(spark, tmp_path):
    src = tmp_path / "s"
    spark.createDataFrame([("a", "2026-01-01 00:10:00"), ("a", "2026-01-01 00:20:00"), ("b", "2026-01-01 01:10:00")], "url string, t string").select("url", F.col("t").cast("timestamp").alias("t")).coalesce(1).write.parquet(str(src))
    s = spark.readStream.schema("url string, t timestamp").parquet(str(src))
    q = ingest.once(s, "url", "t").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2
    q = ingest.counts_by_hour(s, "t", "url").writeStream.format("memory").outputMode("complete").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hours").count() == 2


def test_sitemaps(spark):
    x = lambda *u: "<urlset>" + "".join(f"<url><loc>{v}</loc></url>" for v in u) + "</urlset>"
    maps = spark.createDataFrame([("https://a.es/sitemap.xml", "<sitemapindex><sitemap><loc>https://a.es/s1.xml</loc></sitemap></sitemapindex>"), ("https://a.es/s1.xml", x("https://a.es/b/", "https://c.es/x", "https://a.es/d.pdf", "https://a.es/en/z", "https://a.es/q?x=1")), ("https://a.es/bad", None)], "url string, xml string")
    none = spark.createDataFrame([], "url string, body string")
    got = R.sitemap_urls(none, maps, "https://a.es/", lang="es")
    assert sorted(r["url"] for r in got.collect()) == ["https://a.es/b", "https://a.es/q"]
    robots = spark.createDataFrame([("https://a.es/robots.txt", "User-agent: *\nSitemap: https://a.es/s1.xml")], "url string, body string")
    assert R.sitemap_urls(robots, maps, "https://a.es/").count() == 3
    # A robots.txt whose sitemaps give nothing leaves it to the common places, of which the first that gives a page counts.
    useless = spark.createDataFrame([("https://a.es/robots.txt", "Sitemap: https://a.es/bad\nSitemap: s2.xml")], "url string, body string")
    ns = f'<?xml version="1.0" encoding="UTF-8"?><n:urlset xmlns:n="http://www.sitemaps.org/schemas/sitemap/0.9"><n:url><n:loc> https://a.es/ns?a=1&amp;b=2 </n:loc></n:url></n:urlset>'
    more = spark.createDataFrame([("https://a.es/bad", "<urlset><url><loc>https://a.es/cut</loc>"), ("https://a.es/sitemap.xml", x("https://c.es/other")), ("https://a.es/sitemap_index.xml", ns), ("https://a.es/sitemap/sitemap.xml", x("https://a.es/late")), ("https://b.es/sitemap.xml", x("https://b.es/b"))], "url string, xml string")
    homes = spark.createDataFrame([("https://a.es/",), ("https://b.es",), ("https://d.es",)], "home string")
    assert {tuple(r) for r in R.sitemap_urls(useless, more, homes).collect()} == {("https://a.es/", "https://a.es/ns"), ("https://b.es", "https://b.es/b")}
    assert R.sitemap_urls(none, more.where("false"), homes).count() == 0
    p = spark.createDataFrame([("https://a.es/", '<link rel="alternate" type="application/rss+xml" title="N" href="/rss.xml"><a href="/feed">Feed</a><a href="https://b.es/rss">no</a>')], "url string, html string")
    assert sorted(r["feed"] for r in R.feeds_of(p).collect()) == ["https://a.es/feed", "https://a.es/rss.xml"]


def test_json_kb(spark, tmp_path):
    doc = {"entities": [{"name": "A", "types": "Museum", "longDescriptionb": "x", "score": 0.5, "coordinates": {"lat": 1.5, "lng": 2.0}, "sources": [{"url": "u", "text": "t"}]}, {"name": None, "images": ["i", "j"]}], "crawled_urls": ["b", "a", "a"]}
    f = tmp_path / "kb.json"
    f.write_text(json.dumps(doc))
    e = R.read_kb(spark, str(f)).orderBy("pos").collect()
    assert (e[0]["name"], e[0]["types"], e[0]["longDescription"], e[0]["coordinates"]["lat"], e[0]["sources"][0]["text"]) == ("A", ["Museum"], "x", 1.5, "t")
    assert (e[1]["name"], e[1]["images"], e[1]["types"]) == ("", ["i", "j"], [])
    assert R.crawled_urls(spark.createDataFrame([(json.dumps(doc),), ("{bad",)], "value string")).count() == 2
    assert R.entities_of_json(spark.createDataFrame([("[bad",), (json.dumps(doc["entities"]),)], "value string")).count() == 2
    R.write_kb(R.read_kb(spark, str(f)).select("name", "types"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    lines = spark.createDataFrame([(" a ",), ("#b",), ("",), (" #c",)], "value string")
    assert [r["url"] for r in R.url_list(lines).collect()] == ["a", "#c"]


def test_ontology_schema_and_data_url(spark, tmp_path):
    rdf = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#"><owl:Class rdf:about="http://o#Museum"><rdfs:label xml:lang="es">Museo</rdfs:label><rdfs:subClassOf rdf:resource="http://o#Place"/></owl:Class><owl:Class rdf:about="http://x#No"></owl:Class></rdf:RDF>'
    o = R.ontology_of_rdf(spark.createDataFrame([(rdf,), ("",)], "xml string"), namespace="http://o#").collect()
    assert [(r["name"], r["label_es"], r["parent"]) for r in o] == [("Museum", "Museo", "Place")]
    more = '<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:o="http://www.w3.org/2002/07/owl#" xmlns:s="http://www.w3.org/2000/01/rdf-schema#"><o:Class r:about="http://o#A"/><o:Class r:about="http://o#B"><s:label xml:lang="en">B &amp; b</s:label><s:subClassOf r:resource="http://o#A"/></o:Class></r:RDF>'
    o = R.ontology_of_rdf(spark.createDataFrame([(more,), (more[:-3],)], "xml string"), namespace="http://o#").orderBy("name").collect()
    assert [(r["name"], r["label_en"], r["parent"]) for r in o] == [("A", "", ""), ("B", "B & b", "A")]
    doc = {"data": {"__schema": {"mutationType": {"name": "M"}, "types": [{"name": "M", "fields": [{"name": "createMuseum"}, {"name": "deleteX"}]}, {"name": "MuseumInput", "inputFields": [{"name": "name", "type": {"kind": "NON_NULL"}}, {"name": "b", "type": {"kind": "LIST"}}]}]}}}
    assert [tuple(r) for r in R.graph_schema(spark.createDataFrame([(json.dumps(doc),)], "value string")).collect()] == [("Museum", "createMuseum", ["name"])]
    (tmp_path / "a.jpg").write_bytes(b"abc")
    assert R.data_url(spark.read.format("binaryFile").load(str(tmp_path / "a.jpg"))).first()["data_url"] == "data:image/jpeg;base64,YWJj"


def test_fetch_hook(spark):
    keys = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    got = {r["k"]: (r["body"], bool(r["error"])) for r in fetch.fetched(keys, "k", lambda k: k.upper() if k == "a" else 1 / 0, pause=0).collect()}
    assert got == {"a": ("A", False), "b": (None, True)}
