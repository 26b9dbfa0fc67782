"""Queries of readers (documents are written from the tables and read back), lookups and steps of the pipeline, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as T
from ..functions.urls import with_scheme
from ..operators import classify as C, consolidate as K, enrich as E, export as X, graph as G, html as H, merge as R, report as A
from ..sources import formats as R_
from ..sources.tables import table
from . import sql as S
from .core import query
from .relational_queries import _ALLOWED, _FIRST_ALLOWED, _FOLD, _INFERRED, _QUIET, _TREE, escaped
from .scalar_queries import _unq

_NONE = "array<string>"


def joined_text(rows: DataFrame, by: list[str], part: str, before: str, after: str) -> DataFrame:
    """(by, xml): the ``part`` of all rows of a document, framed."""
    return rows.groupBy(*by).agg(F.concat(F.lit(before), F.array_join(F.collect_list(part), ""), F.lit(after)).alias("xml"))


# Readers


@query(f"select distinct 'https://' || site as home, n as url from (select site, {S.normal('trim(url)')} n from crawl_pages where {S.t('site')} <> '') where n is not null and {S.domain('n')} = {S.domain("'https://' || site")} and not {S.skipped('n')}")
def sitemap_pages(spark, d):
    """Pages are written as sitemaps of 5,000 with an index, which robots.txt names for every other site; a broken one stands before."""
    p = table(spark, d, "crawl_pages").where("site <> '' and url is not null").select("site", F.concat(F.lit("https://"), "site").alias("home"), F.floor(F.col("page_id") / 5000).alias("part"), escaped(F.col("url")).alias("u"))
    part = F.concat("home", F.lit("/pages-"), "part", F.lit(".xml"))
    space = "http://www.sitemaps.org/schemas/sitemap/0.9"
    maps = joined_text(p.withColumn("x", F.concat(F.lit("<url><loc> "), "u", F.lit("</loc></url>"))), ["home", "part"], "x", f'<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="{space}">', "</urlset>").select(part.alias("url"), "xml")
    index = joined_text(p.select("home", part.alias("s")).distinct().withColumn("x", F.concat(F.lit("<s:sitemap><s:loc>"), "s", F.lit("</s:loc></s:sitemap>"))), ["home"], "x", f'<s:sitemapindex xmlns:s="{space}">', "</s:sitemapindex>").select("home", F.concat("home", F.lit("/sitemap_index.xml")).alias("url"), "xml")
    broken = index.select(F.concat("home", F.lit("/sitemap.xml")).alias("url"), F.concat(F.lit("<urlset><url><loc>"), "home", F.lit("/cut</loc>")).alias("xml"))
    robots = index.where(F.pmod(F.crc32(F.col("home").cast("binary")), F.lit(2)) == 0).select(F.concat("home", F.lit("/robots.txt")).alias("url"), F.concat(F.lit("User-agent: *\nSITEMAP: "), "url").alias("body"))
    return R_.sitemap_urls(robots, maps.unionByName(index.select("url", "xml")).unionByName(broken), index.select("home"))


@query("""with p as (select url, page_id, regexp_replace(coalesce(title, ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') t, lower(regexp_extract(url, '^(?i:(https?))://([^/?#]*)', 1)) || '://' || regexp_extract(url, '^(?i:(https?))://([^/?#]*)', 2) b from crawl_pages where regexp_matches(url, '^(?i:https?)://[^/?#]'))
select url, b || '/rss/' || page_id as feed, t as title, 0 as prio from p union all select url, b || '/feeds/x' || page_id, 'Canal', 1 from p""")
def feed_links(spark, d):
    """Pages are written as HTML with an alternate link, a link that looks like a feed and two that don't count."""
    p = table(spark, d, "crawl_pages").where(F.rlike("url", F.lit("^(?i:https?)://[^/?#]")))
    body = '"></head><body><a href="/contacto">Contacto</a><a href="/rss">Copiar</a><a href="/feeds/x'
    html = F.concat(F.lit('<html><head><link rel="stylesheet" href="/a.css"><link rel="alternate" type="application/rss+xml" title="'), escaped(F.col("title")), F.lit('" href="/rss/'), "page_id", F.lit(body), "page_id", F.lit('#top">Canal</a></body></html>'))
    return R_.feeds_of(p.select("url", html.alias("html")))


@query(f"with {_TREE} select name, 'http://o.example/t#' || name as uri, case when parent = '' then '' else name || ' & más' end as label_es, '' as label_en, parent from o")
def rdf_classes(spark, d):
    """The ontology is written as RDF, classes without a parent in one tag, and read back."""
    o = dims.ontology(spark).withColumn("about", F.concat(F.lit('<owl:Class rdf:about="http://o.example/t#'), "name", F.lit('"')))
    whole = F.concat("about", F.lit('><rdfs:label xml:lang="es">'), "name", F.lit(' &amp; más</rdfs:label><rdfs:subClassOf rdf:resource="http://o.example/t#'), "parent", F.lit('"/></owl:Class>'))
    frame = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#"><owl:Class rdf:about="http://other.example/x#No"/>'
    docs = joined_text(o.withColumn("x", F.when(F.col("parent") == "", F.concat("about", F.lit("/>"))).otherwise(whole)), [], "x", frame, "</rdf:RDF>")
    return R_.ontology_of_rdf(docs, namespace="http://o.example/t#")


@query(f"with {_TREE} select name as class, 'create' || name as mutation, 'name|parent' as required from o")
def schema_classes(spark, d):
    """The ontology is written as an introspection document, and read back."""
    field = lambda n, kind: F.struct(F.lit(n).alias("name"), F.struct(F.lit(kind).alias("kind")).alias("type"))
    inputs = F.array(field("name", "NON_NULL"), field("parent", "NON_NULL"), field("note", "SCALAR"))
    o = dims.ontology(spark)
    of = o.agg(F.collect_list(F.struct(F.concat(F.lit("create"), "name").alias("name"))).alias("m"), F.collect_list(F.struct(F.concat("name", F.lit("Input")).alias("name"), inputs.alias("inputFields"))).alias("t"))  # the ontology's few dozen classes
    doc = of.select(F.to_json(F.struct(F.struct(F.struct(F.struct(F.lit("Mutations").alias("name")).alias("mutationType"), F.concat(F.array(F.struct(F.lit("Mutations").alias("name"), F.col("m").alias("fields"), F.lit(None).cast("array<struct<name:string,type:struct<kind:string>>>").alias("inputFields"))), F.transform("t", lambda x: F.struct(x["name"].alias("name"), F.lit(None).cast("array<struct<name:string>>").alias("fields"), x["inputFields"].alias("inputFields")))).alias("types")).alias("__schema")).alias("data"))).alias("value"))
    return R_.graph_schema(doc).select("class", "mutation", F.array_join("required", "|").alias("required"))


@query(f"select entity_id, {S.t('name')} as name, {S.t('type')} as type, {S.t('address')} as address, array_to_string(coalesce(types, []), '|') as types, len(coalesce(images, [])) as images, score, coordinates.lat as lat, {S.t('shortDescription')} as short from entities")
def json_entities(spark, d):
    """Entities are written as JSON knowledge bases, one each, and read back."""
    e = table(spark, d, "entities")
    of = ("name", "type", "address", "types", "images", "score", "coordinates", "shortDescription")
    docs = e.select(F.to_json(F.struct(F.array(F.struct(F.col("entity_id").cast("string").alias("evidence"), *of)).alias("entities"))).alias("value"))
    return R_.entities_of_json(docs).select(F.col("evidence").cast("bigint").alias("entity_id"), "name", "type", "address", F.array_join("types", "|").alias("types"), F.size("images").cast("bigint").alias("images"), "score", F.col("coordinates.lat").alias("lat"), F.col("shortDescription").alias("short"))


@query("select trim(url) as url, count(*) as rows from crawl_pages where status = 'ok' and trim(url) <> '' group by 1")
def url_lists(spark, d):
    """Pages are written as lines of a list, failed ones as remarks, and read back."""
    lines = table(spark, d, "crawl_pages").select(F.when(F.col("status") == "ok", F.concat(F.lit("  "), "url", F.lit(" "))).otherwise(F.concat(F.lit("#"), T.text(F.col("url")))).alias("value"))
    return R_.url_list(lines).groupBy("url").agg(F.count("*").alias("rows"))


def _html(body):
    return F.concat(F.lit("<html><body>"), body, F.lit("</body></html>"))


@query(f"""with i as (select page_id, unnest(images).url u from crawl_pages), j as (select distinct page_id, replace(u, ' ', '%20') u from i where {S.t('u')} <> ''), k as (select *, {S.key(f"lower({S.path(_unq('u'))}) || '  '")} ik from j) select page_id, u as image from k where not {_QUIET}""")
def html_images(spark, d):
    """Images are written as tags beside an icon, and read back without what is noise."""
    tags = F.array_join(F.transform("images", lambda i: F.concat(F.lit('<img src="'), escaped(i["url"]), F.lit('">'))), "")
    p = table(spark, d, "crawl_pages").select(F.col("page_id").cast("string").alias("url"), _html(F.concat(F.lit('<img src="/small.png" width="16" height="16">'), T.text(tags))).alias("html"))
    return H.page_images(H.parse(p)).select(F.col("url").cast("bigint").alias("page_id"), "image")


_ARTICLE = S.clean_content(f"{S.t('title')} || ' ' || {S.t('text')}")


@query(f"""with a as (select page_id, {S.clean_content('title')} h, {_ARTICLE} t, row_number() over (partition by page_id order by position, block_uid) n from content_blocks where kind <> 'page' and page_id is not null),
u as (select * from a where length(t) >= 50 and not (regexp_matches(lower(t), 'cookies|politica de privacidad|aviso legal') and length(t) < 500)),
f as (select *, row_number() over (partition by page_id order by n) k from u qualify row_number() over (partition by page_id, substr(t, 1, 300) order by n) = 1)
select page_id, h as title, substr(t, 1, {H.BLOCK_TEXT}) as text from f where k <= {H.MOST_BLOCKS}""")
def html_blocks(spark, d):
    """Blocks are written as the articles of their page, and read back."""
    one = F.concat(F.lit("<article><h2>"), escaped(F.col("title")), F.lit("</h2><p>"), escaped(F.col("text")), F.lit("</p></article>"))
    b = table(spark, d, "content_blocks").where("kind <> 'page' and page_id is not null").groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "block_uid", one.alias("x")))), lambda z: z["x"]), "").alias("body"))
    parsed = H.parse(b.select(F.col("page_id").cast("string").alias("url"), _html(F.col("body")).alias("html")))
    return H.page_blocks(parsed).where("kind = 'article'").select(F.col("url").cast("bigint").alias("page_id"), "title", "text")


@query(f"""with l as (select sourceUrl p, unnest(relatedUrls) u from entities union all select sourceUrl, '/es/inicio#arriba' from entities), a as (select p, trim(u) u from l where p is not null and {S.t('u')} <> ''),
f as (select p, {S.normal("case when starts_with(u, '/') then " + "regexp_extract(p, '^([A-Za-z][A-Za-z0-9+.-]*)', 1) || '://' || " + S.authority('p') + " || u else u end")} n from a)
select distinct p as url, n as link from f where n is not null and {S.domain('n')} = {S.domain('p')} and not {S.skipped('n')}""")
def html_links(spark, d):
    """Related urls are written as links of the entity's page, and the followable ones of the site read back."""
    tags = F.array_join(F.transform(F.filter(F.coalesce("relatedUrls", F.array().cast(_NONE)), lambda u: T.text(u) != ""), lambda u: F.concat(F.lit('<a href="'), u, F.lit('">x</a>'))), "")
    more = '<a href="/es/inicio#arriba">x</a><a href="mailto:a@b.example">x</a><a href="#pie">x</a><a href="/x.pdf">x</a>'
    p = table(spark, d, "entities").where("sourceUrl is not null").select(F.col("sourceUrl").alias("url"), _html(F.concat(T.text(tags), F.lit(more))).alias("html"))
    return G.page_links(p)


_SCHEMA = "st(k, t) as (values " + ", ".join(f"('{k}', '{t}')" for k, t in dims.SCHEMA_TYPES.items()) + ")"
_POINT = "coordinates.lat <> 0 and coordinates.lng <> 0 and coordinates.lat between -90 and 90 and coordinates.lng between -180 and 180"


@query(f"""with {_SCHEMA} select entity_id, trim(name) as name, st.t as type, {S.t('address')} as address, case when {_POINT} then coordinates.lat end as lat, case when {_POINT} then coordinates.lng end as lng, trim({S.t('phone')}) as phone from entities e join st on e.type = st.k where trim({S.t('name')}) <> ''""")
def json_ld_entities(spark, d):
    """Entities are written as structured data of pages, in a graph beside an item without a type and a broken script, and read back."""
    item = F.struct(F.col("type").alias("@type"), "name", F.struct(F.nullif("address", F.lit("")).alias("streetAddress")).alias("address"), F.struct(F.col("coordinates.lat").alias("latitude"), F.col("coordinates.lng").alias("longitude")).alias("geo"), F.col("phone").alias("telephone"))
    script = F.concat(F.lit('<script type="application/ld+json">{"@context": </script><script type="application/ld+json">{"@graph": ['), F.to_json(item), F.lit("]}</script>"))
    e = table(spark, d, "entities").select(F.col("entity_id").cast("string").alias("url"), F.concat(F.lit("<html><head>"), script, F.lit("</head></html>")).alias("html"))
    return H.structured_entities(H.structured_data(H.parse(e))).select(F.col("url").cast("bigint").alias("entity_id"), "name", "type", "address", "lat", "lng", "phone")


@query("select point_id, lat, lng, case when confidence >= 0.5 then 'json-ld' else 'meta' end as source, cast(case when confidence >= 0.5 then 0.9 else 0.8 end as double) as confidence from geo_candidates where lat between -90 and 90 and lng between -180 and 180")
def page_points(spark, d):
    """Points are written as meta tags of pages, sure ones as structured data too, and read back once."""
    n = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("x"))
    meta = F.concat(F.lit('<meta property="place:location:latitude" content="'), n("lat"), F.lit('"><meta property="place:location:longitude" content="'), n("lng"), F.lit('">'))
    ld = F.when(F.col("confidence") >= 0.5, F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.struct(F.col("lat").alias("latitude"), F.col("lng").alias("longitude")).alias("geo"))), F.lit("</script>")))
    p = table(spark, d, "geo_candidates").select(F.col("point_id").cast("string").alias("url"), F.concat(F.lit("<html><head>"), meta, T.text(ld), F.lit("</head></html>")).alias("html"))
    return H.geo_candidates(H.parse(p)).select(F.col("url").cast("bigint").alias("point_id"), "lat", "lng", "source", "confidence")


@query(f"select entity_id, name as label, {S.t('shortDescription')} as description, 'Q' || entity_id as first_class, case when {S.t('type')} = '' then 1 else 2 end as classes, images[1] as image from entities where {S.t('name')} <> ''")
def wikidata_documents(spark, d):
    """Entities are written as documents of the knowledge graph, and their facts read back."""
    claim = lambda v: F.struct(F.struct(F.struct(v.alias("value")).alias("datavalue")).alias("mainsnak"))
    id_ = lambda v: claim(F.struct(v.alias("id")))
    classes = F.array(id_(F.concat(F.lit("Q"), "entity_id")), id_(F.coalesce(F.nullif("type", F.lit("")), F.lit(""))))
    text_of = lambda c, l: F.struct(F.struct(F.col(c).alias("value")).alias(l)).alias("x")
    doc = F.to_json(F.struct(F.struct(classes.alias("P31"), F.array(claim(F.get("images", F.lit(0)))).alias("P18")).alias("claims"), text_of("name", "en").alias("labels"), text_of("shortDescription", "es").alias("descriptions")))
    facts = E.wikidata_facts(table(spark, d, "entities").where("name <> ''").select(F.col("entity_id").cast("string").alias("qid"), doc.alias("doc")))
    return facts.select(F.col("qid").cast("bigint").alias("entity_id"), "label", "description", F.get("p31", F.lit(0)).alias("first_class"), F.size("p31").alias("classes"), "image")


@query(f"select entity_id, {S.t('name')} <> '' as valid from entities")
def upload_items(spark, d):
    """Entities are written as items to send, those without a name without variables, and checked."""
    variables = F.when(F.col("name") != "", F.struct(F.struct("name", F.struct(F.lit("u").alias("uri"), F.lit("o").alias("object")).alias("place")).alias("input")))
    item = F.to_json(F.struct(F.lit("mutation { x }").alias("query"), variables.alias("variables")))
    return X.checked_items(table(spark, d, "entities").select(F.col("entity_id").alias("pos"), item.alias("item")), inline=True, drop="externalId").select(F.col("pos").alias("entity_id"), "valid")


# Columns and lookups


@query(rf"select entity_id, trim(translate(coalesce(string_split(regexp_replace({S.path('sourceUrl')}, '^/+|/+$', '', 'g'), '/')[-1], ''), '-_', '  ')) as slug, case when {S.t('type')} = '' then 0 else 1 end as listed from entities where sourceUrl is not null")
def slug_names(spark, d):
    return table(spark, d, "entities").where("sourceUrl is not null").select("entity_id", T.slug_name(F.col("sourceUrl")).alias("slug"), F.size(T.as_list(F.col("type"))).alias("listed"))


@query("select page_id, coalesce(nullif(title, ''), nullif(description, ''), '') as label, case when regexp_matches(url, '^https?://') then url else 'https://' || url end as url from crawl_pages where url is not null")
def language_pick(spark, d):
    p = table(spark, d, "crawl_pages").where("url is not null")
    return p.select("page_id", T.pick_language(F.create_map(F.lit("en"), F.col("description"), F.lit("es"), F.col("title"))).alias("label"), with_scheme(F.col("url")).alias("url"))


@query(f"""with h as (select page_id, lower(concat_ws(' ', {S.t('url')}, {S.t('title')}, {S.t('description')})) h from crawl_pages), m as (select page_id, arg_min(city, city_id) c from h join city_centers on contains(h, lower(city)) group by 1)
select h.page_id, coalesce(c, '') as city from h left join m on h.page_id = m.page_id""")
def city_names(spark, d):
    return E.city_of(table(spark, d, "crawl_pages"), table(spark, d, "city_centers").where("city is not null").select(F.col("city_id").alias("ord"), F.lower("city").alias("key"), F.col("city").alias("name")))


_HEADING = r"\b\d{1,2}\s+de\s+[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+\s+de\s+\d{4}\b"


@query(rf"""with x as (select evidence_id, {S.key('e.name')} k, {S.compact('v.text')} t from evidence v join entities e on v.entity_id = e.entity_id),
y as (select *, list_filter(string_split(regexp_replace(t, '({_HEADING})', chr(1) || '\1', 'g'), chr(1)), lambda p: regexp_matches(p, '^{_HEADING}')) ps from x)
select evidence_id, case when len(ps) >= 2 and k <> '' then coalesce(trim(list_filter(ps, lambda p: contains({S.key('p')}, k))[1]), t) else t end as text from y""")
def relevant_texts(spark, d):
    v = table(spark, d, "evidence").select("evidence_id", "entity_id", "text").join(table(spark, d, "entities").select("entity_id", "name"), "entity_id")
    return v.select("evidence_id", T.relevant_text(F.col("name"), F.col("text")).alias("text"))


@query(f"select entity_id from entities where len(list_filter(list_concat([url, sourceUrl], coalesce(relatedUrls, [])), lambda u: {S.domain('u')} = 'portal-caminos.example')) > 0")
def domain_entities(spark, d):
    return A.on_domain(table(spark, d, "entities"), "https://www.portal-caminos.example/x").select("entity_id")


@query(f"""with n as (select entity_id, name, wikidataId qid, list_filter(string_split({S.key('name')}, ' '), lambda w: length(w) >= 3 and w not in {S.in_(dims.LABEL_STOPWORDS)}) w from entities where {S.t('wikidataId')} <> ''), l as (select wikidataId qid, string_agg(distinct {S.key('name')}, ' ') h from kb_entities where {S.t('wikidataId')} <> '' group by 1)
select entity_id, n.qid from n left join l on n.qid = l.qid where h is null or len(w) = 0 or len(list_filter(w, lambda x: contains(h, x))) > 0""")
def label_matches(spark, d):
    named = lambda t: table(spark, d, t).where("wikidataId <> ''").withColumnRenamed("wikidataId", "qid")
    return E.label_matches(named("entities").select("entity_id", "name", "qid"), named("kb_entities").select("qid", F.col("name").alias("label"))).select("entity_id", "qid")


_SLUG = rf"trim(translate(coalesce(string_split(regexp_replace({S.path('sourceUrl')}, '^/+|/+$', '', 'g'), '/')[-1], ''), '-_', '  '))"


@query(f"""with s as (select {S.compact('name')} q, wikidataId id, row_number() over (partition by {S.compact('name')} order by kb_id) - 1 p from kb_entities where {S.t('wikidataId')} <> '' and name is not null), e as (select entity_id, name, {_SLUG} slug from entities),
q as (select entity_id, {S.compact('name')} q, 0 r from e where name is not null union all select entity_id, {S.compact('slug')}, 1 from e where slug <> '' and lower({S.ascii_('slug')}) <> lower({S.ascii_('name')}) and name is not null),
h as (select entity_id, id, min(r * 100 + p) o from q join s on q.q = s.q group by 1, 2), k as (select *, row_number() over (partition by entity_id order by o, id) n from h)
select entity_id, string_agg(id, '|' order by n) as qids from k where n <= 8 group by 1""")
def candidate_qids(spark, d):
    """Searches answer with the identifiers of entities of that name in the other source, in order."""
    kb = table(spark, d, "kb_entities").where("wikidataId <> '' and name is not null")
    searches = kb.select(T.compact(F.col("name")).alias("query"), "kb_id", F.col("wikidataId").alias("qid")).withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy("kb_id")) - 1).drop("kb_id")
    return E.candidate_ids(table(spark, d, "entities").where("name is not null"), searches).select("entity_id", F.array_join("qids", "|").alias("qids"))


@query(f"""with p as (select wikidataId w, list_sort(list(distinct sourceUrl)) l from entities where {S.t('wikidataId')} <> '' and sourceUrl is not null group by 1)
select entity_id, array_to_string({S.distinct("list_concat(coalesce(p.l, []), coalesce(images, []))")}, '|') as images from entities e left join p on e.wikidataId = p.w""")
def identifier_images(spark, d):
    e = table(spark, d, "entities")
    pictures = e.where("wikidataId <> '' and sourceUrl is not null").groupBy("wikidataId").agg(F.sort_array(F.collect_set("sourceUrl")).alias("images"))
    return E.with_wikidata_images(e, pictures).select("entity_id", F.array_join("images", "|").alias("images"))


_RADIUS = f"coalesce(list_filter(list_transform(coalesce(e.types, []), lambda t: case when t in {{wide}} then 800 when t in {{narrow}} then 100 end), lambda r: r is not null)[1], 200)"


def _radius() -> str:
    from ..functions import geo

    return _RADIUS.format(wide=S.in_(geo.WIDE), narrow=S.in_(geo.NARROW))


_KM = S.km("e.coordinates.lat", "e.coordinates.lng", "k.lat", "k.lng")


@query(f"""with k as (select kb_id, coordinates.lat lat, coordinates.lng lng from kb_entities where coordinates.lat between -90 and 90 and coordinates.lng between -180 and 180),
j as (select e.entity_id, k.kb_id, {_KM} * 1000 m, {_radius()} r from entities e join k on k.lat between e.coordinates.lat - 0.01 and e.coordinates.lat + 0.01 where coalesce(len(e.images), 0) = 0 and e.coordinates.lat between -90 and 90 and e.coordinates.lng between -180 and 180)
select entity_id, kb_id, round(m, 3) as metres from j where m <= r""")
def images_around(spark, d):
    """Places of the other source around entities without images."""
    files = table(spark, d, "kb_entities").where("coordinates.lat between -90 and 90 and coordinates.lng between -180 and 180").select(F.col("kb_id").cast("string").alias("url"), "coordinates.lat", "coordinates.lng")
    return E.geosearch_images(table(spark, d, "entities"), files).select("entity_id", F.col("url").cast("bigint").alias("kb_id"), "metres")


@query(f"""with q as (select entity_id, {S.key('name')} q, {S.key(f"regexp_extract({S.t('address')}, '([^,;0-9()]*)$', 1)")} city from entities where {S.key('name')} <> ''), r as (select {S.key('name')} q, kb_id, coordinates.lat lat, coordinates.lng lng from kb_entities where coordinates.lat is not null and coordinates.lng is not null),
c as (select {S.key('city')} city, min(lat) lat, min(lng) lng, min(radius_km) r from city_centers group by 1)
select entity_id, arg_min(r.lat, kb_id) as lat, arg_min(r.lng, kb_id) as lng from q join r on q.q = r.q join c on q.city = c.city where {S.km('r.lat', 'r.lng', 'c.lat', 'c.lng')} <= c.r group by 1""")
def lookup_in_city(spark, d):
    """Names are looked up in the other source; the first place within the city that ends the address counts."""
    q = table(spark, d, "entities").select("entity_id", F.lit(0).alias("pos"), T.key(F.col("name")).alias("query"), T.key(F.regexp_extract(T.text(F.col("address")), "([^,;0-9()]*)$", 1)).alias("city")).where("query <> ''")
    r = table(spark, d, "kb_entities").where("coordinates.lat is not null and coordinates.lng is not null").select(T.key(F.col("name")).alias("query"), F.col("kb_id").alias("rank"), "coordinates.lat", "coordinates.lng", F.lit(0.5).alias("importance"))
    c = table(spark, d, "city_centers").groupBy(T.key(F.col("city")).alias("name")).agg(*[F.min(x).alias(x) for x in ("lat", "lng", "radius_km")])
    return E.first_lookup(q, r, c)


# Steps of the pipeline


@query(f"""with b as (select *, entity_id k from entities), i as (select *, entity_id - 1 k from entities), j as (select b.k, b.images bi, i.images ii, b.types bt, i.types it, b.coordinates bc, i.coordinates ic, b.address ba, i.address ia, b.phone bp, i.phone ip, b.wikidataId bw, i.wikidataId iw, b.score bs, i.score iscore, trim({S.t('b.shortDescription')}, '{T.BLANKS}') a, trim({S.t('i.shortDescription')}, '{T.BLANKS}') b from b left join i on b.k = i.k),
m as (select *, {S.distinct('coalesce(bi, [])')} own, ic.lat is not null and (bc.lat is null or coalesce(ic.confidence, 0.0) > coalesce(bc.confidence, 0.0)) surer from j)
select k as entity_id, {_FOLD} as short, array_to_string(list_slice({S.distinct("list_filter(list_concat(own, coalesce(ii, [])), lambda u: coalesce(u, '') <> '')")}, 1, greatest(10, len(own))), '|') as images,
 array_to_string(list_sort({S.distinct(f"list_filter(list_concat(coalesce(bt, []), coalesce(it, [])), lambda t: t in {S.in_(dims.ALLOWED)})")}), '|') as types, case when surer then ic.lat else bc.lat end as lat, case when surer then ic.confidence else bc.confidence end as confidence,
 case when {S.t('ba')} <> '' then ba else coalesce(nullif(ia, ''), ba) end as address, case when {S.t('bp')} <> '' then bp else coalesce(nullif(ip, ''), bp) end as phone, case when {S.t('bw')} <> '' then bw else coalesce(nullif(iw, ''), bw) end as "wikidataId", greatest(bs, iscore) as score from m""")
def kb_enriched(spark, d):
    """Each entity takes in the next one."""
    e = table(spark, d, "entities")
    n = R.enriched(e.withColumn("key", F.col("entity_id")), e.withColumn("key", F.col("entity_id") - 1))
    return n.select(F.col("key").alias("entity_id"), F.col("shortDescription").alias("short"), F.array_join("images", "|").alias("images"), F.array_join(F.array_sort("types"), "|").alias("types"), F.col("coordinates.lat").alias("lat"), F.col("coordinates.confidence").alias("confidence"), "address", "phone", "wikidataId", "score")


_P31 = list(dims.P31_TYPES.items())
_OSM = [(c, k, t) for c, m in dims.OSM_TYPES.items() for k, t in m.items()]


@query(f"""with {_INFERRED}, pt(i, t) as (values {', '.join(f"({i}, '{t}')" for i, (_, t) in enumerate(_P31))}), ot(i, t) as (values {', '.join(f"({i}, '{t}')" for i, (_, _, t) in enumerate(_OSM))}),
w as (select entity_id, pt.t from entities join pt on entity_id % {len(_P31)} = pt.i where {S.t('wikidataId')} <> '' and pt.t in {S.in_(dims.ALLOWED)}), o as (select entity_id, ot.t from entities join ot on entity_id % {len(_OSM)} = ot.i where {S.t('address')} <> '' and ot.t in {S.in_(dims.ALLOWED)}),
x as (select e.entity_id, w.t wt, o.t ot, case when inf.t <> '' and (c >= 60 or len({_ALLOWED}) = 0 or list_contains({_ALLOWED}, inf.t)) then inf.t else coalesce({_FIRST_ALLOWED}, inf.t) end p, inf.t q, {_ALLOWED} a, c from entities e join inf on e.entity_id = inf.entity_id left join w on e.entity_id = w.entity_id left join o on e.entity_id = o.entity_id)
select entity_id, coalesce(wt, ot, p) as type, array_to_string(list_sort(list_distinct(list_filter(list_concat([coalesce(wt, ot, p), coalesce(wt, ot, q)], a), lambda y: y <> ''))), '|') as types, cast(case when wt is not null then 120 when ot is not null then 110 else c end as int) as confidence from x""")
def classified(spark, d):
    """Identifiers and addresses stand for classes of the knowledge graph (the class itself or its parent) and categories of the map."""
    e, v = table(spark, d, "entities"), table(spark, d, "evidence")
    # Half of the classes are known by their parent only.
    number = F.pmod("entity_id", F.lit(len(_P31)))
    qid = F.get(F.array(*[F.lit(q) for q, _ in _P31]), number.cast("int"))
    own = e.where("wikidataId <> ''").select("entity_id", F.lit(1).alias("pos"), F.when(number % 2 == 0, qid).otherwise(F.concat(F.lit("child-of-"), qid)).alias("qid"))
    unknown = own.select("entity_id", F.lit(0).alias("pos"), F.lit("Q0").alias("qid"))
    parents = spark.createDataFrame([(f"child-of-{q}", q) for q, _ in _P31], "qid string, parent string")
    place = F.get(F.array(*[F.struct(F.lit(c).alias("category"), F.lit(k).alias("kind")) for c, k, _ in _OSM]), F.pmod("entity_id", F.lit(len(_OSM))).cast("int"))
    places = e.where("address <> ''").select("entity_id", F.lit(0).alias("pos"), place.alias("p")).select("entity_id", "pos", "p.*")
    return C.classify(e, v, C.by_wikidata(unknown.unionByName(own), parents), C.by_osm(places)).select("entity_id", "type", F.array_join(F.array_sort("types"), "|").alias("types"), F.col("confidence").cast("int").alias("confidence"))


@query(f"with k as (select entity_key g, min(wikidataId) filter (where {S.t('wikidataId')} <> '') w from entities where entity_key is not null group by 1) select entity_id, coalesce(nullif(wikidataId, ''), w, '') as mine, coalesce(w, nullif(wikidataId, ''), '') as other from entities e join k on e.entity_key = k.g")
def identifiers_shared(spark, d):
    e = table(spark, d, "entities").where("entity_key is not null")
    k = e.groupBy("entity_key").agg(F.min(F.nullif("wikidataId", F.lit(""))).alias("b_wd"))
    return K.propagated(e.select("entity_id", "entity_key", F.col("wikidataId").alias("a_wd")).join(k, "entity_key")).select("entity_id", F.col("a_wd").alias("mine"), F.col("b_wd").alias("other"))


_IMG = "select entity_id, unnest(images) u, generate_subscripts(images, 1) - 1 p from entities"


@query(f"select entity_id, lower(u) as image, min(p) as pos from ({_IMG}) where {S.t('u')} <> '' and not ends_with(u, '-1.jpg') group by 1, 2")
def images_alive(spark, d):
    """Images that end in -1.jpg fail their check, the others lead to their address in lower case."""
    i = table(spark, d, "entities").select("entity_id", F.posexplode("images").alias("pos", "image")).where("image <> ''")
    status = i.select(F.col("image").alias("url")).distinct().select("url", (~F.endswith("url", F.lit("-1.jpg"))).alias("ok"), F.lower("url").alias("resolved"))
    return X.alive(i, status).select("entity_id", "image", F.col("pos").cast("bigint").alias("pos"))


@query(f"select entity_id, coalesce(string_agg(distinct u, '|' order by u) filter (where ends_with(u, '-0.jpg')), '') as accepted, coalesce(string_agg(distinct u, '|' order by u) filter (where not ends_with(u, '-0.jpg')), '') as rejected from ({_IMG}) where u is not null group by 1")
def images_judged(spark, d):
    """Images that end in -0.jpg are judged to show the entity."""
    i = table(spark, d, "entities").select("entity_id", F.explode("images").alias("image")).where("image is not null").withColumn("related", F.endswith("image", F.lit("-0.jpg")))
    return K.accepted_images(i).select("entity_id", F.array_join("accepted", "|").alias("accepted"), F.array_join("rejected", "|").alias("rejected"))


@query(f"""with l0 as (select url page, unnest(images) i from crawl_pages), l as (select distinct page, i.url image, lower(split_part(trim({S.t('i.context')}), ' ', 1)) l from l0), f as (select * from l where l not in ('', 'none', 'ninguna', 'ninguno', 'null', 'n/a', 'no')), e as (select entity_id, sourceUrl page, lower(trim(name)) n from entities where trim(name) <> ''),
j as (select f.page, image, entity_id, case when l = n then 0 when contains(n, l) or contains(l, n) then 1 end h from f join e on f.page = e.page), b as (select page, image, min({{'h': h, 'e': entity_id}}) b from j where h is not null group by 1, 2)
select b.e as entity_id, image, case when b.h = 0 then 'name' else 'part' end as how from b""")
def images_named(spark, d):
    """The first word of what stands around an image is what was seen in it."""
    i = table(spark, d, "crawl_pages").select(F.col("url").alias("page"), F.explode("images").alias("i")).select("page", F.col("i.url").alias("image"), F.substring_index(F.trim(T.text(F.col("i.context"))), " ", 1).alias("label")).distinct()
    return K.seen_images(i, table(spark, d, "entities"))
