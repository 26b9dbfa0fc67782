"""Queries of joins, groups, classification, resolution, reports and exports over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import text as T
from ..functions.urls import site
from ..operators import classify as C, enrich as E, export as X, graph as G, html as H, match as M, merge as R, report as A, resolve as V
from ..sources.tables import cut, table
from . import sql as S
from .core import query
from .scalar_queries import _BODY, _NOISE_IMG, _NOISE_SQL, _REASONS, _navigation_sql, _unq



def escaped(c):
    """A text as it stands in XML and HTML."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return T.text(c)


_PRIMARY = "coalesce(nullif(type, ''), types[1])"


@query(f"""with c as (select {_PRIMARY} t, count(*) n, min(entity_id) f from entities where {S.t(_PRIMARY)} <> '' group by 1)
select t as type, n as entities, row_number() over (order by n desc, f) as rank from c""")
def type_counts(spark, d):
    return A.count_by_type(table(spark, d, "entities"))


_PAGE = "coalesce(nullif(page_url, ''), nullif(metadata.page_url, ''), nullif(url, ''), '')"


@query(f"select {_PAGE} as page, count(distinct entity_id) as entities from evidence where {_PAGE} <> '' and entity_id is not null group by 1")
def entities_per_page(spark, d):
    return A.count_by_page(table(spark, d, "evidence").where("entity_id is not null"))


@query(f"select distinct url from crawl_pages where status = 'ok' and url not in (select {_PAGE} from evidence)")
def zero_pages(spark, d):
    return A.silent_pages(table(spark, d, "crawl_pages"), table(spark, d, "evidence"))


@query(f"""select site, count(*) as pages, count(*) filter (where status = 'ok') as ok, count(*) filter (where status <> 'ok') as failed, count(*) filter (where {S.t('title')} = '') as untitled,
 cast(sum(coalesce(len(errors), 0)) as bigint) as errors, count(*) - count(distinct url) as repeated from crawl_pages group by site""")
def batch_report(spark, d):
    return A.crawl_report(table(spark, d, "crawl_pages"))


@query(f"select {S.key('name')} as key, count(*) as rows, min(entity_id) as first from entities where {S.key('name')} <> '' group by 1 having count(*) > 1")
def duplicate_groups(spark, d):
    return A.duplicate_groups(table(spark, d, "entities"), F.col("name"), "entity_id")


def _side(t: str, i: str) -> str:
    return f"select {S.key('name')} k, arg_max(list_transform(list_distinct(list_filter(list_concat([type], coalesce(types, [])), lambda t: coalesce(t, '') <> '')), lambda t: {S.key('t')}), {i}) t from {t} where {S.t('name')} <> '' group by 1"


@query(f"""with a as ({_side('entities', 'entity_id')}), e as ({_side('(select *, [type] as types from kb_entities)', 'kb_id')})
select coalesce(a.k, e.k) as key, case when a.k is null then 'missing' when e.k is null then 'additional' else 'found' end as state, case when a.k is not null and e.k is not null then len(list_intersect(a.t, e.t)) > 0 or len(e.t) = 0 end as type_match from a full join e on a.k = e.k""")
def ground_truth_compare(spark, d):
    return A.compare(table(spark, d, "entities"), table(spark, d, "kb_entities").withColumn("types", F.array("type")), "entity_id", "kb_id")


def _coverage_sql() -> str:
    hits = "len(list_filter(n.w, lambda w: contains(b.body, w)))"
    return f"""with b as (select block_uid, url, block_id, title, text, {_BODY} body, {_REASONS} reasons from content_blocks),
c as (select * from b where len(reasons) > 0), dir as (select distinct url, block_id from evidence where block_id <> '' and block_id <> 'page'),
n0 as (select sourceUrl url, entity_id, name, {S.key('name')} k, list_filter(string_split({S.key('name')}, ' '), lambda w: length(w) >= 4) w from entities),
n as (select url, k, w, min({{'i': entity_id, 'n': name}}) m from n0 where len(w) > 0 group by all),
met as (select b.block_uid, n.m.n as nm, min(n.m.i) i from c b join n on b.url = n.url where contains(b.body, n.k) or {hits} >= least(2, len(n.w)) group by 1, 2),
cov as (select block_uid, list(nm order by i) names from met where {S.t('nm')} <> '' group by 1),
s as (select c.*, names, case when dir.url is not null then 'attached_to_entity' when len(names) > 0 then 'covered_by_related_entities' when {_navigation_sql()} then 'discarded_navigation' when {_NOISE_SQL} then 'discarded_noise' else 'unresolved_relevant' end status
 from c left join dir on c.url = dir.url and c.block_id = dir.block_id left join cov on c.block_uid = cov.block_uid)"""


@query(_coverage_sql() + " select block_uid, url, status, array_to_string(reasons, ',') as reasons, case when status = 'covered_by_related_entities' then array_to_string(list_slice(names, 1, 8), '|') else '' end as covered_by from s")
def block_coverage(spark, d):
    return A.block_coverage(table(spark, d, "content_blocks"), table(spark, d, "evidence"), table(spark, d, "entities"))


@query(
    _coverage_sql()
    + """, tot as (select url, count(*) n from content_blocks group by 1), g as (select url, count(*) c, """
    + ", ".join(f"count(*) filter (where status = '{x}') {x}" for x in ("attached_to_entity", "covered_by_related_entities", "discarded_navigation", "discarded_noise", "unresolved_relevant"))
    + """ from s group by 1) select tot.url, n as total_blocks, coalesce(c, 0) as candidates, coalesce(c - unresolved_relevant, 0) as covered, coalesce(unresolved_relevant, 0) as uncovered, round((c - unresolved_relevant) / c, 3) as ratio, """
    + ", ".join(f"coalesce({x}, 0) as {x}" for x in ("attached_to_entity", "covered_by_related_entities", "discarded_navigation", "discarded_noise", "unresolved_relevant"))
    + " from tot left join g on tot.url = g.url"
)
def coverage_report(spark, d):
    return A.coverage_summary(block_coverage(spark, d), table(spark, d, "content_blocks"))


_NAV = ("saber mas", "ver mapa", "newsletter", "aviso legal", "cookies")


@query(f"""select count(*) as entities, count(*) filter (where {S.t('name')} = '') as unnamed, count(*) filter (where {S.t('type')} = '' and coalesce(len(types), 0) = 0) as untyped, count(*) filter (where coordinates.lat is not null and coordinates.lng is not null) as located,
 count(*) filter (where {S.t('wikidataId')} <> '') as identified, count(*) filter (where len(images) > 0) as illustrated, max(len(images)) as most_images, count(*) filter (where {S.t('address')} <> '' and length(address) > 90) as long_addresses,
 {", ".join(f"count(*) filter (where contains(lower({S.t('sourceText')}), '{x}')) as {x.replace(' ', '_')}" for x in _NAV)} from entities""")
def diagnostics(spark, d):
    c = F.col
    has = lambda x: T.text(c(x)) != ""
    n = F.count_if
    return table(spark, d, "entities").agg(
        F.count("*").alias("entities"), n(~has("name")).alias("unnamed"), n(~has("type") & (F.coalesce(F.size("types"), F.lit(0)) <= 0)).alias("untyped"), n(c("coordinates.lat").isNotNull() & c("coordinates.lng").isNotNull()).alias("located"), n(has("wikidataId")).alias("identified"),
        n(F.size("images") > 0).alias("illustrated"), F.max(F.size("images")).cast("bigint").alias("most_images"), n(F.length("address") > 90).alias("long_addresses"), *[n(F.contains(F.lower(T.text(c("sourceText"))), F.lit(x))).alias(x.replace(" ", "_")) for x in _NAV],
    )


_LONGEST = lambda c: f"arg_max(coalesce({c}, ''), {{'n': length(coalesce({c}, '')), 'o': -entity_id}})"


@query(f"""with e as (select *, {S.entity_key()} key from entities),
ty as (select key, string_agg(v, '|' order by o, p) x from (select key, v, min(o) o, min(p) p from (select key, entity_id o, unnest(types) v, generate_subscripts(types, 1) p from e) where {S.t('v')} <> '' group by 1, 2) group by 1),
im as (select key, string_agg(v, '|' order by f) x from (select key, v, min({{'o': o, 'p': p}}) f from (select key, entity_id o, unnest(images) v, generate_subscripts(images, 1) p from e) where {S.t('v')} <> '' group by 1, 2) group by 1)
select e.key, min(entity_id) as entity_id, count(*) as rows, arg_min_null(name, entity_id) as name, {_LONGEST('shortDescription')} as short, {_LONGEST('longDescription')} as long, arg_min(address, entity_id) filter (where {S.t('address')} <> '') as address, arg_min(phone, entity_id) filter (where {S.t('phone')} <> '') as phone,
 arg_min(coordinates.lat, entity_id) filter (where coordinates.lat is not null) as lat, max(score) as score, coalesce(any_value(im.x), '') as images from e left join im on e.key = im.key group by 1""")
def entity_merge(spark, d):
    m = R.merge_entities(table(spark, d, "entities"))
    return m.select("key", "entity_id", "rows", "name", F.col("shortDescription").alias("short"), F.col("longDescription").alias("long"), "address", "phone", F.col("coordinates.lat").alias("lat"), "score", F.array_join("images", "|").alias("images"))


@query(f"""with e as (select *, coalesce(url, '') u, coalesce(block_id, '') b, coalesce(source_type, '') s from evidence), im as (select entity_id, u, b, s, string_agg(v, '|' order by f) x from (select entity_id, u, b, s, v, min({{'o': o, 'p': p}}) f from (select entity_id, u, b, s, evidence_id o, unnest(images) v, generate_subscripts(images, 1) p from e) where {S.t('v')} <> '' group by all) group by all)
select e.entity_id, e.u as url, e.b as block_id, e.s as source_type, min(evidence_id) as evidence_id, count(*) as rows, arg_min(title, evidence_id) filter (where {S.t('title')} <> '') as title, arg_max(coalesce(text, ''), {{'n': length(coalesce(text, '')), 'o': -evidence_id}}) as text, coalesce(any_value(x), '') as images
from e left join im on e.entity_id is not distinct from im.entity_id and e.u = im.u and e.b = im.b and e.s = im.s group by 1, 2, 3, 4""")
def merge_sources(spark, d):
    m = R.merge_sources(table(spark, d, "evidence").where("entity_id is not null"))
    return m.select("entity_id", "url", "block_id", "source_type", "evidence_id", "rows", "title", "text", F.array_join("images", "|").alias("images"))


_FOLD = f"case when b = '' then a when a = '' then case when {S.is_boilerplate('b')} then a else b end when contains(a, b) then a when contains(b, a) then b when {S.is_boilerplate('b')} then a else a || ' ' || b end"


@query(f"""with t as (select entity_id, trim(text, '{T.BLANKS}') x, min(evidence_id) o from evidence where trim(text, '{T.BLANKS}') <> '' group by 1, 2), l as (select entity_id, list(x order by o) l from t group by 1)
select entity_id, list_reduce(list_prepend('', l), lambda a, b: {_FOLD}) as text from l""")
def text_fold(spark, d):
    return R.accumulated_text(table(spark, d, "evidence"))


@query(f"""with a as (select {S.entity_key()} key, min(kb_id) kb from kb_entities group by 1), b as (select {S.entity_key()} key, min(entity_id) n from entities group by 1)
select coalesce(a.key, b.key) as key, kb, n as new, case when a.key is null then 'added' when b.key is null then 'kept' else 'enriched' end as state from a full join b on a.key = b.key""")
def kb_upsert_exact(spark, d):
    return R.upsert(table(spark, d, "kb_entities"), table(spark, d, "entities"), "kb_id", "entity_id")


def _own_type(k: str) -> str:
    c, w = (lambda s: f"contains({k}, '{s}')"), (lambda s: S.kw(k, s))
    return f"case when {w('ruta')} then 'Route' when {c('museo de ')} then 'Museum' when {c('centro de interpretacion')} then 'TouristAttractionSite' when {w('festival')} or {w('fiesta')} then 'Event' when {w('mirador')} or {w('miradores')} then 'UrbanViewPoint' when {c('conjunto catedralicio')} then 'TouristAttractionSite' when {c('catedral y su entorno')} or {c('catedral de burgos y su entorno')} then 'Route' else '' end"


_KW_VALUES = ", ".join(f"('{k}', '{t}', {i})" for i, (k, t) in enumerate(dims.TYPE_KEYWORDS))
_INFERRED = f"""kw(w, t, o) as (values {_KW_VALUES}), cx as (select entity_id, name x, 100 p from entities union all select entity_id, title, 40 from evidence where source_type in ('wikipedia', 'wikidata') union all select entity_id, text, case when source_type = 'wikipedia' then 35 else 20 end from evidence where source_type in ('wikipedia', 'wikidata')),
ck as (select entity_id, {S.key('x')} k, p from cx), sc as (select entity_id, t, sum(p) s, min(o) o from ck join kw on contains(' ' || k || ' ', ' ' || w || ' ') group by 1, 2),
bt as (select entity_id, arg_max({{'t': t, 's': s}}, {{'s': s, 'o': -o}}) b from sc group by 1),
inf as (select e.entity_id, case when {_own_type(S.key('name'))} <> '' then {_own_type(S.key('name'))} else coalesce(b.t, '') end t, case when {_own_type(S.key('name'))} <> '' then 110 else coalesce(b.s, 0) end c from entities e left join bt on e.entity_id = bt.entity_id)"""
_ALLOWED = f"list_distinct(list_filter(coalesce(e.types, []), lambda x: x in {S.in_(dims.ALLOWED)}))"
_FIRST_ALLOWED = f"list_filter(coalesce(e.types, []), lambda x: x in {S.in_(dims.ALLOWED)})[1]"


@query(f"""with {_INFERRED} select e.entity_id, inf.t as inferred, cast(c as int) as confidence, case when inf.t <> '' and (c >= 60 or len({_ALLOWED}) = 0 or list_contains({_ALLOWED}, inf.t)) then inf.t else coalesce({_FIRST_ALLOWED}, inf.t) end as type from entities e join inf on e.entity_id = inf.entity_id""")
def keyword_typing(spark, d):
    e, v = table(spark, d, "entities"), table(spark, d, "evidence")
    found = cut(C.inferred(e, v))
    return C.classify(e, v, by_keywords=found).select("entity_id", "type").join(found, "entity_id").select("entity_id", "inferred", "confidence", "type")


@query(f"""with {_INFERRED}, x as (select e.entity_id, case when inf.t <> '' and (c >= 60 or len({_ALLOWED}) = 0 or list_contains({_ALLOWED}, inf.t)) then inf.t else coalesce({_FIRST_ALLOWED}, inf.t) end p, inf.t q, {_ALLOWED} a, c from entities e join inf on e.entity_id = inf.entity_id)
select entity_id, array_to_string(list_sort(list_distinct(list_filter(list_concat([p, q], a), lambda y: y <> ''))), '|') as related, array_to_string(list_sort(case when len(a) > 0 and q <> '' and c >= 90 then [q] when len(a) > 0 then a when q <> '' then [q] else [] end), '|') as normalized from x""")
def related_types(spark, d):
    e, v = table(spark, d, "entities"), table(spark, d, "evidence")
    j = e.select("entity_id", "types").join(C.inferred(e, v), "entity_id")
    own = C.allowed(F.col("types"))
    first = C.primary(own, F.col("inferred"), F.col("confidence"))
    return j.select("entity_id", F.array_join(F.array_sort(C.related(own, first, F.col("inferred"))), "|").alias("related"), F.array_join(F.array_sort(C.normalized(F.col("types"), F.col("inferred"), F.col("confidence"))), "|").alias("normalized"))


_TREE = "o(name, parent) as (values " + ", ".join(f"('{n}', '{p}')" for n, p in dims.ONTOLOGY) + ")"


@query(f"with recursive {_TREE}, s as (select name as root, name, 0 as depth from o where name in {S.in_(dims.ROOTS)} union all select s.root, o.name, s.depth + 1 from s join o on o.parent = s.name) select root, name, min(depth) as depth from s group by 1, 2")
def ontology_subtree(spark, d):
    return G.subtrees(dims.ontology(spark))


@query(f"with recursive {_TREE}, s as (select name from o where name in {S.in_(dims.ROOTS)} union all select o.name from s join o on o.parent = s.name), c as (select name from s union select name from o where name in {S.in_(dims.FACILITIES)}) select type, count(*) as entities, bool_or(c.name is not null) as allowed from entities left join c on type = c.name where {S.t('type')} <> '' group by 1")
def ontology_lookup(spark, d):
    names = F.broadcast(G.classifiable(dims.ontology(spark)).withColumn("known", F.lit(True)))  # a few dozen classes
    t = table(spark, d, "entities").where(T.text(F.col("type")) != "").groupBy("type").agg(F.count("*").alias("entities"))
    return t.join(names, t["type"] == names["name"], "left").select("type", "entities", F.coalesce("known", F.lit(False)).alias("allowed"))


def _match_sql() -> str:
    hits = "len(list_filter(w, lambda x: contains(body, x)))"
    return f"""e as (select entity_id, name, sourceUrl page, {S.key('name')} k, list_filter(string_split({S.key('name')}, ' '), lambda x: length(x) >= 4) w from entities), b as (select block_uid, block_id, url page, {_BODY} body, {S.key('title')} head, length({S.t('text')}) size from content_blocks),
j as (select entity_id, block_uid, block_id, size, {S.words('body')} n, case when contains(body, k) then 100 else 0 end + case when contains(head, k) then 80 else 0 end + case when len(w) > 0 and {hits} >= least(2, len(w)) then {hits} * 10 else 0 end s from e join b on e.page = b.page where k <> ''),
r as (select entity_id, block_uid, block_id, s + case when n <= 120 then 30 when n > 600 then -60 when n > 450 then -40 else 0 end score, size from j where s > 0),
m as (select *, row_number() over (partition by entity_id order by score desc, size, block_uid) as rank from r qualify rank <= 5)"""


@query(f"with {_match_sql()} select entity_id, block_uid, cast(score as int) as score, cast(rank as int) as rank from m")
def block_topk(spark, d):
    return M.block_matches(table(spark, d, "entities"), table(spark, d, "content_blocks"))


@query(f"with {_match_sql()} select e.entity_id, cast(coalesce(m.rank, 1) as int) as rank, coalesce(m.block_id, 'page') as block_id, case when m.rank is null then 'page' else 'page_block' end as source_type from e left join m on e.entity_id = m.entity_id")
def evidence_attach(spark, d):
    return M.attached(table(spark, d, "entities"), table(spark, d, "content_blocks")).select("entity_id", "rank", "block_id", "source_type")


@query(f"""with j as (select v.entity_id, evidence_id, {S.key('v.text')} t, {S.key('e.name')} k from evidence v join entities e on v.entity_id = e.entity_id where {S.t('v.text')} <> ''),
s as (select entity_id, evidence_id, case when k <> '' and contains(t, k) then 100 else 0 end + 10 * len(list_filter(string_split(k, ' '), lambda w: length(w) >= 4 and contains(t, w))) + case when {S.words('t')} <= 120 then 50 when {S.words('t')} <= 250 then 20 when {S.words('t')} > 450 then -60 else 0 end score from j)
select entity_id, arg_max(evidence_id, {{'s': score, 'i': -evidence_id}}) as evidence_id, cast(max(score) as int) as score from s group by 1""")
def best_text(spark, d):
    return M.best_source_text(table(spark, d, "evidence"), table(spark, d, "entities"))


@query(f"""with g as (select entity_key k, entity_id i, coalesce(longDescription, '') x from entities where entity_key is not null) select k as entity_key, arg_max(x, {{'n': length(x), 'i': -i}}) as longest from g group by 1""")
def prefer_longest(spark, d):
    x = T.text(F.col("longDescription"))
    return table(spark, d, "entities").where("entity_key is not null").groupBy("entity_key").agg(F.max_by(x, F.struct(F.length(x), -F.col("entity_id"))).alias("longest"))


def _feat(t: str, i: str, types: str) -> str:
    nk = S.name_key("name", dims.RESOLVE_ARTICLES)
    return f"select {i} id, {S.entity_key()} ek, {nk} nk, list_distinct(list_filter(string_split({nk}, ' '), lambda w: length(w) >= 4 and w not in {S.in_(dims.NAME_STOPWORDS)})) toks, nullif(wikidataId, '') wd, coordinates.lat lat, coordinates.lng lng, {S.key('address')} addr, {types} t0 from {t}"


_LEFT, _RIGHT = _feat("entities", "entity_id", "nullif(types[1], '')"), _feat("kb_entities", "kb_id", "nullif(type, '')")


def _scores(a: str, b: str, x: str) -> str:
    """(a, b, score) of the pairs of two tables of features that can score, as s{x}."""
    return f"""ta{x} as (select id, unnest(toks) t from {a}), tb{x} as (select id, unnest(toks) t from {b}),
c{x} as (select a.id a, b.id b from {a} a join {b} b on a.nk = b.nk where a.nk <> '' union select a.id, b.id from {a} a join {b} b on a.wd = b.wd union select ta{x}.id, tb{x}.id from ta{x} join tb{x} on ta{x}.t = tb{x}.t),
p{x} as (select c.a, c.b, a.wd w1, b.wd w2, a.nk n1, b.nk n2, len(list_intersect(a.toks, b.toks)) sh, least(len(a.toks), len(b.toks)) le, len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks)) un, a.addr a1, b.addr a2, a.t0 t1, b.t0 t2,
  case when a.lat is not null and a.lng is not null and b.lat is not null and b.lng is not null then {S.km('a.lat', 'a.lng', 'b.lat', 'b.lng')} end km from c{x} c join {a} a on c.a = a.id join {b} b on c.b = b.id),
s{x} as (select a, b, round(cast(case when w1 = w2 then 1.0 when w1 is not null and w2 is not null then 0.0 when not (n1 <> '' and n2 <> '' and (n1 = n2 or le >= 2 and sh = le)) then 0.0 when km > 5 then 0.0 else case when km <= 0.15 then 0.55 else 0.0 end + case when a1 <> '' and a1 = a2 then 0.35 else 0.0 end + case when le >= 2 and sh = le then 0.30 when sh > 0 and sh / un >= 0.5 then 0.20 else 0.0 end + case when t1 = t2 then 0.10 else 0.0 end end as double), 6) score from p{x})"""


@query(f"with a as ({_LEFT}), b as ({_RIGHT}), {_scores('a', 'b', '')} select a as entity_id, b as kb_id, score from s where score > 0")
def pair_score(spark, d):
    left = V.features(table(spark, d, "entities"), "entity_id")
    right = V.features(table(spark, d, "kb_entities").withColumn("types", F.array("type")), "kb_id")
    return V.scored_pairs(left, right).select(F.col("a").alias("entity_id"), F.col("b").alias("kb_id"), "score")


@query(f"""with recursive n as materialized ({_LEFT}), k as materialized ({_RIGHT}),
ex as (select n.id, k.hit base from n join (select ek, min(id) hit from k where ek <> '' group by 1) k on n.ek = k.ek), nm as (select n.id, k.hit base from n join (select nk, min(id) hit from k where nk <> '' group by 1) k on n.nk = k.nk where n.wd is not null and n.id not in (select id from ex)),
rest as (select * from n where id not in (select id from ex union all select id from nm)), tw as (select ek, min(id) base from rest group by 1), sm as (select rest.id, tw.base from rest join tw on rest.ek = tw.ek where rest.id <> tw.base), hd as materialized (select * from rest where id not in (select id from sm)),
{_scores('hd', 'k', '1')}, {_scores('hd', 'hd', '2')},
old as materialized (select a id, max({{'score': score, 'old': 1, 'first': -b}}) c from s1 where score >= {V.THRESHOLD} group by 1), inn as materialized (select a id, b earlier, score from s2 where a > b and score >= {V.THRESHOLD}), el as (select id, list(earlier) l from inn group by 1),
hs as materialized (select hd.id, row_number() over (order by hd.id) i, old.id is not null known, coalesce(el.l, []) l from hd left join old on hd.id = old.id left join el on hd.id = el.id),
r as (select cast(0 as bigint) i, cast([] as bigint[]) added union all select hs.i, case when hs.known or list_has_any(r.added, hs.l) then r.added else list_append(r.added, hs.id) end from r join hs on hs.i = r.i + 1), ad as (select unnest(added) id from (select added from r order by i desc limit 1)),
cd as (select id, c from old union all select inn.id, {{'score': score, 'old': 0, 'first': -earlier}} from inn join ad on inn.earlier = ad.id), bc as (select id, max(c) c from cd group by 1)
select id, base, 'exact_key' as tier, cast(1 as double) as score from ex union all select id, base, 'name_key', 1 from nm union all select id, base, 'exact_key', 1 from sm
union all select hs.id, coalesce(-c.first, hs.id), case when c is null then 'added' else 'similar' end, coalesce(c.score, 0) from hs left join bc on hs.id = bc.id""")
def kb_resolve(spark, d):
    """The SQL decides row by row, with the list of those added so far."""
    return V.resolve(table(spark, d, "kb_entities").withColumn("types", F.array("type")), table(spark, d, "entities"), "kb_id", "entity_id")


@query(f"select point_id, city_id, round({S.km('p.lat', 'p.lng', 'c.lat', 'c.lng')}, 6) as km from geo_candidates p, city_centers c where p.lat is not null and p.lng is not null and not isnan(p.lat) and not isnan(p.lng) and p.lat between -90 and 90 and p.lng between -180 and 180 and {S.km('p.lat', 'p.lng', 'c.lat', 'c.lng')} <= radius_km")
def city_range_join(spark, d):
    p = table(spark, d, "geo_candidates").where("lat between -90 and 90 and lng between -180 and 180 and not isnan(lat) and not isnan(lng)")
    return E.near_cities(p, table(spark, d, "city_centers"))


@query(f"""with n as (select point_id, city_id, round({S.km('p.lat', 'p.lng', 'c.lat', 'c.lng')}, 6) km from geo_candidates p, city_centers c where not isnan(p.lat) and not isnan(p.lng) and p.lat between -90 and 90 and p.lng between -180 and 180 and {S.km('p.lat', 'p.lng', 'c.lat', 'c.lng')} <= radius_km)
select point_id, arg_min(city_id, {{'k': km, 'c': city_id}}) as city_id, min(km) as km from n group by 1""")
def nearest_city(spark, d):
    return E.nearest_city(city_range_join(spark, d))


@query("""with c as (select url, count(*) n, arg_max({'a': lat, 'b': lng, 's': source, 'c': confidence}, {'c': coalesce(confidence, -1), 'i': -point_id}) p from geo_candidates where lat between -90 and 90 and lng between -180 and 180 and not isnan(lat) and not isnan(lng) group by 1),
j as (select e.entity_id, case when coordinates.lat is not null and coordinates.lng is not null then {'a': coordinates.lat, 'b': coordinates.lng, 's': coordinates.source, 'c': coordinates.confidence} when p.c >= 0.7 or n = 1 then p end x from entities e left join c on e.sourceUrl = c.url)
select entity_id, x.a as lat, x.b as lng, x.s as source, x.c as confidence from j""")
def coordinate_cascade(spark, d):
    p = table(spark, d, "geo_candidates").where("lat between -90 and 90 and lng between -180 and 180 and not isnan(lat) and not isnan(lng)")
    return E.coordinates(table(spark, d, "entities"), p)


@query(f"""with v as (select *, case when source_type = 'wikidata' then 0 when source_type = 'openstreetmap' then 1 else 2 end r from evidence),
c as (select entity_id, arg_min(coordinates, {{'r': r, 'i': evidence_id}}) filter (where coalesce(coordinates.lat, 0) <> 0 and coalesce(coordinates.lng, 0) <> 0) c, arg_min(regexp_extract(url, '/wiki/(Q\\d+)$', 1), evidence_id) filter (where source_type = 'wikidata' and regexp_extract({S.t('url')}, '/wiki/(Q\\d+)$', 1) <> '') q from v group by 1),
u as (select entity_id, string_agg(url, '|' order by i) x from (select entity_id, url, min(evidence_id) i from evidence where source_type in ('wikidata', 'openstreetmap', 'wikipedia') and {S.t('url')} <> '' group by 1, 2) group by 1)
select e.entity_id, case when coalesce(coordinates.lat, 0) <> 0 and coalesce(coordinates.lng, 0) <> 0 then coordinates.lat else coalesce(c.lat, coordinates.lat) end as lat, coalesce(nullif(wikidataId, ''), q, '') as wikidata, coalesce(x, '') as refs from entities e left join c on e.entity_id = c.entity_id left join u on e.entity_id = u.entity_id""")
def coords_promote(spark, d):
    return X.promoted(table(spark, d, "entities"), table(spark, d, "evidence")).select("entity_id", "lat", F.col("wikidataId").alias("wikidata"), F.array_join("referenceUrls", "|").alias("refs"))


@query(f"""with t as (select entity_id, unnest([longDescription, description, shortDescription, sourceText, evidence]) x, generate_subscripts([longDescription, description, shortDescription, sourceText, evidence], 1) - 1 p from entities union all select entity_id, text, evidence_id + 10 from evidence where source_type in ('wikidata', 'wikipedia')),
c as (select entity_id, {S.clean_content('x')} x, p from t), b as (select entity_id, arg_max(x, {{'n': length(x), 'p': -p}}) x from c where x <> '' group by 1) select e.entity_id, coalesce(x, '') as summary from entities e left join b on e.entity_id = b.entity_id""")
def summary_longest(spark, d):
    return X.summary(table(spark, d, "entities"), table(spark, d, "evidence"))


@query(f"""select entity_id, name, coalesce(len(types), 0) as n_types, case when coordinates.lat is not null and (coordinates.confidence is null or coordinates.confidence >= 0.3) then coordinates.lat end as lat from entities""")
def clean_projection(spark, d):
    return X.clean(table(spark, d, "entities")).select("entity_id", "name", F.coalesce(F.size("types"), F.lit(0)).cast("bigint").alias("n_types"), F.col("coordinates.lat").alias("lat"))


@query("""select entity_id, name, type, score, sourceUrl, url, address, phone, email, wikidataId, classificationEvidence.selected as selected, coalesce(array_to_string(relatedUrls, '|'), '') as related, coalesce(array_to_string(images, '|'), '') as images from entities""")
def golden_projection(spark, d):
    g = X.golden(table(spark, d, "entities"))
    return g.select("entity_id", "name", "type", "score", "sourceUrl", "url", "address", "phone", "email", "wikidataId", F.col("classificationEvidence.selected").alias("selected"), F.coalesce(F.array_join("relatedUrls", "|"), F.lit("")).alias("related"), F.coalesce(F.array_join("images", "|"), F.lit("")).alias("images"))


@query("""select p.page_id, p.url, title, language, status, coalesce(len(images), 0) as image_count, coalesce(len(errors), 0) as error_count, coalesce(b.n, 0) as block_count, coalesce(g.n, 0) as geo_candidates_count from crawl_pages p left join (select page_id, count(*) n from content_blocks group by 1) b on p.page_id = b.page_id left join (select url, count(*) n from geo_candidates group by 1) g on p.url = g.url""")
def page_summary(spark, d):
    return X.page_summary(table(spark, d, "crawl_pages"), table(spark, d, "content_blocks"), table(spark, d, "geo_candidates"))


@query(f"""with t as (select * from entities where {S.t('type')} <> ''), i as (select entity_id, 0 o, unnest(images) v, generate_subscripts(images, 1) p from t union all select entity_id, evidence_id, unnest(images), generate_subscripts(images, 1) from evidence where entity_id in (select entity_id from t)),
f as (select entity_id, v, min({{'o': o, 'p': p}}) m from i where {S.t('v')} <> '' group by 1, 2), g as (select entity_id, array_to_string(list_slice(list(v order by m), 1, 10), '|') x from f group by 1)
select t.entity_id, name, type, coalesce(x, '') as images from t left join g on t.entity_id = g.entity_id""")
def flat_projection(spark, d):
    return X.flat(table(spark, d, "entities"), table(spark, d, "evidence")).select("entity_id", "name", "type", F.array_join("images", "|").alias("images"))


_B = lambda label, body: f"'**{label}:** ' || {body} || '  ' || chr(10)"
_OTHERS = f"array_to_string(list_filter(types, lambda x: coalesce(x, '') <> '' and x is distinct from {_PRIMARY}), ', ')"
_COORDS = "cast(coordinates.lat as varchar) || ', ' || cast(coordinates.lng as varchar) || coalesce(printf(' *(confianza: %.2f)*', coordinates.confidence), '')"


@query(f"""select entity_id, '### ' || coalesce(nullif(name, ''), 'Sin nombre') || chr(10) || chr(10) || {_B('Tipo', f"coalesce({_PRIMARY}, '-')")} || coalesce(case when {_OTHERS} <> '' then {_B('Tipos relacionados', _OTHERS)} end, '')
 || coalesce(case when trim({S.t('shortDescription')}) <> '' then {_B('Descripcion', "substr(trim(shortDescription), 1, 300)")} end, '') || coalesce(case when coordinates.lat is not null and coordinates.lng is not null then {_B('Coordenadas', _COORDS)} end, '')
 || coalesce(case when trim({S.t('address')}) <> '' then {_B('Direccion', 'trim(address)')} end, '') || coalesce(case when len(images) > 0 then {_B('Imagenes', 'cast(len(images) as varchar)')} end, '') || coalesce(case when v.n > 0 then {_B('Fuentes', "cast(v.n as varchar) || ' evidencias' || case when v.p = 1 then ' - 1 pagina' when v.p > 1 then ' - ' || v.p || ' paginas' else '' end")} end, '') || coalesce(case when trim({S.t('wikidataId')}) <> '' then {_B('Wikidata', 'trim(wikidataId)')} end, '') || chr(10) || '---' || chr(10) as card
 from entities e left join (select entity_id i, count(*) n, count(distinct nullif({_PAGE}, '')) p from evidence group by 1) v on e.entity_id = v.i""")
def markdown_report(spark, d):
    return A.markdown_cards(table(spark, d, "entities"), table(spark, d, "evidence"))


@query(f"""with c as (select {_PRIMARY} t, count(*) n, min(entity_id) f from entities where {S.t(_PRIMARY)} <> '' group by 1), p as (select {_PAGE} t, count(distinct entity_id) n from evidence where {_PAGE} <> '' and entity_id is not null group by 1)
select 'type' as part, cast(row_number() over (order by n desc, f) as int) as pos, '| ' || t || ' | ' || n || ' |' as line from c union all select 'page', cast(dense_rank() over (order by n desc, t) as int), '| ' || t || ' | ' || n || ' |' from p union all select 'head', 1, '*Generado: 2026-01-01 - ' || (select count(distinct url) from crawl_pages where status = 'ok') || ' paginas procesadas - ' || (select count(*) from entities) || ' entidades*'""")
def markdown_tables(spark, d):
    return A.markdown_tables(table(spark, d, "entities"), table(spark, d, "evidence").where("entity_id is not null"), table(spark, d, "crawl_pages"), "2026-01-01")


_SCHEMA = [("Museum", "createMuseum", ["name", "hasDescription"]), ("Church", "createChurch", ["name", "hasLocation"]), ("Event", "createEvent", ["name", "startsAt"]), ("TourismEntity", "createTourismEntity", ["name"])]


@query(f"""with a as (select *, list_filter(list_transform(list_concat([type, classificationEvidence.selected], coalesce(types, [])), lambda x: regexp_replace(coalesce(x, ''), '[^A-Za-z0-9]', '', 'g')), lambda x: x in ('Museum', 'Church', 'Event', 'TourismEntity')) w from entities where {S.t('name')} <> ''), b as (select *, coalesce(w[1], 'TourismEntity') c from a)
select entity_id, c as class_name, 'create' || c as mutation, 'kb:' || lower(c) || ':' || coalesce(nullif({S.slug('name')}, ''), 'entity') || ':' || substr(sha1(c || '|' || name || '|' || {S.first_filled('wikidataId', 'sourceUrl', 'url', 'name')}), 1, 12) as external_id,
 cast(len(w) = 0 as int) + cast({S.t('shortDescription')} = '' and {S.t('description')} = '' and {S.t('sourceText')} = '' as int) + cast(c = 'Church' and {S.t('address')} = '' and not (coordinates.lat is not null and coordinates.lng is not null) as int) + cast(c = 'Event' and {S.t('startDate')} = '' as int) as warnings from b""")
def graphql_payload(spark, d):
    schema = spark.createDataFrame(_SCHEMA, "class string, mutation string, required array<string>")
    p = X.graph_payloads(table(spark, d, "entities"), schema)
    return p.select("entity_id", F.col("className").alias("class_name"), "mutation", F.col("externalId").alias("external_id"), F.size("warnings").alias("warnings"))


def _image_sql(u: str, k: str) -> dict[str, str]:
    """How an image fits a name, by expressions of its url and the name's key."""
    h = S.key(S.path(_unq(u)))
    own = f"list_distinct(list_filter(string_split({k}, ' '), lambda w: length(w) >= 4 and w not in {S.in_(dims.IMAGE_STOPWORDS)}))"
    hits = f"len(list_filter({own}, lambda w: contains({h}, w)))"
    more = f"({hits} + case when len({own}) = 0 and not contains({k}, ' ') and contains({h}, {k}) then 1 else 0 end)"
    url = f"case when {h} = '' or {k} = '' then 0 when contains(replace({h}, ' ', ''), replace({k}, ' ', '')) then 100 when len({own}) <= 1 and {more} > 0 then 50 when len({own}) > 1 and {more} >= 2 then 40 + {more} else 0 end"
    text_hits = lambda t: f"len(list_filter({own}, lambda w: contains({t}, w)))"
    alt = lambda t: f"case when {t} = '' or {k} = '' then 0 when contains({t}, {k}) then 95 when len({own}) = 0 then 0 when {text_hits(t)} >= least(2, len({own})) then 35 + {text_hits(t)} else 0 end"
    generic = f"len(list_intersect(string_split({h}, ' '), {S.listed(dims.GENERIC_TOKENS)})) > 0"
    slug = f"len(list_filter(list_distinct(string_split({k}, ' ')), lambda w: length(w) >= 4 and contains({h}, w)))"
    return {"url": url, "alt": alt, "context": lambda t: f"case when {S.words(t)} > 200 then 0 else {text_hits(t)} end", "generic": generic, "slug": slug}


_IS = _image_sql("u", "nk")
_QUIET = _NOISE_IMG.replace("string_split(k, ' ')", "string_split(ik, ' ')").replace("replace(k, ' ', '')", "replace(ik, ' ', '')")
_IMAGE_LEVELS = rf"""e as (select entity_id, sourceUrl page, {S.key('name')} nk, count(*) over (partition by sourceUrl) = 1 alone from entities),
i0 as (select url page, unnest(images) i from crawl_pages), i1 as (select page, i.url u, min({{'x': coalesce(try_cast(nullif(i.index, '') as int), 999999), 'a': i.alt, 'c': i.context}}) m from i0 where {S.t('i.url')} <> '' group by 1, 2),
i as (select page, u, m.x idx, {S.key('m.a')} ak, {S.key('m.c')} ck, {S.key(f"lower({S.path(_unq('u'))}) || '  '")} ik from i1),
j as (select entity_id, u, idx, alone, nk, greatest({_IS['url']}, {_IS['alt']('ak')}) dir, greatest({_IS['alt']('ak')}, {_IS['context']('ck')}) aro, not {_QUIET} quiet from e join i on e.page = i.page where not {_IS['generic']}),
l as (select *, case when nk <> '' and dir > 0 then 1 when nk <> '' and quiet and aro > 0 then 2 when alone and quiet then 3 end lv from j),
f as (select *, case lv when 1 then dir when 2 then aro else 0 end sc, min(lv) over (partition by entity_id) best from l where lv is not null),
top as (select entity_id, u as image, cast(lv as int) as level, cast(sc as int) as score, cast(row_number() over (partition by entity_id order by sc desc, idx, u) as int) as rank from f where lv = best)"""


@query(f"with {_IMAGE_LEVELS} select * from top")
def image_topk(spark, d):
    pages = table(spark, d, "crawl_pages")
    return M.image_matches(table(spark, d, "entities"), M.page_images(pages))


@query(rf"""with e as (select entity_id, {S.key('name')} nk, images from entities), i as (select entity_id, nk, unnest(images) u, generate_subscripts(images, 1) p from e), d as (select entity_id, nk, u, min(p) p from i where {S.t('u')} <> '' group by all),
k as (select *, {S.key(f"lower({S.path(_unq('u'))}) || '  '")} ik from d), g as (select entity_id, u, p, {_IS['slug']} s from k where not {_QUIET} and ({S.domain('u')} in {S.in_(dims.TRUSTED_HOSTS)} or ({_IS['url']}) > 0 and not {_IS['generic']})),
o as (select entity_id, array_to_string(list_slice(list(u order by s desc, p), 1, 10), '|') x from g group by 1) select e.entity_id, coalesce(x, '') as images from e left join o on e.entity_id = o.entity_id""")
def image_sanitize(spark, d):
    from ..functions.images import cleaned

    e = table(spark, d, "entities")
    return e.select("entity_id", F.array_join(cleaned(F.coalesce("images", F.array().cast("array<string>")), T.key(F.col("name"))), "|").alias("images"))


@query(f"with {_IMAGE_LEVELS} select entity_id, image, rank, cast(floor((rank - 1) / 8.0) as int) as batch from top where rank <= 5")
def vision_pairs(spark, d):
    return M.vision_pairs(image_topk(spark, d))


@query(f"""with v as (select distinct e.wikidataId w, x.url, {S.t('x.title')} title from evidence x join entities e on x.entity_id = e.entity_id where source_type = 'wikipedia' and {S.t('e.wikidataId')} <> '')
select e.entity_id, v.url, v.title from entities e join v on v.w = e.wikidataId where not exists (select 1 from evidence x where x.entity_id = e.entity_id and x.url = v.url and x.block_id = e.name and x.source_type = 'wikipedia')""")
def external_evidence(spark, d):
    """What encyclopedias say of an entity goes to all entities of its identifier."""
    e, v = table(spark, d, "entities"), table(spark, d, "evidence")
    own = v.where("source_type = 'wikipedia'").join(e.select("entity_id", "wikidataId"), "entity_id").where(T.text(F.col("wikidataId")) != "")
    summaries = own.select("wikidataId", "source_type", "url", T.text(F.col("title")).alias("title"), F.lit("").alias("text")).distinct()
    return E.external_evidence(e, v, summaries).select("entity_id", "url", "title")


@query(rf"""with recursive e as (select distinct sourceUrl p, unnest(relatedUrls) l from entities), g as (select p, l from e where regexp_replace(lower(regexp_extract(p, '//([^/?#:]+)', 1)), '^www\.', '') = regexp_replace(lower(regexp_extract(l, '//([^/?#:]+)', 1)), '^www\.', '')),
s as (select min(url) u from crawl_pages where status = 'ok' group by site), r as (select u, 0 d from s union select g.l, r.d + 1 from r join g on g.p = r.u where r.d < 30) select u as url, min(d) as depth from r group by 1""")
def site_bfs(spark, d):
    e = table(spark, d, "entities").select(F.col("sourceUrl").alias("page"), F.explode("relatedUrls").alias("link")).where(site(F.col("page")) == site(F.col("link")))
    seeds = table(spark, d, "crawl_pages").where("status = 'ok'").groupBy("site").agg(F.min("url").alias("url"))
    return G.crawl_order(e, seeds).select("url", "depth")


_KWT = "kw(w, t, o) as (values " + _KW_VALUES + ")"


@query(rf"""with {_KWT}, a as (select page_id, url, trim({S.t('title')}) t from crawl_pages),
b as (select page_id, case when contains(t, ' | ') and trim(split_part(t, ' | ', 1)) <> '' then trim(split_part(t, ' | ', 1)) when contains(t, ' - ') and trim(split_part(t, ' - ', 1)) <> '' then trim(split_part(t, ' - ', 1))
 when contains(t, ' – ') and trim(split_part(t, ' – ', 1)) <> '' then trim(split_part(t, ' – ', 1)) when contains(t, ' — ') and trim(split_part(t, ' — ', 1)) <> '' then trim(split_part(t, ' — ', 1)) else t end as name from a),
c as (select page_id, name, {S.key('name')} k from b), h as (select page_id, t, count(*) n, min(o) o from c join kw on contains(' ' || k || ' ', ' ' || w || ' ') group by 1, 2), w as (select page_id, arg_max(t, {{'n': n, 'o': -o}}) t from h group by 1)
select c.page_id, name, coalesce(nullif({_own_type('k')}, ''), w.t) as type, '' as start, '' as "end" from c left join w on c.page_id = w.page_id where k <> '' and k not in {S.in_(dims.NAVIGATION_NAMES)} and ({_own_type('k')} <> '' or w.t is not null)""")
def title_entities(spark, d):
    return H.title_entities(table(spark, d, "crawl_pages"), F.lit("2026-06-01").cast("date"))


_DATED = r"^\s*\d{1,2}\s+de\s+[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+\s+de\s+\d{4}\s+(.+?)\s+(?:Con|En|El|La|Los|Las|Una|Un|Del|Durante|Toda|Descarga|DESCARGA|Burgos Film Commission)\s"
_CHUNK = r"\b\d{1,2}\s+de\s+[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+\s+de\s+\d{4}\b"


@query(rf"""with a as (select block_uid, text, {S.clean_name('title')} h, {S.clean_name(f"regexp_extract({S.t('text')}, '{_DATED}', 1)")} dt from content_blocks),
b as (select *, case when h <> '' and {S.key('h')} not in {S.in_(dims.NAVIGATION_NAMES)} then h when dt <> '' and {S.words(S.key('dt'))} between 2 and 12 then dt else '' end as name from a)
select block_uid, name from b where name <> ''""")
def block_entities(spark, d):
    return H.block_names(table(spark, d, "content_blocks")).select("block_uid", "name")


@query("select p.page_id, coalesce(trim(regexp_replace(p.title, '\\s+', ' ', 'g')), '') as title, coalesce(p.language, '') as language, cast(count(b.block_uid) as bigint) as articles from crawl_pages p left join content_blocks b on p.page_id = b.page_id and b.kind <> 'page' group by 1, 2, 3")
def html_parse(spark, d):
    """Pages are written as HTML, with a block an article, and read back."""
    esc = lambda c: F.replace(F.replace(F.replace(T.text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    b = table(spark, d, "content_blocks").where("kind <> 'page'").groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "block_uid", esc(F.col("title")).alias("t"), esc(F.col("text")).alias("x")))), lambda z: F.concat(F.lit("<article><h2>"), z["t"], F.lit("</h2><p>"), z["x"], F.lit("</p></article>"))), "").alias("body"))
    p = table(spark, d, "crawl_pages").join(b, "page_id", "left")
    html = F.concat(F.lit('<html lang="'), esc(F.col("language")), F.lit('"><head><title>'), esc(F.col("title")), F.lit("</title></head><body><nav><a href='/x'>x</a></nav>"), T.text(F.col("body")), F.lit("</body></html>"))
    parsed = H.parse(p.select(F.col("page_id").cast("string").alias("url"), html.alias("html")))
    return parsed.select(F.col("url").cast("bigint").alias("page_id"), "title", "language", F.size("blocks").cast("bigint").alias("articles"))


@query(f"""with v as (select e.evidence_id, e.entity_id, e.source_type, e.url, e.metadata from evidence e where entity_id in (select entity_id from entities)),
g as (select entity_id, arg_min(metadata.address, evidence_id) filter (where {S.t('metadata.address')} <> '') a, arg_min(metadata.phone, evidence_id) filter (where {S.t('metadata.phone')} <> '') p from v group by 1),
u as (select entity_id, url, min(evidence_id) i from v where source_type not in ('page', 'page_block') and {S.t('url')} <> '' group by 1, 2),
r as (select entity_id, unnest(relatedUrls) url, generate_subscripts(relatedUrls, 1) - 1000000 i from entities union all select entity_id, url, i from u), d as (select entity_id, url, min(i) i from r where {S.t('url')} <> '' group by 1, 2),
x as (select entity_id, string_agg(url, '|' order by i) x from d group by 1)
select e.entity_id, coalesce(x, '') as related, coalesce(nullif(e.address, ''), a, '') as address, coalesce(nullif(e.phone, ''), p, '') as phone from entities e left join g on e.entity_id = g.entity_id left join x on e.entity_id = x.entity_id""")
def consolidate_evidence(spark, d):
    from ..operators.consolidate import consolidated

    return consolidated(table(spark, d, "entities"), table(spark, d, "evidence")).select("entity_id", F.array_join("relatedUrls", "|").alias("related"), "address", "phone")


@query(f"""select entity_id, {S.clean_name('name')} as name, case when {S.t('address')} <> '' and {S.words(S.compact('address'))} <= 10 and length(address) <= 120 then address else '' end as address,
 case when {S.clean_content('shortDescription')} <> '' then {S.clean_content('shortDescription')} else substr({S.clean_content('description')}, 1, 300) end as short, case when {S.clean_content('longDescription')} <> '' then {S.clean_content('longDescription')} else {S.clean_content('description')} end as long from entities""")
def normalize_entities(spark, d):
    from ..operators.consolidate import normalized

    return normalized(table(spark, d, "entities")).select("entity_id", "name", "address", F.col("shortDescription").alias("short"), F.col("longDescription").alias("long"))


@query(f"select evidence_id, coalesce(nullif(e.page_url, ''), url) as page_url from evidence e")
def stamp_pages(spark, d):
    return X.stamped(table(spark, d, "evidence"), F.col("url")).select("evidence_id", "page_url")


@query(f"""with b as (select *, row_number() over (partition by page_id order by position, block_uid) n from content_blocks where kind <> 'page' and ({S.t('title')} <> '' or len(images) > 0) qualify n <= 15), g as (select page_id, count(*) n, arg_min({S.t('title')}, n) t, sum(length(substr({S.t('text')}, 1, 400))) c, sum(least(len(coalesce(images, [])), 4)) i from b group by 1),
w as (select page_id, arg_min(text, block_uid) filter (where text is not null) x, arg_min(coalesce(text, chr(1)), block_uid) y from content_blocks where kind = 'page' group by 1)
select p.page_id, {S.t('p.title')} as title, {S.t('p.language')} as language, least(len(coalesce(p.images, [])), 25) as images, coalesce({S.t('p.images[1].context')}, '') as context, substr(case when y = chr(1) then '' else coalesce(y, '') end, 1, 10000) as text, coalesce(g.n, 0) as blocks, g.t as first_block, cast(coalesce(g.c, 0) as bigint) as block_text, cast(coalesce(g.i, 0) as bigint) as block_images, {len(dims.ALLOWED)} as types
from crawl_pages p left join g on p.page_id = g.page_id left join w on p.page_id = w.page_id""")
def page_prompts(spark, d):
    """The prompts, read back."""
    part = "struct<title:string,language:string,images:array<struct<url:string,alt:string,context:string,index:string>>,text:string,blocks:array<struct<id:string,title:string,text:string,images:array<struct<url:string,alt:string>>>>>"
    p = X.prompts(table(spark, d, "crawl_pages"), table(spark, d, "content_blocks")).withColumn("x", F.from_json("prompt", f"struct<task:string,rules:array<string>,tourist_types:array<string>,page:{part}>"))
    sizes = lambda f: F.aggregate(F.transform("x.page.blocks", f), F.lit(0), lambda a, b: a + b).cast("bigint")
    return p.select(
        "page_id", "x.page.title", "x.page.language", F.size("x.page.images").alias("images"), T.text(F.get("x.page.images", F.lit(0))["context"]).alias("context"), "x.page.text", F.size("x.page.blocks").alias("blocks"), F.get("x.page.blocks", F.lit(0))["title"].alias("first_block"),
        sizes(lambda b: F.length(b["text"])).alias("block_text"), sizes(lambda b: F.size(b["images"])).alias("block_images"), F.size("x.tourist_types").alias("types"),
    )


@query(f"select site, coalesce(nullif({S.compact('title')}, ''), '(sin título)') as title, strftime(fetched_at, '%Y-%m-%d') as published, {S.compact('url')} as url from crawl_pages where title <> '' and fetched_at >= timestamp '2024-01-01'")
def rss_cutoff(spark, d):
    """Pages are written as feeds, an item a page, and read back with a cutoff."""
    from ..sources.formats import articles

    p = table(spark, d, "crawl_pages").where("title <> ''")
    item = F.concat(F.lit("<item><title>"), escaped(F.col("title")), F.lit("</title><link>"), escaped(F.col("url")), F.lit("</link><pubDate>"), F.date_format("fetched_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item>"))
    # A feed has the pages of a site whose ids are near each other.
    feeds = p.select("site", F.floor(F.col("page_id") / 5000).alias("part"), item.alias("x")).groupBy("site", "part").agg(F.concat(F.lit("<rss>"), F.array_join(F.collect_list("x"), ""), F.lit("</rss>")).alias("xml"))
    return articles(feeds, since="2024-01-01", source="site").select("site", "title", "published", "url")
