"""Queries of text, URL, date, predicate and image columns over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import dates, geo, images as I, predicates as P, text as T, urls as U
from ..sources.tables import table
from . import sql as S
from .core import query


@query(f"select entity_id, {S.key('name')} as name_key, {S.plain('name')} as plain_name, {S.ascii_('name')} as ascii_name, {S.key('address')} as address_key from entities")
def key_normalize(spark, d):
    n, a = F.col("name"), F.col("address")
    return table(spark, d, "entities").select("entity_id", T.key(n).alias("name_key"), T.plain(n).alias("plain_name"), T.ascii_fold(n).alias("ascii_name"), T.key(a).alias("address_key"))


@query(f"select block_uid, {S.clean_content('text')} as clean_text, {S.is_boilerplate('text')} as boilerplate from content_blocks")
def clean_content(spark, d):
    return table(spark, d, "content_blocks").select("block_uid", T.clean_content(F.col("text")).alias("clean_text"), T.is_boilerplate(F.col("text")).alias("boilerplate"))


@query(f"select entity_id, {S.clean_name('name')} as clean_name, {S.name_key('name')} as merge_key, {S.name_key('name', dims.RESOLVE_ARTICLES)} as resolve_key from entities")
def name_clean(spark, d):
    n = F.col("name")
    return table(spark, d, "entities").select("entity_id", T.clean_name(n).alias("clean_name"), T.strip_articles(T.key(n)).alias("merge_key"), T.strip_articles(T.key(n), dims.RESOLVE_ARTICLES).alias("resolve_key"))


@query(f"""with a as (select page_id, trim({S.t('title')}) t from crawl_pages)
select page_id, case when contains(t, ' | ') and trim(split_part(t, ' | ', 1)) <> '' then trim(split_part(t, ' | ', 1)) when contains(t, ' - ') and trim(split_part(t, ' - ', 1)) <> '' then trim(split_part(t, ' - ', 1))
 when contains(t, ' – ') and trim(split_part(t, ' – ', 1)) <> '' then trim(split_part(t, ' – ', 1)) when contains(t, ' — ') and trim(split_part(t, ' — ', 1)) <> '' then trim(split_part(t, ' — ', 1)) else t end as name from a""")
def title_names(spark, d):
    return table(spark, d, "crawl_pages").select("page_id", T.first_title_segment(F.col("title")).alias("name"))


@query(f"""with k as (select entity_id, list_filter(string_split({S.key('name')}, ' '), lambda w: length(w) >= 4 and w not in {S.in_(dims.NAME_STOPWORDS)}) w from entities)
select entity_id, array_to_string(list_sort(list_distinct(w)), ' ') as tokens, len(list_distinct(w)) as n from k""")
def significant_tokens(spark, d):
    s = T.significant(T.key(F.col("name")))
    return table(spark, d, "entities").select("entity_id", F.array_join(F.array_sort(s), " ").alias("tokens"), F.size(s).cast("bigint").alias("n"))


_PHONE = r"(?:^|[^0-9])((?:\+34\s*)?(?:[0-9][\s.\-]?){9})(?:[^0-9]|$)"


@query(rf"""with m as (select evidence_id, regexp_extract_all({S.t('text')}, '{_PHONE}', 1) p from evidence),
g as (select evidence_id, list_filter(p, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) = 9 or length(regexp_replace(x, '[^0-9]', '', 'g')) = 11 and starts_with(regexp_replace(x, '[^0-9]', '', 'g'), '34')) p from m)
select evidence_id, coalesce(trim({S.compact('p[1]')}, ' .,:;'), '') as phone from g""")
def phone_extract(spark, d):
    return table(spark, d, "evidence").select("evidence_id", T.phone(F.col("text")).alias("phone"))


def _address_sql() -> str:
    end = T._ADDRESS_END.replace("(?iu)", "(?i)")
    bad = T._NARRATIVE.replace("(?iu)", "(?i)")
    return rf"""with s as (select evidence_id, {S.compact('text')} x from evidence),
m as (select evidence_id, list_filter(string_split(regexp_replace(x, '([.;])\s+', e'\\1\x01', 'g'), e'\x01'), lambda s: regexp_matches(s, '(?i)avenida|avda|calle|carretera|c/|paseo|plaza')) s from s),
f as (select evidence_id, list_transform(s, lambda z: trim(trim(regexp_extract(z, '(?i)((?:C/|calle|plaza|avenida|avda\.?|paseo|carretera)\s+[^.;]{{3,120}})', 1), ' ,.;'))) a from m),
g as (select evidence_id, list_transform(a, lambda z: trim(split_part(regexp_replace(z, '{end}', e'\x01'), e'\x01', 1), ' ,.;:-')) a from f)
select evidence_id, coalesce(list_filter(a, lambda z: z <> '' and length(z) <= 90 and len(string_split(z, ' ')) <= 14 and not regexp_matches(z, '{bad}') and lower(z) not in ('calle', 'plaza', 'paseo', 'avenida', 'carretera', 'c/'))[1], '') as address from g"""


@query(_address_sql())
def address_extract(spark, d):
    return table(spark, d, "evidence").select("evidence_id", T.address(F.col("text")).alias("address"))


@query(rf"""select entity_id, {S.t('address')} <> '' and {S.words(S.compact('address'))} <= 10 and length(address) <= 120 as valid_address,
  {S.t('address')} <> '' and ({S.words(S.compact('address'))} > 12 or length(address) > 120) as suspect_address from entities""")
def address_checks(spark, d):
    a = F.col("address")
    return table(spark, d, "entities").select("entity_id", T.valid_address(a).alias("valid_address"), P.suspect_address(a).alias("suspect_address"))


def _dates_sql() -> str:
    w = r"[\p{L}\p{N}_]+"
    lab = lambda k: rf"(?i)fecha\s+de\s+{k}\s*:\s*(?:{w},\s*)?(\d{{1,2}})\s+de\s+({w})[,\s]+(\d{{4}})\s*[-–]\s*(\d{{1,2}}:\d{{2}})"
    rng = rf"(?i)del?\s+(\d{{1,2}})\s+de\s+({w})\s+al?\s+(\d{{1,2}})\s+de\s+({w})(?:\s+de\s+(\d{{4}}))?"
    one = rf"(?i)\b(\d{{1,2}})\s+de\s+({w})\s+de\s+(\d{{4}})\b"
    iso_re = r"\b(\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2})?)?)\b"
    months = S.listed(dims.MONTHS)
    mon = lambda x: f"nullif(coalesce(list_position({months}, lower({x})), 0), 0)"
    iso = lambda dd, m, y, tm="'00:00'": f"case when {mon(m)} is not null then lpad({y}, 4, '0') || '-' || lpad(cast({mon(m)} as varchar), 2, '0') || '-' || lpad(cast(cast({dd} as int) as varchar), 2, '0') || 'T' || {tm} || ':00' end"
    x = lambda p, g: f"regexp_extract(t, '{p}', {g})"
    has = lambda p: f"regexp_matches(t, '{p}')"
    return rf"""with a as (select doc_id, {S.t('text')} t from documents),
b as (select doc_id, t, case when {has(lab('inicio'))} then {iso(f'nullif({x(lab("inicio"), 1)}, $$$$)', x(lab('inicio'), 2), x(lab('inicio'), 3), x(lab('inicio'), 4))} end s0,
  case when {has(lab('fin'))} then {iso(f'nullif({x(lab("fin"), 1)}, $$$$)', x(lab('fin'), 2), x(lab('fin'), 3), x(lab('fin'), 4))} end e0, regexp_extract_all(t, '{iso_re}', 1) i,
  {has(rng)} r, {x(rng, 1)} d1, {x(rng, 2)} m1, {x(rng, 3)} d2, {x(rng, 4)} m2, {x(rng, 5)} y, regexp_extract(regexp_extract(t, '(?s)^(.*?){rng[4:]}', 1), '\b(20\d{{2}})\b', 1) yb,
  case when {has(one)} then {iso(f'nullif({x(one, 1)}, $$$$)', x(one, 2), x(one, 3))} end s1 from a),
c as (select *, case when try_cast('2026-' || lpad(cast(coalesce({mon('m1')}, 1) as varchar), 2, '0') || '-' || lpad(nullif(d1, ''), 2, '0') as date) < date '2026-06-01' then '2027'
  when try_cast('2026-' || lpad(cast(coalesce({mon('m1')}, 1) as varchar), 2, '0') || '-' || lpad(nullif(d1, ''), 2, '0') as date) is not null then '2026' end g from b),
e as (select *, coalesce(nullif(y, ''), nullif(yb, ''), g) yy from c)
select doc_id, case when s0 is not null or e0 is not null then coalesce(s0, '') when len(i) > 0 then i[1] when r and {mon('m1')} is not null and {mon('m2')} is not null then coalesce({iso("nullif(d1, '')", 'm1', 'yy')}, '') else coalesce(s1, '') end as start_date,
  case when s0 is not null or e0 is not null then coalesce(e0, s0) when len(i) > 0 then coalesce(i[2], i[1]) when r and {mon('m1')} is not null and {mon('m2')} is not null then coalesce({iso("nullif(d2, '')", 'm2', 'yy')}, '') else coalesce(s1, '') end as end_date from e"""


@query(_dates_sql())
def event_dates(spark, d):
    e = dates.event_dates(F.col("text"), F.lit("2026-06-01").cast("date"))
    return table(spark, d, "documents").select("doc_id", e["start"].alias("start_date"), e["end"].alias("end_date"))


@query(rf"""select entity_id, {S.slug('name')} as slug, regexp_replace({S.t('type')}, '[^A-Za-z0-9]', '', 'g') as class_name,
 'kb:' || lower(regexp_replace({S.t('type')}, '[^A-Za-z0-9]', '', 'g')) || ':' || coalesce(nullif({S.slug('name')}, ''), 'entity') || ':' || substr(sha1(regexp_replace({S.t('type')}, '[^A-Za-z0-9]', '', 'g') || '|' || {S.t('name')} || '|' || {S.first_filled('wikidataId', 'sourceUrl', 'url', 'name', "' '")}), 1, 12) as external_id from entities""")
def slug_external_id(spark, d):
    cls = T.class_name(F.col("type"))
    source = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("wikidataId", "sourceUrl", "url", "name")], F.lit(" "))
    return table(spark, d, "entities").select("entity_id", T.slug(F.col("name")).alias("slug"), cls.alias("class_name"), T.external_id(F.lit("kb"), cls, F.col("name"), source).alias("external_id"))


@query(rf"""select page_id, case when regexp_matches(url, '(?i)^https?:') then case when length(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*(/.*)?$', 1)) > 1 then regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') else regexp_replace(url, '[?#].*$', '') end end as normal,
 {S.domain('url')} as domain, array_to_string(list_slice(string_split({S.domain('url')}, '.'), -2, -1), '.') as root_domain,
 len(list_intersect({S.segments('lower(url)')}, {S.listed(dims.SKIP_SEGMENTS)})) > 0 or regexp_matches({S.path('lower(url)')}, '\.(?:{'|'.join(dims.SKIP_EXTENSIONS)})$') as skipped,
 lower({S.segments('url')}[1]) in {S.in_(dims.LANGUAGES)} and lower({S.segments('url')}[1]) <> 'es' as other_language, len(list_intersect({S.segments('url')}, {S.listed(dims.LISTING_SEGMENTS)})) > 0 as listing from crawl_pages""")
def url_normalize(spark, d):
    u = F.col("url")
    return table(spark, d, "crawl_pages").select("page_id", U.normalize(u).alias("normal"), U.domain(u).alias("domain"), U.root_domain(u).alias("root_domain"), U.skipped(u).alias("skipped"), U.foreign_language(u, "es").alias("other_language"), U.listing(u).alias("listing"))


def _editorial_sql(name: str, url: str, types: str) -> str:
    k, p = S.key(name), S.plain(name)
    r = lambda c, x: f"regexp_matches({c}, '{x}')"
    event = f"coalesce(list_contains({S.segments(url)}, 'evento') and list_contains({types}, 'Event') and {S.words(k)} <= 8 and not contains({p}, ':'), false)"
    marks = " or ".join((r(k, r"^\d{1,2} (?:consejos?|razones?|tips?|ideas?|secretos?)\b"), f"{S.words(k)} > 14", f"contains(' ' || {k} || ' ', ' se encuentra ')", r(p, r"\.\s+.{0,100}\b(?:domingos?|sabados?|lunes|martes|miercoles|jueves|viernes|euros?)\b"), r(p, r",\s+(?:el|la)\s+\w+.+\b(?:mas|mejor|unico|primero|antigua?|famoso|dedicad)"), r(p, r":\s+\b(?:redescubre|descubre|conoce|visita|explora|disfruta|aprende|siente|vive)\b"), r(p, r":\s+\b(?:historia|arte|arquitectura|cultura|naturaleza|gastronomia|desde|plan ideal)\b"), r(k, r"\bque (?:representa|simboliza|alberga|esconde)\b"), r(k, r"\bby su \w+ con\b")))
    return f"case when {k} = '' then false when {r(k, '^(?:' + '|'.join(dims.EDITORIAL_PREFIXES) + ')')} or {r(p, r',?\s+dia\s+a\s+dia\s*$')} then true when {event} then false else ({marks}) end"


_URL_LIKE = rf"(regexp_matches(lower(trim({S.t('name')})), '://|^www\.|/|\\|\.(?:com|es|org|net|eu)$') or ({S.key(S.domain('sourceUrl'))} <> '' and ({S.key('name')} = {S.key(S.domain('sourceUrl'))} or {S.key('name')} = replace({S.key(S.domain('sourceUrl'))}, ' ', ''))))"
_ALL = "trim(concat_ws(' ', nullif(shortDescription, ''), nullif(longDescription, ''), nullif(description, ''), nullif(sourceText, '')))"
_SUBSTANTIVE = S.words(S.key("concat_ws(' ', coalesce(shortDescription, ''), coalesce(longDescription, ''), coalesce(description, ''), coalesce(evidence, ''))")) + " >= 8"


@query(rf"""with a as (select *, {_editorial_sql('name', 'sourceUrl', 'types')} ed, {_URL_LIKE} ul, regexp_matches({_ALL}, '^\S+$') and (contains({_ALL}, '://') or starts_with({_ALL}, 'www.')) uo, {_SUBSTANTIVE} su from entities)
select entity_id, ed as editorial, ul as url_like, uo as url_only, su as substantive,
  not (length({S.key('name')}) < 3 or ed or ul or {S.key('name')} in {S.in_(dims.NAVIGATION_NAMES)} or regexp_matches({S.t('name')}, '^\d+[.)]\s') or uo) and (coalesce(len(types), 0) > 0 or su) as valid from a""")
def entity_valid(spark, d):
    c = F.col
    e = table(spark, d, "entities")
    texts = (c("shortDescription"), c("longDescription"), c("description"))
    return e.select(
        "entity_id", P.editorial(c("name"), c("sourceUrl"), c("types")).alias("editorial"), P.url_like(c("name"), c("sourceUrl")).alias("url_like"), P.url_only(*texts, c("sourceText")).alias("url_only"), P.substantive(*texts, c("evidence")).alias("substantive"),
        P.valid_entity(c("name"), c("sourceUrl"), c("types"), *texts, c("sourceText"), c("evidence")).alias("valid"),
    )


@query(rf"""with a as (select *, coalesce(len(types), 0) > 0 ty, coalesce(len(list_intersect({S.segments('sourceUrl')}, {S.listed(dims.LISTING_SEGMENTS)})) > 0, false) li from entities),
b as (select *, coordinates.lat is not null or {S.t('wikidataId')} <> '' or ({S.t('url')} <> '' and {S.t('url')} <> {S.t('sourceUrl')}) or (coalesce(score, 0) >= 0.9 and ty) an from a)
select entity_id from b where not (not an and li) and not (not ty and coordinates.lat is null and coalesce(score, 0) < 0.5) and not ({S.words(S.compact('name'))} > 7 and not an)""")
def quality_filter(spark, d):
    c = F.col
    return table(spark, d, "entities").where(P.quality(c("name"), c("coordinates.lat"), c("wikidataId"), c("url"), c("sourceUrl"), c("score"), c("types"))).select("entity_id")


def _navigation_sql() -> str:
    k = S.key("text")
    return f"({S.key('title')} in {S.in_(dims.NAVIGATION_TITLES)} and {S.words(k)} <= 35 or len(list_filter({S.listed(dims.NAVIGATION_MARKERS)}, lambda m: contains({k}, m))) >= 2 and {S.words(k)} <= 80 or (length({k}) - length(replace({k}, 'saber mas', ''))) / 9 >= 2)"


_NOISE_SQL = "(" + " or ".join(f"contains({S.key('text')}, '{m}')" for m in dims.NOISE_MARKERS) + ")"
_BODY = S.key("coalesce(title, '') || ' ' || coalesce(text, '')")
_REASONS = f"list_slice(list_concat(list_filter({S.listed(sorted(dims.TOURIST_SIGNALS))}, lambda s: contains({_BODY}, s)), case when coalesce(len(images), 0) > 0 and {S.words(_BODY)} >= 8 then ['imagenes_en_bloque'] else [] end), 1, 6)"


@query(f"select block_uid, {_navigation_sql()} as navigation, {_NOISE_SQL} as noise, array_to_string({_REASONS}, ',') as reasons from content_blocks")
def noise_blocks(spark, d):
    c = F.col
    return table(spark, d, "content_blocks").select("block_uid", P.navigation_block(c("title"), c("text")).alias("navigation"), P.noise_block(c("text")).alias("noise"), F.array_join(P.tourist_reasons(c("title"), c("text"), F.coalesce(F.size("images"), F.lit(0))), ",").alias("reasons"))


def _unq(u: str) -> str:
    return f"coalesce(try(url_decode({S.t(u)})), {S.t(u)})"


_NOISE_IMG = (
    rf"(regexp_matches(lower({S.path(_unq('u'))}), '\.(?:svg|ico)$') or starts_with(regexp_extract(lower({S.path(_unq('u'))}), '([^/]*)$', 1), '-') or len(list_intersect(string_split(k, ' '), {S.listed(dims.BLOCKED_TOKENS)})) > 0"
    rf" or len(list_filter({S.listed(dims.BLOCKED_SUBSTRINGS)}, lambda s: contains(replace(k, ' ', ''), s))) > 0 or {S.key(f"regexp_extract(lower({S.path(_unq('u'))}), '([^/]*)$', 1)")} in {S.in_(dims.SOCIAL_FILES)})"
)


@query(rf"""with i as (select page_id, unnest(images) i from crawl_pages), u as (select distinct page_id, i.url u, coalesce(i.alt, '') alt from i), w as (select *, {S.key(f"lower({S.path(_unq('u'))}) || ' ' || alt || ' '")} k from u)
select page_id, u as image, alt, {_NOISE_IMG} as noise, {S.domain('u')} in {S.in_(dims.TRUSTED_HOSTS)} as trusted,
 regexp_matches({S.path(f"lower({_unq('u')})")}, '\.(?:{'|'.join(dims.IMAGE_EXTENSIONS)})$') or regexp_matches(regexp_extract(lower({_unq('u')}), '\?([^#]*)', 1), 'imagepreview|image_preview') or contains({S.path(f"lower({_unq('u')})")}, '/documents/d/guest/') as is_image,
 len(list_intersect(string_split({S.key(S.path(_unq('u')))}, ' '), {S.listed(dims.GENERIC_TOKENS)})) > 0 as generic from w""")
def image_noise(spark, d):
    u = F.col("image")
    i = table(spark, d, "crawl_pages").select("page_id", F.explode("images").alias("i")).select("page_id", F.col("i.url").alias("image"), T.text(F.col("i.alt")).alias("alt")).distinct()
    return i.select("page_id", "image", "alt", I.is_noise(u, F.col("alt")).alias("noise"), I.is_trusted(u).alias("trusted"), I.is_image(u).alias("is_image"), I.is_generic(u).alias("generic"))


@query(rf"""with q as (select entity_id, [{", ".join(S.compact(f"array_to_string(list_filter([{', '.join(xs)}], lambda p: p <> ''), ', ')") for xs in ((S.t('address'), "'Milpuliquera'", "'Spain'"), (S.t('name'), S.t('address')), (S.t('name'), "'Milpuliquera'", "'Spain'")))}, {S.compact('name')}] q from entities),
x as (select entity_id, unnest(q) q, generate_subscripts(q, 1) i from q), y as (select entity_id, {S.ascii_('q')} q, i from x), z as (select entity_id, q, min(i) i from y where q <> '' group by 1, 2)
select entity_id, string_agg(q, ' | ' order by i) as queries from z group by 1""")
def geocode_queries(spark, d):
    q = geo.geocode_queries(F.col("name"), F.col("address"), F.lit("Milpuliquera"))
    return table(spark, d, "entities").select("entity_id", F.array_join(q, " | ").alias("queries")).where("queries <> ''")


@query(rf"""select entity_id, coalesce(list_filter(list_transform(types, lambda t: case when t in {S.in_(geo.WIDE)} then 800 when t in {S.in_(geo.NARROW)} then 100 end), lambda r: r is not null)[1], 200) as radius,
 case when coordinates.lat is not null and coordinates.lng is not null then round({S.km('coordinates.lat', 'coordinates.lng', '40.4165', '-3.70256')}, 6) end as km_to_center from entities""")
def geo_scalars(spark, d):
    lat, lng = F.col("coordinates.lat"), F.col("coordinates.lng")
    return table(spark, d, "entities").select("entity_id", geo.search_radius(F.col("types")).alias("radius"), F.when(geo.both(lat, lng), F.round(geo.distance_km(lat, lng, F.lit(40.4165), F.lit(-3.70256)), 6)).alias("km_to_center"))
