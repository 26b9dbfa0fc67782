"""The queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import addresses, boilerplate, cutoff, leaks, matching, residue, site_lines, survivor, tokenize


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.find_repeated_lines(table(spark, d, "content_blocks"))


def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.remove_repeated_lines(table(spark, d, "content_blocks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.choose_strict(table(spark, d, "entities")).withColumnsRenamed({"grp": "entity_key", "id": "entity_id"})


def p2_record(spark: SparkSession, d: str) -> DataFrame:
    return survivor.choose_summed(table(spark, d, "entities"), as_of=AS_OF, half_life_days=HALF_LIFE)


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_records(table(spark, d, "entities"), table(spark, d, "kb_entities"), table(spark, d, "city_centers"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_matches(spark, d).select("entity_id", "kb_id").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.same_address(table(spark, d, "entities"), table(spark, d, "city_centers"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.find_boilerplate(boilerplate.whole_pages(table(spark, d, "content_blocks"), table(spark, d, "evidence")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(residue.evidence_and_entities(table(spark, d, "evidence"), table(spark, d, "entities")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_documents(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.find_cut(table(spark, d, "documents"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.cut_rates(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_cleaned, p2_found, p2_record, p3_found, p3_matches, p4_found, p5_found, p6_found, p8_ids, p9_found, p10_found, p10_rates)}
#: The date from which ages count in p2_record, and the half life in days.
AS_OF, HALF_LIFE = "2026-01-01", 365.0
_LINE = r"trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '0', 'g'), '[\s\x0b\x{85}\p{Z}]+', ' ', 'g'))"
_SITE = r"regexp_replace(lower(regexp_extract(coalesce(url, ''), '//([^/?#:]+)', 1)), '^www\.', '')"
_LINES = f"""s as (select block_uid, {_SITE} site, string_split(coalesce(text, ''), chr(10)) ls, text from content_blocks),
x as (select block_uid, site, unnest(ls) l, generate_subscripts(ls, 1) - 1 n from s), y as (select block_uid, site, cast(n as int) n, l, {_LINE} k from x),
c as (select site, k, count(distinct block_uid) r from y where k <> '' group by 1, 2), t as (select site, count(*) r from s group by 1),
f as (select c.site, k from c join t on c.site = t.site where c.r >= 8 and c.r >= 0.05 * t.r)"""

_BLANK = survivor.BLANKS
_FOLDED = f"trim(regexp_replace(translate(lower(v), '{survivor.ACCENTED}', '{survivor.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_KNOWN = ", ".join(f"'{x}'" for x in ("", *survivor.UNKNOWN))

_KEPT = f"""with d as (select entity_key g, entity_id i, extracted_at a, score, coordinates c, unnest([{{'f': 'shortDescription', 'v': shortDescription}}, {{'f': 'longDescription', 'v': longDescription}}, {{'f': 'address', 'v': address}}]) x from entities where trim(entity_key) <> ''),
e as (select g, i, a, score t, x.f f, trim(x.v, '{_BLANK}') v from d), u as (select *, case when f = 'address' then v else trim(regexp_replace(v, '(?:…|\\.{{3,}}|[\\s\\x{{a0}}])+$', ''), '{_BLANK}') end s from e where {_FOLDED} not in ({_KNOWN})),
k as (select * from u where s <> '' and (f = 'address' or not exists (select 1 from u o where o.g = u.g and o.f = u.f and length(o.s) > length(u.s) and starts_with(o.s, u.s)))),
w as (select g, f, i, a, t, s, s v from k union all select g, 'coordinates', i, a, t, s, s from (select entity_key g, entity_id i, extracted_at a, coordinates.confidence t, cast(coordinates.lat as varchar) || ',' || cast(coordinates.lng as varchar) s from entities where trim(entity_key) <> '' and coordinates.lat between -90 and 90 and coordinates.lng between -180 and 180 and not isnan(coordinates.lat) and not isnan(coordinates.lng) and not (coordinates.lat = 0 and coordinates.lng = 0)))"""

SQL: dict[str, str] = {
    "p1_found": f"with {_LINES} select block_uid, n as line_no from y join f on y.site = f.site and y.k = f.k",
    "p1_cleaned": f"""with {_LINES}, z as (select block_uid, string_agg(l, chr(10) order by n) filter (where f.k is null) t, count(f.k) g from y left join f on y.site = f.site and y.k = f.k group by 1)
select s.block_uid, case when s.text is not null then coalesce(t, '') end as text, cast(g as int) as removed from s join z on s.block_uid = z.block_uid""",
    "p2_found": f"""{_KEPT},
n as (select entity_key g from entities group by 1 having count(*) > 1)
select w.g as entity_key, f as field_name, i as entity_id from w join n on w.g = n.g qualify row_number() over (partition by w.g, f order by t desc nulls last, a desc nulls last, i) = 1""",
    "p2_record": f"""{_KEPT},
n as (select distinct entity_key g from entities where trim(entity_key) <> ''),
x as (select *, round(coalesce(t, 0.1) * pow(0.5, coalesce(greatest(0, date '{AS_OF}' - cast(a as date)), 3650) / {HALF_LIFE}), 9) p from w),
y as (select g, f, {_FOLDED} as norm, sum(p) votes from x group by 1, 2, 3),
z as (select x.g, x.f, x.s, row_number() over (partition by x.g, x.f order by round(y.votes, 6) desc, x.p desc, x.i) r from (select *, {_FOLDED} as norm from x) x join y on x.g = y.g and x.f = y.f and x.norm = y.norm)
select n.g as entity_key, max(s) filter (where f = 'shortDescription') as "shortDescription", max(s) filter (where f = 'longDescription') as "longDescription", max(s) filter (where f = 'address') as address, max(s) filter (where f = 'coordinates') as coordinates
from n left join z on n.g = z.g and r = 1 group by 1""",
    "p9_found": """with d as (select doc_id, regexp_extract_all(strip_accents(nfc_normalize(lower(text))), '[\\p{L}\\p{N}]+') w from documents), i as (select item_id, regexp_extract_all(strip_accents(nfc_normalize(lower(item_text))), '[\\p{L}\\p{N}]+') w from eval_items),
dg as (select doc_id, array_to_string(w[k : k + 11], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 10)) k from d)), ig as (select item_id, array_to_string(w[k : k + 11], ' ') g from (select item_id, w, unnest(range(1, len(w) - 10)) k from i))
select distinct doc_id, item_id from dg join ig on dg.g = ig.g""",
}
