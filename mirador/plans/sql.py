"""Pieces of DuckDB SQL, as strings, for the check of the queries."""

from __future__ import annotations

from .. import dims
from ..functions.text import FOLD_FROM, FOLD_TO


def t(x: str) -> str:
    return f"coalesce({x}, '')"


def ascii_(x: str) -> str:
    return f"translate({t(x)}, '{FOLD_FROM}', '{FOLD_TO}')"


def plain(x: str) -> str:
    return f"lower(translate(replace({t(x)}, 'ß', 'ss'), '{FOLD_FROM}', '{FOLD_TO}'))"


def key(x: str) -> str:
    return rf"trim(regexp_replace({plain(x)}, '[^a-z0-9]+', ' ', 'g'))"


def compact(x: str) -> str:
    return rf"trim(regexp_replace({t(x)}, '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def strip_articles(k: str, articles: tuple[str, ...] = dims.MERGE_ARTICLES) -> str:
    return rf"regexp_replace({k}, '^(?:(?:{'|'.join(articles)})(?: |$))+', '')"


def name_key(x: str, articles: tuple[str, ...] = dims.MERGE_ARTICLES) -> str:
    return strip_articles(key(x), articles)


def entity_key(name: str = "name", wd: str = "wikidataId", articles: tuple[str, ...] = dims.MERGE_ARTICLES) -> str:
    return f"case when {t(wd)} <> '' then 'wikidata:' || {wd} else 'name:' || {name_key(name, articles)} end"


def authority(x: str) -> str:
    return rf"regexp_extract({t(x)}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"


def domain(x: str) -> str:
    return rf"regexp_replace(lower({authority(x)}), '^www\.', '')"


def path(x: str) -> str:
    return rf"regexp_extract({t(x)}, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"


def normal(x: str) -> str:
    bare = f"regexp_replace({x}, '[?#].*$', '')"
    return f"case when regexp_matches({x}, '(?i)^https?:') then case when length(regexp_extract({bare}, '^https?://[^/]*(/.*)?$', 1)) > 1 then regexp_replace({bare}, '/+$', '') else {bare} end end"


def skipped(x: str) -> str:
    return rf"(len(list_intersect({segments(f'lower({x})')}, {listed(dims.SKIP_SEGMENTS)})) > 0 or regexp_matches({path(f'lower({x})')}, '\.(?:{'|'.join(dims.SKIP_EXTENSIONS)})$'))"


def distinct(l: str) -> str:
    """Distinct values in order."""
    return f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"


def segments(x: str) -> str:
    return f"string_split(trim({path(x)}, '/'), '/')"


def words(k: str) -> str:
    return f"(case when {k} = '' then 0 else len(string_split({k}, ' ')) end)"


def listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def in_(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def km(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


def kw(k: str, word: str) -> str:
    return f"contains(' ' || {k} || ' ', ' {word} ')"


def first_filled(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ")"


def is_boilerplate(x: str) -> str:
    return rf"regexp_matches({t(x)}, '(?i)\d{{1,5}}\s+visitas?\b|\bsaber\s+m[aá]s\b|\bir\s+a\s+\w|\bver\s+m[aá]s\b|\bleer\s+m[aá]s\b|\bqu[eé]\s+ver\b')"


def clean_content(x: str) -> str:
    label = r"(?i)^(?:(?:mas lugares de interes|m[aá]s lugares de inter[eé]s|lugares de interes|lugares de inter[eé]s|curiosidades|ficha)\b[:\s-]*)+"
    action = r"(?i)\b(?:mas lugares de interes|m[aá]s lugares de inter[eé]s|lugares de interes|lugares de inter[eé]s|ver mapa|saber mas|saber m[aá]s|leer mas|leer m[aá]s|reserva ahora|qu[eé]\s+ver)\b"
    a = rf"trim(regexp_replace({compact(x)}, '{label}', ''))"
    b = rf"regexp_replace(regexp_replace({a}, '{action}', '', 'g'), '\s+([.,;:])', '\1', 'g')"
    return compact(rf"regexp_replace({b}, '(?:\.\s*){{2,}}', '. ', 'g')")


def shortest_part(x: str, sep: str) -> str:
    parts = f"list_filter(list_transform(string_split({x}, '{sep}'), lambda p: trim(p)), lambda p: p <> '')"
    return f"coalesce(list_sort(list_transform({parts}, lambda p, i: {{'n': length(p), 'i': i, 'p': p}}))[1].p, {x})"


def clean_name(x: str) -> str:
    return rf"trim({shortest_part(shortest_part(f'trim({t(x)})', '|'), ' - ')}, e' \t\r\n-_/|')"


def slug(x: str) -> str:
    return f"substr(trim(regexp_replace(lower({t(x)}), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80)"
