"""Predicates on entities and blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .text import key, let, plain, text, word_count
from .urls import authority, listing, segments


def editorial(name: Column, url: Column, types: Column) -> Column:
    """Headlines of articles; short names on event pages are none. The rules hold in this order."""
    k, p, n = key(name), plain(name), word_count(key(name))
    has = lambda c, r: F.rlike(c, F.lit(r))
    event = F.array_contains(segments(url), "evento") & F.array_contains(types, "Event") & (n <= 8) & ~F.contains(p, F.lit(":"))
    # What marks a headline.
    marks = (
        has(k, r"^\d{1,2} (?:consejos?|razones?|tips?|ideas?|secretos?)\b")
        | (n > 14)
        | F.contains(F.concat(F.lit(" "), k, F.lit(" ")), F.lit(" se encuentra "))
        | has(p, r"\.\s+.{0,100}\b(?:domingos?|sabados?|lunes|martes|miercoles|jueves|viernes|euros?)\b")
        | has(p, r",\s+(?:el|la)\s+\w+.+\b(?:mas|mejor|unico|primero|antigua?|famoso|dedicad)")
        | has(p, r":\s+\b(?:redescubre|descubre|conoce|visita|explora|disfruta|aprende|siente|vive)\b")
        | has(p, r":\s+\b(?:historia|arte|arquitectura|cultura|naturaleza|gastronomia|desde|plan ideal)\b")
        | has(k, r"\bque (?:representa|simboliza|alberga|esconde)\b")
        | has(k, r"\bby su \w+ con\b")
    )
    return F.when(k == "", False).when(has(k, f"^(?:{'|'.join(dims.EDITORIAL_PREFIXES)})") | has(p, r",?\s+dia\s+a\s+dia\s*$"), True).when(F.coalesce(event, F.lit(False)), False).otherwise(F.coalesce(marks, F.lit(False)))


def url_like(name: Column, page_url: Column) -> Column:
    raw = F.lower(F.trim(text(name)))
    host = key(F.regexp_replace(F.regexp_replace(F.lower(authority(page_url)), r"^www\.", ""), r":[^:]*$", ""))
    same = (host != "") & key(raw).isin(host) | (host != "") & (key(raw) == F.replace(host, F.lit(" "), F.lit("")))
    return F.rlike(raw, F.lit(r"://|^www\.|/|\\|\.(?:com|es|org|net|eu)$")) | same


def url_only(*texts: Column) -> Column:
    """All text is one URL."""
    t = F.trim(F.concat_ws(" ", *[F.nullif(text(x), F.lit("")) for x in texts]))
    return F.rlike(t, F.lit(r"^\S+$")) & (F.contains(t, F.lit("://")) | F.startswith(t, F.lit("www.")))


def substantive(*texts: Column) -> Column:
    return word_count(key(F.concat_ws(" ", *map(text, texts)))) >= 8


def valid_entity(name: Column, url: Column, types: Column, short: Column, long: Column, description: Column, source_text: Column, evidence: Column) -> Column:
    k = key(name)
    bad = (F.length(k) < 3) | editorial(name, url, types) | url_like(name, url) | k.isin(*dims.NAVIGATION_NAMES) | F.rlike(text(name), F.lit(r"^\d+[.)]\s")) | url_only(short, long, description, source_text)
    return ~bad & ((F.size(F.coalesce(types, F.array())) > 0) | substantive(short, long, description, evidence))


def quality(name: Column, lat: Column, wikidata: Column, url: Column, source_url: Column, score: Column, types: Column) -> Column:
    """Entities with an anchor, or typed, scored and shortly named, that don't come from a listing."""
    typed = F.size(F.coalesce(types, F.array())) > 0
    anchor = lat.isNotNull() | (text(wikidata) != "") | (text(url) != "") & (text(url) != text(source_url)) | (F.coalesce(score, F.lit(0.0)) >= 0.9) & typed
    weak = ~typed & lat.isNull() & (F.coalesce(score, F.lit(0.0)) < 0.5)
    return ~(~anchor & F.coalesce(listing(source_url), F.lit(False))) & ~weak & ~((word_count(F.regexp_replace(text(name), r"(?U)\s+", " ")) > 7) & ~anchor)


def navigation_block(title: Column, body: Column) -> Column:
    def of(b: Column) -> Column:
        n = word_count(b)
        marks = F.size(F.filter(F.array(*map(F.lit, dims.NAVIGATION_MARKERS)), lambda m: F.contains(b, m)))
        return key(title).isin(*dims.NAVIGATION_TITLES) & (n <= 35) | (marks >= 2) & (n <= 80) | (F.regexp_count(b, F.lit("saber mas")) >= 2)

    return let(key(body), of)


def noise_block(body: Column) -> Column:
    return let(key(body), lambda b: F.exists(F.array(*map(F.lit, dims.NOISE_MARKERS)), lambda m: F.contains(b, m)))


def tourist_reasons(title: Column, body: Column, images: Column) -> Column:
    """Up to six signals that a block is about a place, in order; last that it has images and text."""

    def of(k: Column) -> Column:
        found = F.filter(F.array(*map(F.lit, sorted(dims.TOURIST_SIGNALS))), lambda s: F.contains(k, s))
        pictures = F.when((images > 0) & (word_count(k) >= 8), F.array(F.lit("imagenes_en_bloque"))).otherwise(F.array().cast("array<string>"))
        return F.slice(F.concat(found, pictures), 1, 6)

    return let(key(F.concat_ws(" ", text(title), text(body))), of)


def suspect_address(address: Column) -> Column:
    """Long addresses, and those that tell a story."""
    return (text(address) != "") & ((word_count(F.regexp_replace(text(address), r"(?U)\s+", " ")) > 12) | (F.length(text(address)) > 120))
