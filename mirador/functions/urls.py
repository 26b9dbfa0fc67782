"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def _part(url: Column, part: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit(part)), F.lit(""))


def site(url: Column) -> Column:
    """Host of ``url`` in lower case, without user, port and leading ``www.``; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def with_scheme(url: Column) -> Column:
    return F.when(F.rlike(url, F.lit("^https?://")), url).otherwise(F.concat(F.lit("https://"), url))


def normalize(url: Column) -> Column:
    """Web URLs without query and fragment and, below the root, without closing slashes; null for others."""
    bare = F.regexp_replace(url, "[?#].*$", "")
    path = F.regexp_extract(bare, r"^https?://[^/]*(/.*)?$", 1)
    return F.when(F.rlike(url, F.lit("(?i)^https?:")), F.when(F.length(path) > 1, F.regexp_replace(bare, "/+$", "")).otherwise(bare))


def authority(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def domain(url: Column) -> Column:
    """Lower-case authority (with its port) without leading www."""
    return F.regexp_replace(F.lower(authority(url)), r"^www\.", "")


def root_domain(url: Column) -> Column:
    return F.substring_index(domain(url), ".", -2)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def segments(url: Column) -> Column:
    return F.split(F.btrim(path(url), F.lit("/")), "/")


def _any_segment(url: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(segments(url), F.array(*map(F.lit, names)))


def skipped(url: Column) -> Column:
    """Static files and system pages."""
    low = F.lower(url)
    return F.rlike(path(low), F.lit(rf"\.(?:{'|'.join(dims.SKIP_EXTENSIONS)})$")) | _any_segment(low, dims.SKIP_SEGMENTS)


def foreign_language(url: Column, lang: str) -> Column:
    """Whether the path begins with another language's code."""
    first = F.lower(F.get(segments(url), F.lit(0)))
    return first.isin(*dims.LANGUAGES) & (first != lang.lower()) if lang else F.lit(False)


def listing(url: Column) -> Column:
    return _any_segment(url, dims.LISTING_SEGMENTS)


def absolute(href: Column, base: Column) -> Column:
    """A link resolved against its page: absolute, scheme-relative, rooted, or beside the page."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.concat(scheme, F.lit("://"), authority(base))
    folder = F.regexp_replace(F.when(path(base) == "", F.lit("/")).otherwise(path(base)), "[^/]*$", "")
    return (
        F.when(F.rlike(href, F.lit("^[A-Za-z][A-Za-z0-9+.\\-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.startswith(href, F.lit("?")), F.concat(root, path(base), href))
        .otherwise(F.concat(root, folder, href))
    )
