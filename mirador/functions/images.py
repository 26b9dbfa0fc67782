"""Image columns: noise, trust, and how well an image fits a name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .text import key, let, text, word_count
from .urls import domain, path


def _list(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def unquoted(url: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(text(url), F.lit("+"), F.lit("%2B"))), text(url))


def url_words(url: Column) -> Column:
    """The path as a key."""
    return key(path(unquoted(url)))


def is_noise(url: Column, alt: Column | None = None, metadata: Column | None = None) -> Column:
    """Icons, logos, social badges and other assets of the site."""
    p = F.lower(path(unquoted(url)))
    name = F.substring_index(p, "/", -1)
    k = key(F.concat_ws(" ", p, text(F.lit("") if alt is None else alt), text(F.lit("") if metadata is None else metadata)))
    dense = F.replace(k, F.lit(" "), F.lit(""))
    # One pattern, so that the key is computed once.
    has = F.rlike(dense, F.lit("|".join(map(re.escape, dims.BLOCKED_SUBSTRINGS))))
    return F.rlike(p, F.lit(r"\.(?:svg|ico)$")) | F.startswith(name, F.lit("-")) | F.arrays_overlap(F.split(k, " "), _list(dims.BLOCKED_TOKENS)) | has | key(name).isin(*dims.SOCIAL_FILES)


def is_trusted(url: Column) -> Column:
    return domain(url).isin(*dims.TRUSTED_HOSTS)


def is_image(url: Column) -> Column:
    u = F.lower(unquoted(url))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return F.rlike(path(u), F.lit(rf"\.(?:{'|'.join(dims.IMAGE_EXTENSIONS)})$")) | F.rlike(query, F.lit("imagepreview|image_preview")) | F.contains(path(u), F.lit("/documents/d/guest/"))


def is_generic(url: Column) -> Column:
    return F.arrays_overlap(F.split(url_words(url), " "), _list(dims.GENERIC_TOKENS))


def name_words(name_key: Column) -> Column:
    """The distinct words of a name that an image may carry."""
    return F.array_distinct(F.filter(F.split(name_key, " "), lambda w: (F.length(w) >= 4) & ~w.isin(*dims.IMAGE_STOPWORDS)))


def _found(haystack: Column, name_key: Column) -> tuple[Column, Column]:
    """How many of the name's words are in the haystack, and how many there are."""
    own = name_words(name_key)
    return F.size(F.filter(own, lambda w: F.contains(haystack, w))), F.size(own)


def url_score(url: Column, name_key: Column) -> Column:
    """100 if the path has the whole name; 50 for a name of one word, 40 and the words' number for two or more."""

    def of(h: Column) -> Column:
        hits, n = _found(h, name_key)
        # A name of one word counts itself a second time, as its own compound.
        hits = hits + F.when((n == 0) & ~F.contains(name_key, F.lit(" ")) & F.contains(h, name_key), 1).otherwise(0)
        whole = F.contains(F.replace(h, F.lit(" "), F.lit("")), F.replace(name_key, F.lit(" "), F.lit("")))
        return F.when((h == "") | (name_key == ""), 0).when(whole, 100).when((n <= 1) & (hits > 0), 50).when((n > 1) & (hits >= 2), 40 + hits).otherwise(0)

    return let(url_words(url), of)


def alt_score(alt: Column, name_key: Column) -> Column:
    """95 if the caption has the whole name; 45 for its one word, 35 and the words' number for enough of them."""

    def of(h: Column) -> Column:
        hits, n = _found(h, name_key)
        return F.when((h == "") | (name_key == ""), 0).when(F.contains(h, name_key), 95).when(n == 0, 0).when(hits >= F.least(F.lit(2), n), 35 + hits).otherwise(0)

    return let(key(alt), of)


def context_score(context: Column, name_key: Column) -> Column:
    """How many of the name's words the image's surroundings hold; 0 if these are long."""
    return let(key(context), lambda h: F.when(word_count(h) > 200, 0).otherwise(_found(h, name_key)[0]))


def fits(url: Column, name_key: Column) -> Column:
    return (url_score(url, name_key) > 0) & ~is_generic(url)


def slug_words(url: Column, name_key: Column) -> Column:
    """How many of the name's longer words the path holds."""
    return let(url_words(url), lambda h: F.size(F.filter(F.array_distinct(F.split(name_key, " ")), lambda w: (F.length(w) >= 4) & F.contains(h, w))))


def cleaned(images: Column, name_key: Column, most: int = 10) -> Column:
    """Distinct images that are no noise and are trusted or fit the name; those with more of its words in their path first."""
    good = F.array_distinct(F.filter(images, lambda u: (text(u) != "") & ~is_noise(u) & (is_trusted(u) | fits(u, name_key))))
    ranked = F.array_sort(F.transform(good, lambda u, i: F.struct((-slug_words(u, name_key)).alias("s"), i.alias("i"), u.alias("u"))))
    return F.slice(F.transform(ranked, lambda r: r["u"]), 1, most)
