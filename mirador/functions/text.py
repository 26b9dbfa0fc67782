"""Text columns: keys, cleaning, contact data, identifiers. No Python runs per row."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def _folding() -> tuple[str, str]:
    """Letters of Latin scripts and the plain letter each decomposes to; combining marks, which have none, come last."""
    src, dst = [], []
    for code in range(0xA0, 0x250):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c and plain.isalnum():
            src.append(c)
            dst.append(plain)
    return "".join(src) + "".join(map(chr, range(0x300, 0x370))), "".join(dst)


FOLD_FROM, FOLD_TO = _folding()


def let(c: Column, f) -> Column:
    """``f(c)`` with ``c`` computed once per row, also where ``f`` uses it within a lambda."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def text(c: Column) -> Column:
    """Null means missing, as '' does."""
    return F.coalesce(c, F.lit(""))


#: White space of all kinds.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.btrim(text(c), F.lit(BLANKS))


def compact(c: Column) -> Column:
    """Runs of white space become one blank; trimmed."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def ascii_fold(c: Column) -> Column:
    """Without accents, case and punctuation kept."""
    return F.translate(text(c), FOLD_FROM, FOLD_TO)


def plain(c: Column) -> Column:
    """Without accents and case, punctuation kept."""
    return F.lower(ascii_fold(F.replace(text(c), F.lit("ß"), F.lit("ss"))))


def key(c: Column) -> Column:
    """The universal match key: words of a-z and 0-9, parted by single blanks."""
    return F.trim(F.regexp_replace(plain(c), "[^a-z0-9]+", " "))


def key_of(s: str) -> str:
    """``key`` of a constant."""
    t = "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x)).casefold()
    return " ".join("".join(x if x.isascii() and x.isalnum() else " " for x in t).split())


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def has_keyword(key_: Column, keyword: Column | str) -> Column:
    """Whether the key holds the keyword as whole words."""
    k = F.lit(keyword) if isinstance(keyword, str) else keyword
    return (key_ != "") & (k != "") & F.contains(F.concat(F.lit(" "), key_, F.lit(" ")), F.concat(F.lit(" "), k, F.lit(" ")))


def strip_articles(key_: Column, articles: tuple[str, ...] = dims.MERGE_ARTICLES) -> Column:
    return F.regexp_replace(key_, rf"^(?:(?:{'|'.join(articles)})(?: |$))+", "")


def significant(key_: Column) -> Column:
    """Distinct words of four letters or more that are no stop words."""
    return F.array_distinct(F.filter(F.split(key_, " "), lambda w: (F.length(w) >= 4) & ~w.isin(*dims.NAME_STOPWORDS)))


# Labels before a text, actions within it, and signs of navigation.
_LABEL = r"(?iu)^(?:(?:mas lugares de interes|m[aá]s lugares de inter[eé]s|lugares de interes|lugares de inter[eé]s|curiosidades|ficha)\b[:\s-]*)+"
_ACTION = r"(?iu)\b(?:mas lugares de interes|m[aá]s lugares de inter[eé]s|lugares de interes|lugares de inter[eé]s|ver mapa|saber mas|saber m[aá]s|leer mas|leer m[aá]s|reserva ahora|qu[eé]\s+ver)\b"
_BOILERPLATE = r"(?iu)\d{1,5}\s+visitas?\b|\bsaber\s+m[aá]s\b|\bir\s+a\s+\w|\bver\s+m[aá]s\b|\bleer\s+m[aá]s\b|\bqu[eé]\s+ver\b"


def clean_content(c: Column) -> Column:
    """Without leading labels, inline actions, blanks before punctuation and repeated dots."""
    t = F.trim(F.regexp_replace(compact(c), _LABEL, ""))
    t = F.regexp_replace(F.regexp_replace(t, _ACTION, ""), r"\s+([.,;:])", "$1")
    return compact(F.regexp_replace(t, r"(?:\.\s*){2,}", ". "))


def is_boilerplate(c: Column) -> Column:
    return F.rlike(text(c), F.lit(_BOILERPLATE))


def clean_name(c: Column) -> Column:
    """The shortest part between bars, then of that between dashes; first of equals. Outer separators go."""
    t = F.trim(text(c))
    for sep in (r"\|", " - "):
        parts = F.filter(F.transform(F.split(t, sep), lambda p: F.trim(p)), lambda p: p != "")
        ranked = F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i"), p.alias("p")))
        t = F.when(F.size(parts) > 0, F.array_min(ranked)["p"]).otherwise(t)
    return F.btrim(t, F.lit(" \t\r\n-_/|"))


def first_title_segment(c: Column) -> Column:
    """The part of a page title before its separator; the separators are tried in turn."""
    t = F.trim(text(c))
    out = t
    for sep in (" — ", " – ", " - ", " | "):
        head = F.trim(F.substring_index(t, sep, 1))
        out = F.when(F.contains(t, F.lit(sep)) & (head != ""), head).otherwise(out)
    return out


_DATE_HEADING = r"\b\d{1,2}\s+de\s+[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+\s+de\s+\d{4}\b"


def relevant_text(name: Column, c: Column) -> Column:
    """Of a text with two or more dated parts, the first part that names the entity; else the whole text."""
    t = compact(c)
    parts = F.filter(F.split(t, rf"(?={_DATE_HEADING})(?<![0-9])"), lambda p: F.rlike(p, F.lit(rf"^{_DATE_HEADING}")))
    hit = F.filter(parts, lambda p: F.contains(key(p), key(name)))
    return F.when((F.size(parts) >= 2) & (key(name) != ""), F.coalesce(F.trim(F.get(hit, F.lit(0))), t)).otherwise(t)


def merge_text(current: Column, incoming: Column) -> Column:
    """Adds a text to another: copies, parts of it and navigation are left out, what contains it replaces it."""
    a, b = strip(current), strip(incoming)
    return (
        F.when(b == "", a)
        .when(a == "", F.when(is_boilerplate(b), a).otherwise(b))
        .when(F.contains(a, b), a)
        .when(F.contains(b, a), b)
        .when(is_boilerplate(b), a)
        .otherwise(F.concat(a, F.lit(" "), b))
    )


def fold_texts(texts: Column) -> Column:
    """``merge_text`` over an ordered array."""
    return F.aggregate(texts, F.lit(""), merge_text)


def source_text_score(c: Column, name: Column) -> Column:
    """How well a text serves as the source text of a name: it names it, and is short."""
    k = key(name)

    def score(t: Column) -> Column:
        hits = F.size(F.filter(F.split(k, " "), lambda w: (F.length(w) >= 4) & F.contains(t, w)))
        n = word_count(t)
        return F.when((k != "") & F.contains(t, k), 100).otherwise(0) + hits * 10 + F.when(n <= 120, 50).when(n <= 250, 20).when(n > 450, -60).otherwise(0)

    return let(key(c), score)


def phone(c: Column) -> Column:
    """The first number of nine digits, or eleven that begin with 34; '' if none."""
    runs = F.regexp_extract_all(text(c), F.lit(r"(?<!\d)((?:\+34\s*)?(?:\d[\s.-]?){9})(?!\d)"), 1)
    digits = lambda p: F.regexp_replace(p, r"\D", "")
    good = F.filter(runs, lambda p: (F.length(digits(p)) == 9) | (F.length(digits(p)) == 11) & F.startswith(digits(p), F.lit("34")))
    return text(F.btrim(compact(F.get(good, F.lit(0))), F.lit(" .,:;")))


# What ends an address, and what tells that a sentence is none.
_ADDRESS_END = r"(?iu)\b(?:ver mapa|horarios?|fecha|hora|precio|idiomas?|de lunes|lunes|martes|miercoles|miércoles|jueves|viernes|sabado|sábado|domingo|actividad|informacion|información|reserva|entrada|gratuito)\b"
_NARRATIVE = r"(?iu)\b(?:se llena|se encuentran?|sirven?|disfrutar|recorrido|actividad|concierto|casetas?|escenario|temporada|prevision|previsión)\b"
_MARKERS = r"(?iu)avenida|avda|calle|carretera|c/|paseo|plaza"
_ADDRESS = r"(?iu)((?:C/|calle|plaza|avenida|avda\.?|paseo|carretera)\s+[^.;]{3,120})"


def _address_in(sentence: Column) -> Column:
    found = F.btrim(compact(F.regexp_extract(sentence, _ADDRESS, 1)), F.lit(" ,.;"))
    a = F.btrim(compact(F.get(F.split(found, _ADDRESS_END, 2), F.lit(0))), F.lit(" ,.;:-"))
    bad = (F.length(a) > 90) | (word_count(a) > 14) | F.rlike(a, F.lit(_NARRATIVE)) | F.lower(a).isin("calle", "plaza", "paseo", "avenida", "carretera", "c/")
    return F.when((a != "") & ~bad, a)


def address(c: Column) -> Column:
    """The first plausible street address of a text; '' if none."""
    sentences = F.filter(F.split(compact(c), r"(?<=[.;])\s+"), lambda s: F.rlike(s, F.lit(_MARKERS)))
    return text(F.get(F.filter(F.transform(sentences, _address_in), lambda a: a.isNotNull()), F.lit(0)))


def valid_address(c: Column) -> Column:
    return (text(c) != "") & (word_count(compact(c)) <= 10) & (F.length(text(c)) <= 120)


def geocode_address(c: Column) -> Column:
    """An address cut for a lookup: up to a stop word, 160 characters, 24 words."""
    head = F.btrim(compact(F.get(F.split(compact(c), r"(?iu)\b(?:horarios?|precio|fecha|reserva|ver mapa|saber mas)\b", 2), F.lit(0))), F.lit(" ,.;:-"))
    short = F.substring(head, 1, 160)
    cut = F.when(F.length(head) > 160, F.coalesce(F.nullif(F.regexp_replace(short, ",[^,]*$", ""), F.lit("")), short)).otherwise(head)
    return F.when(word_count(cut) > 24, "").otherwise(cut)


def slug(c: Column) -> Column:
    return F.substring(F.btrim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), F.lit("-")), 1, 80)


def class_name(c: Column) -> Column:
    return F.regexp_replace(text(c), "[^A-Za-z0-9]", "")


def external_id(prefix: Column, cls: Column, name: Column, source: Column) -> Column:
    """prefix:class:slug:digest, stable for one class, name and source."""
    digest = F.substring(F.sha1(F.concat_ws("|", cls, text(name), text(source))), 1, 12)
    return F.concat_ws(":", prefix, F.lower(cls), F.coalesce(F.nullif(slug(name), F.lit("")), F.lit("entity")), digest)


def literal(c: Column, lang: str = "es") -> Column:
    return F.struct(F.trim(text(c)).alias("value"), F.lit(lang).alias("lang"))


def as_list(c: Column) -> Column:
    return F.when(text(c) == "", F.array().cast("array<string>")).otherwise(F.array(c))


def distinct_filled(c: Column) -> Column:
    """Distinct non-empty values, in order."""
    return F.array_distinct(F.filter(c, lambda x: F.coalesce(x, F.lit("")) != ""))


def slug_name(url: Column) -> Column:
    """The last path segment as words."""
    parts = F.filter(F.split(text(F.try_parse_url(url, F.lit("PATH"))), "/"), lambda x: x != "")
    return F.trim(F.translate(text(F.element_at(F.concat(F.array(F.lit("")), parts), -1)), "-_", "  "))


def pick_language(labels: Column, languages: tuple[str, ...] = ("es", "en")) -> Column:
    """The first filled value of a map by language."""
    return F.coalesce(*[F.nullif(F.try_element_at(labels, F.lit(x)), F.lit("")) for x in languages], F.lit(""))
