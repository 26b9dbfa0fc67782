"""Problem 6: template residue, filler, error messages and script notices in place of content.

Method: character n-gram models. The model of natural prose counts the n-grams of all given texts (they are prose but for
a few per cent); the models of notices and of filler are fit on the phrases below; a model of shapes, in which all letters
are one sign, is fit on placeholder syntaxes. The likelihood ratio of each n-gram, averaged over windows, localises
residue. One round of expectation-maximisation moves the n-grams of texts found so far from prose to their class. A text is left out if residue covers most of it, or if a placeholder window passes an exact check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N, BITS, WINDOW = 4, 18, 9
COVERAGE = 0.5
#: A letter that follows another less often than this is odd there; a text of which this share of the pairs of letters is odd is no
#: language. Both are shares, alike at every size.
ODD, ODD_SHARE = 0.008, 0.45

#: Messages of servers and browsers, and notices that scripts, cookies or other browsers are needed.
NOTICES = """
error 404. error 500. error 503. error 403. error 301. error 429. http/1.1 404 not found. http/1.1 500 http/1.1 301 http/1.1 502
404 - no encontrado. 403 - prohibido. 500 - error interno. 404 not found. 403 forbidden. 502 bad gateway. bad gateway. gateway timeout.
internal server error. service unavailable. service temporarily unavailable. the page you requested could not be found. page not found.
la página que busca no existe o ha cambiado de sitio. página no encontrada. la página solicitada no existe. esta página ya no existe.
lo sentimos, ha ocurrido un problema interno (código 500). se ha producido un error inesperado. vaya, algo ha salido mal. error interno del servidor.
aquesta pàgina ja no hi és. pàgina no trobada. oups, cette page est introuvable. page introuvable. cette page n'existe plus. erreur interne du serveur.
la sesión ha caducado. su sesión ha expirado. session expired. la session a expiré. la sessió ha caducat.
acceso denegado a la ficha. acceso denegado. access denied. accès refusé. accés denegat. you do not have permission to access this page.
el servidor tardó demasiado en responder. tiempo de espera agotado. no se pudo conectar con la base de datos. error establishing a database connection.
demasiadas peticiones desde su dirección. too many requests. sitio en mantenimiento: web en mantenimiento. site under maintenance.
este dominio está aparcado. this domain is parked. este dominio está en venta. no hay resultados para su consulta. no results found. sin resultados.
warning: include(file.inc): failed to open stream on line 10. fatal error: uncaught exception. traceback: keyerror 'name' in render_card. undefined index. syntax error. nullpointerexception at line 12.
identifíquese de nuevo. inicie sesión de nuevo. disculpe las molestias. rogamos disculpen las molestias. inténtelo pasados 10 minutos. inténtelo de nuevo más tarde. inténtelo otra vez.
go back home. back to home page. vuelva a la portada de. volver a la página de inicio. volver | buscar | póngase en contacto con el titular de. contacte con el administrador del sitio. reference #12345 nginx/1.18 apache/2.4 server at port 80.
please turn on javascript and reload the page. please enable javascript. you need to enable javascript to run this app. you need to enable scripts to run this app. javascript is required. javascript is disabled in your browser.
active javascript en su navegador. debe activar javascript para ver esta página. este contenido necesita scripts. este sitio requiere javascript. habilite javascript. veuillez activer javascript. cal activar javascript. activeu javascript.
su navegador no admite marcos ni mapas; actualícelo. actualice su navegador. your browser does not support frames. this page works best with a newer browser. navegador no compatible. votre navigateur n'est pas compatible.
desactive el bloqueador de anuncios. please disable your ad blocker. acepte las cookies para cargar el vídeo. accept cookies to load the video. acepta las cookies para ver este contenido.
verificando su conexión segura. comprobando que no es un robot. checking your browser before accessing. marque la casilla y confirme que es una persona. verify you are human. complete el captcha.
cargando, espere por favor. cargando... loading, please wait. loading... chargement en cours. carregant. y vuelva a intentarlo. and try again. para ver la ficha de. para ver este contenido.
"""
#: Filler that stands for text to come, and what empty values turn into.
FILLER = """
lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
et sed ut vel sit amet magna elit. sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium. adipiscing consectetur incididunt labore tempor nostrud fugiat enim quis. vel sed et ut amet.
párrafo de relleno. texto de relleno. texto de ejemplo. texto de prueba. texto provisional. texto de muestra. text de mostra. text de prova. text provisional. texte à venir. texte d'exemple. texte de remplissage. sample text goes here. placeholder text. your text here. dummy text. insert text here. add your content here.
aquí va la descripción. aquí va el texto. aquí va el título. escriba aquí su texto. contenido por defecto. título por defecto / subtítulo. título por defecto. subtítulo. borrador sin redactar. borrador, pendiente de redactar. contenido pendiente. default content. default title. contingut per defecte. contenu par défaut.
todo: completar. todo: fill in. todo: write. pendiente (12). pendiente de completar. a rellenar por el editor. a completar por el editor. sustituir por la ficha de. cambiar antes de publicar. sustituir este texto. replace me. change me. to be replaced. bla bla bla. blah blah blah. xxxxx xxxxx xxxxxxx. xxx xxx. test test test. prueba prueba prueba. prova prova prova. testing 123. asdf asdf asdf. qwerty qwerty.
null null, null. undefined, undefined. undefined de undefined. nan / nan. nan km. none none none. [object object] [object object]. lista vacía: []. n/a n/a n/a. array() array().
"""
#: Syntaxes of placeholders; the letters between the signs are one or more names.
SHAPES = ("{{ name }}", "{{name}}", "{name}", "{name.name}", "${name}", "${ name }", "[[name]]", "[[ name ]]", "[name]", "[NAME NAME]", "%%name%%", "%name%", "__name__", "@@name@@", "##name##", "$name$", "<%= name %>", "<% name %>", "{% name name %}", "<name aquí>", "<name here>", "XX_name_XX", "#{name}", "<?= $name ?>", "<?php name ?>", "[object Object]", "{{{name}}}", "&lt;name&gt;", "%(name)s", "{0}")
#: The exact check of a placeholder. A bracketed word counts if it names a field or asks to insert one.
FIELD = r"(?:t[ií]t(?:ulo|le|ol|re)|sub_?t[ií]tulo|name|nombre|nom|descri\w+|fecha\w*|date\w*|horarios?|hours?|precios?|price|prix|preu|ciudad|city|ville|ciutat|municipio|municipi|provincia|direcci[oó]n|address|tel[eé]fono|phone|email|url|link|imag\w*|image|texto?|text|contenido|content|item|poi|place|lugar|lloc|lieu|slug|categor\w+|tags?|autor|author|user|usuario)"
PLACEHOLDER = regex.compile(
    r"\{\{+[^{}]{0,80}\}\}+|\$\{[^{}]{0,80}\}|#\{[^{}]{0,80}\}|\{%[^{}]{0,80}%\}|<%=?[^<>]{0,80}%>|<\?(?:php|=)[^<>]{0,80}\?>|\[\[[^\[\]]{0,80}\]\]"
    r"|\{[\p{L}_][\w.]*\}|\{\d{1,2}\}|%%[\p{L}_][\w.]*%%|(?<![\w%])%[\p{L}_]+[\w.]*%(?!\w)|%\([\w.]+\)[sd]|@@[\p{L}_][\w.]*@@|##[\p{L}_][\w.]*##|\$[\p{L}_][\w.]*\$"
    r"|(?<!\w)__[\p{L}_][\w.]*?__(?!\w)|(?<!\w)X{2,}_[\w.]+?_X{2,}(?!\w)|<[\p{L}_][\w .]*\s+(?:aqu[ií]|here|ici)>"
    r"|\[(?:insert\w*|inserir|a[ñn]ad\w+|rellen\w+|complet\w+|ponga|your|su|tu|add|enter)\s[^\[\]]{0,60}\]"
    rf"|\[{FIELD}(?:[_ .]\w+)?\]|\[[\p{{Lu}}_]{{4,}}(?:[_ ][\p{{Lu}}_]+)*\]|<{FIELD}(?:[_.]\w+)?>|\[object \w+\]|\bundefined\b.*\bundefined\b|\bNaN\b.*\bNaN\b",
    regex.IGNORECASE | regex.V0,
)  # the capitals of [TITLE] are checked below, as the rest ignores case
_CAPS = regex.compile(r"^\[[\p{Lu}_ ]+\]$")
_FIELD = regex.compile(rf"^[\[<](?:insert\w*|inserir|a[ñn]ad\w+|rellen\w+|complet\w+|ponga|your|su|tu|add|enter|object)\b.*|^[\[<]{FIELD}(?:[_ .]\w+)?[\]>]$", regex.IGNORECASE)
_EMPTY = regex.compile(r"^\W*(?:(?:undefined|null|nan|none|nil|\[\]|n/a)\b\W*)+", regex.IGNORECASE)


def placeholder(text: str) -> bool:
    """Whether ``text`` has an unfilled placeholder, exactly."""
    for m in PLACEHOLDER.finditer(text):
        s = m[0]
        if s[0] == "[" and not s.startswith("[[") and not (_CAPS.match(s) or _FIELD.match(s)):
            continue
        return True
    return False


def codes(texts: list[str], shape: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The texts as numbers, one a character of any script, each led by N blanks, and where each begins. Digits are one sign, case is
    folded; for shapes all letters are one sign."""
    joined = [" " * N + t for t in texts]
    sizes = np.fromiter(map(len, joined), np.int64, len(joined))
    whole = "".join(joined)
    low = whole.lower()
    if len(low) != len(whole):  # lower case changed the length of a rare letter
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in whole)
    raw = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(raw < 256, _TABLES[shape][np.minimum(raw, 255)], ord("a") if shape else raw), np.concatenate([[0], np.cumsum(sizes)])


def _table(shape: bool) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    t[ord("0") : ord("9") + 1] = ord("0")
    t[[9, 10, 13, 160]] = ord(" ")
    if shape:
        t[ord("a") : ord("z") + 1] = ord("a")
        t[[c for c in range(192, 256) if c not in (215, 247)]] = ord("a")
        t[ord("0")] = ord("a")
    return t


_TABLES = {False: _table(False), True: _table(True)}


def grams(raw: np.ndarray) -> np.ndarray:
    """The bucket of the N-gram that ends at each position."""
    h = np.zeros(raw.size, np.uint64)
    for k in range(N):
        lag = np.empty_like(raw)
        lag[:k], lag[k:] = 32, raw[: raw.size - k] if k else raw
        h = h * np.uint64(1099511628211) + lag.astype(np.uint64)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def letter_pairs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the pair of letters that ends there, as one number, and whether it is one (of the first 256 signs)."""
    low = np.minimum(raw, 255).astype(np.int64)
    letter = _LETTER[low] & (raw < 256)
    both = letter & np.concatenate([[False], letter[:-1]])
    return np.concatenate([[0], low[:-1]]) * 256 + low, both


def gram_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket of n-grams and each pair of letters occurs over all texts of the column ``text``: 2^BITS and 2^16
    numbers, whatever the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + (1 << 16), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 4000):
                raw, _ = codes([t for t in b.column(0).slice(lo, 4000).to_pylist() if t])
                total[: 1 << BITS] += np.bincount(grams(raw), minlength=1 << BITS)
                pair, both = letter_pairs(raw)
                total[1 << BITS :] += np.bincount(pair[both], minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["g", "n"])

    rows = texts.select("text").mapInArrow(run, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((1 << BITS) + (1 << 16))
    out[rows["g"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=float)
    return out[: 1 << BITS], out[1 << BITS :]


def phrase_counts(phrases: str, shape: bool = False) -> np.ndarray:
    raw, _ = codes([p.strip() for p in phrases.strip().splitlines()], shape)
    return np.bincount(grams(raw), minlength=1 << BITS).astype(float)


def log_ratio(seen: np.ndarray, prose: np.ndarray) -> np.ndarray:
    """Per bucket the log likelihood ratio against prose, within [-3, 5]; an n-gram that the class does not know speaks against it.

    Both are shares of their class, so the ratios are alike at every size of the corpus.
    """
    p, q = (seen + 0.02) / (seen.sum() + 1), (prose + 0.5) / (prose.sum() + 1)
    ratio = np.clip(np.log(p / q), -3, 5)
    return np.where(seen == 0, np.minimum(ratio, -0.5), ratio).astype(np.float32)


def window_mean(x: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """The mean of the ``width`` values around each position."""
    c = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    lo, hi = np.maximum(0, np.arange(x.size) - width // 2), np.minimum(x.size, np.arange(x.size) + width // 2 + 1)
    return (c[hi] - c[lo]) / (hi - lo)


class Models:
    """Likelihood ratios of residue against prose, from n-gram counts. About 3 MB, sent with the tasks.

    ``notice`` and ``filler`` are the counts of texts found in a round before, on top of the phrases.
    """

    def __init__(self, prose: np.ndarray, pairs: np.ndarray, notice: np.ndarray | None = None, filler: np.ndarray | None = None):
        follows = pairs.reshape(256, 256)
        self.odd = ((follows + 0.05) / (follows.sum(axis=1, keepdims=True) + 1) < ODD).ravel()
        self.notice = log_ratio(phrase_counts(NOTICES) * 3 + (0 if notice is None else notice), prose)
        self.filler = log_ratio(phrase_counts(FILLER) * 3 + (0 if filler is None else filler), prose)
        framed = [f.format(s) for s in SHAPES for f in ("{}", "name {} name", "name, {}, name", "name ({}) name", "name. {}. name")]
        self.shape = phrase_counts("\n".join(framed), True) > 0

    def classes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text 0 (content), 1 (notice), 2 (filler) or 3 (placeholder), and the n-grams' buckets of all texts."""
        if not texts:
            return np.zeros(0, np.int8), np.zeros(0, np.int64)
        raw, at = codes(texts)
        g = grams(raw)
        sums = lambda x: np.add.reduceat(x.astype(np.int64), at[:-1])
        letter, solid = _LETTER[np.minimum(raw, 255)], raw != 32
        notice, filler = window_mean(self.notice[g]) > 0.6, window_mean(self.filler[g]) > 0.6
        covered = (notice | filler) & solid
        # Names (a capital and small letters) may stand in a notice as in any text: where not covered they don't count.
        name = _names(texts, letter) if raw.size else letter
        own, rest = sums(covered), sums(solid & ~covered & ~name)
        by = np.stack([sums(notice & solid), sums(filler & solid)])
        residue = (own >= np.minimum(8, sums(solid))) & (own >= COVERAGE * (own + rest)) & (by.max(axis=0) >= 0.3 * (own + rest)) & (own >= 0.2 * sums(solid))
        out = np.where(residue, 1 + by.argmax(axis=0), 0).astype(np.int8)
        # What is typed at random: most letters follow one that they hardly ever follow.
        pair, both = letter_pairs(raw)
        number = sums(both)
        residue = np.where((number >= 4) & (sums(self.odd[pair] & both) >= ODD_SHARE * number), 2, 0)
        out = np.where(out == 0, residue, out).astype(np.int8)
        # Placeholders: signs in a context of the shape model; the exact check follows.
        shaped, _ = codes(texts, True)
        for k in np.flatnonzero(sums(self.shape[grams(shaped)] & _SIGN[np.minimum(raw, 255)]) > 0):
            if placeholder(texts[k]):
                out[k] = 3
        for k in np.flatnonzero((out == 0) & (sums(solid) < 60)):
            if _EMPTY.match(texts[k]):
                out[k] = 2
        return out, g


def _names(texts: list[str], letter: np.ndarray) -> np.ndarray:
    """Which characters belong to words of a capital and small letters, by positions of ``codes``."""
    upper = np.frombuffer("".join([" " * N + t for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    high = ((upper >= 65) & (upper <= 90)) | ((upper >= 192) & (upper < 223) & (upper != 215))
    start = letter & ~np.concatenate([[False], letter[:-1]])
    first = start & high & np.concatenate([letter[1:] & ~high[1:], [False]])
    last = np.maximum.accumulate(np.where(start, np.arange(letter.size), 0))
    return letter & first[last]


_LETTER = np.array([chr(b).isalpha() for b in range(256)])
_SIGN = np.array([chr(b) in "{}[]$%_@<>#" for b in range(256)])


def find_residue(texts: DataFrame) -> DataFrame:
    """Rows of ``texts`` (columns table_name, record_id, text) that hold residue: (table_name, record_id).

    Missing, empty and blank texts are no case. Prose counts cover all given rows, whatever their length; the tables sent
    to the tasks have 2^BITS entries. Repeated rows are each judged; with unique ids none comes out twice.
    """
    present = texts.where(F.col("text").rlike(r"(?U)\S")).select("table_name", "record_id", "text")
    prose, pairs = gram_counts(present)
    models = Models(prose, pairs)

    def found_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, 1 << BITS), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.column(0).slice(lo, 2000).to_pylist()
                kind, _ = models.classes(part)
                for k in (1, 2):
                    raw, _ = codes([part[i] for i in np.flatnonzero(kind == k)])
                    total[k] += np.bincount(grams(raw), minlength=1 << BITS)
        for k in (1, 2):
            at = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(at.size, k)), pa.array(at), pa.array(total[k][at])], names=["k", "g", "n"])

    rows = present.select("text").mapInArrow(found_counts, "k bigint, g bigint, n bigint").groupBy("k", "g").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros((3, 1 << BITS))
    seen[rows["k"].to_numpy(dtype=np.int64), rows["g"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=float)
    models = Models(np.maximum(0, prose - seen[1] - seen[2]), pairs, seen[1], seen[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                kind, _ = models.classes(part.column("text").to_pylist())
                yield part.select(["table_name", "record_id"]).filter(pa.array(kind > 0))

    return present.mapInArrow(run, "table_name string, record_id bigint")


def evidence_and_entities(evidence: DataFrame, entities: DataFrame) -> DataFrame:
    """The texts of the problem: evidence other than whole pages, and the entities' source texts."""
    named = lambda df, name, key, text: df.select(F.lit(name).alias("table_name"), F.col(key).cast("bigint").alias("record_id"), F.col(text).alias("text"))
    other: Column = ~F.col("source_type").eqNullSafe("page")
    return named(evidence.where(other), "evidence", "evidence_id", "text").unionByName(named(entities, "entities", "entity_id", "sourceText"))
