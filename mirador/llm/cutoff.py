"""Problem 10: texts cut off by a field limit or a broken transfer.

Method: a trie of the corpus vocabulary tells whether the last word of a text is unknown but a proper prefix of known
words (cut within a word); the source's lengths tell whether the text ends just at a limit. A cut after a whole word shows
in neither; there the trie goes on from words to their sequences: a path of the last masked words that the corpus nearly
always continues, and where texts and sentences hardly ever end, breaks off.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

#: A length is a source's limit if no text of the source is longer and this share of its texts, and so many, have it.
LIMIT_SHARE, LIMIT_ROWS = 0.03, 5
#: A context ends whole texts if this share of its occurrences (the text's own left out) ends a line or, before dots, a sentence.
END_SHARE = 0.25
#: Tokens a task counts before it hands the counts on.
HOLD = 4_000_000
#: A last line or sentence of at most so many tokens is looked up whole. Sizes this near the limit may be cut at the last word.
LINE, SOFT = 6, 15
_TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}]*|[0-9]+|\n|[^\s\p{L}0-9]")
_ADDRESS = regex.compile(r"(?:https?://|www\.)\S+|[\w.+-]+@[\w.-]+\w")
_TAG = regex.compile(r"(?<!\w)#\w+")
_EOL = regex.compile(r"\s*[\r\n\x0b\x0c\x85\u2028\u2029]\s*")
#: What may follow a break: signs of going on, broken characters, tags and entities.
_MARK = regex.compile(
    r"(?:[\[(]\s*(?:\+|…|\.{2,3}|sigue|contin[uú]a|cont\.?|m[aá]s|more|suite|segueix|\+\s*info|leer m[aá]s|read more|lire la suite|llegir m[eé]s)\s*[\])]"
    r"|(?:leer|ver|read|see|llegir|lire)\s+(?:m[aá]s|more|m[eé]s|la suite)|(?:sigue|seguir) leyendo|continuar leyendo|continue reading|\[|»»|>>+|→|�+|<[\p{L}/!][^<>]*|<|&#?\w{0,7}|\\u?[0-9a-fA-F]{0,4}|%[0-9A-Fa-f]?)\s*$",
    regex.IGNORECASE,
)
_DOTS = regex.compile(r"\s*(?:…|\.{2,})\s*$")
_WHOLE = regex.compile(r"[.!?][\"'»”’)\]*_]*$")
#: Token classes: plain words and signs, words with a capital, words that join the parts of a name, ends of sentences, of lines, and
#: signs after which a capital says nothing.
PLAIN, CAPITAL, JOIN, STOP, LINE_END, OPENING = range(6)
_OF = {**{c: STOP for c in ".!?…"}, "\n": LINE_END, **{c: OPENING for c in "¿¡«"}, **{w: JOIN for w in ("de", "del", "d", "of")}}


def _code(t: str) -> int:
    """A number for a token that is the same in every process, never 0."""
    return (zlib.crc32(t.encode("utf-8", "surrogatepass")) << 20 ^ len(t)) + 1


NAME, NUMBER, ADDRESS, TAG = (_code(x) for x in ("<N>", "<0>", "<U>", "<T>"))
NEWLINE = _code("\n")


class Vocabulary(dict):
    """token -> position in ``codes`` and ``classes``; both grow as tokens come."""

    def __init__(self):
        self.words: list[str] = []
        self.codes: list[int] = []
        self.classes: list[int] = []

    def __missing__(self, t: str) -> int:
        k = self[t] = len(self.words)
        self.words.append(t)
        self.codes.append(NUMBER if t[0] in "0123456789" else ADDRESS if t == "\uffff" else TAG if t == "\ufffe" else _code(t))
        self.classes.append(_OF.get(t, CAPITAL if t[0].isupper() else PLAIN))
        return k


def tokens(text: str) -> list[str]:
    if "\n" in text or "\r" in text or "\u2028" in text or "\x85" in text or "\x0b" in text or "\x0c" in text:
        text = _EOL.sub("\n", text)
    if "@" in text or "://" in text or "www." in text:
        text = _ADDRESS.sub("\uffff", text)
    if "#" in text:
        text = _TAG.sub("\ufffe", text)
    return _TOKEN.findall(text)


def masked(codes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' codes with names as one sign, and which of the tokens stay: names of several parts are one.

    A capital counts as a name unless it begins a sentence or line.
    """
    before = np.concatenate([[LINE_END], classes[:-1]])
    name = (classes == CAPITAL) & (before != STOP) & (before != LINE_END) & (before != OPENING)
    m = np.where(name, NAME, codes)
    keep = np.ones(len(m), bool)
    keep[1:] &= ~(name[1:] & name[:-1])
    joined = name[2:] & (classes[1:-1] == JOIN) & name[:-2]
    keep[2:] &= ~joined
    keep[1:-1] &= ~joined
    return m, keep


_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The hash of a sequence with one more token."""
    h = (h ^ x.astype(np.uint64)) * _M1
    h ^= h >> np.uint64(32)
    h *= _M2
    return h ^ (h >> np.uint64(29))


def chain(parts: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(parts[0]), _M3, np.uint64)
    for x in parts:
        h = _mix(h, x)
    return h.astype(np.int64)


def tail(text: str) -> tuple[str, bool, bool]:
    """The text without outer white space, closing marks and dots; whether there were marks and dots."""
    core, marks, dots = text.rstrip(), False, False
    while core:
        if m := _MARK.search(core, max(0, len(core) - 300)):
            core, marks = core[: m.start()].rstrip(), True
        elif m := _DOTS.search(core, max(0, len(core) - 30)):
            core, dots = core[: m.start()].rstrip(), True
        else:
            break
    return core, marks, dots


def tally(keys: np.ndarray, stops: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per distinct key how often it occurs, and before the end of a sentence and of a line."""
    if not keys.size:
        return keys, keys, keys, keys
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.diff(np.append(first, len(k))), np.add.reduceat(stops[order].astype(np.int64), first), np.add.reduceat(ends[order].astype(np.int64), first)


_KINDS = "kind string, word string, k bigint, n bigint, stops bigint, ends bigint"
_TAILS = "source string, size int, whole boolean, marks boolean, dots boolean, core boolean, c3 bigint, c2 bigint, line bigint, end bigint"


def read_texts(docs: DataFrame) -> DataFrame:
    """One pass over (id, source, text): counts of all texts and what the end of each shows, in rows told apart by ``kind``.

    Counts (k, n, stops, ends): how often a word (kind w), a context of three or two masked tokens (c, d) or the beginning of
    a line or sentence up to LINE masked tokens (l) occurs within texts, is followed by the end of a sentence, and by the end
    of a line; contexts are known by their hash. The last word of a text counts for nothing here, so that a cut word does not
    become known. Each task hands on sums.

    Ends (kind t): whether a text ends whole, has marks or dots, its last word, its last contexts, its last line or sentence
    if that has at most LINE tokens (``line``), and a hash that tells ends of equal texts from others (``end``).
    """
    key = docs.schema["id"].dataType.simpleString()
    counts = [f.split()[0] for f in _KINDS.split(", ")]
    tails = ["id", *(f.split()[0] for f in _TAILS.split(", "))]
    tail_types = {"source": pa.string(), "size": pa.int32(), **{c: pa.bool_() for c in ("whole", "marks", "dots", "core")}, **{c: pa.int64() for c in ("c3", "c2", "line", "end")}}
    count_types = {"kind": pa.string(), "word": pa.string(), **{c: pa.int64() for c in ("k", "n", "stops", "ends")}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, ...]]] = {"c": [], "d": [], "l": []}
        words: dict[str, list[int]] = {}
        size, id_type = 0, None

        def rows(height: int, **cols) -> pa.RecordBatch:
            types = count_types | {"id": id_type} | tail_types
            order = [*counts, *tails]
            return pa.RecordBatch.from_arrays([cols[c] if isinstance(cols.get(c), pa.Array) else pa.array(cols[c], types[c]) if c in cols else pa.nulls(height, types[c]) for c in order], names=order)

        def hand_on() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if parts:
                    k, n, st, en = (np.concatenate(x) for x in zip(*parts))
                    order = np.argsort(k, kind="stable")
                    k = k[order]
                    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                    n, st, en = (np.add.reduceat(x[order], first) if len(first) else x for x in (n, st, en))
                    yield rows(len(first), kind=[kind] * len(first), k=k[first], n=n, stops=st, ends=en)
                parts.clear()
            if words:
                n, st, en = zip(*words.values())
                yield rows(len(words), kind=["w"] * len(words), word=list(words), n=n, stops=st, ends=en)
            words.clear()

        for b in batches:
            id_type = b.column(0).type
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                texts = part.column(2).to_pylist()
                ended = [tail(t) for t in texts]
                v = Vocabulary()
                flat: list[int] = []
                edge = v["\n"]
                for core, _, _ in ended:
                    # Two line ends set a text apart, so no context reaches over it: -1 marks where it ends.
                    flat += [edge, edge, *[v[x] for x in tokens(core)], -1]
                at = np.array(flat, np.int64)
                end = at == -1
                at[end] = edge
                codes, classes = np.array(v.codes, np.int64)[at], np.array(v.classes, np.int8)[at]
                codes[end] = 0
                # Words: all but the last of each text.
                open_ = np.concatenate([end[1:], [False]]) | end
                nxt = np.concatenate([classes[1:], [LINE_END]])
                inside = np.flatnonzero(~open_)
                k, n, st, en = tally(at[inside], nxt[inside] == STOP, nxt[inside] == LINE_END)
                for i, *x in zip(k.tolist(), n.tolist(), st.tolist(), en.tolist()):
                    w = v.words[i]
                    if w[0].isalpha():
                        o = words.setdefault(w, [0, 0, 0])
                        o[0] += x[0]
                        o[1] += x[1]
                        o[2] += x[2]
                last_words = [w if (w := v.words[i])[0].isalpha() else "" for i in at[np.flatnonzero(end) - 1].tolist()]
                m, keep = masked(codes, classes)
                keep |= end
                m, c, e = m[keep], classes[keep], end[keep]
                closing = (c == STOP) | (c == LINE_END)
                # Contexts are followed by a token of the same text.
                last = np.flatnonzero(~e[2:-1] & ~e[3:] & ~e[1:-2] & ~e[:-3]) + 2 if len(m) > 3 else np.zeros(0, np.int64)
                stops, ends = c[last + 1] == STOP, c[last + 1] == LINE_END
                held["c"].append(tally(chain([m[last - 2], m[last - 1], m[last]]), stops, ends))
                held["d"].append(tally(chain([m[last - 1], m[last]]), stops, ends))
                start = np.flatnonzero(closing[:-1] & ~e[:-1]) + 1
                h, alive = np.full(len(start), _M3, np.uint64), np.ones(len(start), bool)
                for k in range(LINE):
                    p = start + k
                    alive &= p < len(m) - 1
                    p = np.minimum(p, len(m) - 2)
                    alive &= ~e[p] & ~closing[p]
                    h = _mix(h, m[p])
                    ok = alive & ~e[p + 1]
                    held["l"].append(tally(h[ok].astype(np.int64), c[p[ok] + 1] == STOP, c[p[ok] + 1] == LINE_END))
                # The ends of the texts, in the same arrays.
                z = np.flatnonzero(e) - 1
                at_ = lambda back: m[np.maximum(z - back, 0)]
                c3, c2 = chain([at_(2), at_(1), at_(0)]), chain([at_(1), at_(0)])
                line, known = np.zeros(len(z), np.int64), closing[z]
                none = known.copy()
                for k in range(1, LINE + 1):
                    here = ~known & closing[np.maximum(z - k, 0)]
                    if here.any():
                        line[here] = chain([m[z[here] - j] for j in range(k - 1, -1, -1)])
                    known = known | here
                none |= ~known
                yield rows(
                    len(texts), kind=["t"] * len(texts), word=last_words, id=part.column(0), source=part.column(1), size=list(map(len, texts)),
                    whole=[bool(_WHOLE.search(x[-12:])) for x, _, _ in ended], marks=[x for _, x, _ in ended], dots=[x for _, _, x in ended], core=[bool(x) for x, _, _ in ended],
                    c3=c3, c2=c2, line=pa.array(line, pa.int64(), mask=none), end=[int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for x, _, _ in ended],
                )
                size += len(m)
                if size > HOLD:
                    yield from hand_on()
                    size = 0
        yield from hand_on()

    return docs.select("id", "source", "text").mapInArrow(run, f"{_KINDS}, id {key}, {_TAILS}")


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, cut) for every text that is not missing or blank."""
    named = docs.select(F.col(key).alias("id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text")).where(F.col("text").rlike(r"(?U)\S"))
    read = cut(read_texts(named))
    stats = cut(read.where("kind <> 't'").groupBy("kind", "word", "k").agg(*[F.sum(c).alias(c) for c in ("n", "stops", "ends")]))
    ends = read.where("kind = 't'").drop("kind", "k", "n", "stops", "ends")

    # The trie of the vocabulary as a table of its nodes: a proper prefix of a known word is a node with children.
    words = stats.where("kind = 'w'").select("word", F.col("n").alias("nw"), (F.col("stops") + F.col("ends")).alias("ew"))
    prefixes = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))
    nodes = words.where(F.length("word") > 1).select(F.explode(prefixes).alias("word")).distinct().withColumn("inner", F.lit(True))
    asked = ends.where("word <> ''").select("word").distinct()
    known = asked.join(words, "word", "left").join(nodes, "word", "left")

    # Contexts: what the corpus shows within texts, and the open ends of texts (equal texts count once).
    open_ends = ends.where("not whole and not marks").select("c3", "c2", "line", "dots", "end").distinct()

    def context(level: str, inside: DataFrame) -> DataFrame:
        own = open_ends.where(F.col(level).isNotNull()).groupBy(level).agg(F.count_distinct(F.when(~F.col("dots"), F.col("end"))).alias("bare"), F.count_distinct(F.when(F.col("dots"), F.col("end"))).alias("dotted"))
        return own.join(inside, level, "left").select(level, F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n", "stops", "ends", "bare", "dotted")]).alias(f"of_{level}"))

    three, two, lines = (stats.where(F.col("kind") == k).select(F.col("k").alias(c), "n", "stops", "ends") for k, c in (("c", "c3"), ("d", "c2"), ("l", "line")))

    # A source's limit is its largest size, if many of its texts have just this (hard) or nearly this (soft).
    sizes = cut(ends.groupBy("source", "size").agg(F.count("*").alias("m")))
    largest = sizes.groupBy("source").agg(F.max("size").alias("limit"), F.sum("m").alias("all"))
    limits = sizes.join(largest, "source").where(F.col("size") >= F.col("limit") - SOFT).groupBy("source", "limit", "all").agg(F.sum("m").alias("near"), F.max_by("m", "size").alias("just"))
    many = lambda c: (F.col(c) >= LIMIT_ROWS) & (F.col(c) >= LIMIT_SHARE * F.col("all"))
    limits = limits.select("source", "limit", many("just").alias("hard"), many("near").alias("soft"))

    e = ends.join(known, "word", "left").join(context("c3", three), "c3", "left").join(context("c2", two), "c2", "left").join(context("line", lines), "line", "left").join(limits, "source", "left")

    def share(level: str):
        """The share of ends after a context, without the text's own end; null if nothing else is known of it."""
        x = F.col(f"of_{level}")
        dotted = F.col("dots")
        all_ = x["n"] + x["bare"] + x["dotted"] - 1
        ends_ = x["ends"] + x["bare"] + F.when(dotted, x["stops"] + x["dotted"]).otherwise(0) - 1
        return F.when(all_ > 0, ends_ / all_)

    # A whole short line that others have too decides first, then the longer context.
    ending = F.coalesce(F.when(F.col("line").isNotNull(), share("line")), share("c3"), share("c2"), F.lit(0.0))
    word = F.col("word") != ""
    within = word & F.col("nw").isNull() & F.col("inner").isNotNull()
    never = word & (F.col("ew") + 0.1 < 0.01 * F.col("nw")) & ~(F.coalesce(F.when(F.col("line").isNotNull(), share("line")), F.lit(0.0)) >= END_SHARE)
    hard = F.coalesce(F.col("hard") & (F.col("size") == F.col("limit")), F.lit(False))
    soft = F.coalesce(F.col("soft") & (F.col("size") >= F.col("limit") - SOFT), F.lit(False))
    breaks = within | F.coalesce(never, F.lit(False)) | hard | (ending < F.when(F.col("dots") & soft, F.lit(0.9)).otherwise(END_SHARE))
    cut_off = F.col("marks") | F.col("core") & ~F.col("whole") & breaks
    return e.select("id", "source", cut_off.alias("cut"))


def find_cut(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(``key``): texts that break off within a word or sentence, whatever mark follows; each key once.

    Missing and blank texts are no case; a null source is a source of its own, ''. Vocabulary, contexts and lengths are
    counted over all texts, in each task first, so hot sources and repeated texts cost their distinct words only.
    """
    return judged(docs, key, text, source).where("cut").select(F.col("id").alias(key)).distinct()


def cut_rates(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(source, texts, cut, share): how many texts each source has that are not blank, and how many it cuts."""
    return judged(docs, key, text, source).groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"), F.round(F.count_if("cut") / F.count("*"), 4).alias("share"))
