"""Problem 9: passages of evaluation items inside documents.

Method: q-gram lemma filtering. A document that holds W consecutive words of an item, but for k edits of characters, holds a
stretch of at least n characters of its normalised text, where n is the length of the shortest W words in a row of any
item. By the q-gram lemma such a stretch shares at least n - q + 1 - k * q of its q-grams with the item, all of them within
k + 1 diagonals, so in one of the overlapping bands of 2 * (k + 1). Documents are probed at every s-th position only, and an edit
spoils at most ceil(q / s) probes, so at least (n - q + 1) // s - k * ceil(q / s) of them must hit in one band. A region that
reaches it is verified by banded alignment: from its q-grams the furthest item positions that 0 to k edits reach on the
diagonals of the band, to either side. The problem asks for equal words, k = 0.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Words in a row that make a leak, and the length of q-grams.
WORDS, Q = 12, 12
#: Items of at most so many characters are sent to each task with their q-grams; more are joined by q-gram.
ITEM_CHARS = 2_000_000
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_MARK = regex.compile(r"\p{M}+")


def normal_words(text: str) -> str:
    """The words of ``text`` (runs of letters or digits) without case and accents, each followed by one blank."""
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFD", text))
    text = text.casefold()
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFD", text))
    return " ".join(_WORD.findall(text))


def framed(text: str) -> str:
    """Normal words with a blank before and after each."""
    return f" {normal_words(text)} "


def shortest_run(t: str, words: int) -> int | None:
    """The length of the shortest ``words`` words in a row of a framed text, with the blanks around."""
    ends = [p for p, ch in enumerate(t) if ch == " "]
    return min((b - a + 1 for a, b in zip(ends, ends[words:])), default=None)


class Lemma:
    """What the q-gram lemma asks for: probes at every ``stride``-th position, of which ``need`` hit in a band.

    ``q`` is made shorter where so many edits could spoil every q-gram of the shortest stretch.
    """

    def __init__(self, shortest: int | None, q: int, edits: int):
        self.edits = edits
        self.usable = shortest is not None and shortest > edits
        self.q = q = max(1, min(q, ((shortest or 0) - edits) // (edits + 1)))
        grams = (shortest or 0) - edits - q + 1
        hits = lambda s: grams // s - edits * -(-q // s)
        # The widest stride that leaves two hits, else one.
        self.stride = next((s for n in (2, 1) for s in range(max(1, grams // 2), 0, -1) if hits(s) >= n), 1) if self.usable else 1
        self.need = max(1, hits(self.stride)) if self.usable else 1

    def bands(self, diagonal: int) -> tuple[int, ...]:
        """The bands a diagonal lies in: each overlaps half of the next."""
        b = diagonal // (self.edits + 1)
        return (b,) if not self.edits else (b - 1, b)


def reach(a: str, b: str, i: int, j: int, step: int, edits: int) -> list[int]:
    """The furthest positions of ``b`` that an alignment from (i, j) reaches with 0, 1, .. ``edits`` edits, to the right (step 1) or
    left (step -1). Positions lie between characters. Per edit and diagonal of the band only the furthest point is kept."""
    n, m = (len(a), len(b)) if step > 0 else (i, j)

    def slide(x: int, y: int) -> int:
        if step > 0:
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
        else:
            while x < n and y < m and a[i - 1 - x] == b[j - 1 - y]:
                x, y = x + 1, y + 1
        return y

    # y is the position in b, x - y the diagonal; leftwards both count back from (i, j).
    x0, y0 = (i, j) if step > 0 else (0, 0)
    at = {x0 - y0: slide(x0, y0)}
    out = [max(at.values())]
    for _ in range(edits):
        wider: dict[int, int] = {}
        for d, y in at.items():
            for d2, y2 in ((d, y + 1), (d + 1, y), (d - 1, y + 1)):
                if y2 <= m and d2 + y2 <= n and y2 > wider.get(d2, -1):
                    wider[d2] = y2
        at = {d: slide(d + y, y) for d, y in wider.items()} or at
        out.append(max(out[-1], *at.values()))
    return out if step > 0 else [j - y for y in out]


class ItemIndex:
    """The q-grams of items by text: (item, position) lists. Texts begin and end with a blank."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS, q: int = Q, edits: int = 0, lemma: Lemma | None = None):
        self.words, self.edits = words, edits
        self.items = [(i, framed(t)) for i, t in items if t]
        self.lemma = lemma or Lemma(min((n for _, t in self.items if (n := shortest_run(t, words))), default=None), q, edits)
        self.q = q = self.lemma.q
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, t) in enumerate(self.items):
            for p in range(len(t) - q + 1):
                at[t[p : p + q]].append((k, p))
        self.at = dict(at)

    def leaks(self, text: str) -> set[int]:
        """Ids of the items of which ``text`` has at least ``words`` consecutive words within the edits."""
        t, q, found, lemma = framed(text), self.q, set(), self.lemma
        at = self.at
        hits = [(p, h) for p in range(0, len(t) - q + 1, lemma.stride) if (h := at.get(t[p : p + q]))]
        if not hits or not lemma.usable:
            return found
        bands: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for p, where in hits:
            for k, x in where:
                for b in lemma.bands(p - x):
                    bands[k, b].append((p, x))
        for (k, _), seeds in bands.items():
            i, item = self.items[k]
            if i in found or len({p for p, _ in seeds}) < lemma.need:
                continue
            done: dict[int, int] = {}
            for p, x in seeds:
                if p + q <= done.get(p - x, -1):
                    continue
                right, left = reach(t, item, p + q, x + q, 1, self.edits), reach(t, item, p, x, -1, self.edits)
                done[p - x] = p - x + right[0]
                # Whole words lie between blanks.
                if any(item.count(" ", left[e], right[self.edits - e]) > self.words for e in range(self.edits + 1)):
                    found.add(i)
                    break
        return found


def gram_hash(gram: str) -> int:
    return xxhash.xxh64_intdigest(gram) - (1 << 63)


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "item_text", item_key: str = "item_id", words: int = WORDS, q: int = Q, edits: int = 0) -> DataFrame:
    """(``key``, ``item_key``): documents with at least ``words`` consecutive words of an item, each pair once.

    ``edits`` is how many characters may be added, dropped or changed in them (0: equal words). Missing and short texts
    (fewer words) have no leaks, on either side; equal items each count; a repeated document gives its pairs once if its
    key is repeated too. Items of up to ITEM_CHARS characters go to the tasks with their index and documents are neither
    shuffled nor gathered; beyond that the documents' probes are joined with the items' q-grams, still in one pass.
    """
    sized = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).cast("bigint").alias("i"), F.col(item_text).alias("item"))
    narrow = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)
    total = sized.agg(F.sum(F.length("item"))).first()[0] or 0
    found = indexed(narrow, [tuple(r) for r in sized.collect()], words, q, edits) if total <= ITEM_CHARS else joined(narrow, sized, words, q, edits)
    return found.select(F.col("k").cast(docs.schema[key].dataType).alias(key), F.col("i").cast(items.schema[item_key].dataType).alias(item_key)).distinct()


def batch(**cols: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols.values()], names=list(cols))


def indexed(docs: DataFrame, items: list[tuple[int, str]], words: int, q: int, edits: int) -> DataFrame:
    """(k, i) by an index of all items in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items, words, q, edits)
        for b in batches:
            pairs = [(k, i) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i in index.leaks(t)]
            yield batch(k=[k for k, _ in pairs], i=[i for _, i in pairs])

    return docs.mapInArrow(run, "k bigint, i bigint")


def joined(docs: DataFrame, items: DataFrame, words: int, q: int, edits: int) -> DataFrame:
    """(k, i) by joining probes with the items' q-grams; bands with enough hits give pairs, which are verified with their texts."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(n=[n for t in b.column(1).to_pylist() if (n := shortest_run(framed(t), words))])

    lemma = Lemma(items.mapInArrow(runs, "n bigint").agg(F.min("n")).first()[0], q, edits)
    q = lemma.q

    def grams(stride: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = framed(t)
                rows += [(k, p, gram_hash(t[p : p + q])) for p in range(0, len(t) - q + 1, stride)]
            yield batch(id=[r[0] for r in rows], p=[r[1] for r in rows], h=[r[2] for r in rows])

    probes = docs.mapInArrow(lambda it: grams(lemma.stride, it), "id bigint, p bigint, h bigint").withColumnsRenamed({"id": "k"})
    postings = items.mapInArrow(lambda it: grams(1, it), "id bigint, p bigint, h bigint").withColumnsRenamed({"id": "i", "p": "x"})
    first = F.floor((F.col("p") - F.col("x")) / (edits + 1))
    band = F.explode(F.array(first - 1, first) if edits else F.array(first))
    hits = probes.join(postings, "h").select("k", "i", "p", band.alias("band"))
    pairs = hits.groupBy("k", "i", "band").agg(F.count_distinct("p").alias("hits")).where(F.col("hits") >= (lemma.need if lemma.usable else 1 << 62)).select("k", "i").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            ok = [(k, i) for k, i, t, item in zip(d["k"], d["i"], d["t"], d["item"]) if ItemIndex([(i, item)], words, q, edits, lemma).leaks(t)]
            yield batch(k=[k for k, _ in ok], i=[i for _, i in ok])

    return cut(pairs).join(items, "i").join(docs, "k").select("k", "i", "t", "item").mapInArrow(verify, "k bigint, i bigint")
