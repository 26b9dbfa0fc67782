"""Problem 5: page boilerplate mixed with main content.

Method: wrapper induction. A page is a tree: page, lines, sentences of paragraphs, tokens. Each page is aligned with several
pages of its host by simple tree matching: the heaviest order-preserving matching of lines of one template, weighed by the
tokens they share. What alignments find again is a node of the host's wrapper or a frame with slots; templates that
they find too seldom are looked up in all other pages, and what is found nowhere is content. Of the templates found, a
sentence is a constant node (wrapper) if its lines share nearly all tokens with the lines of all other pages of their host, else a frame whose slots vary (content); a paragraph is content if its children vary, that is if its sentence
frames stand first in some paragraphs and later in others. Rows and lists of short items are wrapper. Short lines and names
are judged by the place of their template in its pages. Evidence is added up over all hosts, as many have few pages. Last,
names are settled by their neighbours: those of a side box follow its label, the page's own heading leads the text.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import site
from ..sources.tables import checked_broadcast, cut

#: Each page is aligned with so many pages before it. Pages of a host are laid out in pieces of PIECE pages, so a hot host is aligned
#: by many tasks; hosts of fewer than SMALL pages share a piece with others.
NEIGHBOURS, PIECE, SMALL = 8, 2_000, 9
#: Short lines of at most so many words one below the other are the items of a list.
ITEM = 4
#: Two lines match if they share a template and this part of their tokens; those that share STEADY of them are constant.
SHARED, STEADY = 0.3, 0.9
#: A template's place in its pages counts from so many lines. A template is a node of a wrapper only if alignments found it MATCHES times.
SUPPORT, MATCHES = 5, 2
#: Short lines of a template with fewer lines than this share the evidence of all short lines, if so many of these per line were matched.
FEW, FOUND = 25, 0.1
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’.]*|\d+|[^\w\s]")
_SENTENCE = regex.compile(r"(?<=[.!?…])(?<!\b\p{Lu}\p{L}{0,2}\.)[\"»”)]*\s+(?=[\p{Lu}¿¡«\"“])")
_MONEY = regex.compile(r"(?:€|\bEUR\b|\beuros?\b|\$|£)\s*$|^\W*\p{L}[^:]*:\s*(?:€|\$|£)\s*\d|:\s*(?:gratis|gratuit[oa]?|free|libre)\s*$", regex.IGNORECASE)
_SEPARATED = regex.compile(r"\s+[|/·»>›•\-–+]\s+|\s{2,}|\s[»›>]\s")
_BULLET = regex.compile(r"^\s*[>+•»›<▸▪←→^]\s*\S")
_LISTED, _CLOSED, _ENDED, _POINTED = (regex.compile(p) for p in (r"^\W*[-–·*•]\s", r"[.!?]$", r"[.!?…][\"»”)]*$", r"[.!?:,;…]$"))
_NUMBERS = regex.compile(r"\d+")


def frame(words: list[str], caps: bool) -> str:
    """The first three tokens, runs of names and numbers masked."""
    out: list[str] = []
    for i, w in enumerate(words):
        x = "0" if w[0].isdigit() else "X" if i and w[0].isupper() and not caps else w.lower()
        if x == "X" and out and out[-1] == "X":
            continue
        out.append(x)
        if len(out) == 3:
            break
    return " ".join(out)


def shape(line: str) -> tuple[str, str, list[str]]:
    """The kind of a non-blank line, its template and, of a paragraph, the templates of its sentences.

    Kinds stand for the tags that text has lost: menu (a row of short items), fact (a price), multi (a paragraph of several
    sentences), sent (one sentence), name (a short line of a name's form), short (any other; lines_of makes those that stand
    together the items of a list).
    """
    t = " ".join(line.split())
    words = _WORD.findall(t)
    caps = t.isupper()
    head = frame(words[:24], caps)
    alpha = [w for w in words if w[0].isalpha()]
    if _MONEY.search(t) and (_LISTED.match(t) or len(alpha) <= 12 and ":" in t):
        return "fact", "money", []
    ended = _ENDED.search(t) is not None
    if not (ended and _CLOSED.search(t)):
        parts = [p for p in _SEPARATED.split(line.strip()) if p.strip()]
        if _BULLET.match(line) or len(parts) >= 2 and all(len(p.split()) <= 7 for p in parts):
            return "menu", "menu", []
    if len(t) > 40:
        parts = [s for s in _SENTENCE.split(t) if s.count(" ") >= 3]
        if len(parts) >= 2:
            return "multi", head, [frame(_WORD.findall(s[:120]), caps) for s in parts]
    if len(alpha) >= 7 and ended:
        return "sent", head, [head]
    if len(alpha) <= 9 and not _POINTED.search(t) and not any(w[0].isdigit() for w in words) and (alpha and (alpha[0][0].isupper() or caps) and sum(w[0].isupper() for w in alpha) >= 2 or caps):
        return "name", head, []
    return "short", head, []


Line = tuple[int, str, str, list[str], str]


def lines_of(text: str) -> list[Line]:
    """(line number, kind, template, sentences' templates, the line in normal form) of the lines that are not blank."""
    out = []
    for i, line in enumerate(text.split("\n")):
        if line.strip():
            out.append((i, *shape(line), " ".join(_NUMBERS.sub("0", line.lower()).split())))
    few = [x[1] == "short" and x[4].count(" ") < ITEM and ":" not in x[4] for x in out]
    for k, x in enumerate(out):
        if few[k] and (k and few[k - 1] or k + 1 < len(out) and few[k + 1]):
            out[k] = (x[0], "item", "item", [], x[4])
    return out


def shared(a: str, b: str) -> float:
    """The part of the tokens that two lines share, by the longer one."""
    if a == b:
        return 1.0
    x, y = a.split(), b.split()
    left: dict[str, int] = {}
    for w in x:
        left[w] = left.get(w, 0) + 1
    n = 0
    for w in y:
        k = left.get(w, 0)
        if k:
            left[w] = k - 1
            n += 1
    return n / max(len(x), len(y))


def match(a: list[Line], b: list[Line]) -> list[tuple[int, int, float]]:
    """Simple tree matching of two pages: the heaviest order-preserving matching of lines of one template, as (i, j, shared tokens).

    Lines can match if they share SHARED of their tokens, which are their weight. Only lines of one template are compared; of a
    template that both pages repeat the k-th line is compared with the k-th, so a long page costs its lines, not their square.
    """
    at: dict[tuple[str, str], list[int]] = {}
    for j, y in enumerate(b):
        at.setdefault((y[1], y[2]), []).append(j)
    open_: list[tuple[int, int, float]] = []
    met: dict[tuple[str, str], int] = {}
    for i, x in enumerate(a):
        k = (x[1], x[2])
        js = at.get(k)
        if not js:
            continue
        nth = met[k] = met.get(k, -1) + 1
        if len(js) > 3:
            js = js[nth : nth + 1]
        for j in js:
            w = shared(x[4], b[j][4])
            if w >= SHARED:
                open_.append((i, j, w))
    if len(open_) < 2:
        return open_
    # The heaviest increasing chain: per candidate (i, j) the best one that ends before it, by a tree of prefix maxima over j.
    size = len(b) + 1
    tree: list[tuple[float, int]] = [(0.0, -1)] * (size + 1)
    score, back = [0.0] * len(open_), [-1] * len(open_)
    k = 0
    while k < len(open_):
        e = k
        while e < len(open_) and open_[e][0] == open_[k][0]:
            best, j = (0.0, -1), open_[e][1]
            while j > 0:
                best = max(best, tree[j])
                j -= j & -j
            score[e], back[e] = best[0] + open_[e][2], best[1]
            e += 1
        for q in range(k, e):
            j = open_[q][1] + 1
            while j <= size:
                tree[j] = max(tree[j], (score[q], q))
                j += j & -j
        k = e
    q = max(range(len(open_)), key=lambda q: score[q])
    out = []
    while q >= 0:
        out.append(open_[q])
        q = back[q]
    return out[::-1]


_COUNTS = ("n", "before", "after", "first", "last", "late", "label", "matched", "later")


def marked(form: str) -> str:
    """The tokens of a line, each repeated one with its number, so that all are different; shares with other such lines stay."""
    met: dict[str, int] = {}
    out = []
    for w in form.split():
        k = met[w] = met.get(w, 0) + 1
        out.append(w if k == 1 else f"{w}\x01{k}")
    return " ".join(out)


def page_key(page: list[Line]) -> int:
    """The same number for pages that were loaded twice."""
    return int.from_bytes(blake2b("\n".join(f"{x[1]} {x[4]}" for x in page).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def read_pages(pages: DataFrame) -> DataFrame:
    """The lines of all pages (table_name, record_id, line_no, kind, head, and what :func:`steadiness` and :func:`rest` need: host,
    place, page, nth line of its template, form) and, where line_no is null, each task's evidence per template (kind, head and
    counts). ``pages`` is laid out by piece; each page is aligned with the NEIGHBOURS pages of its piece before it, which settles
    most templates; the partners that are further away are found by :func:`rest`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0] * len(_COUNTS))
        piece, before = None, deque(maxlen=NEIGHBOURS)
        for b in batches:
            lines: list[tuple] = []
            for own_piece, host, t, table_name, record in zip(*(b.column(i).to_pylist() for i in range(5))):
                own = lines_of(t)
                text = [x[1] == "multi" or x[1] == "sent" for x in own]
                lead = next((i for i, x in enumerate(own) if x[1] == "multi"), None)
                key, nth = page_key(own), defaultdict(int)
                place = "" if own_piece.startswith(":") else host
                for i, (no, kind, head, frames, form) in enumerate(own):
                    c = seen[kind, head]
                    c[0] += 1
                    c[1] += i > 0 and text[i - 1]
                    c[2] += i + 1 < len(own) and (text[i + 1] or own[i + 1][1] == "fact")
                    c[3] += i == 0
                    c[4] += i == len(own) - 1
                    c[5] += lead is not None and i > lead
                    c[6] += i + 1 < len(own) and own[i + 1][1] == "name"
                    lines.append((table_name, record, no, kind, head, host, place, key, nth[kind, head], marked(form)))
                    nth[kind, head] += 1
                    # Sentences of a paragraph after its first: where one frame comes first here and later there, the
                    # paragraph's children vary.
                    for f in frames[1:]:
                        seen["multi", f][8] += 1
                        seen["sent", f][8] += 1
                if own_piece != piece:
                    piece = own_piece
                    before.clear()
                for page in before:
                    pairs = match(page, own)
                    if len(pairs) == len(own) == len(page) and all(w == 1 for _, _, w in pairs):
                        continue  # a page loaded twice shows nothing
                    for _, j, _ in pairs:
                        seen[own[j][1], own[j][2]][7] += 1
                before.append(own)
            yield of_lines(lines)
            if len(seen) > 200_000:
                yield out(seen)
        yield out(seen)

    def batch(cols: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    def of_lines(lines: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*lines)) if lines else [[]] * 10
        return batch([*map(list, cols), *[[None] * len(lines)] * len(_COUNTS)])

    def out(seen: dict) -> pa.RecordBatch:
        n = len(seen)
        cols = [[None] * n, [None] * n, [None] * n, [k[0] for k in seen], [k[1] for k in seen], *[[None] * n] * 5, *[[int(c[i]) for c in seen.values()] for i in range(len(_COUNTS))]]
        seen.clear()
        return batch(cols)

    names = ["table_name", "record_id", "line_no", "kind", "head", "host", "place", "page", "nth", "form", *_COUNTS]
    types = [pa.string(), pa.int64(), pa.int32(), *[pa.string()] * 4, pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * len(_COUNTS)]
    return pages.select("piece", "host", "text", "table_name", "record_id").mapInArrow(run, "table_name string, record_id bigint, line_no int, kind string, head string, host string, place string, page bigint, nth int, form string, " + ", ".join(f"{c} bigint" for c in _COUNTS))


def laid_out(pages: DataFrame) -> DataFrame:
    """``pages`` (table_name, record_id, url, text) with ``piece``, pages of one host to be aligned in one task, spread evenly.

    Hosts of many pages are cut into pieces of about PIECE by the hash of the record; pages of hosts under SMALL pages, and
    those without a host, share pieces by the hash of the host (or record).
    """
    p = pages.where(F.col("text").rlike(r"(?U)\S")).select("table_name", "record_id", F.coalesce(site(F.col("url")), F.lit("")).alias("host"), "text")
    hosts = cut(p.groupBy("host").agg(F.count("*").alias("pages")))
    total, strays = hosts.agg(F.sum("pages"), F.sum(F.when((F.col("host") == "") | (F.col("pages") < SMALL), F.col("pages")))).first()
    record = F.xxhash64("table_name", "record_id")
    stray = (F.col("host") == "") | (F.col("pages") < SMALL)
    shelves = F.lit(1 + (strays or 0) // PIECE)
    piece = F.when(stray, F.concat_ws(":", F.lit(""), F.pmod(F.when(F.col("host") == "", record).otherwise(F.xxhash64("host")), shelves))).otherwise(
        F.concat_ws(":", F.col("host"), F.pmod(record, 1 + F.floor(F.col("pages") / PIECE)))
    )
    tasks = max(3 * p.sparkSession.sparkContext.defaultParallelism, (total or 0) // (3 * PIECE))
    known = p.join(checked_broadcast(hosts), "host").select("table_name", "record_id", piece.alias("piece"), "host", "text")
    return known.repartition(tasks, "piece").sortWithinPartitions("piece", F.xxhash64("table_name", "record_id"))


def template_evidence(read: DataFrame) -> DataFrame:
    """(kind, head, counts): the evidence of all tasks added up, with that of the pages that are no neighbours."""
    near = cut(read.where("line_no is null").groupBy("kind", "head").agg(*[F.sum(c).alias(c) for c in _COUNTS]))
    more = near.join(rest(read, near), ["kind", "head"], "left").join(steadiness(read), ["kind", "head"], "left")
    counts = {"matched": F.greatest("matched", F.coalesce("further", F.lit(0)))}
    return more.select("kind", "head", *[counts.get(c, F.col(c)).alias(c) for c in _COUNTS], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("own", "constant")])


def rest(read: DataFrame, near: DataFrame) -> DataFrame:
    """(kind, head, further): of templates that neighbours matched under MATCHES times, how often lines of any two pages of a place
    match (a host, or the hosts of few pages together), MATCHES at most: with these a template is settled."""
    open_ = cut(near.where((F.col("n") > 1) & (F.col("matched") < MATCHES) & (F.col("kind") != "fact")).select("kind", "head"))
    lines = read.where("line_no is not null").join(checked_broadcast(open_), ["kind", "head"]).select("place", "kind", "head", "page", "form").distinct()
    names = ["kind", "head", "further"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, found, by_form, by_token = None, 0, {}, {}
        out: list[tuple] = []
        for b in batches:
            for place, kind, head, page, form in zip(*(b.column(i).to_pylist() for i in range(5))):
                if group != (place, kind, head):
                    if found:
                        out.append((*group[1:], found))
                    group, found, by_form, by_token = (place, kind, head), 0, {}, {}
                if found >= MATCHES:
                    continue
                tokens = form.split()
                met: dict[str, int] = defaultdict(int)
                for w in tokens:
                    for f in by_token.get(w, ()):
                        met[f] += 1
                for f, k in met.items():
                    if k >= SHARED * max(len(tokens), f.count(" ") + 1):
                        found += sum(p != page for p in by_form[f])
                        if found >= MATCHES:
                            break
                found = min(found, MATCHES)
                if form not in by_form:
                    for w in tokens:
                        by_token.setdefault(w, []).append(form)
                by_form.setdefault(form, []).append(page)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], names=names)
                out = []
        if found:
            out.append((*group[1:], found))
        cols = list(zip(*out)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()))], names=names)

    sorted_ = lines.repartition("place", "kind", "head").sortWithinPartitions("place", "kind", "head", "page", "form")
    return sorted_.mapInArrow(run, "kind string, head string, further bigint").groupBy("kind", "head").agg(F.sum("further").alias("further"))


def steadiness(read: DataFrame) -> DataFrame:
    """(kind, head, own, constant) of sentences and names: lines that share SHARED of their tokens with their node of the host's
    wrapper, and those that share STEADY.

    A node are the n-th lines of one template in all pages of a host, pages loaded twice once. What a line shares with it is the
    mean over all other lines of the node, which is a sum of its tokens' counts: so every page is compared with all of its host,
    and a node costs its tokens, not its pairs of lines.
    """
    x = read.where("line_no is not null and host <> '' and kind in ('sent', 'name')").select("host", "page", "kind", "head", "nth", "form").distinct()
    x = x.select("kind", "head", F.xxhash64("host", "kind", "head", "nth").alias("node"), F.xxhash64("host", "page", "kind", "head", "nth").alias("id"), F.split("form", " ").alias("ws"))
    x = cut(x.select("kind", "head", "node", "id", F.transform("ws", lambda w: F.xxhash64(w)).alias("ws")))
    nodes = x.groupBy("node").agg(F.count("*").alias("lines"), F.sum(F.size("ws")).alias("tokens")).where("lines > 1")
    each = x.join(nodes, "node").select("kind", "head", "node", "id", "lines", "tokens", F.size("ws").alias("size"), F.explode("ws").alias("w"))
    counts = each.groupBy("node", "w").agg(F.count("*").alias("c"))
    met = each.join(counts, ["node", "w"]).groupBy("kind", "head", "id", "lines", "tokens", "size").agg(F.sum(F.col("c") - 1).alias("met"))
    others = F.col("lines") - 1
    share = F.col("met") / others / F.greatest(F.col("size"), (F.col("tokens") - F.col("size")) / others)
    return met.select("kind", "head", share.alias("share")).groupBy("kind", "head").agg(F.count_if(F.col("share") >= SHARED).alias("own"), F.count_if((F.col("share") >= SHARED) & (F.col("share") >= STEADY)).alias("constant"))


def template_labels(evidence: DataFrame) -> DataFrame:
    """(kind, head, label): main, wrapper, label (of a side box) or name (to be settled by its neighbours).

    A template that alignments did not find in other pages is a varying slot: main. Of the others, paragraphs and sentences
    are slots if their frames change places with others within paragraphs; a sentence that never does is a constant node if
    most of its lines share nearly all tokens with all others of their host, else a frame of varying slots. Short lines are judged by their place.
    """
    share = lambda c: F.col(c) / F.greatest(F.col("n"), F.lit(1))
    enough = F.col("n") >= SUPPORT
    kind = F.col("kind")
    short = evidence.where("kind = 'short'").agg((F.sum("matched") >= FOUND * F.sum("n")).alias("shorts"))
    node = (F.col("matched") >= MATCHES) | (kind == "short") & (F.col("n") < FEW) & F.coalesce("shorts", F.lit(False))
    steady = (F.col("own") > 0) & (F.col("constant") >= 0.6 * F.col("own"))
    free = F.col("later") >= 0.05 * (F.col("n") + F.col("later"))
    label = (
        F.when(~node & (kind != "name"), "main")
        .when(kind == "fact", "main")
        .when(kind.isin("menu", "item"), "wrapper")
        .when(kind == "multi", F.when(free, "main").otherwise("wrapper"))
        .when(kind == "sent", F.when(~free & steady, "wrapper").otherwise("main"))
        .when(enough & (share("label") >= F.when(kind == "name", 0.85).otherwise(0.6)) & (share("late") >= 0.5), "label")
        .when(enough & (share("after") >= 0.7) & (share("before") >= 0.5), "main")
        .when(kind == "name", F.when(node & enough & ((share("first") >= 0.6) | (share("last") >= 0.5) | (F.col("own") >= SUPPORT) & steady | (share("before") >= 0.45)), "wrapper").otherwise("name"))
        .otherwise("wrapper")
    )
    return evidence.crossJoin(F.broadcast(short)).select("kind", "head", label.alias("label"))  # short is one row


def settle(kinds: list[tuple[str, str]]) -> list[bool]:
    """Whether each line of a page, given (kind, label) in order, is outside the main body."""
    n = len(kinds)
    outside = [label in ("wrapper", "label") for _, label in kinds]
    text = [label == "main" and kind in ("multi", "sent") for kind, label in kinds]
    lead = next((i for i in range(n) if text[i]), n)
    # A name may be the page's own heading if it comes before the text and in no box; of several the last that leads the text
    # directly, else the last.
    headings = []
    for i, (_, label) in enumerate(kinds):
        if label != "name":
            continue
        outside[i] = True
        j = i
        while j and kinds[j - 1][1] == "name":
            j -= 1
        boxed = j > 0 and kinds[j - 1][1] == "label"
        if i < lead and not boxed and not (i + 1 < n and kinds[i + 1][1] == "name"):
            headings.append((i + 1 < n and kinds[i + 1][1] == "main", i))
    if headings:
        outside[max(headings)[1]] = False
    return outside


def find_boilerplate(pages: DataFrame) -> DataFrame:
    """(table_name, record_id, line_no) of each non-blank line outside the main body; ``pages`` has (table_name, record_id, url, text).

    Lines count from 0. Missing and blank texts have none; pages without a host are aligned with none but judged by the
    evidence of all. Templates are joined by a shuffle (or broadcast by AQE where small); a page's lines meet in one task.
    """
    read = cut(read_pages(laid_out(pages)))
    evidence = cut(template_evidence(read))
    labels = cut(template_labels(evidence).select(F.xxhash64("kind", "head").alias("k"), "label"))
    lines = read.where("line_no is not null").select("table_name", "record_id", "line_no", "kind", F.xxhash64("kind", "head").alias("k"))
    pages_ = lines.join(labels, "k").groupBy("table_name", "record_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "kind", "label"))).alias("lines"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, r, ls in zip(*(b.column(i).to_pylist() for i in range(3))):
                out = settle([(x["kind"], x["label"]) for x in ls])
                rows += [(n, r, x["line_no"]) for x, o in zip(ls, out) if o]
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32()))], names=["table_name", "record_id", "line_no"])

    return pages_.mapInArrow(decide, "table_name string, record_id bigint, line_no int")


def whole_pages(blocks: DataFrame, evidence: DataFrame) -> DataFrame:
    """The pages of the problem: blocks of kind page and evidence of source type page."""
    a = blocks.where("kind = 'page'").select(F.lit("content_blocks").alias("table_name"), F.col("block_uid").cast("bigint").alias("record_id"), "url", "text")
    e = evidence.where("source_type = 'page'").select(F.lit("evidence").alias("table_name"), F.col("evidence_id").cast("bigint").alias("record_id"), F.coalesce("page_url", "url").alias("url"), "text")
    return a.unionByName(e)
