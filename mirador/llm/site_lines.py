"""Problem 1: lines that come back in a great share of a site's blocks.

Method: lines are parsed into templates by token trees of fixed depth, one root per site. A line's path is its site, its
number of tokens and its first DEPTH tokens; the leaf at its end holds the rest of the line, which is a wildcard slot as
soon as two lines of the leaf differ there (runs of digits are slots from the start). Every task grows the trees of its
own rows; trees are merged by path: counts of rows add up, unequal rests become a slot. A line that many rows have lies
under a template that many rows have, so templates under the thresholds fall away with all their lines. A template without
a slot is one line in the sense of the problem; the lines under a template with a slot are counted by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.urls import site
from ..sources.tables import BROADCAST_ROWS, checked_broadcast, cut

#: A template is repeated if it covers this many rows of the site and this share of them.
MIN_ROWS, MIN_SHARE = 8, 0.05
#: Levels of the trees below the number of tokens, and leaves that a task holds before it hands its trees on.
DEPTH, HOLD = 3, 200_000
#: White space of the problem (all Unicode white space, so no-break spaces too).
SPACE = r"(?U)\s+"
#: Repeated lines of a site are kept in so many shelves by their hash, so that a line is looked up in one of them.
SHELVES = 64


def normal_line(line: Column) -> Column:
    """Lower case, each run of the digits 0-9 one slot, each run of white space one blank, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), SPACE, " "))


def leaf(normal: Column) -> Column:
    """The 96-bit address of a line: two hashes."""
    return F.struct(F.xxhash64(normal).alias("a"), F.hash(normal).alias("b"))


def path(normal: Column) -> Column:
    """The path of a line in its site's tree, as one hash of the number of tokens and the first DEPTH tokens."""
    return let(F.split(normal, " "), lambda t: F.xxhash64(F.concat_ws(" ", F.size(t).cast("string"), F.slice(t, 1, DEPTH))))


class TokenTree:
    """Trees of all sites: site -> number of tokens -> first tokens -> [rows, rest]; rest is None where it is a slot."""

    def __init__(self):
        self.sites: dict[str, dict] = {}
        self.rows: dict[str, int] = {}
        self.leaves = 0

    def _leaf(self, site: str, count: int, first: tuple[str, ...], rest: str | None) -> list:
        node = self.sites.setdefault(site, {}).setdefault(count, {})
        for t in first[:-1]:
            node = node.setdefault(t, {})
        found = node.get(first[-1])
        if found is None:
            self.leaves += 1
            found = node[first[-1]] = [0, rest]
        elif found[1] != rest:
            found[1] = None
        return found

    def insert(self, site: str, lines: list[str]) -> None:
        """A row of ``site`` with its lines in normal form; each template counts the row once."""
        self.rows[site] = self.rows.get(site, 0) + 1
        met = {}
        for line in lines:
            t = line.split(" ")
            own = self._leaf(site, len(t), tuple(t[:DEPTH]), " ".join(t[DEPTH:]))
            met[id(own)] = own
        for own in met.values():
            own[0] += 1

    def templates(self) -> Iterator[tuple[str, str, str | None, int]]:
        """(site, path, rest, rows) of all leaves."""

        def walk(site: str, count: int, first: tuple[str, ...], node) -> Iterator[tuple[str, str, str | None, int]]:
            if isinstance(node, list):
                yield site, f"{count} {' '.join(first)}", node[1], node[0]
            else:
                for t, below in node.items():
                    yield from walk(site, count, (*first, t), below)

        for s, counts in self.sites.items():
            for count, node in counts.items():
                yield from walk(s, count, (), node)

    def merge(self, other: TokenTree) -> None:
        """Takes in another partition's trees: by path, rows add up and unequal rests become a slot."""
        for s, n in other.rows.items():
            self.rows[s] = self.rows.get(s, 0) + n
        for s, p, rest, n in other.templates():
            count, *first = p.split(" ")
            self._leaf(s, int(count), tuple(first), rest)[0] += n


def block_lines(blocks: DataFrame, text: str, url: str, key: str) -> DataFrame:
    """One row for each row of ``blocks``: key, site and its lines in normal form, in order ('' where a line is blank)."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    return blocks.select(F.col(key).alias("key"), F.coalesce(site(F.col(url)), F.lit("")).alias("site"), F.transform(lines, normal_line).alias("lines"))


def site_templates(parsed: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> DataFrame:
    """(site, path, slot, need): templates that cover the least number of rows of their site, ``need``, with a slot or without.

    Each task hands on its trees (in parts if they grow beyond HOLD leaves); equal paths are merged by one aggregate, a
    hot site spread by its paths. A row counts once for a template however many lines it has there; sites' rows come
    from the roots (null path).
    """

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TokenTree()
        for b in batches:
            for s, lines in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tree.insert(s, lines)
            if tree.leaves > HOLD:
                yield out(tree)
                tree = TokenTree()
        yield out(tree)

    def out(tree: TokenTree) -> pa.RecordBatch:
        rows = [*tree.templates(), *((s, None, None, n) for s, n in tree.rows.items())]
        cols = [[r[i] for r in rows] for i in range(4)]
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in cols[:3]], pa.array(cols[3], pa.int64())], names=["site", "path", "rest", "n"])

    trees = parsed.select("site", F.filter(F.array_distinct("lines"), lambda x: x != "")).mapInArrow(grow, "site string, path string, rest string, n bigint")
    # Rests are compared by their hash; null is a slot already.
    hashed = trees.select("site", F.when(F.col("path").isNotNull(), F.xxhash64("path")).alias("path"), F.xxhash64("rest").alias("rest"), F.col("rest").isNull().alias("slot"), "n")
    merged = hashed.groupBy("site", "path").agg(F.sum("n").alias("n"), (F.bool_or("slot") | (F.min("rest") != F.max("rest"))).alias("slot"))
    # A template under min_rows can be left out at once; what remains is small, and is read twice below.
    merged = cut(merged.where(F.col("path").isNull() | (F.col("n") >= min_rows)))
    need = F.greatest(F.lit(float(min_rows)), F.col("n") * min_share).alias("need")
    roots = merged.where(F.col("path").isNull()).select("site", need)
    return merged.where(F.col("path").isNotNull()).join(checked_broadcast(roots), "site").where("n >= need").select("site", "path", "slot", "need")


def candidate_lines(parsed: DataFrame, min_rows: int, min_share: float) -> DataFrame:
    """(key, site, line_no, leaf, slot, need) of all lines under templates that cover enough rows."""
    templates = checked_broadcast(cut(site_templates(parsed, min_rows, min_share)))
    at = parsed.select("key", "site", F.posexplode("lines").alias("line_no", "line")).where("line <> ''").withColumn("path", path(F.col("line")))
    return at.join(templates, ["site", "path"]).select("key", "site", "line_no", leaf(F.col("line")).alias("leaf"), "slot", "need")


def repeated_leaves(candidates: DataFrame) -> DataFrame:
    """(site, leaf): the lines under templates with a slot that have enough rows by themselves, and those of templates without."""
    # Under a template without a slot all lines are equal, and were counted with it.
    rows = candidates.groupBy("site", "leaf", "slot", "need").agg(F.count_distinct(F.when(F.col("slot"), F.col("key"))).alias("n"))
    return rows.where("not slot or n >= need").select("site", "leaf")


def find_repeated_lines(blocks: DataFrame, text: str = "text", url: str = "url", key: str = "block_uid", min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> DataFrame:
    """(``key``, line_no): every occurrence of a non-blank line that its site has in many rows; lines count from 0.

    Rows without text have no lines but count as rows of their site; rows without a host form the site ''. Keys are
    unique; rows of equal content count each for itself, as the site loads them. Templates and repeated lines are broadcast
    only after a count.
    """
    candidates = cut(candidate_lines(block_lines(blocks, text, url, key), min_rows, min_share))
    frequent = checked_broadcast(cut(repeated_leaves(candidates)))
    return candidates.join(frequent, ["site", "leaf"]).select(F.col("key").alias(key), "line_no").distinct()


def remove_repeated_lines(blocks: DataFrame, text: str = "text", url: str = "url", key: str = "block_uid", min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> DataFrame:
    """(``key``, text, removed): each row's text without its repeated lines and the number of these; null stays null.

    The repeated leaves of a site travel as shelves of hashes to the rows of the site, so the texts themselves are never
    split into rows nor shuffled: they are broadcast if a count of all sites' leaves shows at most BROADCAST_ROWS of 12 bytes.
    """
    candidates = cut(candidate_lines(block_lines(blocks, text, url, key), min_rows, min_share))
    leaves = cut(repeated_leaves(candidates))
    shelf = lambda x: F.pmod(x["a"], F.lit(SHELVES)).cast("int")
    by_site = leaves.groupBy("site").agg(F.collect_set("leaf").alias("all"))
    shelves = by_site.select("site", F.transform(F.sequence(F.lit(0), F.lit(SHELVES - 1)), lambda k: F.filter("all", lambda x: shelf(x) == k)).alias("frequent"))
    if leaves.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        shelves = F.broadcast(shelves)
    own = blocks.select(F.col(key).alias("key"), F.col(text).alias("own"), F.coalesce(site(F.col(url)), F.lit("")).alias("site"))
    gone = lambda x: let(leaf(normal_line(x)), lambda y: F.coalesce(F.array_contains(F.get("frequent", shelf(y)), y), F.lit(False)))
    joined = own.join(shelves, "site", "left")
    kept = F.filter(F.split("own", "\n", -1), lambda x: ~gone(x))
    return joined.select(F.col("key").alias(key), F.array_join(kept, "\n").alias("text"), F.coalesce(F.size(F.split("own", "\n", -1)) - F.size(kept), F.lit(0)).alias("removed"))
