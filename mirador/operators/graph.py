"""Traversals: the class tree of an ontology, and a site's pages by links."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.urls import absolute, domain, foreign_language, normalize, skipped
from ..sources.tables import cut


def subtrees(ontology: DataFrame, roots: tuple[str, ...] = dims.ROOTS) -> DataFrame:
    """(root, name, depth) of all classes under the roots, these included, by repeated joins until a level has no new one."""
    level = ontology.where(F.col("name").isin(*roots)).select(F.col("name").alias("root"), "name", F.lit(0).alias("depth"))
    out = level = cut(level.distinct())
    child = ontology.select(F.col("name").alias("child"), "parent")
    for d in count(1):
        below = level.join(child, level["name"] == child["parent"]).select("root", F.col("child").alias("name")).distinct()
        level = cut(below.join(out.select("root", "name"), ["root", "name"], "left_anti").withColumn("depth", F.lit(d)))
        if level.isEmpty():
            return out
        out = cut(out.unionByName(level))


def classifiable(ontology: DataFrame) -> DataFrame:
    """The names that may be chosen as types."""
    return subtrees(ontology).select("name").unionByName(ontology.where(F.col("name").isin(*dims.FACILITIES)).select("name")).distinct()


def page_links(pages: DataFrame, home: str | None = None, lang: str = "") -> DataFrame:
    """(url, link): links in (url, html), made absolute and normal, on the site, followable, in the language; each once a page."""
    hrefs = F.explode(F.regexp_extract_all("html", F.lit(r"""href=["']([^"'#][^"']*)["']"""), 1))
    raw = pages.select("url", hrefs.alias("h")).select("url", F.trim("h").alias("h")).where("h <> ''").where(~F.rlike("h", F.lit(r"^(?:mailto:|tel:|javascript:|#)")))
    full = raw.select("url", normalize(absolute(F.col("h"), F.col("url"))).alias("link")).where("link is not null")
    own = domain(F.lit(home)) if home else domain(F.col("url"))
    return full.where((domain(F.col("link")) == own) & ~skipped(F.col("link")) & ~foreign_language(F.col("link"), lang)).distinct()


def crawl_order(edges: DataFrame, seeds: DataFrame, done: DataFrame | None = None, most_pages: int | None = None) -> DataFrame:
    """(url, depth): pages reachable from the seeds over (page, link) edges, breadth first, none of ``done``; by a join a round.

    ``most_pages`` ends the crawl when so many pages are visited, those of ``done`` included; of the last level the first by
    address stay. The visited set is anti-joined each round, so a round costs its own edges; lineage is cut each round.
    """
    skip = done.select("url") if done is not None else None
    level = seeds.select("url").distinct()
    left = None if most_pages is None else max(0, most_pages - (done.select("url").distinct().count() if done is not None else 0))

    def within(pages: DataFrame) -> DataFrame:
        """The level, or as much of it as may still be visited."""
        nonlocal left
        pages = cut(pages)
        if left is None:
            return pages
        n = pages.count()
        if n > left:
            pages = cut(pages.orderBy("url").limit(left))  # the limit is the crawl's own
        left = max(0, left - n)
        return pages

    level = within((level.join(skip, "url", "left_anti") if skip is not None else level).withColumn("depth", F.lit(0)))
    seen = level
    e = edges.select("page", "link").distinct()
    for d in count(1):
        nxt = level.join(e, level["url"] == e["page"]).select(F.col("link").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        if skip is not None:
            nxt = nxt.join(skip, "url", "left_anti")
        if left == 0:
            return seen
        level = within(nxt.withColumn("depth", F.lit(d)))
        if level.isEmpty():
            return seen
        seen = cut(seen.unionByName(level))
