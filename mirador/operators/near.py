"""Problem 7: points near other points, and the regions that contain points.

Method: points become unit vectors in three dimensions, so that poles and the date line need no special care. A k-d tree
of split planes, fit on a bounded sample, cuts space into cells of about equal numbers; every point goes to its home
cell, and copies go to the cells that its neighbourhood reaches (the halo). Each cell is then searched alone, by a local
k-d tree whose leaves are compared only if their boxes lie within the radius's chord. A pair comes out in the home cell
of its first point, so once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checked_broadcast, cut

#: Metres.
EARTH = 6_371_000.0
#: Points per cell aimed at; sample rows per cell; most cells. The planes' size is bounded by MOST_CELLS, whatever the data.
CELL, SAMPLE_PER_CELL, MOST_CELLS = 4_000, 16, 1 << 15
#: A cell with more points than this is searched in blocks, each by a task of its own.
BLOCK = 60_000
#: A tile of the sweep with more points than this is spread over tasks.
CROWD = 50_000
LEAF = 48


def usable_point(lat: Column, lng: Column) -> Column:
    """Both numbers, not NaN, in range, not both 0."""
    ok = ~F.isnan(lat) & ~F.isnan(lng) & lat.between(-90, 90) & lng.between(-180, 180) & ((lat != 0) | (lng != 0))
    return F.coalesce(ok, F.lit(False))


def chord(radius: float) -> float:
    return 2 * math.sin(min(radius / (2 * EARTH), math.pi / 2))


class Planes:
    """A k-d tree of split planes as arrays: node k has children 2k+1 and 2k+2; the last level's children are cells."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros((1 << depth) - 1, np.int8)
        self.value = np.full((1 << depth) - 1, np.inf)
        parts = {0: sample}
        for k in range(len(self.axis)):
            p = parts.pop(k)
            if len(p):
                axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
                value = float(np.median(p[:, axis]))
                self.axis[k], self.value[k] = axis, value
                left = p[:, axis] <= value
                parts[2 * k + 1], parts[2 * k + 2] = p[left], p[~left]
            else:
                parts[2 * k + 1] = parts[2 * k + 2] = p

    def home(self, xyz: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        node, row = np.zeros(len(xyz), np.int64), np.arange(len(xyz))
        for _ in range(self.depth):
            node = 2 * node + 1 + (xyz[row, self.axis[node]] > self.value[node])
        return node - len(self.axis)

    def cells(self, xyz: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for each cell that a row's cube of half side ``reach`` meets."""
        row, node = np.arange(len(xyz)), np.zeros(len(xyz), np.int64)
        for _ in range(self.depth):
            x = xyz[row, self.axis[node]]
            v = self.value[node]
            left, right = x - reach <= v, x + reach > v
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return row, node - len(self.axis)


def fit_planes(vectors: DataFrame, cell: int = CELL) -> Planes:
    """Split planes for about ``cell`` points a cell, from a sample of at most MOST_CELLS * SAMPLE_PER_CELL points."""
    n = vectors.count()
    depth = max(0, min(math.ceil(math.log2(max(1, n / cell))), int(math.log2(MOST_CELLS))))
    want = SAMPLE_PER_CELL << depth
    fraction = min(1.0, 1.2 * want / max(1, n))
    sample = vectors.select("x", "y", "z").sample(fraction, seed=7).limit(want).toPandas() if depth else pd.DataFrame(columns=["x", "y", "z"], dtype="float64")
    return Planes(sample.to_numpy(dtype="float64"), depth)


def near_pairs(a: np.ndarray, b: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of rows of ``a`` and ``b`` at most ``reach`` apart, by two k-d trees' leaves."""
    la, lb = leaves(a), leaves(b)
    if not la or not lb:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = (np.array([f(b[i]) for i in lb]) for f in (lambda p: p.min(axis=0), lambda p: p.max(axis=0)))
    ia, ib = [], []
    for i in la:
        p = a[i]
        gap = np.maximum(0, np.maximum(low - p.max(axis=0), p.min(axis=0) - high))
        for k in np.flatnonzero((gap * gap).sum(axis=1) <= reach * reach):
            j = lb[k]
            d = p[:, None, :] - b[j][None, :, :]
            x, y = np.nonzero(np.einsum("ijk,ijk->ij", d, d) <= reach * reach)
            ia.append(i[x])
            ib.append(j[y])
    return (np.concatenate(ia), np.concatenate(ib)) if ia else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def leaves(p: np.ndarray) -> list[np.ndarray]:
    """Leaves of a k-d tree over the rows of ``p``, at most LEAF rows each unless all are equal."""
    out, open_ = [], [np.arange(len(p))] if len(p) else []
    while open_:
        i = open_.pop()
        q = p[i]
        spread = q.max(axis=0) - q.min(axis=0)
        axis = int(np.argmax(spread))
        if len(i) <= LEAF or spread[axis] == 0 and len(i) <= 4 * LEAF:
            out.append(i)
            continue
        order = np.argpartition(q[:, axis], len(i) // 2)
        open_ += [i[order[: len(i) // 2]], i[order[len(i) // 2 :]]]
    return out


def great_circle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Metres between rows of (lat, lng) in degrees."""
    a, b = np.radians(a), np.radians(b)
    h = np.sin((b[:, 0] - a[:, 0]) / 2) ** 2 + np.cos(a[:, 0]) * np.cos(b[:, 0]) * np.sin((b[:, 1] - a[:, 1]) / 2) ** 2
    return 2 * EARTH * np.arcsin(np.minimum(1, np.sqrt(h)))


def unit(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    lat, lng = np.radians(lat), np.radians(lng)
    return np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], axis=1)


def pairs_within(points: DataFrame, radius: float, key: str = "point_id", lat: str = "lat", lng: str = "lng", cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(``key``_a, ``key``_b): all pairs of usable rows at most ``radius`` metres apart on the sphere, smaller key first.

    Rows without usable coordinates have no pairs; equal points are at distance 0 and pair up; a repeated key does not
    pair with itself. Keys are whole numbers. A cell that stays large (points crowd closer together than planes part
    them) is cut into blocks by key and each pair of blocks gets its own task, so a hot spot is spread and its pairs are
    written in batches as they are found; nothing is capped.
    """
    rad = lambda c: F.radians(F.col(c))
    usable = points.where(usable_point(F.col(lat), F.col(lng))).select(F.col(key).cast("bigint").alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lng).cast("double").alias("lng"))
    vectors = usable.withColumns({"x": F.cos(rad("lat")) * F.cos(rad("lng")), "y": F.cos(rad("lat")) * F.sin(rad("lng")), "z": F.sin(rad("lat"))})
    planes = fit_planes(vectors, cell)
    reach = chord(radius) * (1 + 1e-9) + 1e-12

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, la, ln = (b.column(k).to_numpy() for k in range(3))
            xyz = unit(la, ln)
            row, at = planes.cells(xyz, reach)
            home = planes.home(xyz)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(home[row] == at), pa.array(ids[row]), pa.array(la[row]), pa.array(ln[row])], names=["cell", "home", "id", "lat", "lng"])

    placed = usable.mapInArrow(place, "cell int, home boolean, id bigint, lat double, lng double")
    sizes = cut(placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > block))
    if not sizes.isEmpty():
        large = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / block).cast("int").alias("k")))  # at most MOST_CELLS rows, whatever the data
        placed = placed.join(large, "cell", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
        # The row of block i meets block j in the task (smaller, larger).
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        placed = placed.select("cell", "home", "id", "lat", "lng", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    else:
        placed = placed.select("*", F.lit(0).alias("own"), F.lit(0).alias("p"), F.lit(0).alias("q"))

    def search(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(rows))
        p, q = int(g["p"].iloc[0]), int(g["q"].iloc[0])
        own = g["own"].to_numpy()
        A, B = np.flatnonzero(own == p), np.flatnonzero(own == q)
        ids, home, deg = g["id"].to_numpy(), g["home"].to_numpy(), g[["lat", "lng"]].to_numpy()
        xyz = unit(deg[:, 0], deg[:, 1])
        tree = leaves(xyz[A])
        for lo in range(0, len(tree), 64):  # results leave in batches
            part = A[np.concatenate(tree[lo : lo + 64])]
            x, y = near_pairs(xyz[part], xyz[B], reach)
            i, j = part[x], B[y]
            if p == q:
                i, j = i[keep := ids[i] < ids[j]], j[keep]
            else:
                i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
                i, j = i[keep := ids[i] < ids[j]], j[keep]
            i, j = i[keep := home[i]], j[keep]
            keep = great_circle(deg[i], deg[j]) <= radius
            yield pd.DataFrame({"a": ids[i[keep]], "b": ids[j[keep]]})

    found = placed.groupBy("cell", "p", "q").applyInPandas(search, "a bigint, b bigint")
    return found.select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"))


def points_in_regions(points: DataFrame, regions: DataFrame, key: str = "point_id", lat: str = "lat", lng: str = "lng", region: str = "region_id", ring: str = "ring", band: float = 0.25, tile: float = 2.0, crowd: int = CROWD) -> DataFrame:
    """(``key``, ``region``): points inside polygons, by plane sweep over the polygons' edges.

    ``ring`` is an array of (lat, lng) structs, closed or not, in the plane of degrees (no polygon crosses the date line).
    Edges are cut into bands of ``band`` degrees of latitude (and so is the sweep); in a task a line sweeps its band
    northward, taking up and dropping edges, and counts the edges to the west of each point: an odd number is inside. An
    edge holds its southern end and not its northern, so no vertex counts twice; a point on an edge counts as east of it.
    Null rings and rings under three corners contain nothing; several polygons may contain one point. Bands are cut into
    tiles of ``tile`` degrees of longitude, and an edge goes to the tiles that its polygon reaches, so a point meets edges of
    polygons around it only. A tile with more than ``crowd`` points is spread over tasks by the points, and only its edges copied.
    """
    corners = regions.where(F.size(ring) >= 3).select(F.col(region).cast("bigint").alias("id"), F.col(ring).alias("r"))
    corners = corners.withColumns({"west": F.array_min(F.transform("r", lambda c: c["lng"])), "east": F.array_max(F.transform("r", lambda c: c["lng"]))})
    edges = corners.select("id", "west", "east", F.posexplode("r").alias("k", "u"), F.element_at("r", (F.col("k") + 1) % F.size("r") + 1).alias("v"))
    rising = F.col("u.lat") < F.col("v.lat")
    edges = edges.where(F.col("u.lat") != F.col("v.lat")).select("id", "west", "east", F.when(rising, F.col("u")).otherwise(F.col("v")).alias("s"), F.when(rising, F.col("v")).otherwise(F.col("u")).alias("n"))
    bands = F.sequence(F.floor(F.col("s.lat") / band), F.floor(F.col("n.lat") / band))
    e = edges.withColumn("band", F.explode(bands)).withColumn("tile", F.explode(F.sequence(F.floor(F.col("west") / tile), F.floor(F.col("east") / tile))))
    # Points of tiles that no polygon reaches go no further. At most as many rows as tiles of the globe.
    reached = checked_broadcast(cut(e.select("band", "tile").distinct()))
    usable = points.where(usable_point(F.col(lat), F.col(lng))).select(F.col(key).cast("bigint").alias("id"), F.col(lat).cast("double").alias("y"), F.col(lng).cast("double").alias("x"))
    p = usable.withColumns({"band": F.floor(F.col("y") / band), "tile": F.floor(F.col("x") / tile)}).join(reached, ["band", "tile"])
    crowded = checked_broadcast(cut(p.groupBy("band", "tile").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("band", "tile", F.ceil(F.col("n") / crowd).cast("int").alias("parts"))))
    parts = F.coalesce("parts", F.lit(1))
    p = p.join(crowded, ["band", "tile"], "left").select("band", "tile", F.pmod(F.xxhash64("id"), parts).cast("int").alias("salt"), "id", "y", "x", *[F.lit(None).cast("double").alias(c) for c in ("y2", "x2")])
    e = e.join(crowded, ["band", "tile"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    e = e.select("band", "tile", "salt", "id", F.col("s.lat").alias("y"), F.col("s.lng").alias("x"), F.col("n.lat").alias("y2"), F.col("n.lng").alias("x2"))

    def sweep(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = pd.concat(list(rows))
        is_edge = g["y2"].notna().to_numpy()
        edge, pt = g[is_edge].sort_values("y", kind="stable"), g[~is_edge].sort_values("y", kind="stable")
        if edge.empty or pt.empty:
            return
        ey, ex, ey2, ex2, eid = (edge[c].to_numpy() for c in ("y", "x", "y2", "x2", "id"))
        py, px, pid = (pt[c].to_numpy() for c in ("y", "x", "id"))
        polygons, own = np.unique(eid, return_inverse=True)
        active, nxt, a, b = np.zeros(0, np.int64), 0, [], []
        for lo in range(0, len(py), 256):  # the sweep line moves on by 256 points
            ys, xs = py[lo : lo + 256], px[lo : lo + 256]
            upto = np.searchsorted(ey, ys[-1], side="right")
            active = np.concatenate([active, np.arange(nxt, upto)])
            nxt = upto
            active = active[ey2[active] > ys[0]]
            if not len(active):
                continue
            y, x = ys[:, None], xs[:, None]
            cross = (ey[active] <= y) & (y < ey2[active]) & (ex[active] + (y - ey[active]) / (ey2[active] - ey[active]) * (ex2[active] - ex[active]) <= x)
            i, k = np.nonzero(cross)
            if len(i):
                met, times = np.unique((lo + i) * len(polygons) + own[active[k]], return_counts=True)
                met = met[times % 2 == 1]
                a.append(pid[met // len(polygons)])
                b.append(polygons[met % len(polygons)])
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    found = p.unionByName(e).groupBy("band", "tile", "salt").applyInPandas(sweep, "a bigint, b bigint")
    return found.select(F.col("a").alias(key), F.col("b").alias(region))
