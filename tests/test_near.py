import itertools
import math
import random

from pyspark.sql import functions as F

from mirador.operators import near

SCHEMA = "point_id bigint, lat double, lng double, x string, id string"


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * near.EARTH * math.asin(min(1, math.sqrt(h)))


def usable(p):
    return None not in p[1:] and not any(map(math.isnan, p[1:])) and abs(p[1]) <= 90 and abs(p[2]) <= 180 and p[1:] != (0.0, 0.0)


def points():
    r = random.Random(1)
    out = [(0, 0.0, 0.0), (1, None, 1.0), (2, 1.0, None), (3, float("nan"), 1.0), (4, 91.0, 0.0), (5, 10.0, 181.0), (6, 0.0, 0.001), (7, 0.0, 0.0011)]
    for k in range(400):
        lat, lng = r.choice([(40.0, -3.0), (89.9995, 100.0), (10.0, 179.9999), (-89.9999, 0.0)])
        x = lng + r.uniform(-0.004, 0.004) * (50 if abs(lat) > 80 else 1)
        out.append((10 + k, max(-90.0, min(90.0, lat + r.uniform(-0.004, 0.004))), (x + 180) % 360 - 180))
    out += [(500 + k, 41.0, 2.0) for k in range(30)] + [(600, 41.0, 2.0), (600, 41.0, 2.0)]  # copies, and a repeated key
    return out


def test_pairs_equal_brute_force_whatever_the_cells_and_blocks(spark):
    ps = points()
    want = {(a[0], b[0]) for a, b in itertools.product([p for p in ps if usable(p)], repeat=2) if a[0] < b[0] and metres(a, b) <= 150}
    df = spark.createDataFrame([(*p, "x", "id") for p in ps], SCHEMA)
    for cell, block in ((10_000, 12_000), (16, 12_000), (16, 25), (200, 40)):
        got = [tuple(r) for r in near.pairs_within(df, 150.0, cell=cell, block=block).distinct().collect()]
        assert set(got) == want and len(got) == len(want)


def test_no_points(spark):
    assert near.pairs_within(spark.createDataFrame([], SCHEMA), 150.0).count() == 0
    assert near.pairs_within(spark.createDataFrame([(1, None, None, "", "")], SCHEMA), 150.0).count() == 0


def test_regions_equal_ray_casting(spark):
    r = random.Random(2)
    ring = "array<struct<lat:double,lng:double>>"
    star = [(40 + (1 if k % 2 else 0.4) * math.sin(k * math.pi / 5), -3 + (1 if k % 2 else 0.4) * math.cos(k * math.pi / 5)) for k in range(10)]
    regions = [(1, star), (2, [(39.5, -3.5), (40.5, -3.5), (40.5, -2.5), (39.5, -2.5)]), (3, [(1.0, 1.0)]), (4, None), (5, [])]
    ps = [(k, 40 + r.uniform(-1.5, 1.5), -3 + r.uniform(-1.5, 1.5)) for k in range(500)] + [(900, None, 1.0)]

    def inside(p, poly):
        n = 0
        for (y1, x1), (y2, x2) in zip(poly, poly[1:] + poly[:1]):
            if (y1 > p[1]) != (y2 > p[1]):
                n += x1 + (p[1] - y1) / (y2 - y1) * (x2 - x1) <= p[2]
        return n % 2 == 1

    want = {(p[0], i) for p in ps if None not in p for i, poly in regions if poly and len(poly) > 2 and inside(p, poly)}
    df = spark.createDataFrame(ps, "point_id bigint, lat double, lng double")
    rg = spark.createDataFrame(regions, f"region_id bigint, ring {ring}")
    assert {tuple(x) for x in near.points_in_regions(df, rg).collect()} == want
    got = [tuple(x) for x in near.points_in_regions(df, rg, tile=0.3, crowd=5).collect()]
    assert set(got) == want and len(got) == len(want)
    assert near.points_in_regions(df.where(F.lit(False)), rg).count() == 0
