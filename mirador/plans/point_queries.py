"""Problem 7: points near points, and regions that contain points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import near
from ..sources.tables import table
from .core import query

P7_REGIONS_SQL = """
with e as (
  select city_id, k,
    lat + radius_km / 111.0 * sin(6.283185307179586 / 12 * k) y1, lng + radius_km / 111.0 / cos(radians(lat)) * cos(6.283185307179586 / 12 * k) x1,
    lat + radius_km / 111.0 * sin(6.283185307179586 / 12 * ((k + 1) % 12)) y2, lng + radius_km / 111.0 / cos(radians(lat)) * cos(6.283185307179586 / 12 * ((k + 1) % 12)) x2
  from city_centers, range(12) r(k)),
p as (select point_id, lat, lng from geo_candidates
  where lat between -90 and 90 and lng between -180 and 180 and not isnan(lat) and not isnan(lng) and not (lat = 0 and lng = 0))
select point_id, city_id as region_id from p, e
where (y1 > lat) <> (y2 > lat) and x1 + (lat - y1) / (y2 - y1) * (x2 - x1) <= lng
group by 1, 2 having count(*) % 2 = 1
"""

P7_FOUND_SQL = """
with p as (select point_id, lat, lng, cast(floor(lat / 0.0014) as bigint) b from geo_candidates
  where lat between -90 and 90 and lng between -180 and 180 and not isnan(lat) and not isnan(lng) and not (lat = 0 and lng = 0)),
n as (select *, b + d as near from p, (values (-1), (0), (1)) v(d))
select a.point_id as point_id_a, c.point_id as point_id_b from n a join p c on a.near = c.b and a.point_id < c.point_id
where 2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(c.lat - a.lat) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lng - a.lng) / 2), 2)))) <= 150
"""


@query(P7_FOUND_SQL)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return near.pairs_within(table(spark, d, "geo_candidates"), 150.0)


def circle_regions(cities: DataFrame, corners: int = 12) -> DataFrame:
    """Regular polygons around the cities, in degrees, with the given number of corners."""
    angle = lambda k: F.lit(6.283185307179586 / corners) * k
    corner = lambda k: F.struct((F.col("lat") + F.col("radius_km") / 111.0 * F.sin(angle(k))).alias("lat"), (F.col("lng") + F.col("radius_km") / 111.0 / F.cos(F.radians("lat")) * F.cos(angle(k))).alias("lng"))
    return cities.select(F.col("city_id").alias("region_id"), F.transform(F.sequence(F.lit(0), F.lit(corners - 1)), corner).alias("ring"))


@query(P7_REGIONS_SQL)
def p7_regions(spark: SparkSession, d: str) -> DataFrame:
    return near.points_in_regions(table(spark, d, "geo_candidates"), circle_regions(table(spark, d, "city_centers")))
