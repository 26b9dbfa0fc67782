"""Geographic columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_fold, compact, text

# Kinds of places that are wide, and those in dense surroundings.
WIDE = ("NaturalPark", "Beach", "Mountain", "Trail", "Route", "Valley", "NaturalResource")
NARROW = ("Square", "Monument", "Bridge", "Tower", "Church", "Cathedral", "Monastery")


def distance_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def both(*columns: Column) -> Column:
    """All present."""
    out = columns[0].isNotNull()
    for c in columns[1:]:
        out = out & c.isNotNull()
    return out


def search_radius(types: Column) -> Column:
    """Metres around an entity by its first telling type."""
    of = F.transform(types, lambda t: F.when(t.isin(*WIDE), 800).when(t.isin(*NARROW), 100))
    return F.coalesce(F.get(F.filter(of, lambda r: r.isNotNull()), F.lit(0)), F.lit(200))


def address_line(road: Column, number: Column, postcode: Column, city: Column, expected: Column) -> Column:
    """Road and number, postcode, city; '' if the city is another than expected."""
    fold = lambda c: F.lower(ascii_fold(c))
    other = (text(expected) != "") & (text(city) != "") & ~F.contains(fold(city), fold(expected)) & ~F.contains(fold(expected), fold(city))
    street = compact(F.concat_ws(" ", F.nullif(road, F.lit("")), F.nullif(number, F.lit(""))))
    parts = F.filter(F.array(street, text(postcode), text(city)), lambda p: p != "")
    return F.when(other, "").otherwise(compact(F.array_join(parts, ", ")))


def geocode_queries(name: Column, address: Column, city: Column, country: str = "Spain") -> Column:
    """Distinct lookups from the most to the least telling."""
    join = lambda *xs: compact(F.array_join(F.filter(F.array(*[text(x) for x in xs]), lambda p: p != ""), ", "))
    all_ = F.array(join(address, city, F.lit(country)), join(name, address), join(name, city, F.lit(country)), compact(name))
    return F.array_distinct(F.filter(F.transform(all_, ascii_fold), lambda q: q != ""))


def wkt(lat: Column, lng: Column) -> Column:
    return F.concat(F.lit("POINT("), lng.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))
