"""The geometry model on plain Spark types.

A position is ARRAY<DOUBLE> (lon, lat, then any further axes). Every geometry has the same
nesting, polygon > ring > position, whatever its type, so one expression serves all types:

    Point [[[p]]]   MultiPoint, LineString [[ps]]   MultiLineString, Polygon [lines]
    MultiPolygon [polygon, polygon, ...]

A feature is a row of geometry, properties, id and bbox; a feature collection is a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSITION = T.ArrayType(T.DoubleType())
PARTS = T.ArrayType(T.ArrayType(T.ArrayType(POSITION)))
BBOX = T.ArrayType(T.DoubleType())
GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("parts", PARTS), T.StructField("bbox", BBOX)])
GEOMETRY_DDL = GEOMETRY.simpleString()
TYPES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")
SINGLE = ("Point", "LineString", "Polygon")
MULTI = ("MultiPoint", "MultiLineString", "MultiPolygon")


def is_single(g: Column) -> Column:
    return g["type"].isin(*SINGLE)


def is_multi(g: Column) -> Column:
    return g["type"].isin(*MULTI, "GeometryCollection")


def is_point_like(g: Column) -> Column:
    return g["type"].isin("Point", "MultiPoint")


def is_line_like(g: Column) -> Column:
    return g["type"].isin("LineString", "MultiLineString")


def is_polygon_like(g: Column) -> Column:
    return g["type"].isin("Polygon", "MultiPolygon")


def is_valid_position(p: Column) -> Column:
    return p.isNotNull() & (F.size(p) >= 2) & F.forall(p, lambda x: x.isNotNull())


def is_valid_bbox(b: Column) -> Column:
    return (F.size(b) >= 4) & (F.size(b) % 2 == 0)


def same_lonlat(a: Column, b: Column) -> Column:
    return (F.get(a, 0) == F.get(b, 0)) & (F.get(a, 1) == F.get(b, 1))


def is_valid(g: Column) -> Column:
    """Whether a geometry keeps the rules of its type; null for null.

    A line has two positions or more; a polygon a ring or more; a ring four positions or more,
    of which the first equals the last; multi-geometries may be empty.
    """
    positions = F.flatten(F.flatten(g["parts"]))
    long_enough = F.forall(F.flatten(g["parts"]), lambda line: F.size(line) >= 2)
    ring = lambda r: (F.size(r) >= 4) & (F.get(r, 0) == F.element_at(r, -1))
    closed = F.forall(g["parts"], lambda polygon: (F.size(polygon) >= 1) & F.forall(polygon, ring))
    kind = g["type"]
    shape = (
        F.when(kind == "Point", F.size(positions) == 1)
        .when(kind == "MultiPoint", F.lit(True))
        .when(kind == "LineString", (F.size(F.flatten(g["parts"])) == 1) & long_enough)
        .when(kind == "MultiLineString", long_enough)
        .when(kind == "Polygon", (F.size(g["parts"]) == 1) & closed)
        .when(kind == "MultiPolygon", closed)
        .otherwise(F.lit(False))
    )
    return F.when(g.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(shape & F.forall(positions, is_valid_position), F.lit(False)) & (g["bbox"].isNull() | is_valid_bbox(g["bbox"])))


def assert_valid(g: Column) -> Column:
    """The geometry itself, or an error where it breaks a rule; null for null."""
    return F.when(g.isNull() | is_valid(g), g).otherwise(F.raise_error(F.concat(F.lit("invalid geometry: "), F.coalesce(g["type"], F.lit("?")))).cast(GEOMETRY))
