"""Constructors, accessors and conversions of geometries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoframe.schema import BBOX, GEOMETRY, PARTS, POSITION, same_lonlat


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression."""
    return F.get(F.transform(F.array(value), body), 0)


def num(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


# positions


def position(lon: Column | float, lat: Column | float, *more: Column | float) -> Column:
    """A position; null axes after the first two are left out."""
    base = F.array(num(lon), num(lat))
    return F.concat(base, F.filter(F.array(*map(num, more)), lambda x: x.isNotNull())) if more else base


def lon(p: Column) -> Column:
    return F.get(p, 0)


def lat(p: Column) -> Column:
    return F.get(p, 1)


def alt(p: Column) -> Column:
    return F.get(p, 2)


def has_altitude(p: Column) -> Column:
    return F.size(p) > 2


def axes(p: Column) -> Column:
    return F.size(p)


# geometries from parts


def make(kind: str | Column, parts: Column, bbox: Column | None = None) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    box = (bbox if bbox is not None else F.lit(None)).cast(BBOX)
    return F.when(parts.isNotNull(), F.struct(kind.alias("type"), parts.cast(PARTS).alias("parts"), box.alias("bbox"))).cast(GEOMETRY)


def point(p: Column, bbox: Column | None = None) -> Column:
    return make("Point", F.when(p.isNotNull(), F.array(F.array(F.array(p)))), bbox)


def point_lonlat(lon: Column | float, lat: Column | float, alt: Column | float | None = None) -> Column:
    x, y = num(lon), num(lat)
    p = F.when(x.isNotNull() & y.isNotNull(), position(x, y) if alt is None else position(x, y, alt))
    return point(p)


def multi_point(positions: Column, bbox: Column | None = None) -> Column:
    return make("MultiPoint", F.when(positions.isNotNull(), F.array(F.array(positions))), bbox)


def line_string(positions: Column, bbox: Column | None = None) -> Column:
    return make("LineString", F.when(positions.isNotNull(), F.array(F.array(positions))), bbox)


def multi_line_string(lines: Column, bbox: Column | None = None) -> Column:
    return make("MultiLineString", F.when(lines.isNotNull(), F.array(lines)), bbox)


def polygon(rings: Column, bbox: Column | None = None) -> Column:
    return make("Polygon", F.when(rings.isNotNull(), F.array(rings)), bbox)


def multi_polygon(polygons: Column, bbox: Column | None = None) -> Column:
    return make("MultiPolygon", polygons, bbox)


def close_ring(ring: Column) -> Column:
    """The ring with its first position again at the end, unless it is there already."""
    return F.when(F.size(ring) == 0, F.raise_error(F.lit("a ring must not be empty")).cast(f"array<{POSITION.simpleString()}>")).when(same_lonlat(F.get(ring, 0), F.element_at(ring, -1)), ring).otherwise(F.concat(ring, F.array(F.get(ring, 0))))


def build_polygon(rings: Column) -> Column:
    """A polygon of rings that may be open."""
    return polygon(F.transform(rings, close_ring))


def _in_order(place: Column, value: Column) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(place.alias("k"), value.alias("v"))))
    return F.transform(rows, lambda r: r["v"])


def make_line(place: Column, p: Column) -> Column:
    """Aggregate: the line through a group's positions in the order of ``place``. A line is one value, so a group must fit a row."""
    return line_string(_in_order(place, p))


def make_multi_point(place: Column, p: Column) -> Column:
    """Aggregate: a group's positions in the order of ``place``."""
    return multi_point(_in_order(place, p))


def make_multi_line(place: Column, line: Column) -> Column:
    """Aggregate: a group's lines, each an array of positions, in the order of ``place``."""
    return multi_line_string(_in_order(place, line))


def make_polygon(place: Column, ring: Column) -> Column:
    """Aggregate: the polygon of a group's rings, the outer one first; open rings are closed."""
    return build_polygon(_in_order(place, ring))


def make_multi_polygon(place: Column, rings: Column) -> Column:
    """Aggregate: a group's polygons, each an array of rings, in the order of ``place``."""
    return multi_polygon(_in_order(place, rings))


def point_of(*axes_: float) -> Column:
    return point(F.array(*map(num, axes_)))


def _literal(positions) -> Column:
    return F.array(*[F.array(*map(num, p)) for p in positions])


def line_string_of(*positions) -> Column:
    return line_string(_literal(positions))


def multi_point_of(*positions) -> Column:
    return multi_point(_literal(positions))


def multi_line_string_of(*lines) -> Column:
    return multi_line_string(F.array(*map(_literal, lines)))


def polygon_of(*rings) -> Column:
    return polygon(F.array(*map(_literal, rings)))


def multi_polygon_of(*polygons) -> Column:
    return multi_polygon(F.array(*[F.array(*map(_literal, p)) for p in polygons]))


# collections: an array of geometries; members that are collections themselves are laid out in their place


def geometry_collection(*members) -> Column:
    """A collection of geometries and of other collections, given as arrays by ``in_collection``."""
    return F.flatten(F.array(*[m.members if isinstance(m, _Members) else F.array(m) for m in members]))


class _Members:
    def __init__(self, members: Column):
        self.members = members


def in_collection(geometries: Column) -> _Members:
    """A collection as a member of another."""
    return _Members(geometries)


def build_collection(place: Column, g: Column) -> Column:
    """Aggregate: the collection of a group's geometries in the order of ``place``; null geometries are left out."""
    rows = F.array_sort(F.collect_list(F.when(g.isNotNull(), F.struct(place.alias("k"), g.alias("g")))))
    return F.transform(rows, lambda r: r["g"])


def collection_coordinates(gs: Column) -> Column:
    """All positions of a collection in order."""
    return F.flatten(F.transform(gs, coordinates))


# coordinates


def coordinates(g: Column) -> Column:
    """All positions in order, those that close rings included."""
    return F.flatten(F.flatten(g["parts"]))


def lines_of(g: Column) -> Column:
    """The lines or rings of a geometry."""
    return F.flatten(g["parts"])


def only_line(g: Column) -> Column:
    return F.get(F.get(g["parts"], 0), 0)


def only_position(g: Column) -> Column:
    return F.get(only_line(g), 0)


def explode_points(g: Column) -> Column:
    """All positions as one MultiPoint."""
    return multi_point(coordinates(g))


def children(g: Column) -> Column:
    """The single geometries of a multi-geometry."""
    each = lambda kind, items, wrap: F.transform(items, lambda x: make(kind, wrap(x)))
    return (
        F.when(g["type"] == "MultiPoint", each("Point", coordinates(g), lambda p: F.array(F.array(F.array(p)))))
        .when(g["type"] == "MultiLineString", each("LineString", lines_of(g), lambda l: F.array(F.array(l))))
        .when(g["type"] == "MultiPolygon", each("Polygon", g["parts"], lambda r: F.array(r)))
        .otherwise(F.array(g))
    )


def count_children(g: Column) -> Column:
    return F.size(children(g))


def child(g: Column, index: int) -> Column:
    """A child by place from 0; null beyond the end."""
    return F.get(children(g), index)


def contains_child(g: Column, other: Column) -> Column:
    return F.exists(children(g), lambda c: (c["type"] == other["type"]) & (c["parts"] == other["parts"]) & c["bbox"].eqNullSafe(other["bbox"]))


def contains_children(g: Column, others: Column) -> Column:
    return F.forall(others, lambda o: contains_child(g, o))


# rounding


def round_even(x: Column, precision: int = 0) -> Column:
    """Half-even rounding of x * 10^precision."""
    if precision < 0:
        raise ValueError("precision must not be negative")
    scale = float(10**precision)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


# conversions


def _as(kind: str, g: Column, parts: Column | None = None) -> Column:
    return make(kind, g["parts"] if parts is None else parts, g["bbox"])


def to_multi_point(g: Column) -> Column:
    return _as("MultiPoint", g)


def line_to_multi_line(g: Column) -> Column:
    return _as("MultiLineString", g)


def polygon_to_multi_polygon(g: Column) -> Column:
    return _as("MultiPolygon", g)


def polygon_to_multi_line(g: Column) -> Column:
    """The rings as lines; the bbox stays."""
    return _as("MultiLineString", g)


def multi_polygon_to_multi_lines(g: Column) -> Column:
    """One MultiLineString a polygon."""
    return F.transform(g["parts"], lambda rings: make("MultiLineString", F.array(rings)))


def _extent(ring: Column) -> Column:
    """Area of a ring's bounding box, in degrees."""
    xs, ys = F.transform(ring, lon), F.transform(ring, lat)
    return (F.array_max(xs) - F.array_min(xs)) * (F.array_max(ys) - F.array_min(ys))


def rings_to_polygon(rings: Column, auto_close: bool = True, auto_order: bool = True) -> Column:
    """Rings of a polygon; with ``auto_order`` the one with the largest bounding box leads."""
    rings = F.transform(rings, close_ring) if auto_close else rings
    if not auto_order:
        return rings
    sizes = F.transform(rings, _extent)
    first = F.array_position(sizes, F.array_max(sizes)).cast("int")
    rest = F.filter(rings, lambda r, k: k != first - 1)
    return F.when(F.size(rings) <= 1, rings).otherwise(F.concat(F.array(F.element_at(rings, first)), rest))


def line_to_polygon(g: Column, auto_close: bool = True, auto_order: bool = True) -> Column:
    """The polygon whose rings are the lines of a LineString or MultiLineString."""
    return make("Polygon", F.array(rings_to_polygon(lines_of(g), auto_close, auto_order)), g["bbox"])


def lines_to_multi_polygon(geometries: Column, auto_close: bool = True, auto_order: bool = True) -> Column:
    """The MultiPolygon of an array of line geometries, a polygon each."""
    return multi_polygon(F.transform(geometries, lambda g: rings_to_polygon(lines_of(g), auto_close, auto_order)))


# properties


def properties_as(props: Column, ddl: str) -> Column:
    """Properties as a struct of the caller's types; keys that it lacks are left out, missing ones are null."""
    return F.from_json(props, ddl)


def contains_property(props: Column, key: str) -> Column:
    """Whether a JSON object has a key; false for null."""
    return F.coalesce(F.array_contains(F.json_object_keys(props), key), F.lit(False))


def property_as(props: Column, key: str, kind: str) -> Column:
    """A property of a JSON object; null where it is missing, an error where it has another type."""
    return F.variant_get(F.parse_json(props), "$." + key, kind)


def string_property(props: Column, key: str) -> Column:
    return property_as(props, key, "string")


def double_property(props: Column, key: str) -> Column:
    return property_as(props, key, "double")


def int_property(props: Column, key: str) -> Column:
    return property_as(props, key, "int")


def boolean_property(props: Column, key: str) -> Column:
    return property_as(props, key, "boolean")
