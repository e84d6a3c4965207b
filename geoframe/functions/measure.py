"""Distances, bearings, areas and boxes on a sphere. Lengths are metres, angles degrees.

Arguments are positions unless a name says otherwise; a null argument gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import collection_coordinates, coordinates, lat, let, lines_of, lon, make, num, point, polygon, position

# fixed values: the sphere's mean radius, for lengths, and its equatorial one, for areas
RADIUS = 6371008.8
EQUATOR = 6378137.0


def _sq(x: Column) -> Column:
    return x * x


def distance_lonlat(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    a = _sq(F.sin(F.radians(y2 - y1) / 2)) + _sq(F.sin(F.radians(x2 - x1) / 2)) * F.cos(F.radians(y1)) * F.cos(F.radians(y2))
    return F.lit(RADIUS) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def distance(a: Column, b: Column) -> Column:
    """Great-circle distance."""
    return distance_lonlat(lon(a), lat(a), lon(b), lat(b))


def _isometric(y1: Column, y2: Column) -> Column:
    return F.ln(F.tan(F.radians(y2) / 2 + math.pi / 4) / F.tan(F.radians(y1) / 2 + math.pi / 4))


def rhumb_distance(a: Column, b: Column) -> Column:
    """Distance along a line of constant bearing, the short way round."""
    gap = lon(b) - lon(a)
    x2 = lon(b) + F.when(gap > 180, -360.0).when(gap < -180, 360.0).otherwise(0.0)
    dy, dx, stretch = F.radians(lat(b)) - F.radians(lat(a)), F.abs(F.radians(x2) - F.radians(lon(a))), _isometric(lat(a), lat(b))
    q = F.when(F.abs(stretch) > 1e-11, dy / F.when(stretch != 0, stretch)).otherwise(F.cos(F.radians(lat(a))))
    return F.sqrt(_sq(dy) + _sq(q) * _sq(dx)) * RADIUS


def bearing(a: Column, b: Column, final: bool = False) -> Column:
    """Initial or final great-circle bearing, in [0, 360)."""
    if final:
        return F.pmod(bearing(b, a) + 180, F.lit(360.0))
    dx, y1, y2 = F.radians(lon(b)) - F.radians(lon(a)), F.radians(lat(a)), F.radians(lat(b))
    return F.pmod(F.degrees(F.atan2(F.sin(dx) * F.cos(y2), F.cos(y1) * F.sin(y2) - F.sin(y1) * F.cos(y2) * F.cos(dx))), F.lit(360.0))


def rhumb_bearing(a: Column, b: Column) -> Column:
    dx = F.radians(lon(b) - lon(a))
    dx = F.when(dx > math.pi, dx - 2 * math.pi).when(dx < -math.pi, dx + 2 * math.pi).otherwise(dx)
    return F.pmod(F.degrees(F.atan2(dx, _isometric(lat(a), lat(b)))), F.lit(360.0))


def bearing_signed(a: Column, b: Column) -> Column:
    """The rotation from the bearing to north, in (-180, 180]."""
    back = F.pmod(-bearing(a, b), F.lit(360.0))
    return F.when(back > 180, back - 360).otherwise(back)


def destination(p: Column, metres: Column | float, degrees: Column | float) -> Column:
    """The position at a distance and bearing; its longitude isn't wrapped."""
    d, t = num(metres) / RADIUS, F.radians(num(degrees))
    x, y = F.radians(lon(p)), F.radians(lat(p))
    y2 = F.asin(F.sin(y) * F.cos(d) + F.cos(y) * F.sin(d) * F.cos(t))
    x2 = x + F.atan2(F.sin(t) * F.sin(d) * F.cos(y), F.cos(d) - F.sin(y) * F.sin(y2))
    return position(F.degrees(x2), F.degrees(y2))


def wrap_lon(x: Column) -> Column:
    """A longitude in [-180, 180)."""
    return F.pmod(x + 180, F.lit(360.0)) - 180


def midpoint(a: Column, b: Column) -> Column:
    return destination(a, distance(a, b) / 2, bearing(a, b))


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Rhumb distance to the nearest place of a segment, found in the plane of degrees."""
    ux, uy = lon(b) - lon(a), lat(b) - lat(a)
    along = ux * (lon(p) - lon(a)) + uy * (lat(p) - lat(a))
    whole = ux * ux + uy * uy
    t = F.when(along <= 0, 0.0).when(whole <= along, 1.0).otherwise(along / F.when(whole != 0, whole))
    foot = F.when(along <= 0, F.slice(a, 1, 2)).when(whole <= along, F.slice(b, 1, 2)).otherwise(F.array(lon(a) + t * ux, lat(a) + t * uy))
    return let(foot, lambda f: rhumb_distance(p, f))


def _pairs(line: Column, f) -> Column:
    """f over each position of a line but the last and the next one."""
    n = F.size(line)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(line, 1, F.greatest(n - 1, F.lit(0))), F.slice(line, 2, F.greatest(n - 1, F.lit(0))), f))


def line_distance(p: Column, line: Column) -> Column:
    """Least distance of a position to the segments of a line."""
    return F.array_min(_pairs(line, lambda a, b: segment_distance(p, a, b)))


def line_length(line: Column) -> Column:
    return F.aggregate(_pairs(line, distance), F.lit(0.0), lambda s, x: s + x)


def length(g: Column) -> Column:
    """Length of lines, perimeter of polygons with their holes, 0 for points."""
    whole = F.aggregate(F.transform(lines_of(g), line_length), F.lit(0.0), lambda s, x: s + x)
    return F.when(g["type"].isin("Point", "MultiPoint"), F.lit(0.0)).otherwise(whole)


def ring_area(ring: Column) -> Column:
    """Signed spherical area of a closed ring, in square metres."""
    n = F.size(ring)
    at = lambda k: F.get(ring, k % n)
    terms = F.when(n > 2, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(terms, F.lit(0.0), lambda s, k: s + (F.radians(lon(at(k + 2))) - F.radians(lon(at(k)))) * F.sin(F.radians(lat(at(k + 1)))))
    return total * (EQUATOR * EQUATOR) / 2


def rings_area(rings: Column) -> Column:
    sizes = F.transform(rings, lambda r: F.abs(ring_area(r)))
    return F.aggregate(sizes, F.lit(0.0), lambda s, x: s - x) + 2 * F.coalesce(F.get(sizes, 0), F.lit(0.0))


def area(g: Column) -> Column:
    """Area of polygons, holes taken off; 0 for points and lines."""
    whole = F.aggregate(F.transform(g["parts"], rings_area), F.lit(0.0), lambda s, x: s + x)
    return F.when(g["type"].isin("Polygon", "MultiPolygon"), whole).otherwise(F.when(g.isNotNull(), F.lit(0.0)))


# boxes: [west, south, east, north], or with altitudes [west, south, low, east, north, high]


def west(b: Column) -> Column:
    return F.get(b, 0)


def south(b: Column) -> Column:
    return F.get(b, 1)


def east(b: Column) -> Column:
    return F.when(F.size(b) >= 6, F.get(b, 3)).otherwise(F.get(b, 2))


def north(b: Column) -> Column:
    return F.when(F.size(b) >= 6, F.get(b, 4)).otherwise(F.get(b, 3))


def low(b: Column) -> Column:
    return F.when(F.size(b) >= 6, F.get(b, 2))


def high(b: Column) -> Column:
    return F.when(F.size(b) >= 6, F.get(b, 5))


def southwest(b: Column) -> Column:
    return F.slice(b, 1, (F.size(b) / 2).cast("int"))


def northeast(b: Column) -> Column:
    half = (F.size(b) / 2).cast("int")
    return F.slice(b, half + 1, half)


def box(w: Column | float, s: Column | float, e: Column | float, n: Column | float) -> Column:
    return F.array(*map(num, (w, s, e, n)))


def box_of_corners(sw: Column, ne: Column) -> Column:
    """A box of two corners, in the axes that both have."""
    n = F.least(F.size(sw), F.size(ne))
    return F.concat(F.slice(sw, 1, n), F.slice(ne, 1, n))


def positions_bbox(positions: Column) -> Column:
    def of(ps: Column) -> Column:
        xs, ys = F.transform(ps, lon), F.transform(ps, lat)
        return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))

    finite = lambda b: F.forall(b, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return let(let(positions, of), lambda b: F.when(F.coalesce(finite(b), F.lit(False)), b))


def compute_bbox(g: Column) -> Column:
    """Box of all positions; null where there are none or one isn't finite."""
    return positions_bbox(coordinates(g))


def bbox_or_error(g: Column) -> Column:
    """Box of all positions; an error where there are none or one isn't finite, null for null."""
    return F.when(g.isNull(), F.lit(None).cast("array<double>")).otherwise(F.coalesce(compute_bbox(g), F.raise_error(F.lit("a box needs finite positions")).cast("array<double>")))


def _sum_over(gs: Column, f) -> Column:
    return F.aggregate(F.transform(gs, f), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def collection_length(gs: Column) -> Column:
    """Length of all members of a collection; null for null, 0 for none."""
    return _sum_over(gs, length)


def collection_area(gs: Column) -> Column:
    """Area of all members of a collection; null for null, 0 for none."""
    return _sum_over(gs, area)


def collection_bbox(gs: Column) -> Column:
    """Box of all positions of a collection; null where there are none or one isn't finite."""
    return positions_bbox(collection_coordinates(gs))


def with_bbox(g: Column) -> Column:
    return make(g["type"], g["parts"], compute_bbox(g))


def bbox_or_computed(g: Column) -> Column:
    return F.coalesce(g["bbox"], compute_bbox(g))


def bbox_center(b: Column) -> Column:
    return point(position((west(b) + east(b)) / 2, (south(b) + north(b)) / 2))


def bbox_polygon(b: Column) -> Column:
    """The rectangle, counter-clockwise from the south-west; an error for a box with altitudes."""

    def of(x: Column) -> Column:
        flat = F.when(x.isNull() | (F.size(x) == 4), x).otherwise(F.raise_error(F.lit("a box with altitudes has no rectangle")).cast("array<double>"))
        corner = lambda i, k: position(F.get(x, i), F.get(x, k))
        ring = F.array(corner(0, 1), corner(2, 1), corner(2, 3), corner(0, 3), corner(0, 1))
        return polygon(F.when(flat.isNotNull(), F.array(ring)), x)

    return let(b, of)


def envelope(g: Column) -> Column:
    return bbox_polygon(bbox_or_computed(g))


def bbox_square(b: Column) -> Column:
    """The box widened, in degrees, along the side that is shorter in metres."""
    w, s, e, n = west(b), south(b), east(b), north(b)
    wide = distance_lonlat(w, s, e, s) >= distance_lonlat(w, s, w, n)
    x, y = (w + e) / 2, (s + n) / 2
    return F.when(wide, box(w, y - (e - w) / 2, e, y + (e - w) / 2)).otherwise(box(x - (n - s) / 2, s, x + (n - s) / 2, n))


def bboxes_intersect(a: Column, b: Column) -> Column:
    return (west(a) <= east(b)) & (south(a) <= north(b)) & (east(a) >= west(b)) & (north(a) >= south(b))


def bbox_contains(a: Column, b: Column) -> Column:
    return (west(a) <= west(b)) & (south(a) <= south(b)) & (east(a) >= east(b)) & (north(a) >= north(b))
