"""SQL names of the functions, for queries in text: temporary SQL functions, which Spark inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

R, EQUATOR = 6371008.8, 6378137.0
GEOMETRY = "STRUCT<type: STRING, parts: ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>, bbox: ARRAY<DOUBLE>>"
_SQUARE = "(pow(sin(radians(b[1] - a[1]) / 2), 2) + pow(sin(radians(b[0] - a[0]) / 2), 2) * cos(radians(a[1])) * cos(radians(b[1])))"
HOP = f"{R}D * 2 * atan2(sqrt({_SQUARE}), sqrt(1 - {_SQUARE}))"  # metres between positions a and b
#: Even-odd test of the place x, y; the boundary isn't told apart, for that use the column function.
IN_RING = (
    "aggregate(zip_with(slice({ring}, 1, size({ring}) - 1), slice({ring}, 2, size({ring}) - 1), (p, q) -> (p[1] > y) <> (q[1] > y) AND x < (q[0] - p[0]) * (y - p[1]) / nullif(q[1] - p[1], 0D) + p[0]), "
    "false, (s, e) -> s <> coalesce(e, false))"
)
#: name(arguments) -> body
FUNCTIONS = {
    "st_distance_lonlat(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)": (
        "DOUBLE",
        f"{R}D * 2 * atan2(sqrt(pow(sin(radians(y2 - y1) / 2), 2) + pow(sin(radians(x2 - x1) / 2), 2) * cos(radians(y1)) * cos(radians(y2))), "
        "sqrt(1 - (pow(sin(radians(y2 - y1) / 2), 2) + pow(sin(radians(x2 - x1) / 2), 2) * cos(radians(y1)) * cos(radians(y2)))))",
    ),
    "st_bearing_lonlat(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)": (
        "DOUBLE",
        "pmod(degrees(atan2(sin(radians(x2) - radians(x1)) * cos(radians(y2)), cos(radians(y1)) * sin(radians(y2)) - sin(radians(y1)) * cos(radians(y2)) * cos(radians(x2) - radians(x1)))), 360D)",
    ),
    "st_point(x DOUBLE, y DOUBLE)": (GEOMETRY, "named_struct('type', 'Point', 'parts', array(array(array(array(x, y)))), 'bbox', CAST(NULL AS ARRAY<DOUBLE>))"),
    "st_x(g STRUCT<type: STRING, parts: ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>, bbox: ARRAY<DOUBLE>>)": ("DOUBLE", "g.parts[0][0][0][0]"),
    "st_y(g STRUCT<type: STRING, parts: ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>, bbox: ARRAY<DOUBLE>>)": ("DOUBLE", "g.parts[0][0][0][1]"),
    "st_bbox_intersects(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)": ("BOOLEAN", "a[0] <= b[2] AND a[1] <= b[3] AND a[2] >= b[0] AND a[3] >= b[1]"),
    f"st_type(g {GEOMETRY})": ("STRING", "g.type"),
    f"st_positions(g {GEOMETRY})": ("ARRAY<ARRAY<DOUBLE>>", "flatten(flatten(g.parts))"),
    f"st_bbox(g {GEOMETRY})": (
        "ARRAY<DOUBLE>",
        "array(array_min(transform(flatten(flatten(g.parts)), p -> p[0])), array_min(transform(flatten(flatten(g.parts)), p -> p[1])), array_max(transform(flatten(flatten(g.parts)), p -> p[0])), array_max(transform(flatten(flatten(g.parts)), p -> p[1])))",
    ),
    f"st_length(g {GEOMETRY})": (
        "DOUBLE",
        f"CASE WHEN g.type IN ('Point', 'MultiPoint') THEN 0D ELSE aggregate(flatten(g.parts), 0D, (s, l) -> s + aggregate(zip_with(slice(l, 1, greatest(size(l) - 1, 0)), slice(l, 2, greatest(size(l) - 1, 0)), (a, b) -> {HOP}), 0D, (u, v) -> u + v)) END",
    ),
    f"st_area(g {GEOMETRY})": (
        "DOUBLE",
        "CASE WHEN g.type IN ('Polygon', 'MultiPolygon') THEN aggregate(transform(g.parts, rings -> aggregate(transform(rings, (r, k) -> CASE WHEN k = 0 THEN 1 ELSE -1 END * abs("
        "aggregate(CASE WHEN size(r) > 2 THEN sequence(0, size(r) - 1) ELSE array() END, 0D, (s, i) -> s + (radians(r[(i + 2) % size(r)][0]) - radians(r[i][0])) * sin(radians(r[(i + 1) % size(r)][1]))))), 0D, (x, y) -> x + y)), 0D, (x, y) -> x + y)"
        f" * {EQUATOR}D * {EQUATOR}D / 2 ELSE 0D END",
    ),
    f"st_contains(g {GEOMETRY}, x DOUBLE, y DOUBLE)": (
        "BOOLEAN",
        f"exists(g.parts, rings -> {IN_RING.format(ring='rings[0]')} AND NOT exists(slice(rings, 2, greatest(size(rings), 1)), hole -> {IN_RING.format(ring='hole')}))",
    ),
    "st_tile_id(z INT, x BIGINT, y BIGINT)": (
        "BIGINT",
        "(shiftleft(1L, 2 * z) - 1) div 3 + aggregate(CASE WHEN z > 0 THEN sequence(z - 1, 0, -1) ELSE array() END, named_struct('x', x, 'y', y, 'd', 0L), (s, k) -> named_struct("
        "'x', CASE WHEN s.y & shiftleft(1L, k) = 0 THEN CASE WHEN s.x & shiftleft(1L, k) <> 0 THEN shiftleft(1L, k) - 1 - s.y ELSE s.y END ELSE s.x END, "
        "'y', CASE WHEN s.y & shiftleft(1L, k) = 0 THEN CASE WHEN s.x & shiftleft(1L, k) <> 0 THEN shiftleft(1L, k) - 1 - s.x ELSE s.x END ELSE s.y END, "
        "'d', s.d + shiftleft(1L, k) * shiftleft(1L, k) * CASE WHEN s.x & shiftleft(1L, k) <> 0 THEN CASE WHEN s.y & shiftleft(1L, k) <> 0 THEN 2L ELSE 3L END ELSE CASE WHEN s.y & shiftleft(1L, k) <> 0 THEN 1L ELSE 0L END END), s -> s.d)",
    ),
    "st_zoom_start(z INT)": ("BIGINT", "(shiftleft(1L, 2 * z) - 1) div 3"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [h.split("(")[0] for h in FUNCTIONS]
