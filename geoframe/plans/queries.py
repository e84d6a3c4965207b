"""Queries over the driver's tables, one an operator family, with the same in DuckDB's SQL.

The tables have no geometry; coordinates come from keys by integer arithmetic that both engines
do alike. Floats are rounded after all else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoframe.functions import geometry as G
from geoframe.functions import lines as L
from geoframe.functions import measure as M
from geoframe.functions import predicates as P
from geoframe.functions import tiles as T
from geoframe.functions import transform as X
from geoframe.functions import units as U
from geoframe.operators import collections as C
from geoframe.operators import join as J
from geoframe.operators.index import SpatialIndex
from geoframe.sources import geojson, geouri, polyline
from geoframe.sources.pmtiles.writer import entry_runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def lon_of(k: str) -> str:
    return f"(((({k}) * 7919) % 360000) / CAST(1000 AS DOUBLE) - 180)"


def lat_of(k: str) -> str:
    return f"(((({k}) * 104729) % 170000) / CAST(1000 AS DOUBLE) - 85)"


POINTS = f"SELECT c_custkey AS id, {lon_of('c_custkey')} AS x1, {lat_of('c_custkey')} AS y1, {lon_of('c_custkey * 3 + 7')} AS x2, {lat_of('c_custkey * 5 + 11')} AS y2 FROM customer"
BOXES = f"SELECT s_suppkey AS bid, {lon_of('s_suppkey')} / 2 AS cx, {lat_of('s_suppkey')} / 2 AS cy, (s_suppkey % 50 + 10) / CAST(10 AS DOUBLE) AS w FROM supplier"
PX, PY = f"({lon_of('id')} / 2 + ((id * 31 + i * 17) % 200 - 100) / CAST(100 AS DOUBLE))", f"({lat_of('id')} / 2 + ((id * 13 + i * 29) % 200 - 100) / CAST(100 AS DOUBLE))"
LINES_SPARK = f"SELECT id, transform(sequence(0, 5), i -> array({PX}, {PY})) AS line FROM (SELECT c_custkey AS id FROM customer)"
LINES_SQL = f"SELECT id, list_transform(range(0, 6), lambda i: [{PX}, {PY}]) AS line FROM (SELECT c_custkey AS id FROM customer)"


def rows(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """A SELECT over tables of a folder, given as views of the query alone."""
    return spark.sql(text.replace(" FROM customer", " FROM {customer}").replace(" FROM supplier", " FROM {supplier}"), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir, POINTS, "customer")
    return df.withColumns({"a": F.array("x1", "y1"), "b": F.array("x2", "y2")})


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, LINES_SPARK, "customer")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows(spark, sf_dir, BOXES, "supplier")
    box = M.box(F.col("cx") - F.col("w"), F.col("cy") - F.col("w"), F.col("cx") + F.col("w"), F.col("cy") + F.col("w"))
    return df.withColumn("box", box).withColumn("polygon", M.bbox_polygon(F.col("box")))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def scalar(name: str, column: Callable[[], Column], sql: str, digits: int = 6):
    """A query of one rounded measure of each pair of points."""
    QUERIES[name] = lambda spark, d: points(spark, d).select("id", F.round(column(), digits).alias("value"))
    SQL[name] = f"WITH p AS ({POINTS}) SELECT id, round({sql}, {digits}) AS value FROM p"




def _a() -> Column:
    return F.col("a")


def _b() -> Column:
    return F.col("b")


R = "CAST(6371008.8 AS DOUBLE)"


def hav(x1: str, y1: str, x2: str, y2: str) -> str:
    h = f"(pow(sin(radians({y2} - {y1}) / 2), 2) + pow(sin(radians({x2} - {x1}) / 2), 2) * cos(radians({y1})) * cos(radians({y2})))"
    return f"({R} * 2 * atan2(sqrt({h}), sqrt(1 - {h})))"


def pmod(x: str) -> str:
    return f"(({x}) - 360 * floor(({x}) / 360))"


def brg(x1: str, y1: str, x2: str, y2: str) -> str:
    dx = f"(radians({x2}) - radians({x1}))"
    return pmod(f"degrees(atan2(sin({dx}) * cos(radians({y2})), cos(radians({y1})) * sin(radians({y2})) - sin(radians({y1})) * cos(radians({y2})) * cos({dx})))")


def dest(x: str, y: str, d: str, t: str) -> tuple[str, str]:
    y2 = f"asin(sin(radians({y})) * cos({d} / {R}) + cos(radians({y})) * sin({d} / {R}) * cos(radians({t})))"
    return f"degrees(radians({x}) + atan2(sin(radians({t})) * sin({d} / {R}) * cos(radians({y})), cos({d} / {R}) - sin(radians({y})) * sin({y2})))", f"degrees({y2})"


ISO = "ln(tan(radians({b}) / 2 + pi() / 4) / tan(radians({a}) / 2 + pi() / 4))"


def rhumb(x1: str, y1: str, x2: str, y2: str) -> str:
    iso = ISO.format(a=y1, b=y2)
    x3 = f"({x2} + CASE WHEN {x2} - {x1} > 180 THEN -360 WHEN {x2} - {x1} < -180 THEN 360 ELSE 0 END)"
    q = f"(CASE WHEN abs({iso}) > CAST(1e-11 AS DOUBLE) THEN (radians({y2}) - radians({y1})) / {iso} ELSE cos(radians({y1})) END)"
    return f"({R} * sqrt(pow(radians({y2}) - radians({y1}), 2) + pow({q}, 2) * pow(radians({x3}) - radians({x1}), 2)))"


P4 = ("x1", "y1", "x2", "y2")
DX = "radians(x2 - x1)"
WRAPPED = f"(CASE WHEN {DX} > pi() THEN {DX} - 2 * pi() WHEN {DX} < -pi() THEN {DX} + 2 * pi() ELSE {DX} END)"
scalar("haversine", lambda: M.distance(_a(), _b()) / 1000, f"{hav(*P4)} / 1000", 3)
scalar("rhumb_distance", lambda: M.rhumb_distance(_a(), _b()) / 1000, f"{rhumb(*P4)} / 1000", 3)
scalar("bearing_initial", lambda: M.bearing(_a(), _b()), brg(*P4), 5)
scalar("bearing_final", lambda: M.bearing(_a(), _b(), final=True), pmod(f"{brg('x2', 'y2', 'x1', 'y1')} + 180"), 5)
scalar("rhumb_bearing", lambda: M.rhumb_bearing(_a(), _b()), pmod(f"degrees(atan2({WRAPPED}, {ISO.format(a='y1', b='y2')}))"), 5)
scalar("round_half_even", lambda: G.round_even(F.col("x1"), 2), "round_even(x1, 2)", 2)
scalar("unit_convert", lambda: U.convert(M.distance(_a(), _b()), "meters", "nautical_miles"), f"{hav(*P4)} / 1852", 3)
scalar("bearing_arith", lambda: U.smallest_rotation(M.bearing(_a(), _b()), M.rhumb_bearing(_a(), _b())), "CASE WHEN t > 180 THEN t - 360 ELSE t END", 4)
SQL["bearing_arith"] = f"WITH p AS ({POINTS}), q AS (SELECT *, {brg(*P4)} AS b1, {pmod(f'degrees(atan2({WRAPPED}, {ISO.format(a="y1", b="y2")}))')} AS b2 FROM p), r AS (SELECT id, {pmod('b2 - b1')} AS t FROM q) SELECT id, round(CASE WHEN t > 180 THEN t - 360 ELSE t END, 4) AS value FROM r"
FAR = dest("x1", "y1", "d", "t")


@query("destination", f"WITH p AS ({POINTS}), q AS (SELECT *, CAST(1000 * (id % 900 + 1) AS DOUBLE) AS d, CAST(id % 360 AS DOUBLE) AS t FROM p) SELECT id, round({FAR[0]}, 6) AS lon, round({FAR[1]}, 6) AS lat FROM q")
def destination(spark, d):
    to = M.destination(_a(), 1000 * (F.col("id") % 900 + 1), F.col("id") % 360)
    return points(spark, d).select("id", to.alias("to")).select("id", F.round(G.lon(F.col("to")), 6).alias("lon"), F.round(G.lat(F.col("to")), 6).alias("lat"))


MID = dest("x1", "y1", "d", "t")


@query("midpoint", f"WITH p AS ({POINTS}), q AS (SELECT *, {hav(*P4)} / 2 AS d, {brg(*P4)} AS t FROM p) SELECT id, round({MID[0]}, 5) AS lon, round({MID[1]}, 5) AS lat FROM q")
def midpoint(spark, d):
    bound = points(spark, d).select("id", "a", (M.distance(_a(), _b()) / 2).alias("d"), M.bearing(_a(), _b()).alias("t"))
    to = bound.select("id", M.destination(_a(), F.col("d"), F.col("t")).alias("to"))
    return to.select("id", F.round(G.lon(F.col("to")), 5).alias("lon"), F.round(G.lat(F.col("to")), 5).alias("lat"))


HOP = hav("line[i][1]", "line[i][2]", "line[i + 1][1]", "line[i + 1][2]")


@query("line_length", f"WITH l AS ({LINES_SQL}) SELECT id, round(list_sum(list_transform(range(1, 6), lambda i: {HOP})) / 1000, 3) AS km FROM l")
def line_length(spark, d):
    return lines(spark, d).select("id", F.round(M.length(G.line_string(F.col("line"))) / 1000, 3).alias("km"))


SEG = "line[i][1] + t * (line[i + 1][1] - line[i][1]), line[i][2] + t * (line[i + 1][2] - line[i][2])"


@query(
    "point_line_distance",
    f"""WITH l AS ({LINES_SQL}), s AS (SELECT id, {lon_of('id')} / 2 AS px, {lat_of('id')} / 2 AS py, line[i][1] AS ax, line[i][2] AS ay, line[i + 1][1] AS bx, line[i + 1][2] AS by_ FROM l, (SELECT unnest(range(1, 6)) AS i)),
    t AS (SELECT *, (bx - ax) * (px - ax) + (by_ - ay) * (py - ay) AS v, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS u FROM s),
    f AS (SELECT id, px, py, CASE WHEN v <= 0 THEN ax WHEN u <= v THEN bx ELSE ax + v / u * (bx - ax) END AS fx, CASE WHEN v <= 0 THEN ay WHEN u <= v THEN by_ ELSE ay + v / u * (by_ - ay) END AS fy FROM t)
    SELECT id, round(min({rhumb('px', 'py', 'fx', 'fy')}) / 1000, 3) AS km FROM f GROUP BY id""",
)
def point_line_distance(spark, d):
    p = F.array(F.expr(f"{lon_of('id')} / 2"), F.expr(f"{lat_of('id')} / 2"))
    return lines(spark, d).withColumn("p", p).select("id", F.round(M.line_distance(F.col("p"), F.col("line")) / 1000, 3).alias("km"))


RING = "[[cx - w, cy - w], [cx + w, cy - w], [cx + w, cy + w], [cx - w, cy + w], [cx - w, cy - w]]"
AREA = "abs(list_sum(list_transform(range(0, 5), lambda k: (radians(ring[(k + 2) % 5 + 1][1]) - radians(ring[k % 5 + 1][1])) * sin(radians(ring[(k + 1) % 5 + 1][2])))) * CAST(6378137.0 AS DOUBLE) * CAST(6378137.0 AS DOUBLE) / 2)"


@query("polygon_area", f"WITH b AS ({BOXES}), r AS (SELECT *, {RING} AS ring FROM b) SELECT bid, round({AREA} / 1000000, 2) AS km2 FROM r")
def polygon_area(spark, d):
    return boxes(spark, d).select("bid", F.round(M.area(F.col("polygon")) / 1e6, 2).alias("km2"))


@query("bbox_agg", f"WITH l AS ({LINES_SQL}), p AS (SELECT id % 7 AS k, unnest(line) AS p FROM l) SELECT k, round(min(p[1]), 6) AS west, round(min(p[2]), 6) AS south, round(max(p[1]), 6) AS east, round(max(p[2]), 6) AS north FROM p GROUP BY k")
def bbox_agg(spark, d):
    made = C.total_bbox(lines(spark, d).select((F.col("id") % 7).alias("k"), G.line_string(F.col("line")).alias("geometry")), by=["k"])
    b = F.col("bbox")
    return made.select("k", *[F.round(f(b), 6).alias(n) for f, n in ((M.west, "west"), (M.south, "south"), (M.east, "east"), (M.north, "north"))])


@query("bbox_center", f"WITH b AS ({BOXES}) SELECT bid, round(((cx - w) + (cx + w)) / 2, 6) AS lon, round(((cy - w) + (cy + w)) / 2, 6) AS lat FROM b")
def bbox_center(spark, d):
    c = G.only_position(M.bbox_center(F.col("box")))
    return boxes(spark, d).select("bid", F.round(G.lon(c), 6).alias("lon"), F.round(G.lat(c), 6).alias("lat"))


@query(
    "bbox_square",
    f"""WITH b AS ({BOXES}), e AS (SELECT bid, cx - 2 * w AS x1, cy - w AS y1, cx + 2 * w AS x2, cy + w AS y2 FROM b), f AS (SELECT *, {hav('x1', 'y1', 'x2', 'y1')} >= {hav('x1', 'y1', 'x1', 'y2')} AS wide FROM e)
    SELECT bid, round(CASE WHEN wide THEN x1 ELSE (x1 + x2) / 2 - (y2 - y1) / 2 END, 6) AS west, round(CASE WHEN wide THEN (y1 + y2) / 2 - (x2 - x1) / 2 ELSE y1 END, 6) AS south FROM f""",
)
def bbox_square(spark, d):
    w = F.col("w")
    s = boxes(spark, d).select("bid", M.bbox_square(M.box(F.col("cx") - 2 * w, F.col("cy") - w, F.col("cx") + 2 * w, F.col("cy") + w)).alias("s"))
    return s.select("bid", F.round(M.west(F.col("s")), 6).alias("west"), F.round(M.south(F.col("s")), 6).alias("south"))


@query("envelope", f"WITH l AS ({LINES_SQL}), p AS (SELECT id, unnest(line) AS p FROM l), b AS (SELECT id, min(p[1]) AS w, min(p[2]) AS s, max(p[1]) AS e, max(p[2]) AS n FROM p GROUP BY id) SELECT id, 5 AS positions, round(w + s + e + s + e + n + w + n + w + s, 4) AS total FROM b")
def envelope(spark, d):
    made = lines(spark, d).select("id", M.envelope(G.line_string(F.col("line"))).alias("g"))
    ps = G.coordinates(F.col("g"))
    return made.select("id", F.size(ps).alias("positions"), F.round(F.aggregate(F.flatten(ps), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("flatten_coords", f"WITH b AS ({BOXES}), r AS (SELECT bid, {RING} AS ring FROM b) SELECT bid, len(ring) AS n, round(ring[3][1], 6) AS lon3 FROM r")
def flatten_coords(spark, d):
    ps = G.coordinates(F.col("polygon"))
    return boxes(spark, d).select("bid", F.size(ps).cast("long").alias("n"), F.round(G.lon(F.get(ps, 2)), 6).alias("lon3"))


@query("explode_points", f"WITH l AS ({LINES_SQL}), e AS (SELECT id, unnest(line) AS p, unnest(range(0, 6)) AS place FROM l) SELECT id, place, round(p[1], 6) AS lon, round(p[2], 6) AS lat FROM e")
def explode_points(spark, d):
    e = lines(spark, d).select("id", F.posexplode(G.coordinates(G.explode_points(G.line_string(F.col("line"))))).alias("place", "p"))
    return e.select("id", F.col("place").cast("long").alias("place"), F.round(G.lon(F.col("p")), 6).alias("lon"), F.round(G.lat(F.col("p")), 6).alias("lat"))


@query(
    "combine_by_type",
    f"""WITH p AS ({POINTS}), l AS ({LINES_SQL}), b AS ({BOXES}), r AS (SELECT {RING} AS ring FROM b)
    SELECT (SELECT count(*) FROM p) AS points, (SELECT count(*) FROM l) AS lines, (SELECT count(*) FROM b) AS polygons, (SELECT round(sum(x1 * y1), 2) FROM p) AS point_sum,
    (SELECT round(sum(list_sum(list_transform(line, lambda q: q[1] * q[2]))), 2) FROM l) AS line_sum, (SELECT round(sum(list_sum(list_transform(ring, lambda q: q[1] * q[2]))), 2) FROM r) AS polygon_sum""",
)
def combine_by_type(spark, d):
    gs = points(spark, d).select(G.point(_a()).alias("geometry")).unionByName(lines(spark, d).select(G.line_string(F.col("line")).alias("geometry"))).unionByName(boxes(spark, d).select(F.col("polygon").alias("geometry")))
    made = C.combine(gs)
    count = lambda c: F.size(G.children(F.col(c))).cast("long").alias(c)
    total = lambda c, n: F.round(F.aggregate(G.coordinates(F.col(c)), F.lit(0.0), lambda s, p: s + G.lon(p) * G.lat(p)), 2).alias(n)
    return made.select(count("points"), count("lines"), count("polygons"), total("points", "point_sum"), total("lines", "line_sum"), total("polygons", "polygon_sum"))


@query("line_to_polygon", f"WITH l AS ({LINES_SQL}) SELECT id, CAST(7 AS BIGINT) AS positions, round(line[1][1], 6) AS last_lon FROM l")
def line_to_polygon(spark, d):
    made = lines(spark, d).select("id", G.coordinates(G.line_to_polygon(G.line_string(F.col("line")))).alias("ps"))
    return made.select("id", F.size("ps").cast("long").alias("positions"), F.round(G.lon(F.element_at("ps", -1)), 6).alias("last_lon"))


EDGE = "ring[i][1] AS xi, ring[i][2] AS yi, ring[CASE WHEN i = 1 THEN 4 ELSE i - 1 END][1] AS xj, ring[CASE WHEN i = 1 THEN 4 ELSE i - 1 END][2] AS yj"
TILTED = "[[cx - w, cy], [cx, cy - w / 2], [cx + w, cy], [cx, cy + w / 2], [cx - w, cy]]"


@query(
    "point_in_polygon",
    f"""WITH b AS ({BOXES}), r AS (SELECT bid, cx + w * ((bid % 21) - 10) / 10 AS x, cy + w * ((bid % 7) - 3) / 10 AS y, {TILTED} AS ring FROM b),
    e AS (SELECT bid, x, y, {EDGE} FROM r, (SELECT unnest(range(1, 5)) AS i)),
    t AS (SELECT bid, y * (xi - xj) + yi * (xj - x) + yj * (x - xi) = 0 AND (xi - x) * (xj - x) <= 0 AND (yi - y) * (yj - y) <= 0 AS on_edge, (yi > y) <> (yj > y) AND x < (xj - xi) * (y - yi) / nullif(yj - yi, 0) + xi AS crosses FROM e)
    SELECT bid, CASE WHEN bool_or(on_edge) THEN true ELSE count(*) FILTER (WHERE coalesce(crosses, false)) % 2 = 1 END AS inside FROM t GROUP BY bid""",
)
def point_in_polygon(spark, d):
    cx, cy, w = F.col("cx"), F.col("cy"), F.col("w")
    ring = F.array(F.array(cx - w, cy), F.array(cx, cy - w / 2), F.array(cx + w, cy), F.array(cx, cy + w / 2), F.array(cx - w, cy))
    p = F.array(cx + w * ((F.col("bid") % 21) - 10) / 10, cy + w * ((F.col("bid") % 7) - 3) / 10)
    return boxes(spark, d).select("bid", "cx", G.polygon(F.array(ring)).alias("g"), p.alias("p")).select("bid", P.contains(F.col("g"), F.col("p")).alias("inside"))


INSIDE = "p.x1 >= b.cx - b.w AND p.x1 <= b.cx + b.w AND p.y1 >= b.cy - b.w AND p.y1 <= b.cy + b.w"


@query("points_within_polygon_semi", f"WITH p AS ({POINTS}), b AS ({BOXES}) SELECT id FROM p WHERE EXISTS (SELECT 1 FROM b WHERE {INSIDE})")
def points_within_polygon_semi(spark, d):
    ps = points(spark, d).select("id", G.point(_a()).alias("geometry"))
    return J.filter_inside(ps, boxes(spark, d).select(F.col("polygon").alias("geometry")), "id").select("id")


@query("spatial_join", f"WITH p AS ({POINTS}), b AS ({BOXES}) SELECT bid, count(*) AS n, min(id) AS first_id FROM p JOIN b ON {INSIDE} GROUP BY bid")
def spatial_join(spark, d):
    ps = points(spark, d).select("id", G.point(_a()).alias("geometry"))
    got = J.points_in_polygons(ps, boxes(spark, d).select("bid", F.col("polygon").alias("geometry")))
    return got.groupBy("polygon.bid").agg(F.count("*").alias("n"), F.min("point.id").alias("first_id"))


@query("bbox_join_distance", f"WITH p AS ({POINTS}), b AS ({BOXES}) SELECT bid, count(*) AS n, round(sum({hav('x1', 'y1', 'cx', 'cy')}) / 1000, 1) AS km FROM p JOIN b ON {INSIDE} GROUP BY bid")
def bbox_join_distance(spark, d):
    """Points joined to the boxes that hold them, with the distances to their centres."""
    ps = points(spark, d).select("id", "x1", "y1", M.box(F.col("x1"), F.col("y1"), F.col("x1"), F.col("y1")).alias("bbox"))
    got = J.boxes_intersect(ps, boxes(spark, d).select("bid", "cx", "cy", F.col("box").alias("bbox")))
    far = M.distance_lonlat(F.col("left.x1"), F.col("left.y1"), F.col("right.cx"), F.col("right.cy"))
    return got.groupBy("right.bid").agg(F.count("*").alias("n"), F.round(F.sum(far) / 1000, 1).alias("km"))


@query("box_join", f"WITH b AS ({BOXES}) SELECT p.bid AS id1, b.bid AS id2 FROM b p JOIN b ON p.bid < b.bid AND p.cx - p.w <= b.cx + b.w AND p.cy - p.w <= b.cy + b.w AND p.cx + p.w >= b.cx - b.w AND p.cy + p.w >= b.cy - b.w")
def box_join(spark, d):
    b = boxes(spark, d).select("bid", F.col("box").alias("bbox"))
    return J.boxes_intersect(b, b).select(F.col("left.bid").alias("id1"), F.col("right.bid").alias("id2")).filter("id1 < id2")


@query("bbox_search", f"WITH p AS ({POINTS}) SELECT id FROM p WHERE x1 BETWEEN -20 AND 40 AND y1 BETWEEN -10 AND 30")
def bbox_search(spark, d):
    return SpatialIndex(points(spark, d).select("id", G.point(_a()).alias("geometry"))).search(M.box(-20, -10, 40, 30)).select("id")


@query("bbox_collides", f"WITH b AS ({BOXES}), k AS (SELECT unnest([1, 2, 3]) AS k) SELECT CAST(k AS INTEGER) AS k, bool_or(cx - w <= k * 10 + 1 AND cx + w >= k * 10 AND cy - w <= k + 1 AND cy + w >= k) AS hit FROM b, k GROUP BY k")
def bbox_collides(spark, d):
    asked = spark.createDataFrame([(k,) for k in (1, 2, 3)], "k int").withColumn("bbox", M.box(F.col("k") * 10, F.col("k"), F.col("k") * 10 + 1, F.col("k") + 1))
    hit = J.boxes_intersect(asked, boxes(spark, d).select("bid", F.col("box").alias("bbox"))).select("left.k").distinct().withColumn("hit", F.lit(True))
    return asked.join(hit, "k", "left").select("k", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("index_remove_anti", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0")
def index_remove_anti(spark, d):
    rows_ = points(spark, d).select("id", G.point(_a()).alias("geometry"))
    return SpatialIndex(rows_).remove(rows_.filter("id % 3 = 0")).df.select("id")


@query("segment_intersect", f"WITH p AS ({POINTS}), s AS (SELECT id, x1 / 2 AS ax, y1 AS ay, x2 / 2 AS bx, y2 AS by_, y1 / 2 AS cx, x1 / 3 AS cy, y2 / 2 AS dx, x2 / 3 AS dy FROM p), t AS (SELECT *, (dy - cy) * (bx - ax) - (dx - cx) * (by_ - ay) AS q FROM s), u AS (SELECT *, ((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) / nullif(q, 0) AS u, ((bx - ax) * (ay - cy) - (by_ - ay) * (ax - cx)) / nullif(q, 0) AS v FROM t) SELECT id, round(ax + u * (bx - ax), 5) AS lon, round(ay + u * (by_ - ay), 5) AS lat FROM u WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1")
def segment_intersect(spark, d):
    x1, y1, x2, y2 = (F.col(c) for c in P4)
    at = L.intersect_segments(F.array(x1 / 2, y1), F.array(x2 / 2, y2), F.array(y1 / 2, x1 / 3), F.array(y2 / 2, x2 / 3))
    return points(spark, d).select("id", at.alias("at")).filter("at IS NOT NULL").select("id", F.round(G.lon(F.col("at")), 5).alias("lon"), F.round(G.lat(F.col("at")), 5).alias("lat"))


RIM = dest("x", "y", "r", "t")


@query("circle", f"WITH p AS (SELECT id, x1 AS x, y1 AS y, CAST((id % 50 + 1) * 1000 AS DOUBLE) AS r, unnest(range(0, 17)) AS k FROM ({POINTS})), q AS (SELECT id, k, x, y, r, k * CAST(-360 AS DOUBLE) / 16 AS t FROM p) SELECT id, k AS place, round({RIM[0]}, 5) AS lon, round({RIM[1]}, 5) AS lat FROM q")
def circle(spark, d):
    made = points(spark, d).select("id", X.circle(_a(), (F.col("id") % 50 + 1) * 1000, 16).alias("g"))
    e = made.select("id", F.posexplode(G.coordinates(F.col("g"))).alias("place", "p")).filter("place < 17")
    return e.select("id", F.col("place").cast("long").alias("place"), F.round(G.lon(F.col("p")), 5).alias("lon"), F.round(G.lat(F.col("p")), 5).alias("lat"))


GRID_STEP = f"(CAST(50000 AS DOUBLE) / ({R} * pi() / 180))"


@query("square_grid", f"WITH b AS ({BOXES}), g AS (SELECT bid, w, CAST(floor(2 * w / {GRID_STEP}) AS BIGINT) AS n FROM b) SELECT bid, CAST(col AS INTEGER) AS col, CAST(row_ AS INTEGER) AS row_, round(-w + (2 * w - n * {GRID_STEP}) / 2 + col * {GRID_STEP}, 6) AS west, round(-w + (2 * w - n * {GRID_STEP}) / 2 + (row_ + 1) * {GRID_STEP}, 6) AS north FROM g, LATERAL (SELECT unnest(range(0, n)) AS col) c, LATERAL (SELECT unnest(range(0, n)) AS row_) r WHERE n > 0")
def square_grid(spark, d):
    b = boxes(spark, d)
    cells = X.square_grid(b.select("bid", F.array(F.lit(0.0) - F.col("w"), F.lit(0.0) - F.col("w"), F.col("w"), F.col("w")).alias("box")), F.col("box"), 50000.0)
    box = M.compute_bbox(F.col("cell"))
    return cells.select("bid", "col", F.col("row").alias("row_"), box.alias("b")).select("bid", "col", "row_", F.round(M.west(F.col("b")), 6).alias("west"), F.round(M.north(F.col("b")), 6).alias("north"))


@query(
    "great_circle",
    f"""WITH p AS ({POINTS}), d AS (SELECT *, {hav(*P4)} / {R} AS d FROM p), k AS (SELECT unnest(range(0, 20)) AS k),
    w AS (SELECT id, x1, y1, x2, y2, k, sin((1 - (k + 1) / CAST(19 AS DOUBLE)) * d) / sin(d) AS p, sin((k + 1) / CAST(19 AS DOUBLE) * d) / sin(d) AS q FROM d, k WHERE d > 0 AND abs(d - pi()) > CAST(1e-12 AS DOUBLE)),
    v AS (SELECT *, p * cos(radians(y1)) * cos(radians(x1)) + q * cos(radians(y2)) * cos(radians(x2)) AS vx, p * cos(radians(y1)) * sin(radians(x1)) + q * cos(radians(y2)) * sin(radians(x2)) AS vy, p * sin(radians(y1)) + q * sin(radians(y2)) AS vz FROM w),
    c AS (SELECT id, k, CASE k WHEN 0 THEN x1 WHEN 19 THEN x2 ELSE degrees(atan2(vy, vx)) END AS x, CASE k WHEN 0 THEN y1 WHEN 19 THEN y2 ELSE degrees(atan2(vz, sqrt(vx * vx + vy * vy))) END AS y FROM v),
    s AS (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY k) AS px FROM c),
    j AS (SELECT id, count(*) FILTER (abs(x - px) > 350 AND ((px > 170 AND x < -170) OR (px < -170 AND x > 170))) AS cuts, coalesce(max(abs(x - px)) FILTER (abs(x - px) <= 350), 0) AS ordinary, round(max(y) FILTER (k = 7), 5) AS lat7 FROM s GROUP BY id)
    SELECT p.id, CASE WHEN cuts > 0 AND ordinary < 10 THEN 'MultiLineString' WHEN cuts IS NOT NULL THEN 'LineString' END AS type, CAST(20 + CASE WHEN ordinary < 10 THEN 2 * cuts ELSE 0 END AS BIGINT) AS positions, CASE WHEN cuts = 0 THEN lat7 END AS lat7
    FROM p LEFT JOIN j USING (id)""",
)
def great_circle(spark, d):
    made = points(spark, d).select("id", X.great_circle(_a(), _b(), 20).alias("g"))
    seventh = F.when(F.col("g.type") == "LineString", F.round(G.lat(F.get(G.coordinates(F.col("g")), 7)), 5))
    uncut = ~F.exists(F.zip_with(F.slice(G.coordinates(F.col("g")), 1, 19), F.slice(G.coordinates(F.col("g")), 2, 19), lambda p, q: F.abs(G.lon(q) - G.lon(p)) > 350), lambda x: F.coalesce(x, F.lit(False)))
    return made.select("id", F.col("g.type").alias("type"), F.size(G.coordinates(F.col("g"))).cast("long").alias("positions"), F.when(uncut, seventh).alias("lat7"))


def nearest_sql(px: str, py: str) -> str:
    """CTEs ending in ``near`` (id, x, y, d, at, i): the nearest place of each of ``l`` to a position, by every candidate of every segment."""
    a, b = ("line[i][1]", "line[i][2]"), ("line[i + 1][1]", "line[i + 1][2]")
    one, two = dest("px", "py", "h", "(t + 90)"), dest("px", "py", "h", "(t - 90)")
    return f"""seg AS (SELECT id, i, line, {px} AS px, {py} AS py, {a[0]} AS ax, {a[1]} AS ay, {b[0]} AS bx, {b[1]} AS by_, {hav(*a, *b)} AS n FROM l, (SELECT unnest(range(1, 6)) AS i)),
    aim AS (SELECT *, {hav('px', 'py', 'ax', 'ay')} AS da, {hav('px', 'py', 'bx', 'by_')} AS db, greatest({hav('px', 'py', 'ax', 'ay')}, {hav('px', 'py', 'bx', 'by_')}) AS h, {brg('ax', 'ay', 'bx', 'by_')} AS t, coalesce(sum(n) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM seg),
    ends AS (SELECT *, {one[0]} AS cx, {one[1]} AS cy, {two[0]} AS ex, {two[1]} AS ey FROM aim),
    cut AS (SELECT *, (by_ - ay) * (ex - cx) - (bx - ax) * (ey - cy) AS q FROM ends),
    uv AS (SELECT *, ((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) / nullif(q, 0) AS u, ((ex - cx) * (cy - ay) - (ey - cy) * (cx - ax)) / nullif(q, 0) AS v FROM cut),
    cand AS (SELECT id, i, before, ax, ay, 0 AS c, ax AS x, ay AS y, da AS d, i - 1 AS k FROM uv UNION ALL SELECT id, i, before, ax, ay, 1, bx, by_, db, i FROM uv
      UNION ALL SELECT id, i, before, ax, ay, 2, cx + u * (ex - cx), cy + u * (ey - cy), {hav('px', 'py', '(cx + u * (ex - cx))', '(cy + u * (ey - cy))')}, i - 1 FROM uv WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1),
    near AS (SELECT id, x, y, d, before + {hav('ax', 'ay', 'x', 'y')} AS at_m, k FROM cand QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, i, c) = 1)"""


@query("nearest_on_line", f"WITH l AS ({LINES_SQL}), {nearest_sql(lon_of('id') + ' / 2', lat_of('id') + ' / 2')} SELECT id, CAST(k AS INTEGER) AS index, round(d / 1000, 3) AS km, round(at_m / 1000, 3) AS at_km, round(x, 5) AS lon, round(y, 5) AS lat FROM near")
def nearest_on_line(spark, d):
    p = F.array(F.expr(f"{lon_of('id')} / 2"), F.expr(f"{lat_of('id')} / 2"))
    near = lines(spark, d).withColumn("p", p).select("id", L.nearest_on_lines(F.array("line"), F.col("p")).alias("n"))
    return near.select("id", "n.index", F.round(F.col("n.distance") / 1000, 3).alias("km"), F.round(F.col("n.location") / 1000, 3).alias("at_km"), F.round(G.lon(F.col("n.at")), 5).alias("lon"), F.round(G.lat(F.col("n.at")), 5).alias("lat"))


WALK = f"v0 AS (SELECT id, unnest(range(0, 6)) AS k, unnest(line)[1] AS x, unnest(line)[2] AS y FROM l), v1 AS (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY k) AS px, lag(y) OVER (PARTITION BY id ORDER BY k) AS py FROM v0), v AS (SELECT *, sum(CASE WHEN k = 0 THEN 0 ELSE {hav('px', 'py', 'x', 'y')} END) OVER (PARTITION BY id ORDER BY k) AS gone, {brg('px', 'py', 'x', 'y')} AS t FROM v1)"


def place_sql(name: str, metres: str) -> str:
    """A CTE (id, x, y) of the place at a distance along each line of WALK."""
    x, y = dest("x", "y", f"({metres} - gone)", "t")
    return f"""{name} AS (SELECT id, CASE WHEN k = 5 AND {metres} >= gone OR {metres} = gone THEN x ELSE {x} END AS x, CASE WHEN k = 5 AND {metres} >= gone OR {metres} = gone THEN y ELSE {y} END AS y
      FROM v WHERE gone >= {metres} OR k = 5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY k) = 1)"""


@query("locate_along", f"WITH l AS ({LINES_SQL}), {WALK}, {place_sql('p', 'CAST(id % 500 * 1000 AS DOUBLE)')} SELECT id, round(x, 5) AS lon, round(y, 5) AS lat FROM p")
def locate_along(spark, d):
    at = lines(spark, d).select("id", L.locate_along(F.col("line"), F.col("id") % 500 * 1000).alias("p"))
    return at.select("id", F.round(G.lon(F.col("p")), 5).alias("lon"), F.round(G.lat(F.col("p")), 5).alias("lat"))


CUT = "CAST(1000 AS DOUBLE)", "CAST(90000 AS DOUBLE)"


@query(
    "line_slice",
    f"""WITH l AS ({LINES_SQL}), {WALK}, {place_sql('a', CUT[0])}, {place_sql('b', CUT[1])},
    part AS (SELECT id, -1 AS k, x, y FROM a UNION ALL SELECT id, k, x, y FROM v WHERE gone > {CUT[0]} AND gone < {CUT[1]} AND k < 5 UNION ALL SELECT id, 6, x, y FROM b),
    hops AS (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY k) AS px, lag(y) OVER (PARTITION BY id ORDER BY k) AS py FROM part)
    SELECT id, count(*) AS positions, round(coalesce(sum({hav('px', 'py', 'x', 'y')}), 0) / 1000, 3) AS km FROM hops GROUP BY id""",
)
def line_slice(spark, d):
    made = lines(spark, d).select("id", L.slice_along(F.col("line"), 1000.0, 90000.0).alias("part"))
    return made.select("id", F.size("part").cast("long").alias("positions"), F.round(M.line_length(F.col("part")) / 1000, 3).alias("km"))


SHARP = "CAST(0.85 AS DOUBLE)"


def control_sql(c: str, axis: int) -> str:
    """A control at position k + 1 towards the centre before (into) or after it (out)."""
    near, far = ("k", "k + 1") if c == "into" else ("k + 1", "k + 2")
    own = f"(line[{near}][{axis}] + line[{far}][{axis}]) / 2"
    middle = f"((line[k][{axis}] + line[k + 1][{axis}]) / 2 + (line[k + 1][{axis}] + line[k + 2][{axis}]) / 2) / 2"
    return f"((1 - {SHARP}) * line[k + 1][{axis}] + {SHARP} * ({own} + line[k + 1][{axis}] - {middle}))"


def curve_sql(axis: int) -> str:
    p0, p3 = f"line[n + 1][{axis}]", f"line[n + 2][{axis}]"
    p1 = f"CASE WHEN n = 0 THEN {p0} ELSE list_extract(outs, n)[{axis}] END"
    p2 = f"CASE WHEN n = 4 THEN {p3} ELSE list_extract(ins, n + 1)[{axis}] END"
    return f"(pow(1 - t, 3) * {p0} + 3 * pow(1 - t, 2) * t * ({p1}) + 3 * (1 - t) * t * t * ({p2}) + pow(t, 3) * {p3})"


@query(
    "bezier_spline",
    f"""WITH l AS ({LINES_SQL}), c AS (SELECT id, line, list_transform(range(1, 5), lambda k: [{control_sql('into', 1)}, {control_sql('into', 2)}]) AS ins, list_transform(range(1, 5), lambda k: [{control_sql('out', 1)}, {control_sql('out', 2)}]) AS outs FROM l),
    s AS (SELECT id, line, ins, outs, r, CAST(floor(5 * r / CAST(10000 AS DOUBLE)) AS BIGINT) AS n, 5 * r / CAST(10000 AS DOUBLE) - floor(5 * r / CAST(10000 AS DOUBLE)) AS t FROM c, (SELECT unnest(range(0, 10000, 10)) AS r) WHERE (r // 100) % 2 = 0),
    p AS (SELECT id, r, {curve_sql(1)} AS x, {curve_sql(2)} AS y FROM s UNION ALL SELECT id, 10000, line[6][1], line[6][2] FROM l),
    h AS (SELECT *, lag(x) OVER (PARTITION BY id ORDER BY r) AS px, lag(y) OVER (PARTITION BY id ORDER BY r) AS py FROM p)
    SELECT id, count(*) AS positions, round(sum({hav('px', 'py', 'x', 'y')}) / 1000, 2) AS km FROM h GROUP BY id""",
)
def bezier_spline(spark, d):
    spread = lines(spark, d).repartition(spark.sparkContext.defaultParallelism)  # few bytes, but much to draw
    made = spread.select("id", X.bezier_spline(F.col("line")).alias("s"))
    return made.select("id", F.size("s").cast("long").alias("positions"), F.round(M.line_length(F.col("s")) / 1000, 2).alias("km"))


FAR_SQL = "(sx - x1 - {t} * (x2 - x1)) * (sx - x1 - {t} * (x2 - x1)) + (sy - y1 - {t} * (y2 - y1)) * (sy - y1 - {t} * (y2 - y1))"
SHARE_SQL = "CASE WHEN (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) = 0 THEN 0 ELSE greatest(0, least(1, ((sx - x1) * (x2 - x1) + (sy - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) END"


@query(
    "simplify_line",
    f"""WITH RECURSIVE l AS ({LINES_SQL}),
    thin(id, k, last, kept) AS (SELECT id, 1, 1, [1] FROM l UNION ALL
      SELECT t.id, t.k + 1, CASE WHEN far THEN t.k + 1 ELSE t.last END, CASE WHEN far THEN list_append(t.kept, t.k + 1) ELSE t.kept END
      FROM (SELECT thin.*, pow(line[thin.k + 1][1] - line[last][1], 2) + pow(line[thin.k + 1][2] - line[last][2], 2) > CAST(0.25 AS DOUBLE) AS far FROM thin JOIN l USING (id) WHERE k < 6) t),
    rest AS (SELECT id, line, CASE WHEN list_contains(kept, 6) THEN kept ELSE list_append(kept, 6) END AS kept FROM thin JOIN l USING (id) WHERE k = 6),
    split(id, a, b) AS (SELECT id, 1, len(kept) FROM rest UNION ALL
      SELECT s.id, CASE h WHEN 1 THEN s.a ELSE s.m END, CASE h WHEN 1 THEN s.m ELSE s.b END FROM (
        SELECT id, a, b, arg_max(m, (gap, -m)) AS m, max(gap) AS gap FROM (
          SELECT id, a, b, m, {FAR_SQL.format(t='t')} AS gap FROM (SELECT *, {SHARE_SQL} AS t FROM (
            SELECT id, a, b, m, line[kept[m]][1] AS sx, line[kept[m]][2] AS sy, line[kept[a]][1] AS x1, line[kept[a]][2] AS y1, line[kept[b]][1] AS x2, line[kept[b]][2] AS y2
            FROM split JOIN rest USING (id), LATERAL (SELECT unnest(range(a + 1, b)) AS m) WHERE b - a > 1))) GROUP BY id, a, b) s, (SELECT unnest([1, 2]) AS h) WHERE s.gap > CAST(0.25 AS DOUBLE))
    SELECT id, count(DISTINCT a) + 1 AS positions FROM split GROUP BY id""",
)
def simplify_line(spark, d):
    return lines(spark, d).select("id", F.size(X.simplify(F.col("line"), 0.5)).cast("long").alias("positions"))


@query("unit_sum", f"WITH p AS ({POINTS}) SELECT id % 10 AS k, round(sum({hav(*P4)}) / 1609.344, 1) AS miles FROM p GROUP BY 1")
def unit_sum(spark, d):
    made = points(spark, d).groupBy((F.col("id") % 10).alias("k")).agg(U.sum_of(M.distance(_a(), _b())).alias("m"))
    return made.select("k", F.round(U.from_base(F.col("m"), "miles"), 1).alias("miles"))


@query("track_length", f"WITH e AS (SELECT user_id, ts, event_id, {lon_of('event_id')} AS x, {lat_of('event_id')} AS y FROM events), g AS (SELECT user_id, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count(*) AS positions, round(coalesce(sum({hav('px', 'py', 'x', 'y')}), 0) / 1000, 1) AS km FROM g GROUP BY user_id")
def track_length(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", F.array(F.expr(lon_of("event_id")), F.expr(lat_of("event_id"))).alias("p"))
    track = e.groupBy("user_id").agg(G.make_line(F.struct("ts", "event_id"), F.col("p")).alias("g"))
    return track.select("user_id", F.size(G.coordinates(F.col("g"))).cast("long").alias("positions"), F.round(M.length(F.col("g")) / 1000, 1).alias("km"))


TZ, TX, TY = "(c_custkey % 13)", "((c_custkey * 7919) % (CAST(1 AS BIGINT) << CAST(c_custkey % 13 AS INTEGER)))", "((c_custkey * 104729) % (CAST(1 AS BIGINT) << CAST(c_custkey % 13 AS INTEGER)))"
HILBERT = """list_reduce(list_concat([{'x': x, 'y': y, 'd': CAST(0 AS BIGINT), 's': CAST(0 AS BIGINT)}], list_transform(range(0, z), lambda k: {'x': CAST(0 AS BIGINT), 'y': CAST(0 AS BIGINT), 'd': CAST(0 AS BIGINT), 's': CAST(1 AS BIGINT) << CAST(z - 1 - k AS INTEGER)})),
 lambda a, b: {'x': CASE WHEN a.y & b.s = 0 THEN CASE WHEN a.x & b.s <> 0 THEN b.s - 1 - a.y ELSE a.y END ELSE a.x END, 'y': CASE WHEN a.y & b.s = 0 THEN CASE WHEN a.x & b.s <> 0 THEN b.s - 1 - a.x ELSE a.x END ELSE a.y END,
 'd': a.d + b.s * b.s * CASE WHEN a.x & b.s <> 0 THEN CASE WHEN a.y & b.s <> 0 THEN CAST(2 AS BIGINT) ELSE CAST(3 AS BIGINT) END ELSE CASE WHEN a.y & b.s <> 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END END, 's': b.s}).d"""
TILES = f"SELECT c_custkey AS id, CAST({TZ} AS BIGINT) AS z, {TX} AS x, {TY} AS y FROM customer"


def tiles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    df = spark.read.parquet(f"{d}/customer.parquet")
    side = F.call_function("shiftleft", F.lit(1).cast("long"), (k % 13).cast("int"))
    return df.select(k.alias("id"), (k % 13).alias("z"), ((k * 7919) % side).alias("x"), ((k * 104729) % side).alias("y"))


@query("tile_id", f"WITH t AS ({TILES}) SELECT id, ((CAST(1 AS BIGINT) << CAST(2 * z AS INTEGER)) - 1) // 3 + {HILBERT} AS tile FROM t")
def tile_id(spark, d):
    return tiles(spark, d).select("id", T.tile_id(F.col("z"), F.col("x"), F.col("y")).alias("tile"))


UNROLL = """list_reduce(list_concat([{'x': CAST(0 AS BIGINT), 'y': CAST(0 AS BIGINT), 't': id - ((CAST(1 AS BIGINT) << CAST(2 * z AS INTEGER)) - 1) // 3, 's': CAST(0 AS BIGINT)}], list_transform(range(0, z), lambda k: {'x': CAST(0 AS BIGINT), 'y': CAST(0 AS BIGINT), 't': CAST(0 AS BIGINT), 's': CAST(1 AS BIGINT) << CAST(k AS INTEGER)})),
 lambda a, b: {'x': b.s * ((a.t >> 1) & 1) + CASE WHEN (a.t & 1) = ((a.t >> 1) & 1) THEN CASE WHEN (a.t >> 1) & 1 = 1 THEN b.s - 1 - a.y ELSE a.y END ELSE a.x END,
 'y': b.s * xor(a.t & 1, (a.t >> 1) & 1) + CASE WHEN (a.t & 1) = ((a.t >> 1) & 1) THEN CASE WHEN (a.t >> 1) & 1 = 1 THEN b.s - 1 - a.x ELSE a.x END ELSE a.y END, 't': a.t >> 2, 's': b.s})"""


@query("tile_zxy", f"WITH t AS (SELECT o_orderkey * 104729 AS id FROM orders), z AS (SELECT id, len(list_filter(range(0, 32), lambda k: ((CAST(1 AS HUGEINT) << CAST(2 * k AS INTEGER)) - 1) // 3 <= id)) - 1 AS z FROM t), u AS (SELECT id, z, {UNROLL} AS p FROM z) SELECT id, CAST(z AS BIGINT) AS z, p.x AS x, p.y AS y FROM u")
def tile_zxy(spark, d):
    """Any ids to their places."""
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") * 104729).alias("id"))
    return o.select("id", T.tile_zxy(F.col("id")).alias("t")).select("id", F.col("t.z").cast("long").alias("z"), "t.x", "t.y")


@query(
    "tile_lookup_asof",
    """WITH e AS (SELECT p_partkey * 10 AS tile_id, 1 + p_partkey % 9 AS run_length, p_partkey AS entry FROM part), k AS (SELECT c_custkey AS id, c_custkey * 7 AS tile FROM customer)
    SELECT id, tile, CASE WHEN tile < e.tile_id + e.run_length THEN entry END AS entry FROM k ASOF LEFT JOIN e ON k.tile >= e.tile_id""",
)
def tile_lookup_asof(spark, d):
    e = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") * 10).alias("tile_id"), (1 + F.col("p_partkey") % 9).alias("run_length"), F.col("p_partkey").alias("entry"))
    k = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7).alias("tile"))
    return J.interval_lookup(k, e, "tile", "tile_id", "run_length").select("id", "tile", "entry")


@query("tile_runs", "WITH o AS (SELECT o_orderkey AS t, o_orderstatus AS k FROM orders), g AS (SELECT t, k, t - row_number() OVER (PARTITION BY k ORDER BY t) AS island FROM o) SELECT min(t) AS tile_id, count(*) AS run_length, k AS key FROM g GROUP BY k, island")
def tile_runs(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("tile_id"), "o_orderstatus")
    return entry_runs(o, F.col("o_orderstatus"), 4096)


@query(
    "read_coalescing",
    """WITH r AS (SELECT o_custkey AS archive, o_orderkey * 10 AS o, 10 + o_orderkey % 300 AS n FROM orders), m AS (SELECT *, max(o + n) OVER (PARTITION BY archive ORDER BY o, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR o - reach > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY archive ORDER BY o, n ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT archive, min(o) AS "offset", max(o + n) - min(o) AS length, count(*) AS ranges FROM i GROUP BY archive, island""",
)
def read_coalescing(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("archive"), (F.col("o_orderkey") * 10).alias("offset"), (10 + F.col("o_orderkey") % 300).alias("length"))
    return C.coalesce_islands(o, "archive", gap=100)


TEXT = "round(floor(p[1] * 100000 + CAST(0.5 AS DOUBLE)) / 100000, 5) AS lon, round(floor(p[2] * 100000 + CAST(0.5 AS DOUBLE)) / 100000, 5) AS lat"


@query("polyline_decode", f"WITH l AS ({LINES_SQL}), e AS (SELECT id, unnest(line) AS p, unnest(range(0, 6)) AS place FROM l) SELECT id, place, {TEXT} FROM e")
def polyline_decode(spark, d):
    made = lines(spark, d).select("id", polyline.encode(F.col("line")).alias("text")).select("id", F.posexplode(polyline.decode(F.col("text"))).alias("place", "p"))
    return made.select("id", F.col("place").cast("long").alias("place"), F.round(G.lon(F.col("p")), 5).alias("lon"), F.round(G.lat(F.col("p")), 5).alias("lat"))


NUMBER_SQL = """list_aggregate(list_transform(range(0, 1 + len(list_filter(range(1, 13), lambda j: (z >> CAST(5 * j AS INTEGER)) > 0))),
  lambda j: chr(CAST(((z >> CAST(5 * j AS INTEGER)) & 31) + CASE WHEN (z >> CAST(5 * (j + 1) AS INTEGER)) > 0 THEN 32 ELSE 0 END + 63 AS INTEGER))), 'string_agg', '')"""


@query(
    "polyline_encode",
    f"""WITH l AS ({LINES_SQL}), p AS (SELECT id, unnest(range(0, 6)) AS k, unnest(line) AS p FROM l),
    w AS (SELECT id, 2 * k + a AS place, a, CAST(floor(p[2 - a] * 100000 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS v FROM p, (SELECT unnest([0, 1]) AS a)),
    e AS (SELECT id, place, v - coalesce(lag(v) OVER (PARTITION BY id, a ORDER BY place), 0) AS delta FROM w),
    z AS (SELECT id, place, CASE WHEN delta < 0 THEN -2 * delta - 1 ELSE 2 * delta END AS z FROM e)
    SELECT id, string_agg({NUMBER_SQL}, '' ORDER BY place) AS text FROM z GROUP BY id""",
)
def polyline_encode(spark, d):
    return lines(spark, d).select("id", polyline.encode(F.col("line")).alias("text"))


@query("geo_uri", f"WITH p AS ({POINTS}) SELECT id, round(x1, 3) AS lon, round(y1, 3) AS lat FROM p")
def geo_uri(spark, d):
    x, y = F.round("x1", 3), F.round("y1", 3)
    text = F.concat(F.lit("geo:"), F.format_string("%.3f", y), F.lit(","), F.format_string("%.3f", x), F.lit(";crs=wgs84"))
    made = points(spark, d).select("id", geouri.parse(text).alias("g"))
    return made.select("id", F.round(G.lon(G.only_position(F.col("g"))), 3).alias("lon"), F.round(G.lat(G.only_position(F.col("g"))), 3).alias("lat"))


@query("geojson_roundtrip", f"WITH b AS ({BOXES}) SELECT bid, 'Polygon' AS type, round(cx - w, 6) AS west, round(cy + w, 6) AS north, CAST(bid AS VARCHAR) AS id, bid % 5 AS k FROM b")
def geojson_roundtrip(spark, d):
    text = geojson.encode_feature(F.col("polygon"), F.to_json(F.struct((F.col("bid") % 5).alias("k"))), F.col("bid").cast("string"))
    f = boxes(spark, d).select("bid", text.alias("j")).select("bid", geojson.feature(F.col("j")).alias("f"))
    b = M.compute_bbox(F.col("f.geometry"))
    return f.select("bid", F.col("f.geometry.type").alias("type"), F.round(M.west(b), 6).alias("west"), F.round(M.north(b), 6).alias("north"), "f.id", G.property_as(F.col("f.properties"), "k", "bigint").alias("k"))


@query("property_access", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.k') IS NOT NULL AS has_k, json_extract(props, '$.zz') IS NOT NULL AS has_zz FROM events")
def property_access(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", G.property_as(F.col("props"), "k", "bigint").alias("k"), G.contains_property(F.col("props"), "k").alias("has_k"), G.contains_property(F.col("props"), "zz").alias("has_zz"))


from . import families  # noqa: E402, F401 - adds its queries
