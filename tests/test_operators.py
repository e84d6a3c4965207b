"""Joins, the index and collections against plain loops."""

import random

from pyspark.sql import functions as F

from geoframe.functions import geometry as G
from geoframe.functions import measure as M
from geoframe.operators import collections as C
from geoframe.operators import join as J
from geoframe.operators.index import SpatialIndex


def test_boxes_of_all_sizes(spark):
    random.seed(3)
    rows = [(k, x := random.uniform(-170, 170), y := random.uniform(-80, 80), x + random.choice([0.0, 0.01, 1, 30, 200]), y + random.choice([0.0, 0.01, 1, 30])) for k in range(120)]
    df = spark.createDataFrame(rows, "k int, w double, s double, e double, n double").select("k", F.array("w", "s", "e", "n").alias("bbox"))
    got = [(r.a, r.b) for r in J.boxes_intersect(df, df).select(F.col("left.k").alias("a"), F.col("right.k").alias("b")).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2]}
    assert len(got) == len(set(got)) and set(got) == want


def test_filter_inside(spark):
    square = G.polygon_of([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)])
    big = G.polygon_of([(-100, -60), (100, -60), (100, 60), (-100, 60), (-100, -60)])
    polygons = spark.range(1).select(square.alias("geometry")).unionByName(spark.range(1).select(big.alias("geometry")))
    points = spark.range(1).select(F.lit(1).alias("k"), G.point_of(5, 5).alias("geometry")).unionByName(spark.range(1).select(F.lit(2).alias("k"), G.multi_point_of((5, 5), (150, 5), (99, 5)).alias("geometry"))).unionByName(spark.range(1).select(F.lit(3).alias("k"), G.multi_point_of((150, 5)).alias("geometry")))
    got = {r.k: r.geometry.parts[0][0] for r in J.filter_inside(points, polygons, "k").collect()}
    assert got == {1: [[5, 5]], 2: [[5, 5], [99, 5]]}


def test_interval_lookup(spark):
    random.seed(4)
    ranges, at = [], 0
    for k in range(200):
        at += random.choice([0, 1, 5])
        n = random.choice([1, 2, 3, 100, 5000])
        ranges.append((at, n, k))
        at += n
    keys = [(k,) for k in range(0, at + 50, 3)] + [(None,)]
    got = J.interval_lookup(spark.createDataFrame(keys, "t long"), spark.createDataFrame(ranges, "a long, n long, k long"), "t", "a", "n").collect()
    want = {t: next((k for a, n, k in ranges if a <= t < a + n), None) for (t,) in keys if t is not None}
    assert len(got) == len(keys) and all(r.k == want.get(r.t) for r in got)


def test_index(spark):
    rows = spark.createDataFrame([(k, float(k), float(k)) for k in range(20)], "k long, x double, y double").select("k", G.point_lonlat(F.col("x"), F.col("y")).alias("geometry"))
    index = SpatialIndex(rows)
    assert index.search(M.box(3, 3, 5, 5)).count() == 3 and index.collides(M.box(3, 3, 5, 5)) and not index.collides(M.box(50, 50, 60, 60))
    assert index.size() == 20 and index.remove(rows.filter("k < 5")).size() == 15 and index.insert(rows).remove(rows).size() == 20 and index.clear().is_empty()
    assert index.contains_all(rows.filter("k = 3")) and index.clustered(2).count() == 20


def test_collections(spark):
    df = spark.range(1).select(G.point_of(1, 2).alias("geometry"), F.array(*map(F.lit, [0.0, 0.0, 0.0, 0.0])).alias("bbox"))
    moved = C.map_geometry(df, lambda g: G.point(M.destination(G.only_position(g), 0.0, 0.0))).first()
    assert [round(v, 6) for v in moved.bbox] == [1, 2, 1, 2]
    c = C.combine(df).first()
    assert c.points.type == "MultiPoint" and c.lines.parts == [[]] and c.polygons.parts == []


def test_points_on_level_edges(spark):
    """The cross products of a level edge at 0.7 add up to 4e-17 or -6e-17 instead of zero."""
    box = M.bbox_polygon(M.box(0.1, 0.2, 0.8, 0.7))
    tent = G.polygon_of([(0.1, 0.7), (0.4, 0.2), (0.8, 0.7), (0.1, 0.7)])
    hole = G.polygon_of([(-5, -5), (5, -5), (5, 5), (-5, 5), (-5, -5)], [(0.1, 0.2), (0.8, 0.2), (0.8, 0.7), (0.1, 0.7), (0.1, 0.2)])
    shapes = [("box", box), ("tent", tent), ("hole", hole)]
    polygons = spark.range(3).select(F.element_at(F.array(*[F.struct(F.lit(name).alias("name"), shape.alias("geometry")) for name, shape in shapes]), (F.col("id") + 1).cast("int")).alias("s")).select("s.*")
    at = [(1, 0.2, 0.7), (2, 0.8, 0.7), (3, 0.4, 0.5), (4, 0.9, 0.7), (5, 0.2, 0.2)]
    points = spark.createDataFrame(at, "k int, x double, y double").select("k", G.point_lonlat(F.col("x"), F.col("y")).alias("geometry"))
    pairs = lambda strict: {(r.k, r.name) for r in J.points_in_polygons(points, polygons, ignore_boundary=strict).select("point.k", "polygon.name").collect()}
    assert pairs(False) == {(1, "box"), (2, "box"), (3, "box"), (5, "box"), (1, "tent"), (2, "tent"), (3, "tent"), (1, "hole"), (2, "hole"), (4, "hole"), (5, "hole")}
    assert pairs(True) == {(3, "box"), (3, "tent"), (4, "hole")}
    assert {r.k for r in J.filter_inside(points, polygons.filter("name = 'box'"), "k").collect()} == {1, 2, 3, 5}


def test_boxes_are_dealt_by_how_they_begin(spark, tmp_path):
    """Boxes on cell edges and copies meet once a pair, and neither side is broadcast, as files don't tell how many cells there are."""
    rows = [(k, x / 8, y / 8, x / 8 + w, y / 8 + h) for k, (x, y, w, h) in enumerate((x, y, w, h) for x in (-1, 0, 1, 2) for y in (-2, 0, 1) for w, h in ((0.0, 0.0), (0.125, 0.25), (0.25, 0.0625), (1.0, 3.0)))]
    rows += [(len(rows) + k, *r[1:]) for k, r in enumerate(rows[:5])] + [(999, None, None, None, None)]
    df = spark.createDataFrame(rows, "k int, w double, s double, e double, n double").select("k", F.when(F.col("w").isNotNull(), F.array("w", "s", "e", "n")).alias("bbox"))
    df.write.parquet(str(tmp_path / "boxes"))
    df = spark.read.parquet(str(tmp_path / "boxes"))
    few = df.filter("k % 3 = 0")
    made = J.boxes_intersect(df, few).select(F.col("left.k").alias("a"), F.col("right.k").alias("b"))
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()
    got = [(r.a, r.b) for r in made.collect()]
    want = {(a[0], b[0]) for a in rows[:-1] for b in rows[:-1] if b[0] % 3 == 0 and a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2]}
    assert len(got) == len(set(got)) and set(got) == want
