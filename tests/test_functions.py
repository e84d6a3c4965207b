"""Golden values of the functions."""

import math

import pytest
from pyspark.sql import functions as F

from geoframe import schema as S
from geoframe import sql
from geoframe.functions import geometry as G
from geoframe.functions import lines as L
from geoframe.functions import measure as M
from geoframe.functions import predicates as P
from geoframe.functions import tiles as T
from geoframe.functions import transform as X
from geoframe.functions import units as U
from geoframe.sources import geouri, polyline


def p(*axes):
    return F.array(*[F.lit(float(x)) for x in axes])


def line(*ps):
    return F.array(*[p(*x) for x in ps])


@pytest.fixture(scope="module")
def values(spark):
    def run(**columns):
        return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()

    return run


def test_measures(values):
    got = values(
        distance=M.distance(p(-73.67, 45.48), p(-79.48, 43.68)) / 1000,
        rhumb=M.rhumb_distance(p(-75.343, 39.984), p(-75.534, 39.123)) / 1000,
        initial=M.bearing(p(-75, 45), p(20, 60)),
        final=M.bearing(p(-75, 45), p(20, 60), True),
        rhumb_bearing=M.rhumb_bearing(p(-75, 45), p(20, 60)),
        to_line=M.line_distance(p(-0.54931640625, 0.7470491450051796), line((1, 3), (2, 2), (2, 0), (-1.5, -1.5))) / 1000,
        lat=G.lat(M.destination(p(-75, 38.10096062273525), 100000.0, 0.0)),
        mid=G.lon(M.midpoint(p(-79.3801, 43.6463), p(-74.0071, 40.7113))),
    )
    want = {"distance": 501.64563403765925, "rhumb": 97.12923942772163, "initial": 37.75495, "final": 120.01405, "rhumb_bearing": 75.28061364784332, "to_line": 188.01568693725255, "lat": 39.000281, "mid": -76.6311}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-4), k


def test_boxes(values):
    got = values(a=M.bbox_square(p(0, 0, 5, 10)), b=M.bbox_square(p(0, 0, 10, 5)), c=M.positions_bbox(line((1, 5), (-2, 3))), d=M.east(p(1, 2, 3, 4, 5, 6)), none=M.positions_bbox(F.array().cast("array<array<double>>")))
    assert got == {"a": [-2.5, 0, 7.5, 10], "b": [0, -2.5, 10, 7.5], "c": [-2, 3, 1, 5], "d": 4.0, "none": None}


def test_areas_and_lengths(values):
    square = G.polygon_of([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])
    hole = G.polygon_of([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], [(0.2, 0.2), (0.4, 0.2), (0.4, 0.4), (0.2, 0.2)])
    got = values(a=M.area(square), h=M.area(hole), l=M.length(square), z=M.area(G.point_of(1, 2)), zl=M.length(G.point_of(1, 2)))
    assert got["h"] < got["a"] and got["a"] == pytest.approx(1.2391e10, rel=1e-3)
    assert got["l"] == pytest.approx(444763, rel=1e-3) and got["z"] == got["zl"] == 0


def test_point_in_polygon(values):
    triangle = G.polygon(F.array(line((0, 0), (0, 100), (100, 0), (0, 0))))
    boxed = G.polygon(F.array(line((0, 0), (0, 100), (100, 0), (0, 0))), p(0, 0, 10, 10))
    donut = G.polygon_of([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)])
    got = values(a=P.contains(triangle, p(50, 50)), b=P.contains(boxed, p(50, 50)), edge=P.contains(donut, p(0, 5)), off=P.contains(donut, p(0, 5), True), hole=P.contains(donut, p(3, 3)), rim=P.contains(donut, p(2, 3)), rim_off=P.contains(donut, p(2, 3), True), null=P.contains(donut, F.lit(None).cast("array<double>")))
    assert got == {"a": True, "b": False, "edge": True, "off": False, "hole": False, "rim": True, "rim_off": False, "null": None}


def test_lines(values):
    way = line((0, 0), (1, 0), (2, 0))
    got = values(
        cross=L.intersect(line((-1, 0), (1, 0)), line((0, -1), (0, 1))), parallel=L.intersect(line((0, 0), (1, 0)), line((0, 1), (1, 1))), end=L.locate_along(way, 1e9), start=L.locate_along(way, 0.0),
        near=L.nearest_on_lines(F.array(way), p(1.5, 0.1)), part=L.slice_along(way, 50000.0, 150000.0), between=L.slice_between(way, p(1.5, 0.1), p(0.5, 0.1)),
    )
    assert got["cross"] == [0, 0] and got["parallel"] is None and got["end"] == [2, 0] and got["start"] == [0, 0]
    assert got["near"]["index"] == 1 and got["near"]["at"][0] == pytest.approx(1.5) and got["near"]["location"] == pytest.approx(166792.6, abs=1)
    assert [len(got["part"]), len(got["between"])] == [3, 3] and got["between"][0][0] == pytest.approx(0.5)


@pytest.mark.parametrize("bad", range(6))
def test_errors(spark, bad):
    cases = [
        lambda: L.slice_along(line((0, 0), (1, 0)), 1e9, 2e9), lambda: L.locate_along(line((0, 0), (1, 0)), -1.0), lambda: L.intersect(line((0, 0), (1, 0), (2, 0)), line((0, 0), (1, 1))),
        lambda: polyline.decode(F.lit("_p~iF~ps|")), lambda: geouri.parse(F.lit("geo:1")), lambda: T.tile_id(F.lit(1), F.lit(2), F.lit(0)),
    ]
    with pytest.raises(Exception):
        spark.range(1).select(cases[bad]()).collect()


def test_transformations(values):
    got = values(
        circle=F.size(G.coordinates(X.circle(p(-75.343, 39.984), 5000.0))), arc=X.great_circle(p(-122, 48), p(28.125, 43.32517767999296), 99), split=X.great_circle(p(-122.349358, 47.620422), p(77.036560, 38.897957), 100)["type"],
        level=X.great_circle(p(0, 10), p(20, 10), 5)["type"], spline=F.size(X.bezier_spline(line((0, 0), (1, 2), (3, 1)))),
    )
    assert got["circle"] == 66 and got["arc"]["type"] == "LineString" and len(got["arc"]["parts"][0][0]) == 99 and got["split"] == "MultiLineString" and got["level"] == "LineString" and got["spline"] == 501


def test_simplify_keeps_ends():
    import numpy as np

    rows = np.array([[k / 10, math.sin(k)] for k in range(50)])
    kept = X.simplify_positions(rows, 0.2, True)
    assert kept[0] == 0 and kept[-1] == 49 and 2 < len(kept) <= 50
    assert list(X.simplify_positions(np.array([[0, 0], [1, 0.001], [2, 0]]), 0.1)) == [0, 2]


def test_grid(spark):
    b = spark.range(1).select(p(0, 0, 1, 1).alias("b"))
    assert X.square_grid(b, F.col("b"), X.DEGREE / 4).count() == 16 and X.square_grid(b, F.col("b"), X.DEGREE * 2).count() == 0


def test_tiles(values, spark):
    cases = [((0, 0, 0), 0), ((1, 0, 1), 2), ((1, 1, 1), 3), ((2, 0, 0), 5), ((12, 3423, 1763), 19078479)]
    got = values(ids=F.array(*[T.tile_id(*map(F.lit, c)) for c, _ in cases]), a=T.zoom_start(F.lit(3)), b=T.zoom_start(F.lit(31)))
    assert got["ids"] == [i for _, i in cases] and got["a"] == 21 and got["b"] == 1537228672809129301
    back = spark.range(0, 6000).select("id", T.tile_zxy(F.col("id")).alias("t")).select("id", T.tile_id(F.col("t.z"), F.col("t.x"), F.col("t.y")).alias("again"))
    assert back.filter("id <> again").count() == 0


def test_text(values):
    got = values(
        p5=polyline.encode(line((-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252))), p6=polyline.encode(line((0, 0), (2.3456789, 1.2345678), (-3.3, -3.3), (0, 0)), 6), back=polyline.decode(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@")), bad=polyline.decode_or_null(F.lit("_")), none=polyline.encode(F.array().cast("array<array<double>>")),
        uri=geouri.format_uri(geouri.parse(F.lit("geo:48.2,16.3,183;crs=WGS84;u=0"))), crs=geouri.parse_or_null(F.lit("geo:1,2;crs=other")), u=geouri.parse_or_null(F.lit("geo:1,2;u=5")), e=geouri.parse_or_null(F.lit("geo:1e3,2")),
    )
    assert got["p5"] == "_p~iF~ps|U_ulLnnqC_mqNvxq`@" and got["p6"] == "??ogjjA}kdnCnqwsG|uqwI_ilhE_ilhE" and got["none"] == ""
    assert got["back"] == [[-120.2, 38.5], [-120.95, 40.7], [-126.453, 43.252]] and got["bad"] is None
    assert got["uri"] == "geo:48.2,16.3,183.0" and got["crs"] is got["u"] is got["e"] is None


def test_units(values):
    got = values(
        a=U.format_bearing(F.lit(0.0)), b=U.format_bearing(F.lit(90.0)), c=U.format_bearing_dms(F.lit(189.0)), d=U.format_bearing(F.lit(350.0)), turn=U.smallest_rotation(F.lit(350.0), F.lit(10.0)), minus=U.bearing_minus(F.lit(90.0), F.lit(180.0)),
        big=U.format_unit(F.lit(12_300_000.0), "meters"), deg=U.format_unit(F.lit(5.0), "degrees"), miles=U.convert(F.lit(1.0), "miles", "meters"), up=U.round_to_long(F.lit(2.5), "meters"), even=G.round_even(F.lit(2.5)), r=G.round_even(F.lit(0.000051), 4), inf=U.is_infinite(F.lit(float("-inf"))),
    )
    assert [got[k] for k in "abcd"] == ["N 0.00° E", "S 90.00° E", "S 9° 0′ 0.00″ W", "N 10.00° W"]
    assert got["turn"] == 20 and got["minus"] == 270 and got["big"] == "12300000.00 m" and got["deg"] == "5.00°" and got["miles"] == 1609.344 and got["up"] == 3 and got["even"] == 2 and got["r"] == 0.0001 and got["inf"]
    assert (U.LENGTHS["feet"] * U.LENGTHS["yards"]).factor == pytest.approx(0.3048 * 0.9144)
    with pytest.raises(ValueError):
        U.convert(F.lit(1.0), "miles", "acres")


def test_validity_and_builders(values):
    open_ = F.array(line((0, 0), (1, 0), (1, 1)))
    got = values(
        closed=S.is_valid(G.build_polygon(open_)), open=S.is_valid(G.polygon(open_)), short=S.is_valid(G.line_string(line((0, 0)))), ok=S.is_valid(G.line_string(line((0, 0), (1, 1)))), empty=S.is_valid(G.multi_point(F.array().cast("array<array<double>>"))), axes=G.has_altitude(p(1, 2, 3)),
        first=F.get(G.lines_of(G.line_to_polygon(G.multi_line_string_of([(0, 0), (1, 0), (1, 1), (0, 0)], [(-5, -5), (5, -5), (5, 5), (-5, -5)]))), 0), kids=G.count_children(G.multi_point_of((1, 2), (3, 4))), has=G.contains_child(G.multi_point_of((1, 2), (3, 4)), G.point_of(3, 4)),
    )
    assert got["closed"] and not got["open"] and not got["short"] and got["ok"] and got["empty"] and got["axes"] and got["kids"] == 2 and got["has"] and got["first"][0] == [-5, -5]


def test_sql_names(spark):
    sql.register(spark)
    r = spark.sql("SELECT st_distance_lonlat(-73.67D, 45.48D, -79.48D, 43.68D) / 1000 AS km, st_x(st_point(3D, 4D)) AS x, st_zoom_start(3) AS z").first()
    assert r.km == pytest.approx(501.64563403765925) and r.x == 3 and r.z == 21
