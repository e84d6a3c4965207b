"""Readers and writers: GeoJSON, GPX, tile archives."""

import json
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoframe.functions import geometry as G
from geoframe.functions import measure as M
from geoframe.sources import geojson, gpx, pmtiles, polyline
from geoframe.sources.pmtiles import format as A
from geoframe.sources.pmtiles.source import coalesce_ranges
from geoframe.streaming.features import geofence, read_stream

FEATURES = [
    {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2.5, 3.5]}, "properties": {"k": 1}, "id": "1", "extra": 0},
    {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]], "bbox": [0, 0, 1, 1]}, "properties": None, "id": 1},
    {"type": "Feature", "geometry": None, "properties": {"a": [1, 2]}},
]


def test_collection_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": FEATURES}, indent=1))
    df = geojson.read_documents(spark, str(tmp_path / "a.json"))
    rows = df.collect()
    assert [r.id for r in rows] == ['"1"', "1", None] and rows[0].geometry.parts == [[[[1.5, 2.5, 3.5]]]] and rows[1].geometry.bbox == [0, 0, 1, 1] and rows[2].geometry is None
    geojson.write_lines(df, str(tmp_path / "out"))
    again = geojson.read_lines(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    text = df.select(geojson.encode_collection(geojson.encode_feature(F.col("geometry"), F.col("properties"), F.col("id"))).alias("t")).first().t
    assert len(json.loads(text)["features"]) == 3


@pytest.mark.parametrize("text", ['{"type":"LineString","coordinates":[[0,0]]}', '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}', '{"type":"Point","coordinates":[1]}', "{", '{"type":"Cube","coordinates":[1,2]}', '{"type":"Point"}'])
def test_malformed_geometry_is_null_or_error(spark, text):
    df = spark.createDataFrame([(text,)], "j string")
    assert df.select(geojson.geometry_or_null(F.col("j")).alias("g")).first().g is None
    with pytest.raises(Exception):
        df.select(geojson.geometry(F.col("j"))).collect()


def test_feature_rules(spark):
    texts = ['{"type":"Feature","properties":{}}', '{"type":"Feature","geometry":null,"id":true}', '{"type":"Feature","geometry":null,"properties":[1]}', '{"type":"Feature","geometry":null}']
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    assert [r.f is not None for r in df.select(geojson.feature_or_null(F.col("j")).alias("f")).collect()] == [False, False, False, True]


def test_geometry_text_and_collections(spark):
    df = spark.range(1).select(G.multi_polygon_of([[(0, 0), (1, 0), (1, 1), (0, 0)]]).alias("g"))
    assert df.select(geojson.encode_geometry(F.col("g")).alias("t")).first().t == '{"type":"MultiPolygon","coordinates":[[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]]]}'
    nested = '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[3,4]}]}]}'
    got = spark.createDataFrame([(nested,)], "j string").select(geojson.geometries(F.col("j")).alias("g")).first().g
    assert [g.parts[0][0][0] for g in got] == [[1, 2], [3, 4]]


GPX = """<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1" version="1.1"><wpt lat="1.5" lon="2.5"><ele>10</ele><time>2020-01-02T03:04:05</time><name>a &amp; b</name><foobar>1</foobar></wpt><wpt lat="3" lon="4"/>
<trk><name>t</name><trkseg><trkpt lat="1" lon="2"/><trkpt lat="3" lon="4"><ele>5</ele></trkpt></trkseg><trkseg><trkpt lat="5" lon="6"/></trkseg></trk><rte><name>r</name><rtept lat="7" lon="8"/></rte></gpx>"""


def test_gpx(spark, tmp_path):
    path = str(tmp_path / "a.gpx")
    (tmp_path / "a.gpx").write_text(GPX)
    points = gpx.read(spark, path, "wpt")
    got = gpx.waypoint_features(points).orderBy("properties").collect()
    assert sorted(g.geometry.parts[0][0][0] for g in got) == [[2.5, 1.5, 10.0], [4.0, 3.0]]
    track = gpx.track_features(gpx.read(spark, path, "trk")).first()
    assert [g.parts[0][0][0] for g in track.geometries] == [[2, 1], [4, 3, 5], [6, 5]]
    assert len(gpx.route_features(gpx.read(spark, path, "rte")).first().geometries) == 1
    text = points.select(gpx.document(F.listagg(gpx.encode_point(F.struct("*")), F.lit(""))).alias("t")).first().t
    (tmp_path / "b.gpx").write_text(text)
    again = gpx.read(spark, str(tmp_path / "b.gpx"), "wpt")
    assert sorted(map(str, again.collect())) == sorted(map(str, points.collect())) and "a &amp; b" in text
    assert points.select(gpx.time_of(F.col("time")).cast("string").alias("t")).filter("t IS NOT NULL").first().t == "2020-01-02 03:04:05"


def test_archive_round_trip(spark, tmp_path):
    pmtiles.register(spark)
    rows = [(z, x, y, f"tile {z}" if z < 3 else f"tile {z}/{x}/{y}") for z in range(5) for x in range(1 << z) for y in range(1 << z)]
    tiles = spark.createDataFrame(rows, "z int, x long, y long, t string").select("z", "x", "y", F.col("t").cast("binary").alias("payload"))
    path = str(tmp_path / "a.pmtiles")
    header = pmtiles.write(tiles, path, json.dumps({"name": "n", "vector_layers": []}))
    read = lambda view, **o: spark.read.format("pmtiles").option("path", path).option("view", view).options(**o).load()
    assert read("header").first().addressed_tiles == len(rows) == header["addressed_tiles"] and header["tile_entries"] < len(rows)
    assert sorted((r.z, r.x, r.y, bytes(r.payload).decode()) for r in read("tiles").collect()) == sorted(rows)
    one = read("tiles").filter("tile_id = 7").collect()
    assert len(one) == 1 and bytes(one[0].payload) == b"tile 2" and read("metadata").first().name == "n" and read("warnings").count() == 0
    assert read("directory").agg(F.sum("run_length")).first()[0] == len(rows)


def test_archive_errors(spark, tmp_path):
    (tmp_path / "bad").write_text("text")
    pmtiles.register(spark)
    with pytest.raises(Exception, match="InvalidMagic"):
        spark.read.format("pmtiles").option("path", str(tmp_path / "bad")).option("view", "header").load().collect()
    twice = spark.createDataFrame([(0, 0, 0, b"a"), (0, 0, 0, b"b")], "z int, x long, y long, payload binary")
    with pytest.raises(Exception, match="twice"):
        pmtiles.write(twice, str(tmp_path / "x"), tile_type=2)
    with pytest.raises(A.ArchiveError):
        pmtiles.write(twice.limit(1), str(tmp_path / "x"))


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """An archive whose directory needs leaves, the path and its tiles: (z, x, y, payload)."""
    path = str(tmp_path_factory.mktemp("archive") / "wide.pmtiles")
    rows = [(13, (k * 7919) % 8192, k % 8192, f"{k % 977}" * (1 + k % 3)) for k in range(20_000)]
    rows = list({r[:3]: r for r in rows}.values())
    tiles = spark.createDataFrame(rows, "z int, x long, y long, t string").select("z", "x", "y", F.col("t").cast("binary").alias("payload"))
    pmtiles.write(tiles, path, tile_type=2, tile_compression=A.GZIP, codecs=None)
    return path, rows


def test_archive_with_leaves(spark, wide):
    path, rows = wide
    pmtiles.register(spark)
    read = lambda view, **o: spark.read.format("pmtiles").options(path=path, view=view, **o).load()
    h = read("header").first()
    assert h.leaf_length > 0 and h.addressed_tiles == len(rows) and h.tile_contents == len({r[3] for r in rows}) and h.root_offset + h.root_length <= A.FIRST_READ
    assert h.tile_length == sum(map(len, {r[3] for r in rows}))
    got = read("tiles").select("z", "x", "y", F.col("payload").cast("string").alias("t"))
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    one = rows[777]
    assert [tuple(r) for r in got.filter((F.col("z") == one[0]) & (F.col("x") == one[1]) & (F.col("y") == one[2])).collect()] == [one]
    assert got.filter("z = 5").count() == 0 and got.filter("z = 13 AND x = 99999 AND y = 0").count() == 0


def test_places_are_pushed():
    from pyspark.sql.datasource import EqualTo

    from geoframe.sources.pmtiles.source import ArchiveReader

    r = ArchiveReader({"path": "x"})
    list(r.pushFilters([EqualTo(("z",), 3), EqualTo(("x",), 1), EqualTo(("y",), 2)]))
    assert r.low == r.high == A.zxy_to_id(3, 1, 2)
    r = ArchiveReader({"path": "x"})
    list(r.pushFilters([EqualTo(("z",), 2)]))
    assert (r.low, r.high) == (5, 20)


def test_batch_of_tiles(spark, wide):
    path, rows = wide
    pmtiles.register(spark)
    held = {r[:3]: r[3] for r in rows}
    asked = [(k, *rows[k * 37 % len(rows)][:3]) for k in range(200)] + [(200 + k, 13, 8000, k) for k in range(50)] + [(900, 99, 0, 0), (901, 2, 7, 0), (902, None, 0, 0), (903, *rows[0][:3]), (904, *rows[0][:3])]
    got = pmtiles.read_batch(spark, path, spark.createDataFrame(asked, "place long, z int, x long, y long")).collect()
    assert sorted((r.place, r.z, r.x, r.y, None if r.payload is None else bytes(r.payload).decode()) for r in got) == sorted((*a, held.get(a[1:])) for a in asked)
    assert pmtiles.read_batch(spark, path, spark.createDataFrame([], "place long, z int, x long, y long")).count() == 0


@pytest.mark.parametrize("option, code", [("maxEntries", "LimitExceeded"), ("maxDirectoryBytes", "LimitExceeded"), ("maxDepth", "LimitExceeded")])
def test_limits(spark, wide, option, code):
    pmtiles.register(spark)
    with pytest.raises(Exception, match=code):
        spark.read.format("pmtiles").options(path=wide[0], view="tiles", **{option: "0" if option == "maxDepth" else "1"}).load().count()


@pytest.mark.parametrize("field, value, code", [("root_length", 0, "EmptyRoot"), ("root_offset", 16_380, "InvalidRootLocation"), ("tile_offset", 10, "InvalidSection"), ("leaf_offset", 130, "OverlappingSections"), ("clustered", 7, "InvalidHeader"), ("max_zoom", 40, "InvalidHeader")])
def test_header_rules(field, value, code):
    good = dict.fromkeys(A.FIELDS, 0) | {"root_offset": 127, "root_length": 50, "leaf_offset": 200, "leaf_length": 10, "tile_offset": 300, "tile_length": 20, "internal_compression": 2, "tile_compression": 2, "tile_type": 1, "addressed_tiles": 1, "tile_entries": 1, "tile_contents": 1}
    h, warnings = A.parse_header(A.encode_header(good), 1 << 20)
    assert h["root_length"] == 50 and not warnings
    with pytest.raises(A.ArchiveError) as e:
        A.parse_header(A.encode_header(good | {field: value}), 1 << 20)
    assert e.value.code == code


def test_lenient_header():
    odd = dict.fromkeys(A.FIELDS, 0) | {"root_offset": 127, "root_length": 50, "leaf_offset": 400, "leaf_length": 10, "tile_offset": 300, "tile_length": 20, "internal_compression": 9, "tile_type": 77}
    _, warnings = A.parse_header(A.encode_header(odd), 1 << 20, strict=False)
    assert [c for c, _ in warnings] == ["SectionOrder", "UnknownCounts", "UnknownTileType", "UnknownCompression", "UnstatedCompression"]
    with pytest.raises(A.ArchiveError, match="UnknownCompression"):
        A.parse_header(A.encode_header(odd), 1 << 20)


def test_failed_write_leaves_nothing(spark, tmp_path):
    def broken(path):
        raise OSError("full")

    tiles = spark.createDataFrame([(0, 0, 0, b"a")], "z int, x long, y long, payload binary")
    with pytest.raises(OSError):
        pmtiles.write(tiles, str(tmp_path / "x"), tile_type=2, sink=broken)
    assert not list(tmp_path.iterdir())


def test_nested_collections(spark):
    point = lambda k: f'{{"type":"Point","coordinates":[{k},0]}}'
    deep = point(0)
    for k in range(1, 7):
        deep = f'{{"type":"GeometryCollection","geometries":[{deep},{point(k)}]}}'
    texts = [deep, f'{{"type":"GeometryCollection","geometries":[{point(1)},{{"type":"GeometryCollection","geometries":[{{"type":"Point"}}]}}]}}', '{"type":"GeometryCollection","geometries":[]}', point(1)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, j string").select("k", geojson.geometries(F.col("j")).alias("g"))
    got = {r.k: None if r.g is None else [x.parts[0][0][0][0] for x in r.g] for r in df.collect()}
    assert got == {0: [0, 1, 2, 3, 4, 5, 6], 1: None, 2: [], 3: None}


def test_directories():
    entries = [A.Entry(k * 3 + k % 2, (k * 7919) % 100003 * 10, 1 + k % 9, 1) for k in range(30000)]
    assert A.decode_directory(A.encode_directory(entries)) == entries
    for bad in (b"", b"\x01\x00", A.encode_directory(entries[:2]) + b"\x00"):
        with pytest.raises(A.ArchiveError):
            A.decode_directory(bad)
    with pytest.raises(A.ArchiveError):
        A.gunzip(A.COMPRESS[A.GZIP](b"a" * 1000), 10)
    assert all(A.zxy_to_id(*A.id_to_zxy(k)) == k for k in range(5000))


def test_coalesced_ranges():
    assert coalesce_ranges([(0, 10), (10, 5), (20, 5)]) == [(0, 15), (20, 5)] and coalesce_ranges([(0, 10), (12, 5)], gap=2) == [(0, 17)]
    assert coalesce_ranges([(0, 10), (10, 10)], most=15) == [(0, 10), (10, 10)] and coalesce_ranges([(0, 1), (1, 1)], most=0) == [(0, 1), (1, 1)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, FEATURES)))
    q = geofence(read_stream(spark, str(tmp_path / "in")), M.box(1, 2, 3, 4)).writeStream.format("memory").queryName("fenced").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("fenced").count() == 1


def polyline_by_loop(line):
    text, before = "", (0, 0)
    for p in line:
        now = tuple(math.floor(v * 1e5 + 0.5) for v in (p[1], p[0]))
        for d in (now[0] - before[0], now[1] - before[1]):
            z = -2 * d - 1 if d < 0 else 2 * d
            while z >= 32:
                text, z = text + chr((z & 31) + 95), z >> 5
            text += chr(z + 63)
        before = now
    return text


def test_polylines_of_a_batch():
    rnd = random.Random(1)
    lines = [[[rnd.uniform(-180, 180), rnd.uniform(-90, 90), 1.0][: rnd.randrange(2, 4)] for _ in range(rnd.randrange(8))] for _ in range(300)]
    held = pa.array([*lines, None], pa.list_(pa.list_(pa.float64())))
    texts = polyline.encode_lines(held)
    assert texts.to_pylist() == [*map(polyline_by_loop, lines), None]
    for line, got in zip(lines, polyline.decode_texts(texts).to_pylist()):
        assert len(line) == len(got) and all(abs(a - b) < 6e-6 for p, q in zip(line, got) for a, b in zip(p, q))
    assert polyline.encode_lines(held.slice(40, 90)).equals(texts.slice(40, 90))
    assert polyline.decode_texts(texts.slice(40, 90)).to_pylist() == polyline.decode_texts(texts).to_pylist()[40:130]
    assert polyline.encode_lines(pa.array([[[1.0]], [[None, 1.0]], [[math.nan, 0.0]], [None]], held.type)).null_count == 4
    assert polyline.decode_texts(pa.array(["", "??", "_p~iF~ps|", "?", "\x01?", "_" * 13 + "??", None])).to_pylist() == [[], [[0.0, 0.0]], *[None] * 5]
    assert len(polyline.encode_lines(held[:0])) == len(polyline.decode_texts(texts[:0])) == 0


def test_features_of_collections(spark, tmp_path):
    many = '{"type":"Feature","geometry":{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1.0,2.0]},{"type":"LineString","coordinates":[[0.0,0.0],[1.0,1.0]]}]},"properties":{"a":1}}'
    none = '{"type":"Feature","geometry":null,"properties":null}'
    bad = ['{"type":"Feature","properties":null}', '{"type":"Feature","geometry":"x"}', '{"type":"Feature","geometry":[]}', '{"type":"Feature","geometry":{}}', '{"type":"Feature","geometry":{"type":"GeometryCollection"}}']
    bad.append('{"type":"Feature","geometry":{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1]}]}}')
    df = spark.createDataFrame([(x,) for x in (many, none, *bad)], "j string").coalesce(1)
    got = [r.f for r in df.select(geojson.feature_or_null(F.col("j")).alias("f")).collect()]
    assert [g is not None for g in got] == [True, True] + [False] * len(bad)
    assert [g.type for g in got[0].geometries] == ["Point", "LineString"] and got[0].geometry is None and got[1].geometries is None
    (tmp_path / "a.json").write_text(many + "\n" + none)
    geojson.write_lines(geojson.read_lines(spark, str(tmp_path / "a.json")).coalesce(1), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == [many, none]


def test_members_in_any_order(spark):
    """Features by their types give what they give by their members, decoys and broken coordinates included."""
    point = '"geometry":{"type":"Point","coordinates":[1,2]}'
    texts = [
        '{"type":"Feature",%s,"properties":{"a":1},"id":7,"bbox":[0,0,1,1]}' % point,
        '{"type":"Feature","geometry":{"coordinates":[1,2],"type":"Point"},"properties":{"a":1},"id":7,"bbox":[0,0,1,1]}',
        '{"properties":{"geometry":{"type":"Point","coordinates":[9]}},"type":"Feature","geometry":{"type":"LineString","coordinates":[[0,0],[1,1]]}}',
        '{"properties":{"geometry":{"type":"Point"}},"type":"Feature","geometry":null}',
        '{"type":"Feature","geometry":{"type":"Point","coordinates":[[1,2]]},"properties":null}',
        '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[1,2]]},"properties":null}',
        '{"type":"Feature","geometry":{"type":"Point","coordinates":["x",2]},"properties":null}',
        '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2],"bbox":"no"},"properties":null}',
        '{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]]]},"properties":{},"id":"a"}',
        '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]}',
        '{"type":"Feature","properties":null}',
        '{"type":"Other",%s}' % point,
    ]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, j string")
    got = {r.k: r.f for r in df.select("k", geojson.feature_or_null(F.col("j")).alias("f")).collect()}
    assert got[0] == got[1] and got[0].id == "7" and got[0].bbox == [0, 0, 1, 1] and got[0].geometry.parts == [[[[1, 2]]]]
    assert got[2].geometry.type == "LineString" and got[3].geometry is None and got[8].id == '"a"' and got[8].geometry.type == "MultiPolygon"
    assert all(got[k] is None for k in (4, 5, 6, 7, 9, 10, 11))
