"""Queries over the operators that come in families: codecs, archives, builders, conversions, units, the index.

They work on whole tables like those of ``queries``, which this module adds to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoframe import schema as S
from geoframe import sql
from geoframe.functions import geometry as G
from geoframe.functions import lines as L
from geoframe.functions import measure as M
from geoframe.functions import tiles as T
from geoframe.functions import units as U
from geoframe.operators import collections as C
from geoframe.operators import join as J
from geoframe.operators.index import SpatialIndex
from geoframe.sources import geojson, geouri, gpx, pmtiles, polyline

from .queries import AREA, BOXES, LINES_SQL, P4, POINTS, RING, boxes, brg, hav, lat_of, lines, lon_of, nearest_sql, pmod, points, query

RECT = "[[cx - w, cy - w], [cx + w, cy - w], [cx + w, cy + w], [cx - w, cy + w], [cx - w, cy - w]]"


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that all executors share; it goes when the application ends."""
    jvm = spark.sparkContext._jvm
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = jvm.org.apache.hadoop.fs.Path(f"{known}/{uuid.uuid4().hex}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def lonlat(c: str, digits: int = 6):
    """Rounded lon and lat of a position column."""
    return F.round(G.lon(F.col(c)), digits).alias("lon"), F.round(G.lat(F.col(c)), digits).alias("lat")


# GeoJSON


@query("geojson_or_null", "SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'Point' END AS any_type, c_custkey % 6 = 0 AS polygon, CASE c_custkey % 6 WHEN 2 THEN NULL WHEN 4 THEN NULL WHEN 1 THEN 'Point' ELSE 'Polygon' END AS kind, c_custkey % 6 IN (0, 1) AS feature FROM customer")
def geojson_or_null(spark, d):
    """Decoding by type and without an error: two valid objects, a broken one, an open ring, no object, a missing member."""
    ring = lambda last: F.concat(F.lit('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],'), F.lit(last), F.lit("]]}"))
    kind = F.col("id") % 6
    text = F.when(kind == 0, ring("[0,0]")).when(kind == 1, F.lit('{"type":"Point","coordinates":[1,2],"crs":"ignored"}')).when(kind == 2, F.lit('{"type":')).when(kind == 3, ring("[5,5]")).when(kind == 4, F.lit("[]")).otherwise(F.lit('{"type":"Polygon"}'))
    df = points(spark, d).select("id", text.alias("j"))
    told = F.concat(F.lit('{"type":"Feature","properties":null,"geometry":'), F.col("j"), F.lit("}"))
    return df.select("id", geojson.geometry_or_null(F.col("j"))["type"].alias("any_type"), geojson.geometry_or_null(F.col("j"), "Polygon").isNotNull().alias("polygon"), geojson.kind_of(F.col("j")).alias("kind"), geojson.feature_or_null(told).isNotNull().alias("feature"))


@query("feature_collection", f"WITH p AS ({POINTS}) SELECT CAST(id % 7 AS BIGINT) AS k, count(*) AS features, sum(id) AS ids, round(min(x1), 6) AS west FROM p GROUP BY 1")
def feature_collection(spark, d):
    """Collections written as documents and read back, feature by feature."""
    text = geojson.encode_feature(G.point(F.col("a")), F.to_json(F.struct("id")), F.col("id").cast("string"))
    docs = points(spark, d).groupBy((F.col("id") % 7).alias("k")).agg(geojson.encode_collection(text).alias("j"))
    each = docs.select("k", F.explode(geojson.collection_features(F.col("j"))).alias("j")).select("k", geojson.feature(F.col("j")).alias("f"))
    return each.groupBy("k").agg(F.count("*").alias("features"), F.sum(F.col("f.id").cast("long")).alias("ids"), F.round(F.min(G.lon(G.only_position(F.col("f.geometry")))), 6).alias("west"))


@query(
    "geometry_collection",
    f"WITH b AS ({BOXES}), r AS (SELECT *, {RECT} AS ring FROM b) SELECT bid, CAST(4 AS BIGINT) AS members, round(({hav('cx', 'cy', '(cx + w)', '(cy + w)')} + list_sum(list_transform(range(1, 5), lambda i: {hav('ring[i][1]', 'ring[i][2]', 'ring[i + 1][1]', 'ring[i + 1][2]')}))) / 1000, 3) AS km, round({AREA} / 1000000, 2) AS km2, round(cx - w, 6) AS west, round(cy + w, 6) AS north FROM r",
)
def geometry_collection(spark, d):
    """Nested collections written, decoded and measured."""
    centre, w = F.array("cx", "cy"), F.col("w")
    one = geojson.encode_geometry
    text = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), one(G.point(centre)), F.lit(',{"type":"GeometryCollection","geometries":['), one(G.line_string(F.array(centre, F.array(F.col("cx") + w, F.col("cy") + w)))), F.lit(',{"type":"GeometryCollection","geometries":['), one(F.col("polygon")), F.lit("]}]},"), one(G.multi_point(F.array(centre))), F.lit("]}"))
    gs = boxes(spark, d).select("bid", geojson.geometries(text).alias("gs"))
    g, box = F.col("gs"), F.col("box")
    made = gs.select("bid", F.size(g).cast("long").alias("members"), F.round(M.collection_length(g) / 1000, 3).alias("km"), F.round(M.collection_area(g) / 1e6, 2).alias("km2"), M.collection_bbox(g).alias("box"))
    return made.select("bid", "members", "km", "km2", F.round(M.west(box), 6).alias("west"), F.round(M.north(box), 6).alias("north"))


@query("collection_build", f"WITH b AS ({BOXES}) SELECT CAST(bid % 5 AS BIGINT) AS k, 3 * count(*) AS members, count(*) AS polygons, round(min(cx - w), 6) AS west FROM b GROUP BY 1")
def collection_build(spark, d):
    """Collections of literals, of collections inside collections and of groups."""
    centre = G.point(F.array("cx", "cy"))
    whole = G.geometry_collection(F.col("polygon"), G.in_collection(G.geometry_collection(centre, G.line_string(F.array(F.array("cx", "cy"), F.array("cy", "cx"))))))
    each = boxes(spark, d).select((F.col("bid") % 5).alias("k"), "bid", F.posexplode(whole).alias("at", "g"))
    made = each.groupBy("k").agg(G.build_collection(F.struct("bid", "at"), F.col("g")).alias("gs"), F.min(F.when(F.col("g.type") == "Polygon", M.west(M.compute_bbox(F.col("g"))))).alias("west"))
    return made.select("k", F.size("gs").cast("long").alias("members"), F.size(F.filter("gs", lambda g: g["type"] == "Polygon")).cast("long").alias("polygons"), F.round("west", 6).alias("west"))


@query("position_json", f"WITH p AS ({POINTS}) SELECT id, CASE WHEN id % 3 > 0 THEN round(x1, 6) END AS lon, CASE WHEN id % 3 = 2 THEN CAST(7 AS DOUBLE) END AS alt, CASE WHEN id % 2 = 0 THEN round(x2, 6) END AS east FROM p")
def position_json(spark, d):
    x, y = F.col("x1").cast("string"), F.col("y1").cast("string")
    p = F.when(F.col("id") % 3 == 0, F.concat(F.lit("["), x, F.lit("]"))).when(F.col("id") % 3 == 1, F.concat(F.lit("["), x, F.lit(","), y, F.lit("]"))).otherwise(F.concat(F.lit("["), x, F.lit(","), y, F.lit(",7]")))
    b = F.when(F.col("id") % 2 == 0, F.to_json(F.array("x1", "y1", "x2", "y2"))).otherwise(F.to_json(F.array("x1", "y1", "x2")))
    df = points(spark, d).select("id", geojson.position_or_null(p).alias("p"), geojson.bbox_or_null(b).alias("b"))
    return df.select("id", F.round(G.lon(F.col("p")), 6).alias("lon"), G.alt(F.col("p")).alias("alt"), F.round(M.east(F.col("b")), 6).alias("east"))


@query("feature_ids", "SELECT c_custkey AS id, '\"' || c_name || '\"' AS text_id, CAST(c_custkey AS VARCHAR) AS number_id, c_custkey % 5 AS k, c_mktsegment AS segment FROM customer")
def feature_ids(spark, d):
    """Features built from columns, with ids of strings and numbers and properties of the caller's types."""
    c = spark.read.parquet(f"{d}/customer.parquet").withColumn("props", F.to_json(F.struct((F.col("c_custkey") % 5).alias("k"), F.col("c_mktsegment").alias("segment"))))
    f = lambda id_: geojson.feature_of(G.point_lonlat(F.lit(1.0), F.lit(2.0)), F.col("props"), id_)
    made = c.select(F.col("c_custkey").alias("id"), f(F.col("c_name")).alias("f"), f(F.col("c_custkey")).alias("g"))
    return made.select("id", F.col("f.id").alias("text_id"), F.col("g.id").alias("number_id"), G.properties_as(F.col("f.properties"), "k bigint, segment string").alias("p")).select("id", "text_id", "number_id", "p.k", "p.segment")


@query("parquet_roundtrip", f"WITH p AS ({POINTS}) SELECT id, 'Point' AS type, round(x1, 6) AS lon, round(y1, 6) AS lat FROM p")
def parquet_roundtrip(spark, d):
    """Geometries are plain Spark types, so a binary format is Parquet."""
    path = f"{scratch(spark)}/points"
    points(spark, d).select("id", G.point(F.col("a")).alias("g")).write.parquet(path)
    return spark.read.parquet(path).filter(S.is_valid(F.col("g"))).select("id", "g.type", G.only_position(F.col("g")).alias("p")).select("id", "type", *lonlat("p"))


# other formats


@query("geo_uri_format", f"WITH p AS ({POINTS}) SELECT id, 'geo:' || CAST(floor(y1) AS INTEGER) || '.5,' || CAST(floor(x1) AS INTEGER) || '.25' AS uri FROM p WHERE y1 >= 1 AND x1 >= 1")
def geo_uri_format(spark, d):
    p = F.array(F.floor("x1").cast("double") + 0.25, F.floor("y1").cast("double") + 0.5)
    return points(spark, d).filter("y1 >= 1 AND x1 >= 1").select("id", geouri.format_uri(G.point(p)).alias("uri"))


@query("polyline_or_null", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 3 END AS positions FROM customer")
def polyline_or_null(spark, d):
    kind = F.col("id") % 3
    text = F.when(kind == 0, F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@")).when(kind == 1, F.lit("_p~iF~ps|")).otherwise(F.lit("_p~iF~ps|U_"))
    made = points(spark, d).repartition("id").select("id", polyline.decode_or_null(text).alias("ps"))
    return made.select("id", F.when(F.col("ps").isNotNull(), F.size("ps")).alias("positions"))


def waypoints(spark: SparkSession, d: str) -> DataFrame:
    """Customers as waypoints: position, elevation, name with signs to escape, and a link."""
    c = points(spark, d)
    fields = {"_lat": F.round("y1", 3), "_lon": F.round("x1", 3), "ele": F.col("id").cast("double"), "name": F.concat(F.lit("a<b & \"c\" "), F.col("id")), "link": F.when(F.col("id") % 2 == 0, F.struct(F.concat(F.lit("http://x/?a=1&b="), F.col("id")).alias("_href"), F.lit("t").alias("text"), F.lit(None).cast("string").alias("type")))}
    names = ["_lat", "_lon", *[x.split(":")[0] for x in gpx.POINT_FIELDS.replace(gpx.LINK, "link").split(",")]]
    kind = gpx.schema("wpt")
    return c.select("id", F.struct(*[fields[n].cast(kind[n].dataType).alias(n) if n in fields else F.lit(None).cast(kind[n].dataType).alias(n) for n in names]).alias("w"))


def written(spark: SparkSession, text: DataFrame) -> str:
    """The folder of documents of one text column."""
    path = f"{scratch(spark)}/documents"
    text.write.option("maxRecordsPerFile", 1).text(path)  # a document a file
    return path


@query("gpx_waypoints", f"WITH p AS ({POINTS}) SELECT id, round(x1, 3) AS lon, round(y1, 3) AS lat, CAST(id AS DOUBLE) AS ele, 'a<b & \"c\" ' || id AS name, CASE WHEN id % 2 = 0 THEN 'http://x/?a=1&b=' || id END AS href FROM p")
def gpx_waypoints(spark, d):
    """Waypoints written as documents, read back by the XML source and made features."""
    docs = waypoints(spark, d).groupBy((F.col("id") % 20).alias("k")).agg(gpx.document(F.listagg(gpx.encode_point(F.col("w")))).alias("value")).select("value")
    read = gpx.read(spark, written(spark, docs))
    f = gpx.waypoint_features(read).select(G.only_position(F.col("geometry")).alias("p"), G.properties_as(F.col("properties"), "name string, ele double, link struct<_href:string>").alias("x"))
    return f.select(F.col("x.ele").cast("long").alias("id"), *lonlat("p", 3), "x.ele", "x.name", F.col("x.link._href").alias("href"))


@query("gpx_routes", "SELECT CAST(c_custkey % 50 AS INTEGER) AS number, count(*) AS points, sum(c_custkey) AS ids, 'http://r/' || (c_custkey % 50) AS href FROM customer GROUP BY 1, 4 UNION ALL SELECT 99, 0, NULL, NULL")
def gpx_routes(spark, d):
    """Routes with links, and one without points, through documents and back."""
    link = lambda k: F.struct(F.concat(F.lit("http://r/"), k).alias("_href"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("type"))
    none = F.lit(None).cast("string")
    head = lambda n, l: [none.alias("name"), none.alias("cmt"), none.alias("desc"), none.alias("src"), l.alias("link"), n.cast("int").alias("number"), none.alias("type")]
    grouped = waypoints(spark, d).groupBy((F.col("id") % 50).alias("k")).agg(F.array_sort(F.collect_list("w"), lambda x, y: F.signum(x["ele"] - y["ele"]).cast("int")).alias("rtept"))
    full = grouped.select(F.struct(*head(F.col("k"), link(F.col("k"))), "rtept").alias("r"))
    empty = spark.range(1).select(F.struct(*head(F.lit(99), F.lit(None).cast(gpx.LINK)), F.lit(None).cast(f"array<{gpx.POINT}>").alias("rtept")).alias("r"))
    read = gpx.read(spark, written(spark, full.unionByName(empty).select(gpx.document(gpx.encode_route(F.col("r"))).alias("value"))), "rte")
    ids = F.aggregate(F.col("rtept"), F.lit(0.0), lambda s, w: s + w["ele"]).cast("long")
    f = gpx.route_features(read).select(F.size("geometries").cast("long").alias("points"), G.int_property(F.col("properties"), "number").alias("number"))
    told = read.select("number", ids.alias("ids"), F.col("link._href").alias("href"))
    return f.join(told, "number").select("number", "points", "ids", "href")


@query("gpx_tracks", "SELECT CAST(c_custkey % 50 AS INTEGER) AS number, CAST(count(DISTINCT c_custkey % 4) AS BIGINT) AS segments, count(*) AS points FROM customer GROUP BY 1")
def gpx_tracks(spark, d):
    """Tracks of segments through documents and back to features of points."""
    none = F.lit(None).cast("string")
    segments = waypoints(spark, d).groupBy((F.col("id") % 50).alias("k"), (F.col("id") % 4).alias("s")).agg(F.struct(F.collect_list("w").alias("trkpt")).alias("seg"))
    tracks = segments.groupBy("k").agg(F.collect_list("seg").alias("trkseg"))
    row = F.struct(none.alias("name"), none.alias("cmt"), none.alias("desc"), none.alias("src"), F.lit(None).cast(gpx.LINK).alias("link"), F.col("k").cast("int").alias("number"), none.alias("type"), "trkseg")
    read = gpx.read(spark, written(spark, tracks.select(gpx.document(gpx.encode_track(row)).alias("value"))), "trk")
    f = gpx.track_features(read).select(F.size("geometries").cast("long").alias("points"), F.col("properties"))
    return f.select(G.int_property(F.col("properties"), "number").alias("number"), F.size(G.properties_as(F.col("properties"), "trkseg array<struct<trkpt:array<struct<ele:double>>>>")["trkseg"]).cast("long").alias("segments"), "points")


@query("gpx_metadata", "SELECT r_regionkey AS k, CASE WHEN r_regionkey % 2 = 0 THEN 'a \"b\" <c>' ELSE 'geoframe' END AS creator, '1.1' AS version, r_name AS name, 'x@y.org' AS mail, CAST(2000 + r_regionkey AS INTEGER) AS year, CAST(r_regionkey AS DOUBLE) AS minlat FROM region")
def gpx_metadata(spark, d):
    """Metadata and attributes of documents, a missing creator among them."""
    r = spark.read.parquet(f"{d}/region.parquet")
    kind = gpx.schema("metadata")
    held = {"name": F.col("r_name"), "author": F.struct(F.lit("n").alias("name"), F.struct(F.lit("x").alias("_id"), F.lit("y.org").alias("_domain")).alias("email"), F.lit(None).cast(gpx.LINK).alias("link")), "copyright": F.struct(F.lit("me").alias("_author"), (2000 + F.col("r_regionkey")).cast("int").alias("year"), F.lit(None).cast("string").alias("license")), "bounds": F.struct(*[F.col("r_regionkey").cast("double").alias(f"_{n}") for n in ("minlat", "minlon", "maxlat", "maxlon")]), "keywords": F.col("r_regionkey").cast("string")}
    m = F.struct(*[(held[f.name] if f.name in held else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
    docs = r.select(F.when(F.col("r_regionkey") % 2 == 0, gpx.document(F.lit(None).cast("string"), 'a "b" <c>', m)).otherwise(F.regexp_replace(gpx.document(F.lit(None).cast("string"), metadata=m), ' creator="geoframe"', "")).alias("value"))
    read = gpx.read_documents(spark, written(spark, docs))
    x = F.col("metadata")
    return read.select(x["keywords"].cast("int").alias("k"), "creator", "version", x["name"].alias("name"), F.concat(x["author"]["email"]["_id"], F.lit("@"), x["author"]["email"]["_domain"]).alias("mail"), x["copyright"]["year"].alias("year"), x["bounds"]["_minlat"].alias("minlat"))


# archives: customers as tiles of zoom 14, in rows of 128, some of which share a payload

TILE = "SELECT CAST(14 AS INTEGER) AS z, c_custkey % 128 AS x, c_custkey // 128 AS y, 'payload ' || (c_custkey // 16 % 40) AS payload FROM customer"


def placed(x: Column, y: Column) -> tuple[Column, Column]:
    """The tile of zoom 14 for a place: rows beyond the zoom's last, 16 383, go on in the next 128 columns."""
    return (x + 128 * F.floor(y / (1 << 14))).alias("x"), (y % (1 << 14)).alias("y")


def unplaced(x: Column, y: Column) -> tuple[Column, Column]:
    """The place of a tile; the inverse of ``placed``."""
    return (x % 128).alias("x"), (y + (1 << 14) * F.floor(x / 128)).alias("y")


def tiles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(F.lit(14).alias("z"), *placed(k % 128, F.floor(k / 128)), F.concat(F.lit("payload "), F.floor(k / 16) % 40).cast("binary").alias("payload"))


ARCHIVES: dict[tuple[str, str], str] = {}


def archive(spark: SparkSession, d: str, **options) -> str:
    """The path of an archive of ``tiles``, in a folder that executors reach; the plain one is written once an application."""
    pmtiles.register(spark)
    known = spark.sparkContext.applicationId, d
    if not options and known in ARCHIVES:
        return ARCHIVES[known]
    path = f"{scratch(spark)}/tiles.pmtiles".removeprefix("file:")
    pmtiles.write(tiles(spark, d), path, **({"metadata": '{"name":"n","vector_layers":[]}', "tile_type": 1} | options))
    if not options:
        ARCHIVES[known] = path
    return path


def view(spark: SparkSession, path: str, name: str, **options) -> DataFrame:
    return spark.read.format("pmtiles").options(path=path, view=name, **options).load()


@query("archive_tiles", f"WITH t AS ({TILE}) SELECT * FROM t")
def archive_tiles(spark, d):
    """Tiles written to an archive and read back."""
    return view(spark, archive(spark, d), "tiles").select("z", *unplaced(F.col("x"), F.col("y")), F.col("payload").cast("string").alias("payload"))


@query("archive_tile", f"WITH t AS ({TILE}) SELECT x, y, payload FROM t WHERE x = 5 AND y = 3")
def archive_tile(spark, d):
    """One tile by its place, which is pushed to the reader."""
    return view(spark, archive(spark, d), "tiles", decompress="true").filter("z = 14 AND x = 5 AND y = 3").select("x", "y", F.col("payload").cast("string").alias("payload"))


@query("archive_directory", f"WITH t AS ({TILE}) SELECT count(*) AS tiles, count(DISTINCT payload) AS contents FROM t")
def archive_directory(spark, d):
    e = view(spark, archive(spark, d), "directory")
    return e.agg(F.sum("run_length").alias("tiles"), F.countDistinct("offset").alias("contents"))


@query("archive_header", f"WITH t AS ({TILE}) SELECT CAST(count(*) AS BIGINT) AS addressed_tiles, CAST(count(DISTINCT payload) AS BIGINT) AS tile_contents, CAST(14 AS BIGINT) AS min_zoom, CAST(14 AS BIGINT) AS max_zoom, CAST(1 AS BIGINT) AS clustered, CAST(sum(DISTINCT 8 + length(CAST(c // 16 % 40 AS VARCHAR)) + 1000 * (c // 16 % 40)) % 1000 AS BIGINT) AS tile_bytes FROM t, (SELECT 1) JOIN (SELECT c_custkey AS c FROM customer) ON c % 128 = x AND c // 128 = y")
def archive_header(spark, d):
    h = view(spark, archive(spark, d), "header")
    return h.select("addressed_tiles", "tile_contents", "min_zoom", "max_zoom", "clustered", (F.col("tile_length") % 1000).alias("tile_bytes"))


@query("archive_metadata", "SELECT 'n' AS name, '[]' AS vector_layers")
def archive_metadata(spark, d):
    return view(spark, archive(spark, d), "metadata").select("name", "vector_layers")


@query("archive_warnings", "SELECT unnest(['MissingVectorLayers', 'UnknownTileType']) AS code, unnest(['no', 'yes']) AS unknown_type")
def archive_warnings(spark, d):
    """What a lenient read warns of: an unknown tile type, and metadata without vector layers."""
    path = archive(spark, d, metadata="{}", tile_type=2)
    data = bytearray(open(path, "rb").read(127))
    found = []
    for kind, name in ((0, "yes"), (1, "no")):
        data[99] = kind
        other = f"{path}.{kind}"
        with open(path, "rb") as a, open(other, "wb") as b:
            b.write(bytes(data) + a.read()[127:])
        found.append(view(spark, other, "warnings", strict="false").select("code", F.lit(name).alias("unknown_type")))
    return found[0].unionByName(found[1])


@query("archive_batch", f"WITH t AS ({TILE}), a AS (SELECT o_orderkey AS place, CAST(CASE WHEN o_orderkey % 11 = 0 THEN 40 ELSE 14 END AS INTEGER) AS z, o_custkey % 128 AS x, o_custkey // 128 + CASE WHEN o_orderkey % 7 = 0 THEN 9000 ELSE 0 END AS y FROM orders) SELECT a.place, a.z, a.x, a.y, t.payload FROM a LEFT JOIN t USING (z, x, y)")
def archive_batch(spark, d):
    """Tiles for a list of coordinates with repeats, tiles that aren't there and impossible places."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    asked = o.select(k.alias("place"), F.when(k % 11 == 0, 40).otherwise(14).alias("z"), *placed(c % 128, F.floor(c / 128) + F.when(k % 7 == 0, 9000).otherwise(0)))
    return pmtiles.read_batch(spark, archive(spark, d), asked).select("place", "z", *unplaced(F.col("x"), F.col("y")), F.col("payload").cast("string").alias("payload"))


@query("archive_contains", f"WITH t AS ({TILE}) SELECT o_orderkey AS place FROM orders WHERE o_custkey * 2 % 256 < 128 AND EXISTS (SELECT 1 FROM t WHERE x = o_custkey * 2 % 256 AND y = o_custkey // 128)")
def archive_contains(spark, d):
    """The coordinates whose tile is in the archive."""
    asked = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("place"), (F.col("o_custkey") * 2 % 256).alias("x"), F.floor(F.col("o_custkey") / 128).alias("y"))
    keyed = asked.filter("x < 128").select("place", *placed(F.col("x"), F.col("y"))).filter(F.col("x") < 1 << 14).withColumn("tile", T.tile_ids(F.lit(14), F.col("x"), F.col("y")))
    entries = view(spark, archive(spark, d), "directory").select(F.col("tile_id").alias("first"), "run_length")
    return J.interval_lookup(keyed, entries, "tile", "first", "run_length", "left_semi").select("place")


@query("archive_codec", f"WITH t AS ({TILE}) SELECT x, y, reverse(payload) AS payload FROM t")
def archive_codec(spark, d):
    """An archive whose payloads and directories pass through codecs and a byte source of the caller's."""
    from geoframe.sources.pmtiles.source import Files

    class Counted(Files):
        def read(self, path, ranges):
            return [bytes(x) for x in super().read(path, ranges)]

    path = archive(spark, d, tile_compression=4, internal_compression=3, codecs={3: lambda b: b[::-1]})
    pmtiles.register(spark, {3: lambda b: b[::-1], 4: lambda b: b[::-1]}, Counted())
    return view(spark, path, "tiles", decompress="true").select(*unplaced(F.col("x"), F.col("y")), F.col("payload").cast("string").alias("payload"))


@query(
    "read_coalescing_capped",
    """WITH RECURSIVE r AS (SELECT o_custkey AS archive, o_orderkey * 10 AS o, 10 + o_orderkey % 300 AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
    w(archive, k, start, stop, island) AS (SELECT archive, k, o, o + n, 1 FROM r WHERE k = 1 UNION ALL
      SELECT r.archive, r.k, CASE WHEN r.o - w.stop <= 5000 AND greatest(r.o + r.n, w.stop) - w.start <= 20000 THEN w.start ELSE r.o END,
             CASE WHEN r.o - w.stop <= 5000 AND greatest(r.o + r.n, w.stop) - w.start <= 20000 THEN greatest(r.o + r.n, w.stop) ELSE r.o + r.n END,
             CASE WHEN r.o - w.stop <= 5000 AND greatest(r.o + r.n, w.stop) - w.start <= 20000 THEN w.island ELSE w.island + 1 END
      FROM w JOIN r ON r.archive = w.archive AND r.k = w.k + 1)
    SELECT archive, min(start) AS "offset", max(stop) - min(start) AS length, count(*) AS ranges FROM w GROUP BY archive, island""",
)
def read_coalescing_capped(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("archive"), (F.col("o_orderkey") * 10).alias("offset"), (10 + F.col("o_orderkey") % 300).alias("length"))
    return C.coalesce_islands(o, "archive", gap=5000, most=20000)


@query("zoom_start", "SELECT o_orderkey AS id, ((CAST(1 AS BIGINT) << CAST(2 * (o_orderkey % 31) AS INTEGER)) - 1) // 3 AS start FROM orders")
def zoom_start(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), T.zoom_start(F.col("o_orderkey") % 31).alias("start"))


# builders, access, conversions


@query("literals", "SELECT r_regionkey AS k, 3 AS points, 4 AS line, 5 AS lines, 9 AS polygon, 10 AS polygons, CAST(17 AS DOUBLE) AS total, 3 AS axes FROM region")
def literals(spark, d):
    ring = [(0, 0), (1, 0), (1, 1), (0, 0)]
    size = lambda g: F.size(G.coordinates(g))
    total = F.aggregate(F.flatten(G.coordinates(G.multi_point_of((1, 2), (3, 11)))), F.lit(0.0), lambda s, x: s + x)
    return spark.read.parquet(f"{d}/region.parquet").select(
        F.col("r_regionkey").alias("k"), size(G.multi_point_of((1, 2), (3, 4), (5, 6))).alias("points"), size(G.line_string_of(*ring)).alias("line"), size(G.multi_line_string_of([(0, 0), (1, 1)], [(2, 2), (3, 3), (4, 4)])).alias("lines"),
        size(G.build_polygon(F.array(F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in ring]), F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in [(0, 0), (2, 0), (2, 2), (0, 2)]])))).alias("polygon"),
        size(G.multi_polygon_of([ring], [[(5, 5), (6, 5), (6, 6), (5, 6), (5, 5), (5, 5)]])).alias("polygons"), total.alias("total"), G.axes(G.only_position(G.point_of(1, 2, 3))).alias("axes"),
    )


@query("build_groups", f"WITH p AS ({POINTS}) SELECT CAST(id % 9 AS BIGINT) AS k, count(*) AS points, count(*) AS lines, 2 * count(*) AS line_positions, count(*) AS rings, count(*) AS polygons, round(arg_min(x1, id), 6) AS first_lon FROM p GROUP BY 1")
def build_groups(spark, d):
    """Geometries built by accumulation over the rows of a group."""
    p = points(spark, d)
    w = F.lit(1.0)
    ring = F.array(F.array("x1", "y1"), F.array(F.col("x1") + w, F.col("y1")), F.array(F.col("x1") + w, F.col("y1") + w))
    closed = F.concat(ring, F.array(F.get(ring, 0)))
    g = p.groupBy((F.col("id") % 9).alias("k")).agg(G.make_multi_point(F.col("id"), F.col("a")).alias("mp"), G.make_multi_line(F.col("id"), F.array("a", "b")).alias("ml"), G.make_polygon(F.col("id"), ring).alias("pg"), G.make_multi_polygon(F.col("id"), F.array(closed)).alias("mg"))
    n = lambda x: F.size(x).cast("long")
    valid = S.is_valid(F.col("mp")) & S.is_valid(F.col("ml")) & S.is_valid(F.col("pg")) & S.is_valid(F.col("mg"))
    return g.filter(valid).select("k", n(G.coordinates(F.col("mp"))).alias("points"), n(G.lines_of(F.col("ml"))).alias("lines"), n(G.coordinates(F.col("ml"))).alias("line_positions"), n(G.lines_of(F.col("pg"))).alias("rings"), n(F.col("mg.parts")).alias("polygons"), F.round(G.lon(F.get(G.coordinates(F.col("mp")), 0)), 6).alias("first_lon"))


@query("child_access", f"WITH l AS ({LINES_SQL}) SELECT id, 6 AS children, round(line[4][1], 6) AS lon3, true AS has_third, false AS has_other, true AS has_all, true AS beyond FROM l")
def child_access(spark, d):
    g = G.multi_point(F.col("line"))
    third = G.point(F.get(F.col("line"), 3))
    return lines(spark, d).select("id", G.count_children(g).alias("children"), F.round(G.lon(G.only_position(G.child(g, 3))), 6).alias("lon3"), G.contains_child(g, third).alias("has_third"), G.contains_child(g, G.point_of(999, 999)).alias("has_other"), G.contains_children(g, F.array(third, G.child(g, 0))).alias("has_all"), G.child(g, 6).isNull().alias("beyond"))


@query("map_features", f"WITH p AS ({POINTS}) SELECT id, round(x1 + 1, 6) AS lon, CASE WHEN id % 2 = 0 THEN round(x1 + 1, 6) END AS west, CAST(2 * id AS VARCHAR) AS props FROM p")
def map_features(spark, d):
    """Functions over geometries, whose boxes follow where there were some, and over properties."""
    f = points(spark, d).select("id", G.point(F.col("a")).alias("geometry"), F.col("id").cast("string").alias("properties"), F.when(F.col("id") % 2 == 0, M.box(F.col("x1"), F.col("y1"), F.col("x1"), F.col("y1"))).alias("bbox"))
    moved = C.map_geometry(f, lambda g: G.point(F.array(G.lon(G.only_position(g)) + 1, G.lat(G.only_position(g)))))
    made = C.map_properties(moved, lambda p: (p.cast("long") * 2).cast("string"))
    return made.select("id", F.round(G.lon(G.only_position(F.col("geometry"))), 6).alias("lon"), F.round(M.west(F.col("bbox")), 6).alias("west"), F.col("properties").alias("props"))


@query("conversions", f"WITH b AS ({BOXES}), r AS (SELECT *, {RING} AS ring FROM b) SELECT bid, 'MultiLineString' AS lines, 1 AS multi_lines, 'MultiPolygon' AS multi, 'MultiPoint' AS points, 'MultiLineString' AS line, round(cx - w, 6) AS west FROM r")
def conversions(spark, d):
    g, p = F.col("polygon"), G.point(F.array("cx", "cy"))
    lines_ = G.polygon_to_multi_line(g)
    return boxes(spark, d).select("bid", lines_["type"].alias("lines"), F.size(G.multi_polygon_to_multi_lines(G.polygon_to_multi_polygon(g))).alias("multi_lines"), G.polygon_to_multi_polygon(g)["type"].alias("multi"), G.to_multi_point(p)["type"].alias("points"), G.line_to_multi_line(G.line_string(G.only_line(g)))["type"].alias("line"), F.round(M.west(lines_["bbox"]), 6).alias("west"))


@query("rings_in_order", f"WITH b AS ({BOXES}) SELECT bid, CAST(2 AS BIGINT) AS rings, round(cx - w, 6) AS outer_west, CAST(5 AS BIGINT) AS inner_positions, CAST(2 AS BIGINT) AS polygons FROM b")
def rings_in_order(spark, d):
    """Lines to polygons: open rings are closed, and the ring of the largest box leads."""
    cx, cy, w = F.col("cx"), F.col("cy"), F.col("w")
    square = lambda r: F.array(F.array(cx - r, cy - r), F.array(cx + r, cy - r), F.array(cx + r, cy + r), F.array(cx - r, cy + r))
    pair = G.multi_line_string(F.array(square(w / 2), square(w)))
    made = boxes(spark, d).select("bid", G.line_to_polygon(pair).alias("g"), G.lines_to_multi_polygon(F.array(pair, G.line_string(square(w)))).alias("m"))
    ring = lambda k: F.get(G.lines_of(F.col("g")), k)
    return made.select("bid", F.size(G.lines_of(F.col("g"))).cast("long").alias("rings"), F.round(G.lon(F.get(ring(0), 0)), 6).alias("outer_west"), F.size(ring(1)).cast("long").alias("inner_positions"), F.size("m.parts").cast("long").alias("polygons"))


@query("collection_rows", "SELECT CAST(count(*) AS BIGINT) AS geometries, CAST(sum(c_custkey) AS BIGINT) AS ids FROM customer WHERE c_custkey % 4 <> 0")
def collection_rows(spark, d):
    """Features to geometries, without the null ones, and back to features."""
    f = points(spark, d).select(F.when(F.col("id") % 4 != 0, G.point(F.array(F.col("id").cast("double"), F.lit(0.0)))).alias("geometry"))
    back = C.to_features(C.to_geometries(f), lambda g: F.to_json(F.struct(G.lon(G.only_position(g)).cast("long").alias("id"))))
    return back.agg(F.count("geometry").alias("geometries"), F.sum(G.property_as(F.col("properties"), "id", "bigint")).alias("ids"))


@query("bbox_tools", f"WITH b AS ({BOXES}) SELECT bid, round(cx - w, 6) AS west, round(cy + w, 6) AS north, true AS holds, bid % 2 = 0 AS held, CAST(3 AS DOUBLE) AS low, round(cx + w, 6) AS east6 FROM b")
def bbox_tools(spark, d):
    cx, cy, w = F.col("cx"), F.col("cy"), F.col("w")
    g = M.with_bbox(G.polygon(G.lines_of(F.col("polygon"))))
    inner = M.box(cx - w / 2, cy - w / 2, cx + w / 2, cy + w / 2)
    six = F.array(cx - w, cy - w, F.lit(3.0), cx + w, cy + w, F.lit(4.0))
    shifted = M.box(cx - w / 2, cy - w / 2, cx + F.when(F.col("bid") % 2 == 0, w).otherwise(w * 2), cy)
    return boxes(spark, d).select("bid", F.round(M.west(g["bbox"]), 6).alias("west"), F.round(M.north(M.bbox_or_error(g)), 6).alias("north"), M.bbox_contains(F.col("box"), inner).alias("holds"), M.bbox_contains(F.col("box"), shifted).alias("held"), M.low(six).alias("low"), F.round(M.east(six), 6).alias("east6"))


@query("bearing_signed", f"WITH p AS ({POINTS}), t AS (SELECT id, {pmod('-(' + brg(*P4) + ')')} AS t FROM p) SELECT id, round(CASE WHEN t > 180 THEN t - 360 ELSE t END, 4) AS value FROM t")
def bearing_signed(spark, d):
    return points(spark, d).select("id", F.round(M.bearing_signed(F.col("a"), F.col("b")), 4).alias("value"))


PX, PY = f"{lon_of('id')} / 2", f"{lat_of('id')} / 2"
QX, QY = f"({lon_of('id')} / 2 + 1)", f"({lat_of('id')} / 2 - 1)"


@query(
    "slice_between",
    f"WITH l AS ({LINES_SQL}), a AS (WITH {nearest_sql(PX, PY)} SELECT id, x, y, k FROM near), b AS (WITH {nearest_sql(QX, QY)} SELECT id, x, y, k FROM near) SELECT a.id, CAST(2 + abs(a.k - b.k) AS BIGINT) AS positions, round(CASE WHEN a.k <= b.k THEN a.x ELSE b.x END, 5) AS first_lon, round(CASE WHEN a.k <= b.k THEN b.y ELSE a.y END, 5) AS last_lat FROM a JOIN b USING (id)",
)
def slice_between(spark, d):
    p, q = F.array(F.expr(PX), F.expr(PY)), F.array(F.expr(QX), F.expr(QY))
    made = lines(spark, d).withColumns({"p": p, "q": q}).select("id", L.slice_between(F.col("line"), F.col("p"), F.col("q")).alias("part"))
    return made.select("id", F.size("part").cast("long").alias("positions"), F.round(G.lon(F.get("part", 0)), 5).alias("first_lon"), F.round(G.lat(F.element_at("part", -1)), 5).alias("last_lat"))


# the index


@query("index_insert", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS boxed, false AS empty, true AS cleared FROM (SELECT c_custkey FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def index_insert(spark, d):
    """A bulk load, an insertion, missing boxes filled in, and an index without rows."""
    p = points(spark, d).select("id", G.point(F.col("a")).alias("geometry"))
    index = SpatialIndex(p).insert(p.filter("id % 3 = 0"))
    rows = index.df.agg(F.count("*").alias("rows"), F.count("bbox").alias("boxed"))
    none = index.clear()
    return rows.crossJoin(spark.range(1).select(F.lit(index.is_empty()).alias("empty"), F.lit(none.size() == 0).alias("cleared")))


@query("index_contains", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0")
def index_contains(spark, d):
    """The given rows that have an equal one in the index."""
    p = points(spark, d).select("id", G.point(F.col("a")).alias("geometry"))
    index = SpatialIndex(p.filter("id % 2 = 0"))
    return index.contains(p).select("id")


@query("index_pruned", f"WITH p AS ({POINTS}) SELECT id, round(x1, 6) AS lon FROM p WHERE x1 BETWEEN 10 AND 20 AND y1 BETWEEN 10 AND 20")
def index_pruned(spark, d):
    """A box search over a table that lies clustered, where the scan prunes by the flat columns."""
    path = f"{scratch(spark)}/index"
    SpatialIndex(points(spark, d).select("id", G.point(F.col("a")).alias("geometry"))).clustered(8).write.parquet(path)
    found = SpatialIndex(spark.read.parquet(path), clustered=True).search(M.box(10, 10, 20, 20))
    return found.select("id", F.round(G.lon(G.only_position(F.col("geometry"))), 6).alias("lon"))


# units


@query("unit_values", f"WITH p AS (SELECT c_custkey AS id, {lon_of('c_custkey')} AS v FROM customer) SELECT id, round(v * 1000, 4) AS metres, round(v * 1000 / CAST(0.3048 AS DOUBLE), 4) AS feet, CAST(floor(v * 1000 / CAST(0.9144 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS yards, CAST(floor(v / CAST(0.9 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INTEGER) AS gradians, round(v * CAST(4046.8564224 AS DOUBLE) / 10000, 4) AS hectares FROM p")
def unit_values(spark, d):
    v = F.expr(lon_of("id"))
    return points(spark, d).select("id", F.round(U.to_base(v, "kilometers"), 4).alias("metres"), F.round(U.from_base(U.to_base(v, "kilometers"), "feet"), 4).alias("feet"), U.round_to_long(v * 1000, "yards").alias("yards"), U.round_to_int(v, "gradians").alias("gradians"), F.round(U.convert(v, "acres", "hectares"), 4).alias("hectares"))


@query("unit_arithmetic", f"WITH p AS (SELECT c_custkey AS id, {lon_of('c_custkey')} AS v, {lat_of('c_custkey')} AS u FROM customer) SELECT id, round(v % 7, 6) AS remainder, round(v - 7 * floor(v / 7), 6) AS modulo, v > 0 AS positive, v < 0 AS negative, v = 0 AS zero, true AS finite, false AS infinite, v < u AS shorter, round(abs(-v), 6) AS size FROM p")
def unit_arithmetic(spark, d):
    v, u = F.expr(lon_of("id")), F.expr(lat_of("id"))
    seven = F.lit(7.0)
    return points(spark, d).select("id", F.round(U.remainder(v, seven), 6).alias("remainder"), F.round(U.modulo(v, seven), 6).alias("modulo"), U.is_positive(v).alias("positive"), U.is_negative(v).alias("negative"), U.is_zero(v).alias("zero"), (U.is_finite(v) & (F.lit(U.MAX_VALUE) > v) & (F.lit(U.MIN_VALUE) > U.ZERO)).alias("finite"), U.is_infinite(v).alias("infinite"), (v < u).alias("shorter"), F.round(F.abs(-v), 6).alias("size"))


@query("unit_trig", f"WITH p AS (SELECT c_custkey AS id, {lon_of('c_custkey')} AS v, {lat_of('c_custkey')} AS u FROM customer) SELECT id, round(sin(radians(v)), 6) AS s, round(cos(radians(v)), 6) AS c, round(tan(radians(u)), 4) AS t, round(degrees(asin(u / 90)), 6) AS a, round(degrees(acos(u / 90)), 6) AS b, round(degrees(atan(v)), 6) AS d, round(degrees(atan2(v, u)), 6) AS e FROM p")
def unit_trig(spark, d):
    v, u = F.expr(lon_of("id")), F.expr(lat_of("id"))
    r = lambda x, n=6: F.round(x, n)
    return points(spark, d).select("id", r(U.sin(v)).alias("s"), r(U.cos(v)).alias("c"), r(U.tan(u), 4).alias("t"), r(U.asin(u / 90)).alias("a"), r(U.acos(u / 90)).alias("b"), r(U.atan(v)).alias("d"), r(U.atan2(v, u)).alias("e"))


@query("bearing_turns", f"WITH p AS ({POINTS}), b AS (SELECT id, {pmod('x1')} AS b, {pmod('y1 * 4')} AS o FROM p) SELECT id, round({pmod('b + 30.5')}, 5) AS turned, round({pmod('b - o')}, 5) AS between_, round({pmod('o - b')}, 5) AS clockwise, CAST(22.5 * (id % 16) AS DOUBLE) AS compass FROM b")
def bearing_turns(spark, d):
    b, o = U.bearing_of(F.col("x1")), U.bearing_of(F.col("y1") * 4)
    names = list(U.COMPASS)
    at = F.element_at(F.array(*[F.lit(U.COMPASS[n]) for n in names]), (F.col("id") % 16 + 1).cast("int"))
    return points(spark, d).select("id", F.round(U.bearing_plus(b, F.lit(30.5)), 5).alias("turned"), F.round(U.bearing_minus(b, o), 5).alias("between_"), F.round(U.clockwise_rotation(b, o), 5).alias("clockwise"), at.alias("compass"))


@query("unit_text", "SELECT c_custkey AS id, printf('%.2f', floor(c_custkey / CAST(1609.344 AS DOUBLE) * 100 + CAST(0.5 AS DOUBLE)) / 100) || ' mi' AS miles, c_custkey || '.0°' AS degrees, (c_custkey // 2) || '° ' || CASE WHEN c_custkey % 2 = 1 THEN '30' ELSE '0' END || '′ 0.00″' AS dms FROM customer")
def unit_text(spark, d):
    v = F.col("id").cast("double")
    return points(spark, d).select("id", U.format_unit(v, "miles").alias("miles"), U.format_unit(v, "degrees", 1).alias("degrees"), U.format_dms(v / 2).alias("dms"))


ANGLE = "CASE WHEN b < 90 THEN b WHEN b = 90 THEN 90 WHEN b <= 180 THEN 180 - b WHEN b < 270 THEN b - 180 ELSE 360 - b END"


@query("bearing_text", f"WITH p AS (SELECT c_custkey AS id, CAST(c_custkey * 7 % 720 AS DOUBLE) / 2 AS b FROM customer), a AS (SELECT *, {ANGLE} AS a FROM p) SELECT id, CASE WHEN b < 90 OR b > 270 THEN 'N' ELSE 'S' END || ' ' || printf('%.2f', a) || '° ' || CASE WHEN b <= 180 THEN 'E' ELSE 'W' END AS text, CASE WHEN b < 90 OR b > 270 THEN 'N' ELSE 'S' END || ' ' || CAST(floor(a) AS INTEGER) || '° ' || CASE WHEN a > floor(a) THEN '30' ELSE '0' END || '′ 0.00″ ' || CASE WHEN b <= 180 THEN 'E' ELSE 'W' END AS dms FROM a")
def bearing_text(spark, d):
    b = (F.col("id") * 7 % 720).cast("double") / 2
    return points(spark, d).select("id", U.format_bearing(b).alias("text"), U.format_bearing_dms(b).alias("dms"))


@query("custom_units", "SELECT c_custkey AS id, round(c_custkey / CAST(1.7 AS DOUBLE), 6) AS paces, round(c_custkey / (CAST(1.7 AS DOUBLE) * CAST(0.3048 AS DOUBLE)), 6) AS plots, round(c_custkey / (radians(CAST(1 AS DOUBLE)) * CAST(1737400.0 AS DOUBLE)), 8) AS moon_degrees FROM customer")
def custom_units(spark, d):
    """A length of the caller's, its product with another, and degrees of another world."""
    pace, moon = U.Unit("length", 1.7, "pc"), U.World(1737400.0, 1737400.0)
    v = F.col("id").cast("double")
    return points(spark, d).select("id", F.round(U.from_base(v, pace), 6).alias("paces"), F.round(U.from_base(v, pace * U.LENGTHS["feet"]), 6).alias("plots"), F.round(U.from_base(v, U.ROTATIONS["degrees"].on(moon)), 8).alias("moon_degrees"))


@query("sql_names", f"WITH b AS ({BOXES}), r AS (SELECT *, {RING} AS ring FROM b) SELECT bid, round({hav('cx', 'cy', '(cx + w)', '(cy + w)')} / 1000, 3) AS km, round({AREA} / 1000000, 2) AS km2, true AS holds, false AS outside, round(cx - w, 6) AS west, CAST(5 AS BIGINT) AS tile, 'Point' AS type FROM r")
def sql_names(spark, d):
    """The functions by their SQL names."""
    sql.register(spark)
    b = boxes(spark, d)
    return spark.sql(
        "SELECT bid, round(st_distance_lonlat(cx, cy, cx + w, cy + w) / 1000, 3) AS km, round(st_area(polygon) / 1000000, 2) AS km2, st_contains(polygon, cx, cy) AS holds, st_contains(polygon, cx + 2 * w, cy) AS outside, "
        "round(st_bbox(polygon)[0], 6) AS west, st_tile_id(2, 0L, 0L) AS tile, st_type(st_point(cx, cy)) AS type FROM {b}", b=b,
    )
