"""GPX documents: readers over the built-in XML source, features, and documents as text.

Unknown children are ignored; times without a zone are UTC, so the session's zone should be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoframe.functions.geometry import point, position

LINK = "struct<_href:string,text:string,type:string>"
# fixed values: the elements of a waypoint in the order of the format
POINT_FIELDS = (
    "ele:double,time:string,magvar:double,geoidheight:double,name:string,cmt:string,desc:string,src:string,"
    f"link:{LINK},sym:string,type:string,fix:string,sat:int,hdop:double,vdop:double,pdop:double,ageofdgpsdata:double,dgpsid:double"
)
POINT = f"struct<_lat:double,_lon:double,{POINT_FIELDS}>"
HEAD = f"name:string,cmt:string,desc:string,src:string,link:{LINK},number:int,type:string"
SCHEMAS = {
    "wpt": POINT,
    "rte": f"struct<{HEAD},rtept:array<{POINT}>>",
    "trk": f"struct<{HEAD},trkseg:array<struct<trkpt:array<{POINT}>>>>",
    "metadata": f"struct<name:string,desc:string,author:struct<name:string,email:struct<_id:string,_domain:string>,link:{LINK}>,copyright:struct<_author:string,year:int,license:string>,"
    f"link:{LINK},time:string,keywords:string,bounds:struct<_minlat:double,_minlon:double,_maxlat:double,_maxlon:double>>",
}
DEFAULT_CREATOR = "geoframe"


def schema(tag: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[tag]) if hasattr(T, "_parse_datatype_string") else T.DataType.fromDDL(SCHEMAS[tag])


def read(spark: SparkSession, path: str, tag: str = "wpt") -> DataFrame:
    """Rows of one kind of element: wpt, rte, trk or metadata."""
    return spark.read.format("xml").schema(schema(tag)).option("rowTag", tag).load(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(creator, version) of each document, with the defaults where they aren't told."""
    told = spark.read.format("xml").schema("_creator string, _version string, metadata " + SCHEMAS["metadata"]).option("rowTag", "gpx").load(path)
    return told.select(F.coalesce("_creator", F.lit(DEFAULT_CREATOR)).alias("creator"), F.coalesce("_version", F.lit("1.1")).alias("version"), "metadata")


def time_of(text: Column) -> Column:
    return F.try_to_timestamp(text)


def waypoint_geometry(w: Column) -> Column:
    return point(position(w["_lon"], w["_lat"], w["ele"]))


def waypoint_features(df: DataFrame) -> DataFrame:
    """A point a waypoint, with the waypoint as properties."""
    row = F.struct(*df.columns)
    return df.select(waypoint_geometry(row).alias("geometry"), F.to_json(row).alias("properties"))


def route_features(df: DataFrame) -> DataFrame:
    """A feature a route, with its points in order as ``geometries``."""
    return df.select(F.transform(F.coalesce("rtept", F.array().cast(f"array<{POINT}>")), waypoint_geometry).alias("geometries"), F.to_json(F.struct(*df.columns)).alias("properties"))


def segment_geometries(segment: Column) -> Column:
    return F.transform(F.coalesce(segment["trkpt"], F.array().cast(f"array<{POINT}>")), waypoint_geometry)


def track_features(df: DataFrame) -> DataFrame:
    """A feature a track, with the points of all segments in order as ``geometries``."""
    return df.select(F.flatten(F.transform(F.coalesce("trkseg", F.array().cast(f"array<struct<trkpt:array<{POINT}>>>")), segment_geometries)).alias("geometries"), F.to_json(F.struct(*df.columns)).alias("properties"))


# writing


def _escape(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def _element(tag: str, c: Column, pad: str) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit(f"{pad}<{tag}>"), _escape(c.cast("string")), F.lit(f"</{tag}>\n"))).otherwise("")


def encode_point(w: Column, tag: str = "wpt", pad: str = "    ") -> Column:
    """A waypoint struct, with all or some of the fields of POINT, as an element."""
    names = [x.split(":")[0] for x in POINT_FIELDS.replace(LINK, "link").split(",")]
    parts = []
    for name in names:
        parts.append(_link(w["link"], pad * 2) if name == "link" else _element(name, w[name], pad * 2))
    return F.concat(F.lit(f'{pad}<{tag} lat="'), w["_lat"].cast("string"), F.lit('" lon="'), w["_lon"].cast("string"), F.lit('">\n'), *parts, F.lit(f"{pad}</{tag}>\n"))


def _link(link: Column, pad: str) -> Column:
    inner = F.concat(_element("text", link["text"], pad + "    "), _element("type", link["type"], pad + "    "))
    return F.when(link.isNotNull(), F.concat(F.lit(f'{pad}<link href="'), _escape(F.coalesce(link["_href"], F.lit(""))), F.lit('">\n'), inner, F.lit(f"{pad}</link>\n"))).otherwise("")


def _head(w: Column, pad: str) -> Column:
    """What routes and tracks begin with, in the order of the format."""
    return F.concat(*[_link(w["link"], pad) if n == "link" else _element(n, w[n], pad) for n in ("name", "cmt", "desc", "src", "link", "number", "type")])


def encode_metadata(m: Column, pad: str = "    ") -> Column:
    """A struct of the fields of SCHEMAS["metadata"] as an element; empty for null."""
    two, three = pad * 2, pad * 3
    author, mail, rights, box = m["author"], m["author"]["email"], m["copyright"], m["bounds"]
    email = F.when(mail.isNotNull(), F.concat(F.lit(f'{three}<email id="'), _escape(F.coalesce(mail["_id"], F.lit(""))), F.lit('" domain="'), _escape(F.coalesce(mail["_domain"], F.lit(""))), F.lit('"/>\n'))).otherwise("")
    who = F.when(author.isNotNull(), F.concat(F.lit(f"{two}<author>\n"), _element("name", author["name"], three), email, _link(author["link"], three), F.lit(f"{two}</author>\n"))).otherwise("")
    owned = F.concat(F.lit(f'{two}<copyright author="'), _escape(F.coalesce(rights["_author"], F.lit(""))), F.lit('">\n'), _element("year", rights["year"], three), _element("license", rights["license"], three), F.lit(f"{two}</copyright>\n"))
    edge = lambda k: F.concat(F.lit(f'{k}="'), F.coalesce(box[f"_{k}"].cast("string"), F.lit("")), F.lit('"'))
    bounds = F.concat(F.lit(f"{two}<bounds "), F.concat_ws(" ", *map(edge, ("minlat", "minlon", "maxlat", "maxlon"))), F.lit("/>\n"))
    parts = [
        _element("name", m["name"], two), _element("desc", m["desc"], two), who, F.when(rights.isNotNull(), owned).otherwise(""), _link(m["link"], two),
        _element("time", m["time"], two), _element("keywords", m["keywords"], two), F.when(box.isNotNull(), bounds).otherwise(""),
    ]
    return F.when(m.isNotNull(), F.concat(F.lit(f"{pad}<metadata>\n"), *parts, F.lit(f"{pad}</metadata>\n"))).otherwise("")


def _each(items: Column, f) -> Column:
    """The texts of an array's elements; empty for a null array."""
    return F.coalesce(F.array_join(F.transform(items, f), ""), F.lit(""))


def encode_route(r: Column, pad: str = "    ") -> Column:
    return F.concat(F.lit(f"{pad}<rte>\n"), _head(r, pad * 2), _each(r["rtept"], lambda w: encode_point(w, "rtept", pad)), F.lit(f"{pad}</rte>\n"))


def encode_track(t: Column, pad: str = "    ") -> Column:
    segment = lambda s: F.concat(F.lit(f"{pad * 2}<trkseg>\n"), _each(s["trkpt"], lambda w: encode_point(w, "trkpt", pad)), F.lit(f"{pad * 2}</trkseg>\n"))
    return F.concat(F.lit(f"{pad}<trk>\n"), _head(t, pad * 2), _each(t["trkseg"], segment), F.lit(f"{pad}</trk>\n"))


def document(elements: Column, creator: str | Column = DEFAULT_CREATOR, metadata: Column | None = None) -> Column:
    """A document around the text of its elements, its metadata first; null elements count as none."""
    head = F.lit("") if metadata is None else encode_metadata(metadata)
    own = _escape(creator if isinstance(creator, Column) else F.lit(creator))
    start = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<gpx xmlns="http://www.topografix.com/GPX/1/1" version="1.1" creator="'), own, F.lit('">\n'))
    return F.concat(start, head, F.coalesce(elements, F.lit("")), F.lit("</gpx>\n"))
