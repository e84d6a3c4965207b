"""GeoJSON as expressions over JSON text, and readers of documents and of lines.

Unknown keys are ignored. A decoded feature is a struct of geometry, properties (JSON text), id
(its JSON literal, so that "1" and 1 differ), bbox and geometries: the last holds the members
of a geometry collection, in place of a geometry. The members of nested collections come in
their place, down to NESTED levels; deeper ones are malformed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoframe.functions.geometry import coordinates, let, lines_of, make
from geoframe.schema import BBOX, GEOMETRY, GEOMETRY_DDL, is_valid, is_valid_bbox

FEATURE_DDL = f"struct<geometry:{GEOMETRY_DDL},properties:string,id:string,bbox:array<double>,geometries:array<{GEOMETRY_DDL}>>"
MEMBERS = "type string, geometry struct<type:string,coordinates:string,geometries:string,bbox:string>, properties string, id string, bbox string"
NESTED = 8  # levels of geometry collections inside each other
KINDS = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection", "Feature", "FeatureCollection")


def _error(text: str, kind) -> Column:
    return F.raise_error(F.lit(text)).cast(kind)


def kind_of(j: Column) -> Column:
    """The type of a GeoJSON object; null for other JSON."""
    kind = F.get_json_object(j, "$.type")
    return F.when(kind.isin(*KINDS), kind)


def position_or_null(j: Column) -> Column:
    p = F.from_json(j, "array<double>")
    return F.when((F.size(p) >= 2) & F.forall(p, lambda x: x.isNotNull()), p)


def bbox_or_null(j: Column) -> Column:
    b = F.from_json(j, "array<double>")
    return F.when(is_valid_bbox(b), b)


def _geometry_of(s: Column, kind: str | None) -> Column:
    """A geometry of a struct of its members' texts, each of which is parsed once."""
    own = s["type"]
    nested = lambda depth: F.from_json(s["coordinates"], "array<" * depth + "double" + ">" * depth)
    parts = (
        F.when(own == "Point", F.array(F.array(F.array(nested(1)))))
        .when(own.isin("MultiPoint", "LineString"), F.array(F.array(nested(2))))
        .when(own.isin("MultiLineString", "Polygon"), F.array(nested(3)))
        .when(own == "MultiPolygon", nested(4))
    )
    right = F.lit(True) if kind is None else own == kind
    made = let(parts, lambda x: make(own, x, F.from_json(s["bbox"], BBOX)))
    return let(made, lambda g: F.when(right & F.coalesce(is_valid(g), F.lit(False)) & (s["bbox"].isNull() | g["bbox"].isNotNull()), g))


def geometry_or_null(j: Column, kind: str | None = None) -> Column:
    """A geometry other than a collection; null where it is malformed, invalid or of another type."""
    return let(F.from_json(j, "type string, coordinates string, bbox string"), lambda s: _geometry_of(s, kind))


def geometry(j: Column, kind: str | None = None) -> Column:
    """As geometry_or_null, with an error in place of null for JSON that isn't one."""
    return let(geometry_or_null(j, kind), lambda g: F.when(j.isNull() | g.isNotNull(), g).otherwise(_error(f"not a valid {kind or 'geometry'}", GEOMETRY)))


def _children(text: Column) -> Column:
    """The geometries of a JSON array, those of nested collections in their place; null if one is malformed."""
    nested = lambda x: F.coalesce(F.get_json_object(x, "$.type") == "GeometryCollection", F.lit(False))
    inner = lambda x: F.when(nested(x), F.from_json(F.get_json_object(x, "$.geometries"), "array<string>")).otherwise(F.array(x))

    def level(items: Column, _) -> Column:
        return F.when(F.exists(items, nested), F.flatten(F.transform(items, inner))).otherwise(items)

    items = F.aggregate(F.sequence(F.lit(2), F.lit(NESTED)), F.from_json(text, "array<string>"), level)
    made = F.transform(items, lambda x: geometry_or_null(x))
    return let(made, lambda gs: F.when(F.forall(gs, lambda g: g.isNotNull()), gs))


def geometries(j: Column) -> Column:
    """The geometries of a collection, those of nested ones in their place; null if malformed."""
    return F.when(F.get_json_object(j, "$.type") == "GeometryCollection", _children(F.get_json_object(j, "$.geometries")))


def feature_or_null(j: Column) -> Column:
    """A feature; null where it is malformed. ``geometry`` must be there, if only as null."""

    def made(f: Column) -> Column:
        # The literal of an id, and whether a null geometry is there, take a second look at the text.
        id_ = F.when(f["id"].isNotNull(), F.to_json(F.try_variant_get(F.try_parse_json(j), "$.id", "variant")))
        many = f["geometry"]["type"] == "GeometryCollection"
        one = F.when(f["geometry"].isNotNull() & ~F.coalesce(many, F.lit(False)), _geometry_of(f["geometry"], None))
        found = F.struct(
            one.alias("geometry"), f["properties"].alias("properties"), id_.alias("id"), F.from_json(f["bbox"], BBOX).alias("bbox"),
            F.when(many, _children(f["geometry"]["geometries"])).alias("geometries"),
        )

        def checked(x: Column) -> Column:
            told_null = F.array_contains(F.json_object_keys(j), "geometry") & F.get_json_object(j, "$.geometry").isNull()
            there = F.when(f["geometry"].isNotNull(), x["geometry"].isNotNull() | x["geometries"].isNotNull()).otherwise(told_null)
            good_id = x["id"].isNull() | x["id"].startswith('"') | x["id"].rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")
            good = (f["type"] == "Feature") & there & good_id & (x["properties"].isNull() | x["properties"].startswith("{"))
            return F.when(F.coalesce(good, F.lit(False)), x).cast(FEATURE_DDL)

        return let(found, checked)

    return let(F.from_json(j, MEMBERS), made)


def feature(j: Column) -> Column:
    return let(feature_or_null(j), lambda f: F.when(j.isNull() | f.isNotNull(), f).otherwise(_error("not a valid Feature", FEATURE_DDL)))


def collection_features(j: Column) -> Column:
    """The features of a collection as JSON texts; ``features`` is mandatory."""
    items = F.from_json(F.get_json_object(j, "$.features"), "array<string>")
    return F.when((F.get_json_object(j, "$.type") == "FeatureCollection") & items.isNotNull(), items).otherwise(F.when(j.isNotNull(), _error("not a valid FeatureCollection", "array<string>")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Features of whole-file GeoJSON documents: collections, single features or bare geometries."""
    return decode_documents(spark.read.text(path, wholetext=True), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Features of newline-delimited GeoJSON, which splits across tasks."""
    return decode_documents(spark.read.text(path).filter(F.trim("value") != ""), "value")


def decode_documents(df: DataFrame, col: str) -> DataFrame:
    j = F.col(col)
    kind = F.get_json_object(j, "$.type")
    bare = lambda g: F.concat(F.lit('{"type":"Feature","geometry":'), g, F.lit("}"))
    items = F.when(kind == "FeatureCollection", collection_features(j)).when(kind == "Feature", F.array(j)).when(kind == "GeometryCollection", F.transform(F.from_json(F.get_json_object(j, "$.geometries"), "array<string>"), bare)).otherwise(F.array(bare(j)))
    return df.select(F.explode(items).alias("__j")).select(feature(F.col("__j")).alias("f")).select("f.*")


def feature_of(geometry_: Column, properties: Column | None = None, id_: Column | None = None, bbox: Column | None = None, geometries: Column | None = None) -> Column:
    """A feature struct of its members. ``id_`` is a column of strings or numbers and becomes its JSON literal."""
    none = lambda c, kind: F.lit(None).cast(kind) if c is None else c.cast(kind)
    return F.struct(
        none(geometry_, GEOMETRY).alias("geometry"), none(properties, "string").alias("properties"), none(None if id_ is None else id_literal(id_), "string").alias("id"),
        none(bbox, BBOX).alias("bbox"), none(geometries, f"array<{GEOMETRY_DDL}>").alias("geometries"),
    )


def id_literal(id_: Column) -> Column:
    """A string or number as the JSON literal that ids are kept as; null for null."""
    text = F.to_json(F.array(id_))
    return F.when(id_.isNotNull(), F.substring(text, F.lit(2), F.length(text) - 2))


# encoding


def encode_geometry(g: Column) -> Column:
    """{"type", "bbox"?, "coordinates"}."""
    kind = g["type"]
    text = (
        F.when(kind == "Point", F.to_json(F.get(coordinates(g), 0)))
        .when(kind.isin("MultiPoint", "LineString"), F.to_json(F.get(lines_of(g), 0)))
        .when(kind.isin("MultiLineString", "Polygon"), F.to_json(F.get(g["parts"], 0)))
        .otherwise(F.to_json(g["parts"]))
    )
    box = F.when(g["bbox"].isNotNull(), F.concat(F.lit(',"bbox":'), F.to_json(g["bbox"]))).otherwise("")
    return F.concat(F.lit('{"type":"'), kind, F.lit('"'), box, F.lit(',"coordinates":'), F.coalesce(text, F.lit("[]")), F.lit("}"))


def encode_geometries(gs: Column) -> Column:
    return F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(F.transform(gs, encode_geometry), ","), F.lit("]}"))


def encode_feature(geometry_: Column, properties: Column | None = None, id_: Column | None = None, bbox: Column | None = None, geometries: Column | None = None) -> Column:
    """{"type", "geometry", "properties", "id"?, "bbox"?}; ``properties`` is JSON text or a struct's to_json.

    Where the geometry is null, ``geometries`` are written as a collection.
    """
    optional = lambda key, c: F.lit("") if c is None else F.when(c.isNotNull(), F.concat(F.lit(f',"{key}":'), c)).otherwise("")
    collected = [] if geometries is None else [encode_geometries(geometries)]
    body = F.coalesce(encode_geometry(geometry_), *collected, F.lit("null"))
    props = F.lit("null") if properties is None else F.coalesce(properties, F.lit("null"))
    return F.concat(F.lit('{"type":"Feature","geometry":'), body, F.lit(',"properties":'), props, optional("id", id_), optional("bbox", None if bbox is None else F.to_json(bbox)), F.lit("}"))


def encode_collection(features: Column) -> Column:
    """Aggregate: a FeatureCollection of feature texts. For one document; write lines for many rows."""
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), F.coalesce(F.listagg(features, F.lit(",")), F.lit("")), F.lit("]}"))


def write_lines(df: DataFrame, path: str) -> None:
    """Newline-delimited features, one file a partition."""
    at = {c: F.col(c) if c in df.columns else None for c in ("properties", "id", "bbox", "geometries")}
    geometry_ = F.col("geometry") if "geometry" in df.columns else F.lit(None).cast(GEOMETRY)
    df.select(encode_feature(geometry_, at["properties"], at["id"], at["bbox"], at["geometries"]).alias("value")).write.text(path)
