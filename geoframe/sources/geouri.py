"""geo: URIs, latitude first, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoframe.functions.geometry import alt, lat, lon, only_position, point, position
from geoframe.schema import GEOMETRY

NUMBER = r"-?\d+(?:\.\d+)?"
PATTERN = rf"^(?i:geo):({NUMBER}),({NUMBER})(?:,({NUMBER}))?((?:;.*)?)$"


def parse_or_null(uri: Column) -> Column:
    """A Point; null for a malformed URI, a crs other than wgs84 or an uncertainty other than 0."""
    part = lambda k: F.when(F.regexp_extract(uri, PATTERN, k) != "", F.regexp_extract(uri, PATTERN, k).cast("double"))
    params = F.filter(F.split(F.regexp_extract(uri, PATTERN, 4), ";"), lambda x: x != "")
    ok = lambda x: F.when(F.lower(F.substring_index(x, "=", 1)) == "crs", F.lower(F.substring_index(x, "=", -1)) == "wgs84").when(F.lower(F.substring_index(x, "=", 1)) == "u", F.coalesce(F.substring_index(x, "=", -1).try_cast("double") == 0, F.lit(False))).otherwise(F.lit(True))
    return F.when(F.regexp_like(uri, F.lit(PATTERN)) & F.forall(params, ok), point(position(part(2), part(1), part(3))))


def parse(uri: Column) -> Column:
    got = parse_or_null(uri)
    return F.when(uri.isNull() | got.isNotNull(), got).otherwise(F.raise_error(F.concat(F.lit("malformed geo URI: "), uri)).cast(GEOMETRY))


def format_uri(g: Column) -> Column:
    """geo:lat,lon[,alt] of a Point."""
    p = only_position(g)
    return F.concat(F.lit("geo:"), F.concat_ws(",", lat(p).cast("string"), lon(p).cast("string"), alt(p).cast("string")))
