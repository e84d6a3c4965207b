"""Operators over feature and geometry collections, which are DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from geoframe.functions import measure as M
from geoframe.functions.geometry import lines_of, make, only_line, only_position


def map_geometry(df: DataFrame, f: Callable[[Column], Column], geometry: str = "geometry", bbox: str = "bbox") -> DataFrame:
    """Apply a function to each geometry; a feature's bbox, where it has one, follows."""
    made = df.withColumn(geometry, f(F.col(geometry)))
    if bbox not in df.columns:
        return made
    return made.withColumn(bbox, F.when(F.col(bbox).isNotNull(), F.coalesce(M.compute_bbox(F.col(geometry)), F.col(bbox))))


def map_properties(df: DataFrame, f: Callable[[Column], Column], properties: str = "properties") -> DataFrame:
    return df.withColumn(properties, f(F.col(properties)))


def combine(df: DataFrame, geometry: str = "geometry", by: list[str] | None = None) -> DataFrame:
    """One MultiPoint, MultiLineString and MultiPolygon of the single geometries of each group.

    The three columns are there even where empty. For groups that fit a row; members are in the
    order of their parts.
    """
    g = F.col(geometry)
    of = lambda kind, value: F.array_sort(F.collect_list(F.when(g["type"] == kind, value)))
    return df.groupBy(*(by or [])).agg(
        make("MultiPoint", F.array(F.array(of("Point", only_position(g))))).alias("points"),
        make("MultiLineString", F.array(of("LineString", only_line(g)))).alias("lines"),
        make("MultiPolygon", of("Polygon", lines_of(g))).alias("polygons"),
    )


def to_geometries(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """The geometries that aren't null."""
    return df.filter(F.col(geometry).isNotNull()).select(geometry)


def to_features(df: DataFrame, properties: Callable[[Column], Column], geometry: str = "geometry") -> DataFrame:
    """A feature a geometry."""
    return df.select(F.col(geometry), properties(F.col(geometry)).alias("properties"))


def total_bbox(df: DataFrame, geometry: str = "geometry", by: list[str] | None = None) -> DataFrame:
    """The box of all geometries of each group."""
    boxed = df.withColumn("__b", M.compute_bbox(F.col(geometry)))
    b = F.col("__b")
    return boxed.groupBy(*(by or [])).agg(F.array(F.min(M.west(b)), F.min(M.south(b)), F.max(M.east(b)), F.max(M.north(b))).alias("bbox"))


def coalesce_islands(df: DataFrame, by: str, offset: str = "offset", length: str = "length", gap: int = 0, most: int | None = None, span: int = 1 << 26) -> DataFrame:
    """(by, offset, length, ranges): byte ranges of each archive joined where at most ``gap`` bytes lie between them.

    Ranges are looked at within stretches of ``span`` bytes; how far the stretches before reach,
    and where the last joined range began, is told by one row a stretch, so that a large archive
    isn't one task. With ``most``, a joined range has at most so many bytes (0 joins none, and a
    longer single range stays); then each archive's ranges are walked in order by one task that
    holds one range.
    """
    end = F.col("at") + F.col("size")
    rows = df.select(F.col(by).alias("k"), F.col(offset).cast("long").alias("at"), F.col(length).cast("long").alias("size")).withColumn("part", F.floor(F.col("at") / span))
    if most is not None:
        return _capped(rows, gap, most).withColumnsRenamed({"k": by, "at": offset, "size": length})
    parts = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    ends = rows.groupBy("k", "part").agg(F.max(end).alias("end")).select("k", "part", F.max("end").over(parts).alias("before"))
    own = Window.partitionBy("k", "part").orderBy("at", "size")
    reach = F.greatest(F.col("before"), F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    marked = rows.join(ends, ["k", "part"]).withColumn("new", F.when(reach.isNull() | (F.col("at") - reach > gap), F.col("at")))
    begun = marked.withColumn("start", F.last("new", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    lasts = marked.groupBy("k", "part").agg(F.max("new").alias("new")).select("k", "part", F.last("new", ignorenulls=True).over(parts).alias("carried"))
    whole = begun.join(lasts, ["k", "part"]).withColumn("start", F.coalesce("start", "carried"))
    made = whole.groupBy(F.col("k").alias(by), "start").agg(F.min("at").alias(offset), (F.max(end) - F.min("at")).alias(length), F.count("*").alias("ranges"))
    return made.drop("start")


def _capped(rows: DataFrame, gap: int, most: int) -> DataFrame:
    kind = rows.schema["k"].dataType

    kind_of = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # archive, offset, end, ranges
        for batch in batches:
            out = []
            for k, at, size in zip(*(c.to_pylist() for c in batch.columns)):
                if held and most and k == held[0] and at - held[2] <= gap and max(at + size, held[2]) - held[1] <= most:
                    held = [k, held[1], max(at + size, held[2]), held[3] + 1]
                    continue
                if held:
                    out.append(held)
                held = [k, at, at + size, 1]
            yield batch_of(out, kind_of)
        if held:
            yield batch_of([held], kind_of)

    def batch_of(out, own):
        k, at, end, n = zip(*out) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(k, own), pa.array(at, pa.int64()), pa.array([e - a for a, e in zip(at, end)], pa.int64()), pa.array(n, pa.int64())], names=["k", "at", "size", "ranges"])

    schema = T.StructType([T.StructField("k", kind), *[T.StructField(n, T.LongType()) for n in ("at", "size", "ranges")]])
    return rows.select("k", "at", "size").repartition("k").sortWithinPartitions("k", "at", "size").mapInArrow(run, schema)
