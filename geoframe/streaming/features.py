"""Streams of newline-delimited GeoJSON; all column functions are stateless and work on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoframe.functions import measure as M
from geoframe.sources.geojson import decode_documents


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Features of the files that arrive in a folder."""
    return decode_documents(spark.readStream.text(path).filter(F.trim("value") != ""), "value")


def geofence(features: DataFrame, box: Column, geometry: str = "geometry") -> DataFrame:
    """Features whose box meets a fence."""
    return features.filter(M.bboxes_intersect(M.bbox_or_computed(F.col(geometry)), box))
