"""What a mutable spatial index offers, over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.functions import measure as M
from geoframe.functions.geometry import lat, lon, only_position

from .join import CELL, boxes_intersect


class SpatialIndex:
    """An immutable collection of rows with a geometry; each change gives a new one.

    ``clustered`` says that the rows have their boxes as columns west, south, east and north too,
    as ``clustered`` writes them; a search then filters those, which a scan can prune by.
    """

    def __init__(self, df: DataFrame, geometry: str = "geometry", bbox: str = "bbox", clustered: bool = False):
        self.geometry, self.bbox, self.flat = geometry, bbox, clustered
        own = F.col(bbox) if bbox in df.columns else F.lit(None).cast("array<double>")
        self.df = df.withColumn(bbox, F.coalesce(own, M.bbox_or_computed(F.col(geometry))))

    def _with(self, df: DataFrame) -> SpatialIndex:
        return SpatialIndex(df, self.geometry, self.bbox)

    def insert(self, rows: DataFrame) -> SpatialIndex:
        return self._with(self.df.unionByName(self._with(rows).df))

    def remove(self, rows: DataFrame) -> SpatialIndex:
        """Without one equal row for each given row."""
        return self._with(self.df.exceptAll(self._with(rows).df.select(*self.df.columns)))

    def remove_by_key(self, rows: DataFrame, key: str) -> SpatialIndex:
        return self._with(self.df.join(rows.select(key).distinct(), key, "left_anti"))

    def clear(self) -> SpatialIndex:
        return self._with(self.df.limit(0))

    def size(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def search(self, box: Column) -> DataFrame:
        """Rows whose box meets the given one, edges included."""
        if self.flat:
            return self.df.filter((F.col("west") <= M.east(box)) & (F.col("south") <= M.north(box)) & (F.col("east") >= M.west(box)) & (F.col("north") >= M.south(box)))
        return self.df.filter(M.bboxes_intersect(F.col(self.bbox), box))

    def search_all(self, boxes: DataFrame, box: str = "bbox") -> DataFrame:
        """Pairs of a query row and a row of the index, for a table of boxes."""
        return boxes_intersect(boxes, self.df, box, self.bbox)

    def collides(self, box: Column) -> bool:
        return not self.search(box).limit(1).isEmpty()

    def contains(self, rows: DataFrame) -> DataFrame:
        """The given rows that have an equal row here."""
        given = self._with(rows).df.select(*self.df.columns)
        same = [given[c].eqNullSafe(self.df[c]) for c in self.df.columns]
        condition = same[0]
        for c in same[1:]:
            condition &= c
        return given.join(self.df, condition, "left_semi")

    def contains_all(self, rows: DataFrame) -> bool:
        return self.contains(rows).count() == rows.count()

    def clustered(self, partitions: int, cell: float = CELL * 16) -> DataFrame:
        """Rows near each other in the same files, with west, south, east and north on top level,
        so that a reader's minimum and maximum statistics prune a box search; read them back as
        ``SpatialIndex(df, clustered=True)``."""
        b = F.col(self.bbox)
        flat = self.df.withColumns({"west": M.west(b), "south": M.south(b), "east": M.east(b), "north": M.north(b)})
        place = [F.floor(F.col("west") / cell), F.floor(F.col("south") / cell)]
        return flat.repartitionByRange(partitions, *place).sortWithinPartitions(*place)


def point_boxes(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    p = only_position(F.col(geometry))
    return df.withColumn("bbox", M.box(lon(p), lat(p), lon(p), lat(p)))
