"""Point in polygon."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import lat, lon
from .measure import east, north, south, west


def in_ring(p: Column, ring: Column, ignore_boundary: bool | Column = False) -> Column:
    """Even-odd test of a ring; a position exactly on an edge counts unless it is ignored."""
    last = F.element_at(ring, -1)
    closed = (F.size(ring) > 0) & (lon(F.get(ring, 0)) == lon(last)) & (lat(F.get(ring, 0)) == lat(last))
    n = F.size(ring) - F.when(closed, 1).otherwise(0)
    open_ = F.slice(ring, 1, F.greatest(n, F.lit(0)))
    before = F.when(n > 0, F.concat(F.slice(open_, n, 1), F.slice(open_, 1, F.greatest(n - 1, F.lit(0))))).otherwise(open_)
    x, y = lon(p), lat(p)

    def edge(i: Column, j: Column) -> Column:
        xi, yi, xj, yj = lon(i), lat(i), lon(j), lat(j)
        level = (yi == y) & (yj == y)  # the products of a level edge needn't add up to zero
        on = (level | (y * (xi - xj) + yi * (xj - x) + yj * (x - xi) == 0)) & ((xi - x) * (xj - x) <= 0) & ((yi - y) * (yj - y) <= 0)
        cross = ((yi > y) != (yj > y)) & (x < (xj - xi) * (y - yi) / F.when(yj != yi, yj - yi) + xi)
        return F.struct(on.alias("on"), F.coalesce(cross, F.lit(False)).alias("cross"))

    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("on"))
    step = lambda s, e: F.struct((s["inside"] != e["cross"]).alias("inside"), (s["on"] | e["on"]).alias("on"))
    ignored = ignore_boundary if isinstance(ignore_boundary, Column) else F.lit(ignore_boundary)
    return F.aggregate(F.zip_with(open_, before, edge), start, step, lambda s: F.when(s["on"], ~ignored).otherwise(s["inside"]))


def contains(g: Column, p: Column, ignore_boundary: bool = False) -> Column:
    """Whether a polygon or multi-polygon holds a position, holes left out.

    A stored bbox is trusted as a first test. On the boundary, of a hole too, a position is
    inside unless ``ignore_boundary``.
    """
    boxed = g["bbox"].isNull() | ((west(g["bbox"]) <= lon(p)) & (south(g["bbox"]) <= lat(p)) & (east(g["bbox"]) >= lon(p)) & (north(g["bbox"]) >= lat(p)))
    hit = lambda rings: in_ring(p, F.get(rings, 0), ignore_boundary) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings), F.lit(1))), lambda hole: in_ring(p, hole, not ignore_boundary))
    return F.when(g.isNotNull() & p.isNotNull(), boxed & F.exists(g["parts"], lambda rings: (F.size(rings) > 0) & hit(rings)))
