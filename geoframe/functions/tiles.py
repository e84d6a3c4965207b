"""Tile ids: a Hilbert order of the tiles of each zoom, after those of all lower zooms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .geometry import let

MAX_ZOOM = 31


def zoom_start(z: Column) -> Column:
    """The first id of a zoom: (4^z - 1) / 3."""
    return F.call_function("div", _two(z.cast("int") * 2) - 1, F.lit(3).cast("long"))


def _two(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def tile_id(z: Column, x: Column, y: Column) -> Column:
    """The id of a tile; an error outside zooms 0 to 31 or the zoom's range."""
    z, x, y = z.cast("int"), x.cast("long"), y.cast("long")
    start = F.struct(x.alias("x"), y.alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, k: Column) -> Column:
        scale = _two(k)
        rx = (s["x"].bitwiseAND(scale) != 0).cast("long")
        ry = (s["y"].bitwiseAND(scale) != 0).cast("long")
        d = s["d"] + scale * scale * (rx * 3).bitwiseXOR(ry)
        fx, fy = F.when(rx == 1, scale - 1 - s["x"]).otherwise(s["x"]), F.when(rx == 1, scale - 1 - s["y"]).otherwise(s["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(s["x"]).alias("x"), F.when(ry == 0, fx).otherwise(s["y"]).alias("y"), d.alias("d"))

    steps = F.when(z > 0, F.sequence(z - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    valid = z.between(0, MAX_ZOOM) & (x >= 0) & (y >= 0) & (x < _two(z)) & (y < _two(z))
    made = zoom_start(z) + F.aggregate(steps, start, step, lambda s: s["d"])
    return F.when(valid, made).otherwise(F.when(z.isNotNull() & x.isNotNull() & y.isNotNull(), F.raise_error(F.lit("no such tile")).cast("long")))


@F.arrow_udf(LongType())
def _ids(z: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    null = np.zeros(len(z), bool)
    for a in (z, x, y):
        null |= a.is_null().to_numpy(zero_copy_only=False)
    z, x, y = (a.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for a in (z, x, y))
    z, x, y = (np.where(null, 0, a) for a in (z, x, y))
    held = (z >= 0) & (z <= MAX_ZOOM)
    side = np.left_shift(1, np.where(held, z, 0))
    if not (held & (x >= 0) & (y >= 0) & (x < side) & (y < side)).all():
        raise ValueError("no such tile")
    d = (side.astype(np.uint64) ** np.uint64(2) - np.uint64(1)) // np.uint64(3)
    d = d.astype(np.int64)
    for k in range(int(z.max(initial=0)) - 1, -1, -1):
        on = z > k
        rx, ry = x >> k & 1, y >> k & 1
        d += np.where(on, (3 * rx ^ ry) << 2 * k, 0)
        flip, turn = on & (ry == 0) & (rx == 1), on & (ry == 0)
        x, y = np.where(flip, ~x, x), np.where(flip, ~y, y)  # only the bits below k are read again
        x, y = np.where(turn, y, x), np.where(turn, x, y)
    return pa.array(d, pa.int64(), mask=null)


def tile_ids(z: Column, x: Column, y: Column) -> Column:
    """``tile_id`` for whole tables: worked out for all rows of an Arrow batch at once, and so not for use inside lambdas."""
    return _ids(z.cast("int"), x.cast("long"), y.cast("long"))


def tile_zoom(id_: Column) -> Column:
    """The zoom of a valid id, from the number of bits of 3 * id + 1."""
    last = (4**MAX_ZOOM - 1) // 3
    bits = F.length(F.bin(F.least(id_, F.lit(last - 1)) * 3 + 1))
    return F.when(id_ >= last, MAX_ZOOM).otherwise(F.floor((bits - 1) / 2)).cast("int")


def tile_zxy(id_: Column) -> Column:
    """A struct of z, x and y; the inverse of tile_id. Null for null, an error for an id beyond zoom 31."""
    kind = "struct<z:int,x:bigint,y:bigint>"

    def walk(v: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            t, scale = s["t"], _two(k)
            rx = F.shiftright(t, 1).bitwiseAND(F.lit(1).cast("long"))
            ry = t.bitwiseXOR(rx).bitwiseAND(F.lit(1).cast("long"))
            fx, fy = F.when(rx == 1, scale - 1 - s["x"]).otherwise(s["x"]), F.when(rx == 1, scale - 1 - s["y"]).otherwise(s["y"])
            nx, ny = F.when(ry == 0, fy).otherwise(s["x"]), F.when(ry == 0, fx).otherwise(s["y"])
            return F.struct((nx + scale * rx).alias("x"), (ny + scale * ry).alias("y"), F.shiftright(t, 2).alias("t"))

        zero = F.lit(0).cast("long")
        begin = F.struct(zero.alias("x"), zero.alias("y"), (v["id"] - zoom_start(v["z"])).alias("t"))
        steps = F.when(v["z"] > 0, F.sequence(F.lit(0), v["z"] - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, begin, step, lambda s: F.struct(v["z"].alias("z"), s["x"].alias("x"), s["y"].alias("y")))

    def checked(x: Column) -> Column:
        valid = (x >= 0) & (x < F.lit((4 ** (MAX_ZOOM + 1) - 1) // 3))
        found = let(F.struct(x.alias("id"), tile_zoom(x).alias("z")), walk)
        return F.when(valid, found).otherwise(F.when(x.isNotNull(), F.raise_error(F.lit("no such tile")).cast(kind)))

    return let(id_.cast("long"), checked)  # bound once, as an id may be a long expression
