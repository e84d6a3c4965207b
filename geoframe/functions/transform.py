"""Simplification, splines, circles, great circles and grids."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sphere
from .geometry import lat, let, line_string, lon, make, num, polygon, position
from .measure import RADIUS, destination, distance, east, north, positions_bbox, south, west

POSITIONS = "array<array<double>>"
DEGREE = RADIUS * math.pi / 180  # metres of a degree


# simplification


def _segment_gaps(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of positions to segments, row by row, in the plane of degrees."""
    d = b - a
    whole = (d * d).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(whole > 0, np.clip(((p - a) * d).sum(1) / whole, 0, 1), 0.0)
    gap = p - (a + t[:, None] * d)
    return (gap * gap).sum(1)


def _thinned(xy: np.ndarray, sizes: np.ndarray, limit: float) -> np.ndarray:
    """Whether a position stays: the first, those beyond the limit from the last that stays, and the end."""
    stay = np.zeros(len(xy), bool)
    first, end = sphere.starts(sizes), sphere.starts(sizes) + sizes - 1
    live = np.flatnonzero(sizes > 0)
    last, k = first[live], 0
    stay[last] = True
    while len(live):  # all lines go on by a position at once
        k += 1
        on = sizes[live] > k
        live, last = live[on], last[on]
        here = first[live] + k
        gap = xy[here] - xy[last]
        far = (gap * gap).sum(1) > limit
        stay[here[far]] = True
        last = np.where(far, here, last)
    stay[end[sizes > 0]] = True
    return stay


def simplified(xy: np.ndarray, sizes: np.ndarray, tolerance: float = 1.0, highest_quality: bool = False) -> np.ndarray:
    """Whether each position of many lines stays. Radial thinning, unless of highest quality, then Douglas-Peucker.

    All lines are split at once, a level of the recursion a step. Lines of two positions or fewer stay.
    """
    limit = tolerance * tolerance
    short = np.repeat(sizes <= 2, sizes)
    kept = np.flatnonzero(short | (np.ones(len(xy), bool) if highest_quality else _thinned(xy, sizes, limit)))
    own = xy[kept]
    row = sphere.owners(sizes)[kept]
    new = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    a = np.flatnonzero(new)
    b = np.r_[a[1:], len(kept)] - 1 if len(a) else a
    stay = short[kept]
    stay[a] = stay[b] = True
    while True:
        wide = b - a > 1
        a, b = a[wide], b[wide]
        if not len(a):
            break
        inner = b - a - 1
        segment, begin = sphere.owners(inner), sphere.starts(inner)
        at = a[segment] + 1 + np.arange(len(segment)) - begin[segment]
        gaps = _segment_gaps(own[at], own[a[segment]], own[b[segment]])
        most = np.maximum.reduceat(gaps, begin)
        hit = np.flatnonzero(gaps == most[segment])
        _, one = np.unique(segment[hit], return_index=True)  # the first of equals
        far = at[hit[one]]
        split = most > limit
        a, b, far = a[split], b[split], far[split]
        stay[far] = True
        a, b = np.r_[a, far], np.r_[far, b]
    out = np.zeros(len(xy), bool)
    out[kept[stay]] = True
    return out


def simplify_positions(line: np.ndarray, tolerance: float = 1.0, highest_quality: bool = False) -> np.ndarray:
    """Places of the positions of one line that stay."""
    return np.flatnonzero(simplified(line[:, :2], np.array([len(line)]), tolerance, highest_quality))


def simplify(line: Column, tolerance: float | None = None, highest_quality: bool = False) -> Column:
    """A line with fewer positions, which keep all their axes; null for null. Recursive, hence an Arrow function."""
    limit = 1.0 if tolerance is None else float(tolerance)

    @F.arrow_udf(POSITIONS)
    def run(lines: pa.Array) -> pa.Array:
        sizes, positions = sphere.counts(lines), lines.flatten()
        keep = simplified(sphere.lonlats(positions), sizes, limit, highest_quality)
        left = np.bincount(sphere.owners(sizes)[keep], minlength=len(sizes)) if len(keep) else sizes
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(left)], pa.int32()), positions.filter(pa.array(keep)), mask=lines.is_null())

    return run(line.cast(POSITIONS))


# splines


def bezier_spline(line: Column, resolution: int = 10000, sharpness: float = 0.85) -> Column:
    """Positions of a cubic spline through a line, drawn in dashes of ten samples, and its end."""
    s = float(sharpness)
    n = F.size(line)
    mid = lambda a, b: F.array((lon(a) + lon(b)) / 2, (lat(a) + lat(b)) / 2)
    centres = F.zip_with(F.slice(line, 1, n - 1), F.slice(line, 2, n - 1), mid)

    def control(c: Column, p: Column, m: Column) -> Column:
        return F.array(*[(1 - s) * f(p) + s * (f(c) + f(p) - f(m)) for f in (lon, lat)])

    def pair(k: Column) -> Column:
        p, a, b = F.get(line, k + 1), F.get(centres, k), F.get(centres, k + 1)
        return let(mid(a, b), lambda m: F.struct(control(a, p, m).alias("into"), control(b, p, m).alias("out")))

    ends = lambda p: F.array(F.struct(p.alias("into"), p.alias("out")))
    flat = lambda p: F.slice(p, 1, 2)
    inner = F.when(n > 2, F.transform(F.sequence(F.lit(0), n - 3), pair)).otherwise(F.slice(ends(flat(F.get(line, 0))), 1, 0))
    controls = F.concat(ends(flat(F.get(line, 0))), inner, ends(flat(F.element_at(line, -1))))

    def bezier(t: Column, k: Column, c: Column) -> Column:
        ends = F.struct(t.alias("t"), (1 - t).alias("u"), F.get(line, k).alias("p0"), F.get(line, k + 1).alias("p3"), F.get(c, k)["out"].alias("p1"), F.get(c, k + 1)["into"].alias("p2"))

        def curve(x: Column) -> Column:
            t, u, p0, p1, p2, p3 = (x[name] for name in ("t", "u", "p0", "p1", "p2", "p3"))
            return F.array(*[u * u * u * f(p0) + 3 * u * u * t * f(p1) + 3 * u * t * t * f(p2) + t * t * t * f(p3) for f in (lon, lat)])

        return let(ends, curve)

    def at(c: Column):
        def run(time: Column) -> Column:
            def draw(x: Column) -> Column:
                return F.when(x["k"] >= n - 1, flat(F.element_at(line, -1))).otherwise(bezier(x["place"] - x["k"], x["k"], c))

            return let((n - 1) * time.cast("double") / resolution, lambda place: let(F.struct(place.alias("place"), F.floor(place).cast("int").alias("k")), draw))

        return run

    times = F.filter(F.sequence(F.lit(0), F.lit(resolution - 1), F.lit(10)), lambda t: F.floor(t / 100) % 2 == 0)
    return let(controls, lambda c: F.concat(F.transform(times, at(c)), F.array(flat(F.element_at(line, -1)))))


# circles


def circle(center: Column, metres: Column | float, steps: int = 64) -> Column:
    """A polygon around a position: steps + 1 positions and one that closes it."""
    if steps < 4:
        raise ValueError("a circle has four steps or more")
    ring = F.concat(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: destination(center, metres, k * -360.0 / steps)), F.array(destination(center, metres, F.lit(0.0))))
    made = let(ring, lambda r: polygon(F.array(r), positions_bbox(r)))
    return F.when(num(metres) > 0, made).otherwise(F.raise_error(F.lit("the radius must be positive")).cast(made_type()))


def made_type():
    from geoframe.schema import GEOMETRY

    return GEOMETRY


# great circles


def great_circle_positions(a: Column, b: Column, count: int = 100) -> Column:
    """Positions of the arc; the first and last are exact, and the inner ones lead up to the end."""
    def between(f: Column, d: Column) -> Column:
        x1, y1, x2, y2 = (F.radians(v) for v in (lon(a), lat(a), lon(b), lat(b)))

        def place(w: Column) -> Column:
            p, q = w["p"], w["q"]
            x, y = p * F.cos(y1) * F.cos(x1) + q * F.cos(y2) * F.cos(x2), p * F.cos(y1) * F.sin(x1) + q * F.cos(y2) * F.sin(x2)
            return F.array(F.degrees(F.atan2(y, x)), F.degrees(F.atan2(p * F.sin(y1) + q * F.sin(y2), F.sqrt(x * x + y * y))))

        return let(F.struct((F.sin((1 - f) * d) / F.sin(d)).alias("p"), (F.sin(f * d) / F.sin(d)).alias("q")), place)

    arc = lambda d: F.transform(F.sequence(F.lit(2), F.lit(count - 1)), lambda k: between(k.cast("double") / (count - 1), d))
    inner = let(distance(a, b) / RADIUS, arc) if count > 2 else F.array().cast(POSITIONS)
    return F.concat(F.array(F.slice(a, 1, 2)), inner, F.array(F.slice(b, 1, 2)))


def great_circle(a: Column, b: Column, count: int = 100, offset: float = 10.0) -> Column:
    """The arc as a LineString, or, where it crosses the antimeridian, cut into a MultiLineString.

    Equal and antipodal ends give null. The cut's latitude is linear in longitude.
    """
    border = 180.0 - offset

    def split(ps: Column) -> Column:
        gaps = F.zip_with(F.slice(ps, 1, F.size(ps) - 1), F.slice(ps, 2, F.size(ps) - 1), lambda p, q: F.abs(lon(q) - lon(p)))
        crossing = lambda p, q: (F.abs(lon(q) - lon(p)) > 360.0 - offset) & (((lon(p) > border) & (lon(q) < -border)) | ((lon(p) < -border) & (lon(q) > border)))
        crosses = F.exists(F.zip_with(F.slice(ps, 1, F.size(ps) - 1), F.slice(ps, 2, F.size(ps) - 1), crossing), lambda x: x)
        ordinary = F.coalesce(F.array_max(F.filter(gaps, lambda g: g <= 360.0 - offset)), F.lit(0.0))
        start = F.array(F.array(F.get(ps, 0)))

        def step(lines: Column, q: Column) -> Column:
            p = F.element_at(F.element_at(lines, -1), -1)
            side = F.when(lon(p) > 0, 180.0).otherwise(-180.0)
            there = lon(q) + 2 * side
            y = lat(p) + (lat(q) - lat(p)) * (side - lon(p)) / F.when(there != lon(p), there - lon(p))
            y = F.coalesce(y, lat(p))
            head, last = F.slice(lines, 1, F.size(lines) - 1), F.element_at(lines, -1)
            cut = F.concat(head, F.array(F.concat(last, F.array(F.array(side, y)))), F.array(F.array(F.array(-side, y), q)))
            return F.when(crossing(p, q), cut).otherwise(F.concat(head, F.array(F.concat(last, F.array(q)))))

        return F.when(crosses & (ordinary < offset), F.aggregate(F.slice(ps, 2, F.size(ps)), start.cast("array<array<array<double>>>"), step)).otherwise(F.array(ps))

    def shape(ps: Column) -> Column:
        return let(split(ps), lambda lines: make(F.when(F.size(lines) > 1, "MultiLineString").otherwise("LineString"), F.array(lines), positions_bbox(ps)))

    d = distance(a, b) / RADIUS
    return F.when((d > 0) & (F.abs(d - math.pi) > 1e-12), let(great_circle_positions(a, b, count), shape))


# grids


def grid_counts(b: Column, cell_width: float, cell_height: float | None = None) -> Column:
    """Columns and rows of cells, of so many metres, that fit a box, and the south-west of the first."""
    w, h = cell_width / DEGREE, (cell_width if cell_height is None else cell_height) / DEGREE
    across, up = F.abs(east(b) - west(b)), F.abs(north(b) - south(b))
    cols, rows = F.floor(across / w).cast("int"), F.floor(up / h).cast("int")
    return F.struct(
        cols.alias("cols"), rows.alias("rows"), (west(b) + (across - cols * w) / 2).alias("x"), (south(b) + (up - rows * h) / 2).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h")
    )


def square_grid(df: DataFrame, box: Column, cell_width: float, cell_height: float | None = None, name: str = "cell") -> DataFrame:
    """One row a cell of each row's box, column by column, with ``col``, ``row`` and the cell's polygon.

    A box smaller than a cell gives no row.
    """
    counted = df.withColumn("__g", grid_counts(box, cell_width, cell_height)).filter("__g.cols > 0 AND __g.rows > 0")
    cells = counted.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("__g.cols") - 1))).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("__g.rows") - 1)))
    g = F.col("__g")
    x, y = g["x"] + F.col("col") * g["w"], g["y"] + F.col("row") * g["h"]
    ring = F.array(position(x, y), position(x, y + g["h"]), position(x + g["w"], y + g["h"]), position(x + g["w"], y), position(x, y))
    return cells.withColumn(name, polygon(F.array(ring))).drop("__g")
