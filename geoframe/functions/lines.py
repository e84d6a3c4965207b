"""Places along lines, nearest places, slices and intersections. Lines are position arrays.

What depends on the lengths along a line is worked out for all positions of a batch at once,
from the running lengths of the lines, in Arrow functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoframe.schema import POSITION

from . import sphere as S
from .geometry import lat, let, lon, num

POS = "array<double>"
LINE = f"array<{POS}>"


def intersect_segments(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where the segments a-b and c-d cross, ends included; null where they are parallel or don't."""
    bx, by, dx, dy = lon(b) - lon(a), lat(b) - lat(a), lon(d) - lon(c), lat(d) - lat(c)
    whole = dy * bx - dx * by
    u = (dx * (lat(a) - lat(c)) - dy * (lon(a) - lon(c))) / F.when(whole != 0, whole)
    v = (bx * (lat(a) - lat(c)) - by * (lon(a) - lon(c))) / F.when(whole != 0, whole)
    return F.when((u >= 0) & (u <= 1) & (v >= 0) & (v <= 1), F.array(lon(a) + u * bx, lat(a) + u * by))


def intersect(line1: Column, line2: Column) -> Column:
    """Intersection of two lines of two positions; longer lines are an error."""
    two = (F.size(line1) == 2) & (F.size(line2) == 2)
    at = intersect_segments(F.get(line1, 0), F.get(line1, 1), F.get(line2, 0), F.get(line2, 1))
    return F.when(two, at).otherwise(F.when(line1.isNotNull() & line2.isNotNull(), F.raise_error(F.lit("only lines of two positions can be intersected")).cast(POS)))


def _places(xy: np.ndarray, sizes: np.ndarray, gone: np.ndarray, metres: np.ndarray) -> np.ndarray:
    """For each line the place at a distance, its last position beyond the end; NaN for no position.

    A place inside a segment is reached from the segment's end, back along its bearing.
    """
    n = len(sizes)
    out = np.full((n, 2), np.nan)
    row, first = S.owners(sizes), S.starts(sizes)
    reached = np.bincount(row[gone < metres[row]], minlength=n) if len(row) else np.zeros(n, np.int64)  # lengths don't fall along a line
    used = sizes > 0
    k = first[used] + np.minimum(reached, sizes - 1)[used]
    short = np.where(reached < sizes, metres, np.inf)[used]  # beyond the end: the last position itself
    back = np.where(np.isinf(short), 0.0, short - gone[k])
    made = xy[k].copy()
    inside = back < 0
    made[inside] = S.destination(xy[k[inside]], back[inside], S.bearing(xy[k[inside] - 1], xy[k[inside]]))
    out[used] = made
    return out


@F.arrow_udf(POSITION)
def _locate(lines: pa.Array, metres: pa.Array) -> pa.Array:
    sizes, xy = S.counts(lines), S.lonlats(lines.flatten())
    d = metres.to_numpy(zero_copy_only=False).astype(float)
    at = _places(xy, sizes, S.travelled(xy, sizes), d)
    null = np.isnan(at).any(1) | np.isnan(d)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * 2, pa.int32()), pa.array(at.ravel()), mask=pa.array(null))


def locate_along(line: Column, metres: Column | float) -> Column:
    """The position at a distance along a line; its last position beyond the end.

    A negative distance is an error; a null argument and a line without positions give null.
    """
    d = num(metres)
    checked = F.when(d < 0, F.raise_error(F.lit("the distance must not be negative")).cast("double")).otherwise(d)
    return _locate(line.cast(LINE), checked)


@F.arrow_udf(POSITION)
def _nearest(lines: pa.Array, targets: pa.Array) -> pa.Array:
    n = len(lines)
    per_row, inner = S.counts(lines), lines.flatten()
    sizes, xy = S.counts(inner), S.lonlats(inner.flatten())
    row_of_line, line = S.owners(per_row), S.owners(sizes)
    begins = np.flatnonzero(line[:-1] == line[1:]) if len(line) > 1 else np.zeros(0, np.int64)  # segments lead from here to the next position
    row, index = row_of_line[line[begins]], begins - S.starts(sizes)[line[begins]]
    a, b, p = xy[begins], xy[begins + 1], S.lonlats(targets)[row]
    to_a, to_b = S.distance(p, a), S.distance(p, b)
    reach, way = np.maximum(to_a, to_b), S.bearing(a, b)
    foot = S.crossing(S.destination(p, reach, way + 90), S.destination(p, reach, way - 90), a, b)
    # Candidates by segment, each with its start, its end and the foot of the perpendicular.
    far = np.stack([to_a, to_b, np.where(np.isnan(foot[:, 0]), np.inf, S.distance(p, foot))], 1).ravel()
    far = np.where(np.isnan(far), np.inf, far)
    out = np.full((n, 5), np.nan)
    if len(begins):
        held = S.owners(np.full(len(begins), 3))
        groups = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(far, 3 * groups)
        best = np.full(n, np.inf)
        best[row[groups]] = least
        hit = np.flatnonzero((far == best[row[held]]) & np.isfinite(far))
        own, first = np.unique(row[held[hit]], return_index=True)
        c = hit[first]
        s = held[c]
        at = np.stack([a[s], b[s], foot[s]])[c % 3, np.arange(len(c))]
        length = S.distance(a, b)
        before = np.cumsum(length) - length
        start = before[groups][np.searchsorted(row[groups], own)]
        out[own] = np.column_stack([at, far[c], before[s] - start + S.distance(a[s], at), index[s] + (c % 3 == 1)])
    null = np.isnan(out).any(1)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 5, pa.int32()), pa.array(out.ravel()), mask=pa.array(null))


def nearest_on_lines(lines: Column, p: Column) -> Column:
    """The nearest place of an array of lines to a position.

    A struct of ``at``, ``distance``, ``location`` (metres along all lines up to there) and
    ``index`` (of the segment, within its line). Candidates are each segment's ends and where
    it meets the perpendicular through p; the first of equals wins. Null for a null argument and
    where no line has two positions.
    """
    made = lambda x: F.struct(F.slice(x, 1, 2).alias("at"), F.get(x, 2).alias("distance"), F.get(x, 3).alias("location"), F.get(x, 4).cast("int").alias("index"))
    return let(_nearest(lines.cast(f"array<{LINE}>"), p.cast(POS)), lambda x: F.when(x.isNotNull(), made(x)))


def slice_between(line: Column, start: Column, stop: Column) -> Column:
    """The part of a line between the places nearest to two positions, with the vertices between."""
    a, b = nearest_on_lines(F.array(line), start), nearest_on_lines(F.array(line), stop)
    ordered = let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.when(s["a"]["index"] <= s["b"]["index"], s).otherwise(F.struct(s["b"].alias("a"), s["a"].alias("b"))))
    return let(ordered, lambda s: F.concat(F.array(s["a"]["at"]), F.slice(line, s["a"]["index"] + 2, F.greatest(s["b"]["index"] - s["a"]["index"], F.lit(0))), F.array(s["b"]["at"])))


@F.arrow_udf(T.ArrayType(POSITION))
def _slice(lines: pa.Array, start: pa.Array, stop: pa.Array) -> pa.Array:
    n = len(lines)
    sizes, xy = S.counts(lines), S.lonlats(lines.flatten())
    low, high = (x.to_numpy(zero_copy_only=False).astype(float) for x in (start, stop))
    row, gone = S.owners(sizes), S.travelled(xy, sizes)
    count = lambda hit: np.bincount(row[hit], minlength=n) if len(row) else np.zeros(n, np.int64)
    whole = sizes - count(gone <= low[row]) > 0  # the line goes on beyond the start
    # The cut at the stop must not come in a segment before that of the start.
    bad = ~whole | (count(gone < high[row]) < count(gone <= low[row])) | lines.is_null().to_numpy(zero_copy_only=False) | np.isnan(low) | np.isnan(high)
    inner = (gone > low[row]) & (gone < high[row])
    last = S.starts(sizes)[row] + sizes[row] - 1
    inner &= np.arange(len(xy)) != last  # the last position is the cut at the stop, if it is reached
    a, b = _places(xy, sizes, gone, low), _places(xy, sizes, gone, high)
    keep = inner & ~bad[row]
    parts = np.concatenate([a[~bad], xy[keep], b[~bad]])
    owner = np.concatenate([np.flatnonzero(~bad), row[keep], np.flatnonzero(~bad)])
    order = np.argsort(owner, kind="stable")
    return S.nested(parts[order], np.where(bad, 0, np.bincount(owner, minlength=n)), bad)


def slice_along(line: Column, start: Column | float, stop: Column | float) -> Column:
    """The part of a line between two distances: the cuts there and the vertices between.

    A stop beyond the end is the end. A start at or beyond the end, and a stop in a segment
    before that of the start, are errors; a null argument gives null.
    """
    a, b = num(start), num(stop)
    failed = F.raise_error(F.lit("the start lies beyond the end of the line")).cast(LINE)
    return F.coalesce(_slice(line.cast(LINE), a, b), F.when(line.isNotNull() & a.isNotNull() & b.isNotNull(), failed))
