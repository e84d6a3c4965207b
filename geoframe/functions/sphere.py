"""The measures of a sphere over numpy arrays, and batches of lines as flat arrays, for the Arrow functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .measure import RADIUS


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle metres between rows (lon, lat)."""
    (x1, y1), (x2, y2) = np.radians(a).T, np.radians(b).T
    h = np.sin((y2 - y1) / 2) ** 2 + np.sin((x2 - x1) / 2) ** 2 * np.cos(y1) * np.cos(y2)
    return RADIUS * 2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def bearing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (x1, y1), (x2, y2) = np.radians(a).T, np.radians(b).T
    return np.degrees(np.arctan2(np.sin(x2 - x1) * np.cos(y2), np.cos(y1) * np.sin(y2) - np.sin(y1) * np.cos(y2) * np.cos(x2 - x1))) % 360


def destination(p: np.ndarray, metres: np.ndarray, degrees: np.ndarray) -> np.ndarray:
    d, t = metres / RADIUS, np.radians(degrees)
    x, y = np.radians(p).T
    y2 = np.arcsin(np.sin(y) * np.cos(d) + np.cos(y) * np.sin(d) * np.cos(t))
    return np.degrees(np.stack([x + np.arctan2(np.sin(t) * np.sin(d) * np.cos(y), np.cos(d) - np.sin(y) * np.sin(y2)), y2], 1))


def crossing(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Where segments a-b and c-d cross, in the plane of degrees; NaN where they don't."""
    u, v, w = b - a, d - c, a - c
    whole = v[:, 1] * u[:, 0] - v[:, 0] * u[:, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        s, t = (v[:, 0] * w[:, 1] - v[:, 1] * w[:, 0]) / whole, (u[:, 0] * w[:, 1] - u[:, 1] * w[:, 0]) / whole
        there = (whole != 0) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)
        return np.where(there[:, None], a + s[:, None] * u, np.nan)


# batches


def counts(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def lonlats(positions: pa.Array) -> np.ndarray:
    """Rows (lon, lat) of an array of positions; NaN where one is missing."""
    axes = counts(positions)
    held = np.r_[positions.values.to_numpy(zero_copy_only=False).astype(float), np.nan, np.nan]
    at = np.where(axes >= 2, np.asarray(positions.offsets)[:-1], len(held) - 2)
    return np.stack([held[at], held[at + 1]], 1)


def owners(sizes: np.ndarray) -> np.ndarray:
    """The list that each element of the flattened lists is from."""
    return np.repeat(np.arange(len(sizes)), sizes)


def starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def travelled(xy: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Metres from the first position of its line to each position."""
    step = np.zeros(len(xy))
    if len(xy) > 1:
        step[1:] = distance(xy[:-1], xy[1:])
    first = starts(sizes)[sizes > 0]
    step[first] = 0
    total = np.cumsum(step)
    return total - np.repeat(total[first], sizes[sizes > 0])


def nested(xy: np.ndarray, sizes: np.ndarray, null: np.ndarray) -> pa.Array:
    """Lists of (lon, lat) positions, so many a row."""
    points = pa.ListArray.from_arrays(pa.array(np.arange(len(xy) + 1) * 2, pa.int32()), pa.array(xy.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), points, mask=pa.array(null))
