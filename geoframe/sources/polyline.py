"""Encoded polylines: deltas, lat before lon, in chunks of five bits.

The columns are Arrow UDFs that code all characters of a batch at once. Built-in higher-order
functions can say the same but walk the characters one by one outside compiled code.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_SHIFT = 55  # bits before the last five of a 64-bit number


def encode_lines(lines: pa.Array, precision: int = 5) -> pa.Array:
    """Texts of a batch of position arrays; null where a position lacks a finite lon or lat."""
    n = len(lines)
    count = pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    bad = lines.is_null().to_numpy(zero_copy_only=False).copy()
    positions = lines.flatten()
    row = np.repeat(np.arange(n), count)
    axes = pc.fill_null(pc.list_value_length(positions), 0).to_numpy(zero_copy_only=False)
    held = np.r_[positions.values.to_numpy(zero_copy_only=False).astype(float), np.nan, np.nan]
    at = np.where(axes >= 2, np.asarray(positions.offsets)[:-1], len(held) - 2)
    scaled = np.floor(np.stack([held[at + 1], held[at]], 1) * 10**precision + 0.5)  # lat comes first
    wrong = ~np.isfinite(scaled).all(1)
    bad[row[wrong]] = True
    scaled[wrong] = 0
    whole = scaled.astype(np.int64)
    delta = np.diff(whole, axis=0, prepend=np.zeros((1, 2), np.int64))
    first = (np.cumsum(count) - count)[count > 0]
    delta[first] = whole[first]
    zigzag = np.where(delta < 0, -2 * delta - 1, 2 * delta).ravel()
    chunks = 1 + sum((zigzag >> k > 0).astype(np.int64) for k in range(5, MOST_SHIFT + 6, 5))
    owner = np.repeat(np.arange(len(zigzag)), chunks)
    place = np.arange(len(owner)) - (np.cumsum(chunks) - chunks)[owner]
    text = ((zigzag[owner] >> 5 * place) & 31) + np.where(place < chunks[owner] - 1, 32, 0) + 63
    ends = np.r_[0, np.cumsum(np.bincount(row[owner // 2], minlength=n))].astype(np.int32)
    made = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(ends), pa.py_buffer(text.astype(np.uint8))])
    return pc.if_else(pa.array(bad), pa.scalar(None, pa.string()), made)


def encode(positions: Column, precision: int = 5) -> Column:
    """Positions as text; only the first two axes are kept."""

    @F.arrow_udf("string")
    def run(lines: pa.Array) -> pa.Array:
        return encode_lines(lines, precision)

    return run(positions.cast("array<array<double>>"))


def decode_texts(texts: pa.Array, precision: int = 5) -> pa.Array:
    """Positions of a batch of texts, all of whose characters are decoded at once; null where malformed."""
    n = len(texts)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    held = b"".join(x for x in texts.cast("binary").to_pylist() if x)
    v = np.frombuffer(held, np.uint8).astype(np.int64) - 63
    row = np.repeat(np.arange(n), sizes)
    bad = texts.is_null().to_numpy(zero_copy_only=False).copy()
    bad[row[(v < 0) | (v > 63)]] = True
    closes = v < 32
    last = np.cumsum(sizes)[sizes > 0] - 1
    bad[row[last[~closes[last]]]] = True  # cut off inside a number
    ends = closes.copy()
    ends[last] = True
    stop = np.flatnonzero(ends)
    start = np.r_[0, stop[:-1] + 1][: len(stop)]
    shift = 5 * (np.arange(len(v)) - np.repeat(start, stop - start + 1))
    bad[row[shift > MOST_SHIFT]] = True
    bits = np.add.reduceat((v & 31) << np.minimum(shift, MOST_SHIFT), start) if len(start) else np.zeros(0, np.int64)
    delta = np.where(bits & 1, -(bits >> 1) - 1, bits >> 1)
    owner = row[start]
    count = np.bincount(owner, minlength=n)
    bad |= count % 2 == 1
    good = ~bad[owner]
    pairs = np.where(bad, 0, count // 2)
    sums = np.cumsum(delta[good].reshape(-1, 2), axis=0)
    before = np.r_[np.zeros((1, 2), np.int64), sums][np.cumsum(pairs) - pairs]
    flat = (sums - np.repeat(before, pairs, axis=0))[:, ::-1] / float(10**precision)  # lat comes first
    points = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * 2, pa.int32()), pa.array(flat.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(pairs)], pa.int32()), points, mask=pa.array(bad))


def decode_or_null(text: Column, precision: int = 5) -> Column:
    """The positions of an encoded text; null where it is malformed."""

    @F.arrow_udf("array<array<double>>")
    def run(texts: pa.Array) -> pa.Array:
        return decode_texts(texts, precision)

    return run(text)


def decode(text: Column, precision: int = 5) -> Column:
    """The positions of an encoded text; an error where it is malformed."""
    got = decode_or_null(text, precision)
    failed = F.raise_error(F.lit("malformed polyline")).cast("array<array<double>>")
    return F.coalesce(got, F.when(text.isNotNull(), failed))
