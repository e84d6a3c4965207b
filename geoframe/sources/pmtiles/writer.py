"""Writing archives: tiles are sorted, deduplicated and run-length coded by Spark.

``assemble`` plans entries as a DataFrame; ``write`` streams directories and payloads in order to
one file, as the format asks for.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoframe.functions.tiles import tile_ids

from . import format as A

ROOT_BYTES, LEAF_ENTRIES, MOST_LEAVES = A.FIRST_READ - A.HEADER, 4096, 2048


def entry_runs(tiles: DataFrame, key: Column, spread: int = 1 << 16) -> DataFrame:
    """(tile_id, run_length, key): runs of consecutive ids with one key, from (tile_id, ...).

    Runs are found within ranges of ``spread`` ids and then joined across them, so that no
    window holds the whole table.
    """
    rows = tiles.select("tile_id", key.alias("key")).withColumn("part", F.floor(F.col("tile_id") / spread))
    order = Window.partitionBy("part").orderBy("tile_id")
    fresh = (F.lag("key").over(order).eqNullSafe(F.col("key")) & (F.lag("tile_id").over(order) == F.col("tile_id") - 1)).cast("int")
    marked = rows.withColumn("run", F.sum(1 - F.coalesce(fresh, F.lit(0))).over(order))
    local = marked.groupBy("part", "run", "key").agg(F.min("tile_id").alias("tile_id"), F.count("*").alias("run_length"))
    stop = F.col("tile_id") + F.col("run_length")
    # Only runs that touch an end of their range can go on in the next: two a range at most.
    border = (F.col("tile_id") % spread == 0) | (stop % spread == 0)
    whole = Window.partitionBy("key").orderBy("tile_id")
    joined = (F.lag(stop).over(whole) == F.col("tile_id")).cast("int")
    again = local.filter(border).withColumn("island", F.sum(1 - F.coalesce(joined, F.lit(0))).over(whole))
    merged = again.groupBy("key", "island").agg(F.min("tile_id").alias("tile_id"), F.sum("run_length").alias("run_length")).select("tile_id", "run_length", "key")
    return merged.unionByName(local.filter(~border).select("tile_id", "run_length", "key"))


def assemble(tiles: DataFrame) -> DataFrame:
    """(tile_id, run_length, key, length): the entries of (z, x, y, payload).

    Tiles of one place twice, and empty payloads, are errors. ``key`` is the payload's SHA-256.
    """
    named = tiles.select(tile_ids(F.col("z"), F.col("x"), F.col("y")).alias("tile_id"), "payload")
    checked = named.withColumn("payload", F.when(F.length("payload") > 0, F.col("payload")).otherwise(F.raise_error(F.lit("a tile is empty")).cast("binary")))
    twice = checked.groupBy("tile_id").agg(F.count("*").alias("c"), F.first(F.sha2("payload", 256)).alias("key"), F.first(F.length("payload")).alias("length"))
    once = twice.withColumn("key", F.when(F.col("c") == 1, F.col("key")).otherwise(F.raise_error(F.lit("a tile is given twice"))))
    return entry_runs(once, F.struct("key", "length")).select("tile_id", "run_length", "key.*")  # one length a key


def running(df: DataFrame, order: str, value: Column, name: str, spread: int = 1 << 16) -> DataFrame:
    """Append the sum of ``value`` over all rows before, by a whole-numbered column without ties.

    Sums run within stretches of ``spread``; what lies before a stretch is told by one row each.
    """
    parted = df.withColumn("__part", F.floor(F.col(order) / spread)).withColumn("__value", value.cast("long"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # No key: one row a stretch, which the frame sums as they come.
    before = parted.groupBy("__part").agg(F.sum("__value").alias("__value")).select("__part", F.coalesce(F.sum("__value").over(upto(Window.orderBy("__part"))), F.lit(0)).alias("__before"))
    own = F.coalesce(F.sum("__value").over(upto(Window.partitionBy("__part").orderBy(order))), F.lit(0))
    return parted.withColumn("__own", own).join(before, "__part").withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__value", "__before", "__own")


def directories(entries: DataFrame, compress, size: int) -> DataFrame:
    """(leaf, first, bytes): the directories of ``size`` entries each, in order, from (place, tile_id, offset, length, run_length)."""
    packed = entries.groupBy(F.floor(F.col("place") / size).alias("leaf")).agg(F.sort_array(F.collect_list(F.struct("tile_id", "offset", "length", "run_length"))).alias("rows"))  # ``size`` rows each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[A.Entry(*e) for e in zip(*(c.to_pylist() for c in x.values.flatten()))] for x in batch.column("rows")]
            made = [compress(A.encode_directory(x)) for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column("leaf"), pa.array([x[0].tile_id for x in rows], pa.int64()), pa.array(made, pa.binary())], names=["leaf", "first", "bytes"])

    return packed.mapInArrow(run, "leaf long, first long, bytes binary")


def write(tiles: DataFrame, path: str, metadata: str = "{}", tile_type: int = A.MVT, tile_compression: int = A.NONE, internal_compression: int = A.GZIP, bounds: tuple[float, float, float, float] = (-180.0, -85.0, 180.0, 85.0), codecs: dict | None = None, sink=None) -> dict:
    """Write (z, x, y, payload) to one file and return its header.

    ``path`` is local or has a scheme that pyarrow knows; ``sink`` may be a function from the path
    to a context manager of an open file instead. Sections come in the order header, root,
    metadata, leaves, tiles. Payloads are stored as they are. Offsets and leaf directories are made
    by the executors; the driver holds the root, a row a leaf, and leaves and payloads stream
    through it a partition at a time. Leaves double in size until the root fits. Nothing is
    written before all is checked, and the file appears when it is whole.
    """
    value = json.loads(metadata)
    if not isinstance(value, dict) or tile_type == A.MVT and not isinstance(value.get("vector_layers"), list):
        raise A.ArchiveError("InvalidMetadata", "metadata must be an object, and has vector_layers for vector tiles")
    compress = A.codec(A.COMPRESS, internal_compression, codecs)
    runs = assemble(tiles).cache()
    try:
        told = runs.agg(F.count("*").alias("entries"), F.sum("run_length").alias("tiles"), F.countDistinct("key").alias("contents"), F.min("tile_id").alias("first"), F.max(F.col("tile_id") + F.col("run_length") - 1).alias("last")).first()
        if not told.entries:
            raise A.ArchiveError("InvalidTile", "an archive has one tile or more")
        firsts = running(runs.groupBy("key").agg(F.min("tile_id").alias("first"), F.first("length").alias("length")), "first", F.col("length"), "offset").cache()
        end = firsts.agg(F.sum("length")).first()[0]
        entries = running(runs.join(firsts.select("key", "offset"), "key"), "tile_id", F.lit(1), "place").select("place", "tile_id", "offset", F.col("length").cast("long").alias("length"), "run_length").cache()
        size, leaves, total = max(LEAF_ENTRIES, told.entries // MOST_LEAVES), None, 0
        rows = [A.Entry(r.tile_id, r.offset, r.length, r.run_length) for r in entries.orderBy("tile_id").collect()] if told.entries <= LEAF_ENTRIES else []
        root = compress(A.encode_directory(rows)) if rows else b""
        while not rows or len(root) > ROOT_BYTES:
            leaves, tops, total, rows = directories(entries, compress, size).cache(), [], 0, [None]
            for r in leaves.select("first", F.octet_length("bytes").alias("n")).orderBy("first").collect():  # a row a leaf
                tops.append(A.Entry(r["first"], total, r.n, 0))
                total += r.n
            root = compress(A.encode_directory(tops))
            if len(root) > ROOT_BYTES and size > told.entries:
                raise A.ArchiveError("LimitExceeded", "the root directory doesn't fit")
            size *= 2
        meta = compress(metadata.encode())
        places = {}
        cursor = A.HEADER
        for name, n in (("root", len(root)), ("metadata", len(meta)), ("leaf", total), ("tile", end)):
            places |= {f"{name}_offset": cursor, f"{name}_length": n}
            cursor += n
        zooms = [A.id_to_zxy(told["first"])[0], A.id_to_zxy(told["last"])[0]]
        header = places | {"addressed_tiles": told.tiles, "tile_entries": told.entries, "tile_contents": told.contents, "clustered": 1, "internal_compression": internal_compression, "tile_compression": tile_compression, "tile_type": tile_type, "min_zoom": zooms[0], "max_zoom": zooms[1]}
        w, s, e, n = bounds
        header |= {"min_lon": w, "min_lat": s, "max_lon": e, "max_lat": n, "center_zoom": zooms[0], "center_lon": (w + e) / 2, "center_lat": (s + n) / 2}
        named = tiles.select(tile_ids(F.col("z"), F.col("x"), F.col("y")).alias("tile_id"), "payload").join(firsts.select(F.col("first").alias("tile_id")), "tile_id")
        with (sink or _sink)(path) as f:
            f.write(A.encode_header(header) + root + meta)
            for r in leaves.orderBy("first").toLocalIterator() if leaves is not None else ():
                f.write(bytes(r.bytes))
            for r in named.orderBy("tile_id").toLocalIterator():
                f.write(bytes(r.payload))
        return header
    finally:
        runs.unpersist()


@contextmanager
def _sink(path: str):
    """A file beside the path that takes its name once it is whole; nothing is left where writing fails."""
    from pyarrow import fs

    files, own = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))
    part = f"{own}.{uuid.uuid4().hex}"
    try:
        with files.open_output_stream(part) as f:
            yield f
        files.move(part, own)
    except BaseException:
        if files.get_file_info(part).type != fs.FileType.NotFound:
            files.delete_file(part)
        raise
