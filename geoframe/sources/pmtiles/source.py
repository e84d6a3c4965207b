"""The data source ``pmtiles`` with the views header, metadata, directory, tiles and warnings.

The driver reads the header and the root directory; each leaf directory is one input partition
that reads its own tiles. Filters on tile_id prune leaves and entries, where Spark passes them
(spark.sql.python.filterPushdown.enabled).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from geoframe.functions.tiles import tile_ids
from geoframe.operators.join import interval_lookup

from . import format as A

LIMIT_OPTIONS = {"directory": "maxdirectorybytes", "metadata": "maxmetadatabytes", "tile": "maxtilebytes", "entries": "maxentries", "depth": "maxdepth"}
VIEWS = {
    "header": ", ".join(f"{k} {'double' if k.endswith(('lon', 'lat')) else 'long'}" for k in A.FIELDS),
    "metadata": "json string, name string, description string, attribution string, type string, version string, encoding string, vector_layers string",
    "directory": "tile_id long, offset long, length long, run_length long, depth int",
    "tiles": "z int, x long, y long, tile_id long, payload binary",
    "warnings": "code string, context string",
}


def read_ranges(path: str, ranges: list[tuple[int, int]]) -> list[bytes]:
    """Byte ranges of a file; a short read is an error. Paths with a scheme go through pyarrow."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        files, own = fs.FileSystem.from_uri(path)
        with files.open_input_file(own) as f:
            out = [f.read_at(n, at) for at, n in ranges]
    else:
        with open(path.removeprefix("file://"), "rb") as f:
            out = []
            for at, n in ranges:
                f.seek(at)
                out.append(f.read(n))
    return out


class Files:
    """Where an archive's bytes come from: local paths and those with a scheme."""

    def size(self, path: str) -> int:
        return file_size(path)

    def read(self, path: str, ranges: list[tuple[int, int]]) -> list[bytes]:
        return read_ranges(path, ranges)


def file_size(path: str) -> int:
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        files, own = fs.FileSystem.from_uri(path)
        return files.get_file_info(own).size
    import os

    return os.path.getsize(path.removeprefix("file://"))


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int = 0, most: int = 512 * 1024) -> list[tuple[int, int]]:
    """Sorted byte ranges (offset, length), joined where at most ``gap`` bytes lie between them
    and the joined range has at most ``most`` bytes; ``most`` 0 joins none."""
    out: list[tuple[int, int]] = []
    for at, n in sorted(set(ranges)):
        if out and most and at - (out[-1][0] + out[-1][1]) <= gap and max(at + n, sum(out[-1])) - out[-1][0] <= most:
            out[-1] = (out[-1][0], max(at + n, sum(out[-1])) - out[-1][0])
        else:
            out.append((at, n))
    return out


class Archive:
    """Header, directories and tiles of one file."""

    def __init__(self, path: str, strict: bool = True, gap: int = 0, most: int = 512 * 1024, limits: dict[str, int] | None = None, codecs: dict | None = None, files=None):
        """``codecs`` are functions from bytes to bytes by compression code, before the built-in ones; ``files`` has size(path) and read(path, ranges)."""
        self.files = files or Files()
        self.path, self.size, self.gap, self.most, self.codecs = path, self.files.size(path), gap, most, codecs
        self.limits, self.strict = A.LIMITS | (limits or {}), strict
        self.head = self._read([(0, min(A.FIRST_READ, self.size))])[0]
        self.header, self.warnings = A.parse_header(self.head, self.size, strict)
        h = self.header
        self.root = self._directory(self.head[h["root_offset"] : h["root_offset"] + h["root_length"]]) if h["root_length"] else []
        if not self.root:
            self.warnings.append(("EmptyRoot", "the root directory has no entries"))

    def _read(self, ranges: list[tuple[int, int]]) -> list[bytes]:
        out = self.files.read(self.path, ranges)
        if any(len(x) != n for x, (_, n) in zip(out, ranges)):
            raise A.ArchiveError("ShortRead", self.path)
        return out

    def inflate(self, stored: bytes, purpose: str) -> bytes:
        """Decompress, but to no more bytes than the limit of the purpose: directory, metadata or tile."""
        code, limit = self.header["tile_compression" if purpose == "tile" else "internal_compression"], self.limits[purpose]
        if code == A.GZIP and code not in (self.codecs or {}):
            return A.gunzip(stored, limit)
        plain = A.codec(A.DECOMPRESS, code, self.codecs)(stored)
        if len(plain) > limit:
            raise A.ArchiveError("LimitExceeded", f"more than {limit} bytes")
        return plain

    def _directory(self, stored: bytes) -> list[A.Entry]:
        entries = A.decode_directory(self.inflate(stored, "directory"), self.limits["entries"])
        for e in entries:
            section = "tile" if e.run_length else "leaf"
            if e.offset + e.length > self.header[f"{section}_length"]:
                raise A.ArchiveError("InvalidDirectory", f"an entry leaves the {section} section")
        return entries

    def leaf(self, e: A.Entry) -> list[A.Entry]:
        return self._directory(self._read([(self.header["leaf_offset"] + e.offset, e.length)])[0])

    def entries(self, at: list[A.Entry], low: int = 0, high: int = 1 << 62, depth: int = 0) -> Iterator[tuple[A.Entry, int]]:
        """Tile entries that may cover ids low..high."""
        if depth > self.limits["depth"]:
            raise A.ArchiveError("LimitExceeded", "directories are nested too deeply")
        for k, e in enumerate(at):
            end = at[k + 1].tile_id - 1 if k + 1 < len(at) else 1 << 62
            if e.run_length:
                if e.tile_id <= high and e.tile_id + e.run_length - 1 >= low:
                    yield e, depth
            elif e.tile_id <= high and end >= low:
                if depth:
                    self.warnings.append(("NestedLeaf", f"depth {depth}"))
                yield from self.entries(self.leaf(e), low, high, depth + 1)

    def payloads(self, entries: list[A.Entry]) -> Iterator[tuple[A.Entry, bytes]]:
        base = self.header["tile_offset"]
        spans = coalesce_ranges([(e.offset, e.length) for e in entries], self.gap, self.most)
        by = sorted(entries, key=lambda e: e.offset)
        k = 0
        for at, n in spans:
            data = self._read([(base + at, n)])[0]
            while k < len(by) and by[k].offset + by[k].length <= at + n:
                yield by[k], data[by[k].offset - at : by[k].offset - at + by[k].length]
                k += 1

    def metadata(self) -> str:
        h = self.header
        stored = self._read([(h["metadata_offset"], h["metadata_length"])])[0]
        try:
            text = self.inflate(stored, "metadata").decode() if stored else "{}"
            value = json.loads(text)
            if not isinstance(value, dict):
                raise ValueError("not an object")
        except ValueError as e:
            if self.strict:
                raise A.ArchiveError("InvalidMetadata", str(e)) from e
            self.warnings.append(("RecoveredMetadata", str(e)))
            return "{}"
        if h["tile_type"] == A.MVT and not isinstance(value.get("vector_layers"), list):
            if self.strict:
                raise A.ArchiveError("InvalidMetadata", "vector_layers is missing")
            self.warnings.append(("MissingVectorLayers", "metadata"))
        return text


class Leaf(InputPartition):
    def __init__(self, entries: list[A.Entry], depth: int):
        self.entries, self.depth = entries, depth


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, codecs: dict | None = None, files=None):
        self.view = options.get("view", "tiles")
        self.raw = options.get("decompress", "false").lower() != "true"
        self.low, self.high = 0, (1 << 62)
        self.arguments = {"path": options["path"], "strict": options.get("strict", "true").lower() == "true", "gap": int(options.get("maxgapbytes", 0)), "most": int(options.get("maxcoalescedbytes", 512 * 1024))}
        self.arguments |= {"limits": {k: int(options[o]) for k, o in LIMIT_OPTIONS.items() if o in options}, "codecs": codecs, "files": files}
        self.equal: dict[str, int] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("tile_id",) and self.view in ("tiles", "directory"):
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, f.value), min(self.high, f.value)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value)
            elif isinstance(f, EqualTo) and self.view == "tiles" and getattr(f, "attribute", None) in (("z",), ("x",), ("y",)):
                self.equal[f.attribute[0]] = f.value
            yield f  # entries cover runs, so Spark filters the rows again
        z, x, y = (self.equal.get(k) for k in "zxy")
        if z is not None:  # a zoom is a range of ids, and a place in it one id
            inside = 0 <= z <= 31 and all(v is None or 0 <= v < 1 << z for v in (x, y))
            first, end = (A.zxy_to_id(z, 0, 0), ((1 << 2 * (z + 1)) - 1) // 3 - 1) if inside else (1, 0)
            if inside and x is not None and y is not None:
                first = end = A.zxy_to_id(z, x, y)
            self.low, self.high = max(self.low, first), min(self.high, end)

    def partitions(self) -> list[InputPartition]:
        if self.view not in ("tiles", "directory"):
            return [Leaf([], 0)]
        a = Archive(**self.arguments)
        parts, own = [], [e for e in a.root if e.run_length and e.tile_id <= self.high and e.tile_id + e.run_length > self.low]
        for k, e in enumerate(a.root):
            end = a.root[k + 1].tile_id - 1 if k + 1 < len(a.root) else 1 << 62
            if not e.run_length and e.tile_id <= self.high and end >= self.low:
                parts.append(Leaf([e], 0))
        step = 4096
        return parts + [Leaf(own[k : k + step], 0) for k in range(0, len(own), step)] or [Leaf([], 0)]

    def read(self, partition: Leaf) -> Iterator[tuple]:
        a = Archive(**self.arguments)
        h = a.header
        if self.view == "header":
            yield tuple(h[k] for k in A.FIELDS)
        elif self.view == "warnings":
            if not h["root_length"]:
                pass
            a.metadata()
            list(a.entries(a.root))
            yield from dict.fromkeys(a.warnings)
        elif self.view == "metadata":
            text = a.metadata()
            value = json.loads(text)
            layers = value.get("vector_layers")
            yield (text, *[None if value.get(k) is None else str(value[k]) for k in ("name", "description", "attribution", "type", "version", "encoding")], None if layers is None else json.dumps(layers))
        else:
            found = list(a.entries(partition.entries, self.low, self.high))
            if self.view == "directory":
                for e, depth in found:
                    yield e.tile_id, e.offset, e.length, e.run_length, depth
                return
            inflate = (lambda b: b) if self.raw else (lambda b: a.inflate(b, "tile"))
            for e, data in a.payloads([e for e, _ in found]):
                plain = inflate(data)
                for tile in range(max(e.tile_id, self.low), min(e.tile_id + e.run_length - 1, self.high) + 1):
                    yield (*A.id_to_zxy(tile), tile, plain)


class TileArchive(DataSource):
    """Options: path, view, decompress, strict, maxGapBytes, maxCoalescedBytes, and the limits
    maxDirectoryBytes, maxMetadataBytes, maxTileBytes, maxEntries and maxDepth."""

    codecs: dict | None = None
    files = None

    @classmethod
    def name(cls) -> str:
        return "pmtiles"

    def schema(self) -> str:
        view = self.options.get("view", "tiles")
        if view not in VIEWS:
            raise ValueError(f"no view {view}; there are {', '.join(VIEWS)}")
        return VIEWS[view]

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()}, self.codecs, self.files)


def register(spark: SparkSession, codecs: dict | None = None, files=None) -> None:
    """Make the format ``pmtiles`` known, with own decompressors by code and an own source of bytes."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(type("TileArchive", (TileArchive,), {"codecs": codecs, "files": files}))


def read_batch(spark: SparkSession, path: str, asked: DataFrame, order: str = "place", decompress: bool = False, **options) -> DataFrame:
    """(place, z, x, y, payload): the tiles of rows (place, z, x, y), one row each, in any number and order.

    A coordinate that is asked twice is answered twice; a tile that the archive lacks and an
    impossible coordinate have a null payload. Directory entries are looked up by id, each entry
    that is met is read once, and the payloads go back to all that asked.
    """
    view = lambda name: spark.read.format("pmtiles").options(path=path, view=name, decompress=str(decompress).lower(), **options).load()
    side = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("z").cast("int"))
    good = F.col("z").between(0, 31) & (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < side) & (F.col("y") < side)
    ids = asked.select(F.col(order).alias("place"), F.col("z").cast("int").alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    keyed = ids.withColumn("tile", tile_ids(F.when(good, F.col("z")), F.when(good, F.col("x")), F.when(good, F.col("y"))))
    entries = view("directory").select(F.col("tile_id").alias("first"), "offset", "length", "run_length")
    met = interval_lookup(keyed, entries, "tile", "first", "run_length")
    wanted = met.filter("offset IS NOT NULL").select("offset", "length").distinct()
    reader = ArchiveReader({"path": path, "decompress": str(decompress).lower(), **{k.lower(): str(v) for k, v in options.items()}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Archive(**reader.arguments)
        for batch in batches:
            got = [(e, data if reader.raw else a.inflate(data, "tile")) for e, data in a.payloads([A.Entry(0, at, n, 1) for at, n in zip(*(c.to_pylist() for c in batch.columns))])]
            yield pa.RecordBatch.from_arrays([pa.array([e.offset for e, _ in got], pa.int64()), pa.array([e.length for e, _ in got], pa.int64()), pa.array([d for _, d in got], pa.binary())], names=["offset", "length", "payload"])

    found = wanted.repartitionByRange("offset").sortWithinPartitions("offset").mapInArrow(run, "offset long, length long, payload binary")
    return met.join(found, ["offset", "length"], "left").select("place", "z", "x", "y", "payload")
