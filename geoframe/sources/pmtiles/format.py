"""Bytes of the archive format: header, directories, tile ids and codecs."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

# fixed values of the format
MAGIC, VERSION, HEADER, FIRST_READ = b"PMTiles", 3, 127, 16384
NONE, GZIP = 1, 2
COMPRESSIONS = {0: "unknown", 1: "none", 2: "gzip", 3: "brotli", 4: "zstd"}
TILE_TYPES = {0: "unknown", 1: "mvt", 2: "png", 3: "jpeg", 4: "webp", 5: "avif", 6: "mlt"}
MVT = 1
FIELDS = (
    "root_offset root_length metadata_offset metadata_length leaf_offset leaf_length tile_offset tile_length addressed_tiles tile_entries tile_contents "
    "clustered internal_compression tile_compression tile_type min_zoom max_zoom min_lon min_lat max_lon max_lat center_zoom center_lon center_lat"
).split()
LAYOUT = "<7sB11Q6B4iB2i"
SCALE = 10_000_000
MAX_BYTES = 1 << 26


class ArchiveError(ValueError):
    """A broken archive; ``code`` names the rule."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


@dataclass
class Entry:
    tile_id: int
    offset: int
    length: int
    run_length: int


def gunzip(data: bytes, limit: int = MAX_BYTES) -> bytes:
    """Inflate, but never to more than ``limit`` bytes."""
    d = zlib.decompressobj(31)
    try:
        out = d.decompress(data, limit + 1)
    except zlib.error as e:
        raise ArchiveError("Compression", str(e)) from e
    if len(out) > limit or d.unconsumed_tail:
        raise ArchiveError("LimitExceeded", f"more than {limit} bytes")
    if not d.eof:
        raise ArchiveError("Compression", "the data end early")
    return out


DECOMPRESS: dict[int, Callable[[bytes], bytes]] = {NONE: lambda b: b, GZIP: gunzip}
COMPRESS: dict[int, Callable[[bytes], bytes]] = {NONE: lambda b: b, GZIP: lambda b: gzip.compress(b, 9, mtime=0)}


LIMITS = {"directory": MAX_BYTES, "metadata": MAX_BYTES, "tile": MAX_BYTES, "entries": 1 << 24, "depth": 4}


def codec(table: dict[int, Callable[[bytes], bytes]], code: int, extra: dict | None = None) -> Callable[[bytes], bytes]:
    found = (extra or {}).get(code) or table.get(code)
    if not found:
        raise ArchiveError("UnsupportedCompression", COMPRESSIONS.get(code, str(code)))
    return found


def parse_header(data: bytes, size: int, strict: bool = True) -> tuple[dict, list[tuple[str, str]]]:
    """The header's fields, coordinates in degrees, and warnings of a lenient read."""
    if len(data) < HEADER:
        raise ArchiveError("InvalidMagic" if not data.startswith(MAGIC) else "Truncated", "shorter than a header")
    magic, version, *values = struct.unpack_from(LAYOUT, data)
    if magic != MAGIC:
        raise ArchiveError("InvalidMagic", "not an archive")
    if version != VERSION:
        raise ArchiveError("UnsupportedVersion", str(version))
    h = dict(zip(FIELDS, values))
    warnings = []

    def need(ok: bool, code: str, text: str):
        if not ok:
            raise ArchiveError(code, text)

    def advise(ok: bool, code: str, text: str):
        if not ok:
            if strict and code == "UnknownCompression":
                raise ArchiveError(code, text)
            warnings.append((code, text))

    need(h["clustered"] in (0, 1), "InvalidHeader", "clustered flag")
    need(h["min_zoom"] <= 31 and h["max_zoom"] <= 31 and h["center_zoom"] <= 31 and h["min_zoom"] <= h["max_zoom"], "InvalidHeader", "zooms")
    for k in ("min_lon", "max_lon", "center_lon", "min_lat", "max_lat", "center_lat"):
        h[k] /= SCALE
        need(abs(h[k]) <= (180 if "lon" in k else 90), "InvalidHeader", k)
    need(h["min_lon"] <= h["max_lon"] and h["min_lat"] <= h["max_lat"], "InvalidHeader", "bounds")
    spans = [(h[f"{n}_offset"], h[f"{n}_length"], n) for n in ("root", "metadata", "leaf", "tile")]
    for at, n, name in spans:
        need(at + n < 1 << 63, "InvalidSection", f"{name} section is too long")
        need(not n or (at >= HEADER and at + n <= size), "InvalidSection", f"{name} section outside the archive")
    full = sorted(s for s in spans if s[1])
    need(all(a[0] + a[1] <= b[0] for a, b in zip(full, full[1:])), "OverlappingSections", "sections overlap")
    need(h["root_length"] > 0, "EmptyRoot", "the root directory has no bytes")
    need(h["root_offset"] + h["root_length"] <= FIRST_READ, "InvalidRootLocation", "root directory beyond the first 16 KiB")
    advise([s[2] for s in full] == [s[2] for s in spans if s[1]], "SectionOrder", "sections in another order")
    advise(h["addressed_tiles"] > 0 and h["tile_entries"] > 0 and h["tile_contents"] > 0, "UnknownCounts", "counts are not given")
    advise(h["tile_type"] in TILE_TYPES and h["tile_type"] != 0, "UnknownTileType", str(h["tile_type"]))
    for k in ("internal_compression", "tile_compression"):
        advise(h[k] in COMPRESSIONS and h[k] != 0, "UnknownCompression" if h[k] not in COMPRESSIONS else "UnstatedCompression", k)
    return h, warnings


def encode_header(h: dict) -> bytes:
    values = [round(h[k] * SCALE) if k.endswith(("lon", "lat")) else h[k] for k in FIELDS]
    return struct.pack(LAYOUT, MAGIC, VERSION, *values)


def varints(data: bytes, count: int, at: int) -> tuple[list[int], int]:
    out = []
    for _ in range(count):
        value = shift = 0
        while True:
            if at >= len(data):
                raise ArchiveError("InvalidDirectory", "the data end early")
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                break
            shift += 7
            if shift > 63:
                raise ArchiveError("InvalidDirectory", "a number is too long")
        if value >= 1 << 63:
            raise ArchiveError("InvalidDirectory", "a number is too large")
        out.append(value)
    return out, at


def varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def decode_directory(data: bytes, most: int = LIMITS["entries"]) -> list[Entry]:
    """Columns of id steps, run lengths, lengths and offsets, where 0 means next to the last."""
    (n,), at = varints(data, 1, 0)
    if n > most:
        raise ArchiveError("LimitExceeded", f"more than {most} entries")
    if n > len(data):
        raise ArchiveError("InvalidDirectory", "more entries than bytes")
    steps, at = varints(data, n, at)
    runs, at = varints(data, n, at)
    lengths, at = varints(data, n, at)
    offsets, at = varints(data, n, at)
    if at != len(data):
        raise ArchiveError("InvalidDirectory", "bytes are left over")
    out: list[Entry] = []
    tile = 0
    for k in range(n):
        if k and not steps[k]:
            raise ArchiveError("InvalidDirectory", "ids must grow")
        tile += steps[k]
        if not lengths[k]:
            raise ArchiveError("InvalidDirectory", "an entry is empty")
        if not offsets[k] and not k:
            raise ArchiveError("InvalidDirectory", "the first entry has no offset")
        out.append(Entry(tile, offsets[k] - 1 if offsets[k] else out[-1].offset + out[-1].length, lengths[k], runs[k]))
    return out


def encode_directory(entries: list[Entry]) -> bytes:
    if not entries:
        raise ArchiveError("InvalidDirectory", "no entries")
    steps, offsets, last, end = [], [], 0, None
    for k, e in enumerate(entries):
        if k and e.tile_id <= last or e.length <= 0:
            raise ArchiveError("InvalidDirectory", "ids must grow and entries hold bytes")
        steps.append(e.tile_id - last)
        offsets.append(0 if end is not None and e.offset == end else e.offset + 1)
        last, end = e.tile_id, e.offset + e.length
    columns = [steps, [e.run_length for e in entries], [e.length for e in entries], offsets]
    return varint(len(entries)) + b"".join(varint(v) for c in columns for v in c)


def zxy_to_id(z: int, x: int, y: int) -> int:
    if not (0 <= z <= 31 and 0 <= x < 1 << z and 0 <= y < 1 << z):
        raise ArchiveError("InvalidTile", f"{z}/{x}/{y}")
    d = ((1 << 2 * z) - 1) // 3
    for k in range(z - 1, -1, -1):
        s = 1 << k
        rx, ry = int(x & s != 0), int(y & s != 0)
        d += s * s * (3 * rx ^ ry)
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
    return d


def id_to_zxy(tile: int) -> tuple[int, int, int]:
    z = 0
    while z < 31 and ((1 << 2 * (z + 1)) - 1) // 3 <= tile:
        z += 1
    t, x, y = tile - ((1 << 2 * z) - 1) // 3, 0, 0
    for k in range(z):
        s = 1 << k
        rx = t >> 1 & 1
        ry = (t ^ rx) & 1
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y, t = x + s * rx, y + s * ry, t >> 2
    return z, x, y
