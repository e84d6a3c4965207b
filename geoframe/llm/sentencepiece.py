"""Offset-preserving SentencePiece encoding and decoding of BPE models.

A text is normalised by the longest match in the model's compiled character map, and every
byte of the normalised text keeps the place of the original bytes that it came from, so that
each piece is projected back to a span of the original UTF-8 bytes. Pieces are then merged in
chunks that no piece of the vocabulary can cross; chunks repeat, so their pieces are kept.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, numbered, place, renamed, table, without

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the model format
KEPT_CHUNKS = 400_000
SHORT = 64  # characters of a chunk that is kept, and merged by scans instead of a heap
NEVER = float("inf")


class Kept(dict):
    """Values that a function makes of short chunks when first asked for, KEPT_CHUNKS at most.

    When half of that is held, it becomes the older half and the one before goes; what is asked
    for again moves on, so frequent chunks stay.
    """

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, chunk: str):
        got = self.older.get(chunk)
        if got is None:
            got = self.make(chunk)
        if len(chunk) <= SHORT:
            if len(self) >= KEPT_CHUNKS // 2:
                self.older = dict(self)
                self.clear()
            self[chunk] = got
        return got


class CharacterMap:
    """A compiled map: a double-array trie of UTF-8 keys whose values point into a text pool."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.pool = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``start`` and what it becomes."""
        if not self.units:
            return None
        units, at, found = self.units, self._offset(self.units[0]), None
        for k in range(start, len(data)):
            c = data[k]
            at ^= c
            unit = units[at]
            if unit & 0x800000FF != c:
                break
            at ^= self._offset(unit)
            if unit & 0x100:
                value = units[at] & 0x7FFFFFFF
                found = (k + 1 - start, self.pool[value : self.pool.index(b"\0", value)])
        return found


class Model:
    """A BPE model read from the bytes of a model file."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(blob)
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != 2 or any(p.type == USER_DEFINED for p in proto.pieces) or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models without user-defined symbols and with blanks as prefixes are supported")
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, UNUSED)}
        self.order = {p.piece: -p.score for p in proto.pieces if p.type in (NORMAL, UNUSED)}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.unknown_text = trainer.unk_surface.encode()
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            self.chunk = re.compile(r".+", re.S)
        else:
            end = "" if any("\n" in p for p in self.ids if len(p) > 1) else "\n"
            signs = re.escape("".join(sorted(self._signs())))
            word = f"[^{SPACE}{end}{signs}]+"
            signed = f"{SPACE}*[{signs}]*{word}|{SPACE}*[{signs}]+" if signs else f"{SPACE}*{word}"
            self.chunk = re.compile(f"{signed}|{SPACE}+" + (f"|{end}" if end else ""))
        self.plain = [p.replace(SPACE, " ").encode() if t in (NORMAL, UNUSED) else None for p, t in zip(self.pieces, self.types)]
        self.names = [str(i) for i in range(len(self.pieces))]
        self.kept = Kept(self.merge)
        self.digests = Kept(self._digest)

    def _signs(self) -> set[str]:
        """Characters, no letters, that follow only each other and marks in the pieces, so that a chunk may end before them."""
        pairs = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        signs = {c for c in {*string.punctuation, *"".join(self.ids)} if not c.isalpha() and c not in (SPACE, "\n")}
        while gone := {b for a, b in pairs if b in signs and a != SPACE and a not in signs}:
            signs -= gone
        return signs

    # normalisation

    def normalise(self, data: bytes) -> tuple[str, list[int] | None]:
        """The normalised text and, for each of its bytes and its end, the original offset.

        The offsets are None where each original byte keeps its place but for blanks and the
        added prefix; then they follow from the text itself.
        """
        text = data.decode("utf-8", "replace")
        if not text:
            return "", [0]
        if not self.map.units and not self.squeeze:
            mark = SPACE if self.escape else " "
            return (mark if self.dummy else "") + (text.replace(" ", SPACE) if self.escape else text), None
        data = text.encode()
        parts: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit:
                n, out = hit
            else:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                out = data[at : at + n]
            parts.append((out, at, at + n))
            at += n
        if self.squeeze:
            while parts and not parts[0][0].strip(b" "):
                parts.pop(0)
        if not parts:
            return "", [0]
        mark = SPACE.encode() if self.escape else b" "
        out, where = bytearray(), []

        def add(piece: bytes, origin: int):
            out.extend(piece)
            where.extend([origin] * len(piece))

        if self.dummy:
            add(mark, parts[0][1])
        blank = self.squeeze
        for piece, begin, _ in parts:
            if blank:
                piece = piece.lstrip(b" ")
            for c in re.findall(rb" |[^ ]+", piece):
                add(mark if c == b" " else c, begin)
            if piece:
                blank = self.squeeze and piece.endswith(b" ")
        end = parts[-1][2]
        if self.squeeze:
            while out.endswith(mark):
                end = where[-len(mark)]
                del out[-len(mark) :], where[-len(mark) :]
        return out.decode(), [*where, end]

    # encoding

    def _merged(self, chunk: str) -> list[str]:
        """The pieces of a chunk: the best pair of neighbours is merged, the first of equals, till none is left."""
        parts, cost = list(chunk), self.order.get
        costs = [cost(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while costs and (least := min(costs)) < NEVER:
            k = costs.index(least)
            parts[k] += parts.pop(k + 1)
            costs.pop(k)
            if k < len(costs):
                costs[k] = cost(parts[k] + parts[k + 1], NEVER)
            if k:
                costs[k - 1] = cost(parts[k - 1] + parts[k], NEVER)
        return parts

    def _merged_long(self, chunk: str) -> list[str]:
        """The same through a heap of pairs."""
        text: list[str | None] = list(chunk)
        n, order = len(text), self.order
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int):
            if a >= 0 and b < n:
                both = text[a] + text[b]
                if both in order:
                    heapq.heappush(heap, (order[both], a, b, both))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if text[a] is None or text[b] is None or right[a] != b or len(text[a]) + len(text[b]) != len(both):
                continue
            text[a], text[b] = both, None
            right[a] = right[b]
            if right[b] < n:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [x for x in text if x is not None]

    def merge(self, chunk: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """Ids of a chunk and the number of its characters that each covers; later bytes cover none."""
        parts = self._merged(chunk) if len(chunk) <= SHORT else self._merged_long(chunk)
        ids = [*map(self.ids.get, parts)]
        if None not in ids:
            return tuple(ids), tuple(map(len, parts))
        ids, spans = [], []
        for piece in parts:
            if piece in self.ids:
                ids.append(self.ids[piece])
                spans.append(len(piece))
            elif self.bytes:
                raw = piece.encode()
                ids.extend(self.bytes[c] for c in raw)
                spans.extend([len(piece)] + [0] * (len(raw) - 1))
            elif ids and ids[-1] == self.unknown:  # unknown characters in a row are one piece
                spans[-1] += len(piece)
            else:
                ids.append(self.unknown)
                spans.append(len(piece))
        return tuple(ids), tuple(spans)

    def encode(self, data: bytes) -> list[int]:
        ids: list[int] = []
        for chunk in self.chunk.findall(self.normalise(data)[0]):
            got = self.kept[chunk][0]
            if not self.bytes and ids and got and ids[-1] == got[0] == self.unknown:
                got = got[1:]
            ids.extend(got)
        return ids

    def encode_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(id, begin, end) of every piece, in bytes of the original text.

        A character that falls back to bytes is covered by the first of them; the others are empty.
        """
        normal, where = self.normalise(data)
        whole = data.decode("utf-8", "replace").encode()
        out: list[tuple[int, int, int]] = []
        at, origin = 0, 0  # in bytes of the normalised and of the original text
        for chunk in self.chunk.findall(normal):
            ids, spans = self.kept[chunk]
            k = 0
            for piece, n in zip(ids, spans):
                part = chunk[k : k + n]
                k += n
                begin = origin if where is None else where[at]
                if where is None:
                    for c in part:
                        if self.dummy and at == 0 and c in (SPACE, " "):
                            at += len(c.encode())
                            continue
                        at += len(c.encode())
                        origin += 1 if c == SPACE and whole[origin : origin + 1] == b" " else len(c.encode())
                    end = origin
                else:
                    at += len(part.encode())
                    end = where[at] if n else begin
                if out and not self.bytes and piece == self.unknown == out[-1][0]:
                    out[-1] = (piece, out[-1][1], end)
                else:
                    out.append((piece, begin, end))
        return out

    # decoding

    def decode(self, ids: list[int]) -> bytes:
        out, raw, first = [], bytearray(), True

        def flush():
            if raw:
                out.append(decoded_bytes(bytes(raw)))
                raw.clear()

        for i in ids:
            kind = self.types[i]
            if kind == BYTE:
                raw.append(int(self.pieces[i][1:-1], 16))
                first = False
                continue
            flush()
            if kind == CONTROL:
                continue
            piece = self.unknown_text if kind == UNKNOWN else self.pieces[i].encode()
            mark = SPACE.encode()
            if kind != UNKNOWN:
                if first and (self.dummy or self.squeeze) and piece.startswith(mark):
                    piece = piece[len(mark) :]
                    if self.squeeze:
                        first = True
                        if not piece:
                            continue
                piece = piece.replace(mark, b" ")
            first = False
            out.append(piece)
        flush()
        return b"".join(out)

    def _digest(self, chunk: str) -> tuple[int, str, bytes, bytes]:
        """Number of ids of a chunk, the ids as text, their decoding inside a text, and the
        lengths of their spans, as 32-bit numbers, where the chunk's marks stand for blanks."""
        ids, spans = self.merge(chunk)
        if not chunk.lstrip(SPACE).isascii():  # else a character is a byte, and so is the blank of a mark
            wide, k = [], 0
            for n in spans:
                wide.append(len(chunk[k : k + n].replace(SPACE, " ").encode()))
                k += n
            spans = wide
        sizes = struct.pack(f"<{len(spans)}I", *spans)
        try:
            plain = b"".join([self.plain[i] for i in ids])
        except TypeError:  # bytes decode together; another piece before them keeps a leading blank
            lead = self.ids[SPACE]
            plain = self.decode([lead, lead, *ids])[2 - (self.dummy or self.squeeze) :]
        return len(ids), ",".join([self.names[i] for i in ids]), plain, sizes

    def digest(self, data: bytes) -> tuple[int, str, str, str]:
        """Number of ids and SHA-256 of the ids, of their decoding and of their spans, joined chunk by chunk."""
        mark = SPACE if self.escape else " "
        if not self.bytes or SPACE not in self.ids or self.squeeze or self.map.units or SPACE.encode() in data:
            own = self.encode_spans(data)  # pieces or blanks may join across chunks, or a mark be no blank
            ids = [i for i, _, _ in own]
            return len(ids), sha(",".join(map(str, ids)).encode()), sha(self.decode(ids)), span_digest(np.array([x[1:] for x in own], "<u4").reshape(-1, 2))
        chunks = self.chunk.findall(self.normalise(data)[0])
        counts, ids, texts, sizes = zip(*map(self.digests.__getitem__, chunks)) if chunks else ((), (), (), ())
        plain = b"".join(texts)
        if self.dummy and plain.startswith(b" "):
            plain = plain[1:]
        wide = np.frombuffer(bytearray().join(sizes), "<u4")
        if self.dummy and len(wide):  # the mark that was put before the text covers none of it
            wide[0] -= len(mark.replace(SPACE, " "))
        spans = np.empty((len(wide), 2), "<u4")
        np.cumsum(wide, out=spans[:, 1])
        np.subtract(spans[:, 1], wide, out=spans[:, 0])
        return sum(counts), sha(",".join(ids).encode()), sha(plain), span_digest(spans)


def span_digest(spans: np.ndarray) -> str:
    """SHA-256 of the spans (begin, end), one after the other, as 32-bit numbers, the low byte first."""
    return sha(np.ascontiguousarray(spans, "<u4").tobytes())


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def decoded_bytes(raw: bytes) -> bytes:
    """UTF-8 of the valid characters; each byte that is part of none becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        lead = raw[at]
        n = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        try:
            if not n or at + n > len(raw):
                raise ValueError
            raw[at : at + n].decode()
            out.append(raw[at : at + n])
            at += n
        except ValueError:
            out.append("�".encode())
            at += 1
    return b"".join(out)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_model(path: str | None = None) -> bytes:
    with open(path or default_model(), "rb") as f:
        return f.read()


def _model(docs: DataFrame, path: str | None):
    return docs.sparkSession.sparkContext.broadcast(read_model(path))  # a model file, of fixed size


def model_of(shared) -> Model:
    """The model of a broadcast file; a Python worker keeps it, and its chunks, from one task to the next."""
    if not hasattr(shared, "model"):
        shared.model = Model(shared.value)
    return shared.model


def encode(docs: DataFrame, model_path: str | None = None, text_col: str = "text") -> DataFrame:
    """Append ``pieces``, an array of (id, begin, end) with byte spans of the original text.

    A null or empty text has no pieces. Repeated rows are encoded alike. The text goes; a column
    named like the result, in any case, is replaced and all others carried along. The model is
    read by the driver and sent to the executors, which need no copy of the file.
    """
    shared = _model(docs, model_path)

    def each():
        model = model_of(shared)
        return lambda text: ([{"id": i, "begin": b, "end": e} for i, b, e in model.encode_spans(text or b"")],)

    return map_texts(docs, each, "pieces array<struct<id:int,begin:int,end:int>>", text_col)


def decode(df: DataFrame, model_path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """Append ``decoded``, the text of a column of id arrays; a null or empty array gives the empty text.

    All columns are carried along but one named like the result, in any case, which is replaced.
    """
    from pyspark.sql import functions as F

    shared = _model(df, model_path)

    def each():
        model = model_of(shared)
        return lambda ids: (model.decode([int(x) for x in ids.split(b",")] if ids else []).decode(),)

    kept, plain = without(df, "decoded"), numbered(df)
    joined = plain.withColumn("ids", F.array_join(F.col(f"c{place(df, ids_col)}").cast("array<string>"), ","))
    return renamed(map_texts(joined, each, "decoded string", "ids"), df, kept, "decoded")


def digests(docs: DataFrame, model_path: str | None = None, text_col: str = "text") -> DataFrame:
    """Append n_tokens and the SHA-256 of the ids, of the decoded text and of the pieces' spans.

    The spans are those of ``encode``, in bytes of the original text. A null or empty text has no
    pieces. Repeated rows have equal digests. The text goes; columns named like a result, in any
    case, are replaced and all others carried along.
    """
    shared = _model(docs, model_path)

    def each():
        model = model_of(shared)
        return lambda text: model.digest(text or b"")

    return map_texts(docs, each, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string", text_col)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
