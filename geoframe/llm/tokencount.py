"""Token counts by a linear longest-match automaton.

The pieces of a vocabulary form a trie. A failure link leads from a node to where matching goes
on once the node's longest pieces have been emitted, and a count holds how many pieces that
pops. A word is read once, left to right, and no piece is built.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table
from .sentencepiece import NORMAL, SPACE, read_model

KEPT_WORDS = 200_000
MARK = "\x02"  # stands before a word, as the mark of pieces that begin one
CODE = 21


class Automaton:
    """Counts greedy longest-match pieces of a word.

    ``starts`` are pieces that begin a word, ``parts`` those that continue one. A word that the
    pieces can't spell counts as one unknown piece.
    """

    def __init__(self, starts: set[str], parts: set[str]):
        edges: dict[int, int] = {}
        last = [False, False]  # node 0: before a word; node 1: after a piece
        for root, pieces in ((0, starts), (1, parts)):
            for piece in pieces:
                if not piece:
                    continue
                v = root
                for c in piece:
                    key = v << CODE | ord(c)
                    if key not in edges:
                        edges[key] = len(last)
                        last.append(False)
                    v = edges[key]
                last[v] = True
        below: dict[int, list[tuple[int, int]]] = {}
        for key, v in edges.items():
            below.setdefault(key >> CODE, []).append((key & (1 << CODE) - 1, v))
        fail, pops = [-1] * len(last), [0] * len(last)
        queue = deque((0, 1))
        while queue:
            u = queue.popleft()
            for c, v in below.get(u, ()):
                if last[v]:
                    fail[v], pops[v] = 1, 1
                else:
                    z, n = fail[u], pops[u]
                    while z >= 0 and (z << CODE | c) not in edges:
                        n += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = edges[z << CODE | c], n
                queue.append(v)
        self.edges, self.fail, self.pops = edges, fail, pops

    def count(self, word: str) -> int:
        """Number of pieces, or 0 for a word that can't be spelled."""
        edges, fail, pops = self.edges, self.fail, self.pops
        v, n = 0, 0
        for c in word:
            c = ord(c)
            while (v << CODE | c) not in edges:
                n += pops[v]
                v = fail[v]
                if v < 0:
                    return 0
            v = edges[v << CODE | c]
        while v != 1:
            if v <= 0 and v != 1:
                return 0
            n += pops[v]
            v = fail[v]
        return n


def vocabulary(path: str | None = None) -> tuple[set[str], set[str]]:
    """Pieces that begin a word, led by MARK, and those that continue one, of a piece model."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(read_model(path))
    pieces = [p.piece for p in proto.pieces if p.type == NORMAL]
    return {MARK + p[1:] for p in pieces if p.startswith(SPACE) and SPACE not in p[1:]}, {p for p in pieces if SPACE not in p}


def token_counts(docs: DataFrame, starts: set[str], parts: set[str], mark: str = MARK, text_col: str = "text") -> DataFrame:
    """Append n_words, n_tokens and n_unknown.

    Words are runs of characters other than ASCII white space. A word that the vocabulary can't
    spell is one token and one unknown. A null or empty text has none; repeated rows count alike.
    The text goes; columns named like a result, in any case, are replaced and all others carried
    along.
    """
    shared = docs.sparkSession.sparkContext.broadcast((starts, parts))  # a vocabulary, of fixed size

    def each():
        automaton, kept = Automaton(*shared.value), {}

        def call(text):
            words = (text or b"").split()
            n = unknown = 0
            for w in words:
                c = kept.get(w)
                if c is None:
                    if len(kept) >= KEPT_WORDS:
                        kept.clear()
                    c = automaton.count(mark + w.decode("utf-8", "replace"))
                    if len(w) <= 64:
                        kept[w] = c
                n += c or 1
                unknown += not c
            return len(words), n, unknown

        return call

    return map_texts(docs, each, "n_words long, n_tokens long, n_unknown long", text_col)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary())
