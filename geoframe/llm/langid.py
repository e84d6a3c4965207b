"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, map_texts, numbered, place, slices, small_batches, table

TOP = 400  # n-grams of a language's profile
TOP_DOC = 300  # most frequent n-grams of a document
FLUSH = 1_000_000  # distinct counts that a training task holds before it passes them on


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str, letters: np.ndarray) -> np.ndarray:
    """Codes of the 1- to 3-grams inside words, which end in one blank on either side.

    A code holds up to three code points of 21 bits. Characters that are no letters end words.
    """
    at = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    at = np.where(letters[at], at, 32)
    blank = at == 32
    keep = np.ones(len(at), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    at, blank = at[keep], blank[keep]
    two = (at[:-1] << 21) | at[1:]
    three = (two[:-1] << 21) | at[2:]
    return np.concatenate([at[~blank], two, three[~blank[1:-1]]])


def ranked(codes: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, ties to the smaller code."""
    code, n = np.unique(codes, return_counts=True)
    return code[np.argsort(-n, kind="stable")[:top]]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> DataFrame:
    """Profiles (lang, code, rank) from all rows whose language and text are not null.

    Ties go to the smaller code. Repeated rows count as often as they come; a text without
    letters adds nothing; an empty table gives no profile; other columns are ignored. Every task sums the counts of its own rows and passes sums on, at least whenever it holds
    FLUSH of them, so neither a frequent language nor a long text gathers in one task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            for lang, (code, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code), pa.array(n)], names=["lang", "code", "n"])
            sums.clear()

        for batch in slices(batches):
            by: dict[str, list[np.ndarray]] = {}
            held = 0
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, (lang, text) in enumerate(zip(langs, texts)):
                by.setdefault(lang, []).append(got := grams(bytes(text).decode("utf-8", "replace"), letters))
                held += len(got)
                if held > FLUSH or k == len(langs) - 1:
                    for own, parts in by.items():
                        code, n = np.unique(np.concatenate(parts), return_counts=True)
                        if own in sums:
                            both, inv = np.unique(np.concatenate([sums[own][0], code]), return_inverse=True)
                            code, n = both, np.bincount(inv, np.concatenate([sums[own][1], n])).astype(np.int64)
                        sums[own] = (code, n)
                    by, held = {}, 0
            if sum(len(x[0]) for x in sums.values()) > FLUSH:
                yield from out()
        yield from out()

    known = numbered(docs).select(F.col(f"c{place(docs, lang_col)}").alias("lang"), F.col(f"c{place(docs, text_col)}").cast("binary").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = known.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    # The limit stands on the row number itself, so that each task ranks its own rows and passes the first on.
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).select("lang", "code", (F.col("place") - 1).alias("rank"))


def predict(docs: DataFrame, profiles: DataFrame, text_col: str = "text", top_doc: int = TOP_DOC) -> DataFrame:
    """Append ``lang_pred`` and ``score``.

    The distance to a language is the sum, over the document's most frequent n-grams, of how far
    each is out of place in the profile, or the profile's length where it is missing. The score
    is 1 less the least distance over the largest possible one. Ties go to the first language
    by code point. A null text, one without letters and an empty training set give ``und``, 0.
    Repeated rows are judged alike. The text goes; columns named like a result, in any case, are
    replaced and all others carried along.
    """
    with small_batches(docs.sparkSession):
        rows = profiles.collect()  # at most TOP rows a language
    langs = sorted({r.lang for r in rows})
    codes = np.array(sorted({r.code for r in rows}), np.int64)
    worst = max([r.rank for r in rows], default=0) + 1
    ranks = np.full((len(codes) + 1, len(langs)), -1, np.int32)
    if rows:
        ranks[np.searchsorted(codes, [r.code for r in rows]), [langs.index(r.lang) for r in rows]] = [r.rank for r in rows]
    shared = docs.sparkSession.sparkContext.broadcast((langs, codes, ranks, worst))

    def each():
        langs, codes, ranks, worst = shared.value
        letters = letter_table()

        def call(text):
            got = ranked(grams((text or b"").decode("utf-8", "replace"), letters), top_doc)
            if not len(got) or not langs:
                return "und", 0.0
            at = np.searchsorted(codes, got)
            at[at == len(codes)] = 0
            at[codes[at] != got] = len(codes)
            there = ranks[at]
            off = np.where(there < 0, worst, np.minimum(worst, np.abs(there - np.arange(len(got))[:, None]))).sum(0)
            best = int(np.argmin(off))
            return langs[best], float(1 - off[best] / (worst * len(got)))

        return call

    return map_texts(docs, each, "lang_pred string, score double", text_col)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    guessed = predict(docs.select("doc_id", "text"), train(docs.filter(~held)))
    return guessed.select("doc_id", held.alias("held_out"), "lang_pred", "score")


#: The CRC of a text of ASCII characters: eight steps a character.
CRC_SQL = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END), CAST(4294967295 AS BIGINT))"""
OP6_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, lang, coalesce({CRC_SQL} % 4 = 2, false) AS held_out, ' ' || trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g')) || ' ' AS t FROM documents
), chars AS (
  SELECT k, string_split(t, '') AS c FROM docs WHERE length(t) > 2
), grams AS (
  SELECT k, unnest(c) AS g FROM chars UNION ALL
  SELECT k, unnest(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) FROM chars UNION ALL
  SELECT k, unnest(list_transform(list_filter(range(1, len(c) - 1), lambda i: c[i + 1] <> ' '), lambda i: c[i] || c[i + 1] || c[i + 2])) FROM chars
), counted AS (
  SELECT k, g, count(*) AS n FROM grams WHERE g <> ' ' GROUP BY k, g
), profiles AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(g), g) - 1 AS place FROM counted JOIN docs USING (k) WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, g QUALIFY place < {TOP}
), worst AS (
  SELECT max(place) + 1 AS worst FROM profiles
), own AS (
  SELECT k, g, row_number() OVER (PARTITION BY k ORDER BY n DESC, length(g), g) - 1 AS place FROM counted QUALIFY place < {TOP_DOC}
), sizes AS (
  SELECT k, count(*) AS size FROM own GROUP BY k
), saved AS (
  SELECT k, p.lang, sum(greatest(0, worst - abs(p.place - o.place))) AS saved FROM own o JOIN profiles p USING (g), worst GROUP BY k, p.lang
), off AS (
  SELECT k, l.lang, size, worst, worst * size - coalesce(saved, 0) AS off FROM sizes CROSS JOIN (SELECT DISTINCT lang FROM profiles) l CROSS JOIN worst LEFT JOIN saved USING (k, lang)
), best AS (
  SELECT k, lang, 1 - CAST(off AS DOUBLE) / CAST(worst * size AS DOUBLE) AS score FROM off QUALIFY row_number() OVER (PARTITION BY k ORDER BY off, lang) = 1
)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(score, 0) AS score FROM docs LEFT JOIN best USING (k)
"""
