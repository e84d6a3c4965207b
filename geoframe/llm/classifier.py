"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, durable, map_texts, numbered, place, table

BITS = 18
TOKEN = re.compile(r"\w+|[^\w\s]+")


def features(text: bytes | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and L2-normalised counts of the word unigrams and bigrams of a whole text.

    Words are runs of word characters or of other non-blank characters. A bigram's hash mixes
    both words in their order; immediate repetitions of any word also share one index, which
    lets the model see stuttering texts.
    """
    words = TOKEN.findall((text or b"").decode("utf-8", "replace"))
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    known = {w: zlib.crc32(w.encode()) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    mult, top = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        one = ((h + np.uint64(1)) * mult) >> top
        both = ((h[:-1] + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ h[1:]
        both ^= both >> np.uint64(29)
        two = (both * mult) >> top
    again = np.zeros(int((h[1:] == h[:-1]).sum()), np.uint64)  # index 0
    index, count = np.unique(np.concatenate([one, two, again]), return_counts=True)
    return index.astype(np.int32), (count / np.sqrt(np.dot(count, count))).astype(np.float32)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.001, l2: float = 0.1, epochs: int = 4, seed: int = 7) -> np.ndarray:
    """FTRL-proximal. Returns 2^bits weights and, last, the bias."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            index, value, label = rows[k]
            at, x = np.append(index, size), np.append(value, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(size + 1)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 6000, max_mb: int = 256, bits: int = BITS, text_col: str = "text") -> np.ndarray:
    """Train on at most ``max_rows`` labelled documents, those of least hashed id.

    The sample's bounds are ``max_rows`` and ``max_mb``, the features that the driver takes;
    where the latter is met first, fewer rows are taken, in the order of the hashes. Every chosen
    text is read whole, and the driver gets hashed features, not texts. Null labels and ids are
    left out; where an id has several labels the largest counts, and where it has several texts
    that of the least hash. Other columns are ignored. No rows: all weights are zero.
    """
    told = numbered(labels).select(F.col(f"c{place(labels, 'doc_id')}").alias("doc_id"), F.col(f"c{place(labels, label_col)}").cast("int").alias("label"))
    chosen = told.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = numbered(docs).select(F.col(f"c{place(docs, 'doc_id')}").alias("doc_id"), F.col(f"c{place(docs, text_col)}").alias("text"))
    known = rows.join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))  # max_rows bounds it
    made = durable(map_texts(known, lambda: lambda t: tuple(x.tobytes() for x in features(t, bits)), "at binary, x binary"))
    sizes = made.groupBy("doc_id").agg(F.min("h").alias("h"), F.max(F.octet_length("at") + F.octet_length("x")).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    rest, taken = max_mb * 1_000_000, []
    for r in sizes:
        rest -= r["size"]
        if rest < 0:
            break
        taken.append((r.doc_id, r.h))
    if not taken:
        return np.zeros((1 << bits) + 1, np.float32)
    own = docs.sparkSession.createDataFrame(taken, made.select("doc_id", "h").schema)
    got = {r.doc_id: r for r in made.join(F.broadcast(own), ["doc_id", "h"]).dropDuplicates(["doc_id"]).select("doc_id", "label", "at", "x").collect()}
    return train_ftrl([(np.frombuffer(r.at, np.int32), np.frombuffer(r.x, np.float32), r.label) for _, r in sorted(got.items())], bits)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Append the probability of label 1; an empty or null text gets that of the bias alone.

    Repeated rows score alike. The text goes; a column named like the result, in any case, is
    replaced and all others carried along.
    """
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2^bits floats

    def each():
        w = shared.value

        def call(text):
            index, value = features(text, bits)
            return (float(1 / (1 + np.exp(-np.clip(float(w[index] @ value) + float(w[-1]), -35, 35)))),)

        return call

    return map_texts(docs, each, f"{score_col} double", text_col)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(crc_mod(F.col("doc_id"), 5) > 0)
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
