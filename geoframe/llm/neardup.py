"""Near copies by the Jaccard similarity of five-word shingles, by SimHash and the rest by bands.

Texts with one set of shingles are joined once. Sets whose SimHash fingerprints differ in 3 bits
or fewer are candidates: the trie self-join finds them. But two texts at a similarity of 0.8
differ in 10 of 64 bits on average and in 20 at times, a budget at which the trie prunes nothing.
So sets that agree in a band of least hashes are candidates as well; a pair at 0.8 agrees in none
of 32 bands of 5 values with probability 3e-6. Groups of candidates come together with their
sets, each sent once, and only pairs whose exact similarity reaches the threshold are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import durable, map_texts, numbered, place, renamed, slices, without
from .components import components
from .simhash import SEED, TO_LOWER, signed

WIDTH, SHARE, WHOLE = 5, 4, 5  # words a shingle; near copies share SHARE / WHOLE of their shingles or more
BANDS, ROWS = 32, 5
HOT = 2_000  # sets of a group that one task compares; more are dealt out by pairs of salts
BLOCK = 4_096  # shingles that are permuted at once
_draw = np.random.default_rng(SEED)
TIMES, PLUS = (_draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the shingles in order; a short text is one shingle, one without words 0."""
    words = (text or b"").translate(TO_LOWER).split()
    if not words:
        return np.zeros(1, np.uint64)
    rows = zip(*(words[k:] for k in range(width))) if len(words) > width else [words]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(x, SEED) for x in map(b" ".join, rows)), np.uint64))


def bands_of(own: np.ndarray) -> list[int]:
    """A hash of the MinHash values of each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), BLOCK):
        turned = own[None, at : at + BLOCK] * TIMES[:, None] + PLUS[:, None]
        least = np.minimum(least, (turned >> np.uint64(32)).min(1))
    return [signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)) for x in least.reshape(BANDS, ROWS)]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets reach the threshold."""
    if min(len(a), len(b)) * WHOLE < max(len(a), len(b)) * SHARE:
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return both * WHOLE >= SHARE * (len(a) + len(b) - both)


def join_group(sets: list[np.ndarray], bands: np.ndarray) -> np.ndarray:
    """The smallest position linked to each set; pairs that a link already joins aren't compared."""
    root, seen = np.arange(len(sets)), set()
    for band in bands.T:
        order = np.argsort(band, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(band[order])) + 1):
            for k, i in enumerate(run[:-1]):
                if (root[run] == root[run[0]]).all():
                    break
                rest = run[k + 1 :]
                for j in rest[root[rest] != root[i]]:
                    if root[j] == root[i] or (i, j) in seen:
                        continue
                    seen.add((i, j))
                    if similar(sets[i], sets[j]):
                        low, high = sorted((root[i], root[j]))
                        root[root == high] = low
    return root


def links(sets: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v) that connect exactly the near copies among (set, bands, grp, shingles)."""
    sizes = sets.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = sets.join(sizes, "grp").withColumn("s", F.ceil(F.col("n") / hot)).withColumn("a", F.pmod(F.xxhash64("set"), "s"))
    other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("s") - 1), lambda x: (F.col("s") == 1) | (x != F.col("a")))
    dealt = dealt.withColumn("b", F.explode(other)).select("grp", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "set", "bands", "shingles")
    placed = dealt.repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def join() -> Iterator[pa.RecordBatch]:
            root = join_group([np.frombuffer(x[2], np.uint64) for x in held], np.array([x[1] for x in held], np.int64))
            names = np.array([x[0] for x in held], np.int64)
            moved = root != np.arange(len(root))
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], names=["u", "v"])

        for batch in slices(batches):
            for *now, own, bands, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    if len(held) > 1:
                        yield from join()
                    key, held = now, []
                held.append((own, bands, packed))
        if len(held) > 1:
            yield from join()

    return placed.mapInArrow(run, "u long, v long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, budget: int = 3) -> DataFrame:
    """The rows whose id is the smallest of their group of near copies.

    A row is told by its id and text, so rows of one id with different texts are judged apart;
    rows that repeat both stay together. Rows with a null id go where their group has a row with
    an id, and stay otherwise. Null texts and texts without words are copies of each other. All
    columns are carried along, whatever their names. An empty table gives none.
    """
    id_, text = f"c{place(docs, id_col)}", f"c{place(docs, text_col)}"
    key = F.xxhash64(F.col(text)).alias("key")
    rows = numbered(docs).select(F.col(id_).alias("id"), key, F.col(text).alias("text"))

    def sign():
        def call(text):
            own = shingles(text)
            return signed(xxhash.xxh64_intdigest(own.tobytes(), SEED)), signed(simhash.majority(own)), bands_of(own)

        return call

    marked = durable(map_texts(rows, sign, "set long, fp long, bands array<long>"))
    least = durable(marked.groupBy("set").agg(F.min("id").alias("least"), F.min("key").alias("key"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    # Fingerprints that the trie connects are one more band.
    near = durable(components(simhash.links(least, "fp", budget)).select(F.col("key").alias("fp"), F.col("root").alias("near")))
    least = least.join(near, "fp", "left").withColumn("bands", F.array_append("bands", F.coalesce("near", "fp"))).drop("near", "fp")
    least = durable(least)
    keyed = least.select("set", F.posexplode("bands").alias("band", "lead"))
    first = keyed.groupBy("band", "lead").agg(F.min("set").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
    groups = durable(components(keyed.join(first, ["band", "lead"]).select(F.col("set").alias("u"), "v")))
    asked = durable(least.join(groups, least["set"] == groups["key"]).select(least["key"], "set", "bands", F.col("root").alias("grp")))
    texts = rows.select("key", "text").join(asked, "key").dropDuplicates(["key"])
    sets = durable(map_texts(texts, lambda: lambda t: (shingles(t).tobytes(),), "shingles binary"))
    linked = durable(components(links(sets, hot)))
    rooted = least.join(linked, least["set"] == linked["key"], "left").select("set", "least", F.coalesce("root", "set").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("kept")), "root").select("set", "kept")
    gone = durable(marked.join(named, "set").filter("NOT id <=> kept").select("id", "key").distinct())
    all_rows = numbered(docs).withColumn("key", key)
    left = all_rows.join(gone, all_rows[id_].eqNullSafe(gone["id"]) & (all_rows["key"] == gone["key"]), "left_anti")
    return renamed(left, docs, without(docs))
