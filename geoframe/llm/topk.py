"""Exact top-k inner products by block-at-a-time pruning.

Vectors are cut into shards by ranges of their ids, and a shard into blocks. Shards and blocks
keep each term's largest and smallest weight; their products with a query, summed, bound what
they can score. A block of queries first searches the shard that promises it most, which gives
each query a score to beat; then only shards whose bound reaches that of some query are met, and
in them a query takes the blocks from the highest bound down, scores them through the block's
forward index, and stops once the next bound is below its k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, numbered, place, table

SHARD, BLOCK, QUERIES, HEADS = 8192, 256, 512, 4096  # vectors of a shard, of a block; queries of a block; shards whose bounds are found together
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
PACK = "ids binary, rows binary, m binary, wide long, bytes long, most binary, least binary"


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, as doubles without a fraction, which hold any such number exactly.

    Null for a vector that is null or holds a null or non-finite component, or one that isn't
    finite any more when scaled.
    """
    scaled = F.transform(vector, lambda x: F.lit(scale).cast("double") * x.cast("double"))
    finite = F.forall(scaled, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf")))
    whole = F.transform(scaled, lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y))
    return F.when(vector.isNotNull() & F.coalesce(finite, F.lit(False)), whole)


def _packed(df: DataFrame, rows: int, name: str) -> DataFrame:
    """Rows (id, row, w) of a partition, in order, as rows of at most ``rows`` of them with their matrix and its extremes."""

    def out(held: list[tuple[int, int, list[float]]]) -> pa.RecordBatch:
        m = np.zeros((len(held), max(len(w) for _, _, w in held)))
        for k, (_, _, w) in enumerate(held):
            m[k, : len(w)] = w
        most, least = m.max(0), m.min(0)
        if m.size and np.abs(m).max() < 1 << 15:
            m = m.astype(np.int16)
        ids, keys = (np.array([h[k] for h in held], np.int64).tobytes() for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (ids, keys, m.tobytes(), m.shape[1], m.itemsize, most.tobytes(), least.tobytes())], names=["ids", "rows", "m", "wide", "bytes", "most", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, list[float]]] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(r)
                if len(held) == rows:
                    yield out(held)
                    held = []
        if held:
            yield out(held)

    return durable(df.select("id", "row", "w").mapInArrow(run, PACK).withColumn(name, F.monotonically_increasing_id()))


def _matrix(r: dict, prefix: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, row keys and weights of a packed row, with zeros up to ``width``."""
    ids, rows = (np.frombuffer(r[prefix + c], np.int64) for c in ("ids", "rows"))
    m = np.zeros((len(ids), width))
    m[:, : r[prefix + "wide"]] = np.frombuffer(r[prefix + "m"], np.int16 if r[prefix + "bytes"] == 2 else np.float64).reshape(len(ids), -1)
    return ids, rows, m


def product(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Inner products of matrices of whole numbers, exact; those beyond a long are the nearest long."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * max(1, d.shape[1])
    if top < 2.0**53:  # sums are exact as doubles
        return (q @ d.T).astype(np.int64)
    if top < 2.0**62:
        return q.astype(np.int64) @ d.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(d).T, LOW, HIGH).astype(np.int64)


def bounds(q: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """No score of a query is above its bound; rounding is made up for by what it can be at most."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        made = up @ most.T + down @ least.T
        slack = (up @ np.abs(most).T - down @ np.abs(least).T) * (q.shape[1] + 1) * 2.0**-52
    return np.where(np.isnan(made + slack), np.inf, made + slack)


def search_shard(query_rows: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, docs: np.ndarray, k: int, block: int = BLOCK, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids of each query's best k, ties to smaller ids, and the number of pairs scored.

    Those below the query's ``floor`` may be left out. No query meets the row of its own key.
    Missing entries have the lowest score that a long can have and the largest id.
    """
    starts = range(0, len(ids), block)
    bound = bounds(queries, np.stack([docs[s : s + block].max(0) for s in starts]), np.stack([docs[s : s + block].min(0) for s in starts]))
    order = np.argsort(-bound, axis=1, kind="stable")
    scores, found = np.full((len(queries), k), LOW), np.full((len(queries), k), HIGH)
    floor = np.full(len(queries), LOW) if floor is None else floor
    active, seen = np.arange(len(queries)), 0
    for r in range(order.shape[1]):
        own = order[active, r]
        go = bound[active, own] >= np.maximum(scores[active, k - 1], floor[active])
        active, own = active[go], own[go]  # later bounds of a query are no higher
        if not len(active):
            break
        for b in np.unique(own):
            at = active[own == b]
            s = slice(b * block, (b + 1) * block)
            got = product(queries[at], docs[s])
            seen += got.size
            new = np.broadcast_to(ids[s], got.shape)
            mine = query_rows[at][:, None] == rows[s]
            both = np.concatenate([scores[at], np.where(mine, LOW, got)], 1)
            names = np.concatenate([found[at], np.where(mine, HIGH, new)], 1)
            best = np.lexsort((names, ~both), axis=1)[:, :k]
            scores[at] = np.take_along_axis(both, best, 1)
            found[at] = np.take_along_axis(names, best, 1)
    return scores, found, seen


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", weights_col: str = "weights", own_col: str | None = None, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row of ``queries``.

    Both tables have an id and an array of whole numbers as doubles; a row with a null id or null
    weights takes no part, and shorter arrays count as ending in zeros. ``own_col`` names a long
    key of the rows of both tables: no query meets the row of its own key, and rows of one id
    are told apart by it. Without it a query meets all rows. Each query row gives its own result,
    also where ids repeat. Ties go to the smaller id; of fewer than k candidates all are
    returned. A score beyond a long is given, and ranked, as the nearest long. Other columns are
    ignored. No query or no vector gives no row.
    """

    def slim(df: DataFrame) -> DataFrame:
        key = F.lit(None).cast("long") if own_col is None else F.col(f"c{place(df, own_col)}").cast("long")
        told = numbered(df).select(F.col(f"c{place(df, id_col)}").cast("long").alias("id"), F.col(f"c{place(df, weights_col)}").cast("array<double>").alias("w"), key.alias("row"))
        return told.filter("id IS NOT NULL AND w IS NOT NULL")

    docs, asked = slim(vectors), slim(queries)
    if own_col is None:  # keys that no query and vector share
        docs, asked = docs.withColumn("row", -1 - F.monotonically_increasing_id()), durable(asked.withColumn("row", F.monotonically_increasing_id()))
    n = docs.count()
    shards = _packed(docs.repartitionByRange(max(1, -(-n // shard)), "id", "row").sortWithinPartitions("id", "row"), shard, "shard")
    blocks = _packed(asked, QUERIES, "chunk")
    size = max(1, -(-shards.count() // HEADS))
    heads = shards.select(F.pmod(F.xxhash64("shard"), F.lit(size)).alias("part"), "shard", "most", "least")
    q = blocks.select("chunk", *[F.col(c).alias(f"q_{c}") for c in ("ids", "rows", "m", "wide", "bytes")])

    def met(chunks: DataFrame, floored: bool) -> DataFrame:
        """(chunk, shard) that a block of queries has to meet; without floors, the one that promises it most."""
        pairs = chunks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")))).join(heads, "part")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    most, least = (np.frombuffer(r[c], np.float64) for c in ("most", "least"))
                    width = max(len(most), r["q_wide"])
                    most, least = (np.pad(x, (0, width - len(x))) for x in (most, least))
                    bound = bounds(_matrix(r, "q_", width)[2], most[None], least[None])[:, 0]
                    if not floored:
                        out.append((r["chunk"], r["shard"], float(bound.mean())))
                    elif (bound >= np.frombuffer(r["floor"], np.int64)).any():
                        out.append((r["chunk"], r["shard"], 0.0))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()))], names=["chunk", "shard", "hope"])

        made = pairs.mapInArrow(run, "chunk long, shard long, hope double")
        return made.select("chunk", "shard") if floored else made.groupBy("chunk").agg(F.max_by("shard", F.struct("hope", "shard")).alias("shard"))

    def searched(pairs: DataFrame, chunks: DataFrame, kinds: str, give) -> DataFrame:
        full = pairs.join(chunks, "chunk").join(shards, "shard")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    r = batch.slice(at, 1).to_pylist()[0]
                    width = max(r["wide"], r["q_wide"])
                    ids, rows, d = _matrix(r, "", width)
                    qids, qrows, w = _matrix(r, "q_", width)
                    floor = np.frombuffer(r["floor"], np.int64) if "floor" in r else None
                    yield give(r["chunk"], qids, qrows, *search_shard(qrows, w, ids, rows, d, k, floor=floor)[:2])

        return full.mapInArrow(run, kinds)

    def floors(chunk, qids, qrows, scores, found) -> pa.RecordBatch:
        least = np.where(found[:, -1] == HIGH, LOW, scores[:, -1])
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([least.tobytes()])], names=["chunk", "floor"])

    def best(chunk, qids, qrows, scores, found) -> pa.RecordBatch:
        rows = [[{"lower": int(~s), "vec_id": int(i)} for s, i in zip(a[t], b[t])] for a, b, t in zip(scores, found, found != HIGH)]
        kind = pa.list_(pa.struct([("lower", pa.int64()), ("vec_id", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(qids), pa.array(qrows), pa.array(rows, kind)], names=["query_id", "row", "best"])

    told = q.join(searched(met(q, False), q, "chunk long, floor binary", floors), "chunk")
    told = durable(told)
    found = searched(durable(met(told, True)), told, "query_id long, row long, best array<struct<lower:long,vec_id:long>>", best)
    merged = found.groupBy("query_id", "row").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))  # k from each shard that is met
    return merged.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", F.bitwise_not(F.col("b.lower")).alias("score"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("weights"))
    rows = durable(read.withColumn("row", F.monotonically_increasing_id()))
    return top_k(rows, rows.filter(F.col("vec_id") % 100 == 0), own_col="row")


OP4_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.w, d.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
