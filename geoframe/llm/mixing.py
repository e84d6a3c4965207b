"""Mixing overlapping sources to target weights by min-cost flow.

Documents are summed by membership pattern (the set of sources that hold them). A small network
on the driver routes the words of the patterns to the quotas of the sources; each further
repetition of a pattern costs more, so fresh documents go first. What a pattern gives in full
passes goes to all its documents; the rest goes to those of least seeded hash, up to a cut that
is found from a histogram of hash prefixes and one of its bins.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, map_texts, numbered, place, renamed, table, without

BIN = 3  # hexadecimal digits of the hash that name a bin
MOST_SENT = 100_000  # patterns, or sources, whose table is broadcast
Source = str | None


def water_fill(sizes: list[int], weights: list[int], cap: int = 3) -> list[float]:
    """Shares of the sum of the sizes by weight, none above ``cap`` times its size.

    What a full source can't take is shared out again among the others by weight.
    """
    order = sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i))
    rest, weight, out = sum(sizes), sum(weights), [0.0] * len(sizes)
    for k, i in enumerate(order):
        level = rest / weight
        if cap * sizes[i] > weights[i] * level:
            for j in order[k:]:
                out[j] = weights[j] * level
            break
        out[i] = float(cap * sizes[i])
        rest -= cap * sizes[i]
        weight -= weights[i]
    return out


def min_cost_flow(patterns: list[tuple[int, list[int]]], quotas: list[int], repeats: int = 3) -> list[dict[int, int]]:
    """Words that each pattern (capacity, sources) sends to each source.

    The r-th pass over a pattern costs r*(r-1)/2 a word and nothing else costs, so a path costs
    what the pass costs that it begins with. The cheapest flow is thus found pass by pass: a
    largest flow with one pass over each pattern, made larger with two, and so on, each by
    blocking flows along shortest paths. As much of the quotas as possible is met, at the least
    cost.
    """
    n, m = len(patterns), len(quotas)
    start, end = n + m, n + m + 1
    head: list[list[int]] = [[] for _ in range(end + 1)]
    to: list[int] = []
    room: list[int] = []

    def arc(a: int, b: int, c: int) -> int:
        for x, y, r in ((a, b, c), (b, a, 0)):
            head[x].append(len(to))
            to.append(y), room.append(r)
        return len(to) - 2

    passes = [arc(start, p, 0) for p in range(n)]
    routes = [(p, s, arc(p, n + s, repeats * capacity)) for p, (capacity, sources) in enumerate(patterns) for s in sources]
    for s, quota in enumerate(quotas):
        arc(n + s, end, quota)

    def levels() -> list[int]:
        far, front = [-1] * (end + 1), [start]
        far[start] = 0
        while front and far[end] < 0:
            reached = []
            for v in front:
                for e in head[v]:
                    if room[e] and far[to[e]] < 0:
                        far[to[e]] = far[v] + 1
                        reached.append(to[e])
            front = reached
        return far

    def block(far: list[int]) -> None:
        """Fill the paths that go down the levels until each has a full arc."""
        tried, path, v = [0] * (end + 1), [], start
        while True:
            if v == end:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                full = next(k for k, e in enumerate(path) if not room[e])
                v = to[path[full] ^ 1]
                del path[full:]
                continue
            while tried[v] < len(head[v]):
                e = head[v][tried[v]]
                if room[e] and far[to[e]] == far[v] + 1:
                    path.append(e)
                    v = to[e]
                    break
                tried[v] += 1
            else:
                if v == start:
                    return
                v = to[path.pop() ^ 1]
                tried[v] += 1

    for _ in range(repeats):
        for p, e in enumerate(passes):
            room[e] += patterns[p][0]
        while (far := levels())[end] >= 0:
            block(far)
    out: list[dict[int, int]] = [{} for _ in patterns]
    for p, s, e in routes:
        if room[e ^ 1]:
            out[p][s] = room[e ^ 1]
    return out


def cyclic_weights(sources: list[Source]) -> list[int]:
    """1, 2, 3, repeating, in the order given."""
    return [k % 3 + 1 for k in range(len(sources))]


def _key(members: Column) -> Column:
    """A pattern as JSON text: its sources, each once, by code point, null last."""
    return F.to_json(F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>")))))


def _mix(docs: DataFrame, members: Column, weights: Callable[[list[Source]], list[int]], repeats: int, seed: int, id_col: str, text_col: str, keep_text: bool) -> tuple[DataFrame, list[dict]]:
    """Columns c<k> of ``docs`` with size and taken, and a dict a source; see ``mix``."""
    spark = docs.sparkSession
    rows = numbered(docs.select("*", _key(members)))
    key, id_, text = f"c{len(docs.columns)}", f"c{place(docs, id_col)}", f"c{place(docs, text_col)}"
    marked = rows.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))))
    marked = marked.withColumnRenamed(key, "key").withColumn("bin", F.substring("h", 1, BIN))
    sized = map_texts(marked.withColumn("words", F.col(text)), lambda: lambda t: (len((t or b"").split()),), "size long", "words")
    # The texts are read once to size them, and once more where they are asked for.
    slim = durable(sized.select("key", "h", "bin", "size") if keep_text else sized.drop(text))
    bins = durable(slim.groupBy("key", "bin").agg(F.sum("size").alias("size")))
    totals = {r["key"]: r["size"] for r in bins.groupBy("key").agg(F.sum("size").alias("size")).collect()}
    keys = sorted(totals)
    held = [json.loads(k) for k in keys]
    names = sorted({s for x in held for s in x}, key=lambda s: (s is None, (s or "").encode()))
    at = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for k, x in zip(keys, held):
        for s in x:
            sizes[at[s]] += totals[k]
    share = sum(totals[k] for k, x in zip(keys, held) if x)
    targets = water_fill(sizes, weights(names), repeats) if sum(sizes) == share else _scaled(sizes, weights(names), share, repeats)
    flow = min_cost_flow([(totals[k], [at[s] for s in x]) for k, x in zip(keys, held)], [int(t + 0.5) for t in targets], repeats)
    wanted = [(k, *divmod(sum(f.values()), totals[k])) if totals[k] else (k, 0, 0) for k, f in zip(keys, flow)]
    cuts = _cuts(spark, bins, slim, wanted)
    plan = spark.createDataFrame([(k, full, cuts.get(k, "")) for k, full, _ in wanted], "key string, full long, cut string")
    out = (sized if keep_text else slim).join(small(plan, len(wanted)), "key", "left")
    out = out.withColumn("taken", F.col("size") * (F.coalesce("full", F.lit(0)) + F.when(F.col("h") <= F.col("cut"), 1).otherwise(0)))
    took = [sum(f.get(i, 0) for f in flow) for i in range(len(names))]
    return out, [{"source": s, "size": sizes[i], "target": targets[i], "taken": took[i]} for i, s in enumerate(names)]


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if the table, of a row a pattern, has at most MOST_SENT rows; else joined as Spark sees fit."""
    return F.broadcast(df) if rows <= MOST_SENT else df


def mix(docs: DataFrame, members: Column, weights: Callable[[list[Source]], list[int]] = cyclic_weights, repeats: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[dict]]:
    """Choose the documents of a mix.

    ``members`` is an array of the sources that hold a document. Sources go by code point, null
    last, and get weights in that order; the quotas share the words of all documents and none
    is above ``repeats`` times its source's words. Returns ``docs`` without the text, with
    ``size`` and ``taken`` (a multiple of the size, at most ``repeats`` times it), and one dict a
    source with its source, size, target and taken words.

    A null text has no words and is taken 0. A document without sources isn't taken. Rows of
    equal id and text share a hash and are taken alike. Columns named like a result, in any case,
    are replaced. An empty table gives an empty mix. Reruns agree. The driver holds the patterns
    and sources, not documents.
    """
    out, report = _mix(docs, members, weights, repeats, seed, id_col, text_col, False)
    kept = [k for k in without(docs, "size", "taken") if k != place(docs, text_col)]
    return renamed(out, docs, kept, "size", "taken"), report


def _scaled(sizes: list[int], weights: list[int], share: int, cap: int) -> list[float]:
    """Quotas where sources overlap: they share what there is once, not the sum of the sizes."""
    order = sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i))
    rest, weight, out = float(share), sum(weights), [0.0] * len(sizes)
    for i in order:
        out[i] = min(cap * sizes[i], weights[i] * rest / weight)
        rest -= out[i]
        weight -= weights[i]
    return out


def _cuts(spark: SparkSession, bins: DataFrame, slim: DataFrame, wanted: list[tuple[str, int, int]]) -> dict[str, str]:
    """The last hash that each pattern's remainder takes; the nearest sum of words counts."""
    need = [(k, rest) for k, _, rest in wanted if rest]
    if not need:
        return {}
    upto = Window.partitionBy("key").orderBy("bin")  # at most 16^BIN rows a pattern
    edges = bins.join(small(spark.createDataFrame(need, "key string, need long"), len(need)), "key").withColumn("upto", F.sum("size").over(upto))
    edge = edges.filter("upto >= need AND upto - size < need").select("key", "bin", "need", (F.col("upto") - F.col("size")).alias("before"))
    inside = slim.select("key", "bin", "h", "size").join(small(edge, len(need)), ["key", "bin"]).groupBy("key", "need", "before", "h").agg(F.sum("size").alias("size"))
    cum = F.sum("size").over(Window.partitionBy("key").orderBy("h"))  # one bin of a pattern
    placed = inside.withColumn("upto", F.col("before") + cum)
    fits = F.col("upto") * 2 - F.col("size") <= F.col("need") * 2
    got = placed.groupBy("key").agg(F.max(F.when(fits, F.col("h"))).alias("cut"), F.min("h").alias("least")).collect()
    # Where the bin's first document is too long, the cut lies before it, after all earlier bins.
    return {r["key"]: r.cut if r.cut is not None else r.least[:-1] for r in got}


def apply_mix(docs: DataFrame, members: Column, weights: Callable[[list[Source]], list[int]] = cyclic_weights, repeats: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of a mix, with all their columns: each document as often as it is taken; the others go.

    A document without a word is in no mix and goes. For the rest see ``mix``.
    """
    out, _ = _mix(docs, members, weights, repeats, seed, id_col, text_col, True)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return renamed(out.filter(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times))), docs, without(docs))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out, report = mix(docs, F.array("source"))
    known = spark.createDataFrame([(r["source"], r["size"], r["target"]) for r in report], "source string, source_size long, target double")
    joined = out.alias("d").join(small(known, len(report)).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")), "left")
    return joined.select("d.doc_id", "d.size", "s.source_size", "s.target", "d.taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         md5(concat_ws(':', '0', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS h
  FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source NULLS LAST) AS k FROM src
), rest AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
         CAST(sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weight FROM ranked
), level AS (
  SELECT CAST(rest AS DOUBLE) / weight AS level, k FROM rest WHERE 3 * source_size > w * (CAST(rest AS DOUBLE) / weight) ORDER BY k LIMIT 1
), quota AS (
  SELECT source, source_size, CASE WHEN level.k IS NULL OR rest.k < level.k THEN CAST(3 * source_size AS DOUBLE) ELSE w * level.level END AS target FROM rest LEFT JOIN level ON true
), need AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS words FROM quota
), placed AS (
  SELECT d.doc_id, d.size, n.source_size, n.target, n.words,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS BIGINT) AS upto, CAST(sum(d.size) OVER (PARTITION BY d.source, d.h) AS BIGINT) AS unit
  FROM sized d JOIN need n ON d.source IS NOT DISTINCT FROM n.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE size * (words // source_size + CASE WHEN words % source_size > 0 AND 2 * upto - unit <= 2 * (words % source_size) THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM placed
"""
