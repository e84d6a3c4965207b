"""Line dedup by a suffix array over line-ID sequences, sorted by distributed prefix doubling.

The distinct texts, in the order of their ids, form one sequence of line IDs in which no run
crosses the end of a text. Suffixes are ranked by their first 1, 2, 4, ... lines: each round
range-sorts the suffixes that still share their rank by the pair of ranks before, with the place
as last key, so that a frequent line or passage is dealt over many tasks; a rank is the place of
a group's first member in the suffix array. Rounds end when no two suffixes share a rank.

The common prefix of neighbours in the array is compared where it isn't told by the line before
both (then it is one less than theirs). From the array and these lengths follow the intervals of
common prefix: of the suffixes of an interval all but the first in the corpus are later copies
of a run as long as the interval is deep. Slices of the array are reduced by a stack, and what
reaches over their ends, at most a few suffixes a line of the longest run, is reduced again.
A later copy goes where its longest run has ``min_words`` words or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Saved, durable, map_texts, numbered, place, renamed, slices, table, without

MIN_WORDS = 25
LONG = (1 << 63) - 1
ENDS = 20_000  # suffixes at the ends of slices that the driver reduces itself; more take another round
SLICE = 10_000  # suffixes that are worth a partition of their own
KEYS = ("k1", "k2", "k3")


def lines_of(text: bytes | None, min_words: int) -> list[dict]:
    """The lines with words of a text that has min_words words: number, two hashes, words."""
    out, total = [], 0
    for number, line in enumerate((text or b"").split(b"\n")):
        n = len(line.split())
        if n:
            total += n
            own = line.strip()
            out.append({"line": number, "h1": xxhash.xxh64_intdigest(own, 1) - (1 << 63), "h2": xxhash.xxh64_intdigest(own, 2) - (1 << 63), "n": n})
    return out if total >= min_words else []


# places in a sorted order, of groups that may span partitions


def _ordered(df: DataFrame, rows: int | None = None) -> tuple[Saved, DataFrame, int]:
    """Sort by (a, b, pos) and tell the groups of equal a and of equal (a, b).

    ``rows`` is how many there are at most, if known; few rows take fewer partitions.

    Appends ``start_a`` and ``start_b``, the places of the first rows of a row's groups in the
    whole order, and ``alone``. Also returns the number of rows that aren't alone, or more. The
    driver gets one row a partition.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = parts if rows is None else min(parts, rows // SLICE + 1)
    spread = df.repartitionByRange(parts, "a", "b", "pos").sortWithinPartitions("a", "b", "pos").withColumn("pid", F.spark_partition_id())
    schema = T.StructType([*spread.schema.fields, *T.StructType.fromDDL("i long, in_a long, in_b long, lone boolean, last boolean").fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one partition of a sort
        if not sum(x.num_rows for x in held):
            return
        a, b = (np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in held]) for k in ("a", "b"))
        at = np.arange(len(a))
        new_a = np.r_[True, a[1:] != a[:-1]]
        new_b = new_a | np.r_[True, b[1:] != b[:-1]]
        in_a, in_b = (np.maximum.accumulate(np.where(new, at, 0)) for new in (new_a, new_b))
        made = [at, in_a, in_b, new_b & np.r_[new_b[1:], True], in_b == in_b[-1]]
        k = 0
        for x in held:
            yield pa.RecordBatch.from_arrays([*x.columns, *[pa.array(m[k : k + x.num_rows]) for m in made]], names=names)
            k += x.num_rows

    saved = Saved(spread.mapInArrow(run, schema))
    key = F.struct("a", "b")
    told = saved.df.groupBy("pid").agg(
        F.count("*").alias("n"), F.max("in_a").alias("a"), F.max("in_b").alias("b"), F.min_by(key, "i").alias("first"), F.max_by(key, "i").alias("last"), F.sum((~F.col("lone")).cast("long")).alias("many")
    )
    offset, before, run_a, run_b, rows, tied = 0, None, 0, 0, [], 0
    for r in sorted(told.collect(), key=lambda r: r.pid):
        same_a = before is not None and before.a == r.first.a
        same_b = same_a and before.b == r.first.b
        if same_b:
            rows[-1][-1] = True
        rows.append([r.pid, offset, run_a if same_a else offset, run_b if same_b else offset, same_b, False])
        run_a, run_b = (first if not inner else offset + inner for first, inner in ((rows[-1][2], r.a), (rows[-1][3], r.b)))
        before, offset, tied = r["last"], offset + r.n, tied + r.many + same_b
    places = spark.createDataFrame(rows, "pid int, offset long, first_a long, first_b long, joins boolean, joined boolean")
    full = saved.df.join(F.broadcast(places), "pid")  # one row a partition
    start = lambda x: F.when(F.col(f"in_{x}") == 0, F.col(f"first_{x}")).otherwise(F.col("offset") + F.col(f"in_{x}"))
    alone = F.col("lone") & ~((F.col("in_b") == 0) & F.col("joins")) & ~(F.col("last") & F.col("joined"))
    return saved, full.select(*df.columns, start("a").alias("start_a"), start("b").alias("start_b"), (F.col("offset") + F.col("i")).alias("order"), alone.alias("alone")), tied


# the suffix array


def _corpus(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[Saved, DataFrame]:
    """Texts (d, k1, k2, k3, lines) with the place d of their first line, each text once, and (k1, k2, k3, lines) of later copies."""
    doc, text = F.col(f"c{place(docs, id_col)}"), F.col(f"c{place(docs, text_col)}")
    keys = {"k1": F.coalesce(doc.cast("long"), F.lit(LONG)), "k2": F.xxhash64(F.coalesce(text, F.lit(""))), "k3": F.xxhash64(F.lit(1), F.coalesce(text, F.lit("")))}
    read = map_texts(numbered(docs).select(*[c.alias(n) for n, c in keys.items()], text.alias("text")), lambda: lambda t: (lines_of(t, min_words),), "lines array<struct<line:int,h1:long,h2:long,n:int>>")
    rows = Saved(read.filter(F.size("lines") > 0).groupBy(*KEYS).agg(F.first("lines").alias("lines")))
    _, told, _ = _ordered(rows.df.select(F.col("k2").alias("a"), F.col("k3").alias("b"), F.col("k1").alias("pos"), "lines"))
    first = F.col("order") == F.col("start_b")
    told = told.select(F.col("pos").alias("k1"), F.col("a").alias("k2"), F.col("b").alias("k3"), "lines", first.alias("first"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = told.filter("first").drop("first").repartitionByRange(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "k3").withColumn("pid", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for x in batches:
            size = x.column("lines").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) + 1  # a free place after each text
            d = at + np.cumsum(size) - size + (x.column("pid").to_numpy().astype(np.int64) << 40)
            at += int(size.sum())
            yield pa.RecordBatch.from_arrays([pa.array(d), *x.columns[:4]], names=["d", *KEYS, "lines"])

    corpus = Saved(spread.mapInArrow(number, "d long, k1 long, k2 long, k3 long, lines array<struct<line:int,h1:long,h2:long,n:int>>"))
    return corpus, told.filter("NOT first").drop("first")


def suffix_array(lines: DataFrame) -> Saved:
    """(rank, pos, d, n, g, level) of all suffixes that share their first line with another.

    ``lines`` are (pos, d, n, h1, h2). ``rank`` is the place in the suffix array, ``g`` that of
    the first suffix with the same first line; 2^level lines tell the suffix from all others.
    """
    saved, told, tied = _ordered(lines.select(F.col("h1").alias("a"), F.col("h2").alias("b"), "pos", "d", "n"))
    state = Saved(told.filter("NOT alone").select("pos", "d", "n", F.col("start_b").alias("g"), F.col("start_b").alias("rank"), F.lit(False).alias("settled")))
    saved.drop()
    tables, size, level = [], 1, 0
    done = state.df.drop("settled").withColumn("level", F.lit(0)).limit(0)
    while tied:
        level += 1
        next_ = state.df.select((F.col("pos") - size).alias("pos"), F.col("rank").alias("b"))
        # No suffix goes on alike after a line that occurs once or after the end of a text.
        pairs = state.df.filter("NOT settled").join(next_, "pos", "left").select(F.col("rank").alias("a"), F.coalesce("b", -1 - F.col("pos")).alias("b"), "pos", "d", "n", "g")
        saved, told, tied = _ordered(pairs, tied)
        tables.append(saved)
        ranked = told.select("pos", "d", "n", "g", (F.col("a") + F.col("start_b") - F.col("start_a")).alias("rank"), F.col("alone").alias("settled"))
        done = done.unionByName(ranked.filter("settled").drop("settled").withColumn("level", F.lit(level)))
        if tied:  # ranks are looked up on in texts with suffixes that still share theirs
            live = ranked.filter("NOT settled").select("d").distinct()
            before, state = state, Saved(state.df.filter("settled").unionByName(ranked).join(live, "d", "left_semi"))
            before.drop()
        size *= 2
    array = Saved(done)
    for x in [*tables, state]:
        x.drop()
    return array


def common_prefixes(array: DataFrame, corpus: DataFrame) -> Saved:
    """(rank, pos, d, n, lcp): the lines that each suffix shares with the one before it in the array."""
    before = array.select((F.col("rank") + 1).alias("rank"), "g", F.col("pos").alias("j"), F.col("d").alias("dj"), F.col("level").alias("level_j"))
    met = array.join(before, ["rank", "g"], "left")
    own = Window.partitionBy("d").orderBy("pos")  # one text
    # Where the lines before both are neighbours too, this prefix is theirs without its first line.
    told = (F.lag("pos").over(own) == F.col("pos") - 1) & (F.lag("j").over(own) == F.col("j") - 1)
    marked = met.withColumn("head", F.when(F.coalesce(told, F.lit(False)), F.lit(None)).otherwise(F.col("pos")))
    marked = marked.withColumn("head", F.last("head", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("most", F.expr("shiftleft(1, least(level, level_j))"))
    held = Saved(marked.select("rank", "pos", "d", "n", "j", "dj", "head", "most"))
    asked = held.df.filter("pos = head AND most > 2")
    part = lambda d, pos: F.transform(F.slice("lines", (F.col(pos) - F.col(d) + 1).cast("int"), F.col("most")), lambda x: F.struct(x["h1"], x["h2"]))
    one = asked.join(corpus.select("d", "lines"), "d").select("pos", "j", "dj", "most", part("d", "pos").alias("x"))
    two = one.join(corpus.select(F.col("d").alias("dj"), "lines"), "dj").select("pos", "x", part("dj", "j").alias("y"))
    same = F.zip_with("x", "y", lambda x, y: F.coalesce(x == y, F.lit(False)))
    off = F.array_position(same, F.lit(False))
    found = two.select(F.col("pos").alias("head"), F.when(off == 0, F.size(same)).otherwise(off - 1).cast("long").alias("found"))
    length = F.when(F.col("j").isNull(), 0).when(F.col("most") == 2, 1).otherwise(F.col("found") - F.col("pos") + F.col("head"))
    out = Saved(held.df.join(found, "head", "left").select("rank", "pos", "d", "n", length.cast("long").alias("lcp")))
    held.drop()
    return out


# intervals of common prefix


def reduce_slice(pos: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a slice of the suffix array tells by itself.

    Returns for each suffix the depth of the deepest interval within the slice that holds an
    earlier place (``pos``); whether it may lie in a deeper one over an end of the slice, or be
    the earlier place of one; and the lines shared with the last suffix before that is kept.
    """
    n, p, l = len(pos), pos.tolist(), lcp.tolist()
    depth, link, stack = [0] * n, [0] * n, []
    for k in range(n):
        c = l[k] if k else 0
        while stack and p[stack[-1]] > p[k]:
            e = stack.pop()
            depth[e] = max(depth[e], c)  # k is the next earlier place to the right of e
            c = min(c, link[e])
        if stack:
            depth[k] = c
        link[k] = c
        stack.append(k)
    keep = np.zeros(n, bool)
    for order, step in ((range(n), 0), (range(n - 1, -1, -1), 1)):
        chain: list[tuple[int, int]] = []  # earliest places seen from an end, each at another depth
        c = 1 << 62
        for k in order:
            c = min(c, l[k + 1] if step and k + 1 < n else c if step else l[k])
            if c <= 0:
                break
            if not chain or p[k] < p[chain[-1][0]]:
                if chain and chain[-1][1] == c:
                    chain.pop()
                chain.append((k, c))
        keep[[k for k, _ in chain]] = True
    shared, c = np.zeros(n, np.int64), 1 << 62
    for k in range(n):
        c = min(c, l[k])
        if keep[k]:
            shared[k], c = c, 1 << 62
    return np.array(depth, np.int64), keep, shared


def repeated_before(prefixes: DataFrame, ends: int = ENDS) -> DataFrame:
    """(pos, d, n, depth): the longest run of each suffix that has an earlier copy, in lines."""
    spark = prefixes.sparkSession
    schema = "rank long, pos long, d long, n int, lcp long, depth long, keep boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def reduced(x: pa.Table) -> pa.Table:
        depth, keep, shared = reduce_slice(x["pos"].to_numpy(), x["lcp"].to_numpy())
        deepest = np.maximum(depth, x["depth"].to_numpy())
        return pa.table([x["rank"], x["pos"], x["d"], x["n"], pa.array(shared), pa.array(deepest), pa.array(keep)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one slice
        if held:
            yield from reduced(pa.Table.from_batches(held)).to_batches()

    rows, done = prefixes.withColumn("depth", F.lit(0).cast("long")), []
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    while True:
        spread = rows.repartitionByRange(parts, "rank").sortWithinPartitions("rank")
        saved = Saved(spread.select(*names[:-1]).mapInArrow(run, schema))
        done.append(saved.df.filter("NOT keep"))
        rows = saved.df.filter("keep").drop("keep")
        if rows.count() <= ends:
            last = reduced(rows.orderBy("rank").toArrow())
            done.append(spark.createDataFrame(last.cast(pa.schema(zip(names, [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2 + [pa.bool_()])))))
            break
        parts = max(1, parts // 16)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("pos", "d", "n", "depth")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, k3, gone): for each line of a document up to the last that goes, whether it goes.

    k1 is the id, with null as the largest long, and (k2, k3) a hash of the text. The order of
    documents is that of these keys; rows of equal id and text count as one document.
    """
    corpus, copies = _corpus(docs, id_col, text_col, min_words)
    lines = corpus.df.select("d", F.posexplode("lines").alias("at", "x")).select((F.col("d") + F.col("at")).alias("pos"), "d", "x.n", "x.h1", "x.h2")
    array = suffix_array(lines)
    prefixes = common_prefixes(array.df, corpus.df)
    array.drop()
    depths = repeated_before(prefixes.df).filter((F.col("depth") > 1) | (F.col("depth") == 1) & (F.col("n") >= min_words))
    runs = depths.groupBy("d").agg(F.collect_list(F.struct((F.col("pos") - F.col("d")).cast("int").alias("at"), F.col("depth").cast("int").alias("lines"))).alias("runs"))  # of one text
    held = corpus.df.join(runs, "d").select(*KEYS, F.transform("lines", lambda x: x["line"]).alias("line"), F.transform("lines", lambda x: x["n"]).alias("n"), "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            masks = []
            for line, n, own in zip(*(c.to_pylist() for c in batch.columns[3:])):
                words, mask, done = np.r_[0, np.cumsum(n)], np.zeros(line[-1] + 1, bool), -1
                for r in sorted(own, key=lambda r: (r["at"], -r["lines"])):
                    end = r["at"] + r["lines"]
                    if end > done and words[end] - words[r["at"]] >= min_words:
                        mask[line[r["at"]] : line[end - 1] + 1] = True
                        done = end
                masks.append(mask[: int(np.flatnonzero(mask)[-1]) + 1].tolist() if mask.any() else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(masks, pa.list_(pa.bool_()))], names=[*KEYS, "gone"])

    found = held.mapInArrow(run, "k1 long, k2 long, k3 long, gone array<boolean>").filter("gone IS NOT NULL")
    first, last = F.get("lines", 0)["line"], F.element_at("lines", -1)["line"]
    whole = copies.select(*KEYS, F.transform(F.sequence(F.lit(0), last), lambda k: k >= first).alias("gone"))
    return durable(found.unionByName(whole))


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the later copies of repeated line runs, and with n_lines, n_removed.

    Lines end at a newline and are compared without ASCII white space around them; lines without
    words count for nothing, and go where they lie inside a run. The first place of a run, by id
    and then place, stays. A null text stays null, with no lines; an empty one has one line.
    Rows with a null id come last. Repeated rows lose the same lines. An empty table gives none.
    Columns named like a result, in any case, are replaced; all others are carried along.
    """
    kept, text = without(docs, "n_lines", "n_removed"), f"c{place(docs, text_col)}"
    masks = repeated_runs(docs, id_col, text_col, min_words)
    keys = {"k1": F.coalesce(F.col(f"c{place(docs, id_col)}").cast("long"), F.lit(LONG)), "k2": F.xxhash64(F.coalesce(F.col(text), F.lit(""))), "k3": F.xxhash64(F.lit(1), F.coalesce(F.col(text), F.lit("")))}
    joined = numbered(docs).withColumns(keys).join(masks.hint("merge"), list(KEYS), "left")  # masks grow with the documents
    parts = F.split(F.col(text), "\n", -1)
    left = F.array_join(F.filter(parts, lambda x, k: ~F.coalesce(F.get(F.col("gone"), k), F.lit(False))), "\n")
    made = {
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long"),
        "n_removed": F.coalesce(F.size(F.filter(F.when(F.col("gone").isNull(), F.array().cast("array<boolean>")).otherwise(F.col("gone")), lambda x: x)), F.lit(0)).cast("long"),
        text: F.when(F.col("gone").isNull(), F.col(text)).otherwise(left),
    }
    return renamed(joined.withColumns(made), docs, kept, "n_lines", "n_removed")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


#: Pairs of equal lines, of which one comes earlier, on one diagonal of two texts make up the common runs.
OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), used AS (
  SELECT doc_id, line, regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS own, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
         row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k
  FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), pairs AS (
  SELECT a.doc_id, a.k, a.line, a.n, b.doc_id AS other, a.k - b.k AS diagonal
  FROM used a JOIN used b ON a.own = b.own AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.k < a.k)
), islands AS (
  SELECT *, k - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY k) AS island FROM pairs
), runs AS (
  SELECT DISTINCT doc_id, min(line) AS a, max(line) AS b FROM islands GROUP BY doc_id, other, diagonal, island HAVING sum(n) >= 25
), gone AS (
  SELECT DISTINCT doc_id, line FROM runs JOIN lines USING (doc_id) WHERE line BETWEEN a AND b
), left_ AS (
  SELECT doc_id, count(*) FILTER (gone.line IS NOT NULL) AS n_removed, count(*) AS n_lines, string_agg(x, chr(10) ORDER BY line) FILTER (gone.line IS NULL) AS x
  FROM lines LEFT JOIN gone USING (doc_id, line) GROUP BY doc_id
)
SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE n_lines END AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, md5(coalesce(x, '')) AS text_md5 FROM documents JOIN left_ USING (doc_id)
"""
