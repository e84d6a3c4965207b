"""SimHash near-duplicates by self-joins of binary tries.

Fingerprints are 64 bits; equal ones are joined once. Two that differ in at most E bits agree
in one of E+1 bands, so each fingerprint enters E+1 tries, rotated so that one band leads; the
band is the part of the trie that both share, and a task owns the subtries below it. There,
pairs of nodes are walked together, a level at a time: differing bits add up, and a pair goes
once they exceed the budget. Links become components by large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, map_texts, numbered, place, table
from .components import components
from .xxh_sql import hashed

SEED = 42  # of the shingles' XXH64
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
TO_LOWER = bytes.maketrans(UPPER, LOWER)
HOT = 20_000  # fingerprints of a band that one task joins; more are dealt out by pairs of salts
FLUSH = 100_000  # rows that a task joins at once
FRONT = 400_000  # pairs of nodes that are walked at once
LEAF = 16  # pairs of fingerprints below which two nodes are compared directly


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Bit i is set where over half of the shingles' hashes have it; 0 without words."""
    words = (text or b"").translate(TO_LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    rows = zip(*(words[k:] for k in range(width)))
    return majority(np.fromiter((digest(x, SEED) for x in map(b" ".join, rows)), np.uint64, len(words) - width + 1))


def majority(h: np.ndarray) -> int:
    """Bit i is set where over half of the numbers have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        counts += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def rotate(x: np.ndarray, n: int) -> np.ndarray:
    n %= 64
    return x if not n else (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _between(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run each position belongs to, and the positions start..start+size of all runs."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]


def trie_join(keys: np.ndarray, groups: np.ndarray, top: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs i < j of a group whose keys differ in at most ``budget`` bits.

    ``keys`` ascend within each group, groups are runs, and keys of a group share all bits from
    ``top`` up.
    """
    if len(keys) < 2:
        return
    begin = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    end = np.r_[begin[1:], len(keys)]
    big = end - begin > 1
    # One frontier of node pairs: runs a and b, the bit to split by, bits still allowed to differ.
    stack = [(begin[big], end[big], begin[big], end[big], np.full(int(big.sum()), budget), top - 1)]
    while stack:
        a0, a1, b0, b1, left, bit = stack.pop()
        if not len(a0):
            continue
        if len(a0) > FRONT:
            half = len(a0) // 2
            for s in (slice(half, None), slice(None, half)):
                stack.append((a0[s], a1[s], b0[s], b1[s], left[s], bit))
            continue
        leaf = ((a1 - a0) * (b1 - b0) <= LEAF) if bit >= 0 else np.ones(len(a0), bool)
        if leaf.any():
            la0, lb0, na, nb = a0[leaf], b0[leaf], (a1 - a0)[leaf], (b1 - b0)[leaf]
            rows = np.cumsum(na * nb)
            at = 0
            while at < len(la0):  # leaves by portions, as equal keys can make them large at bit -1
                upto = max(at + 1, int(np.searchsorted(rows, (rows[at - 1] if at else 0) + 4 * FRONT, "right")))
                own, i = _between(la0[at:upto], na[at:upto])
                other = nb[at:upto][own]
                pos, j = _between(lb0[at:upto][own], other)
                i = i[pos]
                ok = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
                if ok.any():
                    yield i[ok], j[ok]
                at = upto
            rest = ~leaf
            a0, a1, b0, b1, left = a0[rest], a1[rest], b0[rest], b1[rest], left[rest]
        if bit < 0 or not len(a0):
            continue
        one = ((keys >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)
        ones = np.r_[0, np.cumsum(one)]
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # within a node, zeros come first
        self_pair = a0 == b0
        parts = [(a0, am, b0, bm, left), (am, a1, bm, b1, left), (a0, am, bm, b1, left - 1), (am, a1, b0, bm, left - 1)]
        keep = [np.ones(len(a0), bool), np.ones(len(a0), bool), left > 0, (left > 0) & ~self_pair]
        made = [[x[k] for x in part] for part, k in zip(parts, keep)]
        c0, c1, d0, d1, l = (np.concatenate([m[k] for m in made]) for k in range(5))
        used = (c1 > c0) & (d1 > d0) & ~((c0 == d0) & (c1 - c0 == 1) & (c1 == d1))
        stack.append((c0[used], c1[used], d0[used], d1[used], l[used], bit - 1))


def roots_of(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position linked to each of n positions."""
    p = np.arange(n)
    for u, v in pairs:
        while True:
            ru, rv = p[u], p[v]
            off = ru != rv
            if not off.any():
                break
            u, v = u[off], v[off]
            p[np.maximum(ru[off], rv[off])] = np.minimum(ru[off], rv[off])
            while True:
                q = p[p]
                if (q == p).all():
                    break
                p = q
    return p


def links(fingerprints: DataFrame, fp_col: str = "fp", budget: int = 3, hot: int = HOT) -> DataFrame:
    """(u, v): links that connect exactly the distinct fingerprints within ``budget`` bits.

    Within a band, only links from each fingerprint to the least one it is connected with there
    are returned, at most one a fingerprint and band, so a large group of near copies doesn't
    grow into all its pairs. A band with more than ``hot`` fingerprints is dealt out by pairs of
    salts, each of which meets in one task; none is dropped.
    """
    bands = budget + 1
    bounds = [round(64 * k / bands) for k in range(bands + 1)]
    widths = [b - a for a, b in zip(bounds, bounds[1:])]
    fps = fingerprints.select(F.col(fp_col).alias("fp")).filter("fp IS NOT NULL").distinct()

    def rotated(k: int):
        n, w = bounds[k], widths[k]
        turned = F.col("fp") if not n else F.shiftleft("fp", n).bitwiseOR(F.shiftrightunsigned("fp", 64 - n))
        return F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(turned, 64 - w).alias("lead"), turned.alias("key"))

    keyed = fps.select(F.explode(F.array(*[rotated(k) for k in range(bands)])).alias("r")).select("r.*")
    sizes = durable(keyed.groupBy("band", "lead").agg(F.count("*").alias("n")).filter("n > 1"))
    salts = F.ceil(F.col("n") / hot)
    dealt = keyed.join(sizes, ["band", "lead"]).withColumn("s", salts).withColumn("a", F.pmod(F.xxhash64("key"), "s"))
    other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("s") - 1), lambda x: (F.col("s") == 1) | (x != F.col("a")))
    dealt = dealt.withColumn("b", F.explode(other)).select("band", "lead", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "key")
    placed = dealt.repartition("band", "lead", "lo", "hi").sortWithinPartitions("band", "lead", "lo", "hi", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def join(cols: list[np.ndarray]):
            band, lead, lo, hi, key = cols
            new = np.r_[True, (band[1:] != band[:-1]) | (lead[1:] != lead[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])] if len(key) else np.zeros(0, bool)
            group, u64 = np.cumsum(new), key.view(np.uint64)
            for k in np.unique(band):
                at = np.flatnonzero(band == k)
                # Spark orders keys as signed numbers; a band's first bit sets the sign of all its keys
                root = roots_of(len(at), trie_join(u64[at], group[at], 64 - widths[k], budget))
                moved = root != np.arange(len(at))
                if moved.any():
                    back = rotate(u64[at], 64 - bounds[k]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(back[moved]), pa.array(back[root[moved]])], names=["u", "v"])

        def whole() -> list[np.ndarray]:
            return [np.concatenate(c) for c in zip(*held)]

        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            if sum(len(h[0]) for h in held) >= FLUSH:
                cols = whole()
                last = np.ones(len(cols[0]), bool)
                for c in cols[:4]:
                    last &= c == c[-1]
                cut = len(last) - int(last.sum())
                if cut:
                    yield from join([c[:cut] for c in cols])
                held = [tuple(c[cut:] for c in cols)]
        if held:
            yield from join(whole())

    return placed.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3, width: int = 3) -> DataFrame:
    """(id, fp long, component_id) of every row; other columns are ignored.

    Fingerprints link at ``budget`` or fewer differing bits; the component is the smallest id
    that is reachable. A null or empty text has fingerprint 0 and is linked like any other. A
    null id is never a component's id; where all are null, so is the component. Repeated rows
    give repeated rows. An empty table gives none.
    """
    rows = numbered(docs).select(F.col(f"c{place(docs, id_col)}").alias("id"), F.col(f"c{place(docs, text_col)}").alias("text"))
    marked = durable(map_texts(rows, lambda: lambda t: (signed(fingerprint(t, width)),), "fp long"))
    least = durable(marked.groupBy("fp").agg(F.min("id").alias("least")))
    linked = durable(components(links(least, budget=budget)))
    rooted = least.join(linked, least.fp == linked.key, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(first, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


OP9_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingled AS (
  SELECT k, unnest(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN [w[1]] WHEN 2 THEN [w[1] || ' ' || w[2]] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM docs
), {hashed('shingled', SEED)},
sums AS (
  SELECT k, count(*) AS n, {', '.join(f'sum(CAST((h >> {b}) & 1 AS BIGINT)) AS s{b}' for b in range(64))} FROM shingled JOIN hashed USING (x) GROUP BY k
), marked AS (
  SELECT doc_id, CAST(coalesce({' + '.join(f'CASE WHEN 2 * s{b} > n THEN CAST({1 << b} AS HUGEINT) ELSE 0 END' for b in range(64))}, 0) AS UBIGINT) AS fp FROM docs LEFT JOIN sums USING (k)
), fps AS (
  SELECT fp, min(doc_id) AS least FROM marked GROUP BY fp
), links AS (
  SELECT a.fp AS a, b.fp AS b FROM fps a JOIN fps b ON a.fp <> b.fp AND bit_count(CAST(xor(a.fp, b.fp) AS HUGEINT)) <= 3
), reach(a, b) AS (
  SELECT fp, fp FROM fps UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), named AS (
  SELECT a AS fp, min(least) AS component_id FROM reach JOIN fps ON fps.fp = reach.b GROUP BY a
)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component_id FROM marked JOIN named USING (fp)
"""
