"""Connected components of links between 64-bit keys, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved


def components(links: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(key, root): the smallest key that is reachable from each key in a link.

    Links with a null end and loops are left out. Each step sends a key's neighbours to the
    smallest of them through partial minima and a join, so a key with many links isn't gathered
    in one task; steps go on until no link changes. No links: an empty table.
    """
    told = links.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    held = Saved(told.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct())

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first())

    now = state(held.df)
    while now[0]:
        edges = held.df
        # large star: a key's larger neighbours go to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a key and its smaller neighbours go to the smallest of them
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        before, held = held, Saved(small.filter("u <> v").distinct())
        before.drop()
        then, now = now, state(held.df)
        if then == now:
            break
    edges = held.df
    roots = edges.select(F.col("u").alias("key"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("key"), F.col("v").alias("root"))).distinct()
