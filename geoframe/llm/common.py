"""What the operators share: reading tables, names of columns, Arrow batches, tables that outlive executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH_ROWS = 512  # texts handed to a function at once; Spark bounds the bytes of the batch they come in


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# columns


def place(df: DataFrame, name: str) -> int:
    """The place of a column: that of exactly this name, else the first that differs in case only."""
    names = df.columns
    if name in names:
        return names.index(name)
    low = [c.lower() for c in names]
    if name.lower() not in low:
        raise ValueError(f"no column {name}; there are {', '.join(names)}")
    return low.index(name.lower())


def without(df: DataFrame, *names: str) -> list[int]:
    """Places of the columns whose names differ from all given ones, whatever the case."""
    gone = {n.lower() for n in names}
    return [k for k, c in enumerate(df.columns) if c.lower() not in gone]


def numbered(df: DataFrame) -> DataFrame:
    """The same rows with columns c0, c1, ..., so that no name clashes with those of an operator."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def renamed(df: DataFrame, like: DataFrame, kept: list[int], *made: str) -> DataFrame:
    """Columns c<k> of ``kept`` under their names in ``like``, then the made ones."""
    return df.select(*[f"c{k}" for k in kept], *made).toDF(*[like.columns[k] for k in kept], *made)


# tables that are written once and read again


class Saved:
    """A written table: ``df`` reads it, ``drop`` deletes it before the application ends."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        self.path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self._at = jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.deleteOnExit(self._at)
        void = [f.name for f in df.schema if isinstance(f.dataType, T.NullType)]  # Parquet has no such type
        held = df.withColumns({c: F.col(c).cast("string") for c in void}) if void else df
        with small_batches(spark):
            held.write.parquet(self.path)
        read = spark.read.schema(held.schema).parquet(self.path)
        self.df = read.withColumns({c: F.lit(None) for c in void}) if void else read

    def drop(self) -> None:
        self._files.delete(self._at, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors reach."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if spark.sparkContext.master.startswith("local["):  # one machine: a folder of its own is shared by all
        spark.conf.set("spark.checkpoint.dir", own := tempfile.mkdtemp(prefix="checkpoint"))
        return own
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


@contextmanager
def small_batches(spark: SparkSession, most: str = "8m") -> Iterator[None]:
    """For what runs inside, Spark hands Python batches of few bytes; the session's own setting comes back after it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows as a table in the shared folder, which goes when the application ends."""
    return Saved(df).df


# Python over whole texts


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that few are Python objects at once; what the batches held goes back to the system at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    pa.default_memory_pool().release_unused()


def map_texts(df: DataFrame, each: Callable[[], Callable[..., tuple]], columns: str, *text_cols: str) -> DataFrame:
    """Append columns that a Python function computes from one or more whole texts of a row.

    ``each()`` is called once a task and returns the function from UTF-8 bytes (a null text
    comes as None), one argument a text column, to a tuple in the order of ``columns``, a DDL
    string. The text columns go, ``text`` if none is named. Other columns of ``df`` are carried
    along, whatever their names; one that has the name of a result, in any case, is replaced.
    """
    texts = [place(df, c) for c in text_cols or ("text",)]
    schema = T.StructType.fromDDL(columns)
    names, types = schema.names, [f.type for f in to_arrow_schema(schema)]
    kept = [k for k in without(df, *names) if k not in texts]
    plain = numbered(df)
    source = plain.select(*[f"c{k}" for k in kept], *[F.col(f"c{k}").cast("binary").alias(f"t{i}") for i, k in enumerate(texts)])
    out = T.StructType([*source.schema.fields[: len(kept)], *schema.fields])
    n, held = len(kept), source.columns[: len(kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = each()
        for batch in slices(batches):
            rows = [call(*x) for x in zip(*(c.to_pylist() for c in batch.columns[n:]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array(list(x), kind) for x, kind in zip(zip(*rows), types)]], names=[*held, *names])

    return renamed(source.mapInArrow(run, out), df, kept, *names)


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the decimal text modulo n; -1 where the id is null."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % n, F.lit(-1))
