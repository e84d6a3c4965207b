"""A corpus pipeline of five stages over ``documents``; each works on all that the one before kept.

Every stage takes the columns of ``documents`` by name and leaves all others out, so that extra
columns, whatever their names, change nothing. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoframe.llm import langid, linededup, mixing, neardup, sentencepiece
from geoframe.llm.common import durable, numbered, place

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(docs: DataFrame) -> DataFrame:
    return numbered(docs).select(*[F.col(f"c{place(docs, c)}").alias(c) for c in COLUMNS])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: null and empty texts and those without letters.

    Profiles are learned from all rows with a language; without one, no document has any. Of equal
    distances the first language by code point wins. Repeated rows stay or go together.
    """
    own = documents(docs)
    read = own.withColumn("read", F.col("text"))  # the text goes along, which costs less than joining it again
    return langid.predict(read, langid.train(own), "read").filter("lang_pred <> 'und'").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which nothing else is left.

    The order is that of the ids, null last. Null and empty texts stay as they are; repeated rows
    lose the same lines. ``n_chars`` is counted anew where lines went.
    """
    made = linededup.remove_repeated_lines(documents(docs))
    emptied = (F.col("n_removed") > 0) & (F.trim(F.translate("text", "\n\t\r\x0b\x0c", "     ")) == "")
    return made.filter(~emptied).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 or more) stays, that of the smallest id.

    Null texts and texts without words are copies of each other. Rows with a null id go where
    their group has one with an id; rows that repeat both id and text stay together.
    """
    return neardup.keep_one(documents(docs)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, three times at most.

    A null source is one of its own. Null texts and texts without words are in no mix and go.
    Rows of equal id and text are taken alike.
    """
    return mixing.apply_mix(documents(docs), F.array("source")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids and digests of the ids, the decoded text and the spans, with what names the document.

    A null text counts as empty. Repeated rows give repeated rows.
    """
    return sentencepiece.digests(documents(docs))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix_sources), ("sentencepiece", encode)]
ORACLE_SQL = None  # learned profiles, suffix ranks and pieces are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each but the last is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
