"""The registered queries over the small tables: SQL where there is some, held-out accuracy, planted copies."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from geoframe.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    pd.testing.assert_frame_equal(got[columns].sort_values(columns).reset_index(drop=True), want[columns].sort_values(columns).reset_index(drop=True), check_dtype=False)


def test_held_out(spark):
    docs, labels = pd.read_parquet(f"{DATA}/documents.parquet"), pd.read_parquet(f"{DATA}/labels.parquet")
    lang = QUERIES["op6_language_id"](spark, DATA).toPandas().merge(docs[["doc_id", "lang"]], on="doc_id")
    lang = lang[lang.held_out & lang.lang.notna()]
    assert (lang.lang == lang.lang_pred).mean() > 0.95
    quality = QUERIES["op10_quality_classifier"](spark, DATA).toPandas().merge(labels, on="doc_id")
    quality = quality[quality.held_out]
    assert ((quality.score >= 0.3) == (quality.quality == 1)).mean() > 0.8


def test_pipeline(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = rows.select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, DATA)
        assert made.columns == corpus_pipeline.COLUMNS and 0 < made.count() <= 3 * docs.count(), name
        docs = made
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() == docs.count() and {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in rows.select("doc_id").collect()}
