"""Columns whose names clash with those of the operators, and settings and tables that operators leave behind."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geoframe.llm import classifier, common, langid, linededup, mixing, neardup, quality, sentencepiece, simhash, tokencount, topk, urls

NAMES = ["a.b", "K1", "gone", "Size", "TAKEN", "N_Words", "n_TOKENS", "__text", "Text", "c0", "h", "key", "bin", "LANG_pred", "score", "fp", "set", "id", "Failures", "Rule", "Verdict", "rank", "DOC_id", "t`q", "n_removed", "Decoded", "pieces", "row", "w", "label", "pos", "words"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(["one two three four\nfive six seven eight nine ten", None, "", "one two three four\nfive six seven eight nine ten", "b"])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def odd(docs):
    return docs.select("*", *[F.lit(k) for k in range(len(NAMES))], F.lit(None)).toDF(*docs.columns, *NAMES, "of no type")


OPERATORS = {
    "op1": lambda d: mixing.mix(d, F.array("source"))[0],
    "apply": lambda d: mixing.apply_mix(d, F.array("source")),
    "op2": lambda d: urls.judge(d, [(("h:x",), 1.0)], url_col="text"),
    "labels": lambda d: urls.label_urls(d, url_col="text"),
    "op3": lambda d: tokencount.token_counts(d, {"\x02one"}, {"a"}),
    "op5": lambda d: sentencepiece.digests(d),
    "encode": lambda d: sentencepiece.encode(d),
    "op6": lambda d: langid.predict(d, langid.train(d)),
    "op7": lambda d: quality.apply_policy(quality.ledger(d), "v2"),
    "op8": lambda d: linededup.remove_repeated_lines(d, min_words=5),
    "op9": lambda d: simhash.near_duplicates(d),
    "near": lambda d: neardup.keep_one(d),
    "op10": lambda d: classifier.score(d, classifier.fit(d, d, label_col="n_chars")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(docs, odd, name):
    """Results are those without the extra columns, which come along unless a result has their name."""
    plain, made = OPERATORS[name](docs), OPERATORS[name](odd)
    told = [c for c in made.columns if c in plain.columns]
    assert told == plain.columns
    low = [c.lower() for c in made.columns]
    assert all(low.count(c.lower()) == 1 for c in plain.columns if c not in docs.columns)
    rows = lambda df, at: sorted(str(tuple(r[k] for k in at)) for r in df.collect())
    assert rows(made, [made.columns.index(c) for c in plain.columns]) == rows(plain, range(len(plain.columns)))
    if len(made.columns) > len(plain.columns):
        first = made.collect()[0]
        for k, c in enumerate(made.columns):
            if c in NAMES and c not in plain.columns:
                assert first[k] == NAMES.index(c)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, odd, stage):
    none = docs.filter("false")
    assert stage(spark, none, "").count() == 0
    plain, made = stage(spark, docs, ""), stage(spark, odd, "")
    assert plain.columns == made.columns and sorted(map(str, plain.collect())) == sorted(map(str, made.collect()))
    nulls = docs.select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    assert stage(spark, nulls.unionByName(docs).unionByName(docs), "").count() >= 0


def test_settings_stay(spark, docs):
    told = lambda: {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.shuffle.partitions")}
    before = told()
    for f in OPERATORS.values():
        f(docs).count()
    rows = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("weights"))
    assert topk.top_k(rows, rows).count() == 25 and told() == before


def test_saved_tables_go(spark, docs):
    held = common.Saved(docs)
    assert held.df.count() == docs.count() and held._files.exists(held._at)
    held.drop()
    assert not held._files.exists(held._at)


def test_each_row_is_read_once(spark, tmp_path):
    """The pipeline sends every row through the language stage's prediction once."""
    rows = spark.createDataFrame([(k, f"some words of text number {k}", "en", "a", 1) for k in range(50)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    count, real = spark.sparkContext.accumulator(0), langid.predict

    def counted(docs, profiles, text_col="text"):
        def each():
            def call(text):
                count.add(1)
                return (0,)

            return call

        mark = docs.withColumn("own", F.col(text_col))
        return real(common.map_texts(mark, each, "seen int", "own"), profiles, text_col)

    langid.predict = counted
    try:
        assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    finally:
        langid.predict = real
    assert count.value == 50
