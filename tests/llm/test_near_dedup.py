"""The pipeline's near_dedup against all pairs by exact five-word Jaccard."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geoframe.llm import neardup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def planted():
    """Texts of 120 words with copies of which a few words are changed: similarities on both sides of 0.8."""
    random.seed(5)
    rows = []
    for _ in range(40):
        base = [f"w{random.randrange(3000)}" for _ in range(120)]
        rows.append(" ".join(base))
        for n in (1, 2, 3, 4):
            own = list(base)
            for at in random.sample(range(120), n):
                own[at] = f"x{random.randrange(3000)}"
            rows.append(" ".join(own))
    random.shuffle(rows)
    return rows + ["a b c", "A  b c", "a b d", rows[0].upper()]


def plain_kept(texts):
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return {k for k, r in enumerate(root) if r == k}


@pytest.mark.parametrize("hot", [neardup.HOT, 2])
def test_planted_pairs(spark, hot):
    texts = planted()
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    made = corpus_pipeline.near_dedup(spark, docs, "") if hot == neardup.HOT else neardup.keep_one(docs, hot=hot)
    assert {r.doc_id for r in made.collect()} == plain_kept(texts)


def test_rows_of_one_id_are_judged_apart(spark):
    same, other = "one two three four five six seven", "quite another text that has no copy at all"
    rows = [(1, same), (2, same), (2, other), (2, other), (None, same), (None, "alone"), (None, None), (9, "")]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA)
    kept = sorted(((r.doc_id, r.text) for r in neardup.keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, same), (2, other), (2, other), (None, "alone"), (9, "")], key=str)
    assert neardup.keep_one(docs.filter(F.lit(False))).count() == 0
