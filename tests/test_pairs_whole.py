"""Scores of given pairs: texts are split once, and pairs meet their own document as a whole."""

import random

import pytest
from pyspark.sql import functions as F

from arbiter.operators import relevance

WORDS = [f"w{chr(97 + i)}" for i in range(26)]


@pytest.mark.parametrize("words", [relevance.WORDS, 5])
def test_scores_of_pairs(spark, monkeypatch, words):
    rnd = random.Random(9)
    text = lambda n: " ".join(rnd.choice(WORDS[: rnd.randint(2, 26)]) for _ in range(n))
    docs = spark.createDataFrame([(i, text(rnd.randint(0, 30))) for i in range(60)] + [(60, None), (61, "")], "doc_id long, text string")
    asked = [(i, text(rnd.randint(0, 8)) or None, d) for i in range(40) for d in rnd.sample(range(64), 3)]
    pairs = spark.createDataFrame([*asked, asked[0], (99, "wa wa", 2), (99, "wb", 3)], "qid long, query string, doc_id long")
    every = relevance.bm25_scores(docs, pairs.groupBy("qid").agg(F.array_join(F.collect_list("query"), " ").alias("query")), "l2")
    want = pairs.select("qid", "doc_id").join(every, ["qid", "doc_id"], "left").fillna(0.0, ["score"])
    monkeypatch.setattr(relevance, "WORDS", words)
    got = relevance.bm25_pairs(pairs, docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("qid", "doc_id", "score").collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
