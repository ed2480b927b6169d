"""Scores of questions that are dealt in parts, and of documents that share an id, equal those of all at once."""

from collections import Counter

from arbiter.operators import relevance

TEXTS = [(1, "a b c a"), (1, "a d"), (2, None), (3, ""), (4, "b b e"), (None, "a e"), (5, "zz")]
ASKED = [(q, "a b e" if q % 2 else "d zz nothing") for q in range(12)] + [(12, ""), (13, None)]


def test_parts_of_questions(spark, monkeypatch):
    docs, asked = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(ASKED, "qid long, query string")
    whole = Counter(map(tuple, relevance.bm25_scores(docs, asked).collect()))
    monkeypatch.setattr(relevance, "TERMS_LIMIT", 300)
    assert Counter(map(tuple, relevance.bm25_scores(docs, asked).collect())) == whole and len(whole) > 20


def test_what_is_scored_is_not_shuffled(spark):
    docs, asked = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(ASKED, "qid long, query string")
    plan = relevance.bm25_scores(docs, asked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(qid" not in plan
