"""TF-IDF and classic BM25: the first documents by blocks equal those of all scores, and no pair is a row."""

import random

import pytest
from arbiter.operators import relevance

WORDS = [f"w{i}" for i in range(40)]


def _tables(spark):
    rnd = random.Random(7)
    text = lambda n: " ".join(WORDS[min(int(rnd.expovariate(0.15)), 39)] for _ in range(n))
    docs = [(i, text(rnd.randint(0, 12))) for i in range(150)] + [(i, "w1 w2 w2") for i in range(150, 180)] + [(181, None), (182, ""), (183, "é w1")]
    asked = [(i, text(rnd.randint(1, 6))) for i in range(40)] + [(40, ""), (41, None), (42, "nothing"), (43, "w2 w2 nothing w1")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "qid long, query string")


def _rows(df):
    return sorted(map(tuple, df.select("qid", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("words", [relevance.WORDS, 15, 3])
@pytest.mark.parametrize(("top", "every"), [(relevance.tfidf_top, relevance.tfidf_cosine), (relevance.okapi_top, relevance.okapi_scores)])
def test_first_of_all_scores(spark, monkeypatch, top, every, words):
    docs, asked = _tables(spark)
    want = _rows(relevance.top_k(every(docs, asked), 6))
    monkeypatch.setattr(relevance, "WORDS", words)
    assert _rows(top(docs, asked, 6)) == want and len(want) > 200


def test_no_pair_is_a_row(spark):
    docs, asked = _tables(spark)
    for top in (relevance.tfidf_top, relevance.okapi_top):
        plan = top(docs, asked, 6)._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "hashpartitioning(qid, doc_id" not in plan


def test_words_that_weigh_nothing(spark):
    """A word of half of the texts has no weight, but its texts are ranked."""
    docs = spark.createDataFrame([(0, "a b"), (1, "a"), (2, "c"), (3, "d"), (4, None), (5, "")], "doc_id long, text string").where("doc_id < 4")
    asked = spark.createDataFrame([(0, "a"), (1, "a b"), (2, "c")], "qid long, query string")
    want = _rows(relevance.top_k(relevance.okapi_scores(docs, asked), 2))
    assert _rows(relevance.okapi_top(docs, asked, 2)) == want and (0, 1, 0, 0.0) in want


def test_pool_in_the_order_of_cosines(spark):
    docs, asked = _tables(spark)
    cosine = relevance.tfidf_cosine(docs, asked)
    pool = relevance.pool_union(relevance.bm25(docs, asked, 4), relevance.top_k(cosine, 4))
    want = sorted(map(tuple, relevance.rerank(pool, cosine).where("rank <= 3").select("qid", "doc_id", "rank").collect()))
    got = relevance.pooled(docs, asked, 4, 3)
    assert sorted(map(tuple, got.select("qid", "doc_id", "rank").collect())) == want
    assert sorted(map(tuple, relevance.pooled(docs, asked, 4).collect())) == sorted(map(tuple, pool.collect()))


def test_repeated_rows_are_one_document(spark):
    docs, asked = _tables(spark)
    docs = docs.unionAll(docs.where("doc_id % 3 = 0"))
    assert _rows(relevance.bm25(docs, asked, 6)) == _rows(relevance.top_k(relevance.bm25_scores(docs, asked), 6))
