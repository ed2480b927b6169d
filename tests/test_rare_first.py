"""Questions that rare words settle meet no other documents, and the first are those of all scores."""

import random

import pytest
from arbiter.operators import best, relevance


@pytest.mark.parametrize("tie", ["asc", "desc"])
def test_rare_words_settle(spark, monkeypatch, tie):
    rnd = random.Random(4)
    docs = [(i, f"u{i // 4} emp{i // 4 % 5} " + rnd.choice(["view", "click", "view error"])) for i in range(160)] + [(200, "emp1"), (201, "view view")]
    asked = [(i, f"is emp{i % 5} u{i} view") for i in range(40)] + [(40, "emp1"), (41, "click error"), (42, "nothing"), (43, "u1 u2 u3")]
    docs, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "qid long, query string")
    rows = lambda df: sorted(map(tuple, df.select("qid", "rank", "doc_id", "score").collect()))
    want = rows(relevance.top_k(relevance.bm25_scores(docs, asked), 3, tie))
    monkeypatch.setattr(best, "MANY", 1)
    monkeypatch.setattr(best, "RARE", 2)
    seen, whole = [], best._best
    monkeypatch.setattr(best, "_best", lambda docs, asked, *a: seen.append(asked.count()) or whole(docs, asked, *a))
    assert rows(relevance.bm25(docs, asked, 3, tie=tie)) == want and len(want) > 120
    assert seen and 0 < seen[0] < 25


def test_first_documents_are_found_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i}") for i in range(9)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a1 a2"), (2, "b")], "qid long, query string")
    out = relevance.bm25(docs, asked, 3, unmatched="append")
    assert "FlatMapCoGroupsInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.qid, r.doc_id) for r in out.orderBy("qid", "rank").collect()] == [(1, 1), (1, 2), (1, 0), (2, 0), (2, 1), (2, 2)]
