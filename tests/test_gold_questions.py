"""Ranks of gold documents: only questions that have one are scored."""

from arbiter.operators import relevance
from arbiter.plans import relevance_queries as R


def test_only_questions_with_gold_are_scored(spark, sf, monkeypatch):
    asked, scores = [], relevance.bm25_scores

    def seen(corpus, queries, *rest):
        asked.extend(r["qid"] for r in queries.select("qid").collect())
        return scores(corpus, queries, *rest)

    monkeypatch.setattr(relevance, "bm25_scores", seen)
    ranks = R.gold_ranks(spark, sf).collect()
    assert set(asked) == {r["qid"] for r in ranks} and len(asked) < R.questions(spark, sf).count()
