"""Ranks counted by blocks equal those of whole rankings; blocks that go first change no result."""

import random

import pytest
from arbiter.operators import best, relevance

WORDS = [f"w{i}" for i in range(40)]


def _tables(spark):
    rnd = random.Random(11)
    text = lambda n: " ".join(WORDS[min(int(rnd.expovariate(0.15)), 39)] for _ in range(n))
    docs = [(i, text(rnd.randint(0, 12))) for i in range(150)] + [(i, "w1 w2 w2") for i in range(150, 180)] + [(7, "w3 w9"), (None, "w1 w2 w2"), (181, None), (182, "")]
    asked = [(i, text(rnd.randint(1, 6))) for i in range(40)] + [(40, ""), (41, None), (42, "nothing"), (43, "w2 w2 w1")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "qid long, query string")


@pytest.mark.parametrize("sides", [(1000, 2000), (7, 11)])
def test_counted_ranks(spark, monkeypatch, sides):
    monkeypatch.setattr(best, "SIDES", sides)
    docs, asked = _tables(spark)
    gold = asked.select("qid").crossJoin(docs.where("doc_id % 7 = 0 OR doc_id > 149").select("doc_id").distinct())
    rows = lambda df: sorted(map(tuple, df.select("qid", "doc_id", "rank").collect()), key=str)
    want = rows(relevance.rank_by_count(relevance.bm25_scores(docs, asked), gold, 999))
    found = best.ranks(*relevance.bm25_vectors(docs, asked), gold)
    assert rows(relevance.rank_of(found, gold, 999)) == want and len({r for *_, r in want}) > 100
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("tie", ["asc", "desc"])
def test_blocks_that_go_first(spark, monkeypatch, tie):
    monkeypatch.setattr(best, "SIDES", (7, 5))
    docs, asked = _tables(spark)
    rows = lambda df: sorted(map(tuple, df.select("qid", "rank", "doc_id", "score").collect()), key=str)
    once = relevance.bm25(docs, asked, 6, tie=tie)
    monkeypatch.setattr(best, "MANY", 1)
    twice = relevance.bm25(docs, asked, 6, tie=tie)
    assert rows(twice) == rows(once) == rows(relevance.top_k(relevance.bm25_scores(docs, asked), 6, tie))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (once, twice)]
    assert ["least" in p for p in plans] == [False, True]


def test_only_goals_of_late_anchors_are_counted(spark, sf, monkeypatch):
    from arbiter.queries import QUERIES

    monkeypatch.setattr(relevance, "bm25_scores", None)
    seen, ranks = [], best.ranks
    monkeypatch.setattr(best, "ranks", lambda docs, asked, goals: seen.append(goals.count()) or ranks(docs, asked, goals))
    rows = QUERIES["analytic_rank"](spark, sf).collect()
    assert sum(r["rank"] > 3 for r in rows) <= seen[0] < len(rows)
