"""The first documents by blocks equal those of all scores, with ties, copies, shared and missing ids."""

import random

import pytest
from arbiter.operators import best, relevance

WORDS = [f"w{i}" for i in range(40)]


def _tables(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join(WORDS[min(int(rnd.expovariate(0.15)), 39)] for _ in range(n))
    docs = [(i, text(rnd.randint(0, 12))) for i in range(150)] + [(i, "w1 w2 w2") for i in range(150, 180)] + [(7, "w3 w9"), (None, "w0 w5"), (181, None), (182, "")]
    asked = [(i, text(rnd.randint(1, 6))) for i in range(40)] + [(40, ""), (41, None), (42, "nothing"), (43, "w2 w2 w1")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "qid long, query string")


@pytest.mark.parametrize("tie", ["asc", "desc"])
@pytest.mark.parametrize("sides", [(1000, 2000), (7, 11)])
def test_first_of_all_scores(spark, monkeypatch, tie, sides):
    monkeypatch.setattr(best, "SIDES", sides)
    monkeypatch.setattr(best, "ASKED", 15)
    docs, asked = _tables(spark)
    rows = lambda df: sorted(map(tuple, df.select("qid", "rank", "doc_id", "score").collect()), key=str)
    want = rows(relevance.top_k(relevance.bm25_scores(docs, asked, dup_terms=True), 6, tie))
    assert rows(relevance.bm25(docs, asked, 6, dup_terms=True, tie=tie)) == want and len(want) > 200


def test_no_pair_is_a_row(spark):
    docs, asked = _tables(spark)
    plan = relevance.bm25(docs, asked, 6)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "hashpartitioning(qid, doc_id" not in plan


def test_first_of_dense_scores(spark, monkeypatch):
    monkeypatch.setattr(best, "SIDES", (3, 7))
    rnd = random.Random(3)
    rows = [(i, [round(rnd.uniform(-1, 1), 1) for _ in range(3)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None, 2.0]), (62, [1.0]), (63, [float("nan"), 0.0, 1.0]), (64, [float("inf"), 1.0, 1.0]), (65, [-0.0, 0.0, 0.0]), (66, [1e9, 1.0, -1.0])]
    docs = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    asked = docs.where("doc_id % 4 = 0 OR doc_id > 60").withColumnRenamed("doc_id", "qid")
    shown = lambda df: sorted(str(tuple(r)) for r in df.select("qid", "rank", "doc_id", "score").collect())
    assert shown(relevance.dense_top(docs, asked, 5)) == shown(relevance.top_k(relevance.dense_scores(docs, asked), 5))
    plan = relevance.dense_top(docs.where("doc_id < 60"), asked.where("qid < 60"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_places_are_found_once_for_each_key(spark):
    docs = spark.createDataFrame([(i % 50, "ab"[i % 2], i % 3 if i % 7 else None) for i in range(60)], "doc_id long, x string, y int")
    asked = docs.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "qid")
    want = {}
    for q in asked.collect():
        want.setdefault(q["qid"], []).extend(r["doc_id"] for r in docs.collect() if q["y"] is not None and (r["x"], r["y"]) == (q["x"], q["y"]))
    got = relevance.exact_matches(docs, asked, ["x", "y"])
    assert sorted(map(tuple, got.collect())) == sorted((q, i, n + 1) for q, ids in want.items() for n, i in enumerate(sorted(ids)))
    alone = relevance.exact_matches(docs.where("doc_id > 9"), asked.where("qid > 9"), ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" in alone and "[qid" not in alone[alone.index("Window") :].split("\n")[0]


def test_rare_terms_make_no_matrix(monkeypatch):
    monkeypatch.setattr(best, "SIDES", (7, 11))
    monkeypatch.setattr(best, "SHARED", 2)
    monkeypatch.setattr(best, "FEW", 99)
    one = lambda n: (n, *map(best.np.array, zip(*[(i, (i * j) % 5, 1.0 + j) for i in range(n) for j in range(2)])))
    seen = []
    monkeypatch.setattr(best.np, "partition", lambda *a, **b: seen.append(1))
    sparse = best._first(one(20), one(30), 4, False)
    assert not seen and len(sparse[0]) > 20
    monkeypatch.undo()
    whole = best._first(one(20), one(30), 4, False)
    assert sorted(zip(*map(list, sparse))) == sorted(zip(*map(list, whole)))
