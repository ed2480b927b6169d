import datetime as dt

import pytest
from pyspark.sql import functions as F

from arbiter.operators import graph, metrics, pipelines, relevance, synth
from arbiter.plans import adapters
from arbiter.plans.rules import COMPLIANCE, LEGAL, SECURITY, Rule, checked, depth

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "event_id string, event_type string, ts timestamp, employee_id string, security_ticker string, counterparty string, policy_id string"


def kb(spark, *rows):
    return spark.createDataFrame([(i, t, DAY + dt.timedelta(days=d), "E", "T", c, None) for i, t, d, c in rows], SCHEMA)


T2 = [("e1", "pre_clearance_approved", 0, None), ("e2", "blackout_announced", 1, None), ("e3", "emergency_exception", 2, None)]


@pytest.mark.parametrize(
    "rows, gone",
    [
        (T2[:1], set()),
        (T2[:2], {"e1"}),
        (T2, {"e1", "e2"}),
        ([*T2[:2], ("e3", "blackout_lifted", 2, None)], {"e1", "e2"}),
        ([("e1", "pre_clearance_approved", 0, None), ("e2", "blackout_announced", 0, None)], set()),
        ([("e1", "conflict_disclosed", 0, None), ("e2", "conflict_amended", 1, None)], set()),
        ([("e1", "conflict_disclosed", 0, "c"), ("e2", "conflict_amended", 1, "c")], {"e1"}),
    ],
)
def test_scenarios(spark, rows, gone):
    events = kb(spark, *rows)
    assert {r[0] for r in graph.superseded(events, COMPLIANCE).collect()} == gone
    assert {r["target_id"] for r in graph.edges(events, COMPLIANCE).collect()} == gone
    assert {r["event_id"] for r in graph.active(events, COMPLIANCE).collect()} == {r[0] for r in rows} - gone


def test_chain_and_strict_tca_take_other_triggers(spark):
    events = kb(spark, ("e1", "pre_clearance_approved", 0, None), ("e2", "blackout_announced", 1, None), ("e3", "watchlist_added", 2, None))
    e = graph.edges(events, COMPLIANCE)
    assert [tuple(r) for r in graph.chains(events, COMPLIANCE).collect()] == [("e1", 1, "e2", "R1")]
    seen = spark.createDataFrame([("q", "e1", 1), ("q", "e2", 2)], "qid string, doc_id string, rank long")
    gold = seen.select("qid", "doc_id")
    answers = spark.createDataFrame([("q", "Yes ", "yes")], "qid string, predicted string, expected string")
    assert metrics.compute_tca(seen, gold, e, answers).first()["tca"] == 0.0
    assert metrics.compute_tca(seen, gold, e, answers, mode="any").first()["tca"] == 1.0


def test_certificate(spark):
    rows = {r["event_id"]: r for r in graph.certificates(kb(spark, *T2), COMPLIANCE).collect()}
    assert rows["e3"]["valid"] and rows["e3"]["chain"] == []
    assert [tuple(c) for c in rows["e1"]["chain"]] == [("e2", "R1"), ("e3", "R3")]


def test_frontier_has_no_inner_edge_and_order_does_not_matter(spark, sf):
    from arbiter.plans import graph_queries as g

    a = {tuple(r) for r in g.active_frontier(spark, sf).collect()}
    e = graph.transitive(g.edges(spark, sf), g.STEPS).collect()
    per = {}
    for q, x in a:
        per.setdefault(q, set()).add(x)
    assert not any(r["target_id"] in s and r["trigger_id"] in s for s in per.values() for r in e)


def test_rules_without_cycles():
    assert depth(COMPLIANCE) == 3 and depth(SECURITY) == 2 and depth(LEGAL) == 2
    with pytest.raises(ValueError):
        checked([Rule("a", "x", "y", ("s",)), Rule("b", "y", "x", ("s",))])


def test_no_nested_loop_join(spark, sf):
    from arbiter.plans import graph_queries as g

    plan = g.edges(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_two_stage_puts_overriding_record_first(spark):
    records = spark.createDataFrame(
        [(1, "cve_disclosed", "P", "c1"), (2, "patch_released", " p ", "C1"), (3, "patch_released", "q", "c2"), (4, "patch_released", None, "c1")], "doc_id long, record_type string, product string, cve_id string"
    )
    ranking = spark.createDataFrame([(0, 3, 1), (0, 1, 2), (0, 4, 3)], "qid long, doc_id long, rank long")
    out = pipelines.two_stage(ranking, records, adapters.SECURITY, 5).orderBy("rank").collect()
    assert [r["doc_id"] for r in out] == [2, 3, 1, 4]


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a"), (2, None)], "qid long, query string")
    assert relevance.bm25(docs, q, 5).collect() == []
    assert relevance.tfidf_cosine(docs, q).collect() == []


def test_distractors_avoid_gold_pairs(spark):
    ex = synth.scenario_events(synth.entity_pairs(spark, 5, 5, 6)).select(F.col("employee_id").alias("employee"), F.col("security_ticker").alias("ticker"), "ts")
    d = synth.distractors(ex, 6, ["trade_executed"], ["{emp} traded {ticker}"])
    gold = {tuple(r) for r in ex.select("employee", "ticker").collect()}
    got = {tuple(r) for r in d.select("employee", "ticker").collect()}
    assert got and not got & gold
    with pytest.raises(ValueError):
        synth.entity_pairs(spark, 2, 2, 5)


def test_registered_retrievers(spark, sf, tmp_path):
    from arbiter.plans.relevance_queries import corpus, questions

    out = adapters.retrieve("bm25", corpus(spark, sf), questions(spark, sf).limit(3), 2)
    assert out.where("rank > 2").count() == 0
    with pytest.raises(KeyError):
        adapters.retrieve("none", None, None, 1)
    (tmp_path / "mine.py").write_text("def retrieve(corpus, queries, k):\n    return corpus\n")
    adapters.load_retriever(str(tmp_path / "mine.py"), "mine")
    assert "mine" in adapters.RETRIEVERS
