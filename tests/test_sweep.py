"""As-of sweeps against edges and their transitive relation: ties, nulls, rules of different scopes, a hot scope."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from arbiter.operators import graph, pipelines, sweep
from arbiter.plans.rules import COMPLIANCE, LEGAL, depth

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, event_type string, ts timestamp, employee_id string, security_ticker string, counterparty string, policy_id string"


def made(spark, rules, n, seed):
    """A third of the events have one ticker and employee; few distinct times, some nulls."""
    rng = random.Random(seed)
    kinds = sorted({k for r in rules for k in (r.trigger_type, r.target_type)})
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        pick = lambda xs, one, hot=hot: one if hot else rng.choice(xs)
        rows.append((i, rng.choice(kinds), DAY + dt.timedelta(hours=rng.randrange(60)), pick(["E1", "E2", "E3", None], "E1"), pick(["T1", "T2", None], "T1"), pick(["c", None], "c"), rng.choice(["p", None])))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module", params=[COMPLIANCE, LEGAL], ids=["compliance", "legal"])
def world(spark, request):
    rules = request.param
    events = made(spark, rules, 90, len(rules)).cache()
    edges = graph.edges(events, rules).cache()
    sets = events.select((F.col("event_id") % 5).alias("qid"), "event_id")
    return events, rules, edges, sets


@pytest.mark.parametrize("slices", [1, 7])
def test_first_edges(world, monkeypatch, slices):
    events, rules, edges, _ = world
    monkeypatch.setattr(sweep.next_after, "__defaults__", (None, slices))
    assert rows(sweep.first_edges(events, rules)) == rows(graph.one_edge(edges))


def test_closure_and_frontier(world):
    events, rules, edges, sets = world
    few = sets.where("event_id < 25")
    closed = sweep.closure(few, events, rules)
    assert rows(closed) == rows(graph.closure(few, edges, depth(rules)))
    reach = graph.transitive(edges, depth(rules))
    assert rows(sweep.frontier(sets, events, rules)) == rows(graph.frontier(sets, reach))


def test_audit(world):
    """Against sets of edges in Python."""
    events, rules, edges, sets = world
    anchors = sets.where("event_id % 7 = 0")
    retrieved = sets.where("event_id % 4 <> 1")
    got = {r.qid: (r.frontier_in, r.superseded_ok, r.tca) for r in sweep.audit(retrieved, anchors, events, rules, graph.superseded(events, rules)).collect()}
    direct = {(r.trigger_id, r.target_id) for r in edges.collect()}
    reach = {tuple(r) for r in graph.transitive(edges, depth(rules)).collect()}
    mine = {}
    for q, e in retrieved.collect():
        mine.setdefault(q, set()).add(e)
    want = {}
    for q in {r.qid for r in anchors.collect()}:
        a = {r.event_id for r in anchors.where(F.col("qid") == q).collect()}
        closed = a | {t for t, o in reach if o in a}
        front = {e for e in closed if not any((t, e) in reach for t in closed)}
        ok = all(any((t, e) in direct for t in mine[q]) for e in mine[q] if any(o == e for _, o in direct))
        want[q] = (front <= mine[q], ok, int(front <= mine[q] and ok))
    assert got == want


@pytest.mark.parametrize("slices", [1, 5])
def test_next_superseder(world, monkeypatch, slices):
    events, rules, _, _ = world
    monkeypatch.setattr(sweep.next_after, "__defaults__", (None, slices))
    kinds = [rules[0].trigger_type, rules[1].trigger_type]
    all_rows = sorted(((e.ts, e.event_id, e.event_type, e.security_ticker) for e in events.collect()))
    want = [(i, next((b for _, b, kind, s in all_rows[k + 1 :] if s == scope and kind in kinds), None) if scope else None) for k, (_, i, _, scope) in enumerate(all_rows)]
    assert rows(graph.next_superseder(events, ["security_ticker"], kinds)) == sorted(want, key=str)


def test_anchor_probe(world):
    events, _, _, sets = world
    ranking = sets.select("qid", F.col("event_id").alias("doc_id"), (F.col("event_id") % 17 + 1).alias("rank"))
    got = rows(pipelines.anchor_probe(ranking, events, ["security_ticker", "employee_id"], 5))
    of = {e.event_id: e for e in events.collect()}
    tops = {}
    for q, d, r in ranking.where("rank <= 5").collect():
        tops.setdefault(q, {})[d] = r
    want = []
    for q, top in tops.items():
        for e in of.values():
            before = [r for d, r in top.items() if e.security_ticker and e.employee_id and (of[d].security_ticker, of[d].employee_id) == (e.security_ticker, e.employee_id) and of[d].ts < e.ts]
            if before and e.event_id not in top:
                want.append((q, e.event_id, min(before)))
    assert got == sorted(want, key=str)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    sets = spark.createDataFrame([], "qid long, event_id long")
    assert rows(sweep.first_edges(none, LEGAL)) == rows(sweep.closure(sets, none, LEGAL)) == rows(sweep.frontier(sets, none, LEGAL)) == []


def test_work_is_linear_in_a_hot_scope(spark):
    """No join puts out more rows than there are events, though nearly all of them share a scope."""
    n = 4000
    kinds = F.element_at(F.array(*map(F.lit, ["ruling_issued", "ruling_overruled", "ruling_codified"])), (F.col("id") % 3 + 1).cast("int"))
    events = spark.range(n).select(F.col("id").alias("event_id"), kinds.alias("event_type"), F.timestamp_seconds("id").alias("ts"), F.lit("E").alias("employee_id"), F.lit("T").alias("security_ticker"))
    found = sweep.first_edges(events, LEGAL)
    assert len(found.collect()) > n / 2
    plan = found._jdf.queryExecution().executedPlan()
    out, left = [], [plan]
    while left:
        node = left.pop()
        if node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec",):
            left.append(node.finalPhysicalPlan())
            continue
        if hasattr(node, "plan") and "QueryStage" in node.getClass().getSimpleName():
            left.append(node.plan())
        if "Join" in node.getClass().getSimpleName():
            out.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    assert out and all(0 < x <= 4 * n for x in out)
