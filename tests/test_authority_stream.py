"""The stream of the active frontier against the batch, in any order of arrival, and what its state holds."""

import datetime as dt
import random

import pytest

from arbiter.operators import graph
from arbiter.plans.rules import EVENTS
from arbiter.streaming import authority

RULES = [r for r in EVENTS if r.scope == ("user_id",)]
SCHEMA = "event_id long, event_type string, ts timestamp, user_id long"
START = dt.datetime(2024, 1, 1)
KINDS = ["view", "purchase", "error", "signup", "click"]


def made(n, seed, users=3):
    rng = random.Random(seed)
    return [(i, rng.choice(KINDS), START + dt.timedelta(minutes=rng.randrange(n * 20)), rng.choice([None, *range(users)])) for i in range(n)]


def run(spark, tmp_path, frames, build):
    """``build`` makes the result of streams that get one file a batch; returns the facts and the state's rows after each batch."""
    streams = []
    for name, (batches, schema) in frames.items():
        folder = tmp_path / name
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"{i:03}"))
        streams.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder)))
    facts = []
    query = build(*streams).writeStream.outputMode("update").foreachBatch(lambda b, n: facts.extend(b.collect()) and None).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        query.stop()
    return facts, states


def active(facts):
    came = {f.event_id for f in facts if f.state == "active"}
    return came - {f.event_id for f in facts if f.state == "overridden"}


def test_any_order_gives_the_batch_frontier(spark, tmp_path):
    rows = made(60, 1)
    random.Random(2).shuffle(rows)
    batches = [rows[:25] + rows[:5], rows[25:30], rows[20:]]  # some come twice
    facts, _ = run(spark, tmp_path, {"in": (batches, SCHEMA)}, lambda s: authority.frontier_changes(s, RULES, "3650 days", trace=True))
    events = spark.createDataFrame([r for r in rows if r[3] is not None], SCHEMA)
    assert active(facts) == {r.event_id for r in graph.active(events, RULES).collect()}
    # Triggers of a type look at the members of the types they override, and at no others.
    held = max(f.looked_at for f in facts if f.state == "arrival")
    assert held <= sum(r[1] in ("view", "purchase", "error") for r in rows)
    beats = {(r.trigger_type, r.target_type) for r in RULES}
    kinds = {r[0]: r[1] for r in rows}
    assert all((kinds[f.trigger_id], f.event_type) in beats for f in facts if f.state == "overridden")


def test_state_ends(spark, tmp_path):
    """Late events within the delay count; what the watermark has passed leaves the state."""
    rows = sorted((r for r in made(80, 3) if r[3] is not None), key=lambda r: r[2] + dt.timedelta(minutes=random.Random(r[0]).randrange(100)))
    far = [(10**6 + u, "click", START + dt.timedelta(days=60 + d), u) for d in (0, 1) for u in range(3)]
    batches = [rows[k : k + 16] for k in range(0, len(rows), 16)] + [far[:3], far[3:]]
    keep = 10 * 86400 * 10**6
    facts, states = run(spark, tmp_path, {"in": (batches, SCHEMA)}, lambda s: authority.frontier_changes(s, RULES, "3 hours", keep_us=keep))
    events = spark.createDataFrame(rows + far, SCHEMA)
    assert active(facts) >= {r.event_id for r in graph.active(events, RULES).collect()} - {f[0] for f in far}
    assert active(facts) - {f[0] for f in far} == {r.event_id for r in graph.active(spark.createDataFrame(rows, SCHEMA), RULES).collect()}
    assert max(states) > 0 and states[-1] == 0
    assert {f.event_id for f in facts if f.state == "settled"} <= active(facts)


def test_stale_retrievals(spark, tmp_path):
    rows = [r for r in made(40, 5) if r[3] is not None]
    front = sorted(graph.active(spark.createDataFrame(rows, SCHEMA), RULES).collect())
    now = START + dt.timedelta(days=2)
    # Two questions hold each active event; one has a single answer.
    held = [(q, e.event_id, e.event_type, e.ts, now, e.user_id) for e in front for q in ((1, 2) if e.event_id % 2 else (2,))]
    new = [(1000, "error", now + dt.timedelta(hours=1), 0), (1001, "view", now + dt.timedelta(hours=1), 1), (1002, "signup", START - dt.timedelta(days=1), 1)]
    schema = "qid long, event_id long, event_type string, ts timestamp, retrieved_at timestamp, user_id long"
    facts, states = run(spark, tmp_path, {"held": ([held], schema), "new": ([[], new[:2], new[2:]], SCHEMA)}, lambda h, n: authority.stale_retrievals(h, n, RULES, "30 days", trace=True))
    got = {(f.holder, f.event_id, f.trigger_id) for f in facts if f.state == "overridden"}
    assert got == {(str(q), e, 1000) for q, e, kind, _, _, u in held if kind == "purchase" and u == 0}
    looked = {f.event_id: f.looked_at for f in facts if f.state == "arrival"}
    assert looked[1000] == sum(kind == "purchase" and u == 0 for _, _, kind, _, _, u in held)
    assert 1001 not in looked  # no rule has it as a trigger


def test_rules_of_one_scope(spark):
    with pytest.raises(ValueError):
        authority.frontier_changes(spark.createDataFrame([], SCHEMA), EVENTS, "1 day")
