"""The authority graph: supersession edges, active events, chains, certificates, closure and frontier.

Events are ``event_id, event_type, ts`` with scope columns. An edge says that a later trigger overrides a
target of the same scope. A null scope value matches nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbiter.operators import sweep
from arbiter.plans.rules import Rule, checked, depth
from arbiter.sources.shared import cut


def _by_scope(rules: list[Rule]) -> dict[tuple, list[Rule]]:
    out: dict[tuple, list[Rule]] = {}
    for r in checked(rules):
        out.setdefault(r.scope, []).append(r)
    return out


def _rule_rows(rules: list[Rule]) -> F.Column:
    return F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.trigger_type).alias("trigger_type")) for r in rules))


def edges(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """``trigger_id, target_id, rule_id, trigger_ts, target_ts``.

    One equi-join per distinct scope, on the scope's columns and the trigger's type; the order in time is
    what is left. An ``OR`` over scopes would leave no key to join on.
    """
    parts = []
    for scope, its in _by_scope(rules).items():
        wants = F.lit(None)
        for kind in {r.target_type for r in its}:
            wants = F.when(F.col("event_type") == kind, _rule_rows([r for r in its if r.target_type == kind])).otherwise(wants)
        target = events.where(F.col("event_type").isin([r.target_type for r in its])).select(*scope, F.col("event_id").alias("target_id"), F.col("ts").alias("target_ts"), F.explode(wants).alias("r"))
        target = target.select(*scope, "target_id", "target_ts", "r.rule_id", "r.trigger_type")
        trigger = events.where(F.col("event_type").isin([r.trigger_type for r in its])).select(*scope, F.col("event_id").alias("trigger_id"), F.col("ts").alias("trigger_ts"), F.col("event_type").alias("trigger_type"))
        parts.append(target.join(trigger, [*scope, "trigger_type"]).where("trigger_ts > target_ts").select("trigger_id", "target_id", "rule_id", "trigger_ts", "target_ts"))
    return reduce(DataFrame.unionAll, parts)


def superseded(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """``event_id`` of all overridden events, without making edges: only the latest trigger of a scope counts."""
    parts = []
    for scope, its in _by_scope(rules).items():
        latest = events.where(F.col("event_type").isin([r.trigger_type for r in its])).groupBy(*scope, F.col("event_type").alias("trigger_type")).agg(F.max("ts").alias("latest"))
        wants = F.lit(None)
        for kind in {r.target_type for r in its}:
            wants = F.when(F.col("event_type") == kind, F.array(*(F.lit(r.trigger_type) for r in its if r.target_type == kind))).otherwise(wants)
        target = events.where(F.col("event_type").isin([r.target_type for r in its])).select(*scope, "event_id", "ts", F.explode(wants).alias("trigger_type"))
        parts.append(target.join(latest, [*scope, "trigger_type"]).where("ts < latest").select("event_id"))
    return reduce(DataFrame.unionAll, parts).distinct()


def active(events: DataFrame, rules: list[Rule]) -> DataFrame:
    return events.join(superseded(events, rules), "event_id", "left_anti")


def one_edge(e: DataFrame, which: str = "first") -> DataFrame:
    """One trigger per target: the first in time, or the last."""
    key = F.struct("trigger_ts", "trigger_id", "rule_id")
    best = F.min(key) if which == "first" else F.max(key)
    return e.groupBy("target_id").agg(best.alias("b")).select("target_id", "b.trigger_id", "b.rule_id")


def chains(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """``event_id, depth, trigger_id, rule_id``: from each overridden event along first edges.

    Edges go forward in time and rules have no cycle, so the number of joins is the rules' depth.
    """
    first = cut(sweep.first_edges(events, rules))
    step = first.select(F.col("target_id").alias("event_id"), F.lit(1).cast("long").alias("depth"), "trigger_id", "rule_id")
    out, now = step, step
    for d in range(2, depth(rules) + 1):
        follow = first.select(F.col("target_id").alias("at"), F.col("trigger_id").alias("next_id"), F.col("rule_id").alias("next_rule"))
        now = now.join(follow, F.col("trigger_id") == F.col("at")).select("event_id", F.lit(d).cast("long").alias("depth"), F.col("next_id").alias("trigger_id"), F.col("next_rule").alias("rule_id"))
        out = out.unionAll(now)
    return out


def certificates(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """``event_id, valid, reason, chain`` of every event."""
    steps = chains(events, rules).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("depth", "trigger_id", "rule_id"))).alias("steps"))
    chain = F.transform(F.coalesce("steps", F.array()), lambda s: F.struct(s["trigger_id"].alias("event_id"), s["rule_id"].alias("rule_id")))
    valid = F.col("steps").isNull()
    return events.select("event_id").join(steps, "event_id", "left").select("event_id", valid.alias("valid"), F.when(valid, "no_superseding_event_found").otherwise("superseded").alias("reason"), chain.alias("chain"))


def closure(anchors: DataFrame, e: DataFrame, steps: int) -> DataFrame:
    """``qid, event_id``: anchors and all that override them, directly or through others.

    Each step follows edges from what the step before found; ``steps`` is the rules' depth.
    """
    pairs = e.select(F.col("target_id").alias("event_id"), F.col("trigger_id").alias("next")).distinct()
    now = out = anchors.select("qid", "event_id").distinct()
    for _ in range(steps):
        now = now.join(pairs, "event_id").select("qid", F.col("next").alias("event_id")).distinct()
        out = out.unionAll(now)
    return out.distinct()


def transitive(e: DataFrame, steps: int) -> DataFrame:
    """``trigger_id, target_id`` of the transitive relation."""
    direct = e.select("trigger_id", "target_id").distinct()
    out = now = direct
    for _ in range(steps - 1):
        now = now.alias("a").join(direct.alias("b"), F.col("a.trigger_id") == F.col("b.target_id")).select("b.trigger_id", "a.target_id").distinct()
        out = out.unionAll(now)
    return out.distinct()


def frontier(sets: DataFrame, reach: DataFrame) -> DataFrame:
    """Members of each ``qid``'s set that nothing inside the set overrides, ``reach`` being transitive."""
    s = sets.select("qid", "event_id").distinct()
    beaten = s.join(reach, F.col("event_id") == F.col("target_id")).select("qid", "event_id", "trigger_id")
    beaten = beaten.join(s.select("qid", F.col("event_id").alias("trigger_id")), ["qid", "trigger_id"], "left_semi").select("qid", "event_id").distinct()
    return s.join(beaten, ["qid", "event_id"], "left_anti")


def closure_violations(retrieved: DataFrame, e: DataFrame) -> DataFrame:
    """``qid, target_id, trigger_id``: a retrieved event is overridden by one that wasn't retrieved."""
    r = retrieved.select("qid", "event_id").distinct()
    hit = r.join(e.select("target_id", "trigger_id").distinct(), F.col("event_id") == F.col("target_id")).select("qid", "target_id", "trigger_id")
    return hit.join(r.select("qid", F.col("event_id").alias("trigger_id")), ["qid", "trigger_id"], "left_anti").select("qid", "target_id", "trigger_id")


def scope_ambiguity(anchors: DataFrame, events: DataFrame, closed: DataFrame, scope: list[str]) -> DataFrame:
    """``qid, n_scope, n_closure, kappa, phi``: how many events share the anchors' scopes, to how many control them.

    ``closed(qid, event_id)`` is the anchors' closure.
    """
    cl = closed.groupBy("qid").agg(F.count("*").alias("n_closure"))
    of = anchors.join(events.select("event_id", *scope), "event_id").select("qid", *scope).distinct()
    sizes = events.groupBy(*scope).agg(F.count("*").alias("size"))
    n = of.join(sizes, scope).groupBy("qid").agg(F.sum("size").alias("n_scope"))
    kappa = F.col("n_scope") / F.col("n_closure")
    return n.join(cl, "qid").select("qid", "n_scope", "n_closure", F.round(kappa, 6).alias("kappa"), F.round(F.least(F.lit(1.0), 1 / kappa), 6).alias("phi"))


def divergence(scored: DataFrame, front: DataFrame) -> DataFrame:
    """``qid, delta, n_above``: the best score over the best of the frontier, and how many score above that."""
    s = scored.select("qid", "event_id", "score")
    best = s.join(front, ["qid", "event_id"]).groupBy("qid").agg(F.max("score").alias("front_best"))
    return s.join(best, "qid").groupBy("qid").agg(F.round(F.max("score") - F.max("front_best"), 6).alias("delta"), F.count(F.when(F.col("score") > F.col("front_best"), 1)).alias("n_above"))


def probable_closure(anchors: DataFrame, e: DataFrame, least: float, steps: int) -> DataFrame:
    """Closure along edges whose ``conf`` is at least ``least``."""
    return closure(anchors, e.where(F.col("conf") >= least), steps)


def safe_frontier(sets: DataFrame, e: DataFrame, alpha: float) -> DataFrame:
    """Members that are maximal with a probability of ``alpha`` or more, edges being independent."""
    s = sets.select("qid", "event_id").distinct()
    inside = s.join(e.groupBy("target_id", "trigger_id").agg(F.max("conf").alias("conf")), F.col("event_id") == F.col("target_id"))
    inside = inside.join(s.select("qid", F.col("event_id").alias("trigger_id")), ["qid", "trigger_id"], "left_semi")
    # A sure edge leaves no chance; the product of the others is a sum of logarithms.
    p = inside.groupBy("qid", "event_id").agg(F.bool_or(F.col("conf") >= 1).alias("sure"), F.sum(F.when(F.col("conf") < 1, F.ln(1 - F.col("conf"))).otherwise(F.lit(0.0))).alias("log_p"))
    chance = F.when(F.coalesce("sure", F.lit(False)), F.lit(0.0)).otherwise(F.exp(F.coalesce("log_p", F.lit(0.0))))
    return s.join(p, ["qid", "event_id"], "left").select("qid", "event_id", F.round(chance, 6).alias("p_maximal")).where(F.col("p_maximal") >= alpha)


def multi_authority_frontier(anchors: DataFrame, e: DataFrame, steps: int) -> DataFrame:
    """Closure over the union of relations ``relation_id``; members undominated in each of them."""
    cl = closure(anchors, e, steps)
    beaten = cl.join(e.select("relation_id", "target_id", "trigger_id").distinct(), F.col("event_id") == F.col("target_id")).select("qid", "event_id", "relation_id", "trigger_id")
    beaten = beaten.join(cl.select("qid", F.col("event_id").alias("trigger_id")), ["qid", "trigger_id"], "left_semi").select("qid", "event_id").distinct()
    return cl.join(beaten, ["qid", "event_id"], "left_anti")


def bucket_graph(retrieved: DataFrame, events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Edges of the rules among each question's retrieved events only: ``qid`` is part of every scope."""
    mine = retrieved.select("qid", "event_id").distinct().join(events, "event_id")
    scoped = [Rule(r.rule_id, r.trigger_type, r.target_type, ("qid", *r.scope)) for r in rules]
    parts = []
    for scope, its in _by_scope(scoped).items():
        for r in its:
            t = mine.where(F.col("event_type") == r.target_type).select(*scope, F.col("event_id").alias("target_id"), F.col("ts").alias("target_ts"))
            g = mine.where(F.col("event_type") == r.trigger_type).select(*scope, F.col("event_id").alias("trigger_id"), F.col("ts").alias("trigger_ts"))
            parts.append(t.join(g, list(scope)).where("trigger_ts > target_ts").select("qid", "trigger_id", "target_id", F.lit(r.rule_id).alias("rule_id")))
    return reduce(DataFrame.unionAll, parts)


def next_superseder(events: DataFrame, scope: list[str], types: list[str]) -> DataFrame:
    """``event_id, next_id``: the next event of the given types in the scope, in the order of time and id.

    Events with a null in their scope have none.
    """
    kinds = events.where(F.col("event_type").isin(types)).select(*scope, "ts", "event_id")
    asked = events.select(*scope, "ts", F.col("event_id").alias("asked_id"))
    found = sweep.next_after(asked, kinds, scope, tie="asked_id").select(F.col("asked_id").alias("event_id"), "next_id")
    known = reduce(Column.__and__, (F.col(c).isNotNull() for c in scope))
    return found.unionAll(events.where(~known).select("event_id", F.lit(None).cast(events.schema["event_id"].dataType)))
