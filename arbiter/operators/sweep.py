"""As-of sweeps: what comes next in a scope, and what that decides about chains, closures and frontiers.

No edges are made here. Rows are sorted by scope and time and the next trigger runs along; whether one event
overrides another by way of others is decided from the earliest time at which a rule of the lattice can be
reached, one state for each scope. Events are ``event_id, event_type, ts`` with scope columns; a null scope
value matches nothing, and events of equal times don't override each other.

A scope that holds a third of all events is no single task's: its time is cut into slices, and what comes
first in later slices is carried over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbiter.plans.rules import Rule, checked
from arbiter.sources.shared import cut

#: Slices of the whole time span; a scope has so many carried values at most.
SLICES = 1024


def instant(df: DataFrame, name: str = "ts") -> Column:
    """A time column as a whole number, in its own order."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("long")
    return F.unix_micros(F.col(name).cast("timestamp"))


def _sliced(rows: DataFrame, slices: int) -> DataFrame:
    """``rows(at)`` with the slice of the span from the first to the last ``at`` that each is in."""
    span = F.broadcast(rows.agg(F.min("at").alias("lo"), F.max("at").alias("hi")))
    part = F.floor((F.col("at") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * slices)
    return rows.crossJoin(span).withColumn("slice", part).drop("lo", "hi")


def next_after(requests: DataFrame, triggers: DataFrame, keys: list[str], tie: str | None = None, slices: int = SLICES) -> DataFrame:
    """``requests`` with ``next_ts, next_id`` of the first of ``triggers(*keys, ts, event_id)`` that is later, null if none is.

    Of triggers at the same time the smallest id counts. With ``tie``, a column of requests, a trigger at a
    request's own time counts as later if its id is greater than that. Each row is shuffled once, by keys and slice.
    """
    mine = [c for c in requests.columns if c not in keys]
    ask = requests.select(*keys, instant(requests).alias("at"), (F.col(tie) if tie else F.lit(None)).alias("own"), F.struct(*mine).alias("ask"), F.lit(None).cast(triggers.schema["event_id"].dataType).alias("id"))
    has = triggers.select(*keys, instant(triggers).alias("at"), F.col("event_id").alias("own") if tie else F.lit(None).alias("own"), F.lit(None).alias("ask"), F.col("event_id").alias("id"), F.col("ts"))
    rows = ask.withColumn("ts", F.lit(None).cast(triggers.schema["ts"].dataType)).unionByName(has)
    known = reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))
    rows = _sliced(rows.where(known), slices)
    found = F.when(F.col("id").isNotNull(), F.struct("ts", "id"))
    within = W.partitionBy(*keys, "slice")
    if tie:
        # A request stands before a trigger of its own id, which is not later.
        later = within.orderBy(F.col("at").desc(), F.col("own").desc(), F.col("id").isNull().desc()).rowsBetween(W.unboundedPreceding, -1)
    else:
        later = within.orderBy(-F.col("at")).rangeBetween(W.unboundedPreceding, -1)
    swept = rows.withColumn("inside", F.min(found).over(later)).where("id IS NULL").select(*keys, "slice", "ask", "inside")
    firsts = rows.groupBy(*keys, "slice").agg(F.min(found).alias("first"))
    beyond = W.partitionBy(*keys).orderBy(F.col("slice").desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = firsts.select(*keys, "slice", F.min("first").over(beyond).alias("carried"))
    out = swept.join(carried, [*keys, "slice"]).withColumn("next", F.coalesce("inside", "carried"))
    return out.select(*keys, "ask.*", F.col("next.ts").alias("next_ts"), F.col("next.id").alias("next_id"))


def _of_types(events: DataFrame, types) -> DataFrame:
    return events.where(F.col("event_type").isin(sorted(types)))


def first_edges(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """``target_id, trigger_id, rule_id``: of each overridden event the first edge, by time, trigger and rule."""
    parts = []
    for scope in dict.fromkeys(r.scope for r in checked(rules)):
        its = [r for r in rules if r.scope == scope]
        pairs = F.lit(None)
        for kind in {r.target_type for r in its}:
            here = [F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.trigger_type).alias("trigger_type")) for r in its if r.target_type == kind]
            pairs = F.when(F.col("event_type") == kind, F.array(*here)).otherwise(pairs)
        targets = _of_types(events, {r.target_type for r in its}).select(*scope, F.col("event_id").alias("target_id"), "ts", F.explode(pairs).alias("r"))
        targets = targets.select(*scope, "target_id", "ts", "r.rule_id", "r.trigger_type")
        triggers = _of_types(events, {r.trigger_type for r in its}).select(*scope, F.col("event_type").alias("trigger_type"), "ts", "event_id")
        found = next_after(targets, triggers, [*scope, "trigger_type"])
        parts.append(found.where("next_id IS NOT NULL").select("target_id", F.struct("next_ts", "next_id", "rule_id").alias("edge")))
    best = reduce(DataFrame.unionAll, parts).groupBy("target_id").agg(F.min("edge").alias("edge"))
    return best.select("target_id", F.col("edge.next_id").alias("trigger_id"), "edge.rule_id")


def last_edges(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """``target_id, trigger_id, trigger_ts``: of each overridden event the last trigger; only the latest of a scope counts."""
    parts = []
    for r in checked(rules):
        triggers = events.where(F.col("event_type") == r.trigger_type)
        latest = triggers.groupBy(*r.scope).agg(F.max(F.struct("ts", "event_id")).alias("latest"))
        targets = events.where(F.col("event_type") == r.target_type).select(*r.scope, F.col("event_id").alias("target_id"), "ts")
        parts.append(targets.join(latest, list(r.scope)).where("ts < latest.ts").select("target_id", "latest"))
    best = reduce(DataFrame.unionAll, parts).groupBy("target_id").agg(F.max("latest").alias("latest"))
    return best.select("target_id", F.col("latest.event_id").alias("trigger_id"), F.col("latest.ts").alias("trigger_ts"))


def arrivals(members: DataFrame, events: DataFrame, rules: list[Rule]) -> dict[Rule, DataFrame]:
    """For each rule ``event_id, *scope, after``: what overrides the event by way of that rule last.

    These are the trigger's events in the scope that are later than ``after``, the earliest time at which
    the rule's target type can be reached from the event. ``members(event_id)`` are the events asked for.
    """
    after = {r: [] for r in checked(rules)}
    own = cut(members.select("event_id").distinct().join(events, "event_id"))
    for r in rules:
        after[r].append(own.where(F.col("event_type") == r.target_type).select("event_id", *r.scope, F.col("ts").alias("after")))
    out = {}
    # A rule comes after all that lead to it, so that its states are complete when they go on.
    for r in _in_order(rules):
        known = reduce(Column.__and__, (F.col(c).isNotNull() for c in r.scope))
        states = reduce(DataFrame.unionAll, after[r]).where(known).groupBy("event_id", *r.scope).agg(F.min("after").alias("after"))
        states = out[r] = cut(states) if len(after[r]) > 1 else states
        for s in rules:
            if s.target_type == r.trigger_type:
                after[s].append(_step(states, events, r, s))
    return out


def _in_order(rules: list[Rule]) -> list[Rule]:
    done: list[Rule] = []
    while len(done) < len(rules):
        done += [r for r in rules if r not in done and all(p in done for p in rules if p.trigger_type == r.target_type)]
    return done


def _step(states: DataFrame, events: DataFrame, r: Rule, s: Rule) -> DataFrame:
    """States of ``s`` after those of ``r``: in each scope of ``s``, the first trigger of ``r`` that is later."""
    more = [c for c in s.scope if c not in r.scope]
    keys = [*r.scope, *more]
    triggers = events.where(F.col("event_type") == r.trigger_type).select(*keys, "ts", "event_id")
    asked = states.withColumnRenamed("after", "ts").withColumnRenamed("event_id", "member")
    if more:  # the trigger may be in several scopes of the next rule
        asked = asked.join(triggers.select(*keys).distinct(), list(r.scope))
    found = next_after(asked, triggers, keys).where("next_id IS NOT NULL")
    return found.select(F.col("member").alias("event_id"), *s.scope, F.col("next_ts").alias("after"))


def closure(anchors: DataFrame, events: DataFrame, rules: list[Rule]) -> DataFrame:
    """``qid, event_id``: anchors and all that override them, directly or through others."""
    a = cut(anchors.select("qid", "event_id").distinct())
    parts = [a]
    for r, states in arrivals(a, events, rules).items():
        starts = a.join(states, "event_id").groupBy("qid", *r.scope).agg(F.min("after").alias("after"))
        late = events.where(F.col("event_type") == r.trigger_type).select(*r.scope, "event_id", "ts")
        parts.append(starts.join(late, list(r.scope)).where("ts > after").select("qid", "event_id"))
    return reduce(DataFrame.unionAll, parts).distinct()


def _beaten(sets: DataFrame, events: DataFrame, states: dict[Rule, DataFrame]) -> DataFrame:
    """``qid, event_id`` of members that another one of their set overrides: the latest trigger of a scope decides."""
    s = sets.select("qid", "event_id").distinct()
    typed = s.join(events, "event_id")
    parts = []
    for r, after in states.items():
        latest = typed.where(F.col("event_type") == r.trigger_type).groupBy("qid", *r.scope).agg(F.max("ts").alias("latest"))
        parts.append(s.join(after, "event_id").join(latest, ["qid", *r.scope]).where("latest > after").select("qid", "event_id"))
    return reduce(DataFrame.unionAll, parts).distinct()


def frontier(sets: DataFrame, events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Members of each ``qid``'s set that nothing inside the set overrides, directly or through any events."""
    s = cut(sets.select("qid", "event_id").distinct())
    return s.join(_beaten(s, events, arrivals(s, events, rules)), ["qid", "event_id"], "left_anti")


def audit(retrieved: DataFrame, anchors: DataFrame, events: DataFrame, rules: list[Rule], superseded: DataFrame) -> DataFrame:
    """``qid, frontier_in, superseded_ok, tca``: the frontier of the anchors' closure is retrieved, and every
    retrieved event that is overridden (``superseded(event_id)``) has one that overrides it directly among the retrieved.
    """
    r = cut(retrieved.select("qid", "event_id").distinct())
    front = frontier(closure(anchors, events, rules), events, rules)
    missing = front.join(r, ["qid", "event_id"], "left_anti").select("qid").distinct().withColumn("missing", F.lit(True))
    typed = r.select("event_id").distinct().join(events, "event_id")
    direct = {rule: typed.where(F.col("event_type") == rule.target_type).select("event_id", *rule.scope, F.col("ts").alias("after")) for rule in checked(rules)}
    orphan = r.join(superseded, "event_id", "left_semi").join(_beaten(r, events, direct), ["qid", "event_id"], "left_anti")
    orphan = orphan.select("qid").distinct().withColumn("orphan", F.lit(True))
    q = anchors.select("qid").distinct().join(missing, "qid", "left").join(orphan, "qid", "left")
    whole, ok = F.col("missing").isNull(), F.col("orphan").isNull()
    return q.select("qid", whole.alias("frontier_in"), ok.alias("superseded_ok"), (whole & ok).cast("long").alias("tca"))
