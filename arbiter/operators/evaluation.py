"""Whole evaluations: the rankings of every system, what each would answer, and how far it can be trusted, as one plan.

A question has a knowledge base of its own, so what overrides what is looked at within a question: ids of events
are pairs of a question and an event wherever that matters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbiter.operators import graph, metrics, pipelines, relevance, sweep
from arbiter.plans.rules import Rule
from arbiter.sources.shared import cut

#: The systems of an evaluation (fixed names). Those of other domains leave out the first and the last audit.
SYSTEMS = ("bm25", "dense", "oracle", "temporal_audit", "temporal_audit_anchor_only", "temporal_audit_plus", "temporal_audit_proactive")
DOMAIN_SYSTEMS = ("bm25", "dense", "oracle", "temporal_audit_anchor_only", "temporal_audit_plus")


@dataclass(frozen=True)
class World:
    """``keys`` are the columns of events and questions that a question's entities name; null where it names none."""

    questions: DataFrame  # qid, query, *keys, expected
    events: DataFrame  # event_id, event_type, ts, text, *keys
    known: DataFrame  # qid, event_id: a question's own knowledge base
    gold: DataFrame  # qid, doc_id, pos
    initial: DataFrame  # qid, doc_id, rank: a first ranking, as by vectors
    rules: list[Rule]
    keys: tuple[str, ...]


def _own(c: str) -> Column:
    return F.struct("qid", F.col(c).alias("id"))


def _scoped(rules: list[Rule]) -> list[Rule]:
    return [Rule(r.rule_id, r.trigger_type, r.target_type, ("qid", *r.scope)) for r in rules]


def bucket(world: World) -> DataFrame:
    """``qid, event_id`` and the events' columns: all events of a question's entities, if it names the first of them."""
    first, *rest = world.keys
    same = F.col(f"q.{first}") == F.col(f"e.{first}")
    for key in rest:
        same = same & F.col(f"q.{key}").eqNullSafe(F.col(f"e.{key}"))
    return world.questions.alias("q").join(world.events.alias("e"), same).select("q.qid", "e.*")


def bucket_probe(initial: DataFrame, found: DataFrame, events: DataFrame, k: int) -> DataFrame:
    """``qid, event_id, at``: of the bucket ``found`` what is later than a candidate and isn't one, by the first such candidate, time and id."""
    top = initial.where(F.col("rank") <= k)
    steps = top.join(events.select(F.col("event_id").alias("doc_id"), "ts"), "doc_id").groupBy("qid").agg(F.collect_list(F.struct("ts", "rank")).alias("steps"), F.min("ts").alias("first_ts"))
    before = F.filter("steps", lambda s: s["ts"] < F.col("ts"))
    # Whether there is such a candidate is asked of plain columns: Spark may move a filter on ``cand`` below the join, where ``ts`` isn't.
    late = found.select("qid", "event_id", "ts").join(steps, "qid").where("ts > first_ts").select("qid", "event_id", "ts", F.array_min(F.transform(before, lambda s: s["rank"])).alias("cand"))
    new = late.join(top.select("qid", F.col("doc_id").alias("event_id")), ["qid", "event_id"], "left_anti")
    return new.select("qid", "event_id", F.row_number().over(W.partitionBy("qid").orderBy("cand", "ts", "event_id")).alias("at"))


def newest_probe(initial: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``qid, event_id, at``: all of the bucket that isn't a candidate, latest first."""
    top = initial.where(F.col("rank") <= k).select("qid", F.col("doc_id").alias("event_id"))
    new = found.select("qid", "event_id", "ts").join(top, ["qid", "event_id"], "left_anti")
    return new.select("qid", "event_id", F.row_number().over(W.partitionBy("qid").orderBy(F.col("ts").desc(), "event_id")).alias("at"))


def evaluate(world: World, systems: tuple[str, ...] = SYSTEMS, k: int = 5, candidates: int = 20, priority: list[tuple[str, str]] | None = None, keep_superseded: bool = True) -> DataFrame:
    """``system, qid`` and the columns of ``compute_tca``, for every system and question.

    Without ``priority`` answers are those of ``derive_answer`` and count events of the question's entities if it
    names all; with it, those of ``derive_answer_by_priority`` over events that have each entity that it names.
    ``temporal_audit_plus`` and ``_proactive`` judge by the rules over the bucket, the others by the knowledge base.
    """
    if unknown := set(systems) - set(SYSTEMS):
        raise ValueError(f"no system named {', '.join(sorted(unknown))}")
    rules, initial = _scoped(world.rules), world.initial.select("qid", "doc_id", "rank")
    known = cut(world.known.select("qid", "event_id").distinct().join(world.events.drop("text"), "event_id").withColumn("event_id", _own("event_id")))
    gone = cut(graph.superseded(known, rules))
    found = cut(bucket(world).drop("text"))
    mine = initial.withColumn("doc_id", _own("doc_id"))

    def ranked(name: str) -> DataFrame:
        if name == "bm25":
            corpus = world.events.select(F.col("event_id").alias("doc_id"), "text")
            return relevance.bm25(corpus, world.questions, k, tokenizer="a", dup_terms=True, unmatched="append")
        if name == "dense":
            return initial
        if name == "oracle":
            return relevance.oracle_rank(world.events.select(F.col("event_id").alias("doc_id")), world.gold, k)
        if name == "temporal_audit":
            own = pipelines.audit_rerank(mine, gone, sweep.first_edges(known, rules).select("target_id", "trigger_id"), candidates)
        else:
            probe = newest_probe(initial, found, candidates) if name == "temporal_audit_proactive" else bucket_probe(initial, found, world.events, candidates)
            probe = probe.withColumn("event_id", _own("event_id"))
            own = pipelines.probe_rerank(mine, probe, known, gone, candidates, keep_superseded)
        return own.select("qid", F.col("doc_id.id").alias("doc_id"), "rank")

    named = lambda df, name, *columns: df.select(F.struct(F.lit(name).alias("system"), "qid").alias("qid"), *columns)
    tops = [named(ranked(s).where(F.col("rank") <= k), s, "doc_id", "rank") for s in systems]
    top = cut(reduce(DataFrame.unionAll, tops))

    # By the bucket's own graph where there is a bucket, else by the knowledge base's.
    local = graph.superseded(found.withColumn("event_id", _own("event_id")), rules).select("event_id.*")
    base, has = gone.select("event_id.*"), found.select("qid").distinct()
    judged = []
    for s in systems:
        by = local.unionAll(base.join(has, "qid", "left_anti")) if s in ("temporal_audit_plus", "temporal_audit_proactive") else base
        judged.append(named(by, s, F.col("id").alias("doc_id")))
    judged = reduce(DataFrame.unionAll, judged).select(F.struct("qid", "doc_id").alias("event_id"))

    every = F.explode(F.array(*map(F.lit, systems))).alias("system")
    asked = world.questions.select(every, "qid", *world.keys, "expected").withColumn("qid", F.struct("system", "qid")).drop("system")
    kinds = top.join(world.events.select(F.col("event_id").alias("doc_id"), "event_type", *world.keys), "doc_id")
    each = top.withColumn("doc_id", F.struct("qid", "doc_id"))
    of_top = kinds.select(F.struct("qid", "doc_id").alias("event_id"), "event_type", *world.keys).distinct()
    if priority is None:
        answers = metrics.derive_answer(each, of_top, judged, k, asked, list(world.keys))
    else:
        q = asked.select("qid", *(F.col(c).alias(f"q_{c}") for c in world.keys))
        fits = reduce(Column.__and__, (F.col(f"q_{c}").isNull() | F.coalesce(F.col(c) == F.col(f"q_{c}"), F.lit(False)) for c in world.keys))
        inside = of_top.withColumn("qid", F.col("event_id.qid")).join(q, "qid").where(fits).select("event_id", "event_type")
        answers = metrics.derive_answer_by_priority(each, inside, judged, priority, k)
    answers = asked.select("qid", "expected").join(answers.select("qid", F.col("answer").alias("predicted")), "qid", "left")

    pair = lambda df: df.withColumn("doc_id", F.struct(F.col("qid.qid").alias("qid"), F.col("doc_id").alias("id")))
    gold = world.gold.select(every, "qid", "doc_id").withColumn("qid", F.struct("system", "qid")).drop("system")
    out = metrics.compute_tca(pair(top), pair(gold), sweep.last_edges(known, rules), answers, k)
    return out.select(F.col("qid.system").alias("system"), F.col("qid.qid").alias("qid"), *(c for c in out.columns if c != "qid"))


def list_metrics(retrieved: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """``qid, hits, recall, precision`` of lists in which ids may stand more than once.

    Each of the first ``k`` entries of ``retrieved(qid, doc_id, rank)`` that is gold is a hit, and ``gold(qid, doc_id)``
    has as many entries as rows. Questions without any of either have no row.
    """
    n = gold.groupBy("qid").agg(F.count("*").alias("n_gold"))
    hit = retrieved.where(F.col("rank") <= k).join(gold.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    every = retrieved.select("qid").unionAll(gold.select("qid")).distinct().join(n, "qid", "left").join(hit, "qid", "left")
    hits = F.coalesce("hits", F.lit(0))
    return every.select("qid", hits.alias("hits"), F.round(hits / F.greatest(F.coalesce("n_gold", F.lit(0)), F.lit(1)), 6).alias("recall"), F.round(hits / F.lit(max(k, 1)), 6).alias("precision"))
