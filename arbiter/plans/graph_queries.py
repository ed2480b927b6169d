"""Registered queries of the authority graph over ``events`` and of two-stage retrieval over ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.functions import scores
from arbiter.operators import best, graph, metrics, pipelines, relevance, sweep
from arbiter.plans import adapters
from arbiter.plans.relevance_queries import bm25_ctes
from arbiter.plans.rules import EVENTS, depth
from arbiter.sources.io import table
from arbiter.sources.shared import stored

STEPS = depth(EVENTS)


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "event_type", "ts", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "value")


def edges(spark, d) -> DataFrame:
    return graph.edges(events(spark, d), EVENTS)


def supersession_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("trigger_id", "target_id", "rule_id")


def superseded_events(spark: SparkSession, d: str) -> DataFrame:
    return graph.superseded(events(spark, d), EVENTS)


def active_events(spark: SparkSession, d: str) -> DataFrame:
    return graph.active(events(spark, d), EVENTS).select("event_id", "event_type", "user_id")


def superseding_chain(spark: SparkSession, d: str) -> DataFrame:
    return graph.chains(events(spark, d), EVENTS)


def validity_certificate(spark: SparkSession, d: str) -> DataFrame:
    c = graph.certificates(events(spark, d), EVENTS)
    return c.select("event_id", "valid", "reason", F.array_join(F.transform("chain", lambda s: F.concat_ws(":", s["event_id"].cast("string"), s["rule_id"])), ">").alias("chain"))


def anchors(spark, d) -> DataFrame:
    """Each user's five views and purchases of the highest value, the user being the question."""
    e = events(spark, d).where("event_type IN ('view', 'purchase')")
    return relevance.top_k(e.select(F.col("user_id").alias("qid"), F.col("event_id").alias("doc_id"), F.col("value").alias("score")), 5).select("qid", F.col("doc_id").alias("event_id"))


def authority_closure(spark: SparkSession, d: str) -> DataFrame:
    return sweep.closure(anchors(spark, d), events(spark, d), EVENTS)


def active_frontier(spark: SparkSession, d: str) -> DataFrame:
    return sweep.frontier(authority_closure(spark, d), events(spark, d), EVENTS)


def frontier_of_retrieved(spark: SparkSession, d: str) -> DataFrame:
    return sweep.frontier(ranking(spark, d).where("rank <= 20").select("qid", F.col("doc_id").alias("event_id")), events(spark, d), EVENTS)


def closure_violations(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure_violations(anchors(spark, d), edges(spark, d)).groupBy("qid").agg(F.count("*").alias("n_violations"), F.count_distinct("target_id").alias("n_targets"))


def scope_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    return graph.scope_ambiguity(anchors(spark, d), events(spark, d), authority_closure(spark, d), ["user_id"])


def divergence(spark: SparkSession, d: str) -> DataFrame:
    scored = events(spark, d).select(F.col("user_id").alias("qid"), "event_id", F.round("value", 6).alias("score"))
    return graph.divergence(scored, active_frontier(spark, d))


def correctness_audit(spark: SparkSession, d: str) -> DataFrame:
    r = ranking(spark, d).where("rank <= 20").select("qid", F.col("doc_id").alias("event_id"))
    return sweep.audit(r, anchors(spark, d), events(spark, d), EVENTS, superseded_events(spark, d))


def confident(spark, d) -> DataFrame:
    """Edges with a confidence made of their ids."""
    return edges(spark, d).withColumn("conf", ((F.col("trigger_id") + F.col("target_id")) % 10) / 10)


def probable_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.probable_closure(anchors(spark, d), confident(spark, d), 0.5, STEPS)


def safe_frontier(spark: SparkSession, d: str) -> DataFrame:
    sets = ranking(spark, d).where("rank <= 20").select("qid", F.col("doc_id").alias("event_id"))
    return graph.safe_frontier(sets, confident(spark, d), 0.2)


def multi_authority(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).withColumn("relation_id", F.when(F.col("rule_id").isin("D1", "D2"), "a").otherwise("b"))
    return graph.multi_authority_frontier(anchors(spark, d), e, STEPS)


def latest_per_scope(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("ts"), "o_custkey")
    return pipelines.latest_per_scope(o, ["o_custkey"]).select("o_custkey", "doc_id")


def next_superseder(spark: SparkSession, d: str) -> DataFrame:
    return graph.next_superseder(events(spark, d), ["user_id"], ["error"]).fillna(-1)


def rssg_edges(spark: SparkSession, d: str) -> DataFrame:
    r = ranking(spark, d).where("rank <= 20").select("qid", F.col("doc_id").alias("event_id"))
    return graph.bucket_graph(r, events(spark, d), EVENTS)


def ranking(spark, d) -> DataFrame:
    """All of each user's events by value."""
    return relevance.ranked(events(spark, d).select(F.col("user_id").alias("qid"), F.col("event_id").alias("doc_id"), F.col("value").alias("score"))).select("qid", "doc_id", "rank")


def anchor_probe(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.anchor_probe(ranking(spark, d), events(spark, d), ["user_id", "k"])


def proactive_probe(spark: SparkSession, d: str) -> DataFrame:
    q = events(spark, d).select(F.col("user_id").alias("qid"), "user_id").distinct()
    return pipelines.proactive_probe(ranking(spark, d), q, events(spark, d), ["user_id"]).where("at <= 10")


def audit_rerank(spark: SparkSession, d: str) -> DataFrame:
    first = sweep.first_edges(events(spark, d), EVENTS).select("target_id", "trigger_id")
    return pipelines.audit_rerank(ranking(spark, d), superseded_events(spark, d), first)


def _probe(spark, d):
    return anchor_probe(spark, d).select("qid", "event_id", (F.col("cand_rank") * 1000000 + F.col("event_id")).alias("at"))


def probe_rerank(spark: SparkSession, d: str) -> DataFrame:
    known = events(spark, d).where("event_id % 3 <> 0")
    return pipelines.probe_rerank(ranking(spark, d), _probe(spark, d), known, superseded_events(spark, d))


def probe_rerank_plain(spark: SparkSession, d: str) -> DataFrame:
    known = events(spark, d).where("event_id % 3 <> 0")
    return pipelines.probe_rerank(ranking(spark, d), _probe(spark, d), known, superseded_events(spark, d), keep_superseded=False)


#: The compliance types that stand for the event types, to derive answers.
KINDS = {"signup": "emergency_exception", "error": "blackout_announced", "purchase": "pre_clearance_approved", "click": "blackout_lifted", "view": "policy_updated"}


def compliance_events(spark, d) -> DataFrame:
    kind = F.col("event_type")
    for a, b in KINDS.items():
        kind = F.when(F.col("event_type") == a, b).otherwise(kind)
    return events(spark, d).withColumn("event_type", kind)


def derive_answer(spark: SparkSession, d: str) -> DataFrame:
    q = events(spark, d).select(F.col("user_id").alias("qid")).distinct().select("qid", F.when(F.col("qid") % 2 == 0, F.col("qid")).alias("user_id"), F.lit(1).cast("long").alias("k"))
    return metrics.derive_answer(ranking(spark, d), compliance_events(spark, d).select("event_id", "event_type", "user_id", "k"), superseded_events(spark, d), 5, q, ["user_id", "k"])


PRIORITY = [("purchase", "bought"), ("signup", "joined"), ("click", "clicked")]


def derive_answer_by_priority(spark: SparkSession, d: str) -> DataFrame:
    return metrics.derive_answer_by_priority(ranking(spark, d), events(spark, d).select("event_id", "event_type"), superseded_events(spark, d), PRIORITY)


def _tca(spark, d, mode):
    r = ranking(spark, d)
    gold = r.where("rank % 2 = 1 AND rank <= 10").select("qid", "doc_id")
    answers = derive_answer_by_priority(spark, d).select("qid", F.col("answer").alias("predicted"), F.when(F.col("qid") % 2 == 0, "bought").otherwise(F.lit(" Joined ")).alias("expected"))
    return metrics.compute_tca(r, gold, edges(spark, d), answers, 5, mode, provenance=r.where("rank IN (1, 8)").select("qid", "doc_id"))


def tca_strict(spark: SparkSession, d: str) -> DataFrame:
    return _tca(spark, d, "strict")


def tca_any(spark: SparkSession, d: str) -> DataFrame:
    return _tca(spark, d, "any")


def tca_rollup(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tca_rollup(_tca(spark, d, "strict").withColumn("hop_type", F.concat(F.lit("T"), (F.col("qid") % 4).cast("string"))))


def kappa_groups(spark: SparkSession, d: str) -> DataFrame:
    s = scope_ambiguity(spark, d).select("qid", F.round("kappa").cast("long").alias("kappa"))
    t = _tca(spark, d, "any").select("qid", F.col("recall").alias("r_anchor"), "tca")
    return metrics.kappa_groups(s.join(t, "qid"))


def kappa_correlation(spark: SparkSession, d: str) -> DataFrame:
    j = scope_ambiguity(spark, d).join(_tca(spark, d, "any").select("qid", "n_superseded"), "qid")
    return j.agg(F.round(scores.pearson("kappa", "n_superseded"), 6).alias("r"))


# -- two stages over conversations -----------------------------------------------------------------------


def records(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("role").alias("record_type"), F.col("turn").alias("ts"), "conv_id", "text")


def conversation_questions(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").where("role = 'user'")
    return c.groupBy(F.col("conv_id").alias("qid")).agg(F.min_by("text", "turn").alias("query"))


def stage1(spark, d, k: int) -> DataFrame:
    """The first ``k`` of each question, stored, as more than one step reads them: what follows can't reach the first ``k`` of a re-ranking."""
    top = relevance.bm25_top(records(spark, d).select("doc_id", "text"), conversation_questions(spark, d), k)
    return stored(top.select("qid", "doc_id", "rank"), "stage1")


def two_stage(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.two_stage(stage1(spark, d, 20), records(spark, d), adapters.CONVERSATION, 5).where("rank <= 20")


def two_stage_bounded(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.two_stage(stage1(spark, d, 30), records(spark, d), adapters.CONVERSATION, 10, extra=30)


def two_stage_latest(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.two_stage_latest(stage1(spark, d, 20), records(spark, d), ["conv_id"], 5).where("rank <= 20")


def two_stage_truncated(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.two_stage_truncated(stage1(spark, d, 20), records(spark, d), adapters.CONVERSATION)


def entity_index_last(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.entity_index_last(records(spark, d).where("record_type = 'assistant'"), ["conv_id"])


def _picked(spark, d, *picks) -> list[DataFrame]:
    """``qid, doc_id`` of each question's own record of a kind, for each ``(kind, pick)``."""
    return [records(spark, d).where(F.col("record_type") == kind).groupBy(F.col("conv_id").alias("qid")).agg(pick("doc_id").alias("doc_id")) for kind, pick in picks]


def analytic_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of goals are counted where they are asked for, of questions whose anchor isn't among the first three."""
    n = records(spark, d).count()
    docs, asked = relevance.bm25_vectors(records(spark, d).select("doc_id", "text"), conversation_questions(spark, d))
    anchors, goals = _picked(spark, d, ("user", F.min), ("assistant", F.max))
    first = relevance.top_k(best.best(docs, asked, 3), 3).select("qid", "doc_id", "rank")
    anchor = stored(relevance.rank_of(first, anchors, n), "anchors")
    ranks = best.ranks(docs, asked, goals.join(anchor.where("rank > 3"), "qid", "left_semi"))
    return pipelines.analytic_rank(anchor, relevance.rank_of(ranks, goals, n), 3)


def error_categories(spark: SparkSession, d: str) -> DataFrame:
    """Only ranks up to 5 are told apart, so no others are counted."""
    first, n = stage1(spark, d, 5), records(spark, d).count()
    anchor, goal = (relevance.rank_of(first, one, n) for one in _picked(spark, d, ("user", F.max), ("assistant", F.max)))
    j = anchor.select("qid", (F.col("rank") <= 5).alias("anchor_found")).join(goal.select("qid", (F.col("rank") <= 5).alias("hit")), "qid")
    return metrics.error_categories(j)


def two_stage_identity(spark: SparkSession, d: str) -> DataFrame:
    """With one scope per conversation, whether the goal is found at k equals whether an anchor is."""
    first = stage1(spark, d, 5)
    two = pipelines.two_stage(first, records(spark, d), adapters.CONVERSATION, 5)
    kinds = records(spark, d).select("doc_id", "record_type", "conv_id")
    hit = two.where("tier = 0").join(kinds, "doc_id").where("conv_id = qid").select("qid").distinct()
    anchor = first.join(kinds, "doc_id").where("conv_id = qid AND record_type = 'user'").select("qid").distinct()
    return metrics.all_pass(anchor.join(records(spark, d).where("record_type = 'assistant'").select(F.col("conv_id").alias("qid")).distinct(), "qid").join(hit.withColumn("h", F.lit(1)), "qid", "left").select(F.col("qid").alias("name"), F.col("h").isNotNull().alias("passed")))


# -- SQL ------------------------------------------------------------------------------------------------

EV = "ev AS (SELECT event_id, event_type, ts, user_id, json_extract(props, '$.k')::BIGINT AS k, value FROM events)"
ED = f"""{EV}, rules(rule_id, tr, ta, byk) AS (VALUES ('D1', 'error', 'purchase', false), ('D2', 'signup', 'error', false), ('D3', 'purchase', 'view', false), ('D4', 'click', 'view', true)),
ed AS (SELECT t.event_id AS trigger_id, o.event_id AS target_id, rule_id, t.ts AS trigger_ts FROM ev t JOIN rules ON t.event_type = tr JOIN ev o ON o.event_type = ta AND o.user_id = t.user_id AND t.ts > o.ts AND (NOT byk OR o.k = t.k)),
sup AS (SELECT DISTINCT target_id AS event_id FROM ed), p AS (SELECT DISTINCT trigger_id, target_id FROM ed),
fe AS (SELECT target_id, min((trigger_ts, trigger_id, rule_id)) AS m FROM ed GROUP BY target_id),
rk AS (SELECT user_id AS qid, event_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM ev),
anc AS (SELECT * FROM (SELECT user_id AS qid, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM ev WHERE event_type IN ('view', 'purchase')) WHERE rank <= 5)"""
REACH = "tc(trigger_id, target_id) AS (SELECT trigger_id, target_id FROM p UNION SELECT p.trigger_id, tc.target_id FROM tc JOIN p ON tc.trigger_id = p.target_id)"
CL = f"{REACH}, cl AS (SELECT qid, event_id FROM anc UNION SELECT qid, tc.trigger_id FROM anc JOIN tc ON tc.target_id = anc.event_id)"
FRONT = "fr AS (SELECT qid, event_id FROM cl WHERE NOT EXISTS (SELECT 1 FROM tc JOIN cl c2 ON c2.event_id = tc.trigger_id WHERE tc.target_id = cl.event_id AND c2.qid = cl.qid))"
CH = f"WITH RECURSIVE {ED}, ch(event_id, depth, trigger_id, rule_id) AS (SELECT target_id, 1::BIGINT, m[2], m[3] FROM fe UNION ALL SELECT c.event_id, c.depth + 1, f.m[2], f.m[3] FROM ch c JOIN fe f ON f.target_id = c.trigger_id)"
KNOWN = "LEFT JOIN (SELECT event_id AS e1 FROM ev WHERE event_id % 3 <> 0) ON e1 = doc_id LEFT JOIN (SELECT event_id AS e2 FROM sup) ON e2 = doc_id"
PROBE = """pr AS (SELECT r.qid, e.event_id, min(r.rank) AS cand_rank FROM rk r JOIN ev c ON c.event_id = r.doc_id JOIN ev e ON e.user_id = c.user_id AND e.k = c.k AND e.ts > c.ts
  WHERE r.rank <= 20 AND NOT EXISTS (SELECT 1 FROM rk z WHERE z.qid = r.qid AND z.rank <= 20 AND z.doc_id = e.event_id) GROUP BY r.qid, e.event_id)"""


def _probe_sql(keep: bool) -> str:
    return f"""WITH {ED}, {PROBE}, pp AS (SELECT qid, event_id AS doc_id, CASE WHEN e1 IS NOT NULL AND e2 IS NULL THEN 1 ELSE 2 END AS tier, cand_rank * 1000000 + event_id AS "at" FROM (SELECT *, event_id AS doc_id FROM pr) {KNOWN}),
f AS (SELECT * FROM pp {"" if keep else "WHERE tier = 1"}),
c AS (SELECT qid, doc_id, CASE WHEN rank > 20 THEN 6 WHEN e1 IS NULL THEN 4 WHEN e2 IS NOT NULL THEN 5 ELSE 3 END AS tier, rank AS "at" FROM rk {KNOWN} WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.qid = rk.qid AND f.doc_id = rk.doc_id))
SELECT qid, doc_id, tier, row_number() OVER (PARTITION BY qid ORDER BY tier, "at", doc_id) AS rank FROM (SELECT * FROM f UNION ALL SELECT * FROM c)"""


PRI = """ans AS (SELECT q.qid, coalesce(CASE b[1] WHEN 0 THEN 'bought' WHEN 1 THEN 'joined' WHEN 2 THEN 'clicked' ELSE b[2] END, '__no_active_events__') AS answer FROM (SELECT DISTINCT qid FROM rk) q LEFT JOIN (
  SELECT qid, min((CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, event_type)) AS b FROM rk JOIN ev ON event_id = doc_id WHERE rank <= 5 AND doc_id NOT IN (SELECT event_id FROM sup) GROUP BY qid) USING (qid))"""


def _tca_sql(mode: str) -> str:
    pairs = "SELECT target_id, max((trigger_ts, trigger_id))[2] AS trigger_id FROM ed GROUP BY target_id" if mode == "strict" else "SELECT * FROM p"
    return f"""WITH RECURSIVE {ED}, {PRI}, r5 AS (SELECT qid, doc_id FROM rk WHERE rank <= 5), pairs AS ({pairs}),
hit AS (SELECT r.qid, target_id, max((h.doc_id IS NOT NULL)::INT) AS got FROM r5 r JOIN pairs ON target_id = r.doc_id LEFT JOIN r5 h ON h.qid = r.qid AND h.doc_id = trigger_id GROUP BY ALL),
per AS (SELECT qid, count(*) FILTER (got = 0) AS n_missing, count(*) AS n_superseded FROM hit GROUP BY qid),
gd AS (SELECT qid, count(*) AS n_gold, count(*) FILTER (rank <= 5) AS n_hit FROM rk WHERE rank % 2 = 1 AND rank <= 10 GROUP BY qid),
pv AS (SELECT qid, count(*) AS n_prov, count(*) FILTER (rank <= 5) AS n_ph FROM rk WHERE rank IN (1, 8) GROUP BY qid),
tca AS (SELECT qid, round(n_hit / n_gold, 6) AS recall, round(n_hit / 5, 6) AS "precision", answer = (CASE WHEN qid % 2 = 0 THEN 'bought' ELSE 'joined' END) AS answer_correct, coalesce(n_missing, 0) = 0 AS no_ignored_supersession,
  (answer = (CASE WHEN qid % 2 = 0 THEN 'bought' ELSE 'joined' END) AND coalesce(n_missing, 0) = 0)::DOUBLE AS tca, coalesce(n_superseded, 0) AS n_superseded, round(n_ph / n_prov, 6) AS provenance_recall
  FROM ans LEFT JOIN gd USING (qid) LEFT JOIN per USING (qid) LEFT JOIN pv USING (qid))"""


KAPPA = f"{CL}, ka AS (SELECT qid, n_scope, n_closure, round(n_scope / n_closure, 6) AS kappa, round(least(1.0, n_closure / n_scope), 6) AS phi FROM (SELECT user_id AS qid, count(*) AS n_scope FROM ev GROUP BY 1) JOIN (SELECT qid, count(*) AS n_closure FROM cl GROUP BY qid) USING (qid))"
REC = "SELECT conv_id * 1000 + turn AS doc_id, role AS record_type, turn AS ts, conv_id, text FROM conversations"
S1 = f"rec AS ({REC}), {bm25_ctes(docs=REC, qs='SELECT conv_id AS qid, arg_min(text, turn) AS query FROM conversations WHERE role = ' + chr(39) + 'user' + chr(39) + ' GROUP BY conv_id')}"


def _two(k1: int, tail: str) -> str:
    return f"""WITH {S1}, fr AS (SELECT r.qid, g.doc_id, min(r.rank) AS "at" FROM r JOIN rec a ON a.doc_id = r.doc_id AND a.record_type = 'user' JOIN rec g ON g.conv_id = a.conv_id AND g.record_type = 'assistant' WHERE r.rank <= {k1} GROUP BY r.qid, g.doc_id),
ev AS (SELECT qid, doc_id, 0 AS tier, "at" FROM fr UNION ALL SELECT qid, doc_id, 1, rank FROM r WHERE {tail} AND NOT EXISTS (SELECT 1 FROM fr WHERE fr.qid = r.qid AND fr.doc_id = r.doc_id)),
two AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY tier, "at", doc_id) AS rank, tier FROM ev)"""


def _own_sql(kind: str, pick: str, name: str) -> str:
    return f"{name} AS (SELECT o.qid, coalesce(rank, (SELECT count(*) FROM rec) + 1) AS rank FROM (SELECT conv_id AS qid, {pick}(doc_id) AS doc_id FROM rec WHERE record_type = '{kind}' GROUP BY conv_id) o LEFT JOIN r ON r.qid = o.qid AND r.doc_id = o.doc_id)"


_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"
QUERIES = {
    "supersession_edges": (supersession_edges, f"WITH {ED} SELECT trigger_id, target_id, rule_id FROM ed"),
    "superseded_events": (superseded_events, f"WITH {ED} SELECT event_id FROM sup"),
    "active_events": (active_events, f"WITH {ED} SELECT event_id, event_type, user_id FROM ev WHERE event_id NOT IN (SELECT event_id FROM sup)"),
    "superseding_chain": (superseding_chain, CH + " SELECT event_id, depth, trigger_id, rule_id FROM ch"),
    "validity_certificate": (validity_certificate, CH + " SELECT e.event_id, c.chain IS NULL AS valid, CASE WHEN c.chain IS NULL THEN 'no_superseding_event_found' ELSE 'superseded' END AS reason, coalesce(c.chain, '') AS chain FROM ev e LEFT JOIN (SELECT event_id, string_agg(trigger_id || ':' || rule_id, '>' ORDER BY depth) AS chain FROM ch GROUP BY event_id) c USING (event_id)"),
    "authority_closure": (authority_closure, f"WITH RECURSIVE {ED}, {CL} SELECT * FROM cl"),
    "active_frontier": (active_frontier, f"WITH RECURSIVE {ED}, {CL}, {FRONT} SELECT * FROM fr"),
    "frontier_of_retrieved": (frontier_of_retrieved, f"WITH RECURSIVE {ED}, {REACH}, cl AS (SELECT qid, doc_id AS event_id FROM rk WHERE rank <= 20), {FRONT} SELECT * FROM fr"),
    "closure_violations": (closure_violations, f"WITH {ED} SELECT qid, count(*) AS n_violations, count(DISTINCT target_id) AS n_targets FROM anc JOIN p ON p.target_id = anc.event_id WHERE NOT EXISTS (SELECT 1 FROM anc z WHERE z.qid = anc.qid AND z.event_id = p.trigger_id) GROUP BY qid"),
    "scope_ambiguity": (scope_ambiguity, f"WITH RECURSIVE {ED}, {KAPPA} SELECT * FROM ka"),
    "divergence": (divergence, f"WITH RECURSIVE {ED}, {CL}, {FRONT}, sc AS (SELECT user_id AS qid, event_id, round(value, 6) AS score FROM ev), fb AS (SELECT qid, max(score) AS fb FROM sc JOIN fr USING (qid, event_id) GROUP BY qid) SELECT qid, round(max(score) - max(fb), 6) AS delta, count(*) FILTER (score > fb) AS n_above FROM sc JOIN fb USING (qid) GROUP BY qid"),
    "correctness_audit": (
        correctness_audit,
        f"WITH RECURSIVE {ED}, {CL}, {FRONT}, r20 AS (SELECT qid, doc_id AS event_id FROM rk WHERE rank <= 20), a AS (SELECT DISTINCT qid FROM fr WHERE NOT EXISTS (SELECT 1 FROM r20 WHERE r20.qid = fr.qid AND r20.event_id = fr.event_id)), "
        "b AS (SELECT DISTINCT qid FROM r20 WHERE event_id IN (SELECT event_id FROM sup) AND NOT EXISTS (SELECT 1 FROM p JOIN r20 z ON z.event_id = p.trigger_id WHERE p.target_id = r20.event_id AND z.qid = r20.qid)) "
        "SELECT qid, a.qid IS NULL AS frontier_in, b.qid IS NULL AS superseded_ok, (a.qid IS NULL AND b.qid IS NULL)::BIGINT AS tca FROM (SELECT DISTINCT qid FROM anc) LEFT JOIN a USING (qid) LEFT JOIN b USING (qid)",
    ),
    "probable_closure": (probable_closure, f"WITH RECURSIVE {ED}, pq AS (SELECT DISTINCT trigger_id, target_id FROM ed WHERE (trigger_id + target_id) % 10 >= 5), tc(trigger_id, target_id) AS (SELECT * FROM pq UNION SELECT pq.trigger_id, tc.target_id FROM tc JOIN pq ON tc.trigger_id = pq.target_id) SELECT qid, event_id FROM anc UNION SELECT qid, tc.trigger_id FROM anc JOIN tc ON tc.target_id = anc.event_id"),
    "safe_frontier": (safe_frontier, f"WITH {ED}, s AS (SELECT qid, doc_id AS event_id FROM rk WHERE rank <= 20), i AS (SELECT s.qid, s.event_id, sum(ln(1 - (trigger_id + target_id) % 10 / 10)) AS l FROM s JOIN p ON p.target_id = s.event_id JOIN s z ON z.qid = s.qid AND z.event_id = p.trigger_id GROUP BY ALL) SELECT * FROM (SELECT qid, event_id, round(exp(coalesce(l, 0)), 6) AS p_maximal FROM s LEFT JOIN i USING (qid, event_id)) WHERE p_maximal >= 0.2"),
    "multi_authority": (multi_authority, f"WITH RECURSIVE {ED}, {CL} SELECT * FROM cl WHERE NOT EXISTS (SELECT 1 FROM p JOIN cl z ON z.event_id = p.trigger_id WHERE p.target_id = cl.event_id AND z.qid = cl.qid)"),
    "latest_per_scope": (latest_per_scope, "SELECT o_custkey, o_orderkey AS doc_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1"),
    "next_superseder": (next_superseder, f"WITH {EV} SELECT event_id, coalesce(first_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS next_id FROM ev"),
    "rssg_edges": (rssg_edges, f"WITH {ED} SELECT a.qid, trigger_id, target_id, rule_id FROM ed JOIN rk a ON a.doc_id = trigger_id AND a.rank <= 20 JOIN rk b ON b.doc_id = target_id AND b.rank <= 20 AND a.qid = b.qid"),
    "anchor_probe": (anchor_probe, f"WITH {ED}, {PROBE} SELECT * FROM pr"),
    "proactive_probe": (proactive_probe, f"WITH {ED} SELECT * FROM (SELECT user_id AS qid, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS \"at\" FROM ev WHERE NOT EXISTS (SELECT 1 FROM rk WHERE rk.qid = ev.user_id AND rk.rank <= 20 AND rk.doc_id = ev.event_id)) WHERE \"at\" <= 10"),
    "audit_rerank": (
        audit_rerank,
        f"WITH {ED}, called AS (SELECT DISTINCT qid, m[2] AS doc_id FROM rk JOIN fe ON fe.target_id = doc_id WHERE rank <= 20), t AS (SELECT rk.qid, rk.doc_id, rank AS r0, CASE WHEN rank <= 20 AND e2 IS NULL THEN 1 WHEN rank > 20 AND c.doc_id IS NOT NULL THEN 2 WHEN rank <= 20 THEN 3 ELSE 4 END AS tier FROM rk LEFT JOIN (SELECT event_id AS e2 FROM sup) ON e2 = rk.doc_id LEFT JOIN called c ON c.qid = rk.qid AND c.doc_id = rk.doc_id) "
        "SELECT qid, doc_id, tier, row_number() OVER (PARTITION BY qid ORDER BY tier, r0) AS rank FROM t",
    ),
    "probe_rerank": (probe_rerank, _probe_sql(True)),
    "probe_rerank_plain": (probe_rerank_plain, _probe_sql(False)),
    "derive_answer": (
        derive_answer,
        f"WITH {ED}, a AS (SELECT qid, {_KIND_SQL} AS t FROM rk JOIN ev ON event_id = doc_id WHERE rank <= 5 AND (qid % 2 = 1 OR (user_id = qid AND k = 1)) AND doc_id NOT IN (SELECT event_id FROM sup)), "
        "f AS (SELECT qid, bool_or(t = 'emergency_exception') AS e, bool_or(t = 'blackout_announced') AS b, bool_or(t = 'pre_clearance_approved') AS c, bool_or(t = 'blackout_lifted') AS l FROM a GROUP BY qid) "
        "SELECT qid, CASE WHEN e THEN 'compliant' WHEN b THEN 'non_compliant' WHEN c THEN 'active' WHEN l THEN 'non_compliant' ELSE 'requires_review' END AS answer FROM (SELECT DISTINCT qid FROM rk) LEFT JOIN f USING (qid)",
    ),
    "derive_answer_by_priority": (derive_answer_by_priority, f"WITH {ED}, {PRI} SELECT * FROM ans"),
    "tca_strict": (tca_strict, _tca_sql("strict") + " SELECT * FROM tca"),
    "tca_any": (tca_any, _tca_sql("any") + " SELECT * FROM tca"),
    "tca_rollup": (tca_rollup, _tca_sql("strict") + " SELECT coalesce(h, 'all') AS hop_type, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(tca), 6) AS tca, round(avg(answer_correct::INT), 6) AS accuracy, round(avg(no_ignored_supersession::INT), 6) AS compliance FROM (SELECT *, 'T' || (qid % 4) AS h FROM tca) GROUP BY ROLLUP (h)"),
    "kappa_groups": (kappa_groups, _tca_sql("any") + f", {KAPPA} SELECT round(kappa)::BIGINT AS kappa, count(*) AS n, round(avg(recall), 6) AS r_anchor, round(avg(tca), 6) AS tca, round(least(1.0, 1 / round(kappa)) * avg(recall), 6) AS bound, round(avg(tca), 6) <= round(least(1.0, 1 / round(kappa)) * avg(recall), 6) + 0.005 AS held FROM ka JOIN tca USING (qid) GROUP BY round(kappa)"),
    "kappa_correlation": (kappa_correlation, _tca_sql("any") + f", {KAPPA} SELECT round(corr(kappa, n_superseded), 6) AS r FROM ka JOIN tca USING (qid)"),
    "two_stage": (two_stage, _two(5, "true") + " SELECT * FROM two WHERE rank <= 20"),
    "two_stage_bounded": (two_stage_bounded, _two(10, "r.rank <= 30") + " SELECT * FROM two"),
    "two_stage_latest": (
        two_stage_latest,
        f"WITH {S1}, la AS (SELECT conv_id, arg_max(doc_id, (ts, -doc_id)) AS doc_id FROM rec GROUP BY conv_id), fr AS (SELECT r.qid, la.doc_id, min(rank) AS \"at\" FROM r JOIN rec a USING (doc_id) JOIN la USING (conv_id) WHERE rank <= 5 GROUP BY r.qid, la.doc_id), "
        "ev AS (SELECT qid, doc_id, 0 AS tier, \"at\" FROM fr UNION ALL SELECT qid, doc_id, 1, rank FROM r WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.qid = r.qid AND fr.doc_id = r.doc_id)) SELECT * FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY tier, \"at\", doc_id) AS rank, tier FROM ev) WHERE rank <= 20",
    ),
    "two_stage_truncated": (two_stage_truncated, _two(20, "r.rank <= 20") + " SELECT * FROM two WHERE rank <= 5"),
    "entity_index_last": (entity_index_last, "SELECT conv_id::VARCHAR AS conv_id, max(conv_id * 1000 + turn) AS doc_id FROM conversations WHERE role = 'assistant' GROUP BY conv_id"),
    "analytic_rank": (analytic_rank, f"WITH {S1}, {_own_sql('user', 'min', 'a')}, {_own_sql('assistant', 'max', 'b')} SELECT qid, CASE WHEN a.rank <= 3 THEN a.rank ELSE b.rank END AS rank FROM a JOIN b USING (qid)"),
    "error_categories": (error_categories, f"WITH {S1}, {_own_sql('user', 'max', 'a')}, {_own_sql('assistant', 'max', 'b')} SELECT CASE WHEN b.rank <= 5 THEN 'success' WHEN a.rank > 5 THEN 'stage1_miss' ELSE 'stage2_miss' END AS category, count(*) AS n FROM a JOIN b USING (qid) GROUP BY 1"),
    "two_stage_identity": (
        two_stage_identity,
        _two(5, "true") + ", an AS (SELECT DISTINCT r.qid FROM r JOIN rec USING (doc_id) WHERE r.rank <= 5 AND conv_id = r.qid AND record_type = 'user' AND r.qid IN (SELECT conv_id FROM rec WHERE record_type = 'assistant')), "
        "hit AS (SELECT DISTINCT two.qid FROM two JOIN rec USING (doc_id) WHERE tier = 0 AND conv_id = two.qid) "
        "SELECT coalesce(bool_and(hit.qid IS NOT NULL), true) AS all_pass, count(*) FILTER (hit.qid IS NULL) AS n_failed FROM an LEFT JOIN hit USING (qid)",
    ),
}
