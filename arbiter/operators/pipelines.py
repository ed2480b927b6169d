"""Two-stage retrieval and re-ranking: what overrides the anchors found is put in front.

Records are ``doc_id, record_type, ts`` with scope columns; ``pos`` (the place in the corpus) is the id.
Rankings are ``qid, doc_id, rank``. Every output is a total order without repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbiter.functions import text as T
from arbiter.plans.adapters import Adapter


def normalised_keys(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records with keys lower-cased and trimmed as text; rows with an empty or null key are left out."""
    out = records
    for k in keys:
        out = out.withColumn(k, F.lower(F.trim(F.col(k).cast("string")))).where(F.col(k) != "")
    return out


def entity_index(records: DataFrame, keys: list[str]) -> DataFrame:
    """All records of each key (1 to n)."""
    return normalised_keys(records, keys).select(*keys, "doc_id")


def entity_index_last(records: DataFrame, keys: list[str], order: str = "doc_id") -> DataFrame:
    """One record of each key, the last in the corpus."""
    return normalised_keys(records, keys).groupBy(*keys).agg(F.max_by("doc_id", order).alias("doc_id"))


def latest_per_scope(records: DataFrame, keys: list[str]) -> DataFrame:
    """The latest record of each scope; of equally late ones the first in the corpus. A partially aggregated maximum."""
    return records.groupBy(*keys).agg(F.max_by(F.struct("doc_id", "ts"), F.struct("ts", -F.col("doc_id"))).alias("b")).select(*keys, "b.doc_id", "b.ts")


def promoted(stage1: DataFrame, records: DataFrame, adapter: Adapter) -> DataFrame:
    """``qid, doc_id, anchor_rank``: superseding records in the scope of a retrieved anchor, each at its best anchor."""
    keys = list(adapter.scope_keys)
    index = normalised_keys(records, keys)
    anchors = stage1.join(index.where(F.col("record_type") == adapter.anchor_type), "doc_id").select("qid", "rank", *keys)
    goals = index.where(F.col("record_type") == adapter.superseding_type).select(*keys, "doc_id")
    return anchors.join(goals, keys).groupBy("qid", "doc_id").agg(F.min("rank").alias("anchor_rank"))


def _tiers(front: DataFrame, ranking: DataFrame) -> DataFrame:
    """``front`` (qid, doc_id, at) first, then what else the ranking has in its order."""
    rest = ranking.join(front, ["qid", "doc_id"], "left_anti").select("qid", "doc_id", F.lit(1).alias("tier"), F.col("rank").cast("long").alias("at"))
    every = front.select("qid", "doc_id", F.lit(0).alias("tier"), F.col("at").cast("long").alias("at")).unionAll(rest)
    return every.select("qid", "doc_id", F.row_number().over(W.partitionBy("qid").orderBy("tier", "at", "doc_id")).cast("long").alias("rank"), "tier")


def two_stage(ranking: DataFrame, records: DataFrame, adapter: Adapter, k1: int = 20, extra: int | None = None) -> DataFrame:
    """Anchors among the top ``k1`` bring their superseding records to the front; all else keeps its order.

    ``extra`` bounds how much of the ranking follows.
    """
    front = promoted(ranking.where(F.col("rank") <= k1), records, adapter).withColumnRenamed("anchor_rank", "at")
    tail = ranking if extra is None else ranking.where(F.col("rank") <= extra)
    return _tiers(front, tail)


def routed(ranking: DataFrame, queries: DataFrame, records: DataFrame, adapter: Adapter, k1: int = 20) -> DataFrame:
    """Questions ``(qid, query)`` that name the domain's whole scope go to its superseding records at once, the others take two stages.

    A question's own entities are read by the adapter; the records they name come first, by id, whether or not the
    ranking has them or an anchor. A question that names no scope there is takes two stages too.
    """
    keys = list(adapter.scope_keys)
    if adapter.entities is None:
        return two_stage(ranking, records, adapter, k1)
    goals = normalised_keys(records.where(F.col("record_type") == adapter.superseding_type), keys)
    asked = normalised_keys(queries.select("qid", adapter.entities("query").alias("e")).select("qid", *(F.col(f"e.{k}").alias(k) for k in keys)), keys)
    named = asked.join(goals.select(*keys, "doc_id"), keys).select("qid", "doc_id").distinct()
    own = named.withColumn("at", F.lit(0))
    others = ranking.join(named.select("qid").distinct(), "qid", "left_anti")
    return _tiers(own, ranking.join(named.select("qid").distinct(), "qid", "left_semi")).unionAll(two_stage(others, records, adapter, k1))


def closest(anchors: DataFrame, bucket: DataFrame) -> DataFrame:
    """``qid, doc_id, overlap``: of each question's bucket ``(qid, doc_id, text)`` the record whose words are most like its anchor's ``(qid, text)``.

    Jaccard of the sets of words; of equals the first id. A partially aggregated maximum, however large a bucket is.
    """
    words = lambda c: F.array_distinct(T.tokens_w(c))
    a = anchors.select("qid", words("text").alias("a"))
    both = bucket.select("qid", "doc_id", words("text").alias("b")).join(a, "qid")
    union = F.greatest(F.size(F.array_union("a", "b")), F.lit(1))
    pairs = both.select("qid", "doc_id", (F.size(F.array_intersect("a", "b")) / union).alias("overlap"))
    best = pairs.groupBy("qid").agg(F.max(F.col("overlap")).alias("overlap"))
    return pairs.join(best, ["qid", "overlap"]).groupBy("qid").agg(F.min("doc_id").alias("doc_id"), F.round(F.first("overlap"), 6).alias("overlap"))


def two_stage_latest(ranking: DataFrame, records: DataFrame, keys: list[str], k1: int = 20) -> DataFrame:
    """Every one of the top ``k1`` brings the latest record of its scope to the front."""
    latest = latest_per_scope(records, keys).select(*keys, F.col("doc_id").alias("latest_id"))
    hits = ranking.where(F.col("rank") <= k1).join(records.select("doc_id", *keys), "doc_id").join(latest, keys)
    front = hits.groupBy("qid", F.col("latest_id").alias("doc_id")).agg(F.min("rank").alias("at"))
    return _tiers(front, ranking)


def two_stage_truncated(ranking: DataFrame, records: DataFrame, adapter: Adapter, k1: int = 20, k: int = 5) -> DataFrame:
    """As ``two_stage`` over the top ``k1`` only, cut at ``k``."""
    return two_stage(ranking.where(F.col("rank") <= k1), records, adapter, k1).where(F.col("rank") <= k)


def analytic_rank(anchor_rank: DataFrame, direct_rank: DataFrame, k1: int = 20, always_anchor: bool = False) -> DataFrame:
    """``qid, rank``: the anchor's rank if it is among the top ``k1``, else the direct rank."""
    both = anchor_rank.select("qid", F.col("rank").alias("a")).join(direct_rank.select("qid", F.col("rank").alias("d")), "qid")
    return both.select("qid", (F.col("a") if always_anchor else F.when(F.col("a") <= k1, F.col("a")).otherwise(F.col("d"))).alias("rank"))


# -- tiers over events -----------------------------------------------------------------------------------


def audit_rerank(ranking: DataFrame, superseded: DataFrame, first_trigger: DataFrame, k: int = 20) -> DataFrame:
    """Active candidates, then first triggers found beyond the top ``k``, then overridden candidates, then the rest.

    ``superseded(event_id)``, ``first_trigger(target_id, trigger_id)``; unknown events count as active.
    """
    gone = superseded.select(F.col("event_id").alias("doc_id"), F.lit(True).alias("gone"))
    r = ranking.join(gone, "doc_id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    top = r.where((F.col("rank") <= k) & F.col("gone")).select("qid", F.col("doc_id").alias("target_id"))
    called = top.join(first_trigger, "target_id").select("qid", F.col("trigger_id").alias("doc_id")).distinct().withColumn("called", F.lit(True))
    r = r.join(called, ["qid", "doc_id"], "left")
    tier = F.when((F.col("rank") <= k) & ~F.col("gone"), 1).when((F.col("rank") > k) & F.col("called").isNotNull(), 2).when(F.col("rank") <= k, 3).otherwise(4)
    r = r.withColumn("tier", tier)
    return r.select("qid", "doc_id", "tier", F.row_number().over(W.partitionBy("qid").orderBy("tier", "rank")).cast("long").alias("rank"))


def anchor_probe(ranking: DataFrame, events: DataFrame, scope: list[str], k: int = 20) -> DataFrame:
    """``qid, event_id, cand_rank``: later events in the scope of a candidate that aren't candidates, at their first candidate.

    A question's candidates in a scope, at most ``k``, are one row: their times and the best rank up to each. An
    event meets that row once, however many candidates come before it.
    """
    top = ranking.where(F.col("rank") <= k)
    cand = top.join(events.select(F.col("event_id").alias("doc_id"), "ts", *scope), "doc_id")
    steps = cand.groupBy("qid", *scope).agg(F.collect_list(F.struct("ts", "rank")).alias("steps"), F.min("ts").alias("first_ts"))
    found = steps.join(events.select("event_id", "ts", *scope), scope).where("ts > first_ts")
    before = F.filter("steps", lambda s: s["ts"] < F.col("ts"))
    found = found.select("qid", "event_id", F.array_min(F.transform(before, lambda s: s["rank"])).alias("cand_rank"))
    return found.join(top.select("qid", F.col("doc_id").alias("event_id")), ["qid", "event_id"], "left_anti")


def proactive_probe(ranking: DataFrame, queries: DataFrame, events: DataFrame, scope: list[str], k: int = 20) -> DataFrame:
    """``qid, event_id, at``: all events of the question's own scope that aren't candidates, latest first."""
    top = ranking.where(F.col("rank") <= k).select("qid", F.col("doc_id").alias("event_id"))
    mine = queries.select("qid", *scope).join(events.select("event_id", "ts", *scope), scope).join(top, ["qid", "event_id"], "left_anti")
    return mine.select("qid", "event_id", F.row_number().over(W.partitionBy("qid").orderBy(F.col("ts").desc(), "event_id")).cast("long").alias("at"))


def probe_rerank(ranking: DataFrame, probe: DataFrame, known: DataFrame, superseded: DataFrame, k: int = 20, keep_superseded: bool = True) -> DataFrame:
    """Promoted active events, promoted overridden ones, active, unknown and overridden candidates, then the tail.

    ``probe(qid, event_id, at)``; ``known(event_id)`` are the question's own knowledge base. Promoted ids that
    the tail has as well appear once. Without ``keep_superseded``, promoted ones that aren't active stay out of the front.
    """
    is_known = known.select(F.col("event_id").alias("doc_id"), F.lit(True).alias("known")).distinct()
    gone = superseded.select(F.col("event_id").alias("doc_id"), F.lit(True).alias("gone")).distinct()
    p = probe.select("qid", F.col("event_id").alias("doc_id"), F.col("at").cast("long").alias("at")).join(is_known, "doc_id", "left").join(gone, "doc_id", "left")
    fine = F.col("known").isNotNull() & F.col("gone").isNull()
    p = p.withColumn("tier", F.when(fine, 1).otherwise(2))
    if not keep_superseded:
        p = p.where("tier = 1")
    c = ranking.join(is_known, "doc_id", "left").join(gone, "doc_id", "left").join(p.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    tier = F.when(F.col("rank") > k, 6).when(F.col("known").isNull(), 4).when(F.col("gone").isNotNull(), 5).otherwise(3)
    c = c.select("qid", "doc_id", tier.alias("tier"), F.col("rank").cast("long").alias("at"))
    every = p.select("qid", "doc_id", "tier", "at").unionAll(c)
    return every.select("qid", "doc_id", "tier", F.row_number().over(W.partitionBy("qid").orderBy("tier", "at", "doc_id")).cast("long").alias("rank"))
