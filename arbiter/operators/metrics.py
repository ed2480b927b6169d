"""Answers and evaluation: TCA, recall, ranks, rollups, categories and bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.functions import scores

D = 6


def derive_answer(retrieved: DataFrame, events: DataFrame, superseded: DataFrame, k: int = 5, queries: DataFrame | None = None, scope: list[str] = ()) -> DataFrame:
    """``qid, answer``: an exception makes compliant, a blackout or watchlist entry non-compliant, a clearance
    active, a lift non-compliant, else review. With ``queries`` that have all scope values, only events of it count."""
    top = retrieved.where(F.col("rank") <= k).join(events.withColumnRenamed("event_id", "doc_id"), "doc_id")
    base = retrieved.select("qid").distinct()
    if queries is not None:
        q = queries.select("qid", *(F.col(c).alias(f"q_{c}") for c in scope))
        top = top.join(q, "qid")
        has, same = F.lit(True), F.lit(True)
        for c in scope:
            has, same = has & F.col(f"q_{c}").isNotNull(), same & (F.col(c) == F.col(f"q_{c}"))
        top = top.where(~has | F.coalesce(same, F.lit(False)))
    act = top.join(superseded.select(F.col("event_id").alias("doc_id")), "doc_id", "left_anti")
    any_of = lambda *types: F.coalesce(F.bool_or(F.col("event_type").isin(list(types))), F.lit(False))
    flags = act.groupBy("qid").agg(any_of("emergency_exception").alias("exc"), any_of("blackout_announced", "watchlist_added").alias("blk"), any_of("pre_clearance_approved").alias("clr"), any_of("blackout_lifted").alias("lift"))
    answer = F.when(F.col("exc"), "compliant").when(F.col("blk"), "non_compliant").when(F.col("clr"), "active").when(F.col("lift"), "non_compliant").otherwise("requires_review")
    return base.join(flags, "qid", "left").select("qid", answer.alias("answer"))


def derive_answer_by_priority(retrieved: DataFrame, events: DataFrame, superseded: DataFrame, priority: list[tuple[str, str]], k: int = 5) -> DataFrame:
    """``qid, answer``: of the active types among the top ``k`` the first in ``priority`` (type, answer), else the
    least other type; ``__no_active_events__`` if there are none."""
    top = retrieved.where(F.col("rank") <= k).join(events.withColumnRenamed("event_id", "doc_id"), "doc_id")
    act = top.join(superseded.select(F.col("event_id").alias("doc_id")), "doc_id", "left_anti")
    place, label = F.lit(len(priority)), F.col("event_type")
    for at, (kind, answer) in reversed(list(enumerate(priority))):
        place, label = F.when(F.col("event_type") == kind, at).otherwise(place), F.when(F.col("event_type") == kind, answer).otherwise(label)
    best = act.groupBy("qid").agg(F.min(F.struct(place.alias("p"), label.alias("answer"))).alias("b"))
    return retrieved.select("qid").distinct().join(best, "qid", "left").select("qid", F.coalesce("b.answer", F.lit("__no_active_events__")).alias("answer"))


def compute_tca(retrieved: DataFrame, gold: DataFrame, e: DataFrame, answers: DataFrame, k: int = 5, mode: str = "strict", provenance: DataFrame | None = None) -> DataFrame:
    """Per question: recall, precision, answer_correct, no_ignored_supersession, tca, provenance_recall.

    ``retrieved(qid, doc_id, rank)``, ``gold(qid, doc_id)``, ``answers(qid, predicted, expected)``. ``strict``
    wants the last trigger of each retrieved target to be retrieved, ``any`` wants any.
    """
    r = retrieved.where(F.col("rank") <= k).select("qid", "doc_id").distinct()
    key = F.struct("trigger_ts", "trigger_id")
    pairs = e.groupBy("target_id").agg(F.max(key)["trigger_id"].alias("trigger_id")) if mode == "strict" else e.select("target_id", "trigger_id").distinct()
    have = r.select("qid", F.col("doc_id").alias("trigger_id"), F.lit(1).alias("got"))
    hit = r.join(pairs, F.col("doc_id") == F.col("target_id")).join(have, ["qid", "trigger_id"], "left")
    per = hit.groupBy("qid", "target_id").agg(F.max("got").alias("got")).groupBy("qid").agg(F.count(F.when(F.col("got").isNull(), 1)).alias("n_missing"), F.count("*").alias("n_superseded"))
    mark = r.withColumn("got", F.lit(1))

    def share(of: DataFrame, n: str, h: str) -> DataFrame:
        return of.select("qid", "doc_id").distinct().join(mark, ["qid", "doc_id"], "left").groupBy("qid").agg(F.count("*").alias(n), F.count("got").alias(h))

    out = answers.join(share(gold, "n_gold", "n_hit"), "qid", "left").join(per, "qid", "left")
    if provenance is not None:
        out = out.join(share(provenance, "n_prov", "n_prov_hit"), "qid", "left")
    hits, n_gold = F.coalesce("n_hit", F.lit(0)), F.greatest(F.coalesce("n_gold", F.lit(0)), F.lit(1))
    right = F.coalesce(F.lower(F.trim("predicted")) == F.lower(F.trim("expected")), F.lit(False))
    clean = F.coalesce("n_missing", F.lit(0)) == 0
    return out.select(
        "qid", F.round(hits / n_gold, D).alias("recall"), F.round(hits / F.lit(max(k, 1)), D).alias("precision"), right.alias("answer_correct"), clean.alias("no_ignored_supersession"), (right & clean).cast("double").alias("tca"), F.coalesce("n_superseded", F.lit(0)).cast("long").alias("n_superseded"),
        (F.round(F.coalesce("n_prov_hit", F.lit(0)) / F.greatest(F.coalesce("n_prov", F.lit(0)), F.lit(1)), D) if provenance is not None else F.lit(None).cast("double")).alias("provenance_recall"),
    )


def tca_rollup(results: DataFrame, by: str = "hop_type") -> DataFrame:
    """Overall (``all``) and per ``by``: n, recall, tca, accuracy, compliance."""
    g = results.rollup(by).agg(F.count("*").alias("n"), F.round(F.avg("recall"), D).alias("recall"), F.round(F.avg("tca"), D).alias("tca"), F.round(F.avg(F.col("answer_correct").cast("double")), D).alias("accuracy"), F.round(F.avg(F.col("no_ignored_supersession").cast("double")), D).alias("compliance"), F.grouping(by).alias("g"))
    return g.select(F.when(F.col("g") == 1, "all").otherwise(F.col(by)).alias(by), "n", "recall", "tca", "accuracy", "compliance")


def rank_metrics(ranks: DataFrame, by: list[str] = (), ks: tuple[int, ...] = (5,)) -> DataFrame:
    """n, TCA@k, mean rank, MRR over ``rank``; rows with a null rank (no gold) don't count."""
    r = ranks.where("rank IS NOT NULL")
    aggs = [F.count("*").alias("n"), *(F.round(F.avg((F.col("rank") <= k).cast("double")), D).alias(f"tca_at_{k}") for k in ks), F.round(F.avg("rank"), D).alias("mean_rank"), F.round(F.avg(1 / F.col("rank")), D).alias("mrr")]
    return (r.groupBy(*by) if by else r.groupBy()).agg(*aggs)


def rank_medians(ranks: DataFrame, by: list[str] = ()) -> DataFrame:
    """Upper and true median; the sorted ranks of a group are counted, not collected, so groups may be of any size."""
    r = ranks.where("rank IS NOT NULL")
    counts = r.groupBy(*by, "rank").agg(F.count("*").alias("c"))
    from pyspark.sql import Window as W

    part = W.partitionBy(*by) if by else W.partitionBy()
    n, upto = F.sum("c").over(part), F.sum("c").over(part.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    c = counts.select(*by, "rank", "c", n.alias("n"), upto.alias("upto"))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("rank")))
    upper, lower = at(F.floor(F.col("n") / 2)), at(F.floor((F.col("n") - 1) / 2))
    return c.groupBy(*by).agg(F.max("n").alias("n"), upper.cast("long").alias("upper_median"), ((upper + lower) / 2).alias("median"))


def recall_at(ranks: DataFrame, ks: list[int], by: list[str] = ()) -> DataFrame:
    return (ranks.groupBy(*by) if by else ranks.groupBy()).agg(*(F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), D).alias(f"recall_at_{k}") for k in ks))


def error_categories(outcomes: DataFrame) -> DataFrame:
    """Counts of success, stage1_miss (anchor not found) and stage2_miss, from ``anchor_found`` and ``hit``."""
    kind = F.when(F.col("hit"), "success").when(~F.col("anchor_found"), "stage1_miss").otherwise("stage2_miss")
    return outcomes.groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


def kappa_groups(rows: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Per ``kappa``: n, means of ``r_anchor`` and ``tca``, the bound phi * r_anchor, and whether it held."""
    g = rows.groupBy("kappa").agg(F.count("*").alias("n"), F.avg("r_anchor").alias("r"), F.avg("tca").alias("t"))
    bound = F.least(F.lit(1.0), 1 / F.col("kappa")) * F.col("r")
    return g.select("kappa", "n", F.round("r", D).alias("r_anchor"), F.round("t", D).alias("tca"), F.round(bound, D).alias("bound"), (F.round(F.col("t"), D) <= F.round(bound, D) + tolerance).alias("held"))


def rate_interval(rows: DataFrame, flag: str, by: list[str] = ()) -> DataFrame:
    """Hits, trials, rate and the Wilson interval of a boolean column."""
    g = (rows.groupBy(*by) if by else rows.groupBy()).agg(F.count(F.when(F.col(flag), 1)).alias("hits"), F.count(flag).alias("n"))
    w = scores.wilson(F.col("hits"), F.col("n"))
    return g.select(*by, "hits", "n", F.round(F.col("hits") / F.col("n"), D).alias("rate"), F.round(w["low"], D).alias("low"), F.round(w["high"], D).alias("high"))


def all_pass(checks: DataFrame) -> DataFrame:
    """``name, passed`` to whether all passed, and how many didn't."""
    return checks.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_pass"), F.count(F.when(~F.col("passed"), 1)).alias("n_failed"))
