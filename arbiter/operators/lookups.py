"""Lookups by entities in a question's own words, and runs of whole evaluations as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbiter.functions import text as T
from arbiter.operators import metrics, patterns, relevance


def known_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """``qid, name``: the longest of the known ``names(name)``, of equals the first, that stands in ``queries(qid, query)``; case is ignored.

    All names are sought at once. Questions without a known name have no row.
    """
    texts = queries.select("qid", F.lower("query").alias("text"))
    found = patterns.occurrences(texts, names.select(F.lower("name").alias("pattern")), longest=True)
    best = F.min(F.struct((-F.length("pattern")).alias("n"), F.col("pattern").alias("name")))
    return found.groupBy("qid").agg(best.alias("best")).select("qid", "best.name")


def probe_with_applicability(queries: DataFrame, index: DataFrame) -> DataFrame:
    """``qid, cve_id, product, applicable, doc_id``: what an index ``(product, cve_id, doc_id)`` has for a question.

    A question is applicable if it names an identifier and a known product; the last of several entries counts.
    """
    keyed = index.select(F.lower("product").alias("product"), F.upper("cve_id").alias("cve_id"), "doc_id").groupBy("product", "cve_id").agg(F.max("doc_id").alias("doc_id"))
    cve = T.cve_id("query")
    q = queries.select("qid", F.when(cve != "", cve).alias("cve_id"))
    q = q.join(known_names(queries, index.select(F.col("product").alias("name"))).withColumnRenamed("name", "product"), "qid", "left")
    return q.join(keyed, ["product", "cve_id"], "left").select("qid", "cve_id", "product", (F.col("cve_id").isNotNull() & F.col("product").isNotNull()).alias("applicable"), "doc_id")


def regex_probe(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``qid, doc_id, rank``: documents ``(doc_id, product, cve_id)`` of the product and identifier that the question's pattern gives, then all others by id.

    Both are matched with their case; a question without either keeps the corpus's order.
    """
    product = F.trim(F.regexp_extract("query", T.STILL_AFFECTED, 1))
    cve = F.regexp_extract("query", T.CVE, 0)
    both = (product != "") & (cve != "")
    q = queries.select("qid", F.when(both, product).alias("product"), F.when(both, cve).alias("cve_id"))
    return relevance.entity_probe(corpus, q, ["product", "cve_id"], k).select("qid", "doc_id", "rank")


def advisory_lookup(pairs: DataFrame, advisories: DataFrame) -> DataFrame:
    """``id, applicable, found, hit`` of questions ``(id, query, patch_text)`` against ``advisories(cve_id, fixed, summary, details)``.

    A question is applicable if it names an identifier. It hits if a fixed version of the advisory is among
    the patch text's versions, or one of those stands in the advisory's summary or details. Of several
    advisories of one identifier, one that hits is enough.
    """
    cve = T.cve_id("query")
    p = pairs.select("id", F.when(F.coalesce(cve, F.lit("")) != "", cve).alias("cve_id"), T.version_set(F.coalesce("patch_text", F.lit(""))).alias("gold"))
    a = advisories.where("cve_id IS NOT NULL").select(F.upper("cve_id").alias("cve_id"), F.coalesce("fixed", F.array().cast("array<string>")).alias("fixed"), F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("details", F.lit(""))).alias("words"), F.lit(True).alias("there"))
    hit = F.arrays_overlap("fixed", "gold") | F.exists("gold", lambda v: F.contains(F.col("words"), v))
    rows = p.join(a, "cve_id", "left").select("id", "cve_id", F.coalesce("there", F.lit(False)).alias("there"), F.coalesce(hit & F.col("there"), F.lit(False)).alias("hit"))
    return rows.groupBy("id").agg(F.bool_or(F.col("cve_id").isNotNull()).alias("applicable"), F.bool_or("there").alias("found"), F.bool_or("hit").alias("hit"))


def rates(results: DataFrame, flags: list[str], by: list[str] = ()) -> DataFrame:
    """n and the mean of each boolean column."""
    return (results.groupBy(*by) if by else results.groupBy()).agg(F.count("*").alias("n"), *(F.round(F.avg(F.coalesce(F.col(f), F.lit(False)).cast("double")), 6).alias(f"{f}_rate") for f in flags))


# -- whole evaluations ------------------------------------------------------------------------------------


def systems(rankings: dict[str, DataFrame]) -> DataFrame:
    """Rankings ``(qid, doc_id, rank)`` by name as one, whose ``qid`` is a pair of ``system`` and ``qid``."""
    out = None
    for name, r in rankings.items():
        part = r.select(F.struct(F.lit(name).alias("system"), "qid").alias("qid"), "doc_id", "rank")
        out = part if out is None else out.unionAll(part)
    return out


def run_eval(rankings: dict[str, DataFrame], gold: DataFrame, events: DataFrame, edges: DataFrame, superseded: DataFrame, expected: DataFrame, priority: list[tuple[str, str]], k: int = 5, mode: str = "strict") -> DataFrame:
    """TCA of every question under every system, ``system, qid, ...``: one plan, whatever the number of systems.

    ``gold(qid, doc_id)``, ``expected(qid, expected)``; the other arguments are those of ``derive_answer_by_priority`` and ``compute_tca``.
    """
    every = systems(rankings)
    names = F.explode(F.array(*(F.lit(n) for n in rankings))).alias("system")
    of_each = lambda df, *rest: df.select(names, "*").select(F.struct("system", "qid").alias("qid"), *rest)
    answers = metrics.derive_answer_by_priority(every, events, superseded, priority, k).select("qid", F.col("answer").alias("predicted"))
    answers = answers.join(of_each(expected, "expected"), "qid")
    out = metrics.compute_tca(every, of_each(gold, "doc_id"), edges, answers, k, mode)
    return out.select(F.col("qid.system").alias("system"), F.col("qid.qid").alias("qid"), *(c for c in out.columns if c != "qid"))


def scale_eval(rankings: dict[str, DataFrame], gold: DataFrame, anchors: DataFrame, k: int = 5) -> DataFrame:
    """Per model: n, and the shares of questions whose gold document and whose anchor are among the first ``k``."""
    top = systems(rankings).where(F.col("rank") <= k)
    names = F.explode(F.array(*(F.lit(n) for n in rankings))).alias("system")
    asked = gold.select("qid").distinct().select(names, "qid")
    seen = lambda df, name: top.join(df.select(F.col("qid").alias("own"), "doc_id"), "doc_id").where("qid.qid = own").select("qid.system", "own").distinct().select("system", F.col("own").alias("qid"), F.lit(True).alias(name))
    rows = asked.join(seen(gold, "tca"), ["system", "qid"], "left").join(seen(anchors, "anchor"), ["system", "qid"], "left")
    return rates(rows, ["tca", "anchor"], ["system"]).orderBy("system")


def promote_last(ranking: DataFrame, metas: DataFrame, k1: int) -> DataFrame:
    """Two stages over ``metas(doc_id, kind, product, cve_id)``: disclosures among the first ``k1`` bring the last patch of their product and identifier to the front."""
    key = [F.lower(F.trim("product")).alias("product"), F.upper(F.trim("cve_id")).alias("cve_id")]
    index = metas.where("kind = 'patch'").select(*key, "doc_id").groupBy("product", "cve_id").agg(F.max("doc_id").alias("patch"))
    anchors = metas.where("kind = 'disclosure'").select("doc_id", *key)
    front = ranking.where(F.col("rank") <= k1).join(anchors, "doc_id").join(index, ["product", "cve_id"]).groupBy("qid", F.col("patch").alias("doc_id")).agg(F.min("rank").alias("at"))
    rest = ranking.join(front.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").select("qid", "doc_id", F.lit(1).alias("tier"), F.col("rank").cast("long").alias("at"))
    both = front.select("qid", "doc_id", F.lit(0).alias("tier"), F.col("at").cast("long").alias("at")).unionAll(rest)
    return both.select("qid", "doc_id", F.row_number().over(W.partitionBy("qid").orderBy("tier", "at", "doc_id")).cast("long").alias("rank"), "tier")


def downstream(retrieved: DataFrame, answers: DataFrame) -> DataFrame:
    """Given answers ``(qid, response, gold)`` beside whether the right document was retrieved ``(qid, found)``: n, correct and confidently wrong ones per flag."""
    rows = retrieved.join(answers, "qid").select("found", T.evaluate_answer("response", "gold").alias("e"))
    count = lambda c: F.count(F.when(F.col(f"e.{c}"), 1)).alias(f"n_{c}")
    return rows.groupBy("found").agg(F.count("*").alias("n"), count("correct"), count("confident_wrong"))


def deltas(before: DataFrame, after: DataFrame, by: list[str], value: str) -> DataFrame:
    """What a value gained from one table to another, by key."""
    b, a = before.select(*by, F.col(value).alias("before")), after.select(*by, F.col(value).alias("after"))
    return b.join(a, by).select(*by, "before", "after", F.round(F.col("after") - F.col("before"), 6).alias("delta"))


def iso_time(text: Column | str, days: int = 0) -> Column:
    """ISO text as a timestamp, moved by days; null if it isn't one."""
    c = F.col(text) if isinstance(text, str) else text
    return F.try_to_timestamp(c) + F.make_dt_interval(F.lit(days))
