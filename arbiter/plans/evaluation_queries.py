"""Registered queries of lookups, whole evaluations and corpora with distractors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.operators import etl, lookups, metrics, relevance, synth
from arbiter.plans import adapters, graph_queries as G
from arbiter.plans.relevance_queries import bm25_ctes, corpus, questions, sql_tokens
from arbiter.sources.io import table


def okapi_top5(spark: SparkSession, d: str) -> DataFrame:
    return relevance.okapi_top(corpus(spark, d), questions(spark, d), 5).select("qid", "rank", "doc_id", "score")


def pairs(spark, d) -> DataFrame:
    """Each part as a product with an identifier, a disclosure and a patch note."""
    p = table(spark, d, "part")
    cve = F.concat(F.lit("CVE-2023-"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"))
    version = F.concat((F.col("p_size") % 7).cast("string"), F.lit("."), (F.col("p_partkey") % 13).cast("string"), F.lit(".1"))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("product"), cve.alias("cve_id"), F.concat(cve, F.lit(" affects "), "p_name").alias("disclosure_text"), F.concat(F.lit("Fixed in "), version).alias("patch_text"), version.alias("version"))


def numbered(p: DataFrame) -> DataFrame:
    """``pairs`` with an identifier of each part's own: the five places of the others are too few for keys over 99,999, which would share one."""
    digits = F.col("id").cast("string")
    return p.withColumn("cve_id", F.concat(F.lit("CVE-2023-"), F.lpad(digits, F.greatest(F.length(digits), F.lit(5)), F.lit("0"))))


def asked(spark, d, p: DataFrame | None = None) -> DataFrame:
    """Of every part a question: with both names, without the identifier, or with the product in capitals."""
    k = F.col("id") % 3
    q = F.when(k == 0, F.concat(F.lit("Is "), "product", F.lit(" still affected by "), "cve_id", F.lit("?"))).when(k == 1, F.concat(F.lit("Is "), "product", F.lit(" still affected?"))).otherwise(F.concat(F.upper("product"), F.lit(" has "), F.lower("cve_id")))
    return (p or pairs(spark, d)).select(F.col("id").alias("qid"), q.alias("query"))


def advisory_hits(spark: SparkSession, d: str) -> DataFrame:
    p = numbered(pairs(spark, d))
    fixed = F.when(F.col("id") % 2 == 0, F.array("version", F.lit("0.1"))).otherwise(F.array(F.lit("0.1")))
    summary = F.when(F.col("id") % 5 == 0, F.concat(F.lit("see "), "version")).otherwise(F.lit("none"))
    a = p.where("id % 4 <> 3").select("cve_id", fixed.alias("fixed"), summary.alias("summary"), F.lit(None).cast("string").alias("details"))
    return lookups.advisory_lookup(p.select("id", "patch_text").join(asked(spark, d, p).withColumnRenamed("qid", "id"), "id"), a)


def advisory_rates(spark: SparkSession, d: str) -> DataFrame:
    return lookups.rates(advisory_hits(spark, d), ["applicable", "found", "hit"])


def probe_applicable(spark: SparkSession, d: str) -> DataFrame:
    index = pairs(spark, d).select("product", "cve_id", F.col("id").alias("doc_id"))
    return lookups.probe_with_applicability(asked(spark, d), index).fillna({"cve_id": "", "product": "", "doc_id": -1})


def regex_probe_top3(spark: SparkSession, d: str) -> DataFrame:
    index = pairs(spark, d).select("product", "cve_id", F.col("id").alias("doc_id"))
    return lookups.regex_probe(index, asked(spark, d), 3)


def _rankings(spark, d) -> dict[str, DataFrame]:
    e = G.events(spark, d)
    by = lambda score: relevance.ranked(e.select(F.col("user_id").alias("qid"), F.col("event_id").alias("doc_id"), score.alias("score"))).select("qid", "doc_id", "rank")
    value = by(F.col("value"))
    return {"value": value, "latest": by(F.unix_micros(F.col("ts").cast("timestamp"))), "audit": G.audit_rerank(spark, d).select("qid", "doc_id", "rank")}


def run_eval(spark: SparkSession, d: str) -> DataFrame:
    ranks = _rankings(spark, d)
    gold = ranks["value"].where("rank % 2 = 1 AND rank <= 10").select("qid", "doc_id")
    want = ranks["value"].select("qid").distinct().select("qid", F.when(F.col("qid") % 2 == 0, "bought").otherwise(F.lit("joined")).alias("expected"))
    out = lookups.run_eval(ranks, gold, G.events(spark, d).select("event_id", "event_type"), G.edges(spark, d), G.superseded_events(spark, d), want, G.PRIORITY, mode="any")
    return out.select("system", "qid", "recall", "answer_correct", "no_ignored_supersession", "tca")


def run_eval_rollup(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tca_rollup(run_eval(spark, d), "system")


def scale_eval(spark: SparkSession, d: str) -> DataFrame:
    """Whole vectors and halves of them as two models; a question's own vector is the anchor, the next one the gold document."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    half = e.select("doc_id", F.slice("vector", 1, 8).alias("vector"))
    q = e.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "vector")
    near = lambda docs, qs: relevance.dense_top(docs, qs, 5)
    ranks = {"half": near(half, q.select("qid", F.slice("vector", 1, 8).alias("vector"))), "whole": near(e, q)}
    return lookups.scale_eval(ranks, q.select("qid", (F.col("qid") + 1).alias("doc_id")), q.select("qid", F.col("qid").alias("doc_id")))


def domain_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline that a domain's name makes, over the first 20 of each question."""
    run = adapters.make_pipeline(G.records(spark, d), "conversation", 5)
    return run(G.stage1(spark, d, 20)).where("rank <= 20")


def promoted_patches(spark: SparkSession, d: str) -> DataFrame:
    p = numbered(pairs(spark, d))
    metas = p.select((2 * F.col("id")).alias("doc_id"), F.lit("disclosure").alias("kind"), "product", "cve_id").unionAll(p.select((2 * F.col("id") + 1).alias("doc_id"), F.lit("patch"), F.concat(F.upper("product"), F.lit(" ")), F.lower("cve_id")))
    ranking = p.select(F.col("id").alias("qid"), F.explode(F.array(F.struct((2 * F.col("id")).alias("doc_id"), F.lit(2).alias("rank")), F.struct((2 * F.col("id") + 4).alias("doc_id"), F.lit(1).alias("rank")), F.struct((2 * F.col("id") + 1).alias("doc_id"), F.lit(3).alias("rank")))).alias("r")).select("qid", "r.*")
    return lookups.promote_last(ranking, metas, 2)


def security_corpus(spark: SparkSession, d: str) -> DataFrame:
    """A distractor for each number below 2,000 and for every supplier's key beside the parts' disclosures and patches."""
    keys = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"))
    return synth.security_corpus(pairs(spark, d), spark.range(2000).unionAll(keys).distinct())


def recall_corpus(spark: SparkSession, d: str) -> DataFrame:
    return synth.recall_corpus(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


def ruling_corpus(spark: SparkSession, d: str) -> DataFrame:
    return synth.ruling_corpus(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


def security_confounders(spark: SparkSession, d: str) -> DataFrame:
    return synth.confounders(pairs(spark, d), ["product", "cve_id"], 6, [["product"], ["cve_id"], []])


def legal_confounders(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("case_slug"), F.col("s_suppkey").alias("qid"))
    return synth.confounders(s, ["case_slug", "qid"], 4, [["case_slug"], ["qid"], []])


def merge_pairs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    return etl.merge_pairs(o.where("o_custkey % 2 = 0").distinct(), o, ["o_custkey", "o_orderstatus"])


def downstream(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    answer = F.when(F.col("id") % 3 == 0, F.concat(F.lit("It was fixed in "), "version")).when(F.col("id") % 3 == 1, F.lit("It is unpatched")).otherwise(F.lit("It was patched in 99.9"))
    return lookups.downstream(p.select(F.col("id").alias("qid"), (F.col("id") % 2 == 0).alias("found")), p.select(F.col("id").alias("qid"), answer.alias("response"), F.col("patch_text").alias("gold")))


def events_before(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups before the middle of the first month, with a day added to their times."""
    early = etl.events_before(etl.events_by_type(table(spark, d, "events"), "signup"), "2024-01-16 00:00:00")
    return early.select("event_id", F.unix_timestamp(lookups.iso_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), 1)).alias("moved"))


def rate_deltas(spark: SparkSession, d: str) -> DataFrame:
    """How mean discounts changed from early to late ship dates, by flag; rows are split by date."""
    li = table(spark, d, "lineitem")
    mean = lambda where: li.where(where).groupBy("l_returnflag").agg(F.round(F.avg("l_discount"), 6).alias("m"))
    return lookups.deltas(mean("l_shipdate < DATE'1996-01-01'"), mean("l_shipdate >= DATE'1996-01-01'"), ["l_returnflag"], "m")


# -- SQL ------------------------------------------------------------------------------------------------

_P = """p AS (SELECT p_partkey AS id, p_name AS product, 'CVE-2023-' || lpad(p_partkey::VARCHAR, 5, '0') AS cve_id, (p_size % 7) || '.' || (p_partkey % 13) || '.1' AS version, p_partkey % 3 AS k FROM part)"""
_A = f"""WITH {_P}, a AS (SELECT p.id, k <> 1 AS applicable, k <> 1 AND id % 4 <> 3 AS found, k <> 1 AND id % 4 <> 3 AND (id % 2 = 0 OR id % 5 = 0) AS hit FROM p)"""


def _mixed(values, at: str, salt: int) -> str:
    n = values if isinstance(values, int) else len(values)
    k = f"((({at}) + 1) * {7919 + 2 * salt}) % 100003 % {n}"
    return k if isinstance(values, int) else "[" + ", ".join(f"'{v}'" for v in values) + f"][({k}) + 1]"


_SLUG = lambda c: f"substring(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), 1, 60)"
_CITE = f"c_name || ', ' || ({_mixed(500, 'c_custkey', 9)} + 1) || ' U.S. ' || (c_custkey + 1)"
_EVAL = f"""WITH {G.ED}, called AS (SELECT DISTINCT qid, m[2] AS doc_id FROM rk JOIN fe ON fe.target_id = doc_id WHERE rank <= 20),
au AS (SELECT rk.qid, rk.doc_id, rank AS r0, CASE WHEN rank <= 20 AND e2 IS NULL THEN 1 WHEN rank > 20 AND c.doc_id IS NOT NULL THEN 2 WHEN rank <= 20 THEN 3 ELSE 4 END AS tier FROM rk LEFT JOIN (SELECT event_id AS e2 FROM sup) ON e2 = rk.doc_id LEFT JOIN called c ON c.qid = rk.qid AND c.doc_id = rk.doc_id),
sy AS (SELECT 'value' AS system, qid, doc_id, rank FROM rk UNION ALL SELECT 'latest', user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) FROM ev
  UNION ALL SELECT 'audit', qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY tier, r0) FROM au),
s5 AS (SELECT * FROM sy WHERE rank <= 5),
an AS (SELECT system, qid, min((CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, event_type)) AS b FROM s5 JOIN ev ON event_id = doc_id WHERE doc_id NOT IN (SELECT event_id FROM sup) GROUP BY ALL),
hit AS (SELECT r.system, r.qid, target_id, max((h.doc_id IS NOT NULL)::INT) AS got FROM s5 r JOIN p ON target_id = r.doc_id LEFT JOIN s5 h ON h.system = r.system AND h.qid = r.qid AND h.doc_id = trigger_id GROUP BY ALL),
per AS (SELECT system, qid, count(*) FILTER (got = 0) AS n_missing FROM hit GROUP BY ALL),
gd AS (SELECT y.system, rk.qid, count(*) AS n_gold, count(s5.doc_id) AS n_hit FROM rk, (SELECT DISTINCT system FROM sy) y LEFT JOIN s5 ON s5.system = y.system AND s5.qid = rk.qid AND s5.doc_id = rk.doc_id WHERE rk.rank % 2 = 1 AND rk.rank <= 10 GROUP BY ALL),
res AS (SELECT u.system, u.qid, round(n_hit / n_gold, 6) AS recall, coalesce(CASE b[1] WHEN 0 THEN 'bought' WHEN 1 THEN 'joined' WHEN 2 THEN 'clicked' ELSE b[2] END, '__no_active_events__') = (CASE WHEN u.qid % 2 = 0 THEN 'bought' ELSE 'joined' END) AS answer_correct,
  coalesce(n_missing, 0) = 0 AS no_ignored_supersession, (answer_correct AND no_ignored_supersession)::DOUBLE AS tca
  FROM (SELECT DISTINCT system, qid FROM sy) u LEFT JOIN gd USING (system, qid) LEFT JOIN an USING (system, qid) LEFT JOIN per USING (system, qid))"""
_NEAR = lambda n: f"SELECT q.vec_id AS qid, e.vec_id AS doc_id, round(list_sum(list_transform(list_zip(e.embedding[1:{n}], q.embedding[1:{n}]), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0"
QUERIES = {
    "okapi_top5": (
        okapi_top5,
        f"WITH {bm25_ctes()}, qd AS (SELECT qid, tok, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({sql_tokens('w', 'text')}) AS tok FROM benchmark) GROUP BY qid, tok), i0 AS (SELECT tok, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st), i AS (SELECT tok, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i0) ELSE idf END AS idf FROM i0), "
        "o AS (SELECT qid, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN i USING (tok) JOIN qd USING (tok), st GROUP BY qid, doc_id), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM o) SELECT qid, rank, doc_id, score FROM k WHERE rank <= 5",
    ),
    "advisory_hits": (advisory_hits, _A + " SELECT * FROM a"),
    "advisory_rates": (advisory_rates, _A + " SELECT count(*) AS n, round(avg(applicable::INT), 6) AS applicable_rate, round(avg(found::INT), 6) AS found_rate, round(avg(hit::INT), 6) AS hit_rate FROM a"),
    "probe_applicable": (
        probe_applicable,
        f"WITH {_P}, q AS (SELECT id AS qid, CASE k WHEN 0 THEN 'Is ' || product || ' still affected by ' || cve_id || '?' WHEN 1 THEN 'Is ' || product || ' still affected?' ELSE upper(product) || ' has ' || lower(cve_id) END AS query FROM p), n AS (SELECT DISTINCT lower(product) AS name FROM p), "
        "f AS (SELECT qid, arg_min(name, (-length(name), name)) AS product FROM q JOIN n ON contains(lower(query), name) GROUP BY qid), e AS (SELECT lower(product) AS product, cve_id, max(id) AS doc_id FROM p GROUP BY ALL), c AS (SELECT qid, nullif(upper(regexp_extract(query, '(?i)CVE-\\d{4}-\\d+')), '') AS cve_id FROM q) "
        "SELECT c.qid, coalesce(c.cve_id, '') AS cve_id, coalesce(f.product, '') AS product, c.cve_id IS NOT NULL AND f.product IS NOT NULL AS applicable, coalesce(e.doc_id, -1) AS doc_id FROM c LEFT JOIN f USING (qid) LEFT JOIN e ON e.product = f.product AND e.cve_id = c.cve_id",
    ),
    "regex_probe": (
        regex_probe_top3,
        f"WITH {_P} SELECT * FROM (SELECT q.id AS qid, d.id AS doc_id, row_number() OVER (PARTITION BY q.id ORDER BY (q.k = 0 AND d.product = q.product AND d.cve_id = q.cve_id) DESC, d.id) AS rank FROM p q, p d) WHERE rank <= 3",
    ),
    "run_eval": (run_eval, _EVAL + " SELECT * FROM res"),
    "run_eval_rollup": (run_eval_rollup, _EVAL + " SELECT coalesce(system, 'all') AS system, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(tca), 6) AS tca, round(avg(answer_correct::INT), 6) AS accuracy, round(avg(no_ignored_supersession::INT), 6) AS compliance FROM res GROUP BY ROLLUP (system)"),
    "scale_eval": (
        scale_eval,
        f"WITH s AS (SELECT 'half' AS system, * FROM ({_NEAR(8)}) UNION ALL SELECT 'whole', * FROM ({_NEAR(10000)})), k AS (SELECT *, row_number() OVER (PARTITION BY system, qid ORDER BY score DESC, doc_id) AS rank FROM s), t AS (SELECT system, qid, bool_or(doc_id = qid + 1) AS tca, bool_or(doc_id = qid) AS anchor FROM k WHERE rank <= 5 GROUP BY ALL) "
        "SELECT system, count(*) AS n, round(avg(tca::INT), 6) AS tca_rate, round(avg(anchor::INT), 6) AS anchor_rate FROM t GROUP BY system",
    ),
    "domain_pipeline": (domain_pipeline, G.QUERIES["two_stage"][1]),
    "promoted_patches": (promoted_patches, f"WITH {_P}, r AS (SELECT id AS qid, id AS x, 2 AS r FROM p UNION ALL SELECT id, id + 2, 1 FROM p), f AS (SELECT qid, 2 * x + 1 AS doc_id, r AS \"at\" FROM r WHERE x IN (SELECT id FROM p)), c AS (SELECT id AS qid, 2 * id AS doc_id, 2 AS \"at\" FROM p UNION ALL SELECT id, 2 * id + 4, 1 FROM p), e AS (SELECT qid, doc_id, 0 AS tier, \"at\" FROM f UNION ALL SELECT qid, doc_id, 1, \"at\" FROM c) SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY tier, \"at\", doc_id) AS rank, tier FROM e"),
    "security_corpus": (
        security_corpus,
        f"WITH {_P}, x AS (SELECT i, {_mixed(synth.PRODUCTS, 'i', 1)} AS product, 'CVE-2023-' || lpad((i + 90000)::VARCHAR, 7, '0') AS cve_id FROM (SELECT i FROM range(2000) t(i) UNION SELECT s_suppkey FROM supplier)) "
        "SELECT 3 * id AS doc_id, 'disclosure' AS kind, product, cve_id, cve_id || ' affects ' || product AS text FROM p UNION ALL SELECT 3 * id + 1, 'patch', product, cve_id, 'Fixed in ' || version FROM p "
        f"UNION ALL SELECT 3 * i + 2, 'distractor', product, cve_id, cve_id || ' was found in ' || product || ': it ' || {_mixed(synth.FLAWS, 'i', 2)} || '. Versions up to ' || ({_mixed(9, 'i', 3)}) || '.' || ({_mixed(10, 'i', 4)}) || ' have it, and there is no patch.' FROM x",
    ),
    "recall_corpus": (
        recall_corpus,
        f"SELECT p_partkey AS doc_id, p_name AS drug, CASE WHEN p_partkey % 2 = 0 THEN 'Lot ' || p_partkey || ' of ' || p_name || ' is recalled for ' || {_mixed(synth.REASONS, 'p_partkey', 6)} || '.' ELSE p_name || ' is taken ' || ({_mixed(3, 'p_partkey', 7)} + 1) || ' times a day.' END AS text FROM part",
    ),
    "ruling_corpus": (ruling_corpus, f"WITH c AS (SELECT c_custkey AS i, {_CITE} AS cite FROM customer) SELECT i AS doc_id, {_SLUG('cite')} AS case_slug, cite || ' is followed here, as in ' || {_mixed(synth.CASES, 'i', 10)} || '.' AS text FROM c"),
    "security_confounders": (security_confounders, f"WITH {_P} SELECT id, d, CASE WHEN d % 3 = 0 THEN product ELSE product || '-x' || d END AS product, CASE WHEN d % 3 = 1 THEN cve_id ELSE cve_id || '-x' || d END AS cve_id FROM p, range(6) t(d)"),
    "legal_confounders": (legal_confounders, "SELECT s_suppkey AS id, d, CASE WHEN d % 3 = 0 THEN s_name ELSE s_name || '-x' || d END AS case_slug, CASE WHEN d % 3 = 1 THEN s_suppkey::VARCHAR ELSE s_suppkey || '-x' || d END AS qid FROM supplier, range(4) t(d)"),
    "merge_pairs": (merge_pairs, "SELECT DISTINCT o_custkey, o_orderstatus FROM orders"),
    "downstream": (downstream, f"WITH {_P} SELECT id % 2 = 0 AS found, count(*) AS n, count(*) FILTER (k = 0) AS n_correct, count(*) FILTER (k = 1) AS n_confident_wrong FROM p GROUP BY 1"),
    "events_before": (events_before, "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT + 86400 AS moved FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-16 00:00:00'"),
    "rate_deltas": (rate_deltas, "WITH b AS (SELECT l_returnflag, round(avg(l_discount) FILTER (l_shipdate < DATE '1996-01-01'), 6) AS before, round(avg(l_discount) FILTER (l_shipdate >= DATE '1996-01-01'), 6) AS after FROM lineitem GROUP BY 1) SELECT *, round(after - before, 6) AS delta FROM b"),
}
