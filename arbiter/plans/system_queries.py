"""Registered queries of whole evaluations with every system, routing by entities, picks, samples and tables in pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.functions import text as T
from arbiter.operators import etl, evaluation, html_tables, metrics, pipelines, relevance, vocab
from arbiter.plans import adapters, evaluation_queries as E, graph_queries as G
from arbiter.plans.relevance_queries import OUT, bm25_ctes, corpus, sql_tokens
from arbiter.plans.rules import COMPLIANCE, EVENTS
from arbiter.sources.io import table


def _world(spark, d, events: DataFrame, questions: DataFrame, rules, keys) -> evaluation.World:
    """Each user is a question; two of three events are its own knowledge, and its gold ones are odd ranks by value."""
    e = G.events(spark, d)
    ranking = G.ranking(spark, d)
    gold = ranking.where("rank % 2 = 1 AND rank <= 10").select("qid", "doc_id", F.col("rank").alias("pos"))
    return evaluation.World(questions, events, e.where("event_id % 3 <> 0").select(F.col("user_id").alias("qid"), "event_id"), gold, ranking, rules, keys)


def compliance_world(spark, d) -> evaluation.World:
    """Users as employees and what they dealt in as tickers; a question's entities are read from its words."""
    employee = F.format_string("EMP%03d-u%d", F.col("user_id") % 1000, "user_id")
    ticker = lambda n: F.concat(F.lit("Q"), F.chr(F.lit(65) + n % 26))
    e = G.compliance_events(spark, d).select("event_id", "event_type", "ts", employee.alias("employee_id"), ticker(F.col("k")).alias("security_ticker"))
    e = e.withColumn("text", F.concat_ws(" ", "employee_id", "event_type"))
    asked = F.concat(F.lit("Is "), employee, F.lit("'s pre-clearance for "), ticker(F.col("user_id")), F.lit(" still valid?"))
    q = G.events(spark, d).select("user_id").distinct().select(F.col("user_id").alias("qid"), asked.alias("query"), F.when(F.col("user_id") % 2 == 0, "compliant").otherwise("non_compliant").alias("expected"))
    named = T.query_entities("query")
    q = q.select("qid", "query", named["employee"].alias("employee_id"), named["ticker"].alias("security_ticker"), "expected")
    keys = ("employee_id", "security_ticker")
    return _world(spark, d, e, q, [r for r in COMPLIANCE if set(r.scope) <= set(keys)], keys)


def domain_world(spark, d) -> evaluation.World:
    """The test events' own rules; entities are given with the questions, and half of them lack the second."""
    e = G.events(spark, d).select("event_id", "event_type", "ts", "user_id", "k", F.concat(F.lit("user"), F.col("user_id"), F.lit(" "), "event_type").alias("text"))
    q = e.select("user_id").distinct().select(F.col("user_id").alias("qid"), F.concat(F.lit("What holds for user"), "user_id", F.lit("?")).alias("query"), "user_id", F.when(F.col("user_id") % 2 == 0, F.col("user_id") % 100).alias("k"))
    q = q.withColumn("expected", F.when(F.col("qid") % 2 == 0, "bought").otherwise("joined"))
    return _world(spark, d, e, q, EVENTS, ("user_id", "k"))


COLUMNS = ["system", "qid", "recall", "answer_correct", "no_ignored_supersession", "tca"]


def systems_eval(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluate(compliance_world(spark, d)).select(COLUMNS)


def systems_rollup(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tca_rollup(systems_eval(spark, d), "system")


def domain_systems_eval(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluate(domain_world(spark, d), evaluation.DOMAIN_SYSTEMS, priority=G.PRIORITY, keep_superseded=False).select(COLUMNS)


def routed_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Questions that name product and identifier go to the patch at once."""
    p = E.numbered(E.pairs(spark, d))
    disclosed = p.select((2 * F.col("id")).alias("doc_id"), F.lit("cve_disclosed").alias("record_type"), "product", "cve_id")
    patches = p.select((2 * F.col("id") + 1).alias("doc_id"), F.lit("patch_released"), F.concat(F.upper("product"), F.lit(" ")), F.lower("cve_id"))
    places = [(2 * F.col("id") + 4, 1), (2 * F.col("id"), 2), (2 * F.col("id") + 1, 3)]
    ranking = p.select(F.col("id").alias("qid"), F.explode(F.array(*(F.struct(c.alias("doc_id"), F.lit(r).alias("rank")) for c, r in places))).alias("r")).select("qid", "r.*")
    return pipelines.routed(ranking, E.asked(spark, d, p), disclosed.unionAll(patches), adapters.SECURITY, 2)


def closest_pick(spark: SparkSession, d: str) -> DataFrame:
    """Of a conversation's answers the one whose words are most like the first question's."""
    first = G.conversation_questions(spark, d).select("qid", F.col("query").alias("text"))
    answers = G.records(spark, d).where("record_type = 'assistant'").select(F.col("conv_id").alias("qid"), "doc_id", "text")
    return pipelines.closest(first, answers)


def first_of_type(spark: SparkSession, d: str) -> DataFrame:
    """The first returned part of each order's lines."""
    line = F.struct(F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("event_type"), F.col("l_partkey").alias("event_id"))
    kb = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("kb"))
    return kb.select("l_orderkey", F.coalesce(etl.first_of_type("kb", "R")["event_id"], F.lit(-1)).cast("long").alias("event_id"))


def list_metrics(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), (F.col("l_suppkey") % 5).alias("doc_id"), F.col("l_linenumber").alias("rank"), "l_returnflag")
    return evaluation.list_metrics(li, li.where("l_returnflag = 'N'").select("qid", "doc_id"))


def bm25_appended(spark: SparkSession, d: str) -> DataFrame:
    """Every other question has a word that no document has; its ranking is filled up by id."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("zzqx"), "item_id")).alias("query"))
    return relevance.bm25(corpus(spark, d), q, 5, unmatched="append").select(OUT)


LANGUAGES = ("en", "de", "fr", "es")


def vocab_samples(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return vocab.venn_samples({n: docs.where(F.col("lang") == n) for n in LANGUAGES})


def table_columns(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as a page with a table, and the table's columns read back by their headers."""
    o = table(spark, d, "orders")
    row = F.concat(F.lit("<td>"), F.col("o_orderkey"), F.lit("</td><td><b>"), "o_orderstatus", F.lit("</b></td><td>x<table><tr><td>inner status</td></tr></table></td><td>"), F.col("o_orderdate").cast("date"), F.lit("</td>"))
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("html")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["html"]), "</tr><tr>")
    head = "<h1>Orders</h1><table><tr><th>Customer</th><th>Order&nbsp;key</th><th colspan=2>Status</th><th>Date <i>of order</i></th></tr><tr><td rowspan="
    html = F.concat(F.lit(head), F.size("rows"), F.lit(">"), F.col("o_custkey"), F.lit("</td>"), body, F.lit("</tr></table>"))
    pages = rows.select(F.col("o_custkey").alias("page_id"), html.alias("html"))
    wanted = {"customer": ("customer", None), "order_key": ("order", "date"), "status": ("status", "inner"), "date": ("date", None)}
    return html_tables.page_columns(pages, wanted).drop("table")


_PARTS = ", ".join(f"bool_or(part = '{n}') AS {n}" for n in LANGUAGES)
_FLAGS = ", ".join(LANGUAGES)
QUERIES = {
    # The three evaluations have no SQL of their own; tests hold them against a loop over questions.
    "systems_eval": (systems_eval, None),
    "systems_rollup": (systems_rollup, None),
    "domain_systems_eval": (domain_systems_eval, None),
    "routed_pipeline": (
        routed_pipeline,
        f"WITH {E._P}, r AS (SELECT id AS qid, id AS x, 2 AS r FROM p UNION ALL SELECT id, id + 2, 1 FROM p), f AS (SELECT qid, 2 * x + 1 AS doc_id, r AS \"at\" FROM r WHERE x IN (SELECT id FROM p) AND (qid % 3 <> 0 OR x = qid)), "
        "c AS (SELECT id AS qid, 2 * id AS doc_id, 2 AS \"at\" FROM p UNION ALL SELECT id, 2 * id + 4, 1 FROM p), e AS (SELECT qid, doc_id, 0 AS tier, \"at\" FROM f UNION ALL SELECT qid, doc_id, 1, \"at\" FROM c) "
        "SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY tier, \"at\", doc_id) AS rank, tier FROM e",
    ),
    "closest_pick": (
        closest_pick,
        f"WITH a AS (SELECT conv_id AS qid, list_distinct({sql_tokens('w', 'arg_min(text, turn)')}) AS a FROM conversations WHERE role = 'user' GROUP BY conv_id), "
        f"b AS (SELECT conv_id AS qid, conv_id * 1000 + turn AS doc_id, list_distinct({sql_tokens('w', 'text')}) AS b FROM conversations WHERE role = 'assistant'), "
        "o AS (SELECT qid, doc_id, len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1) AS overlap FROM a JOIN b USING (qid)), "
        "k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, doc_id) AS n FROM o) SELECT qid, doc_id, round(overlap, 6) AS overlap FROM k WHERE n = 1",
    ),
    "first_of_type": (first_of_type, "SELECT l_orderkey, coalesce(arg_min(l_partkey, (l_linenumber, l_partkey)) FILTER (l_returnflag = 'R'), -1)::BIGINT AS event_id FROM lineitem GROUP BY l_orderkey"),
    "list_metrics": (
        list_metrics,
        "WITH l AS (SELECT l_orderkey AS qid, l_suppkey % 5 AS doc_id, l_linenumber AS rank, l_returnflag = 'N' AS gold FROM lineitem), g AS (SELECT DISTINCT qid, doc_id, 1 AS is_gold FROM l WHERE gold), "
        "h AS (SELECT qid, count(*) FILTER (rank <= 5 AND is_gold = 1) AS hits, count(*) FILTER (gold) AS n FROM l LEFT JOIN g USING (qid, doc_id) GROUP BY qid) SELECT qid, hits, round(hits / greatest(n, 1), 6) AS recall, round(hits / 5, 6) AS \"precision\" FROM h",
    ),
    "bm25_appended": (
        bm25_appended,
        f"WITH {bm25_ctes(qs='SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN text ELSE ' + chr(39) + 'zzqx' + chr(39) + ' || item_id END AS query FROM benchmark')}, "
        "e AS (SELECT b.item_id AS qid, d.doc_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY b.item_id ORDER BY score IS NULL, score DESC, d.doc_id) AS rank FROM benchmark b CROSS JOIN documents d LEFT JOIN \"s\" s ON s.qid = b.item_id AND s.doc_id = d.doc_id) SELECT qid, rank, doc_id, score FROM e WHERE rank <= 5",
    ),
    "vocab_samples": (
        vocab_samples,
        f"WITH t AS (SELECT unnest({sql_tokens('l2', 'text')}) AS tok, lang AS part FROM documents WHERE lang IN {LANGUAGES}), f AS (SELECT tok, {_PARTS} FROM t GROUP BY tok), "
        f"k AS (SELECT *, row_number() OVER (PARTITION BY {_FLAGS} ORDER BY tok) AS place FROM f) SELECT * FROM k WHERE place <= 30",
    ),
    "table_columns": (table_columns, "SELECT o_custkey AS page_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS \"row\", o_custkey::VARCHAR AS customer, o_orderkey::VARCHAR AS order_key, o_orderstatus AS status, o_orderdate::DATE::VARCHAR AS date FROM orders"),
}
