"""Registered queries of text functions, predicates and corpus building, over every row of their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.functions import text as T
from arbiter.operators import etl, metrics, synth
from arbiter.sources.io import table


def _part(spark, d) -> DataFrame:
    return table(spark, d, "part")


def regex_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of questions made from parts: an id, a product, and employee and ticker."""
    p = _part(spark, d)
    q = F.concat(F.lit("Is "), F.lower("p_name"), F.lit(" still affected by cve-2023-"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit("? Can EMP"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit("-x7 trade "), F.upper(F.substring(F.regexp_replace("p_type", "[^A-Za-z]", ""), 1, 4)), F.lit(" today"))
    s, e = T.security_entities(q), T.query_entities(q)
    f = T.finance_entities(q)
    return p.select("p_partkey", s["cve_id"].alias("cve_id"), s["product"].alias("product"), e["employee"].alias("employee"), e["ticker"].alias("ticker"), f["employee_id"].alias("finance_employee"), T.strip_cves(q).alias("stripped"))


_Q = "'Is ' || lower(p_name) || ' still affected by cve-2023-' || lpad(p_partkey::VARCHAR, 5, '0') || '? Can EMP' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '-x7 trade ' || upper(substring(regexp_replace(p_type, '[^A-Za-z]', '', 'g'), 1, 4)) || ' today'"
_COMMON = "[" + ", ".join(f"'{w}'" for w in T.COMMON_WORDS) + "]"
SQL_ENTITIES = f"""WITH q AS (SELECT p_partkey, {_Q} AS q FROM part)
SELECT p_partkey, upper(regexp_extract(q, '(?i)CVE-\\d{{4}}-\\d+')) AS cve_id, trim(regexp_extract(q, '(?i)Is (.+?) still affected', 1)) AS product, regexp_extract(q, '\\bEMP\\d{{3}}-\\w+\\b') AS employee,
  list_filter(regexp_extract_all(q, '\\b[A-Z]{{2,5}}\\b'), lambda w: NOT list_contains({_COMMON}, w))[1] AS ticker, upper(regexp_extract(q, '(?i)EMP\\d{{3}}-\\w+')) AS finance_employee, trim(regexp_replace(q, '(?i)CVE-\\d{{4}}-\\d+', '', 'g'), ' ,.') AS stripped FROM q"""


def version_sets(spark: SparkSession, d: str) -> DataFrame:
    p = _part(spark, d)
    t = F.concat(F.lit("fixed in "), (F.col("p_size") % 7).cast("string"), F.lit("."), (F.col("p_partkey") % 13).cast("string"), F.lit(".1 and "), (F.col("p_size") % 3).cast("string"), F.lit(".0-rc1, was 1.2"))
    return p.select("p_partkey", F.array_join(T.version_set(t), ",").alias("versions"))


def evaluate_answer(spark: SparkSession, d: str) -> DataFrame:
    p = _part(spark, d)
    r = F.concat(F.element_at(F.array(*(F.lit(x) for x in ANSWERS)), (F.col("p_partkey") % len(ANSWERS) + 1).cast("int")), F.lit(" in 1."), (F.col("p_size") % 4).cast("string"))
    v = T.evaluate_answer(r, F.concat(F.lit("Release 1."), (F.col("p_partkey") % 4).cast("string")))
    return p.select("p_partkey", v["correct"].alias("correct"), v["confident_wrong"].alias("confident_wrong"), v["is_patched_claim"].alias("patched"), v["is_unpatched_claim"].alias("unpatched"), v["version_overlap"].alias("overlap"))


ANSWERS = ["It was fixed", "No patch exists", "It has been patched", "It remains unmitigated", "We cannot say", "No known fix; upgrade", "See version 3"]
_ANS = "[" + ", ".join(f"'{a}'" for a in ANSWERS) + "]"
SQL_ANSWER = f"""WITH a AS (SELECT p_partkey, lower({_ANS}[p_partkey % {len(ANSWERS)} + 1] || ' in 1.' || (p_size % 4)) AS r, (p_size % 4) = (p_partkey % 4) AS o FROM part),
b AS (SELECT *, regexp_matches(r, '{"|".join(T.PATCHED_SIGNALS)}') AS y, regexp_matches(r, '{"|".join(T.UNPATCHED_SIGNALS)}') AS n FROM a)
SELECT p_partkey, y AND NOT n AND o AS correct, n AND NOT y AS confident_wrong, y AS patched, n AS unpatched, o AS overlap FROM b"""


def simulate_patch(spark: SparkSession, d: str) -> DataFrame:
    p = _part(spark, d)
    t = F.concat(F.lit("Attackers exploit a vulnerability in "), F.col("p_name"), F.lit(" before 1.2.x (CVE-2023-"), F.col("p_partkey").cast("string"), F.lit(", CWE-79). Malicious  injection reveals "), F.col("p_brand"))
    return p.select("p_partkey", T.simulate_patch_text(t, F.array("p_brand", "p_name")).alias("note"))


def _framed(column: str) -> str:
    for pattern in T.ID_PATTERNS:
        column = f"regexp_replace({column}, '(?i){pattern}', '', 'g')"
    for pattern, to in T.FRAMING:
        column = f"regexp_replace({column}, '(?i){pattern}', '{to}', 'g')"
    return column


SQL_PATCH = f"""WITH t AS (SELECT p_partkey, p_name, p_brand, 'Attackers exploit a vulnerability in ' || p_name || ' before 1.2.x (CVE-2023-' || p_partkey || ', CWE-79). Malicious  injection reveals ' || p_brand AS t FROM part),
f AS (SELECT *, {_framed("t")} AS f FROM t),
g AS (SELECT *, CASE WHEN length(p_name) >= length(p_brand) THEN replace(replace(f, p_name, 'the component'), p_brand, 'the component') ELSE replace(replace(f, p_brand, 'the component'), p_name, 'the component') END AS g FROM f)
SELECT p_partkey, 'Release notes — 3.x' || chr(10) || '{T.RELEASE_HEADER}' || trim(regexp_replace(regexp_replace(g, '(?i)\\b(before|prior to|versions?)\\s+[\\d.x]+', '', 'g'), '\\s{{2,}}', ' ', 'g')) AS note FROM g"""


def normalize_name(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d).select("p_partkey", T.normalize_name(F.concat("p_name", F.lit("  "), F.when(F.col("p_size") % 2 == 0, "Sodium").otherwise("HCl"))).alias("name"), T.slug_trimmed("p_type").alias("slug"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.html_text("html").alias("text"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    p = _part(spark, d)
    cell = F.concat(F.lit("Smith v. Jones, "), F.col("p_partkey").cast("string"), F.lit(" U.S. "), F.col("p_size").cast("string"), F.lit(" ("), (F.lit(1900) + F.col("p_size")).cast("string"), F.lit(") and 12 F.2d 34"))
    c = T.split_case_citation(cell)
    return p.select("p_partkey", c["case_name"].alias("case_name"), c["citation"].alias("citation"), T.us_citation(cell)["page"].alias("page"), T.citation_year(cell).alias("year"), F.array_join(T.citations(cell), "|").alias("cited"), T.legal_entities(cell)["case_slug"].alias("case_slug"))


_CELL = "'Smith v. Jones, ' || p_partkey || ' U.S. ' || p_size || ' (' || (1900 + p_size) || ') and 12 F.2d 34'"
SQL_CITE = f"""SELECT p_partkey, trim(regexp_extract({_CELL}, '^(.*?),\\s+\\d', 1)) AS case_name, regexp_extract({_CELL}, '(\\d+\\s+U\\.S\\.\\s+\\d+\\s+\\(\\d{{4}}\\))', 1) AS citation, regexp_extract({_CELL}, '(\\d+)\\s+U\\.S\\.\\s+(\\d+)', 2) AS page, regexp_extract({_CELL}, '\\((\\d{{4}})\\)', 1) AS year,
  array_to_string(regexp_extract_all({_CELL}, '\\d+ (?:U\\.S\\.|F\\.2d) \\d+'), '|') AS cited, substring(regexp_replace(lower(regexp_extract({_CELL}, '(?i)([A-Z][a-z]+(?:\\s+v\\.\\s+[A-Z][a-z]+)?),\\s+\\d+ [A-Z]\\.\\S+ \\d+')), '[^a-z0-9]+', '_', 'g'), 1, 60) AS case_slug FROM part"""


def release_urls(spark: SparkSession, d: str) -> DataFrame:
    p = _part(spark, d)
    own = F.replace("p_name", F.lit(" "), F.lit("-"))
    refs = F.array(F.lit("https://a.test/x"), F.concat(F.lit("https://github.com/own/"), own, F.lit("/releases/tag/v"), F.col("p_size").cast("string"), F.lit("?x=1#y")))
    u = T.parse_release_url(T.release_url(refs))
    name = T.product_name(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.lit(None).cast("string"), refs, F.lit("id"))
    return p.select("p_partkey", u["owner"].alias("owner"), u["repo"].alias("repo"), u["tag"].alias("tag"), name.alias("product"))


def query_styles(spark: SparkSession, d: str) -> DataFrame:
    p = _part(spark, d)
    v = T.query_variants("p_name", F.concat(F.lit("CVE-2023-"), F.lpad((F.col("p_partkey") + 90000).cast("string"), 7, "0")), F.lit(None).cast("string"), "p_partkey")
    return p.select("p_partkey", *(v[k].alias(k) for k in ("structured", "freeform", "entity_omit", "noisy", "partial_ent")))


def templates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    t = F.when(F.col("o_orderkey") % 2 == 0, "{emp} traded {ticker} on {date}.").otherwise("A {ticker} trade by {emp}, {cpty}, on {date}.")
    return o.select("o_orderkey", T.fill_template(t, emp=F.concat(F.lit("EMP"), F.col("o_custkey").cast("string")), ticker="o_orderstatus", cpty=F.lit(None).cast("string"), date=T.long_date("o_orderdate")).alias("text"))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("docs"))
    return c.select("conv_id", T.prompt(F.lit("Is it still valid?"), "docs", 200).alias("prompt"))


def phrase_vocab(spark: SparkSession, d: str) -> DataFrame:
    p = _part(spark, d)
    t = F.concat(F.element_at(F.array(*(F.lit(x) for x in RULINGS)), (F.col("p_partkey") % len(RULINGS) + 1).cast("int")), F.col("p_name"))
    v = T.check_vocab(t)
    return p.select("p_partkey", v["has_overruling_vocab"].alias("over"), v["has_query_vocab"].alias("query"), F.array_join(v["overruling_words_found"], ",").alias("words"))


RULINGS = ["Expressly overruled by ", "Is it still good law? ", "The court abrogated ", "Nothing about ", "Overruling "]
_RUL = "[" + ", ".join(f"'{r}'" for r in RULINGS) + "]"
_lst = lambda ws: "[" + ", ".join(f"'{w}'" for w in sorted(ws)) + "]"
SQL_PHRASE = f"""WITH t AS (SELECT p_partkey, lower({_RUL}[p_partkey % {len(RULINGS)} + 1] || p_name) AS t FROM part)
SELECT p_partkey, len(list_filter({_lst(T.OVERRULING_VOCAB)}, lambda w: contains(t, w))) > 0 AS "over", len(list_filter({_lst(T.QUERY_VOCAB)}, lambda w: contains(t, w))) > 0 AS "query", array_to_string(list_filter({_lst(T.OVERRULING_VOCAB)}, lambda w: contains(t, w)), ',') AS words FROM t"""


def ascii_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(T.is_english("text")).select("doc_id", "lang")


def quality_filters(spark: SparkSession, d: str) -> DataFrame:
    return etl.quality_filters(table(spark, d, "documents"), "text").select("doc_id")


def no_identifier(spark: SparkSession, d: str) -> DataFrame:
    return etl.without_identifier(table(spark, d, "documents").withColumn("ident", F.lit("THE ")), "text", "ident").select("doc_id")


def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return etl.first_per_key(table(spark, d, "lineitem"), ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_partkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


def pair_dedup(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_partkey") % 97).alias("a"), (F.col("l_suppkey") % 89).alias("b"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return etl.pair_dedup(li, "a", "b", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "b"]).select("a", "b", "l_orderkey")


def cap_per_key(spark: SparkSession, d: str) -> DataFrame:
    return etl.cap_per_key(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


def split_semi(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return etl.split_rows(table(spark, d, "documents"), ids, "doc_id").select("doc_id", "source")


def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    return etl.remaining(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id")


def non_gold_pairs(spark: SparkSession, d: str) -> DataFrame:
    return etl.non_gold_pairs(table(spark, d, "customer").select("c_nationkey", "c_mktsegment"), "c_nationkey", "c_mktsegment")


def latest_value(spark: SparkSession, d: str) -> DataFrame:
    return etl.latest_value(table(spark, d, "events"), "user_id", "event_type", "ts")


def corpus_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select("doc_id", "lang", F.length("text").cast("long").alias("n"))
    b = table(spark, d, "benchmark").select((-F.col("item_id") - 1).alias("doc_id"), F.length("text").cast("long").alias("n"))
    return etl.build_corpus(a, b)


def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    q = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.when(F.col("doc_id") % 200 == 0, F.col("lang")).alias("lang"), "source")
    return etl.scoped(docs, q, ["lang", "source"], need_all=False)


def scope_filter_all(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    q = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.when(F.col("doc_id") % 200 == 0, F.col("lang")).alias("lang"), "source")
    return etl.scoped_counts(docs, q, ["lang", "source"])


def descriptive_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    n = F.length("text")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"), F.round(F.avg(n), 6).alias("mean"), F.median(n).alias("median"), F.count_distinct("source").alias("n_sources"))


def group_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role", (F.col("turn") % 3).alias("hop")).agg(F.count("*").alias("n"))


def venn_sets(spark: SparkSession, d: str) -> DataFrame:
    """Customers with urgent orders, with open orders, with both and with only one."""
    o = table(spark, d, "orders")
    a, b = o.where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct(), o.where("o_orderstatus = 'O'").select("o_custkey").distinct()
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(a.intersect(b), "both").unionAll(count(a.subtract(b), "urgent")).unionAll(count(b.subtract(a), "open")).unionAll(count(a.union(b).distinct(), "any"))


def threshold_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_discount").alias("m"))
    return metrics.all_pass(rows.select(F.col("l_returnflag").alias("name"), (F.col("m") < 0.06).alias("passed")))


def kappa_corpus(spark: SparkSession, d: str) -> DataFrame:
    c = synth.kappa_corpus(table(spark, d, "supplier").select("s_suppkey"), 4)
    return c.select("s_suppkey", F.col("copy").cast("long").alias("copy"))


def _scenario_events(spark, d) -> DataFrame:
    """Scenarios of pairs of each customer and two parts."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return synth.scenario_events(synth.pairs_of(c, _part(spark, d).select(F.col("p_partkey").alias("id")), 2))


def scenario_events(spark: SparkSession, d: str) -> DataFrame:
    return _scenario_events(spark, d).select("event_id", "hop_type", "event_type", F.unix_timestamp("ts").alias("at"), "answer")


def scenario_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every scenario's graph, each example being a knowledge base of its own, and the answer that follows from it."""
    from arbiter.operators import graph
    from arbiter.plans.rules import COMPLIANCE, Rule

    own = [Rule(r.rule_id, r.trigger_type, r.target_type, ("example_id", *r.scope)) for r in COMPLIANCE]
    ev = _scenario_events(spark, d)
    gone = graph.superseded(ev.withColumn("counterparty", F.lit(None).cast("string")).withColumn("policy_id", F.lit(None).cast("string")), own)
    ranked = ev.select(F.col("example_id").alias("qid"), F.col("event_id").alias("doc_id"), F.lit(1).alias("rank"))
    return metrics.derive_answer(ranked, ev.select("event_id", "event_type"), gone, 5)


_NUMBER = lambda n, salt: f"((number + 1) * {7919 + 2 * salt}) % 100003 % {n}"
_KINDS = " ".join(f"WHEN {i} THEN {kinds!r}" for i, (kinds, _) in enumerate(synth.SCENARIOS.values()))
_ANSWERS = " ".join(f"WHEN {i} THEN '{a}'" for i, (_, a) in enumerate(synth.SCENARIOS.values()))
SQL_SCENARIOS = f"""n AS (SELECT count(*) AS n FROM part), y AS (SELECT c_custkey AS employee, (c_custkey * 7 + j) % n AS ticker, c_custkey * 2 + j AS number FROM customer, n, range(2) t(j)),
x AS (SELECT employee || '-' || ticker AS example_id, 'T' || ({_NUMBER(4, 13)}) AS hop_type, {_NUMBER(28, 11)} AS day, 1 + {_NUMBER(3, 12)} AS gap, CASE {_NUMBER(4, 13)} {_KINDS} END AS kinds, CASE {_NUMBER(4, 13)} {_ANSWERS} END AS answer FROM y)"""
QUERIES = {
    "regex_entities": (regex_entities, SQL_ENTITIES),
    "version_sets": (version_sets, "SELECT p_partkey, array_to_string(list_sort(list_distinct([(p_size % 7) || '.' || (p_partkey % 13) || '.1', (p_size % 3) || '.0-rc1', '1.2'])), ',') AS versions FROM part"),
    "evaluate_answer": (evaluate_answer, SQL_ANSWER),
    "simulate_patch": (simulate_patch, SQL_PATCH),
    "normalize_name": (normalize_name, f"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || '  ' || CASE WHEN p_size % 2 = 0 THEN 'Sodium' ELSE 'HCl' END), '\\s+({'|'.join(T.SALTS)})$', ''), '\\s+', ' ', 'g')) AS name, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part"),
    "html_text": (html_text, "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages"),
    "citations": (citations, SQL_CITE),
    "release_urls": (release_urls, "SELECT p_partkey, 'own' AS owner, replace(p_name, ' ', '-') AS repo, 'v' || p_size AS tag, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE replace(p_name, ' ', '-') END AS product FROM part"),
    "query_styles": (query_styles, "WITH t AS (SELECT p_partkey, p_name, 'CVE-2023-' || lpad((p_partkey + 90000)::VARCHAR, 7, '0') AS c, ('0x' || substr(md5(p_partkey::VARCHAR), 1, 7))::BIGINT % greatest(length(p_name) - 1, 1) AS at0 FROM part) SELECT p_partkey, 'Is ' || p_name || ' affected by ' || c || '?' AS structured, 'Is ' || p_name || ' still vulnerable to ' || c || '?' AS freeform, 'Is [PRODUCT] still vulnerable to ' || c || '?' AS entity_omit, 'Any fix available for vulnerability ' || right(c, 5) || '?' AS partial_ent, 'Is ' || CASE WHEN length(p_name) < 3 THEN p_name ELSE substr(p_name, 1, at0) || substr(p_name, at0 + 2, 1) || substr(p_name, at0 + 1, 1) || substr(p_name, at0 + 3) END || ' affected by ' || c || '?' AS noisy FROM t"),
    "templates": (templates, "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'EMP' || o_custkey || ' traded ' || o_orderstatus || ' on ' ELSE 'A ' || o_orderstatus || ' trade by EMP' || o_custkey || ', N/A, on ' END || strftime(o_orderdate, '%B %d, %Y') || '.' AS text FROM orders"),
    "prompts": (prompts, "SELECT conv_id, string_agg('[Document ' || i || ']' || chr(10) || substring(text, 1, 200), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) || chr(10) || chr(10) || 'Question: Is it still valid?' AS prompt FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) GROUP BY conv_id"),
    "phrase_vocab": (phrase_vocab, SQL_PHRASE),
    "ascii_filter": (ascii_filter, "SELECT doc_id, lang FROM documents WHERE length(text) > 0 AND length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / length(text) > 0.8"),
    "quality_filters": (quality_filters, "SELECT doc_id FROM documents WHERE length(trim(text)) >= 80 AND len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) >= 20 AND length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / length(text) > 0.8"),
    "no_identifier": (no_identifier, "SELECT doc_id FROM documents WHERE NOT contains(lower(text), 'the ')"),
    "dedup_first": (dedup_first, "SELECT l_partkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1"),
    "pair_dedup": (pair_dedup, "WITH p AS (SELECT l_partkey % 97 AS a, l_suppkey % 89 AS b, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), q AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM p WHERE a <> b), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, b) AS m FROM q WHERE n = 1) SELECT a, b, l_orderkey FROM r WHERE m = 1"),
    "cap_per_key": (cap_per_key, "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n <= 3"),
    "split_semi": (split_semi, "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "resume_anti": (resume_anti, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "non_gold_pairs": (non_gold_pairs, "WITH g AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) SELECT * FROM (SELECT DISTINCT c_nationkey FROM g), (SELECT DISTINCT c_mktsegment FROM g) EXCEPT SELECT * FROM g"),
    "latest_value": (latest_value, "SELECT user_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id"),
    "corpus_union": (corpus_union, "SELECT doc_id, lang, length(text) AS n FROM documents UNION ALL SELECT -item_id - 1, NULL, length(text) FROM benchmark"),
    "scope_filter": (scope_filter, "SELECT q.doc_id AS qid, d.doc_id FROM documents d JOIN documents q ON q.doc_id % 50 = 0 AND d.source = q.source AND (q.doc_id % 200 <> 0 OR d.lang = q.lang)"),
    "scope_filter_all": (scope_filter_all, "SELECT q.doc_id AS qid, count(*) AS n FROM documents d JOIN documents q ON q.doc_id % 50 = 0 AND (q.doc_id % 200 <> 0 OR (d.source = q.source AND d.lang = q.lang)) GROUP BY 1"),
    "descriptive_stats": (descriptive_stats, "SELECT lang, count(*) AS n, min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 6) AS mean, median(length(text)) AS median, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang"),
    "group_counts": (group_counts, "SELECT role, turn % 3 AS hop, count(*) AS n FROM conversations GROUP BY ALL"),
    "venn_sets": (venn_sets, "WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O') SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'urgent', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'open', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)"),
    "threshold_checks": (threshold_checks, "SELECT bool_and(m < 0.06) AS all_pass, count(*) FILTER (m >= 0.06) AS n_failed FROM (SELECT avg(l_discount) AS m FROM lineitem GROUP BY l_returnflag)"),
    "kappa_corpus": (kappa_corpus, "SELECT s_suppkey, unnest(range(0, 4)) AS copy FROM supplier"),
    "scenario_events": (
        scenario_events,
        f"WITH {SQL_SCENARIOS}, e AS (SELECT *, generate_subscripts(kinds, 1) - 1 AS pos, unnest(kinds) AS event_type FROM x) "
        "SELECT example_id || '-e' || pos AS event_id, hop_type, event_type, epoch(TIMESTAMP '2024-01-01 09:00:00')::BIGINT + 86400 * (day + pos * gap) AS at, answer FROM e",
    ),
    "scenario_answers": (scenario_answers, f"WITH {SQL_SCENARIOS} SELECT example_id AS qid, answer FROM x"),
}
