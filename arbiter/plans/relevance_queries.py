"""Registered queries of ranking and evaluation: ``documents`` are the corpus, ``benchmark`` the questions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbiter.functions import text as T
from arbiter.operators import metrics, relevance, stored_index, vector_index, vocab
from arbiter.sources.io import table
from arbiter.sources.shared import shared_dir, stored


def corpus(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def questions(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def gold(spark, d) -> DataFrame:
    """Documents that contain a question's passage."""
    return relevance.containing(corpus(spark, d), questions(spark, d))


OUT = ["qid", "rank", "doc_id", "score"]

_W = "list_filter(string_split_regex(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '')"
TOKENS = {
    "w": _W,
    "a": f"list_filter({_W}, lambda t: regexp_matches(t, '^[a-z0-9]+$'))",
    "l2": f"list_filter({_W}, lambda t: regexp_matches(t, '^[a-z]{{{{2,}}}}$'))",
}


def sql_tokens(kind: str, column: str) -> str:
    return TOKENS[kind].format(column)


def bm25_ctes(kind: str = "w", dup: bool = False, prefix: str = "", docs: str = "SELECT doc_id, text FROM documents", qs: str = "SELECT item_id AS qid, text AS query FROM benchmark") -> str:
    p = prefix
    return f"""
{p}d AS (SELECT doc_id, {sql_tokens(kind, "text")} AS toks FROM ({docs})),
{p}st AS (SELECT count(*) AS n, coalesce(avg(len(toks)), 0) AS avgdl FROM {p}d),
{p}tf AS (SELECT doc_id, tok, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(toks) AS tok, len(toks) AS dl FROM {p}d) GROUP BY doc_id, tok),
{p}df AS (SELECT tok, count(*) AS df FROM {p}tf GROUP BY tok),
{p}q AS (SELECT qid, tok, {"count(*)" if dup else "1"} AS qtf FROM (SELECT qid, unnest({sql_tokens(kind, "query")}) AS tok FROM ({qs})) GROUP BY qid, tok),
"{p}s" AS (
  SELECT qid, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {p}tf JOIN {p}df USING (tok) JOIN {p}q USING (tok), {p}st GROUP BY qid, doc_id),
{p}r AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM "{p}s")"""


GOLD_SQL = "gold AS (SELECT item_id AS qid, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"
TFIDF_SQL = f"""
td AS (SELECT doc_id, {sql_tokens("a", "text")} AS toks FROM documents),
ttf AS (SELECT doc_id, tok, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(toks) AS tok, len(toks) AS dl FROM td) GROUP BY doc_id, tok),
tdf AS (SELECT tok, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM ttf GROUP BY tok),
tv AS (SELECT doc_id, tok, tf / dl * idf AS w FROM ttf JOIN tdf USING (tok)),
tn AS (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM tv GROUP BY doc_id),
tq0 AS (SELECT item_id AS qid, unnest({sql_tokens("a", "text")}) AS tok FROM benchmark),
tq AS (SELECT qid, tok, count(*) / any_value(ql) * any_value(idf) AS qw FROM (SELECT qid, tok, count(*) OVER (PARTITION BY qid) AS ql FROM tq0) JOIN tdf USING (tok) GROUP BY qid, tok),
tqn AS (SELECT qid, sqrt(sum(qw * qw)) AS qn FROM tq GROUP BY qid),
ts AS (SELECT qid, doc_id, round(d / (dn * qn + 1e-12), 6) AS score FROM (SELECT qid, doc_id, sum(w * qw) AS d FROM tv JOIN tq USING (tok) GROUP BY qid, doc_id) JOIN tn USING (doc_id) JOIN tqn USING (qid)),
tr AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM ts)"""


def bm25_top5(spark: SparkSession, d: str) -> DataFrame:
    return relevance.bm25(corpus(spark, d), questions(spark, d), 5).select(OUT)


def bm25_list_terms(spark: SparkSession, d: str) -> DataFrame:
    return relevance.bm25(corpus(spark, d), questions(spark, d), 5, tokenizer="a", dup_terms=True).select(OUT)


def bm25_tie_desc(spark: SparkSession, d: str) -> DataFrame:
    return relevance.bm25(corpus(spark, d), questions(spark, d), 10, tie="desc").select(OUT)


def bm25_l2_top5(spark: SparkSession, d: str) -> DataFrame:
    return relevance.bm25(corpus(spark, d), questions(spark, d), 5, tokenizer="l2").select(OUT)


def bm25_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = gold(spark, d).join(questions(spark, d), "qid")
    return relevance.bm25_pairs(pairs, corpus(spark, d))


def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return relevance.term_stats(corpus(spark, d), "l2")


def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    s = relevance.collection_stats(corpus(spark, d))
    return s.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def tfidf_top5(spark: SparkSession, d: str) -> DataFrame:
    return relevance.tfidf_top(corpus(spark, d), questions(spark, d), 5).select(OUT)


def dense_top5(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = e.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "vector")
    return relevance.dense_top(e, q, 5).select(OUT)


def _own_folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def vector_index_top5(spark: SparkSession, d: str) -> DataFrame:
    """As ``dense_top5``, from an index: questions meet only lists that a bound can't rule out."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    index = vector_index.build(e, _own_folder(spark, "vectors"))
    q = e.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "vector")
    return vector_index.search(index, q, 5).select(OUT)


def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the five nearest of every question the index finds with as many lists as 0.95 of its trials take."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    index = vector_index.build(e, _own_folder(spark, "vectors"))
    probes, _ = vector_index.probes_for(index, 5, 0.95)
    q = e.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "vector")
    exact = vector_index.search(index, q, 5).select("qid", "doc_id")
    found = vector_index.search(index, q, 5, probes).select("qid", "doc_id", F.lit(1).alias("hit"))
    rate = exact.join(found, ["qid", "doc_id"], "left").agg(F.count("*").alias("n"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
    return rate.select("n", "recall", F.lit(probes).alias("probes"), F.lit(len(index.lists.centres)).alias("lists"))


def stored_index_top5(spark: SparkSession, d: str) -> DataFrame:
    """As ``bm25_top5``, from a stored index that half of the documents are added to later."""
    path, docs = _own_folder(spark, "postings"), corpus(spark, d)
    stored_index.add(docs.where("doc_id % 2 = 0"), path)
    stored_index.add(docs.where("doc_id % 2 <> 0 OR doc_id IS NULL"), path)
    return stored_index.search(spark, path, questions(spark, d), 5).select(OUT)


def hyde_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Whether the nearest other vector shares the label, split by a flag of the question."""
    t = table(spark, d, "embeddings")
    e = t.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    # Every vector is a question and travels to each list that isn't ruled out, so lists are few and long.
    index = vector_index.build(e, _own_folder(spark, "vectors"), 16)
    # The first two of a question are itself and another, or two others that are as near.
    found = vector_index.search(index, e.select(F.col("doc_id").alias("qid"), "vector"), 2).where("qid <> doc_id")
    near = found.groupBy("qid").agg(F.min_by("doc_id", "rank").alias("doc_id"))
    lab = t.select("vec_id", "label")
    j = near.join(lab.select(F.col("vec_id").alias("qid"), F.col("label").alias("ql")), "qid").join(lab.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    return j.groupBy((F.col("qid") % 2 == 0).alias("flag")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("ql") == F.col("label")).cast("double")), 6).alias("tca"))


def oracle_rank_top10(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d).withColumn("pos", F.col("doc_id"))
    return relevance.oracle_rank(corpus(spark, d), g, 10)


def entity_probe_exact(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    q = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "lang", "source")
    return relevance.exact_matches(docs, q, ["lang", "source"])


def entity_probe_top10(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    q = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "lang", "source")
    return relevance.entity_probe(docs, q, ["lang", "source"], 10).select("qid", "doc_id", "rank")


def pool_union(spark: SparkSession, d: str) -> DataFrame:
    return relevance.pooled(corpus(spark, d), questions(spark, d), 20)


def pool_rerank(spark: SparkSession, d: str) -> DataFrame:
    return relevance.pooled(corpus(spark, d), questions(spark, d), 20, 5).select("qid", "doc_id", "rank")


def gold_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Questions without a gold document have no row, so no document is scored for them."""
    n, g = corpus(spark, d).count(), stored(gold(spark, d), "gold")
    asked = questions(spark, d).join(g.select("qid").distinct(), "qid", "left_semi")
    return relevance.rank_by_count(relevance.bm25_scores(corpus(spark, d), asked), g, n)


def rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rank_metrics(gold_ranks(spark, d), ks=(5, 10, 20))


def rank_medians(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rank_medians(gold_ranks(spark, d))


def recall_at_ks(spark: SparkSession, d: str) -> DataFrame:
    return metrics.recall_at(gold_ranks(spark, d), [1, 5, 10])


def wilson_ci(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rate_interval(gold_ranks(spark, d).withColumn("hit", F.col("rank") <= 5), "hit")


def labels_wilson(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return metrics.rate_interval(rows.withColumn("good", F.col("quality") == 1), "good", ["lang"])


def _thirds(spark, d) -> DataFrame:
    """``id, query, disclosure, patch``: the thirds of every document's words; no word is cut or left out."""
    # A column of its own, as a text is split once then, not at each use.
    split = table(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), r"\s+").alias("w"))
    w, n = F.col("w"), F.size("w")
    a, b = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
    part = lambda lo, hi: F.array_join(F.slice(w, lo + 1, hi - lo), " ")
    return split.select(F.col("doc_id").alias("id"), part(F.lit(0), a).alias("query"), part(a, b).alias("disclosure"), part(b, n).alias("patch"))


def jaccard_gap(spark: SparkSession, d: str) -> DataFrame:
    return vocab.jaccard_gap(_thirds(spark, d))


def jaccard_summary(spark: SparkSession, d: str) -> DataFrame:
    return vocab.summarize(jaccard_gap(spark, d))


def bm25_gap(spark: SparkSession, d: str) -> DataFrame:
    t = _thirds(spark, d)
    q = t.select(F.col("id").alias("qid"), "query", F.col("id").alias("doc_id"))
    wanted = relevance.pair_words(q)
    one = lambda c: relevance.bm25_pairs(q.drop("query"), t.select(F.col("id").alias("doc_id"), F.col(c).alias("text")), wanted=wanted)
    return vocab.bm25_gap(one("disclosure"), one("patch"))


def vocab_venn(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return vocab.venn({"en": docs.where("lang = 'en'"), "fr": docs.where("lang = 'fr'"), "benchmark": table(spark, d, "benchmark")})


def content_words(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("doc_id", F.size(T.content_words("text")).cast("long").alias("n_content"), F.size(T.token_set("text")).cast("long").alias("n_distinct"), F.size(T.tokens_l2_stop("text")).cast("long").alias("n_plain"))


def _top(k, ctes, name):
    return f"WITH {ctes} SELECT qid, rank, doc_id, score FROM {name} WHERE rank <= {k}"


_PAIRS_Q = "SELECT item_id AS qid, text AS query FROM benchmark WHERE item_id IN (SELECT b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"
_RANKS = f"WITH {bm25_ctes()}, {GOLD_SQL}, g AS (SELECT qid, doc_id, coalesce(rank, (SELECT count(*) FROM documents) + 1) AS rank FROM gold LEFT JOIN r USING (qid, doc_id))"
_POOL = f"""WITH {bm25_ctes()}, {TFIDF_SQL},
every AS (SELECT qid, doc_id, 0 AS pool, rank FROM r WHERE rank <= 20 UNION ALL SELECT qid, doc_id, 1, rank FROM tr WHERE rank <= 20),
pool AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY min((pool, rank)), doc_id) AS rank FROM every GROUP BY qid, doc_id)"""
_DENSE = """WITH s AS (SELECT q.vec_id AS qid, e.vec_id AS doc_id, q.label AS ql, e.label, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS score FROM embeddings e, embeddings q WHERE {})"""
_THIRDS = """w AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\s+') AS w FROM documents),
th AS (SELECT doc_id, array_to_string(w[1:len(w) // 3], ' ') AS query, array_to_string(w[len(w) // 3 + 1:2 * len(w) // 3], ' ') AS disclosure, array_to_string(w[2 * len(w) // 3 + 1:], ' ') AS patch FROM w)"""
_JAC = f"""WITH {_THIRDS}, t AS (SELECT doc_id AS id, list_distinct({sql_tokens("l2", "query")}) AS q, list_distinct({sql_tokens("l2", "disclosure")}) AS d, list_distinct({sql_tokens("l2", "patch")}) AS p FROM th),
j AS (SELECT id, round(CASE WHEN len(q) = 0 OR len(d) = 0 THEN 0 ELSE len(list_intersect(q, d)) / len(list_distinct(list_concat(q, d))) END, 6) AS q_disclosure,
  round(CASE WHEN len(q) = 0 OR len(p) = 0 THEN 0 ELSE len(list_intersect(q, p)) / len(list_distinct(list_concat(q, p))) END, 6) AS q_patch FROM t)"""
# Scores of a question's own document alone.
_OWN = lambda p, side: bm25_ctes("l2", prefix=p, docs=f"SELECT doc_id, {side} AS text FROM th", qs="SELECT doc_id AS qid, query FROM th").replace(f"JOIN {p}q USING (tok)", f"JOIN {p}q ON {p}q.tok = {p}tf.tok AND qid = doc_id")
_WILSON = "round(hits / n, 6) AS rate, round((hits / n + 1.9208 / n - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS low, round((hits / n + 1.9208 / n + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS high"


def _in(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


QUERIES = {
    "bm25_top5": (bm25_top5, _top(5, bm25_ctes(), "r")),
    "stored_index_top5": (stored_index_top5, _top(5, bm25_ctes(), "r")),
    "vector_index_top5": (vector_index_top5, _DENSE.format("q.vec_id % 50 = 0") + ", k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) SELECT qid, rank, doc_id, score FROM k WHERE rank <= 5"),
    # What lists find of all there is has no SQL; tests hold it against brute force.
    "vector_index_recall": (vector_index_recall, None),
    "bm25_list_terms": (bm25_list_terms, _top(5, bm25_ctes("a", True), "r")),
    "bm25_tie_desc": (bm25_tie_desc, f"WITH {bm25_ctes()}, z AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS k FROM s) SELECT qid, k AS rank, doc_id, score FROM z WHERE k <= 10"),
    "bm25_l2_top5": (bm25_l2_top5, _top(5, bm25_ctes("l2"), "r")),
    "bm25_pairs": (bm25_pairs, f"WITH {bm25_ctes('l2', qs=_PAIRS_Q)}, {GOLD_SQL} SELECT qid, doc_id, coalesce(score, 0) AS score FROM gold LEFT JOIN s USING (qid, doc_id)"),
    "term_stats": (term_stats, f"SELECT tok, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({sql_tokens('l2', 'text')}) AS tok FROM documents) GROUP BY tok"),
    "collection_stats": (collection_stats, f"SELECT count(*) AS n_docs, round(coalesce(avg(len({sql_tokens('w', 'text')})), 0), 6) AS avgdl FROM documents"),
    "tfidf_cosine_top5": (tfidf_top5, _top(5, TFIDF_SQL, "tr")),
    "dense_top5": (dense_top5, _DENSE.format("q.vec_id % 50 = 0") + ", k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) SELECT qid, rank, doc_id, score FROM k WHERE rank <= 5"),
    "hyde_diagnostics": (hyde_diagnostics, _DENSE.format("q.vec_id <> e.vec_id") + ", k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE qid <> doc_id) SELECT qid % 2 = 0 AS flag, count(*) AS n, round(avg((ql = label)::DOUBLE), 6) AS tca FROM k WHERE rank = 1 GROUP BY 1"),
    "oracle_rank": (oracle_rank_top10, f"WITH {GOLD_SQL}, e AS (SELECT q.qid, d.doc_id, row_number() OVER (PARTITION BY q.qid ORDER BY g.doc_id IS NULL, d.doc_id) AS rank FROM (SELECT DISTINCT qid FROM gold) q CROSS JOIN documents d LEFT JOIN gold g ON g.qid = q.qid AND g.doc_id = d.doc_id) SELECT * FROM e WHERE rank <= 10"),
    "entity_lookup": (entity_probe_exact, "SELECT q.doc_id AS qid, d.doc_id, row_number() OVER (PARTITION BY q.doc_id ORDER BY d.doc_id) AS rank FROM documents q JOIN documents d USING (lang, source) WHERE q.doc_id % 50 = 0"),
    "entity_probe": (entity_probe_top10, "SELECT * FROM (SELECT q.doc_id AS qid, d.doc_id, row_number() OVER (PARTITION BY q.doc_id ORDER BY (q.lang = d.lang AND q.source = d.source) DESC, d.doc_id) AS rank FROM documents q, documents d WHERE q.doc_id % 50 = 0) WHERE rank <= 10"),
    "pool_union": (pool_union, _POOL + " SELECT * FROM pool"),
    "pool_rerank": (pool_rerank, _POOL + ", z AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, '-inf'::DOUBLE) DESC, doc_id) AS rank FROM pool LEFT JOIN ts USING (qid, doc_id)) SELECT * FROM z WHERE rank <= 5"),
    "gold_ranks": (gold_ranks, _RANKS + " SELECT qid, doc_id, rank FROM g"),
    "rank_metrics": (rank_metrics, _RANKS + " SELECT count(*) AS n, round(avg((rank <= 5)::INT), 6) AS tca_at_5, round(avg((rank <= 10)::INT), 6) AS tca_at_10, round(avg((rank <= 20)::INT), 6) AS tca_at_20, round(avg(rank), 6) AS mean_rank, round(avg(1 / rank), 6) AS mrr FROM g"),
    "rank_medians": (rank_medians, _RANKS + " SELECT count(*) AS n, list_sort(list(rank))[count(*) // 2 + 1] AS upper_median, median(rank) AS median FROM g"),
    "recall_at_ks": (recall_at_ks, _RANKS + " SELECT round(avg((rank <= 1)::INT), 6) AS recall_at_1, round(avg((rank <= 5)::INT), 6) AS recall_at_5, round(avg((rank <= 10)::INT), 6) AS recall_at_10 FROM g"),
    "wilson_ci": (wilson_ci, _RANKS + f", h AS (SELECT count(*) FILTER (rank <= 5) AS hits, count(*) AS n FROM g) SELECT hits, n, {_WILSON} FROM h"),
    "labels_wilson": (labels_wilson, f"WITH h AS (SELECT lang, count(*) FILTER (quality = 1) AS hits, count(quality) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT lang, hits, n, {_WILSON} FROM h"),
    "jaccard_gap": (jaccard_gap, _JAC + " SELECT *, round(q_disclosure - q_patch, 6) AS gap FROM j"),
    "jaccard_summary": (jaccard_summary, _JAC + ", g AS (SELECT *, round(q_disclosure - q_patch, 6) AS gap FROM j) SELECT count(*) AS n, round(avg(q_disclosure), 6) AS mean_disclosure, round(avg(q_patch), 6) AS mean_patch, round(avg(gap), 6) AS mean_gap, round(avg((gap > 0)::INT) * 100, 1) AS pct_positive FROM g"),
    "bm25_gap": (
        bm25_gap,
        f"WITH {_THIRDS}, {_OWN('a', 'disclosure')}, {_OWN('b', 'patch')}, "
        "j AS (SELECT coalesce(x.score, 0) AS a, coalesce(y.score, 0) AS b FROM (SELECT doc_id AS qid FROM documents) q LEFT JOIN as x ON x.qid = q.qid AND x.doc_id = q.qid LEFT JOIN bs y ON y.qid = q.qid AND y.doc_id = q.qid) "
        "SELECT count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg((a > b)::INT) * 100, 1) AS pct_positive, round(CASE WHEN avg(b) > 0 THEN avg(a) / avg(b) END, 6) AS ratio FROM j".replace("JOIN as x", 'JOIN "as" x'),
    ),
    "vocab_venn": (vocab_venn, f"WITH t AS (SELECT unnest({sql_tokens('l2', 'text')}) AS tok, lang AS part FROM documents WHERE lang IN ('en', 'fr') UNION ALL SELECT unnest({sql_tokens('l2', 'text')}), 'benchmark' FROM benchmark), f AS (SELECT tok, bool_or(part = 'en') AS en, bool_or(part = 'fr') AS fr, bool_or(part = 'benchmark') AS benchmark FROM t GROUP BY tok) SELECT en, fr, benchmark, count(*) AS n_tokens FROM f GROUP BY ALL"),
    "content_words": (content_words, f"WITH t AS (SELECT doc_id, {sql_tokens('l2', 'text')} AS k FROM documents) SELECT doc_id, len(list_distinct(list_filter(k, lambda x: NOT list_contains({_in(T.STOPWORDS)}, x)))) AS n_content, len(list_distinct(k)) AS n_distinct, len(list_filter(k, lambda x: NOT list_contains({_in(T.STOP)}, x))) AS n_plain FROM t"),
}
