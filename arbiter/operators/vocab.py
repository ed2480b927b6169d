"""Vocabulary gaps between questions and what controls them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbiter.functions import text as T


def jaccard_gap(triples: DataFrame) -> DataFrame:
    """Per ``id``: similarity of question to disclosure and to patch, and the gap between them."""
    q, d, p = T.token_set("query"), T.token_set("disclosure"), T.token_set("patch")
    s = triples.select("id", F.round(T.jaccard(q, d), 6).alias("q_disclosure"), F.round(T.jaccard(q, p), 6).alias("q_patch"))
    return s.withColumn("gap", F.round(F.col("q_disclosure") - F.col("q_patch"), 6))


def summarize(gaps: DataFrame) -> DataFrame:
    return gaps.agg(F.count("*").alias("n"), F.round(F.avg("q_disclosure"), 6).alias("mean_disclosure"), F.round(F.avg("q_patch"), 6).alias("mean_patch"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.round(F.avg((F.col("gap") > 0).cast("double")) * 100, 1).alias("pct_positive"))


def bm25_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Means of two score columns of the same questions, the share of positive gaps, and their ratio (null for none)."""
    j = a.select("qid", F.col("score").alias("a")).join(b.select("qid", F.col("score").alias("b")), "qid")
    return j.agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.round(F.avg((F.col("a") > F.col("b")).cast("double")) * 100, 1).alias("pct_positive"), F.round(F.when(F.avg("b") > 0, F.avg("a") / F.avg("b")), 6).alias("ratio"))


def venn(parts: dict[str, DataFrame], text: str = "text") -> DataFrame:
    """Number of distinct tokens by which of the named corpora have them."""
    every = None
    for name, df in parts.items():
        t = df.select(F.explode(T.tokens_l2(text)).alias("tok"), F.lit(name).alias("part"))
        every = t if every is None else every.unionAll(t)
    flags = every.groupBy("tok").agg(*(F.bool_or(F.col("part") == n).alias(n) for n in parts))
    return flags.groupBy(*parts).agg(F.count("*").alias("n_tokens"))


def venn_samples(parts: dict[str, DataFrame], k: int = 30, text: str = "text") -> DataFrame:
    """The first ``k`` tokens in order of each region of the Venn diagram; the limit of a group holds in each task already."""
    every = reduce(DataFrame.unionAll, (df.select(F.explode(T.tokens_l2(text)).alias("tok"), F.lit(name).alias("part")) for name, df in parts.items()))
    flags = every.groupBy("tok").agg(*(F.bool_or(F.col("part") == n).alias(n) for n in parts))
    at = F.row_number().over(W.partitionBy(*parts).orderBy("tok"))
    return flags.withColumn("place", at).where(F.col("place") <= k)


def phrase_shares(df: DataFrame, text: str) -> DataFrame:
    v = T.check_vocab(text)
    return df.select(v.alias("v")).agg(F.count("*").alias("n"), F.count(F.when(F.col("v.has_overruling_vocab"), 1)).alias("n_overruling"), F.count(F.when(F.col("v.has_query_vocab"), 1)).alias("n_query"))
