"""Relevance ranking: BM25 in its variants, TF-IDF, dense vectors, probes, pools and rank-of.

Corpora are ``doc_id, text``; question sets ``qid, query``. Every ranking has a total order, the rounded
score and then the id, so results never depend on how tasks ended.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from arbiter.functions import scores
from arbiter.functions.text import TOKENIZERS
from arbiter.operators import best
from arbiter.sources.shared import stored

DIGITS = 6


def postings(corpus: DataFrame, tokenizer: str = "w") -> DataFrame:
    """``doc_id, tok, tf``: partially aggregated before the shuffle, so hot words cost a row per task and document."""
    return corpus.select("doc_id", F.explode(TOKENIZERS[tokenizer]("text")).alias("tok")).groupBy("doc_id", "tok").agg(F.count("*").alias("tf"))


def lengths(corpus: DataFrame, tokenizer: str = "w") -> DataFrame:
    return corpus.select("doc_id", F.size(TOKENIZERS[tokenizer]("text")).cast("long").alias("dl"))


def collection_stats(corpus: DataFrame, tokenizer: str = "w") -> DataFrame:
    """One row: ``n_docs, avgdl``; documents without tokens count."""
    return lengths(corpus, tokenizer).agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def term_stats(corpus: DataFrame, tokenizer: str = "w") -> DataFrame:
    return postings(corpus, tokenizer).groupBy("tok").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def query_terms(queries: DataFrame, tokenizer: str = "w", dup_terms: bool = False) -> DataFrame:
    """``qid, tok, qtf``: how often a term counts, once unless ``dup_terms``."""
    terms = queries.select("qid", F.explode(TOKENIZERS[tokenizer]("query")).alias("tok")).groupBy("qid", "tok").agg(F.count("*").alias("qtf"))
    return terms if dup_terms else terms.withColumn("qtf", F.lit(1).cast("long"))


#: Bytes of question terms that are broadcast at once, and what one of them takes.
TERMS_LIMIT, TERM_BYTES = 16 << 20, 64


def _weighed(corpus: DataFrame, queries: DataFrame, tokenizer: str, dup_terms: bool) -> tuple[DataFrame, DataFrame]:
    """``doc_id, at, w`` of documents and ``qid, at, idf, qtf`` of questions, ``at`` being a number of a question's term.

    Texts are split once: terms that some question has are counted per document and stored, with one row more
    for each document under the empty term, from which the statistics come.
    """
    terms = stored(query_terms(queries, tokenizer, dup_terms), "terms")
    numbers = terms.select("tok").distinct().select("tok", F.monotonically_increasing_id().alias("at"))
    numbers = stored(numbers.unionAll(terms.sparkSession.createDataFrame([("", -1)], "tok string, at long")), "numbers")
    split = corpus.select("doc_id", TOKENIZERS[tokenizer]("text").alias("toks"))
    every = F.explode(F.concat("toks", F.array(F.lit("")))).alias("tok")
    hits = split.select("doc_id", F.size("toks").cast("long").alias("dl"), every).join(numbers, "tok")
    tf = stored(hits.groupBy("doc_id", "dl", "at").agg(F.count("*").alias("tf")), "hits")
    stats = tf.where("at < 0").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(F.col("dl") * F.col("tf")) / F.sum("tf"), F.lit(0.0)).alias("avgdl"))
    tf = tf.where("at >= 0")
    idf = tf.groupBy("at").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).select("at", scores.idf(F.col("n_docs"), F.col("df")).alias("idf"))
    asked = stored(terms.join(numbers, "tok").join(idf, "at").select("qid", "at", "idf", "qtf"), "asked")
    return tf.crossJoin(F.broadcast(stats)).select("doc_id", "at", scores.bm25_weight(F.col("tf"), F.col("dl"), F.col("avgdl")).alias("w")), asked


def bm25_scores(corpus: DataFrame, queries: DataFrame, tokenizer: str = "w", dup_terms: bool = False) -> DataFrame:
    """``qid, doc_id, score`` of all documents that share a term with a question.

    Question terms go to the documents, in parts that are small enough to be broadcast, so what is scored is
    never shuffled, however many questions a document meets.
    """
    weighed, asked = _weighed(corpus, queries, tokenizer, dup_terms)
    parts = -(-asked.count() * TERM_BYTES // TERMS_LIMIT)
    tasks = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    weighed = weighed.repartition(tasks, "doc_id")
    found = None
    for k in range(max(parts, 1)):
        some = asked if parts < 2 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == k)
        part = weighed.join(F.broadcast(some), "at").groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("idf") * F.col("qtf")), DIGITS).alias("score"))
        found = part if found is None else found.unionAll(part)
    return found


#: Words that tasks are given at most: those of questions, or the most frequent ones of documents. Texts counted at once.
WORDS, TEXTS = 200_000, 2_000


def _counts(wanted: pa.Table, every: bool, kinds: str):
    schema = to_arrow_schema(StructType.fromDDL(kinds))

    def lists(row: np.ndarray, n: int, *values) -> list:
        at = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
        return [pa.ListArray.from_arrays(at, v) for v in values]

    def counted(row, code, width):
        pair, tf = np.unique(row * width + code, return_counts=True)
        return *np.divmod(pair, width), pa.array(tf.astype(np.int32))

    def run(batches):
        names, numbers = wanted["tok"].combine_chunks(), wanted["at"].to_numpy()
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                toks = part.column(1)
                dl = np.asarray(pc.list_value_length(toks)).astype(np.int64)
                coded = toks.flatten().dictionary_encode()
                words = coded.dictionary
                row, code, tf = counted(np.repeat(np.arange(len(dl)), dl), coded.indices.to_numpy().astype(np.int64), max(1, len(words)))
                place = pc.index_in(words, value_set=names.cast(words.type)).fill_null(-1).to_numpy(zero_copy_only=False)[code]
                own = place >= 0
                columns = [part.column(0), pa.array(dl), *lists(row[own], len(dl), pa.array(numbers[place[own]]), tf.filter(pa.array(own)))]
                if every:
                    columns += lists(row, len(dl), words.take(pa.array(code)), tf)
                yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _counted(corpus: DataFrame, queries: DataFrame, tokenizer: str, dup_terms: bool, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``doc_id, dl, at, tf`` of documents, ``qid, tok, qtf, at`` of questions, and the statistics.

    ``at`` and ``tf`` are the numbers of a text's words that some question has, and how often they stand in it; with
    ``every``, ``toks`` and ``tfs`` are all of its words. A text is counted where it is, so no word of it is a
    shuffled row, unless ids repeat or questions have more than ``WORDS`` words.
    """
    terms = stored(query_terms(queries, tokenizer, dup_terms), "terms")
    numbers = stored(terms.select("tok").distinct().select("tok", F.monotonically_increasing_id().alias("at")), "numbers")
    few = numbers.count() <= WORDS
    rows, stats = _texts(corpus, tokenizer, numbers if few else numbers.limit(0), every or not few)
    if not few or _repeated(rows):
        rows = stored(_merged(rows, numbers, every or not few), "merged")
    return rows, terms.join(numbers, "tok"), stats


def _texts(corpus: DataFrame, tokenizer: str, numbers: DataFrame, every: bool) -> tuple[DataFrame, DataFrame]:
    """Counts of each row of the corpus, and its statistics."""
    doc = corpus.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {doc}, dl long, at array<long>, tf array<int>" + ", toks array<string>, tfs array<int>" * every
    rows = stored(corpus.select("doc_id", TOKENIZERS[tokenizer]("text").alias("toks")).mapInArrow(_counts(numbers.toArrow(), every, kinds), kinds), "counts")
    return rows, rows.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def _repeated(rows: DataFrame) -> bool:
    return not rows.groupBy("doc_id").count().where("count > 1").isEmpty()


def _merged(rows: DataFrame, numbers: DataFrame, every: bool) -> DataFrame:
    """Rows of one id and length as one document."""
    each = _entries(rows, "toks", "tfs", "doc_id", "dl") if every else _entries(rows, "at", "tf", "doc_id", "dl")
    each = each.groupBy("doc_id", "dl", "key").agg(F.sum("tf").cast("int").alias("tf"))
    if not every:
        found = each.groupBy("doc_id", "dl").agg(F.collect_list(F.struct("key", "tf")).alias("e"))
        return found.select("doc_id", "dl", F.col("e.key").alias("at"), F.col("e.tf").alias("tf"))
    each = each.join(numbers.withColumnRenamed("tok", "key"), "key", "left")
    found = each.groupBy("doc_id", "dl").agg(F.collect_list(F.struct("key", "tf", "at")).alias("e"))
    own = F.filter("e", lambda x: x["at"].isNotNull())
    return found.select("doc_id", "dl", own["at"].alias("at"), own["tf"].alias("tf"), F.col("e.key").alias("toks"), F.col("e.tf").alias("tfs"))


def _entries(rows: DataFrame, key: str, tf: str, *keep: str) -> DataFrame:
    pair = F.explode(F.arrays_zip(F.col(key).alias("key"), F.col(tf).alias("n"))).alias("e")
    return rows.select(*keep, pair).select(*keep, F.col("e.key").alias("key"), F.col("e.n").alias("tf"))


def _frequencies(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``name, df`` of all numbers or words."""
    return rows.select(F.explode(key).alias(name)).groupBy(name).agg(F.count("*").alias("df"))


def _summed(each: DataFrame, words: DataFrame, value: Column, *keys: str) -> DataFrame:
    """``s``, the sum of a value of rows and their words' ``key, df, idf``. Words that many documents have are broadcast, fewer than ``WORDS``; others are shuffled."""
    total = words.agg(F.sum("df")).first()[0] or 0
    hot = F.broadcast(words.where(F.col("df") * WORDS > total).select("key", "idf"))
    cold = each.join(hot, "key", "left_anti").join(words.where(F.col("df") * WORDS <= total).select("key", "idf").hint("merge"), "key")
    part = lambda df: df.groupBy(*keys).agg(F.sum(value).alias("s"))
    return part(each.join(hot, "key")).unionAll(part(cold)).groupBy(*keys).agg(F.sum("s").alias("s"))


def _asked(terms: DataFrame, weights: DataFrame, weight: Column) -> DataFrame:
    """``qid, at, w`` of questions, as arrays."""
    return stored(best.packed(terms.join(weights, "at").select("qid", "at", weight.alias("w")), "qid"), "asked")


def _bm25_vectors(rows: DataFrame, stats: DataFrame) -> DataFrame:
    weight = F.transform("tf", lambda tf: scores.bm25_weight(tf, F.col("dl"), F.col("avgdl")))
    return rows.crossJoin(F.broadcast(stats)).select("doc_id", "at", weight.alias("w"))


def bm25_vectors(corpus: DataFrame, queries: DataFrame, tokenizer: str = "w", dup_terms: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents and questions whose products of vectors are ``bm25_scores``, for ``best``."""
    rows, terms, stats = _counted(corpus, queries, tokenizer, dup_terms)
    idf = _frequencies(rows, "at", "at").crossJoin(F.broadcast(stats)).select("at", scores.idf(F.col("n_docs"), F.col("df")).alias("idf"))
    return _bm25_vectors(rows, stats), _asked(terms, idf, F.col("idf") * F.col("qtf"))


def bm25_top(corpus: DataFrame, queries: DataFrame, k: int, tokenizer: str = "w", dup_terms: bool = False, tie: str = "asc") -> DataFrame:
    """The first ``k`` of ``bm25_scores``, ranked, without a row for any other pair."""
    return top_k(best.best(*bm25_vectors(corpus, queries, tokenizer, dup_terms), k, tie), k, tie)


def okapi_scores(corpus: DataFrame, queries: DataFrame, tokenizer: str = "w", epsilon: float = 0.25) -> DataFrame:
    """BM25 in the classic form: terms that more than half of the documents have would weigh less than nothing and
    get ``epsilon`` times the mean idf of all terms instead. Question terms count as often as they stand.
    """
    terms = query_terms(queries, tokenizer, dup_terms=True)
    split = corpus.select("doc_id", TOKENIZERS[tokenizer]("text").alias("toks"))
    tf = split.select("doc_id", F.size("toks").cast("long").alias("dl"), F.explode("toks").alias("tok")).groupBy("doc_id", "dl", "tok").agg(F.count("*").alias("tf"))
    stats = F.broadcast(collection_stats(corpus, tokenizer))
    plain = F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    idf = tf.groupBy("tok").agg(F.count("*").alias("df")).crossJoin(stats).select("tok", plain.alias("idf"))
    mean = F.broadcast(idf.agg((F.avg("idf") * epsilon).alias("floor")))
    idf = idf.join(terms.select("tok").distinct(), "tok", "left_semi").crossJoin(mean).select("tok", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"))
    weight = F.col("idf") * scores.bm25_weight(F.col("tf"), F.col("dl"), F.col("avgdl")) * F.col("qtf")
    hits = tf.join(idf, "tok").crossJoin(stats).join(terms, "tok")
    return hits.groupBy("qid", "doc_id").agg(F.round(F.sum(weight), DIGITS).alias("score"))


def okapi_top(corpus: DataFrame, queries: DataFrame, k: int, tokenizer: str = "w", epsilon: float = 0.25) -> DataFrame:
    """The first ``k`` of ``okapi_scores``, ranked, without a row for any other pair.

    Scores of 0 or less only come from words that weigh no more. Questions that have one, and fewer than ``k`` documents
    above 0, are scored by themselves.
    """
    rows, terms, stats = _counted(corpus, queries, tokenizer, True, every=True)
    plain = F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    idf = lambda df: df.crossJoin(F.broadcast(stats)).withColumn("idf", plain)
    mean = idf(_frequencies(rows, "toks", "tok")).agg((F.avg("idf") * epsilon).alias("floor"))
    own = idf(_frequencies(rows, "at", "at")).crossJoin(F.broadcast(mean))
    own = stored(own.select("at", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf")), "idf")
    found = top_k(best.best(_bm25_vectors(rows, stats), _asked(terms, own, F.col("idf") * F.col("qtf")), k), k)
    low = own.where("idf <= 0")
    if low.isEmpty():
        return found
    found = stored(found, "found")
    short = terms.join(low, "at").select("qid").distinct().join(found.groupBy("qid").count().where(F.col("count") >= k), "qid", "left_anti")
    rest = top_k(okapi_scores(corpus, queries.join(short, "qid", "left_semi"), tokenizer, epsilon), k)
    return found.join(short, "qid", "left_anti").select(rest.columns).unionAll(rest)


def ranked(found: DataFrame, tie: str = "asc") -> DataFrame:
    """``rank`` per question by score, then by id ascending or descending."""
    last = F.col("doc_id").asc() if tie == "asc" else F.col("doc_id").desc()
    return found.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), last)).cast("long"))


def with_unmatched(found: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """All documents per question; those without a shared term score 0. The result is questions times documents by definition."""
    every = queries.select("qid").join(corpus.select("doc_id"), how="cross")
    return every.join(found, ["qid", "doc_id"], "left").select("qid", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def top_k(found: DataFrame, k: int, tie: str = "asc") -> DataFrame:
    return ranked(found, tie).where(F.col("rank") <= k)


def bm25(corpus, queries, k: int | None = None, tokenizer="w", dup_terms=False, tie="asc", unmatched="drop") -> DataFrame:
    if k is not None:
        top = bm25_top(corpus, queries, k, tokenizer, dup_terms, tie)
        # Filling up reads the first k three times.
        return filled(stored(top, "top"), corpus, queries, k) if unmatched == "append" else top
    found = bm25_scores(corpus, queries, tokenizer, dup_terms)
    return ranked(with_unmatched(found, corpus, queries) if unmatched == "append" else found, tie)


def filled(top: DataFrame, corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Rankings of up to ``k`` documents with as many others, by id and with score 0, as make them ``k``.

    Of the smallest ``2 k`` ids a question with room has fewer than ``k`` already, so no more of them are needed.
    """
    short = queries.select("qid").distinct().join(top.groupBy("qid").agg(F.count("*").alias("has")), "qid", "left").where(F.coalesce("has", F.lit(0)) < k)
    others = short.crossJoin(F.broadcast(first_ids(corpus, 2 * k))).join(top.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    at = F.row_number().over(W.partitionBy("qid").orderBy("doc_id")) + F.coalesce("has", F.lit(0))
    rest = others.select("qid", "doc_id", F.lit(0.0).alias("score"), at.cast("long").alias("rank")).where(F.col("rank") <= k)
    return top.select("qid", "doc_id", "score", "rank").unionAll(rest)


def _shared(kinds: str):
    """Of each pair's document the words that its question has."""
    schema = to_arrow_schema(StructType.fromDDL(kinds))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                asked, toks, tfs = (part.column(c) for c in (3, 4, 5))
                words = toks.flatten().dictionary_encode()
                own = pc.index_in(asked.flatten(), value_set=words.dictionary.cast(asked.type.value_type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = lambda c: np.repeat(np.arange(len(c)), np.asarray(pc.list_value_length(c)))
                width, at = max(1, len(words.dictionary)), row(toks)
                both = np.isin(at * width + words.indices.to_numpy(), (row(asked) * width + own)[own >= 0])
                columns = [part.column(c).take(pa.array(at[both])) for c in (0, 1, 2)] + [toks.flatten().filter(pa.array(both)), tfs.flatten().filter(pa.array(both))]
                yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def pair_words(pairs: DataFrame, tokenizer: str = "l2") -> DataFrame:
    """``qid, doc_id, words`` of ``qid, query, doc_id``: each pair once, with its question's words."""
    words = F.array_distinct(F.flatten(F.transform("queries", TOKENIZERS[tokenizer])))
    asked = pairs.groupBy("qid").agg(F.collect_set("query").alias("queries")).select("qid", words.alias("words"))
    return stored(pairs.select("qid", "doc_id").distinct().join(asked, "qid"), "wanted")


def bm25_pairs(pairs: DataFrame, corpus: DataFrame, tokenizer: str = "l2", wanted: DataFrame | None = None) -> DataFrame:
    """Scores of given ``qid, query, doc_id`` pairs only; pairs without a shared term score 0.

    Texts are split once. A pair meets its own document as a whole, and only words that both have become rows.
    ``wanted`` are the ``pair_words``, where several corpora are asked.
    """
    nothing = corpus.sparkSession.createDataFrame([], "tok string, at long")
    rows, stats = _texts(corpus, tokenizer, nothing, True)
    if _repeated(rows):
        rows = stored(_merged(rows, nothing, True), "merged")
    wanted = pair_words(pairs, tokenizer) if wanted is None else wanted
    kind = lambda c: wanted.schema[c].dataType.simpleString()
    kinds = f"qid {kind('qid')}, doc_id {kind('doc_id')}, dl long, key string, tf int"
    both = wanted.join(rows, "doc_id").select("qid", "doc_id", "dl", "words", "toks", "tfs")
    idf = _frequencies(rows, "toks", "key").crossJoin(F.broadcast(stats)).withColumn("idf", scores.idf(F.col("n_docs"), F.col("df")))
    each = stored(both.mapInArrow(_shared(kinds), kinds).crossJoin(F.broadcast(stats)), "shared")
    found = _summed(each, stored(idf, "words"), F.col("idf") * scores.bm25_weight(F.col("tf"), F.col("dl"), F.col("avgdl")), "qid", "doc_id")
    found = found.select("qid", "doc_id", F.round("s", DIGITS).alias("score"))
    return pairs.select("qid", "doc_id").join(found, ["qid", "doc_id"], "left").select("qid", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


# -- TF-IDF ------------------------------------------------------------------------------------------


def tfidf_vectors(corpus: DataFrame, tokenizer: str = "a") -> DataFrame:
    """Long-form vectors ``doc_id, tok, w`` with smoothed idf and length-normalised tf."""
    tf = postings(corpus, tokenizer)
    df = tf.groupBy("tok").agg(F.count("*").alias("df"))
    n = F.broadcast(corpus.agg(F.count("*").alias("n_docs")))
    return tf.join(df, "tok").join(lengths(corpus, tokenizer), "doc_id").crossJoin(n).select("doc_id", "tok", (F.col("tf") / F.col("dl") * scores.smoothed_idf(F.col("n_docs"), F.col("df"))).alias("w"), "df", "n_docs")


def tfidf_cosine(corpus: DataFrame, queries: DataFrame, tokenizer: str = "a") -> DataFrame:
    """``qid, doc_id, score``: cosine of question and document; question terms that no document has drop out."""
    v = tfidf_vectors(corpus, tokenizer)
    norms = v.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    idf = v.groupBy("tok").agg(F.max(scores.smoothed_idf(F.col("n_docs"), F.col("df"))).alias("idf"))
    q = query_terms(queries, tokenizer, dup_terms=True)
    ql = q.groupBy("qid").agg(F.sum("qtf").alias("ql"))
    q = q.join(ql, "qid").join(idf, "tok").select("qid", "tok", (F.col("qtf") / F.col("ql") * F.col("idf")).alias("qw"))
    qn = q.groupBy("qid").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    dots = v.join(q, "tok").groupBy("qid", "doc_id").agg(F.sum(F.col("w") * F.col("qw")).alias("d"))
    return dots.join(norms, "doc_id").join(qn, "qid").select("qid", "doc_id", F.round(scores.cosine(F.col("d"), F.col("dn"), F.col("qn")), DIGITS).alias("score"))


def _norms(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``doc_id, norm`` of the documents' vectors."""
    square = F.pow(F.col("tf") / F.col("dl") * F.col("idf"), 2)
    return _summed(_entries(rows, "toks", "tfs", "doc_id", "dl"), words, square, "doc_id").select("doc_id", F.sqrt("s").alias("norm"))


def _tfidf(corpus: DataFrame, queries: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, at, w, norm`` and ``qid, at, w, norm``: vectors in places that some question has, and how long they are in all places."""
    rows, terms, stats = _counted(corpus, queries, tokenizer, True, every=True)
    n = F.broadcast(stats.select("n_docs"))
    idf = lambda df: df.crossJoin(n).withColumn("idf", scores.smoothed_idf(F.col("n_docs"), F.col("df")))
    norms = stored(_norms(rows, stored(idf(_frequencies(rows, "toks", "key")), "words")), "norms")
    own = stored(idf(_frequencies(rows, "at", "at")).select("at", "idf"), "idf")
    # Words that no document has count for a question's length, as it stands in its weights.
    ql = terms.groupBy("qid").agg(F.sum("qtf").alias("ql"))
    q = terms.join(ql, "qid").join(own, "at").select("qid", "at", (F.col("qtf") / F.col("ql") * F.col("idf")).alias("w"))
    asked = best.packed(q, "qid").where("qid IS NOT NULL").withColumn("norm", F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x)))
    each = _entries(rows.where("size(at) > 0"), "at", "tf", "doc_id", "dl").withColumnRenamed("key", "at")
    return stored(best.packed(each.join(F.broadcast(own) if own.count() <= WORDS else own, "at").select("doc_id", "at", (F.col("tf") / F.col("dl") * F.col("idf")).alias("w")), "doc_id").join(norms, "doc_id"), "vectors"), stored(asked, "asked")


def tfidf_top(corpus: DataFrame, queries: DataFrame, k: int, tokenizer: str = "a") -> DataFrame:
    """The first ``k`` of ``tfidf_cosine``, ranked, without a row for any other pair."""
    return _tfidf_first(*_tfidf(corpus, queries, tokenizer), k)


def _tfidf_first(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    return top_k(best.best(docs, asked, k), k)


def _tfidf_pairs(docs: DataFrame, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """``qid, doc_id, score`` of given pairs alone, those that share a term."""
    q = asked.select("qid", F.arrays_zip("at", "w").alias("q"), F.col("norm").alias("qn"))
    d = docs.select("doc_id", F.arrays_zip("at", "w").alias("d"), F.col("norm").alias("dn"))
    both = pairs.select("qid", "doc_id").distinct().join(d, "doc_id").join(q, "qid").select("qid", "doc_id", "q", "qn", "dn", F.explode("d").alias("d"))
    both = both.select("qid", "doc_id", "qn", "dn", "d", F.explode(F.filter("q", lambda x: x["at"] == F.col("d.at"))).alias("q"))
    dots = both.groupBy("qid", "doc_id", "qn", "dn").agg(F.sum(F.col("d.w") * F.col("q.w")).alias("dot"))
    return dots.select("qid", "doc_id", F.round(scores.cosine(F.col("dot"), F.col("dn"), F.col("qn")), DIGITS).alias("score"))


def pooled(corpus: DataFrame, queries: DataFrame, k: int, first: int | None = None) -> DataFrame:
    """The first ``k`` by BM25, then by TF-IDF; with ``first``, so many of them, in the order of their cosines."""
    vectors = _tfidf(corpus, queries, "a")
    pool = pool_union(bm25(corpus, queries, k), _tfidf_first(*vectors, k))
    if first is None:
        return pool
    pool = stored(pool, "pool")
    return rerank(pool, _tfidf_pairs(*vectors, pool)).where(F.col("rank") <= first)


# -- dense vectors -----------------------------------------------------------------------------------


def dense_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, doc_id, score``: dot products of stated question vectors ``(qid, vector)`` with all ``(doc_id, vector)``.

    The questions are a stated set against all rows; they are broadcast if Spark finds them small enough.
    """
    q = queries.select("qid", F.col("vector").alias("qv"))
    return vectors.crossJoin(q).select("qid", "doc_id", F.round(scores.dot(F.col("vector"), F.col("qv")), DIGITS).alias("score"))


def dense_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of ``dense_scores``, ranked: blocks of vectors meet as matrices.

    Rows without a vector, with another number of components than the longest have, or with components that are missing,
    not finite or beyond 10^4, are scored by themselves.
    """
    size = vectors.select("vector").unionAll(queries.select("vector")).agg(F.max(F.size("vector"))).first()[0]
    plain = lambda c: F.coalesce((F.size(c) == F.lit(size)) & F.forall(c, lambda x: F.coalesce(F.abs(x) <= 1e4, F.lit(False))), F.lit(False))
    entries = lambda df, key: df.where(plain("vector")).select(key, F.sequence(F.lit(0).cast("long"), F.lit(max(size or 1, 1) - 1).cast("long")).alias("at"), F.col("vector").cast("array<double>").alias("w"))
    odd, odd_q = vectors.where(~plain("vector")), queries.where(~plain("vector"))
    found = best.best(entries(vectors, "doc_id"), entries(queries, "qid"), k, every=True)
    if not odd.isEmpty():
        found = found.unionAll(dense_scores(odd, queries))
    if not odd_q.isEmpty():
        found = found.unionAll(dense_scores(vectors.where(plain("vector")), odd_q))
    return top_k(found, k)


# -- other rankings ----------------------------------------------------------------------------------


def first_ids(corpus: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest ids, to fill rankings up: a bounded table."""
    return corpus.select("doc_id").distinct().orderBy("doc_id").limit(k)


def oracle_rank(corpus: DataFrame, gold: DataFrame, k: int | None = None) -> DataFrame:
    """Gold documents ``(qid, doc_id, pos)`` in their order, then all others by id; with ``k``, the first ``k`` alone.

    A ranking of all documents is questions times documents by definition. For the first ``k``, no more
    than the smallest ``2 k`` ids can follow the gold ones: at most ``k - 1`` of these are gold, if there is room.
    """
    if k is not None:
        own = gold.select("qid", "doc_id", "pos").join(corpus.select("doc_id").distinct(), "doc_id", "left_semi")
        rest = own.select("qid").distinct().crossJoin(F.broadcast(first_ids(corpus, 2 * k))).join(own.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
        both = own.select("qid", "doc_id", "pos").unionAll(rest.select("qid", "doc_id", F.lit(None).cast(own.schema["pos"].dataType)))
        w = W.partitionBy("qid").orderBy(F.col("pos").isNull(), "pos", "doc_id")
        return both.select("qid", "doc_id", F.row_number().over(w).cast("long").alias("rank")).where(F.col("rank") <= k)
    every = gold.select("qid").distinct().join(corpus.select("doc_id"), how="cross").join(gold, ["qid", "doc_id"], "left")
    w = W.partitionBy("qid").orderBy(F.col("pos").isNull(), "pos", "doc_id")
    return every.select("qid", "doc_id", F.row_number().over(w).cast("long").alias("rank"))


def entity_probe(corpus: DataFrame, queries: DataFrame, keys: list[str], k: int | None = None) -> DataFrame:
    """Per question, documents whose keys all equal the question's come first; each part by id; with ``k``, the first ``k`` alone.

    For the first ``k``, each combination of keys gives its ``k`` smallest ids, questions meet them by an
    equi-join, and the smallest ``2 k`` ids of all fill up what is missing.
    """
    if k is not None:
        docs = corpus.select("doc_id", *keys).distinct()
        least = docs.withColumn("at", F.row_number().over(W.partitionBy(*keys).orderBy("doc_id"))).where(F.col("at") <= k)
        own = queries.select("qid", *keys).join(least, keys).select("qid", "doc_id", F.lit(True).alias("is_match"))
        rest = queries.select("qid").crossJoin(F.broadcast(first_ids(corpus, 2 * k))).join(own.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
        both = own.unionAll(rest.select("qid", "doc_id", F.lit(False)))
        rank = F.row_number().over(W.partitionBy("qid").orderBy(F.col("is_match").desc(), "doc_id")).cast("long")
        return both.withColumn("rank", rank).where(F.col("rank") <= k)
    match = None
    for key in keys:
        one = F.col(f"q.{key}") == F.col(f"d.{key}")
        match = one if match is None else match & one
    every = queries.alias("q").join(corpus.alias("d"), how="cross").select("q.qid", "d.doc_id", F.coalesce(match, F.lit(False)).alias("is_match"))
    w = W.partitionBy("qid").orderBy(F.col("is_match").desc(), "doc_id")
    return every.withColumn("rank", F.row_number().over(w).cast("long"))


def exact_matches(corpus: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """Only the matching part of ``entity_probe``: an equi-join, ranked by id.

    A document has the same place for all questions of its keys, so places are found once for each combination of
    keys, and questions, broadcast up to a bound, meet them where they are. Ids that several questions share are ranked by themselves.
    """
    docs = corpus.select("doc_id", *keys)
    asked = queries.select("qid", *keys)
    shared = asked.groupBy("qid").agg(F.count("*").alias("n")).where("n > 1").select("qid")
    alone = asked.join(shared, asked["qid"].eqNullSafe(shared["qid"]), "left_anti")
    if asked.count() * TERM_BYTES <= TERMS_LIMIT:
        alone = F.broadcast(alone)
    # Few rows make many, so they are dealt out again.
    tasks = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    places = docs.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("doc_id")).cast("long")).repartition(tasks, "doc_id")
    found = places.join(alone, keys).select("qid", "doc_id", "rank")
    if not shared.isEmpty():
        several = docs.join(asked.join(shared, asked["qid"].eqNullSafe(shared["qid"]), "left_semi"), keys)
        found = found.unionAll(several.select("qid", "doc_id", F.row_number().over(W.partitionBy("qid").orderBy("doc_id")).cast("long")))
    return found


def pool_union(*pools: DataFrame) -> DataFrame:
    """Ordered distinct union of rankings ``qid, doc_id, rank``: the first pool's order, then new ones of the next."""
    every = None
    for k, p in enumerate(pools):
        part = p.select("qid", "doc_id", F.struct(F.lit(k).alias("pool"), "rank").alias("at"))
        every = part if every is None else every.unionAll(part)
    first = every.groupBy("qid", "doc_id").agg(F.min("at").alias("at"))
    return first.select("qid", "doc_id", F.row_number().over(W.partitionBy("qid").orderBy("at", "doc_id")).cast("long").alias("rank"))


def rerank(pool: DataFrame, new_scores: DataFrame, tie: str = "asc") -> DataFrame:
    """A pool ordered by other scores ``(qid, doc_id, score)``, as of a cross-encoder; unscored ones come last."""
    return ranked(pool.select("qid", "doc_id").join(new_scores, ["qid", "doc_id"], "left").select("qid", "doc_id", F.coalesce("score", F.lit(float("-inf"))).alias("score")), tie)


def containing(corpus: DataFrame, passages: DataFrame) -> DataFrame:
    """``qid, doc_id`` of documents ``(doc_id, text)`` that contain a passage ``(qid, query)``, as it is.

    What lies between two spaces of a passage lies between the same spaces of the document. So a passage
    meets the documents that have its longest such part, by an equi-join, and ``contains`` decides.
    Passages with fewer than two spaces have no such part and meet all documents.
    """
    parts = F.split("query", " ")
    inner = F.slice(parts, 2, F.size(parts) - 2)
    longest = F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    q = passages.where("query IS NOT NULL").withColumn("part", F.when(F.size(parts) > 2, longest))
    d = corpus.where("text IS NOT NULL")
    keyed = d.select("doc_id", "text", F.explode(F.array_distinct(F.split("text", " "))).alias("part"))
    by_part = keyed.join(q.where("part IS NOT NULL"), "part").where(F.contains("text", "query")).select("qid", "doc_id")
    short = d.join(q.where("part IS NULL").select("qid", "query"), F.contains(F.col("text"), F.col("query"))).select("qid", "doc_id")
    return by_part.unionAll(short)


def rank_by_count(found: DataFrame, gold: DataFrame, size: int | Column) -> DataFrame:
    """``rank_of`` gold documents under scores ``(qid, doc_id, score)``, by counting what is better; nothing is sorted."""
    mine = gold.select("qid", "doc_id").join(found, ["qid", "doc_id"]).select("qid", F.col("doc_id").alias("gold_id"), F.col("score").alias("gold_score")).distinct()
    better = (F.col("score") > F.col("gold_score")) | ((F.col("score") == F.col("gold_score")) & (F.col("doc_id") <= F.col("gold_id")))
    ranks = mine.join(found, "qid").where(better).groupBy("qid", F.col("gold_id").alias("doc_id")).agg(F.count("*").alias("rank"))
    return rank_of(ranks, gold, size)


def rank_of(ranking: DataFrame, gold: DataFrame, size: int | Column) -> DataFrame:
    """``qid, doc_id, rank`` of gold documents; those not ranked come one after the corpus's size."""
    size = F.lit(size) if isinstance(size, int) else size
    return gold.select("qid", "doc_id").join(ranking.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left").select("qid", "doc_id", F.coalesce("rank", size + 1).cast("long").alias("rank"))
