"""A stored inverted index: posting blocks with the greatest weight that each can give, added to without a rebuild.

A segment holds the postings of the rows added at once, by bucket and word, cut into blocks in the order of their weights. A
block says how often its words stand in a text at most and how long its texts are at least, which bounds its
weight whatever the collection's statistics become. A segment counts once its line of statistics is written, so
an addition that fails changes nothing. Ids are unique over all additions. Texts are split when they are added only.

A search reads the heads of its words' blocks, scores each word's best block, and so knows a score that ``k``
documents reach; blocks that can't lift a document to it aren't read. The ranking is the same as without an index.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from arbiter.functions import scores
from arbiter.functions.text import TOKENIZERS
from arbiter.operators import best, relevance
from arbiter.sources.shared import stored

#: Postings of a block, folders that words are dealt to, places for a word that all texts have, and postings that a task holds.
BLOCK, BUCKETS, PLACES, HELD = 128, 32, 64, 1 << 20
#: What rounding may add to a score: half of its last digit, twice.
ROUNDING = 1e-6


def _bucket(tok: str) -> Column:
    return F.pmod(F.xxhash64(tok), F.lit(BUCKETS)).cast("int")


def add(corpus: DataFrame, path: str, tokenizer: str = "w") -> None:
    """Adds the rows of ``corpus(doc_id, text)`` to the index below ``path`` as one segment; an empty text is a document too.

    Each task makes one list of postings for each of its words, and the lists are shuffled. A word that a
    share of a task's texts have goes to as many places as that share of ``PLACES``.
    """
    segment, spark = uuid.uuid4().hex, corpus.sparkSession
    doc = corpus.schema["doc_id"].dataType.simpleString()
    lists = f"tok string, place int, docs array<{doc}>, tfs array<int>, dls array<int>"
    split = corpus.select("doc_id", TOKENIZERS[tokenizer]("text").alias("toks")).mapInArrow(_lists(lists), lists)
    # A list without a word says how many documents a task has, and how long they are together.
    split = split.withColumn("bucket", F.when(F.col("tok").isNull(), -1).otherwise(_bucket("tok")))
    dealt = split.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket", "tok", "place").sortWithinPartitions("bucket", "tok")
    kinds = f"bucket int, tok string, docs array<{doc}>, tfs array<int>, dls array<int>, n int, max_tf int, min_dl int"
    blocks = dealt.select("bucket", "tok", "docs", "tfs", "dls").mapInArrow(_blocks(kinds), kinds)
    blocks.withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("segment", "bucket").parquet(f"{path}/blocks")
    told = spark.read.schema(f"{kinds}, segment string").parquet(f"{path}/blocks").where((F.col("segment") == segment) & (F.col("bucket") == -1))
    total = lambda c: F.coalesce(F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0))
    stats = told.agg(total("tfs").alias("n_docs"), total("dls").alias("total"))
    stats.select(F.lit(segment).alias("segment"), "n_docs", "total").write.mode("append").parquet(f"{path}/stats")


def _schema(kinds: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(kinds))


def _listed(values: pa.Array, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values).cast(kind)


def _lists(kinds: str):
    schema = _schema(kinds)

    def run(batches):
        for batch in batches:
            toks = batch.column(1)
            sizes = np.diff(toks.offsets.to_numpy())
            words = toks.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(sizes)), sizes)
            pair, tf = np.unique(words.indices.to_numpy().astype(np.int64) * max(1, len(sizes)) + row, return_counts=True)
            word, row = np.divmod(pair, max(1, len(sizes)))
            at = np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(word))
            n = np.diff(at)
            # Which of a word's places a task's list goes to changes from task to task.
            places = 1 + n * PLACES // max(1, len(sizes))
            place = zlib.crc32(repr(batch.column(0)[:1]).encode()) % places
            columns = [words.dictionary.take(pa.array(word[at[:-1]])), pa.array(place.astype(np.int32)), _listed(batch.column(0).take(pa.array(row)), at, schema.field("docs").type)]
            columns += [_listed(pa.array(x.astype(np.int32)), at, schema.field("tfs").type) for x in (tf, sizes[row])]
            yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            yield pa.record_batch([pa.array([x], f.type) for x, f in zip((None, 0, [], [len(sizes)], [int(sizes.sum())]), schema, strict=True)], schema=schema)

    return run


def _blocks(kinds: str):
    schema = _schema(kinds)

    def batch_of(*columns):
        return pa.record_batch([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def cut(rows):
        """Blocks of each word's lists, the heaviest postings first."""
        words = rows["tok"].combine_chunks().dictionary_encode()
        code = words.indices.to_numpy().astype(np.int64)
        docs, tf, dl = (rows[c].combine_chunks().flatten() for c in ("docs", "tfs", "dls"))
        tf, dl = tf.to_numpy().astype(np.int64), dl.to_numpy().astype(np.int64)
        word = np.repeat(code, pc.list_value_length(rows["tfs"].combine_chunks()).to_numpy())
        order = np.lexsort((-(tf / (tf + dl)), word))
        word, tf, dl = word[order], tf[order], dl[order]
        place = np.arange(len(word)) - np.searchsorted(word, word)
        first = np.flatnonzero(place % BLOCK == 0)
        at = np.append(first, len(word))
        bucket = rows["bucket"].combine_chunks().take(pa.array(np.searchsorted(code, word[first])))
        lists = [_listed(v, at, schema.field(c).type) for c, v in (("docs", docs.take(pa.array(order))), ("tfs", pa.array(tf.astype(np.int32))), ("dls", pa.array(dl.astype(np.int32))))]
        numbers = [pa.array(x.astype(np.int32)) for x in (np.diff(at), np.maximum.reduceat(tf, first), np.minimum.reduceat(dl, first))]
        return batch_of(bucket, words.dictionary.take(pa.array(word[first])), *lists, *numbers)

    def run(batches):
        waiting, held = [], 0
        for batch in batches:
            told = batch.filter(pc.is_null(batch.column(1)))
            if told.num_rows:
                sums = [told.column(c).flatten() for c in (3, 4)]
                yield batch_of(told.column(0)[:1], told.column(1)[:1], told.column(2)[:1], *(_listed(x, np.array([0, len(x)]), schema.field(c).type) for x, c in zip(sums, ("tfs", "dls"), strict=True)), *[pa.array([0])] * 3)
            batch = batch.filter(pc.is_valid(batch.column(1)))
            if not batch.num_rows:
                continue
            waiting.append(batch)
            held += len(batch.column(3).flatten())
            if held < HELD:
                continue
            rows = pa.Table.from_batches(waiting)
            # The last word may go on; one of very many postings is cut all the same.
            start = pc.index(rows["tok"], rows["tok"][-1]).as_py()
            rest = rows.slice(start)
            if start and (left := pc.sum(pc.list_value_length(rest["tfs"])).as_py()) < HELD:
                yield cut(rows.slice(0, start))
                waiting, held = rest.to_batches(), left
            else:
                yield cut(rows)
                waiting, held = [], 0
        if waiting:
            yield cut(pa.Table.from_batches(waiting))

    return run


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row ``n_docs, avgdl`` of all segments."""
    s = spark.read.parquet(f"{path}/stats")
    return s.agg(F.sum("n_docs").alias("n_docs"), F.try_divide(F.sum("total"), F.sum("n_docs")).alias("avgdl"))


def _needed(spark: SparkSession, path: str, queries: DataFrame, k: int, tokenizer: str, dup_terms: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of the searched words, those that can lift a document to the first ``k`` of some question, and ``qid, tok, weight``.

    A block bounds a document's weight the same way for every question, so blocks meet words and no questions.
    """
    live = F.broadcast(spark.read.parquet(f"{path}/stats").select("segment"))  # a row for each addition
    blocks = spark.read.parquet(f"{path}/blocks").join(live, "segment", "left_semi")
    terms = stored(relevance.query_terms(queries, tokenizer, dup_terms), "terms")
    stats = F.broadcast(statistics(spark, path))
    named = terms.select(_bucket("tok").alias("bucket"), "tok").distinct()
    hits = blocks.join(named, ["bucket", "tok"], "left_semi").crossJoin(stats)
    hits = hits.withColumn("unit", scores.bm25_weight(F.col("max_tf"), F.col("min_dl"), F.col("avgdl")))
    heads = hits.groupBy("tok").agg(F.sum("n").alias("df"), F.max("unit").alias("unit"), F.max_by(F.struct("docs", "tfs", "dls"), F.struct("unit", "segment", F.col("docs")[0])).alias("b"))
    heads = stored(heads.crossJoin(stats).select("*", scores.idf(F.col("n_docs"), F.col("df")).alias("idf")), "heads")
    asked = terms.join(heads.select("tok", "unit", "idf"), "tok").select("qid", "tok", (F.col("idf") * F.col("qtf")).alias("weight"), (F.col("idf") * F.col("qtf") * F.col("unit")).alias("most"))
    asked = stored(asked, "weights")
    # What the best blocks of a question's words add up to, of no more postings than a block has for each.
    best_of = asked.join(heads.select("tok", "avgdl", "b"), "tok").select("qid", "weight", "avgdl", F.explode(F.arrays_zip("b.docs", "b.tfs", "b.dls")).alias("p"))
    one = F.col("weight") * scores.bm25_weight(F.col("p.tfs"), F.col("p.dls"), F.col("avgdl"))
    reached = best_of.groupBy("qid", F.col("p.docs").alias("doc_id")).agg(F.sum(one).alias("raw"))
    at = F.row_number().over(W.partitionBy("qid").orderBy(F.col("raw").desc()))
    least = reached.withColumn("at", at).where(F.col("at") == k).select("qid", F.col("raw").alias("least"))
    total = asked.groupBy("qid").agg(F.sum("most").alias("total"))
    # What a document of the block can reach: the block's bound and the most of all other words.
    floor = (F.coalesce("least", F.lit(0.0)) - (F.col("total") - F.col("most")) - 2 * ROUNDING) / F.col("weight")
    limits = stored(asked.join(total, "qid").join(least, "qid", "left").groupBy("tok").agg(F.min(floor).alias("limit")), "limits")
    return hits, hits.join(limits, "tok").where("unit >= limit"), asked.select("qid", "tok", "weight")


def needed_blocks(spark: SparkSession, path: str, queries: DataFrame, k: int, tokenizer: str = "w", dup_terms: bool = False) -> tuple[DataFrame, DataFrame]:
    """All blocks of the searched words, and those that can lift a document to the first ``k``."""
    return _needed(spark, path, queries, k, tokenizer, dup_terms)[:2]


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, tokenizer: str = "w", dup_terms: bool = False, tie: str = "asc") -> DataFrame:
    """``qid, doc_id, score, rank``: the first ``k`` by BM25 for ``queries(qid, query)``.

    Postings of the needed blocks are put together by document, each once however many questions have its word.
    """
    _, needed, weights = _needed(spark, path, queries, k, tokenizer, dup_terms)
    numbers = stored(weights.select("tok").distinct().select("tok", F.monotonically_increasing_id().alias("at")), "numbers")
    each = needed.join(numbers, "tok").select("at", "avgdl", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p"))
    each = each.select(F.col("p.docs").alias("doc_id"), "at", scores.bm25_weight(F.col("p.tfs"), F.col("p.dls"), F.col("avgdl")).alias("w"))
    docs = stored(best.packed(each, "doc_id"), "vectors")
    asked = stored(best.packed(weights.join(numbers, "tok").select("qid", "at", F.col("weight").alias("w")), "qid"), "asked")
    return relevance.top_k(best.best(docs, asked, k, tie), k, tie)
