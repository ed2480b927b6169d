"""Corpus building: flattening, dedup, caps, splits and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbiter.functions import text as T


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key. Spark limits each task's groups before the shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def cap_per_key(df: DataFrame, keys: list[str], order: list, most: int = 3) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def pair_dedup(pairs: DataFrame, a: str, b: str, order: list) -> DataFrame:
    """First of each (a, b), without pairs of one with itself, then first of each a."""
    return first_per_key(first_per_key(pairs.where(F.col(a) != F.col(b)), [a, b], order), [a], order)


def latest_value(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A key-value cache in which the last line wins."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def flatten_kb(examples: DataFrame) -> DataFrame:
    """Corpus rows of examples' ``kb`` arrays: the first of each id in example order; ids fall back to example and type."""
    e = examples.select("example_id", "employee", "ticker", F.posexplode("kb").alias("pos", "e"))
    ident = F.coalesce(F.col("e.event_id"), F.concat_ws("_", "example_id", "e.event_type"))
    rows = e.select(ident.alias("doc_id"), F.col("e.text").alias("text"), F.col("e.event_type").alias("event_type"), F.col("e.timestamp").alias("timestamp"), "employee", "ticker", "example_id", "pos")
    return first_per_key(rows, ["doc_id"], ["example_id", "pos"]).drop("example_id", "pos")


def gold_doc(provenance: Column | str) -> Column:
    """The last element's event."""
    return F.try_element_at(F.col(provenance) if isinstance(provenance, str) else provenance, F.lit(-1))["event_id"]


def build_corpus(*parts: DataFrame) -> DataFrame:
    """Parts as one corpus; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def scope_filter(docs: DataFrame, queries: DataFrame, keys: list[str], need_all: bool) -> DataFrame:
    """Candidates ``qid, doc_id, keys`` kept by scope: all keys together if the question has all, or each that it has."""
    q = queries.select("qid", *(F.col(k).alias(f"q_{k}") for k in keys))
    d = docs.join(q, "qid")
    has = lambda k: F.coalesce(F.col(f"q_{k}"), F.lit("")) != ""
    if need_all:
        every, same = F.lit(True), F.lit(True)
        for k in keys:
            every, same = every & has(k), same & (F.col(k) == F.col(f"q_{k}"))
        keep = ~every | F.coalesce(same, F.lit(False))
    else:
        keep = F.lit(True)
        for k in keys:
            keep = keep & (~has(k) | F.coalesce(F.col(k) == F.col(f"q_{k}"), F.lit(False)))
    return d.where(keep).drop(*(f"q_{k}" for k in keys))


def scoped(docs: DataFrame, queries: DataFrame, keys: list[str], need_all: bool) -> DataFrame:
    """``qid, doc_id``: what ``scope_filter`` keeps of all documents for each question.

    Questions are parted by which keys they have, and each part meets the documents by an equi-join on
    those. A question without a key that counts keeps all documents, by definition.
    """
    out = None
    has = lambda k: F.coalesce(F.col(k), F.lit("")) != ""
    for mask in range(1 << len(keys)):
        mine = [k for i, k in enumerate(keys) if mask >> i & 1]
        part = queries
        for k in keys:
            part = part.where(has(k) if k in mine else ~has(k))
        on = [] if need_all and len(mine) < len(keys) else mine
        d = docs.select("doc_id", *on)
        kept = (part.select("qid", *on).join(d, on) if on else part.select("qid").crossJoin(d)).select("qid", "doc_id")
        out = kept if out is None else out.unionAll(kept)
    return out


def scoped_counts(docs: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """``qid, n``: how many documents have all keys of each question; of a question that lacks one, all count. No pair is made."""
    every = F.lit(True)
    for k in keys:
        every = every & (F.coalesce(F.col(k), F.lit("")) != "")
    per = docs.groupBy(*keys).agg(F.count("*").alias("n"))
    whole = queries.where(every).join(per, keys).select("qid", "n")
    total = F.broadcast(docs.agg(F.count("*").alias("n")))
    return whole.unionAll(queries.where(~every).select("qid").crossJoin(total))


def merge_pairs(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing pairs, then new ones whose keys aren't there yet, each once; columns go by name."""
    return build_corpus(existing, new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti"))


def events_by_type(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("event_type") == kind)


def events_before(events: DataFrame, ts: Column | str, column: str = "ts") -> DataFrame:
    """Events strictly earlier than a time, given as a column or as ISO text."""
    return events.where(F.col(column) < (F.to_timestamp(F.lit(ts)) if isinstance(ts, str) else ts))


def quality_filters(df: DataFrame, text: str, least_chars: int = 80, least_words: int = 20) -> DataFrame:
    c = F.trim(F.col(text))
    return df.where((F.length(c) >= least_chars) & (F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")) >= least_words) & T.is_english(text))


def without_identifier(df: DataFrame, text: str, ident: str, ignore_case: bool = True) -> DataFrame:
    a, b = F.col(text), F.col(ident)
    return df.where(~(F.contains(F.lower(a), F.lower(b)) if ignore_case else F.contains(a, b)))


def split_rows(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(F.col("id").alias(key)), key, "left_semi")


def non_gold_pairs(gold: DataFrame, a: str, b: str) -> DataFrame:
    """All pairs of values that aren't gold pairs: the product of two value lists is what is asked for."""
    return gold.select(a).distinct().crossJoin(gold.select(b).distinct()).join(gold.select(a, b).distinct(), [a, b], "left_anti")


def remaining(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not yet in a sink, for resuming."""
    return source.join(done.select(key), key, "left_anti")


def hash_split(df: DataFrame, key: str, parts: int = 5, seed: int = 42) -> DataFrame:
    """``split``: ``test`` for one in ``parts`` by the key's hash, else ``train``."""
    return df.withColumn("split", F.when(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(parts)) == 0, "test").otherwise("train"))


def first_of_type(elements: Column | str, kind: str, field: str = "event_type") -> Column:
    """The first element of an array of structs that is of a type; null if none is."""
    return F.try_element_at(F.filter(elements, lambda e: e[field] == kind), F.lit(1))
