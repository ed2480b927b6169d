"""Inverted lists of vectors: centres fitted on a bounded sample, every row in the list of its nearest centre.

A search scores the lists nearest to a question, as many as it takes for a stated recall, or all that a bound
can't rule out, which is exact: with a list's radius and greatest length, no dot product in it exceeds
(|q|^2 + greatest^2 - max(0, |q - centre| - radius)^2) / 2. Questions meet vectors in pieces of bounded size, as
products of matrices; a piece gives the best of each question only, so no pair of rows is shuffled.

Rows with a null vector, or one of another length than the index's, are left out, questions too. The index is a table
below a given path and the centres with each list's numbers, of a size that the arguments bound.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.operators import relevance

#: Rows that centres are fitted on, the most lists, rows and components of a piece, and products of questions with a piece at once.
SAMPLE, LISTS, PIECE, VALUES, PRODUCTS = 20_000, 256, 20_000, 2_000_000, 4_000_000
#: Questions that tell how many lists a stated recall takes.
TRIALS = 256
#: What rounding may add to a score: half of its last digit, twice.
ROUNDING = 2e-6


@dataclass
class Lists:
    """Of each list the centre, the farthest row, the longest row, and the number of pieces; 0 where it is empty."""

    centres: np.ndarray
    radius: np.ndarray
    longest: np.ndarray
    pieces: np.ndarray


@dataclass
class VectorIndex:
    rows: DataFrame  # list, piece, doc_id, vector
    lists: Lists


def _piece(width: int) -> int:
    """Rows of a piece, and questions that meet it together. The fewer pieces there are, the fewer times a vector travels."""
    return max(1, min(PIECE, VALUES // max(1, width)))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T))


def _fitted(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, lists).astype(int)]
    for _ in range(rounds):
        near = _distances(x, centres).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=lists)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def build(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """The index of ``vectors(doc_id, vector)``, written below ``path``. Centres are fitted on ``sample`` rows, picked by a hash of their ids."""
    given = vectors.where("vector IS NOT NULL AND size(vector) > 0").select("doc_id", F.col("vector").cast("array<double>").alias("vector"))
    few = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("vector").toArrow().column("vector")
    width = len(few[0]) if len(few) else 1
    few = few.filter(pc.equal(pc.list_value_length(few), width))
    x = _matrix(few) if len(few) else np.zeros((1, width))
    centres = _fitted(x, lists or min(LISTS, max(1, len(x) // 64)))

    def assign(batches):
        for batch in batches:
            m = _matrix(batch.column(1))
            away = _distances(m, centres)
            at = away.argmin(1)
            yield pa.record_batch([*batch.columns, pa.array(at.astype(np.int32)), pa.array(away[np.arange(len(m)), at]), pa.array(np.sqrt((m * m).sum(1)))], names=["doc_id", "vector", "list", "away", "length"])

    doc = given.schema["doc_id"].dataType.simpleString()
    dealt = given.where(F.size("vector") == width).mapInArrow(assign, f"doc_id {doc}, vector array<double>, list int, away double, length double")
    dealt.write.mode("overwrite").parquet(path)
    dealt = vectors.sparkSession.read.parquet(path)
    n, radius, longest = (np.zeros(len(centres)) for _ in range(3))
    for r in dealt.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("away"), F.max("length").alias("length")).collect():  # a row for each list
        n[r.list], radius[r.list], longest[r.list] = r.n, r.away, r.length
    pieces = np.ceil(n / _piece(width)).astype(int)
    of = F.element_at(F.array(*(F.lit(int(max(1, p))) for p in pieces)), F.col("list") + 1)
    return VectorIndex(dealt.select("list", F.pmod(F.xxhash64("doc_id"), of).cast("int").alias("piece"), "doc_id", "vector"), Lists(centres, radius, longest, pieces))


def _pieces(lists: Lists, queries: DataFrame, choose) -> DataFrame:
    """``qid, vector, list, piece``: the pieces that ``choose(matrix, least)`` wants, a mask of lists for each question."""
    pieces = lists.pieces

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            row, at = np.nonzero(choose(x, batch.column(2).to_numpy(zero_copy_only=False).astype(float)) & (pieces > 0))
            times = pieces[at]
            row, at, number = np.repeat(row, times), np.repeat(at, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            for start in range(0, len(row), PIECE):
                part = slice(start, start + PIECE)
                yield pa.record_batch([batch.column(0).take(pa.array(row[part])), batch.column(1).take(pa.array(row[part])), pa.array(at[part].astype(np.int32)), pa.array(number[part].astype(np.int32))], names=["qid", "vector", "list", "piece"])

    kind = queries.schema["qid"].dataType.simpleString()
    return queries.select("qid", "vector", "least").mapInArrow(run, f"qid {kind}, vector array<double>, list int, piece int")


def _scored(index: VectorIndex, asked: DataFrame, blocks: int, k: int) -> DataFrame:
    """``qid, doc_id, raw, list``: the ``k`` best of each question and piece, and what rounding could put beside them."""
    keys = ["list", "piece", "block"]
    asked = asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    wanted = asked.select(F.col("list").alias("of"), F.col("piece").alias("at"), F.col("block").alias("to")).distinct()
    rows = index.rows.join(wanted, (F.col("list") == F.col("of")) & (F.col("piece") == F.col("at"))).select("of", "at", "to", "doc_id", "vector")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(left) and len(right):
            x, y = _matrix(left.column("vector")), _matrix(right.column("vector"))
            step = max(1, PRODUCTS // len(y))
            for at in range(0, len(x), step):
                product = x[at : at + step] @ y.T
                kth = np.partition(product, -k, 1)[:, -k, None] if product.shape[1] > k else -np.inf
                q, d = np.nonzero(product >= kth - ROUNDING)
                parts.append((q + at, d, product[q, d]))
        q, d, raw = map(np.concatenate, zip(*parts, strict=True))
        found = {"qid": left.column("qid").take(pa.array(q)), "doc_id": right.column("doc_id").take(pa.array(d)), "raw": raw}
        return pa.table(found | {"list": pa.array(np.full(len(q), left.column("list")[0].as_py() if len(left) else 0, np.int32))})

    kinds = f"qid {asked.schema['qid'].dataType.simpleString()}, doc_id {index.rows.schema['doc_id'].dataType.simpleString()}, raw double, list int"
    return asked.groupBy(keys).cogroup(rows.groupBy("of", "at", "to")).applyInArrow(run, kinds)


def _questions(index: VectorIndex, queries: DataFrame) -> tuple[DataFrame, int]:
    q = queries.select("qid", F.col("vector").cast("array<double>").alias("vector")).where(F.size("vector") == index.lists.centres.shape[1])
    return q.withColumn("least", F.lit(float("-inf"))), max(1, math.ceil(q.count() / _piece(index.lists.centres.shape[1])))


def _ranks(lists: Lists, x: np.ndarray) -> np.ndarray:
    """For each row the places of all lists in the order of their centres' distances; empty lists come last."""
    away = _distances(x, lists.centres)
    away[:, lists.pieces == 0] = np.inf
    return away.argsort(1, kind="stable").argsort(1, kind="stable")


def _nearest(lists: Lists, probes: int):
    return lambda x, least: _ranks(lists, x) < probes


def _best(found: DataFrame, k: int) -> DataFrame:
    return relevance.top_k(found.select("qid", "doc_id", F.round("raw", relevance.DIGITS).alias("score")), k)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """``qid, doc_id, score, rank`` for ``queries(qid, vector)``: from each question's ``probes`` nearest lists, or exact."""
    q, blocks = _questions(index, queries)
    return _best(_exact(index, q, blocks, k) if probes is None else _scored(index, _pieces(index.lists, q, _nearest(index.lists, probes)), blocks, k), k)


def _exact(index: VectorIndex, q: DataFrame, blocks: int, k: int) -> DataFrame:
    lists = index.lists
    first = _nearest(lists, 1)
    near = _scored(index, _pieces(lists, q, first), blocks, k)
    least = relevance.ranked(near.select("qid", "doc_id", F.col("raw").alias("score"))).where(F.col("rank") == k).select("qid", F.col("score").alias("least"))

    def others(x, least):
        reach = np.maximum(0, _distances(x, lists.centres) - lists.radius)
        bound = ((x * x).sum(1)[:, None] + lists.longest**2 - reach**2) / 2
        return (bound >= least[:, None] - ROUNDING) & ~first(x, least)

    told = q.drop("least").join(least, "qid", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    return near.unionAll(_scored(index, _pieces(lists, told, others), blocks, k))


def probes_for(index: VectorIndex, k: int, recall: float = 0.9, trials: int = TRIALS) -> tuple[int, float]:
    """The fewest lists in which ``trials`` indexed rows, picked by a hash of their ids, find so much of their ``k`` nearest; and how much."""
    q = index.rows.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(trials).select(F.col("doc_id").alias("qid"), "vector")
    q, blocks = _questions(index, q)
    found = _exact(index, q, blocks, k)
    places = found.select("qid", "doc_id", "list")
    best = _best(found, k).join(places, ["qid", "doc_id"]).join(q.select("qid", "vector"), "qid").select("vector", "list").toArrow()
    if not len(best):
        return 1, 1.0
    rank = _ranks(index.lists, _matrix(best.column("vector")))[np.arange(len(best)), best.column("list").to_numpy()]
    share = np.cumsum(np.bincount(rank, minlength=len(index.lists.centres))) / len(rank)
    probes = int(np.searchsorted(share, recall)) + 1
    return probes, float(share[probes - 1])
