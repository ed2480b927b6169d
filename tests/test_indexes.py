"""The stored inverted index against rankings without one, and the vector index against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbiter.operators import relevance, stored_index, vector_index

SCHEMA = "doc_id long, text string"


def made(n, seed):
    """Zipf-like words, one of which nearly all texts have; nulls, empty texts and one very long one."""
    rng = random.Random(seed)
    words = [f"w{int(1.35 ** rng.uniform(0, 20))}" for _ in range(4000)]
    rows = [(i, " ".join(["all", *rng.choices(words, k=rng.randrange(1, 60))])) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "all w3 " * 900), (n + 3, rows[0][1]), (n + 4, rows[0][1])]


@pytest.fixture(scope="module")
def corpus():
    return made(400, 1)


QUESTIONS = [(0, "w1 w3 w150"), (1, "all"), (2, "w2 w2 w7 all nowhere"), (3, ""), (4, None), (5, "nowhere"), (6, "W9 w11, w20!")]


@pytest.fixture(scope="module")
def stored(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    for part in (corpus[:250], corpus[250:], []):
        stored_index.add(spark.createDataFrame(part, SCHEMA), path)
    # An addition that failed: blocks without a line of statistics.
    lost = spark.read.parquet(f"{path}/blocks").limit(3).withColumn("segment", F.lit("lost"))
    lost.write.mode("append").partitionBy("segment", "bucket").parquet(f"{path}/blocks")
    return path


@pytest.mark.parametrize(("k", "dup", "tie"), [(5, False, "asc"), (3, True, "desc"), (1000, False, "asc")])
def test_same_ranking_as_without_an_index(spark, corpus, stored, k, dup, tie):
    docs, q = spark.createDataFrame(corpus, SCHEMA), spark.createDataFrame(QUESTIONS, "qid long, query string")
    want = relevance.bm25(docs, q, k, dup_terms=dup, tie=tie).select("qid", "rank", "doc_id", "score")
    got = stored_index.search(spark, stored, q, k, dup_terms=dup, tie=tie).select("qid", "rank", "doc_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_blocks_are_skipped(spark, corpus, tmp_path, monkeypatch):
    """Blocks of a frequent word whose weights can't lift a document to the first five."""
    monkeypatch.setattr(stored_index, "BLOCK", 8)
    monkeypatch.setattr(stored_index, "PLACES", 2)
    docs, path = spark.createDataFrame(corpus, SCHEMA).repartition(2), str(tmp_path / "small")
    stored_index.add(docs, path)
    q = spark.createDataFrame([(0, "all w3"), (1, "w1")], "qid long, query string")
    every, needed = stored_index.needed_blocks(spark, path, q, 5)
    assert 0 < needed.count() < every.count()
    found = [sorted(map(tuple, x.select("qid", "rank", "doc_id", "score").collect())) for x in (stored_index.search(spark, path, q, 5), relevance.bm25(docs, q, 5))]
    assert found[0] == found[1]
    heads = every.groupBy("tok").agg(F.max("max_tf"), F.min("min_dl"), F.sum("n").alias("n"), F.max("n").alias("most"))
    assert all(r.most <= stored_index.BLOCK for r in heads.collect())


def points():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 10))
    x = np.concatenate([centres[rng.integers(0, 6, 500)] + rng.normal(size=(500, 10)) * 0.3, np.repeat(centres[:1], 60, 0), rng.normal(size=(40, 10)) * 5])
    return [(int(i), v.astype(np.float32).tolist()) for i, v in enumerate(x)]


POINTS = points()
VECTOR = "doc_id long, vector array<float>"


@pytest.mark.parametrize(("piece", "lists"), [(4096, None), (7, 12)])
def test_exact_search(spark, tmp_path, monkeypatch, piece, lists):
    monkeypatch.setattr(vector_index, "PIECE", piece)
    rows = [*POINTS, (9000, None), (9001, [1.0])]
    table = spark.createDataFrame(rows, VECTOR).repartition(3)
    index = vector_index.build(table, str(tmp_path / "v"), lists)
    q = spark.createDataFrame([*POINTS[::41], (9000, None)], "qid long, vector array<float>")
    got = vector_index.search(index, q, 4)
    x = np.array([v for _, v in POINTS], np.float32).astype(float)
    want = []
    for i, v in POINTS[::41]:
        s = np.floor(x @ np.float32(v).astype(float) * 1e6 + 0.5) / 1e6
        want += [(i, r + 1, int(d), round(float(s[d]), 6)) for r, d in enumerate(np.lexsort((np.arange(len(x)), -s))[:4])]
    assert sorted((r.qid, r.rank, r.doc_id, round(r.score, 6)) for r in got.collect()) == sorted(want)


def test_recall(spark, tmp_path):
    """With the number of lists that the trials tell, other questions find their share; a bound leaves lists out."""
    unit = [(i, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v in POINTS]
    index = vector_index.build(spark.createDataFrame(unit, VECTOR), str(tmp_path / "v"), 12)
    probes, share = vector_index.probes_for(index, 5, 0.95, trials=100)
    assert 1 <= probes < 12 and share >= 0.95
    q = spark.createDataFrame(unit[::7], "qid long, vector array<float>")
    exact = {(r.qid, r.doc_id) for r in vector_index.search(index, q, 5).collect()}
    found = {(r.qid, r.doc_id) for r in vector_index.search(index, q, 5, probes).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_empty_index(spark, tmp_path):
    index = vector_index.build(spark.createDataFrame([], VECTOR), str(tmp_path / "v"))
    q = spark.createDataFrame([(1, [1.0])], "qid long, vector array<float>")
    assert vector_index.search(index, q, 3).collect() == [] and vector_index.probes_for(index, 3) == (1, 1.0)


def test_registered_recall(spark, sf):
    from arbiter.queries import QUERIES

    r = QUERIES["vector_index_recall"](spark, sf).first()
    assert r.n == 50 and r.recall >= 0.9
