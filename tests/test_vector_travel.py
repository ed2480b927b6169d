"""Vectors travel once for each piece and block of questions, which are as large as a task may hold."""

import numpy as np
import pytest

from arbiter.operators import vector_index


@pytest.mark.parametrize("products", [vector_index.PRODUCTS, 700])
def test_few_copies_and_all_pairs(spark, tmp_path, monkeypatch, products):
    monkeypatch.setattr(vector_index, "PRODUCTS", products)
    x = np.random.default_rng(2).normal(size=(6000, 4)).round(3)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vector array<double>").repartition(3)
    index = vector_index.build(vectors, str(tmp_path / "index"), 2)
    q, blocks = vector_index._questions(index, vectors.withColumnRenamed("doc_id", "qid"))
    assert blocks == 1 and index.lists.pieces.tolist() == [1, 1] and vector_index._piece(1000) == 2000
    some = vectors.where("doc_id % 97 = 0").withColumnRenamed("doc_id", "qid")
    got = {(r.qid, r["rank"]): (r.doc_id, r.score) for r in vector_index.search(index, some, 2).collect()}
    for i in range(0, 6000, 97):
        s = np.floor(x @ x[i] * 1e6 + 0.5)
        best = np.lexsort((np.arange(6000), -s))[:2]
        assert [got[i, 1][0], got[i, 2][0]] == best.tolist()
