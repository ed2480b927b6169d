"""Rows without ids, and ids with several texts, are no copies."""

import corpus_pipeline
from arbiter.llm import exact_dedup, ngram_join


def test_exact_dedup_keeps_one_row_of_every_text(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, "c"), (3, "another text of 3"), (None, "no id"), (None, "no id"), (None, "c"), (4, None), (5, ""), (3, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = exact_dedup.kept_documents(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a b"), (3, "c"), (3, "another text of 3"), (None, "no id"), (4, None)], key=str)
    assert exact_dedup.kept_documents(docs.limit(0)).collect() == []


def test_near_duplicates_keep_one_row_of_every_component(spark):
    words = " ".join(f"w{i}" for i in range(120))
    near = words.replace("w60", "x")
    rows = [(5, words), (2, near), (2, near), (2, "another text of two"), (None, words), (None, "no id"), (None, "no id"), (7, "no id two"), (None, None), (8, " "), (8, " "), (9, "another text of two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS class", "2 AS part", "3 AS row", "4 AS key")
    out = ngram_join.kept_documents(docs)
    assert out.columns == docs.columns
    want = [(2, near), (2, "another text of two"), (None, "no id"), (7, "no id two"), (None, None), (8, " "), (8, " ")]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)
    assert ngram_join.kept_documents(docs.limit(0)).collect() == []


def test_pipeline_on_rows_with_nulls_and_shared_ids(spark, tmp_path):
    """Every stage keeps what isn't toxic, a copy or a passage, whatever ids rows have; other columns go along."""
    words = lambda tag, n=60: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(1, words("a")), (1, words("b")), (None, words("c")), (None, words("c")), (4, words("a")), (5, None), (6, ""), (7, " \t"), (8, words("d").replace("d30", "x")), (9, words("d")), (10, f"{words('e', 20)} {words('passage', 55)} {words('f', 20)}"), (11, f"{words('g', 20)} {words('passage', 55)} {words('h', 20)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars", "1 AS spans", "2 AS digest", "3 AS class")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (None, 1), (99, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], (r["text"] or "").split()[:1]) for r in kept.collect()), key=str)
    assert got == sorted([(1, ["a0"]), (1, ["b0"]), (None, ["c0"]), (5, []), (7, []), (8, ["d0"]), (10, ["e0"]), (11, ["g0"])], key=str)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert "passage30" not in texts[10] + texts[11] and "f19" in texts[10] and "h19" in texts[11]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"]) for r in pieces if r["doc_id"] is not None) == [(1, 0), (1, 0), (5, 0), (7, 0), (8, 0), (10, 0), (11, 0)] and len(pieces) == 8
    empty = tmp_path / "none"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).collect() == []
