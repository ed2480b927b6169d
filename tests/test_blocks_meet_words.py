"""Blocks of the stored index meet words and no questions, and a posting is a row once however many questions have its word."""

from arbiter.operators import relevance, stored_index


def test_as_many_blocks_for_many_questions(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"all w{i % 7} " + "x " * (i % 5)) for i in range(300)], "doc_id long, text string")
    stored_index.add(docs, str(tmp_path))
    asked = spark.createDataFrame([(i, f"all w{i % 7} x") for i in range(60)], "qid long, query string")
    every, needed = stored_index.needed_blocks(spark, str(tmp_path), asked, 5)
    one, _ = stored_index.needed_blocks(spark, str(tmp_path), asked.where("qid < 7"), 5)
    assert every.count() == one.count() >= needed.count() > 0
    found = stored_index.search(spark, str(tmp_path), asked, 5)
    rows = lambda df: sorted(map(tuple, df.select("qid", "rank", "doc_id", "score").collect()))
    assert rows(found) == rows(relevance.bm25(docs, asked, 5))
    assert "hashpartitioning(qid, doc_id" not in found._jdf.queryExecution().executedPlan().toString()
