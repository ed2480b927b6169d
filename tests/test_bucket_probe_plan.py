"""What is later than a candidate is asked of plain columns: a filter on the candidate's rank could be moved below the join."""

from arbiter.operators import evaluation


def test_no_filter_by_lambdas(spark):
    initial = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "qid long, doc_id long, rank int")
    events = spark.createDataFrame([(1, 5), (2, 3), (3, 4), (4, None)], "event_id long, ts long")
    found = spark.createDataFrame([(1, 3, 4), (1, 1, 5), (1, 4, None), (1, 9, 3)], "qid long, event_id long, ts long")
    out = evaluation.bucket_probe(initial, found, events, 20)
    assert list(map(tuple, out.collect())) == [(1, 3, 1)]
    assert "isnotnull(array_min" not in out._jdf.queryExecution().optimizedPlan().toString()
