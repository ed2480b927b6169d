"""The corpus of parts and distractors has all of its distractors, few suppliers or many."""

from arbiter.queries import QUERIES


def test_every_number_and_every_supplier_has_a_distractor(spark, sf):
    keys = {r["s_suppkey"] for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()}
    rows = QUERIES["security_corpus"](spark, sf).where("kind = 'distractor'").select("doc_id").collect()
    assert len(rows) >= 2000
    assert sorted(r["doc_id"] for r in rows) == sorted(3 * i + 2 for i in keys | set(range(2000)))
