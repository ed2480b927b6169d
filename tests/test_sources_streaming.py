import json

import pytest
from pyspark.sql import functions as F

from arbiter.operators import graph
from arbiter.plans.rules import EVENTS
from arbiter.sources import io
from arbiter.streaming import frontier


def test_examples_to_corpus(spark, tmp_path):
    ex = [
        {"example_id": "a", "hop_type": "type1_x", "employee": "E", "ticker": "T", "kb": [{"event_id": "e1", "text": "one", "event_type": "t", "timestamp": "2024-01-01"}, {"text": "two", "event_type": "u"}], "provenance": [{"event_id": "e1"}]},
        {"example_id": "b", "hop_type": "type2", "employee": "F", "ticker": "U", "kb": [{"event_id": "e1", "text": "later"}], "provenance": []},
    ]
    (tmp_path / "ex.jsonl").write_text("\n".join(map(json.dumps, ex)))
    (tmp_path / "ids.txt").write_text("a\nb c")
    e, corpus = io.load_corpus(spark, str(tmp_path / "ex.jsonl"), str(tmp_path / "ids.txt"), hop_type="type1")
    assert [r["gold_id"] for r in e.collect()] == ["e1"]
    assert {(r["doc_id"], r["text"]) for r in corpus.collect()} == {("e1", "one"), ("a_u", "two")}
    with pytest.raises(Exception):
        io.load_corpus(spark, str(tmp_path / "ex.jsonl"), str(tmp_path / "none.txt"))[0].collect()


def test_cache_last_line_wins_and_resume(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "1", "query": "old"}\n{"id": "2", "query": "x"}\n{"id": "1", "query": "new"}\n')
    assert {tuple(r) for r in io.query_cache(spark, str(tmp_path / "c.jsonl")).collect()} == {("1", "new"), ("2", "x")}
    src = spark.createDataFrame([("1",), ("9",)], "id string")
    assert [r["id"] for r in io.resume(src, spark, str(tmp_path / "c.jsonl"), "id string").collect()] == ["9"]
    (tmp_path / "a.json").write_text('[{"id": "p"}, {"id": "q"}]')
    assert io.json_array(spark, str(tmp_path / "a.json"), io.PAIR).count() == 2
    io.append_jsonl(src, str(tmp_path / "out"))
    io.append_jsonl(src, str(tmp_path / "out"))
    assert spark.read.schema("id string").json(str(tmp_path / "out")).count() == 4
    io.write_report(src, src, str(tmp_path / "report"))
    assert [r["c"] for r in io.completions(src, "id", str.upper, "c").collect()] == ["1", "9"]


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").where("user_id < 6").select("event_id", "event_type", "ts", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _stream(spark, df, path):
    df.repartition(3).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


RULES = [r for r in EVENTS if r.scope == ("user_id",)]


def test_latest_per_scope_stream(spark, sf, tmp_path):
    ev = _events(spark, sf)
    q = frontier.latest_per_scope(_stream(spark, ev, str(tmp_path / "in")), ["user_id"]).writeStream.outputMode("complete").format("memory").queryName("latest_of").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["user_id"]: r["event_id"] for r in spark.table("latest_of").collect()}
    want = {r["user_id"]: r["e"] for r in ev.groupBy("user_id").agg(F.max_by("event_id", "ts").alias("e")).collect()}
    assert got == want


def test_batch_writer_is_order_free(spark, sf):
    ev = _events(spark, sf)
    seen, got = [], []

    def history():
        return seen[0] if seen else ev.limit(0)

    run = frontier.frontier_writer(RULES, ["user_id"], history, lambda df, n: got.append({r["event_id"] for r in df.collect()}))
    late, early = ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1")
    run(late, 0)
    seen.append(late)
    run(early, 1)
    assert got[-1] == {r["event_id"] for r in graph.active(ev, RULES).collect()}
