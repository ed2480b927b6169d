"""Lookups, evaluations as one plan, and functions that no registered query reads."""

import math
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from arbiter.functions import text as T
from arbiter.operators import etl, lookups, relevance, synth
from arbiter.plans import adapters


def test_containing_finds_every_substring(spark):
    docs = [(0, "the old red fox ran home today"), (1, "an old  red fox"), (2, ""), (3, None), (4, "xold red foxes"), (5, "fox")]
    asked = [(0, "old red fox"), (1, "fox"), (2, "red fox"), (3, "ld red fo"), (4, "d  red f"), (5, " "), (6, ""), (7, None), (8, "old red")]
    got = relevance.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "qid long, query string"))
    assert Counter(map(tuple, got.collect())) == Counter((q, d) for q, p in asked if p is not None for d, t in docs if t is not None and p in t)


def test_rank_by_count_equals_sorting(spark):
    found = spark.createDataFrame([(q, d, float((d * 7 + q) % 5)) for q in range(4) for d in range(12)], "qid long, doc_id long, score double")
    gold = spark.createDataFrame([(0, 3), (0, 11), (1, 5), (3, 0), (2, 99), (7, 1)], "qid long, doc_id long")
    a = relevance.rank_by_count(found, gold, 12).collect()
    b = relevance.rank_of(relevance.ranked(found), gold, 12).collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))


def test_first_ranks_equal_whole_rankings(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], None if i % 7 == 0 else str(i % 3)) for i in range(40)], "doc_id long, x string, y string")
    asked = spark.createDataFrame([(1, "a", "1"), (2, "b", None), (3, "z", "9"), (4, "a", "2")], "qid long, x string, y string")
    gold = spark.createDataFrame([(1, 5, 2), (1, 3, 9), (2, 0, 1), *((3, i, 40 - i) for i in range(30))], "qid long, doc_id long, pos int")
    for k in (1, 3, 10):
        got = relevance.entity_probe(docs, asked, ["x", "y"], k).select("qid", "doc_id", "rank")
        want = relevance.entity_probe(docs, asked, ["x", "y"]).where(F.col("rank") <= k).select("qid", "doc_id", "rank")
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
        got, want = relevance.oracle_rank(docs, gold, k), relevance.oracle_rank(docs, gold).where(F.col("rank") <= k)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_scoped_equals_filtering_all_pairs(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], None if i % 7 == 0 else str(i % 3)) for i in range(20)], "doc_id long, x string, y string")
    asked = spark.createDataFrame([(1, "a", "1"), (2, "b", None), (3, "", "2"), (4, None, None)], "qid long, x string, y string")
    pairs = docs.crossJoin(asked.select("qid"))
    for need_all in (True, False):
        want = Counter(map(tuple, etl.scope_filter(pairs, asked, ["x", "y"], need_all).select("qid", "doc_id").collect()))
        assert Counter(map(tuple, etl.scoped(docs, asked, ["x", "y"], need_all).collect())) == want
    n = {r["qid"]: r["n"] for r in etl.scoped_counts(docs, asked, ["x", "y"]).collect()}
    want = {r["qid"]: r["n"] for r in etl.scoped(docs, asked, ["x", "y"], True).groupBy("qid").agg(F.count("*").alias("n")).collect()}
    assert n == want


def test_okapi_floors_frequent_terms(spark):
    texts = ["a a b", "a c", "a d d", "e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in relevance.okapi_scores(docs, spark.createDataFrame([(0, "a d d")], "qid long, query string")).collect()}
    toks = [t.split() for t in texts]
    df = Counter(w for t in toks for w in set(t))
    idf = {w: math.log(4 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    avg = sum(map(len, toks)) / 4
    for k, t in enumerate(toks[:3]):
        want = sum((floor if idf[w] < 0 else idf[w]) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in "add" if w in t)
        assert math.isclose(got[k], want, abs_tol=1e-6)
    assert set(got) == {0, 1, 2}


def test_known_names_are_the_longest(spark):
    asked = spark.createDataFrame([(1, "is Red-Hat fine"), (2, "ab"), (3, "nothing"), (4, None), (5, "x and xy")], "qid long, query string")
    names = spark.createDataFrame([("red",), ("red-hat",), ("hat",), ("AB",), ("x",), ("",), (None,), ("thing",)], "name string")
    assert {r["qid"]: r["name"] for r in lookups.known_names(asked, names).collect()} == {1: "red-hat", 2: "ab", 3: "thing", 5: "x"}


def test_text_functions_without_queries(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    assert one(T.clean_text(F.lit("1.2 USES AND DOSES\nfor  the\nflu")))[0] == "for the flu"
    assert one(T.first_indication(F.lit("INDICATIONS AND USAGE Aldorin, is for the flu"), F.lit("Aldorin")))[0] == "is for the flu"
    assert one(T.mask_names(F.lit("ALDORIN and aldorin help. "), [F.lit("Aldorin"), F.lit("")]))[0] == "this drug and this drug help"
    assert one(T.citation_year(F.lit("12 U.S. 3 (1999)")), T.citation_year(F.lit("none")))[:] == ("1999", "2010")
    assert one(lookups.iso_time(F.lit("2024-02-28T10:00:00"), 2), lookups.iso_time(F.lit("no"), 2))[:] == (datetime(2024, 3, 1, 10), None)
    affected = spark.read.json(spark.sparkContext.parallelize(['{"affected": [{"ranges": [{"events": [{"introduced": "0", "fixed": null}, {"fixed": "1.2"}]}, {"events": [{"fixed": "1.2"}, {"fixed": ""}, {"fixed": "2.0"}]}]}]}']))
    assert affected.select(T.fixed_versions("affected")).first()[0] == ["1.2", "2.0"]
    d = spark.createDataFrame([([("de", "x"), ("en", "y"), ("en", "z")], ["cpe:2.3:a:own:my_app:1", "cpe:2.3:a:b:*"])], "d array<struct<lang: string, value: string>>, c array<string>")
    assert d.select(T.first_english("d"), T.cpe_product("c")).first()[:] == ("y", "my app")


def test_splits_picks_and_adapters(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    split = {r["split"]: r["count"] for r in etl.hash_split(rows, "k").groupBy("split").count().collect()}
    assert sum(split.values()) == 1000 and 150 < split["test"] < 250
    assert etl.hash_split(rows, "k").exceptAll(etl.hash_split(rows.orderBy(F.rand(1)), "k")).isEmpty()
    bucket = spark.createDataFrame([(1, 5), (1, 3), (2, 9), (None, 1)], "s int, v int")
    assert Counter(map(tuple, synth.scope_pick(bucket, ["s"], F.col("v")).collect())) == Counter([(1, 3), (2, 9), (None, 1)])
    records = spark.createDataFrame([(1, "user", 1, "c"), (2, "assistant", 2, "c"), (3, "assistant", 1, "d")], "doc_id long, record_type string, ts long, conv_id string")
    ranking = spark.createDataFrame([(7, 3, 1), (7, 1, 2)], "qid long, doc_id long, rank long")
    out = adapters.make_pipeline(records, "conversation")(ranking)
    assert [(r["doc_id"], r["rank"], r["tier"]) for r in out.orderBy("rank").collect()] == [(2, 1, 0), (3, 2, 1), (1, 3, 1)]
    assert "okapi" in adapters.RETRIEVERS


def test_entry_point_without_the_subpackage(tmp_path):
    """With the folders of the training-data operators deleted, the rest still imports, whether the pipeline's file is there or not."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "arbiter", tmp_path / "arbiter", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_top5' in q and not any(n.startswith('op1_') or n == 'pipeline' for n in q)"
    for step in range(2):
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), **{k: v for k, v in __import__("os").environ.items() if k in ("JAVA_HOME", "HOME")}})
        assert done.returncode == 0, done.stderr[-2000:]
        if (root / "corpus_pipeline.py").exists():
            shutil.copy(root / "corpus_pipeline.py", tmp_path)
        assert step < 2
