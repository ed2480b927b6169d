"""Stored pages as batch and stream, the sink that takes a batch once, tables in HTML, and many patterns at once."""

import json
import random

import pytest
from pyspark.sql import functions as F

from arbiter.operators import html_tables, lookups, patterns
from arbiter.sources import paged


def put(root, series, number, records):
    (root / series).mkdir(parents=True, exist_ok=True)
    (root / series / f"page-{number:04}.json").write_text(json.dumps(records))


def rows(df):
    return sorted((r.series, r.page, r.place, json.loads(r.record)["id"]) for r in df.collect())


def test_batch_and_stream_give_the_same_rows_after_a_stop(spark, tmp_path):
    spark.dataSource.register(paged.PagedSource)
    root, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    put(root, "high", 1, [{"id": 1}, {"id": 2}])
    put(root, "high", 2, {"items": [{"id": 3}]})
    put(root, "low", 1, [])
    put(root, "low", 3, [{"id": 99}])  # page 2 isn't there yet

    def run():
        stream = spark.readStream.format("stored_pages").option("path", str(root)).option("maxPagesPerBatch", 1).load()
        query = stream.writeStream.foreachBatch(lambda b, n: paged.write_once(b, n, out) and None).option("checkpointLocation", ck).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run()
    assert [r[3] for r in rows(paged.committed(spark, out))] == [1, 2, 3]
    put(root, "low", 2, [{"id": 4}, {"id": 5}])
    put(root, "high", 3, [{"id": 6}])
    run()
    batch = spark.read.format("stored_pages").option("path", f"file://{root}").load()
    assert rows(paged.committed(spark, out)) == rows(batch)
    assert sorted(r[3] for r in rows(batch)) == [1, 2, 3, 4, 5, 6, 99]


def test_a_batch_is_written_once(spark, tmp_path):
    path = str(tmp_path)
    first = spark.createDataFrame([(1,), (2,)], "x long")
    assert paged.write_once(first, 0, path)
    assert not paged.write_once(first, 0, path)  # a replay

    @F.udf("long")
    def fails(x):
        raise ValueError

    with pytest.raises(Exception):
        paged.write_once(first.select(fails("x").alias("x")), 1, path)
    assert paged.committed(spark, path).count() == 2
    assert paged.write_once(first, 1, path)
    assert paged.write_once(first.limit(0), 2, path)
    assert sorted(map(tuple, paged.committed(spark, path).collect())) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert not (tmp_path / "staged" / "1").exists()


PAGE = """<p>no</p><table class=w><tr><th>Overruled <b>case</b></th><th colspan=2>Overruling case</th><th>Year</th></tr>
<tr><td rowspan="2">A v. B</td><td>C v.&nbsp;D<br>cited</td><td>x</td><td>1900<script>var a = "<td>";</script></td></tr>
<tr><td>E &amp; F</td><td>y<table><tr><td>inner</td></tr><tr><td rowspan=0>deep</td><td>1</td></tr><tr><td>2</td></tr></table></td><td>1910</td></tr>
<tr><td>short</td></tr></table><table></table><table><tr><td>only"""


def test_tables(spark):
    grids = html_tables.parse(PAGE)
    assert grids[0] == [
        ["Overruled case", "Overruling case", "Overruling case", "Year"],
        ["A v. B", "C v. D cited", "x", "1900"],
        ["A v. B", "E & F", "y", "1910"],
        ["short"],
    ]
    assert grids[1:] == [[["inner"], ["deep", "1"], ["deep", "2"]], [], [["only"]]]
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (None, "<table><tr><td>n")], "page_id long, html string")
    every = html_tables.tables(pages)
    assert every.count() == 4 + 3 + 1 + 1
    out = html_tables.columns(every, {"old": ("overrul", "overruling"), "new": ("overruling", None), "year": ("year", None)})
    assert sorted(map(tuple, out.collect())) == [(1, 0, 1, "A v. B", "C v. D cited", "1900"), (1, 0, 2, "A v. B", "E & F", "1910")]


def test_many_patterns(spark, monkeypatch):
    rng = random.Random(2)
    names = {"".join(rng.choice("abcé \U0001f600") for _ in range(rng.randrange(1, 9))) for _ in range(300)}
    texts = [(i, "".join(rng.choice("abcé \U0001f600") for _ in range(rng.randrange(0, 60)))) for i in range(80)] + [(80, None), (3, "abc")]
    want = sorted((q, p) for q, t in texts for p in names if t and p in t)
    monkeypatch.setattr(patterns, "PATTERNS", 70)
    monkeypatch.setattr(patterns, "TEXTS", 30)
    t = spark.createDataFrame(texts, "qid long, text string")
    p = spark.createDataFrame([(n,) for n in [*names, None, ""]], "pattern string")
    assert sorted(map(tuple, patterns.occurrences(t, p).collect())) == want
    assert patterns.occurrences(t.limit(0), p).collect() == patterns.occurrences(t, p.limit(0)).collect() == []


def test_probe_with_a_hundred_thousand_names(spark):
    """An index of 10^5 products; questions name some of them, inside other words too."""
    index = spark.range(100_000).select(F.concat(F.lit("Product-"), F.col("id")).alias("product"), F.concat(F.lit("CVE-2024-"), F.col("id") + 1000).alias("cve_id"), F.col("id").alias("doc_id"))
    asked = [(i, f"is product-{i * 7} hit by cve-2024-{i * 7 + 1000}?") for i in range(300)] + [(300, "nothing named"), (301, None)]
    out = lookups.probe_with_applicability(spark.createDataFrame(asked, "qid long, query string"), index)
    got = {r.qid: (r.applicable, r.doc_id) for r in out.collect()}
    assert got == {**{i: (True, i * 7) for i in range(300)}, 300: (False, None), 301: (False, None)}
