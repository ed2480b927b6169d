"""Pages whose columns are wanted are parsed once, and give what rows of tables joined with their headers give."""

from arbiter.operators import html_tables

PAGE = "<table><tr><th>Name</th><th>Old name</th><th>Age</th></tr><tr><td>a</td><td>b</td><td>3</td></tr><tr><td>c</td></tr></table><table></table><table><tr><td>Age</td></tr><tr><td>1</td></tr></table>"


def test_once(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>"), (4, PAGE * 2)], "page_id long, html string")
    wanted = {"name": ("name", "old"), "age": ("age", None)}
    got = html_tables.page_columns(pages, wanted)
    assert got.columns == html_tables.columns(html_tables.tables(pages), wanted).columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, html_tables.columns(html_tables.tables(pages), wanted).collect())) != []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
