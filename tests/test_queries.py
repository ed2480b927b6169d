import pytest
from conftest import plain

from arbiter.queries import ORACLE, QUERIES


#: Queries that SQL can't express; they are held against brute force elsewhere.
WITHOUT_SQL = {"vector_index_recall", "systems_eval", "systems_rollup", "domain_systems_eval"}


def test_all_others_have_sql():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf, duck, name):
    out = QUERIES[name](spark, sf).toPandas()
    want = duck.execute(ORACLE[name]).df()
    assert sorted(out.columns) == sorted(want.columns)
    assert plain(out) == plain(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["qid", "rank", "doc_id", "score"]
