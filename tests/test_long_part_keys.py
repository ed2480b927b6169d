"""Parts with keys of more than five digits: each has an identifier of its own."""

import duckdb
import pytest
from conftest import SF, plain

from arbiter.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", ["advisory_hits", "advisory_rates", "promoted_patches", "routed_pipeline"])
def test_equals_sql_with_long_part_keys(spark, tmp_path, name):
    con = duckdb.connect()
    first = f"SELECT * FROM '{SF}/part.parquet' WHERE p_partkey < 40"
    parts = " UNION ALL ".join(f"SELECT * REPLACE (p_partkey + {k} AS p_partkey) FROM ({first})" for k in (10000, 100000, 100001 + 40, 123400))
    con.execute(f"COPY ({parts}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    assert plain(QUERIES[name](spark, str(tmp_path)).toPandas()) == plain(con.execute(ORACLE[name]).df())
