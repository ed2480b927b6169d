"""The epsilon grid order join against all pairs, and its parts."""

import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arbiter.llm import common, epsilon_join, queries

RNG = np.random.default_rng(3)
SCHEMA = "vec_id long, embedding array<float>, label int"


def cosine_at_least(a, b, least=Fraction(0.95)):
    x, y = [Fraction(v) for v in a], [Fraction(v) for v in b]
    dot = sum(p * q for p, q in zip(x, y, strict=True))
    return dot > 0 and dot**2 >= least**2 * sum(p * p for p in x) * sum(q * q for q in y)


def brute(rows, least=0.95):
    vectors = [None if r[1] is None or any(x is None or not np.isfinite(x) for x in r[1]) or not any(r[1]) else np.float32(r[1]).astype(float) for r in rows]
    n, home = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if a is None or b is None or len(a) != len(b):
                continue
            rough = (a / np.linalg.norm(a)) @ (b / np.linalg.norm(b))
            if rough > least + 1e-9 or rough > least - 1e-9 and cosine_at_least(a, b, Fraction(least)):
                n[i], n[j] = n[i] + 1, n[j] + 1
                home[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return Counter((r[0], n[i], low.get(find(i)), r[0] is not None and r[0] == low.get(find(i))) for i, r in enumerate(rows))


def vectors(n, d, noise, groups):
    centres = RNG.normal(size=(groups, d))
    return [(centres[k % groups] * RNG.uniform(0.1, 9) + RNG.normal(size=d) * noise).tolist() for k in range(n)]


def fixture():
    rows = vectors(140, 12, 0.25, 9) + vectors(60, 12, 0.02, 1) + vectors(40, 5, 0.3, 3) + vectors(12, 1, 0.1, 2)
    rows += [[3.0, 4.0] + [0.0] * 10, [0.0] * 12, [-0.0, 1.0], [0.0, 1.0], [0.0, -1.0], [], None, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1e-30, 1e-30], [3e38, 3e38]]
    rows += [rows[0]] * 30 + [rows[150]] * 5
    # cosines of exactly 0.95, and just below and above
    rows += [[1.0, 0.0, 0.0], [0.95, 0.3122498999199199, 0.0], [19.0, 6.2449979984, 0.0], [19.0, 6.244998, 0.0], [20.0, 0.0, 0.0]]
    out = [(i, v, i % 3) for i, v in enumerate(rows)]
    random.Random(1).shuffle(out)
    return [*out, (None, rows[3], 1), (None, vectors(1, 12, 1, 1)[0], 1), (7, rows[60], None), (7, rows[60], None)]


ROWS = fixture()


@pytest.fixture(scope="module")
def table(spark):
    d = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for c in ("v", "d", "row", "unit", "cells", "weight", "first_id", "component", "size", "usable"):
        d = d.withColumn(c, F.lit(c))
    return d


@pytest.mark.parametrize(("unit", "block", "share"), [(None, None, None), (1, 4, 5), (1, 16, 1000)])
def test_against_all_pairs(table, monkeypatch, unit, block, share):
    """In one unit, and in many small ones, with several levels of intervals."""
    if unit:
        monkeypatch.setattr(epsilon_join, "UNIT_BYTES", unit)
        monkeypatch.setattr(epsilon_join, "BLOCK", block)
        monkeypatch.setattr(common, "HOT_SHARE", share)
    out = epsilon_join.near_duplicates(table)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(map(tuple, out.collect())) == brute(ROWS)


def test_groups_that_are_near_altogether(spark, monkeypatch):
    """Tight groups over many units: whole intervals are linked without a comparison, and chains stay chains."""
    monkeypatch.setattr(epsilon_join, "UNIT_BYTES", 1)
    monkeypatch.setattr(epsilon_join, "BLOCK", 4)
    tight = vectors(150, 8, 0.0, 1)
    tight = [(np.array(tight[0]) + RNG.normal(size=8) * 0.001 * abs(tight[0][0])).tolist() for _ in tight]
    arc = [[float(np.cos(t)), float(np.sin(t))] + [0.0] * 6 for t in np.arange(0, 3.0, 0.05)]
    rows = [(int(i), v, 0) for i, v in zip(RNG.permutation(len(tight) + len(arc) + 60), tight + arc + vectors(60, 8, 1, 60), strict=True)]
    compared = []
    monkeypatch.setattr(epsilon_join, "_expand", lambda levels, e, w, f=epsilon_join._expand: compared.append(f(levels, e, w)) or compared[-1])
    got = epsilon_join.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert Counter(map(tuple, got.collect())) == brute(rows)
    assert compared[0][1].count() > 0


@pytest.mark.parametrize("least", [0.3, 1.0])
def test_other_thresholds(spark, least):
    rows = ROWS[:120]
    got = epsilon_join.near_duplicates(spark.createDataFrame(rows, SCHEMA), least)
    assert Counter(map(tuple, got.collect())) == brute(rows, least)


def test_empty_and_unusable(spark):
    assert epsilon_join.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (None, None, None)]
    assert Counter(map(tuple, epsilon_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())) == Counter([(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, False)])


def test_sql(spark, tmp_path):
    """The registered SQL over a table that has links."""
    rows = [r for r in ROWS if r[0] is not None and r[1] and all(x is not None for x in r[1]) and len(r[1]) == 12]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Counter(map(tuple, queries.op12_epsilon_join(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert Counter(con.execute(queries.ORACLE["op12_epsilon_join"]).fetchall()) == got
    assert max(n for _, n, _, _ in got) > 30
