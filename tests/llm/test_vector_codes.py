"""Vector codes against Lloyd's rounds one by one, and the kd-tree against all distances."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arbiter.llm import queries, vector_codes

RNG = np.random.default_rng(5)
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, tuple(float(np.float32(x)) for x in v), label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max((len(v) for _, v, _ in kept), default=0)
    w = -(-longest // parts)
    ints = [[math.floor(x * scale) for x in v] + [0] * (w * parts - len(v)) for _, v, _ in kept]
    cut = [[tuple(x[p * w : p * w + w]) for p in range(parts)] for x in ints]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for x in cut:
                members[nearest(p, x[p])[1]].append(x[p])
            books[p] = [tuple(sum(c) // len(members[k]) for c in zip(*members[k], strict=True)) if k in members else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    coded = [[nearest(p, x[p]) for p in range(parts)] for x in cut]
    errors, by_label = [sum(d for d, _ in c) for c in coded], Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    return Counter((i, "".join(f"{k:02x}" for _, k in c), e, by_label[label], sha) for (i, _, label), c, e in zip(kept, coded, errors, strict=True))


def fixture():
    rows = [(RNG.normal(size=24) * 0.2).tolist() for _ in range(150)] + [RNG.integers(-2, 3, 24).astype(float).tolist() for _ in range(60)]
    rows += [rows[0]] * 40 + [[0.0] * 24] * 10 + [[1.0] * 5, [], None, [1.0, None], [float("nan")] * 24, [float("-inf")] * 24]
    out = [(int(i), v, [None, 1, 2][k % 3]) for k, (i, v) in enumerate(zip(RNG.permutation(len(rows)) + 3, rows, strict=True))]
    return [*out, (None, rows[5], 1), (None, rows[6], None), (4, rows[7], 2), (4, rows[8], 2)]


ROWS = fixture()


@pytest.mark.parametrize("held", [None, 64])
def test_against_rounds_one_by_one(spark, monkeypatch, held):
    if held:
        monkeypatch.setattr(vector_codes, "ROWS", held)
    table = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for c in ("v", "code", "error", "ids", "labels", "trees", "part", "rows", "label_error"):
        table = table.withColumn(c, F.lit(c))
    out = vector_codes.code_digests(table)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, out.collect())) == brute(ROWS)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 100, 1000])
def test_filtering_is_exact(n):
    """Ties go to the first entry, in whole subtrees too; every row is assigned once."""
    for spread in (1, 3, 50):
        x, entries = RNG.integers(-spread, spread + 1, (n, 3)), RNG.integers(-spread, spread + 1, (11, 3))
        tree = vector_codes.Tree.unpacked(vector_codes.Tree(x).packed())
        got, sums = np.full(n, -1), np.zeros((11, 3), np.int64)
        whole = 0
        for entry, starts, ends, total in tree.filtered(entries):
            np.add.at(sums, entry, total)
            for e, s, t in zip(entry, starts, ends, strict=True):
                assert (got[tree.order[s:t]] == -1).all()
                got[tree.order[s:t]] = e
                whole += t - s > 1
        want = ((x[:, None] - entries[None]) ** 2).sum(2).argmin(1)
        assert (got == want).all()
        assert all((sums[e] == x[want == e].sum(0)).all() for e in range(11))
        assert whole or n < 1000 or spread == 50


def test_few_rows_empty_tables_and_large_numbers(spark):
    few = ROWS[:5]
    assert Counter(map(tuple, vector_codes.code_digests(spark.createDataFrame(few, SCHEMA)).collect())) == brute(few)
    nothing = [(1, None, 1), (2, [None], 2)]
    assert vector_codes.code_digests(spark.createDataFrame(nothing, SCHEMA)).collect() == []
    assert vector_codes.code_digests(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(OverflowError):
        vector_codes.code_digests(spark.createDataFrame([(1, [1e30] * 8, 1)], SCHEMA))


def test_sql(spark, sf, duck, tmp_path):
    rows = [r for r in ROWS if r[0] is not None and (r[1] is None or len(r[1]) in (1, 24))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for folder, db in ((str(tmp_path), con), (sf, duck)):
        got = Counter(map(tuple, queries.op13_vector_codes(spark, folder).collect()))
        assert got == Counter(db.execute(queries.ORACLE["op13_vector_codes"]).fetchall())
        assert got
