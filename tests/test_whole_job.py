"""Queries that once read only a part of their tables, against SQL or counts over all of it."""

import math
import re
from collections import Counter

import pytest

from arbiter.plans import relevance_queries as R
from arbiter.queries import QUERIES

WORD = re.compile(r"[^\w\s]")


def _l2(text):
    return [t for t in WORD.sub(" ", text.lower()).split() if re.fullmatch("[a-z]{2,}", t)]


def _documents(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def _parts(text):
    w = re.split(r"\s+", text)
    a, b = len(w) // 3, 2 * len(w) // 3
    return [" ".join(w[:a]), " ".join(w[a:b]), " ".join(w[b:])]


TEXTS = ["alpha beta gamma " * 100 + "delta " * 300 + "alpha omega " * 150, "one two three two", "x", "", "alpha delta omega beta one two", "pad " * 400 + "tail end words"]


def test_gaps_read_whole_texts_of_all_documents(spark, tmp_path):
    d = _documents(spark, tmp_path, TEXTS)
    thirds = [[_l2(t) for t in _parts(t)] for t in TEXTS]
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0
    got = {r["id"]: r for r in R.jaccard_gap(spark, d).collect()}
    assert len(got) == len(TEXTS)
    for k, (q, a, b) in enumerate(thirds):
        assert Counter(q + a + b) == Counter(_l2(TEXTS[k]))
        assert math.isclose(got[k]["q_disclosure"], jac(q, a), abs_tol=1e-6)
        assert math.isclose(got[k]["q_patch"], jac(q, b), abs_tol=1e-6)
    assert got[0]["q_patch"] > 0  # the words after the 600th character count

    def bm25(side):
        corpus = [t[side] for t in thirds]
        avg = sum(map(len, corpus)) / len(corpus)
        df = Counter(w for c in corpus for w in set(c))
        out = []
        for (q, *_), c in zip(thirds, corpus, strict=True):
            tf = Counter(c)
            out.append(sum(math.log((len(corpus) - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(c) / avg)) for w in set(q) if tf[w]))
        return out

    a, b = bm25(1), bm25(2)
    row = R.bm25_gap(spark, d).first()
    assert row["n"] == len(TEXTS)
    assert math.isclose(row["mean_a"], sum(a) / len(a), abs_tol=1e-5)
    assert math.isclose(row["mean_b"], sum(b) / len(b), abs_tol=1e-5)
    assert row["pct_positive"] == round(100 * sum(x > y for x, y in zip(a, b, strict=True)) / len(a), 1)


@pytest.mark.parametrize("name", ["audit_rerank", "probe_rerank", "probe_rerank_plain"])
def test_rerankers_keep_the_tail(spark, sf, name):
    from arbiter.plans import graph_queries as G

    every = {(r["user_id"], r["event_id"]) for r in G.events(spark, sf).collect()}
    got = [(r["qid"], r["doc_id"]) for r in QUERIES[name](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) >= every
