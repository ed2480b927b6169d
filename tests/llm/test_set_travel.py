"""Of the n-gram join, sets travel only to groups where their bitmap has a partner, and none that is similar stays behind."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from arbiter.llm import common, ngram_join
from arbiter.llm.common import Workspace


def test_sets_that_only_share_a_passage_do_not_travel(spark, monkeypatch):
    r = random.Random(4)
    passages = [" ".join(f"p{k}w{i}" for i in range(50)) for k in range(40)]
    texts = [" ".join(r.sample(passages, 8)) for _ in range(300)]
    rows = [*enumerate(texts), (300, texts[7] + " end"), (301, texts[7])]
    saved, save = [], Workspace.save

    def kept(self, df):
        saved.append((df.columns, out := save(self, df)))
        if {"class", "row", "hubs"} <= set(df.columns):
            counts.append(out.count())
        return out

    counts = []
    monkeypatch.setattr(Workspace, "save", kept)
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 7 if k > 299 else k for k, _ in rows}
    assert max(counts) > 200 and counts[-1] == 2


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


@pytest.mark.parametrize("chunks", [1, 3])
@pytest.mark.parametrize("size", [1, 4, 9, 70, 129, 900])
def test_bitmaps_keep_every_similar_pair(size, chunks):
    r = random.Random(size)
    base = [r.getrandbits(64) for _ in range(size)]
    sets, group = [], []
    for k in range(70):
        s = {x for x in base if r.random() > 0.04 * (k % 8)} | {r.getrandbits(64) for _ in range(r.randrange(2 + size // 6))} or {base[0]}
        x = np.array(sorted(s), np.uint64)
        sets.append(s)
        group.append(ngram_join.Candidate(k, len(x), [5, 9] if k % 7 else [9], ngram_join.bitmap(x).tobytes(), k % chunks))
    cells = [group] if chunks == 1 else [[c for c in group if c.chunk in (a, b)] for a in range(chunks) for b in range(a, chunks)]
    found = {row for cell in cells for row in ngram_join.promising(9, cell)}
    charged = [(a, b) for a in range(70) for b in range(a) if min(group[a].hubs & group[b].hubs) == 9]
    real = {k for a, b in charged if similar(sets[a], sets[b]) for k in (a, b)}
    assert real <= found
    far = {k for k in range(70) if not any(k in p and 5 * len(sets[p[0]] & sets[p[1]]) >= 3 * len(sets[p[0]] | sets[p[1]]) for p in charged)}
    assert size < 70 or not far & found


def test_bitmaps_do_not_grow_faster_than_sets():
    for n in (1, 3, 4, 5, 64, 65, 1000, 20_000):
        x = np.sort(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
        bits = ngram_join.bitmap(x)
        assert len(bits) == max(1, 1 << (2 * n - 1).bit_length() >> 3) and len(bits) <= max(1, 8 * n / 16)
        small = np.unique(x & np.uint64(max(8, 4 * len(bits)) - 1))
        assert np.bitwise_count(ngram_join.folded(bits, max(1, len(bits) // 2))).sum() == len(small)


def test_sketch_adds_blocks_of_several_widths(spark):
    blocks = [(k, np.full(ngram_join._BLOCK, v)) for k, v in ((0, 1), (0, 300), (0, 70_000), (2, 255), (2, 255))]
    rows = [(k, bytearray(ngram_join._packed(b))) for k, b in blocks]
    assert [len(b) // ngram_join._BLOCK for _, b in rows] == [1, 2, 4, 1, 1]
    counts = ngram_join.sketch_of(spark.createDataFrame(rows, "block int, counts binary"))
    assert Counter(counts.tolist()) == {70_301: ngram_join._BLOCK, 510: ngram_join._BLOCK, 0: (1 << ngram_join.SKETCH) - 2 * ngram_join._BLOCK}


@pytest.mark.parametrize("group", [1, 400, None])
def test_groups_dealt_to_chunks_without_their_hub(spark, monkeypatch, group):
    """The class that names a group may have no partner in it; another one leads the chunks then."""
    if group:
        monkeypatch.setattr(ngram_join, "GROUP", group)
    r = random.Random(6)
    passages = [" ".join(f"q{k}w{i}" for i in range(30)) for k in range(12)]
    texts = [" ".join(r.sample(passages, 4)) for _ in range(60)]
    texts += [t + " tail" for t in texts[:25]] + ["head " + t for t in texts[10:30]]
    rows = list(enumerate(texts))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    home = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if similar(sets[a], sets[b]):
                x, y = sorted((home[a], home[b]))
                home = [x if h == y else h for h in home]
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(home)) and len(set(home)) < 60


def test_rows_carry_one_bitmap_of_each_class():
    batch = pa.record_batch([pa.array([1, 2, 3, 4]), pa.nulls(4).cast(pa.binary()), pa.array([7, 7, 8, 9]), pa.array(["a b c", "a  b c", "d", None])], names=["doc_id", "key", "hash", "text"])
    rows = [x for b in ngram_join._rows(iter([batch])) for x in b.to_pylist() if x["block"] is None]
    assert [x["bits"] is not None for x in rows] == [True, False, True, False]


@pytest.mark.parametrize("limit", [0, 1000])
def test_texts_are_fetched_whatever_is_broadcast(spark, monkeypatch, limit):
    """With 1,000 bytes the classes are too many to be broadcast and their hashes are not; with none, neither is."""
    monkeypatch.setattr(common, "BROADCAST_LIMIT", limit)
    words = [[f"k{k}w{i}" for i in range(60)] for k in range(10)]
    rows = [(3 * k + j, " ".join(["x"] * (j == 1) + w + ["y"] * (j == 2))) for k, w in enumerate(words) for j in range(3)]
    rows += [(None, rows[4][1]), (4, rows[4][1]), (100, "alone " * 20)]
    got = Counter((x["doc_id"], x["component_id"]) for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((d, 3 if d is None else d if d == 100 else d - d % 3) for d, _ in rows)
