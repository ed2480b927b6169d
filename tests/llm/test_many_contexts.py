"""Repeats around one phrase that very many texts have: no task is given all of its contexts."""

import random
from collections import Counter

import pytest

from arbiter.llm import suffix_dedup

PHRASE = b"the phrase that stands in every one of these texts, always as it is here. "


def made(n, seed=3):
    """Texts with the phrase, some of which share long strings around it with others."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    left, right = [word(420) for _ in range(3)], [word(420) for _ in range(3)]
    texts = []
    for i in range(n):
        a = word(300) + (left[i % 7][-rng.randrange(420):] if i % 7 < 3 else word(rng.randrange(400)))
        b = (right[i % 5][: rng.randrange(420)] if i % 5 < 3 else word(rng.randrange(400))) + word(300)
        texts.append(a + PHRASE.decode() + b)
    return texts


def brute(texts, length=400):
    seen, data = {}, [t.encode() for t in texts]
    for i, b in enumerate(data):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((i, p))
    cover = [bytearray(len(b)) for b in data]
    for at in seen.values():
        if len(at) > 1:
            for i, p in at:
                cover[i][p : p + length] = b"\x01" * length
    return {i: sum(c) for i, c in enumerate(cover)}


@pytest.mark.parametrize("many", [3, 100_000])
def test_many_contexts_of_one_anchor(spark, monkeypatch, many):
    texts = made(120)
    sort = suffix_dedup._sorted

    def bounded(length):
        inner = sort(length)

        def run(batches):
            seen = Counter()
            batches = list(batches)
            for b in batches:
                whole = zip(b.column(0).to_pylist(), b.column(5).to_pylist(), strict=True)
                seen.update(a for a, apart in whole if not apart)
            assert max(seen.values(), default=0) <= many
            yield from inner(batches)

        return run

    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "_sorted", bounded)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.removed_digests(docs).collect()}
    want = brute(texts)
    assert got == want and sum(v > 0 for v in want.values()) > 10


def test_contexts_of_one_anchor_without_a_repeat():
    import numpy as np

    rng = random.Random(5)
    parts = [bytes(rng.randrange(97, 122) for _ in range(410)) for _ in range(3)]
    at = np.array([200] * 3, np.int64)
    assert suffix_dedup.covered_windows(parts, at, at - 10, np.zeros(3, np.int64)) == []
