"""The pipeline's removal of repeats in texts whose runs have few words."""

import random

from arbiter.llm import suffix_dedup

rng = random.Random(9)
SIGNS = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3000))
OTHER = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(300)) for _ in range(4)]


def brute(texts, length=400):
    """Bytes covered by strings that start at two places or more, removed; broken characters go whole."""
    data, seen = [t.encode() for t in texts], {}
    for i, b in enumerate(data):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((i, p))
    cover = [bytearray(len(b)) for b in data]
    for at in seen.values():
        if len(at) > 1:
            for i, p in at:
                cover[i][p : p + length] = b"\x01" * length
    return [bytes(x for x, c in zip(b, m, strict=True) if not c).decode("utf-8", "ignore") for b, m in zip(data, cover, strict=True)]


def test_repeats_without_blanks_go(spark):
    texts = [OTHER[0] + SIGNS[:600] + OTHER[1], SIGNS[:600], OTHER[2] + SIGNS[100:400], SIGNS[:100] + OTHER[3], "x" * 399, "x" * 399 + "y", "short", ""]
    rows = [(i, t, len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").repartition(2)
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix_dedup.cleaned_documents(docs).collect()}
    want = brute(texts)
    assert got == {i: (t, len(t)) for i, t in enumerate(want)}
    assert len(want[0]) < len(texts[0]) and want[3:] == texts[3:]


def test_passages_of_words_go_and_shorter_repeats_stay(spark):
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    long, short = " ".join(words[:60]), " ".join(f"{w}{'q' * 9}" for w in words[300:320])
    texts = [f"a {long} b", f"c {long} d", f"e {short} f", f"g {short} h", SIGNS[:200], f"{SIGNS[:200]} k"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.cleaned_documents(docs).collect()}
    assert got[0].replace(" ", "") == "ab" and got[1].replace(" ", "") == "cd"
    assert got[2] == texts[2] and got[3] == texts[3]
    assert got[4] == "" and got[5].strip() == "k"
