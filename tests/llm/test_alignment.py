"""Token alignment against both libraries over whole texts and a brute force over byte ranges."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arbiter.llm import queries, token_alignment

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
LETTERS = {chr(b): b for b in SHOWN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in SHOWN)}
A_BYTES = {i: bytes(LETTERS[c] for c in t) for t, i in A.get_vocab(with_added_tokens=False).items()}


def b_bytes(i):
    return bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()


def groups(text):
    """Groups of (ids of A, ids of B) and linked occurrence pairs, from byte ranges of all tokens."""
    whole = b" " + (text or "").encode()
    a = A.encode(" " + (text or ""), add_special_tokens=False).ids
    b = B.encode(text or "", num_threads=1)
    if not text or b"".join(map(A_BYTES.__getitem__, a)) != whole or b"".join(map(b_bytes, b)) != whole:
        return [], []

    def ranges(ids, spell):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(spell(i)), i))
            at += len(spell(i))
        return out

    ra, rb = ranges(a, A_BYTES.__getitem__), ranges(b, b_bytes)
    ends = sorted({e for _, e, _ in ra} & {e for _, e, _ in rb})
    out, last = [], 0
    for e in ends:
        out.append(([i for s, t, i in ra if last <= s and t <= e], [i for s, t, i in rb if last <= s and t <= e]))
        last = e
    return out, [(i, j) for s, t, i in ra for u, v, j in rb if max(s, u) < min(t, v)]


def brute(rows):
    each = [groups(t) for _, t in rows]
    count = Counter(p for _, links in each for p in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    for (doc, _), (gs, links) in zip(rows, each, strict=True):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in gs)
        sums = sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links)
        yield doc, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(links), *sums, hashlib.sha256(said.encode()).hexdigest() if gs else ""


TEXTS = [
    None, "", " ", "  ", "\n", " \n ", "a", "one two", "one  two", "one two ", " one two", "tail \n", "tab\tand\nline\r\n \r\n end", "don't we'll they've", "<|endoftext|> and <s> </s> <unk>",
    "a▁b", "naïve café 日本語のテキスト 😀 emoji ́x", "\x00 zero", "<0x41> spelled", "１２３ wide", "ελληνικά русский العربية हिन्दी", "ệกༀ rare \U0001f9ff", "x" * 3000, "no-spaces-" * 200, "the quick brown fox " * 40,
    "  hard", "a　b  c", "deep      indent\n        code()\n", "Ünïcödé—dash…", "﻿mark", "one two", "one two",
]
ROWS = [*enumerate(TEXTS), (None, "no id of its own"), (6, "another text of id 6")]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    for c in ("row", "pair", "pairs", "times", "texts", "best", "a"):
        d = d.withColumn(c, F.lit(c))
    return d


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("limit", [None, 0])
def test_against_whole_texts(docs, monkeypatch, limit):
    """Also where the pair counts are too many to be broadcast, with hot pairs and without."""
    if limit is not None:
        monkeypatch.setattr(token_alignment, "BROADCAST_LIMIT", limit)
        monkeypatch.setattr(token_alignment, "HOT_SHARE", 200)
    out = token_alignment.alignment_digests(docs)
    assert out.columns == COLUMNS
    assert Counter(map(tuple, out.collect())) == Counter(brute(ROWS))


def test_align(docs):
    got = Counter()
    for r in token_alignment.align(docs).collect():
        a, b, at = 0, 0, []
        for n, m in zip(r.group_a, r.group_b, strict=True):
            at.append((tuple(r.a_ids[a : a + n]), tuple(r.b_ids[b : b + m])))
            a, b = a + n, b + m
        assert (a, b) == (len(r.a_ids), len(r.b_ids))
        got[r.doc_id, tuple(at), sum(r.group_bytes)] += 1
    want = Counter()
    for doc, t in ROWS:
        gs = tuple((tuple(x), tuple(y)) for x, y in groups(t)[0])
        want[doc, gs, len((" " + t).encode()) if gs else 0] += 1
    assert got == want


def test_link_counts(docs):
    count = Counter(p for _, t in ROWS for p in set(groups(t)[1]))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    assert {(r.a_id, r.b_id): (r.texts, r.best) for r in token_alignment.link_counts(docs).collect()} == {p: (n, int(n == most[p[0]])) for p, n in count.items()}


def test_every_code_point(spark):
    """Each character inside, before and after letters; the vocabularies know different ones."""
    chars = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    rows = [(k, " ".join(f"a{c}b{c} {c}1" for c in chars[at : at + 64])) for k, at in enumerate(range(0, len(chars), 64))]
    rows = [(d, t) for d, t in rows if d % 4 == 0 or d < 300]
    out = token_alignment.alignment_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    both = token_alignment.aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_a, r.n_b) for r in out.collect()}
    for d, t in rows:
        a, b = A.encode(" " + t, add_special_tokens=False).ids, B.encode(t)
        same = b"".join(both.b_bytes[i] for i in b) == b" " + t.encode()
        assert got[d] == ((len(a), len(b)) if same else (0, 0))


def test_empty_table_and_query(spark, sf):
    assert token_alignment.alignment_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    out = queries.op11_token_alignment(spark, sf)
    assert out.columns == COLUMNS
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = [(d, t) for d, t in rows if len(t or "") < 3000]
    got = {r.doc_id: tuple(r) for r in out.collect()}
    assert len(got) == len(rows)
    for d, t in short:
        gs, links = groups(t)
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in gs)
        assert got[d][1:5] == (sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(links))
        assert got[d][7] == (hashlib.sha256(said.encode()).hexdigest() if gs else "")
