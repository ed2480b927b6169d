"""Alignment of two tokenizers' tokens by a label for every byte of a text.

Both tokenizers spell out the same bytes (a space and the text). Every byte gets a label: no token ends
there (``n``), one of A (``a``), one of B (``b``), or one of both (``x``). A regular expression takes the
spans up to each ``x``; the number of ``a`` and ``b`` in a span, and one more for its ``x``, are the numbers
of tokens in a group. Every labelled byte also ends the overlap of one token of A with one of B, so the
pairs of overlapping tokens are read off the labels.

Neither tokenizer has a token that goes on over a space after something else than white space, so texts
are cut there and of all texts that a task holds at a time, each distinct part is encoded and labelled once.

How often an id pair is linked is counted over all texts: each task counts its own first. A text's pairs
are written once as numbers and looked up by a join, whose small side is broadcast if its counted size
allows it; if not, pairs that very many texts hold are, and the others are shuffled.

A null or empty text, and one whose bytes a tokenizer doesn't give back, has no tokens: zeros and an empty
digest. Very long texts are one row like others. Every row is a document of its own, repeated rows and rows
with the same id or none included. An empty table gives an empty result. Columns beyond id and text are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import BROADCAST_LIMIT, Workspace, slices
from .packing import _UNUSUAL, _byte_letters

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of texts that a task holds as Python objects at a time.
HELD = 1 << 21
#: Of pairs too many to be broadcast, those in more than one in this many rows of (text, pair) are hot; there are fewer than that.
HOT_SHARE = 100_000
#: Bytes of a row of pair counts in a broadcast.
PAIR_BYTES = 32

_LABELS = bytes.maketrans(b"\x00\x01\x02\x03", b"nabx")
_GROUP = re.compile(rb"[nab]*x")


@dataclass
class Parts:
    """Flat arrays of all parts' tokens, groups and links; ``*_at[i]`` is where part ``i`` begins."""

    good: np.ndarray  # whether both tokenizers give the part's bytes back
    a: np.ndarray
    a_at: np.ndarray
    b: np.ndarray
    b_at: np.ndarray
    group_a: np.ndarray  # tokens of A in each group
    group_b: np.ndarray
    group_bytes: np.ndarray
    group_at: np.ndarray
    link: np.ndarray  # id of A * number of B's ids + id of B
    link_at: np.ndarray
    spelled: list[bytes]  # the groups as text, each with a closing semicolon


def _starts(counts) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _gather(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``flat``'s stretches of the parts ``which``, one after the other, and where each begins."""
    n = (at[1:] - at[:-1])[which]
    to = _starts(n)
    return flat[np.arange(to[-1]) + np.repeat(at[:-1][which] - to[:-1], n)], to


class Aligner:
    """Both tokenizers; one for each process."""

    def __init__(self, a_path: str, b_path: str):
        self.library = Tokenizer.from_file(a_path)
        self.library.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        self.a_bytes = [b""] * self.library.get_vocab_size(with_added_tokens=True)
        for t, i in spec["model"]["vocab"].items():
            self.a_bytes[i] = t.encode() if t in special else bytes(map(byte_of.__getitem__, t))
        # Ids of such a vocabulary are in the order of its merges, which makes them ranks.
        ranks = {x: i for i, x in enumerate(self.a_bytes) if x and i not in {spec["model"]["vocab"].get(s) for s in special}}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.space = self.b.piece_to_id("▁")
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        spell = [[f"{i}{mark}".encode() for i in range(len(x)) for mark in marks] for x, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))]
        self.spell = spell[0] + spell[1]
        self.spell_size = np.array(list(map(len, self.spell)), np.int64)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def a_ids(self, part: str) -> list[int]:
        """Characters whose class may depend on a library's version of Unicode go through the library that the file is for."""
        usual = part.isascii() or not _UNUSUAL.search(part)
        return self.fast(" " + part) if usual else self.library.encode(" " + part, add_special_tokens=False).ids

    def parts(self, parts: list[str]) -> Parts:
        """Tokens, groups and links of every part, each with a space before it."""
        texts = [b" " + p.encode() for p in parts]
        a = list(map(self.a_ids, parts))
        b = [x or [self.space] for x in self.b.encode(parts, num_threads=1)] if parts else []
        good = np.ones(len(parts), bool)
        flat_a, flat_b = (np.fromiter((i for x in ids for i in x), np.int64) for ids in (a, b))
        if b"".join(map(self.a_bytes.__getitem__, flat_a.tolist())) != (whole := b"".join(texts)) or b"".join(map(self.b_bytes.__getitem__, flat_b.tolist())) != whole:
            spelled = zip(texts, a, b, strict=True)
            good = np.array([b"".join(map(self.a_bytes.__getitem__, x)) == t == b"".join(map(self.b_bytes.__getitem__, y)) for t, x, y in spelled], bool)
            texts, a, b = ([x if ok else x[:0] for x, ok in zip(each, good, strict=True)] for each in (texts, a, b))
            flat_a, flat_b = (np.fromiter((i for x in ids for i in x), np.int64) for ids in (a, b))
        a_at, b_at, text_at = (_starts([len(x) for x in each]) for each in (a, b, texts))

        labels = np.zeros(text_at[-1], np.uint8)
        labels[np.cumsum(self.a_size[flat_a]) - 1] += 1
        labels[np.cumsum(self.b_size[flat_b]) - 1] += 2
        spans = _GROUP.findall(labels.tobytes().translate(_LABELS))
        group_a = np.fromiter((s.count(b"a") + 1 for s in spans), np.int64, len(spans))
        group_b = np.fromiter((s.count(b"b") + 1 for s in spans), np.int64, len(spans))
        group_bytes = np.fromiter(map(len, spans), np.int64, len(spans))
        group_at = np.searchsorted(_starts(group_bytes), text_at).astype(np.int64)

        ends = np.flatnonzero(labels)
        of_a, of_b = labels[ends] & 1, labels[ends] >> 1
        link = flat_a[np.cumsum(of_a) - of_a] * len(self.b_bytes) + flat_b[np.cumsum(of_b) - of_b] if len(ends) else np.empty(0, np.int64)
        return Parts(good, flat_a, a_at, flat_b, b_at, group_a, group_b, group_bytes, group_at, link, np.searchsorted(ends, text_at).astype(np.int64), self._spelled(flat_a, flat_b, group_a, group_b, a_at + b_at))

    def _spelled(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, token_at: np.ndarray) -> list[bytes]:
        """``a1,a2|b1;`` for every group, joined for each part."""
        order = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[np.cumsum(group_a) - 1] = last_b[np.cumsum(group_b) - 1] = 1
        order[np.arange(len(a)) + np.repeat(np.cumsum(group_b) - group_b, group_a)] = 2 * a + last_a
        order[np.arange(len(b)) + np.repeat(np.cumsum(group_a), group_b)] = 2 * len(self.a_bytes) + 2 * b + last_b
        whole = b"".join(map(self.spell.__getitem__, order.tolist()))
        at = _starts(self.spell_size[order])[token_at].tolist()
        return [whole[i:j] for i, j in zip(at, at[1:], strict=False)]


@functools.lru_cache(1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


_CUT = re.compile(r"(?<=\S)(?= )")


def cut(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct parts of the texts, each text's part numbers, and where they begin.

    A part is what stands after one space, up to the next space that follows anything but white space.
    """
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    parts = lists.flatten().dictionary_encode()
    distinct = parts.dictionary.to_pylist()
    which = parts.indices.to_numpy().astype(np.int64)
    at = lists.offsets.to_numpy().astype(np.int64)
    open_end = np.array([not p or p[-1].isspace() for p in distinct], bool)
    if not open_end.any():
        return distinct, which, at
    # In texts with runs of white space around a space, a part may hold some of the spaces.
    number = {p: i for i, p in enumerate(distinct)}
    found = []
    for i, t in enumerate(texts):
        own = which[at[i] : at[i + 1]]
        if open_end[own].any():
            own = np.array([number.setdefault(p[1:], len(number)) for p in _CUT.split(" " + t)], np.int64)
        found.append(own)
    return list(number), np.concatenate(found), _starts([len(x) for x in found])


def _encoded(batches, a_path: str, b_path: str, text: int):
    """For each stretch of rows: the batch, the parts, every text's part numbers, where they begin, and which texts have tokens."""
    both = aligner(a_path, b_path)
    for batch in slices(batches, 4096, HELD):
        texts = [t or "" for t in batch.column(text).to_pylist()]
        distinct, which, at = cut(texts)
        parts = both.parts(distinct)
        bad = np.add.reduceat(~parts.good[which], at[:-1]) if len(texts) else np.empty(0)
        yield batch, parts, which, at, (bad == 0) & np.array([bool(t) for t in texts], bool), both


_TOKENS = "a_ids array<int>, b_ids array<int>, group_a array<int>, group_b array<int>, group_bytes array<int>"


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's tokens and groups: ids of both tokenizers, and each group's numbers of tokens and of bytes of space+text.

    The arrays are empty where a text has no tokens.
    """
    paths = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)

    def run(batches):
        for batch, p, which, at, has, _ in _encoded(batches, *paths, 1):
            columns = []
            for flat, starts in ((p.a, p.a_at), (p.b, p.b_at), (p.group_a, p.group_at), (p.group_b, p.group_at), (p.group_bytes, p.group_at)):
                values, to = _gather(flat, starts, which)
                columns.append(pa.array([values[to[i] : to[j]] if ok else [] for i, j, ok in zip(at, at[1:], has, strict=False)], pa.list_(pa.int32())))
            yield pa.record_batch([batch.column(0), *columns], names=["doc_id", *(c.split(" ")[0] for c in _TOKENS.split(", "))])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, {_TOKENS}")


_OUT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def _digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Each row's numbers and digest, and its distinct linked id pairs with how often each is linked."""

    def run(batches):
        for batch, p, which, at, has, both in _encoded(batches, a_path, b_path, 2):
            n = len(has)
            counts = []
            for starts in (p.a_at, p.b_at, p.group_at, p.link_at):
                sums = _starts((starts[1:] - starts[:-1])[which])[at]
                counts.append(pa.array((sums[1:] - sums[:-1]) * has))
            own, texts = which.tolist(), p.spelled
            sha = [hashlib.sha256(b"".join([texts[k] for k in own[at[i] : at[i + 1]]])[:-1]).hexdigest() if has[i] else "" for i in range(n)]
            link, to = _gather(p.link, p.link_at, which)
            row = np.repeat(np.arange(n), np.diff(to[at]))
            if len(both.a_bytes) * len(both.b_bytes) >= 1 << 31:
                raise ValueError("an id pair must fit into 31 bits")
            keys, times = np.unique((row << 31 | link)[has[row]], return_counts=True)
            offsets = pa.array(np.searchsorted(keys, np.arange(n + 1) << 31).astype(np.int32))
            pairs = pa.ListArray.from_arrays(offsets, pa.array((keys & (2**31 - 1)).astype(np.int32)))
            often = pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))
            yield pa.record_batch([batch.column(0), batch.column(1), *counts, pa.array(sha, pa.string()), pairs, often], names=[c.split(" ")[0] for c in _OUT.split(", ")])

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, _OUT)


def _pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """``pair, texts, best``: how many rows hold the pair, and whether no pair with the same A id is in more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("texts"))
    counts = counts.withColumn("a", F.expr(f"pair div {b_size}"))
    most = counts.groupBy("a").agg(F.max("texts").alias("most"))
    return counts.join(most, "a").select("pair", "texts", (F.col("texts") == F.col("most")).cast("int").alias("best"))


def link_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a_id, b_id, texts, best`` for every id pair that is linked in some row."""
    paths = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)
    b_size = len(aligner(*paths).b_bytes)
    rows = _digests(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), *paths)
    return _pair_counts(rows, b_size).select(F.expr(f"int(pair div {b_size})").alias("a_id"), F.expr(f"int(pair % {b_size})").alias("b_id"), "texts", "best")


def alignment_digests(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    paths = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)
    work = Workspace(docs.sparkSession, "alignment")
    rows = work.save(_digests(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), *paths))
    counts = work.save(_pair_counts(rows, len(aligner(*paths).b_bytes)))
    held = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", "p.pairs", "p.times")
    held = held.select("row", F.col("pairs").alias("pair"), "times")
    n, total = counts.agg(F.count("*"), F.coalesce(F.sum("texts"), F.lit(0))).first()
    if n * PAIR_BYTES <= BROADCAST_LIMIT:
        joined = held.join(F.broadcast(counts), "pair")
    else:
        hot = F.broadcast(counts.where(F.col("texts") * HOT_SHARE > total))
        rest = counts.where(F.col("texts") * HOT_SHARE <= total)
        cold = held.join(hot.select("pair"), "pair", "left_anti").join(rest.hint("merge"), "pair")
        joined = held.join(hot, "pair").unionByName(cold)
    sums = joined.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("texts")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
