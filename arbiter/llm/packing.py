"""Best-fit packing of token pieces into sequences, by hierarchical residual packing.

Documents become pieces of at most ``limit`` tokens. Whole-length pieces are sequences of their own. The
others go through a tree: each node packs ``NODE`` items best-fit (longest first), emits bins that are
nearly full, and passes on underfull bins as items of the next round, where fewer nodes take them together
with the bins of others. Of a node's bins at most one is half full or less, as two of them would have been
one; and of bins that are over half full, no two fit together. So the next round has as many small bins as
there were nodes, and of the others, for each length, as many as there are small bins: more can't be of use,
and go out as they are, like those without room for the least small bin. With every round the small bins are
fewer, until one node is left or no small bin.

A null text counts as empty: it has the one closing id. A very long text is cut into many pieces. Items of
equal length are packed in any order. Repeated rows are packed each. An empty table gives an empty result.
Columns beyond the id and the text are ignored.
"""

from __future__ import annotations

import functools
import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Workspace, slices

LIMIT = 2048
#: A bin is emitted early when at most this many tokens are free.
SLACK = 8
#: Items that one node packs; a task that has more of them packs several times.
NODE = 100_000

PIECE = np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4"), ("null", "?")])


_MARKS = frozenset(",.;:!?")
#: Letters and marks whose class and lower case are the same everywhere (fixed values): Latin, Greek but for its capitals, Cyrillic,
#: punctuation, kana, unified ideographs, Hangul, pictographs.
_UNUSUAL = regex.compile("[^\x01-\u0129\u0131-\u024f\u03b1-\u03c9\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u3001-\u3011\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f5ff\U0001f600-\U0001f64f]")


class WordTokenizer:
    """Ids of a ``tokenizers`` file of the kind that lower-cases, drops white space and marks word ends.

    No token spans white space, so texts are cut at their spaces and each part's ids come from a cache. What
    isn't there is split by the file's pattern and merged by rank: a word end is the byte 0xFF, which no
    UTF-8 text has. Texts with characters beyond the usual scripts, whose class or lower case may depend on
    the context or on a library's version of Unicode, or with a special token's string go through the
    library itself.
    """

    #: Parts that each of the cache's two generations holds, and the longest that is kept.
    CACHE, LONGEST = 1 << 17, 40

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab, mark = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        spell = lambda t: bytes(map(byte_of.__getitem__, t.removesuffix(mark))) + b"\xff" * t.endswith(mark)
        single = {spell(t): i for t, i in vocab.items() if len(t.removesuffix(mark)) == 1}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # A byte and a word end are one symbol from the start, so they come before all merges.
        order = [k for k in single if len(k) == 2] + [k for k in single if len(k) == 1] + [b"\xff"]
        rank = {k: r for r, k in enumerate(dict.fromkeys(order + [spell(a + b) for a, b in pairs]))}
        self.id_of = np.zeros(len(rank), "<u4")
        for t, i in vocab.items():
            if t not in self.special and (r := rank.get(spell(t))) is not None:
                self.id_of[r] = i
        self.merge = tiktoken.Encoding("ranks", pat_str=r"(?s:.)+", mergeable_ranks=rank, special_tokens={})._core_bpe.encode_single_piece
        self.blob_of = [i.tobytes() for i in self.id_of]
        self.cache = _Parts(self)

    @functools.cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def word(self, word: str) -> bytes:
        """Ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.blob_of.__getitem__, self.merge(word.encode() + b"\xff")))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Of all texts together, every distinct part is looked up once."""
        plain = [not (_UNUSUAL.search(t) if not t.isascii() else None) and not any(s in t for s in self.special) for t in texts]
        lowered = pa.array([unicodedata.normalize("NFC", t).lower().replace("\n", " ") if usual else "" for t, usual in zip(texts, plain, strict=True)], pa.large_string())
        lists = pc.split_pattern(lowered, " ")
        parts = lists.flatten().dictionary_encode()
        blobs = list(map(self.cache.__getitem__, parts.dictionary.to_numpy(zero_copy_only=False).tolist()))
        flat = np.frombuffer(b"".join(blobs), "<u4")
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        which = parts.indices.to_numpy()
        counts, firsts = size[which], (np.cumsum(size) - size)[which]
        ends = np.cumsum(counts)
        ids = flat[np.arange(counts.sum()) + np.repeat(firsts - ends + counts, counts)]
        at = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [ids[a:b] if usual else np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4") for t, usual, a, b in zip(texts, plain, at[:-1], at[1:], strict=True)]


class _Parts(dict):
    """Ids of parts in two generations: when the young one is full it becomes the old one, whose parts come back when they are met again."""

    def __init__(self, words: WordTokenizer):
        self.words, self.old = words, {}

    def __missing__(self, part: str) -> bytes:
        words = self.words
        # Most that are no word are a word and a mark, of which the word alone is kept.
        if part[-1:] in _MARKS and part[:-1].isalpha():
            return self[part[:-1]] + self[part[-1]]
        if (ids := self.old.get(part)) is None:
            ids = words.word(part) if part.isalpha() else b"".join(map(words.word, words.split(part)))
        if len(part) <= words.LONGEST:
            if len(self) >= words.CACHE:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids


@functools.lru_cache(1)
def tokenizer(path: str) -> WordTokenizer:
    """One for each process, as workers run many tasks."""
    return WordTokenizer(path)


def _byte_letters() -> list[str]:
    """The letters that stand for bytes 0 to 255 in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every row: ``doc_id, piece, start, length, ids_crc32``."""

    def run(batches):
        words = tokenizer(path)
        for batch in slices(batches, 4096, 1 << 21):
            doc, piece, start, length, crc = [], [], [], [], []
            for d, found in zip(batch.column(0).to_pylist(), words.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = np.append(found, np.uint32(0)).astype("<u4", copy=False)
                for k, at in enumerate(range(0, len(ids), limit)):
                    x = ids[at : at + limit]
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(len(x))
                    crc.append(zlib.crc32(x))
            yield pa.record_batch([doc, piece, start, length, crc], schema=_PIECES)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, limit: int) -> list[list[int]]:
    """Bins of item numbers: items, given longest first, each go to the fullest open bin that has room."""
    open_by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms = np.zeros(limit + 1, bool)  # rooms that some open bin has
    bins: list[list[int]] = []
    room_of: list[int] = []
    for i, n in enumerate(lengths.tolist()):
        room = n + int(rooms[n:].argmax()) if n <= limit else limit + 1
        if room <= limit and rooms[room]:
            b = open_by_room[room].pop()
            rooms[room] = bool(open_by_room[room])
        else:
            b, room = len(bins), limit
            bins.append([])
            room_of.append(limit)
        bins[b].append(i)
        left = room - n
        room_of[b] = left
        if left:
            open_by_room[left].append(b)
            rooms[left] = True
    return bins


_BIN = "done boolean, length long, rank int, members binary"
_BIN_ARROW = pa.schema([("done", pa.bool_()), ("length", pa.int64()), ("rank", pa.int32()), ("members", pa.binary())])


def _ranks(lengths: np.ndarray) -> np.ndarray:
    """The place of each among those of its length."""
    order = np.argsort(lengths, kind="stable")
    starts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    out = np.empty(len(lengths), np.int32)
    out[order] = np.arange(len(lengths)) - np.repeat(starts, np.diff(np.append(starts, len(lengths))))
    return out


def _packer(limit: int, last: bool):
    def packed(lengths, members):
        order = np.argsort(-lengths, kind="stable")
        bins = best_fit(lengths[order], limit)
        items = [order[b] for b in bins]
        full = np.array([lengths[i].sum() for i in items], np.int64)
        rank = _ranks(full)
        for at in range(0, len(bins), 20_000):
            part = slice(at, at + 20_000)
            yield pa.record_batch([pa.array((full[part] >= limit - SLACK) | last), pa.array(full[part]), pa.array(rank[part]), pa.array([b"".join([members[i] for i in b.tolist()]) for b in items[part]], pa.binary())], schema=_BIN_ARROW)

    def run(batches):
        lengths, members, size = [], [], 0
        for batch in batches:
            lengths.append(batch.column(0).to_numpy())
            members += batch.column(1).to_pylist()
            size += batch.column(1).nbytes
            if len(members) >= NODE or size > NODE * 4 * PIECE.itemsize:
                yield from packed(np.concatenate(lengths), members)
                lengths, members, size = [], [], 0
        if members:
            yield from packed(np.concatenate(lengths), members)

    return run


def _items(batches):
    for batch in batches:
        rows = np.zeros(batch.num_rows, PIECE)
        ids = batch.column(0)
        rows["doc_id"], rows["null"] = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        for k, name in enumerate(("piece", "start", "length", "crc"), 1):
            rows[name] = batch.column(k).to_numpy()
        blobs = pa.Array.from_buffers(pa.binary(PIECE.itemsize), len(rows), [None, pa.py_buffer(rows.tobytes())])
        yield pa.record_batch([batch.column(3), blobs.cast(pa.binary())], names=["length", "members"])


_PLACED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _members(batches):
    for batch in batches:
        ids, blobs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        sizes = np.array([len(b) // PIECE.itemsize for b in blobs], np.int64)
        rows = np.frombuffer(b"".join(blobs), PIECE)
        length = rows["length"].astype(np.int64)
        ends = np.cumsum(length)
        firsts = np.cumsum(sizes) - sizes
        base = np.concatenate([[0], ends])[firsts]
        columns = [pa.array(rows["doc_id"], mask=rows["null"].copy()), rows["piece"], rows["start"], length, rows["crc"].astype(np.int64), np.repeat(ids, sizes), ends - length - np.repeat(base, sizes)]
        yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=_PLACED)


def _joinable(bins: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Underfull bins that no other can be joined with, or that aren't needed for it, and those of the next round."""
    small = F.col("length") * 2 <= limit
    k, least = bins.where(small).agg(F.count("*"), F.min("length")).first()
    if not k:
        return bins, None
    # Small bins join with each other, or each with one of the others: ``k`` of a length are enough, taken by their ranks in the nodes.
    counts = bins.where(~small & (F.col("length") + least <= limit) & (F.col("rank") < k)).groupBy("length", "rank").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("rank").rowsBetween(W.unboundedPreceding, -1))
    up_to = counts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k).groupBy("length").agg(F.max("rank").alias("up_to"))
    # One row for each length, so no more than ``limit`` of them.
    marked = bins.join(F.broadcast(up_to), "length", "left").withColumn("stays", small | F.coalesce(F.col("rank") <= F.col("up_to"), F.lit(False)))
    return marked.where("NOT stays"), marked.where("stays")


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; no sequence is longer than ``limit``."""
    work = Workspace(pieces.sparkSession, "packing")
    # Written, so that no task runs two Python workers.
    items = work.save(pieces.select("doc_id", "piece", "start", "length", "ids_crc32").mapInArrow(_items, "length long, members binary"))
    done = items.where(F.col("length") == limit).select("members")
    open_items = items.where(F.col("length") < limit)
    n = open_items.count()
    parts = -(-n // NODE)
    while parts:
        level = work.save(open_items.select("length", "members").repartition(parts, F.xxhash64("members")).mapInArrow(_packer(limit, parts == 1), _BIN))
        done = done.unionAll(level.where("done").select("members"))
        if parts == 1:
            break
        leaving, open_items = _joinable(level.where("NOT done"), limit)
        done = done.unionAll(leaving.select("members"))
        # Fewer nodes in every round.
        parts = min(-(-open_items.count() // NODE), parts // 2) if open_items else 0
    return done.select(F.monotonically_increasing_id().alias("sequence_id"), "members").mapInArrow(_members, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Every row's pieces with their places. The pieces are written once, so texts are tokenized once."""
    work = Workspace(docs.sparkSession, "pieces")
    return pack(work.save(cut(docs, path or public_tokenizers.path("word_bpe_49k.json"), limit)), limit)
