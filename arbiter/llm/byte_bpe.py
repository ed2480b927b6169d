"""Byte-level BPE encoding and decoding without regular expressions.

A text's code points are looked up in a class array; local context turns each into a symbol of a small
alphabet, and a nine-state automaton over those symbols marks where tokens start. Its transition
functions compose associatively, so a whole batch is scanned at once: each block's composed function
first, then the state in which each block is entered, then all blocks again side by side. The slices
between boundaries are merged by rank through a bounded cache; byte offsets are kept for decoding.

A null text counts as empty; empty texts have no ids. Very long texts are worked on whole. Rows are
independent, so repeated rows and ties don't matter, an empty table gives an empty result, and columns
beyond the id and the text are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Symbols: letter, number, other, apostrophe of a two- or three-character contraction, a space that
# joins what follows or lies within blanks, another blank before text or within blanks.
LETTER, NUMBER, OTHER, TWO, THREE, JOIN, SPACES, BLANK, BLANKS = range(9)
# States: fresh (the next character starts a token), within letters, numbers, others, after a joining
# space, within blanks, and with one or two characters of a contraction to come.
FRESH, IN_L, IN_N, IN_O, JOINED, IN_B, ONE_LEFT, TWO_LEFT = range(8)
STATES, SYMBOLS = 8, 9


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and 'a token starts here', by symbol (those of a text's first character after the others) and state."""
    step = np.zeros((2 * SYMBOLS, STATES), np.uint8)
    start = np.ones((2 * SYMBOLS, STATES), bool)
    run = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O, TWO: ONE_LEFT, THREE: TWO_LEFT, JOIN: JOINED, SPACES: IN_B, BLANK: FRESH, BLANKS: IN_B}
    for symbol in range(SYMBOLS):
        for state in range(STATES):
            if state in (ONE_LEFT, TWO_LEFT):
                to, begins = (FRESH if state == ONE_LEFT else ONE_LEFT), False
            elif symbol in (TWO, THREE) and state in (IN_O, JOINED):
                to, begins = IN_O, False  # an apostrophe within punctuation
            else:
                to = run[symbol]
                begins = not (state == to and state in (IN_L, IN_N, IN_O, IN_B) or state == JOINED and symbol in (LETTER, NUMBER, OTHER))
            step[symbol, state], start[symbol, state] = to, begins
        step[SYMBOLS + symbol], start[SYMBOLS + symbol] = run[symbol], True
    return step, start


STEP, START = _automaton()


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that the symbols' transition functions compose to (0: the identity), each then
    followed by a symbol, and by another function. They are few, so composing two is one look-up."""
    functions = [tuple(range(STATES))]
    known = {functions[0]: 0}
    after: list[list[int]] = []
    for f in functions:  # grows meanwhile
        row = []
        for symbol in range(2 * SYMBOLS):
            g = tuple(int(STEP[symbol, s]) for s in f)
            if g not in known:
                known[g] = len(functions)
                functions.append(g)
            row.append(known[g])
        after.append(row)
    acts = np.array(functions, np.intp)
    then = np.array([[known[tuple(acts[b][acts[a]])] for b in range(len(acts))] for a in range(len(acts))], np.intp)
    return acts, np.array(after, np.intp), then


ACTS, AFTER, THEN = _monoid()


@functools.cache
def class_table() -> np.ndarray:
    """Of each code point: 0 letter, 1 number, 2 other, 3 blank."""
    table = np.full(0x110000, 2, np.uint8)
    kinds = {"L": 0, "N": 1}
    for c in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(c))[0])
        if kind is not None:
            table[c] = kind
    # White_Space of the Unicode standard (fixed values)
    for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[c] = 3
    return table


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The automaton's symbols of code points; ``first`` marks the first of each text."""
    n = len(points)
    kind = class_table()[points]
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    after, after2 = np.zeros(n, points.dtype), np.zeros(n, points.dtype)
    after[:-1], after2[:-2] = points[1:], points[2:]
    after[last] = 0
    after2[last] = 0
    after2[:-1][last[1:]] = 0
    out = np.array([LETTER, NUMBER, OTHER, BLANKS], np.uint8)[kind]
    mark = np.flatnonzero(points == 0x27)
    if len(mark):
        a, b = after[mark], after2[mark]
        pair = lambda x, y: (a == ord(x)) & (b == ord(y))
        out[mark] = np.where(np.isin(a, [ord(x) for x in "stmd"]), TWO, np.where(pair("r", "e") | pair("v", "e") | pair("l", "l"), THREE, OTHER))
    blank = kind == 3
    ends = blank.copy()  # blanks with text right after
    ends[:-1] &= ~blank[1:]
    ends &= ~last
    space = points == 0x20
    out[blank & space] = SPACES
    out[ends] = BLANK
    out[ends & space] = JOIN
    return out + SYMBOLS * first.astype(np.uint8)


def scan(sym: np.ndarray) -> np.ndarray:
    """Where tokens start: the automaton run over the symbols by composing transition functions."""
    n = len(sym)
    if not n:
        return np.zeros(0, bool)
    width = max(16, int(n**0.5))
    rows = -(-n // width)
    grid = np.full(rows * width, SYMBOLS + OTHER, np.intp)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    so_far = np.empty((width + 1, rows), np.intp)  # each block's function up to a character
    so_far[0] = 0
    table = AFTER.ravel()
    for j in range(width):
        np.take(table, so_far[j] * (2 * SYMBOLS) + grid[j], out=so_far[j + 1], mode="clip")
    # Inclusive scan over the blocks' functions by doubling: composition is associative.
    f, by = so_far[width].copy(), 1
    while by < rows:
        f[by:] = THEN[f[:-by], f[by:]]
        by *= 2
    entered = np.zeros(rows, np.intp)
    entered[1:] = ACTS[f[:-1], FRESH]
    state = np.take(ACTS.ravel(), so_far[:-1] * STATES + entered, mode="clip")
    return np.take(START.ravel(), grid * STATES + state, mode="clip").T.ravel()[:n]


@functools.lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeCache:
    """Ids of slices under a table of ranks, through a cache that is emptied when it has grown to its bound."""

    CACHE = 1 << 19

    def __init__(self, rank: dict[bytes, int]):
        self.rank = rank
        # Merges the adjacent pair of lowest rank, leftmost first, until none is left.
        self.merge = tiktoken.Encoding("ranks", pat_str=r"(?s:.)+", mergeable_ranks=self.rank, special_tokens={})._core_bpe.encode_single_piece
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.begin = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def _add(self, pieces: list[str]) -> None:
        made = [self.merge(self._spell(p)) for p in pieces]
        n, k = len(self.place), len(pieces)
        self.place.update(zip(pieces, range(n, n + k), strict=True))
        while len(self.begin) <= n + k:
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.begin[n + 1 : n + k + 1] = self.begin[n] + np.cumsum([len(x) for x in made])
        while len(self.flat) < self.begin[n + k]:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.begin[n] : self.begin[n + k]] = np.fromiter((i for x in made for i in x), np.uint32)

    def _spell(self, piece: str) -> bytes:
        return piece.encode()

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids one after the other, and how many there are up to each piece's end."""
        if len(self.place) > self.CACHE:
            self._clear()
        slots = list(map(self.place.get, pieces))
        if None in slots:
            self._add(list(dict.fromkeys(p for p, s in zip(pieces, slots, strict=True) if s is None)))
            slots = list(map(self.place.__getitem__, pieces))
        slots = np.array(slots, np.int64)
        counts = self.begin[slots + 1] - self.begin[slots]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.begin[slots] - ends + counts, counts)], ends


class Encoder(MergeCache):
    """Encodes batches of texts by a file of ranks."""

    def __init__(self, path: str):
        super().__init__(ranks(path))
        self.bytes = [b""] * (max(self.rank.values()) + 1)
        for k, v in self.rank.items():
            self.bytes[v] = k

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each text: its ids, and the byte offset at which each slice between boundaries starts."""
        ids, offsets = [], []
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= 1 << 20):
                size += len(texts[to])
                to += 1
            a, b = self._block(texts[at:to])
            ids += a
            offsets += b
            at = to
        return ids, offsets

    def _block(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        whole = "".join(texts)
        lengths = np.array([len(t) for t in texts])
        text_at = np.concatenate([[0], np.cumsum(lengths)])
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points), bool)
        first[text_at[:-1][lengths > 0]] = True
        starts = np.flatnonzero(scan(symbols(points, first)))
        bounds = starts.tolist()
        bounds.append(len(points))
        ids, ends = self.ids([whole[a:b] for a, b in zip(bounds, bounds[1:])])  # noqa: B905, RUF007
        bytes_at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)])
        cut = np.searchsorted(starts, text_at)
        id_at = np.concatenate([[0], ends])
        pick = range(len(texts))
        return [ids[id_at[cut[i]] : id_at[cut[i + 1]]] for i in pick], [bytes_at[starts[cut[i] : cut[i + 1]]] - bytes_at[text_at[i]] for i in pick]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def _texts(column) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<long>, slice_offsets array<long>`` of every row."""

    def run(batches):
        enc = Encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, offsets = enc.encode(_texts(part.column(1)))
                yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array(offsets, pa.list_(pa.int64()))], names=["doc_id", "ids", "slice_offsets"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<long>, slice_offsets array<long>")


def decode_column(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` back to ``doc_id, bytes``; null ids count as none."""

    def run(batches):
        enc = Encoder(path)
        for batch in batches:
            data = [enc.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its number of ids, the digest of its ids, and that of the bytes decoded from them."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        enc = Encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, _ = enc.encode(_texts(part.column(1)))
                sha = lambda x: hashlib.sha256(x).hexdigest()
                yield pa.record_batch(
                    [part.column(0).cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(x.astype("<u4").tobytes()) for x in ids]), pa.array([sha(enc.decode(x)) for x in ids])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
