"""Suffix-array dedup: removes every byte covered by a 400-byte string that also starts elsewhere.

Only suffixes that can share ``length`` bytes are sorted. Every window of that length is owned by the 32-byte
gram of least hash in it (its anchor, the leftmost of equals); equal windows have equal anchors at equal
offsets. Windows of one owner in a row are a context: a few hundred bytes around the anchor. Anchors that
occur once are dropped by a partially aggregated count. Contexts that occur more than once are covered as a
whole. Of an anchor with several contexts, one of each is fetched and its suffixes, one for each window,
are sorted by hash comparison: prefix polynomial hashes and a binary search give the common extension of
two suffixes, so a mergesort step takes logarithmic time; neighbours that agree on the whole length by hash
are verified byte by byte. What is covered there goes to all occurrences of the context, copies included.
Of an anchor with over ``MANY`` contexts, as common phrases have, no task holds all: each of their windows is
a row with its 128-bit digest, these are sorted by Spark, and neighbours with one digest are covered.

This is done twice. First with 256 bytes, the least that a passage of over 50 words is taken to have: this
finds the runs of repeated bytes, and so the passages. Then with 400 bytes, over runs of 400 bytes or more
alone: a string that stands twice lies in such runs at both places, so nothing else can have any.

Texts are UTF-8 bytes; matches never cross documents and are judged on the input. Null and short texts
lose nothing. Repeated rows are documents of their own, so each is covered by the other if long enough.
Very long texts are read whole, block by block. Ties don't matter: every occurrence is removed. An empty
table gives an empty result; columns beyond the id and the text are ignored. Contexts are told apart by a
64-bit digest within an anchor's 64-bit hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BASE, Workspace, binary_texts, fresh, mix, powers, slices

LENGTH, GRAM = 400, 32
#: Bytes of the strings whose repeats make up runs, and words of a run that is more than no passage.
LEAST, WORDS = 256, 50
#: Contexts of one anchor that one task sorts together; windows of more of them are compared by their digests.
MANY = 2000
_BLOCK = 1 << 18
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_inverse = np.ones(1, np.uint64)
_LOW = np.uint64((1 << 20) - 1)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        p = np.full(max(n, 2 * len(_inverse)), _INVERSE, np.uint64)
        p[0] = 1
        _inverse = np.multiply.accumulate(p)
    return _inverse[:n]


def prefix_hashes(b: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, modulo 2**64."""
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(len(b)), out=out[1:])
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` neighbours, by running minima from both ends of blocks of ``w``."""
    n = len(x)
    rows = -(-n // w)
    grid = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = x
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1]).ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def contexts(text: bytes, length: int = LENGTH):
    """Yields arrays of anchor hash, anchor position, first and last window start of each context."""
    n = len(text)
    for first in range(0, n - length + 1, _BLOCK):
        b = np.frombuffer(text, np.uint8, min(n - first, _BLOCK + length - 1), first)
        p = prefix_hashes(b)
        grams = mix((p[GRAM:] - p[:-GRAM]) * inverse_powers(len(p) - GRAM))
        least = sliding_min((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1)
        at = (least & _LOW).astype(np.int64)
        cut = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(cut[1:], len(at)) - 1
        anchor = at[cut]
        yield grams[anchor], anchor + first, cut + first, last + first


def _digest(x: bytes, lo: int, hi: int) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8, salt=lo.to_bytes(4, "little") + hi.to_bytes(4, "little")).digest(), "little", signed=True)


_SEEN = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _occurrences(length: int):
    """``anchor, context, doc_id, text_key, pos, lo, hi``: windows start from ``pos - lo`` to ``pos - hi``."""

    def run(batches):
        out, size = [], 0

        def made():
            columns = (np.concatenate(c) for c in zip(*out, strict=True))
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SEEN, strict=True)], schema=_SEEN)

        for batch in slices(batches, 1024, 1 << 23):
            for doc, text, key in zip(batch.column(0).to_pylist(), binary_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for h, pos, first, last in contexts(text, length):
                    lo, hi = pos - first, pos - last
                    made_of = [_digest(text[a : b + length], x, y) for a, b, x, y in zip(first.tolist(), last.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                    out.append((h.view(np.int64), np.array(made_of, np.int64), np.full(len(h), doc, np.int64), np.full(len(h), key, np.int64), pos, lo, hi))
                    size += len(h)
                if size > 50_000:
                    yield made()
                    out, size = [], 0
        if size:
            yield made()

    return run


class Suffixes:
    """Suffixes of one buffer, compared by hashes of prefixes up to ``length`` bytes."""

    def __init__(self, buffer: np.ndarray, length: int = LENGTH):
        self.bytes, self.length = buffer, length
        self.hash = prefix_hashes(buffer)
        self.inverse = inverse_powers(len(self.hash))

    def cut(self, at: np.ndarray, size) -> np.ndarray:
        """Hashes of the ``size`` bytes at each place."""
        return (self.hash[at + size] - self.hash[at]) * self.inverse[at]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common bytes of suffixes at ``a`` and ``b``, ``length`` at most, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        for _ in range(self.length.bit_length()):
            mid = (low + high + 1) // 2
            same = self.cut(a, mid) == self.cut(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, whole_a: np.ndarray, whole_b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether the suffix at ``a`` sorts before that at ``b``; equal ones as ``or_equal`` says."""
        out = or_equal & (whole_a == whole_b)
        differ = np.flatnonzero(whole_a != whole_b)
        x, y = a[differ], b[differ]
        n = self.extension(x, y)
        n = np.minimum(n, self.length - 1)
        out[differ] = self.bytes[x + n] < self.bytes[y + n]
        return out

    def sort(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Order of the suffixes within each of the groups that follow each other in ``at``: a mergesort
        of all groups side by side, in which every suffix finds its rank in the other run by binary search."""
        n = len(at)
        order = np.arange(n)
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside = np.arange(n) - begin
        group = np.repeat(sizes, sizes)
        whole = self.cut(at, self.length)
        width = 1
        while width < sizes.max(initial=0):
            left = (inside // (2 * width)) * 2 * width  # start of the pair of runs
            is_left = inside - left < width
            other = np.where(is_left, left + width, left)
            end = np.minimum(np.where(is_left, left + 2 * width, left + width), group)
            low, high = np.minimum(other, end), end
            for _ in range(int(width).bit_length()):
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                there = order[begin[open_] + mid]
                here = order[open_]
                # Of equals, those of the left run stay first.
                ahead = self.before(at[there], at[here], whole[there], whole[here], ~is_left[open_])
                low[open_] = np.where(ahead, mid + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], mid)
            own = np.where(is_left, inside - left, inside - left - width)
            to = begin + left + own + (low - np.minimum(other, end))
            fresh = np.empty_like(order)
            fresh[to] = order
            order = fresh
            width *= 2
        return order


def covered_windows(parts: list[bytes], lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """Of contexts, the windows that others have too: context number, and first and last offset of each run."""
    sizes = np.array([len(p) for p in parts], np.int64)
    base = np.cumsum(sizes) - sizes
    s = Suffixes(np.frombuffer(b"".join(parts), np.uint8), length)
    counts = lo - hi + 1
    who = np.repeat(np.arange(len(parts)), counts)
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at, offset = base[who] + step, lo[who] - step
    # Suffixes of one anchor at one offset are a group.
    _, number = np.unique(anchor, return_inverse=True)
    key = number[who] * length + offset
    order = np.argsort(key, kind="stable")
    who, at, offset, key = who[order], at[order], offset[order], key[order]
    edge = np.flatnonzero(np.diff(key, prepend=-1))
    sizes = np.diff(np.append(edge, len(key)))
    keep = np.repeat(sizes > 1, sizes)
    who, at, offset, sizes = who[keep], at[keep], offset[keep], sizes[sizes > 1]
    if not len(at):
        return []
    order = s.sort(at, sizes)
    who, at, offset = who[order], at[order], offset[order]
    whole = s.cut(at, length)
    first = np.zeros(len(at), bool)
    first[np.cumsum(sizes) - sizes] = True
    pair = np.flatnonzero((whole[1:] == whole[:-1]) & ~first[1:])
    if not len(pair):
        return []
    # Collision check: runs of neighbouring windows of the same two contexts are compared byte by byte.
    a, b, o, place = who[pair], who[pair + 1], offset[pair], at[pair]
    by = np.lexsort((-o, b, a))
    a, b, o, place, place_b = a[by], b[by], o[by], place[by], at[pair + 1][by]
    starts = np.ones(len(a), bool)
    starts[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (o[1:] != o[:-1] - 1)
    cut = np.flatnonzero(starts)
    out = []
    data = s.bytes.tobytes()
    for i, j in zip(cut.tolist(), np.append(cut[1:], len(a)).tolist(), strict=True):
        x, y, n = int(place[i]), int(place_b[i]), j - i + length - 1
        if data[x : x + n] == data[y : y + n]:
            runs = [(int(o[j - 1]), int(o[i]))]
        else:  # a collision within the run: window by window
            runs = [(int(o[k]), int(o[k])) for k in range(i, j) if data[place[k] : place[k] + length] == data[place_b[k] : place_b[k] + length]]
        for low, high in runs:
            out += [(int(a[i]), low, high), (int(b[i]), low, high)]
    return out


_FOUND = "anchor long, context long, low int, high int, apart boolean"


def _sorted(length: int):
    """Contexts in the order of their anchors, and then single windows in that of their digests, to the windows that are covered, some megabytes at a time."""

    def made(rows):
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], names=["anchor", "context", "low", "high", "apart"])

    def done(rows):
        lo, hi = np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
        anchor = np.array([r[0] for r in rows], np.int64)
        return made([(*rows[k][:2], low, high, False) for k, low, high in sorted(set(covered_windows([r[4] for r in rows], lo, hi, anchor, length)))])

    def run(batches):
        rows, size, last, told = [], 0, None, False
        for batch in slices(batches, 1024, 1 << 22):
            twice = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[5]:
                    same = last is not None and row[4] == last[4]
                    if same and not told:
                        twice.append((*last[:4], True))
                    if same:
                        twice.append((*row[:4], True))
                    last, told = row, same
                    continue
                if size > 1 << 20 and row[0] != rows[-1][0]:
                    yield done(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
            if twice:
                yield made(twice)
        if rows:
            yield done(rows)

    return run


_CONTEXTS = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("bytes", pa.binary()), ("apart", pa.bool_()), ("dealt", pa.int64())])


def _windows(w: dict, text: bytes, length: int):
    """Each window of a context as a row that is dealt by its digest; anchor and offset are part of it."""
    key = w["anchor"].to_bytes(8, "little", signed=True)
    for o in range(w["hi"], w["lo"] + 1):
        at = w["pos"] - o
        digest = hashlib.blake2b(text[at : at + length], digest_size=16, key=key + o.to_bytes(4, "little")).digest()
        yield w["anchor"], w["context"], o, o, digest, True, int.from_bytes(digest[:8], "little", signed=True)


def _fetch(length: int):
    """Contexts' bytes, cut from the texts that have them; of those of an anchor with many, the digests of their windows."""

    def rows(batches):
        for batch in slices(batches, 256, 1 << 22):
            for text, wanted in zip(binary_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for w in wanted:
                    if w["apart"]:
                        yield from _windows(w, text, length)
                    else:
                        yield w["anchor"], w["context"], w["lo"], w["hi"], text[w["pos"] - w["lo"] : w["pos"] - w["hi"] + length], False, w["anchor"]

    def run(batches):
        out = []
        for row in rows(batches):
            out.append(row)
            if len(out) == 5_000:
                yield pa.record_batch([list(c) for c in zip(*out, strict=True)], schema=_CONTEXTS)
                out = []
        if out:
            yield pa.record_batch([list(c) for c in zip(*out, strict=True)], schema=_CONTEXTS)

    return run


def _runs(windows: DataFrame) -> DataFrame:
    """Single windows ``anchor, context, low`` as ``anchor, context, low, high`` of those that follow each other."""
    place = F.row_number().over(W.partitionBy("anchor", "context").orderBy("low"))
    return windows.select("anchor", "context", "low", (F.col("low") - place).alias("run")).groupBy("anchor", "context", "run").agg(F.min("low").alias("first"), F.max("low").alias("high")).select("anchor", "context", F.col("first").alias("low"), "high")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The text's hash tells rows of one id apart; a null id counts as -1 within the work."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("text_key"))


def repeated_spans(keyed: DataFrame, work: Workspace, length: int = LENGTH) -> DataFrame:
    """Of ``keyed(doc_id, text, text_key)``, each text with repeats: ``doc_id, text_key, spans array<struct<start, end>>``, ranges that cover them."""
    all_of = work.save(keyed.where(F.octet_length("text") >= length).select("doc_id", "text", "text_key").mapInArrow(_occurrences(length), "anchor long, context long, doc_id long, text_key long, pos long, lo int, hi int"))
    often = work.save(all_of.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b")).where("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed")))
    work.free()
    some = work.save(all_of.join(often, "anchor"))
    work.drop(all_of, often)
    per = work.save(some.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.bool_or("mixed").alias("mixed"), F.min(F.struct("doc_id", "text_key", "pos")).alias("rep")))
    work.free()
    whole = per.where("n > 1").select("anchor", "context", F.col("hi").alias("low"), F.col("lo").alias("high"))
    # Few: there are ``MANY`` contexts for each.
    many = work.save(per.where("mixed").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("anchor", F.lit(True).alias("apart")))
    wanted = per.where("mixed").join(many, "anchor", "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
    wanted = wanted.groupBy("rep.doc_id", "rep.text_key").agg(F.collect_list(F.struct("anchor", "context", "lo", "hi", F.col("rep.pos").alias("pos"), "apart")).alias("wanted"))
    wanted = work.save(wanted)
    # Repeated rows have the same contexts, so one of them is enough.
    fetched = keyed.join(wanted, ["doc_id", "text_key"]).select("text", "wanted").mapInArrow(_fetch(length), "anchor long, context long, lo int, hi int, bytes binary, apart boolean, dealt long")
    dealt = fetched.repartition("dealt").sortWithinPartitions("apart", "dealt", F.when(F.col("apart"), F.col("bytes")), "context")
    found = work.save(dealt.select("anchor", "context", "lo", "hi", "bytes", "apart").mapInArrow(_sorted(length), _FOUND))
    work.free()
    cover = whole.unionAll(found.where("NOT apart").drop("apart")).unionAll(_runs(found.where("apart")))
    spans = some.select("anchor", "context", "doc_id", "text_key", "pos").join(cover, ["anchor", "context"])
    spans = spans.select("doc_id", "text_key", F.struct((F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + length).alias("end")).alias("s"))
    out = work.save(spans.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("s")).alias("spans")))
    work.drop(some, per, many, wanted, found)
    work.free()
    return out


def merged(spans) -> list[tuple[int, int]]:
    """Sorted ranges as maximal ones."""
    out: list[tuple[int, int]] = []
    for s in spans or ():
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["end"]))
        else:
            out.append((s["start"], s["end"]))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def whole_words(text: bytes, start: int, end: int) -> int:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text that lie in the range with both their ends."""
    words = text[start:end].split()
    cut_first = bool(words) and start > 0 and bool(text[start - 1 : start].strip()) and bool(text[start : start + 1].strip())
    cut_last = bool(words) and end < len(text) and bool(text[end : end + 1].strip()) and bool(text[end - 1 : end].strip())
    return max(0, len(words) - cut_first - cut_last)


def _joined(docs: DataFrame, work: Workspace, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``spans``, those of strings of ``LEAST`` bytes."""
    spans = repeated_spans(_keyed(docs, id_col, text_col), work, LEAST)
    side = spans.select(F.col("doc_id").alias("span_id"), F.col("text_key").alias("span_key"), "spans")
    # The columns travel as one, so that no name of theirs meets another.
    rows = docs.select(F.struct("*").alias("cells"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("key_id"), F.xxhash64(text_col).alias("key_text"))
    both = rows.join(side, (F.col("key_id") == F.col("span_id")) & (F.col("key_text") == F.col("span_key")), "left")
    return both.select(*(F.col("cells").getField(c).alias(c) for c in docs.columns), F.col("spans").alias(fresh(docs, "spans")))


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("passage_words", pa.int64())])
_LOOKED = pa.schema([*_DIGESTS, ("text", pa.binary()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _look(batches):
    """Rows with their words in runs; those with a run of ``LENGTH`` bytes keep the text for the second time, the others are done."""
    for batch in slices(batches, 1024, 1 << 22):
        rows = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), binary_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            found = merged(spans)
            words = max((whole_words(text, a, b) for a, b in found), default=0)
            runs = [{"start": a, "end": b} for a, b in found if b - a >= LENGTH]
            rows.append((doc, len(text), 0, 0, None if runs else hashlib.sha256(text).hexdigest(), words, text if runs else None, runs))
        yield pa.record_batch([list(c) for c in zip(*rows, strict=True)], schema=_LOOKED)


def _remove(batches):
    for batch in slices(batches, 1024, 1 << 22):
        rows = []
        for doc, words, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            m = merged(spans)
            rows.append((doc, len(text), sum(b - a for a, b in m), len(m), hashlib.sha256(without(text, m)).hexdigest(), words))
        yield pa.record_batch([list(c) for c in zip(*rows, strict=True)], schema=_DIGESTS)


def removed_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, passage_words, has_passage`` of every row.

    ``passage_words`` is the most whole words that a run has, where a run is as many bytes as follow each
    other and are covered by ``LEAST``-byte strings that also start elsewhere; ``has_passage`` says that they
    are over ``WORDS``.
    """
    work = Workspace(docs.sparkSession, "suffix_dedup")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage_words long"
    looked = _joined(plain, work, "doc_id", "text").mapInArrow(_look, kinds + ", text binary, runs array<struct<start: bigint, end: bigint>>")
    looked = work.save(looked.withColumn("row", F.monotonically_increasing_id()))
    work.free()
    done, rest = looked.where("text IS NULL").drop("text", "runs", "row"), looked.where("text IS NOT NULL")
    runs = rest.select("row", "text", F.explode("runs").alias("run"))
    runs = runs.select(F.col("row").alias("doc_id"), F.col("run.start").alias("text_key"), F.expr("substring(text, CAST(run.start AS INT) + 1, CAST(run.end - run.start AS INT))").alias("text"))
    spans = repeated_spans(runs, work, LENGTH)
    moved = F.transform("spans", lambda x: F.struct((x["start"] + F.col("text_key")).alias("start"), (x["end"] + F.col("text_key")).alias("end")))
    spans = spans.select(F.col("doc_id").alias("row"), moved.alias("spans")).groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    removed = rest.join(spans, "row", "left").select("doc_id", "passage_words", "text", "spans").mapInArrow(_remove, kinds)
    return done.unionAll(removed).withColumn("has_passage", F.col("passage_words") > WORDS)


_RUNS = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("piece", pa.binary()), ("passage", pa.bool_())])


def _long_runs(batches):
    """Runs of ``LENGTH`` bytes and more of ``(row, text, spans)``, and whether each is a passage."""
    for batch in slices(batches, 1024, 1 << 22):
        rows = []
        for row, text, spans in zip(batch.column(0).to_pylist(), binary_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            rows += [(row, a, text[a:b], whole_words(text, a, b) > WORDS) for a, b in merged(spans) if b - a >= LENGTH]
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RUNS, strict=True)], schema=_RUNS)


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated passages in ``text``, and ``n_chars``, if there is one, counted anew.

    A passage is a run of over ``WORDS`` words: bytes that follow each other and are covered by ``LEAST``-byte
    strings that also start elsewhere. Where a run has fewer words, as in scripts without blanks, what
    ``LENGTH``-byte strings that also start elsewhere cover goes. A character of which a part is removed goes
    whole. Rows keep their place even if nothing is left.
    """
    work = Workspace(docs.sparkSession, "suffix_dedup")
    schema, names = docs.schema, {"spans": fresh(docs, "spans")}
    row, longer = fresh(docs, "row"), fresh(docs, "longer")
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    rows = work.save(_joined(docs, work, "doc_id", "text").withColumn(row, F.monotonically_increasing_id()))
    runs = work.save(rows.where(F.col(names["spans"]).isNotNull()).select(row, "text", names["spans"]).mapInArrow(_long_runs, "row long, start long, piece binary, passage boolean"))
    both = rows.withColumn(longer, F.lit(None).cast("array<struct<start: bigint, end: bigint>>"))
    if not runs.where("NOT passage").isEmpty():
        spans = repeated_spans(runs.select(F.col("row").alias("doc_id"), F.col("start").alias("text_key"), F.col("piece").alias("text")), work, LENGTH)
        moved = F.transform("spans", lambda x: F.struct((x["start"] + F.col("text_key")).alias("start"), (x["end"] + F.col("text_key")).alias("end")))
        found = spans.select(F.col("doc_id").alias(row), moved.alias(longer)).groupBy(row).agg(F.sort_array(F.flatten(F.collect_list(longer))).alias(longer))
        both = rows.join(found, row, "left").select(*rows.columns, longer)

    def run(batches):
        for batch in slices(batches, 1024, 1 << 22):
            n, texts = len(batch.schema), []
            spans, more = (batch.column(k).to_pylist() for k in (n - 3, n - 1))
            for null, text, some, others in zip(batch.column(at).is_null().to_pylist(), binary_texts(batch.column(at)), spans, more, strict=True):
                found = [(a, b) for a, b in merged(some) if whole_words(text, a, b) > WORDS]
                if others:
                    found = merged(sorted([{"start": a, "end": b} for a, b in found] + others, key=lambda x: x["start"]))
                texts.append(None if null else without(text, found).decode("utf-8", "ignore") if found else text.decode())
            columns = [batch.column(i) for i in range(n - 3)]
            columns[at] = pa.array(texts, batch.column(at).type)
            if chars is not None:
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.column(chars).type)
            yield pa.record_batch(columns, names=batch.schema.names[: n - 3])

    return both.mapInArrow(run, schema)
