"""N-gram Jaccard join: documents whose sets of word 5-shingles have a Jaccard similarity of 0.8 or more.

Rows with one set of shingles are a class. Sets are made anew from the texts where they are needed, which
takes less than to keep them. A set's shingles are ordered rare first, by document counts from a sketch of fixed size that all documents
enter (any fixed order gives the same links; rare first gives few candidates). The least shingle in which two
similar sets agree is in the plain prefixes of both, and the ``COMMON`` least ones are in their prefixes, which
are longer by as many. Prefix shingles are dealt to buckets, and those that one class alone has are dropped.

A shingle that up to ``FEW`` classes have is joined to pairs of them, under the length and the positional
filter, and pairs are counted. Any other is joined under a hub: the classes that have it in their plain
prefixes, if another one's length fits theirs, are members of a group whose hub is the one of least hash. The
least common shingle of two similar sets is either of the second kind, and so they share a hub, or of the
first, and so they are a pair that is met in both plain prefixes; that pair is counted ``COMMON`` times, less
the shingles of the second kind that both have in their prefixes. Other pairs go. A pair that stays is a group
too. Frequent shingles that no plain prefix has, as of a passage in many documents, make no hub. Near copies
share most of their shingles and so few hubs.

What travels to a class's groups first is its bitmap, at most a sixteenth of its set: each shingle sets a bit, so
what one class has alone is at least the bits that it alone has set. A pair belongs to the least group that both
are in. Only classes with a pair there that passes the length and the bitmap filter stay in the group, and their
sets alone travel to it, once for each such group. There pairs pass the length and the suffix filter and are then
verified once, by exact intersection, unless links found before already join their classes. What comes out are
spanning links, fewer than the group has classes, which give exactly the components of all links.

A group is sorted by size, so that a set meets those alone whose sizes fit. A group of more than two beyond
``GROUP`` shingles, where a member counts for ``MEMBER`` more, is dealt to chunks. Bitmaps meet those of each chunk; sets, if those that
stay are still as many, meet a leader in each chunk, the hub if it stays; classes that neither the leader nor
its links in the chunk reach are then compared with the other chunks, block by block.

Shingles are told apart by 64-bit hashes, sets by 128-bit digests. A text of fewer words is one shingle;
null texts and texts without words have an empty set, link with nothing and are components of their own.
Repeated rows are of one class. Rows that share an id but not their text are of their own classes under one
id. A null id names no component. An empty table gives an empty result; columns beyond the id and the text
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Workspace, binary_texts, bounded, mix, shingle_set, shuffle_parts, slices
from .components import connected_components

#: Similarity as a ratio of whole numbers, so that thresholds are exact.
NUM, DEN = 4, 5
SKETCH = 20  # bits of the sketch's places
_BLOCK = 4096
POSTING = np.dtype([("token", "<u8"), ("class", "<u8"), ("n", "<u4"), ("pos", "<u4")])
#: Shingles that the prefixes of similar sets share, as many as different sets must have in common to be similar.
COMMON = NUM // (DEN - NUM)
#: The most classes of a shingle whose pairs are counted.
FEW = 4
#: Postings of a bucket, about, and of a hot shingle within one bucket.
BUCKET_ROWS, HOT_ROWS = 400_000, 50_000
#: Shingles of all sets that a group, or a part of one, has in one task, about.
GROUP = 2_000_000
#: Shingles that a member of a group counts for besides its own, so that small sets don't make groups of very many.
MEMBER = 200
#: Parts by which the suffix filter counts a set's shingles.
CUTS = 16


_ROWS = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("hash", pa.int64()), ("class", pa.binary()), ("name", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())])


def digest(s: np.ndarray) -> bytes:
    """A class's digest; its low half is the class's name in groups."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def name_of(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def bitmap(s: np.ndarray) -> np.ndarray:
    """A set's bits, packed: two to four for each shingle, a power of two, of which its low bits choose one."""
    flags = np.zeros(1 << max(3, (2 * len(s) - 1).bit_length()), bool)
    flags[(s & np.uint64(len(flags) - 1)).astype(np.int64)] = True
    return np.packbits(flags)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps as they are with so many bytes."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def _rows(batches):
    """``doc_id, key, hash, class, name, n, bits`` of every row, and then, in rows of their own, the task's part of the sketch.

    A class's first row of the task has its bitmap. The sketch counts, for each place, the task's classes that have shingles there.
    """
    counts, seen = np.zeros(1 << SKETCH, np.int32), set()
    for batch in slices(batches, 1024, 1 << 22):
        sets = [shingle_set(t) for t in binary_texts(batch.column(3))]
        digests = [digest(x) if len(x) else None for x in sets]
        first = [d is not None and not (d in seen or seen.add(d)) for d in digests]
        places = [(x >> np.uint64(64 - SKETCH)).astype(np.int64) for x, new in zip(sets, first, strict=True) if new]
        if places:
            counts += np.bincount(np.concatenate(places), minlength=1 << SKETCH).astype(np.int32)
        none = pa.nulls(len(sets))
        columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(digests, pa.binary()), pa.array([d and name_of(d) for d in digests], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([bitmap(x).tobytes() if new else None for x, new in zip(sets, first, strict=True)], pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())]
        yield pa.record_batch(columns, schema=_ROWS)
    blocks = [k for k in range((1 << SKETCH) // _BLOCK) if counts[k * _BLOCK : (k + 1) * _BLOCK].any()]
    columns = [pa.nulls(len(blocks)).cast(f.type) for f in list(_ROWS)[:-2]]
    yield pa.record_batch([*columns, pa.array(blocks, pa.int32()), pa.array([_packed(counts[k * _BLOCK : (k + 1) * _BLOCK]) for k in blocks], pa.binary())], schema=_ROWS)


def _packed(block: np.ndarray) -> bytes:
    """A block's counts in as few bytes each as the largest takes."""
    return block.astype(np.min_scalar_type(block.max())).tobytes()


def _add_blocks(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, f"u{len(x) // _BLOCK}").astype(np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def sketch_of(parts: DataFrame) -> np.ndarray:
    """How many classes have shingles of each place, from the tasks' parts ``block, counts``. Its size is fixed."""
    rows = parts.groupBy("block").applyInArrow(_add_blocks, "block int, counts binary").toArrow()
    counts = np.zeros(1 << SKETCH, np.int64)
    for k, x in zip(rows.column("block").to_pylist(), rows.column("counts").to_pylist(), strict=True):
        counts[k * _BLOCK : (k + 1) * _BLOCK] = np.frombuffer(x, np.int64)
    return counts


def prefix(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles, rare first, of which a similar set has ``COMMON`` in its own prefix, or all that make it similar if they are fewer."""
    size = min(len(s), len(s) - -(-NUM * len(s) // DEN) + COMMON)
    place = counts[(s >> np.uint64(64 - SKETCH)).astype(np.int64)]
    return s[np.lexsort((s, place))[:size]]


def plain_size(n):
    """How many shingles of sets of these sizes, rare first, surely hold one that a similar set has among as many of its own."""
    return n + (-NUM * n) // DEN + 1


class _Held:
    """An array that travels to the tasks once, as a broadcast variable."""

    def __init__(self, array: np.ndarray):
        from pyspark.sql import SparkSession

        self._sent = SparkSession.getActiveSession().sparkContext.broadcast(array)

    @property
    def value(self) -> np.ndarray:
        return self._sent.value


def _dealer(counts, buckets: int):
    """Postings of the prefixes, in rows of many postings of one bucket; a class enters once a task."""
    usual = int(counts.mean())
    counts = _Held(counts)

    def flush(parts):
        rows = np.concatenate(parts)
        hot = counts.value[(rows["token"] >> np.uint64(64 - SKETCH)).astype(np.int64)] - 4 * usual
        salt = np.where(hot > HOT_ROWS, rows["class"] % np.maximum(1, hot // HOT_ROWS).astype(np.uint64), 0).astype(np.uint64)
        bucket = (mix(rows["token"] + mix(salt + np.uint64(1))) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        yield pa.record_batch([pa.array(bucket[cuts[:-1]], pa.int64()), pa.array([rows[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["bucket", "postings"])

    def run(batches):
        seen, parts, size = set(), [], 0
        for batch in slices(batches, 1024, 1 << 22):
            for s in map(shingle_set, binary_texts(batch.column(0))):
                d = digest(s)
                if not len(s) or d in seen:
                    continue
                seen.add(d)
                p, c = prefix(s, counts.value), int.from_bytes(d[:8], "little")
                rows = np.empty(len(p), POSTING)
                rows["token"], rows["class"], rows["n"], rows["pos"] = p, c, len(s), np.arange(len(p))
                parts.append(rows)
                size += len(rows)
                if size > 1_000_000:
                    yield from flush(parts)
                    parts, size = [], 0
        if parts:
            yield from flush(parts)

    return run


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _fits(n, m):
    """Whether sets of these sizes can be similar."""
    return NUM * np.maximum(n, m) <= DEN * np.minimum(n, m)


def _pairs_of(rows, starts, sizes):
    """Pairs of classes that share a shingle which few have, under the length and the positional filter, how often each is met, and how often in both plain prefixes."""
    out, plain = [], []
    for m in range(2, FEW + 1):
        at = starts[sizes == m]
        for i in range(m):
            for j in range(i):
                x, y = rows[at + i], rows[at + j]
                n, k, p, q = x["n"].astype(np.int64), y["n"].astype(np.int64), x["pos"].astype(np.int64), y["pos"].astype(np.int64)
                # The shingles up to this one, and those from it on, that both can have.
                most = np.minimum(p, q) + np.minimum(n - p, k - q)
                ok = _fits(n, k) & ((NUM + DEN) * most >= NUM * (n + k))
                out.append(np.stack([np.minimum(x["class"], y["class"])[ok], np.maximum(x["class"], y["class"])[ok]], 1))
                plain.append(((p < plain_size(n)) & (q < plain_size(k)))[ok])
    every = np.concatenate([np.zeros((0, 2), np.uint64), *out])
    if not len(every):
        return every, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((every[:, 1], every[:, 0]))
    every, plain = every[order], np.concatenate(plain)[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (every[1:] != every[:-1]).any(1)]))
    return every[first], np.diff(np.append(first, len(every))), np.add.reduceat(plain, first)


def _is_plain(rows):
    """Whether postings are of plain prefixes."""
    return rows["pos"] < plain_size(rows["n"].astype(np.int64))


def _spread(starts, sizes):
    """Row numbers of runs, run by run."""
    return np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _hubs_of(rows, starts, sizes):
    """Hub and class of the shingles that many classes have, of classes with it in their plain prefixes whose length another one's fits; each once."""
    rows, group = rows[_spread(starts, sizes)], np.repeat(np.arange(len(sizes)), sizes)
    plain = _is_plain(rows)
    rows, group = rows[plain], group[plain]
    # The nearest length is the next smaller or the next larger one.
    order = np.lexsort((rows["n"], group))
    n, g = rows["n"][order].astype(np.int64), group[order]
    near = (g[1:] == g[:-1]) & _fits(n[1:], n[:-1])
    keep = np.zeros(len(rows), bool)
    keep[order[1:][near]] = True
    keep[order[:-1][near]] = True
    rows, group = rows[keep], group[keep]
    begin = np.flatnonzero(np.diff(group, prepend=-1))
    hub = np.repeat(rows["class"][np.lexsort((mix(rows["class"]), group))[begin]], np.diff(np.append(begin, len(group))))
    return np.unique(np.stack([hub, rows["class"]], 1), axis=0)


_SHARED = pa.schema([("kind", pa.int8()), ("x", pa.int64()), ("y", pa.int64()), ("n", pa.int64()), ("plain", pa.int64())])
#: Kinds of rows: a pair with how often it is met, at all and in plain prefixes; a hub with a class; a hot shingle of a plain
#: prefix with a class; a class with how many shingles of its prefix make no pairs.
PAIR, HUB, LOOSE, SPARE = 0, 1, 2, 3


def _shared(hot_place):
    """Postings of a bucket to rows of the kinds above. A hot shingle lies in several buckets, so its postings come out as they are."""

    def made(kind, x, y, n=None, plain=None):
        n, plain = (np.zeros(len(x), np.int64) if c is None else c.astype(np.int64) for c in (n, plain))
        for at in range(0, len(x), 100_000):
            part = slice(at, at + 100_000)
            k = len(x[part])
            yield pa.record_batch([pa.array(np.full(k, kind, np.int8)), pa.array(_signed(x[part])), pa.array(_signed(y[part])), pa.array(n[part]), pa.array(plain[part])], schema=_SHARED)

    def one(parts):
        rows = np.unique(np.frombuffer(b"".join(parts), POSTING))
        hot = hot_place.value[(rows["token"] >> np.uint64(64 - SKETCH)).astype(np.int64)]
        loose, rows = rows[hot], rows[~hot]
        token = rows["token"]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(rows) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(rows)))
        found, times, plain = _pairs_of(rows, starts, sizes)
        yield from made(PAIR, found[:, 0], found[:, 1], times, plain)
        many = sizes > FEW
        if many.any():
            found = _hubs_of(rows, starts[many], sizes[many])
            yield from made(HUB, found[:, 0], found[:, 1])
        spare, n = np.unique(np.concatenate([rows["class"][_spread(starts[many], sizes[many])], loose["class"]]), return_counts=True)
        yield from made(SPARE, spare, spare, n)
        loose = loose[_is_plain(loose)]
        yield from made(LOOSE, loose["token"], loose["class"])

    def run(batches):
        now, parts = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != now and parts:
                    yield from one(parts)
                    parts = []
                now = bucket
                parts.append(blob)
        if parts:
            yield from one(parts)

    return run


def suffix_counts(s: np.ndarray) -> np.ndarray:
    """How many shingles a sorted set has in each of ``CUTS`` equal ranges."""
    return np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=CUTS)


class Member:
    """A class within a group: its row, set, hubs, and what part it has in the group."""

    __slots__ = ("hubs", "part", "row", "set")

    def __init__(self, row: int, blob: bytes, hubs: list[int], part: int = 0):
        self.row, self.set, self.hubs, self.part = row, np.frombuffer(blob, np.uint64), frozenset(hubs), part


#: Parts of members: a usual one, and one that all members of the other part are compared with.
CHUNK, REST = 0, 1


def spanning_links(hub: int, group: list[Member], across: bool = False) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join what all links of the group's pairs join, and each member's component.

    Pairs of which a lesser hub has charge aren't this group's. With ``across``, only pairs of a ``REST`` and a ``CHUNK`` member are.
    """
    # By size, behind the member that leads.
    order = sorted(range(len(group)), key=lambda k: (k > 0, len(group[k].set)))
    group = [group[k] for k in order]
    n = np.array([len(m.set) for m in group])
    counts = np.stack([suffix_counts(m.set) for m in group])
    part = np.array([m.part for m in group])
    label = np.arange(len(group))
    links = []
    for i in range(len(group)):
        if across and part[i] != REST:
            continue
        # Those that come later, of which sizes fit up to the last one here; across parts, those on both sides.
        low = 0 if across else i + 1
        if i:
            low = max(low, 1 + int(np.searchsorted(n[1:], -(-NUM * n[i] // DEN))))
        high = 1 + int(np.searchsorted(n[1:], DEN * n[i] // NUM, "right"))
        js = np.arange(low, high)
        if across and i and _fits(n[0], n[i]):
            js = np.append(js, 0)
        ok = label[js] != label[i]
        if across:
            ok &= part[js] == CHUNK
        js = js[ok]
        # Length and suffix filters: what the intersection can be at most.
        js = js[_fits(n[js], n[i])]
        js = js[(NUM + DEN) * np.minimum(counts[js], counts[i]).sum(1) >= NUM * (n[js] + n[i])]
        x = group[i].set
        for j in js.tolist():
            if label[i] == label[j] or min(group[i].hubs & group[j].hubs) != hub:
                continue
            y = group[j].set
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            if DEN * common >= NUM * (len(x) + len(y) - common):
                links.append((group[i].row, group[j].row))
                label[label == label[j]] = label[i]
        if not across and (label == label[0]).all():
            break
    return links, label[np.argsort(order)]


class Candidate:
    """A class within a group by its bitmap: its row, size, hubs, and the chunk of the group that it is in."""

    __slots__ = ("bits", "chunk", "hubs", "n", "row")

    def __init__(self, row: int, n: int, hubs: list[int], bits: bytes, chunk: int = 0):
        self.row, self.n, self.hubs, self.bits, self.chunk = row, n, frozenset(hubs), np.frombuffer(bits, np.uint8), chunk


def promising(hub: int, group: list[Candidate]) -> list[int]:
    """Rows of the classes that, by size and bitmap, can be similar to one with which the group has charge of their pair.

    Of two chunks, only pairs of both are looked at.
    """
    n, chunk = np.array([c.n for c in group]), np.array([c.chunk for c in group])
    two = (chunk != chunk[0]).any()
    width = np.array([len(c.bits) for c in group])
    same = {w: np.flatnonzero(width == w) for w in set(width.tolist())}
    maps = {w: np.stack([group[j].bits for j in at]) for w, at in same.items()}
    maps = {(w, size): folded(m, size) for w, m in maps.items() for size in (w, w // 2) if size}
    number = {}
    kind = np.array([number.setdefault(c.hubs, len(number)) for c in group])
    found = np.zeros(len(group), bool)
    for i, c in enumerate(group):
        # Sizes that fit differ by less than two, and so do bitmaps' by two at most.
        for w in () if found[i] else (len(c.bits) // 2, len(c.bits), 2 * len(c.bits)):
            if w not in same:
                continue
            js, size = same[w], min(w, len(c.bits))
            ok = _fits(n[js], c.n) & ((chunk[js] != chunk[i]) if two else (js != i))
            js, mine, theirs = js[ok], folded(c.bits, size), maps[w, size][ok]
            # What one alone has is at least the bits that it alone has set.
            common = np.minimum(c.n - np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64), n[js] - np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64))
            js = js[(NUM + DEN) * common >= NUM * (n[js] + c.n)]
            # One of each set of hubs tells for all of them.
            for j in js[np.unique(kind[js], return_index=True)[1]].tolist():
                if min(c.hubs & group[j].hubs) == hub:
                    found[i] = found[j] = True
                    break
            if found[i]:
                break
    return [c.row for c, yes in zip(group, found.tolist(), strict=True) if yes]


def _promising(batches):
    """Rows ``hub, cell, row, n, hubs, bits, chunk`` in the order of the first two to ``hub, row`` of those that are promising."""
    key, group, out = None, [], []

    def made():
        return pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["hub", "row"])

    for batch in slices(batches, 1024, 1 << 22):
        for hub, cell, *member in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if (hub, cell) != key:
                out += [(key[0], row) for row in promising(key[0], group)] if group else []
                key, group = (hub, cell), []
            group.append(Candidate(*member))
        if len(out) > 20_000:
            yield made()
            out = []
    if group:
        out += [(key[0], row) for row in promising(key[0], group)]
    yield made()


_FOUND = "a long, b long, rest_of long"


def _grouped(across: bool, lead_only: bool):
    """Rows ``hub, chunk, row, set, hubs, part`` in the order of the first three to spanning links.

    A class that comes twice, by repeated rows, counts once.
    With ``lead_only``, the classes that nothing joins with the hub come out too, as ``a`` and ``rest_of``.
    """

    def done(hub, group):
        # The hub leads, or who stands for it: most of a group of near copies are joined with it.
        if lead_only:
            group.sort(key=lambda m: m.part == CHUNK)
        links, label = spanning_links(hub, group, across)
        out = [(a, b, None) for a, b in links]
        if lead_only and group[0].part == REST:
            out += [(m.row, None, hub) for m, k in zip(group, label.tolist(), strict=True) if k != label[0]]
        return out

    def run(batches):
        key, group, out = None, [], []
        for batch in slices(batches, 1024, 1 << 22):
            for hub, chunk, row, blob, hubs, part in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (hub, chunk) != key:
                    if group:
                        out += done(key[0], group)
                    key, group = (hub, chunk), []
                if group and group[-1].row == row and group[-1].part == part:
                    continue
                group.append(Member(row, blob, hubs, part))
            if len(out) > 20_000:
                yield _links_batch(out)
                out = []
        if group:
            out += done(key[0], group)
        yield _links_batch(out)

    return run


def _links_batch(out) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["a", "b", "rest_of"])


def _fetched(batches):
    """Texts with the class that is looked for to its set; texts of another class have the same id and hash by chance only."""
    for batch in slices(batches, 1024, 1 << 22):
        sets = [shingle_set(t) for t in binary_texts(batch.column(0))]
        mine = pa.array([len(x) > 0 and digest(x) == c for x, c in zip(sets, batch.column(1).to_pylist(), strict=True)], pa.bool_())
        yield pa.record_batch([*batch.columns[2:], pa.array([x.tobytes() for x in sets], pa.binary())], names=[*batch.schema.names[2:], "set"]).filter(mine)


def class_links(docs: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs(doc_id, key, text)`` to its rows ``row, doc_id, key, class, name, n``, the classes ``class, row`` and spanning links ``a, b`` of the classes' rows."""
    spark = docs.sparkSession
    hashed = docs.select("doc_id", "key", F.xxhash64("text").alias("hash"), "text")
    kinds = "doc_id long, key binary, hash long, class binary, name long, n long"
    made = work.save(hashed.mapInArrow(_rows, kinds + ", bits binary, block int, counts binary").withColumn("row", F.monotonically_increasing_id()))
    rows = made.where("block IS NULL").drop("bits", "block", "counts")
    total = rows.where("class IS NOT NULL").agg(F.sum(F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1)).first()[0] or 0
    # A class's row is its first; the text of that row is where its set comes from.
    first = F.min(F.struct("row", "doc_id", "hash", "name", "n")).alias("at")
    classes = work.save(rows.where("class IS NOT NULL").groupBy("class").agg(first).select("class", "at.*"))
    counts = sketch_of(made.where("block IS NOT NULL").select("block", "counts"))
    buckets = max(4 * shuffle_parts(spark), int(total) // BUCKET_ROWS)
    dealt = docs.select("text").mapInArrow(_dealer(counts, buckets), "bucket long, postings binary")
    hot = _Held(counts - 4 * int(counts.mean()) > HOT_ROWS)
    under = work.save(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared(hot), "kind byte, x long, y long, n long, plain long"))
    work.free()
    loose = under.where(F.col("kind") == LOOSE).select(F.col("x").alias("token"), F.col("y").alias("name"))
    lead = loose.groupBy("token").agg(F.expr("min_by(name, xxhash64(name))").alias("hub"), F.count("*").alias("k")).where("k > 1").select("token", "hub")
    own = under.where(F.col("kind") == HUB).select(F.col("x").alias("hub"), F.col("y").alias("name")).unionAll(loose.join(lead, "token").select("hub", "name"))
    # Of pairs, those met often enough, or with as many other shingles in both prefixes as that takes.
    pairs = under.where(F.col("kind") == PAIR).groupBy("x", "y").agg(F.sum("n").alias("times"), F.sum("plain").alias("plain")).where("plain > 0")
    spare = under.where(F.col("kind") == SPARE).groupBy("x").agg(F.sum("n").alias("spare"))
    rare = pairs.where(F.col("times") < COMMON).join(spare, "x").join(spare.select(F.col("x").alias("y"), F.col("spare").alias("other")), "y")
    chosen = pairs.where(F.col("times") >= COMMON).select("x", "y").unionAll(rare.where(F.col("times") + F.least("spare", "other") >= COMMON).select("x", "y"))
    chosen = chosen.select(F.xxhash64("x", "y", F.lit("pair")).alias("hub"), F.explode(F.array("x", "y")).alias("name"))
    # One row for each class in a group: its groups are no more than its prefix has shingles, times ``FEW``.
    members = own.unionAll(chosen).groupBy("name").agg(F.sort_array(F.collect_set("hub")).alias("hubs"))
    needed = work.save(members.join(classes, "name").select("doc_id", "hash", "class", "row", "name", "n", "hubs"))
    work.drop(under)

    def large_of(df: DataFrame, hubs: str) -> DataFrame:
        """Groups of very many shingles by these hubs: in how many chunks, and which class leads them."""
        weight, leads = F.sum(F.col("n") + MEMBER).alias("weight"), F.coalesce(F.max(F.when(F.col("name") == F.col("hub"), F.col("name"))), F.min("name")).alias("lead")
        weights = df.select(F.explode(hubs).alias("hub"), "name", "n").groupBy("hub").agg(weight, leads, F.count("*").alias("k")).where((F.col("weight") > GROUP) & (F.col("k") > 2))
        return work.save(weights.select("hub", F.ceil(F.col("weight") / GROUP).cast("long").alias("chunks"), "lead"))

    # Bitmaps first; one of a large group meets those of each chunk.
    large = large_of(needed, "hubs")
    bits = made.where("bits IS NOT NULL").select("row", "bits").join(bounded(needed.select("row", "n", "hubs"), 100), "row")
    bits = bits.select(F.explode("hubs").alias("hub"), "row", "n", "hubs", "bits")
    bits = bits.withColumn("chunks", F.lit(1).cast("long")) if large.isEmpty() else bits.join(bounded(large, 24), "hub", "left").fillna(1, ["chunks"])
    cells = F.expr("transform(sequence(0L, chunks - 1), x -> least(x, chunk) * chunks + greatest(x, chunk))")
    bits = bits.withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks"))).withColumn("cell", F.explode(cells))
    bits = bits.select("hub", "cell", "row", "n", "hubs", "bits", "chunk").repartition("hub", "cell").sortWithinPartitions("hub", "cell")
    staying = work.save(bits.mapInArrow(_promising, "hub long, row long"))
    work.free()
    every = needed
    needed = work.save(every.join(staying.groupBy("row").agg(F.collect_set("hub").alias("own")), "row"))
    work.drop(every, staying, large)
    large = large_of(needed, "own")
    some_large = not large.isEmpty()

    def sets(wanted: DataFrame) -> DataFrame:
        texts, hashes = hashed.select("doc_id", "hash", "text"), wanted.select("hash").distinct()
        # Where the wanted classes are too many to be broadcast, their hashes may not be, so that no other texts are shuffled.
        if 200 * wanted.count() > common.BROADCAST_LIMIT >= 16 * hashes.count():
            texts = texts.join(F.broadcast(hashes), "hash", "left_semi")
        side = bounded(wanted.drop("n").withColumnRenamed("doc_id", "_id").withColumnRenamed("hash", "_hash"), 200)
        found = texts.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
        return found.select("text", "class", "row", "name", "hubs", "own").mapInArrow(_fetched, "row long, name long, hubs array<long>, own array<long>, set binary")

    def grouped(placed: DataFrame, across: bool, lead_only: bool) -> DataFrame:
        dealt = placed.select("hub", "chunk", "row", "set", "hubs", "part").repartition("hub", "chunk")
        return work.save(dealt.sortWithinPartitions("hub", "chunk", "row").mapInArrow(_grouped(across, lead_only), _FOUND))

    placed = sets(needed).select(F.explode("own").alias("hub"), "row", "set", "hubs")
    placed = placed.join(bounded(large, 24), "hub", "left_anti") if some_large else placed
    links = grouped(placed.withColumn("chunk", F.lit(0).cast("long")).withColumn("part", F.lit(CHUNK)), False, False).select("a", "b")
    work.free()
    if some_large:
        # Each chunk has the leader as its one member of the other part.
        within = needed.withColumn("hub", F.explode("own")).join(bounded(large, 24), "hub", "left_semi").select(needed.columns).distinct()
        big = work.save(sets(within)).select(F.explode("own").alias("hub"), "row", "name", "set", "hubs").join(bounded(large, 24), "hub")
        is_hub = F.col("name") == F.col("lead")
        every_chunk = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
        own = F.pmod(F.xxhash64("row"), F.col("chunks"))
        chunk = F.explode(F.when(is_hub, every_chunk).otherwise(F.array(own))).alias("chunk")
        one = grouped(big.select("*", chunk, F.when(is_hub, REST).otherwise(CHUNK).alias("part")), False, True)
        links = links.unionAll(one.where("b IS NOT NULL").select("a", "b"))
        rest = work.save(one.where("rest_of IS NOT NULL").select(F.col("rest_of").alias("hub"), F.col("a").alias("row")).distinct())
        if not rest.isEmpty():
            # Blocks of the rest against all other chunks; a block and a chunk are together of bounded size.
            mine = big.join(bounded(rest, 16), ["hub", "row"], "left_semi")
            blocks = work.save(mine.groupBy("hub").agg(F.ceil(F.sum(F.octet_length("set") / 8 + MEMBER) / GROUP).cast("long").alias("blocks")))
            cell = (F.col("block") * F.col("chunks") + F.col("at")).alias("chunk")
            with_blocks = lambda df: df.join(bounded(blocks, 16), "hub").withColumn("own", own)
            left = with_blocks(mine).withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks"))).withColumn("at", F.explode(every_chunk)).where("at <> own")
            right = with_blocks(big).withColumn("at", F.col("own")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            columns = ["hub", cell, "row", "set", "hubs"]
            two = grouped(left.select(*columns, F.lit(REST).alias("part")).unionAll(right.select(*columns, F.lit(CHUNK).alias("part"))), True, False)
            links = links.unionAll(two.select("a", "b"))
    links = work.save(links.distinct())
    work.drop(needed)
    work.free()
    return rows, classes, links


def _parted(docs: DataFrame, key, work: Workspace) -> DataFrame:
    """The rows of ``docs`` as ``row, doc_id, key, n, part``; equal parts are one component, null for an empty set."""
    rows, classes, links = class_links(docs.withColumn("key", key), work)
    parts = connected_components(links, work).select(F.col("node").alias("row"), F.col("component").alias("to"))
    of_class = work.save(classes.select("class", "row").join(parts, "row", "left").select("class", F.coalesce("to", "row").alias("part")))
    return rows.join(of_class, "class", "left").select("row", "doc_id", "key", "n", "part")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    work = Workspace(docs.sparkSession, "ngram_join")
    parted = work.save(_parted(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), F.lit(None).cast("binary"), work))
    lowest = work.save(parted.where("part IS NOT NULL").groupBy("part").agg(F.min("doc_id").alias("component_id")))
    return parted.join(lowest, "part", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest id, or one without an id if it has no other.

    Rows are told apart by id and text; of repeated rows, one stays. Rows with an empty set all stay.
    """
    work = Workspace(docs.sparkSession, "ngram_join")
    key = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    parted = _parted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key, work)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row", "key")).alias("best")
    kept = work.save(parted.where("part IS NOT NULL").groupBy("part").agg(best).select(F.col("best.doc_id").alias("_id"), F.col("best.key").alias("_kept")))
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    staying = docs.where(words).withColumn("_key", key)
    staying = staying.join(kept, (staying["_key"] == kept["_kept"]) & staying["doc_id"].eqNullSafe(kept["_id"]), "left_semi")
    return staying.dropDuplicates(["doc_id", "_key"]).drop("_key").unionAll(docs.where(~words))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh FROM w),
c AS (SELECT doc_id, len(sh) AS n, min(doc_id) OVER (PARTITION BY list_sort(sh)) AS lead, sh FROM s),
p AS (SELECT doc_id, n, unnest(sh) AS t FROM c WHERE doc_id = lead),
f AS (SELECT t FROM p GROUP BY t HAVING count(*) > 1),
q AS (SELECT p.* FROM p SEMI JOIN f USING (t)),
l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM q x JOIN q y ON x.t = y.t AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(x, y) AS (SELECT a, a FROM e UNION SELECT x, e.b FROM reach JOIN e ON reach.y = e.a),
k AS (SELECT x, min(y) AS k FROM reach GROUP BY x)
SELECT c.doc_id, c.n AS n_shingles, CASE WHEN c.n = 0 THEN c.doc_id ELSE coalesce(k.k, c.lead) END AS component_id
FROM c LEFT JOIN k ON k.x = c.lead
"""
