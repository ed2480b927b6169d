"""Exact dedup over a cuckoo-filter index of live digests.

Each task keeps a cuckoo filter of short fingerprints in front of buckets of full SHA-256 digests of
the normalised texts. A filter miss is certain; a hit is verified against the bucketed digests. The
filter doubles when an insertion overflows, rebuilt from the stored keys. Map tasks first fold their
own copies, so a text that makes up a third of all rows reaches the shuffle once per task, and the
tasks that own a digest range fold those again, in the order of the digests. An index never holds more
than ``HELD`` digests: a full one is emitted, and a new one goes on.

Nulls count as empty texts, and all empty or blank-free-equal texts form groups like any other; a null
``doc_id`` is kept out of no group but never becomes the row that stays unless the whole group is null.
Repeated rows count each. An empty table gives an empty result. Columns beyond id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh

SLOTS = 4


class CuckooIndex:
    """A cuckoo filter over 32-byte digests, backed by buckets of the digests themselves.

    ``insert`` returns the value stored under an equal digest if there is one, else None after
    storing the new one; ``delete`` removes a digest. Insertions that overflow double the table and
    place all stored keys anew, so no key is ever lost.
    """

    def __init__(self, buckets: int = 1024):
        self.count = 0
        self._start(buckets)

    def _start(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = np.zeros((buckets, SLOTS), np.uint16).tolist()
        self.store = {}  # home bucket -> {digest: value}
        self.extra = {}  # marks of digests that no table size would tell apart -> how many

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        home = int.from_bytes(digest[2:10], "little")
        return mark, home & self.mask, (home ^ (mark * 0x5BD1E995)) & self.mask

    def _seen(self, digest: bytes) -> dict | None:
        """The bucket of stored digests, if the filter says that the digest may be there."""
        mark, one, two = self._place(digest)
        if mark in self.prints[one] or mark in self.prints[two] or mark in self.extra:
            return self.store.get(one)
        return None

    def get(self, digest: bytes):
        found = self._seen(digest)
        return found.get(digest) if found else None

    def insert(self, digest: bytes, value):
        found = self._seen(digest)
        if found is not None and digest in found:
            return found[digest]
        if not self._mark(digest):
            # A full table doubles; in a mostly empty one the digests have one mark and home, which no size tells apart.
            if 4 * self.count >= SLOTS * (self.mask + 1):
                self._grow()
            if not self._mark(digest):
                self._beside(digest)
        self.store.setdefault(self._place(digest)[1], {})[digest] = value
        self.count += 1
        return None

    def replace(self, digest: bytes, value) -> None:
        self.store[self._place(digest)[1]][digest] = value

    def delete(self, digest: bytes) -> bool:
        found = self._seen(digest)
        if not found or digest not in found:
            return False
        mark, one, two = self._place(digest)
        for at in (one, two):
            if mark in self.prints[at]:
                self.prints[at][self.prints[at].index(mark)] = 0
                break
        else:
            self.extra[mark] -= 1
            if not self.extra[mark]:
                del self.extra[mark]
        del found[digest]
        self.count -= 1
        return True

    def _mark(self, digest: bytes) -> bool:
        mark, one, two = self._place(digest)
        for at in (one, two):
            if 0 in self.prints[at]:
                self.prints[at][self.prints[at].index(0)] = mark
                return True
        at, path = two, []
        for step in range(200):
            slot = step % SLOTS
            path.append((at, slot, self.prints[at][slot]))
            mark, self.prints[at][slot] = self.prints[at][slot], mark
            at = (at ^ (mark * 0x5BD1E995)) & self.mask
            if 0 in self.prints[at]:
                self.prints[at][self.prints[at].index(0)] = mark
                return True
        for at, slot, old in reversed(path):  # give every displaced mark its place back
            self.prints[at][slot] = old
        return False

    def _grow(self) -> None:
        """Twice the buckets, filled from the stored keys."""
        kept = list(self.items())
        self._start(2 * (self.mask + 1))
        for digest, value in kept:
            if not self._mark(digest):
                self._beside(digest)
            self.store.setdefault(self._place(digest)[1], {})[digest] = value

    def _beside(self, digest: bytes) -> None:
        mark = self._place(digest)[0]
        self.extra[mark] = self.extra.get(mark, 0) + 1

    def items(self):
        for bucket in self.store.values():
            yield from bucket.items()


def normalised(text: Column) -> Column:
    """Every run of blanks ``[\\x20\\x09-\\x0D]+`` as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


_FOLDED = "digest binary, keep_id long, group_size long"
_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


#: Digests that an index holds before it is emptied into the output.
HELD = 100_000
#: A group of more than this share of all rows is hot; there are fewer than its inverse.
HOT_SHARE = 1000


def _fold(ordered: bool):
    """Rows of digests to one for each. An index that is full is emitted and starts anew: where digests come in
    order, between two of them, so that each has one row; else they are partial sums for the next fold."""

    def emitted(index):
        rows = list(index.items())
        for at in range(0, len(rows), 50_000):
            part = rows[at : at + 50_000]
            yield pa.record_batch([pa.array([d for d, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())], schema=_ARROW)

    def run(batches):
        index, last = CuckooIndex(), None
        for batch in batches:
            for digest, doc, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if index.count >= HELD and (not ordered or digest != last):
                    yield from emitted(index)
                    index = CuckooIndex()
                last = digest
                old = index.insert(digest, (doc, n))
                if old is not None:
                    ids = [x for x in (old[0], doc) if x is not None]
                    index.replace(digest, (min(ids, default=None), old[1] + n))
        yield from emitted(index)

    return run


def fold_digests(digests: DataFrame) -> DataFrame:
    """``(digest, doc_id)`` to one row per digest with its smallest id and its number of rows."""
    local = digests.select("digest", "doc_id", F.lit(1).cast("long").alias("n")).mapInArrow(_fold(False), _FOLDED)
    return local.repartition("digest").sortWithinPartitions("digest").mapInArrow(_fold(True), _FOLDED)


def _hot(groups: DataFrame) -> DataFrame:
    """Groups of more than one in ``HOT_SHARE`` rows: fewer than ``HOT_SHARE``, so they can be broadcast however many rows there are."""
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    return F.broadcast(groups.where(F.col("group_size") * HOT_SHARE > total))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256. Rows of hot groups aren't shuffled."""
    work = Workspace(docs.sparkSession, "exact_dedup")
    digests = work.save(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest")))
    groups = work.save(fold_digests(digests))
    hot = _hot(groups)
    rest = digests.join(hot.select("digest"), "digest", "left_anti").join(groups, "digest")
    return digests.join(hot, "digest").unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts: with its smallest id, or null if it has none.

    Rows of hot groups that go are dropped before anything is dealt by digest.
    """
    work = Workspace(docs.sparkSession, "exact_dedup")
    mark = fresh(docs, "digest")
    keyed = docs.withColumn(mark, F.unhex(F.sha2(normalised(F.col("text")), 256)))
    groups = work.save(fold_digests(keyed.select(F.col(mark).alias("digest"), "doc_id")))
    own = lambda side: F.coalesce(keyed["doc_id"] == side["keep_id"], keyed["doc_id"].isNull() & side["keep_id"].isNull())
    hot = _hot(groups)
    first = keyed.join(hot, (keyed[mark] == hot["digest"]) & own(hot), "left_semi")
    rest = keyed.join(hot, keyed[mark] == hot["digest"], "left_anti").join(groups, (keyed[mark] == groups["digest"]) & own(groups), "left_semi")
    return first.unionAll(rest).dropDuplicates([mark]).drop(mark)


ORACLE = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
