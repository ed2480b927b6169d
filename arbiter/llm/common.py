"""Shared helpers: tables written to the cluster's shared folder, and word-shingle hashing.

Every long job here is cut into steps whose results are written as Parquet under
``spark.checkpoint.dir``; a lost executor then costs the tasks of one step only.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast a side only when this many bytes bound it; beyond that the join shuffles.
BROADCAST_LIMIT = 24 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where the session names none and all run in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="arbiter-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_open: list[Workspace] = []


def opened() -> int:
    """How many workspaces there are; what is opened later can be closed by this number."""
    return len(_open)


def close(since: int = 0) -> None:
    """Deletes all tables of the workspaces opened since; for when their results have been written or aren't needed any more."""
    for w in _open[since:]:
        w.close()
    del _open[since:]


class Workspace:
    """Intermediate tables of one operator run, written once and read again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _open.append(self)

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._n}"
        self._n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._arbiter_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._arbiter_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def free(self) -> None:
        """Lets the driver's cleaner remove shuffle files of finished steps."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()


def bounded(df: DataFrame, bytes_per_row: int) -> DataFrame:
    """``df`` marked for broadcast if its counted size is under the limit, else as it is."""
    if df.count() * bytes_per_row <= BROADCAST_LIMIT:
        return F.broadcast(df)
    return df.hint("merge")


#: A key that more than one in so many rows have is hot; there are fewer than that.
HOT_SHARE = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined by ``key`` with ``table``, which has one row for each key and in ``size`` how many rows have it.

    Hot keys are broadcast, fewer than ``HOT_SHARE`` however many rows there are; the others are shuffled. Keys aren't null.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    hot = table.where(F.col(size) * HOT_SHARE > total)
    own = [key, *(c for c in table.columns if c not in rows.columns)]
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(size) * HOT_SHARE <= total).select(own).hint("merge"), key)
    return rows.join(F.broadcast(hot.select(own)), key).unionByName(cold)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def slices(batches, rows: int, size: int):
    """Arrow batches in parts of at most so many rows, and of about so many bytes unless a row has more.

    Only one part's texts are Python objects at a time.
    """
    for batch in batches:
        mean = max(1, batch.nbytes // max(1, batch.num_rows))
        at = 0
        while at < batch.num_rows:
            n = max(1, min(rows, size // mean))
            while n > 1 and batch.slice(at, n).nbytes > 2 * size:
                n //= 2
            yield batch.slice(at, n)
            at += n


def binary_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


# -- hashing of words and shingles ------------------------------------------------------------

M64 = (1 << 64) - 1
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64."""
    global _powers
    if len(_powers) < n:
        size = max(n, 1 << 12, 2 * len(_powers))
        p = np.full(size, BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased."""
    b = _LOWER[np.frombuffer(text, np.uint8)]
    inside = ~_SPACE[b]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    weighed = (b[at].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(weighed, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Odd multipliers of a shingle's words; fixed so that every task hashes alike.
_WEIGHTS = [np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3), np.uint64(0x1D8E4E27C47D124F)]


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word ``width``-shingles.

    With fewer words, the whole sequence is the one shingle; without words, the set is empty.
    """
    words = word_hashes(text)
    if not len(words):
        return words
    n = min(width, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = mix(total * _WEIGHTS[4] + words[k : len(words) - n + 1 + k] * _WEIGHTS[k % 5] + np.uint64(k + 1))
    if n < width:
        total = mix(total + np.full(1, n, np.uint64) * _WEIGHTS[0])
    return np.unique(total)
