"""Product codes of vectors, with codebooks by Lloyd's rounds over kd-trees that filter the entries.

A vector's components become integers, ``floor(scale * x)``, and are cut into equal consecutive parts. Tasks
build a kd-tree over each part position of the rows they hold at a time: halves at the median of the widest
component, and in every node the bounds of its parts, their sum and their number. The trees are written once.
In each round every entry is a candidate at the roots. Of a node's candidates, the one nearest to the middle
of its bounds drops those that no point within the bounds is nearer to; where one is left, the node's sum
and number go to it as a whole, and only the parts of leaves with more candidates are looked at one by one.
What a task sends is a sum for each entry and component. All is done in integers, so results don't depend on
how rows are dealt; the codebooks, of a size that the arguments fix, are all that the driver holds.

A row whose vector is null or holds a null, NaN or infinity is left out. Where lengths differ or aren't a
multiple of the number of parts, vectors end in as many zeros as it takes. Rows with the same id are rows of
their own; as first entries they come in the order of their vectors, rows without an id last. With fewer rows
than entries the codebooks are shorter. An empty table gives an empty result. Components so large that squared
distances need more than 64 bits are an ``OverflowError``. Columns other than id, vector and label are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, looked_up, slices

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows over which one task builds trees at a time, bytes of their vectors, and the parts that a leaf has at most.
ROWS, HELD, LEAF = 8192, 1 << 23, 8


class Tree:
    """A kd-tree over rows of integers; nodes are numbered level by level and all leaves are on the last one."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.order = np.arange(n)
        starts = np.zeros(1, np.int64)
        self.levels = []
        while True:
            ends = np.append(starts[1:], n)
            rows = x[self.order]
            low, high = np.minimum.reduceat(rows, starts), np.maximum.reduceat(rows, starts)
            self.levels.append((starts, low, high, np.add.reduceat(rows, starts)))
            if (ends - starts).max() <= LEAF:
                break
            sizes = ends - starts
            widest = np.repeat((high - low).argmax(1), sizes)
            node = np.repeat(np.arange(len(starts)), sizes)
            self.order = self.order[np.lexsort((rows[np.arange(n), widest], node))]
            # A node of one row has one child, so that no node is empty.
            halves = np.stack([starts, starts + sizes // 2], 1).ravel()
            starts = np.unique(halves)
        self.x = x[self.order]

    def packed(self) -> bytes:
        """Sizes, rows in the tree's order, and for each level the starts, bounds and sums."""
        flat = [np.array([*self.x.shape, len(self.levels), *(len(level[0]) for level in self.levels)], "<i8")]
        flat += [self.order.astype("<i4"), self.x.astype("<i4")]
        for starts, low, high, sums in self.levels:
            flat += [starts.astype("<i4"), low.astype("<i4"), high.astype("<i4"), sums.astype("<i8")]
        return b"".join(a.tobytes() for a in flat)

    @classmethod
    def unpacked(cls, blob: bytes) -> Tree:
        n, width, depth = np.frombuffer(blob, "<i8", 3).tolist()
        nodes = np.frombuffer(blob, "<i8", depth, 24).tolist()
        at = 24 + 8 * depth

        def take(rows: int, columns: int, kind: str = "<i4") -> np.ndarray:
            nonlocal at
            found = np.frombuffer(blob, kind, rows * columns, at).astype(np.int64).reshape(rows, columns)
            at += rows * columns * int(kind[-1])
            return found

        tree = cls.__new__(cls)
        tree.order, tree.x = take(n, 1).ravel(), take(n, width)
        tree.levels = [(take(k, 1).ravel(), take(k, width), take(k, width), take(k, width, "<i8")) for k in nodes]
        return tree

    def filtered(self, entries: np.ndarray):
        """Assigns every row to its nearest entry, the first of several: yields ``(entry, starts, ends, sums)`` of rows assigned together.

        Rows are in the tree's order.
        """
        n = len(self.x)
        node, possible = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
        for depth, (starts, low, high, sums) in enumerate(self.levels):
            ends = np.append(starts[1:], n)
            possible &= self._kept(low[node], high[node], entries, possible)
            one = possible.sum(1) == 1
            yield possible[one].argmax(1), starts[node[one]], ends[node[one]], sums[node[one]]
            node, possible = node[~one], possible[~one]
            if depth + 1 == len(self.levels) or not len(node):
                break
            # Children are the next level's nodes that start within the node.
            below = self.levels[depth + 1][0]
            first, last = np.searchsorted(below, starts[node]), np.searchsorted(below, ends[node])
            times = last - first
            offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            node, possible = np.repeat(first, times) + offset, np.repeat(possible, times, 0)
        if len(node):
            sizes = (ends - starts)[node]
            row = np.repeat(starts[node] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            away = _squares(self.x[row], entries)
            away[~np.repeat(possible, sizes, 0)] = np.iinfo(np.int64).max
            yield away.argmin(1), row, row + 1, self.x[row]

    @staticmethod
    def _kept(low, high, entries, possible) -> np.ndarray:
        """Entries that some point within the bounds may be assigned to.

        The difference of a point's squared distances to two entries is linear in the point, so it is least at
        the corner that lies farthest towards the one. Where it is 0, the entry with the lower number wins.
        """
        middle = _squares(low + high, 2 * entries)
        middle[~possible] = np.iinfo(np.int64).max
        best = middle.argmin(1)
        mine = entries[best][:, None, :]
        corner = np.where(entries[None] > mine, high[:, None, :], low[:, None, :])
        gain = ((corner - entries[None]) ** 2).sum(2) - ((corner - mine) ** 2).sum(2)
        number = np.arange(len(entries))
        return (gain < 0) | ((gain == 0) & (number < best[:, None])) | (number == best[:, None])


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries."""
    return ((x[:, None, :] - entries[None]) ** 2).sum(2)


def _integers(column, width: int, parts: int, scale: int) -> np.ndarray:
    """Components as integers, ``(rows, parts, components of a part)``."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * scale)
    if len(flat) and max(4 * parts, 16) * (width // parts) * float(np.abs(flat).max()) ** 2 >= 2.0**62:
        raise OverflowError("squared distances of components as large as these don't fit into 64 bits")
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out.reshape(len(sizes), parts, width // parts)


def _trees(rows: DataFrame, parts: int, width: int, scale: int) -> DataFrame:
    """``ids, labels, trees``: a row for so many rows as a task holds at a time, with a tree for each part position."""
    label = rows.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, ROWS, HELD):
            x = _integers(batch.column(2), width, parts, scale)
            once = lambda column: pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), column)  # noqa: B023, E731
            trees = [Tree(x[:, part]).packed() for part in range(parts)] if width else []
            yield pa.record_batch([once(batch.column(0)), once(batch.column(1)), pa.array([trees], pa.list_(pa.binary()))], names=["ids", "labels", "trees"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, f"ids array<long>, labels array<{label}>, trees array<binary>")


def _one_by_one(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def _round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks ``(parts, entries, components)`` after a round; entries that no part is nearest to stay."""
    parts, entries, width = books.shape

    def run(batches):
        sums = np.zeros((parts, entries, width + 1), np.int64)  # the last is the number of rows
        for row in _one_by_one(batches):
            for part, blob in enumerate(row.column(0)[0].as_py()):
                for entry, starts, ends, total in Tree.unpacked(blob).filtered(books[part]):
                    np.add.at(sums[part], entry, np.concatenate([total, (ends - starts)[:, None]], 1))
        part, entry, at = np.indices(sums.shape, np.int32)
        used = np.broadcast_to(sums[:, :, -1:] > 0, sums.shape)
        yield pa.record_batch([pa.array(c[used]) for c in (part, entry, at, sums)], names=["part", "entry", "at", "total"])

    found = trees.select("trees").mapInArrow(run, "part int, entry int, at int, total long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total")).toArrow()
    sums = np.zeros((parts, entries, width + 1), np.int64)
    sums[tuple(found.column(c).to_numpy() for c in ("part", "entry", "at"))] = found.column("total").to_numpy()
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)


def _assigned(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of all rows."""
    parts = len(books)
    label = trees.schema["labels"].dataType.elementType.simpleString()

    def run(batches):
        for row in _one_by_one(batches):
            ids, labels = row.column(0).flatten(), row.column(1).flatten()
            codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
            for part, blob in enumerate(row.column(2)[0].as_py()):
                tree = Tree.unpacked(blob)
                code = np.zeros(len(ids), np.uint8)
                for entry, starts, ends, _ in tree.filtered(books[part]):
                    sizes = ends - starts
                    code[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = np.repeat(entry, sizes)
                codes[tree.order, part] = code
                error[tree.order] += ((tree.x - books[part][code]) ** 2).sum(1)
            yield pa.record_batch([ids, labels, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return trees.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of every usable row, and the codebooks ``(parts, entries, components)``."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hexadecimal digits")
    v = F.col(vector_col).cast("array<double>")
    usable = F.col(vector_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts) * parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    books = _integers(first, width, parts, scale).transpose(1, 0, 2)
    trees = Workspace(vectors.sparkSession, "vector_codes").save(_trees(rows, parts, width, scale))
    if width:
        for _ in range(rounds):
            books = _round(trees, books)
    return _assigned(trees, books), books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_digests(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per usable row: vec_id, code, error, label_error, codebooks_sha256."""
    coded, books = vector_codes(vectors, parts, entries, rounds, scale)
    coded = Workspace(vectors.sparkSession, "vector_errors").save(coded)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    named = looked_up(coded.where("label IS NOT NULL"), sums.where("label IS NOT NULL"), "label", "rows")
    without = coded.where("label IS NULL").crossJoin(F.broadcast(sums.where("label IS NULL").select("label_error")))
    both = named.select("vec_id", "code", "error", "label_error").unionAll(without.select("vec_id", "code", "error", "label_error"))
    return both.withColumn("codebooks_sha256", F.lit(books_sha256(books)))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in SQL, for vectors of one length that the number of parts divides."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS k, vec_id, label, embedding, len(embedding) // {parts} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), flat AS (SELECT k, w, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x FROM kept),
x AS MATERIALIZED (SELECT k, i // w AS part, i % w AS pos, CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM flat),
c0 AS MATERIALIZED (SELECT k AS entry, part, pos, v FROM x WHERE k < {entries})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT x.k, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{r} c ON x.part = c.part AND x.pos = c.pos GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT k, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM d{r} GROUP BY k, part)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT a.entry, x.part, x.pos, sum(x.v) AS s, count(*) AS n FROM x JOIN a{r} a ON x.k = a.k AND x.part = a.part GROUP BY ALL),
c{r + 1} AS MATERIALIZED (
  SELECT c.entry, c.part, c.pos, CAST(CASE WHEN m.n IS NULL THEN c.v ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS BIGINT) AS v
  FROM c{r} c LEFT JOIN m{r} m ON c.entry = m.entry AND c.part = m.part AND c.pos = m.pos)""")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT k, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY k),
book AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds})
SELECT kept.vec_id, coded.code, coded.error, CAST(sum(coded.error) OVER (PARTITION BY kept.label) AS BIGINT) AS label_error, book.codebooks_sha256
FROM kept JOIN coded ON kept.k = coded.k CROSS JOIN book"""
