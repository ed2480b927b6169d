"""Near duplicates among vectors by an epsilon grid order join.

Vectors of length one whose cosine is at least ``least`` are at most epsilon = sqrt(2 - 2 * least) apart.
Equal vectors are folded first. The others are turned to their principal axes, and sorted by the grid cells
(of side epsilon) of the leading axes. The sorted sequence is cut into units of bounded size, and the units
are the leaves of a tree of intervals. Beginning with the root against itself, pairs of intervals go to pairs
of their children, a level at a time: pairs of which a bound proves that no vector of one is within epsilon of
one of the other are skipped, and pairs of which a ball proves that all are need no comparison. Only units
left at the leaves travel to each other; inside, the same goes on over halves of their rows, down to blocks
whose products are computed. Products too near the threshold for rounding errors are computed exactly.

Links aren't written: a pair of units gives each vector its number of links, and as many edges as it takes
to join the components that either unit has inside. Connected components run over those.

A vector that is null, zero, empty or holds a null, NaN or infinity links with nothing and is a component of
its own. Vectors of different lengths don't link. Every row is a vector, rows with the same id included:
equal rows link with each other; a row without an id links like others, and ids that are null are no
``component_id`` unless all of a component are; it isn't ``kept``. An empty table gives an empty result.
Columns beyond id and vector are ignored.
"""

from __future__ import annotations

import functools
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, looked_up, shuffle_parts
from .components import connected_components

LEAST = 0.95
#: Leading axes whose cells order the vectors.
AXES = 16
#: Bytes of a unit's vectors; it has so many rows at most.
UNIT_BYTES = 1 << 22
#: Rows of a block that is compared as a whole.
BLOCK = 256
#: Children of an interval of units, as a number of bits.
BITS = 3
#: What rounding may add to a sum of products of unit vectors, or to a distance; many times its worst case.
ROUNDING = 1e-9


# -- the leading axes ---------------------------------------------------------------------------------


def _moments(batches):
    """Sums of products of the directions' components and of the components, one row for each component."""
    sums = None
    for batch in batches:
        for _, v, _ in _by_length(batch.column(0)):
            one = np.concatenate([_directions(v), np.ones((len(v), 1))], 1)
            sums = one.T @ one if sums is None else sums + one.T @ one
    if sums is not None:
        yield pa.record_batch([pa.array(range(len(sums)), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], names=["i", "m"])


def _by_length(column):
    """Length, vectors and places of the vectors of a list column, for each length."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, flat[starts[at][:, None] + np.arange(d)], at


def _directions(x: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """The most frequent length of ``vectors(v)`` and that length's axes, the widest first: as many numbers as its square.

    Vectors of another length are sorted by their own leading components; any orthogonal axes give right results.
    """
    found = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = found.d if found else 1
    parts = vectors.where(F.size("v") == d).select("v").mapInArrow(_moments, "i int, m array<double>")
    sums = parts.select("i", F.posexplode("m").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    m = np.zeros((d + 1, d + 1))
    m[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("x").to_numpy()
    n = max(1.0, m[d, d])
    mean = m[:d, d] / n
    _, turned = np.linalg.eigh(m[:d, :d] / n - np.outer(mean, mean))
    return d, np.ascontiguousarray(turned[:, ::-1])


def _turned(v: np.ndarray, axes: tuple[int, np.ndarray]) -> np.ndarray:
    x = _directions(v)
    return x @ axes[1] if v.shape[1] == axes[0] else x


# -- bounds on intervals ------------------------------------------------------------------------------


def box_of(x: np.ndarray, at: np.ndarray, axes: int):
    """Bounds of the stretches of rows that begin at ``at``: the least and greatest of the leading components and of
    the length of what is left of each row, their centres, and the farthest that a row is from its centre."""
    rest = np.sqrt(np.maximum(0, (x[:, axes:] ** 2).sum(1, keepdims=True)))
    lead = np.concatenate([x[:, :axes], rest], 1)
    sizes = np.diff(np.append(at, len(x)))
    centre = np.add.reduceat(x, at) / sizes[:, None]
    away = np.sqrt(((x - np.repeat(centre, sizes, 0)) ** 2).sum(1))
    return np.minimum.reduceat(lead, at), np.maximum.reduceat(lead, at), centre, np.maximum.reduceat(away, at)


def distant(low_a, high_a, low_b, high_b, epsilon: float) -> np.ndarray:
    """Whether no row of one is within epsilon of one of the other. The rest's lengths differ by no more than the rests do."""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return (gap * gap).sum(-1) > (epsilon + ROUNDING) ** 2


def near(centre_a, far_a, centre_b, far_b, epsilon: float) -> np.ndarray:
    """Whether every row of both is within epsilon of every other."""
    return np.sqrt(((centre_a - centre_b) ** 2).sum(-1)) + 2 * np.maximum(far_a, far_b) <= epsilon - ROUNDING


# -- the join inside a pair of units --------------------------------------------------------------------


def _exactly(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    """Whether the cosine of two vectors, computed without rounding, is at least ``least`` (a positive number)."""
    x, y = ([Fraction(v) for v in each] for each in (a.tolist(), b.tolist()))
    dot, size = sum(p * q for p, q in zip(x, y, strict=True)), sum(p * p for p in x) * sum(q * q for q in y)
    return dot > 0 and dot * dot >= least * least * size


class _Side:
    """A unit's rows, turned to the axes, with the bounds of its blocks and of their halving tree."""

    def __init__(self, x: np.ndarray, axes: int):
        self.x = x
        at = np.arange(0, len(x), BLOCK)
        self.at = np.append(at, len(x))
        bounds = [box_of(x, at, axes)]
        while len(bounds[-1][0]) > 1:
            low, high, centre, far = bounds[-1]
            pairs = np.arange(0, len(low), 2)
            n = np.diff(np.append(pairs, len(low)))
            middle = np.add.reduceat(centre, pairs) / n[:, None]
            reach = np.sqrt(((centre - np.repeat(middle, n, 0)) ** 2).sum(1)) + far
            bounds.append((np.minimum.reduceat(low, pairs), np.maximum.reduceat(high, pairs), middle, np.maximum.reduceat(reach, pairs)))
        self.bounds = bounds  # from the blocks up

    def level(self, k: int):
        return self.bounds[min(k, len(self.bounds) - 1)]

    def rows(self, k: int, i: int) -> slice:
        """The rows of interval ``i`` of a level."""
        k = min(k, len(self.bounds) - 1)
        return slice(self.at[min(i << k, len(self.at) - 1)], self.at[min((i + 1) << k, len(self.at) - 1)])

    def children(self, k: int, i: np.ndarray) -> np.ndarray:
        """Two numbers for each interval, of which the second may not exist."""
        return np.stack([i, np.full(len(i), len(self.at))], 1) if k > len(self.bounds) - 1 else np.stack([2 * i, 2 * i + 1], 1)


class _Union:
    """Sets of numbers; many links are sought at once, and those within a set cost no step of their own."""

    def __init__(self, n: int):
        self.home = np.arange(n)
        self.joined: list[tuple[int, int]] = []

    def find(self, x: np.ndarray) -> np.ndarray:
        up = self.home[x]
        while (far := self.home[up] != up).any():
            up = np.where(far, self.home[up], up)
        self.home[x] = up
        return up

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Joins the sets of ``x[i]`` and ``y[i]`` and keeps one link for each that joined two."""
        p, q = self.find(x), self.find(y)
        pairs, first = np.unique(np.minimum(p, q) * len(self.home) + np.maximum(p, q), return_index=True)
        for pair, i in zip(pairs.tolist(), first.tolist(), strict=True):
            one, two = (int(self.find(np.array([z]))[0]) for z in divmod(pair, len(self.home)))
            if one != two:
                self.home[max(one, two)] = min(one, two)
                self.joined.append((int(x[i]), int(y[i])))


def interval_join(a: _Side, b: _Side | None, least: float, exact, found, whole) -> None:
    """All links of the rows of ``a`` with those of ``b``, or of ``a`` with each other if ``b`` is None.

    ``found(i, j)`` gets the numbers of linked rows, ``whole(rows of a, rows of b)`` intervals linked altogether,
    of ``a`` with itself included; ``exact(i, j)`` decides a pair too close to call.
    """
    same, b = b is None, b or a
    epsilon = math.sqrt(max(0.0, 2 - 2 * least))
    k = max(len(a.bounds), len(b.bounds)) - 1
    i = j = np.zeros(1, np.int64)
    while len(i):
        (low_a, high_a, mid_a, far_a), (low_b, high_b, mid_b, far_b) = a.level(k), b.level(k)
        keep = ~distant(low_a[i], high_a[i], low_b[j], high_b[j], epsilon)
        i, j = i[keep], j[keep]
        all_near = near(mid_a[i], far_a[i], mid_b[j], far_b[j], epsilon)
        for p, q in zip(i[all_near].tolist(), j[all_near].tolist(), strict=True):
            whole(a.rows(k, p), b.rows(k, q))
        i, j = i[~all_near], j[~all_near]
        if k == 0:
            break
        ci, cj = a.children(k, i), b.children(k, j)
        i, j = np.repeat(ci, 2, 1).ravel(), np.tile(cj, (1, 2)).ravel()
        k -= 1
        there = (i < len(a.level(k)[0])) & (j < len(b.level(k)[0])) & ((i <= j) | (not same))
        i, j = i[there], j[there]
    for p in np.unique(i).tolist():
        of = a.rows(0, p)
        for q in j[i == p].tolist():
            to = b.rows(0, q)
            product = a.x[of] @ b.x[to].T
            r, c = np.nonzero(product >= least - ROUNDING)
            if same and p == q:
                r, c = r[r < c], c[r < c]
            unsure = np.flatnonzero(product[r, c] < least + ROUNDING)
            if len(unsure):
                sure = np.ones(len(r), bool)
                sure[unsure] = [exact(of.start + x, to.start + y) for x, y in zip(r[unsure].tolist(), c[unsure].tolist(), strict=True)]
                r, c = r[sure], c[sure]
            if len(r):
                found(r + of.start, c + to.start)


# -- units and pairs of them ----------------------------------------------------------------------------

def _unpack(table: pa.Table):
    """Row numbers, weights and vectors as given of a unit's rows, in the order of their numbers."""
    table = table.sort_by("row")
    x = table.column("v").combine_chunks()
    return table.column("row").to_numpy(), table.column("weight").to_numpy(), x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


_UNIT = "unit long, d int, n long, weight long, first long, low array<double>, high array<double>, centre array<double>, far double"
_LIST = pa.list_(pa.float64())
_UNIT_ARROW = pa.schema([("unit", pa.int64()), ("d", pa.int32()), ("n", pa.int64()), ("weight", pa.int64()), ("first", pa.int64()), ("low", _LIST), ("high", _LIST), ("centre", _LIST), ("far", pa.float64())])


def _unit_bounds(axes):
    def run(key, table: pa.Table) -> pa.Table:
        row, weight, v = _unpack(table)
        low, high, centre, far = box_of(_turned(v, axes), np.zeros(1, np.int64), min(AXES, v.shape[1]))
        numbers = {"unit": key[0].as_py(), "d": v.shape[1], "n": len(row), "weight": int(weight.sum()), "first": int(row[0])}
        return pa.Table.from_pylist([numbers | {"low": low[0].tolist(), "high": high[0].tolist(), "centre": centre[0].tolist(), "far": float(far[0])}], schema=_UNIT_ARROW)

    return run


#: kind: a row's links (0), or an edge between the components of two rows (1).
_FOUND = "kind int, row long, x long"


def _pair_join(axes, least: float):
    least_exactly = Fraction(least)

    def run(key, table: pa.Table) -> pa.Table:
        one, two = key[0].as_py(), key[1].as_py()
        same = one == two
        units = [table.filter(pc.equal(table.column("unit"), u)) for u in ([one] if same else [one, two])]
        rows, weights, given = zip(*map(_unpack, units), strict=True)
        sides = [_Side(_turned(v, axes), min(AXES, v.shape[1])) for v in given]
        row, weight = np.concatenate(rows), np.concatenate(weights)
        # Numbers of the second unit's rows go on after those of the first.
        start, last = (0, 0) if same else (len(rows[0]), 1)
        links, union = np.zeros(len(row), np.int64), _Union(len(row))

        def found(p, q):
            q = q + start
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
            union.join(p, q)

        def whole(p: slice, q: slice):
            p, q = np.arange(p.start, p.stop), np.arange(q.start, q.stop) + start
            if same and p[0] == q[0]:  # a row's own weight is counted with the equal vectors
                links[p] += weight[p].sum() - weight[p]
                union.join(p[1:], np.repeat(p[:1], len(p) - 1))
            else:  # either side is also linked with itself, here or where its unit meets itself
                links[p] += weight[q].sum()
                links[q] += weight[p].sum()
                union.join(p[:1], q[:1])

        interval_join(sides[0], None if same else sides[1], least, lambda p, q: _exactly(given[0][p], given[last][q], least_exactly), found, whole)
        some = np.flatnonzero(links)
        ends = row[np.array(union.joined, np.int64).reshape(-1, 2)]
        kind = np.repeat(np.int32([0, 1]), [len(some), len(ends)])
        return pa.table({"kind": kind, "row": np.concatenate([row[some], ends[:, 0]]), "x": np.concatenate([links[some], ends[:, 1]])})

    return run


def _gap(a: str, b: str):
    """Squared distance of two boxes."""
    below = F.zip_with(F.col(f"{a}.low"), F.col(f"{b}.high"), lambda p, q: p - q)
    above = F.zip_with(F.col(f"{b}.low"), F.col(f"{a}.high"), lambda p, q: p - q)
    sides = F.zip_with(below, above, lambda p, q: F.greatest(F.lit(0.0), p, q))
    return F.aggregate(sides, F.lit(0.0), lambda s, x: s + x * x)


def _apart(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x))


def _parents(nodes: DataFrame) -> DataFrame:
    """One level up: ``BITS`` bits of the number less, with boxes and balls around those of the children."""
    up = nodes.groupBy("d", F.shiftright("node", BITS).alias("node")).agg(
        F.collect_list(F.struct("low", "high", "centre", "far", "n")).alias("of"), F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.min("first").alias("first")
    )
    each = lambda name, fold: F.expr(f"transform(sequence(0, size(of[0].{name}) - 1), i -> {fold})")
    up = up.select(
        "d", "node", "n", "weight", "first", "of",
        each("low", "array_min(transform(of, x -> x.low[i]))").alias("low"),
        each("high", "array_max(transform(of, x -> x.high[i]))").alias("high"),
        each("centre", "aggregate(of, 0D, (s, x) -> s + x.centre[i] * x.n) / n").alias("centre"),
    )
    reach = F.array_max(F.transform("of", lambda x: _apart(x["centre"], F.col("centre")) + x["far"]))
    return up.withColumn("far", reach).drop("of")


def _expand(levels: list[DataFrame], epsilon: float, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Pairs of units left to compare, and for each level pairs of intervals that are linked altogether.

    ``levels``: the nodes from the units up to the roots, one for each length of vectors.
    """
    pairs = levels[-1].select("d", F.col("node").alias("a"), F.col("node").alias("b"))
    wholes = None
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k].select("d", "node", F.struct("low", "high", "centre", "far").alias("box"))
        if k < len(levels) - 1:
            children = nodes.select("d", F.shiftright("node", BITS).alias("up"), F.col("node").alias("child"))
            pairs = pairs.join(children.select("d", F.col("up").alias("a"), F.col("child").alias("a_child")), ["d", "a"]).join(children.select("d", F.col("up").alias("b"), F.col("child").alias("b_child")), ["d", "b"])
            pairs = pairs.where("a_child <= b_child").select("d", F.col("a_child").alias("a"), F.col("b_child").alias("b"))
        boxed = pairs.join(nodes.select("d", F.col("node").alias("a"), F.col("box").alias("p")), ["d", "a"]).join(nodes.select("d", F.col("node").alias("b"), F.col("box").alias("q")), ["d", "b"])
        boxed = boxed.where(_gap("p", "q") <= (epsilon + ROUNDING) ** 2)
        whole = _apart(F.col("p.centre"), F.col("q.centre")) + 2 * F.greatest("p.far", "q.far") <= epsilon - ROUNDING
        now = work.save(boxed.select("d", "a", "b", whole.alias("whole")))
        done = now.where("whole").select(F.lit(k).alias("level"), "d", "a", "b")
        wholes = done if wholes is None else wholes.unionAll(done)
        pairs = now.where("NOT whole").select("d", "a", "b")
    return pairs, wholes


def _usable(v):
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _sequence(vectors: DataFrame, axes, epsilon: float, work: Workspace) -> DataFrame:
    """``d, unit, row, weight, v, first_id``: vectors numbered in the order of their cells, and dealt to units of neighbours."""

    def cells(batches):
        for batch in batches:
            out: list = [None] * batch.num_rows
            for _, v, at in _by_length(batch.column(0)):
                found = np.floor(_turned(v, axes)[:, :AXES] / max(epsilon, ROUNDING)).astype(np.int64)
                for i, c in zip(at.tolist(), found.tolist(), strict=True):
                    out[i] = c
            yield pa.record_batch([*batch.columns[:3], pa.array(out, pa.list_(pa.int64()))], names=["v", "first_id", "weight", "cells"])

    gridded = vectors.select("v", "first_id", "weight").mapInArrow(cells, "v array<double>, first_id long, weight long, cells array<long>")
    order = [F.size("v"), F.col("cells"), F.xxhash64("v"), F.col("v")]
    ordered = gridded.repartitionByRange(shuffle_parts(vectors.sparkSession), *order).sortWithinPartitions(*order)
    numbered = work.save(ordered.select(F.monotonically_increasing_id().alias("row"), "first_id", "weight", "v"))
    # A number's upper bits are its partition's; one row for each partition and length says how many come before.
    numbered = numbered.withColumn("d", F.size("v")).withColumn("part", F.shiftright("row", 33))
    parts = numbered.groupBy("d", "part").agg(F.count("*").alias("n"), F.min("row").alias("part_first"))
    earlier = Window.partitionBy("d").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("d", "part", "part_first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.col("row") - F.col("part_first") + F.col("before")
    size = F.greatest(F.lit(BLOCK), F.expr(f"{UNIT_BYTES} div (8 * d)"))
    return work.save(numbered.join(F.broadcast(parts), ["d", "part"]).select("d", F.floor(place / size).alias("unit"), "row", "weight", "v", "first_id"))


def _whole_links(levels: list[DataFrame], wholes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What intervals linked altogether give: ``row, x`` links of rows, and ``a, b`` edges.

    An interval linked with another is also linked with itself, there or as a part of a larger one. So one edge
    joins the two, and each row of an interval that is linked with itself has one to the interval's first row.
    """
    units = levels[0].select("d", F.col("node").alias("unit"))
    both = wholes.unionAll(wholes.where("a <> b").select("level", "d", F.col("b").alias("a"), F.col("a").alias("b")))
    gains, edges = [], []
    for k, level in enumerate(levels):
        named = level.select("d", F.col("node").alias("b"), "weight", "first")
        at = both.where(F.col("level") == k).join(named, ["d", "b"])
        own = F.col("a") == F.col("b")
        gain = at.groupBy("d", "a").agg(F.sum("weight").alias("extra"), F.min(F.when(own, F.col("first"))).alias("own_first"))
        gains.append(gain.join(units.withColumn("a", F.shiftright("unit", k * BITS)), ["d", "a"]).select("d", "unit", "extra", "own_first"))
        firsts = level.select("d", F.col("node").alias("a"), F.col("first").alias("a_first"))
        edges.append(at.where("a < b").join(firsts, ["d", "a"]).select(F.col("a_first").alias("a"), F.col("first").alias("b")))
    gain = functools.reduce(DataFrame.unionAll, gains).groupBy("d", "unit").agg(F.sum("extra").alias("extra"), F.min("own_first").alias("own_first"))
    linked = rows.join(gain, ["d", "unit"])
    edges.append(linked.select(F.col("row").alias("a"), F.col("own_first").alias("b")))
    return linked.select("row", (F.col("extra") - F.col("weight")).alias("x")), functools.reduce(DataFrame.unionAll, edges)


def link_components(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """Distinct usable vectors ``(v, first_id, weight)`` to ``(v, weight, n_links, component_id)``."""
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    work = Workspace(vectors.sparkSession, "epsilon_join")
    epsilon = math.sqrt(max(0.0, 2 - 2 * least))
    axes = principal_axes(vectors)
    rows = _sequence(vectors, axes, epsilon, work)
    bounds = rows.select("unit", "d", "row", "weight", "v").groupBy("unit", "d").applyInArrow(lambda key, table: _unit_bounds(axes)(key, table), _UNIT)
    levels = [work.save(bounds.withColumnRenamed("unit", "node"))]
    while levels[-1].agg(F.max("node")).first()[0]:
        levels.append(work.save(_parents(levels[-1])))
    pairs, wholes = _expand(levels, epsilon, work)

    # Each row goes to the pairs of its unit; a pair has two units at most.
    places = pairs.select("d", "a", "b", F.col("a").alias("unit")).unionAll(pairs.where("a <> b").select("d", "a", "b", F.col("b").alias("unit")))
    dealt = places.join(rows.select("d", "unit", "row", "weight", "v"), ["d", "unit"])
    compared = work.save(dealt.groupBy("a", "b", "d").applyInArrow(lambda key, table: _pair_join(axes, least)(key, table), _FOUND))

    whole_links, whole_edges = _whole_links(levels, wholes, rows)
    edges = compared.where("kind = 1").select(F.col("row").alias("a"), F.col("x").alias("b")).unionAll(whole_edges)
    component = work.save(connected_components(edges, work)).withColumnRenamed("node", "row")
    links = compared.where("kind = 0").select("row", "x").unionAll(whole_links).groupBy("row").agg(F.sum("x").alias("links"))
    told = rows.select("row", "v", "weight", "first_id").join(links, "row", "left").join(component, "row", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("weight") - 1
    told = work.save(told.select("v", "weight", "first_id", n_links.alias("n_links"), F.coalesce("component", "row").alias("component")))
    ids = work.save(told.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("size")))
    return looked_up(told, ids, "component", "size").select("v", "weight", "n_links", "component_id")


def near_duplicates(vectors: DataFrame, least: float = LEAST, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    work = Workspace(vectors.sparkSession, "near_vectors")
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    given = given.withColumn("usable", _usable(F.col("v")))
    # Zeros of either sign are one value, as in a grouping.
    usable = given.where("usable").select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    distinct = work.save(usable.groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight")))
    told = work.save(link_components(distinct, least))
    linked = looked_up(usable, told, "v", "weight").select("vec_id", "n_links", "component_id")
    alone = given.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER () AS k,
         embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings
), good AS (SELECT *, len(e) AS d FROM v WHERE usable),
links AS (SELECT a.k, a.vec_id, b.k AS k2, b.vec_id AS vec_id2 FROM good a JOIN good b ON a.d = b.d AND a.k <> b.k AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT k AS root, k, vec_id FROM v UNION SELECT r.root, l.k2, l.vec_id2 FROM reach r JOIN links l ON r.k = l.k),
low AS (SELECT root, min(vec_id) AS component_id FROM reach GROUP BY root),
n AS (SELECT k, count(*) AS n_links FROM links GROUP BY k)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, low.component_id, coalesce(v.vec_id = low.component_id, false) AS kept
FROM v JOIN low ON low.root = v.k LEFT JOIN n ON n.k = v.k
"""
