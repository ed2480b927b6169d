"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Which n-grams a text has (not how often) are its features, hashed to a fixed number of places. Their
document counts by label over the training rows give log-count ratios; those that differ from chance
are kept, scaled by their ratio, and weighed by a regularised logistic regression.

Training rows are labelled documents whose ``crc32(doc_id as text) mod 3`` is not 1, at most
``MAX_ROWS`` of them, one for each id, taken by the order of the ids' checksums. The bound keeps the fit the same size
however large the corpus is; scores go to every row. A null text counts as empty and scores as any text
without features; null labels and null ids train nothing; an id labelled twice is toxic if one label
says so; very long texts are scanned whole; without usable labels every score is the smoothed rate.
Repeated rows are scored each, an empty table gives none, and other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, shuffle_parts, slices

#: The most labelled rows that the classifier is fitted on.
MAX_ROWS = 20_000
SIZES = (4, 6, 8)
PLACES = 20  # bits
#: The least absolute z-score of a log-count ratio, and the most features.
LEAST_Z, MOST_FEATURES = 4.0, 8192
THRESHOLD = 0.7
_P = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 4096


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hashed place of every character n-gram (repeats included) of the lower-cased texts."""
    low = [t.lower() for t in texts]
    lengths = np.array([len(t) + 2 for t in low])
    points = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(low), dtype=np.int32), lengths)
    whose, place = [], []
    h = points
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * _P + points[n - 1 :]
        if n in SIZES and len(h):
            inside = owner[: len(h)] == owner[n - 1 :]
            x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
            place.append((x >> np.uint64(64 - PLACES)).astype(np.int32)[inside])
            whose.append(owner[: len(h)][inside])
    return (np.concatenate(whose), np.concatenate(place)) if whose else (np.zeros(0, np.int32), np.zeros(0, np.int32))


def _chunks(texts: list[str], most: int = 1 << 19):
    """Runs of texts of about ``most`` characters together."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= most):
            size += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to


def _present(texts: list[str]):
    """For each run of texts: its start, and the distinct (text, place) pairs."""
    for at, part in _chunks(texts):
        whose, place = features(part)
        pairs = np.unique(whose.astype(np.int64) << PLACES | place)
        yield at, (pairs >> PLACES).astype(np.int64), (pairs & ((1 << PLACES) - 1)).astype(np.int64)


def _count(batches):
    counts = np.zeros((2, 1 << PLACES), np.int32)
    for batch in batches:
        toxic = np.array(batch.column(1).to_pylist(), np.int64)
        texts = [x or "" for x in batch.column(0).to_pylist()]
        for at, whose, place in _present(texts):
            for label in (0, 1):
                counts[label] += np.bincount(place[toxic[at + whose] == label], minlength=1 << PLACES).astype(np.int32)
    used = [k for k in range((1 << PLACES) // _BLOCK) if counts[:, k * _BLOCK : (k + 1) * _BLOCK].any()]
    for k in used:
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([np.ascontiguousarray(counts[:, k * _BLOCK : (k + 1) * _BLOCK]).tobytes()], pa.binary())], names=["block", "counts"])


def _select(n_neg: int, n_pos: int):
    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int32).reshape(2, _BLOCK).astype(np.int64) for x in table.column("counts").to_pylist())
        neg, pos = total[0] + 1.0, total[1] + 1.0
        ratio = np.log(pos / (n_pos + 2)) - np.log(neg / (n_neg + 2))
        z = ratio / np.sqrt(1 / pos + 1 / neg)
        keep = np.flatnonzero((np.abs(z) >= LEAST_Z) & (total.sum(0) > 0))
        return pa.table({"place": pa.array(keep + table.column("block")[0].as_py() * _BLOCK, pa.int64()), "ratio": pa.array(ratio[keep]), "z": pa.array(z[keep])})

    return run


class Model:
    """Places of the kept features, their weights (ratio times coefficient) and the intercept."""

    def __init__(self, place: np.ndarray, weight: np.ndarray, intercept: float):
        self.place, self.weight, self.intercept = place, weight, intercept

    def scores(self, texts: list[str]) -> np.ndarray:
        table = np.full(1 << PLACES, -1, np.int32)
        table[self.place] = np.arange(len(self.place))
        out = np.full(len(texts), self.intercept)
        for at, part in _chunks(texts):
            whose, place = features(part)
            found = table[place]
            hit = found >= 0
            pairs = np.unique(whose[hit].astype(np.int64) << PLACES | found[hit])
            out[at : at + len(part)] += np.bincount(pairs >> PLACES, self.weight[pairs & ((1 << PLACES) - 1)], minlength=len(part))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def _logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, ridge: float = 0.1, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient descent; the intercept isn't penalised."""
    w, v, prior = np.zeros(width + 1), np.zeros(width + 1), float(y.mean())
    w[-1] = v[-1] = np.log(prior / (1 - prior))
    square = np.bincount(rows, values**2, minlength=len(y))
    rate = 1 / (0.25 * (square.sum() / max(len(y), 1) + square.max(initial=0) + 1) * len(y) / 4 + ridge)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, values * v[cols], minlength=len(y)) + v[-1], -500, 500)))
        g = np.append(np.bincount(cols, values * (p - y)[rows], minlength=width) + ridge * v[:-1], (p - y).sum())
        new = v - rate * g
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The classifier of the labelled training rows; of an id with several texts, the least text counts."""
    work = Workspace(docs.sparkSession, "toxicity")
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("long").alias("toxic"))
    chosen = known.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # The bound on chosen rows is what makes this broadcast safe.
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("toxic").alias("toxic"))
    sample = work.save(found.repartition(shuffle_parts(docs.sparkSession), "doc_id"))
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_neg, n_pos = n.get(0, 0), n.get(1, 0)
    empty = np.zeros(0)
    if not n_neg or not n_pos:
        return Model(np.zeros(0, np.int64), empty, float(np.log((n_pos + 1) / (n_neg + 1))))
    kept = sample.select("text", "toxic").mapInArrow(_count, "block int, counts binary").groupBy("block").applyInArrow(_select(n_neg, n_pos), "place long, ratio double, z double")
    kept = kept.orderBy(F.abs("z").desc(), "place").limit(MOST_FEATURES).toArrow()
    place, ratio = kept.column("place").to_numpy(), kept.column("ratio").to_numpy()

    def mentioned(batches):
        table = np.full(1 << PLACES, -1, np.int32)
        table[place] = np.arange(len(place))
        for batch in batches:
            counts, hits = np.zeros(batch.num_rows, np.int64), []
            for at, whose, at_place in _present([x or "" for x in batch.column(1).to_pylist()]):
                col = table[at_place]
                counts += np.bincount(at + whose[col >= 0], minlength=batch.num_rows)
                hits.append(col[col >= 0])
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            values = np.concatenate(hits) if hits else np.zeros(0, np.int32)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))], names=["doc_id", "toxic", "cols"])

    # At most ``max_rows`` rows of at most ``MOST_FEATURES`` numbers, which stay arrays; in a set order, so
    # that sums of floats don't depend on how tasks ended.
    rows = sample.mapInArrow(mentioned, "doc_id long, toxic long, cols array<int>").toArrow().sort_by("doc_id").combine_chunks()
    y = rows.column("toxic").to_numpy().astype(float)
    lists = rows.column("cols").combine_chunks()
    where = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    cols = lists.flatten().to_numpy().astype(np.int64)
    weight, intercept = _logistic(where, cols, ratio[cols] if len(cols) else empty, y, len(place))
    return Model(place, weight * ratio, intercept)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""

    def run(batches):
        for batch in slices(batches, 1024, 1 << 22):
            s = model.scores([x or "" for x in batch.column(1).to_pylist()])
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't call toxic, with their own columns, whatever they are."""
    model, at = fit(docs, labels), docs.columns.index("text")

    def run(batches):
        for batch in slices(batches, 1024, 1 << 22):
            s = model.scores([x or "" for x in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(s < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
