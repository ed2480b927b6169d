"""Closed-form scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.5, 0.75


def idf(n, df) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def smoothed_idf(n, df) -> Column:
    return F.ln((1 + n) / (1 + df)) + 1


def bm25_weight(tf, dl, avgdl, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def dot(a, b) -> Column:
    """Of two arrays of floats, added up in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(dot_product, norm_a, norm_b) -> Column:
    return dot_product / (norm_a * norm_b + 1e-12)


def wilson(hits, n, z: float = 1.96) -> Column:
    """The 95 % interval of a rate; null for no trials."""
    p = hits / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.struct(((mid - half) / (1 + z * z / n)).alias("low"), ((mid + half) / (1 + z * z / n)).alias("high")))


def upper_median(values) -> Column:
    """The element at ``n // 2`` of the sorted array."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns over a group; null if one of them doesn't vary."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread))
