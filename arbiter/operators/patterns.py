"""Many patterns sought at once: an automaton over a range of the patterns reads each text once.

Patterns are dealt to ranges of bounded size and texts to pieces, both by hash; each pair of a range and a piece
is one task's, whichever of the two is large. Neither is ever broadcast or gathered.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: About how many patterns an automaton has, and how many texts a piece.
PATTERNS, TEXTS = 100_000, 10_000


def _dealt(df: DataFrame, by: str, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with its part ``name``, and the one-row table of how many parts there are."""
    parts = F.broadcast(df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias(f"{name}s")))
    return df.crossJoin(parts).withColumn(name, F.pmod(F.xxhash64(by), F.col(f"{name}s")).cast("int")).drop(f"{name}s"), parts


def _every(df: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    return df.crossJoin(parts).withColumn(name, F.explode(F.sequence(F.lit(0), F.col(f"{name}s") - 1))).drop(f"{name}s")


def _matching(pick: Callable[[list[tuple[int, str]]], list[str]]):
    def run(texts: pa.Table, patterns: pa.Table) -> pa.Table:
        ids, names = [], []
        if len(texts) and len(patterns):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for p in patterns.column("pattern").to_pylist():
                automaton.add_word(p, p)
            automaton.make_automaton()
            for i, text in enumerate(texts.column("text").to_pylist()):
                found = pick(list(automaton.iter(text)))
                ids += [i] * len(found)
                names += found
        return pa.table({"qid": texts.column("qid").take(pa.array(ids, pa.int64())), "pattern": pa.array(names, pa.string())})

    return run


def _distinct(found):
    return sorted({p for _, p in found})


def _longest(found):
    """Of the longest, the first in order."""
    return [min((p for _, p in found), key=lambda p: (-len(p), p))] if found else []


def occurrences(texts: DataFrame, patterns: DataFrame, longest: bool = False) -> DataFrame:
    """``qid, pattern``: every one of ``patterns(pattern)`` that stands in a text of ``texts(qid, text)``, once for each row.

    With ``longest``, only the longest of each text and range of patterns, of equals the first. Null and empty
    patterns stand nowhere, null texts hold none, and letters' case counts.
    """
    p, ranges = _dealt(patterns.where("pattern <> ''").select("pattern").distinct(), "pattern", PATTERNS, "range")
    t, pieces = _dealt(texts.where("text IS NOT NULL").select("qid", "text"), "text", TEXTS, "piece")
    t = _every(t, ranges, "range")
    p = _every(p, pieces, "piece").select(F.col("range").alias("its_range"), F.col("piece").alias("its_piece"), "pattern")
    kind = texts.schema["qid"].dataType.simpleString()
    grouped = t.groupBy("range", "piece").cogroup(p.groupBy("its_range", "its_piece"))
    return grouped.applyInArrow(_matching(_longest if longest else _distinct), f"qid {kind}, pattern string")
