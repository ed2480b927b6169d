"""Structured Streaming: the latest record and the active frontier of each scope, kept as events arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.operators import graph
from arbiter.plans.rules import Rule


def latest_per_scope(stream: DataFrame, scope: list[str], delay: str | None = None) -> DataFrame:
    """Latest event per scope, for update mode; ``delay`` bounds the state by a watermark of daily windows."""
    best = F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", -F.col("event_id"))).alias("b")
    if delay is None:
        return stream.groupBy(*scope).agg(best).select(*scope, "b.*")
    s = stream.withWatermark("ts", delay)
    return s.groupBy(F.window("ts", "1 day"), *scope).agg(best).select(*scope, F.col("window.end").alias("until"), "b.*")


def latest_trigger_state(stream: DataFrame, rules: list[Rule], scope: list[str]) -> DataFrame:
    """Per scope and event type the latest time: all that the frontier of later batches needs."""
    kinds = sorted({r.trigger_type for r in rules})
    return stream.where(F.col("event_type").isin(kinds)).groupBy(*scope, "event_type").agg(F.max("ts").alias("latest"))


def frontier_writer(rules: list[Rule], scope: list[str], history: Callable[[], DataFrame], emit: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the frontier of the scopes that a batch touches, over ``history()`` and the batch.

    Edges compare event times only, so a late event joins as trigger and as target, and the outcome
    doesn't depend on the order of arrival. Replaying a batch gives the same rows.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select(*scope).distinct()
        events = history().unionByName(batch).dropDuplicates(["event_id"]).join(touched, scope, "left_semi")
        emit(graph.active(events, rules), batch_id)

    return run
