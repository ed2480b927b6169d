"""Streams of authority: which events leave the active frontier as others arrive, and which cached answers that makes stale.

State is kept for each scope by itself, in RocksDB. It holds the members of the frontier that a rule can still
override, and for each trigger type the latest trigger while events that are earlier can still arrive. A
trigger is let go of when the watermark has passed it, a member when it is overridden or ``keep`` has run out.
An arrival looks only at members of the types that it overrides.

What comes out are facts that stay true: repeated or reordered input makes repeated or reordered facts, and
an event is active if it has come in and no row says that it is overridden.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from arbiter.plans.rules import Rule, checked

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Timers are set to whole multiples of this many milliseconds, so that a scope has few.
GRAIN_MS = 60_000


class Overriding(StatefulProcessor):
    """Members and triggers of one scope. Input: ``holder, event_id, event_type, at, is_member, is_trigger``, times in microseconds.

    Output: ``holder, event_id, event_type, state, trigger_id, looked_at``. A state is ``active`` when a member
    comes in, ``overridden`` (``trigger_id`` is the latest trigger that was known then) or ``settled`` (its time
    to be overridden has run out). With ``trace``, a row ``arrival`` says how many members each batch's triggers of a type looked at.
    """

    def __init__(self, scope: list[str], beats: dict[str, list[str]], id_type: str, keep_us: int | None, trace: bool):
        self.scope, self.beats, self.id_type, self.keep, self.trace = scope, beats, id_type, keep_us, trace

    def _fact(self, key, holder, event_id, kind, state, trigger_id=None, looked_at=None) -> Row:
        own = dict(zip(self.scope, key, strict=True))
        return Row(**own, holder=holder, event_id=event_id, event_type=kind, state=state, trigger_id=trigger_id, looked_at=looked_at)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getMapState("latest", "event_type string", f"at long, event_id {self.id_type}")
        # One map for each type, so that a trigger needn't look at others.
        self.front = {kind: handle.getMapState(f"front_{i}", f"holder string, event_id {self.id_type}", "at long") for i, kind in enumerate(sorted(self.beats))}

    def _newest(self, kind: str, known: dict) -> tuple | None:
        if kind not in known:
            known[kind] = tuple(self.latest.getValue((kind,))) if self.latest.containsKey((kind,)) else None
        return known[kind]

    def _overrider(self, kind: str, at: int, known: dict) -> tuple | None:
        """The latest known trigger that overrides a member of that type and time."""
        found = [t for trigger in self.beats.get(kind, ()) if (t := self._newest(trigger, known)) and t[0] > at]
        return max(found, default=None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known: dict[str, tuple | None] = {}
        changed: set[str] = set()
        for r in rows:
            if r.is_trigger:
                old = self._newest(r.event_type, known)
                if old is None or (r.at, r.event_id) > old:
                    known[r.event_type] = (r.at, r.event_id)
                    changed.add(r.event_type)
            if r.is_member:
                yield self._fact(key, r.holder, r.event_id, r.event_type, "active")
                if r.event_type not in self.beats:
                    continue
                if over := self._overrider(r.event_type, r.at, known):
                    yield self._fact(key, r.holder, r.event_id, r.event_type, "overridden", over[1])
                else:
                    self.front[r.event_type].updateValue((r.holder, r.event_id), (r.at,))
                    if self.keep is not None:
                        self._timer(r.at + self.keep)
        for trigger in sorted(changed):
            at, trigger_id = known[trigger]
            self.latest.updateValue((trigger,), (at, trigger_id))
            self._timer(at)
            looked = 0
            for kind, front in self.front.items():
                if trigger not in self.beats[kind]:
                    continue
                gone = []
                for member, value in front.iterator():
                    looked += 1
                    if value[0] < at:
                        gone.append(tuple(member))
                for holder, event_id in gone:
                    front.removeKey((holder, event_id))
                    yield self._fact(key, holder, event_id, kind, "overridden", trigger_id)
            if self.trace:
                yield self._fact(key, None, trigger_id, trigger, "arrival", None, looked)

    def _timer(self, at: int) -> None:
        self.handle.registerTimer((at // 1000 // GRAIN_MS + 1) * GRAIN_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
        # All that still arrives is later, so these triggers override none of it.
        for kind in [k[0] for k, v in self.latest.iterator() if v[0] < passed]:
            self.latest.removeKey((kind,))
        if self.keep is None:
            return
        for kind, front in self.front.items():
            for holder, event_id in [tuple(k) for k, v in front.iterator() if v[0] + self.keep < passed]:
                front.removeKey((holder, event_id))
                yield self._fact(key, holder, event_id, kind, "settled")


def _changes(rows: DataFrame, rules: list[Rule], keep_us: int | None, trace: bool) -> DataFrame:
    scopes = {r.scope for r in checked(rules)}
    if len(scopes) != 1:
        raise ValueError("rules must have one scope; rules of others make a stream of their own, and an event is overridden if any says so")
    scope = list(scopes.pop())
    beats: dict[str, list[str]] = {}
    for r in rules:
        beats.setdefault(r.target_type, []).append(r.trigger_type)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = dict(rows.dtypes)
    out = ", ".join(f"{c} {kinds[c]}" for c in scope) + f", holder string, event_id {kinds['event_id']}, event_type string, state string, trigger_id {kinds['event_id']}, looked_at long"
    known = rows.dropna(subset=scope)
    return known.groupBy(*scope).transformWithState(Overriding(scope, beats, kinds["event_id"], keep_us, trace), out, "Update", "EventTime")


def _rows(events: DataFrame, rules: list[Rule], holder, time: str, members: bool, triggers: bool) -> DataFrame:
    scope = rules[0].scope
    is_trigger = F.col("event_type").isin(sorted({r.trigger_type for r in rules})) & F.lit(triggers)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(*scope, holder.cast("string").alias("holder"), "event_id", "event_type", at.alias("at"), F.lit(members).alias("is_member"), is_trigger.alias("is_trigger"), F.col(time).cast("timestamp").alias("time"))


def frontier_changes(stream: DataFrame, rules: list[Rule], delay: str, keep_us: int | None = None, trace: bool = False) -> DataFrame:
    """Facts about the active frontier of a stream ``event_id, event_type, ts`` with scope columns.

    Events that come more than ``delay`` behind the latest are dropped. With ``keep_us``, an event is settled
    when the watermark is so many microseconds past it, and later triggers don't override it any more.
    """
    rows = _rows(stream, rules, F.lit(""), "ts", members=True, triggers=True)
    return _changes(rows.withWatermark("time", delay), rules, keep_us, trace).drop("holder")


def stale_retrievals(retrieved: DataFrame, arrivals: DataFrame, rules: list[Rule], delay: str, keep_us: int | None = None, trace: bool = False) -> DataFrame:
    """Facts about cached answers: ``holder`` is the question, ``overridden`` that an event in its answer no longer holds.

    ``retrieved(qid, event_id, event_type, ts, retrieved_at)`` and ``arrivals(event_id, event_type, ts)`` are
    streams with the scope's columns. An answer is taken to know all that its own watermark has passed when it
    comes in; a later arrival looks at the answers of its scope that hold members of the types it overrides.
    """
    held = _rows(retrieved, rules, F.col("qid"), "retrieved_at", members=True, triggers=False).withWatermark("time", delay)
    came = _rows(arrivals, rules, F.lit(None), "ts", members=False, triggers=True).withWatermark("time", delay)
    return _changes(held.unionByName(came), rules, keep_us, trace)
