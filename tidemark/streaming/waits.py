"""Streams of chat events: whitelisting, bounded buffers, debounced waits with a cap, deadlines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


#: Seconds until a second look, least cap, events that a buffer holds, deadlines of a ready context.
RECHECK, LEAST_CAP, BUFFER, DEADLINE, MATERIALS = 3, 60, 200, 15, 13

EVENT = T.StructType.fromJson(
    {
        "type": "struct",
        "fields": [
            {"name": n, "type": t, "nullable": True, "metadata": {}}
            for n, t in (("chat_id", "string"), ("sender_id", "string"), ("is_self", "boolean"), ("resync", "boolean"), ("sequence", "long"), ("message_id", "string"), ("kind", "integer"), ("received_at", "long"), ("text", "string"))
        ],
    }
)


def event_stream(spark, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(path)


def whitelisted(events: DataFrame, targets: list[str]) -> DataFrame:
    """The known fields of events of the named chats; text of plain messages only."""
    kept = events.where(F.col("chat_id").isin(targets))
    return kept.select(*[F.when(F.col("kind") == 1, F.col("text")).alias("text") if f == "text" else F.col(f) for f in EVENT.names])


def buffered(events: DataFrame, size: int = BUFFER) -> DataFrame:
    """A batch form of the bounded buffer: the newest ``size`` events of each chat; dropped counts the older ones."""
    w = Window.partitionBy("chat_id")
    r = events.withColumn("_r", F.row_number().over(w.orderBy(F.desc("sequence")))).withColumn("_n", F.count(F.lit(1)).over(w))
    return r.where(F.col("_r") <= size).withColumn("dropped", F.greatest(F.col("_n") - size, F.lit(0))).drop("_r", "_n")


def received(events: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """At most ``limit`` (1 to 100) of the oldest events and how many remain."""
    limit = min(max(limit, 1), 100)
    return events.orderBy("sequence").limit(limit), max(0, events.count() - limit)


def newer(messages: DataFrame, since: int, time: str = "create_time") -> DataFrame:
    """Strictly after: a message in the same second isn't new."""
    return messages.where(F.col(time) > since)


def next_since(messages: DataFrame, since: int, time: str = "create_time") -> int:
    return messages.agg(F.coalesce(F.max(time), F.lit(since))).head()[0]


@dataclass(frozen=True)
class Wait:
    """The pending wake of a chat: first and last waking event, and when to look at the record again."""

    first: float | None = None
    last: float | None = None
    recheck: float | None = None

    def due(self, settle: float) -> float | None:
        """When it fires: a quiet gap after the last event, no later than the cap after the first."""
        return None if self.first is None else min(self.last + settle, self.first + max(LEAST_CAP, settle))

    def on_event(self, now: float, is_self: bool = False, resync: bool = False, include_self: bool = False) -> Wait:
        if resync:
            return self if self.first is not None else replace(self, recheck=now + RECHECK)
        if is_self and not include_self:
            return Wait(recheck=now + RECHECK)
        return replace(self, first=now if self.first is None else self.first, last=now)

    def on_record(self, now: float, wakes: bool) -> Wait:
        """After the second look: the record, not the event, decides."""
        return Wait(now, now) if wakes and self.first is None else replace(self, recheck=None)


WAKE = T.StructType([T.StructField("chat_id", T.StringType()), T.StructField("first", T.DoubleType()), T.StructField("last", T.DoubleType()), T.StructField("fired", T.DoubleType()), T.StructField("reason", T.StringType())])


class DebouncedWait(StatefulProcessor):
    """One wake per burst of events of a chat; own events cancel a pending wake and ask for a second look.

    Rows out: reason settled, capped or recheck. Use with ``transformWithStateInPandas`` keyed by
    chat_id and processing time. Consumers re-read the messages (``newer``) before they act.
    """

    def __init__(self, settle: float = 15.0, include_self: bool = False):
        self.settle, self.include_self = settle, include_self

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("wait", "first double, last double, recheck double")

    def _load(self) -> Wait:
        return Wait(*self.state.get()) if self.state.exists() else Wait()

    def _store(self, wait: Wait) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.state.update((wait.first, wait.last, wait.recheck))
        for at in (wait.due(self.settle), wait.recheck):
            if at is not None:
                self.handle.registerTimer(int(at * 1000))

    @staticmethod
    def _row(chat: str, wait: Wait, now: float, reason: str) -> pd.DataFrame:
        text = {"chat_id": pd.Series([chat], dtype=object), "reason": pd.Series([reason], dtype=object)}
        return pd.DataFrame(text | {"first": pd.Series([wait.first], dtype="float64"), "last": pd.Series([wait.last], dtype="float64"), "fired": [now]})[WAKE.names]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, wait = timerValues.getCurrentProcessingTimeInMs() / 1000, self._load()
        for frame in rows:
            for e in frame.sort_values("sequence").itertuples():
                wait = wait.on_event(now, bool(e.is_self), bool(e.resync), self.include_self)
        self._store(wait)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, wait = expiredTimerInfo.getExpiryTimeInMs() / 1000, self._load()
        due = wait.due(self.settle)
        if due is not None and now >= due - 1e-3:
            reason = "capped" if wait.last + self.settle > due else "settled"
            self._store(Wait())
            yield self._row(key[0], wait, now, reason)
        elif wait.recheck is not None and now >= wait.recheck - 1e-3:
            self._store(replace(wait, recheck=None))
            yield self._row(key[0], wait, now, "recheck")


def debounced(events: DataFrame, settle: float = 15.0, include_self: bool = False) -> DataFrame:
    return events.groupBy("chat_id").transformWithStateInPandas(DebouncedWait(settle, include_self), outputStructType=WAKE, outputMode="Append", timeMode="ProcessingTime")


def bursts(events: DataFrame, settle: int, key: str, time: str) -> DataFrame:
    """The batch form of the quiet gap: bursts whose neighbours are at most ``settle`` apart, as (key, first, last, events)."""
    w = Window.partitionBy(key).orderBy(time)
    gap = F.col(time) - F.lag(time).over(w)
    burst = F.sum(F.when(gap > settle, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("_b", burst).groupBy(key, "_b").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("events")).drop("_b")


def first_observed(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each message once, as first seen; state is bounded by the watermark."""
    return events.withColumn("at", F.timestamp_seconds("received_at")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["chat_id", "message_id"])


def deadline_state(observed: str = "observed", finished: str = "finished", now: str = "now") -> Column:
    """pending, partial, ready or late of a context whose materials finish at a time or not yet."""
    took, elapsed = F.col(finished) - F.col(observed), F.col(now) - F.col(observed)
    return F.when(took <= DEADLINE, "ready").when(took.isNotNull(), "late").when(elapsed >= MATERIALS, "partial").otherwise("pending")


def best_candidates(candidates: DataFrame, key: str) -> DataFrame:
    """The earliest success of each message; a later one never replaces it."""
    return candidates.where("success").groupBy(key).agg(F.min_by(F.struct("result", "finished"), "finished").alias("b")).select(key, "b.*")


def best_quality(items: DataFrame, key: str) -> DataFrame:
    """original before standard before thumbnail."""
    rank = F.when(F.col("quality") == "original", 0).when(F.col("quality") == "standard", 1).otherwise(2)
    return items.groupBy(key).agg(F.min_by(F.struct("quality", "path"), F.struct(rank, "path")).alias("b")).select(key, "b.*")


def without_own_bubbles(messages: DataFrame, sent: DataFrame, text: str, time: str) -> DataFrame:
    """Each sent text cancels one equal own message, in time order."""
    w = Window.partitionBy(text).orderBy(time)
    m = messages.withColumn("_k", F.when(F.col("sender_role") == "self", F.row_number().over(Window.partitionBy(text, "sender_role").orderBy(time))))
    s = sent.withColumn("_sk", F.row_number().over(w)).select(F.col(text).alias("_st"), "_sk")
    return m.join(s, (F.col(text) == F.col("_st")) & (F.col("_k") == F.col("_sk")), "left_anti").drop("_k")


def last_per_side(messages: DataFrame, time: str, now: int, days: int = 30) -> DataFrame:
    """One row: the newest own and other message of the last ``days``."""
    recent = messages.where(F.col(time) > now - days * 86_400)
    s = F.struct(F.col(time), F.col("content"))
    return recent.agg(F.max(F.when(F.col("sender_role") == "self", s)).alias("own"), F.max(F.when(F.col("sender_role") == "other", s)).alias("other"))
