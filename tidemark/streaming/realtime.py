"""Keyed state of live sessions: deadline joins, bounded buffers, request reuse, monotone upgrades, decisions from the record."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.waits import BUFFER, DEADLINE, MATERIALS

#: Requests that a session holds at once, observed messages that it remembers, ranks of image quality.
REQUESTS, REMEMBERED, QUALITY = 8, 200, {"thumbnail": 0, "standard": 1, "original": 2}

#: What binds a material to the message that it was made of.
BINDING = ("account", "chat_id", "message_id", "audio_sha256")


# Deadline join --------------------------------------------------------------------------------------
def deadline_join(observed: DataFrame, materials: DataFrame, horizon: int = 120, delay: str = "10 seconds", keys: tuple[str, ...] = BINDING) -> DataFrame:
    """Transitions of observed messages (``keys``, observed_at) whose materials (``keys``, status, finished_at, ...) arrive as a second stream.

    Both sides have a watermark. A message is pending at once; within the material budget a successful
    material makes it ready, and when the watermark passes the budget without one the outer join closes the row as
    partial. Materials up to ``horizon`` seconds after the observation still come through: ready until the
    deadline, late from then on. A material whose binding differs in any key meets nothing; a null key binds nothing. State is held for
    the interval bounds only. Rows: keys, observed_at, state, finished_at and the materials' further columns.
    """
    rest = [c for c in materials.columns if c not in (*keys, "status", "finished_at")]
    o = observed.select(*keys, "observed_at").withWatermark("observed_at", delay)
    done = materials.where(F.col("status") == "success")
    m = done.select(*[F.col(k).alias(f"_{k}") for k in keys], "finished_at", *rest).withWatermark("finished_at", delay)
    bound = F.lit(True)
    for k in keys:
        bound = bound & (F.col(k) == F.col(f"_{k}"))

    def until(seconds: int) -> Column:
        return F.col("observed_at") + F.expr(f"interval {seconds} seconds")

    took = F.col("finished_at").cast("double") - F.col("observed_at").cast("double")
    state = F.when(took.isNull(), "partial").when(took <= DEADLINE, "ready").otherwise("late").alias("state")
    columns = [*keys, "observed_at", state, "finished_at", *rest]
    in_budget = o.join(m, bound & (F.col("finished_at") >= F.col("observed_at")) & (F.col("finished_at") <= until(MATERIALS)), "left_outer").select(*columns)
    after = o.join(m, bound & (F.col("finished_at") > until(MATERIALS)) & (F.col("finished_at") <= until(horizon)), "inner").select(*columns)
    kinds = {f.name: f.dataType for f in materials.schema}
    pending = o.select(*keys, "observed_at", F.lit("pending").alias("state"), *[F.lit(None).cast(kinds[c]).alias(c) for c in ("finished_at", *rest)])
    return pending.unionByName(in_budget).unionByName(after)


def current_states(transitions: DataFrame, keys: tuple[str, ...] = BINDING) -> DataFrame:
    """The furthest state of each message; among several materials the earliest finished one."""
    rank = F.when(F.col("state") == "ready", 0).when(F.col("state") == "late", 1).when(F.col("state") == "partial", 2).otherwise(3)
    rest = [c for c in transitions.columns if c not in keys]
    return transitions.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(rank, "finished_at")).alias("s")).select(*keys, "s.*")


# Bounded buffer -------------------------------------------------------------------------------------
RECEIVED = "session string, request_id string, status string, events array<string>, dropped long, remaining long"


class BoundedBuffer(StatefulProcessor):
    """The newest ``size`` events of a session across micro-batches; the oldest go first and are counted.

    Rows in: session, sequence, payload for an event; session, sequence, request_id, limit for a request, which takes
    the oldest ``limit`` (1 to 100) events out of the buffer and reports how many were dropped since the last one and how many remain.
    Rows are taken in order of sequence within a batch.
    """

    def __init__(self, size: int = BUFFER):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", "payload string")
        self.dropped = handle.getValueState("dropped", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [x[0] for x in self.events.get()]
        dropped = self.dropped.get()[0] if self.dropped.exists() else 0
        out = []
        for row in pd.concat(list(rows)).sort_values("sequence", kind="stable").itertuples():
            if isinstance(row.request_id, str):
                limit = 0 if pd.isna(row.limit) else int(row.limit)
                if not 1 <= limit <= 100:
                    out.append((key[0], row.request_id, "receive_bounds_invalid", [], 0, len(held)))
                    continue
                taken, held = held[:limit], held[limit:]
                out.append((key[0], row.request_id, "partial" if dropped else "success", taken, dropped, len(held)))
                dropped = 0
            else:
                held.append(row.payload)
                if len(held) > self.size:
                    held.pop(0)
                    dropped += 1
        if held:
            self.events.put([(x,) for x in held])
        else:
            self.events.clear()
        self.dropped.update((dropped,))
        if out:
            yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in RECEIVED.split(", ")])


def received_stream(rows: DataFrame, size: int = BUFFER) -> DataFrame:
    """``BoundedBuffer`` over a stream of events and requests."""
    rows = rows.select("session", "sequence", "payload", "request_id", "limit")
    return rows.groupBy("session").transformWithStateInPandas(BoundedBuffer(size), outputStructType=RECEIVED, outputMode="Append", timeMode="None")


# Monotone upgrades ----------------------------------------------------------------------------------
class MonotoneUpgrade(StatefulProcessor):
    """The best item of a key so far. A row comes out when a better one arrives, never when one of the same or a lower rank does."""

    def __init__(self, schema: T.StructType, rank: str):
        self.names, self.kinds, self.rank = schema.names, schema, rank

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "rank double, item string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.best.get()[0] if self.best.exists() else None
        found = None
        for frame in rows:
            for item in frame.to_dict("records"):
                if not pd.isna(item[self.rank]) and (held is None or item[self.rank] > held):
                    held, found = float(item[self.rank]), item
        if found is not None:
            self.best.update((held, json.dumps({k: None if v is pd.NaT else v for k, v in found.items()}, default=str)))
            yield pd.DataFrame([found])[self.names]


def upgrades(items: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """Each key's items that are better than all before them; a higher ``rank`` is better, items without one never show.

    Column names must not begin with an underscore: the frames that Spark hands to a processor lose such names.
    """
    ranked = items.withColumn("upgrade_rank", rank.cast("double"))
    return ranked.groupBy(*keys).transformWithStateInPandas(MonotoneUpgrade(ranked.schema, "upgrade_rank"), outputStructType=ranked.schema, outputMode="Append", timeMode="None").drop("upgrade_rank")


def media_upgrades(items: DataFrame) -> DataFrame:
    """original over standard over thumbnail, for each locator of a message."""
    rank = F.coalesce(*[F.when(F.col("quality") == q, r) for q, r in QUALITY.items()], F.lit(-1))
    return upgrades(items, ["message_id", "locator"], rank)


# Request reuse --------------------------------------------------------------------------------------
ANSWERED = "session string, request_id string, message_id string, status string, reused boolean, answer string"


class RequestReuse(StatefulProcessor):
    """Requests of a session for observed messages: a message that is asked for again gets the request that it has.

    Rows in, by ``what``: observed (message_id), request (request_id, message_id), answer (message_id, answer). A session remembers
    the newest 200 observed messages, first seen first dropped, and holds at most eight requests: the oldest answered one makes room, and without
    one the request is refused. The earliest answer of a message stays. Both maps forget entries after ``ttl`` seconds.
    """

    def __init__(self, ttl: float = 3600.0, held: int = REQUESTS, remembered: int = REMEMBERED):
        self.ttl, self.held, self.remembered = int(ttl * 1000), held, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.observed = handle.getMapState("observed", "message_id string", "nth long", ttlDurationMs=self.ttl)
        self.requests = handle.getMapState("requests", "message_id string", "request_id string, nth long, answer string", ttlDurationMs=self.ttl)
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        nth = self.count.get()[0] if self.count.exists() else 0
        out = []
        for row in pd.concat(list(rows)).sort_values("sequence", kind="stable").itertuples():
            nth += 1
            message = (row.message_id,)
            if row.what == "observed":
                if not self.observed.containsKey(message):
                    self.observed.updateValue(message, (nth,))
                    seen = sorted((v[0], k[0]) for k, v in self.observed.iterator())
                    for _, old in seen[: max(0, len(seen) - self.remembered)]:
                        self.observed.removeKey((old,))
            elif row.what == "answer":
                if self.requests.containsKey(message):
                    request, at, answer = self.requests.getValue(message)
                    if answer is None:
                        self.requests.updateValue(message, (request, at, row.answer))
                        out.append((key[0], request, row.message_id, "answered", False, row.answer))
            elif not self.observed.containsKey(message):
                out.append((key[0], row.request_id, row.message_id, "message_not_observed", False, None))
            elif self.requests.containsKey(message):
                request, _, answer = self.requests.getValue(message)
                out.append((key[0], request, row.message_id, "pending" if answer is None else "answered", True, answer))
            else:
                live = sorted((v[1], v[2] is not None, k[0]) for k, v in self.requests.iterator())
                done = next((m for _, answered, m in live if answered), None)
                if len(live) >= self.held and done is None:
                    out.append((key[0], row.request_id, row.message_id, "request_capacity", False, None))
                    continue
                if len(live) >= self.held:
                    self.requests.removeKey((done,))
                self.requests.updateValue(message, (row.request_id, nth, None))
                out.append((key[0], row.request_id, row.message_id, "pending", False, None))
        self.count.update((nth,))
        if out:
            yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in ANSWERED.split(", ")])


def reused_requests(rows: DataFrame, ttl: float = 3600.0, held: int = REQUESTS) -> DataFrame:
    """``RequestReuse`` over a stream of (session, sequence, what, request_id, message_id, answer).

    Entries expire in processing time, for which Spark runs batches without data; a query that is to end by itself
    (``availableNow``) needs ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    """
    rows = rows.select("session", "sequence", "what", "request_id", "message_id", "answer")
    return rows.groupBy("session").transformWithStateInPandas(RequestReuse(ttl, held), outputStructType=ANSWERED, outputMode="Append", timeMode="ProcessingTime")


# Decisions from the record --------------------------------------------------------------------------
DECISION = "chat_id string, since long, new long, next_since long, wakes boolean, last_role string"


def decide(hints: DataFrame, messages: DataFrame, since: DataFrame, include_self: bool = False) -> DataFrame:
    """What the record says of hinted chats: rows newer than each chat's ``since``, and whether the newest of them wakes.

    hints: (chat_id); messages: (chat_id, create_time, sender_role); since: (chat_id, since). The newest row
    decides: an own one wakes nobody. A hint without a newer row wakes nobody and leaves ``since`` as it is.
    """
    asked = hints.select("chat_id").where("chat_id is not null").distinct()
    asked = asked.join(since.select("chat_id", "since"), "chat_id", "left").select("chat_id", F.coalesce("since", F.lit(0)).cast("long").alias("since"))
    m = messages.select(F.col("chat_id").alias("_chat"), "create_time", "sender_role")
    last = F.max_by(F.struct("sender_role"), F.struct("create_time", F.col("sender_role") != "self"))["sender_role"]
    found = asked.join(m, (F.col("chat_id") == F.col("_chat")) & (F.col("create_time") > F.col("since")), "left").groupBy("chat_id", "since")
    found = found.agg(F.count("create_time").alias("new"), F.coalesce(F.max("create_time"), F.col("since")).alias("next_since"), last.alias("last_role"))
    wakes = (F.col("new") > 0) & (F.lit(include_self) | F.coalesce(F.col("last_role") != "self", F.lit(True)))
    return found.select("chat_id", "since", "new", "next_since", wakes.alias("wakes"), "last_role")


def deciding(read: Callable[[], DataFrame], decisions: str, include_self: bool = False, start: int = 0) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: hints of a batch become decisions that the table behind ``read`` supports.

    A batch's decisions are one folder below ``decisions``, written once: a batch that is replayed finds its folder
    finished and changes nothing, and one that failed half-way is written anew. A chat's ``since`` is the largest
    next_since of earlier batches, so it doesn't depend on what the driver remembers.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{decisions}/batch={batch_id}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
            return
        since = decided(spark, decisions).where(F.col("batch") < batch_id).groupBy("chat_id").agg(F.max("next_since").alias("since"))
        since = batch.select("chat_id").distinct().join(since, "chat_id", "left").select("chat_id", F.coalesce("since", F.lit(start)).alias("since"))
        decide(batch, read(), since, include_self).write.mode("overwrite").parquet(path.toString())

    return run


def decided(spark, decisions: str) -> DataFrame:
    """All decisions, with the batch that each was made in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(decisions)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path) or not len(files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(decisions, "batch=*/_SUCCESS"))):
        return spark.createDataFrame([], DECISION + ", batch long")
    return spark.read.schema(DECISION + ", batch long").parquet(decisions)
