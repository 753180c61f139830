"""Streams with state: several micro-batches, restarts from the checkpoint, replays, expiry."""

import json
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.sources.events import EventSource
from tidemark.streaming import realtime as R


@pytest.fixture(autouse=True)
def one_state_partition(spark):
    """State of a few keys needs no more, and each partition starts a worker in each batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def no_empty_batches(spark):
    """Processors that live in processing time ask for batches without data, again and again: a run of what is there would not end."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


class Feed:
    """A file stream that gets one file a batch, and a query that can be stopped and started again."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        (folder / "in").mkdir(parents=True, exist_ok=True)

    def put(self, rows, name="in"):
        self.n += 1
        (self.folder / name).mkdir(exist_ok=True)
        (self.folder / name / f"{self.n:04}.json").write_text("\n".join(map(json.dumps, rows)))

    def stream(self, name="in", schema=None):
        (self.folder / name).mkdir(exist_ok=True)
        return self.spark.readStream.schema(schema or self.schema).option("maxFilesPerTrigger", 1).json(str(self.folder / name))

    def run(self, df, **options):
        """All that is there, to the end; then the query stops, so that the next call is a restart."""
        q = df.writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "cp")).options(**options).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return q

    def rows(self):
        return self.spark.read.parquet(str(self.folder / "out")).collect()


def at(second):
    return datetime.fromtimestamp(1_700_000_000 + second, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


SEEN = "account string, chat_id string, message_id string, audio_sha256 string, observed_at timestamp"
MADE = "account string, chat_id string, message_id string, audio_sha256 string, status string, route string, finished_at timestamp"


def seen(i, second, digest="d"):
    return {"account": "a", "chat_id": "c", "message_id": i, "audio_sha256": digest, "observed_at": at(second)}


def made(i, second, digest="d", status="success", route="local"):
    return {"account": "a", "chat_id": "c", "message_id": i, "audio_sha256": digest, "status": status, "route": route, "finished_at": at(second)}


def test_deadline_join(spark, tmp_path):
    """Files out of order on both sides: pending, ready, partial and late, wrong bindings meet nothing, state shrinks behind the watermark."""
    feed = Feed(spark, tmp_path, None)
    joined = R.deadline_join(feed.stream("seen", SEEN), feed.stream("made", MADE), horizon=60)
    q = joined.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    held = []

    def push(name, rows):
        feed.put(rows, name)
        q.processAllAvailable()
        held.append(sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]))

    try:
        push("made", [made("early", 8), made("failed", 3, status="candidate_failed"), made("other", 4, digest="x")])  # materials before their messages
        push("seen", [seen("early", 0), seen("late", 1), seen("none", 2), seen("failed", 2), seen("other", 2), seen("soon", 1)])
        push("made", [made("late", 30), made("late", 25, route="cloud"), made("soon", 15)])
        top = max(held)
        for second in (100, 200, 300):  # both sides move on
            push("seen", [seen(f"s{second}", second)])
            push("made", [made(f"m{second}", second)])
    finally:
        q.stop()
    out = spark.read.parquet(str(tmp_path / "out"))
    states = {}
    for r in out.collect():
        states.setdefault(r["message_id"], set()).add(r["state"])
    assert states["early"] == {"pending", "ready"} and states["soon"] == {"pending", "partial", "ready"}
    assert states["late"] == {"pending", "partial", "late"}
    assert states["none"] == states["failed"] == states["other"] == {"pending", "partial"} and states["s300"] == {"pending"}
    now = {r["message_id"]: r for r in R.current_states(out).collect()}
    assert [now[i]["state"] for i in ("early", "soon", "late", "none", "s300")] == ["ready", "ready", "late", "partial", "pending"]
    assert now["late"]["route"] == "cloud" and now["none"]["finished_at"] is None
    assert held[-1] < top


def test_buffer_over_batches_and_a_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path, "session string, sequence long, payload string, request_id string, limit int")
    out = R.received_stream(feed.stream())
    event = lambda k, s="s": {"session": s, "sequence": k, "payload": f"e{k}"}
    ask = lambda k, name, limit: {"session": "s", "sequence": k, "request_id": name, "limit": limit}
    feed.put([event(k) for k in range(150)])
    feed.put([event(k) for k in reversed(range(150, 290))] + [event(1, "other")])
    feed.run(out)
    feed.put([ask(1000, "a", 100), ask(1001, "b", 0), event(1002)])
    feed.put([ask(2000, "c", 100), ask(2001, "d", 100), ask(2002, "e", 1)])
    feed.run(out)
    got = {r["request_id"]: r for r in feed.rows()}
    assert (got["a"]["status"], got["a"]["dropped"], got["a"]["remaining"]) == ("partial", 90, 100)
    assert got["a"]["events"] == [f"e{k}" for k in range(90, 190)]
    assert got["b"]["status"] == "receive_bounds_invalid" and got["b"]["remaining"] == 100
    assert (got["c"]["status"], got["c"]["dropped"], got["c"]["remaining"]) == ("success", 0, 1) and got["c"]["events"][-1] == "e289"
    assert got["d"]["events"] == ["e1002"] and got["e"]["events"] == []


def test_upgrades_never_go_down(spark, tmp_path):
    feed = Feed(spark, tmp_path, "message_id string, locator string, quality string, path string")
    out = R.media_upgrades(feed.stream())
    item = lambda q, p, m="m": {"message_id": m, "locator": "l", "quality": q, "path": p}
    feed.put([item("standard", "s1"), item("thumbnail", "t", "n")])
    feed.put([item("thumbnail", "t1"), item("standard", "s2"), item(None, "x", "u")])
    feed.run(out)
    feed.put([item("original", "o1"), item("standard", "s3"), item("standard", "s", "n")])
    feed.run(out)
    got = sorted((r["message_id"], r["path"]) for r in feed.rows())
    assert got == [("m", "o1"), ("m", "s1"), ("n", "s"), ("n", "t"), ("u", "x")]


ASK = "session string, sequence long, what string, request_id string, message_id string, answer string"


def ask(k, what, message, request=None, answer=None):
    return {"session": "s", "sequence": k, "what": what, "message_id": message, "request_id": request, "answer": answer}


def test_requests_are_reused(spark, tmp_path, no_empty_batches):
    feed = Feed(spark, tmp_path, ASK)
    out = R.reused_requests(feed.stream())
    feed.put([ask(k, "observed", f"m{k}") for k in range(10)] + [ask(20, "request", "m0", "r0"), ask(21, "request", "m0", "again"), ask(22, "request", "nobody", "r?")])
    feed.put([ask(30 + k, "request", f"m{k}", f"r{k}") for k in range(1, 9)])
    feed.run(out)
    feed.put([ask(50, "answer", "m2", answer="first"), ask(51, "answer", "m2", answer="second"), ask(52, "request", "m2", "x"), ask(53, "request", "m8", "r8b"), ask(54, "request", "m2", "y")])
    feed.run(out)
    got = sorted((r["request_id"], r["message_id"], r["status"], r["reused"], r["answer"]) for r in feed.rows())
    assert ("r0", "m0", "pending", False, None) in got and ("r0", "m0", "pending", True, None) in got
    assert ("r?", "nobody", "message_not_observed", False, None) in got and ("r8", "m8", "request_capacity", False, None) in got
    assert ("r2", "m2", "answered", False, "first") in got and ("r2", "m2", "answered", True, "first") in got and "second" not in {x[4] for x in got}
    # m2, answered, made room for m8; a later request for it finds the session full.
    assert ("r8b", "m8", "pending", False, None) in got and ("y", "m2", "request_capacity", False, None) in got and len(got) == 15


def test_requests_expire(spark, tmp_path, no_empty_batches):
    feed = Feed(spark, tmp_path, ASK)
    out = R.reused_requests(feed.stream(), ttl=3.0)
    feed.put([ask(1, "observed", "m"), ask(2, "request", "m", "r1")])
    feed.run(out)
    time.sleep(4)
    feed.put([ask(3, "request", "m", "r2"), ask(4, "observed", "m"), ask(5, "request", "m", "r3")])
    feed.run(out)
    assert sorted((r["request_id"], r["status"], r["reused"]) for r in feed.rows()) == [("r1", "pending", False), ("r2", "message_not_observed", False), ("r3", "pending", False)]


def test_decisions_come_from_the_record(spark, tmp_path):
    """Hints without a row wake nobody, own last rows don't, a replayed batch changes nothing, a half-written one is made anew."""
    record, out = tmp_path / "record", str(tmp_path / "decisions")

    def write(rows):
        spark.createDataFrame(rows, "chat_id string, create_time long, sender_role string").write.mode("append").parquet(str(record))

    write([("a", 5, "other"), ("b", 5, "other"), ("b", 6, "self"), ("d", 7, "other")])
    run = R.deciding(lambda: spark.read.parquet(str(record)), out)
    hint = lambda *c: spark.createDataFrame([(x,) for x in c], "chat_id string")
    run(hint("a", "a", "b", "c", None), 0)
    first = sorted(map(tuple, R.decided(spark, out).collect()))
    assert [(r[0], r[2], r[3], r[4]) for r in first] == [("a", 1, 5, True), ("b", 2, 6, False), ("c", 0, 0, False)]
    write([("a", 9, "other")])
    run(hint("a"), 0)  # replayed
    assert sorted(map(tuple, R.decided(spark, out).collect())) == first
    run(hint("a", "c"), 1)
    (tmp_path / "decisions" / "batch=1" / "_SUCCESS").unlink()
    run(hint("a", "c"), 1)
    again = sorted(map(tuple, R.decided(spark, out).where("batch = 1").collect()))
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in again] == [("a", 5, 1, 9, True), ("c", 0, 0, 0, False)]


def test_event_source_resumes(spark, tmp_path):
    """A growing log is read once: torn lines wait, a restart goes on behind the last batch."""
    spark.dataSource.register(EventSource)
    logs, feed = tmp_path / "logs", Feed(spark, tmp_path, None)
    logs.mkdir()
    event = lambda k, **more: json.dumps({"chat_id": "c", "sequence": k, "text": "é" * k, "is_self": False} | more)
    (logs / "1.jsonl").write_text(event(1) + "\n" + event(2) + "\n" + event(3)[:10])
    (logs / "notes.txt").write_text("not a log")
    events = spark.readStream.format("tidemark_events").option("path", str(logs)).option("blockBytes", 16).load()
    feed.run(events)
    assert sorted(r["sequence"] for r in feed.rows()) == [1, 2]
    with (logs / "1.jsonl").open("a") as f:
        f.write(event(3)[10:] + "\n" + event(4, sequence="4", other=1) + "\n\n")
    (logs / "2.jsonl").write_text(event(5, kind=1) + "\n")
    feed.run(events)
    rows = sorted(feed.rows(), key=lambda r: (r["file"], r["position"]))
    assert [r["sequence"] for r in rows] == [1, 2, 3, None, 5] and [r["text"] for r in rows][2] == "é" * 3 and rows[-1]["kind"] == 1
    feed.run(events)
    assert len(feed.rows()) == 5
    batch = spark.read.format("tidemark_events").option("path", f"file://{logs}").load()
    assert batch.count() == 5 and batch.agg(F.count("sequence")).head()[0] == 4
    (logs / "3.jsonl").write_text("[1]\n")
    with pytest.raises(Exception, match="event_line_invalid"):
        spark.read.format("tidemark_events").option("path", str(logs)).load().count()
