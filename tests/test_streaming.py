import json
import time

from pyspark.sql import functions as F

from tidemark.streaming import waits as W


def test_wait_caps_and_cancels():
    w = W.Wait().on_event(0)
    assert w.due(15) == 15
    for t in (10, 20, 30, 40, 50):
        w = w.on_event(t)
    assert w.due(15) == 60  # the cap, not 65
    w = w.on_event(55, is_self=True)
    assert w.due(15) is None and w.recheck == 58
    assert w.on_record(58, wakes=True).due(15) == 73
    assert w.on_record(58, wakes=False) == W.Wait()
    assert W.Wait().on_event(5, resync=True).recheck == 8
    assert W.Wait(1, 1).on_event(5, resync=True) == W.Wait(1, 1)


def test_bursts_merge_at_the_gap(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 15, 31, 40)], "k string, t long")
    assert sorted((r["first"], r["last"], r["events"]) for r in W.bursts(df, 15, "k", "t").collect()) == [(0, 15, 2), (31, 40, 2)]


def test_new_is_strict(spark):
    df = spark.createDataFrame([(5,), (6,)], "create_time long")
    assert [r[0] for r in W.newer(df, 5).collect()] == [6] and W.next_since(df, 0) == 6 and W.next_since(df.limit(0), 3) == 3


def test_states(spark):
    df = spark.createDataFrame([(0, 10, 99), (0, 20, 99), (0, None, 5), (0, None, 14)], "observed long, finished long, now long")
    assert [r[0] for r in df.select(W.deadline_state()).collect()] == ["ready", "late", "pending", "partial"]


def test_buffer_and_receive(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9)], "chat_id string, sequence long")
    out = sorted((r["chat_id"], r["sequence"], r["dropped"]) for r in W.buffered(df, 3).collect())
    assert out == [("a", 2, 2), ("a", 3, 2), ("a", 4, 2), ("b", 9, 0)]
    got, left = W.received(df, 2)
    assert [r["sequence"] for r in got.collect()] == [0, 1] and left == 4


def test_stream_debounces(spark, tmp_path):
    """Two chats wake once each after the gap; the third's own event leaves a second look only."""
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"chat_id": c, "is_self": s, "sequence": i, "message_id": f"{c}{i}", "kind": 1, "received_at": 1, "text": "x"} for c, s, i in (("a", False, 1), ("a", False, 2), ("b", False, 1), ("c", False, 1), ("c", True, 2), ("z", False, 1))]
    (src / "0.json").write_text("\n".join(map(json.dumps, rows)))
    events = W.whitelisted(W.event_stream(spark, str(src)), ["a", "b", "c"])
    q = W.debounced(events, settle=1.0).writeStream.format("memory").queryName("wakes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 90
        while time.time() < end and spark.table("wakes").count() < 3:
            time.sleep(1)
        got = sorted((r["chat_id"], r["reason"]) for r in spark.table("wakes").collect())
    finally:
        q.stop()
    assert got == [("a", "settled"), ("b", "settled"), ("c", "recheck")]


def test_first_observed(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"chat_id": "a", "message_id": "1", "sequence": i, "received_at": 100 + i} for i in range(3)]
    (src / "0.json").write_text("\n".join(map(json.dumps, rows)))
    q = W.first_observed(W.event_stream(spark, str(src))).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == 1


def test_sides(spark):
    df = spark.createDataFrame([(10, "self", "a"), (20, "self", "b"), (15, "other", "c")], "t long, sender_role string, content string")
    r = W.last_per_side(df, "t", 100).head()
    assert (r["own"]["content"], r["other"]["content"]) == ("b", "c")
    sent = spark.createDataFrame([("a", 1)], "content string, t long")
    assert sorted(r["content"] for r in W.without_own_bubbles(df, sent, "content", "t").collect()) == ["b", "c"]
    q = spark.createDataFrame([("k", "standard", "s"), ("k", "thumbnail", "t")], "k string, quality string, path string")
    assert W.best_quality(q, "k").head()["path"] == "s"
    assert F is not None
