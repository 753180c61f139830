import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import archive as A
from tidemark.operators.cursors import Cursor, QueryError, default_window, exit_code
from tidemark.sources import store


def test_two_merges(spark):
    schema = "k string, body string, h string"
    first = A.merged(spark.createDataFrame([], schema), spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], schema), "k", "h")
    assert {r["k"]: r["change"] for r in first.collect()} == {"a": "added", "b": "added"}
    second = A.merged(first.drop("change"), spark.createDataFrame([("b", "3", "z"), ("c", "4", "w"), ("a", "other", "x")], schema), "k", "h")
    assert {r["k"]: (r["body"], r["change"]) for r in second.collect()} == {"a": ("1", "same"), "b": ("3", "updated"), "c": ("4", "added")}
    third = A.merged(second.drop("change"), spark.createDataFrame([], schema), "k", "h")
    assert {r["change"] for r in third.collect()} == {"retained"}


def test_watermarks(spark):
    df = spark.createDataFrame([(5, 100), (9, 500), (3, None), (7, 450)], "s long, t long")
    r = A.watermarks(df, "s", "t", overlap=60).head()
    assert (r["max_seq"], r["max_time"], r["replay_floor"]) == (9, 500, 3)
    assert A.folded_watermark(df, "s", 20, True) == 20 and A.folded_watermark(df, "s", 2, False) == 2
    with pytest.raises(ValueError):
        A.watermarks(df, "s", "t", overlap=32 * 86_400)


def test_modes():
    state = {"fingerprint": "f", "max_seq": 1}
    assert A.sync_mode(None, "f", 1, True, True) == "full"
    assert A.sync_mode(state, "f", 1, True, True) == "no_change"
    assert A.sync_mode(state, "g", 1, True, True) == "incremental_by_sequence"
    assert A.sync_mode(state, "g", 2, True, True) == "incremental_by_time"
    assert A.sync_mode(state, "f", 1, True, False) == "sender_identity_reconcile"


def test_runs_round_trip(spark):
    df = spark.createDataFrame([(1, n) for n in (1, 2, 3, 5, 7, 8, 8)] + [(2, 4)], "k long, n long")
    enc = A.runs(df, "n", "k")
    assert sorted(map(tuple, enc.collect())) == [(1, 1, 3), (1, 5, 5), (1, 7, 8), (2, 4, 4)]
    assert sorted(map(tuple, A.decoded_runs(enc, "n", "k").collect())) == sorted({(1, n) for n in (1, 2, 3, 5, 7, 8)} | {(2, 4)})


def test_verify_and_dangling(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z"), ("e", 5, "q")], "path string, size long, sha256 string")
    a = spark.createDataFrame([("a", 1, "x"), ("b", 9, "y"), ("c", 3, "?"), ("f", 1, "n")], "path string, size long, sha256 string")
    errors = A.verify(d, a)
    assert {r["path"]: r["error"] for r in errors.collect()} == {"b": "size_mismatch", "c": "hash_mismatch", "e": "missing", "f": "undeclared"}
    assert A.error_codes(errors).head()["errors"] == ["hash_mismatch", "missing", "size_mismatch", "undeclared"]
    assert [r["path"] for r in A.dangling(d, a, "path").collect()] == ["e"]


def test_content_conflict(spark):
    m = spark.createDataFrame([("aa", "jpg", 1), ("aa", "jpg", 2)], "sha256 string, ext string, size long")
    with pytest.raises(Exception, match="media_content_conflict"):
        A.content_addressed(m).collect()


def test_repair(spark):
    schema = "k string, media array<struct<kind:string,openable:boolean>>"
    m = spark.createDataFrame([("a", [("image", True), ("file", None)]), ("b", None)], schema)
    todo = A.repairable(m, "k")
    assert [(r["k"], r["item_no"]) for r in todo.collect()] == [("a", 1)]
    done = A.repaired(m, "k", todo.withColumn("item", F.struct(F.lit("file").alias("kind"), F.lit(True).alias("openable"))))
    assert {r["k"]: [tuple(i) for i in r["media"] or []] for r in done.collect()} == {"a": [("image", True), ("file", True)], "b": []}
    assert {r["kind"]: r["items"] for r in A.media_counts(m).collect()} == {"image": 1, "file": 1}


def test_remap_needs_one_to_one(spark):
    old = spark.createDataFrame([("b1", "o1"), ("b2", "o2")], "basis string, key string")
    new = spark.createDataFrame([("b1", "n1"), ("b2", "n2"), ("b2", "n3")], "basis string, key string")
    assert [tuple(r) for r in A.remapped_keys(old.where("basis = 'b1'"), new, "basis", "key").collect()] == [("o1", "n1")]
    with pytest.raises(Exception, match="key_remap_not_unique"):
        A.remapped_keys(old, new, "basis", "key").collect()


def test_transaction(tmp_path):
    target = tmp_path / "archive"
    t = A.Transaction(str(target))
    t.publish(lambda d: (tmp_path / d / "x").write_text("1"))
    assert (target / "x").read_text() == "1" and t.state() == "none"
    with pytest.raises(RuntimeError, match="stage_verification_failed"):
        t.publish(lambda d: (tmp_path / d / "x").write_text("2"), check=lambda d: False)
    assert (target / "x").read_text() == "1" and t.state() == "none"
    # A crash between the renames.
    t.root.mkdir()
    (t.root / "stage").mkdir()
    (t.root / "stage" / "x").write_text("3")
    (t.root / "ready").write_text("r")
    target.rename(t.root / "old")
    assert t.state() == "swapping"
    t.recover("complete")
    assert (target / "x").read_text() == "3" and not t.root.exists()


def test_json_and_budget(tmp_path):
    A.write_json_atomic(str(tmp_path / "a.json"), {"b": "é ", "a": None})
    text = (tmp_path / "a.json").read_text()
    assert text == '{"a":null,"b":"é\\u2028"}' and json.loads(text)["b"] == "é "
    assert len(A.fitted(lambda n: "x" * n, 100, 30)) == 25


def test_overlay_stops_at_a_gap(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    log = spark.createDataFrame([(1, 1, "A", False, False), (2, 2, "B", True, False), (3, 3, "x", False, True), (4, 3, "C", True, True), (6, 1, "Z", True, False)], "seq long, k long, v string, commit boolean, deleted boolean")
    assert sorted(map(tuple, store.committed_overlay(base, log, "k").collect())) == [(1, "A"), (2, "B")]
    torn = log.where("seq <= 3")
    assert sorted(map(tuple, store.committed_overlay(base, torn, "k").collect())) == [(1, "A"), (2, "B"), (3, "c")]


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("p", s, i, i) for s in ("x", "y") for i in range(3)], "account string, session_id string, create_time long, sort_seq long")
    store.write_store(rows, str(tmp_path / "m"))
    got = store.messages_of(spark.read.parquet(str(tmp_path / "m")), "x")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    assert got.count() == 3 and "session_hash" in got._jdf.queryExecution().executedPlan().toString().partition("PartitionFilters")[2]
    files = store.listing(spark, str(tmp_path / "m"), "*.parquet")
    a = store.fingerprint(files).head()
    assert a["files"] == 2 and a["bytes"] > 0
    (tmp_path / "aliases.json").write_text(json.dumps({"schema": "s", "aliases": [{"name": "n", "account": "primary", "nativeId": "i", "chatType": "group", "label": "l", "addedAt": 1}]}))
    assert store.read_aliases(spark, str(tmp_path / "aliases.json")).count() == 1
    (tmp_path / "aliases.json").write_text(json.dumps({"schema": "s", "aliases": [{"name": " ", "account": "primary", "nativeId": "i", "chatType": "group"}]}))
    with pytest.raises(Exception, match="alias_entry_invalid"):
        store.read_aliases(spark, str(tmp_path / "aliases.json")).collect()
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"0123456789")
    r = store.listing(spark, str(tmp_path / "f")).select("path", F.lit(2).alias("offset"), F.lit(3).alias("length"))
    assert bytes(store.byte_ranges(spark, str(tmp_path / "f"), r).head()["bytes"]) == b"234"


def test_cursor():
    q = Cursor("primary", "c", 1, 2, None, None, False, ())
    from dataclasses import replace

    text = replace(q, key=(1, 5, 6, "server", "7")).encode()
    assert Cursor.key_of(text, q) == (1, 5, 6, "server", "7")
    for other in (replace(q, account="secondary"), replace(q, contains="x"), replace(q, self_only=True)):
        with pytest.raises(QueryError, match="cursor_query_mismatch"):
            Cursor.key_of(text, other)
    for bad in ("", "!!", text[:-4], Cursor("primary", "c", 1, 2, None, None, False, ("x",)).encode()):
        with pytest.raises(QueryError):
            Cursor.key_of(bad, q)
    assert default_window(100, 10, None, None, None) == (90, 100) and default_window(100, 10, 50, None, None) == (40, 60)
    assert (exit_code(None), exit_code(ValueError()), exit_code(KeyboardInterrupt())) == (0, 2, 130)
    assert QueryError("x", candidates=[1]).result()["status"] == "needs_choice"
