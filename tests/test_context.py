import pytest
from pyspark.sql import functions as F

from tidemark.operators import packages as P
from tidemark.operators.context import brief, context, with_identity
from tidemark.operators.cursors import QueryError

ME = {"account": "primary", "contact": "c", "now": 1000, "since": 0, "until": 1000}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, i, "server", str(i), "needle" if i == 100 else (None if i == 299 else f"m{i}"), "self" if i in (1, 101, 250) else "other", "u1", str(i - 1) if i % 2 else None) for i in range(1, 301)]
    return spark.createDataFrame(data, "create_time long, sort_seq long, id_kind string, id_value string, content string, sender_role string, sender_username string, quoted string").cache()


def test_pages_by_cursor(rows):
    got, cursor = [], None
    for _ in range(20):
        r = context(rows, **ME, scan_limit=120, return_limit=80, cursor=cursor)
        got = [m["create_time"] for m in r["messages"]] + got
        cursor = r["nextCursor"]
        if cursor is None:
            break
    assert got == list(range(1, 301))
    with pytest.raises(QueryError):
        context(rows, **ME, cursor="x")


def test_keyword_on_a_later_page(rows):
    first = context(rows, **ME, contains="NEEDLE", scan_limit=120)
    assert first["coverage"]["search"] == "not_found_in_page" and first["status"] == "partial" and not first["messages"]
    whole = context(rows, **ME, contains="NEEDLE", scan_limit=300, return_limit=5)
    assert [m["create_time"] for m in whole["messages"]] == [97, 98, 99, 100, 101] and whole["status"] == "success"
    assert whole["messages"][-1]["quoted_content"] == "needle"


def test_around_self_and_gaps(rows):
    a = context(rows, **ME, around=50, return_limit=5)
    assert sorted(m["create_time"] for m in a["messages"]) == [48, 49, 50, 51, 52]
    assert [m["create_time"] for m in context(rows, **ME, self_only=True)["messages"]] == [1, 101, 250]
    tail = context(rows, **ME, return_limit=3)
    assert tail["gaps"] == [{"kind": "content_unreadable", "id": "299"}] and tail["status"] == "partial"
    assert brief(tail["messages"][:1], 1000)[0]["minutesAgo"] == 11.7
    with pytest.raises(QueryError):
        context(rows, **ME, scan_limit=501)


def test_identity(spark):
    df = spark.createDataFrame([("a", "s", 5, 1, 9), ("b", "s", 0, 1, 9), ("b", "s", None, 0, 9)], "shard string, session_id string, server_id long, local_id long, rowid long")
    assert [r["id_kind"] for r in with_identity(df).collect()] == ["server", "local", "row"]


def test_package_and_verification(spark, rows, tmp_path):
    page = rows.where("create_time > 295").withColumn("sender_display", F.lit("A")).withColumn("quoted_content", F.col("quoted")).withColumn("quoted_sender", F.lit("B"))
    target = tmp_path / "pkg"
    out = P.write_package(str(target), page, "T<", media={"a.jpg": b"x"})
    assert out["messages"] == 5 and P.verify_package(str(target)) == [] and "T&lt;" in (target / "conversation.html").read_text()
    assert (target / "ai-context.md").read_text().startswith("## 1970-01-01")
    (target / "ai-context.md").write_text("changed")
    next((target / "media").rglob("*.jpg")).unlink()
    (target / "more").write_text("")
    assert P.verify_package(str(target)) == ["missing", "size_mismatch", "undeclared"]


def test_two_syncs(spark, tmp_path):
    target, schema = str(tmp_path / "arch"), "export_key string, digest string, create_time long, sort_seq long, body string"
    a = spark.createDataFrame([("k1", "x", 100_000, 1, "a"), ("k2", "y", 200_000, 2, "b")], schema)
    assert P.sync_archive(spark, target, a, fingerprint="f1") == {"mode": "full", "added": 2, "updated": 0, "same": 0, "retained": 0}
    assert P.sync_archive(spark, target, a, fingerprint="f1")["mode"] == "no_change"
    b = spark.createDataFrame([("k2", "z", 200_000, 2, "B"), ("k3", "w", 300_000, 3, "c")], schema)
    assert P.sync_archive(spark, target, b, fingerprint="f2") == {"mode": "incremental_by_sequence", "added": 1, "updated": 1, "same": 0, "retained": 1}
    got = spark.read.parquet(f"{target}/records")
    assert {r["export_key"]: r["body"] for r in got.collect()} == {"k1": "a", "k2": "B", "k3": "c"}
    with pytest.raises(RuntimeError, match="source_changed"):
        P.sync_archive(spark, target, a, fingerprint="f3", refingerprint=lambda: "f4")
    s = str(tmp_path / "snap")
    assert P.sync_snapshot(spark, s, a, key="export_key", digest="digest", fingerprint="1")["new"] == 2
    assert P.sync_snapshot(spark, s, b, key="export_key", digest="digest", fingerprint="2") == {"mode": "replaced", "new": 1, "updated": 1, "removed": 1, "same": 0}


def test_readiness(spark):
    r = P.readiness({"a": spark.range(1)}, {"a": ("id",), "b": ("x",)})
    assert r == {"status": "not_ready", "sources": {"a": "ready", "b": "missing"}}
