import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import messages as M

KEY = M.PageKey()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(None if i % 7 == 0 else rng.randrange(50), rng.randrange(20), "server", str(i)) for i in range(120)]
    return spark.createDataFrame(data, "create_time long, sort_seq long, id_kind string, id_value string").cache()


@pytest.mark.parametrize("size", [1, 7, 50, 200])
def test_pages_concatenate(rows, size):
    """Pages of any size give the whole, once each, in one order."""
    whole = [r["id_value"] for r in rows.orderBy(*[c.desc() for c in KEY.columns()]).collect()]
    got, key, more = [], None, True
    steps = 0
    while more and steps < 40:
        page = M.page(rows, size, KEY.columns(), key).collect()
        page.sort(key=lambda r: KEY.of(r.asDict()), reverse=True)
        got += [r["id_value"] for r in page]
        more = page[0]["has_more"] if page else False
        key = KEY.of(page[-1].asDict()) if page else None
        steps += 1
    assert got == whole[: len(got)] and (more or got == whole)


def test_ids_break_ties_as_text(spark):
    df = spark.createDataFrame([(1, 1, "server", "9"), (1, 1, "server", "10")], "create_time long, sort_seq long, id_kind string, id_value string")
    assert [r["id_value"] for r in M.ascending_limited(df, KEY.columns()).collect()] == ["10", "9"]


def test_null_times_by_filter(spark):
    df = spark.createDataFrame([(1, 50, 1), (2, 150, 2), (3, None, 3), (4, 90, None)], "id long, t long, s long")
    ids = lambda c: sorted(r["id"] for r in df.where(c).collect())
    assert ids(M.in_window("t", 0, 100)) == [1, 4]
    assert ids(M.until_or_undated("t", 100)) == [1, 3, 4]
    assert ids(M.after_watermark("s", 1, "t", 200)) == [2, 3]
    assert ids(M.after_watermark_or_replayed("s", 2, "t", 0, 100)) == [1, 3]


def test_null_times_by_order(spark):
    df = spark.createDataFrame([(1, 50, 1), (2, None, 2)], "id long, create_time long, sort_seq long").withColumns({"id_kind": F.lit("server"), "id_value": F.col("id").cast("string")})
    assert [r["id"] for r in M.ascending_limited(df, KEY.columns()).collect()] == [2, 1]
    assert [r["id"] for r in M.ascending_unlimited(df, "create_time", "sort_seq", "id").collect()] == [1, 2]


def test_watermark_guard(spark):
    df = spark.createDataFrame([(5,)], "s long")
    assert M.guarded_watermark(df, "s", 5).count() == 1
    with pytest.raises(Exception, match="watermark_regressed"):
        M.guarded_watermark(df, "s", 6).collect()


def test_identity_conflict_fails(spark):
    df = spark.createDataFrame([(42, "left", "a"), (42, "right", "b"), (1, "x", "b"), (1, "x", "a")], "id long, body string, shard string")
    ok = M.dedup_identities(df.where("id = 1"), "id", F.col("body"), ["shard"]).collect()
    assert [(r["id"], r["shard"]) for r in ok] == [(1, "a")]
    with pytest.raises(Exception, match="message_identity_is_conflicting"):
        M.dedup_identities(df, "id", F.col("body"), ["shard"]).collect()


@pytest.mark.parametrize("size", [1, 2, 5, 30])
def test_anchored_window(spark, size):
    df = spark.createDataFrame([(i, f"m{i}" if i != 12 else "Needle") for i in range(20)], "t long, body string")
    got = sorted(r["t"] for r in M.anchored(df, size, [F.col("t")], anchor=M.contains_text("body", "needle")).collect())
    ahead = min(size - 1, size * 3 // 5)
    start = max(0, 12 - ahead)
    end = min(20, start + size)
    start = max(0, end - size)
    assert got == list(range(start, end))


def test_anchor_by_time_takes_first_of_ties(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, None)], "id long, t long")
    got = M.anchored(df, 1, [F.col("id")], time="t", at=15).collect()
    assert [r["id"] for r in got] == [1]


ROLES = [
    # local_type, status, sender, session, expected
    (1, 2, 7, "s", "self"), (1, 4, 7, "s", "other"), (1, 3, 7, "s", "self"), (1, 3, 8, "s", "other"), (10000, 2, 7, "s", "system"), (S.PAT_EVENT, 2, 7, "s", "system"),
    (1, 99, 9, "s", "other"), (1, 99, 7, "s", "self"), (1, 99, 55, "s", "unknown"), (1, None, None, "s", "unknown"), (1, 2, 9, "x@openim", "other"), (1, 2, 55, "x@openim", "unknown"),
]


def test_roles(spark):
    import hashlib

    df = spark.createDataFrame([("a", i, s, t, st, sd) for i, (t, st, sd, s, _) in enumerate(ROLES)], "shard string, id long, session_id string, local_type long, status long, real_sender_id long")
    df = df.where("id not in (10, 11)").unionByName(df.where("id in (10, 11)").withColumn("shard", F.lit("b")))
    names = spark.createDataFrame([("a", 7, "me"), ("a", 9, "you"), ("b", 9, "you")], "shard string, sender_id long, user_name string")
    out = {r["id"]: r["sender_role"] for r in M.with_roles(df, names, hashlib.sha256(b"me").hexdigest()).collect()}
    assert out == {i: r[-1] for i, r in enumerate(ROLES)}


def test_calibration_needs_one_sender(spark):
    df = spark.createDataFrame([("a", 2, 1, 7), ("b", 2, 1, 7), ("b", 2, 1, 8), ("c", 2, 10000, 7)], "shard string, status long, local_type long, real_sender_id long")
    assert {r["shard"]: r["own_sender"] for r in M.calibrated_senders(df, ["shard"]).collect()} == {"a": 7, "b": None}


def test_quotes_and_fallback(spark):
    df = spark.createDataFrame([("1", None, "a"), ("2", "1", "b"), ("3", "9", "c")], "id string, quoted string, text string")
    out = {r["id"]: (r["quoted_text"], r["quote_gap"]) for r in M.attach_quotes(df, "quoted", df, "id", ["text"]).collect()}
    assert out == {"1": (None, None), "2": ("a", None), "3": (None, "quote_target_missing")}


def test_search_status():
    assert M.search_status(True, True, 1, True) == "matched"
    assert M.search_status(False, True, 1, True) == "not_found_in_page"
    assert M.search_status(False, False, 1, True) == "indeterminate_content_gaps"
    assert M.search_status(False, False, 0, True) == "not_found_in_remaining_window"
    assert M.search_status(False, False, 0, False) == "not_found_in_requested_window"


def test_keyset_reaches_the_scan(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    e = spark.read.parquet(f"{sf}/events.parquet").where(M.before([F.col("user_id"), F.col("event_id")], (40, 500)))
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "LessThan(user_id,40)" in plan.partition("PushedFilters")[2]


def test_tail_is_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", i, None) for i in range(9)] + [("b", None, 1), ("b", 3, 2)], "k string, t int, x int").repartition(3)
    out = M.tail(df, 2, [F.col("t")], ["k"])
    assert sorted((r["k"], r["t"] or -1) for r in out.collect()) == [("a", 7), ("a", 8), ("b", -1), ("b", 3)]
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_quotes_of_a_repeated_id(spark):
    df = spark.createDataFrame([(1, None, "b"), (1, None, "a"), (2, 1, "r")], "id long, quoted long, text string")
    for parts in (1, 3):
        got = M.attach_quotes(df, "quoted", df.repartition(parts), "id", ["text"]).where("id = 2").collect()
        assert [r["quoted_text"] for r in got] == ["a"]
