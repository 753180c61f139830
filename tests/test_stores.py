"""Stores that keep what didn't change: snapshots by partition, footer indexes, merges by partition, pages of distinct identities."""

import json
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import merge, messages
from tidemark.sources import snapshots, stores
from tidemark.sources.skipping import FooterIndex
from tidemark.sources.store import SourceChanged


def files(root) -> set[str]:
    return {str(p.relative_to(root)) for p in Path(root).rglob("part-*.parquet")}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_store_creates_once(spark, tmp_path):
    s = stores.Store(spark, f"file://{tmp_path}")
    assert s.create("a/b.json", "é") and not s.create("a/b.json", "other") and s.read("a/b.json") == "é"
    assert s.names("a") == ["b.json", "b.json.claim"] and s.names("none") == []


# Snapshots -------------------------------------------------------------------------------------------
def test_snapshot_refresh(spark, tmp_path):
    """Only changed partitions are written, vanished ones go, any doubt means a rebuild; the result equals a full read."""
    src, root = str(tmp_path / "src"), str(tmp_path / "snap")

    def put(part, values, mode="overwrite"):
        spark.createDataFrame([(v,) for v in values], "v long").coalesce(1).write.mode(mode).parquet(f"{src}/account=a/day={part}")

    for k in range(4):
        put(k, [k, 10 * k])
    snap = snapshots.Snapshot(spark, src, root, ["account", "day"], lambda df: df.where("v <> 99").withColumn("twice", 2 * F.col("v")))
    with pytest.raises(FileNotFoundError):
        snap.read()

    def whole():
        return rows_of(spark.read.parquet(src).where("v <> 99").select("account", "day", "v", (2 * F.col("v")).alias("twice")))

    def equal():
        return rows_of(snap.read().select("account", "day", "v", "twice")) == whole()

    r = snap.refresh()
    assert r.rebuilt and len(r.written) == 4 and equal()
    before = files(root)
    assert snap.refresh() == snapshots.Refreshed(False, (), (), 4) and files(root) == before
    put(1, [5, 6, 7])
    put(2, [8], "append")
    put(7, [70])
    r = snap.refresh()
    assert not r.rebuilt and r.written == ("account=a/day=1", "account=a/day=2", "account=a/day=7") and r.kept == 2 and equal()
    assert {f for f in before if f in files(root)} == {f for f in before if "day=0/" in f or "day=3/" in f}
    for p in Path(src, "account=a", "day=3").iterdir():
        p.unlink()
    put(0, [99])
    r = snap.refresh()
    assert r.removed == ("account=a/day=3",) and r.written == ("account=a/day=0",) and equal()
    for doubt in ("_dirty", "bad", "folder", "version"):
        if doubt == "_dirty":
            Path(root, "_dirty").touch()
        elif doubt == "bad":
            Path(root, "_meta.json").write_text("{")
            Path(root, "._meta.json.crc").unlink(missing_ok=True)
        elif doubt == "folder":
            meta = json.loads(Path(root, "_meta.json").read_text())
            folder = next(p["folder"] for p in meta["partitions"].values() if p["folder"])
            os.rename(Path(root, folder), Path(root, folder + "x"))
        else:
            snap = snapshots.Snapshot(spark, src, root, ["account", "day"], snap.derive, version="2")
        assert snap.refresh().rebuilt and equal(), doubt
    assert len({f.split("/")[0] for f in files(root)}) == 1  # older runs are swept


def test_snapshot_of_a_changing_source(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "snap")
    spark.range(3).withColumn("p", F.lit(1)).write.partitionBy("p").parquet(src)

    def derive(df):
        spark.range(1).write.mode("append").parquet(f"{src}/p=1")
        return df

    with pytest.raises(SourceChanged):
        snapshots.Snapshot(spark, src, root, ["p"], derive).refresh()
    assert files(root) == set()


# Footers ---------------------------------------------------------------------------------------------
def test_files_without_the_session_are_not_opened(spark, tmp_path):
    root, index = tmp_path / "store", str(tmp_path / "index")

    def put(lo, hi, mode="append", **more):
        df = spark.range(lo, hi).select(F.format_string("s%03d", F.col("id")).alias("session_id"), F.col("id").alias("create_time")).withColumns({k: F.lit(v) for k, v in more.items()})
        df.coalesce(1).write.mode(mode).parquet(str(root))

    for k in range(5):
        put(20 * k, 20 * k + 20)
    put(0, 1, other=1)  # a newer layout with a further column
    ix = FooterIndex(spark, str(root), index, ["session_id", "create_time"])
    assert ix.refresh() == 6 and ix.refresh() == 0
    assert len(ix.paths(session_id="s045")) == 1 and ix.paths(session_id="zzz") == [] and len(ix.paths(create_time=(30, None))) == 4 and len(ix.paths(create_time=(None, None))) == 6
    assert len(ix.paths(session_id="s045", create_time=(0, 10))) == 0
    got = ix.scan(session_id="s045")
    assert len(got.inputFiles()) == 1
    assert rows_of(got.select("session_id", "create_time")) == [("s045", 45)]
    put(45, 47)
    assert ix.refresh() == 1 and len(ix.paths(session_id="s045")) == 2
    assert rows_of(ix.scan(create_time=(44, 46)).select("create_time")) == [(44,), (45,), (45,), (46,), (46,)]
    first = sorted(root.glob("part-*.parquet"))[0]
    first.unlink()
    ix.refresh()
    assert len(ix.read().select("path").distinct().collect()) == 6
    with pytest.raises(ValueError):
        ix.paths(nobody=1)


def test_unopened_files_may_be_broken(spark, tmp_path):
    """A file whose rows are damaged behind an intact footer harms only scans that need it."""
    root = tmp_path / "store"
    for k in range(3):
        spark.range(1000 * k, 1000 * k + 1000).coalesce(1).write.mode("append").parquet(str(root))
    ix = FooterIndex(spark, str(root), str(tmp_path / "ix"), ["id"])
    ix.refresh()
    broken = ix.paths(id=1500)[0].removeprefix("file:").replace("//", "/")
    stat = os.stat(broken)
    with open(broken, "r+b") as f:
        f.seek(4)
        f.write(b"\xff" * 200)
    os.utime(broken, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    Path(broken).with_name(f".{Path(broken).name}.crc").unlink()
    assert ix.scan(id=(10, 12)).count() == 3
    with pytest.raises(Exception):
        ix.scan(id=1500).collect()


# Merge -----------------------------------------------------------------------------------------------
def archive(spark, tmp_path):
    return merge.PartitionedArchive(spark, str(tmp_path / "arc"), "export_key", "digest", F.date_format(F.timestamp_seconds("create_time"), "yyyy-MM"))


DAY = 86_400


def batch(spark, *rows):
    return spark.createDataFrame([(k, d, t, f"body {d}") for k, d, t in rows], "export_key string, digest string, create_time long, content string")


def test_merge_rewrites_touched_partitions(spark, tmp_path):
    a = archive(spark, tmp_path)
    r = a.merge(batch(spark, ("k1", "a", 0), ("k2", "a", 40 * DAY), ("k3", "a", 41 * DAY), ("k4", "a", 100 * DAY), ("k5", "a", None)), "f1", {"watermark": 7})
    assert (r.version, r.mode, r.added, len(r.written)) == (1, "full", 5, 4)
    first = files(a.root)
    assert a.merge(batch(spark), "f1").mode == "no_change"
    # An overlap that brings the same rows again, one changed row, one new row of an old month.
    r = a.merge(batch(spark, ("k2", "a", 40 * DAY), ("k3", "b", 41 * DAY), ("k6", "a", 42 * DAY), ("k4", "a", 100 * DAY)), "f2")
    assert (r.version, r.mode, r.added, r.updated, r.same, r.written) == (2, "incremental", 1, 1, 2, ("1970-02",))
    untouched = {f for f in first if any(f.startswith(x) for p, x in a.manifest(2)["partitions"].items() if p != "1970-02")}
    assert len(untouched) == 3 and untouched <= files(a.root)
    assert sorted((x["export_key"], x["digest"]) for x in a.read().collect()) == [("k1", "a"), ("k2", "a"), ("k3", "b"), ("k4", "a"), ("k5", "a"), ("k6", "a")]
    assert a.read(1).count() == 5 and a.manifest(1)["state"] == {"watermark": 7}
    # Nothing but equal rows: a new fingerprint and no new file.
    before = files(a.root)
    r = a.merge(batch(spark, ("k1", "a", 0)), "f3")
    assert (r.version, r.same, r.written) == (3, 1, ()) and files(a.root) == before
    # A row that moves to another partition leaves the old one, which is then empty.
    r = a.merge(batch(spark, ("k4", "c", 0)), "f4")
    assert r.written == ("1970-01", "1970-04") and "1970-04" not in a.manifest()["partitions"]
    assert sorted((x["export_key"], x["create_time"]) for x in a.read().collect()) == [("k1", 0), ("k2", 40 * DAY), ("k3", 41 * DAY), ("k4", 0), ("k5", None), ("k6", 42 * DAY)]
    assert a.vacuum() > 0 and a.versions() == [4] and a.read().count() == 6


def test_merge_conflicts_and_failures_leave_the_archive(spark, tmp_path):
    a, b = archive(spark, tmp_path), archive(spark, tmp_path)
    a.merge(batch(spark, ("k1", "a", 0)), "f1")
    stale = b.manifest()
    b.manifest = lambda version=None: stale
    a.merge(batch(spark, ("k1", "b", 0)), "f2")
    with pytest.raises(merge.ArchiveConflict):
        b.merge(batch(spark, ("k1", "c", 0)), "f3")
    assert [r["digest"] for r in a.read().collect()] == ["b"] and a.vacuum() == 1
    for bad in (batch(spark, ("k", "a", 0), ("k", "b", 0)), batch(spark, (None, "a", 0)), batch(spark, ("k9", "a", 0)).withColumn("more", F.lit(1))):
        with pytest.raises(Exception, match="archive_"):
            a.merge(bad, "f9")
    assert a.versions()[-1] == 2 and a.read().count() == 1
    assert {r["change"]: r["n"] for r in merge.merge_preview(a.read(), batch(spark, ("k1", "b", 0), ("n", "a", 0)), "export_key", "digest").collect()} == {"same": 1, "added": 1}


# Pages of distinct identities --------------------------------------------------------------------------
COLUMNS = "server_id long, create_time long, sort_seq long, id_kind string, id_value string, content string, shard string"


def made(rng, n):
    out = []
    for i in range(n):
        t, seq = rng.choice([None, *range(40)]), rng.choice([None, 1, 2])
        out += [(i, t, seq, "server", str(i), f"c{i}", f"s{k}") for k in range(rng.choice([1, 1, 2, 5]))]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("size", [1, 3, 7, 500])
def test_pages_of_distinct_identities_make_up_the_whole(spark, size):
    rng = random.Random(size)
    rows = made(rng, 60 if size < 500 else 200)
    if size < 3:
        rows = made(rng, 9)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5).cache()
    key = messages.PageKey()
    order = sorted({r[:6] for r in rows}, key=lambda r: (r[1] is not None, -1 if r[1] is None else r[1], -1 if r[2] is None else r[2], r[3], r[4]), reverse=True)
    got, at = [], None
    while True:
        page = messages.distinct_page(df, size, "server_id", F.col("content"), key, at).collect()
        got += [tuple(r)[:6] for r in page]
        if not page or not page[0]["has_more"]:
            break
        assert len(page) == size
        at = key.of(page[-1].asDict())
    assert [r[0] for r in got] == [r[0] for r in order]


def test_conflicting_copies_outside_the_page_fail(spark):
    df = spark.createDataFrame([(1, 9, 1, "server", "1", "a", "s"), (1, 2, 1, "server", "1", "b", "t"), (2, 3, 1, "server", "2", "c", "s")], COLUMNS)
    with pytest.raises(Exception, match="message_identity_is_conflicting"):
        messages.distinct_page(df, 1, "server_id", F.col("content")).collect()
    assert [r["server_id"] for r in messages.distinct_page(df.where("server_id = 2"), 1, "server_id", F.col("content")).collect()] == [2]


def test_only_candidates_are_shuffled(spark, tmp_path):
    """The exchange below the grouping gets at most size + 1 rows a task; the time bound reaches the scan."""
    spark.range(40_000).select(F.col("id").alias("server_id"), (F.col("id") % 5000).alias("create_time"), F.lit(1).alias("sort_seq"), F.lit("server").alias("id_kind"), F.col("id").cast("string").alias("id_value"), F.lit("c").alias("content")).repartition(4).write.parquet(str(tmp_path / "m"))
    df = spark.read.parquet(str(tmp_path / "m"))
    out = messages.distinct_page(df, 10, "server_id", F.col("content"), before_key=(1, 4000, 1, "server", "7"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(create_time,4000)" in plan and "PushedFilters: [IsNull(create_time)]" in plan
    rows = [r.asDict() for r in out.collect()]
    want = sorted(((k % 5000, str(k)) for k in range(40_000) if (k % 5000, str(k)) < (4000, "7") and k % 5000 <= 4000), reverse=True)[:10]
    assert [(r["create_time"], r["id_value"]) for r in rows] == want and all(r["has_more"] for r in rows)
    assert plan.count("MapInPandas") == 1 and plan.count("FileScan") == 3
