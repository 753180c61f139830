"""Bundles: content once, reuse, conflicts, and failures that leave nothing."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.sources import bundles


def objects(root):
    return sorted(str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file() and "objects" in p.parts)


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, content binary").repartition(3)


def test_bundle(spark, tmp_path):
    root = str(tmp_path / "b")
    first = files(spark, ("a", b"1"), ("b", b"2"), ("c", b"1"), ("d", b""), ("a", b"1"))
    assert bundles.write_bundle(spark, first, root) == {"files": 4, "written": 3, "reused": 0}
    there = objects(root)
    assert len(there) == 3 and Path(bundles.object_path(root, bundles.hashlib.sha256(b"2").hexdigest())).read_bytes() == b"2"
    assert bundles.write_bundle(spark, first, root) == {"files": 4, "written": 0, "reused": 4}
    for bad, why in ((("a", b"9"), "bundle_conflict"), (("x", None), "bundle_content_missing"), ((None, b"1"), "bundle_content_missing")):
        with pytest.raises(ValueError, match=why):
            bundles.write_bundle(spark, files(spark, ("new", b"new"), bad), root)
    assert objects(root) == there
    assert bundles.write_bundle(spark, files(spark, ("e", b"2"), ("f", b"3")), root) == {"files": 2, "written": 1, "reused": 1}
    got = {r["name"]: r["size"] for r in bundles.bundle_manifest(spark, root).collect()}
    assert got == {"a": 1, "b": 1, "c": 1, "d": 0, "e": 1, "f": 1}
    assert not list(Path(root).glob("_journal*"))


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "b")
    bundles.write_bundle(spark, files(spark, ("a", b"1")), root)
    there = objects(root)
    spark.dataSource.register(bundles.ObjectSink)
    good = spark.range(40).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.col("id").cast("string").cast("binary").alias("content"))
    bad = spark.range(1).select(F.lit("0" * 64).alias("sha256"), F.lit(b"x").alias("content"))
    with pytest.raises(Exception, match="bundle_digest_mismatch"):
        good.unionByName(bad).repartition(4).write.format("tidemark_objects").option("path", root).option("job", "j").mode("append").save()
    end = time.time() + 60  # tasks that were still running end by themselves
    while time.time() < end and objects(root) != there:
        time.sleep(0.5)
    assert objects(root) == there
    assert bundles.write_bundle(spark, files(spark, ("a", b"1"), ("b", b"2")), root) == {"files": 2, "written": 1, "reused": 1}


def test_json_lines_appear_whole(spark, tmp_path):
    from tidemark.operators import archive as A

    target = str(tmp_path / "out")
    A.write_jsonl(spark.createDataFrame([(1, "é" + chr(0x2028)), (2, None)], "b int, a string").coalesce(1), target)
    read = lambda: sorted(x for p in Path(target).glob("part-*") for x in p.read_text().splitlines())
    first = read()
    assert first == ['{"a":"é\\u2028","b":1}', '{"a":null,"b":2}']
    with pytest.raises(Exception):
        A.write_jsonl(spark.range(1).select(F.raise_error(F.lit("no")).cast("string").alias("x")), target)
    assert read() == first and [p.name for p in tmp_path.iterdir()] == ["out"]
    A.write_jsonl(spark.range(1), target)
    assert read() == ['{"id":0}']
