"""Bundles: files by the digest of their content, written by tasks, named by a manifest that is published last."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.sources.stores import Store

MANIFEST = "name string, sha256 string, size long"
DIGITS = 12


def _open(address: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (pafs.LocalFileSystem(), address)


def object_path(root: str, sha256: str) -> str:
    return f"{root}/objects/{sha256[:2]}/{sha256}"


@dataclass
class Written(WriterCommitMessage):
    """What a task made: where it says which objects, and how many."""

    journal: str
    objects: int


class ObjectWriter(DataSourceWriter):
    """Writes rows (sha256, content) as objects.

    An object gets its name when it is whole, by a rename, and its content decides the name, so a task that runs twice or
    beside another makes the same object. Each task notes the names that it is about to make in a journal of its own;
    one that fails takes its objects away itself, and when the job fails the journals say what finished ones made. Tasks that
    still run then find a mark and take theirs away as well.
    """

    def __init__(self, options: dict[str, str]):
        self.root, self.job = options["path"].rstrip("/"), options["job"]

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = _open(self.root)
        journal = f"{root}/_journal-{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(f"{root}/_journal-{self.job}", recursive=True)
        made: list[str] = []

        def go_on() -> None:
            if fs.get_file_info(f"{root}/_aborted-{self.job}").type == pafs.FileType.File:
                raise RuntimeError("bundle_write_aborted")

        try:
            with fs.open_output_stream(journal) as log:
                for row in iterator:
                    if row["content"] is None:
                        raise ValueError("bundle_content_missing")
                    content = bytes(row["content"])
                    if hashlib.sha256(content).hexdigest() != row["sha256"]:
                        raise ValueError("bundle_digest_mismatch")
                    path = object_path(root, row["sha256"])
                    if fs.get_file_info(path).type == pafs.FileType.File:
                        continue
                    go_on()
                    log.write(f"{path}\n".encode())
                    made.append(path)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    draft = f"{path}.{uuid.uuid4().hex}"
                    try:
                        with fs.open_output_stream(draft) as out:
                            out.write(content)
                        fs.move(draft, path)
                    except BaseException:
                        if fs.get_file_info(draft).type == pafs.FileType.File:
                            fs.delete_file(draft)
                        raise
            go_on()
        except BaseException:
            _remove(fs, [*made, journal])
            raise
        return Written(journal, len(made))

    def commit(self, messages: list[Written | None]) -> None:
        """Objects are there; the manifest makes them part of the bundle."""

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.root)
        folder = f"{root}/_journal-{self.job}"
        with fs.open_output_stream(f"{root}/_aborted-{self.job}"):
            pass
        if fs.get_file_info(folder).type != pafs.FileType.Directory:
            return
        for entry in fs.get_file_info(pafs.FileSelector(folder)):
            with fs.open_input_stream(entry.path) as f:
                _remove(fs, f.read().decode().split())
        fs.delete_dir(folder)


def _remove(fs: pafs.FileSystem, paths: list[str]) -> None:
    for path in paths:
        if fs.get_file_info(path).type == pafs.FileType.File:
            fs.delete_file(path)


class ObjectSink(DataSource):
    """The write side of bundles; ``write_bundle`` uses it."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_objects"

    def schema(self) -> str:
        return "sha256 string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ObjectWriter(dict(self.options))


def bundle_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(name, sha256, size) of the files that a bundle holds."""
    store = Store(spark, root)
    versions = [n for n in store.names("manifests") if n.endswith(".json")]
    if not versions:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/{json.loads(store.read(f'manifests/{versions[-1]}'))['rows']}")


def write_bundle(spark: SparkSession, files: DataFrame, root: str) -> dict[str, int]:
    """Adds ``files`` (name, content) to a bundle and returns how many objects were written and how many files reused one.

    A name that is given, or already there, with another content fails the write before any object is made; a null name or content fails it as well.
    Content that the bundle has is not written again. A write that fails leaves the bundle, and the objects below it, as they were.
    """
    store = Store(spark, root)
    versions = [n for n in store.names("manifests") if n.endswith(".json")]
    had = bundle_manifest(spark, root)
    named = files.select("name", "content", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))
    rows = named.groupBy("name").agg(F.min("sha256").alias("sha256"), F.max("sha256").alias("_hi"), F.max("size").alias("size"))
    old = had.select(F.col("name").alias("_n"), F.col("sha256").alias("_s"))
    checked = rows.join(old, F.col("name") == F.col("_n"), "left")
    wrong = F.when(F.col("name").isNull() | F.col("sha256").isNull(), "bundle_content_missing").when((F.col("sha256") != F.col("_hi")) | (F.col("_s") != F.col("sha256")), "bundle_conflict")
    bad = checked.select(wrong.alias("w")).where("w is not null").limit(1).collect()
    if bad:
        raise ValueError(bad[0]["w"])
    fresh = named.join(had.select("sha256").distinct(), "sha256", "left_anti").select("sha256", "content").dropDuplicates(["sha256"])
    spark.dataSource.register(ObjectSink)
    job = uuid.uuid4().hex
    fresh.write.format("tidemark_objects").option("path", root).option("job", job).mode("append").save()
    table = f"rows/{job}"
    names = checked.select("name", "sha256", "size")
    had.join(names.select("name"), "name", "left_anti").select("name", "sha256", "size").unionByName(names).write.parquet(f"{root}/{table}")
    number = int(versions[-1][:DIGITS]) + 1 if versions else 1
    if not store.create(f"manifests/{number:0{DIGITS}d}.json", json.dumps({"rows": table})):
        ObjectWriter({"path": root, "job": job}).abort([])
        store.delete(table)
        raise RuntimeError("bundle_changed_meanwhile")
    total, distinct = names.count(), fresh.select("sha256").count()
    store.delete(f"_journal-{job}")
    return {"files": total, "written": distinct, "reused": names.join(had.select("sha256").distinct(), "sha256", "left_semi").count()}
