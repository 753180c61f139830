"""Incremental snapshots of a partitioned store: only partitions whose files changed are read and written again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.store import SourceChanged, listing
from tidemark.sources.stores import Store

#: The format of the metadata, and reads of a source that changes meanwhile.
FORMAT, ATTEMPTS = 1, 3


@dataclass(frozen=True)
class Refreshed:
    """What a refresh did, by partition path."""

    rebuilt: bool
    written: tuple[str, ...]
    removed: tuple[str, ...]
    kept: int


def partition_signatures(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """(partition, signature, files, bytes) of every partition path below ``root``, from names, lengths and times; contents aren't read."""
    below = F.regexp_extract(F.col("path"), r"((?:/[^/=]+=[^/]*)+)/[^/]+$", 1)
    entry = F.struct(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.unix_micros(F.col("modified").cast("timestamp")).alias("modified"))
    files = listing(spark, root, glob).select(F.ltrim(below, F.lit("/")).alias("partition"), entry.alias("e"), "length")
    return files.groupBy("partition").agg(F.sha2(F.to_json(F.sort_array(F.collect_list("e"))), 256).alias("signature"), F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def _signatures(spark: SparkSession, source: str) -> dict[str, str]:
    return {r["partition"]: r["signature"] for r in partition_signatures(spark, source).select("partition", "signature").toLocalIterator()}  # a row per partition


class Snapshot:
    """A derived copy of a source that Spark writes by partition.

    ``<root>/_meta.json`` says which folder holds each partition and the signature that it was made from. A
    refresh marks the snapshot dirty, writes changed partitions into folders of their own, and makes them visible with
    one new metadata file; folders that nothing names any more go afterwards. Metadata that is missing, unreadable, of another
    format, source or ``version`` of the derivation, or dirty means a rebuild of everything.
    """

    def __init__(self, spark: SparkSession, source: str, root: str, keys: list[str], derive: Callable[[DataFrame], DataFrame] = lambda df: df, version: str = "1"):
        self.spark, self.source, self.root, self.keys, self.derive, self.version = spark, source.rstrip("/"), root.rstrip("/"), keys, derive, version
        self.store = Store(spark, root)

    def _meta(self) -> dict | None:
        if self.store.exists("_dirty") or not self.store.exists("_meta.json"):
            return None
        try:
            meta = json.loads(self.store.read("_meta.json"))
            fine = meta["format"] == FORMAT and meta["source"] == self.source and meta["version"] == self.version and meta["keys"] == self.keys
            return meta if fine and all(self.store.exists(p["folder"]) for p in meta["partitions"].values() if p["folder"]) else None
        except (ValueError, KeyError, TypeError):
            return None

    def refresh(self) -> Refreshed:
        """Brings the snapshot up to its source; a source that changes during three refreshes in a row fails it."""
        for _ in range(ATTEMPTS):
            meta, now = self._meta(), _signatures(self.spark, self.source)
            had = meta["partitions"] if meta else {}
            stale = sorted(p for p, s in now.items() if p not in had or had[p]["signature"] != s)
            gone = sorted(set(had) - set(now))
            if meta and not stale and not gone:
                return Refreshed(False, (), (), len(had))
            self.store.replace("_dirty", "")
            run = f"_run={uuid.uuid4().hex}"
            schema = meta["schema"] if meta else None
            if stale:
                derived = self.derive(self.spark.read.option("basePath", self.source).parquet(*[f"{self.source}/{p}" for p in stale]))
                derived.write.partitionBy(*self.keys).parquet(f"{self.root}/{run}")
                schema = derived.schema.jsonValue()
            if _signatures(self.spark, self.source) != now:
                # What was written may mix two states of the source: forget it, the old metadata still holds.
                self.store.delete(run)
                if meta:
                    self.store.delete("_dirty")
                continue
            parts = {p: had[p] for p in now if p in had and p not in stale}
            # A partition of which the derivation keeps no row has no folder.
            parts |= {p: {"signature": now[p], "folder": f"{run}/{p}" if self.store.exists(f"{run}/{p}") else None} for p in stale}
            found = {"format": FORMAT, "source": self.source, "version": self.version, "keys": self.keys, "schema": schema, "partitions": parts}
            self.store.replace("_meta.json", json.dumps(found))
            self.store.delete("_dirty")
            self._sweep(parts, [had[p]["folder"] for p in had if p not in parts or parts[p] != had[p]])
            return Refreshed(meta is None, tuple(stale), tuple(gone), len(parts) - len(stale))
        raise SourceChanged(f"{self.source} changed during {ATTEMPTS} refreshes")

    def _sweep(self, parts: dict[str, dict], replaced: list[str | None]) -> None:
        """Deletes folders that the metadata no longer names; a reader of the state before must be done by then."""
        for folder in filter(None, replaced):
            self.store.delete(folder)
        used = {p["folder"].split("/")[0] for p in parts.values() if p["folder"]}
        for name in self.store.names():
            if name.startswith("_run=") and name not in used:
                self.store.delete(name)

    def read(self) -> DataFrame:
        """The snapshot as it was last refreshed."""
        meta = self._meta()
        if meta is None:
            raise FileNotFoundError(f"{self.root} has no clean snapshot")
        schema = T.StructType.fromJson(meta["schema"])
        folders = sorted(p["folder"] for p in meta["partitions"].values() if p["folder"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        # _run= counts as a partition key of the files' paths; nobody asks for it.
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(*[f"{self.root}/{f}" for f in folders]).select(*schema.names)
