"""Archives that are merged by the partitions a batch touches: copy on write, published by one manifest."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.archive import gap_counts, merged
from tidemark.sources.stores import Store

#: Digits of a manifest's number; manifests sort by name.
DIGITS = 12


class ArchiveConflict(RuntimeError):
    """Another writer published a version in the meantime; the archive holds that one."""


@dataclass(frozen=True)
class Merged:
    """What a merge did."""

    version: int
    mode: str
    added: int = 0
    updated: int = 0
    same: int = 0
    written: tuple[str, ...] = ()


class PartitionedArchive:
    """Rows by key, in folders by partition; a version is a manifest that names a folder for each partition.

    ``partition`` says where a row belongs. A merge reads the partitions that its rows belong to, and those in which their keys
    already are; a partition in which nothing changes keeps its files. New folders become visible with the manifest, which is
    created once and never overwritten, so a reader sees one version whole, a writer that fails leaves nothing
    visible, and of two writers one gets ``ArchiveConflict``.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, digest: str, partition: Column):
        self.spark, self.root, self.key, self.digest, self.partition = spark, root.rstrip("/"), key, digest, partition.cast("string")
        self.store = Store(spark, root)

    def versions(self) -> list[int]:
        return [int(n[:DIGITS]) for n in self.store.names("manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict | None:
        versions = self.versions()
        if not versions:
            return None
        return json.loads(self.store.read(f"manifests/{version or versions[-1]:0{DIGITS}d}.json"))

    def _rows(self, manifest: dict, parts: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        folders = [f for p, f in sorted(manifest["partitions"].items()) if parts is None or p in parts]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        manifest = self.manifest(version)
        if manifest is None:
            raise FileNotFoundError(f"{self.root} holds no archive")
        return self._rows(manifest)

    def merge(self, incoming: DataFrame, fingerprint: str, state: dict | None = None) -> Merged:
        """Adds new keys, replaces rows of another digest, keeps equal ones and those that ``incoming`` lacks.

        Nothing is read if the archive was made from ``fingerprint``. ``incoming`` has one row per key; keys that
        occur twice, or are null, fail the merge before anything is written. ``state`` is published with the manifest.
        """
        base = self.manifest()
        if base is not None and base["fingerprint"] == fingerprint:
            return Merged(base["version"], "no_change")
        checked = F.when(F.col(self.key).isNull(), F.raise_error(F.lit("archive_key_missing")).cast("string")).otherwise(self.partition)
        incoming = incoming.withColumn("_part", F.coalesce(checked, F.lit("")))
        if incoming.groupBy(self.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            raise ValueError("archive_key_repeated")
        if base is None:
            changes, counts, touched = incoming, {"added": incoming.count()}, sorted(r["_part"] for r in incoming.select("_part").distinct().collect())
            kept = None
        else:
            if base["schema"] != incoming.drop("_part").schema.jsonValue():
                raise ValueError("archive_schema_changed")
            old = self._rows(base).withColumn("_part", F.coalesce(self.partition, F.lit("")))
            # Keys and digests alone decide what changes; rows are read of the touched partitions only.
            wanted = incoming.select(F.col(self.key).alias("_k"), F.col("_part").alias("_to"), F.col(self.digest).alias("_d"))
            known = old.select(self.key, self.digest, "_part")
            met = wanted.join(known, F.col("_k") == F.col(self.key), "left")
            moved = F.col(self.key).isNotNull() & (F.col("_part") != F.col("_to"))
            change = F.when(F.col(self.key).isNull(), "added").when(moved | ~F.col("_d").eqNullSafe(F.col(self.digest)), "updated").otherwise("same")
            met = met.select("_k", F.col("_part").alias("_from"), "_to", change.alias("change")).persist()
            try:
                counts = {r["change"]: r["n"] for r in gap_counts(met, "change").collect()}
                differs = met.where("change <> 'same'")
                touched = sorted({x for r in differs.select("_from", "_to").distinct().collect() for x in r if x is not None})  # names of partitions
                changes = incoming.join(differs.select(F.col("_k").alias(self.key)), self.key, "left_semi").select(*incoming.columns)
                if not touched:
                    return self._publish(base, fingerprint, state, {}, counts, incoming)
                stay = self._rows(base, touched).withColumn("_part", F.coalesce(self.partition, F.lit("")))
                kept = stay.join(differs.select(F.col("_k").alias(self.key)), self.key, "left_anti").select(*incoming.columns)
                return self._publish(base, fingerprint, state, self._write(kept.unionByName(changes), touched), counts, incoming)
            finally:
                met.unpersist()
        return self._publish(base, fingerprint, state, self._write(changes, touched), counts, incoming)

    def _write(self, rows: DataFrame, parts: list[str]) -> dict[str, str | None]:
        """Folders of the partitions, by name; a partition that is left without rows has none."""
        run = f"data/run-{uuid.uuid4().hex}"
        # A folder's name is a digest of the partition's, which may hold any character.
        named = rows.withColumn("_folder", F.sha1("_part"))
        named.repartition("_folder").sortWithinPartitions("_folder", self.key).drop("_part").write.partitionBy("_folder").parquet(f"{self.root}/{run}")
        there = set(self.store.names(run))
        folder = {r["p"]: f"_folder={r['f']}" for r in self.spark.createDataFrame([(p,) for p in parts], "p string").select("p", F.sha1("p").alias("f")).collect()}
        return {p: f"{run}/{folder[p]}" if folder[p] in there else None for p in parts}

    def _publish(self, base: dict | None, fingerprint: str, state: dict | None, written: dict[str, str | None], counts: dict[str, int], incoming: DataFrame) -> Merged:
        version = (base["version"] if base else 0) + 1
        parts = {p: f for p, f in ((base["partitions"] if base else {}) | written).items() if f is not None}
        manifest = {"version": version, "fingerprint": fingerprint, "schema": incoming.drop("_part").schema.jsonValue(), "partitions": parts, "state": state or {}}
        if not self.store.create(f"manifests/{version:0{DIGITS}d}.json", json.dumps(manifest)):
            for run in {f.rsplit("/", 1)[0] for f in written.values() if f}:
                self.store.delete(run)
            raise ArchiveConflict(f"version {version} of {self.root} is another writer's")
        return Merged(version, "full" if base is None else "incremental", counts.get("added", 0), counts.get("updated", 0), counts.get("same", 0), tuple(sorted(written)))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the newest ``keep`` versions and every folder that none of those names; returns how many folders went.

        A claim without its manifest is left by a writer that ended between the two: it goes as well, so the number can be used again. Not to be run beside writers.
        """
        versions = self.versions()[-max(1, keep) :]
        used = {f for v in versions for f in self.manifest(v)["partitions"].values()}
        for name in self.store.names("manifests"):
            if name[:DIGITS].isdigit() and (int(name[:DIGITS]) not in versions):
                self.store.delete(f"manifests/{name}")
        gone = 0
        for run in self.store.names("data"):
            folders = [f for f in self.store.names(f"data/{run}") if f.startswith("_folder=")]
            free = [f for f in folders if f"data/{run}/{f}" not in used]
            for f in free:
                self.store.delete(f"data/{run}/{f}")
            gone += len(free)
            if len(free) == len(folders):
                self.store.delete(f"data/{run}")
        return gone


def merge_preview(existing: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """(change, n): what a merge would add, update, keep and retain."""
    return gap_counts(merged(existing, incoming, key, digest), "change")
