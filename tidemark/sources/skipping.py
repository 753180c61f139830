"""Data skipping by Parquet footers: which files of a store can hold a value, known without reading their rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.store import SourceChanged, listing
from tidemark.sources.stores import Store

ATTEMPTS = 3
INDEX = "path string, length long, modified long, row_count long, column string, kind string, low string, high string, nulls long, known boolean"


def footers(files: DataFrame, columns: list[str], partitions: int | None = None) -> DataFrame:
    """A row per file and column, from the files' footers alone: type, least and largest value as JSON, nulls, and whether that is known.

    ``files``: (path, length, modified). A column that a file lacks has kind null and no values; one without statistics
    in some row group is not known. Long strings' statistics may be cut by the writer, which pyarrow reports
    as not exact and which count as unknown here. Footers are read by the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(f["path"])
                with fs.open_input_file(path) as handle:
                    meta = pq.ParquetFile(handle).metadata
                at = {meta.schema.column(k).path: k for k in range(meta.num_columns)}
                for c in columns:
                    own = (f["path"], f["length"], f["modified"], meta.num_rows, c)
                    if c not in at:
                        out.append((*own, None, None, None, meta.num_rows, True))
                        continue
                    kind = meta.schema.column(at[c]).physical_type
                    stats = [meta.row_group(g).column(at[c]).statistics for g in range(meta.num_row_groups)]
                    fine = kind in ("INT32", "INT64", "BYTE_ARRAY") and all(s is not None and s.has_null_count and (s.has_min_max or s.null_count == s.num_values + s.null_count) for s in stats)
                    ends = [(s.min, s.max) for s in stats if s is not None and s.has_min_max]
                    fine = fine and all(isinstance(x, (int, str)) for e in ends for x in e)
                    low, high = (json.dumps(min(e[0] for e in ends)), json.dumps(max(e[1] for e in ends))) if fine and ends else (None, None)
                    out.append((*own, kind, low, high, sum(s.null_count for s in stats) if fine else None, fine))
            names = [x.split(" ")[0] for x in INDEX.split(", ")]
            kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
            cells = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds[x.split(" ")[1]]) for c, x in zip(cells, INDEX.split(", "), strict=True)], names=names)

    files = files.select("path", "length", F.unix_micros(F.col("modified").cast("timestamp")).alias("modified"))
    return files.repartition(partitions or files.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, INDEX)


class FooterIndex:
    """Ranges of a store's files, kept beside it as Parquet; only files that are new or changed have their footers read again."""

    def __init__(self, spark: SparkSession, root: str, index: str, columns: list[str], glob: str = "*.parquet"):
        self.spark, self.root, self.index, self.columns, self.glob = spark, root.rstrip("/"), index.rstrip("/"), columns, glob
        self.store = Store(spark, self.index)

    def _files(self) -> DataFrame:
        return listing(self.spark, self.root, self.glob).select("path", "length", "modified")

    def _versions(self) -> list[str]:
        return [n for n in self.store.names() if n.startswith("v") and self.store.exists(f"{n}/_SUCCESS")]

    def refresh(self) -> int:
        """Brings the index up to the store and returns how many footers it read."""
        files = self._files()
        stamp = F.unix_micros(F.col("modified").cast("timestamp"))
        versions = self._versions()
        keep = None
        if versions:
            old = self.spark.read.schema(INDEX).parquet(f"{self.index}/{versions[-1]}")
            now = files.select(F.col("path").alias("p"), F.col("length").alias("n"), stamp.alias("m"))
            keep = old.join(now, (F.col("path") == F.col("p")) & (F.col("length") == F.col("n")) & (F.col("modified") == F.col("m")), "left_semi")
            done = keep.groupBy("path").agg(F.collect_set("column").alias("c")).where(F.size(F.array_except(F.array(*map(F.lit, self.columns)), F.col("c"))) == 0).select(F.col("path").alias("p"))
            files = files.join(done, F.col("path") == F.col("p"), "left_anti")
            keep = keep.join(done, F.col("path") == F.col("p"), "left_semi")
        fresh = footers(files, self.columns)
        name = f"v{(int(versions[-1][1:]) if versions else 0) + 1:012d}"
        (fresh if keep is None else keep.withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True)))).write.mode("overwrite").parquet(f"{self.index}/{name}")
        for v in versions[:-1]:  # a reader may still hold the last one
            self.store.delete(v)
        written = self.spark.read.parquet(f"{self.index}/{name}")
        if "fresh" in written.columns:
            written = written.where("fresh")
        return written.select("path").distinct().count()

    def read(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            raise FileNotFoundError(f"{self.index} holds no index")
        return self.spark.read.schema(INDEX).parquet(f"{self.index}/{versions[-1]}")

    def _may_hold(self, low: int | str | None, high: int | str | None) -> Column:
        """Files whose range may meet [low, high]; an unknown range may."""
        text = isinstance(low if low is not None else high, str)
        value = (lambda c: F.from_json(F.concat(F.lit('{"v":'), F.col(c), F.lit("}")), "v string" if text else "v bigint")["v"])
        apart = F.lit(False)
        if low is not None:
            apart = apart | (value("high") < F.lit(low))
        if high is not None:
            apart = apart | (value("low") > F.lit(high))
        return F.when(~F.col("known"), True).when(F.col("low").isNull(), False).otherwise(~apart)

    def paths(self, **ranges) -> list[str]:
        """The files that can hold a row within all ``ranges`` (column: a value, or (low, high) with None for an open end)."""
        rows = self.read()
        if unknown := set(ranges) - set(self.columns):
            raise ValueError(f"not in the index: {', '.join(sorted(unknown))}")
        found = rows.select("path").distinct()
        for column, wanted in ranges.items():
            low, high = wanted if isinstance(wanted, tuple) else (wanted, wanted)
            found = found.join(rows.where((F.col("column") == column) & self._may_hold(low, high)).select("path"), "path", "left_semi")
        return [r["path"] for r in found.orderBy("path").toLocalIterator()]

    def scan(self, **ranges) -> DataFrame:
        """The rows within ``ranges``; files that can't hold any are not opened, whatever they hold.

        The index is brought up to date first. If the store's files change meanwhile, that is done again, three times at most.
        """
        for _ in range(ATTEMPTS):
            self.refresh()
            before = self._files().agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("path", "length", "modified")))), 256)).head()[0]
            paths = self.paths(**ranges)
            schema = self.spark.read.parquet(self.root).schema
            out = self.spark.read.schema(schema).option("basePath", self.root).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
            if before == self._files().agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("path", "length", "modified")))), 256)).head()[0]:
                break
        else:
            raise SourceChanged(f"{self.root} changed during {ATTEMPTS} reads")
        for column, wanted in ranges.items():
            low, high = wanted if isinstance(wanted, tuple) else (wanted, wanted)
            if low is not None:
                out = out.where(F.col(column) >= F.lit(low))
            if high is not None:
                out = out.where(F.col(column) <= F.lit(high))
        return out
