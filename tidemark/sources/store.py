"""Reads of stores: discovery, pruning, stable snapshots, change-log overlays, JSON and byte ranges."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import M_RAW, union_all


class SourceChanged(RuntimeError):
    """The files under a snapshot changed each time they were read."""


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length, modified) of all files below ``root``; folders named migrate are left out. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).where(~F.col("path").rlike("/migrate/"))


def named(files: DataFrame, name: str) -> DataFrame:
    """The files of one name, in path order."""
    return files.where(F.lower(F.element_at(F.split("path", "/"), -1)) == name.lower()).orderBy("path")


def message_shards(files: DataFrame) -> DataFrame:
    """The files that hold message shards: message_<n> below a folder named message."""
    return files.where(F.col("path").rlike(r"/message/(.*/)?message_\d+(\.[a-z]+)?$")).orderBy("path")


def session_table(session_id: Column | str) -> Column:
    """The hash-addressed name of a session's message table, the partition key of a message store."""
    return F.concat(F.lit("Msg_"), F.md5(F.col(session_id) if isinstance(session_id, str) else session_id))


def messages_of(store: DataFrame, session_id: str) -> DataFrame:
    """A session's messages: on a store partitioned by ``session_hash`` only its folders are read, and the id guards against the rest."""
    picked = store
    if "session_hash" in store.columns:
        picked = picked.where(F.col("session_hash") == F.md5(F.lit(session_id)))
    return picked.where(F.col("session_id") == session_id)


def write_store(messages: DataFrame, path: str) -> None:
    """Writes a message store, pruned by account and session hash; ids within a file are sorted for row-group skipping."""
    (
        messages.withColumn("session_hash", F.md5("session_id"))
        .repartition("account", "session_hash")
        .sortWithinPartitions("account", "session_hash", "create_time", "sort_seq")
        .write.partitionBy("account", "session_hash")
        .parquet(path)
    )


def shards(spark: SparkSession, paths: list[str], schema: T.StructType = M_RAW) -> DataFrame:
    """The union of physical shards, tagged by their file."""
    return union_all(*[spark.read.parquet(p).withColumn("shard", F.lit(p)) for p in paths]) if paths else spark.createDataFrame([], schema)


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: a hash over the sorted (path, length, modified), the number of files, their bytes, the newest time."""
    entry = F.struct("path", "length", F.unix_micros(F.col("modified").cast("timestamp")).alias("modified"))
    return files.agg(
        F.sha2(F.to_json(F.sort_array(F.collect_list(entry))), 256).alias("fingerprint"),
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.max("modified").alias("latest"),
    )


def stable_read(spark: SparkSession, root: str, read: Callable[[list[str]], DataFrame], attempts: int = 3, glob: str = "*") -> DataFrame:
    """``read`` over a fixed list of files whose fingerprint is the same before and after."""
    for _ in range(attempts):
        before = fingerprint(listing(spark, root, glob)).head()["fingerprint"]
        paths = [r["path"] for r in listing(spark, root, glob).select("path").orderBy("path").collect()]  # names of files, not rows
        out = read(paths)
        if fingerprint(listing(spark, root, glob)).head()["fingerprint"] == before:
            return out
    raise SourceChanged(f"{root} changed during {attempts} reads")


def committed_overlay(base: DataFrame, log: DataFrame, key: str, seq: str = "seq", commit: str = "commit", deleted: str = "deleted") -> DataFrame:
    """``base`` with the committed prefix of ``log`` applied: the last write of each key wins, deleted keys go.

    The committed prefix ends with the last commit record before the first gap in ``seq``, so a torn tail
    is left out. The log's rows carry base's columns.
    """
    first = log.agg(F.min(seq).alias("s0"))
    # seq - rank is constant until the first gap; ranks come from counts of a range, not from one sorted task.
    gap = log.select(F.col(seq).alias("s")).join(log.select((F.col(seq) + 1).alias("p")), F.col("s") == F.col("p"), "left_anti").crossJoin(F.broadcast(first)).where("s > s0").agg(F.min("s").alias("gap"))
    bound = log.where(F.col(commit)).crossJoin(F.broadcast(gap)).where(F.col("gap").isNull() | (F.col(seq) < F.col("gap"))).agg(F.max(seq).alias("upto"))
    live = log.crossJoin(F.broadcast(bound)).where(F.col(seq) <= F.col("upto"))
    last = live.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in base.columns if c != key], F.coalesce(F.col(deleted), F.lit(False)).alias("_gone")), seq).alias("r"))
    kept = last.where(~F.col("r._gone")).select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in base.columns])
    return base.join(last.select(key), key, "left_anti").select(*base.columns).unionByName(kept)


def pages_of(df: DataFrame, size: int = 512) -> Iterator[list[Row]]:
    """Rows in pages for a driver-side reader, partition by partition."""
    page: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        page.append(row)
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Strict JSON lines: a malformed line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


#: The alias file's schema name (fixed by its format) and the fields of an entry.
ALIAS_FIELDS = "name string, account string, nativeId string, chatType string, label string, addedAt bigint"


def read_aliases(spark: SparkSession, path: str, accounts: tuple[str, ...] = ("primary", "secondary")) -> DataFrame:
    """The entries of an alias file; any entry without name, known account, id and known chat type fails the query."""
    raw = spark.read.schema(f"schema string, aliases array<struct<{', '.join(f.replace(' ', ':', 1) for f in ALIAS_FIELDS.split(', '))}>>").option("multiLine", "true").option("mode", "FAILFAST").json(path)
    entries = raw.select(F.inline("aliases"))
    fine = (F.trim("name") != "") & F.col("account").isin(*accounts) & (F.trim("nativeId") != "") & F.col("chatType").isin("group", "private")
    return entries.where(F.when(F.coalesce(fine, F.lit(False)), True).otherwise(F.raise_error(F.lit("alias_entry_invalid")).cast("boolean")))


def with_account(df: DataFrame, account: str) -> DataFrame:
    return df.withColumn("account", F.lit(account))


def both_accounts(parts: dict[str, DataFrame]) -> DataFrame:
    """The union of accounts, each row tagged by its own."""
    return union_all(*[with_account(df, account) for account, df in sorted(parts.items())])


def archive_catalog(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """All manifest.json below ``root`` but those of unfinished or in-transaction archives, with their path."""
    found = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").json(root)
    return found.withColumn("path", F.col("_metadata.file_path")).where(~F.col("path").rlike(r"\.incomplete|\.transaction"))


def byte_ranges(spark: SparkSession, files: str, ranges: DataFrame) -> DataFrame:
    """Adds ``bytes`` to ``ranges`` (path, offset, length): a range beyond its file fails the query."""
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(files).select("path", "content")
    inside = F.when(F.col("offset") + F.col("length") <= F.octet_length("content"), F.substring("content", F.col("offset") + 1, F.col("length"))).otherwise(F.raise_error(F.lit("range_outside_file")).cast("binary"))
    return ranges.join(contents, "path").withColumn("bytes", inside).drop("content")


def dereference(pointers: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each typed pointer, all stored keys re-checked (nulls equal); no row or several fail the query."""
    cond = None
    for k in keys:
        c = pointers[k].eqNullSafe(rows[k])
        cond = c if cond is None else cond & c
    n = F.count(rows[keys[0]]).over(Window.partitionBy(*[pointers[k] for k in keys]))
    hit = pointers.join(rows, cond, "left").select(*[pointers[c] for c in pointers.columns], *[rows[c] for c in rows.columns if c not in pointers.columns], n.alias("_hits"))
    return hit.where(F.when(F.col("_hits") == 1, True).otherwise(F.raise_error(F.lit("pointer_target_not_unique")).cast("boolean"))).drop("_hits")


def preferred_source(candidates: DataFrame, key: str, rank: dict[str, int]) -> DataFrame:
    """Of each key's available candidates the one whose kind ranks first; ties go to the smaller path."""
    order = F.coalesce(*[F.when(F.col("kind") == k, r) for k, r in rank.items()], F.lit(len(rank)))
    return candidates.where("available").groupBy(key).agg(F.min_by(F.struct("kind", "path"), F.struct(order.alias("r"), "path")).alias("best")).select(key, "best.kind", "best.path")


def valid_name(name: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z0-9_.-]+", name))
