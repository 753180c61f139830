"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separators of the shingle operators.
ASCII_SPACE = "[\\x20\\x09-\\x0D]+"


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of ``mapInArrow``; a worker gives back at the end of each task what the task has freed, as it goes on to serve other stages."""

    @functools.wraps(run)
    def returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return returned


#: Bytes of an Arrow batch, on its way to Python and in it.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: str = "4m") -> None:
    """From now on Arrow batches take little more than ``most`` bytes, unless the session has a limit of its own.

    By rows alone a batch of long texts takes tens of megabytes, several times over: in the JVM's buffers, beside its heap, and in each worker.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where the session names none, a temporary one in local mode, else one in the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        alone = re.match(r"local(\[|$)", spark.sparkContext.master) is not None
        path = f"file://{tempfile.mkdtemp(prefix='tidemark-')}" if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/tidemark"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Shuffle files of a written table are of no more use; Spark removes them at the end of the write.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    This cuts the lineage, so that a lost executor costs a re-read and no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{tag}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` returned and that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def crc_fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % folds


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, made longer until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def sample_order(doc_id: str = "doc_id") -> Column:
    """A fixed pseudo-random order of ids, for bounded samples that don't depend on the partitioning."""
    return F.xxhash64(F.col(doc_id), F.lit("sample"))


def components(edges: DataFrame, tag: str = "cc", max_rounds: int = 64) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) as (id, component_id = smallest id reachable).

    Min-label propagation with pointer jumping. Each round joins with plain shuffle joins,
    which adaptive execution splits at hot keys, and aggregates with map-side combining;
    each round is cut by a table in the shared folder. Nulls and self links are ignored.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), f"{tag}-0")
    for k in range(1, max_rounds + 1):
        near = (
            both.join(labels, F.col("b") == F.col("id"))
            .groupBy("a")
            .agg(F.min("label").alias("near"))
            .join(labels, F.col("a") == F.col("id"))
            .select("id", F.col("label").alias("before"), F.least("near", "label").alias("label"))
        )
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        stepped = near.join(jump, "label", "left").select("id", "before", F.least("label", F.coalesce("up", "label")).alias("label"))
        stepped = materialize(stepped, f"{tag}-{k}")
        changed = stepped.where("label <> before").limit(1).count()
        labels = stepped.select("id", "label")
        if not changed:
            return labels.select("id", F.col("label").alias("component_id"))
    raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")


def rank_within(df: DataFrame, group: str, tie: list[str], rows_per_bucket: int = 50_000, total: int | None = None) -> DataFrame:
    """Adds ``rank``: gapless from 0 within ``group``, without gathering a group in one task.

    Rows go to hash buckets of about ``rows_per_bucket`` within their group; each bucket is
    numbered by a window and shifted by the count of the buckets before it. ``df`` should be
    cheap to read twice (a materialized table).
    """
    n = total if total is not None else df.count()
    buckets = max(64, -(-n // rows_per_bucket))
    keyed = df.withColumn("_b", F.pmod(F.xxhash64(*tie), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("_g"), F.col("_b").alias("_ob"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy(group, "_b").orderBy(*tie)
    return (
        keyed.withColumn("_r", F.row_number().over(local) - 1)
        .join(offsets, (F.col(group) == F.col("_g")) & (F.col("_b") == F.col("_ob")))
        .withColumn("rank", (F.col("_r") + F.col("_off")).cast("long"))
        .drop("_b", "_r", "_g", "_ob", "_off")
    )


def restricted(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """``df`` restricted to (left_semi) or without (left_anti) the ids in ``ids``, a materialized table of numbers.

    They are broadcast only if they are small; else both sides are shuffled, which adaptive execution splits at hot keys.
    """
    right = small(ids.select(F.col(ids.columns[0]).alias("_on")), "32")
    return df.join(right, df[on] == right["_on"], how)


def small(df: DataFrame, row_bytes: str, most_bytes: int = 32 << 20) -> DataFrame:
    """``df``, to be broadcast if its rows, of ``row_bytes`` each (an expression), take at most ``most_bytes``; else as it is."""
    size = df.agg(F.sum(F.expr(row_bytes)).alias("n")).head()["n"] or 0
    return F.broadcast(df) if size <= most_bytes else df
