"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOWEST = np.iinfo(np.int64).min


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) per component; rows with a null or non-finite component or a null id take no part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"),
    )


def _matrix(ids: list, vectors: pa.ChunkedArray | pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and a (rows, terms) matrix; shorter vectors are sparse rows, their missing terms weigh nothing."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offsets = np.asarray(vectors.offsets, dtype=np.int64)
    flat = np.asarray(vectors.values, dtype=np.int64)
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), max(int(lengths.max(initial=0)), width or 0)), dtype=np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], lengths)] = flat[offsets[0] : offsets[-1]]
    return np.asarray(ids, dtype=np.int64), out


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Dense scores (queries, rows): each term's posting list is scattered with every query's weight for the term."""
    scores = np.zeros((len(queries), len(rows)), dtype=np.int64)
    for t in range(min(queries.shape[1], rows.shape[1])):
        having, posting = np.flatnonzero(queries[:, t]), np.flatnonzero(rows[:, t])
        if not len(having) or not len(posting):
            continue
        if len(having) == len(queries) and len(posting) == len(rows):
            scores += queries[:, t, None] * rows[None, :, t]
        else:
            scores[np.ix_(having, posting)] += queries[having, t, None] * rows[None, posting, t]
    return scores


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each line as (scores, ids), ties to smaller ids; LOWEST marks no row. ids: ascending, or a matrix ascending by line."""
    n = scores.shape[1]
    if n <= k:
        return scores, np.broadcast_to(ids, scores.shape)
    kth = np.partition(scores, n - k, axis=1)[:, n - k]
    picked = np.empty((len(scores), k), dtype=np.int64)
    for q in range(len(scores)):
        above = np.flatnonzero(scores[q] > kth[q])
        at = np.flatnonzero(scores[q] == kth[q])[: k - len(above)]
        picked[q] = np.sort(np.concatenate([above, at]))
    best = np.take_along_axis(scores, picked, axis=1)
    return best, ids[picked] if ids.ndim == 1 else np.take_along_axis(ids, picked, axis=1)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    queries_per_block: int = 4096,
    rows_per_block: int = 2048,
) -> DataFrame:
    """For each row with ``is_query``: the k other rows of highest integer inner product.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, fewer than
    k other rows are all returned. Queries are dealt by hash into blocks of about
    ``queries_per_block`` (the only thing that is broadcast, one block a pass); each task
    accumulates term at a time over ``rows_per_block`` rows and keeps k rows a query.

    Null ids, null vectors and vectors holding null or non-finite components take no part; an
    empty vector scores 0 everywhere. Vectors of different lengths meet on their common
    components. A repeated vec_id is a candidate once for each row and queries with its
    smallest vector. Columns beside the id and the vector are ignored.
    """
    rows = quantized(vectors, id_col, vector_col, scale)
    asked = quantized(vectors.where(is_query), id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-asked.count() // queries_per_block))
    schema = "query_id long, vec_id long, score long"
    spark, parts = vectors.sparkSession, []
    for block in range(blocks):
        t = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").toArrow()
        shipped = spark.sparkContext.broadcast(_matrix(t["vec_id"].to_pylist(), t["v"]))

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            qids, queries = shipped.value
            best = np.empty((len(qids), 0), dtype=np.int64)
            best_ids = np.empty((len(qids), 0), dtype=np.int64)
            for whole in batches:
                for start in range(0, whole.num_rows, rows_per_block):
                    batch = whole.slice(start, rows_per_block)
                    ids, matrix = _matrix(batch.column(0).to_pylist(), batch.column(1))
                    order = np.argsort(ids, kind="stable")
                    ids, matrix = ids[order], matrix[order]
                    for q in range(0, len(qids), 512):
                        scores = accumulate(queries[q : q + 512], matrix)
                        scores[qids[q : q + 512, None] == ids[None, :]] = LOWEST
                        new, new_ids = select(scores, ids, k)
                        if q == 0:
                            found = []
                        found.append((new, new_ids))
                    if not len(qids):
                        continue
                    best = np.concatenate([best, np.concatenate([x for x, _ in found])], axis=1)
                    best_ids = np.concatenate([best_ids, np.concatenate([x for _, x in found])], axis=1)
                    by_id = np.argsort(best_ids, axis=1, kind="stable")
                    best, best_ids = select(np.take_along_axis(best, by_id, 1), np.take_along_axis(best_ids, by_id, 1), k)
            real = best != LOWEST
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.broadcast_to(qids[:, None], best.shape)[real]), pa.array(np.asarray(best_ids)[real]), pa.array(best[real])], names=["query_id", "vec_id", "score"]
            )

        parts.append(rows.mapInArrow(search, schema))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
