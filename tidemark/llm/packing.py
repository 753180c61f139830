"""Best-fit packing of tokenized documents, planned over the histogram of piece lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, materialize, rank_within
from tidemark.llm.tokenization import WordTokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized(docs: DataFrame, tokenizer_path: str, size: int, end_id: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``size`` tokens of every whole text: (doc_id, piece, start, length, ids_crc32[, ids])."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokenizer.shared(tokenizer_path).encode_bytes
        tail = np.array([end_id], dtype="<u4").tobytes()
        step = 4 * size
        for batch in batches:
            ids, piece, start, length, crc, tokens = [], [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encode(text.as_py() or "") + tail
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    ids.append(doc)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        tokens.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            columns = [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit over counts: slots as runs (length, first rank, ranks, first sequence, items a sequence, offset).

    Repeatedly takes the longest length that is left, fills its sequence with the longest length
    that still fits, and repeats that pattern as often as the counts allow. So the work and the
    plan depend on the number of distinct lengths, at most ``size``, and not on the documents.
    In a run, rank r sits in sequence ``first sequence + (r - first rank) // items`` at
    ``offset + (r - first rank) % items * length``.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    used = dict.fromkeys(lengths, 0)
    runs, sequence = [], 0
    while lengths:
        space, pattern = size, []
        while space:
            i = bisect_right(lengths, space)
            while i and not left[lengths[i - 1]] - sum(m for n, m in pattern if n == lengths[i - 1]):
                i -= 1
            if not i:
                break
            n = lengths[i - 1]
            m = min(space // n, left[n])
            pattern.append((n, m))
            space -= n * m
        times = min(left[n] // m for n, m in pattern)
        offset = 0
        for n, m in pattern:
            runs.append((n, used[n], times * m, sequence, m, offset))
            used[n] += times * m
            left[n] -= times * m
            offset += n * m
            if not left[n]:
                lengths.remove(n)
        sequence += times
    return runs


def packed(pieces: DataFrame, size: int, tag: str = "pack") -> DataFrame:
    """Adds sequence_id and offset to materialized ``pieces`` (length <= size) by joining rank within length with the plan."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    runs = plan(histogram, size)
    by_length: dict[int, np.ndarray] = {}
    for run in runs:
        by_length.setdefault(run[0], []).append(run[1:])
    by_length = {n: np.array(sorted(r), dtype=np.int64) for n, r in by_length.items()}
    ranked = rank_within(pieces, "length", ["doc_id", "piece", "start"], total=sum(histogram.values()))
    names = [c for c in pieces.columns]
    slots = pieces.sparkSession.sparkContext.broadcast(by_length)  # bounded by the number of lengths
    schema = pieces.sparkSession.createDataFrame([], pieces.schema).schema.add("sequence_id", "long").add("offset", "long")

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("length")
        for batch in batches:
            length = np.asarray(batch.column(at), dtype=np.int64)
            rank = np.asarray(batch.column(len(names)), dtype=np.int64)
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                r = slots.value[int(n)]
                run = r[np.searchsorted(r[:, 0], rank[rows], side="right") - 1]
                within = rank[rows] - run[:, 0]
                sequence[rows] = run[:, 2] + within // run[:, 3]
                offset[rows] = run[:, 4] + within % run[:, 3] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(place, schema)


def best_fit_pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Packs every document into sequences of at most ``size`` tokens.

    A document is its token ids followed by ``end_id``; only longer ones are cut, into pieces of
    ``size`` tokens and a last shorter one. Returns a row per piece: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset and, with ``with_ids``, the ids themselves. Null and empty
    texts are the single id ``end_id``; repeated rows are packed once each; an empty table gives
    no rows; other columns are ignored. The driver sees the length histogram only.
    """
    pieces = materialize(tokenized(docs, tokenizer_path, size, end_id, with_ids), "pieces")
    return packed(pieces, size)
