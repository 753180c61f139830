"""Quality classifier: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, sample_order
from tidemark.llm.linear import byte_ngrams, fit_hinge, fit_sigmoid, sigmoid, stretches

CHAR_DIMS, CLASS_DIMS, RUNS = 1 << 16, 1 << 14, 16
DIMS = CHAR_DIMS + CLASS_DIMS + RUNS


def _classes() -> np.ndarray:
    """Letters by case, digits and white space as one sign each; other signs and bytes above ASCII stay or join."""
    out = np.arange(256, dtype=np.uint8)
    out[ord("a") : ord("z") + 1] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    out[[9, 10, 11, 12, 13]] = ord(" ")
    out[128:] = ord("a")
    return out


_CLASS = _classes()


def indicators(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Sorted codes of the n-grams that the whole text has. ``seen``: DIMS false flags, false again afterwards.

    Character 3-grams of the lower-cased text, 1- and 4-grams of character classes, and the word
    n-grams that repeat one word 2, 3, 4, 6, 10 times and so on.
    """
    raw = (text or "").encode()
    for part in stretches(raw.lower(), 3):
        seen[byte_ngrams(part, 3, CHAR_DIMS)] = True
    for order in (1, 4):
        for part in stretches(raw, order):
            seen[CHAR_DIMS + byte_ngrams(_CLASS[part], order, CLASS_DIMS)] = True
    words = raw.split()
    same = np.fromiter(map(eq, words, words[1:]), dtype=bool, count=max(0, len(words) - 1))
    if same.any():
        edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
        longest = int((edges[1::2] - edges[::2]).max())
        seen[CHAR_DIMS + CLASS_DIMS : CHAR_DIMS + CLASS_DIMS + min(RUNS, 1 + int(2 * np.log2(longest)))] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found.astype(np.int32)


class QualityModel:
    """w . (r * x) / sqrt(number of indicators) + b, through a sigmoid fitted on margins from held-out halves."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, smoothing: float = 1.0, cost: float = 1.0):
        self.weights, self.bias, self.a, self.b = np.zeros(DIMS), 0.0, 1.0, 0.0
        if not len(y) or y.min() == y.max():
            self.b = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
            return
        margins = np.zeros(len(y))
        for k in (0, 1):
            other = np.arange(len(y)) % 2 != k
            if 0 < y[other].sum() < other.sum():
                w, b = self._fit([r for r, o in zip(rows, other, strict=True) if o], y[other], smoothing, cost)
                for i in np.flatnonzero(~other):
                    margins[i] = w[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + b
        self.a, self.b = fit_sigmoid(margins, y)
        self.weights, self.bias = self._fit(rows, y, smoothing, cost)

    @staticmethod
    def _fit(rows: list[np.ndarray], y: np.ndarray, smoothing: float, cost: float) -> tuple[np.ndarray, float]:
        up, down = np.full(DIMS, smoothing), np.full(DIMS, smoothing)
        for r, label in zip(rows, y, strict=True):
            (up if label else down)[r] += 1
        ratio = np.log((up / up.sum()) / (down / down.sum()))
        scaled = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
        norms = np.array([(x**2).sum() + 1 for x in scaled])
        sign = np.where(y > 0, 1.0, -1.0)
        share = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))

        def add(i: int, w: np.ndarray, by: float) -> None:
            w[rows[i]] += by * scaled[i]  # the codes of a row are distinct
            w[DIMS] += by

        w = fit_hinge(len(rows), lambda i, w: w[rows[i]] @ scaled[i] + w[DIMS], add, norms, sign, DIMS + 1, cost * share)
        return w[:DIMS] * ratio, float(w[DIMS])

    def score(self, texts: list[str | None]) -> np.ndarray:
        seen, out = np.zeros(DIMS, dtype=bool), np.zeros(len(texts))
        for i, text in enumerate(texts):
            r = indicators(text, seen)
            out[i] = self.weights[r].sum() / np.sqrt(max(1, len(r))) + self.bias
        return sigmoid(self.a * out + self.b)


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", rows_per_class: int = 1500) -> QualityModel:
    """Fits on a bounded sample: of each class the ``rows_per_class`` labelled ids first in a fixed hash order.

    ``learn`` says which labels may be used. Ids labelled more than once count once, with their
    smallest label; null labels and ids are left out. Whole texts are turned into indicator codes
    on the executors, at most DIMS of them a text.
    """
    known = labels.where(learn & F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).alias("y"))
    sample = None
    for c in (0, 1):
        part = known.where((F.col("y") > 0).cast("int") == c).orderBy(sample_order(), "doc_id").limit(rows_per_class).select(F.col("doc_id").alias("_id"), F.lit(c).alias("_y"))
        sample = part if sample is None else sample.unionByName(part)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIMS, dtype=bool)
        for batch in batches:
            x = [indicators(t.as_py(), seen).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["doc_id", "y", "x"])

    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "_y").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(codes, "doc_id long, y int, x binary")
    first: dict = {}
    for r in rows.toArrow().to_pylist():  # at most 2 rows_per_class
        first[r["doc_id"]] = min(first.get(r["doc_id"], (r["y"], r["x"])), (r["y"], r["x"]))
    ordered = [first[k] for k in sorted(first)]
    return QualityModel([np.frombuffer(x, dtype=np.int32) for _, x in ordered], np.array([y for y, _ in ordered], dtype=np.int64))


def score(docs: DataFrame, model: QualityModel, keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1, higher: label 1 likelier) to the columns ``keep`` (default: all), from the whole text alone.

    Null and empty texts have no indicator and get the score of the bias; without labels of both
    classes every score is the same. Other columns pass through; an input column with an output's name is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score",)]
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # DIMS weights
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(free_name(docs, "_whole_text")))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                s = shipped.value.score(batch.column(batch.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s)], names=[*keep, "score"])

    return source.mapInArrow(run, schema)
