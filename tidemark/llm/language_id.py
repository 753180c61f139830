"""Language identification in two steps: the family, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import lean, sample_order
from tidemark.llm.linear import batch_scores, fit_dense, ngram_frequencies, sigmoid
from tidemark.llm.words import byte_slices

#: Families of closely related languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "nb", "nn", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def prepared(text: str | None) -> bytes:
    """Lower-cased UTF-8 with a space at each end, so that word borders are n-grams too."""
    return f" {' '.join((text or '').lower().split())} ".encode()


class LanguageModel:
    """Weights (dims, models) of a one-versus-rest model per family and one model per pair within a family."""

    def __init__(self, x: np.ndarray, langs: list[str], orders: tuple[int, ...], scale: float):
        self.orders, self.scale = orders, scale
        self.langs = sorted(set(langs))
        named = {lang: name for name, members in FAMILIES.items() for lang in members}
        self.family = {lang: named.get(lang, lang) for lang in self.langs}
        self.families = sorted(set(self.family.values()))
        self.pairs = [p for f in self.families for p in combinations([m for m in self.langs if self.family[m] == f], 2)]
        of, x, columns = np.array(langs), x * scale, []
        kin = np.array([self.family[m] for m in langs])
        for f in self.families if len(self.families) > 1 else []:
            columns.append(fit_dense(x, np.where(kin == f, 1.0, -1.0)))
        for a, b in self.pairs:
            own = (of == a) | (of == b)
            columns.append(fit_dense(x[own], np.where(of[own] == a, 1.0, -1.0)))
        self.weights = np.array([w for w, _ in columns], dtype=np.float32).T * np.float32(scale) if columns else np.zeros((x.shape[1], 0), np.float32)
        self.bias = np.array([b for _, b in columns])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = np.array([bool(t) and _LETTER.search(t) is not None for t in texts], dtype=bool)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        margin = batch_scores([prepared(t) for t in texts], self.orders, self.weights) + self.bias
        n = len(self.families) if len(self.families) > 1 else 0
        chosen = margin[:, :n].argmax(axis=1) if n else np.zeros(len(texts), dtype=int)
        sure = sigmoid(2 * margin[:, :n].max(axis=1)) if n else np.ones(len(texts))
        out, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
        for k, f in enumerate(self.families):
            rows = np.flatnonzero((chosen == k) & known)
            members = [m for m in self.langs if self.family[m] == f]
            votes, strength = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for j, (a, b) in enumerate(self.pairs):
                if self.family[a] == f:
                    m = margin[rows, n + j]
                    for lang, s in ((a, m), (b, -m)):
                        votes[:, members.index(lang)] += s > 0
                        strength[:, members.index(lang)] += s
            best = (votes + 1e-3 * np.tanh(strength)).argmax(axis=1)
            out[rows] = np.array(members, dtype=object)[best]
            near = strength[np.arange(len(rows)), best] / max(1, len(members) - 1)
            score[rows] = sure[rows] * (sigmoid(2 * near) if len(members) > 1 else 1.0)
        return list(out), score


def train(docs: DataFrame, learn: Column, rows_per_language: int = 400, dims: int = 4096, orders: tuple[int, ...] = (1, 2, 3), scale: float = 20.0) -> LanguageModel:
    """Fits on a bounded sample: of each language the ``rows_per_language`` documents first in a fixed hash order.

    The sample is thinned by hash before it is collected, as feature vectors, so texts of any
    length stay on the executors.
    """
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel(np.zeros((0, dims), np.float32), [], orders, scale)
    buckets = 1 << 20
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == lang) & (F.pmod(sample_order(), F.lit(buckets)) < min(buckets, 2 + int(1.5 * rows_per_language / n * buckets))))

    @lean
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [ngram_frequencies(prepared(t.as_py()), orders, dims).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], names=["lang", "at", "x"])

    one = labelled.where(keep).groupBy("lang", sample_order().alias("at")).agg(F.min("text").alias("text"))  # a row per id
    rows = one.mapInArrow(features, "lang string, at long, x binary")
    found = sorted(rows.toArrow().to_pylist(), key=lambda r: (r["lang"], r["at"], r["x"]))
    taken, seen = [], dict.fromkeys(counts, 0)
    for r in found:
        if seen[r["lang"]] < rows_per_language:
            seen[r["lang"]] += 1
            taken.append(r)
    found.clear()
    x = np.array([np.frombuffer(r.pop("x"), dtype=np.float32) for r in taken]) if taken else np.zeros((0, dims), np.float32)
    return LanguageModel(x, [r["lang"] for r in taken], orders, scale)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to the columns ``keep`` (default: all), from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if
    nothing could be learned. Equal texts get equal results; other columns pass through, an input column
    with an output's name is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # dims x models weights
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    # The text goes to Python once, as the column that is kept or as a further one.
    source = kept if "text" in keep else docs.select(*[F.col(f"`{c}`") for c in keep], "text")
    at = source.columns.index("text")
    schema = T.StructType([*kept.schema.fields]).add("lang_pred", "string").add("score", "double")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, at):
                langs, score = shipped.value.predict(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return source.mapInArrow(run, schema)
