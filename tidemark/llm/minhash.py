"""Near-duplicate documents by bottom-k sketches of one hash function, verified on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, forget, lean, materialize, restricted, small
from tidemark.llm.decontamination import shingle_codes
from tidemark.llm.words import byte_slices, hashed_words, text_bytes

#: Counters for the rarity of values; a fixed size, shared by values that collide.
COUNTERS = 1 << 20
#: Keys from here on stand for sets whose smallest id is another set's as well.
FURTHER = 1 << 62


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct 63-bit codes of the runs of ``words`` words; of fewer words, the one of them all."""
    data, edges = text_bytes(pc.ascii_lower(texts))
    start, hashes = hashed_words(data, edges)
    at = np.searchsorted(start, edges).tolist()
    codes = (shingle_codes(hashes, words) >> np.uint64(1)).astype(np.int64)
    for a, b in zip(at, at[1:], strict=False):
        if b - a >= words:
            yield np.unique(codes[a : b - words + 1])
        else:
            yield (shingle_codes(hashes[a:b], b - a) >> np.uint64(1)).astype(np.int64) if b > a else np.zeros(0, dtype=np.int64)


def set_hash(own: np.ndarray) -> str | None:
    return xxhash.xxh3_128_hexdigest(own.tobytes()) if len(own) else None


def sketches(docs: DataFrame, words: int, k: int) -> DataFrame:
    """(doc_id, set_hash, n, sketch): the k least codes of each document's set; set_hash is null for an empty set."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1):
                hashes, sizes, values = [], [], []
                for own in shingle_sets(part.column(1), words):
                    hashes.append(set_hash(own))
                    sizes.append(len(own))
                    values.append(own[:k])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(hashes, pa.string()), pa.array(sizes, pa.int64()), pa.array(values, pa.list_(pa.int64()))],
                    names=["doc_id", "set_hash", "n", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set_hash string, n long, sketch array<long>")


def _counted(partial: DataFrame) -> np.ndarray:
    """Sums (slot, c) rows into COUNTERS counts; the driver gets a row per counter at most."""
    t = partial.groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[t["slot"].to_numpy()] = t["c"].to_numpy()
    return out


def _slots(batches: Iterator[pa.RecordBatch], values) -> Iterator[pa.RecordBatch]:
    """One row per used counter of what ``values(batch)`` yields in the partition."""
    total = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for own in values(batch):
            total += np.bincount(own & (COUNTERS - 1), minlength=COUNTERS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "c"])


def _packed(arrays: Iterator[np.ndarray], width: int = 1 << 19) -> Iterator[np.ndarray]:
    """The arrays, joined into larger ones."""
    held, size = [], 0
    for a in arrays:
        held.append(a)
        size += len(a)
        if size >= width:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def sketch_postings(reps: DataFrame, k: int, least_shared: int) -> DataFrame:
    """(v, rep, n): the retained values under which a document is listed, the rarest of its sketch.

    Similar documents share ``least_shared`` retained values at least (all but certainly; see
    ``near_duplicates``), or 80 % of them if their whole sets are retained. So with values in one
    order, rarest first, the first common one is among the first size - shared + 1 of each: passages
    that many documents share come last and list nobody.
    """

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _slots(batches, lambda b: [np.asarray(b.column(0).flatten(), dtype=np.int64)])

    shipped = reps.sparkSession.sparkContext.broadcast(_counted(reps.select("sketch").mapInArrow(count, "slot long, c long")).astype(np.int32))  # 4 MB

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shipped.value
        for batch in batches:
            vs, reps_, ns = [], [], []
            for rep, n, sketch in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                v = np.asarray(sketch.values, dtype=np.int64)
                shared = -(-4 * n // 5) if 5 * n <= 4 * k else least_shared
                v = v[np.lexsort((v, rarity[v & (COUNTERS - 1)]))][: max(1, len(v) - shared + 1)]
                vs.append(v)
                reps_.append(np.full(len(v), rep))
                ns.append(np.full(len(v), n))
            if vs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (vs, reps_, ns)], names=["v", "rep", "n"])

    return reps.select("doc_id", "n", "sketch").mapInArrow(run, "v long, rep long, n long")


def exact_postings(docs: DataFrame, words: int) -> DataFrame:
    """(v, rep, label, n, pos): of documents with a label the rarest n - ceil(0.8 n) + 1 shingles of each full set, in one rarest-first order."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _slots(batches, lambda b: _packed(own for part in byte_slices(b, 0) for own in shingle_sets(part.column(0), words)))

    shipped = docs.sparkSession.sparkContext.broadcast(_counted(docs.select("text").mapInArrow(count, "slot long, c long")).astype(np.int32))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shipped.value
        for whole in batches:
            for batch in byte_slices(whole, 1, 1 << 21):
                vs, reps_, labels, ns, places = [], [], [], [], []
                for rep, label, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(1), words), strict=True):
                    n = len(v)
                    v = v[np.lexsort((v, rarity[v & (COUNTERS - 1)]))][: n - (-(-4 * n // 5)) + 1]
                    vs.append(v)
                    reps_.append(np.full(len(v), rep))
                    labels.append(np.full(len(v), label))
                    ns.append(np.full(len(v), n))
                    places.append(np.arange(len(v)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (vs, reps_, labels, ns, places)], names=["v", "rep", "label", "n", "pos"])

    return docs.select("doc_id", "text", "label").mapInArrow(run, "v long, rep long, label long, n long, pos long")


def texts_of(keys: DataFrame, docs: DataFrame, classes: DataFrame, words: int, tag: str) -> DataFrame:
    """(key, text): a text of each class among ``keys``; texts are read for the classes' documents only."""
    wanted = materialize(classes.join(keys.select(F.col(keys.columns[0]).alias("wanted")).distinct(), F.col("key") == F.col("wanted"), "left_semi"), f"{tag}-wanted")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1):
                hashes = pa.array([set_hash(own) for own in shingle_sets(part.column(1), words)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), hashes, part.column(1)], names=["doc_id", "set_hash", "text"])

    some = restricted(docs.select("doc_id", "text"), wanted.select("rep").distinct(), "doc_id").mapInArrow(run, "doc_id long, set_hash string, text string")
    hit = small(wanted, "128").select("key", F.col("rep").alias("r"), F.col("set_hash").alias("h"))
    out = materialize(some.join(hit, (F.col("doc_id") == F.col("r")) & (F.col("set_hash") == F.col("h"))).select("key", "text"), f"{tag}-texts")
    forget(wanted)
    # Only a row that repeats both id and set gives a class two texts; texts are shuffled for that alone.
    if out.groupBy("key").count().where("count > 1").limit(1).count():
        every, out = out, materialize(out.groupBy("key").agg(F.min("text").alias("text")), f"{tag}-one-text")
        forget(every)
    return out


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, tag: str) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach 100 * intersection >= 80 * union."""
    texts = texts_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), docs, classes, words, tag)
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 3):
                good, last, own = [], None, None
                for k, (a, other) in enumerate(zip(part.column(0).to_pylist(), shingle_sets(part.column(3), words), strict=True)):
                    if a != last:
                        last, own = a, next(shingle_sets(part.column(2).slice(k, 1), words))
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    good.append(100 * both >= 80 * (len(own) + len(other) - both) and both > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    out = materialize(joined.mapInArrow(run, "a long, b long"), f"{tag}-edges")
    forget(texts)
    return out


def near_duplicates(docs: DataFrame, words: int = 4, k: int = 32, least_shared: int = 12, tag: str = "near") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of documents linked at Jaccard 0.8 or more.

    1. Every document gets the bottom-k sketch of its set of ``words``-word shingles; documents with
       equal sets are one class, with the smallest id as its key.
    2. Inverted lists of retained values: a list's members are paired with its first member. The
       union sketch's estimate filters these pairs, and the full sets verify them.
    3. Classes in a list that still holds more than one component go through an exact join of
       full sets (prefix, length and positional filters, rarest shingle first), for pairs of
       different components only; again the full sets verify them. No list is cut or left out, and
       a list of near copies, which step 2 has linked, makes no pairs here.

    Only step 2's view of who shares a list is subject to chance: of sets at exactly 0.8, one of
    more than 25 retained values, fewer than ``least_shared`` of the union sketch's k = 32 are
    common with a probability under 1e-7.

    Null and empty texts and texts without words have no shingle, are linked with nothing and are
    their own component; rows without an id are linked with nothing either and are not kept.
    Rows are documents of their own, also where an id repeats: those with equal texts are in one component, those with
    different ones only if they are linked. Other columns are ignored, whatever their names; an empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = materialize(sketches(docs, words, k), f"{tag}-sketches")
    whole = sk.where("set_hash is not null and doc_id is not null")
    by_set = materialize(whole.groupBy("set_hash").agg(F.min("doc_id").alias("rep")), f"{tag}-sets")
    shared = by_set.groupBy("rep").agg(F.min("set_hash").alias("h"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("rep").alias("r"), "h")
    further = F.lit(FURTHER) + F.xxhash64("set_hash").bitwiseAND(F.lit(FURTHER // 2 - 1))
    key = F.when(F.col("r").isNull() | (F.col("set_hash") == F.col("h")), F.col("rep")).otherwise(further)
    classes = materialize(by_set.join(shared, F.col("rep") == F.col("r"), "left").select("set_hash", "rep", key.alias("key")), f"{tag}-classes")
    one = whole.join(classes.select("set_hash", F.col("rep").alias("doc_id"), "key"), ["set_hash", "doc_id"]).dropDuplicates(["set_hash", "doc_id"])
    reps = materialize(one.select(F.col("key").alias("doc_id"), "n", "sketch"), f"{tag}-reps")
    postings = materialize(sketch_postings(reps, k, least_shared), f"{tag}-postings")
    lists = postings.groupBy("v").agg(F.min("rep").alias("hub"), F.min_by("n", "rep").alias("hub_n"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("v").alias("lv"), "hub", "hub_n")
    alike = "5 * least(n, hub_n) >= 4 * greatest(n, hub_n)"
    listed = materialize(postings.join(lists, F.col("v") == F.col("lv")).drop("lv"), f"{tag}-listed")
    stars = listed.where("rep <> hub").where(alike).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    # The estimate from the union sketch; a union under k values is whole, and the estimate exact.
    a, b = reps.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa")), reps.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    near = stars.join(b, "b").join(a, "a").select("a", "b", F.size(union).alias("u"), F.size(F.array_intersect(union, F.array_intersect("sa", "sb"))).alias("s"))
    likely = materialize(near.where(f"if(u < {k}, 5 * s >= 4 * u, s >= {least_shared})").select("a", "b"), f"{tag}-likely")
    edges = verified(likely, docs, classes, words, f"{tag}-star")
    found = components(edges, f"{tag}-cc")

    labelled = listed.join(found.select("id", F.col("component_id").alias("label")), F.col("rep") == F.col("id"), "left").select("v", "rep", F.coalesce("label", "rep").alias("label"))
    labelled = materialize(labelled, f"{tag}-labelled")
    mixed = labelled.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(F.col("v").alias("mv"))
    rest = materialize(labelled.join(mixed, F.col("v") == F.col("mv"), "left_semi").groupBy("rep").agg(F.min("label").alias("label")), f"{tag}-rest")
    forget(postings, listed, labelled, likely)
    if rest.limit(1).count():
        texts = texts_of(rest.select("rep"), docs, classes, words, f"{tag}-rest")
        labels = texts.join(small(rest, "16"), F.col("key") == F.col("rep")).select(F.col("key").alias("doc_id"), "text", "label")
        exact = materialize(exact_postings(labels, words), f"{tag}-exact")
        x = exact.select("v", F.col("rep").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("pos").alias("pa"))
        y = exact.select("v", F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
        fits = "a < b and la <> lb and 5 * least(na, nb) >= 4 * greatest(na, nb) and 9 * least(na - pa, nb - pb) >= 4 * (na + nb)"
        pairs = materialize(x.join(y, "v").where(fits).select("a", "b").distinct(), f"{tag}-pairs")
        more = verified(pairs, docs, classes, words, f"{tag}-exact")
        forget(texts, exact, pairs)
        if more.limit(1).count():
            found = components(edges.unionByName(more), f"{tag}-cc2")
    # A component's id is the least document id of its classes.
    roots = classes.join(found, F.col("key") == F.col("id")).groupBy("component_id").agg(F.min("rep").alias("least"))
    of_class = classes.join(found, F.col("key") == F.col("id"), "left").join(roots, "component_id", "left").select("set_hash", F.coalesce("least", "rep").alias("component"))
    out = sk.join(of_class, "set_hash", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    least = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "n_shingles", least.alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
