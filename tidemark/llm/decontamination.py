"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean

MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit codes, so that every bit can serve as a SimHash vote."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingle_codes(word_codes: np.ndarray, size: int) -> np.ndarray:
    """Codes of all runs of ``size`` words, by the position of their first word."""
    n = len(word_codes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    code = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        code = (code + word_codes[k : k + n]) * MIX
    return mixed(code)


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def among(codes: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which codes are in the ascending array ``ordered``, which has one at least."""
    return ordered[np.minimum(np.searchsorted(ordered, codes), len(ordered) - 1)] == codes


def votes(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The 64 weighted votes (+ for a set bit, - for a clear one) of each shingle."""
    bits = np.unpackbits(codes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return (bits.astype(np.int64) * 2 - 1) * weights[:, None]


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class BenchmarkIndex:
    """Items by their number of words, with SimHash fingerprints cut into ``radius`` + 1 blocks.

    Two fingerprints within ``radius`` bits agree on a block at least, so looking up each block
    finds all of them.
    """

    def __init__(self, items: list[tuple[int | None, str]], shingle: int, radius: int, least: float):
        self.shingle, self.radius, self.least = shingle, radius, least
        #: Items go by their place here: an id may have several texts, and texts may have no id.
        self.item_ids = [i for i, _ in items]
        words = {k: split_words(t) for k, (_, t) in enumerate(items)}
        words = {i: w for i, w in words.items() if w}
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for own in words.values() for w in own}))}
        self.code_of = np.array([0] + [xxhash.xxh64_intdigest(w) for w in self.vocabulary], dtype=np.uint64)
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.masks = [np.uint64(((1 << int(b - a)) - 1) << int(a)) for a, b in zip(edges, edges[1:], strict=False)]
        codes = {i: shingle_codes(self.code_of[[self.vocabulary[w] for w in own]], min(shingle, len(own))) for i, own in words.items()}
        in_items = Counter(int(c) for own in codes.values() for c in set(own.tolist()))
        self.known = np.array(sorted(in_items), dtype=np.uint64)
        #: A shingle that few items have says more: 4 for one item, less by half a bit for each doubling.
        self.known_weight = np.array([max(1, round(4 - 0.5 * np.log2(in_items[int(c)]))) for c in self.known.tolist()], dtype=np.int64)
        self.groups: dict[int, dict] = {}
        for i in sorted(codes):
            self.groups.setdefault(len(words[i]), []).append(i)
        for n, ids in self.groups.items():
            prints = np.concatenate([fingerprints(votes(codes[i], self.weights(codes[i])).sum(axis=0, keepdims=True)) for i in ids])
            blocks = [{} for _ in self.masks]
            for k, p in enumerate(prints):
                for b, mask in enumerate(self.masks):
                    blocks[b].setdefault(int(p & mask), []).append(k)
            self.groups[n] = {"ids": ids, "prints": prints, "blocks": blocks, "bags": [Counter(codes[i].tolist()) for i in ids], "known": np.unique(np.concatenate([codes[i] for i in ids]))}

    def weights(self, codes: np.ndarray) -> np.ndarray:
        """Of known shingles their own weight, of others that of a single item."""
        out = np.full(len(codes), 4, dtype=np.int64)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
            out[self.known[at] == codes] = self.known_weight[at[self.known[at] == codes]]
        return out

    def similarity(self, a: Counter, b: Counter) -> float:
        """Weighted Dice over bags of shingles: twice the shared weight by the sum of both."""
        keys = np.array(list(a.keys() | b.keys()), dtype=np.uint64)
        w = self.weights(keys).tolist()
        both = sum(x * min(a[k], b[k]) for x, k in zip(w, keys.tolist(), strict=True))
        each = sum(x * (a[k] + b[k]) for x, k in zip(w, keys.tolist(), strict=True))
        return 2 * both / each if each else 0.0

    def search(self, text: str | None) -> list[tuple[int | None, int, int, float]]:
        """(item, first word, words, similarity): for each item its best window, the first one of equals.

        A text with fewer words than an item is one window. Of an id with several texts the best one counts; texts
        without an id count each. Only windows with enough weight of shingles that items of their size have are fingerprinted;
        any other window is less than ``least`` similar to every item.
        """
        own = split_words(text)
        if not own or not self.groups:
            return []
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in own), dtype=np.int64, count=len(own))
        found: dict[int, tuple[float, int, int]] = {}
        hits_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, group in self.groups.items():
            size = min(self.shingle, n)
            n = min(n, len(own))  # a shorter text is one window
            if n < size:
                continue
            if size not in hits_of:
                inside = np.concatenate([[0], np.cumsum(ids > 0)])
                at = np.flatnonzero(inside[size:] - inside[:-size] == size)  # runs of known words
                code = np.zeros(len(at), dtype=np.uint64)
                for k in range(size):
                    code = (code + self.code_of[ids[at + k]]) * MIX
                code = mixed(code)
                real = among(code, self.known)
                hits_of[size] = at[real], code[real]
            at, code = hits_of[size]
            own_hits = among(code, group["known"]) if len(at) else np.zeros(0, dtype=bool)
            if not own_hits.any():
                continue
            m = n - size + 1
            sums = np.zeros((2, len(own) - size + 2))
            sums[0, at[own_hits] + 1], sums[1, at[own_hits] + 1] = self.weights(code[own_hits]), 1
            sums = np.cumsum(sums, axis=1)
            shared, count = sums[:, m:] - sums[:, :-m]
            # Shared weight is at most that of shingles of such items and any other weighs 1 at least, so Dice >= least needs that much.
            starts = np.flatnonzero(shared * (2 - self.least) + 1e-6 >= self.least * (shared + m - count))
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1):
                for at in range(0, len(part), 4096):
                    self._windows(own, part[at : at + 4096], n, size, group, found)
        best: dict[tuple[int | None, int], tuple[float, int, int]] = {}
        for k, window in found.items():
            item = self.item_ids[k]
            slot = item, k if item is None else -1
            best[slot] = max(best.get(slot, (0.0, 0, 0)), window)
        return [(item, start, n, s) for (item, _), (s, start, n) in sorted(best.items(), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1]))]

    def _windows(self, own: list[bytes], starts: np.ndarray, n: int, size: int, group: dict, found: dict) -> None:
        if not len(starts):
            return
        first, last = int(starts[0]), int(starts[-1]) + n
        codes = shingle_codes(np.array([xxhash.xxh64_intdigest(w) for w in own[first:last]], dtype=np.uint64), size)
        sums = np.vstack([np.zeros((1, 64), dtype=np.int64), np.cumsum(votes(codes, self.weights(codes)), axis=0)])
        at = starts - first
        prints = fingerprints(sums[at + n - size + 1] - sums[at])
        for s, p in zip(at.tolist(), prints, strict=True):
            near = {k for mask, block in zip(self.masks, group["blocks"], strict=True) for k in block.get(int(p & mask), ())}
            near = [k for k in near if popcount(p ^ group["prints"][k]) <= self.radius]
            if not near:
                continue
            bag = Counter(codes[s : s + n - size + 1].tolist())
            for k in near:
                if not bag.keys() & group["bags"][k].keys():
                    continue
                similar = self.similarity(bag, group["bags"][k])
                if similar >= self.least:
                    item = group["ids"][k]
                    found[item] = max(found.get(item, (0.0, 0, 0)), (similar, -(first + s), n))


def build(benchmark: DataFrame, shingle: int = 5, radius: int = 26, least: float = 0.8, most_bytes: int = 64 << 20) -> BenchmarkIndex:
    """Collects the benchmark, after a check that its texts take at most ``most_bytes``; items are its distinct (id, text)."""
    rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    if size > most_bytes:
        raise ValueError(f"the benchmark has {size} bytes of text, over most_bytes; split it and search for each part")
    items = sorted({(r["item_id"], r["text"]) for r in rows.collect()}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    return BenchmarkIndex(items, shingle, radius, least)


def leaks(docs: DataFrame, benchmark: DataFrame, index: BenchmarkIndex | None = None, **settings) -> DataFrame:
    """Documents that hold a benchmark item: (doc_id, item_id, start_word, words, similarity), a row per pair.

    A window of as many words as the item has must reach ``least`` in weighted Dice similarity of
    ``shingle``-word shingles (an item with fewer words is one shingle); a document with fewer words than
    the item is one window itself. Whole texts are searched; null and empty ones hold nothing, nor do
    items without words. Repeated documents are reported once each, an id with several texts by the most
    similar one, items without an id with a null one, a row a text; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(index or build(benchmark, **settings))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for batch in batches:
            rows = [(doc, item, -start, n, round(s, 9)) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for item, start, n, s in index.search(text.as_py())]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "start_word", "words", "similarity"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, start_word long, words long, similarity double")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents, with all their columns, whose text holds no benchmark item."""
    shipped = docs.sparkSession.sparkContext.broadcast(build(benchmark, **settings))
    at = docs.columns.index("text")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [not shipped.value.search(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
