"""Toxicity by nearest labelled examples: exact TF-IDF cosine over all their terms."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, free_name, lean, materialize, sample_order
from tidemark.llm.linear import fit_sigmoid, sigmoid

_WORD = re.compile(r"[^\W\d_]+")
#: Signs up to 255, lower-cased, with a space for those that are in no word.
_LATIN = bytes(ord(c) if _WORD.fullmatch(c) else 32 for c in (chr(k).lower() for k in range(256)))
#: Words of more signs are hashed as a whole.
LONG_WORD = 64
#: Words of which a worker keeps the terms, at most.
KEPT_WORDS = 300_000
#: Examples in a block of a posting list.
BLOCK = 128


#: Lengths of the word beginnings that are terms beside whole words, for languages that inflect or compound.
BEGINNINGS = (4, 5, 6, 7)
#: Shares of a text's words at which a beginning gets a further term, and counts at which it does.
SHARES, COUNTS = (0.005, 0.01, 0.02, 0.04), (2, 4)
#: Times the root of its chi-square: the weight of a term associated with label 1, against 1 of any other. Chosen by the log loss of
#: leave-one-out votes among learning rows alone (sf0.1, remainder not 2): 0.1009 without a factor, 0.0477, 0.0497, 0.0486, 0.0449, 0.0422, 0.0410 for 1/4 to 8.
BOOST = 8.0


def words(text: str | None) -> list[str]:
    try:
        return (text or "").encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text.lower())


def step(h: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """The hash of strings that end in ``sign``, from that of what is before it."""
    h = (h ^ sign.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def term_hashes(strings: list[str], heads: tuple[int, ...] = ()) -> np.ndarray:
    """64-bit hashes of the strings, then, a column each, of their beginnings of so many signs with a star; 0 where a string is no longer."""
    size = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    signs = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    order = np.argsort(-size, kind="stable")
    start, falling = (np.cumsum(size) - size)[order], -size[order]
    out = np.zeros((len(strings), 1 + len(heads)), dtype=np.uint64)
    h, star = np.full(len(strings), 0x2545F4914F6CDD1D, dtype=np.uint64), np.full(1, ord("*"))
    for k in range(min(LONG_WORD, int(size.max(initial=0)))):
        n = int(np.searchsorted(falling, -k, "left"))  # strings of more than k signs come first
        if k in heads:
            out[order[:n], 1 + heads.index(k)] = step(h[:n], star)
        h[:n] = step(h[:n], signs[start[:n] + k])
    out[order, 0] = h
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k, 0] = xxhash.xxh3_64_intdigest(strings[k].encode("utf-8", "surrogatepass"))
    return out


def term_counts(found: list[str], n: int) -> dict[str, int]:
    """Terms and their counts: whole words, beginnings of longer words, and marks for beginnings that recur.

    ``found``: the words to look at, of ``n`` that the text has.
    """
    out = Counter(found)
    heads = Counter(w[:k] + "*" for w in found for k in BEGINNINGS if len(w) > k)
    for head, c in heads.items():
        out[head] = c
        for least in COUNTS:
            if c >= least:
                out[f"{head}{least}"] = 1
        if c >= 2:
            for share in SHARES:
                if c >= share * n:
                    out[f"{head}{share}"] = 1
    return out


class Numbered(dict):
    """Numbers words as they are asked for; ``new``: those numbered since that was cleared."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class Vocabulary:
    """The terms of the examples, sorted; ``strong``: those associated with label 1, with what they weigh more than others.

    Words are looked up once and then kept with the terms that they give.
    """

    def __init__(self, terms: pa.Array, strong: dict[str, float] | None = None):
        self.terms, self.strong, self.size = terms, strong or {}, len(terms)

    def __getstate__(self):
        return {"terms": self.terms, "strong": self.strong, "size": self.size}

    def __getattr__(self, name: str):
        if name == "boost":
            self.boost = np.ones(self.size)
            self.boost[pc.index_in(pa.array(list(self.strong), pa.string()), self.terms).to_numpy()] = list(self.strong.values())
            return self.boost
        if name not in ("keys", "places", "marks", "rows", "table"):
            raise AttributeError(name)
        hashes = np.concatenate([np.zeros(0, dtype=np.uint64), *(term_hashes(self.terms[at : at + 16384].to_pylist())[:, 0] for at in range(0, self.size, 16384))])
        self.places = np.argsort(hashes, kind="stable").astype(np.int32)
        self.keys = hashes[self.places]
        #: By head: the terms that mark its recurrence.
        self.marks = np.full((self.size, len(COUNTS) + len(SHARES)), -1, dtype=np.int32)
        ends = pa.array([str(x) for x in (*COUNTS, *SHARES)])
        marked = np.flatnonzero(pc.match_substring_regex(self.terms, r"\*.").to_numpy(zero_copy_only=False))
        for at in range(0, len(marked), 16384):
            part = marked[at : at + 16384]
            heads, _, tails = zip(*(t.partition("*") for t in self.terms.take(pa.array(part)).to_pylist()), strict=True)
            self.marks[self.find(term_hashes([f"{h}*" for h in heads])[:, 0]), pc.index_in(pa.array(tails), ends).to_numpy()] = part
        self.rows, self.table = Numbered(), np.full((1024, 1 + len(BEGINNINGS)), -1, dtype=np.int32)
        return self.__dict__[name]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The places of terms in the vocabulary by their hashes, -1 for those that it doesn't have."""
        asked, inverse = np.unique(hashes, return_inverse=True)  # near ones are looked for one after the other
        at = np.minimum(np.searchsorted(self.keys, asked), self.size - 1)
        return np.where(self.keys[at] == asked, self.places[at], -1).astype(np.int32)[inverse.reshape(hashes.shape)]

    def learn(self, new: list[str]) -> None:
        """Rows for the words that were asked for last and have none yet."""
        first, last = len(self.rows) - len(new), len(self.rows)
        while last > len(self.table):
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        hashes = term_hashes(new, BEGINNINGS)
        found = self.find(hashes)
        found[hashes == 0] = -1
        self.table[first:last] = found

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms and their counts, as ``term_counts`` has them, of terms in the vocabulary."""
        return next(self.counts_of([text]))

    def counts_of(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``counts`` of each of some texts, which are looked up and summed at once."""
        own = [words(t) for t in texts]
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        if not self.size or not sizes.any():
            yield from ((np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)) for _ in own)
            return
        marks, rows = self.marks, self.rows  # made with the first of them
        if len(rows) > KEPT_WORDS:
            rows.clear()
        at = np.fromiter(map(rows.__getitem__, chain.from_iterable(own)), dtype=np.int64, count=int(sizes.sum()))
        if rows.new:
            self.learn(rows.new)
            rows.new.clear()
        # One number for text, word and, after that, for text, term and count: a plain sort brings equal ones together.
        of = np.sort(np.repeat(np.arange(len(own)), sizes) * len(self.table) + at)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        text, row = np.divmod(of[first], len(self.table))
        term, low = self.table[row], int(sizes.max()).bit_length()
        key = ((text[:, None] * self.size + term) << low | np.diff(first, append=len(of))[:, None])[term >= 0]
        key.sort()
        first = np.flatnonzero(np.diff(key >> low, prepend=-1))
        tf = np.add.reduceat(key & ((1 << low) - 1), first) if len(first) else first
        text, term = np.divmod(key[first] >> low, self.size)
        twice = np.flatnonzero(tf >= 2)
        more = marks[term[twice]]
        least = np.concatenate([np.tile(np.array(COUNTS, dtype=np.float64), (len(own), 1)), np.multiply.outer(sizes, np.array(SHARES))], axis=1)
        good = (tf[twice][:, None] >= least[text[twice]]) & (more >= 0)
        more, whose = more[good], np.repeat(text[twice], good.sum(axis=1))
        edges, ends = (np.searchsorted(x, np.arange(len(own) + 1)).tolist() for x in (text, whose))
        term, tf = term.astype(np.int32), tf.astype(np.int32)
        for k in range(len(own)):
            n = ends[k + 1] - ends[k]
            yield np.concatenate([term[edges[k] : edges[k + 1]], more[ends[k] : ends[k + 1]]]), np.concatenate([tf[edges[k] : edges[k + 1]], np.ones(n, dtype=np.int32)])


class BlockMaxIndex:
    """Postings of unit vectors by term, in blocks of BLOCK examples with the largest weight of each; terms x blocks numbers, so for few terms."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        self.n = len(vectors)
        self.blocks = -(-self.n // BLOCK)
        doc = np.concatenate([np.full(len(t), i) for i, (t, _) in enumerate(vectors)]) if vectors else np.zeros(0)
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0)
        weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
        order = np.lexsort((doc, term))
        self.doc, self.weight = doc[order].astype(np.int64), weight[order].astype(np.float64)
        key = term[order].astype(np.int64) * max(1, self.blocks) + self.doc // BLOCK
        self.start = np.searchsorted(key, np.arange(terms * max(1, self.blocks) + 1))
        self.block_max = np.zeros(terms * max(1, self.blocks))
        np.maximum.at(self.block_max, key, self.weight)
        self.block_max = self.block_max.reshape(terms, max(1, self.blocks))

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k examples of highest cosine above 0, ties to the first; blocks are skipped when their bound can't enter."""
        if not self.n or not len(term):
            return []
        bound = weight @ self.block_max[term]
        best: list[tuple[float, int]] = []
        for block in np.argsort(-bound, kind="stable"):
            if bound[block] <= 0 or len(best) == k and bound[block] < best[-1][0] - 1e-9:
                break
            scores = np.zeros(BLOCK)
            for t, w in zip(term, weight, strict=True):
                at = t * self.blocks + block
                s, e = self.start[at], self.start[at + 1]
                scores[self.doc[s:e] - block * BLOCK] += w * self.weight[s:e]
            hits = np.flatnonzero(scores > 0)
            best += [(round(float(scores[h]), 9), int(block * BLOCK + h)) for h in hits if block * BLOCK + h != without]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
        return best


class ExampleIndex:
    """Unit vectors of the examples by term: exact nearest ones for batches of queries, over all terms.

    Terms of FREQUENT of the examples or more are a dense matrix of single precision and the others postings; of every
    example that can be among the k nearest by their sum, the dense part is summed again in double precision, for which a
    second matrix has what the first lost.
    """

    FREQUENT, MOST_DENSE, SLACK = 1 / 16, 2048, 1e-4

    def __init__(self, start: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int):
        """Example i has the terms and weights from start[i] to start[i + 1]."""
        self.n = len(start) - 1
        df = np.bincount(term, minlength=terms)
        often = np.argsort(-df, kind="stable")[: self.MOST_DENSE]
        often = often[df[often] >= max(1, self.FREQUENT * self.n)]
        self.column = np.full(terms, -1, dtype=np.int16)
        self.column[often] = np.arange(len(often))
        self.dense, self.lost = (np.zeros((len(often), self.n), dtype=np.float32) for _ in range(2))
        self.post_start = np.concatenate([[0], np.cumsum(np.where(self.column < 0, df, 0))])
        self.post_doc = np.empty(self.post_start[-1], dtype=np.int16 if self.n <= 1 << 15 else np.int32)
        self.post_weight = np.empty(self.post_start[-1], dtype=np.float64)
        free = self.post_start[:-1].copy()
        for i, (s, e) in enumerate(zip(start[:-1].tolist(), start[1:].tolist(), strict=True)):
            own, w = term[s:e], weight[s:e]
            column = self.column[own]
            dense = column >= 0
            self.dense[column[dense], i] = w[dense]
            self.lost[column[dense], i] = w[dense] - w[dense].astype(np.float32)
            own = own[~dense]  # the terms of one example are distinct
            self.post_doc[free[own]], self.post_weight[free[own]] = i, w[~dense]
            free[own] += 1

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """The k examples of highest cosine above 0 of each query, ties to the first."""
        if not self.n:
            return [[] for _ in queries]
        q = np.zeros((len(queries), len(self.dense)), dtype=np.float32)
        for r, (term, weight) in enumerate(queries):
            column = self.column[term]
            q[r, column[column >= 0]] = weight[column >= 0]
        rough, out = q @ self.dense, []
        for r, (term, weight) in enumerate(queries):
            column = self.column[term]
            some = column < 0
            rare = term[some]
            at, many = places(self.post_start[rare], self.post_start[rare + 1])
            w = self.post_weight.take(at, mode="wrap")  # all are in range; this mode takes half the time
            w *= np.repeat(weight[some], many)
            postings = np.bincount(self.post_doc.take(at, mode="wrap"), weights=w, minlength=self.n)
            scores = rough[r] + postings
            if without is not None:
                scores[without[r]] = 0
            least = np.partition(scores, self.n - k)[self.n - k] if self.n > k else 0
            near = np.flatnonzero(scores >= least - self.SLACK if least > self.SLACK else scores > 0)
            cells = column[~some].astype(np.int64)[:, None] * self.n + near
            exact = postings[near] + weight[~some] @ (self.dense.ravel().take(cells) + self.lost.ravel().take(cells).astype(np.float64))
            out.append(sorted(((round(float(x), 9), int(i)) for x, i in zip(exact, near, strict=True)), key=lambda x: (-x[0], x[1]))[:k])
        return out


def places(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges from ``first`` up to ``last``, one range after the other, and how many each has."""
    many = last - first
    some = np.flatnonzero(many)
    at = np.ones(many.sum(), dtype=np.int64)
    if len(at):
        at[0] = first[some[0]]
        at[np.cumsum(many[some[:-1]])] = first[some[1:]] - last[some[:-1]] + 1
    return np.cumsum(at, out=at), many


class ToxicityModel:
    """Terms, their inverse document frequencies over all documents, and the labelled examples.

    A score is the similarity-weighted share of toxic ones among the k nearest examples, with
    ``prior`` votes at the examples' own rate, through a sigmoid fitted leaving each example out.
    A text that shares no term with an example has no neighbour and gets the rate among examples without a term.
    """

    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, examples: list[tuple[int, int, tuple[np.ndarray, np.ndarray]]], k: int = 25, prior: float = 1.0, calibrated: int = 2000):
        self.vocabulary, self.idf, self.k, self.prior = vocabulary, idf, k, prior
        examples = sorted(examples, key=lambda e: e[0])
        y = np.array([label for _, label, _ in examples], dtype=np.float64)
        self.rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        bare = [label for _, label, (term, _) in examples if not len(term)]
        self.bare = (sum(bare) + self.rate) / (len(bare) + 1)
        some = [e for e in examples if len(e[2][0])]
        self.ids = np.array([e[0] for e in some], dtype=np.int64)
        self.labels = np.array([e[1] for e in some], dtype=np.float64)
        #: Shipped as terms and counts; the index is made from them where it is used.
        self.start = np.cumsum([0, *(len(e[2][0]) for e in some)])
        self.term, self.tf = (np.concatenate([np.zeros(0, dtype=np.int32), *(e[2][j] for e in some)]) for j in range(2))
        size, examples, some = len(some), None, None  # their arrays are not needed any more
        self.a, self.b = 1.0, 0.0
        self.memo: dict = {}
        self.shipped = None
        #: The examples by which the sigmoid is fitted, ``calibrated`` to twice as many.
        self.fitted_on = np.arange(0, size, max(1, size // calibrated))

    def votes_without(self, part: list[int]) -> list[float]:
        """The votes of examples, each without itself."""
        queries = [self.vector(self.term[s:e], self.tf[s:e]) for s, e in zip(self.start[part], self.start[np.add(part, 1)], strict=True)]
        return [self.vote(near) for near in self.index.nearest(queries, self.k, without=part)]

    def broadcast(self, spark: SparkSession):
        """The model without its sigmoid, shipped once; executors keep the index that they make from it."""
        if self.shipped is None:
            self.shipped = spark.sparkContext.broadcast(self)  # bounded by examples and terms
        return self.shipped

    def calibrate(self, spark: SparkSession) -> None:
        """Fits the sigmoid on the votes of examples; the index is made on the executors only."""
        shipped, at = self.broadcast(spark), self.fitted_on

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(0).to_pylist()
                for i in range(0, len(own), BLOCK):
                    part = own[i : i + BLOCK]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(shipped.value.votes_without(part))], names=["id", "vote"])

        if not len(at):
            return
        step = int(at[1] - at[0]) if len(at) > 1 else 1
        t = spark.range(0, int(at[-1]) + 1, step, 6).mapInArrow(run, "id long, vote double").toArrow().sort_by("id")  # a number an example
        raw, y = t["vote"].to_numpy(), self.labels[t["id"].to_numpy()]
        if 0 < y.sum() < len(y):
            self.a, self.b = fit_sigmoid(np.log(raw / (1 - raw)), y)
            if self.a <= 0:  # calibration never turns the order of the votes around
                self.a, self.b = 1.0, 0.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "shipped")}

    def __getattr__(self, name: str):
        if name != "index":
            raise AttributeError(name)
        weight = np.log(self.tf)
        weight += 1
        weight *= (self.idf * self.vocabulary.boost)[self.term]
        for s, e in zip(self.start[:-1].tolist(), self.start[1:].tolist(), strict=True):
            weight[s:e] /= np.sqrt((weight[s:e] ** 2).sum())
        self.index = ExampleIndex(self.start, self.term, weight, self.vocabulary.size)
        return self.index

    def vector(self, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 + np.log(tf)) * self.idf[term] * self.vocabulary.boost[term]
        return term, weight / np.sqrt((weight**2).sum())

    def vote(self, near: list[tuple[float, int]]) -> float:
        sims = np.array([s for s, _ in near])
        marks = self.labels[[i for _, i in near]] if near else np.zeros(0)
        return float(np.clip(((sims * marks).sum() + self.prior * self.rate) / (sims.sum() + self.prior), 1e-6, 1 - 1e-6))

    def scores(self, texts: list[str | None], a: float, b: float) -> list[tuple[float, list[int], list[str]]]:
        keys = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
        if len(self.memo) >= 50_000:
            self.memo.clear()
        new = {k: t for k, t in zip(keys, texts, strict=True) if k not in self.memo}
        found = dict(zip(new, self.vocabulary.counts_of(list(new.values())), strict=True))
        full = [k for k, (term, _) in found.items() if len(term)]
        self.memo.update({k: (float(self.bare), [], []) for k in found})
        for k, near in zip(full, self.index.nearest([self.vector(*found[k]) for k in full], self.k), strict=True):
            raw = self.vote(near)
            value = float(sigmoid(np.array(a * np.log(raw / (1 - raw)) + b)))
            term = found[k][0]
            strong = term[self.vocabulary.boost[term] > 1]
            self.memo[k] = value, [int(self.ids[i]) for _, i in near[:5]], sorted(self.vocabulary.terms[int(t)].as_py() for t in strong)
        return [self.memo[k] for k in keys]


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", examples: int = 8_000, terms: int = 1024, least_chi2: float = 30.0) -> ToxicityModel:
    """Fits on a bounded sample: the ``examples`` labelled ids first in a fixed hash order.

    The vocabulary is every term (see ``term_counts``) of the examples; each term's document
    frequency is counted over all documents. The at most ``terms`` terms most associated with label 1 among
    the examples (chi-square at ``least_chi2`` or more, in 5 examples and 0.1 % of them at least) weigh
    more, by BOOST times the root of chi-square. Null labels, ids and texts are left out; an
    id labelled more than once counts once, with its largest label.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(learn & F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(label_col) > 0).cast("int").alias("_y"))
    sample = known.orderBy(sample_order(), "doc_id").limit(examples).select(F.col("doc_id").alias("_id"), "_y")
    # One text of each id: the last in order.
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "_y").agg(F.max("text").alias("text"))
    labelled = materialize(labelled, "toxic-examples")

    @lean
    def example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, up, rows, toxic = Counter(), Counter(), 0, 0
        for batch in batches:
            for y, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = words(text.as_py())
                own = list(term_counts(own, len(own)))
                n.update(own)
                rows += 1
                if y:
                    toxic += 1
                    up.update(own)
        n[""], up[""] = rows, toxic
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([up[t] for t in n], pa.int64())], names=["term", "n", "up"])

    counts = labelled.mapInArrow(example_terms, "term string, n long, up long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("up").alias("up"))
    counts = materialize(counts, "toxic-terms")
    rows = counts.where("term = ''").head()
    total, toxic = (rows["n"], rows["up"]) if rows else (0, 0)
    expected = F.col("n") * F.lit(toxic / max(1, total))
    chi2 = F.pow(F.col("up") - expected, 2) / (expected * (1 - F.col("n") / F.lit(max(1, total)) + F.lit(1e-9)) * F.lit(max(1e-9, 1 - toxic / max(1, total))))
    chosen = counts.where((F.col("term") != "") & (F.col("n") >= max(5, total // 1000)) & (F.col("up") > expected)).withColumn("chi2", chi2).where(F.col("chi2") >= least_chi2)
    strong = {r["term"]: max(1.0, BOOST * r["chi2"] ** 0.5) for r in chosen.orderBy(F.desc("chi2"), "term").limit(terms).collect()}
    every = counts.where("term != ''").select("term").toArrow()["term"].combine_chunks()
    vocabulary = Vocabulary(every.take(pc.sort_indices(every)), strong)  # bounded by the texts of the examples
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @lean
    def document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = np.zeros(shipped.value.size, dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for at in range(0, batch.num_rows, BLOCK):
                for term, _ in shipped.value.counts_of(batch.column(0).slice(at, BLOCK).to_pylist()):
                    n[term] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int32()), pa.array([rows, *n[some]], pa.int64())], names=["term", "n"])

    df = docs.select("text").mapInArrow(document_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(1 + vocabulary.size)
    n[df["term"].to_numpy() + 1] = df["n"].to_numpy()
    idf = np.log((1 + n[0]) / (1 + n[1:])) + 1

    @lean
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [c for at in range(0, batch.num_rows, BLOCK) for c in shipped.value.counts_of(batch.column(2).slice(at, BLOCK).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c[0] for c in found], pa.list_(pa.int32())), pa.array([c[1] for c in found], pa.list_(pa.int32()))], names=["doc_id", "y", "term", "tf"]
            )

    kept = {}
    for batch in labelled.mapInArrow(vectors, "doc_id long, y int, term array<int>, tf array<int>").toArrow().to_batches():
        for i, y, term, tf in zip(*batch.columns, strict=True):
            new = y.as_py(), (term.values.to_numpy(), tf.values.to_numpy())
            if i.as_py() in kept:
                new = max(kept[i.as_py()], new, key=lambda x: sorted(zip(*(c.tolist() for c in x[1]), strict=True)))
            kept[i.as_py()] = new
    found = [(i, y, c) for i, (y, c) in kept.items()]
    kept.clear()
    model = ToxicityModel(vocabulary, idf, found)
    found.clear()
    model.calibrate(docs.sparkSession)
    return model


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1), evidence (ids of the nearest examples) and terms to the columns ``keep`` (default: all).

    Only the whole text decides. ``terms`` are those associated with label 1. Null and empty texts, and texts that
    share no term with an example, get the rate of label 1 among examples without a term and no evidence.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "evidence", "terms")]
    shipped, a, b = model.broadcast(docs.sparkSession), model.a, model.b
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(free_name(docs, "_whole_text")))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("score", "double").add("evidence", T.ArrayType(T.LongType())).add("terms", T.ArrayType(T.StringType()))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            out = [x for i in range(0, len(texts), BLOCK) for x in model.scores(texts[i : i + BLOCK].to_pylist(), a, b)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.string()))],
                names=[*keep, "score", "evidence", "terms"],
            )

    return source.mapInArrow(run, schema)
