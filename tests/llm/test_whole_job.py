"""Cases that were once left out of the operators' work."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.test_operators import docs
from tidemark.llm import alignment, line_dedup, linear, queries, toxicity


def test_toxicity_searches_every_term(spark):
    """Nearest examples over all terms by brute force, though none is associated with label 1."""
    rng = random.Random(11)
    pool = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 10))) for _ in range(300)]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(5, 60))) for _ in range(400)]
    texts += [texts[i] + " zz" for i in range(0, 400, 10)] + ["", "un kn"]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(d, labels, F.lit(True))
    assert not model.vocabulary.strong
    terms = [toxicity.term_counts(w, len(w)) for w in map(toxicity.words, texts)]
    df = Counter(t for c in terms for t in c)
    known = {t for c in terms[:400] for t in c}
    at = {t: k for k, t in enumerate(sorted(known))}
    dense = np.zeros((len(texts), len(at)))
    for i, c in enumerate(terms):
        for t, n in c.items():
            if t in at:
                dense[i, at[t]] = (1 + np.log(n)) * (np.log((1 + len(texts)) / (1 + df[t])) + 1)
    dense /= np.maximum(1e-300, np.sqrt((dense**2).sum(axis=1)))[:, None]
    got = {r["doc_id"]: r["evidence"] for r in toxicity.score(d, model).collect()}
    for i in range(len(texts)):
        want = sorted((-round(float(s), 9), j) for j, s in enumerate(dense[:400] @ dense[i]) if s > 0)[:5]
        assert got[i] == [j for _, j in want]
    assert all(got[400 + k][0] == 10 * k for k in range(40)) and got[440] == got[441] == []


def test_short_lines_are_compared(spark, tmp_path):
    """Lines of one to six words by brute force, in the query and in the pipeline's stage."""
    import corpus_pipeline as P

    rng = random.Random(12)
    texts = ["\n".join(" ".join(rng.choices("abcdefg", k=rng.randrange(7))) for _ in range(4)) for _ in range(40)] + ["a b c d", "a b c d e", "\u4f60\u597d", "\u4f60\u597d", "Les.", "les.", " \n"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    sets = [((i, k), set(x.lower().split())) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n"))]
    sets = [(p, s) for p, s in sets if s]
    want = {p for j, (p, s) in enumerate(sets) if any(5 * len(s & o) >= 4 * len(s | o) for _, o in sets[:j])}
    assert {(43, 0), (45, 0)} <= want
    assert {(r["doc_id"], r["line_no"]) for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()} == want
    out = {r["doc_id"]: r["text"] for r in P.drop_repeated_lines(spark, docs(spark, texts), "").collect()}
    kept = {i: [x for k, x in enumerate(t.split("\n")) if (i, k) not in want] for i, t in enumerate(texts)}
    assert out == {i: "\n".join(x) for i, x in kept.items() if x}


def test_alignment_holds_little_at_once():
    """What a chunk's row needs while it is made stays far under what its links would take all at once, and so do the words kept."""
    rng = random.Random(13)
    pool = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 12))) for _ in range(60_000)]
    texts = [" ".join(rng.choices(pool, k=300)) for _ in range(800)]
    aligner = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    chunk = alignment._Chunk()
    list(aligner.align(texts[:1]))  # tables that are made once
    tracemalloc.start()
    try:
        found = [x for at in range(0, 800, 100) for x in aligner.align(texts[at : at + 100])]
        units = sum(len(u) for u, _ in found)
        for i, (own, known) in enumerate(found):
            chunk.add(i, texts[i], own, known, False)
        del found, known
        held, words = tracemalloc.get_traced_memory()[0], len(aligner.young)
        tracemalloc.reset_peak()
        row = chunk.batch(0)
        peak = tracemalloc.get_traced_memory()[1] - held
    finally:
        tracemalloc.stop()
    links = len(row.column("at")[0])
    assert units == 240_000 and words > 50_000 and links > 300_000
    assert peak < 150 * links, (peak, links)
    assert held < 500 * words, (held, words)


def test_toxicity_terms_of_many_texts_at_once():
    """Terms and counts of a batch are those of each text, for words of any signs and length, within and beyond Latin-1."""
    rng = random.Random(14)
    texts = [" ".join("".join(rng.choices("abcÜü²ªXY9_'" + "漢İΣ" * (j % 3 == 0), k=rng.randrange(1, rng.choice([12, 90])))) for _ in range(rng.randrange(60))) for j in range(120)]
    texts += [None, "", "abcd abcd abcdefghi " * 5, "".join(map(chr, range(256)))]
    assert all(toxicity.words(t) == re.findall(r"[^\W\d_]+", (t or "").lower()) for t in texts)
    want = [toxicity.term_counts(w, len(w)) for w in map(toxicity.words, texts)]
    terms = sorted({t for c in want[:100] for t in c})
    vocabulary, known = toxicity.Vocabulary(pa.array(terms), {}), set(terms)
    for counts, (term, tf) in zip(want, vocabulary.counts_of(texts), strict=True):
        assert sorted((terms[t], int(n)) for t, n in zip(term, tf, strict=True)) == sorted((t, n) for t, n in counts.items() if t in known)


def test_toxicity_marks_are_found_many_at_once():
    """The terms that mark a beginning's recurrence, 25000 of them, are looked up in a few steps; each is the one of its own beginning."""
    rng = random.Random(16)
    heads = sorted({"".join(rng.choices("abcdefghijkl\u00fc", k=rng.choice(toxicity.BEGINNINGS))) for _ in range(6000)})
    ends = [str(x) for x in (*toxicity.COUNTS, *toxicity.SHARES)]
    terms = sorted({f"{h}*{e}" for h in heads for e in ("", *ends) if not e or rng.random() < 0.75})
    steps, find = [], toxicity.Vocabulary.find
    vocabulary = toxicity.Vocabulary(pa.array(terms))
    vocabulary.find = lambda hashes: steps.append(len(hashes)) or find(vocabulary, hashes)
    marks, at = vocabulary.marks, {t: k for k, t in enumerate(terms)}
    assert len(steps) < 10 and sum(steps) == len(terms) - len(heads) > 24_000
    assert all(marks[at[f"{h}*"]].tolist() == [at.get(f"{h}*{e}", -1) for e in ends] for h in heads)


def test_toxicity_nearest_are_exact_in_both_parts():
    """Cosines by brute force, of frequent and of rare terms, with near ties that single precision can't tell; a query without rare or frequent terms too."""
    rng, n, terms = np.random.default_rng(17), 700, 900
    rows = [np.sort(rng.choice(terms, size=int(rng.integers(3, 60)), replace=False, p=(w := 1 / np.arange(5, 5 + terms)) / w.sum())) for _ in range(n)]
    weights = [(v := rng.random(len(t)) + 0.1) / np.sqrt(v @ v) for t in rows]
    for i in range(0, n - 1, 7):  # nearly the same example again
        rows[i + 1], weights[i + 1] = rows[i], (v := weights[i] * (1 + 1e-8 * rng.random(len(weights[i])))) / np.sqrt(v @ v)
    index = toxicity.ExampleIndex(np.cumsum([0, *map(len, rows)]), np.concatenate(rows).astype(np.int32), np.concatenate(weights), terms)
    assert 0 < len(index.dense) < terms
    whole = np.zeros((n, terms))
    for i, (t, w) in enumerate(zip(rows, weights, strict=True)):
        whole[i, t] = w
    often = np.flatnonzero(index.column >= 0).astype(np.int32)
    queries = [*zip(rows[:200], weights[:200], strict=True), (often[:5], np.full(5, 5**-0.5)), (np.array([terms - 1, terms - 2], dtype=np.int32), np.full(2, 0.5**0.5))]
    for (t, w), got in zip(queries, index.nearest(queries, 9), strict=True):
        scores = whole[:, t] @ w
        want = sorted(((round(float(x), 9), i) for i, x in enumerate(scores) if x > 0), key=lambda x: (-x[0], x[1]))[:9]
        assert len(got) == len(want) and np.allclose([x for x, _ in got], [x for x, _ in want], atol=2e-9)
        assert all(abs(scores[i] - x) < 2e-9 for x, i in got)


def test_scores_of_many_texts_hold_little_at_once():
    """Texts are scored in groups whose numbers, one a byte and model, take a few megabytes; the scores are those of single texts."""
    rng = np.random.default_rng(15)
    weights = rng.normal(size=(4096, 16)).astype(np.float32)
    texts = [rng.integers(97, 123, size=int(n), dtype=np.uint8).tobytes() for n in rng.integers(1, 4000, size=300)]
    tracemalloc.start()
    try:
        got = linear.batch_scores(texts, (1, 2, 3), weights)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 24 << 20, peak
    assert np.allclose(got, [linear.ngram_frequencies(t, (1, 2, 3), 4096) @ weights.astype(np.float64) for t in texts], atol=1e-6)


def test_pipeline_sends_texts_in_small_batches(spark):
    """After any stage 12 MB of long texts come to a worker in batches of about 4 MB, and every row comes; a session's own limit stays."""
    import corpus_pipeline as P

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    key, d = "spark.sql.execution.arrow.maxBytesPerBatch", docs(spark, ["abcd " * 800] * 3000).coalesce(1)
    for name, stage in P.STAGES[:1] + P.STAGES[-1:]:
        spark.conf.unset(key)
        stage(spark, d.limit(20), "")
        got = d.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in got) == 3000 and max(r["size"] for r in got) < 5 << 20, name
    try:
        spark.conf.set(key, "1m")
        P.STAGES[0][1](spark, d.limit(20), "")
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
