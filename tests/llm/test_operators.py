"""The training-data operators on small fixtures: against brute force, and on nulls, empty and long texts, ties, repeats, no rows, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination, language_id, line_dedup, minhash, packing, quality, secrets, sharding, topk_search, toxicity
from tidemark.llm.common import components, crc_fold
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.tokenization import WordTokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, rep long, n long, label long"


def docs(spark, texts, langs=None, start=0):
    """A documents table whose further columns clash with names that operators use."""
    rows = [(start + i, x, (langs or ["en"] * len(texts))[i], "s", len(x or ""), 0.5, 1, 2, 3, 4) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


# 1 -------------------------------------------------------------------------------------------------
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
TEXTS = [
    None, "", "plain words only", 'é😀 password = "abc123" Token:xyz API_KEY="qwertyuiop" secret:aaaaaaa', "AKIA" + "B" * 16 + " AKIA12 " + "deadbeef" * 3 + " deadbeef",
    "key ghp_a8Zk29fQmPq0LrT7vXw3 and some_long_identifier_name_2 in /usr/local/lib/python3/site-packages", "token=" + "x1" * 3 + "token=" + "y2" * 3, "passwordpassword: secret=abcdef", "a" * 200_000 + " token: 'zzzzzz'",
]


def base_spans(t):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_secrets(spark, sf):
    d = docs(spark, TEXTS)
    models = secrets.train(secrets.labelled_samples(spark.read.parquet(f"{sf}/documents.parquet")))
    out = secrets.scan(d, models)
    got = {r["doc_id"]: r for r in out.select("doc_id", secrets.spelled(F.col("base")).alias("b"), F.transform("markov", lambda m: m["s"]).alias("m"), "lang").collect()}
    assert [got[i]["b"] for i in range(len(TEXTS))] == [base_spans(x or "") for x in TEXTS]
    assert got[5]["m"] == ["ghp_a8Zk29fQmPq0LrT7vXw3"] and not any(got[i]["m"] for i in got if i != 5)
    assert secrets.scan(d.limit(0), models).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


# 2 -------------------------------------------------------------------------------------------------
def brute_components(texts, k):
    sets = []
    for x in texts:
        w = [y.lower() for y in re.findall(r"[^\x20\x09-\x0D]+", x or "")]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("k", [4, 5])
def test_minhash_against_brute_force(spark, k):
    rng = random.Random(k)
    base = [words(rng, rng.choice([2, 6, 30, 120])) for _ in range(12)]
    texts = [None, "", "one two", "ONE  two", " \t\n"]
    for b in base:
        for _ in range(7):
            w = b.split()
            for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(w) if rng.random() < 0.7 else "shared passage of quite a few common words here " + " ".join(w))
    rng.shuffle(texts)
    want, sizes = brute_components(texts, k)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, texts), words=k).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_minhash_edges(spark):
    assert minhash.near_duplicates(docs(spark, ["a"]).limit(0)).count() == 0
    twice = docs(spark, ["a b c d e", "x"]).unionByName(docs(spark, ["a b c d e"])).unionByName(docs(spark, ["a b c d e"]).withColumn("doc_id", F.lit(None).cast("long")))
    out = minhash.near_duplicates(twice).collect()
    assert sorted((r["doc_id"] is None, r["component_id"], r["kept"]) for r in out if r["doc_id"] != 1) == [(False, 0, True), (False, 0, True), (True, None, False)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    touched = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in touched}


# 3 -------------------------------------------------------------------------------------------------
def test_leaks(spark):
    rng = random.Random(4)
    items = [words(rng, n, 5000) for n in (8, 20, 20, 45)] + ["two words", None, " "]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    edited = items[3].split()
    edited[20] = "changed"
    texts = [words(rng, 300, 5000), words(rng, 50) + " " + items[1].upper() + " " + words(rng, 50), " ".join(edited), items[3][: len(items[3]) // 2], None, "", "Two  words", items[0] + "\n" + items[2], "x " * 60_000 + items[1]]
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.leaks(docs(spark, texts), bench).collect()}
    assert set(got) == {(1, 1), (2, 3), (6, 4), (7, 0), (7, 2), (8, 1)}
    assert got[1, 1]["similarity"] == 1.0 and got[1, 1]["start_word"] == 50 and got[2, 3]["similarity"] >= 0.8
    clean = decontamination.decontaminated(docs(spark, texts), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [0, 3, 4, 5] and clean.columns == docs(spark, ["x"]).columns
    assert decontamination.leaks(docs(spark, ["x"]).limit(0), bench).count() == 0
    assert decontamination.leaks(docs(spark, texts), bench.limit(0)).count() == 0


def test_hamming_blocks_find_all_within_radius():
    rng = np.random.default_rng(1)
    index = decontamination.BenchmarkIndex([(0, "a b c d e f")], 5, 26, 0.8)
    for _ in range(200):
        p = int(rng.integers(0, 2**63))
        flips = rng.choice(64, size=26, replace=False)
        q = p
        for f in flips:
            q ^= 1 << int(f)
        assert any(p & int(m) == q & int(m) for m in index.masks)


# 4 -------------------------------------------------------------------------------------------------
def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [rng.normal(size=6).round(2).tolist() if i % 3 else [0.5] * 6 for i in range(120)]
    vectors[7], vectors[9], vectors[11], vectors[50] = None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [0.0] * 5, [float("inf")] * 6
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in topk_search.top_k(df, F.col("vec_id") % 10 == 0, k=5, queries_per_block=3, rows_per_block=7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all()}
    want = {}
    for q in ints:
        if q % 10 == 0:
            order = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:5]
            want[q] = [(i, -s, k + 1) for k, (s, i) in enumerate(order)]
    assert dict(got) == want
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert topk_search.top_k(df.where("vec_id in (0, 1)"), F.col("vec_id") % 10 == 0).count() == 1


# 5 -------------------------------------------------------------------------------------------------
def test_shards(spark):
    rng = random.Random(6)
    texts = [("é" if i % 5 == 0 else "x") * rng.choice([1, 10, 200, 900]) + str(i % 90) for i in range(2000)] + ["copy"] * 1000 + [None, ""]
    out = sharding.kd_shards(docs(spark, texts), shards=7).toPandas()
    assert len(out) == len(texts)
    size = {i: len((x or "").encode()) + 16 for i, x in enumerate(texts)}
    assert all(size[r.doc_id] == r.size and zlib.crc32((texts[r.doc_id] or "").encode()) == r.text_crc32 for r in out.itertuples())
    by = out.groupby("shard")["size"].sum()
    assert len(by) == 7 and by.max() - by.min() <= 4 * max(size.values())
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert sharding.kd_shards(docs(spark, ["a"]).limit(0), shards=3).count() == 0
    assert sharding.kd_shards(docs(spark, texts[:50]), target_bytes=sum(list(size.values())[:50]) // 3).select("shard").distinct().count() >= 3
    one = sharding.kd_shards(docs(spark, ["a"] * 3).withColumn("doc_id", F.lit(5).cast("long")), shards=2).toPandas()
    assert len(one) == 3


# 6 -------------------------------------------------------------------------------------------------
def test_lines_against_brute_force(spark):
    rng = random.Random(7)
    pool = [words(rng, rng.choice([3, 5, 9, 14, 30, 60]), 120) for _ in range(30)]
    texts = [None, "", "\n\n"]
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(pool).split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"q{rng.randrange(10**5)}"
            lines.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
        texts.append("\n".join(lines))
    d = docs(spark, texts)
    got = {(r["doc_id"], r["line_no"]): (r["match_doc_id"], r["match_line_no"]) for r in line_dedup.repeated_lines(d).collect()}
    sets = [((i, k), set(x.lower().split())) for i, t in enumerate(texts) if t is not None for k, x in enumerate(t.split("\n"))]
    sets = [(p, s) for p, s in sets if s]
    want = {p for j, (p, s) in enumerate(sets) if any(5 * len(s & o) >= 4 * len(s | o) for _, o in sets[:j])}
    assert set(got) == want
    at = dict(sets)
    assert all(m < p and 5 * len(at[p] & at[m]) >= 4 * len(at[p] | at[m]) for p, m in got.items())
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(d).collect()}
    for i, t in enumerate(texts):
        kept = None if t is None else [x for k, x in enumerate(t.split("\n")) if (i, k) not in want]
        assert out.get(i, "gone") == (None if t is None else "\n".join(kept) if kept else "gone")
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


def test_prefix_has_a_common_pair():
    """In the worst case for all sizes: own tokens first, and spread to part all common ones."""
    cut = lambda n: min(n, 2 * n // 5 + 2)
    for c in range(1, 200):
        for d in range(c // 4 + 1):
            for e in range(c // 4 + 1):
                if 5 * c >= 4 * (c + d + e) and c + d >= 5 and c + e >= 5:
                    assert min(cut(c + d) - d, cut(c + e) - e, c) - 1 > d + e


# 7, 8, 9 -------------------------------------------------------------------------------------------
def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(d, crc_fold("doc_id", 5) != 0, rows_per_language=60)
    out = language_id.identify(d, model).where(crc_fold("doc_id", 5) == 0).select("lang", "lang_pred", "score").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()
    odd = language_id.identify(docs(spark, [None, "", "123 !?", "the and of", "the and of"]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in odd[:3]] == ["und"] * 3 and odd[3]["lang_pred"] == odd[4]["lang_pred"] and odd[3]["score"] == odd[4]["score"]
    none = language_id.train(d.limit(0), F.lit(True))
    assert [r["lang_pred"] for r in language_id.identify(docs(spark, ["the"]), none).collect()] == ["und"]
    alone, batch = model.predict(["Das ist der"])[1][0], model.predict(["x", "Das ist der", "y" * 3000])[1][1]
    assert alone == pytest.approx(batch, abs=1e-9)


def test_quality(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    model = quality.train(d, labels, crc_fold("doc_id", 3) != 1, rows_per_class=200)
    out = quality.score(d, model, keep=["doc_id"]).where(crc_fold("doc_id", 3) == 1).join(labels, "doc_id").toPandas()
    assert ((out.score >= 0.5) == (out.quality == 1)).mean() > 0.97
    odd = quality.score(docs(spark, [None, "", "a" * 3_000_000]), model).toPandas()
    assert odd.score.between(0, 1).all() and odd.columns.tolist().count("score") == 1
    assert quality.score(docs(spark, ["a"]), quality.train(d.limit(0), labels.limit(0), F.lit(True))).count() == 1


def test_toxicity(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.train(d, labels, crc_fold("doc_id", 4) != 2)
    out = toxicity.score(d, model, keep=["doc_id"]).where(crc_fold("doc_id", 4) == 2).join(labels, "doc_id").toPandas()
    hit = out.score >= 0.3
    assert hit[out.toxic == 1].mean() > 0.9 and hit[out.toxic == 0].mean() < 0.02
    odd = toxicity.score(docs(spark, [None, "", "!"]), model).toPandas()
    assert odd.score.nunique() == 1 and odd.evidence.map(len).sum() == 0
    assert toxicity.score(docs(spark, ["a"]), toxicity.train(d.limit(0), labels.limit(0), F.lit(True))).count() == 1


def test_block_max_is_exact():
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(40, size=rng.integers(1, 6), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt((w**2).sum())))
    index = toxicity.BlockMaxIndex(vectors, 40)
    dense = np.zeros((700, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for q in range(30):
        want = sorted(((-round(float(s), 9), i) for i, s in enumerate(dense @ dense[q]) if s > 0 and i != q))[:9]
        assert index.nearest(*vectors[q], 9, without=q) == [(-s, i) for s, i in want]


# 10 ------------------------------------------------------------------------------------------------
def test_tokens_are_the_tokenizers(sf):
    import pyarrow.parquet as pq

    own = WordTokenizer(tokenizer_path(), cached_words=50, cached_pieces=50)
    texts = pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()[:60]
    texts += ["", "İstanbul ΣΑΣ don't I'LL 3rd <|endoftext|>x ﬁ é a b \x1c z\x85q ſK 你好", "é́ ½²", "a'Sb", "x\x0by　z"]
    for text, e in zip(texts, own.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode_bytes(text) == np.array(e.ids, dtype="<u4").tobytes()


def test_packing(spark):
    rng = random.Random(8)
    texts = [words(rng, rng.choice([0, 1, 5, 20, 70, 300])) for _ in range(150)] + [None, "", "a a a"] + ["copy of it"] * 40
    out = packing.best_fit_pack(docs(spark, texts), tokenizer_path(), size=64, with_ids=True).toPandas()
    own = WordTokenizer(tokenizer_path())
    for doc, g in out.sort_values("piece").groupby("doc_id"):
        ids = [*np.frombuffer(own.encode_bytes(texts[doc] or ""), dtype="<u4").tolist(), 1]
        assert [x for p in g.ids for x in p] == ids and g.start.tolist() == list(range(0, len(ids), 64)) and all(n == 64 for n in g.length[:-1])
        assert all(zlib.crc32(np.array(p, dtype="<u4").tobytes()) == c for p, c in zip(g.ids, g.ids_crc32, strict=True))
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= 64
    least = -(-out.length.sum() // 64)
    assert out.sequence_id.nunique() <= 1.02 * least + 1
    assert packing.best_fit_pack(docs(spark, ["a"]).limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_each_rank_once(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 65): rng.randrange(1, 300) for _ in range(30)}
    seen, space = defaultdict(set), defaultdict(list)
    for n, first, ranks, sequence, m, offset in packing.plan(counts, 64):
        for r in range(first, first + ranks):
            assert r not in seen[n]
            seen[n].add(r)
            space[sequence + (r - first) // m].append((offset + (r - first) % m * n, n))
    assert {n: len(s) for n, s in seen.items()} == counts
    for slots in space.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= 64


def test_pipeline_against_its_parts(spark, sf):
    """Each stage on its own input, by brute force where there is one."""
    import corpus_pipeline as P

    d = spark.read.parquet(f"{sf}/documents.parquet")
    kept = P.keep_known_languages(spark, d, sf)
    assert kept.columns == d.columns and kept.count() == d.where(F.col("text").rlike(r"\p{L}")).count()
    fewer = P.drop_near_duplicates(spark, kept, sf).toPandas()
    k = kept.orderBy("doc_id").toPandas()
    want, _ = brute_components(k.text.tolist(), 5)
    assert sorted(fewer.doc_id) == sorted(k.doc_id[i] for i in set(want))
    assert [name for name, _ in P.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    out = P.run(spark, sf).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 4096 and set(out.doc_id) <= set(k.doc_id)
    assert hashlib is not None
