"""Repeated and null ids, clashing names and long lists."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_operators import docs
from tidemark.llm import decontamination, line_dedup, minhash, quality, secrets, toxicity


def test_minhash_of_an_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b), (4, b + " more"), (5, a + " more"), (None, a), (7, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_on", F.lit(1)).withColumn("key", F.lit(2))
    out = minhash.near_duplicates(d).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in out) == [(0, None, False), (1, 1, True), (1, 1, True), (4, 1, False), (5, 1, False), (7, 7, True)]


def test_long_lists_of_lines(spark):
    """Near copies of one line, more than one deal keeps under a key, and lists longer than a task compares."""
    rng = random.Random(3)
    base = [f"t{i}" for i in range(40)]
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 3, 5, 6])):
            w[rng.randrange(40)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [set(t.split()) for t in texts]
    want = {j for j, s in enumerate(sets) if any(5 * len(s & o) >= 4 * len(s | o) for o in sets[:j])}
    assert {r["doc_id"] for r in line_dedup.repeated_lines(docs(spark, texts).coalesce(1)).collect()} == want


def test_clashing_names(spark):
    d = docs(spark, ["good text here", "bad bad bad", "x"]).withColumns({c: F.lit(1) for c in ("_id", "_y", "_gone", "_gone_id", "lines", "id", "row", "_whole_text", "_WHOLE_TEXT_")})
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(d, quality.train(d, labels, F.lit(True))).count() == 3
    assert toxicity.score(d, toxicity.train(d, labels, F.lit(True))).count() == 3
    assert secrets.scan(d, secrets.MarkovModels([0] * secrets.SIGNS**2)).count() == 3
    out = line_dedup.dedup_lines(d.unionByName(d.withColumn("doc_id", F.col("doc_id") + 10)))
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2] and out.columns == d.columns


def test_model_spans_against_brute_force(spark, sf):
    """Runs with and without digits, short and long, by a loop over the model's ratios; repeated and null rows too."""
    rng = random.Random(5)
    models = secrets.train(secrets.labelled_samples(spark.read.parquet(f"{sf}/documents.parquet")))
    made = ["qWzRtYpLkJhGfDsAmNbVcXzQ", "x8Kq2ZpL9vTr4WmN7b", "some_long_identifier_name_2", "/usr/local/lib/python3/site-packages", "Donaudampfschifffahrtsgesellschaft"]
    made += ["".join(rng.choices(secrets.ALPHABET[: rng.choice([26, 52, 62, 65])], k=rng.randrange(8, 50))) for _ in range(200)]
    texts = ["é😀 " + " . ".join(rng.choices(made, k=6)) for _ in range(120)] + [". ".join(made), "", None, "".join(made[:2]) * 40]
    got = {r["doc_id"]: [(m["start"], m["end"]) for m in r["markov"]] for r in secrets.scan(docs(spark, texts), models).collect()}
    place = {c: k for k, c in enumerate(secrets.ALPHABET)}
    hits = 0
    for i, text in enumerate(texts):
        taken = [m.span() for _, p, *_ in secrets.RULES for m in re.finditer(p, text or "")]
        want = []
        for m in re.finditer("[A-Za-z0-9+/_=-]+", text or ""):
            at = [place[c] for c in m[0]]
            total = sum(models.ratios[a * secrets.SIGNS + b] for a, b in zip(at, at[1:], strict=False))
            if len(at) >= 16 and total >= max(500 * (len(at) - 1), 9500) and not any(a < m.end() and m.start() < b for a, b in taken):
                want.append(m.span())
        assert got[i] == want
        hits += len(want)
    assert hits > 100 and len(got[len(texts) - 1]) == 1
    twice = docs(spark, texts[:1]).unionByName(docs(spark, texts[:1])).withColumn("doc_id", F.lit(None).cast("long"))
    assert [[(m["start"], m["end"]) for m in r["markov"]] for r in secrets.scan(twice, models).collect()] == [got[0]] * 2


def test_many_matches_in_one_text(spark):
    """More matches than one step numbers, with gaps of every length."""
    rng = random.Random(6)
    text = "".join("ü" * rng.randrange(4) + " token=" + "a" * rng.randrange(1, 12) + "," for _ in range(3000))
    want = [m.span() for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= 6]
    models = secrets.MarkovModels([0] * secrets.SIGNS**2)
    row = secrets.scan(docs(spark, [text]), models).head()
    assert [(m["start"], m["end"]) for m in row["base"]] == want and len(want) > 3 * secrets.STEP


def test_first_texts(spark):
    d = docs(spark, [f"text {i}" for i in range(50)] + [None])
    many = d.unionByName(d).unionByName(d.withColumn("doc_id", F.lit(None).cast("long")))
    one = sorted(r["text"] for r in secrets.first_texts(many, 20).collect())
    assert one == sorted(r["text"] for r in secrets.first_texts(many.repartition(7), 20).collect()) and 0 < len(one) <= 20
    assert secrets.first_texts(d.limit(0), 5).count() == 0


def brute_leaks(text, items, least=0.8):
    """(item, similarity to 6 places) of every item by every window of every text, weights as in the index."""
    words = {k: t.lower().split() for k, t in enumerate(items)}

    def bag(w, size):
        return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))

    bags = {k: bag(w, min(5, len(w))) for k, w in words.items()}
    count = Counter(s for b in bags.values() for s in b)

    def weight(s):
        return max(1, round(4 - 0.5 * np.log2(count[s]))) if s in count else 4

    own, out = (text or "").lower().split(), {}
    for k, b in bags.items():
        size, n = min(5, len(words[k])), min(len(words[k]), len(own))
        for at in range(len(own) - n + 1 if n >= size else 0):
            w = bag(own[at : at + n], size)
            both = sum(weight(s) * min(w[s], b[s]) for s in w)
            s = 2 * both / sum(weight(s) * c for x in (w, b) for s, c in x.items())
            if s >= least:
                out[k] = max(out.get(k, 0), round(s, 6))
    return out


def test_leaks_against_brute_force(spark):
    """Items whole, edited, cut at the ends and as documents of their own, by all windows and items."""
    rng = random.Random(14)
    items = [" ".join(f"v{rng.randrange(60)}" for _ in range(n)) for n in (3, 5, 6, 12, 12, 20, 20, 40, 40, 60)]
    texts = [None, "", "v1"]
    for _ in range(300):
        w = rng.choice(items).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(90)}"
        w = w[rng.choice([0, 0, 1]) : len(w) - rng.choice([0, 0, 1, 2])]
        around = [[f"v{rng.randrange(60)}" for _ in range(rng.choice([0, 0, 9]))] for _ in range(2)]
        texts.append(" ".join(around[0] + w + around[1]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 6) for r in decontamination.leaks(docs(spark, texts), bench).collect()}
    want = {(i, k): s for i, t in enumerate(texts) for k, s in brute_leaks(t, items).items()}
    assert got == want and len(want) > 100


def test_items_of_one_id_and_of_none(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    bench = spark.createDataFrame([(1, a), (1, b), (None, c), (None, a), (1, a)], "item_id long, text string")
    d = docs(spark, [a, b, c, a[:-4], "nothing of the kind"])
    found = sorted((r["doc_id"], r["item_id"] or 0, r["words"]) for r in decontamination.leaks(d, bench).collect())
    assert found == [(0, 0, 30), (0, 1, 30), (1, 1, 30), (2, 0, 30), (3, 0, 29), (3, 1, 29)]
    assert [r["doc_id"] for r in decontamination.decontaminated(d, bench).collect()] == [4]
