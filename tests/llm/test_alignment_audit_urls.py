"""Operators 11 to 13 against brute force and SQL on small fixtures, with nulls, empty and long texts, repeats, no rows and clashing columns."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter
from itertools import permutations, product

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_operators import docs
from tests.test_queries import plain
from tidemark.llm import alignment, filter_audit, queries, url_filters

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# 11 ------------------------------------------------------------------------------------------------
def decoded():
    """Bytes of each id of both tokenizers, by the alphabet's own definition."""
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    plain_bytes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in plain_bytes} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain_bytes)}
    a_bytes = {k: bytes(letter[c] for c in e) for e, k in a.get_vocab().items()}
    b_bytes = {k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace(chr(0x2581), " ").encode() for k in range(len(b))}
    return a, b, a_bytes, b_bytes


def brute_alignment(texts):
    a, b, a_bytes, b_bytes = decoded()
    out, held = [], Counter()
    for t in texts:
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw = (" " + (t or "")).encode()
        if not t or b"".join(a_bytes[x] for x in ia) != raw or b"".join(b_bytes[x] for x in ib) != raw:
            ia, ib = [], []
        ends = []
        for ids, known in ((ia, a_bytes), (ib, b_bytes)):
            at, own = 0, []
            for x in ids:
                at += len(known[x])
                own.append(at)
            ends.append(own)
        cuts = sorted({*ends[0]} & {*ends[1]})
        groups, start = [], 0
        for c in cuts:
            groups.append(([x for x, e in zip(ia, ends[0], strict=True) if start < e <= c], [x for x, e in zip(ib, ends[1], strict=True) if start < e <= c]))
            start = c
        links = [p for g in groups for p in product(*g)]
        held.update({*links})
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(ia), len(ib), len(groups), links, hashlib.sha256(spelled.encode()).hexdigest() if ia else "", spelled))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [(na, nb, ng, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), sha, spelled) for na, nb, ng, links, sha, spelled in out]


U = chr(0x2581)
ODD = [None, "", " ", "  ", "\n", "a\n\nb", " \n x", "a \t b\r\nc", "x" + chr(0xA0) + " y", "a" + U + "b", "<|endoftext|> <s> </s> <0x41>", "e" + chr(0x301) + " " + chr(0x1F600) + chr(0x200D), "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "if (x) {\n        return y;\n}\t\t// z", "a  b   c    d ", "\x00\x1f x", chr(0x4F60) + chr(0x597D) + " " + chr(0x3000) + "x", "...!!! don't we'll 1234567 3.14"]


def test_alignment_against_brute_force(spark, sf):
    rng = random.Random(21)
    texts = ODD + [r["text"][:600] for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").orderBy("doc_id").limit(60).collect()]
    texts += ["".join(rng.choice("ab \n\t\r'é" + U + "1.") for _ in range(rng.randrange(40))) for _ in range(150)]
    texts += ["word " * 30_000, "z" * 5_000, texts[30], texts[30]]
    d = docs(spark, texts).withColumns({c: F.lit(1) for c in ("chunk", "code", "codes", "best", "documents", "of", "groups")})
    want = brute_alignment(texts)
    out = alignment.align(d.repartition(3), BYTE, PIECE, with_groups=True)
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"], r["groups"]) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(x[0] > 0 for x in want) > 100 and sum(x[0] == 0 for x in want) > 3


def test_alignment_in_many_chunks_and_of_odd_tables(spark):
    rng = random.Random(22)
    texts = [" ".join(rng.choices(["the", "token", "un-happy", "4217", "Stra" + chr(0xDF) + "e"], k=rng.randrange(9))) for _ in range(80)]
    chunks = alignment.aligned_chunks(docs(spark, texts).coalesce(2), BYTE, PIECE, chunk_bytes=500).cache()
    assert chunks.count() > 10
    got = {r["doc_id"]: r["count_sum"] for r in alignment.scored(chunks, alignment.pair_counts(chunks)).collect()}
    assert [got[i] for i in range(80)] == [x[5] for x in brute_alignment(texts)]
    assert alignment.align(docs(spark, ["x"]).limit(0), BYTE, PIECE).count() == 0
    none = alignment.align(docs(spark, ["", None]).withColumn("doc_id", F.lit(None).cast("long")), BYTE, PIECE).collect()
    assert [(r["doc_id"], r["n_a"], r["count_sum"], r["groups_sha256"]) for r in none] == [(None, 0, 0, "")] * 2


def test_token_groups_are_minimal():
    rng = random.Random(23)
    for _ in range(300):
        total = rng.randrange(1, 30)
        sizes = []
        for _ in range(2):
            cuts = sorted(rng.sample(range(1, total), rng.randrange(total)) if total > 1 else []) + [total]
            sizes.append([y - x for x, y in zip([0, *cuts], cuts)])
        a_ends, b_ends = (np.cumsum(x) for x in sizes)
        ga, gb = alignment.token_groups(a_ends, b_ends)
        cuts = sorted({*a_ends.tolist()} & {*b_ends.tolist()})
        assert [bisect_left(cuts, e) for e in a_ends] == ga.tolist() and [bisect_left(cuts, e) for e in b_ends] == gb.tolist()


# 12 ------------------------------------------------------------------------------------------------
def brute_audit(rows, labels):
    """All orders, a row at a time; rows are (doc_id, text, lang)."""
    import re

    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first: dict[str, int] = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 200, "B": 100 * len({*w}) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        fails.append((lang or "", {k for k, v in bad.items() if v}, i in good, i in toxic))
    out = []
    for part in {p for p, *_ in fails}:
        shapley, found = Counter(), []
        for order in permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            for step, k in enumerate(order, 1):
                gone, kept = [f for f in left if k in f[1]], [f for f in left if k not in f[1]]
                mine = [f for f in fails if f[0] == part and k in f[1]]
                found.append([part, "".join(order), step, len(kept), len(gone), len(mine) - len(gone), sum(f[1] == {k} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)])
                shapley[k] += len(gone)
                left = kept
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in found]
    return sorted(out)


def test_audit_against_brute_force(spark):
    rng = random.Random(24)
    pool = [None, "", " ", "short", "A B C", "x " * 300, " ".join(f"w{k}" for k in range(250)), "# " + " ".join(f"w{k}" for k in range(250)), "Q" * 50 + " " + " ".join(f"v{k}" for k in range(220)), "caf" + chr(0xE9) + " " * 3 + chr(0x1F600), "long " * 50_000]
    rows = [(rng.choice([None, *range(90)]), rng.choice(pool), rng.choice([None, "", "en", "de", "x y"])) for _ in range(120)] + [(5, "same", "en"), (5, "same", "en"), (4, "same", "solo")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(60)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("part", "mask", "digest", "id", "same", "first", "of", "g", "_t", "good", "quality")})
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r[c] for c in names) for r in filter_audit.audit(d, lab).collect())
    assert got == brute_audit(rows, labels)
    assert filter_audit.audit(d.limit(0), lab).count() == 0
    assert filter_audit.audit(d, lab.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_polynomial_of_known_sets():
    p = filter_audit.RemovalPolynomial({0: 7, 1: 3, 3: 5, 2: 1}, 2)
    assert [p.corner(s) for s in range(4)] == [0, 8, 6, 9]
    assert p.shapley(0) + p.shapley(1) == 9 and p.shapley(0) == 3 + 5 / 2


# 13 ------------------------------------------------------------------------------------------------
def brute_verdicts(pages, rules):
    """Rules by scanning, ranks by a loop over dictionaries with the same whole masses."""
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    read = []
    for i, url, html in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.translate(low)
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        links = set()
        for tag in re.findall("<(?:a|area)[ \t\n\f\r][^<>]*", html or "", re.I | re.A):
            m = re.search(r"href[ \t\n\f\r]*=[ \t\n\f\r]*[\"']?[ \t\n\f\r]*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"' \t\n\f\r]*)", tag, re.I | re.A)
            if m:
                links.add(m[1].translate(low))
        read.append((i, host, path, max(fits)[1:] if fits else (None, None), links))
    hosts = sorted({r[1] for r in read if r[1]})
    edges = Counter((r[1], x) for r in read if r[1] for x in r[4] if x and x != r[1])
    ranks = []
    for side, verdict in (("trust", "allow"), ("distrust", "block")):
        along = {(a, b) if side == "trust" else (b, a): w for (a, b), w in edges.items()}
        out = Counter()
        for (a, _), w in along.items():
            out[a] += w
        mass = {}
        for h in hosts:
            own = [r for r in read if r[1] == h]
            mass[h] = int(sum(r[3][1] == verdict for r in own) * float(1 << 30) / len(own))
        rank = Counter(mass)
        for _ in range(43):
            moved = Counter()
            for (a, b), w in along.items():
                moved[b] += int(float(mass.get(a, 0)) * w / out[a] * 0.85)
            rank.update(moved)
            mass = moved
        ranks.append(rank)
    out = []
    for i, host, path, (rule, said), _ in read:
        t, d = (r[host] if host else 0 for r in ranks)
        out.append((i, host, path, rule, said or ("block" if d > 0.5 * (t + d) else "allow"), t / (1 << 30), d / (1 << 30)))
    return out


def made_pages(rng):
    hosts = [f"{p}h{k}.example.{t}" for k in range(6) for p, t in product(("", "www."), ("org", "com", "net"))] + ["org", "com", "example.org", "a.b:80", "Other.IO"]
    pages = []
    for i in range(260):
        url = f"{rng.choice(['http', 'HTTPS', 'x'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/1', '/en/12?x=/es/', '/es/9', '/fr/a#b', '/de/', '/de', '?q=/fr/', '#/de/'])}"
        links = []
        for _ in range(rng.randrange(6)):
            to = rng.choice(hosts).upper() if rng.random() < 0.3 else rng.choice(hosts)
            links.append(rng.choice([f'<a href="http://{to}/x">', f"<A class=a HREF='//{to}?y'>", f"<area\nhref = https://{to}>", f'<a href="/local/{to}">', f'<b href="http://{to}/">', f'<a data-x="1" href=" mailto:{to}">', f"<a <a href=//{to}#z>"]))
        pages.append((i % 250, url, "<p>".join(links)))
    return pages + [(300, None, '<a href="http://h1.example.org/">'), (301, "no scheme/fr/", None), (302, "http://", ""), (303, "http://h1.example.com", "x" * 300_000 + "<a " * 20_000), (None, "http://h1.example.com/fr/", None)]


def test_verdicts_against_brute_force_and_sql(spark, tmp_path):
    pages = made_pages(random.Random(25))
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "targets", "found", "of", "trust", "side", "node", "verdict")})
    names = "page_id host path rule verdict trust distrust".split()
    got = url_filters.judge_pages(d, queries.URL_RULES)
    key = lambda r: tuple(str(x) for x in r)
    rows = [tuple(r[c] for c in names) for r in got.collect()]
    assert sorted(rows, key=key) == sorted(brute_verdicts(pages, queries.URL_RULES), key=key)
    free = [r for r in rows if r[3] is None]
    assert {r[4] for r in free} == {"allow", "block"} and any(0 < r[6] for r in free if ".net" in r[1])
    d.select("page_id", "url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"create view pages as from '{tmp_path}/pages.parquet/*.parquet'")
    assert plain(got.toPandas()) == plain(c.sql(queries.OP13_SQL).df())
    assert url_filters.judge_pages(d.limit(0), queries.URL_RULES).count() == 0
    with pytest.raises(ValueError):
        url_filters.judge_pages(d, [("maybe", "org", "/")])


def test_distrust_runs_against_links(spark):
    """A farm that links to blocked pages is blocked, the victim of its links is not; trust runs along links, over several hosts."""
    pages = [(1, "http://bad.com/de/1", ""), (2, "http://farm.net/1", '<a href="//bad.com/de/1"><a href="//victim.net/">'), (3, "http://victim.net/", ""), (4, "http://up.net/", '<a href="//farm.net">')]
    pages += [(5, "http://good.org/", '<a href="//mid.net/">'), (6, "http://mid.net/", '<a href="//far.net/">'), (7, "http://far.net/", "")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filters.judge_pages(d, queries.URL_RULES).collect()}
    assert [got[i]["verdict"] for i in range(1, 8)] == ["block", "block", "allow", "block", "allow", "allow", "allow"]
    assert got[2]["distrust"] > got[4]["distrust"] > 0 and got[6]["trust"] > got[7]["trust"] > 0
