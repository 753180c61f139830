"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, decontamination, filter_audit, language_id, line_dedup, minhash, packing, quality, secrets, sharding, topk_search, toxicity, url_filters
from tidemark.llm.common import crc_fold, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])

    def n(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.spelled(F.col("base")), 256).alias("base_sha256"), secrets.spelled(F.array_sort(F.concat("base", "markov"))).alias("spans")
    )


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


OP2_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END) AS shingle FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT p.a, p.b FROM p JOIN n AS x ON x.doc_id = p.a JOIN n AS y ON y.doc_id = p.b WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = reach.y
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) AS r ON r.x = d.doc_id
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP4_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e AS q, e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.kd_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Which of several similar earlier lines a line is matched with depends on how the rows are dealt; that it repeats one does not.
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents"), least_tokens=1).select("doc_id", "line_no")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, crc_fold("doc_id", 5) != 0)
    out = language_id.identify(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, crc_fold("doc_id", 3) != 1)
    out = quality.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, crc_fold("doc_id", 4) != 2)
    out = toxicity.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence", "terms")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), tokenizer_path(), size=4096, end_id=1)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    byte_path, piece_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), byte_path, piece_path).drop("groups")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), first AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text), marked AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(marked.toxic, 0) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(d.text, '[^A-Z]+', '', 'g')) > 3 * length(d.text) AS c, regexp_matches(d.text, '[#$%&*|]') AS d, coalesce(d.doc_id > first, false) AS e
  FROM d JOIN first ON d.text = first.text LEFT JOIN marked ON marked.doc_id = d.doc_id
), f AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM m GROUP BY ALL
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM l AS p, l AS q, l AS r, l AS s, l AS t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (SELECT filter_order, CAST(k AS INTEGER) AS step, filter_order[k:k] AS own, filter_order[1:k - 1] AS earlier FROM orders, range(1, 6) AS r(k)), s AS (
  SELECT part, filter_order, step, own, n, good, toxic, failed, contains(failed, own) AS fails,
         len(list_filter(string_split(failed, ''), lambda x: x <> '' AND contains(earlier, x))) > 0 AS gone
  FROM f, steps
), sums AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN fails OR gone THEN 0 ELSE n END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM sums
"""

#: The rules that op13 goes by: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_pages(table(spark, sf_dir, "pages"), URL_RULES)


OP13_SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
         list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '@LINK@', 1),
           lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS targets
  FROM pages
), p AS (
  SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                 WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM u
), q AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said FROM p), seeds AS (
  SELECT host, CAST(floor(count(CASE WHEN said = 'allow' THEN 1 END) * CAST(1073741824 AS DOUBLE) / count(*)) AS BIGINT) AS allow,
         CAST(floor(count(CASE WHEN said = 'block' THEN 1 END) * CAST(1073741824 AS DOUBLE) / count(*)) AS BIGINT) AS block
  FROM q WHERE host <> '' GROUP BY host
), l AS (
  SELECT src, dst, count(*) AS weight FROM (SELECT host AS src, unnest(targets) AS dst FROM q) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), e AS (SELECT 'trust' AS side, src, dst, weight FROM l UNION ALL SELECT 'distrust', dst, src, weight FROM l), shares AS (
  SELECT *, sum(weight) OVER (PARTITION BY side, src) AS out FROM e
), moved AS (
  SELECT 0 AS k, side, node, mass FROM (SELECT 'trust' AS side, host AS node, allow AS mass FROM seeds UNION ALL SELECT 'distrust', host, block FROM seeds) WHERE mass > 0
  UNION ALL
  SELECT k, side, node, mass FROM (
    SELECT moved.k + 1 AS k, moved.side, shares.dst AS node, CAST(sum(CAST(floor(CAST(mass AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(out AS DOUBLE) * CAST(0.85 AS DOUBLE)) AS BIGINT)) AS BIGINT) AS mass
    FROM moved JOIN shares ON shares.side = moved.side AND shares.src = moved.node WHERE moved.k < 43 GROUP BY 1, 2, 3
  ) WHERE mass > 0
), ranks AS (
  SELECT node, CAST(sum(CASE WHEN side = 'trust' THEN mass ELSE 0 END) AS BIGINT) AS trust, CAST(sum(CASE WHEN side = 'distrust' THEN mass ELSE 0 END) AS BIGINT) AS distrust FROM moved GROUP BY node
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN distrust > CAST(0.5 AS DOUBLE) * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(coalesce(trust, 0) AS DOUBLE) / 1073741824 AS trust, CAST(coalesce(distrust, 0) AS DOUBLE) / 1073741824 AS distrust
FROM q LEFT JOIN ranks ON host = node
""".replace("@LINK@", url_filters.LINK_HOST.replace("'", "''"))

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_minhash": op2_minhash,
    "op3_decontamination": op3_decontamination,
    "op4_topk_search": op4_topk_search,
    "op5_kd_sharding": op5_kd_sharding,
    "op6_line_dedup": op6_line_dedup,
    "op7_language_id": op7_language_id,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_alignment": op11_alignment,
    "op12_filter_audit": op12_filter_audit,
    "op13_url_filters": op13_url_filters,
}

ORACLE_SQL = {"op2_minhash": OP2_SQL, "op4_topk_search": OP4_SQL, "op12_filter_audit": OP12_SQL, "op13_url_filters": OP13_SQL}
