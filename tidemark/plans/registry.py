"""The registered queries and their SQL, over the driver's tables.

Sessions are users (events) or conversations, server ids are event ids, times are seconds of ``ts``,
labels come from customers, nations and regions, archives are documents, feeds are pages. Where
the data have no duplicate, gap or conflict, a query derives some, in Spark and SQL alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions.decode import loose_name
from tidemark.operators import archive as A
from tidemark.operators import directory as D
from tidemark.operators import messages as M
from tidemark.sources import store
from tidemark.streaming import waits as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: 2024-01-10 and 2024-01-20, UTC.
SINCE, UNTIL = 1_704_844_800, 1_705_708_800


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: seconds, and an id as text."""
    return t(spark, sf_dir, "events").withColumns({"create_time": F.unix_seconds(F.col("ts").cast("timestamp")), "id_value": F.col("event_id").cast("string")})


def order() -> list:
    return [F.col("create_time"), F.col("event_id")]


EV = "e AS (SELECT *, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS create_time FROM events)"


@query(
    f"""WITH {EV}, p AS (SELECT event_id, create_time, event_type, props FROM e WHERE user_id = 7 AND create_time BETWEEN {SINCE} AND {UNTIL} ORDER BY create_time DESC, event_id DESC LIMIT 25),
    r AS (SELECT *, row_number() OVER (ORDER BY create_time DESC, event_id DESC) AS rn, count(*) OVER () AS n FROM p)
    SELECT event_id, create_time, event_type, props, n > 24 AS has_more FROM r WHERE rn <= 24"""
)
def context_page(spark, sf_dir):
    rows = events(spark, sf_dir).where((F.col("user_id") == 7) & M.in_window("create_time", SINCE, UNTIL)).select("event_id", "create_time", "event_type", "props")
    return M.ascending_limited(M.page(rows, 24, order()), order())


@query(
    f"""WITH {EV} SELECT event_id, create_time, user_id FROM e WHERE (create_time < {UNTIL} OR (create_time = {UNTIL} AND event_id < 5000)) ORDER BY create_time DESC, event_id DESC LIMIT 100"""
)
def context_next_page(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "create_time", "user_id")
    return M.page(rows, 100, order(), before_key=(UNTIL, 5000)).drop("has_more")


@query(f"WITH {EV} SELECT event_id, create_time FROM e ORDER BY abs(create_time - {SINCE}), create_time DESC, event_id DESC LIMIT 50")
def around_topk(spark, sf_dir):
    return M.around(events(spark, sf_dir).select("event_id", "create_time"), SINCE, 50, "create_time", order())


@query(
    f"""WITH {EV}, r AS (SELECT user_id, event_id, create_time, event_type, row_number() OVER (PARTITION BY user_id ORDER BY create_time, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM e),
    a AS (SELECT *, max(CASE WHEN contains(lower(event_type), 'click') THEN rn END) OVER (PARTITION BY user_id) AS anchor_rn FROM r),
    w AS (SELECT *, least(greatest(anchor_rn - 6, 1) + 9, n) AS last FROM a WHERE anchor_rn IS NOT NULL)
    SELECT user_id, event_id, create_time, rn, anchor_rn FROM w WHERE rn BETWEEN greatest(last - 9, 1) AND last"""
)
def anchored_frame_keyword(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "create_time", "event_type")
    out = M.anchored(rows, 10, order(), anchor=M.contains_text("event_type", "CLICK"), partition=["user_id"])
    return out.select("user_id", "event_id", "create_time", "rn", "anchor_rn")


@query(
    f"""WITH {EV}, r AS (SELECT user_id, event_id, create_time, row_number() OVER (PARTITION BY user_id ORDER BY create_time, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM e),
    a AS (SELECT *, first_value(rn) OVER (PARTITION BY user_id ORDER BY abs(create_time - {UNTIL}), rn) AS anchor_rn FROM r),
    w AS (SELECT *, least(greatest(anchor_rn - 6, 1) + 9, n) AS last FROM a)
    SELECT user_id, event_id, rn, anchor_rn FROM w WHERE rn BETWEEN greatest(last - 9, 1) AND last"""
)
def anchored_frame_time(spark, sf_dir):
    rows = events(spark, sf_dir).select("user_id", "event_id", "create_time")
    return M.anchored(rows, 10, order(), time="create_time", at=UNTIL, partition=["user_id"]).select("user_id", "event_id", "rn", "anchor_rn")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def tail_per_session(spark, sf_dir):
    return M.tail(t(spark, sf_dir, "conversations"), 3, [F.col("turn")], ["conv_id"]).select("conv_id", "turn", "role")


def two_shards(spark, sf_dir, changed: str):
    """Events in two overlapping shards; ``changed``: an expression of what the second shard's copy says."""
    e = events(spark, sf_dir).select("event_id", "create_time", "event_type", "value")
    a = e.withColumn("shard", F.when(F.col("value") < 20, "c").otherwise("a"))
    b = e.withColumn("event_type", F.expr(changed)).withColumn("shard", F.lit("b"))
    return a.unionByName(b).drop("value")


#: What the second shard says of some events.
CHANGED = "CASE WHEN value > 90 THEN upper(event_type) ELSE event_type END"
TWO = f"{EV}, u AS (SELECT event_id, create_time, event_type, CASE WHEN value < 20 THEN 'c' ELSE 'a' END AS shard FROM e UNION ALL SELECT event_id, create_time, %s, 'b' FROM e)"


@query(f"WITH {TWO % 'event_type'} SELECT event_id, create_time, event_type, min(shard) AS shard FROM u GROUP BY ALL")
def shard_union_dedup(spark, sf_dir):
    return M.dedup_identities(two_shards(spark, sf_dir, "event_type"), "event_id", F.sha2(F.concat_ws("|", "create_time", "event_type"), 256), ["shard"])


@query(f"WITH {TWO % CHANGED} SELECT event_id, count(DISTINCT event_type) AS signatures FROM u GROUP BY event_id HAVING count(DISTINCT event_type) > 1")
def identity_conflicts(spark, sf_dir):
    rows = two_shards(spark, sf_dir, CHANGED)
    return M.conflicts_marked(rows, "event_id", F.col("event_type"), ["shard"]).where("signatures > 1").select("event_id", F.col("signatures").cast("bigint").alias("signatures"))


@query(
    f"""WITH {EV}, s AS (SELECT user_id, create_time, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY create_time DESC, event_id) AS r FROM e)
    SELECT 'u' || user_id || CASE WHEN user_id % 5 = 0 THEN '@chatroom' ELSE '' END AS username, CASE WHEN user_id % 5 = 0 THEN 'group' ELSE 'contact' END AS session_type, create_time AS last_timestamp, event_id AS sort_timestamp FROM s WHERE r = 1"""
)
def sessions_latest(spark, sf_dir):
    raw = events(spark, sf_dir).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 5 == 0, "@chatroom").otherwise("")).alias("username"),
        F.col("create_time").alias("last_timestamp"), (F.lit(0).cast("bigint") * F.col("event_id")).alias("zero"), F.col("event_id"), F.col("event_id").alias("source_rank"),
    )
    best = D.sessions(raw.withColumn("sort_timestamp", F.col("zero")).drop("zero", "event_id")).select("username", "session_type", "last_timestamp")
    first = raw.groupBy("username", "last_timestamp").agg(F.min("event_id").alias("sort_timestamp"))
    return best.join(first, ["username", "last_timestamp"]).select("username", "session_type", "last_timestamp", "sort_timestamp")


@query("SELECT session_type, count(*) AS sessions FROM (SELECT DISTINCT CASE WHEN user_id % 7 = 0 THEN 'channel' WHEN user_id % 5 = 0 THEN 'group' ELSE 'contact' END AS session_type, user_id FROM events) GROUP BY 1")
def session_type_counts(spark, sf_dir):
    u = F.col("user_id").cast("string")
    name = F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("GH_"), u)).when(F.col("user_id") % 5 == 0, F.concat(u, F.lit("@ChatRoom"))).otherwise(u)
    return t(spark, sf_dir, "events").select(name.alias("n")).distinct().groupBy(S.session_type(F.col("n")).alias("session_type")).agg(F.count(F.lit(1)).alias("sessions"))


ROLE = "CASE role WHEN 'user' THEN 'other' WHEN 'assistant' THEN 'self' WHEN 'system' THEN 'system' END"


@query(f"WITH r AS (SELECT conv_id, {ROLE} AS r FROM conversations) SELECT conv_id, count(*) FILTER (r = 'self') AS self_count, count(*) FILTER (r = 'other') AS other_count, count(*) FILTER (r = 'system') AS system_count, count(*) FILTER (r IS NULL) AS unknown_count FROM r GROUP BY conv_id")
def role_counts(spark, sf_dir):
    return D.role_counts(t(spark, sf_dir, "conversations").withColumn("r", F.expr(ROLE)), "r", ["conv_id"])


def people(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    first = F.when(F.col("c_acctbal") < 0, "x").otherwise("u")
    return c.select(F.concat(first, F.col("c_custkey").cast("string")).alias("username"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).otherwise("  ").alias("remark"), F.when(F.col("c_custkey") % 4 != 1, F.col("c_name")).alias("nick_name"), F.lit(0).alias("source_rank"))


PEOPLE = "p AS (SELECT CASE WHEN c_acctbal < 0 THEN 'x' ELSE 'u' END || c_custkey AS username, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS remark, CASE WHEN c_custkey % 4 <> 1 THEN c_name END AS nick_name FROM customer)"
SESS = "s AS (SELECT 'u' || user_id AS username, CASE WHEN user_id % 6 = 0 THEN NULL ELSE max(CAST(epoch_us(ts) // 1000000 AS BIGINT)) END AS last_timestamp FROM events GROUP BY user_id)"


def known_sessions(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id").agg(F.max("create_time").alias("m"))
    return D.sessions(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"), F.when(F.col("user_id") % 6 != 0, F.col("m")).alias("last_timestamp"), F.lit(0).alias("source_rank")))


@query(
    f"""WITH {SESS}, {PEOPLE} SELECT s.username, last_timestamp AS last_known, CASE WHEN last_timestamp IS NULL THEN 'unknown' WHEN last_timestamp > 1706500000 THEN 'after_until' ELSE 'changed' END AS state,
    coalesce(remark, nick_name, s.username) AS display_name, CASE WHEN p.username IS NULL THEN 'contact_row_missing' ELSE 'label_columns_missing' END AS label_gap
    FROM s LEFT JOIN p ON s.username = p.username WHERE last_timestamp >= 1706000000 OR last_timestamp IS NULL"""
)
def changes_since(spark, sf_dir):
    s = known_sessions(spark, sf_dir)
    return D.changed_sessions(s, D.contacts(people(spark, sf_dir), s), 1706000000, 1706500000).drop("session_type").withColumn("label_gap", F.coalesce("label_gap", F.lit("none")))


@query(
    f"""WITH {SESS}, {PEOPLE} SELECT s.username AS native_id, coalesce(remark, nick_name, s.username) AS display_name, remark, nick_name AS nickname, last_timestamp,
    CASE WHEN p.username IS NULL THEN 'contact_row_missing' ELSE 'label_columns_missing' END AS label_gap FROM s LEFT JOIN p ON s.username = p.username"""
)
def contacts_with_fallback(spark, sf_dir):
    return D.contacts(people(spark, sf_dir), known_sessions(spark, sf_dir)).select("native_id", "display_name", "remark", "nickname", "last_timestamp", "label_gap")


@query(
    f"""WITH {SESS}, {PEOPLE} SELECT coalesce(s.username, p.username) AS native_id, coalesce(remark, nick_name, s.username, p.username) AS display_name, CASE WHEN s.username IS NULL THEN 'session_missing' END AS session_gap, CASE WHEN p.username IS NULL THEN 'contact_row_missing' ELSE 'label_columns_missing' END AS label_gap
    FROM s FULL JOIN p ON s.username = p.username"""
)
def directory_full_outer(spark, sf_dir):
    return D.contacts(people(spark, sf_dir), known_sessions(spark, sf_dir), include_unregistered=True).select("native_id", "display_name", "session_gap", "label_gap")


def rooms(spark, sf_dir):
    r = t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("username"))
    m = t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("room_id"), F.col("n_nationkey").alias("member_id"))
    p = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("username"), F.lit(None).cast("string").alias("alias"), F.lit(None).cast("string").alias("remark"), F.col("n_name").alias("nick_name"))
    return r, m, p


@query("SELECT r_name AS room, string_agg(n_name, ',' ORDER BY n_name) AS members, count(*) AS member_count FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def group_members(spark, sf_dir):
    return D.members_by_room(D.group_members(*rooms(spark, sf_dir))).withColumn("members", F.array_join("members", ","))


@query("SELECT c_nationkey, CAST(floor(c_acctbal / 100) AS BIGINT) AS room, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN min(c_mktsegment) END AS c_mktsegment, CASE WHEN count(DISTINCT c_mktsegment) > 1 THEN 'group_member_label_conflict' END AS label_gap FROM customer GROUP BY ALL")
def label_agreement(spark, sf_dir):
    rooms = t(spark, sf_dir, "customer").withColumn("room", F.floor(F.col("c_acctbal") / 100).cast("bigint"))
    return D.agreed_labels(rooms, ["c_nationkey", "room"], ["c_mktsegment"])


def replies(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").withColumn("id", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return c.withColumn("quoted", F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")))


@query(
    """SELECT a.conv_id, a.turn, b.role AS quoted_role, sha256(b.text) AS quoted_sha, CASE WHEN b.conv_id IS NULL THEN 'quote_target_missing' END AS quote_gap
    FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1"""
)
def quote_self_join(spark, sf_dir):
    r = replies(spark, sf_dir)
    return M.attach_quotes(r, "quoted", r, "id", ["role", "text"]).select("conv_id", "turn", "quoted_role", F.sha2("quoted_text", 256).alias("quoted_sha"), "quote_gap")


@query("SELECT conv_id, turn FROM conversations a WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE a.conv_id = b.conv_id AND b.turn = a.turn - 1)")
def quote_missing(spark, sf_dir):
    r = replies(spark, sf_dir)
    return r.join(r.select(F.col("id").alias("quoted")), "quoted", "left_anti").select("conv_id", "turn")


@query(
    """WITH l AS (SELECT o_orderkey, o_custkey FROM orders), r AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal >= 4000 THEN c_custkey END AS first_key FROM customer),
    a AS (SELECT o_orderkey, o_custkey, c_custkey, c_nationkey FROM l JOIN r ON o_custkey = first_key)
    SELECT * FROM a UNION ALL SELECT l.o_orderkey, l.o_custkey, r.c_custkey, r.c_nationkey FROM l LEFT JOIN r ON r.c_custkey = l.o_custkey + 1 AND r.c_nationkey < 12 WHERE l.o_orderkey NOT IN (SELECT o_orderkey FROM a)"""
)
def fallback_key_join(spark, sf_dir):
    left = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    right = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") >= 4000, F.col("c_custkey")).alias("first_key"))
    out = M.prioritized_join(left, right, F.col("o_custkey") == F.col("first_key"), (F.col("c_custkey") == F.col("o_custkey") + 1) & (F.col("c_nationkey") < 12), "o_orderkey")
    return out.drop("first_key")


@query("SELECT conv_id, CASE WHEN count(DISTINCT length(text) // 300) = 1 THEN min(length(text) // 300) + 1 END AS own_sender FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def sender_calibration(spark, sf_dir):
    status, sender = F.when(F.col("role") == "assistant", 2).otherwise(4), F.floor(F.length("text") / 300).cast("bigint") + 1
    rows = t(spark, sf_dir, "conversations").select("conv_id", status.alias("status"), F.lit(1).cast("bigint").alias("local_type"), sender.alias("real_sender_id"))
    return M.calibrated_senders(rows, ["conv_id"])


@query(
    f"""WITH {EV}, x AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE create_time END AS create_time FROM e)
    SELECT event_id, create_time FROM x WHERE (event_id > 6000 AND (create_time <= {UNTIL + 600000} OR create_time IS NULL)) OR (event_id <= 6000 AND create_time BETWEEN {UNTIL - 86400} AND {UNTIL + 600000})"""
)
def watermark_increment(spark, sf_dir):
    x = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("create_time")).alias("create_time"))
    return x.where(M.after_watermark_or_replayed("event_id", 6000, "create_time", UNTIL - 86400, UNTIL + 600000))


@query(f"WITH {EV}, m AS (SELECT max(event_id) AS max_seq, max(create_time) AS max_time FROM e) SELECT max_seq, max_time, coalesce(min(event_id) FILTER (create_time >= max_time - 86400), max_seq) AS replay_floor FROM e, m GROUP BY max_seq, max_time")
def watermark_state(spark, sf_dir):
    return A.watermarks(events(spark, sf_dir), "event_id", "create_time")


def old_and_new(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), "n_chars")
    renamed = F.when(F.col("n_chars") % 5 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id"))
    changed = F.when(F.col("n_chars") % 7 == 0, F.lit("changed")).otherwise(F.col("sha"))
    return d.drop("n_chars"), d.select(renamed.alias("doc_id"), changed.alias("sha"))


OLD_NEW = "o AS (SELECT doc_id, sha256(text) AS sha FROM documents), n AS (SELECT CASE WHEN n_chars % 5 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id, CASE WHEN n_chars % 7 = 0 THEN 'changed' ELSE sha256(text) END AS sha FROM documents)"


@query(
    f"""WITH {OLD_NEW} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.sha IS NOT NULL AND (o.sha IS NULL OR o.sha <> n.sha) THEN n.sha ELSE o.sha END AS sha,
    CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'retained' WHEN o.sha = n.sha THEN 'same' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id"""
)
def merge_result(spark, sf_dir):
    return A.merged(*old_and_new(spark, sf_dir), "doc_id", "sha")


@query(
    f"""WITH {OLD_NEW} SELECT CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'retained' WHEN o.sha = n.sha THEN 'same' ELSE 'updated' END AS change, count(*) AS n FROM o FULL JOIN n ON o.doc_id = n.doc_id GROUP BY 1"""
)
def merge_counts(spark, sf_dir):
    return merge_result(spark, sf_dir).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {OLD_NEW} SELECT CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.sha = n.sha THEN 'same' ELSE 'updated' END AS change, count(*) AS n FROM o FULL JOIN n ON o.doc_id = n.doc_id GROUP BY 1")
def snapshot_diff(spark, sf_dir):
    return A.snapshot_diff(*old_and_new(spark, sf_dir), "doc_id", "sha").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sha256(text) AS sha256, count(*) AS uses, min(octet_length(encode(text))) AS size, 'media/' || substr(sha256(text), 1, 2) || '/' || sha256(text) || '.txt' AS path FROM documents GROUP BY text")
def content_dedup(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size"), F.lit("txt").alias("ext"))
    return A.content_addressed(d).select("sha256", "uses", "size", "path")


@query("SELECT kind, count(*) AS n FROM (SELECT unnest(CASE WHEN n_chars > 2000 THEN ['long'] ELSE [] END || CASE WHEN lang <> 'en' THEN ['foreign'] ELSE [] END) AS kind FROM documents) GROUP BY kind")
def gap_counts(spark, sf_dir):
    gaps = F.array_compact(F.array(F.when(F.col("n_chars") > 2000, "long"), F.when(F.col("lang") != "en", "foreign")))
    return A.gap_counts(t(spark, sf_dir, "documents").select(F.explode(gaps).alias("kind")), "kind")


@query("SELECT d.doc_id // 2 AS bucket, CASE WHEN count(quality) = count(*) THEN CAST(sum(quality) AS BIGINT) END AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def known_coverage_sum(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy(F.expr("doc_id div 2").alias("bucket")).agg(A.known_sum("quality").alias("quality"))


@query("""WITH x AS (SELECT '{"path":"' || source || '","length":' || count(*) || ',"modified":' || max(doc_id) || '}' AS j, source FROM documents GROUP BY source) SELECT sha256('[' || string_agg(j, ',' ORDER BY source) || ']') AS fingerprint, count(*) AS files FROM x""")
def fingerprint(spark, sf_dir):
    files = t(spark, sf_dir, "documents").groupBy(F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("length"), F.timestamp_micros(F.max("doc_id")).alias("modified"))
    return store.fingerprint(files).select("fingerprint", "files")


@query(
    """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) - DATE '2024-01-01' AS day FROM events), g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM d)
    SELECT user_id, min(day) AS first, max(day) AS last FROM g GROUP BY user_id, i"""
)
def rle_islands(spark, sf_dir):
    d = t(spark, sf_dir, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("day"))
    return A.runs(d, "day", "user_id")


@query(
    """WITH d AS (SELECT user_id, event_id, ts, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day FROM events), l AS (SELECT *, lag(day) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM d)
    SELECT user_id, event_id, day FROM l WHERE p IS NULL OR p <> day"""
)
def day_headings(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", "ts", "create_time")
    return A.day_headings(e, "create_time", ["ts", "event_id"], "user_id").where("heading").select("user_id", "event_id", "day")


@query(
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, event_id FROM r WHERE n <= 9 OR list_contains(list_transform(range(9), lambda i: CAST(round_even(i * (n - 1) / 8, 0) AS INTEGER)), CAST(rn AS INTEGER))"""
)
def even_sample(spark, sf_dir):
    return A.even_sample(t(spark, sf_dir, "events").select("user_id", "event_id", "ts"), 9, ["ts", "event_id"], "user_id").select("user_id", "event_id")


@query(
    """WITH x AS (SELECT doc_id, octet_length(encode(text)) AS b FROM documents ORDER BY doc_id DESC LIMIT 80), s AS (SELECT doc_id, CAST(sum(b) OVER (ORDER BY doc_id DESC) AS BIGINT) AS used_bytes FROM x) SELECT doc_id, used_bytes FROM s WHERE used_bytes <= 131072"""
)
def byte_budget_tail(spark, sf_dir):
    return A.within_bytes(t(spark, sf_dir, "documents").select("doc_id", "text"), "text", [F.col("doc_id")], 131_072).select("doc_id", "used_bytes")


@query("SELECT doc_id, sha256(substr(text, 1, 2048)) AS head_sha, length(text) AS chars, octet_length(encode(text)) AS bytes, 'sha256:' || sha256(text) AS sha256, sha256(substr(text, 101, 50)) AS slice_sha FROM documents")
def text_segments(spark, sf_dir):
    p = S.preview(F.col("text"))
    d = t(spark, sf_dir, "documents").withColumn("p", p)
    return d.select("doc_id", F.sha2("p.head", 256).alias("head_sha"), F.col("p.chars").cast("bigint").alias("chars"), F.col("p.bytes").cast("bigint").alias("bytes"), "p.sha256", F.sha2(S.text_slice(F.col("text"), 100, 50, F.col("p.sha256")), 256).alias("slice_sha"))


@query("SELECT c_custkey FROM customer WHERE contains(lower(regexp_replace(c_name || ' ' || c_mktsegment, '[\\p{P}\\p{S}\\p{Z}\\s]', '', 'g')), '001machinery')")
def loose_name_match(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", loose_name(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("n"))
    return c.where(F.contains("n", F.lit("001machinery"))).select("c_custkey")


@query(
    """WITH x AS (SELECT n_name, CASE WHEN lower(n_name) = 'nation 1' THEN 1 WHEN lower(regexp_replace(n_name, '[\\p{P}\\p{S}\\p{Z}\\s]', '', 'g')) = 'nation1' THEN 2 WHEN contains(lower(regexp_replace(n_name, '[\\p{P}\\p{S}\\p{Z}\\s]', '', 'g')), 'nation1') THEN 3 END AS layer FROM nation)
    SELECT n_name AS nickname, CASE layer WHEN 1 THEN 'exact' WHEN 2 THEN 'loose' ELSE 'partial_name' END AS match_kind FROM x WHERE layer = (SELECT min(layer) FROM x)"""
)
def resolve_layers(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    p = n.select(F.lit("primary").alias("account"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("native_id"), F.col("n_name").alias("display_name"), F.lit(None).cast("string").alias("remark"), F.col("n_name").alias("nickname"), F.lit(None).cast("string").alias("alias"), F.lit(0).cast("bigint").alias("last_timestamp"))
    return D.resolve(p, "Nation 1", allow_partial=True).select("nickname", "match_kind")


@query()
def similarity_suggest(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    p = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("native_id"), F.lit(None).cast("string").alias("remark"), F.col("n_name").alias("nickname"), F.lit(None).cast("string").alias("alias"), F.lit(0).cast("bigint").alias("last_timestamp"))
    return D.suggestions(p, "natoin_13").select("native_id", "nickname", "similarity")


@query("SELECT page_id, nullif(regexp_extract(html, '<title>(?:<!\\[CDATA\\[)?(.*?)(?:\\]\\]>)?</title>', 1, 's'), '') AS title FROM pages")
def xml_title(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", S.tag_text(F.col("html"), "title").alias("title"))


@query(
    """SELECT page_id, len(list_distinct(regexp_extract_all('<refermsg><svrid>' || url || '</svrid></refermsg><refermsg>' || html || '<svrid>7</svrid></refermsg><refermsg><msgid>' || url || '</msgid>', '<refermsg>.*?<(?:svrid|msgid|newmsgid)>(?:<!\\[CDATA\\[)?([^<\\]]+)', 1, 's'))) AS ids FROM pages"""
)
def quote_ids(spark, sf_dir):
    x = F.concat(F.lit("<refermsg><svrid>"), F.col("url"), F.lit("</svrid></refermsg><refermsg>"), F.col("html"), F.lit("<svrid>7</svrid></refermsg><refermsg><msgid>"), F.col("url"), F.lit("</msgid>"))
    return t(spark, sf_dir, "pages").select("page_id", F.size(S.quote_ids(x)).cast("bigint").alias("ids"))


@query(
    """SELECT conv_id, turn, CASE turn % 6
      WHEN 0 THEN role || chr(10) || 'http://x/' || conv_id
      WHEN 1 THEN '微信红包'
      WHEN 2 THEN '微信转账' || chr(10) || CASE turn % 5 WHEN 1 THEN '转账已发起' WHEN 3 THEN '转账已确认收款' WHEN 4 THEN '转账已退还' ELSE '转账状态未知' END || '，金额 ' || conv_id
      WHEN 3 THEN '位置分享：' || role || ' & ' || conv_id || '；' || role
      WHEN 4 THEN role || ' joined $gone$'
      ELSE role || ' ended' END AS body FROM conversations"""
)
def message_bodies(spark, sf_dir):
    """The readable text of messages of five types, from bodies that hold the table's values."""
    turn, who, at = F.col("turn"), F.col("role"), F.col("conv_id").cast("string")
    template = (
        ":\n<sysmsg type=\"sysmsgtemplate\"><sysmsgtemplate><content_template><plain></plain><template>$who$ joined $gone$</template>"
        "<link_list><link name=\"who\"><plain><![CDATA["
    )
    kinds = [
        (49, F.concat(F.lit("<msg><title>"), who, F.lit("</title><des>"), who, F.lit("</des><url>http://x/"), at, F.lit("</url></msg>"))),
        (49, F.concat(F.lit("<msg><title><![CDATA[微信红包]]></title><des>"), who, F.lit("</des></msg>"))),
        (49, F.concat(F.lit("<msg><title>微信转账</title><paysubtype>"), turn % 5, F.lit("</paysubtype><feedesc><![CDATA["), at, F.lit("]]></feedesc></msg>"))),
        (48, F.concat(F.lit("<msg><location poiname=\""), who, F.lit(" &amp; "), at, F.lit("\" label=\""), who, F.lit("\"/></msg>"))),
        (10000, F.concat(who, F.lit(template), who, F.lit("]]></plain></link></link_list></content_template></sysmsgtemplate></sysmsg>"))),
        (50, F.concat(F.lit("<voipmsg type=\"b\"><msg>"), who, F.lit(" ended</msg></voipmsg>"))),
    ]
    content, kind = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, (n, body) in enumerate(kinds):
        content, kind = F.when(turn % 6 == k, body).otherwise(content), F.when(turn % 6 == k, n).otherwise(kind)
    bodies = t(spark, sf_dir, "conversations").select("conv_id", "turn", content.alias("content"), kind.alias("kind"))
    return bodies.select("conv_id", "turn", S.message_text(F.col("content"), F.col("kind")).alias("body"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query(
    """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, octet_length(encode(text)) AS size, sha256(text) AS h FROM documents), a AS (SELECT CASE WHEN n_chars % 11 = 0 THEN 'moved/' ELSE '' END || doc_id AS doc_id, octet_length(encode(text)) + CASE WHEN n_chars % 13 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN n_chars % 19 = 0 THEN 'bad' ELSE sha256(text) END AS h FROM documents)
    SELECT coalesce(d.doc_id, a.doc_id) AS path, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'undeclared' WHEN d.size <> a.size THEN 'size_mismatch' WHEN d.h <> a.h THEN 'hash_mismatch' END AS error
    FROM d FULL JOIN a ON d.doc_id = a.doc_id WHERE a.doc_id IS NULL OR d.doc_id IS NULL OR d.size <> a.size OR d.h <> a.h"""
)
def verify_manifest(spark, sf_dir):
    n = F.col("n_chars")
    declared = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha256"), "n_chars")
    path = F.when(n % 11 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    actual = declared.select(path.alias("path"), (F.col("size") + F.when(n % 13 == 0, 1).otherwise(0)).alias("size"), F.when(n % 19 == 0, "bad").otherwise(F.col("sha256")).alias("sha256"))
    return A.verify(declared, actual)


@query(
    """WITH base AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders), top AS (SELECT max(event_id) AS m FROM events),
    lg AS (SELECT event_id + CASE WHEN event_id > m * 3 // 4 THEN 1 ELSE 0 END AS seq, event_id // 2 * 3 AS k, event_type AS v, event_id % 100 = 0 AS c, event_id % 9 = 0 AS deleted FROM events, top),
    b AS (SELECT max(seq) AS upto FROM lg WHERE c AND seq < (SELECT coalesce(min(seq), 1000000000000) FROM lg l WHERE seq > (SELECT min(seq) FROM lg) AND NOT EXISTS (SELECT 1 FROM lg p WHERE p.seq = l.seq - 1))),
    w AS (SELECT k, arg_max(v, seq) AS v, arg_max(deleted, seq) AS gone FROM lg, b WHERE seq <= upto GROUP BY k)
    SELECT k, v FROM base WHERE k NOT IN (SELECT k FROM w) UNION ALL SELECT k, v FROM w WHERE NOT gone"""
)
def overlay_log(spark, sf_dir):
    base = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    e = t(spark, sf_dir, "events")
    e = e.crossJoin(F.broadcast(e.agg(F.max("event_id").alias("m"))))  # one row; the log has a gap after three quarters
    seq = F.col("event_id") + F.when(F.col("event_id") > F.expr("m * 3 div 4"), 1).otherwise(0)
    log = e.select(seq.alias("seq"), (F.expr("event_id div 2") * 3).alias("k"), F.col("event_type").alias("v"), (F.col("event_id") % 100 == 0).alias("commit"), (F.col("event_id") % 9 == 0).alias("deleted"))
    return store.committed_overlay(base, log, "k")


@query(
    f"""WITH {EV}, g AS (SELECT user_id, create_time, CASE WHEN create_time - lag(create_time) OVER (PARTITION BY user_id ORDER BY create_time) > 43200 THEN 1 ELSE 0 END AS brk FROM e),
    b AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY create_time ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, min(create_time) AS first, max(create_time) AS last, count(*) AS events FROM b GROUP BY user_id, i"""
)
def debounce_batch(spark, sf_dir):
    return W.bursts(events(spark, sf_dir).select("user_id", "create_time"), 43_200, "user_id", "create_time")


@query(
    f"""WITH {EV}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT CAST(user_id AS VARCHAR) AS chat_id, event_id AS sequence, greatest(n - 50, 0) AS dropped FROM r WHERE r <= 50"""
)
def bounded_buffer(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("chat_id"), F.col("event_id").alias("sequence"))
    return W.buffered(e, 50)


@query("SELECT event_id, CASE WHEN ty = 34359738417 THEN 47 WHEN ty IN (1, 3, 34, 42, 43, 47, 48, 49, 50, 10000) THEN ty WHEN ty > 65535 AND (ty & 255) IN (1, 3, 34, 42, 43, 47, 48, 49, 50) THEN ty & 255 ELSE ty END AS base_type FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 34359738417 WHEN 1 THEN (event_id << 32) | 49 WHEN 2 THEN event_id % 60 ELSE 10000 END AS ty FROM events)")
def base_types(spark, sf_dir):
    e = F.col("event_id")
    kind = F.when(e % 4 == 0, F.lit(S.STICKER_APP)).when(e % 4 == 1, F.shiftleft(e, 32).bitwiseOR(F.lit(49))).when(e % 4 == 2, e % 60).otherwise(F.lit(10000))
    return t(spark, sf_dir, "events").select("event_id", S.base_type(kind).alias("base_type"))


@query(
    """WITH x AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 0 ELSE event_id END AS server_id, CASE event_id % 5 WHEN 0 THEN NULL ELSE event_id END AS local_id FROM events)
    SELECT event_id, CASE WHEN server_id <> 0 THEN 'server' WHEN local_id IS NOT NULL THEN 'local' END AS kind, CASE WHEN server_id <> 0 THEN CAST(server_id AS VARCHAR) WHEN local_id IS NOT NULL THEN CAST(local_id AS VARCHAR) END AS value FROM x"""
)
def native_ids(spark, sf_dir):
    e = F.col("event_id")
    n = S.native_id(F.when(e % 3 == 0, F.lit(0)).otherwise(e), F.when(e % 5 != 0, e))
    return t(spark, sf_dir, "events").select("event_id", n.alias("n")).select("event_id", "n.kind", "n.value")


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S+08:00') AS moment FROM events")
def local_times(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", S.local_time(F.col("create_time")).alias("local_time"), S.moment(F.col("create_time")).alias("moment"))


@query("SELECT page_id, md5(url) AS key, 'Msg_' || md5(url) AS session_table FROM pages")
def session_tables(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.md5("url").alias("key"), store.session_table("url").alias("session_table"))


@query(
    """SELECT conv_id, sha256(string_agg(l, chr(10) || chr(10) ORDER BY turn)) AS page_sha FROM (SELECT conv_id, turn, role || ': ' || regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS l FROM conversations) GROUP BY conv_id"""
)
def rendered_conversations(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(": ", "role", S.compact_text(F.col("text"))).alias("l"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "l"))), lambda s: s["l"])
    return c.groupBy("conv_id").agg(F.sha2(F.array_join(ordered, "\n\n"), 256).alias("page_sha"))


@query("WITH b AS (SELECT text, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, event_id, event_type FROM (SELECT event_type AS text, * FROM events)) SELECT event_id FROM b WHERE k > 2")
def own_bubbles(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("text"), F.lit("self").alias("sender_role"))
    sent = e.select("text").distinct().select(F.explode(F.array(F.lit(1), F.lit(2))).alias("event_id"), "text")
    return W.without_own_bubbles(e, sent, "text", "event_id").select("event_id")


@query("SELECT user_id, arg_min(event_type, event_id) AS result, min(event_id) AS finished FROM events WHERE value > 50 GROUP BY user_id")
def best_candidates(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", (F.col("value") > 50).alias("success"), F.col("event_type").alias("result"), F.col("event_id").alias("finished"))
    return W.best_candidates(e, "user_id")


from tidemark.plans import extended  # noqa: E402, F401  registers more queries
