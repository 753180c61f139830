"""Queries of parsed bodies, public messages, media relations, distinct pages, and of filters and joins that stand alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import archive as A
from tidemark.operators import bodies as B
from tidemark.operators import directory as D
from tidemark.operators import media as X
from tidemark.operators import messages as M
from tidemark.plans.registry import EV, UNTIL, events, query, t

EDGES = r"'^[\s\p{Z}]+|[\s\p{Z}]+$'"
READABLE = f"nullif(regexp_replace(text, {EDGES}, '', 'g'), '')"


@query(
    f"""SELECT conv_id, turn, CASE turn % 8 WHEN 0 THEN {READABLE}
      WHEN 1 THEN '位置分享：' || role || ' & ' || conv_id
      WHEN 4 THEN role
      WHEN 5 THEN 'hi ' || conv_id || ' & ' || role || ' z'
      WHEN 7 THEN '消息已撤回' END AS body FROM conversations"""
)
def parsed_bodies(spark, sf_dir):
    """Bodies with numeric entities, single quotes, CDATA, children, nesting and broken markup, around the tables' whole texts."""
    turn, who, at, text = F.col("turn"), F.col("role"), F.col("conv_id").cast("string"), S.html_escape(F.col("text"))
    head, tail = '<sysmsg type="sysmsgtemplate"><sysmsgtemplate><content_template>', "</content_template></sysmsgtemplate></sysmsg>"
    made = [
        (10000, [head, "<plain>", text, "</plain>", tail]),
        (48, ["<location label='", who, " &#38; ", at, "'/>"]),
        (48, ['<msg><deep><location label="', who, '"/></deep></msg>']),
        (10000, ['<sysmsg type="sysmsgtemplate"><plain>', text]),
        (10000, [head, "<template>", who, " <b>x</b> tail</template>", tail]),
        (10000, [head, "<template>hi <![CDATA[", at, " & ", who, "]]> z</template>", tail]),
        (10000, ["<sysmsg><foo><revokemsg/>", text, "</foo></sysmsg>"]),
        (10000, ["<sysmsg><revokemsg><content>", text, "</content></revokemsg></sysmsg>"]),
    ]
    content, kind = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, (n, parts) in enumerate(made):
        body = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        content, kind = F.when(turn % 8 == k, body).otherwise(content), F.when(turn % 8 == k, n).otherwise(kind)
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", content.alias("content"), kind.alias("kind"))
    return rows.select("conv_id", "turn", F.coalesce(S.system_text(F.when(F.col("kind") == 10000, F.col("content"))), S.location_text(F.when(F.col("kind") == 48, F.col("content")))).alias("body"))


@query(
    f"""SELECT conv_id, turn, CASE WHEN turn % 6 = 5 THEN '0' ELSE CAST(conv_id * 1000 + turn AS VARCHAR) END AS server_id,
      CASE WHEN turn % 7 = 6 THEN 'unknown' WHEN turn % 5 = 4 THEN 'system' ELSE 'text' END AS type,
      CASE WHEN turn % 7 <> 6 THEN {READABLE} END AS content,
      CASE WHEN conv_id % 4 = 0 THEN 'sender_mapping_unresolved' END AS sender_gap,
      CASE WHEN turn % 7 = 6 THEN 'message_type_unsupported' WHEN {READABLE} IS NULL THEN 'message_content_unparsed' END AS content_gap,
      turn % 6 = 5 OR conv_id * 1000 + turn = 0 AS by_shard FROM conversations"""
)
def public_messages(spark, sf_dir):
    """Stored rows to public messages: the body from either content column, types, gaps and identities."""
    turn, raw, none = F.col("turn"), F.col("text").cast("binary"), F.lit(None).cast("binary")
    rows = t(spark, sf_dir, "conversations").select(
        "conv_id", turn.alias("local_id"), F.lit("shard").alias("shard"), F.col("conv_id").cast("string").alias("session_id"),
        F.when(turn % 6 == 5, 0).otherwise(F.col("conv_id") * 1000 + turn).alias("server_id"),
        F.when(turn % 7 == 6, 99).when(turn % 5 == 4, 10000).otherwise(1).cast("bigint").alias("local_type"),
        F.lit(1).alias("sort_seq"), turn.alias("create_time"), F.lit(4).alias("status"),
        F.when(turn % 3 != 2, raw).alias("message_content"), F.when(turn % 3 == 2, raw).alias("compress_content"),
        none.alias("source"), none.alias("packed_info_data"), F.when(turn % 2 == 0, "self").otherwise("other").alias("sender_role"),
        S.direction(F.when(turn % 2 == 0, "self").otherwise("other")).alias("direction"), (turn % 2 == 0).alias("is_send"), F.when(F.col("conv_id") % 4 != 0, F.col("role")).alias("sender_username"),
    )
    out = B.public_messages(rows.withColumn("local_id", turn_key(F.col("conv_id"), F.col("local_id"))))
    keys = F.regexp_extract
    local = F.col("local_id")
    return out.select(
        keys(local, "^(.*):", 1).cast("bigint").alias("conv_id"), keys(local, ":(.*)$", 1).cast("bigint").alias("turn"), "server_id", "type", "content", "sender_gap", "content_gap", F.col("shard_local_identity").isNotNull().alias("by_shard")
    )


def turn_key(conv, turn):
    return F.concat_ws(":", conv.cast("string"), turn.cast("string"))


@query(
    f"""WITH {EV}, k AS (SELECT DISTINCT event_id, create_time FROM e ORDER BY create_time DESC, CAST(event_id AS VARCHAR) DESC LIMIT 51)
    SELECT event_id, create_time, (SELECT count(*) FROM k) > 50 AS has_more FROM k ORDER BY create_time DESC, CAST(event_id AS VARCHAR) DESC LIMIT 50"""
)
def distinct_newest(spark, sf_dir):
    """The newest identities of two overlapping shards, each once."""
    e = events(spark, sf_dir).select("event_id", "create_time", F.lit(0).alias("sort_seq"), F.lit("server").alias("id_kind"), "id_value", "event_type")
    both = e.unionByName(e.where(F.hash("event_type") % 2 == 0))
    return M.distinct_page(both, 50, "event_id", F.col("event_type")).select("event_id", "create_time", "has_more")


@query(
    """WITH m AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN -o_orderkey ELSE o_orderkey END AS svr FROM orders JOIN customer ON c_custkey = o_custkey),
    d AS (SELECT l_orderkey, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS size FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, CASE WHEN svr = 0 THEN 'unavailable' WHEN svr < 0 THEN 'not_found' WHEN o_orderkey % 8 = 1 THEN 'conflict' ELSE 'found' END AS lookup,
      CAST(CASE WHEN svr > 0 AND o_orderkey % 8 <> 1 THEN coalesce(n, 1) END AS BIGINT) AS resources, CAST(CASE WHEN svr > 0 AND o_orderkey % 8 <> 1 THEN coalesce(size, 0) END AS BIGINT) AS size
    FROM m LEFT JOIN d ON l_orderkey = o_orderkey"""
)
def resource_lookup(spark, sf_dir):
    """Orders as messages, their lines as resources, customers as chats; some messages are known under two identities that disagree."""
    o, c, li = t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer"), t(spark, sf_dir, "lineitem")
    key = F.col("o_orderkey")
    info = o.select(F.lit("r").alias("database"), key.alias("rowid"), key.alias("message_id"), F.col("o_custkey").alias("chat_id"), (key % 1000).alias("message_local_id"), key.alias("message_svr_id"), F.lit(3).alias("message_local_type"))
    stale = info.where(F.col("message_id") % 8 == 1).withColumn("message_local_id", F.lit(-1).cast("bigint"))
    chats = c.select(F.lit("r").alias("database"), F.col("c_custkey").alias("rowid"), F.col("c_name").alias("user_name"))
    details = li.select(F.lit("r").alias("database"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rowid"), F.col("l_orderkey").alias("message_id"), F.col("l_partkey").alias("resource_id"), F.col("l_linenumber").alias("type"), F.col("l_quantity").cast("bigint").alias("size"))
    index = X.resource_index(info.unionByName(stale), chats, details)
    wanted = F.when(key % 5 == 0, 0).when(key % 11 == 0, -key).otherwise(key)
    messages = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.lit("r").alias("database"), F.col("c_name").alias("session_id"), wanted.alias("server_id"))
    found = X.exact_resources(messages, index)
    size = F.aggregate("resources", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["size"], F.lit(0)))
    return found.select("o_orderkey", "lookup", F.when(F.col("resources").isNotNull(), F.size("resources")).cast("bigint").alias("resources"), size.alias("size"))


@query(
    f"""WITH {EV} SELECT event_id, CAST(CASE WHEN props IS NOT NULL AND octet_length(encode(props)) > 0 AND event_id % 10 <> 0 AND event_id <> 0 THEN octet_length(encode(props)) END AS BIGINT) AS size,
      CASE WHEN props IS NULL OR octet_length(encode(props)) = 0 OR event_id % 10 = 0 OR event_id = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'time' ELSE 'server' END AS voice_by FROM e"""
)
def voice_lookup(spark, sf_dir):
    """Events as voice messages and as voice rows, of which some have no server id and are met by time and local id."""
    e = events(spark, sf_dir)
    key = F.col("event_id")
    data = F.when(key % 10 != 0, F.col("props").cast("binary"))
    voices = e.select(F.lit("v").alias("database"), key.alias("rowid"), F.col("user_id").alias("chat_name_id"), key.alias("local_id"), F.when(key % 3 == 0, 0).otherwise(key).alias("svr_id"), "create_time", data.alias("voice_data"))
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    names = e.select(F.lit("v").alias("database"), F.col("user_id").alias("rowid"), user.alias("user_name")).distinct()
    messages = e.select(key.alias("message_key"), user.alias("session_id"), key.alias("server_id"), key.alias("local_id"), "create_time")
    found = X.exact_voices(messages, X.voice_index(voices, names))
    return found.select(F.col("message_key").alias("event_id"), F.get("voices", F.lit(0))["size"].alias("size"), "voice_by")


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'emoji' WHEN 2 THEN 'video' ELSE 'file' END AS kind,
      CASE WHEN doc_id % 3 <> 0 THEN md5(text) END AS md5, CAST(CASE WHEN doc_id % 3 <> 0 THEN n_chars END AS BIGINT) AS bytes, CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 = 3 THEN source || ' & co' END AS file_name FROM documents WHERE text IS NOT NULL"""
)
def declared_media(spark, sf_dir):
    """What bodies declare of their media, where two bodies of a message agree or don't."""
    key, n = F.col("doc_id"), F.col("n_chars").cast("string")

    def body(md5):
        def element(name, size):
            return F.concat(F.lit(f"x:\n<msg><{name} {size}='"), n, F.lit("' md5=\""), md5, F.lit(f"\"><a/></{name}></msg>"))

        sticker = F.concat(F.lit("<msg><appmsg><type> 8 </type><appattach><emoticonmd5>"), md5, F.lit("</emoticonmd5><totallen>"), n, F.lit("</totallen></appattach></appmsg></msg>"))
        file = F.concat(F.lit("<?xml version='1.0'?><appmsg><title>"), F.col("source"), F.lit(" &#x26; co</title><type>6</type><appattach><totallen>"), n, F.lit("</totallen><md5>"), md5, F.lit("</md5></appattach></appmsg>"))
        return F.when(key % 4 == 0, element("img", "length")).when(key % 8 == 1, sticker).when(key % 4 == 1, element("emoji", "len")).when(key % 4 == 2, element("videomsg", "length")).otherwise(file)

    other = F.when(key % 3 == 0, F.md5(F.concat("text", F.lit("x")).cast("binary"))).otherwise(F.upper(F.md5(F.col("text").cast("binary"))))
    rows = t(spark, sf_dir, "documents").where("text is not null").withColumn("bodies", F.array(body(F.md5(F.col("text").cast("binary"))), F.lit("<broken"), body(other)))
    rows = rows.withColumns({"payloads": F.col("bodies"), "image_stem": F.lit(None).cast("string"), "local_type": F.when(key % 4 == 0, 3).when(key % 4 == 1, 47).when(key % 4 == 2, 43).otherwise(49)})
    return X.declared_media(rows).select("doc_id", "kind", "declared.md5", "declared.bytes", "declared.file_name")


@query(
    """WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'emoji' WHEN 2 THEN 'video' ELSE 'voice' END AS kind, n_chars % 5 <> 0 AS has, n_chars % 3 <> 0 AS stored, n_chars % 2 = 0 AS thumb, n_chars % 7 = 0 AS opened, n_chars % 4 = 0 AS cached, n_chars % 11 < 5 AS url FROM documents),
    s AS (SELECT *, CASE WHEN has AND stored AND kind IN ('image', 'video') THEN 'stored' WHEN has AND kind = 'image' THEN 'absent' WHEN opened THEN 'opened' WHEN has AND kind = 'emoji' AND cached THEN 'cached' WHEN has AND kind = 'emoji' AND url THEN 'remote' ELSE 'missing' END AS step FROM d)
    SELECT doc_id, CASE step WHEN 'opened' THEN 'openable' WHEN 'absent' THEN 'not_openable' WHEN 'missing' THEN 'not_openable' ELSE 'not_requested' END AS open_status, CASE WHEN step IN ('stored', 'cached', 'remote') THEN step = 'remote' END AS requires_network,
      CASE WHEN step = 'stored' AND kind = 'image' AND thumb THEN 'only_thumbnail_local' WHEN step IN ('stored', 'cached', 'remote') THEN 'media_materialization_required' WHEN step = 'absent' THEN 'image_not_stored_locally' WHEN step = 'missing' THEN 'native_media_missing_or_unreadable' END AS resolution_gap FROM s"""
)
def media_states(spark, sf_dir):
    """The state of each item by what its body, its stored copies and the caches have."""
    key, n = F.col("doc_id"), F.col("n_chars")
    items = t(spark, sf_dir, "documents").select(
        "doc_id", F.when(key % 4 == 0, "image").when(key % 4 == 1, "emoji").when(key % 4 == 2, "video").otherwise("voice").alias("kind"), (n % 5 != 0).alias("has_declared"),
        F.when(n % 3 != 0, "p").alias("path"), F.when(n % 2 == 0, "thumbnail").otherwise("original").alias("quality"), (n % 7 == 0).alias("opened"), (n % 4 == 0).alias("cached"), (n % 11 < 5).alias("native_url"),
    )
    return X.media_state(items).select("doc_id", "open_status", "requires_network", "resolution_gap")


@query(
    """WITH i AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN '图片' WHEN 1 THEN '视频' ELSE '文件' END AS label, l_linenumber % 3 = 0 AS pic, l_quantity > 25 AS there, l_partkey, l_quantity > 40 AS thumb, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE WHEN l_quantity > 25 THEN CAST(l_partkey AS VARCHAR) END NULLS FIRST, l_quantity > 40) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    l AS (SELECT l_orderkey, k, n, CASE WHEN there THEN CASE WHEN pic THEN '  ![' ELSE '  [' END || label || '](media/' || l_partkey || ')' || CASE WHEN thumb THEN chr(10) || '  [仅保留缩略图，正常图片尚未保留；细节不完整。]' ELSE '' END ELSE '  [' || label || '未保存：本机无可用副本，未请求远端；不代表服务器已过期]' END AS line FROM i)
    SELECT l_orderkey, string_agg(line, chr(10) ORDER BY k) FILTER (WHERE k <= 3) || CASE WHEN max(n) > 3 THEN chr(10) || '  [本条另有 ' || (max(n) - 3) || ' 个媒体项；完整清单见 context.md]' ELSE '' END AS lines FROM l GROUP BY l_orderkey"""
)
def media_lines(spark, sf_dir):
    """The first three items of each message as lines, and how many more there are."""
    q, none = F.col("l_quantity"), F.lit(None)
    items = t(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(F.col("l_linenumber") % 3 == 0, "image").when(F.col("l_linenumber") % 3 == 1, "video").otherwise("file").alias("kind"), F.col("l_linenumber").alias("position"), none.alias("locator"),
        F.when(q > 25, F.concat(F.lit("media\\"), F.col("l_partkey").cast("string"))).alias("path"), none.alias("derived_path"), F.when(q > 40, "thumbnail").alias("quality"), F.lit(1).alias("frames"),
        F.when(q > 25, "available_local").alias("export_status"), F.lit("").alias("export_gap"), F.lit(True).alias("requires_network"), none.alias("resolution_gap"),
    )
    return X.media_lists(items, "l_orderkey").select("l_orderkey", F.array_join(X.media_lines(F.col("media"), 3), "\n").alias("lines"))


@query(
    """WITH d AS (SELECT md5(text) AS md5, source, lang, doc_id, n_chars FROM documents WHERE text IS NOT NULL), f AS (SELECT md5, max(n_chars) AS newest FROM d GROUP BY md5)
    SELECT md5, 'msg/attach/' || min(lang) || '/Img/' || md5 || '_h.dat' AS path, 'original' AS quality, CAST(length(md5) AS BIGINT) AS bytes FROM d WHERE lang IS NOT NULL GROUP BY md5 HAVING min(lang) = max(lang)"""
)
def stored_copies(spark, sf_dir):
    """Links of pictures to folders, met with the files that are there; the second folder is unknown."""
    d = t(spark, sf_dir, "documents").where("text is not null and lang is not null").withColumn("md5", F.md5(F.col("text").cast("binary")))
    dirs = d.select("lang").distinct().select(F.crc32(F.col("lang").cast("binary")).alias("rowid"), F.col("lang").alias("username"))
    links = d.select("md5", F.lit("image").alias("kind"), F.concat("md5", F.lit("_t.dat")).alias("file_name"), F.crc32(F.col("lang").cast("binary")).alias("dir1"), F.lit(-1).cast("bigint").alias("dir2"), F.col("n_chars").alias("modify_time"))
    one = d.groupBy("md5").agg(F.min("lang").alias("a"), F.max("lang").alias("b")).where("a = b")
    files = one.select(F.concat(F.lit("msg/attach/"), "a", F.lit("/Img/"), "md5", F.lit("_h.dat")).alias("path"), F.length("md5").cast("bigint").alias("length"))
    return X.hardlink_paths(links, dirs, files).where("rank = 1").select("md5", "path", "quality", "bytes")


@query(
    f"""SELECT CASE WHEN page_id % 10 < 2 THEN CAST(page_id AS VARCHAR) ELSE 'p' || page_id END AS moment_id, CASE WHEN page_id % 10 >= 2 THEN url END AS author, CASE WHEN page_id % 10 >= 1 THEN 'n & ' || page_id END AS nickname,
      CASE WHEN page_id % 10 >= 2 AND page_id % 3 <> 0 THEN page_id * 100 END AS created, CASE WHEN page_id % 10 >= 2 THEN {READABLE.replace('text', 'html')} END AS text,
      CASE WHEN page_id % 10 >= 2 THEN url || '|' ELSE '' END AS urls, CASE WHEN page_id % 10 >= 2 THEN md5(url) || '|none' ELSE '' END AS sums,
      CASE page_id % 10 WHEN 0 THEN 'moment_xml_unreadable' WHEN 1 THEN 'moment_timeline_missing' END AS gap FROM pages"""
)
def feed_posts(spark, sf_dir):
    """Pages as feed posts: XML around their whole texts, some of it broken, some without a post."""
    key, url = F.col("page_id"), S.html_escape(F.col("url"))
    post = F.concat(
        F.lit("<TimelineObject><id>p"), key.cast("string"), F.lit("</id><username>"), url, F.lit("</username><createTime> "), F.when(key % 3 != 0, key * 100).otherwise(0).cast("string"), F.lit(" </createTime><contentDesc>"),
        S.html_escape(F.col("html")), F.lit("</contentDesc><ContentObject><type>1</type><mediaList><media><url type='1' md5='"), F.md5(F.col("url").cast("binary")), F.lit("'>"), url, F.lit("</url></media><media><id>2</id></media></mediaList></ContentObject></TimelineObject>"),
    )
    nick = F.concat(F.lit("<LocalExtraInfo><nickname>n &#38; "), key.cast("string"), F.lit("</nickname></LocalExtraInfo>"))
    body = F.concat(F.lit("<SnsDataItem>"), F.when(key % 10 == 0, F.lit("<open>")).when(key % 10 == 1, F.lit("")).otherwise(post), nick, F.lit("</SnsDataItem>"))
    rows = t(spark, sf_dir, "pages").select(key.alias("tid"), F.lit("owner").alias("user_name"), body.alias("content"))
    sums = F.array_join(F.transform("media_md5", lambda m: F.coalesce(m, F.lit("none"))), "|")
    return D.moments(rows).select("moment_id", "author", "nickname", "created", "text", F.array_join("media_urls", "|").alias("urls"), sums.alias("sums"), "gap")


# Filters and joins that stand alone ---------------------------------------------------------------------
@query(f"WITH {EV} SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN create_time END AS create_time FROM e WHERE event_id % 3 = 0 OR create_time <= {UNTIL}")
def until_or_undated(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("create_time")).alias("create_time"))
    return rows.where(M.until_or_undated("create_time", UNTIL))


@query("SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 1")
def own_or_unknown(spark, sf_dir):
    role = F.when(F.col("turn") % 3 == 0, "self").when(F.col("turn") % 3 == 1, "other").otherwise("unknown")
    return t(spark, sf_dir, "conversations").withColumn("sender_role", role).where(M.self_or_unknown("sender_role")).select("conv_id", "turn")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def picked_by_id(spark, sf_dir):
    wanted = t(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey")
    return M.by_ids(t(spark, sf_dir, "orders"), wanted, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey AS sender_id, min(o_orderstatus) AS user_name FROM orders GROUP BY o_custkey HAVING min(o_orderstatus) = max(o_orderstatus)")
def unambiguous_senders(spark, sf_dir):
    return D.unambiguous_ids(t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sender_id"), F.col("o_orderstatus").alias("user_name")))


@query(
    """WITH r AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'self' WHEN n_chars % 3 = 1 THEN 'other' ELSE 'system' END AS role FROM documents)
    SELECT doc_id, CASE WHEN role <> 'system' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) THEN 'unknown' ELSE role END AS sender_role FROM r"""
)
def downgraded_attribution(spark, sf_dir):
    role = F.when(F.col("n_chars") % 3 == 0, "self").when(F.col("n_chars") % 3 == 1, "other").otherwise("system")
    rows = t(spark, sf_dir, "documents").select("doc_id", role.alias("sender_role"), F.col("source").alias("sender_username"))
    return A.downgraded(rows, t(spark, sf_dir, "labels"), "doc_id").select("doc_id", "sender_role")


@query(
    f"""WITH {EV}, m AS (SELECT event_id, user_id % 3 AS shard, CASE WHEN event_id % 4 = 0 AND user_id % 3 <> 1 THEN 5 ELSE user_id END AS sender, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 0 ELSE 9 END AS status FROM e),
    c AS (SELECT shard, CASE WHEN min(sender) = max(sender) THEN min(sender) END AS own FROM m WHERE status = 2 AND sender > 0 GROUP BY shard)
    SELECT event_id, CASE WHEN status = 2 THEN 'self' WHEN status = 4 THEN 'other' WHEN status = 0 AND own IS NOT NULL AND sender > 0 THEN CASE WHEN sender = own THEN 'self' ELSE 'other' END ELSE 'unknown' END AS sender_role
    FROM m LEFT JOIN c USING (shard)"""
)
def sender_roles(spark, sf_dir):
    """Roles by status, and by the one sender that a shard's outgoing rows have; a shard with several proves nothing."""
    key, user = F.col("event_id"), F.col("user_id")
    status = F.when(key % 4 == 0, 2).when(key % 4 == 1, 4).when(key % 4 == 2, 0).otherwise(9)
    sender = F.when((key % 4 == 0) & (user % 3 != 1), 5).otherwise(user)
    rows = events(spark, sf_dir).select("event_id", (user % 3).alias("shard"), F.lit("s").alias("session_id"), F.lit(1).cast("bigint").alias("local_type"), status.alias("status"), sender.cast("bigint").alias("real_sender_id"))
    names = rows.select("shard", F.col("real_sender_id").alias("sender_id"), F.concat(F.lit("u"), F.col("real_sender_id").cast("string")).alias("user_name")).distinct()
    return M.with_roles(rows, names, None).select("event_id", "sender_role")


@query(
    r"""SELECT doc_id, '> ' || source || '：' || CASE WHEN length(flat) > 240 THEN substr(flat, 1, 239) || '…' ELSE flat END AS line
    FROM (SELECT doc_id, source, regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g') AS flat FROM documents)"""
)
def quote_lines(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", S.quote_line(F.col("source"), F.col("text")).alias("line"))


@query("SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages")
def escaped_pages(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.sha2(S.html_escape(F.col("html")), 256).alias("escaped"))


@query(r"SELECT c_custkey, regexp_replace(c_name || CASE WHEN c_custkey % 2 = 0 THEN '_1aF' || (c_custkey % 10) ELSE '' END, '^(.+)_[0-9a-fA-F]{4}$', '\1') AS native_id FROM customer")
def storage_names(spark, sf_dir):
    named = F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("_1aF"), (F.col("c_custkey") % 10).cast("string"))).otherwise(""))
    return t(spark, sf_dir, "customer").select("c_custkey", S.without_storage_suffix(named).alias("native_id"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR)) AS r FROM orders) WHERE r = 1")
def largest_archives(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderkey").cast("string").alias("path"))
    return A.largest_archive(o, "o_custkey", "o_totalprice").drop("path")


@query(
    """SELECT l_orderkey, l_partkey, l_shipdate, CASE WHEN l_shipdate IS NOT NULL THEN rank() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate) END AS nth
    FROM (SELECT l_orderkey, min(l_partkey) AS l_partkey, l_shipdate FROM lineitem GROUP BY l_orderkey, l_shipdate)"""
)
def completion_order(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_shipdate").agg(F.min("l_partkey").alias("l_partkey"))
    return A.by_completion(rows, "l_orderkey", "l_shipdate").withColumn("nth", F.col("nth").cast("bigint"))
