"""Media of messages: what their bodies declare, what the indexes know of them, which files there are, and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import markup as M
from tidemark.functions import scalar as S
from tidemark.operators.bodies import TYPE_NAMES

#: Fixed values of the message format: the element that describes a kind, and kinds that have media.
ELEMENTS = {"image": "img", "emoji": "emoji", "video": "videomsg", "file": "appmsg"}
KINDS = ("image", "voice", "video", "emoji", "file")
#: What readers call the kinds, and what a gap means.
LABELS = {"image": "图片", "emoji": "表情包", "voice": "语音", "video": "视频", "file": "文件"}
GAPS = {
    "remote_not_requested": "本机无可用副本，未请求远端；不代表服务器已过期",
    "image_not_stored_locally": "本机未找到图片；不能区分未下载与已清理",
    "local_wxgf_conversion_unavailable": "本机已有缓存，当前程序尚不能完整解码",
}
GAP_ELSE = "本机缺失或暂不可读，具体原因见媒体清单"

_ATTRIBUTES = "_md5:string,_len:string,_length:string,_cdnurl:string"
_APP = "type:array<string>,title:array<string>,md5:array<string>,appattach:array<struct<md5:array<string>,emoticonmd5:array<string>,totallen:array<string>>>"
_NODES = f"img array<struct<{_ATTRIBUTES}>>, emoji array<struct<{_ATTRIBUTES}>>, videomsg array<struct<{_ATTRIBUTES}>>, appmsg array<struct<{_ATTRIBUTES},{_APP}>>"
_ROOT = f"{_ATTRIBUTES.replace(':', ' ').replace(',', ', ')}, {', '.join(x.replace(':', ' ', 1) for x in _APP.split(',', 3))}, {_NODES}, _corrupt string"


# Declared media --------------------------------------------------------------------------------------
def markup_of(body: Column) -> Column:
    """A body from its first ``<`` on, without NULs, if it is one well-formed element; else null."""
    xml = F.replace(F.substring(body, F.locate("<", body), F.char_length(body)), F.lit("\0"), F.lit(""))
    return F.when(F.locate("<", body) > 0, M.one_element(xml))


def _node(xml: Column, tag: str) -> Column:
    """The root if it is of that name, else its first child of that name."""
    doc = F.from_xml(xml, _ROOT, {"columnNameOfCorruptRecord": "_corrupt"})
    named = F.regexp_extract(F.regexp_replace(xml, r"^\s*<\?xml\s[^>]*\?>|(?s)<!--.*?-->", ""), r"^\s*<([^\s/>]+)", 1) == tag
    fields = [f.split(":")[0] for f in _ATTRIBUTES.split(",")]
    if tag == "appmsg":
        fields += ["type", "title", "md5", "appattach"]
    return F.when(named, F.struct(*[doc[f].alias(f) for f in fields])).otherwise(M.first(doc[tag]))


def media_kind(base: Column, payloads: Column) -> Column:
    """The kind of media that a message of a base type has; an app message has a file only if its subtype is 6."""
    is_file = F.exists(payloads, lambda p: F.coalesce(F.trim(M.first(_node(markup_of(p), "appmsg")["type"])) == "6", F.lit(False)))
    kind = F.coalesce(*[F.when(base == k, name) for k, name in TYPE_NAMES.items() if name in KINDS])
    return F.when(base == 49, F.when(is_file, "file")).otherwise(kind)


def declared_media(messages: DataFrame) -> DataFrame:
    """Adds ``kind`` and ``declared``, struct(md5, bytes, file_name, url), to messages with bodies, payloads, local_type and image_stem.

    A body counts if its element names 32 hexadecimal digits, or the message is an image with a stem of its own. All bodies
    that count must agree, without regard to case; a file is named by the app's attachment before the app itself.
    """
    rows = messages.withColumn("kind", media_kind(S.base_type(F.col("local_type")), F.col("payloads")))

    def described(body: Column) -> Column:
        xml = markup_of(body)
        app = _node(xml, "appmsg")
        attachment = M.first(app["appattach"])
        out = F.lit(None).cast("struct<md5:string,bytes:bigint,file_name:string,url:string>")

        def entry(md5: Column, size: Column, name: Column = F.lit(None), url: Column = F.lit(None)) -> Column:  # noqa: B008
            return F.struct(F.lower(F.coalesce(md5, F.lit(""))).alias("md5"), size.try_cast("bigint").alias("bytes"), name.cast("string").alias("file_name"), url.cast("string").alias("url"))

        for kind in ("image", "emoji", "video"):
            node = _node(xml, ELEMENTS[kind])
            own = F.when(node.isNotNull(), entry(node["_md5"], F.coalesce(node["_len"], node["_length"]), url=node["_cdnurl"]))
            if kind == "emoji":
                sticker = F.trim(M.first(app["type"])) == "8"
                own = F.coalesce(own, F.when(sticker, entry(M.first(attachment["emoticonmd5"]), M.first(attachment["totallen"]))))
            out = F.when(F.col("kind") == kind, own).otherwise(out)
        named = F.coalesce(F.nullif(M.first(attachment["md5"]), F.lit("")), M.first(app["md5"]))
        file = F.when(M.first(app["type"]) == "6", entry(named, M.first(attachment["totallen"]), M.first(app["title"])))
        return F.when(F.col("kind") == "file", file).otherwise(out)

    stem = F.coalesce((F.col("kind") == "image") & F.col("image_stem").isNotNull(), F.lit(False))
    usable = F.filter(F.transform("bodies", described), lambda d: d.isNotNull() & (d["md5"].rlike("^[0-9a-f]{32}$") | stem))
    agreed = F.size(F.array_distinct(F.transform(usable, lambda d: d["md5"]))) == 1
    return rows.withColumn("declared", F.when(agreed, F.get(usable, F.lit(0))))


# Indexes ---------------------------------------------------------------------------------------------
def resource_index(infos: DataFrame, chats: DataFrame, details: DataFrame) -> DataFrame:
    """Resources by session: infos (database, rowid, message_id, chat_id, message_local_id, message_svr_id, message_local_type) of known
    chats (database, rowid, user_name) with their details (database, rowid, message_id, resource_id, type, size), or without any."""
    i, c, d = infos.alias("i"), chats.alias("c"), details.alias("d")
    joined = i.join(c, (F.col("i.database") == F.col("c.database")) & (F.col("i.chat_id") == F.col("c.rowid")))
    joined = joined.join(d, (F.col("i.database") == F.col("d.database")) & (F.col("i.message_id") == F.col("d.message_id")), "left")
    return joined.select(
        "i.database", F.col("i.rowid").alias("info_rowid"), F.col("d.rowid").alias("detail_rowid"), "i.message_id", "i.chat_id", F.col("c.user_name").alias("session_id"),
        "i.message_local_id", "i.message_svr_id", "i.message_local_type", "d.resource_id", F.col("d.type").alias("resource_type"), "d.size",
    )


def voice_index(voices: DataFrame, names: DataFrame) -> DataFrame:
    """Voice rows with data by session: voices (database, rowid, chat_name_id, local_id, svr_id, create_time, voice_data), names (database, rowid, user_name).

    The data itself isn't carried, only its size."""
    v, n = voices.where("voice_data is not null").alias("v"), names.alias("n")
    return v.join(n, (F.col("v.database") == F.col("n.database")) & (F.col("v.chat_name_id") == F.col("n.rowid"))).select(
        "v.database", "v.rowid", F.col("v.chat_name_id").alias("chat_id"), F.col("n.user_name").alias("session_id"), "v.local_id",
        S.present_id(F.col("v.svr_id")).alias("server_id"), F.col("v.create_time").alias("create_time"), F.octet_length("v.voice_data").cast("bigint").alias("size"),
    )


def exact_resources(messages: DataFrame, index: DataFrame) -> DataFrame:
    """Each message (database, session_id, server_id, ...) with its resources, as an ordered array, and what the look-up proves.

    lookup: found; not_found, where the index was asked and has none; conflict, where rows under several chat ids of the session (stale
    aliases) disagree in message id, local id, server id or type, of which none is picked; unavailable for a message without server id.
    """
    shape = F.struct("message_id", "message_local_id", "message_svr_id", "message_local_type")
    item = F.struct("info_rowid", F.coalesce("detail_rowid", F.lit(0)).alias("_d"), "detail_rowid", "message_local_id", "resource_id", "resource_type", "size")
    grouped = index.where(S.present_id(F.col("message_svr_id")).isNotNull()).groupBy(F.col("database").alias("_db"), F.col("session_id").alias("_session"), S.present_id(F.col("message_svr_id")).alias("_server")).agg(
        (F.min(shape).eqNullSafe(F.max(shape))).alias("_same"), F.transform(F.sort_array(F.collect_list(item)), lambda x: x.dropFields("_d")).alias("_items")
    )  # the resources of one message
    own = S.present_id(F.col("server_id"))
    joined = messages.join(grouped, (F.col("database") == F.col("_db")) & (F.col("session_id") == F.col("_session")) & (own == F.col("_server")), "left")
    lookup = F.when(own.isNull(), "unavailable").when(F.col("_items").isNull(), "not_found").when(F.col("_same"), "found").otherwise("conflict")
    return joined.withColumn("lookup", lookup).withColumn("resources", F.when(F.col("lookup") == "found", F.col("_items"))).drop("_db", "_session", "_server", "_same", "_items")


def exact_voices(messages: DataFrame, index: DataFrame) -> DataFrame:
    """(key columns of messages, voices) by server id; a message that has none there by time and local id, among rows without a server id.

    messages: (message_key, session_id, server_id, local_id, create_time)."""
    some = index.where("size > 0")
    i = some.select(*[F.col(c).alias(f"_{c}") for c in some.columns])
    m = messages.withColumn("_own", S.present_id(F.col("server_id")))
    item = F.struct("_database", "_chat_id", "_rowid", "_size")
    by_server = m.join(i, (F.col("session_id") == F.col("_session_id")) & (F.col("_own") == F.col("_server_id")))
    rest = m.where("_own is not null").join(by_server.select("message_key").distinct(), "message_key", "left_anti")
    timed = S.sender_key(F.col("local_id")).isNotNull() & S.sender_key(F.col("create_time")).isNotNull()
    by_time = rest.where(timed).join(i, (F.col("session_id") == F.col("_session_id")) & F.col("_server_id").isNull() & (F.col("local_id") == F.col("_local_id")) & (F.col("create_time") == F.col("_create_time")))
    hits = by_server.select("message_key", item.alias("v"), F.lit("server").alias("by")).unionByName(by_time.select("message_key", item.alias("v"), F.lit("time").alias("by")))
    found = hits.groupBy("message_key").agg(F.transform(F.sort_array(F.collect_list("v")), lambda x: F.struct(*[x[f"_{c}"].alias(c) for c in ("database", "chat_id", "rowid", "size")])).alias("voices"), F.max("by").alias("voice_by"))
    return messages.join(found, "message_key", "left")


def hardlink_paths(links: DataFrame, dirs: DataFrame, files: DataFrame) -> DataFrame:
    """(md5, kind, path, quality, bytes, rank) of stored copies: links (md5, kind, file_name, dir1, dir2, modify_time), both
    directories from dirs (rowid, username) where they are known, and of the places that follow those that ``files`` (path, length), relative to the root, has.

    Newer links come first; rank counts from 1 for each md5 and kind.
    """
    one, two = dirs.select(F.col("rowid").alias("_r1"), F.col("username").alias("_u1")), dirs.select(F.col("rowid").alias("_r2"), F.col("username").alias("_u2"))
    rows = links.where("file_name is not null and file_name <> ''").join(one, F.col("dir1") == F.col("_r1"), "left").join(two, F.col("dir2") == F.col("_r2"), "left")
    known = F.filter(F.array("_u1", "_u2"), lambda d: d.isNotNull() & (d != ""))
    below = F.array_join(known, "/")
    image = F.col("kind") == "image"

    def folder(*parts: Column) -> Column:
        return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/")

    months = F.transform(F.filter(known, lambda d: d.rlike(r"^\d{4}-\d{2}$")), lambda d: F.concat(F.lit("msg/"), F.col("kind"), F.lit("/"), d))
    bases = F.when(image, F.array(folder(F.lit("msg/attach"), below, F.lit("Img")))).otherwise(F.concat(F.array(folder(F.concat(F.lit("msg/"), F.col("kind")), below)), months))
    stem = F.regexp_replace("file_name", r"(?i)(?:_[ht])?\.dat$", "")

    def named(name: Column, quality: str) -> Column:
        return F.struct(name.alias("name"), F.lit(quality).alias("quality"))

    cached = F.array(named(F.concat(stem, F.lit("_h.dat")), "original"), named(F.concat(stem, F.lit(".dat")), "original"), named(F.concat(stem, F.lit("_t.dat")), "thumbnail"))
    bare = F.array(named(F.col("file_name"), "original"), named(F.concat("file_name", F.lit(".dat")), "original"))
    single = F.array(named(F.col("file_name"), "original"))
    names = F.when(image & stem.rlike("^[0-9a-fA-F]{32}$"), cached).when(image & ~F.col("file_name").rlike(r"[^.]\.[^.]*$"), bare).otherwise(single)
    spread = rows.select("md5", "kind", "modify_time", F.posexplode(bases).alias("_b", "base"), names.alias("names")).select("*", F.posexplode("names").alias("_n", "n"))
    candidate = spread.withColumn("path", F.concat("base", F.lit("/"), "n.name")).where(~F.col("path").rlike(r"(^|/)\.\.(/|$)"))
    there = candidate.join(files.select(F.col("path").alias("_path"), F.col("length").alias("bytes")), F.col("path") == F.col("_path"))
    first = there.groupBy("md5", "kind", "path").agg(F.min_by(F.struct(F.col("n.quality").alias("quality"), "bytes", "modify_time", "_b", "_n"), F.struct(-F.coalesce("modify_time", F.lit(0)), "_b", "_n")).alias("f"))
    order = Window.partitionBy("md5", "kind").orderBy(F.col("f.modify_time").desc_nulls_last(), "f._b", "f._n", "path")
    return first.select("md5", "kind", "path", "f.quality", "f.bytes", F.row_number().over(order).alias("rank"))


# States ----------------------------------------------------------------------------------------------
def media_state(items: DataFrame) -> DataFrame:
    """Adds what can be done with an item: openable, materializable, requires_network, open_status, processing_state, resolution_gap, source.

    items: kind, has_declared (its body describes it), path and quality (of the best stored copy), cached (a cache has its data), opened (its data is at hand), native_url.
    """
    kind, stored = F.col("kind"), F.col("path").isNotNull() & F.col("has_declared")
    filed = kind.isin("image", "video", "file") & F.col("has_declared")
    step = (
        F.when(filed & stored, "stored")
        .when((kind == "image") & F.col("has_declared"), "image_missing")
        .when(F.coalesce(F.col("opened"), F.lit(False)), "opened")
        .when((kind == "emoji") & F.col("has_declared") & F.coalesce(F.col("cached"), F.lit(False)), "cached")
        .when((kind == "emoji") & F.col("has_declared") & F.coalesce(F.col("native_url"), F.lit(False)), "remote")
        .otherwise("missing")
    )
    thumb = (step == "stored") & (kind == "image") & (F.col("quality") == "thumbnail")
    later = step.isin("stored", "cached", "remote")
    gap = F.when(thumb, "only_thumbnail_local").when(later, "media_materialization_required").when(step == "image_missing", "image_not_stored_locally").when(step == "missing", "native_media_missing_or_unreadable")
    return items.withColumns(
        {
            "openable": F.when(step == "opened", True).when(later, F.lit(None).cast("boolean")).otherwise(False),
            "materializable": F.when(later, True),
            "requires_network": F.when(later, step == "remote"),
            "open_status": F.when(step == "opened", "openable").when(later, "not_requested").otherwise("not_openable"),
            "processing_state": F.when(step == "opened", "available").otherwise("unprocessed"),
            "resolution_gap": gap,
            "materialization_source": F.when(step.isin("stored", "cached", "opened"), "local"),
        }
    )


def gap_reason(item: Column) -> Column:
    """Why an item (export_status, export_gap, quality, requires_network, resolution_gap) isn't there as it should be; null if it is."""
    exported = F.when(item["quality"] == "thumbnail", "only_thumbnail_local")
    rest = F.coalesce(F.nullif(item["export_gap"], F.lit("")), F.when(item["requires_network"], "remote_not_requested"), F.nullif(item["resolution_gap"], F.lit("")), F.lit("local_media_unavailable"))
    return F.when(F.coalesce(item["export_status"] == "available_local", F.lit(False)), exported).otherwise(rest)


ITEM = "kind string, position int, locator string, path string, derived_path string, quality string, frames int, export_status string, export_gap string, requires_network boolean, resolution_gap string"


def media_lists(items: DataFrame, key: str) -> DataFrame:
    """(key, media): each message's items, columns as ``ITEM`` names them, as one array in their order."""
    names = [x.split(" ")[0] for x in ITEM.split(", ")]
    s = F.struct(F.col("position").alias("_p"), *[F.col(n).cast(x.split(" ")[1]).alias(n) for n, x in zip(names, ITEM.split(", "), strict=True)])
    return items.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(s)), lambda x: x.dropFields("_p")).alias("media"))


def media_lines(media: Column, limit: int | None = None) -> Column:
    """The lines that stand for a message's media in a text, those past ``limit`` as a count."""
    shown = media if limit is None else F.slice(media, 1, limit)

    def lines(m: Column) -> Column:
        label = F.coalesce(*[F.when(m["kind"] == k, v) for k, v in LABELS.items()], F.lit("媒体"))
        path = F.replace(F.coalesce(F.when(m["kind"] == "voice", F.nullif(m["derived_path"], F.lit(""))), F.nullif(m["path"], F.lit(""))), F.lit("\\"), F.lit("/"))
        picture = m["kind"].isin("image", "emoji")
        place = F.concat(F.lit("]("), path, F.lit(")"))
        named = F.when(picture, F.concat(F.lit("  !["), label, place)).when(m["kind"] == "voice", F.concat(F.lit("  [语音（可播放，按需转写）"), place)).otherwise(F.concat(F.lit("  ["), label, place))
        moving = F.when(picture & (m["frames"] > 1), F.concat(F.lit("  [动图，共 "), m["frames"].cast("string"), F.lit(" 帧；判断动作时需查看连续帧，不能只看首帧。]")))
        small = F.when(m["quality"] == "thumbnail", F.lit("  [仅保留缩略图，正常图片尚未保留；细节不完整。]"))
        reason = gap_reason(m)
        detail = F.coalesce(*[F.when(reason == k, v) for k, v in GAPS.items()], F.lit(GAP_ELSE))
        return F.when(path.isNotNull(), F.array_compact(F.array(named, moving, small))).otherwise(F.array(F.concat(F.lit("  ["), label, F.lit("未保存："), detail, F.lit("]"))))

    own = F.flatten(F.transform(F.coalesce(shown, F.array().cast(f"array<struct<{', '.join(x.replace(' ', ':') for x in ITEM.split(', '))}>>")), lines))
    if limit is None:
        return own
    more = F.size(media) - limit
    return F.concat(own, F.when(more > 0, F.array(F.concat(F.lit("  [本条另有 "), more.cast("string"), F.lit(" 个媒体项；完整清单见 context.md]")))).otherwise(F.array().cast("array<string>")))


def without_places(media: Column) -> Column:
    """Items without their locators, for comparing copies of one message from several shards."""
    return F.transform(media, lambda m: m.dropFields("locator"))
