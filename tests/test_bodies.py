"""Parsed bodies, public messages and media relations on rows made for their edges."""

import zstandard
from pyspark.sql import functions as F

from tidemark.functions import markup
from tidemark.functions import scalar as S
from tidemark.operators import bodies as B
from tidemark.operators import media as X

HEAD, TAIL = "<sysmsg type='sysmsgtemplate'><sysmsgtemplate><content_template>", "</content_template></sysmsgtemplate></sysmsg>"
LINKS = "<link_list><link name='a'><plain>A</plain></link><link name='b'><memberlist><member><nickname>B&#49;</nickname></member><member><nickname>C</nickname></member></memberlist></link><link name='a'><title>Last</title></link><link name='c'/></link_list>"
CASES = [
    (48, '<location label="A&#38;B"/>', "位置分享：A&B"),
    (48, "<msg><location label='Here' poiname='Here'/></msg>", "位置分享：Here"),
    (48, "bob:\n<location x='1' y='2'/>", "位置分享：1，2"),
    (48, "<msg><a><location label='deep'/></a></msg>", None),
    (48, "<location label='x'", None),
    (48, "<location/>", "位置分享（未提供地点名称）"),
    (48, "<location label='x'/>and more", None),
    (10000, f"{HEAD}<template>a <b>x</b> y</template>{TAIL}", "a"),
    (10000, f"{HEAD}<plain>hi <![CDATA[you & me]]></plain>{TAIL}", "hi you & me"),
    (10000, f"{HEAD}<plain></plain><template>$a$ and $b$, $c$</template>{LINKS}{TAIL}", "Last and B1, $c$"),
    (10000, f"{HEAD}<plain>1 &lt; 2</plain>{TAIL}", "1 < 2"),
    (10000, f"{HEAD}<plain>broken{TAIL}", None),
    (10000, "<sysmsg><revokemsg/></sysmsg>", "消息已撤回"),
    (10000, "<sysmsg><foo><revokemsg/></foo></sysmsg>", None),
    (10000, "plain notice", "plain notice"),
    (10000, None, None),
]


def test_bodies_are_parsed(spark):
    df = spark.createDataFrame([(i, k, x) for i, (k, x, _) in enumerate(CASES)], "i int, kind int, x string").orderBy("i")
    got = [r[0] for r in df.select(S.message_text(F.col("x"), F.col("kind"))).collect()]
    assert got == [w for *_, w in CASES]


def test_documents_have_one_root(spark):
    rows = [("<msg/>", True), ("<a/>", True), ("<msg/><msg/>", False), ("<msg/>x", False), ("", False), ("<?xml version='1.0'?>\n<msg/>", True), ("<msg a='1' a='2'/>", False)]
    got = spark.createDataFrame(rows, "x string, want boolean").select("want", markup.document(F.col("x")).isNotNull()).collect()
    assert all(r[0] == r[1] for r in got)


RAW = "shard string, session_id string, server_id long, local_id long, local_type long, sort_seq long, create_time long, status long, message_content binary, compress_content binary, source binary, packed_info_data binary, sender_role string, direction string, is_send boolean, sender_username string"


def raw(kind, content=None, packed=None, source=None, info=None, role="other", name="n", server=7, local=3):
    return ("sh", "se", server, local, kind, 1, 1, 4, content, packed, source, info, role, "incoming", False, name)


def test_public_messages(spark):
    z = zstandard.compress("from zstd".encode())
    text = b"\x08\x02\x12\x03abc"
    refer = b"<x><refermsg><svrid>5</svrid></refermsg></x>"
    rows = [
        raw(1, b" hi "), raw(1, None, z), raw(1, b"\xff\xfe"), raw(1, z[:-4]), raw(48, b"<location"), raw(34, None, info=b"\x2a" + bytes([len(text)]) + text),
        raw(50, b"12345678901234567890", source=b"<voipmsg><msg>over</msg></voipmsg>"), raw(3), raw(77, b"x"), raw(49, b"<title>T</title>", source=refer),
        raw(49, refer.replace(b"5", b"6"), source=refer), raw(1, b"a", role="unknown", server=0, local=4), raw(1, b"a", role="self", name=None, server=None, local=None),
    ]
    got = B.public_messages(spark.createDataFrame(rows, RAW).coalesce(1)).collect()
    assert [r["content"] for r in got] == ["hi", "from zstd", None, None, "位置分享（地点信息不可用）", "abc", "over", None, None, "T", None, "a", "a"]
    assert [r["content_gap"] for r in got][2:4] == ["message_content_unparsed", "compressed_content_decode_failed"] or got[3]["content_gap"] == "compressed_content_exceeds_limit"
    assert got[7]["content_gap"] is None and got[8]["content_gap"] == "message_type_unsupported" and got[8]["type"] == "unknown"
    assert got[9]["quoted_id"] == "5" and got[10]["quote_gap"] == "quote_identity_conflict" and got[10]["quoted_id"] is None
    assert got[11]["direction_gap"] == "message_status_unproven" and got[11]["shard_local_identity"].startswith("sha256:") and got[12]["shard_local_identity"] is None
    assert got[12]["sender_gap"] == "sender_mapping_unresolved" and got[5]["content_source"] == "native_cache"


def test_declared_media(spark):
    a, b = "a" * 32, "B" * 32
    img = lambda m: f"<msg><img md5='{m}'/></msg>"
    rows = [
        (3, [img(a), img(a.upper())], None), (3, [img(a), img(b)], None), (3, ["<msg><img/></msg>"], "s"), (3, ["<msg><img/></msg>"], None), (43, [f"noise\0 <videomsg md5='{b}' length='9'/>"], None),
        (49, [f"<appmsg><type>6</type><title>f</title><md5>{a}</md5></appmsg>"], None), (49, [f"<appmsg><type>5</type><md5>{a}</md5></appmsg>"], None), (47, [f"<msg><img md5='{a}'/></msg>"], None), (1, [img(a)], None),
    ]
    df = spark.createDataFrame(rows, "local_type long, bodies array<string>, image_stem string").coalesce(1).withColumn("payloads", F.col("bodies"))
    got = [(r["kind"], r["declared"] and r["declared"]["md5"]) for r in X.declared_media(df).collect()]
    assert got == [("image", a), ("image", None), ("image", ""), ("image", None), ("video", b.lower()), ("file", a), (None, None), ("emoji", None), (None, None)]


def test_voices_by_server_id_come_first(spark):
    voices = spark.createDataFrame([("d", 1, 9, 5, 70, 100, b"xx"), ("d", 2, 9, 5, 0, 100, b"yyy"), ("d", 3, 9, 6, 0, 101, b"z"), ("d", 4, 9, 7, 71, 102, None)], "database string, rowid long, chat_name_id long, local_id long, svr_id long, create_time long, voice_data binary")
    names = spark.createDataFrame([("d", 9, "s")], "database string, rowid long, user_name string")
    messages = spark.createDataFrame([("k1", "s", 70, 5, 100), ("k2", "s", 99, 6, 101), ("k3", "s", 71, 7, 102), ("k4", "t", 70, 5, 100), ("k5", "s", 0, 5, 100)], "message_key string, session_id string, server_id long, local_id long, create_time long")
    got = {r["message_key"]: (r["voice_by"], r["voices"] and [v["rowid"] for v in r["voices"]]) for r in X.exact_voices(messages, X.voice_index(voices, names)).collect()}
    assert got == {"k1": ("server", [1]), "k2": ("time", [3]), "k3": (None, None), "k4": (None, None), "k5": (None, None)}


def test_stored_copies_in_order(spark):
    links = spark.createDataFrame([("m", "image", "0" * 32 + ".dat", 1, 2, 5), ("m", "image", "photo", 1, 9, 6), ("v", "video", "v.mp4", 3, 9, 1), ("v", "video", "../x", 3, 9, 2)], "md5 string, kind string, file_name string, dir1 long, dir2 long, modify_time long")
    dirs = spark.createDataFrame([(1, "u"), (2, "2024-01"), (3, "2024-02")], "rowid long, username string")
    there = ["msg/attach/u/2024-01/Img/" + "0" * 32 + "_t.dat", "msg/attach/u/2024-01/Img/" + "0" * 32 + ".dat", "msg/attach/u/Img/photo.dat", "msg/video/2024-02/v.mp4", "msg/video/x"]
    files = spark.createDataFrame([(p, 1) for p in there], "path string, length long")
    got = {(r["md5"], r["rank"]): (r["path"], r["quality"]) for r in X.hardlink_paths(links, dirs, files).collect()}
    assert got == {("m", 1): (there[2], "original"), ("m", 2): (there[1], "original"), ("m", 3): (there[0], "thumbnail"), ("v", 1): (there[3], "original")}


def test_media_lines(spark):
    names = [x.split(" ")[0] for x in X.ITEM.split(", ")]
    item = lambda **v: tuple(v.get(n) for n in names)
    media = [item(kind="image", path="a\\b.gif", frames=3, export_status="available_local"), item(kind="voice", path="v", derived_path="v.wav"), item(kind="odd", export_gap="x"), item(kind="emoji", requires_network=True)]
    df = spark.createDataFrame([(media,), (None,)], f"media array<struct<{', '.join(x.replace(' ', ':') for x in X.ITEM.split(', '))}>>").coalesce(1)
    full, none = (r[0] for r in df.select(X.media_lines(F.col("media"))).collect())
    assert full[0] == "  ![图片](a/b.gif)" and "共 3 帧" in full[1] and full[2] == "  [语音（可播放，按需转写）](v.wav)" and full[3].startswith("  [媒体未保存：本机缺失") and full[4].startswith("  [表情包未保存：本机无可用副本") and none == []
    assert "另有 2 个" in df.select(X.media_lines(F.col("media"), 2).alias("m")).head()["m"][-1]
    assert "locator" not in df.select(X.without_places(F.col("media")).alias("m")).schema["m"].dataType.elementType.names
