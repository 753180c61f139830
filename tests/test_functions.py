import zstandard
from pyspark.sql import functions as F

from tidemark.functions import decode
from tidemark.functions import scalar as S


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("r")).head()["r"]





def test_texts(spark):
    assert one(spark, "<msg><title><![CDATA[T]]></title><des>D</des><url></url></msg>", lambda X: S.message_text(X, F.lit(49))) == "T\nD"
    assert one(spark, "<paysubtype>3</paysubtype><feedesc>5.00</feedesc>", lambda X: S.message_text(X, F.lit(49))).endswith("转账已确认收款，金额 5.00")
    assert one(spark, '<msg><location x="1" y="2" label="L" poiname="P"/></msg>', lambda X: S.message_text(X, F.lit(48))) == "位置分享：P；L"
    assert one(spark, '<msg><location x="1" y="2"/></msg>', lambda X: S.message_text(X, F.lit(48))) == "位置分享：1，2"
    assert one(spark, "<voipmsg><msg>Ended</msg></voipmsg>", lambda X: S.message_text(X, F.lit(50))) == "Ended"
    assert one(spark, "<a><duration>12</duration></a>", lambda X: S.message_text(X, F.lit(50))) == "通话时长 12"
    assert one(spark, '<sysmsg type="revokemsg"><revokemsg/></sysmsg>', lambda X: S.message_text(X, F.lit(10000))) == "消息已撤回"
    body = '<sysmsg type="sysmsgtemplate"><sysmsgtemplate><content_template><template>$a$ met $b$</template><link_list><link name="a"><plain>Ann</plain></link></link_list></content_template></sysmsgtemplate></sysmsg>'
    assert one(spark, body, lambda X: S.message_text(X, F.lit(10000))) == "Ann met $b$"
    assert one(spark, "ok\x01", lambda X: S.message_text(X, F.lit(1))) is None
    assert one(spark, "Bo:\n" + body, lambda X: S.message_text(X, F.lit(10000))) == "Ann met $b$"
    plain = body.replace("<template>", "<plain>a &amp; b</plain><template>")
    assert one(spark, plain, lambda X: S.message_text(X, F.lit(10000))) == "a & b"
    twice = body.replace("<plain>Ann</plain>", "<plain></plain><memberlist><member><nickname><![CDATA[$a$ &amp;]]></nickname></member></memberlist>")
    assert one(spark, twice, lambda X: S.message_text(X, F.lit(10000))) == "$a$ &amp; met $b$"
    assert one(spark, "Bo:\n<sysmsg type='other'><x/></sysmsg>", lambda X: S.message_text(X, F.lit(10000))) is None
    assert one(spark, "<msg><title>微信红包</title><des>D</des><paysubtype>1</paysubtype></msg>", lambda X: S.message_text(X, F.lit(49))) == "微信红包"
    assert one(spark, "<msg><title><![CDATA[微信转账]]></title></msg>", lambda X: S.message_text(X, F.lit(49))) == "微信转账\n转账状态未知"
    assert one(spark, '<msg><location label="A &amp;amp; B"/></msg>', lambda X: S.message_text(X, F.lit(48))) == "位置分享：A &amp; B"
    assert one(spark, "a\x14b ", lambda X: S.message_text(X, F.lit(1))) == "ab"


def test_quote_ids(spark):
    v = "<refermsg><svrid><![CDATA[12]]></svrid></refermsg><refermsg><msgid>13</msgid></refermsg><refermsg><msgid>12</msgid></refermsg>"
    assert one(spark, v, lambda X: S.quote_ids(X)) == ["12", "13"]


def test_numbers_and_names(spark):
    assert one(spark, (8 << 32) | 49, lambda X: S.base_type(X), "bigint") == 47
    assert one(spark, (62 << 32) | 49, lambda X: S.base_type(X), "bigint") == 49
    assert one(spark, (5 << 32) | 7, lambda X: S.base_type(X), "bigint") == (5 << 32) | 7
    assert one(spark, "GH_a", lambda X: S.session_type(X)) == "channel"
    assert one(spark, "1@ChatRoom", lambda X: S.session_type(X)) == "group"
    assert one(spark, "ab_12cD", lambda X: S.without_storage_suffix(X)) == "ab"
    assert one(spark, "_12cd", lambda X: S.without_storage_suffix(X)) == "_12cd"
    assert one(spark, "2026-08-01T12:00:00", lambda X: S.parse_time(X)) == 1785556800
    assert one(spark, "2026-08-01T04:00:00Z", lambda X: S.parse_time(X)) == 1785556800
    assert one(spark, 1785556800, lambda X: S.moment(X), "bigint") == "2026-08-01T12:00:00+08:00"
    assert one(spark, b"\x89PNG\r\n\x1a\n..", lambda X: S.sniffed(X), "binary") == "png"
    assert one(spark, b"\xff\xfe", lambda X: S.readable(X), "binary") is None


def test_locator_is_bound(spark):
    import pytest

    df = spark.createDataFrame([(7, "k")], "id long, kind string").withColumn("p", S.locator("store", "a", "id", "kind"))
    assert df.select(S.decode_locator(F.col("p"), "a", "id long, kind string").alias("k")).head()["k"]["id"] == 7
    with pytest.raises(Exception, match="locator_account_mismatch"):
        df.select(S.decode_locator(F.col("p"), "b", "id long, kind string")).collect()


def test_names(spark):
    df = spark.createDataFrame([("【Ａ】 b!c",), (None,)], "x string").select(decode.loose_name("x").alias("l"), decode.normalized_name("x").alias("n"), decode.similarity(F.col("x"), F.lit("abc")).alias("s"))
    a, b = df.collect()
    assert (a["l"], a["n"]) == ("abc", "【a】 b!c") and (b["l"], b["s"]) == (None, None)


def test_inflate():
    good = zstandard.compress("é".encode() * 10)
    assert decode.inflate(b"\x00\x01" + good) == ("é" * 10, None)
    assert decode.inflate(b"plain")[1] == "compressed_content_format_unsupported"
    assert decode.inflate(good[:-3])[1] is not None
    assert decode.inflate(zstandard.compress(b"\xff\xff"))[1] == "compressed_content_text_invalid"
    assert decode.inflate(zstandard.compress(b"  "))[1] == "compressed_content_empty"
    assert decode.inflate(zstandard.compress(b"x" * 100), most=50)[1] == "compressed_content_exceeds_limit"
    assert decode.inflate(None) == (None, None)
    unsized = zstandard.ZstdCompressor().compressobj()
    bomb = unsized.compress(b"\0" * (64 << 20)) + unsized.flush()
    assert decode.inflate(bomb)[1] == "compressed_content_exceeds_limit"


def test_wire(spark):
    text = b"\x08\x02\x12\x03abc"
    assert decode.transcript_of(b"\x2a" + bytes([len(text)]) + text) == "abc"
    assert decode.transcript_of(b"\x2a\x04\x08\x01\x12\x00") is None
    name = b"0" * 31 + b"A"
    assert decode.image_stem_of(b"\x1a" + bytes([34]) + b"\x22\x20" + name) == "0" * 31 + "a"
    assert decode.wire_fields(b"\x0b\x10\x01\x0c") == [(1, 3, None)]
    for bad in (b"\x0b", b"\x0c", b"\x12\x05a", b"\x00\x01", b"\xff" * 11):
        try:
            decode.wire_fields(bad)
            raise AssertionError(bad)
        except ValueError:
            pass
    spark.udtf.register("wire_fields", decode.WireFields)
    assert [(r["number"], r["varint"]) for r in spark.sql("select * from wire_fields(X'0802')").collect()] == [(1, "2")]
