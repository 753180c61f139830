from pyspark.sql import functions as F

from tidemark.operators import directory as D


def test_sessions_keep_the_newest(spark):
    raw = spark.createDataFrame([("a", 100, 1, 0), ("a", 200, 0, 1), ("b", None, 0, 0), ("b", 5, 0, 1), ("c", 7, 1, 0), ("c", 7, 0, 1)], "username string, last_timestamp long, is_hidden int, source_rank int")
    out = {r["username"]: (r["last_timestamp"], r["is_hidden"]) for r in D.sessions(raw).collect()}
    assert out == {"a": (200, False), "b": (5, False), "c": (7, True)}


def people(spark):
    rows = [("primary", "u1", "Anna Bee", None, "Anna Bee", "ab", 5), ("primary", "u2", "Anna", "Anna", None, None, 9), ("secondary", "g@chatroom", "Anna's", None, "Anna's", None, 1), ("primary", "gh_x", "News", None, "News", None, 3)]
    return spark.createDataFrame(rows, "account string, native_id string, display_name string, remark string, nickname string, alias string, last_timestamp long")


def found(df):
    return sorted((r["native_id"], r["match_kind"]) for r in df.collect())


def test_layers(spark):
    p = people(spark)
    assert found(D.resolve(p, "ANNA")) == [("u2", "exact")]
    assert found(D.resolve(p, "anna-bee")) == [("u1", "loose")]
    assert found(D.resolve(p, "nna", allow_partial=True)) == [("g@chatroom", "partial_name"), ("u1", "partial_name"), ("u2", "partial_name")]
    assert found(D.resolve(p, "nna")) == []
    assert found(D.resolve(p, "nna", allow_partial=True, chat_type="private")) == [("u1", "partial_name"), ("u2", "partial_name")]
    m = spark.createDataFrame([("g@chatroom", "z1", None, None, "Zoe")], "room string, native_id string, alias string, remark string, nick_name string")
    assert found(D.resolve(p, "zoe", members=m, allow_partial=True)) == [("g@chatroom", "group_member")]
    aliases = spark.createDataFrame([("boss", "primary", "u1", "private"), ("boss", "secondary", "g@chatroom", "group"), ("old", "primary", "gone", "private")], "name string, account string, nativeId string, chatType string")
    assert found(D.resolve(p, "Boss", aliases=aliases)) == [("u1", "alias")]
    hits, stale = D.alias_hits(aliases, p)
    assert hits.count() == 2 and [r["name"] for r in stale.collect()] == ["old"]


def test_alias_edits(spark):
    a = spark.createDataFrame([("boss", "primary", "u1")], "name string, account string, nativeId string")
    b = D.upsert_alias(a, spark.createDataFrame([("Boss!", "primary", "u1"), ("x", "primary", "u2")], a.schema))
    assert [tuple(r) for r in b.collect()] == [("Boss!", "primary", "u1"), ("x", "primary", "u2")]
    assert D.remove_alias(b, "BOSS").count() == 1


def test_suggestions_and_candidates(spark):
    s = D.suggestions(people(spark), "ana").collect()
    assert s[0]["native_id"] == "u2" and s[0]["similarity"] == 0.8571
    c = D.candidates(people(spark).where("account = 'primary'"), 2).collect()
    assert [(r["native_id"], r["candidate_total"]) for r in c] == [("u2", 3), ("u1", 3)]


def test_label_conflict_and_dictionary(spark):
    m = spark.createDataFrame([("r", "a", "x"), ("r", "a", "y"), ("r", "b", "z")], "room string, id string, nick string")
    out = {r["id"]: (r["nick"], r["label_gap"]) for r in D.agreed_labels(m, ["room", "id"], ["nick"]).collect()}
    assert out == {"a": (None, "group_member_label_conflict"), "b": ("z", None)}
    d = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c")], "sender_id long, user_name string")
    assert [tuple(r) for r in D.unambiguous_ids(d).collect()] == [(1, "a")]


def post(i, user, t, text="t", extra=""):
    return f"<root><TimelineObject><id>{i}</id><username>{user}</username><createTime>{t}</createTime><contentDesc>{text}</contentDesc><ContentObject><type>1</type><mediaList>{extra}</mediaList></ContentObject></TimelineObject></root>"


def test_feed(spark):
    media = '<media><url md5="m1">http://a</url></media><media><url>http://b</url></media><media></media>'
    rows = [(i, "other", post(i, "other", 1000 + i)) for i in range(600, 0, -1)] + [(0, "me", post("p0", "me", 0, extra=media))]
    raw = spark.createDataFrame(rows, "tid long, user_name string, content string")
    mine = D.feed(raw, "me").collect()
    assert len(mine) == 1 and mine[0]["created"] is None and mine[0]["media_md5"] == ["m1", "", None] and mine[0]["media_urls"][:2] == ["http://a", "http://b"]
    assert [r["moment_id"] for r in D.feed(raw, limit=2).collect()] == ["600", "599"]
    s = D.feed_stats(raw, "me", 0, 10).head()
    assert (s["scanned"], s["target_rows"], s["matched"], s["newest"], s["newest_overall"]) == (601, 1, 1, None, 1600)
    import pytest

    twice = raw.limit(1).unionByName(raw.limit(1).withColumn("content", F.replace("content", F.lit("<contentDesc>t"), F.lit("<contentDesc>u"))))
    with pytest.raises(Exception, match="conflicting"):
        D.feed(twice, "other").collect()


def test_changes_keep_unknown_and_later(spark):
    known = D.sessions(spark.createDataFrame([("a", 150), ("b", None), ("c", 250), ("d", 99)], "username string, last_timestamp long").withColumn("source_rank", F.lit(0)))
    people_ = D.contacts(spark.createDataFrame([("a", "A")], "username string, nick_name string").withColumn("source_rank", F.lit(0)), known)
    out = {r["username"]: (r["state"], r["display_name"]) for r in D.changed_sessions(known, people_, 100, 200).collect()}
    assert out == {"a": ("changed", "A"), "b": ("unknown", "b"), "c": ("after_until", "c")}


def test_resolution_never_picks(spark):
    columns = "account string, native_id string, display_name string, remark string, nickname string, alias string, last_timestamp long"
    rows = [("a", f"u{i}", "Ann", None, "Ann", None, i) for i in range(25)] + [("a", "ann", "Other", None, "Other", None, 3), ("a", "solo", "Solo", None, "Solo", None, 1)]
    p = spark.createDataFrame(rows, columns).coalesce(2)

    def came_to(query, **more):
        return D.resolution(D.resolve(p, query, **more), D.suggestions(p, query)).orderBy("rank").collect()

    many = came_to("ANN")
    assert {r["status"] for r in many} == {"needs_choice"} and len(many) == 20 and many[0]["candidate_total"] == 26 and many[0]["native_id"] == "u24" and many[0]["match_kind"] == "exact"
    assert [(r["status"], r["native_id"]) for r in came_to("ANN", prefer_native_id=True)] == [("resolved", "ann")]
    assert [(r["status"], r["native_id"], r["candidate_total"]) for r in came_to("Solo")] == [("resolved", "solo", None)]
    near = came_to("Sol0")
    assert (near[0]["status"], near[0]["native_id"], near[0]["similarity"]) == ("not_found", "solo", 0.75) and near[0]["match_kind"] is None
    assert [(r["status"], r["rank"], r["native_id"]) for r in came_to("zzzzzz")] == [("not_found", 0, None)]
