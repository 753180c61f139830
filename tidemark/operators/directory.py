"""Sessions, contacts, groups, feeds and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import markup as M
from tidemark.functions import scalar as S
from tidemark.functions.decode import fold_name, loose_name, loosen_name, normalized_name, similarity
from tidemark.operators.messages import dedup_identities
from tidemark.schema import OPTIONAL_LABELS, OPTIONAL_SESSION, require, with_optional


def sessions(raw: DataFrame, source_rank: str = "source_rank") -> DataFrame:
    """One row per session, the most recent over all sources; equals keep the first source.

    raw: username, optional type, last_timestamp, sort_timestamp, is_hidden, and a source rank.
    """
    df = with_optional(require(raw, "username"), OPTIONAL_SESSION).where("username is not null and username <> ''")
    newest = F.struct(
        F.col("last_timestamp").isNotNull().cast("int"), F.coalesce("last_timestamp", F.lit(0)), F.col("sort_timestamp").isNotNull().cast("int"), F.coalesce("sort_timestamp", F.lit(0)), -F.col(source_rank)
    )
    best = df.groupBy("username").agg(F.max_by(F.struct("type", "last_timestamp", "sort_timestamp", "is_hidden"), newest).alias("r"))
    return best.select("username", S.session_type(F.col("username")).alias("session_type"), F.col("r.type").alias("native_type"), "r.last_timestamp", "r.sort_timestamp", (F.coalesce("r.is_hidden", F.lit(0)) != 0).alias("is_hidden"))


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("sort_timestamp").desc_nulls_last(), F.col("username").desc())


def contacts(raw: DataFrame, known: DataFrame, include_unregistered: bool = False, source_rank: str = "source_rank") -> DataFrame:
    """Contact labels joined with sessions.

    Later sources overwrite earlier ones. Sessions without a contact row are kept with a label gap;
    contact rows without a session are dropped, or kept with a session gap (``include_unregistered``).
    """
    bare = [c for c in OPTIONAL_LABELS if c not in raw.columns]
    df = with_optional(require(raw, "username"), OPTIONAL_LABELS)
    last = df.groupBy("username").agg(F.max_by(F.struct("alias", "remark", "nick_name"), source_rank).alias("r")).select(F.col("username").alias("contact_id"), "r.*")
    joined = known.join(last, F.col("username") == F.col("contact_id"), "full_outer" if include_unregistered else "left")
    native = F.coalesce("username", "contact_id")
    return joined.select(
        native.alias("native_id"),
        S.display_name(F.col("remark"), F.col("nick_name"), F.col("alias"), native).alias("display_name"),
        S.blank_to_null(F.col("remark")).alias("remark"),
        S.blank_to_null(F.col("nick_name")).alias("nickname"),
        S.blank_to_null(F.col("alias")).alias("alias"),
        S.session_type(native).alias("session_type"),
        "last_timestamp",
        F.when(F.col("contact_id").isNull(), "contact_row_missing").when(F.lit(bool(bare)), "label_columns_missing").alias("label_gap"),
        F.when(F.col("username").isNull(), "session_missing").alias("session_gap"),
    )


def of_chat_type(df: DataFrame, chat_type: str | None) -> DataFrame:
    """Groups, or private chats (neither groups nor channels), or all."""
    kind = S.session_type(F.col("native_id"))
    return df if chat_type is None else df.where(kind == ("group" if chat_type == "group" else "contact"))


def group_members(rooms: DataFrame, members: DataFrame, people: DataFrame) -> DataFrame:
    """(room, native_id, labels): three-way inner join of rooms, memberships and contacts."""
    return (
        rooms.select(F.col("id").alias("_room"), F.col("username").alias("room"))
        .join(members, F.col("_room") == F.col("room_id"))
        .join(people, F.col("member_id") == people["id"])
        .select("room", people["username"].alias("native_id"), people["alias"], people["remark"], people["nick_name"])
    )


def agreed_labels(rows: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Labels of each key if all its rows agree, else nulls and label_gap = conflict."""
    s = F.struct(*labels)
    g = rows.groupBy(*keys).agg(F.min(s).alias("lo"), F.max(s).alias("hi"))
    same = F.col("lo").eqNullSafe(F.col("hi"))
    return g.select(*keys, *[F.when(same, F.col(f"lo.{c}")).alias(c) for c in labels], F.when(~same, "group_member_label_conflict").alias("label_gap"))


def members_by_room(rows: DataFrame) -> DataFrame:
    return rows.groupBy("room").agg(F.sort_array(F.collect_set("native_id")).alias("members"), F.countDistinct("native_id").alias("member_count"))


def unambiguous_ids(dictionary: DataFrame) -> DataFrame:
    """(sender_id, user_name) over all sources; ids that mean different names are dropped."""
    g = dictionary.groupBy("sender_id").agg(F.min("user_name").alias("user_name"), F.max("user_name").alias("_hi"))
    return g.where("user_name = _hi").drop("_hi")


def sender_labels(messages: DataFrame, people: DataFrame, members: DataFrame | None = None, peer: str | None = None) -> DataFrame:
    """Adds the sender's display name and label gap; a member's own labels in the group come before the contact's.

    people, members: (native_id, display_name). peer: the display name of a private chat's other side.
    """
    p = people.select(F.col("native_id").alias("_p"), F.col("display_name").alias("_pn"))
    out = messages.join(p, F.col("sender_username") == F.col("_p"), "left")
    own = F.lit(None).cast("string")
    if members is not None:
        m = members.select(F.col("native_id").alias("_m"), F.col("display_name").alias("_mn"))
        out = out.join(m, F.col("sender_username") == F.col("_m"), "left")
        own = F.col("_mn")
    label = F.coalesce(own, F.col("_pn"), F.lit(peer) if peer else F.lit(None).cast("string"))
    # Fixed texts of the output format.
    shown = (
        F.when(F.col("sender_role") == "self", "我")
        .when(F.col("sender_role") == "system", "系统")
        .when(label.isNotNull(), label)
        .when((F.col("sender_role") == "other") & F.lit(members is not None), "群成员（昵称未取到）")
        .otherwise(F.coalesce("sender_username", F.lit("身份未确定")))
    )
    gap = F.when((F.col("sender_role") == "other") & label.isNull() & F.lit(members is not None), "group_member_label_unavailable")
    return out.withColumn("sender_display", shown).withColumn("label_gap", gap).drop("_p", "_pn", "_m", "_mn")


def changed_sessions(known: DataFrame, people: DataFrame, since: int, until: int) -> DataFrame:
    """Sessions that may have changed since a time: later ones and ones without a known time. Rows past ``until`` stay, labelled."""
    t = S.known_time(F.col("last_timestamp"))
    rows = known.withColumn("last_known", t).where((F.col("last_known") >= since) | F.col("last_known").isNull())
    state = F.when(F.col("last_known").isNull(), "unknown").when(F.col("last_known") > until, "after_until").otherwise("changed")
    labels = people.select(F.col("native_id").alias("_n"), "display_name", F.col("label_gap").alias("_gap"))
    out = rows.join(labels, F.col("username") == F.col("_n"), "left")
    return out.select("username", "session_type", "last_known", state.alias("state"), F.coalesce("display_name", "username").alias("display_name"), F.when(F.col("_n").isNull(), "contact_row_missing").otherwise(F.col("_gap")).alias("label_gap"))


def alias_hits(aliases: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases whose target exists, stale aliases)."""
    on = (aliases["account"] == people["account"]) & (aliases["nativeId"] == people["native_id"])
    return aliases.join(people.drop("alias"), on).drop(people["account"]), aliases.join(people, on, "left_anti")


def upsert_alias(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """Replaces entries of the same loose name, account and id; sorted by name, account and id."""
    keyed = aliases.withColumn("_k", loose_name("name"))
    add = new.withColumn("_k", loose_name("name"))
    kept = keyed.join(add.select("_k", "account", "nativeId"), ["_k", "account", "nativeId"], "left_anti").select(*keyed.columns)
    return kept.unionByName(add).drop("_k").orderBy("name", "account", "nativeId")


def remove_alias(aliases: DataFrame, name: str, account: str | None = None) -> DataFrame:
    same = loose_name("name") == loose_name(F.lit(name))
    return aliases.where(~(same & (F.col("account") == account if account else F.lit(True))))


def resolve(people: DataFrame, query: str, aliases: DataFrame | None = None, members: DataFrame | None = None, chat_type: str | None = None, allow_partial: bool = False, prefer_native_id: bool = False) -> DataFrame:
    """The candidates of the first layer that has any: alias, exact, loose, partial, group member.

    people: account, native_id, display_name, remark, nickname, alias, last_timestamp. Layers merge all
    accounts. Partial and member layers need ``allow_partial`` and two loose signs; private chats
    have no member layer. Several alias hits without a chat type mean the private one if
    there is just one. With ``prefer_native_id`` an exact native id hides other exact names. The caller decides on ambiguity (see ``resolution``); nothing is picked here.
    """
    rows = of_chat_type(people, chat_type)
    norm, loose = F.lit(fold_name(query)), F.lit(loosen_name(query))
    labels = ("remark", "nickname", "alias")
    folded = rows.withColumns({f"_{c}": loose_name(F.col(c)) for c in labels} | {f"_n{c}": normalized_name(F.col(c)) for c in (*labels, "native_id", "display_name")} | {"_q": norm, "_lq": loose})
    names = F.array_compact(F.array(*[F.when(F.col(f"_{c}") != "", F.col(f"_{c}")) for c in labels]))
    exact = F.array_contains(F.array_compact(F.array(*[F.col(f"_n{c}") for c in (*labels, "native_id", "display_name")])), F.col("_q"))
    long_enough = F.lit(allow_partial) & (F.char_length("_lq") >= 2)
    layer = F.when(exact, 1).when((F.col("_lq") != "") & F.array_contains(names, F.col("_lq")), 2).when(long_enough & F.exists(names, lambda n: F.contains(n, F.col("_lq"))), 3)
    if aliases is not None:
        hit = aliases.withColumn("_an", loose_name("name")).where(F.col("_an") == loose).select(F.col("account").alias("_aa"), F.col("nativeId").alias("_ai")).distinct()
        folded = folded.join(hit, (F.col("account") == F.col("_aa")) & (F.col("native_id") == F.col("_ai")), "left")
        layer = F.when(F.col("_ai").isNotNull(), 0).otherwise(layer)
    if members is not None and chat_type != "private":
        m = members.withColumns({f"_m{c}": loose_name(F.col(c)) for c in ("remark", "nick_name", "alias")})
        found = m.where(F.lit(allow_partial) & F.array_contains(F.transform(F.array("_mremark", "_mnick_name", "_malias"), lambda n: F.coalesce(F.contains(n, F.lit(loosen_name(query))), F.lit(False))), True))
        folded = folded.join(found.select(F.col("room").alias("_room")).distinct(), F.col("native_id") == F.col("_room"), "left")
        layer = F.coalesce(layer, F.when(long_enough & F.col("_room").isNotNull(), 4))
    ranked = folded.withColumn("layer", layer).where("layer is not null")
    if prefer_native_id:
        ranked = ranked.withColumn("_by_id", (F.col("layer") == 1) & (F.col("_nnative_id") == F.col("_q")))
    else:
        ranked = ranked.withColumn("_by_id", F.lit(False))
    is_private = S.session_type(F.col("native_id")) != "group"
    layers = ranked.groupBy(F.col("layer").alias("_first")).agg(F.count_if(is_private).alias("_private"), F.max("_by_id").alias("_ids"))  # five rows at most
    best = layers.agg(F.min_by(F.struct("_first", "_private", "_ids"), "_first").alias("_b")).select("_b.*")
    first = ranked.crossJoin(F.broadcast(best)).where((F.col("layer") == F.col("_first")) & (~F.col("_ids") | F.col("_by_id")))
    if chat_type is None:
        first = first.where((F.col("layer") != 0) | (F.col("_private") != 1) | is_private)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("alias", "exact", "loose", "partial_name", "group_member")]), F.col("layer") + 1)
    return first.select(*people.columns, kind.alias("match_kind"))


def suggestions(people: DataFrame, query: str, least: float = 0.5, top: int = 5) -> DataFrame:
    """What to offer when nothing matches: the most similar names, then the most recent."""
    best = F.greatest(*[F.coalesce(similarity(F.lit(loosen_name(query)), loose_name(F.col(c))), F.lit(0.0)) for c in ("remark", "nickname", "alias")])
    return people.withColumn("similarity", best).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), F.coalesce(S.known_time(F.col("last_timestamp")), F.lit(0)).desc(), "native_id").limit(top)


def candidates(matches: DataFrame, top: int = 20) -> DataFrame:
    """The most recent candidates of an ambiguous name, each with the total."""
    total = matches.agg(F.count(F.lit(1)).alias("candidate_total"))
    return matches.orderBy(F.coalesce(S.known_time(F.col("last_timestamp")), F.lit(0)).desc(), "native_id").limit(top).crossJoin(F.broadcast(total))


def resolution(matches: DataFrame, offered: DataFrame, top: int = 20) -> DataFrame:
    """What a name came to, as rows (status, rank, columns of ``matches``, similarity, candidate_total).

    resolved: the only match. needs_choice: the most recent ``top`` of several matches, none of which is picked, with their number where there are more.
    not_found: the rows of ``offered`` (``suggestions``), or one row that says so where there are none.
    """
    spark, columns = matches.sparkSession, matches.columns
    total = matches.limit(top + 1).count()
    recent = F.coalesce(S.known_time(F.col("last_timestamp")), F.lit(0))
    no_total, no_similarity = F.lit(None).cast("bigint").alias("candidate_total"), F.lit(None).cast("double").alias("similarity")
    if total:
        said = F.lit("resolved" if total == 1 else "needs_choice").alias("status")
        rows = matches.orderBy(recent.desc(), "native_id").limit(top)
        order = Window.orderBy(recent.desc(), "native_id")  # at most ``top`` rows
        counted = matches.agg(F.count(F.lit(1)).alias("candidate_total")) if total > top else spark.range(1).select(no_total)
        return rows.crossJoin(F.broadcast(counted)).select(said, F.row_number().over(order).alias("rank"), *columns, no_similarity, "candidate_total")
    order = Window.orderBy(F.desc("similarity"), recent.desc(), "native_id")  # a few suggestions
    kinds = {f.name: f.dataType for f in matches.schema}
    own = [F.col(c) if c in offered.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns]
    rows = offered.select(F.lit("not_found").alias("status"), F.row_number().over(order).alias("rank"), *own, "similarity", no_total)
    if rows.isEmpty():
        return spark.range(1).select(F.lit("not_found").alias("status"), F.lit(0).alias("rank"), *[F.lit(None).cast(kinds[c]).alias(c) for c in columns], no_similarity, no_total)
    return rows


_POST_MEDIA = "array<struct<type:array<string>,id:array<string>,size:array<struct<_totalSize:string>>,url:array<struct<_md5:string,_VALUE:string>>>>"
_POST = (
    "TimelineObject array<struct<id:array<string>,username:array<string>,createTime:array<string>,contentDesc:array<string>,"
    f"ContentObject:array<struct<type:array<string>,title:array<string>,description:array<string>,mediaList:array<struct<media:{_POST_MEDIA}>>>>>>, "
    "LocalExtraInfo array<struct<nickname:array<string>>>, _corrupt string"
)


def moments(raw: DataFrame) -> DataFrame:
    """Feed posts from their XML: (moment_id, author, nickname, compared_time, created, text, kind, title, description, media_urls, media_md5, gap, tid).

    A time of 0 is shown as null; an address element without a checksum declares an empty one. A body that isn't one well-formed
    element has the gap moment_xml_unreadable, one without a post moment_timeline_missing; both have no author, and ``feed`` leaves them out.
    """
    x = F.col("content")
    doc = F.from_xml(M.one_element(x), _POST, {"columnNameOfCorruptRecord": "_corrupt"})
    post = M.first(doc["TimelineObject"])
    content = M.first(post["ContentObject"])

    def said(value: Column) -> Column:
        return S.blank_to_null(M.first(value))

    created = said(post["createTime"]).try_cast("bigint")
    media = F.coalesce(M.flat(content["mediaList"], "media"), F.array().cast(_POST_MEDIA))
    rows = raw.withColumn("_readable", M.one_element(x).isNotNull())
    gap = F.when(~F.coalesce("_readable", F.lit(False)), "moment_xml_unreadable").when(F.coalesce(F.size(doc["TimelineObject"]), F.lit(0)) < 1, "moment_timeline_missing")
    return rows.select(
        F.coalesce(said(post["id"]), F.col("tid").cast("string")).alias("moment_id"),
        F.when(gap.isNull(), F.coalesce(said(post["username"]), F.col("user_name"))).alias("author"),
        said(M.flat(doc["LocalExtraInfo"], "nickname")).alias("nickname"),
        F.coalesce(created, F.lit(0)).alias("compared_time"),
        S.known_time(created).alias("created"),
        S.safe_text(M.first(post["contentDesc"])).alias("text"),
        said(content["type"]).try_cast("int").alias("kind"),
        said(content["title"]).alias("title"),
        said(content["description"]).alias("description"),
        F.transform(media, lambda m: F.coalesce(F.trim(M.first(m["url"])["_VALUE"]), F.lit(""))).alias("media_urls"),
        F.transform(media, lambda m: F.when(F.size(m["url"]) > 0, F.coalesce(M.first(m["url"])["_md5"], F.lit("")))).alias("media_md5"),
        gap.alias("gap"),
        F.col("tid"),
    )


def feed(raw: DataFrame, author: str | None = None, since: int | None = None, until: int | None = None, limit: int = 20) -> DataFrame:
    """The newest posts in a window. Without an author only a bounded number of rows by row id is looked at, which is part of the result's meaning."""
    limit = min(max(limit, 1), 50)
    rows = raw if author is not None else raw.orderBy(F.desc("tid")).limit(min(max(8 * limit, 100), 500))
    posts = moments(rows).where("gap is null")
    if author is not None:
        posts = posts.where(F.col("author") == author)
    if since is not None:
        posts = posts.where(F.col("compared_time") >= since)
    if until is not None:
        posts = posts.where(F.col("compared_time") <= until)
    sig = F.sha2(F.to_json(F.struct(*[c for c in posts.columns if c != "tid"])), 256)
    return dedup_identities(posts, "moment_id", sig, ["tid"]).orderBy(F.desc("compared_time"), F.desc("moment_id")).limit(limit)


def feed_stats(raw: DataFrame, author: str | None, since: int, until: int) -> DataFrame:
    """One row beside a feed: rows scanned, of the author, in the window; the author's and the overall time range."""
    p = moments(raw)
    mine = F.lit(True) if author is None else F.col("author") == author
    inside = mine & F.col("compared_time").between(since, until)
    t = F.nullif(F.col("compared_time"), F.lit(0))
    return p.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(mine).alias("target_rows"), F.count_if(inside).alias("matched"), F.min(F.when(mine, t)).alias("oldest"), F.max(F.when(mine, t)).alias("newest"), F.max(t).alias("newest_overall")
    )


def moments_with_labels(posts: DataFrame, people: DataFrame) -> DataFrame:
    p = people.select(F.col("native_id").alias("_n"), F.col("display_name").alias("author_display"))
    return posts.join(p, F.col("author") == F.col("_n"), "left").drop("_n").withColumn("author_display", F.coalesce("author_display", "nickname", "author"))


def publishers(people: DataFrame, posts: DataFrame) -> DataFrame:
    """Contacts and feed authors as one directory: contact labels first, the sets of names that match joined."""
    seen = posts.groupBy(F.col("author").alias("_a")).agg(F.max_by("nickname", "compared_time").alias("_nick"))
    out = people.join(seen, people["native_id"] == F.col("_a"), "full_outer")
    names = F.array_union(F.coalesce(S.match_fields(F.col("remark"), F.col("nickname"), F.col("alias"), F.col("native_id")), F.array().cast("array<string>")), S.match_fields(F.col("_nick"), F.col("_a")))
    return out.select(F.coalesce("native_id", "_a").alias("native_id"), F.coalesce("display_name", "_nick", "_a").alias("display_name"), names.alias("match_names"))


def session_exists(known: DataFrame, session_id: str) -> bool:
    return known.where(F.col("username") == session_id).limit(1).count() == 1


def role_counts(df: DataFrame, role: str, keys: list[str]) -> DataFrame:
    r = F.coalesce(F.col(role), F.lit("unknown"))
    return df.groupBy(*keys).agg(*[F.count_if(r == k).alias(f"{k}_count") for k in ("self", "other", "system", "unknown")])
