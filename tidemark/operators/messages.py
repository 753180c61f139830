"""Message queries: time and watermark filters, keyset pages, anchored windows, identity dedup, quotes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S


# Filters. Each is one expression over stored columns, so that it reaches the Parquet scan.
def in_window(t: str, since: int, until: int) -> Column:
    """Closed at both ends; rows without a time are out."""
    return F.col(t).between(since, until)


def until_or_undated(t: str, until: int) -> Column:
    """Upper bound alone: rows without a time stay."""
    return (F.col(t) <= until) | F.col(t).isNull()


def after_watermark(seq: str, watermark: int, t: str, until: int) -> Column:
    return (F.col(seq) > watermark) & until_or_undated(t, until)


def after_watermark_or_replayed(seq: str, watermark: int, t: str, since: int, until: int) -> Column:
    """New rows and, again, rows of the overlap; a row without a sequence is in neither."""
    return after_watermark(seq, watermark, t, until) | ((F.col(seq) <= watermark) & in_window(t, since, until))


def guarded_watermark(messages: DataFrame, seq: str, watermark: int) -> DataFrame:
    """Fails when the store's largest sequence lies below the watermark: the store has been replaced."""
    top = messages.agg(F.max(seq).alias("_top"))
    return messages.crossJoin(F.broadcast(top)).where(F.when(F.col("_top") >= watermark, True).otherwise(F.raise_error(F.lit("watermark_regressed")).cast("boolean"))).drop("_top")


def contains_text(content: str, wanted: str) -> Column:
    """Substring without regard to case; no content is empty content."""
    return F.contains(F.lower(F.coalesce(F.col(content), F.lit(""))), F.lit(wanted.lower()))


def self_or_unknown(role: str) -> Column:
    """The owner's messages and those whose sender isn't known, never the others'."""
    return F.col(role).isin("self", "unknown")


def by_ids(messages: DataFrame, ids: DataFrame | list, column: str = "server_id") -> DataFrame:
    if isinstance(ids, list):
        return messages.where(F.col(column).isin(ids))
    return messages.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")


@dataclass(frozen=True)
class PageKey:
    """The total order of a page: dated rows after undated ones, then time, sequence, kind of id, id as text."""

    time: str = "create_time"
    seq: str = "sort_seq"
    kind: str = "id_kind"
    value: str = "id_value"

    def columns(self) -> list[Column]:
        return [F.col(self.time).isNotNull().cast("int"), F.coalesce(F.col(self.time), F.lit(-1)), F.coalesce(F.col(self.seq), F.lit(-1)), F.col(self.kind), F.col(self.value)]

    def of(self, row: dict) -> tuple:
        t, s = row[self.time], row[self.seq]
        return (int(t is not None), -1 if t is None else t, -1 if s is None else s, row[self.kind], row[self.value])


def before(columns: list[Column], key: tuple) -> Column:
    """Rows below a key, lexicographically, spelled out so that the scan gets the leading terms."""
    out, equal = F.lit(False), F.lit(True)
    for c, k in zip(columns, key, strict=True):
        out = out | (equal & (c < F.lit(k)))
        equal = equal & (c == F.lit(k))
    return out & (columns[0] <= F.lit(key[0]))


def page(messages: DataFrame, size: int, order: list[Column], before_key: tuple | None = None) -> DataFrame:
    """The newest ``size`` rows below ``before_key`` and whether there are more: one distributed top-k of size + 1.

    Adds has_more; rows come newest first by ``order`` (ascending columns, read downwards).
    """
    rows = messages if before_key is None else messages.where(before(order, before_key))
    top = rows.orderBy(*[c.desc_nulls_last() for c in order]).limit(size + 1)
    ranked = top.withColumn("_rank", F.row_number().over(Window.orderBy(*[c.desc_nulls_last() for c in order])))
    return ranked.withColumn("has_more", F.max("_rank").over(Window.partitionBy()) > size).where(F.col("_rank") <= size).drop("_rank")


def around(messages: DataFrame, at: int, size: int, time: str, order: list[Column]) -> DataFrame:
    """The ``size`` rows nearest in time, newer ones first among equals; a row without a time counts as -1."""
    distance = F.abs(F.coalesce(F.col(time), F.lit(-1)) - F.lit(at))
    return messages.orderBy(distance.asc(), *[c.desc_nulls_last() for c in order]).limit(size)


def ascending_limited(messages: DataFrame, order: list[Column]) -> DataFrame:
    """The final order of a page: undated rows first."""
    return messages.orderBy(*[c.asc_nulls_first() for c in order])


def ascending_unlimited(messages: DataFrame, time: str, seq: str, ident: str) -> DataFrame:
    """The final order of a whole read: undated rows last."""
    return messages.orderBy(F.col(time).asc_nulls_last(), F.col(seq).asc_nulls_last(), F.col(ident).cast("string").asc_nulls_last())


def numbered(messages: DataFrame, order: list[Column], partition: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(partition or [])).orderBy(*order)
    return messages.withColumn("rn", F.row_number().over(w).cast("bigint"))


def anchored(messages: DataFrame, size: int, order: list[Column], *, anchor: Column | None = None, time: str | None = None, at: int | None = None, partition: list[str] | None = None) -> DataFrame:
    """A window of ``size`` rows about an anchor, three fifths before it, moved to stay inside the rows.

    The anchor is the last row that ``anchor`` holds for; with ``at`` as well, the one of those nearest
    in time; with ``at`` alone, the nearest row with a time. Ties go to the first row. Without
    either, the last rows. Windows run per ``partition``; messages should be a bounded page
    where there is none. A partition without an anchor gives no rows.
    """
    rows = numbered(messages, order, partition)
    whole = Window.partitionBy(*(partition or []))
    if anchor is None and at is None:
        return rows.withColumn("_n", F.count(F.lit(1)).over(whole)).where(F.col("rn") > F.col("_n") - size).drop("_n")
    if at is None:
        a = F.max(F.when(anchor, F.col("rn"))).over(whole)
    else:
        usable = anchor if anchor is not None else F.col(time).isNotNull()
        gap = F.abs(F.coalesce(F.col(time), F.lit(0)) - F.lit(at))
        a = F.min(F.when(usable, F.struct(gap.alias("d"), F.col("rn").alias("rn")))).over(whole)["rn"]
    rows = rows.withColumn("anchor_rn", a).withColumn("_n", F.count(F.lit(1)).over(whole)).where("anchor_rn is not null")
    ahead = min(size - 1, size * 3 // 5)
    first = F.greatest(F.col("anchor_rn") - ahead, F.lit(1))
    last = F.least(first + size - 1, F.col("_n"))
    first = F.greatest(last - size + 1, F.lit(1))
    return rows.where(F.col("rn").between(first, last)).drop("_n")


def tail(messages: DataFrame, size: int, order: list[Column], partition: list[str]) -> DataFrame:
    """The last ``size`` rows of each partition. Every task keeps as many of a partition before the shuffle, so one large partition does no harm."""
    w = Window.partitionBy(*partition).orderBy(*[c.desc_nulls_last() for c in order])
    return messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= size).drop("_r")


def dedup_identities(messages: DataFrame, identity: str, signature: Column, order: list[str]) -> DataFrame:
    """One row per identity, the least by ``order``; copies that differ in ``signature`` fail the query."""
    return conflicts_marked(messages, identity, signature, order).where(F.when(F.col("signatures") == 1, True).otherwise(F.raise_error(F.lit("message_identity_is_conflicting")).cast("boolean"))).drop("signatures")


def conflicts_marked(messages: DataFrame, identity: str, signature: Column, order: list[str]) -> DataFrame:
    """As ``dedup_identities``, with the number of distinct signatures instead of a failure."""
    rows = messages.withColumn("_sig", signature)
    lo_hi = rows.groupBy(identity).agg(F.min_by(F.struct(*messages.columns), F.struct(*order)).alias("r"), F.min("_sig").alias("lo"), F.max("_sig").alias("hi"))
    return lo_hi.select("r.*", F.when(F.col("lo").eqNullSafe(F.col("hi")), 1).otherwise(2).alias("signatures"))


def checked_page(messages: DataFrame, selected: DataFrame, identity: str, signature: Column, order: list[str]) -> DataFrame:
    """All copies of the selected identities, also those outside the page's window, checked and reduced to one each."""
    ids = selected.select(identity).distinct()
    return dedup_identities(messages.join(F.broadcast(ids), identity, "left_semi"), identity, signature, order)  # a page of ids


def calibrated_senders(messages: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, own_sender): the only valid sender of outgoing, non-system rows; null where there are several. No majority counts."""
    out = messages.where((F.col("status") == S.OUTGOING) & (S.base_type(F.col("local_type")) != S.SYSTEM)).withColumn("_k", S.sender_key(F.col("real_sender_id")))
    return out.groupBy(*scope).agg(F.when(F.min("_k") == F.max("_k"), F.min("_k")).alias("own_sender"))


def with_roles(messages: DataFrame, names: DataFrame, owner_sha256: str | None, scope: list[str] = ["shard"]) -> DataFrame:  # noqa: B006
    """Adds sender_username, sender_role, direction and is_send; names: (shard, sender_id, user_name), ids hold within a shard."""
    cal = calibrated_senders(messages, scope)
    n = names.select(F.col("shard").alias("_shard"), F.col("sender_id").alias("_sid"), F.col("user_name").alias("sender_username"))
    joined = messages.join(cal, scope, "left").join(n, (F.col("shard") == F.col("_shard")) & (F.col("real_sender_id") == F.col("_sid")), "left").drop("_shard", "_sid")
    own = S.is_owner(F.col("sender_username"), owner_sha256)
    role = S.sender_role(F.col("local_type"), F.col("status"), F.col("real_sender_id"), F.col("own_sender"), own, F.endswith(F.lower("session_id"), F.lit("@openim")))
    out = joined.withColumn("sender_role", role)
    # A name that disagrees with the role is not shown.
    agrees = own.isNull() | ~F.col("sender_role").isin("self", "other") | (own == (F.col("sender_role") == "self"))
    return (
        out.withColumn("sender_gap", F.when(~agrees, "sender_identity_conflict"))
        .withColumn("sender_username", F.when(agrees, F.col("sender_username")))
        .withColumns({"direction": S.direction(F.col("sender_role")), "is_send": F.when(F.col("sender_role") != "unknown", F.col("sender_role") == "self")})
        .drop("own_sender")
    )


def attach_quotes(page: DataFrame, quoted: str, targets: DataFrame, ident: str, columns: list[str]) -> DataFrame:
    """Left self-join of replies with what they quote: columns as quoted_<c>, and a gap where the target is missing.

    Of rows that repeat an id the least by the columns stands for it.
    """
    t = targets.groupBy(F.col(ident).alias("_target")).agg(F.min(F.struct(*[F.col(c).alias(f"quoted_{c}") for c in columns])).alias("_q")).select("_target", "_q.*")
    out = page.join(t, F.col(quoted) == F.col("_target"), "left")
    return out.withColumn("quote_gap", F.when(F.col(quoted).isNotNull() & F.col("_target").isNull(), "quote_target_missing")).drop("_target")


def prioritized_join(left: DataFrame, right: DataFrame, first: Column, second: Column, key: str) -> DataFrame:
    """Left rows joined by ``first``; only those without any hit are tried by ``second``."""
    a = left.join(right, first)
    rest = left.join(a.select(key).distinct(), key, "left_anti")
    return a.unionByName(rest.join(right, second, "left"))


def agreed_rows(candidates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The row of each key if all its candidates agree in ``columns``, else nulls and a conflict."""
    s = F.struct(*columns)
    g = candidates.groupBy(key).agg(F.min(s).alias("lo"), F.max(s).alias("hi"))
    same = F.col("lo").eqNullSafe(F.col("hi"))
    return g.select(key, *[F.when(same, F.col(f"lo.{c}")).alias(c) for c in columns], F.when(~same, "conflict").alias("gap"))


def search_status(matched: bool, has_more: bool, gaps: int, by_cursor: bool) -> str:
    """What a keyword search of one page may claim."""
    if matched:
        return "matched"
    if has_more:
        return "not_found_in_page"
    if gaps:
        return "indeterminate_content_gaps"
    return "not_found_in_remaining_window" if by_cursor else "not_found_in_requested_window"


def coverage(page: DataFrame, content: str, role: str) -> DataFrame:
    """One row of receipts: rows, rows without a readable body, and counts by role."""
    return page.agg(
        F.count(F.lit(1)).alias("returned"),
        F.count_if(F.col(content).isNull()).alias("unreadable"),
        *[F.count_if(F.coalesce(F.col(role), F.lit("unknown")) == r).alias(f"{r}_count") for r in ("self", "other", "system", "unknown")],
    )


def distinct_page(messages: DataFrame, size: int, identity: str, signature: Column, key: PageKey = PageKey(), before_key: tuple | None = None) -> DataFrame:  # noqa: B008
    """The newest ``size`` distinct identities below ``before_key``, one checked row each, with has_more.

    Every task keeps the newest ``size`` + 1 distinct identities of what it scans and no more, so that only
    these, as (identity, order), are shuffled, however many rows and copies there are. The best ``size``
    of them are then fetched with all their copies, also those outside the page's bounds, and copies that differ in
    ``signature`` fail the query. Time bounds reach the scan. Rows come newest first.
    """
    rows = messages
    if before_key is not None:
        below = before(key.columns(), before_key)
        rows = messages.where(F.col(key.time).isNull())
        if before_key[0]:
            # Undated rows are all older. Each part has a condition on the stored column, which reaches the scan; their disjunction would not.
            rows = rows.unionByName(messages.where((F.col(key.time) <= before_key[1]) & below))
        else:
            rows = rows.where(below)
    names = ["_dated", "_time", "_seq", "_kind", "_value"]
    narrow = rows.select(F.col(identity).alias("_identity"), *[c.alias(n) for c, n in zip(key.columns(), names, strict=True)])

    def newest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            both = frame if held is None else pd.concat([held, frame])
            held = both.sort_values(names, ascending=False, na_position="last", kind="stable").drop_duplicates("_identity").head(size + 1)
        if held is not None:
            yield held

    best = narrow.mapInPandas(newest, narrow.schema).groupBy("_identity").agg(F.max(F.struct(*names)).alias("_at"))
    top = best.orderBy(F.col("_at").desc()).limit(size + 1)
    ranked = top.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_at").desc())))  # a page and one row
    ranked = ranked.withColumn("has_more", F.max("_rank").over(Window.partitionBy()) > size).where(F.col("_rank") <= size)
    copies = messages.join(F.broadcast(ranked.drop("_at")), F.col(identity) == F.col("_identity")).drop("_identity")  # at most ``size`` ids
    return dedup_identities(copies, identity, signature, [key.time, key.seq, key.kind, key.value]).orderBy("_rank").drop("_rank")
