"""The bounded context query: scan a page, anchor a window, attach quotes and labels, report coverage, continue by cursor."""

from __future__ import annotations

import hashlib
import json
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import directory as D
from tidemark.operators import messages as M
from tidemark.operators.cursors import Cursor, QueryError, default_window

SCAN, RETURN, MOST_SCAN, MOST_RETURN = 120, 24, 500, 80
KEY = M.PageKey()


def context(
    messages: DataFrame,
    *,
    account: str,
    contact: str,
    now: int,
    since: int | None = None,
    until: int | None = None,
    lookback: int = 30 * 86_400,
    contains: str | None = None,
    around: int | None = None,
    self_only: bool = False,
    scan_limit: int = SCAN,
    return_limit: int = RETURN,
    cursor: str | None = None,
    people: DataFrame | None = None,
    members: DataFrame | None = None,
    peer: str | None = None,
) -> dict:
    """One page of a conversation as data.

    messages: create_time, sort_seq, id_kind, id_value, content, sender_role, sender_username and, if
    replies are to be resolved, quoted (the id_value of what is quoted). At most ``scan_limit`` rows are
    scanned and ``return_limit`` returned; only these reach the driver. The next cursor is the least
    key of the returned rows, so a wide scan with a narrow return skips nothing.
    """
    if not (1 <= scan_limit <= MOST_SCAN and 1 <= return_limit <= MOST_RETURN):
        raise QueryError("limit_out_of_range")
    since, until = default_window(now, lookback, around, since, until)
    bound = Cursor(account, contact, since, until, contains, around, self_only, ())
    before_key = Cursor.key_of(cursor, bound) if cursor else None
    rows = messages.where(M.in_window("create_time", since, until))
    if self_only:
        rows = rows.where(M.self_or_unknown("sender_role"))
    order = KEY.columns()
    if around is not None:
        if before_key is not None:
            rows = rows.where(M.before(order, before_key))
        scanned = M.around(rows, around, min(scan_limit, return_limit), "create_time", order).withColumn("has_more", F.lit(False))
    else:
        scanned = M.page(rows, scan_limit, order, before_key)
    scanned = scanned.cache()
    try:
        facts = scanned.agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.max("has_more"), F.lit(False)).alias("more"), F.count_if(F.col("content").isNull()).alias("unreadable"),
            F.count_if(M.contains_text("content", contains) if contains else F.lit(True)).alias("hits"),
        ).head()
        matched = facts["hits"] > 0
        if contains and not matched:
            window = scanned.limit(0)
        elif contains:
            window = M.anchored(scanned, return_limit, order, anchor=M.contains_text("content", contains), time="create_time", at=around)
        elif around is not None:
            window = M.anchored(scanned, return_limit, order, time="create_time", at=around)
        else:
            window = M.anchored(scanned, return_limit, order)
        if "quoted" in messages.columns:
            ids = window.select(F.col("quoted").alias("id_value")).where("id_value is not null").distinct()
            targets = messages.join(F.broadcast(ids), "id_value", "left_semi")  # ids of one page
            window = M.attach_quotes(window, "quoted", targets, "id_value", ["content", "sender_role"])
        if people is not None:
            window = D.sender_labels(window, people, members, peer)
        found = [r.asDict(recursive=True) for r in M.ascending_limited(window, order).collect()]  # at most return_limit rows
    finally:
        scanned.unpersist()
    least = min((KEY.of(r) for r in found), default=None)
    more = bool(facts["more"]) or len(found) < facts["n"]
    gaps = [{"kind": "content_unreadable", "id": r["id_value"]} for r in found if r["content"] is None] + [{"kind": r["quote_gap"], "id": r["id_value"]} for r in found if r.get("quote_gap")]
    roles = {k: sum((r["sender_role"] or "unknown") == k for r in found) for k in ("self", "other", "system", "unknown")}
    search = M.search_status(matched, bool(facts["more"]), facts["unreadable"], cursor is not None) if contains else None
    partial = bool(gaps) if not contains or matched else more or bool(facts["unreadable"])
    for r in found:
        digest = {k: r[k] for k in sorted(r) if k in messages.columns}
        r["message_sha256"] = "sha256:" + hashlib.sha256(json.dumps(digest, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()
    return {
        "status": "partial" if partial else "success",
        "messages": found,
        "coverage": {"scanned": facts["n"], "returned": len(found), "has_more": more, "since": since, "until": until, "search": search, "roles": roles},
        "gaps": gaps,
        "nextCursor": replace(bound, key=least).encode() if more and least is not None and around is None else None,
        "manifest_sha256": "sha256:" + hashlib.sha256("\n".join(r["message_sha256"] for r in found).encode()).hexdigest(),
    }


def brief(rows: list[dict], now: int) -> list[dict]:
    """What a waiting reader needs of each message."""
    return [{"time": r["create_time"], "role": r["sender_role"], "content": r["content"], "minutesAgo": None if r["create_time"] is None else round((now - r["create_time"]) / 60, 1)} for r in rows]


def with_identity(messages: DataFrame) -> DataFrame:
    """Adds id_kind and id_value to stored messages: server, shard-local or row identity."""
    ident = S.record_identity(F.col("shard"), F.col("session_id"), F.col("server_id"), F.col("local_id"), F.col("rowid"))
    return messages.withColumn("_id", ident).select(*messages.columns, F.col("_id.kind").alias("id_kind"), F.col("_id.value").alias("id_value"))
