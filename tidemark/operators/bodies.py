"""From stored rows to public messages: payload texts, the body by type, gaps, quotes and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import decode as D
from tidemark.functions import scalar as S
from tidemark.schema import OPTIONAL_MESSAGE, require, with_optional

#: Fixed values of the message format: names of base types, and the types whose body may be missing.
TYPE_NAMES = {1: "text", 3: "image", 34: "voice", 43: "video", 47: "emoji", 48: "location", 49: "app", 50: "call", 10000: "system"}
BODILESS = (3, 34, 43, 47)
#: What a place without any readable body is shown as (fixed value).
PLACE_UNKNOWN = "位置分享（地点信息不可用）"


def framed(value: Column) -> Column:
    """Whether bytes hold a zstd frame's mark that begins and ends within the first 64."""
    return F.hex(F.substring(value, 1, 64)).rlike("^(..){0,60}28B52FFD")


def value_text(value: Column, drop: str = "\x14") -> Column:
    """struct(text, gap) of a content column: a bounded zstd body is inflated, other bytes are text if they are valid and readable.

    Only framed bodies are sent to Python.
    """
    packed = F.coalesce(framed(value), F.lit(False))
    inflated = D.decompressed(F.when(packed, value))
    return F.when(packed, inflated).otherwise(F.struct(S.safe_text(S.readable(value), drop).alias("text"), F.lit(None).cast("string").alias("gap")))


def with_payloads(messages: DataFrame) -> DataFrame:
    """Adds bodies (texts of the two content columns), payloads (bodies and the readable side columns), both distinct and in order, and body_gap."""
    rows = with_optional(require(messages, "message_content", "compress_content", "source", "packed_info_data"), OPTIONAL_MESSAGE)
    rows = rows.withColumns({"_m": value_text(F.col("message_content")), "_c": value_text(F.col("compress_content"))})
    bodies = F.array_distinct(F.array_compact(F.array("_m.text", "_c.text")))
    side = F.array_compact(F.array(*[S.safe_text(S.readable(F.col(c))) for c in ("source", "packed_info_data", "origin_source")]))
    rows = rows.withColumns({"bodies": bodies, "body_gap": F.coalesce("_m.gap", "_c.gap"), "_side": side})
    return rows.withColumn("payloads", F.array_distinct(F.concat("bodies", "_side"))).drop("_m", "_c", "_side")


def body_text(base: Column) -> Column:
    """The first readable body: of the payloads for app messages, of bodies and both source columns for calls, of the bodies else; voice has its transcript."""
    sources = F.array_compact(F.array(*[S.safe_text(S.readable(F.col(c))) for c in ("source", "origin_source")]))
    candidates = F.when(base == 49, F.col("payloads")).when(base == 50, F.array_distinct(F.concat("bodies", sources))).otherwise(F.col("bodies"))
    said = F.get(F.filter(F.transform(candidates, lambda text: S.message_text(text, base)), lambda x: x.isNotNull()), F.lit(0))
    voice = D.voice_transcript(F.when(base == 34, F.col("packed_info_data")))
    return F.when(base == 34, voice).otherwise(said)


def quoted_ids(payloads: Column) -> Column:
    """Distinct ids that any payload quotes."""
    return F.array_distinct(F.flatten(F.transform(payloads, S.quote_ids)))


def shard_local_identity(shard: Column, session: Column, server_id: Column, local_id: Column) -> Column:
    """The identity of a message without a server id: its local id, bound to its shard's table."""
    key = F.concat(shard, F.lit("\0"), session)
    local = S.present_id(local_id)
    return F.when(S.present_id(server_id).isNull() & local.isNotNull(), S.prefixed_sha256(F.concat(key, F.lit("\0"), local)))


def public_messages(selected: DataFrame) -> DataFrame:
    """Public messages of rows with roles (``messages.with_roles``): apply it to a page, as it decodes every row.

    Columns: server_id, local_id, local_type, sort_seq, create_time, status, type, content, is_send, is_system, sender_role, direction, sender_username,
    sender_gap, direction_gap, content_gap, content_source, quoted_id, quote_gap, shard_local_identity, payloads.
    """
    rows = with_payloads(selected).withColumn("_base", S.base_type(F.col("local_type")))
    rows = rows.withColumn("_said", body_text(F.col("_base"))).withColumn("_ids", quoted_ids(F.col("payloads")))
    base, role = F.col("_base"), F.col("sender_role")
    content = F.coalesce(F.col("_said"), F.when(base == 48, PLACE_UNKNOWN))
    named = F.coalesce(*[F.when(base == k, name) for k, name in TYPE_NAMES.items()], F.lit("unknown"))
    gap = F.coalesce(F.col("body_gap"), F.when(base == 50, "call_status_unavailable").when(F.coalesce(base.isin(*TYPE_NAMES), F.lit(False)), "message_content_unparsed").otherwise("message_type_unsupported"))
    person = role.isin("self", "other")
    return rows.select(
        F.col("server_id").cast("string").alias("server_id"), "local_id", "local_type", "sort_seq", "create_time", "status",
        F.when(role == "system", "system").otherwise(named).alias("type"),
        content.alias("content"), "is_send", (role == "system").alias("is_system"), "sender_role", "direction",
        F.when(role == "system", "system").when(person, F.col("sender_username")).alias("sender_username"),
        F.when(person & F.col("sender_username").isNull(), "sender_mapping_unresolved").alias("sender_gap"),
        F.when(role == "unknown", "message_status_unproven").alias("direction_gap"),
        F.when(content.isNull() & ~F.coalesce(base.isin(*BODILESS), F.lit(False)), gap).alias("content_gap"),
        F.when((base == 34) & content.isNotNull(), "native_cache").alias("content_source"),
        F.when(F.size("_ids") == 1, F.get("_ids", F.lit(0))).alias("quoted_id"),
        F.when(F.size("_ids") > 1, "quote_identity_conflict").alias("quote_gap"),
        shard_local_identity(F.col("shard"), F.col("session_id"), F.col("server_id"), F.col("local_id")).alias("shard_local_identity"),
        "payloads",
    )
