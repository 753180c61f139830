"""Column functions: numbers, times, hashes, text projections. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import markup as M

ZONE = "Asia/Shanghai"
#: Fixed values of the message format: base types that stand for themselves.
KNOWN_TYPES = (1, 3, 34, 42, 43, 47, 48, 49, 50, 10000)
#: The app subtypes (in the high 32 bits) of stickers and of generated pat events.
STICKER_APP, PAT_EVENT = (8 << 32) | 49, (62 << 32) | 49
#: Statuses that say the direction, and those that a calibrated sender decides.
OUTGOING, INCOMING, CALIBRATED = 2, 4, (0, 3, 5)
SYSTEM = 10000
#: Fixed values of the message format: the titles of money transfers and of red packets.
TRANSFER_TITLE, RED_PACKET_TITLE = "微信转账", "微信红包"
#: Fixed values of the message format: what the subtypes of a transfer mean, and any other.
TRANSFER_STATES, TRANSFER_UNKNOWN = {"1": "转账已发起", "3": "转账已确认收款", "4": "转账已退还"}, "转账状态未知"


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def present_id(c: Column) -> Column:
    """Ids of 0, as number or text, mean none."""
    text = c.cast("string")
    return F.when((text != "0") & (text != ""), text)


def native_id(server_id: Column, local_id: Column) -> Column:
    """struct(kind, value): the server's id where there is one, else the local one, else null."""
    local = local_id.cast("string")
    return F.when(present_id(server_id).isNotNull(), F.struct(F.lit("server").alias("kind"), present_id(server_id).alias("value"))).when(
        local.isNotNull() & (local != ""), F.struct(F.lit("local").alias("kind"), local.alias("value"))
    )


def record_identity(shard: Column, table: Column, server_id: Column, local_id: Column, rowid: Column) -> Column:
    """struct(kind, value): server ids hold everywhere, local and row ids within a shard's table only."""
    scope = F.sha2(F.concat(shard, F.lit("\0"), table), 256)
    return (
        F.when(present_id(server_id).isNotNull(), F.struct(F.lit("server").alias("kind"), present_id(server_id).alias("value")))
        .when(present_id(local_id).isNotNull(), F.struct(F.lit("local").alias("kind"), F.concat_ws(":", scope, present_id(local_id)).alias("value")))
        .otherwise(F.struct(F.lit("row").alias("kind"), F.concat_ws(":", scope, rowid.cast("string")).alias("value")))
    )


def session_type(username: Column) -> Column:
    u = F.lower(username)
    return F.when(F.startswith(u, F.lit("gh_")), "channel").when(F.endswith(u, F.lit("@chatroom")), "group").otherwise("contact")


def display_name(remark: Column, nickname: Column, alias: Column, native: Column) -> Column:
    return F.coalesce(blank_to_null(remark), blank_to_null(nickname), blank_to_null(alias), native)


def match_fields(*labels: Column) -> Column:
    """The set of non-empty labels that a query may name."""
    return F.array_distinct(F.array_compact(F.array(*[blank_to_null(c) for c in labels])))


def base_type(local_type: Column) -> Column:
    """The base message type: stickers sent as apps are stickers; packed types are their low byte if that is known."""
    n = local_type.cast("bigint")
    low = n.bitwiseAND(F.lit(255))
    return F.when(n == STICKER_APP, F.lit(47).cast("bigint")).when(n.isin(*KNOWN_TYPES), n).when((n > 0xFFFF) & low.isin(*KNOWN_TYPES), low).otherwise(n)


def sender_key(sender: Column) -> Column:
    n = sender.cast("string").try_cast("bigint")
    return F.when(n > 0, n)


def sender_role(local_type: Column, status: Column, sender: Column, calibrated: Column, by_dictionary: Column, by_dictionary_only: Column | None = None) -> Column:
    """self, other, system or unknown.

    Pat events and system messages are system. Sessions of the kind ``by_dictionary_only`` go by the
    dictionary alone (``by_dictionary``: whether the sender's name is the owner's; null if unknown).
    Else status 2 and 4 say it; statuses 0, 3 and 5 compare the sender with the shard's calibrated
    own id; what that can't reach goes by the dictionary.
    """
    named = F.when(by_dictionary, "self").when(~by_dictionary, "other")
    known = F.when(status == OUTGOING, "self").when(status == INCOMING, "other")
    key = sender_key(sender)
    measured = F.when(status.isin(*CALIBRATED) & calibrated.isNotNull() & key.isNotNull(), F.when(key == calibrated, "self").otherwise("other"))
    reachable = ~F.coalesce(status.isin(*CALIBRATED) & calibrated.isNotNull(), F.lit(False))
    ladder = F.coalesce(known, measured, F.when(reachable, named), F.lit("unknown"))
    if by_dictionary_only is not None:
        ladder = F.when(by_dictionary_only, F.coalesce(named, F.lit("unknown"))).otherwise(ladder)
    return F.when(F.coalesce((local_type == PAT_EVENT) | (base_type(local_type) == SYSTEM), F.lit(False)), "system").otherwise(ladder)


def direction(role: Column) -> Column:
    return F.when(role == "self", "outgoing").when(role == "other", "incoming").otherwise(role)


def is_owner(username: Column, owner_sha256: str | None) -> Column:
    """Whether a name is the owner's, by its hash; null where name or hash is unknown."""
    return F.sha2(username, 256) == F.lit(owner_sha256)


def known_time(t: Column) -> Column:
    n = t.cast("string").try_cast("bigint")
    return F.when(n > 0, n)


def local_time(seconds: Column, pattern: str = "yyyy-MM-dd HH:mm:ss", zone: str = ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone), pattern)


def moment(seconds: Column) -> Column:
    return local_time(seconds, "yyyy-MM-dd'T'HH:mm:ss'+08:00'")


def parse_time(text: Column, zone: str = ZONE) -> Column:
    """Seconds of an ISO time; a time without an offset is local."""
    aware = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return F.unix_seconds(F.when(aware, F.try_to_timestamp(text)).otherwise(F.to_utc_timestamp(F.try_to_timestamp(text), zone)))


def month_candidates(seconds: Column) -> Column:
    """The months that a local clock may have shown at the time, whatever its zone."""
    return F.array_distinct(F.array(*[F.date_format(F.timestamp_seconds(seconds + h * 3600), "yyyy-MM") for h in (-12, 0, 14)]))


def prefixed_sha256(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def canonical_json(*columns: str) -> Column:
    """Sorted keys, nulls kept, line separators escaped; equal records give equal bytes."""
    text = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return F.replace(F.replace(text, F.lit("\u2028"), F.lit("\\u2028")), F.lit("\u2029"), F.lit("\\u2029"))


def locator(scheme: str, account: str, *columns: str) -> Column:
    """A typed pointer that is bound to an account by a commitment."""
    return F.concat(F.lit(f"{scheme}://"), F.sha2(F.lit(account), 256), F.lit("/v1/"), F.base64(F.to_json(F.struct(*columns)).cast("binary")))


def decode_locator(text: Column, account: str, schema: str) -> Column:
    """The pointer's keys; one of another account fails the query."""
    own = F.regexp_extract(text, "^[a-z-]+://([0-9a-f]{64})/v1/", 1) == F.sha2(F.lit(account), 256)
    return F.from_json(F.when(own, F.unbase64(F.regexp_extract(text, "/v1/(.*)$", 1)).cast("string")).otherwise(F.raise_error(F.lit("locator_account_mismatch")).cast("string")), schema)


def readable(value: Column) -> Column:
    """Bytes as text if they are valid UTF-8, else null."""
    text = value.cast("string")
    return F.when(F.is_valid_utf8(text), text)


_EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def safe_text(value: Column, drop: str = "") -> Column:
    """Trimmed text; null if empty or if it has control signs other than line ends and tabs (``drop``: signs that are taken out)."""
    t = F.regexp_replace(value, _EDGES, "")
    if drop:
        t = F.regexp_replace(t, f"[{drop}]", "")
    return F.when((t != "") & ~t.rlike(r"[\p{Cc}&&[^\n\r\t]]"), t)


def tag_text(xml: Column, tag: str, any_case: bool = False) -> Column:
    """The text of the first element of a name, CDATA or not, over line ends; null if there is none."""
    found = F.regexp_extract(xml, f"(?s{'i' if any_case else ''})<{tag}>(?:<!\\[CDATA\\[)?(.*?)(?:\\]\\]>)?</{tag}>", 1)
    return F.when(found != "", found)


def link_text(xml: Column) -> Column:
    """Title, description, address and file name of an app message, distinct, a line each."""
    parts = F.array_compact(F.array(*[safe_text(tag_text(xml, t)) for t in ("title", "des", "url", "filename")]))
    return F.when(F.size(parts) > 0, F.array_join(F.array_distinct(parts), "\n"))


def red_packet_text(xml: Column) -> Column:
    """The title of a red packet, which is all that it says; null for anything else."""
    title = safe_text(tag_text(xml, "title", True))
    return F.when(title == RED_PACKET_TITLE, title)


def transfer_text(xml: Column) -> Column:
    """The state of a money transfer by its subtype, with the amount; null for anything else, red packets included."""
    title, subtype = safe_text(tag_text(xml, "title", True)), safe_text(tag_text(xml, "paysubtype", True))
    marked = tag_text(xml, "paysubtype", True).isNotNull() | xml.rlike("(?i)<(transferid|paymsgid|feedesc)>") | F.coalesce(title == TRANSFER_TITLE, F.lit(False))
    state = F.lit(TRANSFER_UNKNOWN)
    for code, said in TRANSFER_STATES.items():
        state = F.when(subtype == code, said).otherwise(state)
    amount = safe_text(tag_text(xml, "feedesc", True))
    text = F.concat(F.lit(f"{TRANSFER_TITLE}\n"), state, F.coalesce(F.concat(F.lit("，金额 "), amount), F.lit("")))
    return F.when(marked & red_packet_text(xml).isNull(), text)


def call_text(xml: Column) -> Column:
    """The outcome of a call: its message, else the displayed text, else a duration above 0."""
    said = F.when(xml.rlike(r"(?i)<voipmsg(\s[^>]*)?>"), safe_text(tag_text(xml, "msg", True)))
    shown = [safe_text(tag_text(xml, t, True)) for t in ("diaplay_content", "display_content")]  # the first spelling occurs in real data
    seconds = F.regexp_extract(xml, r"(?i)<duration>(\d+)</duration>", 1)
    return F.coalesce(said, *shown, F.when(seconds.try_cast("bigint") > 0, F.concat(F.lit("通话时长 "), seconds)))


def without_speaker(value: Column, before: str) -> Column:
    """Takes off the line that names the speaker in front of what ``before`` matches."""
    return F.regexp_replace(value, rf"^\s*[^\s<>:]+:\s*\n(?={before})", "")


def location_text(value: Column) -> Column:
    """Distinct place names, else both coordinates, else a note that there is no name; null where the body is no place.

    The place is the body's root, or the first of its kind right below a ``msg`` root.
    """
    doc = M.document(without_speaker(F.regexp_replace(value, _EDGES, ""), "<"))
    place = F.coalesce(M.first(doc["location"]), M.first(M.flat(doc["msg"], "location")))
    names = F.array_distinct(F.array_compact(F.array(*[safe_text(place[f"_{a}"]) for a in ("poiname", "label")])))
    x, y = (safe_text(place[f"_{a}"]) for a in ("x", "y"))
    shown = F.when(F.size(names) > 0, F.array_join(names, "；")).when(x.isNotNull() & y.isNotNull(), F.concat_ws("，", x, y))
    return F.when(place.isNotNull(), F.coalesce(F.concat(F.lit("位置分享："), shown), F.lit("位置分享（未提供地点名称）")))


def system_text(value: Column) -> Column:
    """System notices: plain ones as they are, withdrawals as such, templates by their plain text or with their links' displays put in.

    A speaker's line in front of a notice is taken off. A body that isn't well formed has no text, and no markup is ever shown: of an
    element with children only the text before the first counts.
    """
    body = without_speaker(value, r"<sysmsg\b")
    plain = F.when(~F.startswith(F.ltrim(body), F.lit("<")), safe_text(body, "\x14"))
    doc = M.document(body)
    notice = M.first(doc["sysmsg"])
    template = M.first(M.flat(notice["sysmsgtemplate"], "content_template"))
    path = "sysmsg/sysmsgtemplate/content_template"

    def shown(name: str) -> Column:
        return safe_text(M.leading_text(body, doc, M.first(template[name]), f"{path}[1]/{name}[1]"), "\x14")

    def display(link: Column) -> Column:
        nickname = M.first(M.flat(M.flat(link["memberlist"], "member"), "nickname"))
        own = [F.substring_index(x, "<", 1) for x in (M.first(link["plain"]), M.first(link["title"]), nickname)]
        return F.struct(F.concat(F.lit("$"), link["_name"], F.lit("$")).alias("name"), F.coalesce(*[safe_text(x, "\x14") for x in own]).alias("text"))

    # Of links of one name the last that has a display counts; what a display says is not looked at again.
    links = F.reverse(F.filter(F.transform(M.flat(template["link_list"], "link"), display), lambda x: x["name"].isNotNull() & x["text"].isNotNull()))
    pieces = F.regexp_extract_all(shown("template"), F.lit(r"(?s)\$[A-Za-z_][A-Za-z0-9_]*\$|[^$]+|\$"), F.lit(0))
    filled = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(F.filter(links, lambda x: x["name"] == p), F.lit(1))["text"], p)), "")
    withdrawn = F.when(F.size(notice["revokemsg"]) > 0, "消息已撤回")
    return F.coalesce(plain, withdrawn, F.when(notice["_type"] == "sysmsgtemplate", F.coalesce(shown("plain"), safe_text(filled, "\x14"))))


def message_text(content: Column, kind: Column) -> Column:
    """The readable body by base type; null where the type has none."""
    call = F.when(content.rlike("[<>]"), call_text(content)).otherwise(safe_text(content))
    call = F.when((F.char_length(call) <= 128) & ~call.rlike(r"^([0-9a-fA-F]{32,}|\d+)$"), call)
    return (
        F.when(kind == SYSTEM, system_text(content))
        .when(kind == 1, safe_text(content, "\x14"))
        .when(kind == 48, location_text(content))
        .when(kind == 50, call)
        .when(kind == 49, F.coalesce(red_packet_text(content), transfer_text(content), link_text(content)))
    )


def quote_ids(source: Column) -> Column:
    """Distinct ids that a message's source quotes; more than one is a conflict, for the caller to report."""
    found = F.regexp_extract_all(source, F.lit(r"(?s)<refermsg>.*?<(?:svrid|msgid|newmsgid)>(?:<!\[CDATA\[)?([^<\]]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))


def preview(text: Column, size: int = 2048) -> Column:
    """struct(head, chars, bytes, sha256): what a reader needs to show a long text and fetch the rest."""
    return F.struct(F.substring(text, 1, size).alias("head"), F.char_length(text).alias("chars"), F.octet_length(text).alias("bytes"), prefixed_sha256(text).alias("sha256"))


def text_slice(text: Column, offset: int, size: int, sha256: Column) -> Column:
    """An exact slice by code points; a text that has changed since fails the query."""
    return F.when(prefixed_sha256(text) == sha256, F.substring(text, offset + 1, size)).otherwise(F.raise_error(F.lit("text_changed")).cast("string"))


def compact_text(text: Column, placeholder: Column | None = None) -> Column:
    """One kind of line end, no blank edges; ``placeholder`` where nothing is left."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), _EDGES, "")
    return F.coalesce(F.when(t != "", t), placeholder if placeholder is not None else F.lit(None).cast("string"))


def quote_line(speaker: Column, text: Column, size: int = 240) -> Column:
    flat = F.regexp_replace(text, r"\s+", " ")
    return F.concat(F.lit("> "), speaker, F.lit("："), F.when(F.char_length(flat) > size, F.concat(F.substring(flat, 1, size - 1), F.lit("…"))).otherwise(flat))


def safe_filename(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(name, r'[\x00-\x1f<>:"/\\|?*]+', "_"), r"^[. ]+|[. ]+$", ""), F.lit("")), F.lit("file"))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def without_storage_suffix(native: Column) -> Column:
    """Takes off one underscore and four hexadecimal digits that a store may append to an id."""
    return F.regexp_replace(native, "^(.+)_[0-9a-fA-F]{4}$", "$1")


def typing_seconds(text: Column, per_sign: float = 0.25, per_mark: float = 0.5) -> Column:
    """An estimate of the time to type: marks in brackets count as one key each."""
    marks = F.regexp_count(text, F.lit(r"\[[^\[\]]{1,8}\]"))
    return F.char_length(F.regexp_replace(text, r"\[[^\[\]]{1,8}\]", "")) * per_sign + marks * per_mark


#: Leading bytes of file formats.
MAGIC = (("jpg", "FFD8FF"), ("png", "89504E470D0A1A0A"), ("gif", "47494638"), ("pdf", "25504446"), ("zip", "504B0304"), ("mp3", "494433"), ("silk", "02232153494C4B"), ("silk", "232153494C4B"))


def sniffed(content: Column) -> Column:
    """A file extension by leading bytes; bin where none is known."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.when(head.rlike("^52494646.{8}57454250"), "webp").when(head.rlike("^52494646.{8}57415645"), "wav").when(head.rlike("^.{8}66747970"), "mp4")
    for kind, magic in MAGIC:
        out = out.when(F.startswith(head, F.lit(magic)), kind)
    return out.otherwise("bin")


def contained_path(path: Column) -> Column:
    """A relative path that stays below its root, else an error."""
    bad = path.rlike(r"^([/\\]|[A-Za-z]:)") | path.rlike(r"(^|[/\\])\.\.([/\\]|$)") | path.rlike(r"[\x00-\x1f]") | (path == "")
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("path_outside_package")).cast("string")).otherwise(path)
