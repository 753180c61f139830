"""Arrow-batched functions for what built-in expressions can't say: Unicode folding, similarity, zstd, wire fields.

Use them above a limit or a filter: Catalyst pushes no filter through them.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of a message body and of a wire message (fixed values of the format).
MOST_BODY, MOST_WIRE, MOST_DEPTH = 4 << 20, 1 << 16, 8
FRAME = b"\x28\xb5\x2f\xfd"
_SEPARATORS = ("P", "S", "Z")


def fold_name(text: str | None) -> str | None:
    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def loosen_name(text: str | None) -> str | None:
    return None if text is None else "".join(c for c in fold_name(text) if not c.isspace() and unicodedata.category(c)[0] not in _SEPARATORS)


@F.pandas_udf(T.StringType())
def normalized_name(names: pd.Series) -> pd.Series:
    return names.map(fold_name, na_action="ignore")


@F.pandas_udf(T.StringType())
def loose_name(names: pd.Series) -> pd.Series:
    return names.map(loosen_name, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Gestalt similarity of two names to four places; null where a name is."""
    return pd.Series([None if x is None or y is None else round(SequenceMatcher(None, x, y).ratio(), 4) for x, y in zip(a, b, strict=True)], dtype="float64")


def inflate(raw: bytes | None, most: int = MOST_BODY) -> tuple[str | None, str | None]:
    """(text, gap) of a compressed body; the frame may start within the first 64 bytes."""
    if not raw:
        return None, None
    at = raw.find(FRAME, 0, 64)
    if at < 0:
        return None, "compressed_content_format_unsupported"
    frame = raw[at:]
    try:
        # No more than the bound is ever inflated, whatever size the frame names.
        clear = zstandard.ZstdDecompressor().stream_reader(frame, read_across_frames=False).read(most + 1)
        whole = len(clear) <= most
        if whole:
            stream = zstandard.ZstdDecompressor().decompressobj(read_across_frames=False)
            stream.decompress(frame)
            whole = stream.eof
    except (zstandard.ZstdError, MemoryError):
        return None, "compressed_content_decode_failed"
    if not whole:
        return None, "compressed_content_exceeds_limit"
    try:
        text = clear.decode().strip()
    except UnicodeDecodeError:
        return None, "compressed_content_text_invalid"
    return (text, None) if text else (None, "compressed_content_empty")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("gap", T.StringType())]))
def decompressed(bodies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([inflate(None if b is None else bytes(b)) for b in bodies], columns=["text", "gap"])


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for k in range(10):
        if at + k >= len(data):
            break
        value |= (data[at + k] & 0x7F) << (7 * k)
        if data[at + k] < 0x80:
            if value >> 64:
                break
            return value, at + k + 1
    raise ValueError("varint")


def wire_fields(data: bytes) -> list[tuple[int, int, int | bytes | None]]:
    """(number, wire type, value) of the top-level fields of an unknown wire message; groups are skipped whole. ValueError if malformed or too large."""
    if len(data) > MOST_WIRE:
        raise ValueError("size")
    out, at, opened = [], 0, []
    while at < len(data):
        tag, at = _varint(data, at)
        number, kind = divmod(tag, 8)
        if not 1 <= number < 1 << 29:
            raise ValueError("number")
        value: int | bytes | None = None
        match kind:
            case 0:
                value, at = _varint(data, at)
            case 1 | 2 | 5:
                size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
                value, at = data[at : at + size], at + size
                if at > len(data):
                    raise ValueError("truncated")
            case 3:
                if len(opened) == MOST_DEPTH:
                    raise ValueError("depth")
            case 4:
                if not opened or opened.pop() != number:
                    raise ValueError("group")
                continue
            case _:
                raise ValueError("wire type")
        if not opened:
            out.append((number, kind, value))
        if kind == 3:
            opened.append(number)
    if opened:
        raise ValueError("open group")
    return out


def _single(data: bytes, number: int) -> bytes | None:
    """The only field of a number, if it is length-delimited."""
    found = [(kind, value) for n, kind, value in wire_fields(data) if n == number]
    return found[0][1] if len(found) == 1 and found[0][0] == 2 else None


def transcript_of(packed: bytes | None) -> str | None:
    """The finished transcript of a voice message: field 5 with state 2 in its field 1 and one text in its field 2."""
    try:
        inner = _single(packed, 5) if packed else None
        if inner is None or [(k, v) for n, k, v in wire_fields(inner) if n == 1] != [(0, 2)]:
            return None
        text = (_single(inner, 2) or b"").decode().strip()
    except ValueError:
        return None
    return text if text and "\0" not in text else None


def image_stem_of(packed: bytes | None) -> str | None:
    """The 32 hexadecimal digits that name an image: field 4 of field 3."""
    try:
        inner = _single(packed, 3) if packed else None
        name = (_single(inner, 4) or b"").decode("ascii") if inner is not None else ""
    except ValueError:
        return None
    return name.lower() if re.fullmatch("[0-9a-fA-F]{32}", name) else None


@F.pandas_udf(T.StringType())
def voice_transcript(packed: pd.Series) -> pd.Series:
    return packed.map(lambda b: transcript_of(None if b is None else bytes(b)))


@F.pandas_udf(T.StringType())
def image_stem(packed: pd.Series) -> pd.Series:
    return packed.map(lambda b: image_stem_of(None if b is None else bytes(b)))


@F.udtf(returnType=T.StructType([T.StructField("number", T.IntegerType()), T.StructField("wire", T.IntegerType()), T.StructField("value", T.BinaryType()), T.StructField("varint", T.StringType())]))
class WireFields:
    """The fields of a wire message as rows; a malformed one gives none."""

    def eval(self, data: bytes):
        try:
            found = wire_fields(bytes(data)) if data is not None else []
        except ValueError:
            return
        for number, kind, value in found:
            yield number, kind, value if isinstance(value, bytes) else None, str(value) if isinstance(value, int) else None
