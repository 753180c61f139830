"""Canonical schemas, and reads that tolerate older layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A stored message. local_type may carry a subtype in its high 32 bits; ids of 0 mean no id.
_KINDS = {"string": T.StringType(), "bigint": T.LongType(), "binary": T.BinaryType()}
M_RAW = T.StructType(
    [
        T.StructField(name, _KINDS[kind])
        for kind, names in (
            ("string", ("account", "shard", "session_id")),
            ("bigint", ("rowid", "local_id", "local_type", "server_id", "real_sender_id", "create_time", "sort_seq", "status")),
            ("binary", ("message_content", "source", "packed_info_data", "compress_content", "origin_source")),
        )
        for name in names
    ]
)

#: Columns that older stores lack, with their type and the value that stands for them.
OPTIONAL_MESSAGE = {"status": ("bigint", None), "origin_source": ("binary", None)}
OPTIONAL_SESSION = {"type": ("bigint", None), "last_timestamp": ("bigint", None), "sort_timestamp": ("bigint", None), "is_hidden": ("bigint", 0)}
OPTIONAL_LABELS = {"alias": ("string", None), "remark": ("string", None), "nick_name": ("string", None)}


def require(df: DataFrame, *names: str) -> DataFrame:
    """Fails when a column that nothing can stand for is missing."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_optional(df: DataFrame, optional: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds each optional column that ``df`` lacks, as a literal of its type."""
    return df.withColumns({c: F.lit(value).cast(kind) for c, (kind, value) in optional.items() if c not in df.columns})


def union_all(*parts: DataFrame) -> DataFrame:
    """Bag union by name; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
