"""A stream source over a folder of growing JSON-lines logs, with offsets by file."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = (
    "chat_id string, sender_id string, is_self boolean, resync boolean, sequence long, message_id string, kind int, received_at long, text string, file string, position long"
)


class Slice(InputPartition):
    """Whole lines of one file."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Logs:
    """Files of a folder, in any store that pyarrow reads by its address."""

    def __init__(self, options: dict[str, str]):
        self.address = options["path"]
        self.suffix, self.block = options.get("suffix", ".jsonl"), int(options.get("blockBytes", 8 << 20))

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.address) if "://" in self.address or self.address.startswith("file:") else (pafs.LocalFileSystem(), self.address)

    def sizes(self) -> dict[str, int]:
        fs, root = self._open()
        return {i.path: i.size for i in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if i.type == pafs.FileType.File and i.path.endswith(self.suffix)}

    def whole(self, path: str, start: int, size: int) -> int:
        """The end of the last whole line within [start, size); a torn last line waits for its rest."""
        fs, _ = self._open()
        with fs.open_input_file(path) as f:
            at = size
            while at > start:
                low = max(start, at - (64 << 10))
                cut = f.read_at(at - low, low).rfind(b"\n")
                if cut >= 0:
                    return low + cut + 1
                at = low
        return start

    def lines(self, part: Slice) -> Iterator[tuple[int, bytes]]:
        fs, _ = self._open()
        with fs.open_input_file(part.path) as f:
            at, begin, rest = part.start, part.start, b""
            while at < part.end:
                block = f.read_at(min(self.block, part.end - at), at)
                if not block:
                    raise EOFError(f"event_log_truncated: {part.path} at {at}")
                at += len(block)
                *whole, rest = (rest + block).split(b"\n")
                for line in whole:
                    yield begin, line
                    begin += len(line) + 1

    def rows(self, part: Slice, schema: StructType) -> Iterator[tuple]:
        for position, line in self.lines(part):
            if not line.strip():
                continue
            event = json.loads(line)
            if not isinstance(event, dict):
                raise ValueError(f"event_line_invalid: {part.path} at {position}")
            yield tuple(part.path if f.name == "file" else position if f.name == "position" else _typed(event.get(f.name), f.dataType.typeName()) for f in schema)


def _typed(value, kind: str):
    """The value if it is of the column's type, else null; no value is converted."""
    wanted = {"string": str, "boolean": bool, "long": int, "integer": int}[kind]
    return value if type(value) is wanted else None


class EventReader(DataSourceReader):
    """The events that are there now, as a batch."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.logs = schema, _Logs(options)

    def partitions(self) -> list[InputPartition]:
        return [Slice(p, 0, self.logs.whole(p, 0, n)) for p, n in sorted(self.logs.sizes().items())] or [Slice("", 0, 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return self.logs.rows(partition, self.schema) if partition.end > partition.start else iter(())


class EventStreamReader(DataSourceStreamReader):
    """Offsets are the read bytes of each file, so that a restart goes on behind the last finished batch."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.logs = schema, _Logs(options)
        self.latest = options.get("startingOffsets", "earliest") == "latest"
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return self.latestOffset() if self.latest else {}

    def latestOffset(self) -> dict:  # noqa: N802
        for path, size in self.logs.sizes().items():
            had = self.known.get(path, 0)
            if size > had:
                self.known[path] = self.logs.whole(path, had, size)
        return dict(sorted(self.known.items()))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # A large stretch of one file is one partition: lines have no fixed length.
        return [Slice(p, start.get(p, 0), n) for p, n in end.items() if n > start.get(p, 0)] or [Slice("", 0, 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return self.logs.rows(partition, self.schema) if partition.end > partition.start else iter(())

    def commit(self, end: dict) -> None:
        """Logs are kept: the record, not the stream, decides what goes."""


class EventSource(DataSource):
    """``spark.dataSource.register(EventSource)``, then ``spark.readStream.format("tidemark_events").option("path", ...)``.

    Options: path, suffix (.jsonl), startingOffsets (earliest or latest), blockBytes. Lines are JSON objects;
    fields of another type than the column's are null, other fields are left out, a line that is no object fails the query.
    """

    @classmethod
    def name(cls) -> str:
        return "tidemark_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return EventReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return EventStreamReader(schema, dict(self.options))
