"""Server-sent events as a data source: folders of byte streams, read at once or as they grow.

    spark.dataSource.register(SseSource)
    spark.read.format("sse").load(folder)        # (stream_id, at, data, error)
    spark.readStream.format("sse").load(folder)  # the same rows, as the bytes arrive

A file is one stream of bytes, named by its file name. A row is an event: its lines of data, joined; `at`
is the number of bytes of the stream up to its end, which orders the events and identifies them. Bytes
may be cut anywhere, also between the two bytes of a line end or within a character; what is read is a
range of bytes, and an event belongs to the range in which its end is known: where the line end of its
blank line is, or, if that is a lone carriage return, the byte after it. So ranges of one file can be read
by many tasks, offsets are sizes of files alone, and a batch that is replayed after a failure gives the
same rows. An event that is not ended yet comes with a later batch; the end mark is an event like others.

error is bad_utf8 for an event that is no text, whose data is null. Files that are gone leave the offsets;
a file that has shrunk is an error. Files are read through pyarrow's file systems (local, HDFS, S3).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "stream_id string, at long, data string, error string"
#: Bytes of a range, and of a step back to the end of the event before it.
RANGE_BYTES, STEP_BYTES = 64 << 20, 64 << 10

_END = rb"(?:\r\n|\r(?!\n)|(?<!\r)\n)"
_LINE_END = re.compile(_END)
_BLANK = re.compile(_END + rb"(?=" + _END + rb")")


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def events_in(read, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(at, data) of the events whose end is known after byte `start` and by byte `end`; read(a, b) gives bytes of the stream."""
    begin = _event_before(read, start)
    data = read(begin, end)
    lines: list[bytes] = []
    at = 0
    for found in _LINE_END.finditer(data):
        last = found.end() == len(data)
        if last and found.group() == b"\r":
            return  # a line feed may follow
        line, at = data[at : found.start()], found.end()
        if line == b"data" or line.startswith(b"data:"):
            lines.append(line[5:].removeprefix(b" "))
        elif not line and lines:
            known = begin + found.end() + (found.group() == b"\r")
            if known > start:
                yield begin + found.end(), b"\n".join(lines)
            lines = []


def _event_before(read, start: int) -> int:
    """The end of a blank line known by byte `start`, or 0: from there on events can be read."""
    low = high = start
    while low > 0:
        low = max(0, low - STEP_BYTES)
        data = read(max(0, low - 1), min(start, high + 3))  # a byte more on the left: whether a line feed follows a return
        shift = max(0, low - 1)
        for found in reversed(list(_BLANK.finditer(data))):
            second = _LINE_END.match(data, found.end())
            # The first byte of the data may be the second of a line end; a last return may go on.
            if (found.start() or not shift) and not (second.end() == len(data) and second.group() == b"\r"):
                return shift + second.end()
        high = low
    return 0


class _Files:
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("a folder of byte streams is needed: load(folder)")
        self.path, self.range_bytes = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def sizes(self) -> dict[str, int]:
        """The size of each file of the folder; hidden files are left out."""
        system, path = arrow_fs.FileSystem.from_uri(self.path)
        files = system.get_file_info(arrow_fs.FileSelector(path, allow_not_found=True))
        return {f.base_name: f.size for f in files if f.type == arrow_fs.FileType.File and not f.base_name.startswith((".", "_"))}

    def ranges(self, begin: dict[str, int], end: dict[str, int]) -> list[ByteRange]:
        out = []
        for name, size in sorted(end.items()):
            at = begin.get(name, 0)
            if at > size:
                raise ValueError(f"{name} has shrunk from {at} to {size} bytes")
            while at < size:
                stop = min(size, at + self.range_bytes)
                out.append(ByteRange(name, at, stop))
                at = stop
        return out

    def rows(self, part: ByteRange) -> Iterator[tuple]:
        system, folder = arrow_fs.FileSystem.from_uri(self.path)
        with system.open_input_file(f"{folder.rstrip('/')}/{part.path}") as file:
            for at, data in events_in(lambda a, b: file.read_at(b - a, a), part.start, part.end):
                try:
                    yield part.path, at, data.decode(), None
                except UnicodeDecodeError:
                    yield part.path, at, None, "bad_utf8"


class SseReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def partitions(self) -> list[ByteRange]:
        return self.files.ranges({}, self.files.sizes()) or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        return self.files.rows(partition) if partition.end else iter(())


class SseStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.files = _Files(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.files.sizes()

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        return self.files.ranges(start, end)

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        return self.files.rows(partition)


class SseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sse"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SseReader:
        return SseReader(self.options)

    def streamReader(self, schema: StructType) -> SseStreamReader:
        return SseStreamReader(self.options)
