"""Trace files that are still being written, as a source of raw events.

Spark's file sources read a file once. A trace file grows while its session runs, so this source remembers how many bytes of it
are read. Its offset is the name up to which files are finished and the bytes read of the newest files after it, which may still
grow: names are in time order, so a file is finished once enough newer ones are there. The offset therefore does not grow with the
number of files.

A range of bytes gives the events that *end* in it, wherever a range begins: a reader looks back to the end of the event before.
So an event that is half written waits for the rest, a range can be cut anywhere, large files are read by many tasks, and a
batch that is repeated reads the same events.

Any store that ``pyarrow.fs`` opens can be read (local and mounted folders, HDFS, S3, GCS). Executors import this module.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamReader

FORMAT = "trace_tail"
_END = b"</event>"
_START = re.compile(rb"<event[\s>]")
#: Newest files that may still grow; bytes of a task, of one read, and of the events of one Arrow batch.
OPEN_FILES = 100
SPLIT_BYTES = 64 << 20
READ_BYTES = 4 << 20
BATCH_BYTES = 4 << 20
_SCHEMA = pa.schema([("file_name", pa.string()), ("file_offset", pa.int64()), ("event_data", pa.string())])


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def _end_before(file, place: int) -> int:
    """Where the last event that ends at or before ``place`` ends; 0 without one."""
    high, after = place, b""
    while high > 0:
        low = max(0, high - READ_BYTES)
        file.seek(low)
        block = file.read(high - low) + after
        found = block.rfind(_END)
        if found >= 0:
            return low + found + len(_END)
        # An end tag may lie across two blocks.
        high, after = low, block[: len(_END) - 1]
    return 0


def events_ending_in(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the events whose last byte lies from ``start`` to before ``end``."""
    base = _end_before(file, start)
    file.seek(base)
    held, place, scanned = b"", base, 0
    while place < end:
        block = file.read(min(READ_BYTES, end - place))
        if not block:
            return
        place += len(block)
        held += block
        done = 0
        while (found := held.find(_END, max(done, scanned))) >= 0:
            after = found + len(_END)
            # What is between two events, or one that was broken off, is no part of the last one.
            begun = [m.start() for m in _START.finditer(held, done, found)]
            if begun:
                yield base + begun[-1], held[begun[-1] : after]
            done = scanned = after
        held, base = held[done:], base + done
        scanned = max(0, len(held) - len(_END) + 1)


class _Files:
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError(f"{FORMAT} needs the path of a folder")
        self.uri, self.glob = options["path"], options.get("glob", "*.xml")
        self.open_files = int(options.get("openfiles", OPEN_FILES))
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def sizes(self) -> dict[str, int]:
        """Names and sizes in the folder, subfolders excluded, in the order of names."""
        store, folder = fs.FileSystem.from_uri(self.uri)
        found = store.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=True))
        return {f.base_name: f.size for f in sorted(found, key=lambda f: f.base_name) if f.is_file and fnmatch.fnmatch(f.base_name, self.glob)}

    def ranges(self, name: str, start: int, end: int) -> list[Range]:
        path = f"{self.uri.rstrip('/')}/{name}"
        return [Range(path, a, min(a + self.split, end)) for a in range(start, end, self.split)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(part.path)
        name, rows, size = path.rsplit("/", 1)[-1], [], 0
        with store.open_input_file(path) as file:
            for place, text in events_ending_in(file, part.start, part.end):
                rows.append((name, place, text.decode("utf-8", "replace")))
                size += len(text)
                if size > BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        yield _batch(rows)


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


class _TailReader(DataSourceStreamReader):
    def __init__(self, files: _Files):
        self.files, self.finished = files, ""

    def initialOffset(self) -> dict:
        return {"finished": "", "open": {}}

    def latestOffset(self) -> dict:
        sizes = self.files.sizes()
        names = list(sizes)
        older, newest = names[: -self.files.open_files], names[-self.files.open_files :]
        # What was finished stays so when files are removed.
        self.finished = max(self.finished, older[-1] if older else "")
        return {"finished": self.finished, "open": {n: sizes[n] for n in newest if n > self.finished}}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        self.finished = max(self.finished, start["finished"])
        if end["finished"] > start["finished"]:
            # These do not grow any more: their size is where they end.
            for name, size in self.files.sizes().items():
                if start["finished"] < name <= end["finished"]:
                    out += self.files.ranges(name, start["open"].get(name, 0), size)
        for name, size in end["open"].items():
            if name > start["finished"]:
                out += self.files.ranges(name, start["open"].get(name, 0), size)
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.files.read(partition)


class _WholeReader(DataSourceReader):
    def __init__(self, files: _Files):
        self.files = files

    def partitions(self) -> list[Range]:
        return [r for name, size in self.files.sizes().items() for r in self.files.ranges(name, 0, size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.files.read(partition) if partition.path else iter([_batch([])])


class TraceTail(DataSource):
    """Options: path (a folder), glob (``*.xml``), openFiles, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file_name string, file_offset long, event_data string"

    def reader(self, schema) -> DataSourceReader:
        return _WholeReader(_Files(dict(self.options)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TailReader(_Files(dict(self.options)))


def read_trace_tail(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """All complete events of the files under ``path`` as they are now: file_name, file_offset (in bytes), event_data."""
    spark.dataSource.register(TraceTail)
    return spark.read.format(FORMAT).options(**options).option("path", path).load()


def tail_stream(spark: SparkSession) -> DataStreamReader:
    """A stream reader of this format; ``load(path)`` or the option ``path`` names the folder."""
    spark.dataSource.register(TraceTail)
    return spark.readStream.format(FORMAT)
