"""A stream of the complete lines that are appended to files: a Python data source whose offsets are places in bytes.

A micro-batch covers each file from where the last one ended to the end of its last complete line, so a half-written
line waits until it is whole, and a restarted query goes on from its checkpoint without loss or repeats. A file's new
bytes are dealt to tasks in ranges; a line belongs to the range in which it begins.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "fieldloom_tail"
SCHEMA = "path string, at long, line string"
_BACK, _ROWS = 1 << 16, 4096


@dataclass
class Range(InputPartition):
    """Bytes [start, end) of a file whose new part is [first, last)."""

    path: str
    first: int
    start: int
    end: int
    last: int


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def complete(fs: pafs.FileSystem, path: str, size: int) -> int:
    """The end of the last complete line within the first size bytes: reads back from there in blocks."""
    with fs.open_input_file(path) as f:
        end = size
        while end > 0:
            begin = max(0, end - _BACK)
            at = f.read_at(end - begin, begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


class TailStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.start = options.get("start", "latest")
        self.range_bytes = int(options.get("rangebytes", 64 << 20))
        if self.start not in ("latest", "earliest") or self.range_bytes < 1:
            raise ValueError("start is latest or earliest, rangeBytes at least 1")

    def _ends(self) -> dict[str, int]:
        """Where the complete lines of each file end that the path, a file or a pattern in its last part, names."""
        fs, path = _file_system(self.path)
        folder, _, pattern = path.rpartition("/")
        found = fs.get_file_info(pafs.FileSelector(folder or ".", allow_not_found=True))
        return {x.path: complete(fs, x.path, x.size) for x in found if x.is_file and fnmatch.fnmatch(x.base_name, pattern)}

    def initialOffset(self) -> dict:
        return {"ends": self._ends() if self.start == "latest" else {}}

    def latestOffset(self) -> dict:
        return {"ends": self._ends()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, last in sorted(end["ends"].items()):
            first = start["ends"].get(path, 0)
            first = 0 if last < first else first  # the file was cut: it begins anew
            out += [Range(path, first, at, min(at + self.range_bytes, last), last) for at in range(first, last, self.range_bytes)]
        return out or [Range("", 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        p = partition
        fs = _file_system(self.path)[0]
        held: list[tuple] = []
        if p.start < p.end:
            with fs.open_input_file(p.path) as f:
                at = p.start
                f.seek(at)
                if at > p.first:  # a line that began in the range before is that range's
                    f.seek(at - 1)
                    at += len(_line(f)) - 1
                while at < p.end:
                    line = _line(f)
                    if not line.endswith(b"\n"):
                        break
                    held.append((p.path, at, line[:-1].removesuffix(b"\r").decode("utf-8", "replace")))
                    at += len(line)
                    if len(held) >= _ROWS:
                        yield _batch(held)
                        held = []
        yield _batch(held)

    def commit(self, end: dict) -> None:
        pass


def _line(f: pa.NativeFile) -> bytes:
    """The next line with its line feed; blocks are read ahead and the file is set back behind the line."""
    parts, size = [], 1 << 12
    while True:
        at = f.tell()
        block = f.read(size)
        cut = block.find(b"\n")
        if cut >= 0:
            f.seek(at + cut + 1)
            return b"".join([*parts, block[: cut + 1]])
        if not block:
            return b"".join(parts)
        parts.append(block)
        size = min(size * 4, 1 << 22)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, at, line = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(at, pa.int64()), pa.array(line, pa.string())], ["path", "at", "line"])


class TailSource(DataSource):
    """Options: path (a file, or a pattern in its last part), start (latest skips what is there; earliest), rangeBytes.

    A file that gets shorter than it was is read from its beginning. Bytes that are no UTF-8 become replacement signs.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailStream:
        return TailStream(self.options)


def tail(spark: SparkSession, path: str, start: str = "latest", range_bytes: int = 64 << 20):
    """A stream (path, at, line) of the complete lines that are appended to the files of a path; at is a line's first byte."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format(NAME).options(path=path, start=start, rangeBytes=str(range_bytes)).load()
