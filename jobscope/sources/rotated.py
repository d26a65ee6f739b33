"""A stream over a JSON-lines log that is rotated: ``x.log`` becomes ``x.log.1``, that ``x.log.2``, and so on.

Spark's file source knows a file by its name, so a log that is renamed is a new file to it and its events come again. Here a file is known by its
first line, which stays what it is wherever the file is moved and however it grows, and an offset says for each file that is there how many bytes
were read. What isn't a whole line yet waits. Work is cut into ranges of bytes, so a long log is many tasks' work.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes in a range, and of a first line that are looked at.
RANGE_BYTES, HEAD_BYTES = 32 << 20, 1 << 16


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class RotatedLog(DataSource):
    """``spark.readStream.format("rotated_log").load("/logs/watcher.log")``: value (a line, blank ones left out), file (its identity), at (byte).

    The path is one that pyarrow's file systems open, a local or mounted one or a URI such as ``hdfs://...``, and driver and executors
    see the same files there. Two generations must not start with the same line; events have ids and times, so they don't.
    """

    @classmethod
    def name(cls) -> str:
        return "rotated_log"

    def schema(self) -> str:
        return "value string, file string, at bigint"

    def streamReader(self, schema: StructType) -> RotatedReader:
        return RotatedReader(self.options["path"])


class RotatedReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def _files(self) -> dict[str, tuple[str, int]]:
        """identity: (path now, bytes) of the log and its generations; those without a whole line aren't there yet."""
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{os.path.abspath(self.path)}")
        folder, name = path.rsplit("/", 1)
        found = {}
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            tail = info.base_name.removeprefix(name + ".")
            if info.is_file and (info.base_name == name or info.base_name.startswith(name + ".") and tail.isdigit()):
                with system.open_input_file(info.path) as f:
                    head = f.read(HEAD_BYTES)
                if b"\n" in head or len(head) == HEAD_BYTES:
                    found[hashlib.sha256(head.split(b"\n", 1)[0]).hexdigest()[:32]] = (info.path, info.size)
        return found

    def _open(self, path: str):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{os.path.abspath(self.path)}")
        return system.open_input_file(path)

    def _whole(self, path: str, size: int) -> int:
        """How many bytes up to the end of the last whole line."""
        with self._open(path) as f:
            at = size
            while at > 0:
                start = max(0, at - HEAD_BYTES)
                f.seek(start)
                cut = f.read(at - start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                at = start
        return 0

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {file: self._whole(path, size) for file, (path, size) in sorted(self._files().items())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Range(file, at, min(at + RANGE_BYTES, end[file])) for file in end for at in range(start.get(file, 0), end[file], RANGE_BYTES)]

    def read(self, partition: Range) -> Iterator[tuple]:
        """The lines that start in the range. The file is looked for again, as it may have been renamed meanwhile."""
        there = self._files()
        if partition.file not in there:
            raise FileNotFoundError(f"the generation of {self.path} that starts with line {partition.file} is gone before it was read")
        with self._open(there[partition.file][0]) as f:
            at, rest = partition.start, b""
            if at:  # a line that started before is another range's
                f.seek(at - 1)
                at, rest = self._skip(f, at - 1)
            else:
                f.seek(0)
            while at < partition.end:
                cut = rest.find(b"\n")
                if cut < 0:
                    more = f.read(HEAD_BYTES)
                    if not more:
                        break
                    rest += more
                    continue
                line, rest = rest[:cut], rest[cut + 1 :]
                if line.strip():
                    yield line.decode("utf-8", "replace"), partition.file, at
                at += cut + 1

    @staticmethod
    def _skip(f, at: int) -> tuple[int, bytes]:
        """(place behind the next line feed, what was read beyond it)."""
        while more := f.read(HEAD_BYTES):
            cut = more.find(b"\n")
            if cut >= 0:
                return at + cut + 1, more[cut + 1 :]
            at += len(more)
        return at, b""

    def commit(self, end: dict) -> None:
        pass

