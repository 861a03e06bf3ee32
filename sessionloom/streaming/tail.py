"""A streaming source of lines appended to session logs (STR-1, STR-3, SRC-16).

Spark's file stream reads a file once; this source goes on where it stopped. An offset holds for each file the end of the last complete
line, in bytes, the file's number and a checksum of its first bytes. A restart begins with the offsets of the query's checkpoint (option
``checkpoint``), so that a file that cannot be read then keeps its place; a file of another number or with another beginning (rotated), or one that has become
shorter (cut off), is read from its start. The driver lists files and looks at their ends only; tasks read the appended ranges, long
ones in parts of ``PART_BYTES``, each from its first line start to the end of the line that begins in it.
"""

from __future__ import annotations

import glob
import json
import os
import zlib
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PART_BYTES = 32 << 20
LOOK_BYTES = 1 << 16
#: First bytes by which a file is known again.
HEAD_BYTES = 256


@dataclass
class Range(InputPartition):
    """Lines of a file that begin at ``start`` or later and before ``end``."""

    path: str
    start: int
    end: int
    inner: bool  # ``start`` may lie inside a line


def complete_bytes(path: str) -> int | None:
    """Bytes up to the last line break, found from the end of the file; None if it cannot be read now."""
    try:
        with open(path, "rb") as f:
            at = f.seek(0, os.SEEK_END)
            while at > 0:
                begin = max(0, at - LOOK_BYTES)
                f.seek(begin)
                found = f.read(at - begin).rfind(b"\n")
                if found >= 0:
                    return begin + found + 1
                at = begin
            return 0
    except OSError:
        return None


def identity(path: str, upto: int) -> list[int] | None:
    """The file's number, how many of its first bytes are looked at, and their checksum; None if it cannot be read now."""
    try:
        with open(path, "rb") as f:
            n = min(HEAD_BYTES, upto)
            return [os.fstat(f.fileno()).st_ino, n, zlib.crc32(f.read(n))]
    except OSError:
        return None


def checkpointed(folder: str) -> dict:
    """The offsets of the last batch that a query with this checkpoint has planned."""
    try:
        numbers = [int(n) for n in os.listdir(os.path.join(folder, "offsets")) if n.isdigit()]
        with open(os.path.join(folder, "offsets", str(max(numbers)))) as f:
            return json.loads(f.read().strip().split("\n")[-1])
    except (OSError, ValueError):
        return {}


class _Reader(DataSourceStreamReader):
    """Offsets by path: [end of the last complete line, file number, first bytes looked at, their checksum]."""

    def __init__(self, folder: str, pattern: str, checkpoint: str | None = None):
        self.pattern = os.path.join(folder, "**", pattern)
        self.last = checkpointed(checkpoint.removeprefix("file://")) if checkpoint else {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for p in sorted(glob.glob(self.pattern, recursive=True)):
            n = complete_bytes(p)
            own = identity(p, n) if n is not None else None
            if own is not None:
                out[p] = [n, *own]
            elif p in self.last:  # a file that cannot be read now keeps its offset
                out[p] = self.last[p]
        self.last = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, (upto, number, *_) in sorted(end.items()):
            begin, known, head, checksum = start.get(path, (0, number, 0, 0))
            if begin > upto or known != number or (head and end[path] != start[path] and identity(path, head) != [number, head, checksum]):
                begin = 0
            out += [Range(path, at, min(at + PART_BYTES, upto), at > begin) for at in range(begin, upto, PART_BYTES)]
        return out

    def read(self, partition: Range):
        with open(partition.path, "rb") as f:
            f.seek(partition.start - 1 if partition.inner else partition.start)
            if partition.inner:
                f.readline()  # the rest of a line that the part before has read, or its line break
            at = f.tell()
            while at < partition.end:
                line = f.readline()
                if not line:
                    return
                yield partition.path, at, line.rstrip(b"\n").decode("utf-8", "replace")
                at += len(line)


class TailSource(DataSource):
    """``spark.dataSource.register(TailSource)``, then ``spark.readStream.format("session_tail").option("folder", ...).option("checkpoint", <its checkpointLocation>)``."""

    @classmethod
    def name(cls) -> str:
        return "session_tail"

    def schema(self) -> str:
        return "path string, start long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["folder"], self.options.get("pattern", "*.jsonl"), self.options.get("checkpoint"))
