"""A folder of text files that grow: complete lines as a stream, across restarts and replaced files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that are read at a time, and bytes of a file that one task reads.
BLOCK_BYTES = 1 << 16
TASK_BYTES = 64 << 20
#: Bytes of a file's first line that tell it from the file that replaces it.
HEAD_BYTES = 4096


@dataclass
class Span(InputPartition):
    """Lines of a file that begin in [begin, until); `first` is where the whole range begins."""

    path: str
    begin: int
    until: int
    first: int


class GrowingLines(DataSource):
    """Options: path, a folder that pyarrow's file systems reach (a local path, file://, hdfs://, s3://).

    The offset is a map from file to (identity, bytes). A file counts up to its last line end, so a line that
    is still being written waits. A file whose first line has changed, or that is shorter than before, was
    replaced and is read from its start. Names that begin with a dot or an underscore are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(self.options["path"])


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, folder = self.place()
        out = {}
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.type == fs.FileType.File and info.base_name[0] not in "._":
                identity, complete = measured(system, info.path, info.size)
                if complete:
                    out[info.path] = [identity, complete]
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        spans = []
        for path, (identity, complete) in sorted(end.items()):
            known, seen = start.get(path, (None, 0))
            first = seen if known == identity and seen <= complete else 0
            spans += [Span(path, b, min(b + TASK_BYTES, complete), first) for b in range(first, complete, TASK_BYTES)]
        return spans

    def read(self, partition: Span) -> Iterator[tuple[str, str]]:
        system, _ = self.place()
        name = partition.path.rsplit("/", 1)[-1]
        with system.open_input_file(partition.path) as file:
            at = partition.begin
            if at > partition.first:
                # The line that holds the byte before belongs to the task before.
                file.seek(at - 1)
                at = at - 1 + len(next(pieces(file), b""))
            file.seek(at)
            for line in pieces(file):
                if at >= partition.until:
                    return
                at += len(line)
                yield name, line.rstrip(b"\r\n").decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        return None


def pieces(file) -> Iterator[bytes]:
    """Lines with their ends, from where the file stands; only a line feed ends a line."""
    held: list[bytes] = []
    while block := file.read(BLOCK_BYTES):
        *whole, rest = block.split(b"\n")
        for part in whole:
            yield b"".join([*held, part, b"\n"])
            held = []
        if rest:
            held.append(rest)
    if held:
        yield b"".join(held)


def measured(system: fs.FileSystem, path: str, size: int) -> tuple[str, int]:
    """A digest of the first line, and the bytes up to the last line end."""
    with system.open_input_file(path) as file:
        end, complete = size, 0
        while end > 0 and not complete:
            begin = max(0, end - BLOCK_BYTES)
            file.seek(begin)
            complete = begin + file.read(end - begin).rfind(b"\n") + 1
            if complete == begin:
                end, complete = begin, 0
        file.seek(0)
        head = file.read(min(complete, HEAD_BYTES)).split(b"\n")[0]
    return hashlib.sha256(head).hexdigest()[:32], complete


def growing_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines (file, value) of a folder as a stream; where it stands is kept in the query's checkpoint."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format(GrowingLines.name()).option("path", folder).load()
