"""The last lines of a log: a Spark data source that reads files from their ends.

The plan lists the files, walks blocks backwards from the end of the last one and counts line ends until enough are found.
Tasks then read only the stretch behind that point. The walk holds one block at a time, and reads about as many bytes as
the lines asked for. A compressed file can't be entered from its end; where the walk meets one, it is counted front to
back, and a task skips the lines before the tail.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridledger.sources.register_xml import at_storage

BLOCK = 1 << 20
PIECE = 8 << 20
BATCH_LINES = 10_000


@dataclass
class Stretch(InputPartition):
    """Bytes of a plain file, or the lines of a compressed one from ``skip`` on; ``order`` numbers stretches by place."""

    path: str
    start: int
    end: int
    skip: int
    order: int


def log_files(folder: str) -> list[tuple[str, int]]:
    """Files of a folder by name, or the one file, with their sizes; names that begin with . or _ are hidden."""
    store, path = at_storage(folder)
    info = store.get_file_info(path)
    if info.type == FileType.File:
        return [(folder, info.size)]
    found = [f for f in store.get_file_info(FileSelector(path)) if f.type == FileType.File and f.base_name[0] not in "._"]
    return [(f"{folder.rstrip('/')}/{f.base_name}", f.size) for f in sorted(found, key=lambda f: f.base_name)]


def line_starts(data: BinaryIO, size: int, n: int) -> tuple[int, int, list[int]]:
    """How many of the last ``n`` lines a file holds, where the first of them starts, and starts of lines on the way.

    Reads backwards, block by block. The file's last line counts whether or not a line end closes it.
    """
    if not size:
        return 0, 0, []
    data.seek(size - 1)
    wanted = n + (data.read(1) == b"\n")  # a closing line end starts no line
    found, end, cuts = 0, size, []
    while end:
        start = max(end - BLOCK, 0)
        data.seek(start)
        block = data.read(end - start)
        here = block.count(b"\n")
        if found + here >= wanted:
            at = len(block)
            for _ in range(wanted - found):
                at = block.rfind(b"\n", 0, at)
            return n, start + at + 1, cuts
        first = block.find(b"\n")
        if first >= 0 and start + first + 1 < size:
            cuts.append(start + first + 1)
        found, end = found + here, start
    return found + 1 - (wanted - n), 0, cuts


def plan_tail(folder: str, n: int) -> list[Stretch]:
    """Stretches that hold the last ``n`` lines of the files in order, in pieces of about PIECE bytes."""
    out: list[Stretch] = []
    left = n
    for path, size in reversed(log_files(folder)):
        if left <= 0:
            break
        store, target = at_storage(path)
        if path.endswith(".gz"):
            with store.open_input_file(target) as raw, gzip.open(raw) as data:
                lines = sum(1 for _ in data)
            out.append(Stretch(path, 0, 0, max(lines - left, 0), 0))
            left -= min(lines, left)
            continue
        with store.open_input_file(target) as data:
            lines, start, cuts = line_starts(data, size, left)
        left -= lines
        edges = [size]
        for cut in cuts:
            if edges[-1] - cut >= PIECE and cut > start:
                edges.append(cut)
        edges.append(start)
        out.extend(Stretch(path, lo, hi, 0, 0) for hi, lo in zip(edges[:-1], edges[1:]) if hi > lo)
    out.reverse()
    for order, stretch in enumerate(out):
        stretch.order = order
    return out


def stretch_lines(stretch: Stretch) -> Iterator[bytes]:
    store, target = at_storage(stretch.path)
    with store.open_input_file(target) as raw:
        if stretch.path.endswith(".gz"):
            with gzip.open(raw) as data:
                for number, line in enumerate(data):
                    if number >= stretch.skip:
                        yield line
            return
        raw.seek(stretch.start)
        left, kept = stretch.end - stretch.start, b""
        while left:
            block = raw.read(min(BLOCK, left))
            left -= len(block)
            lines = (kept + block).split(b"\n")
            kept = lines.pop()
            yield from lines
        if kept:
            yield kept


class TailReader(DataSourceReader):
    def __init__(self, folder: str, n: int) -> None:
        self.folder, self.n = folder, n

    def partitions(self) -> list[Stretch]:
        return plan_tail(self.folder, self.n) or [Stretch("", 0, 0, 0, -1)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if partition.order < 0:
            return
        texts: list[str] = []
        number = 0
        for line in stretch_lines(partition):
            texts.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
            if len(texts) == BATCH_LINES:
                yield numbered_batch(texts, partition.order, number)
                number, texts = number + len(texts), []
        if texts:
            yield numbered_batch(texts, partition.order, number)


def numbered_batch(texts: list[str], order: int, first: int) -> pa.RecordBatch:
    n = len(texts)
    return pa.RecordBatch.from_arrays(
        [pa.array(texts, pa.string()), pa.array([order] * n, pa.int32()), pa.array(range(first, first + n), pa.int64())],
        ["value", "stretch", "line"])


class LogTail(DataSource):
    """``value``, and ``stretch, line`` to put the lines in their order. Options: ``path``, ``lines``."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "value string, stretch int, line long"

    def reader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options["lines"]))


def tail_lines(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """The last ``n`` lines of the files of a folder in name order: ``value, stretch, line``. Fewer if there are fewer."""
    if n < 1:
        raise ValueError("n must be at least 1")
    spark.dataSource.register(LogTail)
    return spark.read.format("log_tail").option("path", folder).option("lines", str(n)).load()
