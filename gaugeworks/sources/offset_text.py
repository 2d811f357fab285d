"""Text lines with their places in bytes: a data source that reads files by byte ranges in parallel, skips ranges that a filter rules out, and appends."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

#: Bytes of a range, of a read, and of a batch handed on.
RANGE, READ, BATCH = 32 << 20, 1 << 20, 4 << 20
#: Small ranges share a task, up to RANGE bytes, where there are more than so many.
TASKS = 256
_PACKED = {".gz": "gzip", ".zst": "zstd", ".bz2": "bz2"}
_PART = re.compile(r"(\d{6})-(\d{6})-.*\.txt(\.zst|\.gz)?\Z")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def _files(path: str) -> list[tuple[str, int]]:
    """Data files of a path, by name, with their sizes; the parts of one append follow those of the one before."""
    fs, at = _open(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(info.path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True)) if info.type == pafs.FileType.Directory else []
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not any(p.startswith((".", "_")) for p in f.path[len(at) :].split("/") if p))


@dataclass
class Range(ds.InputPartition):
    """The lines that begin in [start, end) of a file; base is the bytes of the files before it, which packed files don't have."""

    path: str
    start: int
    end: int | None
    base: int | None


@dataclass
class Ranges(ds.InputPartition):
    """Ranges that one task reads, one after the other."""

    each: list[Range]


def lines_from(stream, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end). A line that begins earlier is the range's before, even if it ends here; the last line is read to its end, wherever that is.

    stream stands at start - 1 (at 0 for the first range): if that byte ends a line, one begins at start.
    """
    at, rest = max(start - 1, 0), b""
    skip = start > 0
    while True:
        block = stream.read(READ)
        data = rest + block if rest else block
        begin = 0
        while (stop := data.find(b"\n", begin if begin else 0)) >= 0:
            if skip:
                skip = False
            else:
                if end is not None and at + begin >= end:
                    return
                yield at + begin, data[begin:stop]
            begin = stop + 1
        if skip:  # nothing of it is ours so far
            at, rest = at + len(data), b""
        else:
            at, rest = at + begin, data[begin:]
            if end is not None and at >= end:
                return
        if not block:
            if rest:
                yield at, rest
            return


class _Reader(ds.DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size
        self.low, self.high, self.only = 0, None, None

    def pushFilters(self, filters):
        """Bounds of offset and a file's name narrow the ranges; Spark still applies every filter to the rows."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("offset",) and isinstance(value, int):
                if isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual, ds.EqualTo)):
                    self.low = max(self.low, value)
                if isinstance(f, (ds.LessThan, ds.LessThanOrEqual, ds.EqualTo)):
                    self.high = value if self.high is None else min(self.high, value)
            elif column == ("file",) and isinstance(f, ds.EqualTo):
                self.only = value
            yield f

    def partitions(self) -> list[Range]:
        out, base = [], 0
        for path, size in _files(self.path):
            packed = os.path.splitext(path)[1] in _PACKED
            if self.only is None or path == self.only:
                if packed:
                    out.append(Range(path, 0, None, None))
                else:
                    out += [Range(path, a, min(a + self.size, size), base) for a in range(0, size, self.size) if a + self.size > self.low and (self.high is None or a <= self.high)]
            base = None if packed or base is None else base + size
        k = min(RANGE // self.size, len(out) // TASKS)
        return ([Ranges(out[i : i + k]) for i in range(0, len(out), k)] if k > 1 else out) or [Range("", 0, 0, 0)]

    def read(self, part: Range | Ranges):
        if isinstance(part, Ranges):
            for one in part.each:
                yield from self.read(one)
            return
        if not part.path:
            return
        fs, _ = _open(self.path)
        packed = _PACKED.get(os.path.splitext(part.path)[1])
        stream = fs.open_input_stream(part.path, compression=packed) if packed else fs.open_input_file(part.path)
        with stream:
            if not packed and part.start:
                stream.seek(part.start - 1)
            offsets, lines, held = [], [], 0
            for offset, line in lines_from(stream, part.start, part.end):
                offsets.append(offset)
                lines.append(line)
                held += len(line) + 16
                if held > BATCH:
                    yield self._batch(part, offsets, lines)
                    offsets, lines, held = [], [], 0
            if lines:
                yield self._batch(part, offsets, lines)

    @staticmethod
    def _batch(part: Range, offsets: list[int], lines: list[bytes]) -> pa.RecordBatch:
        n = len(lines)
        place = pa.array([None if part.base is None else part.base + o for o in offsets], pa.int64())
        text = pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())
        return pa.RecordBatch.from_arrays([pa.array([part.path] * n, pa.string()), pa.array(offsets, pa.int64()), place, text], ["file", "offset", "place", "line"])


@dataclass
class _Written(ds.WriterCommitMessage):
    temporary: str | None
    name: str


class _Writer(ds.DataSourceArrowWriter):
    """Tasks write under _temporary; commit moves their files to their names, numbered after those that are there. What was there is not touched, unless it is overwritten."""

    def __init__(self, path: str, packed: str | None, overwrite: bool):
        self.path, self.packed, self.overwrite = path, packed, overwrite
        self.job = uuid.uuid4().hex
        taken = [int(m[1]) for p, _ in _files(path) if (m := _PART.search(os.path.basename(p)))]
        self.number = max(taken, default=-1) + 1

    def write(self, batches):
        from pyspark import TaskContext

        fs, root = _open(self.path)
        name = f"{self.number:06d}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.txt" + {"zstd": ".zst", "gzip": ".gz", None: ""}[self.packed]
        fs.create_dir(f"{root}/_temporary/{self.job}", recursive=True)
        at, empty = f"{root}/_temporary/{self.job}/{name}", True
        with fs.open_output_stream(at, compression=self.packed) as out:
            for batch in batches:
                lines = [("" if x is None else x).encode() for x in batch.column(0).to_pylist()]
                if any(b"\n" in x for x in lines):
                    raise ValueError("a line must not hold a line feed")
                if lines:
                    out.write(b"\n".join(lines) + b"\n")
                    empty = False
        return _Written(None if empty else at, name)

    def commit(self, messages):
        fs, root = _open(self.path)
        old = [p for p, _ in _files(self.path)] if self.overwrite else []
        for m in messages:
            if m is not None and m.temporary:
                fs.move(m.temporary, f"{root}/{m.name}")
        for p in old:
            fs.delete_file(p)
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        fs, root = _open(self.path)
        if fs.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_temporary")


class OffsetText(ds.DataSource):
    """offset_text: (file, offset, place, line). offset is the line's first byte in its file, place that in all files in a row (null after a packed file); lines end by line feeds only.

    Options: path; range, bytes of a partition. Writing takes one text column, a line a row, and compression zstd or gzip. Packed files (.zst, .gz, .bz2) are read as one
    partition each, with offsets in what they unpack to. Bytes that are no UTF-8 become replacement characters; a null is written as an empty line.
    """

    @classmethod
    def name(cls) -> str:
        return "offset_text"

    def schema(self) -> str:
        return "file string, offset long, place long, line string"

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], self.options.get("compression"), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the source known and its filters pushed down."""
    spark.dataSource.register(OffsetText)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_lines(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, offset, place, line) of text files under a path, in ranges of size bytes."""
    return registered(spark).read.format("offset_text").option("range", size).load(path)


def append_lines(lines: DataFrame, path: str, compression: str | None = None, overwrite: bool = False) -> None:
    """Add the rows of a table of one text column as lines of new files, in partition order; files that are there stay, or with overwrite go once the new ones are written."""
    registered(lines.sparkSession)
    writer = lines.select(F.col(f"`{lines.columns[0]}`").cast("string").alias("line")).write.format("offset_text").mode("overwrite" if overwrite else "append")
    (writer.option("compression", compression) if compression else writer).save(path)
