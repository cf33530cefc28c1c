"""Document files of any size and number as Spark data sources.

* ``document_splits`` — byte ranges of the files of a folder with the newlines in each;
* ``document_pieces`` — their bytes in rows of bounded size, so that a file may be larger than a row;
* ``document_pages`` — pages of a number of lines each, streamed one at a time from every range.

A task takes one range of a large file or many small files.  A page's number depends on the lines
before it, so ``read_pages`` first counts newlines by range, adds them up per file, and
gives each range the number of its first line; a page belongs to the range that its first
line begins in.  A task never holds more than a block and a page.
"""

from __future__ import annotations

import fnmatch
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textmill.session import scratch_path

SPLIT_BYTES = 64 << 20
PIECE_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20
#: Characters of pages that go to Spark together.
BATCH_CHARS = 4 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path: a local one, or any that Arrow knows by its scheme."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Range:
    """Bytes ``start`` to ``end`` of a file, and the number of the first line that begins there."""

    path: str
    length: int
    start: int
    end: int
    first_line: int = 0


@dataclass
class Ranges(InputPartition):
    ranges: list


def ranges_of(path: str, glob: str, split_bytes: int) -> list[Range]:
    """The ranges of all files under ``path`` whose name matches; an empty file has one empty range."""
    fs, base = filesystem(path)
    found = []
    for info in sorted(fs.get_file_info(pafs.FileSelector(base, recursive=True)), key=lambda i: i.path):
        hidden = any(part.startswith(("_", ".")) for part in info.path[len(base):].split("/"))
        if info.type != pafs.FileType.File or hidden or not fnmatch.fnmatch(info.base_name, glob):
            continue
        starts = range(0, max(info.size, 1), split_bytes)
        found += [Range(info.path, info.size, s, min(s + split_bytes, info.size)) for s in starts]
    return found


def packed(ranges: list[Range], split_bytes: int) -> list[Ranges]:
    """Ranges in partitions of about ``split_bytes``: a whole range, or many small files."""
    out: list[Ranges] = []
    room = 0
    for r in ranges:
        # a file costs something to open, whatever its size
        size = max(r.end - r.start, split_bytes // 64)
        if not out or room < size:
            out.append(Ranges([]))
            room = split_bytes
        out[-1].ranges.append(r)
        room -= size
    return out or [Ranges([])]


def blocks(f, start: int, end: int, size: int) -> Iterator[bytes]:
    f.seek(start)
    while start < end:
        data = f.read(min(size, end - start))
        if not data:
            raise ValueError("file became shorter")
        start += len(data)
        yield data


def pages(f, r: Range, lines_per_page: int) -> Iterator[tuple[int, str]]:
    """(page_no, content) of the pages whose first line begins in the range; lines end with a newline,
    which the last one may lack."""
    line = r.first_line
    f.seek(max(r.start - 1, 0))
    stream = io.BufferedReader(f, BLOCK_BYTES)
    at = r.start
    if r.start:
        # the line that the range begins in belongs to the range before it
        before = stream.readline()
        at = r.start - 1 + len(before)
        line += len(before) > 1
    page: list[bytes] = []
    while True:
        first = line % lines_per_page == 0
        if first and page:
            yield (line - 1) // lines_per_page + 1, b"\n".join(page).decode("utf-8", "replace")
            page = []
        if at >= r.end and not page:
            return
        data = stream.readline()
        if not data:
            break
        if first or page:
            page.append(data.removesuffix(b"\n"))
        at += len(data)
        line += 1
    if page:
        yield (line - 1) // lines_per_page + 1, b"\n".join(page).decode("utf-8", "replace")


class _Reader(DataSourceReader):
    schema: pa.Schema

    def __init__(self, options: dict):
        self.options = options
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))

    def _ranges(self) -> list[Range]:
        return ranges_of(self.options["path"], self.options.get("pathglobfilter", "*"), self.split_bytes)

    def partitions(self) -> list[Ranges]:
        return packed(self._ranges(), self.split_bytes)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.options["path"])
        for r in partition.ranges:
            with fs.open_input_file(r.path) as f:
                yield from self.rows(f, r)

    def rows(self, f, r: Range) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def batch(self, *columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, self.schema, strict=True)], schema=self.schema)


class _Splits(_Reader):
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("newlines", pa.int64())])

    def rows(self, f, r):
        n = sum(b.count(b"\n") for b in blocks(f, r.start, r.end, BLOCK_BYTES))
        yield self.batch([r.path], [r.length], [r.start], [r.end], [n])


class _Pieces(_Reader):
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("offset", pa.int64()), ("data", pa.binary())])

    def rows(self, f, r):
        at = r.start
        for data in blocks(f, r.start, r.end, int(self.options.get("piecebytes", PIECE_BYTES))):
            yield self.batch([r.path], [r.length], [at], [data])
            at += len(data)
        if not r.length:
            yield self.batch([r.path], [0], [0], [b""])


class _Pages(_Reader):
    schema = pa.schema([("path", pa.string()), ("page_no", pa.int32()), ("content", pa.string())])

    def _ranges(self):
        fs, base = filesystem(self.options["index"])
        rows = pq.read_table(base, filesystem=fs).to_pylist()
        return [Range(**r) for r in sorted(rows, key=lambda r: (r["path"], r["start"]))]

    def rows(self, f, r):
        numbers, texts, held = [], [], 0
        for no, content in pages(f, r, int(self.options["linesperpage"])):
            numbers.append(no)
            texts.append(content)
            held += len(content) + 64
            if held >= BATCH_CHARS:
                yield self.batch([r.path] * len(numbers), numbers, texts)
                numbers, texts, held = [], [], 0
        yield self.batch([r.path] * len(numbers), numbers, texts)


class _Documents(DataSource):
    read_as: type[_Reader]

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(self.read_as.schema)

    def reader(self, schema):
        return self.read_as({k.lower(): v for k, v in self.options.items()})


class DocumentSplits(_Documents):
    read_as = _Splits

    @classmethod
    def name(cls):
        return "document_splits"


class DocumentPieces(_Documents):
    read_as = _Pieces

    @classmethod
    def name(cls):
        return "document_pieces"


class DocumentPages(_Documents):
    read_as = _Pages

    @classmethod
    def name(cls):
        return "document_pages"


def _reader(spark: SparkSession, source: type[DataSource], glob: str, split_bytes: int):
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("pathGlobFilter", glob).option("splitBytes", split_bytes)


def read_splits(spark: SparkSession, path: str, glob: str = "*", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, length, start, end, newlines) of byte ranges of every file under ``path``."""
    return _reader(spark, DocumentSplits, glob, split_bytes).load(path)


def read_pieces(spark: SparkSession, path: str, glob: str = "*", piece_bytes: int = PIECE_BYTES,
                split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, length, offset, data): the bytes of every file in rows of at most ``piece_bytes``."""
    return _reader(spark, DocumentPieces, glob, split_bytes).option("pieceBytes", piece_bytes).load(path)


def read_pages(spark: SparkSession, path: str, glob: str = "*", lines_per_page: int = 4,
               split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, page_no, content) of every text file under ``path``, a page every ``lines_per_page`` lines."""
    before = F.sum("newlines").over(W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    index = scratch_path(spark, "pageindex")
    read_splits(spark, path, glob, split_bytes).select(
        "path", "length", "start", "end", F.coalesce(before, F.lit(0)).cast("long").alias("first_line")).write.parquet(index)
    return _reader(spark, DocumentPages, glob, split_bytes).option("index", index).option("linesPerPage", lines_per_page).load(path)
