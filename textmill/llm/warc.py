"""Dictionary-compressed WARC archives: a Spark data source that writes and reads ``.warc.zst``.

Each writing task fills archives of its own.  The first records of an archive (up to
``TRAIN_BYTES``) train a Zstandard dictionary; the archive begins with a skippable frame that
holds it, and every record after that is a frame of its own, compressed with it, so that any
record can be read alone.  An archive is closed when it has ``archive_bytes`` of records.  Files
are written under a name of the task attempt; the commit on the driver lists those of the
attempts that succeeded, with the offsets of their blocks, in an index file, and only what the index lists is
read.  A lost executor's files are never listed.  Reading is split by blocks of about
``SPLIT_BYTES`` of compressed records, whatever the size of an archive.

``archive_pages`` finds the first page (least id) of each payload: of records with equal payloads of at least
``min_bytes``, that one is written as ``response`` and the others as ``revisit`` without
their payload, referring to it.  Payloads are compared by SHA-256 and length; the archive carries the
usual SHA-1 in base32.  Digests that a thousandth of all pages or more share are at most a
thousand, so they are joined by broadcast; the others, none of which has more rows than
that, meet in a shuffle.

Null html counts as empty; a null url is written as ``about:blank``; control characters and
spaces of a url are percent-encoded.  Repeated ids: the one of least url is first; rows that
repeat wholly are written alike.  A null id comes after all others.  Extra columns are ignored.  An
empty table writes no archive and reads as no rows.  Archives too small to train on (fewer than eight
records or under 4 KB) have no dictionary frame.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from textmill.llm.graph import stored
from textmill.session import scratch_path

#: Fixed values of the formats.
DICT_MAGIC = bytes.fromhex("5d2a4d18")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRAWL_DATE = "2024-01-01T00:00:00Z"

DICT_BYTES = 110 << 10
TRAIN_BYTES = 4 << 20
SPLIT_BYTES = 16 << 20
ARCHIVE_BYTES = 1 << 30
FORMAT = "warc_zst"
RECORDS = ("page_id long, url string, record_type string, payload binary, payload_bytes long, "
           "payload_digest string, refers_to long")
_INDEX = "index.json"


def payload_digest(payload: bytes) -> str:
    """The bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records ---------------------------------------------------------------------------

def _uri(url: str | None) -> str:
    if not url:
        return "about:blank"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """The same for rows that repeat wholly, and for no others."""
    return f"<urn:page:{'null' if page_id is None else page_id}:{zlib.crc32((url or '').encode()):08x}:{digest}>"


def _page_of(record_id: str) -> int | None:
    page = record_id.split(":")[2]
    return None if page == "null" else int(page)


def pack_record(page_id, url, html: bytes, size: int, digest: str, refers_to: tuple | None = None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the page (id, url) ``refers_to`` without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to else http + html
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}",
            f"WARC-Record-ID: {_record_id(page_id, url, digest)}", f"WARC-Date: {CRAWL_DATE}",
            f"WARC-Target-URI: {_uri(url)}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(*refers_to, digest)}",
                 f"WARC-Refers-To-Target-URI: {_uri(refers_to[1])}", f"WARC-Refers-To-Date: {CRAWL_DATE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])


def unpack_record(data: bytes) -> tuple:
    """The record as a row of ``RECORDS``; a payload that its digest or a length contradicts is an error."""
    head, rest = data.split(b"\r\n\r\n", 1)
    f = _fields(head)
    length = int(f["Content-Length"])
    if not head.startswith(b"WARC/") or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"broken record {head[:200]!r}")
    http, payload = rest[:length].split(b"\r\n\r\n", 1)
    size = int(_fields(http)["Content-Length"])
    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
    page, uri = _page_of(f["WARC-Record-ID"]), f["WARC-Target-URI"]
    if f["WARC-Type"] == "revisit":
        return page, uri, "revisit", None, size, digest, _page_of(f["WARC-Refers-To"])
    if len(payload) != size or payload_digest(payload) != digest:
        raise ValueError(f"payload of {f['WARC-Record-ID']} does not match its digest")
    return page, uri, "response", payload, len(payload), digest, None


# ---- archives --------------------------------------------------------------------------

def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path: a local one, or any that Arrow knows by its scheme."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def train(records: list[bytes]) -> bytes:
    """A dictionary of the records, or none where they are too few."""
    import zstandard

    if len(records) < 8 or sum(map(len, records)) < 4096:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, records, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


class _Archive:
    """An open archive: its first records wait for the dictionary, later ones are written at once."""

    def __init__(self, fs: pafs.FileSystem, path: str, level: int):
        self.fs, self.path, self.level = fs, path, level
        self.waiting: list[bytes] = []
        self.raw = 0
        self.out = None
        self.blocks: list[int] = []

    def add(self, record: bytes) -> None:
        self.raw += len(record)
        if self.out:
            self._write(record)
            return
        self.waiting.append(record)
        if self.raw >= TRAIN_BYTES:
            self._open()

    def _open(self) -> None:
        import zstandard

        trained = train(self.waiting)
        extra = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
        self.zstd = zstandard.ZstdCompressor(level=self.level, write_checksum=True, **extra)
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self.at = 0
        if trained:
            self.at += self.out.write(DICT_MAGIC + len(trained).to_bytes(4, "little") + trained)
        for r in self.waiting:
            self._write(r)
        self.waiting = []

    def _write(self, record: bytes) -> None:
        if not self.blocks or self.at - self.blocks[-1] >= SPLIT_BYTES:
            self.blocks.append(self.at)
        self.at += self.out.write(self.zstd.compress(record))

    def close(self) -> list[int]:
        """The offsets of the blocks and of the end."""
        if not self.out:
            self._open()
        self.out.close()
        return [*self.blocks, self.at]


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, archive_bytes: int, level: int):
        self.path, self.archive_bytes, self.level = path, archive_bytes, level
        fs, base = _filesystem(path)
        fs.create_dir(base, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, base = _filesystem(self.path)
        files, archive = [], None
        for b in iterator:
            for i in range(b.num_rows):
                page, url, html, size, sha1, first, first_url, revisit = (c[i].as_py() for c in b.columns)
                if archive is None:
                    name = f"part-{uuid.uuid4().hex}.warc.zst"
                    archive = _Archive(fs, f"{base}/{name}", self.level)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                archive.add(pack_record(page, url, (html or "").encode(), size, digest, (first, first_url) if revisit else None))
                if archive.raw >= self.archive_bytes:
                    files.append([name, archive.close()])
                    archive = None
        if archive is not None:
            files.append([name, archive.close()])
        return _Written(files)

    def commit(self, messages: list) -> None:
        fs, base = _filesystem(self.path)
        files = [f for m in messages if m for f in m.files]
        with fs.open_output_stream(f"{base}/{_INDEX}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        fs, base = _filesystem(self.path)
        for m in messages:
            for name, _ in (m.files if m else []):
                fs.delete_file(f"{base}/{name}")


@dataclass
class _Block(InputPartition):
    name: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list:
        fs, base = _filesystem(self.path)
        with fs.open_input_stream(f"{base}/{_INDEX}") as f:
            files = json.loads(f.read())
        found = [_Block(name, s, e) for name, at in files for s, e in zip(at, at[1:], strict=False)]
        return found or [_Block("", 0, 0)]

    def read(self, partition: _Block) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, base = _filesystem(self.path)
        with fs.open_input_file(f"{base}/{partition.name}") as f:
            yield from _batches(read_frames(f, partition.start, partition.end))


def read_frames(f, start: int, end: int) -> Iterator[bytes]:
    """The records from offset ``start`` to ``end`` of an open archive."""
    import zstandard

    f.seek(0)
    magic = f.read(8)
    trained = f.read(int.from_bytes(magic[4:], "little")) if magic[:4] == DICT_MAGIC else b""
    extra = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
    zstd = zstandard.ZstdDecompressor(**extra)
    f.seek(start)
    left, frame, parts = end - start, zstd.decompressobj(), []
    rest = b""
    while left or rest:
        if not rest:
            rest = f.read(min(left, 1 << 20))
            if not rest:
                raise ValueError("archive ends inside a record")
            left -= len(rest)
        parts.append(frame.decompress(rest))
        rest = frame.unused_data
        if frame.eof:
            yield b"".join(parts)
            frame, parts = zstd.decompressobj(), []
    if parts:
        raise ValueError("archive ends inside a record")


def _batches(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    names = [x.strip().split(" ") for x in RECORDS.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in names])
    rows: list[tuple] = []
    held = 0
    for data in records:
        rows.append(unpack_record(data))
        held += len(data)
        if held >= SPLIT_BYTES or len(rows) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                             schema=schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                         schema=schema)


class WarcZst(DataSource):
    """``spark.read.format("warc_zst").load(folder)`` and ``df.write.format("warc_zst").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("archive_bytes", ARCHIVE_BYTES)),
                       int(self.options.get("level", 3)))


# ---- pages -----------------------------------------------------------------------------

def with_first_holder(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with size, sha1, ``first_id``, ``first_url`` and ``revisit``: whether
    an equal payload of at least ``min_bytes`` belongs to a page before it.  Only the thin
    table of digests that repeat is aggregated; html moves once, in the join with it, and not at
    all for revisits of a common payload."""
    body = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.octet_length(body).alias("size"),
                         F.unhex(F.sha2(body.cast("binary"), 256)).alias("key"), F.sha1(body.cast("binary")).alias("sha1"))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.coalesce("url", F.lit("")).alias("u"), "url")
    thin = keyed.filter(F.col("size") >= min_bytes).groupBy("key", "size") \
        .agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    thin = stored(spark, thin.select("key", "size", "first", "n"), "holders")
    common = F.col("n") * 1000 >= pages.count()
    hot = thin.filter(common).select("key", "size", F.col("first").alias("hot"))
    held = keyed.join(F.broadcast(hot), ["key", "size"], "left")
    # Rows of a common payload look for nothing more: a key of their own spreads them evenly.
    none = F.unhex(F.sha2(F.concat_ws(":", F.lit("page"), "page_id", "url"), 256))
    held = held.withColumn("key", F.when(F.col("hot").isNull(), F.col("key")).otherwise(none)) \
        .withColumn("html", F.when(F.col("hot").isNull() | _is_first("hot"), F.col("html")))
    held = held.join(thin.filter(~common).drop("n"), ["key", "size"], "left") \
        .withColumn("first", F.coalesce("hot", "first"))
    revisit = F.col("first").isNotNull() & ~_is_first("first")
    return held.select("page_id", "url", "html", "size", "sha1", F.col("first.page_id").alias("first_id"),
                       F.col("first.url").alias("first_url"), revisit.alias("revisit"))


def _is_first(first: str) -> Column:
    return F.col(f"{first}.page_id").eqNullSafe(F.col("page_id")) & F.col(f"{first}.url").eqNullSafe(F.col("url"))


def archive_pages(spark: SparkSession, pages: DataFrame, path: str, *, min_bytes: int = 0,
                  archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> None:
    """Writes every page (page_id, url, html) to archives in the new folder ``path``."""
    spark.dataSource.register(WarcZst)
    with_first_holder(spark, pages, min_bytes).write.format(FORMAT).mode("append") \
        .option("archive_bytes", archive_bytes).option("level", level).save(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in ``path``: ``RECORDS``; payloads are checked against their digests."""
    spark.dataSource.register(WarcZst)
    return spark.read.format(FORMAT).load(path)


def archived(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """``pages`` written to archives in the shared folder and read back."""
    path = scratch_path(spark, "warc")
    archive_pages(spark, pages, path, **options)
    return read_archives(spark, path)

