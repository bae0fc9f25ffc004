"""WARC archives as a PySpark data source.

Reading plans one partition for each file, or for a few small ones. Filters on
record_type, record_id, target_uri and on single headers are pushed down where the
session allows it (``spark.sql.python.filterPushdown.enabled``). A record's
header is parsed first; a record that the filters leave out is passed over
without decoding its block: members that carry their length (as those written
here do, in the gzip field ``sl``) are skipped unread. Other gzip files are inflated as
one stream, in pieces, whether a member holds one record or all of them. With the
option ``payload`` = false no block is kept. A file that ends inside a record or a
member is an error that names it.

Writing gives each task files of its own, one gzip member for each record,
first under hidden names; the driver renames those of the tasks that count, so
a lost executor or a second attempt leaves nothing in the archive.

A null payload counts as empty, null headers are left out, and control
characters in header values are written as percent codes.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from simloom.functions.workspace import new_path
from simloom.llm.files import open_system, qualified

FORMAT = "simloom_warc"
SCHEMA = "record_id string, record_type string, target_uri string, date string, headers map<string,string>, payload binary"
_NAMED = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date"}
#: Bytes after which a task starts another file, and bytes of small files that one partition reads.
ROLL, GATHER = 256 << 20, 32 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that says its own compressed and plain length in the field ``sl``."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    if max(size, len(data)) > 0xFFFFFFFF:  # the field has no room for such a length
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra = b"sl" + struct.pack("<HII", 8, size, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _safe(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(fields: dict[str, str], payload: bytes) -> bytes:
    """A whole record: version, header, block. A revisit's block has no payload."""
    block = _HTTP + (b"" if fields.get("WARC-Type") == "revisit" else payload)
    lines = [f"{k}: {_safe(v)}" for k, v in fields.items() if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class FilePart(InputPartition):
    """Files that one task reads."""

    paths: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes records to files under hidden names and renames them on commit."""

    def __init__(self, options: dict[str, str]):
        self.path, self.roll = options["path"], int(options.get("roll_bytes", ROLL))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = open_system(self.path)
        system.create_dir(root, recursive=True)
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for part in (batch.slice(a, 200) for a in range(0, batch.num_rows, 200)):
                    for row in part.to_pylist():
                        fields = {name: row.get(column) for column, name in _NAMED.items()} | dict(row.get("headers") or [])
                        data = member(record(fields, row.get("payload") or b""))
                        if out is None or size + len(data) > self.roll:
                            if out is not None:
                                out.close()
                            names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                            out, size = system.open_output_stream(f"{root}/.{names[-1]}", compression=None), 0
                        out.write(data)
                        size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = open_system(self.path)
        system.create_dir(root, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{root}/.{name}", f"{root}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = open_system(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.delete_file(f"{root}/.{name}")


@dataclass
class Written(WriterCommitMessage):
    """Names of the files of a task."""

    names: list[str]


class WarcReader(DataSourceReader):
    """Plans files, takes filters on headers and reads records."""

    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.wanted: list[tuple[str, str, tuple]] = []  # header, kind of test, values

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            at = getattr(f, "attribute", ())
            name = _NAMED.get(at[0]) if len(at) == 1 else at[1] if len(at) == 2 and at[0] == "headers" else None
            if name and isinstance(f, EqualTo):
                self.wanted.append((name, "in", (f.value,)))
            elif name and isinstance(f, In):
                self.wanted.append((name, "in", tuple(f.value)))
            elif name and isinstance(f, StringStartsWith):
                self.wanted.append((name, "starts", (f.value,)))
            else:
                yield f

    def partitions(self) -> list[FilePart]:
        system, root = open_system(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
        parts, size = [FilePart([])], 0
        for f in files:
            if parts[-1].paths and size + f.size > GATHER:
                parts.append(FilePart([]))
                size = 0
            parts[-1].paths.append(f.path)
            size += f.size
        return parts

    def _keeps(self, head: dict[str, str]) -> bool:
        return all((v := head.get(name.lower())) is not None and (v in values if kind == "in" else v.startswith(values)) for name, kind, values in self.wanted)

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        system, _ = open_system(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as f:
                try:
                    for head, block in (_members if path.endswith(".gz") else _plain)(f, self._keeps, self.payload):
                        rows.append((head, block))
                        size += len(block or b"") + 500
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                except (EOFError, zlib.error) as error:
                    raise ValueError(f"{path} is cut off or damaged: {error}") from error
        if rows:
            yield _batch(rows)


def _header(data: bytes) -> dict[str, str]:
    """Fields of a record header by lower-case name; folded lines are joined."""
    out: dict[str, str] = {}
    name = None
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _plain(f, keeps, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records of an uncompressed file; unwanted blocks are skipped by seeking."""
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        data = f.read(1 << 14)
        lead = len(data) - len(data.lstrip(b"\r\n"))
        if lead == len(data):  # line ends after the last record
            at += lead
            continue
        while (end := data.find(b"\r\n\r\n", lead)) < 0 and len(more := f.read(1 << 16)):
            data += more
        if end < 0:
            raise EOFError("a header has no end")
        head = _header(data[lead:end])
        length = int(head.get("content-length", 0))
        begin = at + end + 4
        if begin + length > size:
            raise EOFError(f"a block of {length} bytes has {size - begin}")
        if keeps(head):
            block = None
            if payload:
                f.seek(begin)
                block = f.read(length)
            yield head, block
        at = begin + length


def _members(f, keeps, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records of a gzip file: by members while these carry their length, else as a stream."""
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        raw = f.read(1 << 13)
        if not (len(raw) > 20 and raw[3] & 4 and raw[12:14] == b"sl"):
            f.seek(at)
            yield from _stream(_inflated(f), keeps, payload)
            return
        skip = struct.unpack("<I", raw[16:20])[0]
        if at + skip > size:
            raise EOFError(f"a member of {skip} bytes has {size - at}")
        inflate = zlib.decompressobj(31)
        data = inflate.decompress(raw)
        while (end := data.find(b"\r\n\r\n")) < 0 and not inflate.eof and (raw := f.read(1 << 16)):
            data += inflate.decompress(raw)
        if end < 0:
            raise EOFError("a header has no end")
        head = _header(data[:end])
        if keeps(head):
            block = None
            if payload:
                pieces = [data]
                while not inflate.eof and (raw := f.read(1 << 18)):
                    pieces.append(inflate.decompress(raw))
                data, length = b"".join(pieces), int(head.get("content-length", 0))
                if not inflate.eof or len(data) < end + 4 + length:
                    raise EOFError("a member ends early")
                block = data[end + 4 : end + 4 + length]
            yield head, block
        at += skip


def _inflated(f) -> Iterator[bytes]:
    """The plain bytes of the members that follow, in pieces."""
    inflate, rest, begun = zlib.decompressobj(31), b"", False
    while raw := rest or f.read(1 << 16):
        rest, begun = b"", True
        if data := inflate.decompress(raw, 1 << 20):
            yield data
        if inflate.eof:
            rest, inflate, begun = inflate.unused_data.lstrip(b"\0"), zlib.decompressobj(31), False
        else:
            rest = inflate.unconsumed_tail
    if begun:
        raise EOFError("a member ends early")


def _stream(pieces: Iterator[bytes], keeps, payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records of a stream of bytes; unwanted blocks are passed over piece by piece."""
    data = bytearray()
    while True:
        while data[:1] in (b"\r", b"\n"):
            del data[: len(data) - len(data.lstrip(b"\r\n"))]
        while (end := data.find(b"\r\n\r\n")) < 0 and (more := next(pieces, b"")):
            data += more
            if data[:1] in (b"\r", b"\n"):
                del data[: len(data) - len(data.lstrip(b"\r\n"))]
        if end < 0:
            if data.strip():
                raise EOFError("a header has no end")
            return
        head = _header(bytes(data[:end]))
        length = int(head.get("content-length", 0))
        del data[: end + 4]
        wanted = keeps(head)
        block = bytearray()
        while length:
            if not data:
                if not (more := next(pieces, b"")):
                    raise EOFError(f"a block lacks {length} bytes")
                data += more
            taken = data[:length]
            length -= len(taken)
            del data[: len(taken)]
            if wanted and payload:
                block += taken
        if wanted:
            yield head, bytes(block) if payload else None


def _batch(rows: list[tuple[dict[str, str], bytes | None]]) -> pa.RecordBatch:
    columns: dict[str, list] = {c: [] for c in (*_NAMED, "headers", "payload")}
    for head, block in rows:
        for c, name in _NAMED.items():
            columns[c].append(head.get(name.lower()))
        columns["headers"].append(list(head.items()))
        if block is not None and head.get("content-type", "").startswith("application/http"):
            cut = block.find(b"\r\n\r\n")
            block = block[cut + 4 :] if cut >= 0 else block
        columns["payload"].append(block)
    text = pa.string()
    return pa.RecordBatch.from_arrays([*(pa.array(columns[c], text) for c in _NAMED), pa.array(columns["headers"], pa.map_(text, text)), pa.array(columns["payload"], pa.binary())], names=list(columns))


class WarcSource(DataSource):
    """The data source ``simloom_warc``; options: path, payload, roll_bytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session.

    Spark looks such formats up in the session that is active in the calling
    thread, and a new thread has none; so this one becomes it.
    """
    spark.sparkContext._jvm.org.apache.spark.sql.SparkSession.setActiveSession(spark._jsparkSession)
    spark.dataSource.register(WarcSource)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives below ``path``; header names in ``headers`` are in lower case.

    Turns on the session's setting for filters pushed to Python data sources.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    register(spark)
    return spark.read.format(FORMAT).option("payload", str(payload).lower()).load(qualified(spark, path))


def write_archive(records: DataFrame, path: str) -> None:
    """Write records (record_id, record_type, target_uri, date, headers, payload) below ``path``."""
    register(records.sparkSession)
    records.write.format(FORMAT).mode("append").save(qualified(records.sparkSession, path))


#: Payloads of fewer bytes are always written in full.
REVISIT_BYTES = 1000


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Records of pages: of equal payloads of at least ``least`` bytes all but that of the greatest id are revisits.

    Rows that share the greatest id are all responses. A payload none of whose rows
    has an id is always a response.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), body.alias("payload"), F.sha1(body).alias("digest"), F.length(body).cast("long").alias("bytes"))
    top = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("k").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").drop("n")
    kept = rows.join(top, "digest", "left")
    again = F.coalesce(~F.col("k").eqNullSafe(F.col("top")) & F.col("top").isNotNull(), F.lit(False))

    def ident(k: str):
        h = F.md5(F.concat_ws("|", F.coalesce(F.col(k).cast("string"), F.lit("")), "digest").cast("binary"))
        return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))

    headers = F.map_filter(
        F.create_map(
            F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha1:"), "digest"), F.lit("Payload-Length"), F.col("bytes").cast("string"), F.lit("Page-Id"), F.col("k").cast("string"),
            F.lit("WARC-Profile"), F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            F.lit("WARC-Refers-To"), F.when(again, ident("top")), F.lit("Refers-To-Page-Id"), F.when(again, F.col("top").cast("string")),
        ),
        lambda _, v: v.isNotNull(),
    )
    return kept.select(
        ident("k").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("u").alias("target_uri"), F.lit(date).alias("date"),
        headers.alias("headers"), F.when(~again, F.col("payload")).alias("payload"),
    )


def archive_report(pages: DataFrame, **columns: str) -> DataFrame:
    """Write pages to archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses and revisits are read apart, by a filter on the record type that is pushed
    to the reader. Length and digest of a response are taken from the payload read;
    those of a revisit from its header, so no block of one is decoded.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archive(page_records(pages, **columns), path)
    header = lambda name: F.col("headers").getItem(name)
    refers = header("refers-to-page-id").cast("long").alias("refers_to")
    full = read_archive(spark, path).where("record_type = 'response'")
    light = read_archive(spark, path, payload=False).where("record_type = 'revisit'")
    page = header("page-id").cast("long").alias("page_id")
    responses = full.select(page, F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", refers)
    revisits = light.select(page, header("payload-length").cast("long").alias("payload_bytes"), F.substring(header("warc-payload-digest"), 6, 40).alias("payload_digest"), "record_type", refers)
    return responses.unionByName(revisits)
