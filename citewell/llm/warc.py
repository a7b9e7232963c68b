"""WARC archives as a Spark data source, ``warc``, written and read in Python.

Writing: each task writes gzip archives, one member a record.  Members carry
the ``sl`` extra field of the WARC standard's annex D, the member's compressed
and full length, so that a reader can step over a record without decoding it.
Each commit adds a manifest of its own, moved into place when complete, that
lists its files and member boundaries every few megabytes; files of failed or
repeated attempts are in no manifest and are passed over.

Reading: partitions are spans of files from the manifests, and whole files of
other writers, gathered to about ``span`` bytes.  Predicates on record type
and other header columns are pushed down.  A record's headers are decoded
first; where a predicate fails, or payloads aren't wanted, the rest is skipped.

Cases: null payloads are empty; control characters and blanks in header values
are percent-encoded; null ids and URIs leave their header out; records of 4 GB
or more have no ``sl`` field and are read through; a very long payload is held whole by the task that writes or reads it; of equal
payloads with equal ids any one is the response; plain ``.warc`` files and
members by other writers are read as well; an empty table gives an empty
archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from citewell.llm.common import shared_folder, table, written

SCHEMA = (
    "record_id string, record_type string, target_uri string, warc_date string, refers_to string, content_length long, "
    "http_length long, header_digest string, payload_length long, payload_digest string, payload binary"
)
_HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "refers_to": "warc-refers-to",
}
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
_MANIFESTS = "_manifests"
_OWN_FILE = re.compile(r"own-[0-9a-f]{32}-[0-9a-f]{32}\.warc\.gz")


def _open_fs(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(
    record_id: str | None, record_type: str, target_uri: str | None, warc_date: str, refers_to: str | None, payload: bytes | None, length: int | None = None, sha1: str | None = None
) -> bytes:
    """One record; a revisit has the HTTP headers alone, with its payload's full length and digest (``sha1``, hexadecimal), and needs no payload."""
    length = len(payload) if length is None else length
    told = sha1_base32(payload) if sha1 is None else base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload if record_type == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Date: {warc_date}"]
    if record_id is not None:
        head.append(f"WARC-Record-ID: <{_clean(record_id)}>")
    if target_uri is not None:
        head.append(f"WARC-Target-URI: {_clean(target_uri)}")
    head += [f"WARC-Payload-Digest: sha1:{told}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if record_type == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <{_clean(refers_to)}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 4) -> bytes:
    """``record`` as a gzip member with the ``sl`` field, or without where a length needs more than 32 bits."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    length = 10 + 2 + 12 + len(body) + 8
    if length >> 32 or len(record) >> 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\0\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, length, len(record))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


@dataclass
class Written(WriterCommitMessage):
    files: list  # name, and the boundaries from 0 to the length


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, options: dict):
        self.path = path
        self.file_bytes = int(options.get("fileBytes", 256 << 20))
        self.span = int(options.get("span", 8 << 20))
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        system, root = _open_fs(self.path)
        system.create_dir(root, recursive=True)
        files: list = []
        out, at = None, 0
        for row in rows:
            record = record_bytes(row.record_id, row.record_type, row.target_uri, row.warc_date, row.refers_to, bytes(row.payload or b""), row.payload_length, row.payload_sha1)
            data = member(record)
            if out is not None and at >= self.file_bytes:
                files[-1][1].append(at)
                out.close()
                out = None
            if out is None:
                name, at = f"own-{self.job}-{uuid.uuid4().hex}.warc.gz", 0
                out = system.open_output_stream(f"{root}/{name}", compression=None)
                files.append((name, [0]))
            elif at - files[-1][1][-1] >= self.span:
                files[-1][1].append(at)
            out.write(data)
            at += len(data)
        if out is not None:
            files[-1][1].append(at)
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        system, root = _open_fs(self.path)
        system.create_dir(f"{root}/{_MANIFESTS}", recursive=True)
        names = [x for m in messages if m for x in m.files]
        place = f"{root}/{_MANIFESTS}/{self.job}"
        with system.open_output_stream(f"{place}.part", compression=None) as out:
            out.write(json.dumps(names).encode())
        system.move(f"{place}.part", f"{place}.json")

    def abort(self, messages: list) -> None:
        system, root = _open_fs(self.path)
        for m in messages:
            for name, _ in m.files if m else []:
                try:
                    system.delete_file(f"{root}/{name}")
                except FileNotFoundError:
                    pass


@dataclass
class Spans(InputPartition):
    spans: list  # file, start, end

    def __init__(self, spans: list):
        super().__init__(None)
        self.spans = spans


def parse_headers(data: bytes) -> tuple[dict[str, str], int] | None:
    """Header names in lower case with their values, and where the block begins; None where the headers go on."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    found = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    return found, end + 4


class Record:
    """A record whose headers are known and whose block is fetched on demand."""

    def __init__(self, headers: dict[str, str], block):
        self.headers, self.block = headers, block

    def value(self, column: str):
        if column == "content_length":
            return int(self.headers.get("content-length", 0))
        got = self.headers.get(_HEADERS[column])
        return got.strip("<>") if got and column in ("record_id", "refers_to") else got


_FIRST = 2048


def records(f, start: int, end: int) -> Iterator[Record]:
    """The records of a span; a block not asked for is not decoded."""
    at = start
    while at < end:
        f.seek(at)
        first = f.read(_FIRST)
        if first[:2] == b"\x1f\x8b":
            length, begin = None, 10
            if first[3] & 4:
                n = struct.unpack_from("<H", first, 10)[0]
                begin = 12 + n
                extra, i = first[12:begin], 0
                while i + 4 <= n:
                    size = struct.unpack_from("<H", extra, i + 2)[0]
                    if extra[i : i + 2] == b"sl" and size == 8:
                        length = struct.unpack_from("<I", extra, i + 4)[0]
                    i += 4 + size
            for flag in (8, 16):  # a file name and a comment, each ended by a zero
                if first[3] & flag:
                    begin = first.index(b"\0", begin) + 1
            begin += 2 * bool(first[3] & 2)
            if length is None:
                f.seek(at)
                unpack, parts, used = zlib.decompressobj(31), [], 0
                while not unpack.eof and (piece := f.read(1 << 20)):
                    parts.append(unpack.decompress(piece))
                    used += len(piece)
                length = used - len(unpack.unused_data)
                whole = b"".join(parts)
                headers, body = parse_headers(whole)
                yield Record(headers, lambda w=whole, b=body, n=int(headers.get("content-length", 0)): w[b : b + n])
            else:
                unpack = zlib.decompressobj(-15)
                data = unpack.decompress(first[begin:length])
                fed = min(len(first), length)
                while (got := parse_headers(data)) is None and fed < length and not unpack.eof:
                    piece = f.read(min(_FIRST, length - fed))
                    data += unpack.decompress(piece)
                    fed += len(piece)
                headers, body = got

                def rest(data=data, unpack=unpack, fed=fed, body=body, at=at, length=length, n=int(headers.get("content-length", 0))) -> bytes:
                    f.seek(at + fed)
                    return (data + unpack.decompress(f.read(length - fed)))[body : body + n]

                yield Record(headers, rest)
            at += length
        else:
            data = first
            while (got := parse_headers(data)) is None and (piece := f.read(_FIRST)):
                data += piece
            if got is None:
                return
            headers, body = got
            n = int(headers.get("content-length", 0))

            def plain(at=at, body=body, n=n) -> bytes:
                f.seek(at + body)
                return f.read(n)

            yield Record(headers, plain)
            at += body + n + 4


@dataclass
class WarcReader(DataSourceReader):
    path: str
    options: dict
    tests: list = field(default_factory=list)

    def pushFilters(self, filters: list) -> Iterator:
        for x in filters:
            column = x.attribute[0] if getattr(x, "attribute", None) and len(x.attribute) == 1 else None
            if column in _HEADERS and isinstance(x, (EqualTo, In, StringStartsWith, IsNotNull)):
                self.tests.append((column, type(x).__name__, getattr(x, "value", None)))
            else:
                yield x

    def partitions(self) -> list[Spans]:
        system, root = _open_fs(self.path)
        spans = []
        for x in system.get_file_info(fs.FileSelector(root, recursive=True)):
            if x.is_file and x.path.endswith(f"{_MANIFESTS}/{x.base_name}") and x.extension == "json":
                with system.open_input_stream(x.path, compression=None) as f:
                    spans += [(f"{root}/{name}", a, b) for name, cuts in json.loads(f.read()) for a, b in zip(cuts, cuts[1:], strict=False)]
            elif x.is_file and x.path.endswith((".warc", ".warc.gz")) and not _OWN_FILE.fullmatch(x.base_name):
                spans.append((x.path, 0, x.size))
        most = int(self.options.get("span", 8 << 20))
        bins: list[list] = []
        size = most
        for span in sorted(spans):
            if size + span[2] - span[1] > most:
                bins.append([])
                size = 0
            bins[-1].append(span)
            size += span[2] - span[1]
        return [Spans(x) for x in bins] or [Spans([])]

    def wanted(self, record: Record) -> bool:
        for column, kind, value in self.tests:
            got = record.value(column)
            if got is None:
                return False
            if kind == "EqualTo" and got != value or kind == "In" and got not in value or kind == "StringStartsWith" and not got.startswith(value):
                return False
        return True

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        system, _ = _open_fs(self.path)
        mode = self.options.get("payload", "full")  # full; check: lengths and digests of payloads without the payloads; none: headers alone
        types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in SCHEMA.split(", ")]
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _COLUMNS)
            rows.clear()
            return made

        for path, start, end in partition.spans:
            with system.open_input_file(path) as f:
                for record in records(f, start, end):
                    if not self.wanted(record):
                        continue
                    http_length = length = digest = payload = None
                    if mode != "none":
                        block = record.block()
                        head = parse_headers(block) if block.startswith(b"HTTP/") else None
                        if head and "content-length" in head[0]:
                            http_length = int(head[0]["content-length"])
                        if record.value("record_type") != "revisit":
                            payload = block[head[1] :] if head else block
                            length, digest = len(payload), sha1_base32(payload)
                            held += length * (mode == "full")
                    told = record.headers.get("warc-payload-digest")
                    rows.append((*[record.value(c) for c in _COLUMNS[:6]], http_length, told.rpartition(":")[2] if told else None, length, digest, payload if mode == "full" else None))
                    if len(rows) >= 2000 or held >= 16 << 20:
                        held = 0
                        yield batch()
        if rows:
            yield batch()


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes format ``warc`` known and predicate push-down to Python sources allowed in this session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payload: str = "full", span: int = 8 << 20) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).option("span", span).load(path)


def write_warc(rows: DataFrame, path: str) -> None:
    """Writes ``record_id, record_type, target_uri, warc_date, refers_to, payload, payload_length, payload_sha1`` rows; adds to what ``path`` has.

    Length and digest may be null where the payload is there.
    """
    register(rows.sparkSession)
    rows.select("record_id", "record_type", "target_uri", "warc_date", "refers_to", "payload", "payload_length", "payload_sha1").write.format("warc").mode("append").save(path)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", hot_share: int = 10_000) -> DataFrame:
    """Records of pages: of equal payloads of at least ``least_bytes`` the smallest id is the response that others revisit.

    Rows that repeat the smallest id are all responses.  Digests are counted on
    narrow rows.  Those that more than one row in ``hot_share`` has, fewer than
    ``hot_share`` of them, are broadcast, so a frequent payload is never moved;
    the others that repeat meet their rows by a join no key of which is hot.  A
    revisit goes on with its length and digest alone.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    rows = rows.select("*", F.unhex(F.sha2("payload", 256)).alias("key"), F.octet_length("payload").cast("long").alias("payload_length"))
    counted = rows.filter(F.col("payload_length") >= least_bytes).groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = written(counted.filter("n > 1"), "shared-payloads")
    bound = max(1, pages.count() // hot_share)
    hot = F.broadcast(shared.filter(F.col("n") > bound).select("key", "first"))
    rest = rows.join(hot.select("key"), "key", "left_anti").join(shared.filter(F.col("n") <= bound).select("key", "first"), "key", "left")
    decided = rows.join(hot, "key").unionByName(rest)
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:x-page:"), F.col(c).cast("string"))
    return decided.select(
        name("id").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(date).alias("warc_date"),
        F.when(again, name("first")).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
        "payload_length",
        F.sha1("payload").alias("payload_sha1"),
    )


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages as archives and reads them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to, verified``."""
    spark = pages.sparkSession
    path = f"{folder or shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(with_revisits(pages), path)
    number = lambda c: F.regexp_extract(c, r"^urn:x-page:(-?\d+)$", 1).try_cast("long")
    # revisits step over the payloads of responses, undecoded; responses are decoded and their digests taken anew
    back = [read_warc(spark, path, payload="check").filter(F.col("record_type") == kind) for kind in ("revisit", "response")]
    return back[0].unionByName(back[1]).select(
        number("record_id").alias("page_id"),
        F.coalesce("payload_length", "http_length").alias("payload_bytes"),
        F.coalesce("payload_digest", "header_digest").alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
        F.coalesce(F.col("payload_digest") == F.col("header_digest"), F.lit(True)).alias("verified"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))
