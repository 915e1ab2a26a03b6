"""WARC archives as a Spark data source, and pages archived with identical payloads stored once.

``spark.read.format("warc")`` plans whole files into partitions of a bounded size and streams
records out of them.  A record's header block is parsed first; predicates on the header columns
(record type, target, digest, ...) are pushed into the reader and judged there.  The payload of
a record that fails them, or that the asked schema leaves out, is neither decoded nor read: a
plain file is sought past it, a compressed one is sought past the rest of the record's gzip
member, whose length stands in its ``sl`` extra field.  Members without that field (files of
other writers) are inflated and thrown away in pieces.

``df.write.format("warc")`` writes one gzip member per record into files of a bounded size under
a temporary folder and moves them into place when the job commits, so lost or repeated tasks
leave nothing behind that a reader sees.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weft.llm.common import prepare, stored
from weft.operators.skew import split_lookup
from weft.session import scratch_path

#: columns of the source; ``content_length`` is that of the block, ``payload`` what the block holds
SCHEMA = ("record_id string, type string, target_uri string, date string, content_type string, payload_digest string, "
          "payload_length long, refers_to string, content_length long, payload binary")
# fixed values: the header names of the columns
HEADERS = {
    "record_id": "WARC-Record-ID", "type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length", "refers_to": "WARC-Refers-To", "content_length": "Content-Length",
}
NUMBERS = ("payload_length", "content_length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: bytes of a written file, and of the files that one reading task gets, at about
FILE_BYTES = 64 << 20
TASK_BYTES = 64 << 20
#: bytes fetched at a time, and the longest header block
FETCH = 1 << 18
MAX_HEADER = 1 << 20
#: records and bytes of an Arrow batch
BATCH_RECORDS, BATCH_BYTES = 512, 8 << 20


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/").rstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder.rstrip("/"))


# ---- one record to bytes ---------------------------------------------------------------------

def clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(fields: dict[str, object], block: bytes) -> bytes:
    lines = ["WARC/1.1"]
    lines += [f"{HEADERS[c]}: {clean(str(v))}" for c, v in fields.items() if v is not None and c in HEADERS and c != "content_length"]
    if fields.get("type") == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member that says its own length: extra field ``sl``, compressed and plain size
    (left out beyond 4 GB, which the field cannot hold)."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    whole = 10 + 2 + 12 + len(body) + len(tail)
    if max(whole, len(data)) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\0\xff" + body + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, whole, len(data)) + body + tail


# ---- bytes to records ------------------------------------------------------------------------

class Window:
    """A file read in pieces; what is sought past is not fetched."""

    def __init__(self, file: pa.NativeFile, fetch: int = FETCH):
        self.file, self.fetch, self.size = file, fetch, file.size()
        self.at, self.data, self.fetched = 0, b"", 0

    def get(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at`` (fewer at the end of the file)."""
        n = max(0, min(n, self.size - at))
        if at < self.at or at + n > self.at + len(self.data):
            self.at, self.data = at, self.file.read_at(min(max(n, self.fetch), self.size - at), at)
            self.fetched += len(self.data)
        return self.data[at - self.at:at - self.at + n]


class Plain:
    """A record in an uncompressed file."""

    def __init__(self, window: Window, at: int):
        self.window, self.start = window, at

    def first(self, n: int) -> bytes:
        return self.window.get(self.start, n)

    def part(self, at: int, n: int) -> bytes:
        return self.window.get(self.start + at, n)

    def end(self, length: int) -> int:
        return self.start + length


class Packed:
    """A record in a gzip member, inflated no further than asked."""

    def __init__(self, window: Window, at: int):
        self.window, self.start, self.next = window, at, at
        self.inflate, self.data = zlib.decompressobj(31), bytearray()
        head = window.get(at, 24)
        self.length = None
        if head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"sl" and struct.unpack("<H", head[14:16]) == (8,):
            self.length = struct.unpack("<I", head[16:20])[0]

    def _more(self) -> bytes:
        piece = self.inflate.unconsumed_tail
        if not piece:
            piece = self.window.get(self.next, 1 << 14)
            self.next += len(piece)
            if not piece and not self.inflate.eof:
                raise ValueError("a gzip member ends too early")
        out = self.inflate.decompress(piece, 1 << 16)
        return out

    def first(self, n: int) -> bytes:
        while len(self.data) < n and not self.inflate.eof:
            self.data += self._more()
        return bytes(self.data[:n])

    def part(self, at: int, n: int) -> bytes:
        return self.first(at + n)[at:]

    def end(self, length: int) -> int:
        if self.length is not None:
            return self.start + self.length
        while not self.inflate.eof:
            self._more()  # thrown away
        return self.next - len(self.inflate.unused_data)


def headers_of(block: bytes) -> dict[str, str]:
    """Header names in lower case; a continued line belongs to the one before."""
    out, last = {}, None
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def number(text: str | None) -> int | None:
    return int(text) if text is not None and text.isdigit() else None


def fields_of(headers: dict[str, str]) -> dict[str, object]:
    out = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to", "target_uri"):
        if out[c] and out[c][0] == "<" and out[c][-1] == ">":
            out[c] = out[c][1:-1]
    return out | {c: number(out[c]) for c in NUMBERS}


def payload_of(block: bytes, content_type: str | None) -> bytes:
    """The block, without the head of an HTTP message."""
    if (content_type or "").replace(" ", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def records(window: Window, wanted: Callable[[dict], bool], payload: bool) -> Iterator[dict]:
    """The wanted records of a file; only theirs are decoded, and only if ``payload`` is asked."""
    at = 0
    while at < window.size:
        head = window.get(at, 2)
        if head[:1] in b"\r\n":  # between records
            at += 1
            continue
        r = Packed(window, at) if head == b"\x1f\x8b" else Plain(window, at)
        n, split = 1 << 10, -1
        while split < 0:
            block = r.first(n)
            split = block.find(b"\r\n\r\n")
            if split < 0 and (len(block) < n or n > MAX_HEADER):
                raise ValueError(f"no WARC header at byte {at}")
            n *= 4
        if not block.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        row = fields_of(headers_of(block[:split]))
        length = row["content_length"] or 0
        if wanted(row):
            if payload:
                row["payload"] = payload_of(r.part(split + 4, length), row["content_type"])
            yield row
        at = r.end(split + 4 + length)


# ---- predicates ------------------------------------------------------------------------------

COMPARE: dict[type, Callable] = {
    ds.EqualTo: lambda x, y: x == y, ds.GreaterThan: lambda x, y: x > y, ds.GreaterThanOrEqual: lambda x, y: x >= y, ds.LessThan: lambda x, y: x < y,
    ds.LessThanOrEqual: lambda x, y: x <= y, ds.In: lambda x, y: x in y, ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith,
    ds.StringContains: lambda x, y: y in x,
}


def can_judge(f: ds.Filter) -> bool:
    if isinstance(f, ds.Not):
        return can_judge(f.child)
    return len(f.attribute) == 1 and f.attribute[0] in HEADERS and isinstance(f, (*COMPARE, ds.EqualNullSafe, ds.IsNull, ds.IsNotNull))


def judge(f: ds.Filter, row: dict) -> bool | None:
    """The predicate on parsed headers: true, false, or None as SQL's null."""
    if isinstance(f, ds.Not):
        inner = judge(f.child, row)
        return None if inner is None else not inner
    x = row[f.attribute[0]]
    if isinstance(f, (ds.IsNull, ds.IsNotNull)):
        return (x is None) == isinstance(f, ds.IsNull)
    if isinstance(f, ds.EqualNullSafe):
        return x == f.value
    if x is None:
        return None
    if isinstance(f, ds.In) and x not in f.value and None in f.value:
        return None
    return None if f.value is None else COMPARE[type(f)](x, f.value)


# ---- the data source -------------------------------------------------------------------------

@dataclass
class Files(ds.InputPartition):
    paths: list[str]


class WarcReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.folder = schema, options["path"]
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))
        self.filters: list[ds.Filter] = []
        unknown = {f.name for f in schema} - {*HEADERS, "payload"}
        if unknown:
            raise ValueError(f"no such WARC columns: {sorted(unknown)}")

    def pushFilters(self, filters):
        for f in filters:
            if can_judge(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        """Files in order of size, the large ones alone, small ones together."""
        store, root = filesystem(self.folder)
        found = store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = re.compile(r"(^|/)[._]")
        files = [(f.size, f.path) for f in found if f.type == pafs.FileType.File and not hidden.search(f.path[len(root):]) and re.search(r"\.warc(\.gz)?$", f.path)]
        out: list[Files] = []
        size = self.task_bytes
        for n, path in sorted(files, reverse=True):
            if size + n > self.task_bytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out or [Files([])]

    def read(self, partition):
        store, _ = filesystem(self.folder)
        names = [f.name for f in self.schema]
        kinds = [pa.binary() if c == "payload" else pa.int64() if c in NUMBERS else pa.string() for c in names]

        def wanted(row):
            return all(judge(f, row) for f in self.filters)

        rows, size = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as f:
                for row in records(Window(f), wanted, "payload" in names):
                    rows.append(row)
                    size += len(row.get("payload") or b"")
                    if len(rows) >= BATCH_RECORDS or size >= BATCH_BYTES:
                        yield _batch(rows, names, kinds)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, names, kinds)


def _batch(rows: list[dict], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(names, kinds)], names=names)


@dataclass
class Written(ds.WriterCommitMessage):
    names: list[str]


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.file_bytes = int(options.get("fileBytes", FILE_BYTES))
        self.level = int(options.get("level", 6))
        self.job = uuid.uuid4().hex[:12]

    def _temporary(self, root: str) -> str:
        return f"{root}/_temporary-{self.job}"

    def write(self, iterator):
        store, root = filesystem(self.folder)
        task = TaskContext.get()
        prefix, names, out, size = f"part-{task.partitionId():05d}-{self.job}-{task.taskAttemptId()}", [], None, 0
        for b in iterator:
            cols = [c for c in b.schema.names if c in HEADERS or c in ("payload", "block")]
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in cols}
                if out is None:
                    store.create_dir(self._temporary(root), recursive=True)
                    names.append(f"{prefix}-{len(names):04d}.warc.gz")
                    out = store.open_output_stream(f"{self._temporary(root)}/{names[-1]}", compression=None)
                    size = out.write(member(record({"type": "warcinfo", "record_id": f"<urn:file:{names[-1]}>", "date": row.get("date"), "content_type": "application/warc-fields"},
                                                   b"format: WARC File Format 1.1\r\n")))
                size += out.write(member(record(*_to_record(row)), self.level))
                if size >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        """Driver: move the files of the tasks that count into place; what lost tasks left goes."""
        store, root = filesystem(self.folder)
        if self.overwrite:
            store.create_dir(root, recursive=True)
            for f in store.get_file_info(pafs.FileSelector(root)):
                if f.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", f.path):
                    store.delete_file(f.path)
        for m in messages:
            for name in m.names if m else []:
                store.move(f"{self._temporary(root)}/{name}", f"{root}/{name}")
        self._drop(store, root)

    def abort(self, messages):
        self._drop(*filesystem(self.folder))

    def _drop(self, store, root):
        if store.get_file_info(self._temporary(root)).type == pafs.FileType.Directory:
            store.delete_dir(self._temporary(root))


def _to_record(row: dict) -> tuple[dict, bytes]:
    """Header fields and block of a row.  A response's block is an HTTP message around the payload;
    a revisit has none; of other types the payload is the block."""
    kind, payload = row.get("type"), row.get("payload") or b""
    head = {c: row[c] for c in row if c in HEADERS}
    for c in ("record_id", "refers_to"):
        if head.get(c) is not None:
            head[c] = f"<{head[c]}>"
    if kind in ("response", "revisit"):
        head["content_type"] = "application/http; msgtype=response"
    if kind == "revisit":
        return head, HTTP % int(row.get("payload_length") or 0)
    if kind != "response":
        return head, payload
    head["payload_digest"] = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return head | {"payload_length": len(payload)}, HTTP % len(payload) + payload


class Warc(ds.DataSource):
    """``path``: a folder.  Reading: ``taskBytes``; ``.schema(...)`` with some of the columns leaves
    the others out.  Writing: ``fileBytes``, ``level`` (of compression); modes append, overwrite."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let Spark push predicates into Python sources."""
    prepare(spark)
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, folder: str, columns: str = SCHEMA, where: str | None = None) -> DataFrame:
    """Records of the archives in ``folder`` that meet ``where``, with ``columns`` (a part of ``SCHEMA``).

    Every call loads the source anew.  Spark keeps the predicates that a Python source took with
    the loaded frame: a second query on the same ``spark.read...load()`` that has no predicate
    of its own would get the first one's rows.
    """
    register(spark)
    rows = spark.read.format("warc").schema(columns).load(folder)
    return rows if where is None else rows.where(where)


# ---- pages -----------------------------------------------------------------------------------

def base32(digest_hex: Column) -> Column:
    """40 hex digits (a SHA-1) as base 32: eight times 20 bits as four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def four(g: Column) -> Column:
        x = F.conv(F.substring(digest_hex, g * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(letters, F.shiftright(x, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def page_records(pages: DataFrame, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``pages (page_id, url, html)`` as WARC records: of pages with equal payloads of at least
    ``least`` bytes, the one with the smallest page_id is the response, the others revisit it.

    A null html is an empty payload.  Null ids come last and are named ``urn:page:none``; of
    rows that share id and payload the first by url (null first) counts, of equal rows one.  An
    empty table has no records; other columns are left out.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id"), F.col("url"), body.alias("payload"), F.unhex(F.sha2(body, 256)).alias("key"))
    place = F.struct(F.col("page_id").isNull().alias("late"), F.col("page_id").alias("page"), F.col("url").alias("url"))
    small = rows.where(F.length("payload") >= least).groupBy("key", "page_id", "url").agg(F.count("*").alias("n"), F.min(F.length("payload")).alias("bytes"), F.min(F.sha1("payload")).alias("sha1"))
    copies = small.groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct(place.alias("place"), F.col("n").alias("equal"))).alias("first"), F.min("bytes").alias("bytes"), F.min("sha1").alias("sha1"))
    copies = stored(copies.where("n > 1").select("key", "n", "first.place", "first.equal", "bytes", "sha1"), "warc-copies")

    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    met = split_lookup(rows, copies, "key", "left", rows_of="n")
    first = F.col("place").isNull() | place.eqNullSafe(F.col("place"))
    # of equal rows one is the response: they are one row here, the others are made of the copies' table
    whole = met.where(first & (F.col("place").isNull() | (F.col("equal") == 1)))
    several = copies.where("equal > 1")
    later = met.where(~first).select("page_id", "url", "place", "bytes", "sha1")
    if not several.isEmpty():
        one = met.where(first & (F.col("equal") > 1)).groupBy("key").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "payload")])
        whole = whole.select("page_id", "url", "payload").unionByName(one.drop("key"))
        more = several.withColumn("_i", F.explode(F.sequence(F.lit(2).cast("long"), F.col("equal"))))
        later = later.unionByName(more.select(F.col("place.page").alias("page_id"), F.col("place.url").alias("url"), "place", "bytes", "sha1"))
    response = whole.select(name(F.col("page_id")).alias("record_id"), F.lit("response").alias("type"), F.col("url").alias("target_uri"), "payload")
    revisit = later.select(name(F.col("page_id")).alias("record_id"), F.lit("revisit").alias("type"), F.col("url").alias("target_uri"),
                           name(F.col("place.page")).alias("refers_to"), F.concat(F.lit("sha1:"), base32(F.col("sha1"))).alias("payload_digest"), F.col("bytes").cast("long").alias("payload_length"))
    return response.unionByName(revisit, allowMissingColumns=True).withColumn("date", F.lit(date))


def write_pages(pages: DataFrame, folder: str, least: int = 0, **options) -> None:
    register(pages.sparkSession)
    page_records(pages, least).write.format("warc").mode("append").options(**options).save(folder)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Per archived page: ``page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok``.

    Responses are decoded and measured anew (``digest_ok`` compares with the header); of
    revisits only headers are read.
    """
    page = lambda c: F.when(F.col(c) != "urn:page:none", F.substring(F.col(c), len("urn:page:") + 1, 64).cast("long"))
    of = "record_id string, type string, payload_digest string"
    whole = read(spark, folder, f"{of}, payload binary", "type = 'response'")
    digest = base32(F.sha1("payload"))
    whole = whole.select(page("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"),
                         F.lit(None).cast("long").alias("refers_to"), (F.concat(F.lit("sha1:"), digest) == F.col("payload_digest")).alias("digest_ok"))
    again = read(spark, folder, f"{of}, payload_length long, refers_to string", "type = 'revisit'")
    again = again.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.substring(F.col("payload_digest"), 6, 32).alias("payload_digest"),
                         F.col("type").alias("record_type"), page("refers_to").alias("refers_to"), F.lit(None).cast("boolean").alias("digest_ok"))
    return whole.unionByName(again)


def archive(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write the pages to ``folder`` (default: a new one in the shared folder) and read them back."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    write_pages(pages, folder, least)
    return read_pages(pages.sparkSession, folder)
