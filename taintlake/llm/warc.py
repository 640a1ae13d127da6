"""WARC archives: a Spark data source that reads them, and a writer.

The reader plans one partition per group of files, takes filters on the record type and
on header fields, reads the header of each record first, and seeks past payloads that a
filter or the option `payload=false` makes unneeded.

A record that cannot be read is a row with only a `reject_reason` (and the header fields
that were read), and reading goes on at the next record: a header without end or with a
length that is no number, a record that is cut off, a response without an HTTP header.
A gzip stream that breaks ends its file with such a row.

The writer needs no Python: a record is a header and a block, both text, and records end
in an empty line, which is what Spark's text writer puts after each row.  So archives
can go to any file system Spark knows.  They are gzipped by default.  Record ids follow
from page_id and payload, so a task that runs again writes the same, and a revisit can
name its response."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from taintlake.plans.storage import shared_dir

PARTITION_BYTES = 64 << 20
MAX_HEADER = 1 << 20
#: Column of the data source and the header field that holds it.
FIELDS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest",
          "refers_to": "warc-refers-to", "page_id": "x-page-id", "refers_to_page": "x-refers-to-page", "payload_length": "x-payload-length"}
_LONG = {"page_id", "refers_to_page", "payload_length"}
SCHEMA = ", ".join(f"{c} {'long' if c in _LONG else 'string'}" for c in FIELDS) + ", payload binary, reject_reason string, scanned boolean"
_ARROW = pa.schema([(c, pa.int64() if c in _LONG else pa.string()) for c in FIELDS] + [("payload", pa.binary()), ("reject_reason", pa.string()), ("scanned", pa.bool_())])


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keep what a header can decide; leave the rest to Spark."""
        kinds = {EqualTo: "equal", EqualNullSafe: "same", In: "in", IsNotNull: "known", StringStartsWith: "starts"}
        for f in filters:
            kind = kinds.get(type(f))
            column = getattr(f, "attribute", ("",))
            if kind and column == ("scanned",):
                continue
            if kind and len(column) == 1 and column[0] in FIELDS:
                self.tests.append((column[0], kind, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, root = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        files = sorted((i for i in info if i.is_file and i.size and not i.base_name.startswith(("_", "."))), key=lambda i: i.path)
        groups: list[list[str]] = []
        room = 0
        for i in files:
            if i.size > room:
                groups.append([])
                room = PARTITION_BYTES
            groups[-1].append(i.path)
            room -= i.size
        return [Files(g) for g in groups] or [Files([])]

    def _wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            got = row[column]
            ok = {"equal": lambda: got is not None and got == value, "same": lambda: got == value, "in": lambda: got is not None and got in value,
                  "known": lambda: got is not None, "starts": lambda: got is not None and got.startswith(value)}[kind]()
            if not ok:
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        rows: list[dict] = []
        held = 0
        for path in partition.value:
            packed = path.endswith(".gz")
            with system.open_input_stream(path, compression="gzip" if packed else None) if packed else system.open_input_file(path) as raw:
                for row in _records(raw, self._wanted, self.payload, not packed):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) >= 2_000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class _Bad(Exception):
    """A record that cannot be read."""


class _Buffer:
    """Lines, exact reads and skips over a stream, a mebibyte at a time."""

    def __init__(self, raw, seekable: bool):
        self.raw, self.seekable, self.data, self.at = raw, seekable, b"", 0

    def _more(self) -> bool:
        try:
            fresh = self.raw.read(1 << 20)
        except (OSError, EOFError, zlib.error) as error:
            self.raw = _Ended()
            raise _Bad(f"stream: {error}") from error
        self.data, self.at = self.data[self.at:] + fresh, 0
        return bool(fresh)

    def header(self) -> bytes | None:
        """Bytes up to the next empty line; None at the end."""
        while self.data[self.at:self.at + 2] == b"\r\n" or (len(self.data) - self.at < 2 and self._more()):
            if self.data[self.at:self.at + 2] == b"\r\n":
                self.at += 2
        if self.at >= len(self.data):
            return None
        seen = self.at
        while (end := self.data.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(self.data) - self.at - 3)
            if len(self.data) - self.at > MAX_HEADER or not self._more():
                raise _Bad("header without end")
        head = self.data[self.at:end]
        self.at = end + 4
        return head

    def resume(self) -> None:
        """Go on at the next line that starts a record, or at the end."""
        while (found := self.data.find(b"\r\nWARC/", self.at)) < 0:
            self.at = max(self.at, len(self.data) - 6)
            if not self._more():
                self.at = len(self.data)
                return
        self.at = found + 2

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while left:
            if self.at >= len(self.data) and not self._more():
                raise _Bad("record is cut off")
            parts.append(self.data[self.at:self.at + left])
            self.at += len(parts[-1])
            left -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        here = min(n, len(self.data) - self.at)
        self.at += here
        if n > here and self.seekable:
            to = self.raw.tell() + n - here
            if to > self.raw.size():
                self.raw.seek(self.raw.size())
                raise _Bad("record is cut off")
            self.raw.seek(to)
        elif n > here:
            left = n - here
            while left:  # inflated, but not kept
                left -= len(self.take(min(left, 1 << 20)))


class _Ended:
    def read(self, n: int) -> bytes:
        return b""


def _records(raw, wanted, payload: bool, seekable: bool) -> Iterator[dict]:
    buffer = _Buffer(raw, seekable)
    while True:
        row = dict.fromkeys((*FIELDS, "payload", "reject_reason")) | {"scanned": True}
        try:
            head = buffer.header()
            if head is None:
                return
            length, http = _fields(head, row)
            if not wanted(row):
                buffer.skip(length)
                continue
            if not payload or row["record_type"] == "revisit":
                buffer.skip(length)
            else:
                block = buffer.take(length)
                if http:
                    top, end, block = block.partition(b"\r\n\r\n")
                    if not end:
                        raise _Bad("HTTP block without header end")
                row["payload"] = block
        except _Bad as error:
            row["reject_reason"] = str(error)
            try:
                if not str(error).startswith("HTTP"):  # that block has been read whole
                    buffer.resume()
            except _Bad:
                pass  # the stream broke; what is left of it is empty
            if not wanted(row):
                continue
        yield row


def _fields(head: bytes, row: dict) -> tuple[int, bool]:
    """Fill a row from a header; the length of the block, and whether it is HTTP."""
    first, *lines = head.decode("utf-8", errors="replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise _Bad(f"no WARC record: {first[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    for c, f in FIELDS.items():
        row[c] = fields.get(f)
        if c in _LONG and row[c] is not None:
            row[c] = int(row[c]) if row[c].isascii() and row[c].removeprefix("-").isdigit() and abs(int(row[c])) < 1 << 63 else None
    row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise _Bad(f"content length {length[:40]!r}")
    return int(length), fields.get("content-type", "").startswith("application/http")


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string or binary column."""
    digest = F.sha1(data.cast("binary"))
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return F.translate(F.concat(*[F.lpad(F.upper(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32)), 8, "0") for i in range(4)]), digits, letters)


def write_pages(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write a record per page (page_id, url, html).  Of pages with equal payloads, that
    with the largest page_id is a response and the others revisit it."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.col("url").cast("string"), r"[\r\n]+", " ").alias("url"), html.alias("html"), base32_sha1(html).alias("digest"))
    heads = rows.groupBy("digest").agg(F.max("page_id").alias("head"))
    joined = rows.join(heads, "digest").withColumn("revisit", F.coalesce(F.col("page_id") != F.col("head"), F.col("head").isNotNull()))
    end = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "), F.octet_length("html").cast("string"), F.lit(end + end))
    block = F.concat(http, F.when(F.col("revisit"), "").otherwise(F.col("html")))

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(end)), F.lit(""))

    def record_id(page: Column) -> Column:
        digits = F.md5(F.concat_ws("\x00", page.cast("string"), F.col("digest")).cast("binary"))
        parts = [F.substring(digits, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))

    head = F.concat(F.lit(f"WARC/1.1{end}"), field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
                    field("WARC-Record-ID", record_id(F.col("page_id"))), field("WARC-Target-URI", F.col("url")),
                    field("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
                    field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), field("X-Page-Id", F.col("page_id")),
                    field("WARC-Refers-To", F.when(F.col("revisit"), record_id(F.col("head")))), field("X-Refers-To-Page", F.when(F.col("revisit"), F.col("head"))),
                    field("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                    field("X-Payload-Length", F.octet_length("html")), field("Content-Type", F.lit("application/http;msgtype=response")),
                    field("Content-Length", F.octet_length(block)), F.lit(end))
    joined.select(F.concat(head, block).alias("value")).write.option("lineSep", end + end).option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records below a path: the header columns of FIELDS, the payload and reject_reason.

    Spark keeps a table's reader with the filters of one scan for a later scan that has
    none.  So every scan gets one that all rows pass, and with it a reader of its own."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path if "://" in path or path.startswith("file:") else f"file://{path}").where("scanned").drop("scanned")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write all pages as WARC archives in the shared folder and read them back:
    page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; a null url has no target field; other columns are
    ignored.  Rows that repeat page_id and payload of a response are responses, too.  A
    row without page_id revisits its payload's response, or is one if no row with that
    payload has a page_id."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(pages, path)
    full = read_warc(spark, path).where("record_type = 'response'").select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"),
        "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read_warc(spark, path, payload=False).where("record_type = 'revisit'").select(
        "page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))
    return full.union(again)
