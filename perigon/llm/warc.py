"""WARC archives as a Spark data source, and archives of pages with revisit records.

Reading plans partitions of whole files, up to `partitionBytes` each. A record's headers are parsed
first; predicates on record type and on header columns that Spark pushes down are decided on them,
and the payload of a record that fails, or that the option `payload` (all, response or none) does not
ask for, is not decoded: in a plain file the reader seeks past it, in a compressed one it seeks to
the next member where the member says how long it is (the `sl` extra field that the writer sets) and
otherwise inflates without keeping anything.

Writing puts each record into a gzip member of its own. A task writes to a name that no other attempt
uses, and only the commit on the driver gives the files their names, so that lost or repeated tasks
leave nothing behind.

Edge cases: a null payload is an empty one; an archive of no records is an empty folder; repeated
rows of the page that a payload is kept with are responses too; a page without page_id is never the
one kept unless no other has its payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from perigon.llm import common

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
    "content_type string, http_length bigint, headers map<string,string>, payload binary, file string, offset bigint, broken string"
)
HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 16


def decide(test, header: dict[str, str]) -> bool | None:
    """A predicate on a record's headers; None where its column is null."""
    if isinstance(test, Not):
        got = decide(test.child, header)
        return None if got is None else not got
    value = header.get(HEADER_OF[test.attribute[0]])
    if isinstance(test, IsNull):
        return value is None
    if isinstance(test, IsNotNull):
        return value is not None
    if isinstance(test, EqualNullSafe):
        return value == test.value
    if value is None:
        return None
    if isinstance(test, EqualTo):
        return value == test.value
    if isinstance(test, In):
        return value in test.value
    if isinstance(test, StringStartsWith):
        return value.startswith(test.value)
    if isinstance(test, StringEndsWith):
        return value.endswith(test.value)
    return test.value in value


def decidable(test) -> bool:
    if isinstance(test, Not):
        return decidable(test.child)
    return isinstance(test, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)) and len(test.attribute) == 1 and test.attribute[0] in HEADER_OF


def parse_headers(block: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line is the version or status."""
    found: dict[str, str] = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


class Content:
    """Bytes of a file's records, read in chunks as they are asked for: each byte is copied a fixed number of times, however long a record is."""

    def __init__(self, file):
        self.file, self.have, self.start, self.gone = file, bytearray(), 0, 0

    def __len__(self) -> int:
        return len(self.have) - self.start

    def more(self) -> bool:
        """Reads on; False at the end."""
        part = self.file.read(_CHUNK)
        self.have += part
        return bool(part)

    def need(self, n: int) -> bool:
        while len(self) < n:
            if not self.more():
                return False
        return True

    def peek(self, a: int, b: int) -> bytes:
        return bytes(memoryview(self.have)[self.start + a : self.start + b])

    def find(self, sign: bytes, begin: int = 0, most: int | None = None) -> int:
        """Place of the sign from `begin` on, reading on until it comes or `most` bytes are there; -1 without."""
        looked = begin
        while True:
            at = self.have.find(sign, self.start + looked)
            if at >= 0:
                return at - self.start
            looked = max(begin, len(self) - len(sign) + 1)
            if most is not None and len(self) >= most or not self.more():
                return -1

    def take(self, n: int) -> None:
        """Drops n bytes that are there."""
        self.start += n
        self.gone += n
        if self.start > 1 << 20 and 2 * self.start > len(self.have):
            del self.have[: self.start]
            self.start = 0

    def skip(self, n: int) -> bool:
        """Drops n bytes, also those that are not read yet; False if the file ends before."""
        while n > len(self):
            n -= len(self)
            self.take(len(self))
            if not self.more():
                return False
        self.take(n)
        return True

    def offset(self) -> int:
        return self.gone

    def cut(self) -> bool:
        """Whether the file ends inside of what it holds."""
        return False


class Plain(Content):
    def __init__(self, file, size: int):
        super().__init__(file)
        self.size = size

    def skip(self, n: int) -> bool:
        if n > len(self) + _CHUNK:
            n -= len(self)
            self.take(len(self))
            there = min(n, self.size - self.gone)
            self.gone += there
            self.file.seek(self.gone)
            return there == n
        return super().skip(n)


class Gzip(Content):
    """The content of gzip members one after another; a member may hold any number of records, also parts of them."""

    def __init__(self, file):
        super().__init__(file)
        self.raw, self.at, self.inflate = b"", 0, None
        #: Place of the member in the file and in the content, and what it says of its lengths.
        self.member, self.begins, self.lengths = 0, 0, None
        self.members: list[tuple[int, int, tuple[int, int] | None]] = []

    def _raw(self, n: int) -> bool:
        while len(self.raw) < n:
            part = self.file.read(_CHUNK)
            if not part:
                return False
            self.raw += part
        return True

    def _open(self) -> bool:
        """Begins the next member."""
        if not self._raw(1):
            return False
        lengths = None
        if self._raw(12) and self.raw[3] & 4:
            size = struct.unpack("<H", self.raw[10:12])[0]
            self._raw(12 + size)
            extra = self.raw[12 : 12 + size]
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and n == 8 and len(extra) >= 12:
                    lengths = struct.unpack("<II", extra[4:12])
                extra = extra[4 + n :]
        self.members.append((self.at, self.gone + len(self), lengths))
        self.inflate = zlib.decompressobj(31)
        return True

    def more(self) -> bool:
        before = len(self.have)
        while len(self.have) == before:
            if self.inflate is None and not self._open() or not self._raw(1):
                return False
            self.have += self.inflate.decompress(self.raw)
            rest = self.inflate.unused_data
            self.at += len(self.raw) - len(rest)
            self.raw = rest
            if self.inflate.eof:
                self.inflate = None
        return True

    def cut(self) -> bool:
        return self.inflate is not None

    def offset(self) -> int:
        """Of the member that the next byte is in."""
        while len(self.members) > 1 and self.members[1][1] <= self.gone:
            del self.members[0]
        return self.members[0][0] if self.members else self.at

    def skip_member(self, length: int) -> bool:
        """Moves on to the next member if the present one says that it holds just the `length` bytes from here on."""
        at = self.offset()
        place, begins, lengths = self.members[0]
        if lengths is None or begins != self.gone or not lengths[0] or lengths[1] != length:
            return False
        self.have, self.start, self.raw, self.inflate, self.members = bytearray(), 0, b"", None, []
        self.gone += length
        self.at = at + lengths[0]
        self.file.seek(self.at)
        return True


class Broken(ValueError):
    """A record that cannot be read whole."""


def records(file, size: int, tests: list, payload: str, verify: bool, name: str = "", broken: str = "fail") -> Iterator[tuple[int, dict, dict, bytes | None, str | None]]:
    """(offset, headers, HTTP headers, payload, what is wrong) of the records that pass the tests.

    Of several records in one gzip member the offset is the member's. What is wrong is null for whole records; broken:
    fail raises Broken for others, mark gives as much of them as there is, whatever their headers say.
    """
    first = file.read(2)
    file.seek(0)
    content = Gzip(file) if first == b"\x1f\x8b" else Plain(file, size)
    while True:
        try:
            while content.need(2) and content.peek(0, 2) == b"\r\n":
                content.take(2)
            there = content.need(1)
        except zlib.error:
            there = False
        offset = content.offset()
        header: dict[str, str] = {}
        body, wrong = b"", None
        try:
            if not there:
                if not content.cut() and not len(content):
                    return
                raise Broken("no record can be read")
            end = content.find(b"\r\n\r\n")
            if end < 0:
                if not content.cut() and not content.peek(0, len(content)).strip():
                    return
                raise Broken("the headers are cut off")
            header = parse_headers(content.peek(0, end))
            begin = end + 4
            size_said = header.get("content-length", "0")
            if not size_said.isdigit():
                raise Broken(f"the length {size_said!r} is no number")
            length = int(size_said)
            if not all(decide(t, header) for t in tests):
                if not (isinstance(content, Gzip) and content.skip_member(begin + length + 4)) and not content.skip(begin + length):
                    raise Broken("the record is cut off")
                continue
            kind = header.get("warc-type")
            wanted = payload == "all" or payload == "response" and kind == "response"
            is_http = header.get("content-type", "").startswith("application/http")
            http: dict[str, str] = {}
            if wanted:
                whole = content.need(begin + length)
                body = content.peek(begin, begin + length)
                if not whole:
                    raise Broken("the record is cut off")
            elif is_http:
                # without a wanted payload only the HTTP headers are decoded
                top = content.find(b"\r\n\r\n", begin, begin + length)
                body = content.peek(begin, top + 4) if begin <= top <= begin + length - 4 else b""
        except (Broken, zlib.error, EOFError) as error:
            wrong = f"{name}: record at {offset}: {error}"
            if broken == "fail":
                raise Broken(wrong) from None
            yield offset, header, {}, body if payload != "none" else None, wrong
            return
        if is_http:
            top, _, body = body.partition(b"\r\n\r\n")
            http = parse_headers(top)
        if wanted and verify:
            digest = header.get("warc-payload-digest", "")
            if kind == "response" and digest.startswith("sha1:") and digest[5:] != base64.b32encode(hashlib.sha1(body).digest()).decode():
                wrong = f"{name}: record at {offset}: the payload does not have the digest {digest}"
                if broken == "fail":
                    raise Broken(wrong)
        rest = not wanted and isinstance(content, Gzip) and content.skip_member(begin + length + 4) or content.skip(begin + length)
        if not rest:
            wrong = f"{name}: record at {offset}: the record is cut off"
            if broken == "fail":
                raise Broken(wrong)
        yield offset, header, http, body if wanted else None, wrong
        if not rest:
            return


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


@dataclass
class Written(WriterCommitMessage):
    temporary: str | None
    name: str | None


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, which is Spark's default one where it names none."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()


def located(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        raise ValueError(f"{path} names no file system")
    return pafs.FileSystem.from_uri(path)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "all").lower()
        self.verify = options.get("verify", "true").lower() == "true"
        self.most = int(options.get("partitionBytes", 64 << 20))
        self.broken = options.get("broken", "fail").lower()
        self.tests: list = []

    def pushFilters(self, filters):
        for test in filters:
            if decidable(test):
                self.tests.append(test)
            else:
                yield test

    def partitions(self):
        system, path = located(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith((".warc", ".warc.gz")) and "/_" not in f.path[len(path) :])
        out, size = [[]], 0
        for name, n in files:
            if out[-1] and size + n > self.most:
                out.append([])
                size = 0
            out[-1].append((name, n))
            size += n
        return [Files(p) for p in out]

    def read(self, partition):
        system, _ = located(self.path)
        rows: list[tuple] = []
        size = 0
        kinds = [pa.string()] * 7 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string(), pa.int64(), pa.string()]
        names = [part.split()[0] for part in SCHEMA.split(", ")]

        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for name, n in partition.paths:
            with system.open_input_file(name) as file:
                for offset, header, http, payload, wrong in records(file, n, self.tests, self.payload, self.verify, name, self.broken):
                    length = http.get("content-length")
                    rows.append((*[header.get(h) for h in HEADER_OF.values()], int(length) if length and length.isdigit() else None, list(header.items()), payload, name, offset, wrong))
                    size += len(payload or b"")
                    if len(rows) >= 1000 or size > 4 << 20:
                        yield out()
                        rows, size = [], 0
        if rows:
            yield out()


class WarcWriter(DataSourceArrowWriter):
    """Rows: record_type, record_id, target_uri, date, refers_to, payload_digest, payload_bytes, payload."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.level = int(options.get("level", 4))
        self.run = uuid.uuid4().hex

    def member(self, head: list[str], block: bytes) -> bytes:
        record = ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
        deflate = zlib.compressobj(self.level, zlib.DEFLATED, -15)
        data = deflate.compress(record) + deflate.flush()
        if max(len(data) + 32, len(record)) >> 32:  # lengths that the extra field cannot hold
            return struct.pack("<BBBBIBB", 0x1F, 0x8B, 8, 0, 0, 0, 255) + data + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
        return struct.pack("<BBBBIBBHBBHII", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, 0x73, 0x6C, 8, 24 + len(data) + 8, len(record) & 0xFFFFFFFF) + data + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)

    def write(self, iterator):
        system, path = located(self.path)
        attempt = uuid.uuid4().hex
        temporary = f"{path}/_temporary-{self.run}/{attempt}"
        sink = None
        for batch in iterator:
            for r in batch.to_pylist():
                if sink is None:
                    system.create_dir(f"{path}/_temporary-{self.run}", recursive=True)
                    sink = system.open_output_stream(temporary)
                    sink.write(self.member(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(attempt)}>", f"WARC-Date: {r['date']}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n"))
                sink.write(self.record(r))
        if sink is not None:
            sink.close()
        return Written(temporary, f"{path}/{attempt}.warc.gz") if sink is not None else Written(None, None)

    def record(self, r: dict) -> bytes:
        payload = r["payload"] or b""
        head = ["WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {r['date']}", f"WARC-Payload-Digest: {r['payload_digest']}", "Content-Type: application/http;msgtype=response"]
        if r["target_uri"] is not None:
            head.append("WARC-Target-URI: " + " ".join(r["target_uri"].split()))
        if r["record_type"] == "revisit":
            head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {r['refers_to']}"]
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n".encode()
        return self.member(head, http + (b"" if r["record_type"] == "revisit" else payload))

    def commit(self, messages):
        system, path = located(self.path)
        old = []
        if self.overwrite:
            old = [f.path for f in system.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.path.endswith((".warc", ".warc.gz"))]
        system.create_dir(path, recursive=True)
        for m in messages:
            if m is not None and m.temporary:
                system.move(m.temporary, m.name)
        for name in old:
            system.delete_file(name)
        self.clean(system, path)

    def abort(self, messages):
        self.clean(*located(self.path))

    def clean(self, system, path):
        temporary = f"{path}/_temporary-{self.run}"
        if system.get_file_info(temporary).type == pafs.FileType.Directory:
            system.delete_dir(temporary)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def read_warc(spark: SparkSession, path: str, payload: str = "all", verify: bool = True, partition_bytes: int = 64 << 20, broken: str = "fail") -> DataFrame:
    """Records of the archives below a path. Filters on header columns reach the reader.

    broken: fail (a record that is cut off or unreadable is an error that names file and place) or mark (what there is of
    it is a row whose column `broken` says what is wrong; the rest of its file is not read).
    """
    common.sent_to_workers(spark)
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", payload).option("verify", str(verify).lower()).option("partitionBytes", partition_bytes).option("broken", broken).load(qualified(spark, path))


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 5 hex digits are 4 digits of base 32."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_record_types(pages: DataFrame, least: int = 0, few: int = common.FEW, heavy: int = common.HEAVY) -> DataFrame:
    """Pages with payload, payload_bytes, payload_digest, record_type and refers_to.

    Of pages with equal payloads of at least `least` bytes the smallest page_id keeps the payload. Payloads are
    counted in each task before anything is exchanged, and only digests that occur again are looked up: sent to all
    tasks while they are few, so that no payload is exchanged. Beyond that, digests with a HEAVY-th of all pages
    or more (HEAVY of them at most) are sent, and the others, none of which has that share, are exchanged.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": sha1_base32(F.col("payload"))})
    first = rows.groupBy("payload_digest").agg(F.min("page_id").alias("first__"), F.count(F.lit(1)).alias("n__")).filter(F.col("n__") > 1)
    first = common.written(first, pages.sparkSession, "warc-repeated")
    found = common.looked_up(rows, first, "payload_digest", "n__", few, heavy)
    again = F.col("first__").isNotNull() & (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first__"))
    typed = found.withColumn("again__", F.coalesce(again, F.lit(False)))
    return typed.withColumns({"record_type": F.when(F.col("again__"), "revisit").otherwise("response"), "refers_to": F.when(F.col("again__"), F.col("first__"))}).drop("first__", "again__")


def write_pages(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = 0) -> None:
    """Archives of the pages: a record each, equal payloads written once."""
    common.sent_to_workers(pages.sparkSession)
    pages.sparkSession.dataSource.register(WarcDataSource)

    def urn(column: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("none")), F.lit(">"))

    rows = with_record_types(pages, least).select(
        "record_type",
        urn("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.when(F.col("refers_to").isNotNull(), urn("refers_to")).alias("refers_to"),
        F.concat(F.lit("sha1:"), "payload_digest").alias("payload_digest"),
        "payload_bytes",
        F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"),
    )
    rows.write.format("warc").mode("append").save(qualified(pages.sparkSession, path))


def report(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Per page, as read back from its archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(pages, path)
    found = read_warc(spark, path, payload="response").filter(F.col("record_type").isin("response", "revisit"))

    def page(column: str) -> Column:
        return F.regexp_extract(column, r"<urn:page:(-?\d+)>", 1).try_cast("bigint")

    return found.select(
        page("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("bigint"), F.col("http_length")).alias("payload_bytes"),
        F.substring("payload_digest", 6, 32).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first,
    list_transform(range(0, 40, 5), lambda i: ('0x' || substr(h, (i + 1)::BIGINT, 5))::BIGINT) AS v FROM p
)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((v[k // 4 + 1] >> (15 - 5 * (k % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""
