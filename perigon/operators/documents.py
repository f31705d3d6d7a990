"""Single documents from rows that many tasks hold: text files, and zip archives of one text.

Rows are dealt out in ranges of their order and each task writes what it has to a staging folder below the target
(Spark's own commit keeps what lost or repeated attempts leave out of it). Then one task for each document puts
the head, the parts in the order of their ranges and the foot together, some MB at a time, and moves the whole document to
its name. The staging folder goes at the end, also after a failure: there is a whole document or none.

The target must be a folder that all executors reach.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigon import workers

CHUNK = 4 << 20
#: Bytes of text that are deflated together.
PIECE = 1 << 20
_POLYNOMIAL = 0xEDB88320


def _staging(spark, folder: str) -> tuple[str, str]:
    """The target with its file system, and a new folder below it."""
    workers.send(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    whole = system.makeQualified(path).toString()
    return whole, f"{whole}/_staging-{uuid.uuid4().hex}"


def _remove(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _parts(staging: str, sign: str) -> list[str]:
    """Files of a staging folder, in the order of the ranges that tasks had."""
    system, below = pafs.FileSystem.from_uri(staging)
    found = system.get_file_info(pafs.FileSelector(below, recursive=True, allow_not_found=True))
    return sorted((f.path for f in found if f.type == pafs.FileType.File and f.base_name.startswith("part-") and f.base_name.endswith(sign)), key=part_order)


def part_order(path: str) -> tuple[int, str, str]:
    """Number of the task that wrote a part (of any number of digits), and the part's own name."""
    folder, name = path.rsplit("/", 1)
    return int(re.match(r"part-(\d+)", name)[1]), name, folder


def _placed(system: pafs.FileSystem, attempt: str, target: str) -> None:
    if system.get_file_info(target).type == pafs.FileType.File:
        system.delete_file(target)
    system.move(attempt, target)


def write_documents(rows: DataFrame, folder: str, order: list[str | Column], head: str | dict[str, str] = "", foot: str | dict[str, str] = "", names: list[str] | None = None) -> None:
    """One text file below the folder for each value of `file`: the head, a line for each row's `element` by `order`, the foot.

    rows: file, element and what `order` needs; a null element is left out. names: files that are written even if
    they have no row. Head and foot are for all files or by file; they end with a line break of their own, where they are not empty.
    """
    spark = rows.sparkSession
    whole, staging = _staging(spark, folder)
    try:
        dealt = rows.filter(F.col("element").isNotNull()).repartitionByRange("file", *order).sortWithinPartitions("file", *order)
        dealt.select("file", "element").write.partitionBy("file").text(f"{staging}/parts")
        found: dict[str, list[str]] = {n: [] for n in names or ()}
        for path in _parts(f"{staging}/parts", ".txt"):
            found.setdefault(unquote(path.rsplit("/", 2)[-2].removeprefix("file=")), []).append(path)
        if not found:
            return

        def ends(file: str) -> list[bytes]:
            own = [t.get(file, "") if isinstance(t, dict) else t for t in (head, foot)]
            return [(t + "\n").encode() if t else b"" for t in own]

        def join(documents) -> None:
            system, below = pafs.FileSystem.from_uri(whole)
            _, hidden = pafs.FileSystem.from_uri(staging)
            for row in documents:
                attempt = f"{hidden}/{uuid.uuid4().hex}"
                top, end = ends(row["file"])
                with system.open_output_stream(attempt) as out:
                    out.write(top)
                    for part in row["parts"]:
                        with system.open_input_stream(part) as source:
                            while some := source.read(CHUNK):
                                out.write(some)
                    out.write(end)
                _placed(system, attempt, f"{below}/{row['file']}")

        documents = spark.createDataFrame(sorted(found.items()), "file string, parts array<string>")
        documents.repartition(min(len(found), 4 * spark.sparkContext.defaultParallelism), "file").foreachPartition(join)
    finally:
        _remove(spark, staging)


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo that of CRC-32, highest power in the lowest bit."""
    found = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            found ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return found


def joined_crc(first: int, second: int, length: int) -> int:
    """CRC-32 of two texts one after the other from their own; length: bytes of the second."""
    shift, square = 1 << 31, 1 << 23  # x^0 and x^8
    while length:
        if length & 1:
            shift = _times(square, shift)
        square = _times(square, square)
        length >>= 1
    return _times(shift, first) ^ second


def _deflated(text: bytes, last: bool = False) -> bytes:
    """Blocks of a deflate stream that refer to nothing before them and end on a byte."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    return deflate.compress(text) + deflate.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)


def deflated_pieces(elements: DataFrame) -> DataFrame:
    """(crc, size, data): the lines of each partition in pieces of about PIECE bytes, each deflated for itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            text = b"".join(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([zlib.crc32(text)], pa.int64()), pa.array([len(text)], pa.int64()), pa.array([_deflated(text)], pa.binary())], names=["part", "crc", "size", "data"])

        for batch in batches:
            for line in batch.column(0).to_pylist():
                held.append((line + "\n").encode())
                size += len(held[-1])
                if size >= PIECE:
                    yield out()
                    size = 0
        if held:
            yield out()

    return elements.mapInArrow(run, "part int, crc bigint, size bigint, data binary")


def _zip_frame(name: bytes, crc: int, packed: int, size: int) -> tuple[bytes, bytes]:
    """What stands before and after the only entry of a zip archive; the 64-bit forms where a length needs them."""
    large = max(packed, size) >= 0xFFFFFFFF
    small = (0xFFFFFFFF, 0xFFFFFFFF) if large else (packed, size)
    version = 45 if large else 20
    extra = struct.pack("<HHQQ", 1, 16, size, packed) if large else b""
    common = struct.pack("<HHHHHIII", version, 0x800, 8, 0, 0x21, crc, *small)
    local = b"PK\3\4" + common + struct.pack("<HH", len(name), len(extra)) + name + extra
    at = len(local) + packed
    entry = b"PK\1\2" + struct.pack("<H", version) + common + struct.pack("<HHHHHII", len(name), len(extra), 0, 0, 0, 0, 0) + name + extra
    end = b""
    if at >= 0xFFFFFFFF:
        end = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), at) + b"PK\6\7" + struct.pack("<IQI", 0, at + len(entry), 1)
    return local, entry + end + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(entry), min(at, 0xFFFFFFFF), 0)


def write_zip(rows: DataFrame, folder: str, name: str, member: str, order: list[str | Column], head: str = "", foot: str = "") -> None:
    """A zip archive below the folder with one member: the head, a line for each row's `element` by `order`, the foot.

    Tasks deflate their own pieces; the archive is their blocks one after the other, its checksum is worked out from theirs.
    """
    spark = rows.sparkSession
    whole, staging = _staging(spark, folder)
    try:
        dealt = rows.filter(F.col("element").isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
        deflated_pieces(dealt.select("element")).write.parquet(f"{staging}/parts")
        parts = _parts(f"{staging}/parts", ".parquet")
        top, end = [(t + "\n").encode() if t else b"" for t in (head, foot)]

        def join(documents) -> None:
            system, below = pafs.FileSystem.from_uri(whole)
            _, hidden = pafs.FileSystem.from_uri(staging)
            for row in documents:
                first, last = _deflated(top), _deflated(end, last=True)
                crc, size, packed = zlib.crc32(top), len(top), len(first)
                for data, (own, n) in _pieces(system, row["parts"]):
                    crc, size, packed = joined_crc(crc, own, n), size + n, packed + len(data)
                crc, size, packed = joined_crc(crc, zlib.crc32(end), len(end)), size + len(end), packed + len(last)
                before, after = _zip_frame(member.encode(), crc, packed, size)
                attempt = f"{hidden}/{uuid.uuid4().hex}"
                with system.open_output_stream(attempt) as out:
                    out.write(before + first)
                    for data, _ in _pieces(system, row["parts"]):
                        out.write(data)
                    out.write(last + after)
                _placed(system, attempt, f"{below}/{row['file']}")

        spark.createDataFrame([(name, parts)], "file string, parts array<string>").coalesce(1).foreachPartition(join)
    finally:
        _remove(spark, staging)


def _pieces(system: pafs.FileSystem, parts: list[str]) -> Iterator[tuple[bytes, tuple[int, int]]]:
    """Deflated pieces in order, some at a time, with their checksum and size."""
    for part in parts:
        with system.open_input_file(part) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=8, columns=["crc", "size", "data"]):
                for crc, size, data in zip(*[c.to_pylist() for c in batch.columns]):
                    yield data, (crc, size)
