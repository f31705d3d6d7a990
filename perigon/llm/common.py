"""Helpers shared by the corpus operators: shared storage, sizes, and hashing of whole text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigon import workers

#: Text bytes that the array code looks at in one go; a longer text is one piece by itself.
PIECE_BYTES = 1 << 19
#: Bytes of an Arrow batch that a Python worker is sent.
BATCH = "4m"


def sent_to_workers(spark: SparkSession) -> None:
    """Sends this package to the Python workers of a cluster.

    Everything that starts Python on a caller's rows calls this first. Where the session leaves the size of
    Arrow batches at Spark's default, BATCH bounds it, since whole texts take much memory on both sides.
    """
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size) == "67108864b":
        spark.conf.set(size, BATCH)
    workers.send(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sent_to_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt to as many tasks as run at a time where the scan has fewer: for work in Python on a small table of one file.

    A table of a size that matters has more partitions than that, and is left as it is.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only where the session names none and runs on one machine, a temporary folder is set; a cluster
    without the setting is an error, since its executors do not see each other's folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="perigon-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: For `written`: tables whose rows are some 100 KB. Parquet looks at the size of a page only every so many rows.
LARGE_ROWS = {"parquet.page.row.count.limit": "8", "parquet.block.size": str(16 << 20)}


def written(df: DataFrame, spark: SparkSession, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """The same rows, written once to the shared folder as Parquet; lineage ends there."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options or {}).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_path = path
    return found


def removed(*tables: DataFrame) -> None:
    """Deletes the files of tables from `written` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a table that `looked_up` sends to all tasks; else the keys with this share of all rows.
FEW = 200_000
HEAVY = 50_000


def looked_up(rows: DataFrame, table: DataFrame, key: str, count: str, few: int = FEW, heavy: int = HEAVY) -> DataFrame:
    """rows with the table's columns (all but `count`), null where it has not got the key.

    table: written, one row for each key, with the number of rows that have the key. With at most `few` keys it is sent to all
    tasks. Else only the keys with a `heavy`-th of the counted rows or more are, `heavy` of them at most since counts add up to no
    more than their sum; rows of the others are exchanged by key, where no key has such a share, and rows that
    are found already are dealt out by a hash of their own.
    """
    own = [c for c in table.columns if c not in (key, count)]
    if table.count() <= few:
        return rows.join(F.broadcast(table.drop(count)), key, "left")
    total = table.agg(F.sum(count)).first()[0]
    share = F.col(count) * heavy >= F.lit(total)
    head = table.filter(share).select(key, *[F.col(c).alias(f"{c}head__") for c in own], F.lit(True).alias("head__"))
    tail = table.filter(~share).select(F.col(key).alias("key__"), *own)
    some = rows.join(F.broadcast(head), key, "left")
    asked = F.when(F.col("head__").isNull(), F.col(key))
    spread = some.withColumn("spread__", F.when(asked.isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0)))
    tail = tail.withColumn("zero__", F.lit(0).cast("bigint"))
    joined = spread.join(tail, asked.eqNullSafe(F.col("key__")) & (F.col("spread__") == F.col("zero__")), "left")
    return joined.select(*rows.columns, *[F.coalesce(f"{c}head__", c).alias(c) for c in own])


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column over all rows."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column).cast("bigint")), F.lit(0)).alias("n")).first()["n"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, one after another, and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about `most` bytes each; a longer row is a range of its own, to be walked in parts."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def parts(data: np.ndarray, gap: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges of a text, of about `most` bytes each, that cut no word: each but the last ends before a gap byte.

    Case is folded first, since gaps are told for folded bytes.
    """
    a, n = 0, len(data)
    while n - a > most:
        b = a + most
        while b < n:
            found = np.flatnonzero(gap[lower_ascii(data[b : b + most])])
            if len(found):
                b += int(found[0])
                break
            b += most
        yield a, min(b, n)
        a = min(b, n)
    if a < n:
        yield a, n


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class SpanHash:
    """64-bit hashes of any byte spans of a buffer, from prefix sums of a polynomial modulo 2^64."""

    BASE = 0x9E3779B97F4A7C15 | 1
    INVERSE = pow(BASE, -1, 1 << 64)
    LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    power = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    @classmethod
    def reserve(cls, n: int) -> None:
        if len(cls.power) <= n:
            steps = np.full(max(n + 1, 2 * PIECE_BYTES), cls.BASE, np.uint64)
            steps[0] = 1
            cls.power = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = cls.INVERSE
            cls.inverse = np.cumprod(steps, dtype=np.uint64)

    def __init__(self, data: np.ndarray):
        """data: about a piece; the tables of powers that all buffers share are as long as the longest."""
        n = len(data)
        self.reserve(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.LETTER[data] * self.power[:n], dtype=np.uint64, out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for each pair; the empty span has a hash of its own."""
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """Hash of each run of `width` bytes, by its start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n] + np.uint64(width))


def byte_class(members: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(members)] = True
    return found


SPACE = byte_class(b" \t\n\v\f\r")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside `gap`, and for each row the number of words before it."""
    inside = ~gap[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


_STEP = [np.uint64(pow(0xFF51AFD7ED558CCD, k, 1 << 64)) for k in range(64)]


def shingles(word_hash: np.ndarray, row_words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words within each row, and the n+1 offsets of the rows among them.

    A row of fewer words, but not none, has one shingle: all its words.
    """
    counts = np.diff(row_words)
    per_row = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(per_row, out=out_offsets[1:])
    total = int(out_offsets[-1])
    if total == 0:
        return np.zeros(0, np.uint64), out_offsets
    first = np.repeat(row_words[:-1] - out_offsets[:-1], per_row) + np.arange(total)
    length = np.repeat(np.minimum(counts, size), per_row)
    padded = np.concatenate([word_hash, np.zeros(size, np.uint64)])
    found = length.astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53)
    for k in range(size):
        found += np.where(k < length, padded[first + k] * _STEP[k + 1], np.uint64(0))
    return mix(found), out_offsets


#: Longer words are hashed whole: two short ones that differ have different prefix sums but by chance, very long ones can be made alike.
LONG_WORD = 64


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words data[start:end]."""
    found = SpanHash(data).spans(start, end)
    for k in np.flatnonzero(end - start > LONG_WORD):
        found[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes(), 7)
    return found


def word_pieces(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For rows [i, j): hashes of their words, starts and ends within their row, and the number of words before each row.

    Rows longer than a piece come in several parts, each with i and j = i + 1. ASCII case is folded.
    """
    for i, j in pieces(offsets):
        own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if j == i + 1 and len(own) > PIECE_BYTES:
            for a, b in parts(own, gap):
                some = lower_ascii(own[a:b])
                start, end, rows = words(some, np.array([0, b - a]), gap)
                yield i, j, word_hashes(some, start, end), start + a, end + a, rows
        else:
            own = lower_ascii(own)
            start, end, rows = words(own, at, gap)
            base = np.repeat(at[:-1], np.diff(rows))
            yield i, j, word_hashes(own, start, end), start - base, end - base, rows


def shingle_rows(data: np.ndarray, offsets: np.ndarray, size: int = 5, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the rows of a buffer, ASCII case folded, and the n+1 offsets of the rows among them.

    A row longer than a piece is walked in parts; each begins with the last size - 1 words before it.
    """
    found: list[np.ndarray] = []
    counts = np.zeros(len(offsets) - 1, np.int64)
    row, tail = None, np.zeros(0, np.uint64)

    def end() -> None:
        # a long row of fewer words than a shingle has one, of all its words
        if row is not None and not counts[row] and len(tail):
            found.append(shingles(tail, np.array([0, len(tail)]), size)[0])
            counts[row] = 1

    for i, j, hashes, _, _, rows in word_pieces(data, offsets, gap):
        if i != row:
            end()
            row, tail = None, np.zeros(0, np.uint64)
        if j == i + 1 and offsets[j] - offsets[i] > PIECE_BYTES:
            row = i
            hashes = np.concatenate([tail, hashes])
            if len(hashes) >= size:
                found.append(shingles(hashes, np.array([0, len(hashes)]), size)[0])
                counts[i] += len(found[-1])
                tail = hashes[len(hashes) - size + 1 :]
            else:
                tail = hashes
        else:
            h, o = shingles(hashes, rows, size)
            found.append(h)
            counts[i:j] = np.diff(o)
    end()
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])
