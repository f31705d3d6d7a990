"""Benchmark decontamination: a prefix-filtered join of documents with windows of benchmark items.

Words are runs of digits, letters and non-ASCII characters, ASCII case folded. A window is `width`
consecutive words of an item (all words of a shorter one); a document contains a window when its
words stand there in that order. Containment of a whole window makes each of its shingles (SHINGLE
words, or all of a shorter window) necessary.

1.  The items' windows and their shingles are a table. A bitmap of fixed size, set for the shingles
    of all windows, picks the shingles of documents that are counted.
2.  Windows are joined with these counts. One that has a shingle which no document has cannot occur
    and goes; the others are filed under their rarest shingle, their prefix.
3.  Filed windows go to the tasks, `block_windows` of them at a time: with the usual benchmark that is
    one pass over the documents. Where a document has a prefix, its place in the window fixes where the window
    must start: the window has to lie inside the document (bounds of position and length), then the hashes
    of all its words are compared, and what agrees is confirmed by the words themselves, byte by byte.
4.  Which items have a window is a table of its own: the windows that were found are joined with it, where items are asked for.

The driver and the tasks hold the bitmap (BITMAP bits at most) or one block of windows, whatever the
size of the benchmark and however many items share a window. No document is shuffled.

Edge cases: null and empty texts have no words; items without words have no windows; repeated items
count once for each item_id, which may be of any type and null; columns of the result replace document
columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perigon.llm import common

WIDTH = 10
SHINGLE = 3
BLOCK_WINDOWS = 100_000
#: Bits of the bitmap at most (32 MB), and of one row of it.
BITMAP = 1 << 28
CHUNK = 1 << 19
#: Distinct shingles that a task counts before it sends the counts on.
COUNTED = 200_000
#: Pairs of a document's place and a window that are compared at a time.
PAIRS = 1 << 18
GAP = np.ones(256, bool)
GAP[0x30:0x3A] = False
GAP[0x61:0x7B] = False
GAP[0x80:] = False
_FOLD = bytes(32 if GAP[common.lower_ascii(np.array([b], np.uint8))[0]] else int(common.lower_ascii(np.array([b], np.uint8))[0]) for b in range(256))


def plain(raw: bytes) -> bytes:
    """The words of a stretch of text, folded, one space between them."""
    return b" ".join(raw.translate(_FOLD).split())


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces [i, j) of the rows: word hashes, starts and ends within their row, and words before each row."""
    data, offsets = common.utf8(texts)
    held: list = []
    for i, j, hashes, start, end, rows in common.word_pieces(data, offsets, GAP):
        if held and held[0] != i:
            yield whole(*held)
            held = []
        if j == i + 1 and offsets[j] - offsets[i] > common.PIECE_BYTES:
            held = held or [i, [], [], []]
            for part, new in zip(held[1:], (hashes, start, end)):
                part.append(new)
        else:
            yield i, j, hashes, start, end, rows
    if held:
        yield whole(*held)


def whole(i: int, hashes: list, start: list, end: list):
    """A long row from its parts."""
    hashes = np.concatenate(hashes)
    return i, i + 1, hashes, np.concatenate(start), np.concatenate(end), np.array([0, len(hashes)])


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words that cross no row's start, and the places of their first words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return hashes[:0], np.zeros(0, np.int64)
    found = np.full(n, np.uint64(size * 0xC4CEB9FE1A85EC53 % 2**64))
    for k in range(size):
        found = common.mix(found + hashes[k : k + n])
    inside = np.ones(len(hashes) + 1, bool)
    for k in range(1, size):
        inside[np.maximum(rows - k, 0)[rows >= k]] = False
    place = np.flatnonzero(inside[:n])
    return found[place], place


def windows_of(width: int):
    """Arrow function: the windows of each item as (item_id, n, words, plain, tokens): word hashes, the words, and shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.utf8(batch.column(1))
            for i, j, hashes, start, end, rows in hashed_words(batch.column(1)):
                for row in range(i, j):
                    own = hashes[rows[row - i] : rows[row - i + 1]]
                    first, last = start[rows[row - i] :], end[rows[row - i] :]
                    text = data[offsets[row] : offsets[row + 1]].tobytes()
                    n = min(width, len(own))
                    for a in range(0, len(own) - n + 1 if n else 0, 4096):
                        b = min(a + 4096, len(own) - n + 1)
                        words = np.lib.stride_tricks.sliding_window_view(own, n)[a:b]
                        size = min(n, SHINGLE)
                        tokens, _ = shingles(own[a : b + n - 1], np.array([0, b - a + n - 1]), size)
                        each = np.lib.stride_tricks.sliding_window_view(tokens, n - size + 1)
                        count = pa.array(np.arange(len(words) + 1, dtype=np.int32) * (n - size + 1))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([batch.column(0)[row]] * len(words), batch.column(0).type), pa.array(np.full(len(words), n), pa.int64()), pa.array([w.tobytes() for w in words], pa.binary()), pa.array([plain(text[first[k] : last[k + n - 1]]) for k in range(a, b)], pa.binary()), pa.ListArray.from_arrays(count, pa.array(each.ravel().view(np.int64)))],
                            names=["item_id", "n", "words", "plain", "tokens"],
                        )

    return run


def bitmap(tokens: DataFrame, bits: int) -> np.ndarray:
    """Bits of the tokens, packed; gathered in rows of CHUNK bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for low in batch.column(1):
                flags = np.zeros(min(bits, CHUNK), bool)
                flags[np.asarray(low.values)] = True
                rows.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["chunk", "bits"])

    bit = F.pmod("token", F.lit(bits))
    chunks = tokens.select(F.floor(bit / CHUNK).cast("bigint").alias("chunk"), F.pmod(bit, F.lit(CHUNK)).cast("int").alias("low")).distinct().groupBy("chunk").agg(F.collect_list("low").alias("low"))
    found = np.zeros(max(1, bits // 8), np.uint8)
    for r in chunks.mapInArrow(run, "chunk bigint, bits binary").collect():  # bits / 8 bytes
        at = r["chunk"] * CHUNK // 8
        found[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return found


def counted(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """(token, n): shingles of documents whose bit is set, and how often they occur."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, mask = shared.value, np.uint64(8 * len(shared.value) - 1)
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], names=["token", "n"])

        for batch in batches:
            for _, _, hashes, _, _, rows in hashed_words(batch.column(0)):
                for size in sizes:
                    tokens, _ = shingles(hashes, rows, size)
                    bit = tokens & mask
                    held.append(tokens[(flags[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1])
                if sum(map(len, held)) > COUNTED:
                    yield out()
        if held:
            yield out()

    found = docs.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    found = common.written(found, docs.sparkSession, "shingle-counts")
    shared.destroy()
    return found


def filed(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(words, plain, n, token, place): windows that may occur, their rarest shingle and its place; and (plain, item_id): the items that have a window."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").mapInArrow(windows_of(width), T.StructType([benchmark.schema["item_id"], *T._parse_datatype_string("n bigint, words binary, plain binary, tokens array<bigint>").fields]))
    items = common.written(items, spark, "item-windows")
    members = common.written(items.select("plain", "item_id").distinct(), spark, "window-items")
    windows = items.groupBy("words", "plain").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    windows = common.written(windows, spark, "windows")
    tokens = windows.select("words", "plain", F.posexplode("tokens").alias("place", "token"))
    about = tokens.agg(F.approx_count_distinct("token").alias("n")).first()["n"]
    bits = min(BITMAP, 1 << (256 * max(about, 64)).bit_length())  # so that few other shingles are counted
    sizes = sorted(r["n"] for r in windows.select(F.least("n", F.lit(SHINGLE)).alias("n")).distinct().collect())  # SHINGLE sizes at most
    counts = counted(docs, bitmap(tokens.select("token"), bits), sizes)
    rare = tokens.join(counts.withColumnRenamed("n", "often"), "token").groupBy("words", "plain").agg(F.min(F.struct("often", "place", "token")).alias("rare"), F.count(F.lit(1)).alias("known"))
    rare = windows.join(rare, ["words", "plain"]).filter(F.col("known") == F.size("tokens"))
    rare = common.written(rare.select("words", "plain", "n", "rare.token", "rare.place"), spark, "filed")
    common.removed(items, windows, counts)
    return rare, members


class Windows:
    """A block of filed windows, sorted by their prefixes."""

    def __init__(self, rows: pa.Table, width: int = WIDTH):
        self.width, n = width, rows.num_rows
        self.length = np.asarray(rows.column("n"), np.int64)
        self.table = np.zeros((n, width), np.uint64)
        words = np.frombuffer(b"".join(rows.column("words").to_pylist()), np.uint64)
        self.table[np.arange(width) < self.length[:, None]] = words
        self.offset = np.asarray(rows.column("place"), np.int64)
        key = np.asarray(rows.column("token"), np.int64).view(np.uint64)
        self.order = np.argsort(key, kind="stable")
        self.keys, begin = np.unique(key[self.order], return_index=True)
        self.begin = np.append(begin, n)
        self.sizes = sorted(set(np.minimum(self.length, SHINGLE).tolist()))
        self.plain = rows.column("plain").to_pylist()

    def find(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence; rows: words before each row."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for size in self.sizes:
            tokens, place = shingles(hashes, rows, size)
            at = np.minimum(np.searchsorted(self.keys, tokens), len(self.keys) - 1)
            has = np.flatnonzero(self.keys[at] == tokens)
            at, place = at[has], place[has]
            each = self.begin[at + 1] - self.begin[at]
            ends = np.cumsum(each)
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
                found.append(self.compare(hashes, rows, place[a:b], at[a:b], each[a:b]))
                a = b
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def confirmed(self, text: Callable[[int, int], bytes], where: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The occurrences whose words are those of the window. text: bytes from one word of the rows to another."""
        same = np.array([plain(text(a, a + n - 1)) == self.plain[w] for a, n, w in zip(where.tolist(), self.length[which].tolist(), which.tolist())], bool)
        return where[same], which[same]

    def compare(self, hashes, rows, place, at, each) -> tuple[np.ndarray, np.ndarray]:
        entry = np.repeat(self.begin[at] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        window = self.order[entry]
        start = np.repeat(place, each) - self.offset[window]
        row = np.searchsorted(rows, np.repeat(place, each), "right") - 1
        ok = (start >= rows[row]) & (start + self.length[window] <= rows[row + 1])
        start, window = start[ok], window[ok]
        for k in range(self.width):
            if not len(start):
                break
            more = k < self.length[window]
            same = ~more
            same[more] = hashes[start[more] + k] == self.table[window[more], k]
            start, window = start[same], window[same]
        return start, window


def runs(flags: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [first, end) of set flags; no run crosses a row's start."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[rows] = True
    before = np.concatenate([[False], flags[:-1]]) if len(flags) else flags
    after = np.concatenate([flags[1:], [False]]) if len(flags) else flags
    return np.flatnonzero(flags & (~before | edge[:-1])), np.flatnonzero(flags & (~after | edge[1:])) + 1


SPANS = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("start_byte", T.LongType()), T.StructField("end_byte", T.LongType())]))
SPAN_ARROW = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64())])


def hits(spark: SparkSession, docs: DataFrame, windows: DataFrame, keep: list[str], width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The columns `keep` of each document with n_words, n_hit, spans of hit words and `windows`, the words of those that were found."""
    columns = list(dict.fromkeys([*keep, "text"]))
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", SPANS), T.StructField("windows", T.ArrayType(T.BinaryType()))]
    rows = docs.select(*columns).withColumns({"n_words": F.lit(0).cast("bigint"), "n_hit": F.lit(0).cast("bigint"), "spans": F.array().cast(SPANS), "windows": F.array().cast(T.ArrayType(T.BinaryType()))})
    schema = T.StructType([*[docs.schema[c] for c in columns], *added])
    blocks = max(1, -(-windows.count() // block_windows))
    last: list[DataFrame] = []
    for k in range(blocks):
        own = windows if blocks == 1 else windows.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(Windows(own.toArrow(), width))  # about block_windows rows
        rows = rows.mapInArrow(marker(shared, columns), schema)
        if k < blocks - 1:
            rows = common.written(rows, spark, "decontamination")
            shared.destroy()
            common.removed(*last)
            last = [rows]
        del shared
    return rows.select(*keep, *[f.name for f in added])


def mark(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The columns `keep` (all) of each document with n_words, n_hit, spans of hit words and ids of found items, null last.

    `spans` are the maximal runs of hit words, as word numbers and byte ranges of the text.
    """
    common.sent_to_workers(spark)
    keep = [c for c in (keep or docs.columns) if c not in ("n_words", "n_hit", "spans", "items")]
    windows, members = filed(docs, benchmark, width)
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], "text")
    rows = hits(spark, named, windows, [f"c{k}" for k in range(len(keep))], width, block_windows)
    rows = common.written(rows.withColumn("row__", F.monotonically_increasing_id()), spark, "marked")
    found = rows.select("row__", F.explode("windows").alias("plain")).join(members, "plain")
    items = found.groupBy("row__").agg(F.collect_set(F.struct("item_id")).alias("found__"))
    ids = F.array_sort(F.transform(F.coalesce("found__", F.array().cast(T.ArrayType(T.StructType([benchmark.schema["item_id"]])))), lambda x: x["item_id"]))
    return rows.join(items, "row__", "left").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], "n_words", "n_hit", "spans", ids.alias("items"))


def marker(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            data, offsets = common.utf8(batch.column(columns.index("text")))
            for i, j, hashes, start, end, rows in hashed_words(batch.column(columns.index("text"))):
                part = batch.slice(i, j - i)
                base = np.repeat(offsets[i:j], np.diff(rows))
                where, which = windows.confirmed(lambda a, b: data[base[a] + start[a] : base[b] + end[b]].tobytes(), *windows.find(hashes, rows))  # noqa: B023
                delta = np.zeros(len(hashes) + 1, np.int32)
                np.add.at(delta, where, 1)
                np.add.at(delta, where + windows.length[which], -1)
                hit = np.cumsum(delta[:-1]) > 0
                found: list = [[] for _ in range(j - i)]
                pairs = np.unique(np.stack([np.searchsorted(rows, where, "right") - 1, which]), axis=1)
                for row, window in pairs.T.tolist():
                    found[row].append(windows.plain[window])
                # what earlier blocks found
                for row, (old_spans, old) in enumerate(zip(part.column(len(columns) + 2).to_pylist(), part.column(len(columns) + 3).to_pylist())):
                    for s in old_spans:
                        hit[rows[row] + s["first_word"] : rows[row] + s["end_word"]] = True
                    found[row] += old
                first, last = runs(hit, rows)
                own = np.searchsorted(rows, first, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array(first - rows[own]), pa.array(last - rows[own]), pa.array(start[first]), pa.array(end[last - 1])], fields=list(SPAN_ARROW))
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(j - i + 1)), pa.int32()), spans)
                total_hit = np.concatenate([[0], np.cumsum(hit)])
                out = [part.column(k) for k in range(len(columns))]
                out += [pa.array(np.diff(rows)), pa.array(np.diff(total_hit[rows])), spans, pa.array(found, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(out, names=[*columns, "n_words", "n_hit", "spans", "windows"])

    return run


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents in which no window occurs, whole and with their own columns."""
    common.sent_to_workers(spark)
    windows, _ = filed(docs, benchmark, width)
    marked = hits(spark, docs.select(F.struct(*docs.columns).alias("whole__"), "text"), windows, ["whole__"], width)
    return marked.filter(F.col("n_hit") == 0).select("whole__.*")


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the comma-joined sorted ids) and contaminated."""
    marked = mark(spark, docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), benchmark, ["doc_id"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS w
  FROM iw, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(i) WHERE len(ws) > 0
), place AS (
  SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w
  FROM dw, (SELECT DISTINCT n FROM win), unnest(range(1, len(ws) - n + 2)) AS t(i)
), occ AS (
  SELECT doc_id, item_id, i, n FROM place JOIN win USING (n, w)
), hits AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM occ) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM occ) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""
