"""Quality rules: figures of single documents, and lines that too many documents of a host share.

Words are maximal runs of characters that are no ASCII white space. A document fails by itself with fewer
than MIN_WORDS words, or when more than MOST_REPEATED percent of its words stand in windows of WINDOW
words that the document has twice or more.

Across documents, lines are normalised (ASCII letters in lower case, every digit 0, words separated by
one space) and stand for themselves as 128-bit hashes together with their host. The documents of each
(host, line) are counted, a document counts once. A line in more than `most_documents` documents
of its host is removed wherever it stands at that host; a document of which less than `min_left` percent
of the words, or fewer than MIN_WORDS, are left is depleted and goes.

Counts are aggregated before they are exchanged, so a line that very many documents have is a few rows. Lines
over the limit are looked up where the documents' lines are: in a table sent to all tasks while there
are at most FEW of them. Beyond that only the heavy ones are sent: those with a HEAVY-th of
all counted lines or more, of which there can be no more than HEAVY; the lookup of the others is an exchange by
line, where no line has more than that share.

Edge cases: a null text is empty and has no words; rows are documents, also when they repeat a doc_id or a
whole row; a null host is a host of its own; lines without words are not counted and never removed; empty
tables give empty results; columns of the result replace document columns of the same name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perigon.llm import common

MIN_WORDS = 20
WINDOW = 8
MOST_REPEATED = 30
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: Documents of a host that may share a line, and percent of a document's words that must be left.
MOST_DOCUMENTS = 50
MIN_LEFT = 50
#: Lines over the limit that are sent to all tasks; else the lines with this share of all.
FEW = 200_000
HEAVY = 50_000

LINES = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("words", T.IntegerType()), T.StructField("new", T.BooleanType())]))
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
_BLANK = common.byte_class(BLANKS.encode())


def word_numbers(raw: bytes) -> np.ndarray:
    """A number for each word of a text, equal for equal words; long texts are split in parts, so that only distinct words are held."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    found = []
    for a, b in common.parts(np.frombuffer(raw, np.uint8), _BLANK):
        words = raw[a:b].split()
        found.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def _renumbered(pairs: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 0 on, equal for equal pairs, and how many there are."""
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    new = np.append(False, pairs[1:] != pairs[:-1])
    found = np.empty(len(pairs), np.int32)
    found[order] = np.cumsum(new, dtype=np.int32)
    return found, int(new.sum()) + 1


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that occur twice or more. Runs of 2, 4, ... words are numbered from pairs of numbers: equal numbers are equal words.

    window: a power of 2.
    """
    n = len(numbers) - window + 1
    if n < 2:
        return 0
    size = 1
    while size < window:
        if len(numbers) - size < 1:
            return 0
        pairs = numbers[:-size].astype(np.int64)
        pairs *= int(numbers.max()) + 1
        pairs += numbers[size:]
        numbers, distinct = _renumbered(pairs)
        if distinct == len(numbers):
            return 0
        size *= 2
    again = np.bincount(numbers)[numbers] > 1
    edges = np.zeros(len(again) + window, np.int32)
    edges[: len(again)] += again
    edges[window:] -= again
    return int((np.cumsum(edges) > 0).sum())


def line_key(head: bytes, line: bytes) -> tuple[int, int]:
    """Hash of a normalised line after `head`, and its words; long lines are walked in parts."""
    if len(line) <= common.PIECE_BYTES:
        parts = line.split()
        return xxhash.xxh3_128_intdigest(head + b" ".join(parts).translate(_NORMAL)), len(parts)
    hashed, n = xxhash.xxh3_128(head), 0
    for a, b in common.parts(np.frombuffer(line, np.uint8), _BLANK):
        parts = line[a:b].split()
        if parts:
            hashed.update((b" " if n else b"") + b" ".join(parts).translate(_NORMAL))
            n += len(parts)
    return hashed.intdigest(), n


def line_keys(raw: bytes, host: str | None) -> tuple[list[int], list[int], list[int], list[bool], list[int], int]:
    """Keys of the lines with words (two halves), their words, whether the key is new in the text, their line numbers; lines equal to an earlier one.

    The key is a hash of host and normalised line.
    """
    head = b"\0" if host is None else b"\1" + host.encode() + b"\n"
    a, b, words, new, place = [], [], [], [], []
    seen, whole = set(), set()
    again = 0
    for k, line in enumerate(raw.split(b"\n")):
        key, n = line_key(head, line)
        if not n:
            continue
        if line in whole:
            again += 1
        else:
            whole.add(line)
        a.append((key >> 64) - (1 << 63))
        b.append((key & (1 << 64) - 1) - (1 << 63))
        words.append(n)
        new.append(key not in seen)
        seen.add(key)
        place.append(k)
    return a, b, words, new, place, again


def measured(docs: DataFrame, host: str, text: str, carry: list[str], label: str = "quality-lines") -> DataFrame:
    """One row for each document, written once: row number (row__), figures, lines, and the columns to carry as c0, c1, ..."""
    spark = docs.sparkSession
    carried = [T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(carry)]
    schema = T.StructType([T.StructField("row__", T.LongType()), *carried, *[T.StructField(c, T.LongType()) for c in FIGURES], T.StructField("lines", LINES), T.StructField("places", T.ArrayType(T.IntegerType()))])
    line_type = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("words", pa.int32()), ("new", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            figures, starts, lines = [], [0], [[], [], [], [], []]
            for own, value in zip(batch.column(1).to_pylist(), batch.column(2)):
                value = value.as_py() or ""
                raw = value.encode()
                *found, again = line_keys(raw, own)
                for part, more in zip(lines, found):
                    part += more
                starts.append(len(lines[0]))
                numbers = word_numbers(raw)
                chars = len(value) - sum(value.count(c) for c in BLANKS)
                figures.append((len(numbers), chars, sum(value.count(c) for c in SYMBOLS), again, repeated_words(numbers)))
            offsets = pa.array(starts, pa.int32())
            flat = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(lines, line_type)], fields=list(line_type))
            columns = [batch.column(0), *batch.columns[3:], *[pa.array(c, pa.int64()) for c in (zip(*figures) if figures else [[]] * len(FIGURES))]]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, flat), pa.ListArray.from_arrays(offsets, pa.array(lines[4], pa.int32()))], names=schema.names)

    rows = docs.select(F.monotonically_increasing_id().alias("row__"), F.col(f"`{host}`").cast("string").alias("host__"), F.col(f"`{text}`").alias("text__"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)])
    common.sent_to_workers(spark)
    return common.written(rows.mapInArrow(run, schema), spark, label)


def frequent_lines(rows: DataFrame, most_documents: int, label: str = "quality-frequent") -> DataFrame:
    """(a, b, n): keys of the lines that more than `most_documents` documents have, and how many; written."""
    keys = rows.select(F.explode(F.filter("lines", lambda x: x["new"])).alias("l")).select("l.a", "l.b")
    counted = keys.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return common.written(counted.filter(F.col("n") > most_documents), rows.sparkSession, label)


def removed_lines(rows: DataFrame, frequent: DataFrame, few: int = FEW, heavy: int = HEAVY) -> DataFrame:
    """(row__, place, words) of every line of every document whose key is in `frequent`."""
    lines = rows.select("row__", F.explode(F.arrays_zip("lines", "places")).alias("l")).select("row__", F.col("l.lines.a").alias("a"), F.col("l.lines.b").alias("b"), F.col("l.lines.words").alias("words"), F.col("l.places").alias("place"))
    known = frequent.select("a", "b", "n")
    if known.count() <= few:
        found = lines.join(F.broadcast(known), ["a", "b"])
    else:
        total = rows.agg(F.sum(F.size(F.filter("lines", lambda x: x["new"])))).first()[0]
        # counts add up to no more than the total, so at most `heavy` lines have such a share
        share = F.col("n") * heavy >= F.lit(total)
        heavy_keys = F.broadcast(known.filter(share))
        found = lines.join(heavy_keys, ["a", "b"]).unionByName(lines.join(heavy_keys, ["a", "b"], "left_anti").join(known.filter(~share).hint("shuffle_hash"), ["a", "b"]))
    return found.select("row__", "place", "words")


def judged(spark: SparkSession, docs: DataFrame, host: str = "source", text: str = "text", carry: list[str] | None = None, most_documents: int = MOST_DOCUMENTS, min_left: int = MIN_LEFT, few: int = FEW, heavy: int = HEAVY, places: bool = False) -> DataFrame:
    """Every document with its figures, base_failed, n_removed_lines, n_words_left and kept, beside the columns to carry.

    places: also the numbers (from 0) of the removed lines, as an array that no document's own lines exceed.
    """
    carry = docs.columns if carry is None else carry
    rows = measured(docs, host, text, carry)
    frequent = frequent_lines(rows, most_documents)
    gone = removed_lines(rows, frequent, few, heavy).groupBy("row__").agg(F.count(F.lit(1)).alias("n__"), F.sum("words").alias("w__"), *([F.collect_list("place").alias("p__")] if places else []))
    joined = rows.drop("lines", "places").join(gone, "row__", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("w__", F.lit(0))
    own = [*FIGURES, "base_failed", "n_removed_lines", "n_words_left", "kept", *(["removed_places"] if places else [])]
    return joined.select(
        *[F.col(f"c{k}").alias(c) for k, c in enumerate(carry) if c not in own], *FIGURES, failed.alias("base_failed"),
        F.coalesce("n__", F.lit(0)).cast("bigint").alias("n_removed_lines"), left.cast("bigint").alias("n_words_left"),
        (~failed & (left >= MIN_WORDS) & (100 * left >= min_left * F.col("n_words"))).alias("kept"),
        *([F.coalesce("p__", F.array().cast("array<int>")).alias("removed_places")] if places else []),
    )


def cleaned(spark: SparkSession, docs: DataFrame, host: str = "source", text: str = "text", most_documents: int = MOST_DOCUMENTS, min_left: int = MIN_LEFT) -> DataFrame:
    """The documents that are kept, in their own columns, without the lines that were removed."""
    rows = judged(spark, docs.select(*[F.col(f"`{c}`").alias(f"d{k}") for k, c in enumerate(docs.columns)]), f"d{docs.columns.index(host)}", f"d{docs.columns.index(text)}", None, most_documents, min_left, places=True)
    own = F.col(f"d{docs.columns.index(text)}")
    lines = F.split(own, "\n", -1)
    less = F.array_join(F.filter(lines, lambda line, k: ~F.array_contains("removed_places", k)), "\n")
    shorter = F.when(F.size("removed_places") > 0, less).otherwise(own)
    return rows.filter("kept").select(*[(shorter if c == text else F.col(f"d{k}")).alias(c) for k, c in enumerate(docs.columns)])


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return judged(spark, docs, carry=["doc_id"]).select("doc_id", *FIGURES, "base_failed", "kept", "n_removed_lines", "n_words_left")


_WORDS = r"regexp_extract_all({}, '[^ \t\n\x0b\f\r]+')"
_COUNT = "(length({0}) - length(translate({0}, '{1}', '')))"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS.format("t")} AS words FROM d),
line AS (SELECT r, source, line, place, {_WORDS.format("line")} AS words FROM (SELECT r, source, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS place FROM d)),
good AS (SELECT r, source, line, place, len(words) AS n, regexp_replace(translate(array_to_string(words, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS plain FROM line WHERE len(words) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup FROM good GROUP BY r),
often AS (SELECT source, plain FROM good GROUP BY source, plain HAVING count(DISTINCT r) > {MOST_DOCUMENTS}),
gone AS (SELECT g.r, count(*) AS lines, sum(n)::BIGINT AS n FROM good g JOIN often o ON g.plain = o.plain AND g.source IS NOT DISTINCT FROM o.source GROUP BY g.r),
win AS (SELECT r, p, array_to_string(words[p:p + {WINDOW - 1}], ' ') AS k FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS p FROM w WHERE len(words) >= {WINDOW})),
twice AS (SELECT r, p FROM win QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
cover AS (SELECT r, count(DISTINCT p + o) AS n FROM twice, range({WINDOW}) AS t(o) GROUP BY r),
base AS (SELECT w.r, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  {_COUNT.format("t", SYMBOLS)}::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
  coalesce(lines, 0)::BIGINT AS n_removed_lines, (len(words) - coalesce(gone.n, 0))::BIGINT AS n_words_left
  FROM w LEFT JOIN dup ON dup.r = w.r LEFT JOIN cover ON cover.r = w.r LEFT JOIN gone ON gone.r = w.r),
fail AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words_left >= {MIN_WORDS} AND 100 * n_words_left >= {MIN_LEFT} * n_words AS kept, n_removed_lines, n_words_left FROM fail"""
