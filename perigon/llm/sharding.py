"""Sharding by histogram sort: exact splitters from counted bytes, then one exchange.

Rows are ordered by (key, tie, also). Boundaries between shards are found without sorting anything:
each round counts, over all partitions, the exact bytes in the cells between evenly spaced probes
inside every boundary's open range, and keeps the one cell in which the wanted share of bytes is
passed. A round divides the range by 4,096; it ends when the cell holds few rows (these are looked at
one by one) or a single value. A single key with many rows is divided further by the tie, and a
single tie by `also`. Then each row's shard is known from the splitters alone, and one exchange, by
(shard, cell), numbers the rows: a cell's first slot is the number of rows in the cells before it, so
that no task ever holds a shard. Keys, and pairs of key and tie, with many rows have cells of their own.

Only DataFrame functions are used. Cells, splitters and looked-at rows have fixed bounds.

Law `bytes`: a unit (a row, or all rows of a key that together have at most `tolerance` of a shard's
share) lies in shard floor(shards * middle / total), middle being the bytes before it plus half its
own. So copies stay together where that costs little, and sizes differ by about one unit at most:
groups of equal texts beyond `tolerance` of a share are cut where the boundary falls.

Edge cases: a null text has no bytes (size 1, as the empty text); rows without a doc_id come before
all others of their key; repeated rows are rows like any other, told apart by a row number; an empty
table gives no rows. Columns of the result replace columns of the same name; names that end in two
underscores are used inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perigon.llm import common

SHARDS = 16
TOLERANCE = 0.01
BITS = 12
FEW = 4096
#: A key with at least this share of the rows, and HEAVY_ROWS of them, gets cells of its own, by tie.
HEAVY = 0.002
HEAVY_ROWS = 256
LEVELS = ("key__", "tie__", "also__")


def text_key(text: Column) -> Column:
    """60 bits of the text's MD5: equal texts have equal keys, and keys are spread evenly."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def _cell(column: Column, shift: int) -> Column:
    return F.shiftright(column, shift)


def _open_cells(rows: DataFrame, column: str, bits: int, wanted: dict[int, int], before: int) -> dict[int, tuple[int, int, int, int, int]]:
    """For each boundary the cell in which its target lies: (low, high, bytes before, bytes, rows).

    rows: with `column` in [0, 2^bits) and `size`; wanted: boundary -> target in bytes; before: bytes
    before all of these rows.
    """
    shift = max(0, bits - BITS)
    cells = {i: (0, 1 << bits, before, None, None) for i in wanted}
    while True:
        todo = {i for i, c in cells.items() if c[4] is None or (c[4] > FEW and c[1] - c[0] > 1)}
        if not todo:
            return cells
        last = {(cells[i][0], cells[i][1]) for i in todo}
        inside = None
        for low, high in sorted(last):
            one = (F.col(column) >= low) & (F.col(column) < high)
            inside = one if inside is None else inside | one
        counted = rows.filter(inside).groupBy(_cell(F.col(column), shift).alias("cell")).agg(F.sum("size__").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        found = sorted((r["cell"], r["bytes"], r["rows"]) for r in counted.collect())  # at most 2^BITS cells for each boundary
        for i in todo:
            low, high, at, _, _ = cells[i]
            for cell, size, n in found:
                if low <= cell << shift < high:
                    got = (cell << shift, (cell + 1) << shift, at, size, n)
                    at += size
                    if at >= wanted[i]:
                        break
            cells[i] = got
        if shift == 0:
            return cells
        shift = max(0, shift - BITS)


def splitters(rows: DataFrame, bits: list[int], shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """First (key, tie, also) of the shards 1 and up. rows: LEVELS, not negative and below 2^bits, and size__."""
    total = rows.agg(F.sum("size__").alias("n")).first()["n"] or 0
    if not total or shards < 2:
        return []
    light = int(tolerance * total / shards)

    def shard(before: int, size: int) -> int:
        return shards * (2 * before + size) // (2 * total)

    def filled(*first: int) -> tuple[int, ...]:
        return (*first, *[0] * (len(LEVELS) - len(first)))

    goal = {i: -(-i * total // shards) for i in range(1, shards)}
    firsts: dict[int, tuple[int, ...]] = {}
    few: dict[tuple, list[int]] = {}
    # values of the levels before, bytes before them, and the boundaries inside
    todo: list[tuple[tuple[int, ...], int, list[int]]] = [((), 0, list(goal))]
    while todo:
        fixed, at, own = todo.pop()
        part = rows
        for column, value in zip(LEVELS, fixed):
            part = part.filter(F.col(column) == value)
        deeper: dict[tuple, list[int]] = {}
        for i, (low, high, before, size, n) in _open_cells(part, LEVELS[len(fixed)], bits[len(fixed)], {i: goal[i] for i in own}, at).items():
            if n <= FEW:
                few.setdefault((fixed, low, high, before), []).append(i)
            elif not fixed and size <= light or len(fixed) == len(LEVELS) - 1:
                firsts[i] = filled(*fixed, low) if shard(before, size) >= i else filled(*fixed, high)
            else:
                deeper.setdefault(((*fixed, low), before), []).append(i)
        todo += [(values, before, inside) for (values, before), inside in deeper.items()]
    for (fixed, low, high, before), own in few.items():
        level = len(fixed)
        part = rows.filter((F.col(LEVELS[level]) >= low) & (F.col(LEVELS[level]) < high))
        for column, value in zip(LEVELS, fixed):
            part = part.filter(F.col(column) == value)
        found = sorted((*(r[c] for c in LEVELS), r["size__"]) for r in part.select(*LEVELS, "size__").collect())  # at most FEW rows
        sums: dict[int, int] = {}
        for *values, size in found:
            sums[values[0]] = sums.get(values[0], 0) + size
        units, at, last = [], before, None
        for *values, size in found:
            whole = not fixed and sums[values[0]] <= light
            if whole and values[0] == last:
                continue
            units.append((filled(values[0]) if whole else tuple(values), at, sums[values[0]] if whole else size))
            at += units[-1][2]
            last = values[0]
        for i in own:
            firsts[i] = next((first for first, b, size in units if shard(b, size) >= i), filled(*fixed, high))
    return [firsts[i] for i in sorted(firsts)]


def histogram_sort(rows: DataFrame, key: Column, tie: Column, size: Column, shards: int = SHARDS, tolerance: float = TOLERANCE, also: Column | None = None) -> DataFrame:
    """The rows with `shard` and `slot` (gapless from 0 in each shard, in the order of key, tie and also).

    key, tie and also are bigint; a null counts as the smallest. Rows that agree in all of them lie in
    one shard once they are over FEW.
    """
    keyed = rows.withColumns({"key__": key, "tie__": tie, "also__": F.lit(0).cast("bigint") if also is None else also, "size__": size.cast("bigint")})
    ends = keyed.agg(*[f(c).alias(f"{name}{c}") for c in LEVELS for f, name in ((F.min, "low_"), (F.max, "high_"))], F.count(F.lit(1)).alias("n")).first()
    bits = []
    for column in LEVELS:
        low, high = ends[f"low_{column}"] or 0, ends[f"high_{column}"] or 0
        keyed = keyed.withColumn(column, F.coalesce(F.col(column) - F.lit(low) + 1, F.lit(0)))
        bits.append((high - low + 1).bit_length())
    plain = keyed.select(*LEVELS, "size__")
    shard = F.lit(0)
    for values in splitters(plain, bits, shards, tolerance):
        later, same = F.lit(False), F.lit(True)
        for column, value in zip(LEVELS, values):
            later = later | (same & (F.col(column) > value))
            same = same & (F.col(column) == value)
        shard = shard + F.when(later | same, 1).otherwise(0)
    # heavy keys, and heavy pairs of key and tie: at most 1 / HEAVY of each
    least = max(HEAVY_ROWS, int(HEAVY * ends["n"]))
    turns = []
    for level in (1, 2):
        counts = plain.groupBy(*LEVELS[:level]).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
        turn = F.lit(0)
        for values in sorted(tuple(r) for r in counts.select(*LEVELS[:level]).collect()):
            inside = F.lit(True)
            for column, value in zip(LEVELS[: level - 1], values):
                inside = inside & (F.col(column) == value)
            turn = turn + F.when(inside & (F.col(LEVELS[level - 1]) > values[-1]), 2).when(inside & (F.col(LEVELS[level - 1]) == values[-1]), 1).otherwise(0)
        turns.append(turn)
    placed = keyed.withColumns(
        {
            "shard": shard.cast("int"),
            "bin__": _cell(F.col("key__"), max(0, bits[0] - BITS)),
            "turn__": turns[0],
            "part__": F.when(turns[0] % 2 == 1, _cell(F.col("tie__"), max(0, bits[1] - BITS // 2))).otherwise(F.lit(0)),
            "again__": F.when(turns[0] % 2 == 1, turns[1]).otherwise(F.lit(0)),
            "piece__": F.when((turns[0] % 2 == 1) & (turns[1] % 2 == 1), _cell(F.col("also__"), max(0, bits[2] - BITS // 2))).otherwise(F.lit(0)),
        }
    )
    inner = ["bin__", "turn__", "part__", "again__", "piece__"]
    sums = placed.groupBy("shard", *inner).agg(F.count(F.lit(1)).alias("n__"))
    first = F.sum("n__").over(Window.partitionBy("shard").orderBy(*inner).rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("shard", *inner, F.coalesce(first, F.lit(0)).alias("first__"))  # at most shards + 2^BITS + 2 * 2^(BITS/2) / HEAVY cells
    numbered = placed.withColumn("row__", F.row_number().over(Window.partitionBy("shard", *inner).orderBy(*LEVELS)))
    joined = numbered.join(F.broadcast(starts), ["shard", *inner])
    own = [c for c in rows.columns if c not in ("shard", "slot")]
    return joined.select(*own, "shard", (F.col("first__") + F.col("row__") - 1).cast("bigint").alias("slot"))


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under the law `bytes`).

    Texts are read once; what is counted, refined and exchanged are their keys and sizes. The number
    that tells equal rows apart is written with them, so that it stays what it is.
    """
    text = F.col("text")
    light = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("bigint").alias("text_crc32"),
        text_key(text).alias("text_key"),
        F.monotonically_increasing_id().alias("row"),
    )
    light = common.written(light, spark, "shard-keys")
    placed = histogram_sort(light, F.col("text_key"), F.col("doc_id"), F.col("size"), shards, tolerance, F.col("row"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, tolerance: float = TOLERANCE) -> None:
    """Writes whole documents as one folder per shard, rows in slot order within each file, with `slot`.

    Rows are placed themselves, not looked up by doc_id, so rows without one and repeated ones stay.
    """
    text = F.col("text")
    placed = histogram_sort(docs, text_key(text), F.col("doc_id").cast("bigint"), size_of(text), shards, tolerance)
    placed.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


ORACLE = """
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS crc
), d AS (
  SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents
), k AS (
  SELECT doc_id, (strlen(t) + 1)::BIGINT AS size, ('0x' || substr(md5(t), 1, 15))::BIGINT AS key,
    xor(list_reduce(flatten(list_transform(list_transform(range((length(h) + 511) // 512), lambda k: substr(h, (512 * k + 1)::BIGINT, 512)),
      lambda part: list_transform(range(length(part) // 2), lambda i: ('0x' || substr(part, (2 * i + 1)::BIGINT, 2))::BIGINT))),
      lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
  FROM d, bits
), u AS (
  SELECT *, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY key) AS own,
    sum(size) OVER (ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before,
    sum(size) OVER (ORDER BY key) - sum(size) OVER (PARTITION BY key) AS before_key
  FROM k
), s AS (
  SELECT *, CASE WHEN own <= floor(0.01 * total / 16) THEN 16 * (2 * before_key + own) // (2 * total)
    ELSE 16 * (2 * before + size) // (2 * total) END AS shard
  FROM u
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM s
"""
