"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in an order spread by a hash, are cut into blocks of `block_rows`. With weight w
a source's block i may be placed from slot floor(i / w) on and must be placed before slot
ceil((i + 1) / w); of the blocks that may be placed, the one with the earliest deadline is. Then at
every slot each source is less than one block away from its share.

Weights are exact, so the distance does not grow with the number of slots. A source that runs out
leaves; the others go on, with their weights scaled up. Nothing is dropped or repeated. All sources
are scheduled, however many there are. Stretches of slots are worked out by tasks of their own, which
hold a few numbers for each source; each cell of rows is joined with the slots of its own blocks.

Ranks within a source come from cells of the hash: rows before a cell are counted, and rows are
numbered inside their cell, so that no task holds a source. The number of cells follows from that of
all rows.

Edge cases: null sources are a source; sources without a weight, or with one of zero, come after all
others; repeated rows are rows of their own; rows without doc_id are one cell of their source; an
empty table gives no rows. The columns slot and place replace columns of the same name.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perigon.llm import common

BLOCK_ROWS = 16
#: Rows of a cell, about; a source has 256 cells at least.
CELL_ROWS = 1 << 16
#: Slots that a task works out, about; more where windows are longer.
STRETCH = 1 << 20
#: Slots of the schedule that are sent on at a time.
BATCH = 1 << 16


def tempered(counts: dict) -> dict:
    """Weights by the square root of the sources' sizes."""
    return {s: n**0.5 for s, n in counts.items()}


class Schedule:
    """Slots of the blocks of sources with exact weights, by earliest deadline among released blocks.

    Sources take part until their last block. When every source j has had min(blocks, weight * v)
    blocks, T(v) slots have passed, the sum of these; block i of a source is released at floor(T(i / w)) and due at
    ceil(T((i + 1) / w)). All in whole numbers; what is held is a few numbers for each source.
    """

    def __init__(self, names: list, blocks: list[int], weights: list[Fraction]):
        self.names, self.blocks = names, blocks
        unit = math.lcm(*{w.denominator for w in weights})
        self.weights = [int(w * unit) for w in weights]
        self.order = sorted(range(len(names)), key=lambda k: Fraction(blocks[k], self.weights[k]))
        self.ends = [blocks[k] / self.weights[k] for k in self.order]  # rounded in the order of the exact values
        self.done = [0, *accumulate(blocks[k] for k in self.order)]
        whole = sum(self.weights)
        self.active = [whole, *(whole - x for x in accumulate(self.weights[k] for k in self.order))]
        self.total = self.done[-1]

    def passed(self, i: int, k: int) -> tuple[int, int]:
        """T(i / w[k]), rounded down and up."""
        n, w, order = self.blocks, self.weights, self.order
        j = bisect_left(self.ends, i / w[k])
        while j < len(order) and n[order[j]] * w[k] < i * w[order[j]]:
            j += 1
        down, over = divmod(i * self.active[j], w[k])
        return self.done[j] + down, self.done[j] + down + (over > 0)

    def longest(self) -> int:
        """Slots of the longest window: that of a source's first block, since the sources that take part only get fewer."""
        return max((self.passed(1, k)[1] for k in range(len(self.names))), default=0)

    def released(self, k: int, t: int) -> int:
        """Blocks of a source that are released before slot t."""
        low, high = 0, self.blocks[k]
        while low < high:
            i = (low + high) // 2
            if self.passed(i, k)[0] < t:
                low = i + 1
            else:
                high = i
        return low

    def waiting(self, t: int) -> list[tuple[int, int, int, int]]:
        """(deadline, source, block, release) of the blocks that are released before slot t and due after it, one a source."""
        found = []
        for k in range(len(self.names)):
            i = self.released(k, t) - 1
            if i >= 0 and (due := self.passed(i + 1, k)[1]) > t:
                found.append((due, k, i, self.passed(i, k)[0]))
        return found

    def slots(self, first: int, end: int) -> Iterator[tuple]:
        """(slot, source, block) of the slots from first to end.

        The walk begins where no block that waits there is due after `first`, with those of the latest deadlines
        waiting. Two walks with different blocks waiting differ in pairs of them, and a pair is even once
        the later one is placed, by its deadline; so from `first` on this is the walk from slot 0.
        """
        t = min((release for *_, release in self.waiting(first)), default=first)
        have = [self.released(k, t) for k in range(len(self.names))]
        late = sorted(self.waiting(t), reverse=True)[: sum(have) - t]
        ready = [(due, k, i) for due, k, i, _ in late]
        heapq.heapify(ready)
        coming = [(self.passed(i, k)[0], k, i) for k, i in enumerate(have) if i < self.blocks[k]]
        heapq.heapify(coming)
        for t in range(t, end):
            while coming and coming[0][0] <= t:
                _, k, i = coming[0]
                release, deadline = self.passed(i + 1, k)
                heapq.heappush(ready, (deadline, k, i))
                if i + 1 < self.blocks[k]:
                    heapq.heapreplace(coming, (release, k, i + 1))
                else:
                    heapq.heappop(coming)
            deadline, k, i = heapq.heappop(ready)
            if deadline <= t:
                raise ValueError("weights add up to more than one block a slot")
            if t >= first:
                yield t, self.names[k], i


class Mix:
    """The schedule of the sources with a weight, and after it, evenly, that of those without."""

    def __init__(self, blocks: dict, weights: dict):
        names = [s for s, n in blocks.items() if n > 0]
        exact = {s: Fraction(weights.get(s) or 0) for s in names}
        self.parts = []
        for own, share in (([s for s in names if exact[s] > 0], exact), ([s for s in names if exact[s] <= 0], dict.fromkeys(names, Fraction(1)))):
            if own:
                self.parts.append(Schedule(own, [blocks[s] for s in own], [share[s] for s in own]))
        self.total = sum(p.total for p in self.parts)

    def stretch(self) -> int:
        """Slots of a stretch that a task works out: no window is longer, so walks begin at most one stretch earlier."""
        return max(STRETCH, *(p.longest() for p in self.parts), 1)

    def slots(self, first: int, end: int) -> Iterator[tuple]:
        before = 0
        for p in self.parts:
            a, b = max(first - before, 0), min(end - before, p.total)
            if a < b:
                for t, s, i in p.slots(a, b):
                    yield t + before, s, i
            before += p.total


def turns(blocks: dict, weights: dict) -> Iterator[tuple]:
    """(source, block) of slot 0, 1, 2 and so on."""
    mix = Mix(blocks, weights)
    return ((s, i) for _, s, i in mix.slots(0, mix.total))


def mix_of(rows: list[tuple], weights: dict | Callable, block_rows: int) -> Mix:
    """The mix of sources (missing, name, rows)."""
    sizes = {None if missing else name: n for missing, name, n in sorted(rows)}
    wanted = weights(sizes) if callable(weights) else {s if s is None else str(s): w for s, w in weights.items()}
    return Mix({s: -(-n // block_rows) for s, n in sizes.items()}, wanted)


def measure(weights: dict | Callable, block_rows: int) -> Callable:
    """Maps all sources and their sizes to the number of slots and of those in a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = mix_of([(r["missing__"], r["name__"], r["n__"]) for batch in batches for r in batch.to_pylist()], weights, block_rows)
        yield pa.RecordBatch.from_arrays([pa.array([mix.total], pa.int64()), pa.array([mix.stretch()], pa.int64())], names=["total", "stretch"])

    return run


def scheduler(weights: dict | Callable, block_rows: int, stretch: int, total: int) -> Callable:
    """Maps all sources and their sizes, once for each stretch and sorted by it, to the slots of the stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []

        def out() -> Iterator[pa.RecordBatch]:
            slots = mix_of(rows, weights, block_rows).slots(held * stretch, min(total, (held + 1) * stretch))
            while part := list(islice(slots, BATCH)):
                names, blocks = [s for _, s, _ in part], [i for _, _, i in part]
                yield pa.RecordBatch.from_arrays([pa.array([s is None for s in names]), pa.array([s or "" for s in names], pa.string()), pa.array(blocks, pa.int64()), pa.array([t for t, _, _ in part], pa.int64())], names=["missing__", "name__", "block__", "slot__"])

        for batch in batches:
            for r in batch.to_pylist():
                if rows and r["stretch__"] != held:
                    yield from out()
                    rows = []
                held = r["stretch__"]
                rows.append((r["missing__"], r["name__"], r["n__"]))
        if rows:
            yield from out()

    return run


def with_places(docs: DataFrame, weights: dict | Callable = tempered, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows with `slot` (of their block) and `place` (slot * block_rows + place in the block), which orders the mix.

    weights: target weight by source, or a function from the sources' sizes to such weights.
    """
    common.sent_to_workers(docs.sparkSession)
    source = ["missing__", "name__"]
    cell = [*source, "cell__"]
    spread = F.xxhash64("doc_id")
    bits = min(24, max(8, (docs.count() // CELL_ROWS).bit_length()))
    rows = docs.withColumns({"missing__": F.col("source").isNull(), "name__": F.coalesce(F.col("source").cast("string"), F.lit("")), "spread__": spread, "cell__": F.shiftrightunsigned(spread, 64 - bits)})
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n__"))
    sizes = cells.groupBy(*source).agg(F.sum("n__").alias("n__"))
    found = sizes.repartition(1).mapInArrow(measure(weights, block_rows), "total bigint, stretch bigint").first() or {"total": 0, "stretch": 1}  # a row for each source, two numbers back
    stretches = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(1, -(-found["total"] // found["stretch"])) - 1).cast("bigint")))
    each = sizes.withColumn("stretch__", stretches).repartition("stretch__").sortWithinPartitions("stretch__")
    schedule = each.mapInArrow(scheduler(weights, block_rows, found["stretch"], found["total"]), "missing__ boolean, name__ string, block__ bigint, slot__ bigint")
    before = F.sum("n__").over(Window.partitionBy(*source).orderBy("cell__").rowsBetween(Window.unboundedPreceding, -1))
    starts = cells.withColumn("start__", F.coalesce(before, F.lit(0)))
    blocks = F.sequence(F.floor(F.col("start__") / block_rows), F.floor((F.col("start__") + F.col("n__") - 1) / block_rows))
    needed = starts.select(*cell, "start__", F.explode(blocks).alias("block__"))
    turn = needed.join(schedule, [*source, "block__"]).groupBy(*cell, "start__").agg(F.array_sort(F.collect_list("slot__")).alias("slots__"))  # a source's slots rise with its blocks
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy(F.shiftrightunsigned("spread__", 1), "spread__", "doc_id"))
    placed = rows.withColumn("row__", inside).join(turn, cell).withColumn("rank__", F.col("start__") + F.col("row__") - 1)
    local = F.floor(F.col("rank__") / block_rows) - F.floor(F.col("start__") / block_rows)
    slot = F.element_at("slots__", (local + 1).cast("int"))
    own = [c for c in docs.columns if c not in ("slot", "place")]
    return placed.withColumn("slot", slot).select(*own, "slot", (F.col("slot") * block_rows + F.col("rank__") % block_rows).cast("bigint").alias("place"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, source, slot and place of every document."""
    return with_places(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source"))


def mixed(docs: DataFrame, weights: dict | Callable = tempered, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The documents in the order of the mix, with their own columns."""
    whole = docs.select("doc_id", "source", F.struct(*docs.columns).alias("whole__"))
    return with_places(whole, weights, block_rows).orderBy("place", "doc_id").select("whole__.*")
