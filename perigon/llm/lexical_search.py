"""Ranked lexical search by block-max pruning.

Terms are maximal runs of digits, ASCII letters (folded to lower case) and characters beyond ASCII. The index
has two tables. The forward index is cut into blocks of up to BLOCK_DOCS documents: a block's own
dictionary, and for each document the places in it and how often each occurs. Documents that come
to a task together are laid out by their commonest term and their length before blocks are cut, so that a
block holds documents of a kind and its bounds are close; no document is exchanged. The second table
holds, for each block and each of its terms, the documents that have the term and the largest impact it has in any.

Queries go to the tasks in groups of at most GROUP_TERMS terms (a single larger query is a group of its own):

1.  The terms' document counts, and from them their weights, are summed over the table of maxima.
2.  Each query's bound in a block is the sum of its weighted maxima. The SEEDS blocks with the highest bounds
    are scored; the k-th score found is the query's threshold.
3.  Blocks with a bound of at least the threshold are picked from the table of maxima and scored from the forward
    index, in the order of their bounds, while a task's own k-th score has not passed them. A block below
    the threshold cannot hold a document among the first k, so none is lost.

Scores are whole numbers: the sum over the query's terms, repeats included, of weight x impact, where
impact = (10^9 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L and weight = floor(1000 ln((2 N + 2) / (2 df + 1))).

Edge cases: documents without terms (null, empty) are in no count and never found; queries without terms
give no rows; a repeated item is a query of its own; of equal scores the smaller id comes first, null last; ids are
bigint; no documents or no queries give an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perigon.llm import common

BLOCK_DOCS = 64
BLOCK_BYTES = 1 << 20
TOP = 10
#: Blocks of a query that set its threshold.
SEEDS = 16
#: Terms and bytes of text of a group of queries.
GROUP_TERMS = 100_000
GROUP_BYTES = 8 << 20
#: (block, query) pairs that are sent to all tasks; more are exchanged with the forward index.
FEW = 500_000

_GAP = np.ones(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _GAP[_low:_high] = False
_FOLD = bytes(32 if _GAP[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))

FORWARD = "block bigint, ids array<bigint>, lengths array<bigint>, n_docs bigint, n_terms bigint, terms binary, starts binary, places binary, times binary"
MAXIMA = "block bigint, terms binary, holders binary, top binary"


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists; a long text comes in several."""
    for a, b in common.parts(np.frombuffer(raw, np.uint8), _GAP):
        yield raw[a:b].translate(_FOLD).split()


@dataclass
class Index:
    """Tables of an index, and its counts: documents with terms, and terms with repeats."""

    forward: DataFrame
    maxima: DataFrame
    n_docs: int
    n_terms: int

    def remove(self) -> None:
        common.removed(self.forward, self.maxima)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers of a block in as few bytes each as the largest needs."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}" if n else "u1").astype(np.int64)


def _blocks(block_docs: int, block_bytes: int):
    """Arrow function: documents (id, text) to blocks of the forward index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            known: defaultdict[bytes, int] = defaultdict(count().__next__)
            rows = []
            for k, text in enumerate(batch.column(1)):
                raw = (text.as_py() or "").encode()
                found = [np.fromiter(map(known.__getitem__, part), np.int64, len(part)) for part in terms_of(raw)]
                place, times = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
                rows.append((int(place[times.argmax()]) if len(place) else -1, int(times.sum()), k, place, times, len(raw)))
            names = list(known)
            rows.sort(key=lambda r: r[:3])
            i = 0
            while i < len(rows):
                j, size = i, 0
                while j < len(rows) and j - i < block_docs and (j == i or size + rows[j][5] <= block_bytes):
                    size += rows[j][5]
                    j += 1
                own = rows[i:j]
                used, place = np.unique(np.concatenate([r[3] for r in own]), return_inverse=True)
                starts = np.cumsum([0, *[len(r[3]) for r in own]]).astype(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([number], pa.int64()),
                        "ids": pa.array([batch.column(0).take(pa.array([r[2] for r in own])).to_pylist()], pa.list_(pa.int64())),
                        "lengths": pa.array([[r[1] for r in own]], pa.list_(pa.int64())),
                        "n_docs": pa.array([sum(r[1] > 0 for r in own)], pa.int64()),
                        "n_terms": pa.array([sum(r[1] for r in own)], pa.int64()),
                        "terms": pa.array([b" ".join([names[u] for u in used])], pa.binary()),
                        "starts": pa.array([starts.tobytes()], pa.binary()),
                        "places": pa.array([_packed(place)], pa.binary()),
                        "times": pa.array([_packed(np.concatenate([r[4] for r in own]))], pa.binary()),
                    }
                )
                number += 1
                i = j

    return run


def _impacts(lengths: list[int], starts: bytes, times: bytes, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Impact of each entry of a block, and the document (by its place in the block) that it belongs to."""
    share = np.array([25 + 75 * x * n // total for x in lengths], np.int64)
    doc = np.repeat(np.arange(len(lengths)), np.diff(np.frombuffer(starts, np.int64)))
    tf = _unpacked(times, len(doc))
    return 1_000_000_000 * tf // (1000 * tf + 8 * share[doc]), doc


def build(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> Index:
    """The index of all documents, in the shared folder; its owner removes it."""
    common.sent_to_workers(spark)
    rows = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    forward = common.written(rows.mapInArrow(_blocks(block_docs, block_bytes), FORWARD), spark, "search-forward", common.LARGE_ROWS)
    n, total = forward.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lengths, terms, starts, places, times in zip(*[c.to_pylist() for c in batch.columns]):
                if not terms:
                    continue
                impact, _ = _impacts(lengths, starts, times, n, total)
                place = _unpacked(places, len(impact))
                holders = np.bincount(place)
                top = np.zeros(len(holders), np.int64)
                np.maximum.at(top, place, impact)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([x], pa.binary()) for x in (terms, holders.astype(np.int32).tobytes(), top.astype(np.int32).tobytes())]], names=["block", "terms", "holders", "top"])

    maxima = forward.select("block", "lengths", "terms", "starts", "places", "times").mapInArrow(run, MAXIMA)
    return Index(forward, common.written(maxima, spark, "search-maxima", common.LARGE_ROWS), n, total)


@dataclass
class Group:
    """Queries that go to the tasks together: terms by number, and for each query where its terms are."""

    items: list = field(default_factory=list)
    number: dict[bytes, int] = field(default_factory=dict)
    starts: list[int] = field(default_factory=lambda: [0])
    term: list[int] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    weight: np.ndarray | None = None
    threshold: np.ndarray | None = None

    def add(self, item, terms: dict[bytes, int]) -> None:
        self.items.append(item)
        for t, c in terms.items():
            self.term.append(self.number.setdefault(t, len(self.number)))
            self.times.append(c)
        self.starts.append(len(self.term))

    def numbers(self, terms: bytes) -> np.ndarray:
        """Number of each term of a block, -1 for those that no query has."""
        own = terms.split()
        return np.fromiter((self.number.get(t, -1) for t in own), np.int64, len(own))

    def bounds(self, terms: bytes, top: bytes) -> np.ndarray:
        """Of each query in a block."""
        number = self.numbers(terms)
        asked = number >= 0
        most = np.zeros(len(self.number), np.int64)
        most[number[asked]] = np.frombuffer(top, np.int32)[asked]
        sums = np.concatenate([[0], np.cumsum(self.weight * most[self.term])])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]


def groups(items: DataFrame, id: str, text: str, most_terms: int, most_bytes: int = GROUP_BYTES) -> Iterator[Group]:
    """The queries with terms, in groups; one group is on the driver at a time."""
    group, size = Group(), 0
    for row in items.select(F.col(f"`{id}`").alias("item"), F.col(f"`{text}`").cast("string").alias("text")).toLocalIterator():
        raw = (row["text"] or "").encode()
        terms: defaultdict[bytes, int] = defaultdict(int)
        for part in terms_of(raw):
            for t in part:
                terms[t] += 1
        if not terms:
            continue
        if group.items and (len(group.term) + len(terms) > most_terms or size + len(raw) > most_bytes):
            yield group
            group, size = Group(), 0
        group.add(row["item"], terms)
        size += len(raw)
    if group.items:
        yield group


def _weighed(spark: SparkSession, index: Index, group: Group) -> None:
    """Sets the weight of each of the group's entries from the documents that hold its term."""
    shared = spark.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        held = np.zeros(len(own.number), np.int64)
        for batch in batches:
            for terms, holders in zip(*[c.to_pylist() for c in batch.columns]):
                number = own.numbers(terms)
                asked = number >= 0
                held[number[asked]] += np.frombuffer(holders, np.int32)[asked]
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["term", "n"])

    found = index.maxima.select("terms", "holders").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # terms of a group
    shared.destroy()
    weight = np.zeros(len(group.number), np.int64)
    for term, df in found:
        weight[term] = math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df + 1)))
    group.term, group.starts = np.array(group.term, np.int64), np.array(group.starts, np.int64)
    group.weight = weight[group.term] * np.array(group.times, np.int64)


def _best_blocks(spark: SparkSession, index: Index, group: Group, seeds: int) -> DataFrame:
    """(query, block, bound): the blocks with the highest bounds of each query; a task keeps no more than `seeds` for each."""
    shared = spark.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        bounds, blocks = np.zeros((len(own.items), 0), np.int64), np.zeros(0, np.int64)
        best = np.zeros((len(own.items), 0), np.int64)

        def cut() -> tuple[np.ndarray, np.ndarray]:
            most = min(seeds, bounds.shape[1])
            at = np.argpartition(-bounds, most - 1, axis=1)[:, :most] if most < bounds.shape[1] else np.tile(np.arange(bounds.shape[1]), (len(own.items), 1))
            return np.take_along_axis(bounds, at, 1), np.take_along_axis(best, at, 1)

        for batch in batches:
            block, terms, top = [c.to_pylist() for c in batch.columns]
            for i in range(0, len(block), 256):
                new = np.stack([own.bounds(t, m) for t, m in zip(terms[i : i + 256], top[i : i + 256])], axis=1)
                bounds = np.concatenate([bounds, new], axis=1)
                best = np.concatenate([best, np.tile(np.array(block[i : i + 256], np.int64), (len(own.items), 1))], axis=1)
                bounds, best = cut()
        query, at = np.nonzero(bounds)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(best[query, at]), pa.array(bounds[query, at])], names=["query", "block", "bound"])

    rows = index.maxima.select("block", "terms", "top").mapInArrow(run, "query bigint, block bigint, bound bigint")
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))
    return rows.withColumn("place", order).filter(F.col("place") <= seeds).drop("place")


def _blocks_above(spark: SparkSession, index: Index, group: Group) -> DataFrame:
    """(query, block, bound) where a bound reaches the query's threshold."""
    shared = spark.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for block, terms, top in zip(*[c.to_pylist() for c in batch.columns]):
                bounds = own.bounds(terms, top)
                query = np.flatnonzero(bounds >= own.threshold)
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.full(len(query), block)), pa.array(bounds[query])], names=["query", "block", "bound"])

    return index.maxima.select("block", "terms", "top").mapInArrow(run, "query bigint, block bigint, bound bigint")


class Best:
    """The first k documents of each query so far: highest score first, of equal scores the smaller id, null last."""

    def __init__(self, threshold: np.ndarray, k: int):
        self.threshold = threshold.copy()
        self.k = k
        self.held: dict[int, list[tuple[int, bool, int]]] = defaultdict(list)

    def add(self, query: int, scores: np.ndarray, ids: list) -> None:
        some = np.flatnonzero(scores >= self.threshold[query])
        if not len(some):
            return
        held = self.held[query]
        held += [(-int(scores[d]), ids[d] is None, ids[d] or 0) for d in some]
        held.sort()
        del held[self.k :]
        if len(held) == self.k:
            self.threshold[query] = max(self.threshold[query], -held[-1][0])

    def rows(self) -> pa.RecordBatch:
        found = [(q, None if null else i, -s) for q, held in self.held.items() for s, null, i in held]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], [], []))], names=["query", "doc_id", "score"])


def _scores(group: Group, number: np.ndarray, place: np.ndarray, impact: np.ndarray, doc: np.ndarray, docs: int, queries: np.ndarray, highest: int) -> np.ndarray:
    """Scores of the block's documents (columns) for the queries (rows)."""
    asked = np.unique(number[number >= 0])
    column = np.full(len(group.number), -1)
    column[asked] = np.arange(len(asked))
    # sums of doubles are exact below 2^53; else whole numbers, which are slower to multiply
    kind = np.float64 if highest < 1 << 53 else np.int64
    at = np.where(number >= 0, column[number], -1)[place]
    some = at >= 0
    have = np.zeros((len(asked), docs), kind)
    have[at[some], doc[some]] = impact[some]
    want = np.zeros((len(queries), len(asked)), kind)
    for i, q in enumerate(queries):
        own = slice(group.starts[q], group.starts[q + 1])
        at = column[group.term[own]]
        want[i, at[at >= 0]] = group.weight[own][at >= 0]
    return (want @ have).astype(np.int64)


def _scored(spark: SparkSession, index: Index, group: Group, wanted: DataFrame, k: int, few: int) -> DataFrame:
    """(query, doc_id, score): the best of each task among the blocks that are wanted, in the order of their bounds."""
    shared = spark.sparkContext.broadcast(group)
    n, total = index.n_docs, index.n_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = Best(own.threshold, k)
        for batch in batches:
            rows = sorted(zip(*[c.to_pylist() for c in batch.columns]), key=lambda r: -max(b for _, b in r[6]))
            for ids, lengths, terms, starts, places, times, pairs in rows:
                queries, bounds = (np.array(x, np.int64) for x in zip(*pairs))
                open_ = bounds >= best.threshold[queries]
                if not open_.any():
                    continue
                queries = queries[open_]
                impact, doc = _impacts(lengths, starts, times, n, total)
                scores = _scores(own, own.numbers(terms), _unpacked(places, len(impact)), impact, doc, len(ids), queries, int(bounds.max()))
                for q, found in zip(queries, scores):
                    best.add(int(q), found, ids)
        yield best.rows()

    blocks = wanted.groupBy("block").agg(F.collect_list(F.array("query", "bound")).alias("pairs"))  # queries of a group at most
    if wanted.count() <= few:
        blocks = F.broadcast(blocks)
    rows = index.forward.join(blocks, "block").select("ids", "lengths", "terms", "starts", "places", "times", "pairs")
    return rows.mapInArrow(run, "query bigint, doc_id bigint, score bigint")


def _first(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(spark: SparkSession, index: Index, items: DataFrame, id: str = "item_id", text: str = "text", k: int = TOP, seeds: int = SEEDS, group_terms: int = GROUP_TERMS, few: int = FEW) -> DataFrame:
    """(id, rank, doc_id, score): the first k documents of each query, written."""
    kind = items.schema[id].dataType.simpleString()
    schema = f"`{id}` {kind}, rank int, doc_id bigint, score bigint"
    parts = []
    for group in groups(items, id, text, group_terms) if index.n_docs else ():
        _weighed(spark, index, group)
        group.threshold = np.ones(len(group.items), np.int64)  # a document that is found has a score above 0
        seed_blocks = common.written(_best_blocks(spark, index, group, seeds), spark, "search-seeds")
        found = defaultdict(list)
        for row in _first(_scored(spark, index, group, seed_blocks, k, few), k).collect():  # queries of a group times k
            found[row["query"]].append(row["score"])
        for q, scores in found.items():
            if len(scores) == k:
                group.threshold[q] = min(scores)
        above = common.written(_blocks_above(spark, index, group), spark, "search-blocks")
        names = spark.createDataFrame(list(enumerate(group.items)), f"query bigint, `{id}` {kind}")
        rows = _first(_scored(spark, index, group, above, k, few), k).join(F.broadcast(names), "query")
        parts.append(common.written(rows.select(id, F.col("rank").cast("int").alias("rank"), "doc_id", "score"), spark, "search-found"))
        common.removed(seed_blocks, above)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def report(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    index = build(spark, docs)
    found = search(spark, index, items)
    index.remove()
    return found


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
total AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
entry AS (SELECT r, doc_id, len(w)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
item AS (SELECT q, item_id, term, count(*)::BIGINT AS c FROM (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * max(total.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM entry, total WHERE term IN (SELECT term FROM item) GROUP BY term),
score AS (SELECT q, item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * entry.n * total.n) // total.l))))::BIGINT AS score
  FROM item JOIN weight USING (term) JOIN entry USING (term), total GROUP BY ALL),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank, doc_id, score FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= {TOP}"""
