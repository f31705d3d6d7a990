"""MinHash near-deduplication with an LSH forest.

A document's set holds the hashes of its distinct runs of `size` words (ASCII case folded, words
between ASCII white space; all words of a shorter text as one run). Its signature is a row of minima,
LEAST for each of `trees` trees. Tree t of the forest is the order of all documents by their signature
read from its own minima on, around to those before. Documents with equal sets are one class.

1.  Each order is sorted by Spark: one range exchange by (tree's first LEAST minima, the minima after
    them) and a sort. Neighbours in an order with a longest common prefix of at least LEAST minima
    are candidates; `trees` follows from the threshold so that a pair at the threshold has no such
    prefix with probability below MISS. A prefix shared by n documents gives n - 1 neighbours, and a
    prefix shared by a third of all is cut by the minima after it, so no task holds it.
2.  Candidates join documents to regions (connected components). In a region documents are compared by
    full sets, the longest common prefixes first, down to the least. Only components are wanted, so
    documents that are together already are not compared again.
3.  Where a region is too large for a task, it is worked on deeper: the branches of common prefixes of
    at least DEEPER minima in it are contracted to their centres, each document is compared with the
    centres of its branch and of its region, and what is linked is one group from then on. What is
    left is dealt into blocks by group, and pairs of blocks are compared, but not blocks of one group.
    No task holds more than two blocks, and nothing is capped.

Inside a task, candidates come from an inverted list of each set's rarest members: sets of n members
that are to share most of them share one of the rarest (100 - percent) % of either, so near misses
are not tried pair by pair.

Edge cases: a text that is null or has no words has an empty set and is linked with nothing, as is a
row without doc_id; rows that share a doc_id are one document with several texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perigon.llm import common, graph

SIZE = 5
#: Minima of a prefix that makes candidates, and of one that makes a branch of a large region.
LEAST = 5
DEEPER = 9
#: Minima after the first LEAST that orders and longest common prefixes look at, 16 bits of each.
BELOW = 4
MISS = 1e-6
#: Members of a block at most, and its documents: BLOCK_DOCS, or a BLOCKS-th of a larger group's, up to MOST_DOCS.
BLOCK_SHINGLES = 2_000_000
BLOCK_DOCS = 128
BLOCKS = 32
MOST_DOCS = 4096
PIVOTS = 8
#: Rows of (id, region, group), 24 bytes each, up to which they are sent to all tasks instead of moving the texts.
BROADCAST_ROWS = 500_000
#: Stands for the groups that share blocks.
SHARED = -(1 << 63)
_ROWS = 1 << 13


def tree_count(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** LEAST)))


class Signer:
    def __init__(self, trees: int, size: int = SIZE):
        self.trees, self.size = trees, size
        seeds = common.mix(np.arange(1, 2 * trees * LEAST + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        self.flip, self.times = seeds[: trees * LEAST], seeds[trees * LEAST :] | np.uint64(1)

    def minima(self, one: np.ndarray) -> np.ndarray:
        least = np.full(self.trees * LEAST, np.iinfo(np.uint64).max)
        for i in range(0, len(one), _ROWS):
            values = one[i : i + _ROWS, None] ^ self.flip
            values *= self.times
            np.minimum(least, values.min(axis=0), out=least)
        return least

    def prefixes(self, least: np.ndarray) -> np.ndarray:
        """One number for the first LEAST minima of each tree."""
        label = np.arange(1, self.trees + 1, dtype=np.uint64)
        for k in range(LEAST):
            label = common.mix(label * np.uint64(0x9E3779B97F4A7C15) + least.reshape(self.trees, LEAST)[:, k])
        return label

    def below(self, least: np.ndarray) -> np.ndarray:
        """The BELOW minima after the first LEAST of each tree, as one number that sorts like them."""
        short = common.mix(least) >> np.uint64(48)
        at = (np.arange(self.trees)[:, None] + 1) * LEAST + np.arange(BELOW)
        return (short[at % len(short)] << np.arange(48, -1, -16, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def rows(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The set (sorted) and minima of each text."""
        data, offsets = common.utf8(texts)
        for i, j in common.pieces(offsets):
            found, at = common.shingle_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], self.size)
            for a, b in zip(at[:-1], at[1:]):
                one = np.unique(found[a:b])
                yield one, self.minima(one) if len(one) else one


SIGNED = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, prefixes array<bigint>, below array<bigint>"


def signatures(docs: DataFrame, trees: int, size: int = SIZE) -> DataFrame:
    """For each document the size and two hashes of its set, its trees' prefixes and what follows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(trees, size)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                n, a, b, labels, below, at = [], [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [0]
                for one, least in signer.rows(part.column(1)):
                    n.append(len(one))
                    a.append(int(common.mix(one).sum(dtype=np.uint64).view(np.int64)))
                    b.append(int(common.mix(one ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
                    if len(one):
                        labels.append(signer.prefixes(least))
                        below.append(signer.below(least))
                    at.append(at[-1] + (trees if len(one) else 0))
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(x).view(np.int64))) for x in (labels, below)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *lists], names=["doc_id", "n_shingles", "set_a", "set_b", "prefixes", "below"])

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours (id, root, depth) with a common prefix, from rows (prefix, below, id) in order, and the task's first and last row."""
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        prefix, ids = np.asarray(batch.column(0)), np.asarray(batch.column(2))
        below = np.asarray(batch.column(1)).astype(">i8").view(">u2").reshape(n, BELOW)
        ends = []
        if last is None:
            ends.append(0)
        else:
            prefix, ids, below = np.append(last[0], prefix), np.append(last[1], ids), np.concatenate([last[2], below])
        same = np.flatnonzero(prefix[1:] == prefix[:-1])
        depth = LEAST + np.cumprod(below[same] == below[same + 1], axis=1).sum(axis=1)
        a, b = ids[same], ids[same + 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(depth.astype(np.int32)), pa.nulls(len(a), pa.int64())], names=["id", "root", "depth", "prefix"])
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array(ids[:1]), pa.array(ids[:1]), pa.array([0], pa.int32()), pa.array(prefix[:1])], names=["id", "root", "depth", "prefix"])
        last = prefix[-1:], ids[-1:], below[-1:]
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array(last[1]), pa.array(last[1]), pa.array([0], pa.int32()), pa.array(last[0])], names=["id", "root", "depth", "prefix"])


def candidates(spark: SparkSession, classes: DataFrame, trees: int) -> DataFrame:
    """(id, root, depth): neighbours in the trees' orders and the length of their common prefix, LEAST or more.

    classes: (id, prefixes, below). Where a prefix runs over several tasks, their first and last rows
    with that prefix (two a task at most) are joined by their smallest.
    """
    rows = classes.select("id", F.explode(F.arrays_zip("prefixes", "below")).alias("p")).select(F.col("p.prefixes").alias("prefix"), F.col("p.below").alias("below"), "id")
    ordered = rows.repartitionByRange("prefix", "below").sortWithinPartitions("prefix", "below", "id")
    found = common.written(ordered.mapInArrow(neighbours, "id bigint, root bigint, depth int, prefix bigint"), spark, "neighbours")
    ends = found.filter("depth = 0").groupBy("prefix").agg(F.min("id").alias("root"), F.collect_set("id").alias("ids"))
    across = ends.select(F.explode("ids").alias("id"), "root", F.lit(LEAST).alias("depth")).filter("id <> root")
    return found.filter("depth > 0").select("id", "root", "depth").unionByName(across)


class Region:
    """Documents (ids, sets, prefixes) among which the links at `percent` are wanted."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], prefixes: list[bytes], side: np.ndarray | None, percent: int):
        self.percent, self.side = percent, side
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # members are numbered from rare to common
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        row = np.repeat(np.arange(len(sets)), self.sizes)
        token = rank[token.ravel()]
        self.tokens = token[np.lexsort([token, row])]
        self.n_tokens = len(count)
        self.prefixes = prefixes
        self.of = np.unique(ids, return_inverse=True)[1].ravel()  # rows with one id are together

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs (a, b) are similar enough by their full sets."""

        def flat(rows: np.ndarray) -> np.ndarray:
            n = self.sizes[rows]
            first = np.repeat(self.at[rows] - (np.cumsum(n) - n), n)
            return np.repeat(np.arange(len(rows)), n) * self.n_tokens + self.tokens[first + np.arange(int(n.sum()))]

        x, y = flat(a), flat(b)
        place = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = np.bincount(x[y[place] == x] // self.n_tokens, minlength=len(a))
        return 100 * both >= self.percent * (self.sizes[a] + self.sizes[b] - both)

    def may(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Still apart, of sizes that allow a link, and to be compared here."""
        x, y = self.sizes[a], self.sizes[b]
        ok = (self.of[a] != self.of[b]) & (100 * np.minimum(x, y) >= self.percent * np.maximum(x, y))
        return ok if self.side is None else ok & (self.side[a] != self.side[b])

    def try_pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Compares pairs in their order, a limited number of members at a time, and joins what is linked."""
        while len(a):
            open_ = self.may(a, b)
            a, b = a[open_], b[open_]
            some = max(1, int(np.searchsorted(np.cumsum(self.sizes[a] + self.sizes[b]), 1 << 18)))
            if len(a):
                yes = self.linked(a[:some], b[:some])
                self.join(a[:some][yes], b[:some][yes])
            a, b = a[some:], b[some:]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            old, new = graph.smallest(self.of[a], self.of[b])
            at = np.minimum(np.searchsorted(old, self.of), len(old) - 1)
            self.of = np.where(old[at] == self.of, new[at], self.of)

    def done(self) -> bool:
        return bool((self.of == self.of[0]).all())

    def solve(self) -> np.ndarray:
        """The component of each row."""
        n = len(self.sizes)
        if n <= 8:
            self.try_pairs(*np.triu_indices(n, 1))
            return self.of
        labels = np.stack([np.frombuffer(p, np.uint64) for p in self.prefixes])
        trees = labels.shape[1]
        found = []
        for t in range(trees):
            order = np.lexsort([labels[:, (t + k) % trees] for k in (3, 2, 1, 0)])
            a, b = order[:-1], order[1:]
            depth = np.cumprod([labels[a, (t + k) % trees] == labels[b, (t + k) % trees] for k in range(4)], axis=0).sum(axis=0)
            found.append(np.stack([-depth, np.minimum(a, b), np.maximum(a, b)])[:, depth > 0])
        # the longest common prefixes first
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        self.try_pairs(pairs[1], pairs[2])
        if not self.done():
            self.try_lists()
        return self.of

    def try_lists(self) -> None:
        """Compares what is still apart and shares one of the rarest members of both."""
        head = self.sizes - -(-self.percent * self.sizes // 100) + 1
        first = np.repeat(self.at[:-1] - (np.cumsum(head) - head), head)
        token, row = self.tokens[first + np.arange(int(head.sum()))], np.repeat(np.arange(len(head)), head)
        order = np.argsort(token, kind="stable")
        token, row = token[order], row[order]
        begin, end = np.searchsorted(token, token, "left"), np.searchsorted(token, token, "right")
        for i in np.argsort(-self.sizes, kind="stable"):
            own = self.tokens[self.at[i] : self.at[i] + head[i]]
            place = np.searchsorted(token, own)
            others = np.concatenate([row[begin[p] : end[p]] for p in place])
            others, shared = np.unique(others, return_counts=True)
            open_ = self.may(np.full(len(others), i), others)
            if open_.any():
                others = others[open_][np.argsort(-shared[open_], kind="stable")]
                self.try_pairs(np.full(len(others), i), others)


def linker(percent: int):
    """Arrow function over rows sorted by (region, low, high): links (id, root) inside each group."""

    def solved(rows: list) -> tuple[list[int], list[int]]:
        if len(rows) < 2:
            return [], []
        ids, blocks = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows])
        region = Region(ids, [np.frombuffer(r[2], np.uint64) for r in rows], [r[3] for r in rows], blocks if blocks.min() != blocks.max() else None, percent)
        of = region.solve()
        order = np.argsort(of, kind="stable")
        first = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1]))
        roots = np.empty(len(ids), np.int64)
        roots[order] = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.append(first, len(ids))))
        away = roots != ids
        return ids[away].tolist(), roots[away].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, ids, roots = None, [], [], []
        for batch in batches:
            for region, low, high, *row in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if (region, low, high) != key:
                    a, b = solved(rows)
                    ids += a
                    roots += b
                    key, rows = (region, low, high), []
                    if len(ids) > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], names=["id", "root"])
                        ids, roots = [], []
                rows.append(row)
        a, b = solved(rows)
        yield pa.RecordBatch.from_arrays([pa.array(ids + a, pa.int64()), pa.array(roots + b, pa.int64())], names=["id", "root"])

    return run


SETS = "region bigint, group bigint, doc_id bigint, members binary, prefixes binary"


def with_sets(docs: DataFrame, trees: int, size: int) -> DataFrame:
    """(region, group, doc_id, members, prefixes) from (region, group, doc_id, text); members: the set's hashes, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(trees, size)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = [(one.tobytes(), signer.prefixes(least).tobytes() if len(one) else b"") for one, least in signer.rows(part.column(3))]
                got = pa.RecordBatch.from_arrays([*[part.column(c) for c in range(3)], pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["region", "group", "doc_id", "members", "prefixes"])
                yield got.filter(pa.array([len(r[0]) > 0 for r in rows], pa.bool_()))

    return docs.select("region", "group", "doc_id", "text").mapInArrow(run, SETS)


def chosen(docs: DataFrame, regions: DataFrame, n: int) -> DataFrame:
    """Texts of the documents in regions: three numbers each go to all tasks while they are few, else texts are exchanged."""
    return docs.join(F.broadcast(regions) if n <= BROADCAST_ROWS else regions, "doc_id")


def centre_links(spark: SparkSession, docs: DataFrame, large: DataFrame, near: DataFrame, percent: int, trees: int, size: int) -> DataFrame:
    """Links (id, root) between documents of large regions and the centres of their branches and regions.

    large: (doc_id, region), near: candidates. A centre is the document with most neighbours of a hash
    class of a region, PIVOTS a region, or of a branch. Documents meet centres in salted groups of
    about BLOCK_DOCS, so that a region of any size is dealt evenly; centres are copied to each group.
    """
    inside = near.join(large.withColumnRenamed("doc_id", "id"), "id")
    n_near = inside.select("id", "region").unionByName(inside.select(F.col("root").alias("id"), "region")).groupBy("id", "region").agg(F.count(F.lit(1)).alias("n"))
    best = n_near.groupBy("region", F.pmod(F.xxhash64("id"), F.lit(PIVOTS)).alias("p")).agg(F.max_by("id", F.struct("n", "id")).alias("doc_id"))
    branches = graph.components(spark, inside.filter(F.col("depth") >= DEEPER).select("id", "root"), "branches")
    tops = n_near.join(branches, "id").groupBy("root").agg(F.max_by("id", F.struct("n", "id")).alias("doc_id"))
    sets = common.written(with_sets(chosen(docs, large.withColumn("group", F.lit(None).cast("bigint")), large.count()), trees, size).select("region", "doc_id", "members"), spark, "large-regions")
    parts = sets.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).cast("int").alias("parts"))

    def dealt(rows: DataFrame, key: str, kind: int, salt) -> DataFrame:
        return rows.select(F.col(key).alias("key"), salt.alias("salt"), F.lit(kind).alias("kind"), "doc_id", "members")

    spread = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1))
    by_region = dealt(sets.join(parts, "region"), "region", 1, spread).unionByName(dealt(sets.join(best, ["region", "doc_id"]).join(parts, "region"), "region", 0, every))
    member_of = sets.join(branches.select(F.col("id").alias("doc_id"), F.col("root").alias("branch")), "doc_id")
    branch_parts = branches.groupBy(F.col("root").alias("branch")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).cast("int").alias("parts"))
    by_branch = dealt(member_of.join(branch_parts, "branch"), "branch", 1, spread).unionByName(dealt(member_of.join(tops.select("doc_id"), "doc_id").join(branch_parts, "branch"), "branch", 0, every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centres = None, []
        for batch in batches:
            ids, roots = [], []
            for key, salt, kind, doc, own in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if (key, salt) != group:
                    group, centres = (key, salt), []
                own = np.frombuffer(own, np.uint64)
                if kind == 0:
                    centres.append((doc, own))
                    continue
                for centre, other in centres:
                    both = np.count_nonzero(other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own)
                    if centre != doc and 100 * both >= percent * (len(own) + len(other) - both):
                        ids.append(doc)
                        roots.append(centre)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], names=["id", "root"])

    found = []
    for rows in (by_region, by_branch):
        found.append(rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "kind").mapInArrow(run, "id bigint, root bigint"))
    return common.written(found[0].unionByName(found[1]), spark, "centre-links")


def block_count(docs: Column, shingles: Column, block_shingles: int, block_docs: int) -> Column:
    """Blocks of a group: as many as keep the tasks small, not so many that its documents are copied more often than needed."""
    size = F.greatest(F.lit(block_docs), F.least(docs / BLOCKS, F.lit(max(block_docs, MOST_DOCS))))
    return F.greatest(F.lit(1), F.ceil(F.greatest(shingles / block_shingles, docs / size))).cast("bigint")


def paired(members: DataFrame, parts: DataFrame, block_shingles: int, block_docs: int) -> DataFrame:
    """Documents of large regions with their block, once for each pair (low, high) of blocks to compare.

    parts: (region, group, docs, shingles); group is what the documents are known to be linked with,
    null for those apart. A group beyond a block has blocks of its own, which are not paired with each
    other; all others share blocks, a group in one, which are paired with themselves too.
    """
    blocks = block_count(F.col("docs"), F.col("shingles"), block_shingles, block_docs)
    sized = parts.withColumn("n", blocks).withColumn("own", F.when(F.col("group").isNotNull() & (F.col("n") > 1), F.col("group")).otherwise(F.lit(SHARED)))
    table = sized.groupBy("region", "own").agg(F.sum("docs").alias("docs"), F.sum("shingles").alias("shingles")).withColumn("n", blocks)
    # a region has few groups that large: each has block_docs documents, or block_shingles members, at least
    before = Window.partitionBy("region").orderBy("own")
    table = table.select("region", "own", "n", (F.sum("n").over(before) - F.col("n")).alias("first"), F.sum("n").over(Window.partitionBy("region")).alias("blocks"))
    large = sized.filter(F.col("own") != SHARED).select("region", "group", "own")
    placed = members.join(large, ["region", "group"], "left").withColumn("own", F.coalesce("own", F.lit(SHARED))).join(table, ["region", "own"])
    together = F.when(F.col("own") == SHARED, F.coalesce("group", "doc_id")).otherwise(F.col("doc_id"))
    placed = placed.withColumn("block", F.col("first") + F.pmod(F.xxhash64(together), F.col("n")))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    others = F.when(F.col("own") == SHARED, every).otherwise(F.filter(every, lambda b: (b < F.col("first")) | (b >= F.col("first") + F.col("n"))))
    placed = placed.withColumn("other", F.explode(others))
    return placed.select("region", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "doc_id", "block", "members", "prefixes")


def near_components(spark: SparkSession, docs: DataFrame, percent: int = 80, size: int = SIZE, block_shingles: int = BLOCK_SHINGLES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept, for every row."""
    common.sent_to_workers(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    trees = tree_count(percent)
    signed = common.written(signatures(docs, trees, size), spark, "signatures")
    set_key = ["set_a", "set_b", "n_shingles"]
    classes = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy(*set_key).agg(F.min_by(F.struct("prefixes", "below"), "doc_id").alias("s"), F.min("doc_id").alias("id"))
    classes = common.written(classes.select(*set_key, "id", "s.*"), spark, "classes")
    near = candidates(spark, classes, trees)
    regions = graph.components(spark, near.select("id", "root"), "regions").select(F.col("id").alias("doc_id"), F.col("root").alias("region"))
    sizes = regions.join(classes.select(F.col("id").alias("doc_id"), "n_shingles"), "doc_id")
    blocks = block_count(F.col("docs"), F.col("shingles"), block_shingles, block_docs)
    totals = sizes.groupBy("region").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("shingles"))
    large = common.written(totals.filter(blocks > 1).select("region"), spark, "large")
    known, none = None, F.lit(None).cast("bigint")
    regions = regions.withColumn("group", none)
    if not large.isEmpty():
        inside = common.written(sizes.join(large, "region"), spark, "inside")
        known = centre_links(spark, docs, inside.select("doc_id", "region"), near, percent, trees, size)
        groups = graph.components(spark, known, "groups").select(F.col("id").alias("doc_id"), F.col("root").alias("group"))
        regions = regions.drop("group").join(groups, "doc_id", "left")
        parts = inside.join(groups, "doc_id", "left").groupBy("region", "group").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_shingles").alias("shingles"))
        parts = common.written(parts, spark, "parts")
    regions = common.written(regions.select("doc_id", "region", "group"), spark, "regions")
    members = with_sets(chosen(docs, regions, regions.count()), trees, size)
    whole = F.lit(0).cast("bigint")
    columns = ["region", "low", "high", "doc_id", "block", "members", "prefixes"]
    if known is None:
        grouped = members.withColumns({"low": whole, "high": whole, "block": whole}).select(*columns)
    else:
        members = common.written(members, spark, "members")
        small = members.join(large, "region", "left_anti").withColumns({"low": whole, "high": whole, "block": whole}).select(*columns)
        grouped = small.unionByName(paired(members.join(large, "region"), parts, block_shingles, block_docs))
    links = grouped.repartition("region", "low", "high").sortWithinPartitions("region", "low", "high").mapInArrow(linker(percent), "id bigint, root bigint")
    if known is not None:
        links = graph.components(spark, links.unionByName(known), "links")
    else:
        links = common.written(links.groupBy("id").agg(F.min("root").alias("root")), spark, "links")
    tops = classes.select(*set_key, "id").join(links, "id", "left").select(*set_key, F.coalesce("root", "id").alias("top"))
    result = signed.select("doc_id", *set_key).join(tops, set_key, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("top")).otherwise(F.col("doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(spark: SparkSession, docs: DataFrame, percent: int = 80, size: int = SIZE, few: int = common.FEW) -> DataFrame:
    """The documents of which each near-duplicate component keeps its smallest, whole and with their own columns.

    Of repeated rows of a doc_id the one with the smallest text stays (null first; equal rows count as
    one); of rows without doc_id all do. The ids that go are sent to the documents while there are at most `few`; beyond that
    the documents with an id are exchanged by it.
    """
    parts = common.written(near_components(spark, docs, percent, size).select("doc_id", "kept"), spark, "near-kept")
    gone = common.written(parts.filter(~F.col("kept")).select(F.col("doc_id").alias("gone__")).distinct(), spark, "near-gone")
    same = F.col("doc_id") == F.col("gone__")
    if gone.count() <= few:
        kept = docs.join(F.broadcast(gone), same, "left_anti")
    else:
        kept = docs.filter(F.col("doc_id").isNull()).unionByName(docs.filter(F.col("doc_id").isNotNull()).join(gone, same, "left_anti"))
    repeated = not parts.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").isEmpty()
    common.removed(parts)
    if not repeated:
        return kept
    known = kept.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", F.struct(*kept.columns).alias("whole__"))
    one = known.groupBy("doc_id").agg(F.min_by("whole__", F.struct("text", F.xxhash64(F.to_json("whole__")))).alias("whole__"))
    return kept.filter(F.col("doc_id").isNull()).unionByName(one.select("whole__.*"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, i, i + least(len(ws), 5) - 1), ' ') || ':' || least(len(ws), 5)) AS g
  FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT a AS doc_id, a AS other FROM (SELECT DISTINCT a FROM links)
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), c AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, w.doc_id = coalesce(c.component_id, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
