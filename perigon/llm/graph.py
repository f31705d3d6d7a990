"""Connected components of a graph whose edges are a DataFrame.

Edges point from a node to a smaller one. A round hooks and jumps: the edges of a node are brought
together, it keeps the smallest of the nodes it points to and the others are hooked on that one;
then every edge whose end points further on is moved there. When no end points further, each node
points to the smallest of its component. Edges are contracted inside each partition before they are
exchanged, so that a dense group arrives as a few stars.

A node that many point to is no hot key: nodes are brought together by where they start, and ends
that point further are looked up in a table of such ends only, which is sent to all tasks while it
has at most FEW rows; beyond that, the lookup is an exchange salted by the start.

Edge cases: no edges give no rows; loops are left out; repeated edges count once; ids are bigint and
not null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigon.llm import common

#: Edges of a partition that are contracted at a time.
HELD = 1_000_000
#: Rows (two numbers each) that are sent to all tasks.
FEW = 200_000
SALTS = 16
EDGES = "id bigint, root bigint"


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), sorted, and the smallest node of the component of each."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    at = at.ravel()
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _batch(ids: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], names=["id", "root"])


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect the same nodes, HELD of a partition's edges at a time, as stars."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        nodes, roots = smallest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        held.clear()
        away = nodes != roots
        return _batch(nodes[away], roots[away])

    for batch in batches:
        held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        if sum(len(h[0]) for h in held) >= HELD:
            yield out()
    if held:
        yield out()


def hooked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From edges sorted by (id, root): each node with the smallest it points to, on which the others are hooked."""
    node = first = None
    for batch in batches:
        ids, roots = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if not len(ids):
            continue
        new = np.append(True, ids[1:] != ids[:-1])
        new[0] = node is None or ids[0] != node
        at = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
        least = np.where(at >= 0, roots[at], roots[0] if first is None else first)
        node, first = ids[-1], least[-1]
        more = ~new & (roots != least)
        hooks = np.unique(np.stack([roots[more], least[more]]), axis=1) if more.any() else np.zeros((2, 0), np.int64)
        yield _batch(np.concatenate([ids[new], hooks[0]]), np.concatenate([roots[new], hooks[1]]))


def components(spark: SparkSession, edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, root): each node that has an edge, with the smallest node of its component. edges: bigint id and root."""
    common.sent_to_workers(spark)
    edges = edges.filter(F.col("id") != F.col("root")).select("id", "root")
    before: list[DataFrame] = []
    while True:
        edges = edges.mapInArrow(contracted, EDGES).repartition("id").sortWithinPartitions("id", "root")
        edges = common.written(edges.mapInArrow(hooked, EDGES), spark, label)
        common.removed(*before)
        least = edges.groupBy("id").agg(F.min("root").alias("to"), F.count(F.lit(1)).alias("n"))
        ends = edges.select(F.col("root").alias("end")).distinct()
        further = least.join(ends, F.col("id") == F.col("end"), "left").filter("n > 1 or end is not null").select(F.col("id").alias("end"), "to")
        further = common.written(further, spark, f"{label}-ends")
        n = further.count()
        if not n:
            common.removed(further)
            return edges.unionByName(edges.select(F.col("root").alias("id"), "root").distinct())
        before = [edges, further]
        if n <= FEW:
            moved = edges.join(F.broadcast(further), F.col("root") == F.col("end"), "left")
        else:
            salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
            salted = edges.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
            moved = salted.join(further.withColumn("salt", salts).withColumnRenamed("end", "root"), ["root", "salt"], "left")
        edges = moved.select("id", F.coalesce("to", "root").alias("root"))
