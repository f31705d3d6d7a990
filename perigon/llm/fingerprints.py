"""Document fingerprints: bottom-k sketches of word-shingle hashes.

The sketch of a text is the `k` smallest distinct 64-bit hashes of its shingles (runs of `size` words
between ASCII white space, ASCII case folded). Sketches of parts merge into the sketch of the whole:
the `k` smallest of their union. From sketches alone come estimates of resemblance (Jaccard),
containment and the number of distinct shingles; all are exact while a set has at most `k` shingles.

Edge cases: a null text is an empty one; a text of fewer words than `size` has one shingle, all its
words; a text without words has the empty sketch, written as the empty string. Two empty sketches
resemble each other fully, an empty and another not at all. For the edited texts, rows without a
doc_id come last and, like rows of one doc_id, are one range, ordered by their text.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigon.llm import common

K = 128
SIZE = 5
#: Text bytes in a range of consecutive documents; ranges are dealt to tasks by hash.
RANGE_BYTES = 4 << 20
#: Beyond MOST_RANGES * RANGE_BYTES of text ranges grow. A range is streamed in order, so only its sort on disk grows.
MOST_RANGES = 40_000
CUT_GROUP = 256
MOST_CELLS = 256


def sketches(texts: pa.Array, k: int = K, size: int = SIZE) -> list[np.ndarray]:
    data, offsets = common.utf8(texts)
    found, at = common.shingle_rows(data, offsets, size)
    return [np.unique(found[i:j])[:k] for i, j in zip(at[:-1], at[1:])]


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def decode(text: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text or ""), "<u8")


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the k smallest hashes of the union that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    # distinct values are those that do not repeat their predecessor
    new = np.concatenate([[True], ~twice])
    last = both[new][:k][-1]
    union = min(k, int(new.sum()))
    return float(np.count_nonzero(twice & (both[1:] <= last))) / union


def distinct_count(a: np.ndarray, k: int = K) -> float:
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[-1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j / (1 + j) * (distinct_count(a, k) + distinct_count(b, k)) / distinct_count(a, k))


def fingerprint(docs: DataFrame, text: str = "text", k: int = K, size: int = SIZE, out: str = "fingerprint") -> DataFrame:
    """The rows of `docs` with the column `out`: the encoded sketch of each whole text."""

    @F.pandas_udf("string")
    def sketch_of(texts):
        import pandas as pd

        return pd.Series([encode(s) for s in sketches(pa.Array.from_pandas(texts, type=pa.string()), k, size)], dtype=object)

    common.sent_to_workers(docs.sparkSession)
    return docs.withColumn(out, sketch_of(F.col(text)))


def merge_by(prints: DataFrame, key: str, column: str = "fingerprint", k: int = K) -> DataFrame:
    """One row for each key: the sketch of all its parts together and its distinct shingles.

    Each task first merges what it has of a key, so a key with most rows sends one sketch per task.
    """
    common.sent_to_workers(prints.sparkSession)
    kind = prints.schema[key].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict = {}
        names = [key, column]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(have), schema_key), pa.array([encode(v) for v in have.values()], pa.string())], names)

        schema_key = None
        for b in batches:
            schema_key = b.schema.field(0).type
            for x, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                have[x] = merge(have[x], decode(s), k) if x in have else decode(s)
            if len(have) > 20_000:
                yield out()
                have.clear()
        if have:
            yield out()

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key."""
        held, sketch, some = None, None, False
        schema_key = None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([held], schema_key), pa.array([encode(sketch)], pa.string()), pa.array([distinct_count(sketch, k)], pa.float64())], [key, column, "distinct_shingles"])

        for b in batches:
            schema_key = b.schema.field(0).type
            for x, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if some and x == held:
                    sketch = merge(sketch, decode(s), k)
                    continue
                if some:
                    yield row()
                held, sketch, some = x, decode(s), True
        if some:
            yield row()

    parts = prints.select(key, column).mapInArrow(partial, f"`{key}` {kind}, `{column}` string")
    return parts.repartition(key).sortWithinPartitions(key).mapInArrow(final, f"`{key}` {kind}, `{column}` string, distinct_shingles double")


def compare(pairs: DataFrame, a: str, b: str, k: int = K) -> DataFrame:
    """Pairs of encoded sketches with `resemblance` and `containment` (of a in b)."""

    @F.pandas_udf("resemblance double, containment double")
    def likeness(x, y):
        import pandas as pd

        both = [(decode(p), decode(q)) for p, q in zip(x, y)]
        return pd.DataFrame({"resemblance": [resemblance(p, q, k) for p, q in both], "containment": [containment(p, q, k) for p, q in both]}, dtype="float64")

    common.sent_to_workers(pairs.sparkSession)
    got = pairs.withColumn("likeness__", likeness(F.col(a), F.col(b)))
    return got.withColumns({"resemblance": F.col("likeness__.resemblance"), "containment": F.col("likeness__.containment")}).drop("likeness__")


def id_cuts(docs: DataFrame, low: int, top: int, ranges: int, target: int) -> list[int]:
    """Ids of documents, ascending and below `top`, that cut them into ranges of about `target` bytes.

    Bytes are counted over all partitions in at least four cells of evenly spaced ids for each range.
    Where ids are so dense that a cell has twice the target, the heaviest cells are counted again in
    smaller ones; MOST_CELLS of them a round bound the rows sent.
    """
    cuts: list[int] = []
    todo, shift = [(low, top + 1)], max(0, (top - low).bit_length() - max(12, (4 * ranges).bit_length()))
    while todo:
        inside = None
        for a, b in todo:
            one = (F.col("doc_id") >= a) & (F.col("doc_id") < b)
            inside = one if inside is None else inside | one
        cell = F.shiftright(F.col("doc_id") - F.lit(low), shift)
        found = docs.filter(inside).groupBy(cell.alias("cell")).agg(F.sum(F.octet_length("text").cast("bigint")).alias("n"), F.max("doc_id").alias("last")).collect()
        held = 0
        for _, n, last in sorted((r["cell"], r["n"], r["last"]) for r in found):
            held += n
            if held >= target:
                cuts.append(last)
                held = 0
        heavy = sorted(((r["n"], r["cell"]) for r in found if r["n"] > 2 * target), reverse=True)[:MOST_CELLS] if shift else []
        todo = [(low + (k << shift), low + ((k + 1) << shift)) for _, k in heavy]
        shift = max(0, shift - 8)
    return sorted(set(cuts) - {top})


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Documents dealt so that each meets the next one by descending doc_id: (part, tail, doc_id, text), sorted.

    The ids are cut at actual ids into ranges of consecutive documents. The first document of a range
    also goes, marked as tail, to the end of the range before it, and the very first to the end of the
    last, so that no document needs another task's rows. Texts move once. Rows without an id come
    last; equal ids are ordered by their text.
    """
    common.sent_to_workers(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint")).alias("bytes"), F.min("doc_id").alias("low"), F.max("doc_id").alias("top")).first()
    ranges = ranges or max(1, min(MOST_RANGES, (size["bytes"] or 0) // RANGE_BYTES))
    cuts = [] if ranges == 1 or size["top"] is None else id_cuts(docs, size["low"], size["top"], ranges, -(-(size["bytes"] or 1) // ranges))
    # cuts at or above an id, counted in two steps: whole groups of cuts, then the cuts of one group
    groups = [cuts[k : k + CUT_GROUP] for k in range(0, len(cuts), CUT_GROUP)]
    tops = F.from_json(F.lit(json.dumps([g[-1] for g in groups])), "array<bigint>")  # a row looks at the groups' last cuts and the cuts of one group
    nested = F.from_json(F.lit(json.dumps([*groups, []])), "array<array<bigint>>")
    whole = F.size(F.filter(tops, lambda c: c < F.col("doc_id")))
    group = F.element_at(nested, whole + 1)
    below = F.least(whole * CUT_GROUP, F.lit(len(cuts))) + F.size(F.filter(group, lambda c: c < F.col("doc_id")))
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.lit(len(cuts)) - below)
    first = F.lit(True) if size["top"] is None else F.col("doc_id").eqNullSafe(F.lit(size["top"]))
    own = F.struct(F.col("part__").alias("part"), F.lit(0).alias("tail"))
    places = F.array_compact(
        F.array(
            own,
            F.when(F.col("cut__"), F.struct((F.col("part__") - 1).alias("part"), F.lit(1).alias("tail"))),
            F.when(first, F.struct(F.lit(len(cuts)).alias("part"), F.lit(1).alias("tail"))),
        )
    )
    # a cut is the largest id of its range: the range below begins where the number of cuts at or above changes
    dealt = docs.withColumns({"part__": part, "cut__": F.coalesce(F.exists(group, lambda c: c == F.col("doc_id")), F.lit(False))}).select(F.explode(places).alias("p"), "doc_id", "text").select("p.part", "p.tail", "doc_id", "text")
    tasks = max(1, -(-(len(cuts) + 1) // 4))
    order: list[Column] = [F.col("part"), F.col("tail"), F.col("doc_id").desc_nulls_last(), F.col("text")]
    return dealt.repartition(tasks, "part").sortWithinPartitions(*order)


def edited_pairs(k: int = K, size: int = SIZE):
    """Arrow function over the rows of `with_next`: fingerprints of each text and of its edited text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which still waits for the next: (part, doc_id, text, sketch)
        done = None  # the part whose tail has been used

        def rows(pairs: list) -> pa.RecordBatch:
            edited = []
            for (_, _, text, _), (_, _, follows, _) in pairs:
                n = len(text)
                edited.append(text[: n - n // 2] + follows[: n // 2])
            prints = sketches(pa.array(edited, pa.large_string()), k, size)
            columns = [
                pa.array([a[1] for a, _ in pairs], pa.int64()),
                pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
                pa.array([encode(a[3]) for a, _ in pairs], pa.string()),
                pa.array([encode(s) for s in prints], pa.string()),
                pa.array([resemblance(a[3], s, k) for (a, _), s in zip(pairs, prints)], pa.float64()),
                pa.array([resemblance(a[3], b[3], k) for a, b in pairs], pa.float64()),
                pa.array([distinct_count(a[3], k) for a, _ in pairs], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct_shingles"])

        for batch in batches:
            _, offsets = common.utf8(batch.column("text"))
            for i, j in common.pieces(offsets):
                part = batch.slice(i, j - i)
                texts = part.column("text")
                ready = []
                for p, tail, doc, text, sketch in zip(part.column("part").to_pylist(), part.column("tail").to_pylist(), part.column("doc_id").to_pylist(), texts.to_pylist(), sketches(texts, k, size)):
                    now = (p, doc, text, sketch)
                    if held is not None and held[0] == p:
                        ready.append((held, now))
                        held = None
                    if tail:
                        done = p
                    elif done != p:
                        held = now
                if ready:
                    yield rows(ready)

    return run


EDITED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double"


def edited_fingerprints(docs: DataFrame, k: int = K, size: int = SIZE, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of the text whose second half the next document's start replaces."""
    return with_next(docs, ranges).mapInArrow(edited_pairs(k, size), EDITED)
