import random

import pytest
from pyspark.sql import functions as F

from perigon.llm import sharding


def brute(rows, shards, tolerance):
    """rows: (key, tie, size), sorted; the shard of each."""
    total = sum(r[2] for r in rows)
    own = {}
    for k, _, s in rows:
        own[k] = own.get(k, 0) + s
    out, at, key_at, last = [], 0, 0, object()
    for k, _, s in rows:
        if k != last:
            key_at, last = at, k
        before, size = (key_at, own[k]) if own[k] <= int(tolerance * total / shards) else (at, s)
        out.append(shards * (2 * before + size) // (2 * total))
        at += s
    return out


@pytest.mark.parametrize("case", ["spread", "hot key", "few", "one key"])
def test_against_a_sort(spark, case, monkeypatch):
    monkeypatch.setattr(sharding, "FEW", 16)
    rng = random.Random(case)
    n = 9 if case == "few" else 3000
    key = {"spread": lambda: rng.randrange(1 << 60), "hot key": lambda: 77 if rng.random() < 0.4 else rng.randrange(1 << 40), "few": lambda: rng.randrange(5), "one key": lambda: 3}[case]
    rows = sorted((key(), k, rng.randint(1, 900)) for k in range(n))
    df = spark.createDataFrame(rows, "k bigint, t bigint, s bigint").repartition(5)
    got = sorted((r.k, r.t, r.shard, r.slot) for r in sharding.histogram_sort(df, F.col("k"), F.col("t"), F.col("s"), 7, 0.05).collect())
    assert [g[2] for g in got] == brute(rows, 7, 0.05)
    slots = {}
    for _, _, shard, slot in got:
        assert slot == slots.get(shard, 0)
        slots[shard] = slot + 1


def test_documents(spark):
    rng = random.Random(1)
    rows = [(k, "x" * rng.randint(0, 300)) for k in range(800)] + [(900 + k, "copy of a text") for k in range(300)] + [(None, None), (None, "y"), (1, None), (1, None), (2, "")]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id bigint, text string, size string, shard int")
    got = sharding.shard_documents(spark, df).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    import zlib

    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    sums, slots = {}, {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(sums) == set(range(16)) and max(sums.values()) - min(sums.values()) <= 602
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(spark, df.limit(0)).count() == 0


def test_shards_on_disk(spark, tmp_path):
    rows = [(k, f"text {k}") for k in range(200)] + [(None, "none"), (None, "none"), (7, "again"), (7, None)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, slot int")
    sharding.write_shards(df, str(tmp_path / "s"), shards=4)
    back = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(rows, key=str) and {r.shard for r in back} == set(range(4))
    for shard in range(4):
        assert sorted(r.slot for r in back if r.shard == shard) == list(range(sum(r.shard == shard for r in back)))


def test_very_many_equal_rows_are_cut_where_the_boundary_falls(spark):
    """10,000 rows that agree in text and doc_id, and 10,000 of one text without one: over FEW, under one key and tie."""
    rows = spark.range(10_000).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit("same").alias("text"))
    more = spark.range(10_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("none").alias("text"))
    other = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    got = sharding.shard_documents(spark, rows.unionByName(more).unionByName(other)).collect()
    sums, slots = {}, {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 26_000 and set(sums) == set(range(16)) and max(sums.values()) - min(sums.values()) <= 20
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_own_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(k, k % 5, 10, "k", "t", "s") for k in range(300)], "a bigint, b bigint, c bigint, key string, tie string, size string")
    got = sharding.histogram_sort(df, F.col("a"), F.col("b"), F.col("c"), 3)
    assert got.columns == [*df.columns, "shard", "slot"] and {(r.key, r.tie, r["size"]) for r in got.collect()} == {("k", "t", "s")}
    assert sorted((r.shard, r.slot, r.a) for r in got.collect()) == [(k // 100, k % 100, k) for k in range(300)]
