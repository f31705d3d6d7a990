import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from perigon.llm import mixing


def test_rows(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["hot"] * 5 + ["a", "b", None]), "t", k) for k in range(3000)] + [(None, "a", None, 0), (5, "hot", "again", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, slot int")
    weights = {"hot": 0.25, "a": 0.25, "b": 0.5}
    placed = mixing.with_places(docs.drop("slot"), weights, block_rows=4).collect()
    assert len(placed) == len(rows) and len({r.place for r in placed}) == len(rows)
    first = sorted((r for r in placed), key=lambda r: r.place)
    shortest = min(sum(r[1] == s for r in rows) / w for s, w in weights.items())
    for t in range(20, int(shortest / 4) - 4):
        have = {s: len({r.slot for r in first if r.source == s and r.slot < t}) for s in weights}
        assert all(abs(have[s] - w * t) < 1.01 for s, w in weights.items())
    mixed = mixing.mixed(docs, weights, block_rows=4)
    assert mixed.columns == docs.columns and mixed.count() == len(rows)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))
    assert mixing.with_places(docs.limit(0)).count() == 0


def furthest(order, blocks, weights):
    """The largest distance, in blocks, of a source from its exact share at any slot until one runs out."""
    total = sum(map(Fraction, weights.values()))
    share = {s: Fraction(w) / total for s, w in weights.items()}
    have, most = dict.fromkeys(weights, 0), Fraction(0)
    for t, s in enumerate(order):
        have[s] += 1
        most = max(most, *(abs(have[x] - share[x] * (t + 1)) for x in weights))
        if have[s] == blocks[s]:
            break
    return most


def slots_of(placed):
    return [s for _, s in sorted({(r.slot, r.source) for r in placed})]


def test_small_sources_keep_their_own_weights(spark):
    # 300 sources of 4 rows and one of 2,000: by square roots the small ones have nine tenths of the mix
    docs = spark.range(3200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1200, F.concat(F.lit("s"), F.col("id") % 300)).otherwise("hot").alias("source"))
    placed = mixing.with_places(docs, block_rows=1).collect()
    assert sorted(r.place for r in placed) == list(range(3200))
    blocks = {f"s{k}": 4 for k in range(300)} | {"hot": 2000}
    assert furthest(slots_of(placed), blocks, {s: n**0.5 for s, n in blocks.items()}) < 1.01
    # a source beyond the 256 largest with half of the weight
    placed = mixing.with_places(docs, {"hot": 1, "s299": 1}, block_rows=1).collect()
    assert {r.slot for r in placed if r.source == "s299"} <= set(range(8))
    assert max(r.slot for r in placed if r.source == "hot") == 2003


def test_exact_weights_over_many_slots():
    rng = random.Random(4)
    cases = [(dict.fromkeys("abc", 1500), dict.fromkeys("abc", 1)), (dict.fromkeys("abc", 1500), dict.fromkeys("abc", 1 / 3)), ({"a": 4000, "b": 40}, {"a": 0.99999, "b": 0.00001}), (dict.fromkeys(range(64), 20), dict.fromkeys(range(64), 0.1))]
    cases += [({k: rng.randint(1, 900) for k in range(n)}, {k: rng.choice([rng.random(), rng.randint(1, 4), 1e-6]) for k in range(n)}) for n in range(1, 9)]
    for blocks, weights in cases:
        order = list(mixing.turns(blocks, weights))
        assert sorted(order) == sorted((s, i) for s, n in blocks.items() for i in range(n))
        assert furthest([s for s, _ in order], blocks, weights) < 1
        # also when sources have run out: between the shares of all before and after each block
        w = {s: Fraction(x) for s, x in weights.items()}

        def passed(v):
            return sum(min(n, w[s] * v) for s, n in blocks.items())

        for t, (s, i) in list(enumerate(order))[:: 1 + len(order) // 500]:
            assert passed(i / w[s]) < t + 1 and t < passed((i + 1) / w[s])


def test_rows_of_equal_sources_over_many_slots(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"))
    placed = mixing.with_places(docs, block_rows=1).collect()
    assert furthest(slots_of(placed), dict.fromkeys("012", 3000), dict.fromkeys("012", 1)) < 1


def brute_slots(blocks, weights):
    """The slots of all blocks by trying every source at every slot, from the definition."""
    left, done, order = dict(blocks), dict.fromkeys(blocks, 0), []
    w = {s: Fraction(weights[s]) for s in blocks}

    def passed(v):
        return sum(min(Fraction(n), w[s] * v) for s, n in blocks.items())

    for t in range(sum(blocks.values())):
        ready = [s for s in blocks if left[s] and passed(done[s] / w[s]) < t + 1]
        best = min(ready, key=lambda s: (math.ceil(passed((done[s] + 1) / w[s])), list(blocks).index(s)))
        order.append((best, done[best]))
        left[best] -= 1
        done[best] += 1
    return order


def test_registered_form_against_brute_force(spark):
    """All rows of the query, with the weights it uses: square roots of the sources' sizes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = docs.limit(40).unionByName(docs.limit(3).withColumn("source", F.lit(None).cast(docs.schema["source"].dataType)))
    both = docs.unionByName(extra)
    got = mixing.report(both).collect()
    sizes = {}
    for r in both.select("source").collect():
        sizes[r.source] = sizes.get(r.source, 0) + 1
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute_slots({s: -(-sizes[s] // mixing.BLOCK_ROWS) for s in names}, {s: sizes[s] ** 0.5 for s in names})
    slots = {}
    for r in got:
        slots.setdefault(r.slot, []).append(r)
    assert [slots[t][0].source for t in range(len(want))] == [s for s, _ in want]
    for t, (s, i) in enumerate(want):
        assert {r.source for r in slots[t]} == {s} and sorted(r.place - t * mixing.BLOCK_ROWS for r in slots[t]) == list(range(min(mixing.BLOCK_ROWS, sizes[s] - i * mixing.BLOCK_ROWS)))
    assert sorted((r.doc_id, str(r.source)) for r in got) == sorted((r.doc_id, str(r.source)) for r in both.collect())


def test_stretches_by_themselves_are_the_whole_schedule(spark, monkeypatch):
    rng = random.Random(7)
    cases = [({k: rng.randint(1, 120) for k in range(rng.randint(1, 9))}, 3) for _ in range(60)]
    cases += [({k: rng.randint(1, 5) for k in range(60)}, 50), ({0: 900, 1: 1, 2: 30}, 10)]
    for blocks, most in cases:
        weights = {k: rng.choice([rng.random(), rng.randint(1, most), 1e-3, 0]) for k in blocks}
        mix = mixing.Mix(blocks, weights)
        whole = list(mix.slots(0, mix.total))
        assert [(s, i) for _, s, i in whole] == brute_slots_with_rest(blocks, weights)
        for first in sorted({rng.randrange(mix.total) for _ in range(12)}):
            end = min(mix.total, first + rng.randint(1, 40))
            assert list(mix.slots(first, end)) == whole[first:end], (blocks, weights, first)
        assert all(p.passed(i + 1, k)[1] - p.passed(i, k)[0] <= p.longest() + 1 for p in mix.parts for k in range(len(p.names)) for i in range(p.blocks[k]))
    monkeypatch.setattr(mixing, "STRETCH", 10)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 50 == 1, "b").otherwise("c").alias("source"))
    got = mixing.with_places(docs, block_rows=4).collect()
    sizes = {s: sum(r.source == s for r in got) for s in "abc"}
    want = mixing.Mix({s: -(-n // 4) for s, n in sizes.items()}, mixing.tempered(sizes))
    assert want.total // want.stretch() > 5
    assert {(r.slot, r.source) for r in got} == {(t, s) for t, s, _ in want.slots(0, want.total)}


def brute_slots_with_rest(blocks, weights):
    first = {s: n for s, n in blocks.items() if weights[s] > 0}
    rest = {s: n for s, n in blocks.items() if weights[s] <= 0}
    return brute_slots(first, weights) + brute_slots(rest, dict.fromkeys(rest, 1))
