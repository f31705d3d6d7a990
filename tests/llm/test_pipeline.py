import corpus_pipeline
from perigon.llm import common, decontamination, mixing, near_dedup, toxicity
from tests.llm import test_decontamination, test_near_dedup

SF = "/root/testdata/sf0.001"


def test_stages_against_their_own_inputs(spark):
    docs = common.table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near-duplicates", "decontamination", "mixing", "sharding"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, seen[-1], SF), spark, f"test-{name}")
        if name != "sharding":
            assert out.columns == docs.columns
        seen.append(out)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    rejected = {r.doc_id for r in toxicity.report(spark, docs, common.table(spark, SF, "labels")).filter("predicted = 1").collect()}
    assert ids[1] == ids[0] - rejected
    groups = near_dedup.near_components(spark, seen[1], 80).collect()
    assert ids[2] == {r.component_id for r in groups}
    dirty = {r.doc_id for r in decontamination.report(spark, seen[2], common.table(spark, SF, "benchmark")).filter("contaminated").collect()}
    # the same by brute force, from each stage's own input
    texts = [[(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()] for d in seen[1:3]]
    assert ids[2] == {c for _, _, c in test_near_dedup.brute(texts[0], 80)}
    items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    assert dirty == {d for d, _, hit, _ in test_decontamination.brute(texts[1], items) if hit}
    assert ids[3] == ids[2] - dirty and ids[4] == ids[3] and ids[5] == ids[4]
    shards = seen[5].toPandas().sort_values(["shard", "slot"])
    # the shards follow each other as the mix does
    mix = mixing.with_places(seen[3]).select("doc_id", "place").toPandas().sort_values("place")
    assert list(shards.doc_id) == list(mix.doc_id)
    sums = shards.groupby("shard")["size"].sum()
    assert len(sums) == 16 and sums.max() - sums.min() <= 2 * shards["size"].max()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "shard", "slot").collect())) == sorted(zip(shards.doc_id, shards.shard, shards.slot))


def test_odd_rows(spark, tmp_path):
    """Null, empty, repeated and long rows, and a table without rows, through all stages."""
    docs = common.table(spark, SF, "documents")
    long = " ".join(f"word{k}" for k in range(200_000))
    odd = spark.createDataFrame([(None, None, None), (None, "", "x"), (900_001, None, None), (900_002, long, "y"), (900_002, long + " more", "y"), (900_003, "rare words only once", None)], "doc_id bigint, text string, source string")
    both = docs.limit(60).unionByName(odd, allowMissingColumns=True)
    for rows, least in ((both, 4), (both.limit(0), 0)):
        seen = common.written(rows, spark, "odd")
        for name, stage in corpus_pipeline.STAGES:
            seen = common.written(stage(spark, seen, SF), spark, f"odd-{name}")
        ids = [r.doc_id for r in seen.collect()]
        assert len(ids) >= least and ids.count(900_002) == (1 if least else 0) and ids.count(None) == (2 if least else 0)


def test_rows_from_no_files(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "s") for k in range(50)], "doc_id bigint, text string, source string")
    got = corpus_pipeline.shard(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in got) == list(range(50)) and {r.shard for r in got} == set(range(16))


def test_columns_that_clash_with_those_of_the_stages(spark):
    docs = common.table(spark, SF, "documents").limit(80).selectExpr("*", "doc_id as shard", "text as slot", "1 as size", "'x' as score", "doc_id as place", "2 as n_words", "'y' as items")
    seen = common.written(docs, spark, "clash")
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, seen, SF), spark, f"clash-{name}")
        if name != "sharding":
            assert out.columns == docs.columns
            same = {r.doc_id: (r.slot, r.shard, r.items) for r in out.collect()}
            assert same and all(v[1] == k and v[2] == "y" for k, v in same.items())
        seen = out
    assert sorted(seen.columns) == sorted(["doc_id", "source", "size", "text_crc32", "shard", "slot"]) and seen.count() == len(same)


def test_spread_leaves_wide_scans_alone(spark):
    n = spark.sparkContext.defaultParallelism
    one, many = spark.range(100).coalesce(1), spark.range(100).repartition(n + 3)
    assert common.spread(one).rdd.getNumPartitions() == n and common.spread(many).rdd.getNumPartitions() == n + 3
    assert sorted(r.id for r in common.spread(one).collect()) == list(range(100))
