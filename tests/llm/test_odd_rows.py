"""Null keys, empty tables, ties and clashing columns where the operators' own tests have none."""

from pyspark.sql import functions as F

from perigon.llm import fingerprints, sharding, toxicity


def test_sketches_of_null_keys_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", None), (2, "a b c d e f g", None), (3, None, "k"), (4, "x y z u v w", "k")], "doc_id bigint, text string, part string")
    prints = fingerprints.edited_fingerprints(docs.drop("part"))
    assert prints.count() == 4 and prints.filter("doc_id = 3").first().n_chars == 0
    assert fingerprints.edited_fingerprints(docs.drop("part").limit(0)).count() == 0


def test_scores_at_the_limit_and_missing_labels(spark):
    scored = spark.createDataFrame([(1, toxicity.LIMIT), (2, toxicity.LIMIT - 1e-12), (3, 1.0), (4, None)], "doc_id bigint, score double")
    got = {r.doc_id: r.p for r in scored.select("doc_id", (F.col("score") >= toxicity.LIMIT).cast("int").alias("p")).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: None}
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(k, None, None) for k in range(20)], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.report(spark, docs, marks).collect()} == {0.0}


def test_shards_of_very_many_equal_rows(spark, tmp_path):
    """More equal rows than are told apart one by one: all are there, in shards."""
    docs = spark.range(sharding.FEW + 300).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("same").alias("text"), F.lit("s").alias("source"), F.lit("mine").alias("shard"))
    got = sharding.shard_documents(spark, docs)
    assert got.count() == sharding.FEW + 300 and got.select("slot", "shard").distinct().count() == got.count()
