"""Corpus pipeline: toxicity, near-duplicates, benchmark passages, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All but the last return the columns of `documents`.

Edge cases: null and empty texts score as such, are linked with nothing, contain no passage and weigh
one byte; rows without doc_id stay unless a score or a passage rejects them; of repeated doc_ids one
row stays; an empty table gives no rows; further columns come along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigon.llm import common, decontamination, mixing, near_dedup, sharding, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the limit; the model learns from the labels of these documents."""
    return toxicity.without_toxic(spark, docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 or more (runs of five words) the document with the smallest doc_id."""
    return near_dedup.deduplicated(spark, docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return decontamination.decontaminated(spark, docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that keeps each source less than a block away from its target weight."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot: shards of near equal bytes.

    The key of the sort is a row's place in the files of the mix (number of the file, then of the row),
    so each shard is a stretch of the mix and has its weights. Rows that come from no files keep the
    order in which Spark gives them.
    """
    text = F.coalesce("text", F.lit(""))
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), "source", sharding.size_of(text).alias("size"), F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32")]
    if docs.inputFiles():
        name = F.col("_metadata.file_name")
        part = F.regexp_extract(name, r"part-(\d+)", 1).try_cast("bigint")
        piece = F.coalesce(F.regexp_extract(name, r"-c(\d+)", 1).try_cast("bigint"), F.lit(0))
        place = [part.alias("file"), (F.shiftleft(piece, 40) + F.col("_metadata.row_index")).alias("row")]
    else:
        place = [F.lit(0).cast("bigint").alias("file"), F.monotonically_increasing_id().alias("row")]
    light = common.written(docs.select(*columns, *place), spark, "places")
    placed = sharding.histogram_sort(light, F.col("file"), F.col("row"), F.col("size"), tolerance=0)
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The trees of the first stage are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    done: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), spark, f"pipeline-{name}")
        common.removed(*done)  # the documents of the stage before, which nothing reads any more
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
