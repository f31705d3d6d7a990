"""Observations that arrive as Parquet files, filtered and counted as they come.

This is not the batch gate, which takes the first eligible row of an id by seq over all rows. Here
the first eligible row to arrive is taken. Its id is remembered until the watermark passes its
arrival plus the delay: a copy after that is accepted again, and an eligible row that comes later
than the watermark is dropped. Only if all copies of an id arrive within the delay and in the order
of seq are the results the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from perigon.config import DEFAULT, Config
from perigon.operators import ingest


def observation_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def accepted_stream(obs: DataFrame, delay: str = "7 days", config: Config = DEFAULT) -> DataFrame:
    """Eligible rows, the first of each id within the watermark's delay. obs has an event time `arrived`."""
    wild, placed, named, repaired = ingest.eligible(config)
    good = obs.filter(wild & placed & named).withColumn("taxon_genus_name", repaired)
    return good.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["id"])


def daily_counts(accepted: DataFrame) -> DataFrame:
    """Accepted rows by arrival day and privacy, for a stream with the watermark set."""
    return accepted.groupBy(F.window("arrived", "1 day").alias("day"), "geoprivacy").agg(F.count(F.lit(1)).alias("n")).select(F.col("day.start").alias("day"), "geoprivacy", "n")
