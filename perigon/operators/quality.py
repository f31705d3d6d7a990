"""Data-quality and privacy report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigon.config import DEFAULT, Config
from perigon.functions.names import percent
from perigon.operators import ingest


def counters() -> list[Column]:
    """Aggregates over rows of the gate (all of them, with `reason`, `seen` and `wild`), by which the report is made."""
    ok = F.col("reason").isNull()
    private = F.col("wild") & ~F.col("seen") & (F.col("geoprivacy") == "private")
    bare = private & ((F.col("latitude") == "") | (F.col("longitude") == ""))
    return [
        F.count_if(ok).alias("total"),
        F.count_if(private).alias("private"),
        F.count_if(bare).alias("bare"),
        F.count_if(ok & (F.col("coordinates_obscured") == "true")).alias("obscured"),
        F.count_if(ok & (F.col("taxon_species_name") == "")).alias("genus_only"),
        F.count_if(ok & (F.col("quality_grade") == "research")).alias("research"),
    ]


def report(one: DataFrame) -> DataFrame:
    """metric, value, denominator and percentage (null for a denominator of 0) from the one row of the counters."""
    total, all_private = F.col("total"), F.col("total") + F.col("bare")
    lines = [
        ("accepted", total, total), ("private", F.col("private"), all_private), ("private_without_coordinates", F.col("bare"), all_private),
        ("obscured", F.col("obscured"), total), ("not_obscured", total - F.col("obscured"), total), ("genus_only", F.col("genus_only"), total), ("research_grade", F.col("research"), total),
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("bigint").alias("value"), d.cast("bigint").alias("denominator")) for m, v, d in lines])).alias("r")
    return one.select(rows).select("r.*").withColumn("pct", percent(F.col("value"), F.col("denominator")))


def summary(obs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The report from one pass over the gate."""
    return report(ingest.gated(obs, config).agg(*counters()))


def value_domains(accepted: DataFrame) -> DataFrame:
    """Distinct values of the coded columns, with their counts and first row."""
    columns = ["quality_grade", "geoprivacy", "taxon_geoprivacy", "captive_cultivated"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("p")
    return accepted.select(pairs, "seq").groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def taxa_obscured(accepted: DataFrame) -> DataFrame:
    """Distinct taxa with and without obscuring; the percentage is of the sum of both, as reported, beside the true union."""
    name = F.col("scientific_name")
    hidden = F.count_distinct(F.when(F.col("taxon_geoprivacy") == "obscured", name)).alias("obscured_taxa")
    shown = F.count_distinct(F.when(F.col("taxon_geoprivacy") != "obscured", name)).alias("unobscured_taxa")
    one = accepted.agg(hidden, shown, F.count_distinct(name).alias("distinct_taxa"))
    return one.withColumn("pct_obscured", percent(F.col("obscured_taxa"), F.col("obscured_taxa") + F.col("unobscured_taxa")))
