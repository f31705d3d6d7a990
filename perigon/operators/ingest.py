"""Ordered quality gate with first-accepted de-duplication.

A row is eligible when it is not captive, has both coordinates and a genus (a family-level name of
the monotypic family stands for its genus). Of the eligible rows of an id the one that came first is
accepted; a copy that was rejected before does not stand in the way of a later good one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigon.config import DEFAULT, Config


def eligible(config: Config = DEFAULT) -> tuple[Column, Column, Column, Column]:
    """Conditions on a single row (wild, placed, named), and its genus, repaired where the name stands for it."""
    family, genus = config.monotypic
    wild = F.coalesce(F.col("captive_cultivated"), F.lit("")) != "true"
    placed = (F.col("latitude") != "") & (F.col("longitude") != "")
    named = (F.col("taxon_genus_name") != "") | (F.col("scientific_name") == family)
    repaired = F.when((F.col("taxon_genus_name") == "") & (F.col("scientific_name") == family), genus).otherwise(F.col("taxon_genus_name"))
    return wild, placed, named, repaired


def repeated_ids(obs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """first_id and first_seq, its first eligible row, of the ids that more than one row has."""
    wild, placed, named, _ = eligible(config)
    per_id = obs.groupBy(F.col("id").alias("first_id")).agg(F.min(F.when(wild & placed & named, F.col("seq"))).alias("first_seq"), F.count(F.lit(1)).alias("n"))
    return per_id.filter((F.col("n") > 1) & F.col("first_seq").isNotNull()).drop("n")


def gated(obs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Every row with `reason` (null: accepted) and `seen` (an accepted row of the id came before).

    The first eligible row of an id is a minimum, taken in each task before anything is exchanged, so an id that very
    many rows have (blank ids of short rows) is a few partial results. Only ids that occur again are looked up, and the
    rows stay where they are while these are few enough to be sent to them; else rows are exchanged by id
    and Spark splits the partitions of ids that very many rows have.
    """
    wild, placed, named, repaired = eligible(config)
    found = obs.join(repeated_ids(obs, config), F.col("id").eqNullSafe(F.col("first_id")), "left")
    seen = F.coalesce(F.col("seq") > F.col("first_seq"), F.lit(False))
    reason = F.when(~wild, "captive").when(seen, "duplicate").when(~placed, "no coordinates").when(~named, "no genus")
    return found.withColumns({"reason": reason, "seen": seen, "wild": wild, "placed": placed, "taxon_genus_name": repaired}).drop("first_id", "first_seq")


def accepted(obs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    return gated(obs, config).filter(F.col("reason").isNull()).drop("reason", "seen", "wild", "placed")


def rejects(obs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Rows that the gate turned away, and why."""
    return gated(obs, config).filter(F.col("reason").isNotNull()).select("seq", "id", "reason", "scientific_name")


def private_counters(obs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Private rows that reached the coordinate check, and those of them without coordinates."""
    private = F.col("wild") & ~F.col("seen") & (F.col("geoprivacy") == "private")
    return gated(obs, config).agg(
        F.count_if(private).alias("private"),
        F.count_if(private & ((F.col("latitude") == "") | (F.col("longitude") == ""))).alias("private_without_coordinates"),
    )
