"""Checks that must hold for every table of observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigon.config import CLASSES, DEFAULT, Config
from perigon.operators import exports, rankings, trajectory


def checks(accepted: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """rule, the subjects that it was checked on, and those that break it; none do where coordinates_obscured is true or false."""
    dated = trajectory.rows(accepted, config)
    per_person = trajectory.histogram(dated).join(trajectory.summary(accepted, dated), "user_id")
    classes = sum((F.col(f"cls_{c}") for c, _ in CLASSES), F.lit(0))
    days = trajectory.walked(dated).groupBy("user_id", "day").agg(F.max(F.col("placed").cast("int")).alias("any")).groupBy("user_id").agg(F.sum("any").alias("precise_days"))
    everyone = accepted.groupBy("user_id").agg(F.count(F.lit(1)).alias("accepted"))
    per_person = per_person.join(days, "user_id").join(everyone, "user_id")
    rules = {
        "places are observations": F.col("precise") + F.col("obscured") == F.col("observations"),
        "times are observations": F.col("with_time") + F.col("without_time") == F.col("observations"),
        "classes are precise": classes == F.col("precise"),
        "first is days with a precise row": F.col("cls_first") == F.col("precise_days"),
        "dated and missed are accepted": F.col("observations") + F.col("missed") == F.col("accepted"),
    }
    counts = accepted.agg(*[F.count_if(p).alias(n) for n, p in exports.slice_predicates(config).items()])
    sums = {
        "precise and obscured are all": F.col("precise") + F.col("obscured") == F.col("all"),
        "taxon slices are all": F.col("taxon_empty") + F.col("taxon_open") + F.col("taxon_obscured") == F.col("all"),
        "privacy slices are all": F.col("geoprivacy_empty") + F.col("geoprivacy_obscured") + F.col("geoprivacy_private") == F.col("all"),
        "focus slices add up": F.col("focus_empty") + F.col("focus_open") == F.col("focus_empty_open"),
    }
    half = rankings.half_mass(rankings.poster_counts(accepted))
    halves = {"half of the mass": F.coalesce(F.col("posts") <= F.floor(F.col("total") / 2), F.lit(True))}
    return reduce(DataFrame.unionByName, [_checked(rows, own) for rows, own in ((per_person, rules), (counts, sums), (half, halves))])


def _checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One pass over the rows for all of their rules; a rule that cannot be decided is broken."""
    names = list(rules)
    one = rows.agg(F.count(F.lit(1)).alias("checked"), *[F.count_if(~F.coalesce(rules[n], F.lit(False))).alias(f"r{k}") for k, n in enumerate(names)])
    lines = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{k}").alias("broken")) for k, n in enumerate(names)])).alias("r")
    return one.select(lines, "checked").select("r.rule", "checked", "r.broken")
