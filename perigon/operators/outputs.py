"""One run from observations to all outputs: the gate is passed once, everything else begins from the table that it leaves.

While the gate's rows are written, named observations count them, so the report costs no pass of its own. The table has
accepted and rejected rows in buckets by (user_id, observed_on), in the order of a walk: the windows over a person's days need
no exchange, a person with very many days is many buckets, and people are found by their ids in the row groups' statistics.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from perigon.config import DEFAULT, Config
from perigon.functions import names
from perigon.operators import charts, documents, exports, ingest, powerlaw, quality, rankings, svg, trajectory

WALK = ("user_id", "observed_on")
#: People of a list that the scan is told of; more are found by the join alone.
MOST_PUSHED = 1000


@dataclass
class Gated:
    """The written table of the gate, what was counted on the way, and where it is."""

    rows: DataFrame
    counters: dict[str, int]
    path: str

    @property
    def accepted(self) -> DataFrame:
        return self.rows.filter(F.col("reason").isNull()).drop("reason", "seen", "wild", "placed")

    @property
    def rejects(self) -> DataFrame:
        return self.rows.filter(F.col("reason").isNotNull()).select("seq", "id", "reason", "scientific_name")

    def summary(self) -> DataFrame:
        """The quality report, from the counters."""
        spark = self.rows.sparkSession
        return quality.report(spark.createDataFrame([tuple(self.counters.values())], ", ".join(f"{k} bigint" for k in self.counters)))

    def private_counters(self) -> dict[str, int]:
        return {"private": self.counters["private"], "private_without_coordinates": self.counters["bare"]}


def pass_gate(obs: DataFrame, path: str, config: Config = DEFAULT, buckets: int | None = None) -> Gated:
    """Writes the gate's rows below the path and counts them on the way. buckets: as many as shuffle partitions, unless named.

    The table stays in the catalogue only while it is written and looked up, its files until the caller removes them.
    """
    spark = obs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = Observation(f"gate-{uuid.uuid4().hex}")
    name = f"perigon_gate_{uuid.uuid4().hex}"
    rows = ingest.gated(obs, config).observe(seen, *quality.counters())
    # dealt out as buckets are, so that a bucket is one file
    dealt = rows.repartition(n, *WALK).sortWithinPartitions(*WALK, "time_observed_at", "seq")
    dealt.write.bucketBy(n, *WALK).sortBy(*WALK, "time_observed_at", "seq").format("parquet").option("path", path).saveAsTable(name)
    try:
        return Gated(spark.table(name), {k: int(v) for k, v in seen.get.items()}, path)
    finally:
        spark.sql(f"DROP TABLE {name}")  # the files are the caller's


def of_people(accepted: DataFrame, people: DataFrame, listed: list[str] | None = None) -> DataFrame:
    """Accepted rows of the people; a list of reasonable length is also a predicate of the scan."""
    ids = people.select("user_id").distinct()
    rows = accepted.filter(F.col("user_id").isin([str(u) for u in dict.fromkeys(listed)])) if listed and len(listed) <= MOST_PUSHED else accepted
    return rows.join(ids, "user_id", "left_semi")


def person_walks(accepted: DataFrame, listed: list[str] | None = None, config: Config = DEFAULT) -> DataFrame:
    """The walk of each selected person, with the person's rank; who is listed twice walks twice, under each rank."""
    people = rankings.selected_people(accepted, listed, config)
    walk = trajectory.walked(trajectory.rows(of_people(accepted, people, listed), config))
    return people.join(walk, "user_id")


def _file(rows: DataFrame, name: str, order: list[str], cells: list[Column]) -> DataFrame:
    return rows.select(F.lit(name).alias("file"), *order, names.csv_line(cells).alias("element"))


def write_table(rows: DataFrame, folder: str, name: str, order: list[str]) -> None:
    """A CSV file with a header, rows by `order`."""
    documents.write_documents(_file(rows.select("*"), name, order, [F.col(f"`{c}`") for c in rows.columns]), folder, order, ",".join(rows.columns), names=[name])


def power_laws(accepted: DataFrame) -> DataFrame:
    """The fits of the report: species of at least two words (three lower bounds) and posters."""
    classified = rankings.species_counts(accepted).filter(names.words(F.col("scientific_name")) != 1)
    fits = [("species", "automatic", powerlaw.fit(classified)), ("species", "2", powerlaw.fit(classified, 2)), ("species", "1", powerlaw.fit(classified, 1)), ("posters", "automatic", powerlaw.fit(rankings.poster_counts(accepted)))]
    found = None
    for k, (series, bound, fit) in enumerate(fits):
        rows = fit.select(F.lit(k).alias("line"), F.lit(series).alias("series"), F.lit(bound).alias("bound"), "xmin", "n", "alpha", "sigma", "ks")
        found = rows if found is None else found.unionByName(rows)
    return found


def write_all(gated: Gated, folder: str, config: Config = DEFAULT, listed: list[str] | None = None, compat: bool = False) -> None:
    """All outputs below the folder: point sets, tracks, tables, the log, reports, charts and pictures of the selected people."""
    accepted = gated.accepted
    exports.write_slices(accepted, f"{folder}/slices", config)
    for precise, track in ((True, "precise"), (False, "obscured")):
        points = exports.waypoints(accepted, precise)
        exports.write_gpx(points, folder, f"{track}.gpx", compat)
        exports.write_kml(points, folder, f"{track}.kml")
        exports.write_kmz(points, folder, f"{track}.kmz")
    exports.write_clean(accepted, folder, config, compat)
    rankings.write_posters_csv(accepted, folder)
    write_table(gated.summary().withColumn("line", F.monotonically_increasing_id()), folder, "summary.csv", ["line"])
    write_table(gated.rejects, folder, "rejects.csv", ["seq"])
    write_table(quality.value_domains(accepted), folder, "values.csv", ["field", "first_seq"])
    write_table(quality.taxa_obscured(accepted), folder, "taxa.csv", ["obscured_taxa"])
    write_table(rankings.half_mass(rankings.poster_counts(accepted)), folder, "half-of-posts.csv", ["total"])
    write_table(rankings.low_contributors(rankings.poster_counts(accepted)), folder, "low-contributors.csv", ["at_most"])
    write_table(power_laws(accepted), folder, "power-laws.csv", ["line"])
    write_table(powerlaw.compared(rankings.poster_counts(accepted)), folder, "power-law-posters-compared.csv", ["alternative"])
    charts.write(accepted, f"{folder}/charts", config=config)
    people = rankings.selected_people(accepted, listed, config)
    own = of_people(accepted, people, listed)
    trajectory.write_log(people, own, folder, config)
    svg.write(people, own, f"{folder}/people", config=config)


def run(spark: SparkSession, obs: DataFrame, folder: str, config: Config = DEFAULT, listed: list[str] | None = None, compat: bool = False) -> Gated:
    """From observations to all outputs. The gate's table is `gate` below the folder, for further work."""
    gated = pass_gate(obs, f"{folder}/gate", config)
    write_all(gated, folder, config, listed, compat)
    return gated
