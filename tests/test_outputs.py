"""One run: the gate once, all outputs from its table."""

import shutil

import pytest
from pyspark.sql import functions as F

from perigon.config import Config
from perigon.operators import exports, ingest, outputs, quality, rankings, trajectory
from perigon.sources import events

CONFIG = Config(focus_species="Genus_click sp4", frequent_posts=20)


@pytest.fixture(scope="module")
def gated(spark, tmp_path_factory):
    """Observations that are gone once the gate is passed: whatever comes after cannot work it out again."""
    source = str(tmp_path_factory.mktemp("obs") / "o")
    events.observations(spark, "/root/testdata/sf0.001").write.parquet(source)
    obs = spark.read.parquet(source)
    want = {"summary": sorted(map(tuple, quality.summary(obs, CONFIG).collect())), "accepted": sorted(r.seq for r in ingest.accepted(obs, CONFIG).collect()), "rejects": sorted(map(tuple, ingest.rejects(obs, CONFIG).collect()))}
    found = outputs.pass_gate(obs, str(tmp_path_factory.mktemp("gate") / "g"), CONFIG, buckets=6)
    shutil.rmtree(source)
    return found, want


def test_counters_and_rows(gated):
    found, want = gated
    assert sorted(map(tuple, found.summary().collect())) == want["summary"]
    assert sorted(r.seq for r in found.accepted.collect()) == want["accepted"] and sorted(map(tuple, found.rejects.collect())) == want["rejects"]
    assert found.private_counters()["private"] == found.counters["private"] > 0


def test_walks_need_no_exchange(spark, gated):
    found, _ = gated
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dated = trajectory.rows(found.accepted, CONFIG)
        plan = trajectory.walked(dated)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("FileScan") == 1
        plan = trajectory.histogram(dated)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("Window")  # counts of people only
        people = rankings.selected_people(found.accepted, ["3", "1", "3"], CONFIG)
        plan = outputs.of_people(found.accepted, people, ["3", "1", "3"])._jdf.queryExecution().executedPlan().toString()
        assert "In(user_id, [1,3])" in plan or "In(user_id, [3,1])" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_listed_twice(gated):
    found, _ = gated
    walks = outputs.person_walks(found.accepted, ["3", "1", "3"], CONFIG)
    own = trajectory.walked(trajectory.rows(found.accepted, CONFIG)).filter("user_id = '3'").count()
    assert own and walks.filter("person_rank = 1").count() == own == walks.filter("person_rank = 3").count() and walks.filter("person_rank = 2 and user_id <> '1'").count() == 0


def test_all_outputs(spark, gated, tmp_path):
    found, _ = gated
    outputs.write_all(found, str(tmp_path), CONFIG)
    names = {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert {f"slices/{s}.tsv" for s in exports.slice_predicates(CONFIG)} <= names
    assert {f"{t}.{e}" for t in ("precise", "obscured") for e in ("gpx", "kml", "kmz")} <= names
    assert {"clean.csv", "posters.csv", "summary.csv", "rejects.csv", "values.csv", "taxa.csv", "half-of-posts.csv", "low-contributors.csv", "power-laws.csv", "power-law-posters-compared.csv", "frequent-posters.log"} <= names
    assert {f"charts/{c}.{e}" for c in outputs.charts.LAYOUTS for e in ("svg", "html")} <= names
    people = rankings.selected_people(found.accepted, config=CONFIG).count()
    assert people and sum(n.startswith("people/profile_") for n in names) == 3 * people
    assert not [n for n in names if "_staging" in n]
    lines = (tmp_path / "summary.csv").read_text().splitlines()
    assert lines[0] == "metric,value,denominator,pct,line" and lines[1].startswith(f"accepted,{found.counters['total']},")
    assert len((tmp_path / "power-laws.csv").read_text().splitlines()) == 5
    assert len((tmp_path / "slices/all.tsv").read_text().splitlines()) == found.counters["total"]
    assert (tmp_path / "frequent-posters.log").read_text().count("active from") == people


def test_a_day_that_a_third_of_the_rows_have_is_many_buckets(spark, tmp_path):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "1").otherwise(F.col("id").cast("string")).alias("user_id"), F.concat(F.lit("2020-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")).alias("observed_on"))
    parts = rows.repartition(16, *outputs.WALK).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 3000 / 4
