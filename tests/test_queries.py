"""Each registered query of the observation engine against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from perigon.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return base


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, database, name):
    got = catalogue.QUERIES[name](spark, SF)
    cursor = database.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted((tuple(r) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == want


def test_entry_and_registry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries()) and set(catalogue.QUERIES) <= set(driver.queries())


def test_walk_takes_one_exchange_after_the_gate(spark):
    from perigon.operators import trajectory
    from tests.helpers import observations

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = trajectory.walked(trajectory.rows(observations(spark, [{}])))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
        plan = catalogue.heatmap_slices(spark, SF)._jdf.queryExecution().executedPlan().toString()
        # all slices in one scan, besides the narrow one that finds repeated ids; rows are no window's partition
        assert plan.count("FileScan parquet") == 2 and "Window" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rounding_next_to_a_half(spark, database):
    """Numbers whose text ends in a 5 and their neighbours, rounded as DuckDB does."""
    halves = [(k + 0.5) / 1e4 for k in range(40_001, 700_000_000, 233_333)]
    numbers = [y for x in halves for y in (x, math.nextafter(x, 0), math.nextafter(x, 1e9))]
    got = [r.x for r in catalogue._rounded(spark.createDataFrame([(k, x) for k, x in enumerate(numbers)], "k int, x double"), x=4).orderBy("k").collect()]
    assert got == [database.execute("SELECT round(?::DOUBLE, 4)", [x]).fetchone()[0] for x in numbers]
