"""Numbers and ranks of groups that are spread over cells."""

import random

from pyspark.sql import functions as F

from perigon.functions import ordering
from perigon.operators import rankings
from tests.helpers import observations


def test_numbers_and_ranks_against_sorting(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aaaaaaab"), rng.randint(1, 4), seq) for seq in rng.sample(range(1 << 22), 900)]
    df = spark.createDataFrame(rows, "g string, n bigint, seq bigint").repartition(5)
    for shift in (4, 16, 60):
        got = {r.seq: r.place for r in ordering.numbered(df, ["g"], "seq", shift=shift).collect()}
        assert got == {s: sum(h == g and t <= s for h, _, t in rows) for g, _, s in rows}
        got = {r.seq: r["rank"] for r in ordering.ranked(df, "n", "seq", shift=shift).collect()}
        assert got == {s: k + 1 for k, (_, _, s) in enumerate(sorted(rows, key=lambda r: (-r[1], -r[2])))}


def test_a_hot_group_is_spread(spark):
    """A poster with all rows is numbered in many cells, by windows that no poster is a key of alone."""
    df = spark.range(500_000).selectExpr("'a' as user_id", "'b' as user_login", "id as seq", "cast(id as string) as id")
    df = df.withColumn("user_id", F.when(F.col("seq") >= 0, "a"))  # no constant that the plan could fold
    tags = rankings.poster_tags(df)
    assert tags.selectExpr("sum(place)", "max(place)", "count(distinct place)").first() == (500_000 * 500_001 // 2, 500_000, 500_000)
    sizes = ordering.numbered(df, ["user_id", "user_login"], "seq").selectExpr("shiftright(seq, 16) as cell").groupBy("cell").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) == 1 << 16
    plan = tags._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" in plan and "cell__" in plan and "collect_list" not in plan


def test_posters_have_all_tags_in_order(spark):
    """Tags of a poster from many cells, in the order of seq whatever the cells' own order; rows without an id have no tag."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), None if seq % 9 == 0 else str(seq % 7), seq) for seq in rng.sample(range(-(1 << 20), 1 << 22), 700)] + [("c", None, 5)]
    df = spark.createDataFrame([(u, "l", i, s) for u, i, s in rows], "user_id string, user_login string, id string, seq bigint").repartition(5)
    want = {}
    for user, name, seq in sorted(rows, key=lambda r: r[2]):
        n, first, tags = want.setdefault(user, (0, seq, []))
        want[user] = n + 1, first, tags + [f"i{name}"] * (name is not None)
    got = rankings.posters(df)
    assert {r.user_id: (r.n, r.first_seq, r.tags) for r in got.collect()} == {u: (n, first, ",".join(tags) or None) for u, (n, first, tags) in want.items()}
    assert "cell" in got._jdf.queryExecution().executedPlan().toString()


def test_ranks_scan_once_and_start_nothing(spark):
    obs = observations(spark, [{"user_id": str(k % 3)} for k in range(9)])
    obs.write.mode("overwrite").format("noop").save()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
        ranks = rankings.ranked(rankings.poster_counts(obs))
        assert sorted(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == sorted(jobs)
        plan = ranks._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # every branch but one starts from an exchange that is there already
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("ReusedExchange") >= 1
