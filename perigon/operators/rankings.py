"""Posters and species: counts, ranks, half of the mass, thresholds.

Ranks and numbers come without sorting all rows, or all of a hot poster, in one task: see functions.ordering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigon.config import DEFAULT, Config
from perigon.functions import names, ordering
from perigon.operators import documents

#: Tags of a page.
PAGE = 1000


def poster_tags(accepted: DataFrame) -> DataFrame:
    """The observation tags of each poster as rows, numbered in input order; a poster of any size is many cells."""
    rows = ordering.numbered(accepted.select("user_id", "user_login", "seq", "id"), ["user_id", "user_login"], "seq")
    return rows.select("user_id", "user_login", "place", F.concat(F.lit("i"), "id").alias("tag"))


def tag_pages(accepted: DataFrame, size: int = PAGE) -> DataFrame:
    """user_id, user_login, page (from 0) and the tags of each page of `size` tags, in input order."""
    rows = poster_tags(accepted).withColumn("page", F.floor((F.col("place") - 1) / size).cast("bigint"))
    tags = F.array_sort(F.collect_list(F.struct("place", "tag")))
    return rows.groupBy("user_id", "user_login", "page").agg(F.transform(tags, lambda x: x["tag"]).alias("tags"))


def posters(accepted: DataFrame) -> DataFrame:
    """Posts of each (user_id, user_login), with the first row and all observation tags in input order, joined by commas.

    Tags are sorted and joined in cells of the order, so a task never sorts a poster; only the cells' texts meet in the poster's row.
    """
    key = ["user_id", "user_login"]
    tag = F.concat(F.lit("i"), "id")
    dealt = accepted.select(*key, "seq", tag.alias("tag"), F.shiftright("seq", ordering.SHIFT).alias("cell"))
    tags = F.array_sort(F.collect_list(F.when(F.col("tag").isNotNull(), F.struct("seq", "tag"))))
    cells = dealt.groupBy(*key, "cell").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), _joined(tags).alias("tag"))
    texts = F.array_sort(F.collect_list(F.when(F.col("tag").isNotNull(), F.struct("cell", "tag"))))
    return cells.groupBy(*key).agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"), _joined(texts).alias("tags"))


def _joined(tags: Column) -> Column:
    """The tags of an array of structs; null without any."""
    return F.nullif(F.array_join(F.transform(tags, lambda x: x["tag"]), ","), F.lit(""))


def poster_counts(accepted: DataFrame) -> DataFrame:
    return accepted.groupBy("user_id", "user_login").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def posters_csv(accepted: DataFrame) -> DataFrame:
    """user_id, its first login and that login's posts, with the order of first appearance."""
    first = accepted.groupBy("user_id").agg(F.min_by("user_login", "seq").alias("user_login"), F.min("seq").alias("seen"))
    return first.join(poster_counts(accepted), ["user_id", "user_login"]).select("user_id", "user_login", "n", F.col("seen").alias("first_seq"))


def write_posters_csv(accepted: DataFrame, folder: str, name: str = "posters.csv") -> None:
    """One headerless file in the order of first appearance; cells with commas, quotes or line breaks are quoted."""
    line = names.csv_line([F.col("user_id"), F.col("user_login"), F.col("n")])
    documents.write_documents(posters_csv(accepted).select(F.lit(name).alias("file"), "first_seq", line.alias("element")), folder, ["first_seq"], names=[name])


def species_counts(accepted: DataFrame) -> DataFrame:
    return accepted.groupBy("scientific_name").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def ranked(counts: DataFrame) -> DataFrame:
    """counts (n, first_seq, ...) with `rank`: 1 for the largest n; of equal n the later first_seq ranks first."""
    return ordering.ranked(counts, "n", "first_seq")


def half_mass(counts: DataFrame) -> DataFrame:
    """Fewest people with half of the posts, and the posts of them: the least frequent leave while more than half remains."""
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("c"))  # distinct counts only
    total, people = F.sum(F.col("n") * F.col("c")).over(Window.partitionBy()), F.sum("c").over(Window.partitionBy())
    below = F.coalesce(F.sum(F.col("n") * F.col("c")).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = sizes.select("n", "c", total.alias("total"), people.alias("people"), below.alias("below"))
    over = F.col("total") - F.col("below") - F.floor(F.col("total") / 2)
    leave = F.when(over > 0, F.least(F.col("c"), F.ceil(over / F.col("n")))).otherwise(0)
    return steps.withColumn("leave", leave).agg(
        (F.max("people") - F.sum("leave")).cast("bigint").alias("people"),
        (F.max("total") - F.sum(F.col("leave") * F.col("n"))).cast("bigint").alias("posts"),
        F.max("total").cast("bigint").alias("total"),
        F.max("people").cast("bigint").alias("posters"),
    )


def low_contributors(counts: DataFrame) -> DataFrame:
    """Posters with at most 5, 3, 2 and with 1 post: limit, people and their percentage of all."""
    one = counts.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("n") <= k).alias(f"n{k}") for k in (5, 3, 2, 1)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("at_most"), F.col(f"n{k}").alias("people")) for k in (5, 3, 2, 1)])).alias("r")
    return one.select(rows, "all").select("r.at_most", "r.people", names.percent(F.col("r.people"), F.col("all")).alias("pct"))


def top_posters(accepted: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Posters of more than `top_posts` posts, ranked."""
    return ranked(poster_counts(accepted)).filter(F.col("n") > config.top_posts)


def frequent_posters(accepted: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Posters of at least `frequent_posts` posts with their rank, the order of the profiles."""
    return ranked(poster_counts(accepted)).filter(F.col("n") >= config.frequent_posts)


def selected_people(accepted: DataFrame, listed: list[str] | None = None, config: Config = DEFAULT) -> DataFrame:
    """person_rank and user_id of the people to profile: a given list, or the frequent posters.

    A person listed twice, or frequent under two logins, appears twice.
    """
    if listed is not None:
        people = accepted.sparkSession.createDataFrame([(k + 1, str(u)) for k, u in enumerate(listed)], "person_rank bigint, user_id string")
        return people.join(accepted.select("user_id").distinct(), "user_id", "left_semi").select("person_rank", "user_id")
    return frequent_posters(accepted, config).select(F.col("rank").alias("person_rank"), "user_id")
