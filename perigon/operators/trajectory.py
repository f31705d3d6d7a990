"""Motion plausibility profiles: each observation of a person's day against the one before it.

All of a day's state (the anchor that distances are measured from, the run of obscured observations
that wait for a place, the horizontal offset) is a window over that day, so a person with very many
observations is spread over days; only the numbering of days looks at a person as a whole, and it
looks at distinct days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perigon.config import BLACK, CLASSES, DEFAULT, GRAY, OUTLINE, WHITE, Config
from perigon.functions import geo, names
from perigon.operators import documents


#: Spacings are added up in units of 1/UNITS pixel.
UNITS = float(1 << 20)


def rows(accepted: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Dated observations: tag, day, clock, seconds since 1970 (the clock on the local date), place and flags."""
    year = F.expr("try_cast(split_part(observed_on, '-', 1) AS int)")
    dated = accepted.filter((F.col("observed_on") != "") & (year > config.first_year_after))
    clock = names.clock(F.col("time_observed_at"))
    seconds = F.datediff(F.to_date("observed_on"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
    for k, unit in ((1, 3600), (2, 60), (3, 1)):
        seconds = seconds + F.split_part(F.col("clock"), F.lit(":"), F.lit(k)).cast("bigint") * unit
    hidden = F.col("coordinates_obscured") == "true"
    return dated.withColumn("clock", clock).select(
        "user_id", "user_login", "seq", "id",
        F.concat(F.when(hidden, "iN-o").otherwise("iN-p"), "id").alias("tag"),
        F.col("observed_on").alias("day"), "clock", seconds.alias("at"), F.col("time_observed_at").alias("observed"),
        "lat", "lon", F.col("coordinates_obscured").alias("obscured"), (F.col("time_observed_at") != "").alias("timed"),
    )


def _day():
    return Window.partitionBy("user_id", "day").orderBy("clock", "seq")


def _before():
    return _day().rowsBetween(Window.unboundedPreceding, -1)


def walked(dated: DataFrame) -> DataFrame:
    """Dated observations with rn (order in the day), elapsed, metres, kmh from the anchor, and cls.

    The first row of a day is an anchor even if obscured; later anchors are the precise rows. The
    class of a day's first precise row is `first`; obscured rows have the class `obscured`.
    """
    first = F.col("rn") == 1
    known = dated.withColumn("rn", F.row_number().over(_day())).withColumns(
        {
            "placed": F.when(first, F.col("obscured") != "true").otherwise(F.col("obscured") == "false"),
            "anchor": first | (F.col("obscured") == "false"),
        }
    )
    anchor = F.last(F.when(F.col("anchor"), F.struct("lat", "lon", "at")), ignorenulls=True).over(_before())
    placed_before = F.coalesce(F.count_if("placed").over(_before()), F.lit(0))
    back = known.withColumns({"from": anchor, "placed_before": placed_before})
    measured = F.col("anchor") & (F.col("rn") > 1)
    back = back.withColumn("elapsed", F.when(measured, (F.col("at") - F.col("from.at")).cast("double")))
    back = back.withColumn("metres", F.when(measured, geo.great_circle(F.col("lat"), F.col("lon"), F.col("from.lat"), F.col("from.lon"))))
    back = back.withColumn("kmh", F.when(measured, geo.speed_kmh(F.col("metres"), F.col("elapsed"))))
    cls = (
        F.when(first, F.when(F.col("placed"), "first").otherwise("obscured"))
        .when(~F.col("anchor"), "obscured")
        .when(F.col("placed_before") == 0, "first")
        .otherwise(geo.plausibility(F.col("kmh"), F.col("elapsed")))
    )
    return back.withColumn("cls", cls)


def days(dated: DataFrame) -> DataFrame:
    """Each person's distinct days with their number and observations."""
    per_day = dated.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    return per_day.withColumn("day_idx", F.row_number().over(Window.partitionBy("user_id").orderBy("day")).cast("bigint"))


def histogram(dated: DataFrame) -> DataFrame:
    """Per person: precise and obscured, with and without time, and the nine plausibility classes."""
    hidden = F.col("obscured") == "true"
    counts = [F.count_if(~hidden).alias("precise"), F.count_if(hidden).alias("obscured"), F.count_if("timed").alias("with_time"), F.count_if(~F.col("timed")).alias("without_time")]
    return walked(dated).groupBy("user_id").agg(*counts, *[F.count_if(F.col("cls") == c).alias(f"cls_{c}") for c, _ in CLASSES])


def histogram_vector(histogram: DataFrame) -> DataFrame:
    """The fifteen bars of each person (two spacers), and the control sums."""
    bars = ["precise", "obscured", None, "with_time", "without_time", None, *[f"cls_{c}" for c, _ in CLASSES]]
    values = F.array(*[F.col(b) if b else F.lit(0).cast("bigint") for b in bars])
    classes = sum((F.col(f"cls_{c}") for c, _ in CLASSES), F.lit(0).cast("bigint"))
    return histogram.select("user_id", values.alias("bars"), (F.col("precise") + F.col("obscured")).alias("sum_places"), (F.col("with_time") + F.col("without_time")).alias("sum_times"), classes.alias("sum_classes"))


def histogram_ticks(histogram: DataFrame) -> DataFrame:
    """Unit and values of the count axis."""
    total = F.col("precise") + F.col("obscured")
    unit = F.when(total > 400, 100).when(total > 200, 50).when(total > 100, 25).when(total > 80, 20).otherwise(10).cast("bigint")
    n = F.ceil(total / unit).cast("bigint")
    ticks = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda k: k * unit)).otherwise(F.array().cast("array<bigint>"))
    return histogram.select("user_id", total.alias("total"), unit.alias("unit"), ticks.alias("ticks"))


def summary(accepted: DataFrame, dated: DataFrame) -> DataFrame:
    """Per person: label (login of the last accepted row), range and number of days, observations, rejected dates, axis choices."""
    everyone = accepted.groupBy("user_id").agg(F.max_by("user_login", "seq").alias("label"), F.count(F.lit(1)).alias("accepted"))
    active = dated.groupBy("user_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_distinct("day").alias("days"), F.count(F.lit(1)).alias("observations"))
    joined = everyone.join(active, "user_id", "left").fillna(0, ["days", "observations"])
    first, last = F.split_part("first_day", F.lit("-"), F.lit(1)).cast("bigint"), F.split_part("last_day", F.lit("-"), F.lit(1)).cast("bigint")
    return joined.select(
        "user_id", "label", "first_day", "last_day", "days", "observations", (F.col("accepted") - F.col("observations")).alias("missed"),
        F.coalesce(last - first + 1, F.lit(0)).alias("years"), F.when(last == first, "%m/%Y").otherwise("%Y").alias("tick_format"), F.lit(7).cast("bigint").alias("ticks"),
        F.when(F.col("days") > 95, 20).otherwise(0).cast("bigint").alias("margin_extra"),
    )


def markers(dated: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One marker per observation: day number, kind, shape, colours and box in pixels from the day's point.

    Obscured rows and the precise row that ends their run share the logarithmic spacing of the
    distance that the run covers; so do the rows of a run that the day ends.
    """
    walk = walked(dated).withColumn("run", F.coalesce(F.count_if("anchor").over(_before()), F.lit(0)))
    run = Window.partitionBy("user_id", "day", "run")
    ordered = run.orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.last(F.struct("lat", "lon")).over(ordered)
    spaced = walk.withColumns({"end": whole, "share": F.count(F.lit(1)).over(run.orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    span = geo.great_circle(F.col("end.lat"), F.col("end.lon"), F.col("from.lat"), F.col("from.lon"))
    spaced = spaced.withColumn("spacing", F.when(F.col("rn") > 1, geo.log_spacing(span) / F.col("share")).otherwise(0.0))
    first = F.col("rn") == 1
    # a running sum of doubles drifts on a long day, by more than rounding bears: whole units are added as whole numbers, the rest of each beside them
    spaced = spaced.withColumn("units", F.floor(F.col("spacing") * UNITS)).withColumn("rest", F.col("spacing") * UNITS - F.col("units"))
    so_far = _day().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = (F.sum("units").over(so_far) + F.sum("rest").over(so_far)) / UNITS + config.marker * (F.col("rn") - 2)
    spaced = spaced.withColumn("offset", F.when(first, 0.0).otherwise(offset))
    fill = F.when(F.col("cls") == "obscured", WHITE).when(F.col("cls") == "first", GRAY)
    for name, colour in CLASSES:
        if colour is not None:
            fill = fill.when(F.col("cls") == name, config.palette[colour])
    blank = F.col("cls") == "obscured"
    line = F.when(blank & first, BLACK).when(blank, OUTLINE).otherwise(fill)
    shape = F.when(F.col("clock") == "00:00:00", "circle").when(first, "square").otherwise("rect")
    size = float(config.marker)
    numbered = spaced.join(days(dated).select("user_id", "day", "day_idx"), ["user_id", "day"])
    return numbered.select(
        "user_id", "day_idx", "day", F.col("rn").cast("bigint").alias("rn"), "tag", "cls", F.when(first, "first").otherwise("inner").alias("kind"), shape.alias("shape"),
        fill.alias("fill"), line.alias("line_color"), F.when(blank, 1).otherwise(0).cast("bigint").alias("line_width"), "offset",
        (F.col("offset") + size / 2).alias("x0"), (F.col("offset") + size * 1.5).alias("x1"), F.lit(-size / 2).alias("y0"), F.lit(size / 2).alias("y1"),
    )


def log_lines(dated: DataFrame) -> DataFrame:
    """One line per observation: first of the day, obscured, or with elapsed seconds, metres and km/h."""
    head = F.concat_ws(", ", "tag", F.col("lat").cast("string"), F.col("lon").cast("string"), F.replace("day", F.lit("-"), F.lit("/")), "clock")
    tail = F.concat(F.format_string("%.1f", "elapsed"), F.lit("s, "), F.format_string("%.1f", F.round("metres", 1)), F.lit("m, "), F.format_string("%.1f", F.round("kmh", 1)), F.lit("km/h"))
    what = F.when(F.col("rn") == 1, "first entry of the day").when(~F.col("anchor"), "obscured").otherwise(tail)
    return walked(dated).select("user_id", "day", "clock", "seq", F.concat(head, F.lit(", "), what).alias("line"))


def write_log(people: DataFrame, accepted: DataFrame, folder: str, config: Config = DEFAULT, name: str = "frequent-posters.log") -> None:
    """The log of the selected people as one file, a banner before each, in the order of their rank."""
    dated = rows(accepted, config).join(people.select("user_id").distinct(), "user_id", "left_semi")
    rule = "=" * 28
    banner = summary(accepted, dated).filter(F.col("days") > 0).select(
        "user_id", F.lit("").alias("day"), F.lit("").alias("clock"), F.lit(-1).cast("bigint").alias("seq"),
        F.concat(F.lit(rule + "\n"), "label", F.lit(", active from "), F.replace("first_day", F.lit("-"), F.lit("/")), F.lit(" to "), F.replace("last_day", F.lit("-"), F.lit("/")), F.lit("\n" + rule)).alias("line"),
    )
    lines = people.join(log_lines(dated).unionByName(banner), "user_id").withColumn("file", F.lit(name)).withColumnRenamed("line", "element")
    documents.write_documents(lines, folder, ["person_rank", "day", "clock", "seq"], names=[name])
