"""Data of the charts, as tidy rows, and JSON specifications made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigon.config import BAR, BLACK, CLASSES, DEFAULT, GRAY, WHITE, Config
from perigon.functions import names
from perigon.operators import rankings, trajectory


def species_bars(accepted: DataFrame, by: str = "name") -> DataFrame:
    """Bars of species counts: order 1 is drawn lowest; alphabetical from the end of the alphabet, or by count."""
    counts = rankings.ranked(rankings.species_counts(accepted))
    label = names.unclassified_label(F.col("scientific_name"))
    rows = counts.select("scientific_name", label.alias("label"), "n", "first_seq", "rank")
    if by == "name":
        return rows.select("scientific_name", "label", "n", _annotation().alias("annotation"))
    return rows.select("scientific_name", "label", "n", "rank", _annotation().alias("annotation"))


def _annotation() -> Column:
    """Where the count is written: two units beyond the bar's end."""
    return F.struct((F.col("n") + 2).alias("x"), F.col("n").cast("string").alias("text"))


def species_line(accepted: DataFrame) -> DataFrame:
    """Rank-frequency points of names with at least two words."""
    counts = rankings.species_counts(accepted).filter(names.words(F.col("scientific_name")) != 1)
    return rankings.ranked(counts).select("rank", "n", "scientific_name")


def poster_line(accepted: DataFrame) -> DataFrame:
    return rankings.ranked(rankings.poster_counts(accepted)).select("rank", "n", "user_id", "user_login")


def poster_bars(accepted: DataFrame, config: Config = DEFAULT, top_only: bool = False) -> DataFrame:
    rows = rankings.top_posters(accepted, config) if top_only else rankings.ranked(rankings.poster_counts(accepted))
    return rows.select("rank", F.concat_ws("-", "user_id", "user_login").alias("key"), "n", _annotation().alias("annotation"))


def log_axis(rows: DataFrame) -> DataFrame:
    """Upper bounds of the two logarithmic axes."""
    return rows.agg((F.log10(F.max("rank")) + 0.1).alias("x_high"), (F.log10(F.max("n")) + 0.1).alias("y_high"))


#: Shapes below the histogram's bars: slot, shape, fill, line, line width, left and right edge in pixels from the slot's
#: middle. A number as colour is a colour of the palette.
GLYPHS = (
    (0, "rect", BLACK, BLACK, 0, -23.0, -3.0),
    (0, "circle", BLACK, BLACK, 0, 3.0, 23.0),
    (1, "rect", WHITE, BLACK, 1, -23.0, -3.0),
    (1, "circle", WHITE, BLACK, 1, 3.0, 23.0),
    (3, "rect", BLACK, BLACK, 0, -23.0, -3.0),
    (3, "rect", WHITE, BLACK, 1, 3.0, 23.0),
    (4, "circle", BLACK, BLACK, 0, -23.0, -3.0),
    (4, "circle", WHITE, BLACK, 1, 3.0, 23.0),
    (6, "rect", GRAY, GRAY, 0, -23.0, -3.0),
    (6, "circle", GRAY, GRAY, 0, 3.0, 23.0),
    (7, "rect", 7, 7, 0, -10.0, 10.0),
    (8, "rect", 0, 0, 0, -10.0, 10.0),
    (9, "rect", 1, 1, 0, -10.0, 10.0),
    (10, "rect", 2, 2, 0, -10.0, 10.0),
    (11, "rect", 3, 3, 0, -10.0, 10.0),
    (12, "rect", 4, 4, 0, -10.0, 10.0),
    (13, "rect", 5, 5, 0, -10.0, 10.0),
    (14, "rect", 6, 6, 0, -10.0, 10.0),
)
#: Upper and lower edge of all of them.
GLYPH_EDGES = (-30.0, -10.0)


def glyphs(config: Config = DEFAULT) -> list[dict]:
    """The shapes of GLYPHS with the palette's colours."""

    def colour(c: str | int) -> str:
        return c if isinstance(c, str) else config.palette[c]

    low, high = GLYPH_EDGES
    return [dict(slot=slot, shape=shape, fill=colour(fill), line=colour(line), width=width, x0=x0, x1=x1, y0=low, y1=high) for slot, shape, fill, line, width, x0, x1 in GLYPHS]


def bar_colours(config: Config = DEFAULT) -> list[str]:
    return [BAR] * 6 + [GRAY if colour is None else config.palette[colour] for _, colour in CLASSES]


def file_label(rank: Column, label: Column) -> Column:
    """Rank with at least two digits, and the label without @."""
    number = F.when(rank < 10, F.concat(F.lit("0"), rank.cast("string"))).otherwise(rank.cast("string"))
    return F.concat(number, F.lit("-"), F.replace(label, F.lit("@"), F.lit("_")))


def histogram_spec(histogram: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A JSON chart for each person: bars, colours, ticks and glyphs."""
    shapes = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in g.items()]) for g in glyphs(config)])
    spec = F.struct(F.lit(1000).alias("width"), F.lit(700).alias("height"), "bars", F.array(*[F.lit(c) for c in bar_colours(config)]).alias("colours"), "ticks", shapes.alias("shapes"))
    vector = trajectory.histogram_vector(histogram).join(trajectory.histogram_ticks(histogram), "user_id")
    return vector.select("user_id", F.to_json(spec).alias("spec"))


def profile_spec(markers: DataFrame, wide: bool = False) -> DataFrame:
    """A JSON chart for each day of a person: its point and the boxes laid out from it. Days are rows, so that no row holds a person."""
    box = F.struct("rn", "kind", "shape", "fill", "line_color", "line_width", "x0", "x1", "y0", "y1")
    boxes = F.array_sort(F.collect_list(box))
    per_day = markers.groupBy("user_id", "day", "day_idx").agg(boxes.alias("markers"))
    spec = F.struct(F.lit(1600 if wide else 1200).alias("width"), F.lit(1200).alias("height"), F.col("day").alias("x"), F.col("day_idx").alias("y"), "markers")
    return per_day.select("user_id", "day", "day_idx", F.to_json(spec).alias("spec"))


def rank_spec(rows: DataFrame, title: str, log: bool = False) -> DataFrame:
    """JSON rows of a rank chart, one for each point, in the form {title, x, y, log}."""
    return rows.select("rank", F.to_json(F.struct(F.lit(title).alias("title"), F.col("rank").alias("x"), F.col("n").alias("y"), F.lit(log).alias("log"))).alias("spec"))


def bar_spec(rows: DataFrame, title: str, key: str = "key") -> DataFrame:
    """JSON rows of a bar chart, one for each bar, with its annotation."""
    return rows.select("rank", F.to_json(F.struct(F.lit(title).alias("title"), F.col(key).alias("y"), F.col("n").alias("x"), "annotation")).alias("spec"))


def write_html(spec_rows: DataFrame, path: str, title: str) -> None:
    """A static page per part of the data: the specifications as JSON lines in a script element."""
    safe = F.replace("spec", F.lit("<"), F.lit("\\u003c"))
    head = f'<!DOCTYPE html><meta charset="utf-8"><title>{title}</title>'
    line = F.concat(F.lit('<script type="application/json">'), safe, F.lit("</script>"))
    spec_rows.select(line.alias("line")).write.text(path)
    spec_rows.sparkSession.range(1).select(F.lit(head).alias("line")).write.mode("append").text(path)
