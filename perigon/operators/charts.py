"""General charts, drawn: rank-frequency lines and bars of species and posters, as SVG and as pages of their own.

A chart of any number of points is drawn from a bounded number: for each pixel along its axis of places (columns of a line,
rows of bars) the first, the last, the least and the largest point are kept (the M4 aggregation), which draw the same pixels as
all points do. So a chart has at most four points a pixel, and only these come together in a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigon.config import DEFAULT, Config
from perigon.operators import documents, figures, rankings
from perigon.operators.exports import escaped
from perigon.operators.svg import GRID, INK, Layout, decimal, hundredths

#: Sizes, margins and fonts of the charts, and the colour of lines and bars.
LAYOUTS = {
    "species-alphabetical": Layout(1200, 1600, 55, 5, 5, 25, 20),
    "species-count": Layout(1200, 1600, 55, 5, 5, 25, 20),
    "species-rank": Layout(1300, 1200, 115, 10, 10, 75, 40),
    "posters-top": Layout(1200, 1600, 150, 10, 10, 30, 20),
    "posters-rank": Layout(1300, 1200, 100, 10, 10, 55, 40),
    "posters-all": Layout(1200, 1600, 5, 5, 5, 25, 20),
}
BLUE = "rgb(55,126,184)"
LINES = ("species-rank", "posters-rank")
#: Charts without names beside the bars.
PLAIN = ("posters-all",)
PAGE_HEAD = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>circle,rect{{pointer-events:all}}circle:hover,rect:hover{{stroke:#000;stroke-width:2}}</style></head><body>'


@dataclass(frozen=True)
class Points:
    """Rows (place, label, n): places from 1 on; and how they are drawn."""

    rows: DataFrame
    chart: str

    @property
    def layout(self) -> Layout:
        return LAYOUTS[self.chart]

    @property
    def is_line(self) -> bool:
        return self.chart in LINES


def points(accepted: DataFrame, chart: str, config: Config = DEFAULT) -> Points:
    """What a chart draws: the place is the rank, or the row of the bar from the top."""
    if chart == "species-alphabetical":
        bars = figures.species_bars(accepted, "name")  # a row for each species
        rows = bars.select(F.row_number().over(Window.orderBy("scientific_name")).cast("bigint").alias("place"), "label", "n")
    elif chart == "species-count":
        rows = figures.species_bars(accepted, "count").select(F.col("rank").alias("place"), "label", "n")
    elif chart == "species-rank":
        rows = figures.species_line(accepted).select(F.col("rank").alias("place"), F.col("scientific_name").alias("label"), "n")
    else:
        ranked = rankings.ranked(rankings.poster_counts(accepted))
        ranked = ranked.filter(F.col("n") > config.top_posts) if chart == "posters-top" else ranked
        rows = ranked.select(F.col("rank").alias("place"), F.concat_ws("-", "user_id", "user_login").alias("label"), "n")
    return Points(rows, chart)


def _ends(rows: DataFrame) -> Column:
    """The largest place and n of all rows, as a subquery of one row."""
    return rows.agg(F.struct(F.max("place").alias("place"), F.max("n").alias("n"))).scalar()


def level_of_detail(rows: DataFrame, pixels: int, log: bool) -> DataFrame:
    """pixel, place, label, n and the ends of all rows: of the rows (place, label, n) the first, last, least and largest of each pixel.

    log: pixels divide the logarithm of the place, else the places. Of equal n the smaller place is taken.
    """
    across = F.col("place")
    if log:
        high = F.log10(F.col("ends.place"))
        pixel = F.when(high > 0, F.floor(F.log10(across) / high * (pixels - 1))).otherwise(0)
    else:
        pixel = F.floor((across - 1) * pixels / F.col("ends.place"))
    point = F.struct("place", "label", "n")
    dealt = rows.withColumn("ends", _ends(rows)).withColumn("pixel", pixel.cast("bigint"))
    kept = dealt.groupBy("pixel").agg(
        F.any_value("ends").alias("ends"), F.min(point).alias("a"), F.max(point).alias("b"),
        F.min_by(point, F.struct("n", "place")).alias("c"), F.max_by(point, F.struct(F.col("n"), -F.col("place"))).alias("d"),
    )
    return kept.select("pixel", "ends", F.explode(F.array_distinct(F.array("a", "b", "c", "d"))).alias("p")).select("pixel", "p.place", "p.label", "p.n", "ends")


def kept_points(drawn: Points) -> DataFrame:
    return level_of_detail(drawn.rows, drawn.layout.inner_width if drawn.is_line else drawn.layout.inner_height, drawn.is_line)


def _row(layer: int, at: Column, element: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    return [F.lit(layer).alias("layer"), at.cast("bigint").alias("at"), element.alias("element"), *[c.cast("bigint").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))]]


def _decades(ends: DataFrame, column: str, most: Column) -> DataFrame:
    return ends.select("ends", F.explode(F.sequence(F.lit(0), F.floor(most).cast("int"))).alias("k")).withColumn(column, F.pow(F.lit(10.0), F.col("k")).cast("bigint"))


def line_elements(kept: DataFrame, layout: Layout) -> DataFrame:
    """A rank-frequency line on two logarithmic axes, from the kept points."""
    left, top, base, right = layout.left, layout.top, layout.height - layout.bottom, layout.width - layout.right

    def x(place: Column) -> Column:
        high = F.log10(F.col("ends.place"))
        return hundredths(F.lit(float(left)) + F.when(high > 0, F.log10(place) / high * float(layout.inner_width)).otherwise(0.0))

    def y(n: Column) -> Column:
        return hundredths(F.lit(float(top)) + float(layout.inner_height) * (1 - F.log10(n) / (F.log10(F.col("ends.n")) + 0.1)))

    ends = kept.select("ends").limit(1)
    down = _decades(ends, "v", F.log10(F.col("ends.n")) + 0.1)
    py = y(F.col("v"))
    side = F.concat(F.lit(f'<path d="M{left} '), decimal(py), F.lit(f'H{right}" stroke="{GRID}"/><text x="{left - 6}" y="'), decimal(py), F.lit(f'" fill="{INK}" text-anchor="end" dominant-baseline="middle">'), F.col("v").cast("string"), F.lit("</text>"))
    across = _decades(ends, "v", F.log10(F.col("ends.place")))
    px = x(F.col("v"))
    below = F.concat(F.lit('<path d="M'), decimal(px), F.lit(f' {top}V{base}" stroke="{GRID}"/><text x="'), decimal(px), F.lit(f'" y="{layout.height - 8}" fill="{INK}" text-anchor="middle">'), F.col("v").cast("string"), F.lit("</text>"))
    axes = down.select(*_row(0, F.col("k"), side, F.lit(left * 100), py, F.lit(right * 100), py)).unionByName(across.select(*_row(0, F.col("k") + 1000, below, px, F.lit(top * 100), px, F.lit(base * 100))))
    following = F.lead(F.struct("place", "n")).over(Window.orderBy("place"))  # kept points only
    linked = kept.withColumn("next", following)
    px, py, qx, qy = x(F.col("place")), y(F.col("n")), x(F.col("next.place")), y(F.col("next.n"))
    link = F.concat(F.lit('<path d="M'), decimal(px), F.lit(" "), decimal(py), F.lit("L"), decimal(qx), F.lit(" "), decimal(qy), F.lit(f'" stroke="{BLUE}" stroke-width="4" stroke-linecap="round"/>'))
    lines = linked.filter(F.col("next").isNotNull()).select(*_row(1, F.col("place"), link, px, F.least(py, qy), qx, F.greatest(py, qy)))
    dot = F.concat(F.lit('<circle cx="'), decimal(px), F.lit('" cy="'), decimal(py), F.lit(f'" r="4" fill="{BLUE}"><title>'), F.col("place").cast("string"), F.lit(" "), escaped(F.col("label")), F.lit(": "), F.col("n").cast("string"), F.lit("</title></circle>"))
    dots = kept.select(*_row(2, F.col("place"), dot, px - 400, py - 400, px + 400, py + 400))
    return axes.unionByName(lines).unionByName(dots)


def bar_elements(kept: DataFrame, layout: Layout, labels: bool) -> DataFrame:
    """Bars with their counts, two units beyond their ends, from the kept points; the axis begins at 0 and goes to the largest count and a twentieth."""
    left, top, base = layout.left, layout.top, layout.height - layout.bottom
    unit = float(layout.inner_width) / (F.col("ends.n") * 1.05)

    def x(n: Column) -> Column:
        return hundredths(F.lit(float(left)) + n * unit)

    slot = F.lit(float(layout.inner_height)) / F.col("ends.place")
    y0 = hundredths(F.lit(float(top)) + (F.col("place") - 0.9) * slot)
    y1 = hundredths(F.lit(float(top)) + (F.col("place") - 0.1) * slot)
    middle = hundredths(F.lit(float(top)) + (F.col("place") - 0.5) * slot)
    font = hundredths(F.least(F.lit(20.0), 0.7 * slot))
    end = x(F.col("n").cast("double"))
    bar = F.concat(
        F.lit(f'<rect x="{left}" y="'), decimal(y0), F.lit('" width="'), decimal(end - left * 100), F.lit('" height="'), decimal(y1 - y0), F.lit(f'" fill="{BLUE}"><title>'), escaped(F.col("label")), F.lit(": "), F.col("n").cast("string"), F.lit("</title></rect>"),
        F.lit('<text x="'), decimal(x(F.col("n") + 2.0)), F.lit('" y="'), decimal(middle), F.lit('" font-size="'), decimal(font), F.lit(f'" fill="{INK}" dominant-baseline="middle">'), F.col("n").cast("string"), F.lit("</text>"),
        *([F.lit(f'<text x="{left - 4}" y="'), decimal(middle), F.lit('" font-size="'), decimal(font), F.lit(f'" fill="{INK}" text-anchor="end" dominant-baseline="middle">'), escaped(F.col("label")), F.lit("</text>")] if labels else []),
    )
    bars = kept.select(*_row(1, F.col("place"), bar, F.lit(left * 100), y0, end, y1))
    # at most seven numbers below, by steps of 1, 2 or 5 times a power of ten
    raw = F.col("ends.n") / 7.0
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = F.when(F.col("ends.n") <= 7, 1).otherwise(F.when(raw <= power, power).when(raw <= 2 * power, 2 * power).when(raw <= 5 * power, 5 * power).otherwise(10 * power)).cast("bigint")
    ticks = kept.select("ends").limit(1).withColumn("step", step).select("ends", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("ends.n") / F.col("step")).cast("bigint")), lambda k: k * F.col("step"))).alias("v"))
    px = x(F.col("v").cast("double"))
    below = F.concat(F.lit('<path d="M'), decimal(px), F.lit(f' {top}V{base}" stroke="'), F.when(F.col("v") == 0, INK).otherwise(GRID), F.lit('"/><text x="'), decimal(px), F.lit(f'" y="{layout.height - 4}" fill="{INK}" text-anchor="middle">'), F.col("v").cast("string"), F.lit("</text>"))
    return ticks.select(*_row(0, F.col("v"), below, px, F.lit(top * 100), px, F.lit(base * 100))).unionByName(bars)


def elements(accepted: DataFrame, chart: str, config: Config = DEFAULT) -> DataFrame:
    """layer, at, element and box (hundredths of a pixel) of a chart; no rows, no elements."""
    drawn = points(accepted, chart, config)
    kept = kept_points(drawn)
    return line_elements(kept, drawn.layout) if drawn.is_line else bar_elements(kept, drawn.layout, chart not in PLAIN)


def write(accepted: DataFrame, folder: str, which: tuple[str, ...] = tuple(LAYOUTS), config: Config = DEFAULT) -> None:
    """Each chart as an SVG file and as a page that needs nothing else: points and bars say what they are under the pointer."""
    for chart in which:
        layout = LAYOUTS[chart]
        head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{layout.width}" height="{layout.height}" viewBox="0 0 {layout.width} {layout.height}" font-family="sans-serif" font-size="{layout.font}" fill="none">'
        ends = {f"{chart}.svg": (head, "</svg>"), f"{chart}.html": (PAGE_HEAD.format(title=chart) + head, "</svg></body></html>")}
        rows = elements(accepted, chart, config).withColumn("file", F.explode(F.array(*map(F.lit, ends))))
        documents.write_documents(rows, folder, ["layer", "at"], {n: e[0] for n, e in ends.items()}, {n: e[1] for n, e in ends.items()}, list(ends))


def digests(rows: DataFrame) -> DataFrame:
    """Of each layer: its elements, the box around them, and SHA-256 of the sorted elements (at most four a pixel)."""
    box = [F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")]
    return rows.groupBy("layer").agg(F.count(F.lit(1)).alias("elements"), *[(c / 100.0).alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))], F.sha2(F.array_join(F.array_sort(F.collect_list("element")), "\n"), 256).alias("sha256"))
