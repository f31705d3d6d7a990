"""Profiles and histograms of people as SVG: elements laid out by column expressions, and one file for each person.

The scales of a person (days to pixels across, day numbers to pixels down) come from one row of the person's summary;
markers are placed by a join with it. Every element is a row, so a person of any number of observations is drawn
by as many tasks as hold their rows; `write` puts a person's elements together in a document.

A person without a valid date has no profile; a person that is selected twice (listed twice, or frequent under two logins) is
drawn twice, under each rank.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigon.config import DEFAULT, Config
from perigon.operators import documents, figures, trajectory
from perigon.operators.exports import escaped


@dataclass(frozen=True)
class Layout:
    width: int
    height: int
    left: int
    right: int
    top: int
    bottom: int
    font: int

    @property
    def inner_width(self) -> int:
        return self.width - self.left - self.right

    @property
    def inner_height(self) -> int:
        return self.height - self.top - self.bottom


#: Sizes, margins and fonts of the pictures.
LAYOUTS = {"square": Layout(1200, 1200, 50, 10, 10, 40, 35), "wide": Layout(1600, 1200, 58, 10, 10, 45, 40), "histogram": Layout(1000, 700, 50, 10, 0, 80, 20)}
#: Lines and text.
GRID, INK = "rgb(230,230,230)", "#2a3f5f"
#: Captions of the histogram, by the slot that they are centred on.
CAPTIONS = ((0.5, ("precise/", "obscured")), (3.5, ("with/without", "time stamp")), (10.0, ("apparent speed classes or first observation of", "the day (gray) or identical time stamp (black)")))
#: Days of a page and rows of a leaf: elements are counted and checked by these.
PAGE, LEAF = 100, 1000
SUFFIX = {"square": ".svg", "wide": "-wide.svg", "histogram": "-histogram.svg"}


def hundredths(value: Column) -> Column:
    return F.floor(value * 100 + 0.5).cast("bigint")


def decimal(n: Column) -> Column:
    """Hundredths (not negative) as text with two digits."""
    return F.concat(F.floor(n / 100).cast("bigint").cast("string"), F.lit("."), F.lpad(F.pmod(n, F.lit(100)).cast("string"), 2, "0"))


def file_name(rank: Column, label: Column, kind: str) -> Column:
    """Name of a person's file: rank, label with other signs than letters, digits, dot and dash as _, and the kind."""
    return F.concat(F.lit("profile_"), F.regexp_replace(figures.file_label(rank, label), "[^0-9A-Za-z._-]", "_"), F.lit(SUFFIX[kind]))


def scales(people: DataFrame, accepted: DataFrame, dated: DataFrame, layout: Layout) -> DataFrame:
    """A row for each selected person: label, first and last day, days, left edge and sizes of the plot in pixels."""
    own = trajectory.summary(accepted, dated).filter(F.col("days") > 0)
    low, high = F.to_date("first_day"), F.to_date("last_day")
    return people.join(own, "user_id").select(
        "person_rank", "user_id", "label", "days", "tick_format", "years", low.alias("low"), high.alias("high"),
        (F.lit(layout.left) + F.col("margin_extra")).cast("double").alias("left"),
        (F.lit(layout.inner_width) - F.col("margin_extra")).cast("double").alias("across"),
        F.greatest(F.datediff(high, low), F.lit(1)).cast("double").alias("span"),
    )


def _x(day: Column) -> Column:
    """Pixels of a day: the range has a twentieth of its length free at either end."""
    return F.col("left") + (F.datediff(day, F.col("low")) + 0.05 * F.col("span")) / (1.1 * F.col("span")) * F.col("across")


def _y(number: Column, layout: Layout) -> Column:
    """Pixels of a day number: the range is 0 to days + 1.5, upwards."""
    return F.lit(float(layout.top)) + F.lit(float(layout.inner_height)) * (1 - number / (F.col("days") + 1.5))


def _row(layer: int, page: Column, leaf: Column, at: Column, element: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    box = [c.cast("bigint").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))]
    return ["person_rank", "user_id", "label", F.lit(layer).alias("layer"), page.cast("bigint").alias("page"), leaf.cast("bigint").alias("leaf"), at.cast("bigint").alias("at"), element.alias("element"), *box]


def day_unit() -> Column:
    """Step of the numbers at the side: 1, 2 or 5 times a power of ten, so that there are at most seven."""
    raw = F.col("days") / 7.0
    base = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = F.when(raw <= base, base).when(raw <= 2 * base, 2 * base).when(raw <= 5 * base, 5 * base).otherwise(10 * base)
    return F.when(F.col("days") <= 7, 1).otherwise(step).cast("bigint")


def _axes(scale: DataFrame, layout: Layout) -> DataFrame:
    """Lines and numbers of the days, and month or year starts; the first day stands for itself where none is inside."""
    zero = F.lit(0)
    right = F.col("left") + F.col("across")
    numbers = scale.withColumn("unit", day_unit()).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("days") / F.col("unit")).cast("bigint"))))
    value = F.col("k") * F.col("unit")
    y = hundredths(_y(value, layout))
    line = F.concat(
        F.lit('<path d="M'), decimal(hundredths(F.col("left"))), F.lit(" "), decimal(y), F.lit("H"), decimal(hundredths(right)), F.when(value == 0, f'" stroke="{INK}" stroke-width="1"/>').otherwise(f'" stroke="{GRID}" stroke-width="0.5"/>'),
        F.lit('<text x="'), decimal(hundredths(F.col("left") - 4)), F.lit('" y="'), decimal(y), F.lit(f'" fill="{INK}" text-anchor="end" dominant-baseline="middle">'), value.cast("string"), F.lit("</text>"),
    )
    down = numbers.select(*_row(1, zero, zero, F.col("k"), line, hundredths(F.col("left")), y, hundredths(right), y))
    by_year = F.col("years") > 1
    first = F.when(by_year, (F.year("low") + 1) * 12).otherwise(F.year("low") * 12 + F.month("low"))
    last = F.year("high") * 12 + F.month("high") - 1
    step = F.when(by_year, 12 * F.ceil(F.col("years") / 7)).otherwise(F.ceil(F.greatest(last - first + 1, F.lit(1)) / 7)).cast("int")
    starts = F.when(first <= last, F.transform(F.sequence(first, last, step), lambda m: F.make_date(F.floor(m / 12).cast("int"), F.pmod(m, F.lit(12)) + 1, F.lit(1)))).otherwise(F.array("low"))
    ticks = scale.select("*", F.posexplode(starts).alias("k", "day"))
    x, bottom = hundredths(_x(F.col("day"))), layout.height - layout.bottom
    said = F.when(by_year, F.date_format("day", "yyyy")).otherwise(F.date_format("day", "MM/yyyy"))
    line = F.concat(
        F.lit('<path d="M'), decimal(x), F.lit(f' {layout.top}V{bottom}" stroke="{GRID}" stroke-width="0.5"/><text x="'), decimal(x),
        F.lit(f'" y="{layout.height - 4}" fill="{INK}" text-anchor="middle">'), said, F.lit("</text>"),
    )
    across = ticks.select(*_row(1, zero, zero, F.col("k") + 1_000_000, line, x, F.lit(layout.top * 100), x, F.lit(bottom * 100)))
    return down.unionByName(across)


def profile_elements(people: DataFrame, accepted: DataFrame, kind: str = "square", config: Config = DEFAULT) -> DataFrame:
    """Elements of the profiles of the people (person_rank, user_id), in the order (layer, page, leaf, at) for each rank.

    page and leaf: a hundred days and a thousand rows of a day. Edges in hundredths of a pixel.
    """
    layout = LAYOUTS[kind]
    dated = trajectory.rows(accepted, config).join(people.select("user_id").distinct(), "user_id", "left_semi")
    scale = scales(people, accepted.join(people.select("user_id").distinct(), "user_id", "left_semi"), dated, layout)
    title = scale.select(*_row(0, F.lit(0), F.lit(0), F.lit(0), F.concat(F.lit("<title>"), escaped(F.col("label")), F.lit("</title>")), F.lit(0), F.lit(0), F.lit(layout.width * 100), F.lit(layout.height * 100)))
    marks = trajectory.markers(dated, config).join(scale, "user_id")
    inner = F.col("kind") != "first"
    half, size = config.marker // 2, config.marker
    x = hundredths(_x(F.to_date("day")) + F.when(inner, F.col("x0")).otherwise(float(-half)))
    y = hundredths(_y(F.col("day_idx"), layout) - half)
    paint = F.concat(F.lit('" fill="'), "fill", F.lit('" stroke="'), "line_color", F.lit('" stroke-width="'), F.col("line_width").cast("string"), F.lit('"/>'))
    box = F.concat(F.lit('<rect x="'), decimal(x), F.lit('" y="'), decimal(y), F.lit(f'" width="{size}" height="{size}'), paint)
    ring = F.concat(F.lit('<circle cx="'), decimal(x + 100 * half), F.lit('" cy="'), decimal(y + 100 * half), F.lit(f'" r="{half}'), paint)
    element = F.when(F.col("shape") == "circle", ring).otherwise(box)
    at = F.col("day_idx") * 1_000_000_000 + F.col("rn")
    drawn = [marks.filter(test).select(*_row(layer, F.floor(F.col("day_idx") / PAGE), F.floor(F.col("rn") / LEAF), at, element, x, y, x + 100 * size, y + 100 * size)) for layer, test in ((2, ~inner), (3, inner))]
    return title.unionByName(_axes(scale, layout)).unionByName(drawn[0]).unionByName(drawn[1])


def histogram_elements(people: DataFrame, accepted: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Elements of the histograms of the people: fifteen bars, numbers at the side, glyphs and captions below."""
    layout = LAYOUTS["histogram"]
    own = people.select("user_id").distinct()
    dated = trajectory.rows(accepted, config).join(own, "user_id", "left_semi")
    counts = trajectory.histogram(dated)
    labels = trajectory.summary(accepted.join(own, "user_id", "left_semi"), dated).select("user_id", "label")
    vector = trajectory.histogram_vector(counts).join(trajectory.histogram_ticks(counts), "user_id").join(labels, "user_id")
    rows = people.join(vector.select("user_id", "label", "bars", "ticks"), "user_id").withColumn("most", F.greatest(F.array_max("bars"), F.lit(1).cast("bigint")) * 1.05)
    slot, base = layout.inner_width / 15, layout.height - layout.bottom
    zero = F.lit(0)

    def down(value: Column) -> Column:
        return hundredths(F.lit(float(layout.top)) + F.lit(float(layout.inner_height)) * (1 - value / F.col("most")))

    title = rows.select(*_row(0, zero, zero, zero, F.concat(F.lit("<title>"), escaped(F.col("label")), F.lit("</title>")), zero, zero, F.lit(layout.width * 100), F.lit(layout.height * 100)))
    ticks = rows.select("*", F.posexplode("ticks").alias("k", "tick")).filter(F.col("tick") <= F.col("most"))  # they go on to the sum of all, the bars may be shorter
    line = F.concat(
        F.lit(f'<path d="M{layout.left} '), decimal(down(F.col("tick"))), F.lit(f'H{layout.width - layout.right}" stroke="'), F.when(F.col("tick") == 0, f'{INK}" stroke-width="1"/>').otherwise(f'{GRID}" stroke-width="0.5"/>'),
        F.lit(f'<text x="{layout.left - 4}" y="'), decimal(down(F.col("tick"))), F.lit(f'" fill="{INK}" text-anchor="end" dominant-baseline="middle">'), F.col("tick").cast("string"), F.lit("</text>"),
    )
    axis = ticks.select(*_row(1, zero, zero, F.col("k"), line, F.lit(layout.left * 100), down(F.col("tick")), F.lit((layout.width - layout.right) * 100), down(F.col("tick"))))
    bars = rows.select("*", F.posexplode("bars").alias("k", "n"))
    left = [round((layout.left + (k + 0.1) * slot) * 100) for k in range(15)]
    wide = round(0.8 * slot * 100)
    edge = F.get(F.array(*[F.lit(v).cast("bigint") for v in left]), F.col("k"))
    top = down(F.col("n"))
    colour = F.get(F.array(*[F.lit(c) for c in figures.bar_colours(config)]), F.col("k"))
    bar = F.concat(F.lit('<rect x="'), decimal(edge), F.lit('" y="'), decimal(top), F.lit(f'" width="{wide / 100:.2f}" height="'), decimal(F.lit(base * 100) - top), F.lit('" fill="'), colour, F.lit('"/>'))
    drawn = bars.select(*_row(2, zero, zero, F.col("k"), bar, edge, top, edge + wide, F.lit(base * 100)))
    below = [element for element, _ in below_bars(config)]
    boxes = [box for _, box in below_bars(config)]
    fixed = rows.select("*", F.posexplode(F.array(*[F.struct(F.lit(e).alias("element"), *[F.lit(v).cast("bigint").alias(n) for v, n in zip(b, ("a", "b", "c", "d"))]) for e, b in zip(below, boxes)])).alias("k", "g"))
    return title.unionByName(axis).unionByName(drawn).unionByName(fixed.select(*_row(3, zero, zero, F.col("k"), F.col("g.element"), F.col("g.a"), F.col("g.b"), F.col("g.c"), F.col("g.d"))))


def below_bars(config: Config = DEFAULT) -> list[tuple[str, tuple[int, int, int, int]]]:
    """Glyphs and captions below the bars, which all people share, with their edges in hundredths of a pixel."""
    layout = LAYOUTS["histogram"]
    slot, base = layout.inner_width / 15, layout.height - layout.bottom
    found = []
    for g in figures.glyphs(config):
        middle = layout.left + (g["slot"] + 0.5) * slot
        x0, x1, y0, y1 = middle + g["x0"], middle + g["x1"], base - g["y1"], base - g["y0"]
        paint = f'fill="{g["fill"]}" stroke="{g["line"]}" stroke-width="{g["width"]}"/>'
        if g["shape"] == "circle":
            element = f'<ellipse cx="{(x0 + x1) / 2:.2f}" cy="{(y0 + y1) / 2:.2f}" rx="{(x1 - x0) / 2:.2f}" ry="{(y1 - y0) / 2:.2f}" {paint}'
        else:
            element = f'<rect x="{x0:.2f}" y="{y0:.2f}" width="{x1 - x0:.2f}" height="{y1 - y0:.2f}" {paint}'
        found.append((element, tuple(round(v * 100) for v in (x0, y0, x1, y1))))
    for at, lines in CAPTIONS:
        x = layout.left + (at + 0.5) * slot
        spans = "".join(f'<tspan x="{x:.2f}" y="{layout.height - 26 + 20 * k}">{line}</tspan>' for k, line in enumerate(lines))
        found.append((f'<text fill="{INK}" text-anchor="middle">{spans}</text>', (round(x * 100), (layout.height - 46) * 100, round(x * 100), layout.height * 100)))
    return found


def layout_specs(summary: DataFrame, kind: str) -> DataFrame:
    """user_id and the picture's frame as JSON: size, margins, font, and either the axes of a profile or the captions of a histogram.

    summary: as `trajectory.summary` gives it; people without days have no picture.
    """
    o = LAYOUTS[kind]
    extra = F.lit(0).cast("bigint") if kind == "histogram" else F.col("margin_extra")
    margin = F.struct((F.lit(o.left) + extra).alias("l"), F.lit(o.right).alias("r"), F.lit(o.bottom).alias("b"), F.lit(o.top).alias("t"))
    frame = [F.lit(o.width).alias("width"), F.lit(o.height).alias("height"), margin.alias("margin"), F.lit(o.font).alias("font"), F.col("label").alias("title")]
    if kind == "histogram":
        said = [F.struct(F.lit(at).alias("slot"), F.lit(" ".join(lines)).alias("text")) for at, lines in CAPTIONS]
        own = [F.array(*said).alias("captions")]
    else:
        time = F.struct(F.col("tick_format").alias("tickformat"), F.col("ticks").alias("nticks"), F.array("first_day", "last_day").alias("range"))
        own = [time.alias("x"), F.struct(F.array(F.lit(0.0), F.col("days") + 1.5).alias("range")).alias("y")]
    return summary.filter(F.col("days") > 0).select("user_id", F.to_json(F.struct(*frame, *own)).alias("spec"))


def head(kind: str) -> str:
    layout = LAYOUTS[kind]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{layout.width}" height="{layout.height}" viewBox="0 0 {layout.width} {layout.height}" font-family="sans-serif" font-size="{layout.font}">'


def elements(people: DataFrame, accepted: DataFrame, kind: str, config: Config = DEFAULT) -> DataFrame:
    return histogram_elements(people, accepted, config) if kind == "histogram" else profile_elements(people, accepted, kind, config)


def write(people: DataFrame, accepted: DataFrame, folder: str, kinds: tuple[str, ...] = ("square", "wide", "histogram"), config: Config = DEFAULT) -> None:
    """One SVG file below the folder for each selected person and kind."""
    for kind in kinds:
        rows = elements(people, accepted, kind, config).withColumn("file", file_name(F.col("person_rank"), F.col("label"), kind))
        documents.write_documents(rows, folder, ["layer", "page", "leaf", "at"], head(kind), "</svg>")


def digests(rows: DataFrame) -> DataFrame:
    """For each person and leaf of elements: their number, the box around them in pixels, and SHA-256 of the sorted elements. A leaf is bounded, whatever a person has."""
    box = [F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")]
    return rows.groupBy("person_rank", "user_id", "layer", "page", "leaf").agg(
        F.count(F.lit(1)).alias("elements"), *[(c / 100.0).alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))], F.sha2(F.array_join(F.array_sort(F.collect_list("element")), "\n"), 256).alias("sha256"),
    )
