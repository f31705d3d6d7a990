"""Queries of the observation engine, by name, with DuckDB SQL for the same rows.

Queries on `events` go through the observation adapter. Each pair is written separately for the two
engines; floating results are rounded on both sides to where their libraries agree.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perigon.config import CLASSES, DEFAULT, OBS_COLUMNS, OPTIONAL_COLUMNS, Config
from perigon.operators import charts, exports, figures, ingest, invariants, outputs, powerlaw, quality, rankings, svg, trajectory
from perigon.sources import csv_exports, events

#: The adapter's species and thresholds that its tables can show.
CONFIG = Config(focus_species="Genus_click sp4")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return keep


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.accepted(events.observations(spark, sf_dir), CONFIG)


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.rows(_accepted(spark, sf_dir), CONFIG)


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles rounded as SQL's round does: F.round(c, n) would round the number's shortest text, which differs next to a half."""
    return df.withColumns({c: F.round(F.col(c) * 10.0**n) / 10.0**n for c, n in digits.items()})


_GATE = f"""WITH {events.SQL},
first AS (
  SELECT *, min(CASE WHEN captive_cultivated <> 'true' AND latitude <> '' AND longitude <> '' AND (taxon_genus_name <> '' OR scientific_name = 'Nepenthaceae') THEN seq END) OVER (PARTITION BY id) AS fa FROM obs
), gate AS (
  SELECT *, CASE WHEN captive_cultivated = 'true' THEN 'captive' WHEN fa IS NOT NULL AND seq > fa THEN 'duplicate' WHEN latitude = '' OR longitude = '' THEN 'no coordinates'
    WHEN taxon_genus_name = '' AND scientific_name <> 'Nepenthaceae' THEN 'no genus' END AS reason FROM first
), acc AS (
  SELECT * EXCLUDE (reason, fa) REPLACE (CASE WHEN taxon_genus_name = '' THEN 'Nepenthes' ELSE taxon_genus_name END AS taxon_genus_name) FROM gate WHERE reason IS NULL
), posters AS (
  SELECT user_id, user_login, count(*) AS n, min(seq) AS first_seq FROM acc GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY n DESC, first_seq DESC) AS rank FROM posters
), species AS (
  SELECT scientific_name, count(*) AS n, min(seq) AS first_seq FROM acc GROUP BY ALL
)"""

_EPITHET = "CASE WHEN taxon_hybrid_name <> '' THEN 'x ' || split_part(taxon_hybrid_name, ' ', -1) ELSE split_part(taxon_species_name, ' ', 2) END"


@_register(
    "ingest_accepted",
    _GATE + " SELECT seq, id, user_id, user_login, latitude, longitude, observed_on, time_observed_at, scientific_name, taxon_genus_name, geoprivacy, taxon_geoprivacy, coordinates_obscured FROM acc",
)
def ingest_accepted(spark, sf_dir):
    columns = ["seq", "id", "user_id", "user_login", "latitude", "longitude", "observed_on", "time_observed_at", "scientific_name", "taxon_genus_name", "geoprivacy", "taxon_geoprivacy", "coordinates_obscured"]
    return _accepted(spark, sf_dir).select(*columns)


@_register("ingest_rejects", _GATE + " SELECT seq, id, reason, scientific_name FROM gate WHERE reason IS NOT NULL")
def ingest_rejects(spark, sf_dir):
    return ingest.rejects(events.observations(spark, sf_dir), CONFIG)


_PRIVATE = "captive_cultivated <> 'true' AND geoprivacy = 'private' AND (fa IS NULL OR seq <= fa)"


@_register("ingest_private_counters", _GATE + f" SELECT count(*) FILTER ({_PRIVATE}) AS private, count(*) FILTER ({_PRIVATE} AND (latitude = '' OR longitude = '')) AS private_without_coordinates FROM gate")
def ingest_private_counters(spark, sf_dir):
    return ingest.private_counters(events.observations(spark, sf_dir), CONFIG)


@_register(
    "quality_summary",
    _GATE
    + f""", one AS (
  SELECT count(*) FILTER (reason IS NULL) AS total, count(*) FILTER ({_PRIVATE}) AS private, count(*) FILTER ({_PRIVATE} AND (latitude = '' OR longitude = '')) AS bare,
    count(*) FILTER (reason IS NULL AND coordinates_obscured = 'true') AS obscured, count(*) FILTER (reason IS NULL AND taxon_species_name = '') AS genus_only,
    count(*) FILTER (reason IS NULL AND quality_grade = 'research') AS research FROM gate
), lines AS (
  SELECT 'accepted' AS metric, total AS value, total AS denominator FROM one UNION ALL SELECT 'private', private, total + bare FROM one
  UNION ALL SELECT 'private_without_coordinates', bare, total + bare FROM one UNION ALL SELECT 'obscured', obscured, total FROM one
  UNION ALL SELECT 'not_obscured', total - obscured, total FROM one UNION ALL SELECT 'genus_only', genus_only, total FROM one UNION ALL SELECT 'research_grade', research, total FROM one
) SELECT metric, value, denominator, round(value::DOUBLE * 100 / denominator, 6) AS pct FROM lines""",
)
def quality_summary(spark, sf_dir):
    return _rounded(quality.summary(events.observations(spark, sf_dir), CONFIG), pct=6)


@_register(
    "quality_value_domains",
    _GATE
    + """ SELECT field, value, count(*) AS n, min(seq) AS first_seq FROM (
  SELECT 'quality_grade' AS field, quality_grade AS value, seq FROM acc UNION ALL SELECT 'geoprivacy', geoprivacy, seq FROM acc
  UNION ALL SELECT 'taxon_geoprivacy', taxon_geoprivacy, seq FROM acc UNION ALL SELECT 'captive_cultivated', captive_cultivated, seq FROM acc) GROUP BY ALL""",
)
def quality_value_domains(spark, sf_dir):
    return quality.value_domains(_accepted(spark, sf_dir))


@_register(
    "quality_taxa_obscured",
    _GATE
    + """ SELECT obscured_taxa, unobscured_taxa, distinct_taxa, round(obscured_taxa * 100.0::DOUBLE / (obscured_taxa + unobscured_taxa), 6) AS pct_obscured FROM (
  SELECT count(DISTINCT scientific_name) FILTER (taxon_geoprivacy = 'obscured') AS obscured_taxa, count(DISTINCT scientific_name) FILTER (taxon_geoprivacy <> 'obscured') AS unobscured_taxa,
    count(DISTINCT scientific_name) AS distinct_taxa FROM acc)""",
)
def quality_taxa_obscured(spark, sf_dir):
    return _rounded(quality.taxa_obscured(_accepted(spark, sf_dir)), pct_obscured=6)


_SLICES = {
    "all": "true", "precise": "coordinates_obscured = 'false'", "obscured": "coordinates_obscured = 'true'",
    "taxon_empty": "taxon_geoprivacy = ''", "taxon_open": "taxon_geoprivacy = 'open'", "taxon_obscured": "taxon_geoprivacy = 'obscured'",
    "focus_empty": "scientific_name = 'Genus_click sp4' AND taxon_geoprivacy = ''", "focus_open": "scientific_name = 'Genus_click sp4' AND taxon_geoprivacy = 'open'",
    "focus_empty_open": "scientific_name = 'Genus_click sp4' AND taxon_geoprivacy IN ('', 'open')", "focus_obscured": "scientific_name = 'Genus_click sp4' AND taxon_geoprivacy = 'obscured'",
    "geoprivacy_empty": "geoprivacy = ''", "geoprivacy_obscured": "geoprivacy = 'obscured'", "geoprivacy_private": "geoprivacy = 'private'",
}
_LINE = "id || chr(9) || user_id || chr(9) || user_login || chr(9) || coalesce(private_latitude, latitude) || chr(9) || coalesce(private_longitude, longitude)"


@_register("heatmap_slices", _GATE + " " + " UNION ALL ".join(f"SELECT '{n}' AS slice, seq, {_LINE} AS line FROM acc WHERE {p}" for n, p in _SLICES.items()))
def heatmap_slices(spark, sf_dir):
    return exports.slices(_accepted(spark, sf_dir), CONFIG)


@_register("heatmap_slice_counts", _GATE + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS slice, count(*) AS n FROM acc WHERE {p}" for n, p in _SLICES.items()) + ") WHERE n > 0")
def heatmap_slice_counts(spark, sf_dir):
    return exports.slices(_accepted(spark, sf_dir), CONFIG).groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


@_register(
    "gpx_precise",
    _GATE
    + f""" SELECT seq, CASE WHEN coalesce(private_latitude, '') <> '' THEN private_latitude ELSE latitude END AS lat,
  CASE WHEN coalesce(private_longitude, '') <> '' THEN private_longitude ELSE longitude END AS lon, taxon_genus_name || ' ' || {_EPITHET} AS label
  FROM acc WHERE coordinates_obscured = 'false' OR coalesce(private_latitude, '') <> ''""",
)
def gpx_precise(spark, sf_dir):
    return exports.waypoints(_accepted(spark, sf_dir), precise=True)


@_register("gpx_obscured", _GATE + f" SELECT seq, latitude AS lat, longitude AS lon, taxon_genus_name || ' ' || {_EPITHET} AS label FROM acc WHERE coordinates_obscured = 'true' AND coalesce(private_latitude, '') = ''")
def gpx_obscured(spark, sf_dir):
    return exports.waypoints(_accepted(spark, sf_dir), precise=False)


@_register(
    "gpx_elements",
    _GATE
    + f""" SELECT seq, '  <wpt lat="' || latitude || '" lon="' || longitude || '">' || chr(10) || '    <ele>0.000000</ele>' || chr(10) || '    <name>' || l || '</name>' || chr(10) || '    <cmt>' || l || '</cmt>'
  || chr(10) || '    <desc>' || l || '</desc>' || chr(10) || '    <cmt></cmt>' || chr(10) || '    <desc></desc>' || chr(10) || '  </wpt>' AS element
  FROM (SELECT *, taxon_genus_name || ' ' || {_EPITHET} AS l FROM acc) WHERE coordinates_obscured = 'true' AND coalesce(private_latitude, '') = ''""",
)
def gpx_elements(spark, sf_dir):
    return exports.gpx_elements(exports.waypoints(_accepted(spark, sf_dir), precise=False))


@_register(
    "kml_elements",
    _GATE + f" SELECT seq, '  <Placemark><name>' || taxon_genus_name || ' ' || {_EPITHET} || '</name><Point><coordinates>' || longitude || ',' || latitude || ',0</coordinates></Point></Placemark>' AS element FROM acc WHERE coordinates_obscured = 'true' AND coalesce(private_latitude, '') = ''",
)
def kml_elements(spark, sf_dir):
    return exports.kml_elements(exports.waypoints(_accepted(spark, sf_dir), precise=False))


def _clean_sql(compat: bool) -> str:
    service = "CASE WHEN coalesce(private_{0}, '') <> '' OR coordinates_obscured <> 'true' THEN 'in-precise' ELSE 'in-obscured' END"
    value = "CASE WHEN coalesce(private_{0}, '') <> '' THEN private_{0} ELSE {0} END"
    quote = (lambda x: f"'\"' || {x} || '\"'") if compat else (lambda x: f"'\"' || replace({x}, '\"', '\"\"') || '\"'")
    fields = ["id", service.format("latitude"), value.format("latitude"), *([service.format("longitude")] if compat else []), value.format("longitude"), "''", "taxon_genus_name", _EPITHET]
    fields += ["split_part(taxon_subspecies_name, ' ', -1)", "split_part(taxon_variety_name, ' ', -1)", "CASE WHEN taxon_hybrid_name <> '' THEN '1' ELSE '0' END", quote("place_country_name"), "replace(observed_on, '-', '/')"]
    fields += [quote("replace(place_guess, '\"', '')"), quote("user_login"), quote("user_id"), "'unverified'", "CASE WHEN contains(image_url, 'https://images.example.org/') THEN image_url ELSE '' END"]
    return _GATE + " SELECT seq, " + " || ',' || ".join(f"({f})" for f in fields) + " AS line FROM acc"


@_register("clean_export", _clean_sql(False))
def clean_export(spark, sf_dir):
    return exports.clean_lines(_accepted(spark, sf_dir), CONFIG)


@_register("clean_export_compat", _clean_sql(True))
def clean_export_compat(spark, sf_dir):
    return exports.clean_lines(_accepted(spark, sf_dir), CONFIG, compat=True)


@_register("poster_counts", _GATE + " SELECT user_id, user_login, count(*) AS n, min(seq) AS first_seq, string_agg('i' || id, ',' ORDER BY seq) AS tags FROM acc GROUP BY user_id, user_login")
def poster_counts(spark, sf_dir):
    return rankings.posters(_accepted(spark, sf_dir))


@_register(
    "poster_tag_pages",
    _GATE
    + """ SELECT user_id, user_login, (place - 1) // 20 AS page, string_agg('i' || id, ',' ORDER BY place) AS tags
  FROM (SELECT user_id, user_login, id, row_number() OVER (PARTITION BY user_id, user_login ORDER BY seq) AS place FROM acc) GROUP BY ALL""",
)
def poster_tag_pages(spark, sf_dir):
    return rankings.tag_pages(_accepted(spark, sf_dir), 20).withColumn("tags", F.array_join("tags", ","))


@_register("posters_csv", _GATE + ", head AS (SELECT user_id, arg_min(user_login, seq) AS user_login, min(seq) AS first_seq FROM acc GROUP BY user_id) SELECT h.user_id, h.user_login, p.n, h.first_seq FROM head h JOIN posters p ON p.user_id = h.user_id AND p.user_login = h.user_login")
def posters_csv(spark, sf_dir):
    return rankings.posters_csv(_accepted(spark, sf_dir))


_LABEL = "scientific_name || CASE WHEN contains(scientific_name, ' ') THEN '' ELSE ' (unclassified)' END"


@_register("species_counts_alpha", _GATE + f" SELECT row_number() OVER (ORDER BY scientific_name DESC) AS position, {_LABEL} AS label, n, n + 2 AS text_x FROM species")
def species_counts_alpha(spark, sf_dir):
    bars = figures.species_bars(_accepted(spark, sf_dir), "name")  # a row for each species
    return bars.select(F.row_number().over(Window.orderBy(F.desc("scientific_name"))).cast("bigint").alias("position"), "label", "n", F.col("annotation.x").alias("text_x"))


@_register("species_counts_rank", _GATE + f" SELECT row_number() OVER (ORDER BY n DESC, first_seq DESC) AS rank, {_LABEL} AS label, n, NOT contains(scientific_name, ' ') AS unclassified FROM species")
def species_counts_rank(spark, sf_dir):
    bars = figures.species_bars(_accepted(spark, sf_dir), "count")
    return bars.select("rank", "label", "n", (~F.contains("scientific_name", F.lit(" "))).alias("unclassified"))


@_register("species_rank_frequency", _GATE + " SELECT row_number() OVER (ORDER BY n DESC, first_seq DESC) AS rank, n, scientific_name FROM species WHERE contains(scientific_name, ' ')")
def species_rank_frequency(spark, sf_dir):
    return figures.species_line(_accepted(spark, sf_dir))


@_register("species_unclassified", _GATE + " SELECT count(*) AS species, count(*) FILTER (NOT contains(scientific_name, ' ')) AS unclassified FROM species")
def species_unclassified(spark, sf_dir):
    counts = rankings.species_counts(_accepted(spark, sf_dir))
    return counts.agg(F.count(F.lit(1)).alias("species"), F.count_if(~F.contains("scientific_name", F.lit(" "))).alias("unclassified"))


@_register("poster_rank_frequency", _GATE + " SELECT rank, n, user_id, user_login FROM ranked")
def poster_rank_frequency(spark, sf_dir):
    return figures.poster_line(_accepted(spark, sf_dir))


def _annotated(bars: DataFrame) -> DataFrame:
    return bars.select("rank", "key", "n", F.col("annotation.x").alias("text_x"), F.col("annotation.text").alias("text"))


@_register("poster_tags", _GATE + " SELECT user_id, user_login, row_number() OVER (PARTITION BY user_id, user_login ORDER BY seq) AS place, 'i' || id AS tag FROM acc")
def poster_tags(spark, sf_dir):
    return rankings.poster_tags(_accepted(spark, sf_dir))


@_register("poster_bars_all", _GATE + " SELECT rank, user_id || '-' || user_login AS key, n, n + 2 AS text_x, n::VARCHAR AS text FROM ranked")
def poster_bars_all(spark, sf_dir):
    return _annotated(figures.poster_bars(_accepted(spark, sf_dir), CONFIG))


@_register("poster_top", _GATE + " SELECT rank, user_id || '-' || user_login AS key, n, n + 2 AS text_x, n::VARCHAR AS text FROM ranked WHERE n > 10")
def poster_top(spark, sf_dir):
    return _annotated(figures.poster_bars(_accepted(spark, sf_dir), CONFIG, top_only=True))


@_register("poster_log_axis", _GATE + " SELECT round(log10(max(rank)) + 0.1, 6) AS x_high, round(log10(max(n)) + 0.1, 6) AS y_high FROM ranked")
def poster_log_axis(spark, sf_dir):
    return _rounded(figures.log_axis(figures.poster_line(_accepted(spark, sf_dir))), x_high=6, y_high=6)


@_register("poster_frequent", _GATE + " SELECT user_id, user_login, n, first_seq, rank FROM ranked WHERE n >= 80")
def poster_frequent(spark, sf_dir):
    return rankings.frequent_posters(_accepted(spark, sf_dir), CONFIG).select("user_id", "user_login", "n", "first_seq", "rank")


@_register(
    "poster_half_mass",
    _GATE
    + """, w AS (SELECT n, sum(n) OVER () AS total, count(*) OVER () AS posters, coalesce(sum(n) OVER (ORDER BY n, first_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM posters)
  SELECT (max(posters) - count(*) FILTER (total - before > total // 2))::BIGINT AS people, (max(total) - coalesce(sum(n) FILTER (total - before > total // 2), 0))::BIGINT AS posts,
    max(total)::BIGINT AS total, max(posters)::BIGINT AS posters FROM w""",
)
def poster_half_mass(spark, sf_dir):
    return rankings.half_mass(rankings.poster_counts(_accepted(spark, sf_dir)))


@_register("poster_low_contributors", _GATE + " SELECT k AS at_most, count(*) FILTER (n <= k) AS people, round(count(*) FILTER (n <= k) * 100.0::DOUBLE / count(*), 6) AS pct FROM posters, (VALUES (5::BIGINT), (3), (2), (1)) AS t(k) GROUP BY k")
def poster_low_contributors(spark, sf_dir):
    return _rounded(rankings.low_contributors(rankings.poster_counts(_accepted(spark, sf_dir))), pct=6)


_FIT_END = "SELECT xmin, n, round(alpha, 6) AS alpha, round(sigma, 6) AS sigma, round(ks, 6) AS ks FROM fits ORDER BY fits.ks, xmin LIMIT 1"


def _fit_sql(before: str, counts: str, xmin: int | None, end: str = _FIT_END) -> str:
    zeta = " + ".join(f"pow(({{q}} + {k}) / xmin::DOUBLE, -alpha)" for k in range(powerlaw.HEAD))  # times xmin^alpha, so that nothing underflows
    a = f"({{q}} + {powerlaw.HEAD})"
    zeta += f" + pow({a} / xmin::DOUBLE, -alpha) * ({a} / (alpha - 1) + 0.5 + alpha / (12 * {a}) - alpha * (alpha + 1) * (alpha + 2) / (720 * pow({a}, 3))"
    zeta += f" + alpha * (alpha + 1) * (alpha + 2) * (alpha + 3) * (alpha + 4) / (30240 * pow({a}, 5)))"
    candidates = "SELECT v AS xmin FROM freq WHERE v < (SELECT max(v) FROM freq)" if xmin is None else f"SELECT {xmin}::BIGINT AS xmin"
    return f"""{before} freq AS (SELECT n::BIGINT AS v, count(*) AS c FROM ({counts}) WHERE n >= 1 GROUP BY 1), cand AS ({candidates}),
pairs AS (SELECT xmin, v, sum(c) OVER w AS n, 1 + sum(c) OVER w / sum(c * ln(v / (xmin - 0.5::DOUBLE))) OVER w AS alpha,
  coalesce(sum(c) OVER (PARTITION BY xmin ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(c) OVER w AS below
  FROM cand JOIN freq ON v >= xmin WINDOW w AS (PARTITION BY xmin)),
fits AS (SELECT xmin, max(n)::BIGINT AS n, max(alpha) AS alpha, max((alpha - 1) / sqrt(n)) AS sigma,
  max(abs(below - (1 - CASE WHEN v = xmin THEN 1.0::DOUBLE ELSE ({zeta.format(q='v')}) / ({zeta.format(q='xmin')}) END))) AS ks FROM pairs GROUP BY xmin)
{end}"""


def _fitted(counts: DataFrame, xmin: int | None = None) -> DataFrame:
    return _rounded(powerlaw.fit(counts, xmin), alpha=6, sigma=6, ks=6)


def _classified(spark, sf_dir):
    return rankings.species_counts(_accepted(spark, sf_dir)).filter(F.contains("scientific_name", F.lit(" ")))


_CLASSIFIED = "SELECT n FROM species WHERE contains(scientific_name, ' ')"


@_register("powerlaw_species_auto", _fit_sql(_GATE + ",", _CLASSIFIED, None))
def powerlaw_species_auto(spark, sf_dir):
    return _fitted(_classified(spark, sf_dir))


@_register("powerlaw_species_xmin2", _fit_sql(_GATE + ",", _CLASSIFIED, 2))
def powerlaw_species_xmin2(spark, sf_dir):
    return _fitted(_classified(spark, sf_dir), 2)


@_register("powerlaw_species_xmin1", _fit_sql(_GATE + ",", _CLASSIFIED, 1))
def powerlaw_species_xmin1(spark, sf_dir):
    return _fitted(_classified(spark, sf_dir), 1)


@_register("powerlaw_posters_auto", _fit_sql(_GATE + ",", "SELECT n FROM posters", None))
def powerlaw_posters_auto(spark, sf_dir):
    return _fitted(rankings.poster_counts(_accepted(spark, sf_dir)))


@_register("powerlaw_orders_per_customer", _fit_sql("WITH", "SELECT count(*) AS n FROM orders GROUP BY o_custkey", None))
def powerlaw_orders_per_customer(spark, sf_dir):
    return _fitted(spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")))


@_register("powerlaw_lineitems_per_part", _fit_sql("WITH", "SELECT count(*) AS n FROM lineitem GROUP BY l_partkey", None))
def powerlaw_lineitems_per_part(spark, sf_dir):
    return _fitted(spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")))


@_register("powerlaw_tokens", _fit_sql("WITH", "SELECT count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' GROUP BY w", None))
def powerlaw_tokens(spark, sf_dir):
    tokens = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", " ")).alias("w"))
    return _fitted(tokens.filter("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n")))


def _alternative_end() -> str:
    """The exponential law against the power law of the best fit: ratio of their likelihoods, and the same over its standard deviation."""
    zeta = " + ".join(f"pow((xmin + {k}) / xmin::DOUBLE, -alpha)" for k in range(powerlaw.HEAD))
    a = f"(xmin + {powerlaw.HEAD})"
    zeta += f" + pow({a} / xmin::DOUBLE, -alpha) * ({a} / (alpha - 1) + 0.5 + alpha / (12 * {a}) - alpha * (alpha + 1) * (alpha + 2) / (720 * pow({a}, 3)) + alpha * (alpha + 1) * (alpha + 2) * (alpha + 3) * (alpha + 4) / (30240 * pow({a}, 5)))"
    return f""", best AS (SELECT xmin, alpha FROM fits ORDER BY ks, xmin LIMIT 1), tail AS (SELECT xmin, alpha, v, c, sum(c * (v - xmin)) OVER () / sum(c) OVER () AS beyond, sum(c) OVER () AS total FROM freq, best WHERE v >= xmin),
  gaps AS (SELECT *, -alpha * ln(v / xmin::DOUBLE) - ln({zeta}) - (ln(1 - exp(-ln(1 + 1 / beyond))) - ln(1 + 1 / beyond) * (v - xmin)) AS gap FROM tail), mean AS (SELECT *, sum(c * gap) OVER () AS ratio FROM gaps)
  SELECT 'exponential' AS alternative, max(xmin) AS xmin, round(max(ratio), 5) AS ratio, round(max(ratio) / sqrt(sum(c * pow(gap - ratio / total, 2))), 5) AS z FROM mean"""


@_register("powerlaw_exponential_lineitems", _fit_sql("WITH", "SELECT count(*) AS n FROM lineitem GROUP BY l_partkey", None, _alternative_end()))
def powerlaw_exponential_lineitems(spark, sf_dir):
    counts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return _rounded(powerlaw.compared(counts).filter("alternative = 'exponential'").drop("p"), ratio=5, z=5)


@_register("powerlaw_exponential_posters", _fit_sql(_GATE + ",", "SELECT n FROM posters", None, _alternative_end()))
def powerlaw_exponential_posters(spark, sf_dir):
    return _rounded(powerlaw.compared(rankings.poster_counts(_accepted(spark, sf_dir))).filter("alternative = 'exponential'").drop("p"), ratio=5, z=5)


_WALK = (
    _GATE
    + """, dated AS (
  SELECT user_id, user_login, seq, id, CASE WHEN coordinates_obscured = 'true' THEN 'iN-o' ELSE 'iN-p' END || id AS tag, observed_on AS dayno,
    CASE WHEN split_part(time_observed_at, ' ', 2) = '' THEN '00:00:00' ELSE split_part(time_observed_at, ' ', 2) END AS clock, latitude::DOUBLE AS lat, longitude::DOUBLE AS lon, coordinates_obscured AS obscured, time_observed_at <> '' AS timed
  FROM acc WHERE observed_on <> '' AND try_cast(split_part(observed_on, '-', 1) AS INTEGER) > 1950
), o1 AS (
  SELECT *, epoch((dayno || ' ' || clock)::TIMESTAMP)::BIGINT AS secs, row_number() OVER (PARTITION BY user_id, dayno ORDER BY clock, seq) AS rn FROM dated
), o2 AS (
  SELECT *, CASE WHEN rn = 1 THEN obscured <> 'true' ELSE obscured = 'false' END AS placed, rn = 1 OR obscured = 'false' AS anchor FROM o1
), o3 AS (
  SELECT *, last(CASE WHEN anchor THEN {'lat': lat, 'lon': lon, 'secs': secs} END IGNORE NULLS) OVER b AS f, count(*) FILTER (placed) OVER b AS placed_before, count(*) FILTER (anchor) OVER b AS run
  FROM o2 WINDOW b AS (PARTITION BY user_id, dayno ORDER BY clock, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o4 AS (
  SELECT *, CASE WHEN anchor AND rn > 1 THEN (secs - f.secs)::DOUBLE END AS elapsed, CASE WHEN anchor AND rn > 1 THEN CASE WHEN lat = f.lat AND lon = f.lon THEN 0.0::DOUBLE ELSE 6371009.0::DOUBLE * atan2(sqrt(pow(cos(radians(f.lat)) * sin(radians(f.lon - lon)), 2)
    + pow(cos(radians(lat)) * sin(radians(f.lat)) - sin(radians(lat)) * cos(radians(f.lat)) * cos(radians(f.lon - lon)), 2)), sin(radians(lat)) * sin(radians(f.lat)) + cos(radians(lat)) * cos(radians(f.lat)) * cos(radians(f.lon - lon))) END END AS metres FROM o3
), o5 AS (
  SELECT *, CASE WHEN elapsed > 0 THEN metres * 3.6 / elapsed WHEN elapsed IS NOT NULL THEN -1.0 END::DOUBLE AS kmh FROM o4
), walk AS (
  SELECT *, CASE WHEN rn = 1 THEN CASE WHEN placed THEN 'first' ELSE 'obscured' END WHEN NOT anchor THEN 'obscured' WHEN placed_before = 0 THEN 'first' WHEN kmh > 200 THEN 'kmh_over_200' WHEN kmh > 80 THEN 'kmh_80_200'
    WHEN kmh > 25 THEN 'kmh_25_80' WHEN kmh > 10 THEN 'kmh_10_25' WHEN kmh > 5 THEN 'kmh_5_10' WHEN kmh > 0 THEN 'kmh_0_5' WHEN elapsed = 0 THEN 'instantaneous' ELSE 'stationary' END AS cls FROM o5
), days AS (
  SELECT user_id, dayno, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY dayno) AS day_idx FROM dated GROUP BY user_id, dayno
), hist AS (
  SELECT user_id, count(*) FILTER (obscured <> 'true') AS precise, count(*) FILTER (obscured = 'true') AS obscured, count(*) FILTER (timed) AS with_time, count(*) FILTER (NOT timed) AS without_time, """
    + ", ".join(f"count(*) FILTER (cls = '{c}') AS cls_{c}" for c, _ in CLASSES)
    + """ FROM walk GROUP BY user_id
), people AS (
  SELECT user_id, arg_max(user_login, seq) AS label, count(*) AS accepted FROM acc GROUP BY user_id
), active AS (
  SELECT user_id, min(dayno) AS first_day, max(dayno) AS last_day, count(DISTINCT dayno) AS days, count(*) AS observations FROM dated GROUP BY user_id
)"""
)


@_register("trajectory_rows", _WALK + " SELECT user_id, user_login, seq, tag, dayno, clock, secs, lat, lon, obscured, timed FROM o1")
def trajectory_rows(spark, sf_dir):
    return _dated(spark, sf_dir).select("user_id", "user_login", "seq", "tag", F.col("day").alias("dayno"), "clock", F.col("at").alias("secs"), "lat", "lon", "obscured", "timed")


@_register("trajectory_days", _WALK + " SELECT user_id, dayno, n, day_idx FROM days")
def trajectory_days(spark, sf_dir):
    return trajectory.days(_dated(spark, sf_dir)).select("user_id", F.col("day").alias("dayno"), "n", "day_idx")


@_register("trajectory_speed", _WALK + " SELECT user_id, seq, elapsed, round(metres, 3) AS metres, round(kmh, 4) AS kmh FROM walk WHERE elapsed IS NOT NULL")
def trajectory_speed(spark, sf_dir):
    walk = trajectory.walked(_dated(spark, sf_dir)).filter(F.col("elapsed").isNotNull())
    return _rounded(walk.select("user_id", "seq", "elapsed", "metres", "kmh"), metres=3, kmh=4)


@_register("trajectory_classes", _WALK + " SELECT user_id, seq, rn::BIGINT AS rn, placed, anchor, cls FROM walk")
def trajectory_classes(spark, sf_dir):
    return trajectory.walked(_dated(spark, sf_dir)).select("user_id", "seq", F.col("rn").cast("bigint").alias("rn"), "placed", "anchor", "cls")


@_register("person_speed_histogram", _WALK + " SELECT * FROM hist")
def person_speed_histogram(spark, sf_dir):
    return trajectory.histogram(_dated(spark, sf_dir))


@_register(
    "person_summary",
    _WALK
    + """ SELECT user_id, label, first_day, last_day, coalesce(days, 0) AS days, coalesce(observations, 0) AS observations, accepted - coalesce(observations, 0) AS missed,
  coalesce(split_part(last_day, '-', 1)::BIGINT - split_part(first_day, '-', 1)::BIGINT + 1, 0) AS years, CASE WHEN split_part(last_day, '-', 1) = split_part(first_day, '-', 1) THEN '%m/%Y' ELSE '%Y' END AS tick_format,
  7::BIGINT AS ticks, CASE WHEN days > 95 THEN 20 ELSE 0 END::BIGINT AS margin_extra FROM people LEFT JOIN active USING (user_id)""",
)
def person_summary(spark, sf_dir):
    accepted = _accepted(spark, sf_dir)
    return trajectory.summary(accepted, trajectory.rows(accepted, CONFIG))


_MARKS = (
    _WALK
    + """, m1 AS (
  SELECT w.*, day_idx, last({'lat': lat, 'lon': lon}) OVER (PARTITION BY w.user_id, w.dayno, run ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e, count(*) OVER (PARTITION BY w.user_id, w.dayno, run) AS share
  FROM walk w JOIN days d ON d.user_id = w.user_id AND d.dayno = w.dayno
), m2 AS (
  SELECT *, CASE WHEN rn = 1 THEN 0.0::DOUBLE ELSE log2(CASE WHEN e.lat = f.lat AND e.lon = f.lon THEN 0.0::DOUBLE ELSE 6371009.0::DOUBLE * atan2(sqrt(pow(cos(radians(f.lat)) * sin(radians(f.lon - e.lon)), 2)
    + pow(cos(radians(e.lat)) * sin(radians(f.lat)) - sin(radians(e.lat)) * cos(radians(f.lat)) * cos(radians(f.lon - e.lon)), 2)), sin(radians(e.lat)) * sin(radians(f.lat)) + cos(radians(e.lat)) * cos(radians(f.lat)) * cos(radians(f.lon - e.lon))) END + 1) / share END AS spacing FROM m1
), m3 AS (
  SELECT *, CASE WHEN rn = 1 THEN 0.0::DOUBLE ELSE sum(spacing) OVER (PARTITION BY user_id, dayno ORDER BY rn ROWS UNBOUNDED PRECEDING) + 8 * (rn - 2) END AS off FROM m2
), marks AS (
  SELECT user_id, day_idx, dayno, rn::BIGINT AS rn, tag, cls, CASE WHEN rn = 1 THEN 'first' ELSE 'inner' END AS kind, CASE WHEN clock = '00:00:00' THEN 'circle' WHEN rn = 1 THEN 'square' ELSE 'rect' END AS shape,
    CASE cls WHEN 'obscured' THEN 'rgb(255,255,255)' WHEN 'first' THEN 'rgb(128,128,128)' """
    + " ".join(f"WHEN '{c}' THEN '{DEFAULT.palette[k]}'" for c, k in CLASSES if k is not None)
    + """ END AS fill, off FROM m3
)"""
)


@_register(
    "profile_markers",
    _MARKS
    + """ SELECT user_id, day_idx, dayno, rn, tag, cls, kind, shape, fill, CASE WHEN cls = 'obscured' THEN CASE WHEN rn = 1 THEN 'rgb(0,0,0)' ELSE 'DarkGrey' END ELSE fill END AS line_color,
  CASE WHEN cls = 'obscured' THEN 1 ELSE 0 END::BIGINT AS line_width, round(off + 4, 4) AS x0, round(off + 12, 4) AS x1, -4.0::DOUBLE AS y0, 4.0::DOUBLE AS y1 FROM marks""",
)
def profile_markers(spark, sf_dir):
    return _rounded(trajectory.markers(_dated(spark, sf_dir), CONFIG).drop("offset").withColumnRenamed("day", "dayno"), x0=4, x1=4)


@_register("profile_first_markers", _MARKS + " SELECT user_id, day_idx, dayno, tag, shape, fill FROM marks WHERE kind = 'first'")
def profile_first_markers(spark, sf_dir):
    return trajectory.markers(_dated(spark, sf_dir), CONFIG).filter("kind = 'first'").select("user_id", "day_idx", F.col("day").alias("dayno"), "tag", "shape", "fill")


_BARS = ["precise", "obscured", "0", "with_time", "without_time", "0", *[f"cls_{c}" for c, _ in CLASSES]]


@_register(
    "histogram_vector",
    _WALK
    + " SELECT user_id, "
    + " || ',' || ".join(f"({b})::VARCHAR" for b in _BARS)
    + f" AS bars, precise + obscured AS sum_places, with_time + without_time AS sum_times, {' + '.join(f'cls_{c}' for c, _ in CLASSES)} AS sum_classes FROM hist",
)
def histogram_vector(spark, sf_dir):
    return trajectory.histogram_vector(trajectory.histogram(_dated(spark, sf_dir))).withColumn("bars", F.array_join("bars", ","))


@_register(
    "histogram_ticks",
    _WALK
    + """, u AS (SELECT user_id, precise + obscured AS total, CASE WHEN precise + obscured > 400 THEN 100 WHEN precise + obscured > 200 THEN 50 WHEN precise + obscured > 100 THEN 25 WHEN precise + obscured > 80 THEN 20 ELSE 10 END::BIGINT AS unit FROM hist)
  SELECT user_id, total, unit, array_to_string(list_transform(range((total + unit - 1) // unit), lambda k: k * unit), ',') AS ticks FROM u""",
)
def histogram_ticks(spark, sf_dir):
    return trajectory.histogram_ticks(trajectory.histogram(_dated(spark, sf_dir))).withColumn("ticks", F.array_join("ticks", ","))


@_register(
    "trajectory_log_lines",
    _WALK
    + """ SELECT user_id, seq, tag || ', ' || lat::VARCHAR || ', ' || lon::VARCHAR || ', ' || replace(dayno, '-', '/') || ', ' || clock || ', ' ||
  CASE WHEN rn = 1 THEN 'first entry of the day' WHEN NOT anchor THEN 'obscured' ELSE printf('%.1f', elapsed) || 's, ' || printf('%.1f', round(metres, 1)) || 'm, ' || printf('%.1f', round(kmh, 1)) || 'km/h' END AS line FROM walk""",
)
def trajectory_log_lines(spark, sf_dir):
    return trajectory.log_lines(_dated(spark, sf_dir)).select("user_id", "seq", "line")


@_register("person_selection", _GATE + " SELECT rank AS person_rank, user_id FROM ranked WHERE n >= 80")
def person_selection(spark, sf_dir):
    return rankings.selected_people(_accepted(spark, sf_dir), config=CONFIG)


@_register("person_selection_list", _GATE + " SELECT k AS person_rank, user_id FROM (VALUES (1::BIGINT, '3'), (2, '1'), (3, '4'), (4, '1'), (5, '999999')) AS t(k, user_id) WHERE user_id IN (SELECT user_id FROM acc)")
def person_selection_list(spark, sf_dir):
    return rankings.selected_people(_accepted(spark, sf_dir), ["3", "1", "4", "1", "999999"], CONFIG)


@_register(
    "person_file_labels",
    _WALK + " SELECT rank AS person_rank, r.user_id, CASE WHEN rank < 10 THEN '0' ELSE '' END || rank::VARCHAR || '-' || replace(label, '@', '_') AS label FROM ranked r JOIN people USING (user_id) WHERE n >= 80",
)
def person_file_labels(spark, sf_dir):
    accepted = _accepted(spark, sf_dir)
    people = rankings.selected_people(accepted, config=CONFIG).join(trajectory.summary(accepted, trajectory.rows(accepted, CONFIG)), "user_id")
    return people.select("person_rank", "user_id", figures.file_label(F.col("person_rank"), F.col("label")).alias("label"))


def _checks_sql() -> str:
    classes = " + ".join(f"cls_{c}" for c, _ in CLASSES)
    counts = {n: f"(SELECT count(*) FILTER ({p}) FROM acc)" for n, p in _SLICES.items()}
    people = {
        "places are observations": "precise + h.obscured = observations", "times are observations": "with_time + without_time = observations", "classes are precise": f"{classes} = precise",
        "first is days with a precise row": "cls_first = precise_days", "dated and missed are accepted": "observations + missed = accepted",
    }
    sums = {
        "precise and obscured are all": f"{counts['precise']} + {counts['obscured']} = {counts['all']}", "taxon slices are all": f"{counts['taxon_empty']} + {counts['taxon_open']} + {counts['taxon_obscured']} = {counts['all']}",
        "privacy slices are all": f"{counts['geoprivacy_empty']} + {counts['geoprivacy_obscured']} + {counts['geoprivacy_private']} = {counts['all']}", "focus slices add up": f"{counts['focus_empty']} + {counts['focus_open']} = {counts['focus_empty_open']}",
    }
    return (
        _WALK
        + """, precise_day AS (SELECT user_id, count(DISTINCT dayno) FILTER (placed) AS precise_days FROM walk GROUP BY user_id
), undated AS (SELECT user_id, count(*) FILTER (NOT coalesce(observed_on <> '' AND try_cast(split_part(observed_on, '-', 1) AS INTEGER) > 1950, false)) AS missed FROM acc GROUP BY user_id
), person AS (SELECT h.*, observations, missed, accepted, precise_days FROM hist h JOIN active USING (user_id) JOIN people USING (user_id) JOIN undated USING (user_id) JOIN precise_day USING (user_id)
), desc_n AS (SELECT n, sum(n) OVER (ORDER BY n DESC, first_seq DESC ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER () AS total FROM posters)"""
        + " UNION ALL ".join(
            [f" SELECT '{n}' AS rule, count(*) AS checked, count(*) FILTER (NOT ({r.replace('h.obscured', 'obscured')})) AS broken FROM person" for n, r in people.items()]
            + [f" SELECT '{n}', 1, CASE WHEN {r} THEN 0 ELSE 1 END" for n, r in sums.items()]
            # the largest posters that together have no more than half
            + [" SELECT 'half of the mass', 1, CASE WHEN coalesce(max(upto) FILTER (upto <= total // 2), 0) <= max(total) // 2 THEN 0 ELSE 1 END FROM desc_n"]
        )
    )


@_register("invariant_violations", _checks_sql())
def invariant_violations(spark, sf_dir):
    """Each rule with the subjects that it was checked on and those that break it."""
    return invariants.checks(_accepted(spark, sf_dir), CONFIG)


_LISTED = ["3", "1", "4", "1", "999999"]


@_register(
    "person_walks",
    _WALK + " SELECT k AS person_rank, user_id, seq, rn::BIGINT AS rn, cls, round(kmh, 4) AS kmh FROM (VALUES (1::BIGINT, '3'), (2, '1'), (3, '4'), (4, '1'), (5, '999999')) AS t(k, user_id) JOIN walk USING (user_id)",
)
def person_walks(spark, sf_dir):
    """Profiles of a list in which a person stands twice, from the clustered table of one pass through the gate."""
    gated = outputs.pass_gate(events.observations(spark, sf_dir), csv_exports.scratch(spark, "gate"), CONFIG)
    walks = outputs.person_walks(gated.accepted, _LISTED, CONFIG)
    return _rounded(walks.select("person_rank", "user_id", "seq", F.col("rn").cast("bigint").alias("rn"), "cls", "kmh"), kmh=4)


@_register("single_pass_summary", ORACLE_SQL["quality_summary"])
def single_pass_summary(spark, sf_dir):
    """The quality report from counters that were taken while the gate's rows were written."""
    gated = outputs.pass_gate(events.observations(spark, sf_dir), csv_exports.scratch(spark, "gate"), CONFIG)
    return _rounded(gated.summary(), pct=6)


def _json(value) -> str:
    return json.dumps(value, separators=(",", ":")).replace("'", "''")


@_register(
    "figure_histogram_specs",
    _WALK
    + """, u AS (SELECT *, precise + obscured AS total, CASE WHEN precise + obscured > 400 THEN 100 WHEN precise + obscured > 200 THEN 50 WHEN precise + obscured > 100 THEN 25 WHEN precise + obscured > 80 THEN 20 ELSE 10 END::BIGINT AS unit FROM hist)
  SELECT user_id, '{"width":1000,"height":700,"bars":[' || """
    + " || ',' || ".join(f"({b})::VARCHAR" for b in _BARS)
    + f""" || '],"colours":{_json(figures.bar_colours(CONFIG))},"ticks":[' || array_to_string(list_transform(range((total + unit - 1) // unit), lambda k: k * unit), ',') || '],"shapes":{_json(figures.glyphs(CONFIG))}}}' AS spec FROM u""",
)
def figure_histogram_specs(spark, sf_dir):
    return figures.histogram_spec(trajectory.histogram(_dated(spark, sf_dir)), CONFIG)


def _profile_sql(width: int) -> str:
    box = """'{"rn":' || rn || ',"kind":"' || kind || '","shape":"' || shape || '","fill":"' || fill || '","line_color":"' || CASE WHEN cls = 'obscured' THEN CASE WHEN rn = 1 THEN 'rgb(0,0,0)' ELSE 'DarkGrey' END ELSE fill END
      || '","line_width":' || CASE WHEN cls = 'obscured' THEN '1' ELSE '0' END || ',"x0":' || round(off + 4, 4)::VARCHAR || ',"x1":' || round(off + 12, 4)::VARCHAR || ',"y0":-4.0,"y1":4.0}'"""
    return _MARKS + f""" SELECT user_id, dayno, day_idx, '{{"width":{width},"height":1200,"x":"' || dayno || '","y":' || day_idx || ',"markers":[' || string_agg({box}, ',' ORDER BY rn) || ']}}' AS spec FROM marks GROUP BY user_id, dayno, day_idx"""


def _profile_specs(spark, sf_dir, wide: bool) -> DataFrame:
    marks = _rounded(trajectory.markers(_dated(spark, sf_dir), CONFIG), x0=4, x1=4)
    return figures.profile_spec(marks, wide).withColumnRenamed("day", "dayno")


@_register("figure_profile_specs", _profile_sql(1200))
def figure_profile_specs(spark, sf_dir):
    return _profile_specs(spark, sf_dir, wide=False)


@_register("figure_profile_specs_wide", _profile_sql(1600))
def figure_profile_specs_wide(spark, sf_dir):
    return _profile_specs(spark, sf_dir, wide=True)


#: People that are drawn: the tables have few with the usual number of posts.
DRAWN = Config(focus_species=CONFIG.focus_species, frequent_posts=11)


def _hundredths(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5)::BIGINT"


def _decimal(n: str) -> str:
    return f"(({n}) // 100)::VARCHAR || '.' || lpad((({n}) % 100)::VARCHAR, 2, '0')"


_LEAVES = """ SELECT person_rank, user_id, layer, page, leaf, count(*) AS elements, min(x0) / 100.0::DOUBLE AS x0, min(y0) / 100.0::DOUBLE AS y0, max(x1) / 100.0::DOUBLE AS x1, max(y1) / 100.0::DOUBLE AS y1,
  sha256(string_agg(element, chr(10) ORDER BY element)) AS sha256 FROM elements GROUP BY ALL"""
_TITLE = "'<title>' || replace(replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</title>'"


def _profile_svg_sql(kind: str) -> str:
    o = svg.LAYOUTS[kind]
    base = o.height - o.bottom
    y = f"{o.top}.0::DOUBLE + {o.inner_height}.0::DOUBLE * (1 - {{}} / (days + 1.5::DOUBLE))"
    x = "l + (({} - low) + 0.05::DOUBLE * span) / (1.1::DOUBLE * span) * across"
    return (
        _MARKS
        + f""", scale AS (
  SELECT rank AS person_rank, r.user_id, label, days, first_day::DATE AS low, last_day::DATE AS high, split_part(last_day, '-', 1)::BIGINT - split_part(first_day, '-', 1)::BIGINT + 1 AS years,
    ({o.left} + CASE WHEN days > 95 THEN 20 ELSE 0 END)::DOUBLE AS l, ({o.inner_width} - CASE WHEN days > 95 THEN 20 ELSE 0 END)::DOUBLE AS across, greatest(last_day::DATE - first_day::DATE, 1)::DOUBLE AS span
  FROM ranked r JOIN people USING (user_id) JOIN active USING (user_id) WHERE n >= {DRAWN.frequent_posts}
), placed AS (
  SELECT s.*, m.day_idx, m.rn, m.kind, m.shape, m.fill, m.cls, {_hundredths(x.format("m.dayno::DATE") + " + CASE WHEN m.kind = 'inner' THEN m.off + 4 ELSE -4.0::DOUBLE END")} AS px, {_hundredths(y.format("m.day_idx") + " - 4")} AS py
  FROM marks m JOIN scale s USING (user_id)
), numbers AS (
  SELECT *, unnest(range(0, days // unit + 1)) * unit AS v FROM (SELECT *, CASE WHEN days <= 7 THEN 1 WHEN raw <= b THEN b WHEN raw <= 2 * b THEN 2 * b WHEN raw <= 5 * b THEN 5 * b ELSE 10 * b END::BIGINT AS unit
    FROM (SELECT *, days / 7.0::DOUBLE AS raw, pow(10, floor(log10(days / 7.0::DOUBLE))) AS b FROM scale))
), sides AS (SELECT *, {_hundredths(y.format("v"))} AS py FROM numbers
), months AS (
  SELECT *, CASE WHEN years > 1 THEN (year(low) + 1) * 12 ELSE year(low) * 12 + month(low) END AS first_m, year(high) * 12 + month(high) - 1 AS last_m FROM scale
), starts AS (
  SELECT person_rank, m FROM (SELECT *, CASE WHEN years > 1 THEN 12 * ((years + 6) // 7) ELSE (greatest(last_m - first_m + 1, 1) + 6) // 7 END AS step FROM months), generate_series(first_m, last_m, step) AS g(m) WHERE first_m <= last_m
), ticks AS (
  SELECT s.*, make_date(m // 12, m % 12 + 1, 1) AS dayt FROM scale s JOIN starts USING (person_rank) UNION ALL SELECT s.*, low FROM scale s WHERE person_rank NOT IN (SELECT person_rank FROM starts)
), below AS (SELECT *, {_hundredths(x.format("dayt"))} AS px FROM ticks
), elements AS (
  SELECT person_rank, user_id, 0 AS layer, 0::BIGINT AS page, 0::BIGINT AS leaf, {_TITLE} AS element, 0::BIGINT AS x0, 0::BIGINT AS y0, {o.width * 100}::BIGINT AS x1, {o.height * 100}::BIGINT AS y1 FROM scale
  UNION ALL SELECT person_rank, user_id, 1, 0, 0, '<path d="M' || {_decimal(_hundredths("l"))} || ' ' || {_decimal("py")} || 'H' || {_decimal(_hundredths("l + across"))} || CASE WHEN v = 0 THEN '" stroke="#2a3f5f" stroke-width="1"/>' ELSE '" stroke="rgb(230,230,230)" stroke-width="0.5"/>' END
    || '<text x="' || {_decimal(_hundredths("l - 4"))} || '" y="' || {_decimal("py")} || '" fill="#2a3f5f" text-anchor="end" dominant-baseline="middle">' || v || '</text>', {_hundredths("l")}, py, {_hundredths("l + across")}, py FROM sides
  UNION ALL SELECT person_rank, user_id, 1, 0, 0, '<path d="M' || {_decimal("px")} || ' {o.top}V{base}" stroke="rgb(230,230,230)" stroke-width="0.5"/><text x="' || {_decimal("px")} || '" y="{o.height - 4}" fill="#2a3f5f" text-anchor="middle">' || CASE WHEN years > 1 THEN strftime(dayt, '%Y') ELSE strftime(dayt, '%m/%Y') END || '</text>',
    px, {o.top * 100}, px, {base * 100} FROM below
  UNION ALL SELECT person_rank, user_id, CASE WHEN kind = 'first' THEN 2 ELSE 3 END, day_idx // 100, rn // 1000,
    CASE WHEN shape = 'circle' THEN '<circle cx="' || {_decimal("px + 400")} || '" cy="' || {_decimal("py + 400")} || '" r="4' ELSE '<rect x="' || {_decimal("px")} || '" y="' || {_decimal("py")} || '" width="8" height="8' END || '" fill="' || fill || '" stroke="'
    || CASE WHEN cls = 'obscured' THEN CASE WHEN rn = 1 THEN 'rgb(0,0,0)' ELSE 'DarkGrey' END ELSE fill END || '" stroke-width="' || CASE WHEN cls = 'obscured' THEN '1' ELSE '0' END || '"/>', px, py, px + 800, py + 800 FROM placed
)"""
        + _LEAVES
    )


def _drawn(spark, sf_dir, kind: str) -> DataFrame:
    accepted = _accepted(spark, sf_dir)
    return svg.digests(svg.elements(rankings.selected_people(accepted, config=DRAWN), accepted, kind, DRAWN))


@_register("profile_svg", _profile_svg_sql("square"))
def profile_svg(spark, sf_dir):
    return _drawn(spark, sf_dir, "square")


@_register("profile_svg_wide", _profile_svg_sql("wide"))
def profile_svg_wide(spark, sf_dir):
    return _drawn(spark, sf_dir, "wide")


def _histogram_svg_sql() -> str:
    o = svg.LAYOUTS["histogram"]
    base, slot = o.height - o.bottom, o.inner_width / 15
    down = _hundredths(f"{o.top}.0::DOUBLE + {o.inner_height}.0::DOUBLE * (1 - {{}} / most)")
    left = ", ".join(str(round((o.left + (k + 0.1) * slot) * 100)) for k in range(15))
    colours = ", ".join(f"'{c}'" for c in figures.bar_colours(DRAWN))
    wide = round(0.8 * slot * 100)
    quoted = [(e.replace("'", "''"), b) for e, b in svg.below_bars(DRAWN)]
    fixed = ", ".join(f"('{e}', {a}, {b}, {c}, {d})" for e, (a, b, c, d) in quoted)
    return (
        _WALK
        + f""", drawn AS (
  SELECT rank AS person_rank, user_id, label, [{", ".join(_BARS)}]::BIGINT[] AS bars, precise + obscured AS total FROM ranked JOIN hist USING (user_id) JOIN people USING (user_id) WHERE n >= {DRAWN.frequent_posts}
), scaled AS (SELECT *, greatest(list_max(bars), 1) * 1.05::DOUBLE AS most, CASE WHEN total > 400 THEN 100 WHEN total > 200 THEN 50 WHEN total > 100 THEN 25 WHEN total > 80 THEN 20 ELSE 10 END::BIGINT AS unit FROM drawn
), ticks AS (SELECT *, {down.format("v")} AS py FROM (SELECT *, unnest(range((total + unit - 1) // unit)) * unit AS v FROM scaled) WHERE v <= most
), bars AS (SELECT *, (CAST([{left}] AS BIGINT[]))[k] AS px, {down.format("bars[k]")} AS py, (CAST([{colours}] AS VARCHAR[]))[k] AS colour FROM scaled, range(1, 16) AS t(k)
), elements AS (
  SELECT person_rank, user_id, 0 AS layer, 0::BIGINT AS page, 0::BIGINT AS leaf, {_TITLE} AS element, 0::BIGINT AS x0, 0::BIGINT AS y0, {o.width * 100}::BIGINT AS x1, {o.height * 100}::BIGINT AS y1 FROM scaled
  UNION ALL SELECT person_rank, user_id, 1, 0, 0, '<path d="M{o.left} ' || {_decimal("py")} || 'H{o.width - o.right}" stroke="' || CASE WHEN v = 0 THEN '#2a3f5f" stroke-width="1"/>' ELSE 'rgb(230,230,230)" stroke-width="0.5"/>' END
    || '<text x="{o.left - 4}" y="' || {_decimal("py")} || '" fill="#2a3f5f" text-anchor="end" dominant-baseline="middle">' || v || '</text>', {o.left * 100}, py, {(o.width - o.right) * 100}, py FROM ticks
  UNION ALL SELECT person_rank, user_id, 2, 0, 0, '<rect x="' || {_decimal("px")} || '" y="' || {_decimal("py")} || '" width="{wide / 100:.2f}" height="' || {_decimal(f"{base * 100} - py")} || '" fill="' || colour || '"/>', px, py, px + {wide}, {base * 100} FROM bars
  UNION ALL SELECT person_rank, user_id, 3, 0, 0, e, a, b, c, d FROM scaled, (VALUES {fixed}) AS f(e, a, b, c, d)
)"""
        + _LEAVES
    )


@_register("histogram_svg", _histogram_svg_sql())
def histogram_svg(spark, sf_dir):
    return _drawn(spark, sf_dir, "histogram")



_CHART_ROWS = {
    "species-alphabetical": f"SELECT row_number() OVER (ORDER BY scientific_name) AS place, {_LABEL} AS label, n FROM species",
    "species-count": f"SELECT row_number() OVER (ORDER BY n DESC, first_seq DESC) AS place, {_LABEL} AS label, n FROM species",
    "species-rank": "SELECT row_number() OVER (ORDER BY n DESC, first_seq DESC) AS place, scientific_name AS label, n FROM species WHERE contains(scientific_name, ' ')",
    "posters-top": "SELECT rank AS place, user_id || '-' || user_login AS label, n FROM ranked WHERE n > 10",
    "posters-rank": "SELECT rank AS place, user_id || '-' || user_login AS label, n FROM ranked",
    "posters-all": "SELECT rank AS place, user_id || '-' || user_login AS label, n FROM ranked",
}


def _kept_sql(chart: str, name: str) -> str:
    """Tables that end in one of the kept points: all of its rows against those that are first, last, least or largest of their pixel."""
    o = charts.LAYOUTS[chart]
    if chart in charts.LINES:
        pixel = f"CASE WHEN log10(top_place) > 0 THEN floor(log10(place) / log10(top_place) * {o.inner_width - 1}) ELSE 0 END::BIGINT"
    else:
        pixel = f"floor(((place - 1) * {o.inner_height})::DOUBLE / top_place)::BIGINT"
    return f"""{name}_all AS (SELECT *, max(place) OVER () AS top_place, max(n) OVER () AS top_n FROM ({_CHART_ROWS[chart]})), {name}_px AS (SELECT *, {pixel} AS pixel FROM {name}_all),
  {name} AS (SELECT * FROM {name}_px QUALIFY row_number() OVER (PARTITION BY pixel ORDER BY place) = 1 OR row_number() OVER (PARTITION BY pixel ORDER BY place DESC) = 1
    OR row_number() OVER (PARTITION BY pixel ORDER BY n, place) = 1 OR row_number() OVER (PARTITION BY pixel ORDER BY n DESC, place) = 1)"""


@_register(
    "chart_points",
    _GATE + ", " + ", ".join(_kept_sql(c, c.replace("-", "_")) for c in charts.LAYOUTS) + " " + " UNION ALL ".join(f"SELECT '{c}' AS chart, pixel, place, label, n FROM {c.replace('-', '_')}" for c in charts.LAYOUTS),
)
def chart_points(spark, sf_dir):
    accepted = _accepted(spark, sf_dir)
    kept = [charts.kept_points(charts.points(accepted, c, CONFIG)).select(F.lit(c).alias("chart"), "pixel", "place", "label", "n") for c in charts.LAYOUTS]
    return reduce(DataFrame.unionByName, kept)


_PLAIN_LABEL = "replace(replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _line_svg_sql(chart: str, name: str) -> str:
    o = charts.LAYOUTS[chart]
    base, right = o.height - o.bottom, o.width - o.right
    x = lambda v: _hundredths(f"{o.left}.0::DOUBLE + CASE WHEN log10(top_place) > 0 THEN log10({v}) / log10(top_place) * {o.inner_width}.0::DOUBLE ELSE 0.0 END")
    y = lambda v: _hundredths(f"{o.top}.0::DOUBLE + {o.inner_height}.0::DOUBLE * (1 - log10({v}) / (log10(top_n) + 0.1::DOUBLE))")
    d = _decimal
    return f"""{name}_e AS (
  SELECT 0 AS layer, '<path d="M{o.left} ' || {d("py")} || 'H{right}" stroke="rgb(230,230,230)"/><text x="{o.left - 6}" y="' || {d("py")} || '" fill="#2a3f5f" text-anchor="end" dominant-baseline="middle">' || v || '</text>' AS element, {o.left * 100}::BIGINT AS x0, py AS y0, {right * 100}::BIGINT AS x1, py AS y1
    FROM (SELECT *, {y("v")} AS py FROM (SELECT DISTINCT top_place, top_n, pow(10, unnest(range(0, floor(log10(top_n) + 0.1::DOUBLE)::BIGINT + 1)))::BIGINT AS v FROM {name}_all))
  UNION ALL SELECT 0, '<path d="M' || {d("px")} || ' {o.top}V{base}" stroke="rgb(230,230,230)"/><text x="' || {d("px")} || '" y="{o.height - 8}" fill="#2a3f5f" text-anchor="middle">' || v || '</text>', px, {o.top * 100}, px, {base * 100}
    FROM (SELECT *, {x("v")} AS px FROM (SELECT DISTINCT top_place, top_n, pow(10, unnest(range(0, floor(log10(top_place))::BIGINT + 1)))::BIGINT AS v FROM {name}_all))
  UNION ALL SELECT 1, '<path d="M' || {d("px")} || ' ' || {d("py")} || 'L' || {d("qx")} || ' ' || {d("qy")} || '" stroke="rgb(55,126,184)" stroke-width="4" stroke-linecap="round"/>', px, least(py, qy), qx, greatest(py, qy)
    FROM (SELECT px, py, lead(px) OVER (ORDER BY place) AS qx, lead(py) OVER (ORDER BY place) AS qy FROM (SELECT place, {x("place")} AS px, {y("n")} AS py FROM {name})) WHERE qx IS NOT NULL
  UNION ALL SELECT 2, '<circle cx="' || {d("px")} || '" cy="' || {d("py")} || '" r="4" fill="rgb(55,126,184)"><title>' || place || ' ' || {_PLAIN_LABEL} || ': ' || n || '</title></circle>', px - 400, py - 400, px + 400, py + 400 FROM (SELECT *, {x("place")} AS px, {y("n")} AS py FROM {name})
)"""


def _bar_svg_sql(chart: str, name: str) -> str:
    o = charts.LAYOUTS[chart]
    base = o.height - o.bottom
    x = lambda v: _hundredths(f"{o.left}.0::DOUBLE + {v} * ({o.inner_width}.0::DOUBLE / (top_n * 1.05::DOUBLE))")
    y = lambda part: _hundredths(f"{o.top}.0::DOUBLE + (place - {part}::DOUBLE) * ({o.inner_height}.0::DOUBLE / top_place)")
    d = _decimal
    label = f""" || '<text x="{o.left - 4}" y="' || {d("mid")} || '" font-size="' || {d("font")} || '" fill="#2a3f5f" text-anchor="end" dominant-baseline="middle">' || {_PLAIN_LABEL} || '</text>'""" if chart not in charts.PLAIN else ""
    return f"""{name}_e AS (
  SELECT 0 AS layer, '<path d="M' || {d("px")} || ' {o.top}V{base}" stroke="' || CASE WHEN v = 0 THEN '#2a3f5f' ELSE 'rgb(230,230,230)' END || '"/><text x="' || {d("px")} || '" y="{o.height - 4}" fill="#2a3f5f" text-anchor="middle">' || v || '</text>' AS element, px AS x0, {o.top * 100}::BIGINT AS y0, px AS x1, {base * 100}::BIGINT AS y1
    FROM (SELECT *, {x("v::DOUBLE")} AS px FROM (SELECT top_n, unnest(range(0, top_n // step + 1)) * step AS v FROM (SELECT top_n, CASE WHEN top_n <= 7 THEN 1 WHEN raw <= b THEN b WHEN raw <= 2 * b THEN 2 * b WHEN raw <= 5 * b THEN 5 * b ELSE 10 * b END::BIGINT AS step
      FROM (SELECT DISTINCT top_n, top_n / 7.0::DOUBLE AS raw, pow(10, floor(log10(top_n / 7.0::DOUBLE))) AS b FROM {name}_all))))
  UNION ALL SELECT 1, '<rect x="{o.left}" y="' || {d("a")} || '" width="' || {d(f"px - {o.left * 100}")} || '" height="' || {d("b - a")} || '" fill="rgb(55,126,184)"><title>' || {_PLAIN_LABEL} || ': ' || n || '</title></rect><text x="' || {d("tx")} || '" y="' || {d("mid")}
    || '" font-size="' || {d("font")} || '" fill="#2a3f5f" dominant-baseline="middle">' || n || '</text>'{label}, {o.left * 100}, a, px, b
    FROM (SELECT *, {y("0.9")} AS a, {y("0.1")} AS b, {y("0.5")} AS mid, {x("n::DOUBLE")} AS px, {x("(n + 2.0::DOUBLE)")} AS tx, {_hundredths(f"least(20.0::DOUBLE, 0.7::DOUBLE * ({o.inner_height}.0::DOUBLE / top_place))")} AS font FROM {name})
)"""


def _charts_sql() -> str:
    parts, ends = [], []
    for chart in charts.LAYOUTS:
        name = chart.replace("-", "_")
        parts += [_kept_sql(chart, name), (_line_svg_sql if chart in charts.LINES else _bar_svg_sql)(chart, name)]
        ends.append(f"SELECT '{chart}' AS chart, layer, count(*) AS elements, min(x0) / 100.0::DOUBLE AS x0, min(y0) / 100.0::DOUBLE AS y0, max(x1) / 100.0::DOUBLE AS x1, max(y1) / 100.0::DOUBLE AS y1, sha256(string_agg(element, chr(10) ORDER BY element)) AS sha256 FROM {name}_e GROUP BY layer")
    return _GATE + ", " + ", ".join(parts) + " " + " UNION ALL ".join(ends)


@_register("chart_svg", _charts_sql())
def chart_svg(spark, sf_dir):
    accepted = _accepted(spark, sf_dir)
    return reduce(DataFrame.unionByName, [charts.digests(charts.elements(accepted, c, CONFIG)).withColumn("chart", F.lit(c)) for c in charts.LAYOUTS])



def _layout_sql(kind: str) -> str:
    o = svg.LAYOUTS[kind]
    extra = "0" if kind == "histogram" else "CASE WHEN days > 95 THEN 20 ELSE 0 END"
    if kind == "histogram":
        rest = "'" + ',"captions":' + _json([{"slot": at, "text": " ".join(lines)} for at, lines in svg.CAPTIONS]) + "'"
    else:
        rest = """',"x":{"tickformat":"' || CASE WHEN split_part(last_day, '-', 1) = split_part(first_day, '-', 1) THEN '%m/%Y' ELSE '%Y' END || '","nticks":7,"range":["' || first_day || '","' || last_day || '"]},"y":{"range":[0.0,' || (days + 1.5)::DOUBLE || ']}'"""
    return f"""SELECT '{kind}' AS kind, user_id, '{{"width":{o.width},"height":{o.height},"margin":{{"l":' || ({o.left} + {extra}) || ',"r":{o.right},"b":{o.bottom},"t":{o.top}}},"font":{o.font},"title":' || to_json(label) || {rest} || '}}' AS spec FROM people JOIN active USING (user_id)"""


@_register("figure_layout_specs", _WALK + " " + " UNION ALL ".join(_layout_sql(k) for k in svg.LAYOUTS))
def figure_layout_specs(spark, sf_dir):
    """Frames of the pictures: margins, axis ranges, tick format, captions."""
    accepted = _accepted(spark, sf_dir)
    summary = trajectory.summary(accepted, trajectory.rows(accepted, CONFIG))
    return reduce(DataFrame.unionByName, [svg.layout_specs(summary, k).select(F.lit(k).alias("kind"), "user_id", "spec") for k in svg.LAYOUTS])


def _line_sql(title: str, log: bool) -> str:
    return f"""'{{"title":"{title}","x":' || rank || ',"y":' || n || ',"log":{str(log).lower()}}}'"""


def _bar_sql(title: str, key: str) -> str:
    return f"""'{{"title":"{title}","y":' || to_json({key}) || ',"x":' || n || ',"annotation":{{"x":' || (n + 2) || ',"text":"' || n || '"}}}}'"""


@_register(
    "figure_rank_specs",
    _GATE
    + f""", words AS (SELECT row_number() OVER (ORDER BY n DESC, first_seq DESC) AS rank, n FROM species WHERE contains(scientific_name, ' '))
  SELECT 'species' AS chart, rank, {_line_sql("species", True)} AS spec FROM words UNION ALL SELECT 'posters', rank, {_line_sql("posters", True)} FROM ranked
  UNION ALL SELECT 'posters-bars', rank, {_bar_sql("posters-bars", "user_id || '-' || user_login")} FROM ranked
  UNION ALL SELECT 'posters-top', rank, {_bar_sql("posters-top", "user_id || '-' || user_login")} FROM ranked WHERE n > 10""",
)
def figure_rank_specs(spark, sf_dir):
    accepted = _accepted(spark, sf_dir)
    charts = {
        "species": figures.rank_spec(figures.species_line(accepted), "species", log=True),
        "posters": figures.rank_spec(figures.poster_line(accepted), "posters", log=True),
        "posters-bars": figures.bar_spec(figures.poster_bars(accepted, CONFIG), "posters-bars"),
        "posters-top": figures.bar_spec(figures.poster_bars(accepted, CONFIG, top_only=True), "posters-top"),
    }
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("chart"), "rank", "spec") for name, rows in charts.items()])


_CSV_COLUMNS = [c for c in OBS_COLUMNS if c not in OPTIONAL_COLUMNS]


@_register(
    "csv_exports",
    f"WITH {events.SQL} SELECT family_rank, row_number() OVER (PARTITION BY family_rank ORDER BY seq) AS place, {', '.join(_CSV_COLUMNS)}, {', '.join(f'CASE WHEN family_rank > 0 THEN {c} END AS {c}' for c in OPTIONAL_COLUMNS)} FROM obs",
)
def csv_exports_query(spark, sf_dir):
    """The observations written as two families' exports and read back in ranges: files that are not there, surplus and reordered columns, line breaks in cells, one file without the private coordinates."""
    folder = csv_exports.scratch(spark, "exports")
    obs = events.observations(spark, sf_dir)
    for rank, family in enumerate(CONFIG.families[:2]):
        columns = [*reversed(_CSV_COLUMNS), *(OPTIONAL_COLUMNS if rank else ())]
        csv_exports.write_family(obs.filter(F.col("family_rank") == rank).withColumn("surplus", F.lit('x, "y"\nz')), folder, f"{family}.csv", [columns[0], "surplus", *columns[1:]])
    back = csv_exports.read_exports(spark, folder, CONFIG, range_bytes=1 << 18)
    return back.select("family_rank", csv_exports.place().alias("place"), *_CSV_COLUMNS, *OPTIONAL_COLUMNS)
