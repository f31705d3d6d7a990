"""Observations made from the `events` table, by fixed formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigon.config import OBS_COLUMNS
from perigon.sources.csv_exports import with_points

_COLUMNS = {
    "id": "cast(event_id as string)",
    "observed_on": "case when event_id % 101 = 0 then '' when event_id % 103 = 0 then '1950-06-01' else d end",
    "time_observed_at": "case when event_id % 13 = 0 then '' else concat(d, ' ', t, ' UTC') end",
    "user_id": "cast(u as string)",
    "user_login": "concat('u', cast(u as string), case when event_id > 5000 and u % 10 = 0 then '-n' else '' end)",
    "quality_grade": "case event_id % 3 when 0 then 'research' when 1 then 'needs_id' else 'casual' end",
    "image_url": "concat(case when event_id % 2 = 0 then 'https://images.example.org/' else 'https://elsewhere.example.net/' end, cast(event_id as string), '.jpg')",
    "captive_cultivated": "case when event_id % 17 = 0 then 'true' else 'false' end",
    "place_guess": "concat('Moor \"', cast(k as string), '\", north')",
    "latitude": "case when event_id % 22 = 0 or event_id % 23 = 0 then '' else cast(cast(450 + (event_id * 7919) % 12 as double) / 10 as string) end",
    "longitude": "case when event_id % 22 = 0 then '' else cast(cast(70 + k % 4 as double) / 10 as string) end",
    "private_latitude": "case when f = 0 then null when event_id % 2 = 1 then '' else cast(cast(45 + event_id % 9 as double) / 10 as string) end",
    "private_longitude": "case when f = 0 then null when event_id % 2 = 1 then '' else cast(cast(7 + event_id % 5 as double) / 10 as string) end",
    "geoprivacy": "case event_id % 11 when 0 then 'private' when 1 then 'obscured' else '' end",
    "taxon_geoprivacy": "case event_type when 'view' then 'obscured' when 'click' then 'open' else '' end",
    "coordinates_obscured": "case when event_type = 'error' or k % 5 = 0 then 'true' else 'false' end",
    "place_country_name": "concat('Land ', cast(k % 7 as string))",
    "scientific_name": "s",
    "taxon_genus_name": "case when s in ('Nepenthaceae', 'Droseraceae') then '' else concat('Genus_', event_type) end",
    "taxon_species_name": "case when s like '% %' then s else '' end",
    "taxon_hybrid_name": "case when event_id % 37 = 0 then concat('Genus_', event_type, ' hyb', cast(k % 5 as string)) else '' end",
    "taxon_subspecies_name": "case when event_id % 41 = 0 then concat(s, ' ssp', cast(k % 3 as string)) else '' end",
    "taxon_variety_name": "case when event_id % 43 = 0 then concat(s, ' var', cast(k % 3 as string)) else '' end",
}
_NAME = (
    "case when k % 29 = 0 then 'Nepenthaceae' when k % 31 = 0 then 'Droseraceae' when k % 19 = 0 then concat('Genus_', event_type) "
    "else concat('Genus_', event_type, ' sp', cast(k % 12 as string)) end"
)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OBS from events: every event once, some a second time as from another file."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour, half = F.hour("ts"), F.floor(F.minute("ts") / 30) * 30
    base = events.select(
        "event_id", "event_type",
        F.regexp_extract("props", r'"k": *(\d+)', 1).cast("bigint").alias("k"),
        F.floor("value").cast("bigint").alias("u"),
        F.date_format("ts", "yyyy-MM-dd").alias("d"),
        F.format_string("%02d:%02d:00", hour, half).alias("t"),
    ).withColumn("s", F.expr(_NAME))
    copies = F.when((F.col("event_id") % 40 == 0) | (F.col("event_id") % 11 == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    both = base.withColumn("f", F.explode(copies))
    rows = both.select(*[F.expr(_COLUMNS[c]).alias(c) for c in OBS_COLUMNS], F.col("f").alias("family_rank"), (F.col("f").cast("bigint") * 1000000000 + F.col("event_id")).alias("seq"))
    return with_points(rows)


#: The same table in DuckDB: the column formulas are common to both dialects.
SQL = (
    "base AS (SELECT event_id, event_type, regexp_extract(props, '\"k\": *(\\d+)', 1)::BIGINT AS k, floor(value)::BIGINT AS u, "
    "strftime(ts, '%Y-%m-%d') AS d, strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%H:%M:00') AS t FROM events), "
    f"named AS (SELECT *, {_NAME} AS s FROM base), "
    "twice AS (SELECT *, 0 AS f FROM named UNION ALL SELECT *, 1 AS f FROM named WHERE event_id % 40 = 0 OR event_id % 11 = 0), "
    "obs AS (SELECT "
    + ", ".join(f"{_COLUMNS[c]} AS {c}" for c in OBS_COLUMNS)
    + ", f AS family_rank, f::BIGINT * 1000000000 + event_id AS seq FROM twice)"
)
