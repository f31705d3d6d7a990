"""Hand-written observation rows and a sequential simulation of a person's days."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import types as T

from perigon.config import OBS_COLUMNS

BASE = dict.fromkeys(OBS_COLUMNS, "") | {
    "captive_cultivated": "false", "coordinates_obscured": "false", "quality_grade": "research", "scientific_name": "Drosera rotundifolia",
    "taxon_genus_name": "Drosera", "taxon_species_name": "Drosera rotundifolia", "latitude": "45.0", "longitude": "7.0", "user_id": "1", "user_login": "ann",
    "observed_on": "2020-05-01", "time_observed_at": "2020-05-01 10:00:00 UTC", "private_latitude": None, "private_longitude": None,
}

SCHEMA = T.StructType([*[T.StructField(c, T.StringType()) for c in OBS_COLUMNS], T.StructField("family_rank", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])


def number(text):
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def observations(spark, rows):
    """OBS from dictionaries with the values that differ from BASE."""
    out = []
    for k, given in enumerate(rows):
        r = BASE | {"id": str(k)} | given
        out.append((*[r[c] for c in OBS_COLUMNS], 0, given.get("seq", k), number(r["latitude"]), number(r["longitude"])))
    return spark.createDataFrame(out, SCHEMA)


def great_circle(a, b):
    if a == b:
        return 0.0
    (p, x), (q, y) = [tuple(map(math.radians, v)) for v in (a, b)]
    d = y - x
    across = math.hypot(math.cos(q) * math.sin(d), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d))
    return 6371009.0 * math.atan2(across, math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(d))


def walk(rows):
    """(seq, class, offset) of one person's rows (seq, day, clock, lat, lon, obscured), step by step."""
    found = []
    day = None
    for seq, date, clock, lat, lon, obscured in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        at = datetime.datetime.fromisoformat(f"{date} {clock}")
        if date != day:
            if day is not None:
                found += flush(state)
            day = date
            state = {"anchor": ((lat, lon), at), "wait": [], "offset": 0.0, "placed": obscured != "true", "last": None}
            found.append((seq, "first" if obscured != "true" else "obscured", 0.0))
            continue
        if obscured != "false":
            state["wait"].append(seq)
            state["last"] = (lat, lon)
            continue
        metres = great_circle((lat, lon), state["anchor"][0])
        elapsed = (at - state["anchor"][1]).total_seconds()
        speed = metres * 3.6 / elapsed if elapsed > 0 else -1.0
        if not state["placed"]:
            cls, state["placed"] = "first", True
        else:
            cls = next((c for t, c in ((200, "kmh_over_200"), (80, "kmh_80_200"), (25, "kmh_25_80"), (10, "kmh_10_25"), (5, "kmh_5_10"), (0, "kmh_0_5")) if speed > t), "instantaneous" if elapsed == 0 else "stationary")
        step = math.log2(metres + 1) / (len(state["wait"]) + 1)
        for s in state["wait"]:
            state["offset"] += step
            found.append((s, "obscured", state["offset"]))
            state["offset"] += 8
        state["offset"] += step
        found.append((seq, cls, state["offset"]))
        state["offset"] += 8
        state["wait"], state["anchor"] = [], ((lat, lon), at)
    return found + (flush(state) if day is not None else [])


def flush(state):
    out = []
    if state["wait"]:
        step = math.log2(great_circle(state["last"], state["anchor"][0]) + 1) / len(state["wait"])
        for s in state["wait"]:
            state["offset"] += step
            out.append((s, "obscured", state["offset"]))
            state["offset"] += 8
    return out
