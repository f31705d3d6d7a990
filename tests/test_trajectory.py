import math
import random

import pytest

from perigon.operators import invariants, trajectory
from tests.helpers import great_circle, observations, walk


def days(spark, rows):
    dated = trajectory.rows(observations(spark, rows))
    return dated, {r.seq: r for r in trajectory.walked(dated).collect()}, {r.tag: r for r in trajectory.markers(dated).collect()}


def test_years_and_times(spark):
    rows = [{"observed_on": "1950-12-31"}, {"observed_on": "1951-01-01"}, {"observed_on": ""}, {"time_observed_at": ""}, {"time_observed_at": "2020-05-01 00:00:00 UTC"}]
    dated = trajectory.rows(observations(spark, rows)).orderBy("seq").collect()
    assert [r.seq for r in dated] == [1, 3, 4]
    assert [(r.clock, r.timed) for r in dated[1:]] == [("00:00:00", False), ("00:00:00", True)]


@pytest.mark.parametrize("metres_per_hour,cls", [(5, "kmh_0_5"), (5.01, "kmh_5_10"), (10.01, "kmh_10_25"), (25.01, "kmh_25_80"), (80.01, "kmh_80_200"), (200.01, "kmh_over_200")])
def test_classes(spark, metres_per_hour, cls):
    degrees = metres_per_hour * 1000 / (6371009.0 * 3.141592653589793 / 180)
    rows = [{"longitude": "7", "latitude": "0"}, {"longitude": "7", "latitude": repr(degrees * 0.999999), "time_observed_at": "2020-05-01 11:00:00 UTC"}]
    _, got, _ = days(spark, rows)
    assert got[1].cls == cls


def test_no_time_or_no_distance(spark):
    rows = [{}, {"latitude": "46.0"}, {"latitude": "46.0", "time_observed_at": "2020-05-01 10:30:00 UTC"}]
    _, got, _ = days(spark, rows)
    assert [got[k].cls for k in range(3)] == ["first", "instantaneous", "stationary"]
    assert got[2].metres == 0 and got[1].kmh == -1


def test_obscured_first_row_is_an_anchor_and_the_next_is_gray(spark):
    rows = [{"coordinates_obscured": "true"}, {"latitude": "45.5", "time_observed_at": "2020-05-01 11:00:00 UTC"}, {"coordinates_obscured": "", "time_observed_at": "2020-05-01 12:00:00 UTC"}]
    _, got, marks = days(spark, rows)
    assert [got[k].cls for k in range(3)] == ["obscured", "first", "obscured"]
    assert got[1].metres > 50_000 and marks["iN-o0"].fill == "rgb(255,255,255)" and marks["iN-o0"].line_color == "rgb(0,0,0)" and marks["iN-p1"].fill == "rgb(128,128,128)"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_a_walk_step_by_step(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(250):
        rows.append({
            "user_id": str(rng.randrange(6)), "latitude": str(45 + rng.randrange(4) / 10), "longitude": str(7 + rng.randrange(3) / 10),
            "observed_on": f"2020-05-{rng.randrange(1, 9):02d}", "time_observed_at": rng.choice(["", f"x {rng.randrange(6, 20):02d}:{rng.choice(['00', '30'])}:00 UTC"]),
            "coordinates_obscured": rng.choice(["true", "false", "false"]),
        })
    rng.shuffle(rows)
    dated, got, marks = days(spark, rows)
    by_person = {}
    for r in dated.collect():
        by_person.setdefault(r.user_id, []).append((r.seq, r.day, r.clock, r.lat, r.lon, r.obscured))
    offsets = {int(m.tag[4:]): m.offset for m in marks.values()}
    for own in by_person.values():
        for seq, cls, offset in walk(own):
            assert got[seq].cls == cls and abs(offsets[seq] - offset) < 1e-9
    checked = {r.rule: (r.checked, r.broken) for r in invariants.checks(observations(spark, rows)).collect()}
    assert len(checked) == 10 and checked["classes are precise"] == (len(by_person), 0) and checked["half of the mass"] == (1, 0) and not any(b for _, b in checked.values())


def test_log_and_summary(spark, tmp_path):
    rows = [{"seq": 5}, {"latitude": "45.01", "time_observed_at": "2020-05-01 11:00:00 UTC", "seq": 6}, {"observed_on": "", "user_login": "bea", "seq": 9}, {"user_id": "2", "observed_on": "", "seq": 3}]
    obs = observations(spark, rows)
    dated = trajectory.rows(obs)
    people = {r.user_id: r for r in trajectory.summary(obs, dated).collect()}
    assert (people["1"].label, people["1"].days, people["1"].observations, people["1"].missed, people["1"].tick_format) == ("bea", 1, 2, 1, "%m/%Y")
    assert (people["2"].days, people["2"].missed) == (0, 1)
    trajectory.write_log(spark.createDataFrame([(1, "1"), (2, "2")], "person_rank bigint, user_id string"), obs, str(tmp_path / "log"))
    lines = "\n".join(r.value for r in spark.read.text(str(tmp_path / "log")).collect())
    assert "bea, active from 2020/05/01 to 2020/05/01" in lines
    assert "iN-p1, 45.01, 7.0, 2020/05/01, 11:00:00, 3600.0s, 1112.0m, 1.1km/h" in lines and "first entry of the day" in lines


def test_broken_rules_are_counted(spark):
    """Values of coordinates_obscured beside true and false break the sums over slices and classes."""
    checked = {r.rule: (r.checked, r.broken) for r in invariants.checks(observations(spark, [{}, {"coordinates_obscured": ""}, {"user_id": "2"}])).collect()}
    assert checked["precise and obscured are all"] == (1, 1) and checked["classes are precise"] == (2, 1) and checked["times are observations"] == (2, 0)


def test_offsets_of_a_long_day_do_not_drift(spark):
    """6,000 steps of one day: each offset is the exact sum of the spacings, not a running sum of doubles."""
    places = [(45.0, 7.0), (45.3, 7.2), (45.1, 7.3), (45.7, 7.0), (45.2, 7.1)]
    rng = random.Random(4)
    turns = [rng.randrange(5) for _ in range(6000)]
    rows = [{"latitude": str(places[p][0]), "longitude": str(places[p][1])} for p in turns]
    got = {int(m.tag[4:]): m.offset for m in trajectory.markers(trajectory.rows(observations(spark, rows))).select("tag", "offset").collect()}
    steps = [math.log2(great_circle(places[b], places[a]) + 1) for a, b in zip(turns, turns[1:])]
    exact, parts = 0, 1 << 60
    for k, step in enumerate(steps, 1):
        exact += int(step * parts)
        assert abs(got[k] - (exact / parts + 8 * (k - 1))) < 5e-11
