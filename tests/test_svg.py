"""Pictures of people as SVG: layout against a reckoning by hand, valid files, one for each selected person."""

import datetime
from xml.etree import ElementTree

import pytest

from perigon.config import Config
from perigon.operators import rankings, svg, trajectory
from tests.helpers import observations

SPACE = "{http://www.w3.org/2000/svg}"


def people(spark, *ids):
    return spark.createDataFrame([(k + 1, i) for k, i in enumerate(ids)], "person_rank bigint, user_id string")


def table(spark):
    rows = []
    for k in range(40):
        rows.append({"user_id": str(k % 2), "user_login": ["an<n@x", "bo"][k % 2], "observed_on": f"20{18 + k // 10}-{1 + k % 12:02d}-0{1 + k % 3}", "latitude": str(45 + k / 100), "coordinates_obscured": ["false", "true", "false"][k % 3], "time_observed_at": "" if k % 5 == 0 else f"x {6 + k % 12:02d}:00:00 UTC"})
    rows += [{"user_id": "1", "user_login": "bo", "observed_on": "2019-02-01", "time_observed_at": f"x 1{k}:30:00 UTC", "longitude": str(7 + k / 10)} for k in range(5)]
    return observations(spark, rows + [{"user_id": "9", "observed_on": ""}])


def test_positions(spark):
    obs = table(spark)
    rows = svg.profile_elements(people(spark, "1"), obs, "square").collect()
    dated = trajectory.rows(obs)
    marks = {(m.day_idx, m.rn): m for m in trajectory.markers(dated).filter("user_id = '1'").collect()}
    days = sorted({datetime.date.fromisoformat(m.day) for m in marks.values()})
    low, span = days[0], (days[-1] - days[0]).days
    drawn = [r for r in rows if r.layer in (2, 3)]
    assert len(drawn) == len(marks)
    for r in drawn:
        m = marks[divmod(r["at"], 1_000_000_000)]
        x = 50 + ((datetime.date.fromisoformat(m.day) - low).days + 0.05 * span) / (1.1 * span) * 1140 + (m.x0 if m.kind == "inner" else -4)
        y = 10 + 1150 * (1 - m.day_idx / (len(days) + 1.5)) - 4
        assert abs(r.x0 - x * 100) <= 0.51 and abs(r.y0 - y * 100) <= 0.51 and (r.x1 - r.x0, r.y1 - r.y0) == (800, 800)
        assert (m.shape == "circle") == r.element.startswith("<circle") and f'fill="{m.fill}" stroke="{m.line_color}"' in r.element


def test_files_of_selected_people(spark, tmp_path):
    obs = table(spark)
    svg.write(people(spark, "1", "0", "1", "9"), obs, str(tmp_path / "v"))
    names = sorted(p.name for p in (tmp_path / "v").iterdir() if not p.name.startswith("."))
    # listed twice: drawn twice; without a date: not at all
    assert names == sorted(f"profile_0{k}-{label}{end}" for k, label in ((1, "bo"), (2, "an_n_x"), (3, "bo")) for end in svg.SUFFIX.values())
    for name in names:
        root = ElementTree.parse(tmp_path / "v" / name).getroot()
        assert root.tag == f"{SPACE}svg" and root[0].tag == f"{SPACE}title"
    marks = trajectory.markers(trajectory.rows(obs)).filter("user_id = '0'").count()
    root = ElementTree.parse(tmp_path / "v" / "profile_02-an_n_x.svg").getroot()
    assert root[0].text == "an<n@x" and sum(e.get("stroke-width") in ("0", "1") and e.tag != f"{SPACE}path" for e in root) == marks
    assert [e.text for e in root.iter(f"{SPACE}text") if len(e.text or "") == 4] == ["2019", "2020", "2021"]


def test_histogram(spark):
    rows = svg.histogram_elements(people(spark, "1"), table(spark)).orderBy("layer", "at").collect()
    bars = [r for r in rows if r.layer == 2]
    own = trajectory.histogram_vector(trajectory.histogram(trajectory.rows(table(spark)))).filter("user_id = '1'").first().bars
    most = max(own) * 1.05
    assert len(bars) == 15 and all(abs((r.y1 - r.y0) - 62000 * n / most) <= 1 for r, n in zip(bars, own))
    assert len([r for r in rows if r.layer == 3]) == 18 + 3
    text = "".join(r.element for r in rows)
    ElementTree.fromstring(svg.head("histogram") + text + "</svg>")
    assert "with/without" in text and "precise/" in text


@pytest.mark.parametrize("days,unit", [(1, 1), (7, 1), (8, 2), (14, 2), (15, 5), (35, 5), (36, 10), (70, 10), (71, 20), (701, 200)])
def test_numbers_at_the_side(spark, days, unit):
    assert spark.createDataFrame([(days,)], "days bigint").select(svg.day_unit()).first()[0] == unit


def test_nobody(spark, tmp_path):
    svg.write(people(spark).limit(0), table(spark), str(tmp_path / "v"), ("square",))
    assert not list((tmp_path / "v").iterdir())
    assert rankings.selected_people(table(spark), config=Config(frequent_posts=99)).count() == 0
