"""General charts: kept points draw what all points draw, and files are whole."""

import math
import random
from xml.etree import ElementTree

import pytest

from perigon.operators import charts
from tests.helpers import observations

SPACE = "{http://www.w3.org/2000/svg}"


@pytest.mark.parametrize("log", [True, False])
def test_kept_points_have_the_ends_of_every_pixel(spark, log):
    rng = random.Random(3)
    rows = [(k + 1, f"p{k}", rng.randint(1, 500)) for k in range(3000)]
    kept = charts.level_of_detail(spark.createDataFrame(rows, "place bigint, label string, n bigint").repartition(6), 50, log).collect()
    pixels = {}
    for place, label, n in rows:
        pixel = math.floor(math.log10(place) / math.log10(3000) * 49) if log else (place - 1) * 50 // 3000
        pixels.setdefault(pixel, []).append((place, label, n))
    assert len(kept) <= 4 * 50 and {r.pixel for r in kept} == set(pixels)
    for pixel, own in pixels.items():
        want = {min(own), max(own), min(own, key=lambda p: (p[2], p[0])), max(own, key=lambda p: (p[2], -p[0]))}
        assert {(r.place, r.label, r.n) for r in kept if r.pixel == pixel} == want
    assert {tuple(r.ends) for r in kept} == {(3000, max(n for *_, n in rows))}


def table(spark):
    rng = random.Random(5)
    return observations(spark, [{"user_id": str(int(rng.paretovariate(0.9))), "user_login": f"u<{k % 2}>", "scientific_name": f"Drosera s{int(rng.paretovariate(1))}" if k % 9 else "Drosera"} for k in range(600)])


def test_charts_are_drawn(spark, tmp_path):
    obs = table(spark)
    charts.write(obs, str(tmp_path / "c"))
    assert sorted(p.name for p in (tmp_path / "c").iterdir() if not p.name.startswith(".")) == sorted(f"{c}.{e}" for c in charts.LAYOUTS for e in ("html", "svg"))
    for chart in charts.LAYOUTS:
        root = ElementTree.parse(tmp_path / "c" / f"{chart}.svg").getroot()
        drawn = charts.points(obs, chart)
        n = drawn.rows.count()
        found = list(root.iter(f"{SPACE}circle" if drawn.is_line else f"{SPACE}rect"))
        assert len(found) == charts.kept_points(drawn).count() and (drawn.is_line or len(found) == n)  # fewer bars than pixels: all of them
        page = (tmp_path / "c" / f"{chart}.html").read_text()
        assert page.startswith("<!DOCTYPE html>") and page.rstrip().endswith("</svg></body></html>") and page.count("<title>") == len(found) + 1
    rows = charts.points(obs, "posters-rank").rows.collect()
    root = ElementTree.parse(tmp_path / "c" / "posters-rank.svg").getroot()
    first = next(iter(root.iter(f"{SPACE}circle")))
    top = max(rows, key=lambda r: r.n)
    assert float(first.get("cx")) == 100 and abs(float(first.get("cy")) - (10 + 1135 * (1 - math.log10(top.n) / (math.log10(top.n) + 0.1)))) < 0.01
    assert "u<" in first[0].text and first[0].text.startswith("1 ")


def test_one_point_and_none(spark, tmp_path):
    one = observations(spark, [{}])
    assert [e.layer for e in charts.elements(one, "posters-rank").collect()].count(2) == 1
    assert charts.elements(one.limit(0), "posters-rank").count() == 0 and charts.elements(one.limit(0), "posters-all").count() == 0
    charts.write(one.limit(0), str(tmp_path / "c"), ("posters-all",))
    assert len(ElementTree.parse(tmp_path / "c" / "posters-all.svg").getroot()) == 0
