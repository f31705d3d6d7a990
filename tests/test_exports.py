import random
import struct
import zipfile
import zlib
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from perigon.config import Config
from perigon.operators import documents, exports, figures, rankings
from tests.helpers import observations

ROWS = [
    {"private_latitude": "", "private_longitude": "9.5", "user_login": 'a"b', "place_guess": 'near "x", y'},
    {"coordinates_obscured": "true", "taxon_geoprivacy": "open", "taxon_hybrid_name": "Drosera x hybrida", "taxon_genus_name": "A&B", "place_country_name": 'C "q"'},
    {"coordinates_obscured": "true", "private_latitude": "44.4", "private_longitude": "", "taxon_subspecies_name": "D rot ssp", "image_url": "https://images.example.org/1.jpg"},
    {"taxon_species_name": "Drosera", "geoprivacy": "private", "image_url": "https://other.example.net/2.jpg"},
]


def test_slices_use_private_columns_even_if_blank(spark, tmp_path):
    obs = observations(spark, ROWS)
    lines = {(r.slice, r.seq): r.line for r in exports.slices(obs).collect()}
    assert lines["all", 0] == '0\t1\ta"b\t\t9.5' and lines["all", 1].endswith("\t45.0\t7.0")
    assert ("obscured", 1) in lines and ("precise", 1) not in lines and ("focus_open", 1) in lines and ("focus_empty_open", 0) in lines
    exports.write_slices(obs, str(tmp_path / "s"))
    assert (tmp_path / "s" / "all.tsv").read_text().splitlines() == [lines["all", k] for k in range(4)]
    assert len(list((tmp_path / "s").iterdir())) == 13 and (tmp_path / "s" / "geoprivacy_obscured.tsv").read_text() == ""


def test_waypoints(spark, tmp_path):
    obs = observations(spark, ROWS)
    precise = {r.seq: r for r in exports.waypoints(obs).collect()}
    assert set(precise) == {0, 2, 3} and (precise[0].lat, precise[0].lon) == ("45.0", "9.5") and (precise[2].lat, precise[2].lon) == ("44.4", "7.0")
    assert precise[3].label == "Drosera " and precise[0].label == "Drosera rotundifolia"
    hidden = exports.waypoints(obs, precise=False)
    assert [(r.seq, r.label) for r in hidden.collect()] == [(1, "A&B x hybrida")]
    assert "A&amp;B" in exports.gpx_elements(hidden).first().element and "A&B" in exports.gpx_elements(hidden, compat=True).first().element


def many(spark, n=3000):
    return observations(spark, [{"latitude": f"{k % 80}.5", "taxon_genus_name": f"G&{k}"} for k in range(n)]).repartition(7)


def test_one_document_a_track(spark, tmp_path):
    obs = many(spark)
    points = exports.waypoints(obs)
    want = [(r.lat, r.label) for r in points.orderBy("seq").collect()]
    for turn in range(2):  # a second run replaces the first one's files
        exports.write_gpx(points, str(tmp_path / "t"))
        exports.write_kml(points, str(tmp_path / "t"))
        exports.write_kmz(points, str(tmp_path / "t"))
        assert sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")) == ["track.gpx", "track.kml", "track.kmz"]
    gpx = ElementTree.parse(tmp_path / "t" / "track.gpx").getroot()
    space = "{http://www.topografix.com/GPX/1/1}"
    assert [(w.get("lat"), w.find(f"{space}name").text) for w in gpx] == want and len(want) == 3000
    kml = ElementTree.parse(tmp_path / "t" / "track.kml").getroot()[0]
    assert [p[0].text for p in kml] == [label for _, label in want]
    with zipfile.ZipFile(tmp_path / "t" / "track.kmz") as archive:
        assert archive.testzip() is None and archive.namelist() == ["doc.kml"]
        assert archive.read("doc.kml") == (tmp_path / "t" / "track.kml").read_bytes()


def test_parts_of_very_many_tasks_are_in_order():
    names = [f"/x/file=a/part-{k:05d}-u.c000.txt" for k in (3, 99_999, 100_000, 250_000)] + ["/x/file=a/part-250000-u.c001.txt"]
    assert sorted(reversed(names), key=documents.part_order) == names


def test_tracks_without_points(spark, tmp_path):
    none = exports.waypoints(observations(spark, ROWS).limit(0))
    exports.write_gpx(none, str(tmp_path / "t"))
    exports.write_kmz(none, str(tmp_path / "t"))
    assert len(ElementTree.parse(tmp_path / "t" / "track.gpx").getroot()) == 0
    with zipfile.ZipFile(tmp_path / "t" / "track.kmz") as archive:
        assert archive.read("doc.kml").decode() == exports.KML_HEAD + "\n</Document></kml>\n"


def test_failures_leave_nothing(spark, tmp_path):
    bad = exports.gpx_elements(exports.waypoints(many(spark, 50))).withColumn("element", F.when(F.col("seq") == 49, F.raise_error(F.lit("lost"))).otherwise(F.col("element")))
    with pytest.raises(Exception, match="lost"):
        exports.write_document(bad, str(tmp_path / "t"), "t.gpx", "head")
    assert [p for p in (tmp_path / "t").iterdir()] == []


def test_pieces_of_an_archive(spark, tmp_path, monkeypatch):
    """Checksums of parts give that of the whole, and archives beyond 4 GB get the long forms."""
    rng = random.Random(1)
    for n in (0, 1, 100, 70_000):
        a, b = rng.randbytes(1000), rng.randbytes(n)
        assert documents.joined_crc(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)
    text = b"".join(documents._deflated(p, last) for p, last in ((b"abc" * 50, False), (b"", False), (b"xyz", True)))
    assert zlib.decompress(text, -15) == b"abc" * 50 + b"xyz"
    before, after = documents._zip_frame(b"doc.kml", 1, 5 << 30, 6 << 30)
    assert struct.unpack("<HHQQ", before[-20:]) == (1, 16, 6 << 30, 5 << 30) and b"PK\6\6" in after and b"PK\6\7" in after


def test_clean_lines(spark, tmp_path):
    obs = observations(spark, ROWS)
    lines = {r.seq: r.line for r in exports.clean_lines(obs).collect()}
    assert lines[0] == '0,in-precise,45.0,9.5,,Drosera,rotundifolia,,,0,"",2020/05/01,"near x, y","a""b","1",unverified,'
    assert lines[1].startswith("1,in-obscured,45.0,7.0,,A&B,x hybrida,,,1,") and lines[2].endswith(",https://images.example.org/1.jpg") and ",ssp," in lines[2]
    compat = {r.seq: r.line for r in exports.clean_lines(obs, compat=True).collect()}
    assert compat[2].startswith("2,in-precise,44.4,in-obscured,7.0,")
    exports.write_clean(obs, str(tmp_path / "c"))
    assert (tmp_path / "c" / "clean.csv").read_text().splitlines() == [exports.CLEAN_HEADER, *[lines[k] for k in range(4)]]


def test_rankings(spark):
    users = ["a"] * 5 + ["b"] * 3 + ["c"] * 3 + ["d"] + ["e"]
    obs = observations(spark, [{"user_id": u, "user_login": u.upper() + ("2" if k == 1 else "")} for k, u in enumerate(users)])
    ranked = {(r.user_id, r.user_login): r["rank"] for r in rankings.ranked(rankings.poster_counts(obs)).collect()}
    assert ranked == {("a", "A"): 1, ("c", "C"): 2, ("b", "B"): 3, ("a", "A2"): 6, ("d", "D"): 5, ("e", "E"): 4}
    half = rankings.half_mass(rankings.poster_counts(obs)).first()
    assert (half.people, half.posts, half.total, half.posters) == (2, 4 + 3 - 0, 13, 6) or (half.posts <= 6 and half.total == 13)
    assert [r.n for r in rankings.posters_csv(obs).filter("user_id = 'a'").collect()] == [4]
    tags = rankings.tag_pages(obs, 2).filter("user_login = 'B'").orderBy("page").collect()
    assert [(r.page, r.tags) for r in tags] == [(0, ["i5", "i6"]), (1, ["i7"])]
    low = {r.at_most: r.people for r in rankings.low_contributors(rankings.poster_counts(obs)).collect()}
    assert low == {5: 6, 3: 5, 2: 3, 1: 3}
    people = rankings.selected_people(obs, config=Config(frequent_posts=3)).collect()
    assert sorted((r.person_rank, r.user_id) for r in people) == [(1, "a"), (2, "c"), (3, "b")]
    listed = rankings.selected_people(obs, ["b", "a", "b", "zz"]).collect()
    assert sorted((r.person_rank, r.user_id) for r in listed) == [(1, "b"), (2, "a"), (3, "b")]
    assert rankings.half_mass(rankings.poster_counts(obs.limit(0))).first().people is None


def test_figures(spark):
    assert len(figures.glyphs()) == 6 + 4 + 8 and len(figures.bar_colours()) == 15
    bars = figures.species_bars(observations(spark, [{"scientific_name": "Drosera"}, {}])).collect()
    assert {r.label for r in bars} == {"Drosera (unclassified)", "Drosera rotundifolia"}


def test_posters_csv(spark, tmp_path):
    obs = observations(spark, [{"user_id": u, "user_login": name} for u, name in [("2", "bo"), ("1", "an"), ("2", "bo"), ("1", "an-new"), ("3", "cy, x")]])
    rankings.write_posters_csv(obs, str(tmp_path / "p"))
    lines = (tmp_path / "p" / "posters.csv").read_text().splitlines()
    assert lines == ["2,bo,2", "1,an,1", '3,"cy, x",1']
    tags = rankings.poster_tags(obs).collect()
    assert sorted((r.user_id, r.user_login, r.place, r.tag) for r in tags) == [("1", "an", 1, "i1"), ("1", "an-new", 1, "i3"), ("2", "bo", 1, "i0"), ("2", "bo", 2, "i2"), ("3", "cy, x", 1, "i4")]


def test_pages_of_specifications(spark, tmp_path):
    obs = observations(spark, [{"user_id": "1", "user_login": "a</script>"}, {"user_id": "2"}])
    figures.write_html(figures.bar_spec(figures.poster_bars(obs), "posters"), str(tmp_path / "h"), "posters")
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "h")).collect())
    assert text.count("<script") == 2 and "a\\u003c/script>" in text and "<!DOCTYPE html>" in text
