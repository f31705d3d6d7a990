import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from perigon.operators import ingest, quality
from perigon.plans import catalogue
from perigon.sources import csv_exports, csv_splits
from tests.helpers import OBS_COLUMNS, observations


def kept(spark, rows):
    return sorted((r.seq, r.taxon_genus_name) for r in ingest.accepted(observations(spark, rows)).collect())


def test_first_accepted_copy_wins(spark):
    rows = [{"id": "a", "latitude": ""}, {"id": "a"}, {"id": "a"}, {"id": "b", "captive_cultivated": "true"}, {"id": "b"}, {"id": "c", "taxon_genus_name": ""}]
    assert [s for s, _ in kept(spark, rows)] == [1, 4]
    reasons = {r.seq: r.reason for r in ingest.rejects(observations(spark, rows)).collect()}
    assert reasons == {0: "no coordinates", 2: "duplicate", 3: "captive", 5: "no genus"}


def test_genus_repair(spark):
    rows = [{"taxon_genus_name": "", "scientific_name": "Nepenthaceae"}, {"taxon_genus_name": "", "scientific_name": "Droseraceae"}]
    assert kept(spark, rows) == [(0, "Nepenthes")]


def test_private_counters(spark):
    private = {"geoprivacy": "private"}
    rows = [private | {"id": "p", "latitude": ""}, private | {"id": "p", "latitude": ""}, private | {"id": "q", "taxon_genus_name": ""}, private | {"id": "r"}, private | {"id": "r"}, private | {"id": "s", "captive_cultivated": "true"}]
    one = ingest.private_counters(observations(spark, rows)).first()
    assert (one.private, one.private_without_coordinates) == (4, 2)


def test_summary_of_nothing_has_null_percentages(spark):
    rows = quality.summary(observations(spark, [{}]).limit(0)).collect()
    assert {r.value for r in rows} == {0} and {r.pct for r in rows} == {None}


def write(path, header, lines):
    path.write_text(",".join(header) + "\n" + "\n".join(lines) + "\n", encoding="utf-8")


def test_exports_are_read_by_header(spark, tmp_path):
    plain = [c for c in OBS_COLUMNS if not c.startswith("private")]
    cells = {c: "" for c in OBS_COLUMNS} | {"id": "1", "latitude": "4.5", "longitude": "x", "place_guess": '"by the ""lake"", near\nthe hut"', "scientific_name": "Drosera x"}
    write(tmp_path / "droseraceae.csv", plain, [",".join(cells[c] for c in plain)])
    both = [*reversed(OBS_COLUMNS), "extra"]
    second = cells | {"id": "2", "private_latitude": "", "private_longitude": "8.5", "place_guess": ""}
    write(tmp_path / "cephalotaceae.csv", both, [",".join(second.get(c, "more") for c in both) + ",surplus", second["taxon_variety_name"] + ",short"])
    obs = csv_exports.read_exports(spark, str(tmp_path))
    rows = obs.orderBy("seq").collect()
    assert [r.id for r in rows] == ["1", "2", ""] and [r.family_rank for r in rows] == [0, 6, 6]
    assert rows[0].place_guess == 'by the "lake", near\nthe hut' and rows[0].lat == 4.5 and rows[0].lon is None
    assert rows[0].private_latitude is None and rows[1].private_latitude == "" and rows[1].private_longitude == "8.5"
    write(tmp_path / "nepenthaceae.csv", plain[1:], [""])
    with pytest.raises(ValueError, match="lacks the columns"):
        csv_exports.read_exports(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        csv_exports.read_exports(spark, str(tmp_path / "none"))


def tricky(rng, columns, n):
    """Lines of cells with line breaks, doubled and stray quotes, short and long rows, blank lines."""
    cells = ["", "a", "b c", '"q, r"', '"two\nlines"', '"a ""word"" b"', '""', '"CR\r\nLF"', '5" pot', "über", '"x,\n\n""y"""', "日本"]
    out = []
    for _ in range(n):
        row = ["id"] + rng.choices(cells, k=rng.choice([columns - 1] * 4 + [columns - 3, columns + 2]))
        out.append(",".join(row) + rng.choice(["\n", "\r\n"]))
        if rng.random() < 0.1:
            out.append(rng.choice(["\n", "\r\n\n"]))
    return out


@pytest.mark.parametrize("seed,size,end", [(1, 37, True), (2, 64, False), (3, 1000, True), (4, 1 << 20, False)])
def test_ranges_give_the_rows_of_one_reader(spark, tmp_path, seed, size, end):
    rng = random.Random(seed)
    names = ["id", *[f"c{k}" for k in range(5)]]
    text = rng.choice(["", "\ufeff"]) + rng.choice(["", "\n\n"]) + ",".join(names) + "\r\n" + "".join(tricky(rng, len(names), 120))
    text = text if end else text.rstrip("\r\n")
    (tmp_path / "f.csv").write_bytes(text.encode())
    path = f"file:{tmp_path}/f.csv"
    assert csv_splits.header(path)[0] == names
    got = csv_splits.read(spark, path, {n: k for k, n in enumerate(names)}, size)
    rows = sorted(tuple(r) for r in got.collect())
    plain = text.removeprefix("\ufeff").replace("\r\n", "\n")
    want = [r for r in csv.reader(io.StringIO(plain)) if r][1:]
    assert rows == [(k, *[r[i] if i < len(r) else None for i in range(len(names))]) for k, r in enumerate(want)]
    tasks = len(csv_splits.ranges(spark, path, size))
    assert tasks == -(-(len(text.encode()) - 3 * text.startswith("\ufeff")) // size) and (size > 100_000 or got.rdd.getNumPartitions() == tasks > 1)


def test_states_against_a_walk_byte_by_byte():
    rng = random.Random(7)
    for _ in range(3000):
        data = bytes(rng.choice(b'ab,"\n\r') for _ in range(rng.randint(0, 14)))
        found = csv_splits.outcomes(data)
        for start in csv_splits.STATES:
            state, ended, first = start, 0, None
            for k, byte in enumerate(data):
                state, more = csv_splits.step(state, byte)
                ended += more
                first = (k + 1, "N") if more and first is None else first
            assert found[start] == (state, ended) and csv_splits.next_record(data, start) == first


def test_files_without_rows(spark, tmp_path):
    for k, text in enumerate(["", "a,b", "a,b\n", "\n\n"]):
        (tmp_path / f"{k}.csv").write_text(text)
        assert csv_splits.read(spark, f"file:{tmp_path}/{k}.csv", {"a": 0, "b": 1}, 2).count() == 0


def test_both_readers_number_rows_alike(spark, tmp_path):
    columns = list(OBS_COLUMNS)
    cells = {c: "" for c in columns} | {"latitude": "4.5", "longitude": "7"}
    lines = []
    for k in range(300):
        own = cells | {"id": str(k), "place_guess": ['"by the ""lake"",\nnear"', "plain", '"a, b"'][k % 3]}
        lines.append(",".join(own[c] for c in columns[: len(columns) - 3 * (k % 7 == 0)]) + ",more" * (k % 5 == 0))
    write(tmp_path / "droseraceae.csv", columns, lines)
    path = str(tmp_path / "droseraceae.csv")
    many = csv_exports.read_family(spark, path, 3, range_bytes=999)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, csv_exports.read_family_whole(spark, path, 3).collect()))
    assert many.rdd.getNumPartitions() > 10
    back = many.withColumn("other", F.lit('x\n"y"')).repartition(5)
    csv_exports.write_family(back, str(tmp_path / "again"), "droseraceae.csv", ["other", *columns])
    assert sorted(map(tuple, csv_exports.read_family(spark, str(tmp_path / "again/droseraceae.csv"), 3, range_bytes=500).collect())) == sorted(map(tuple, many.collect()))


def in_order(rows):
    """The gate, row by row: seq to reason."""
    seen, out = set(), {}
    for seq, r in rows:
        if r["captive_cultivated"] == "true":
            out[seq] = "captive"
        elif r["id"] in seen:
            out[seq] = "duplicate"
        elif not r["latitude"] or not r["longitude"]:
            out[seq] = "no coordinates"
        elif not r["taxon_genus_name"]:
            out[seq] = "no genus"
        else:
            seen.add(r["id"])
            out[seq] = None
    return out


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_gate_against_a_walk_in_order_with_a_hot_id(spark, broadcast):
    rng = random.Random(11)
    rows = [{"id": "" if rng.random() < 0.4 else str(rng.randrange(60)), "captive_cultivated": rng.choice(["true", "false", "false"]), "latitude": rng.choice(["", "1", "2"]), "longitude": "3", "taxon_genus_name": rng.choice(["", "Drosera"]), "scientific_name": "x"} for _ in range(400)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = {r.seq: r.reason for r in ingest.gated(observations(spark, rows).repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == in_order(list(enumerate(rows)))


def test_a_hot_id_is_split(spark):
    """A third of the rows with a blank id, beyond what is sent to all tasks: the exchange's large partition is read in parts."""
    rows = observations(spark, [{}]).drop("id", "seq").crossJoin(spark.range(60_000)).withColumn("seq", F.col("id")).withColumn("id", F.when(F.col("id") % 3 == 0, "").otherwise((F.col("id") / 2).cast("bigint").cast("string")))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        gate = ingest.gated(rows)
        assert gate.filter("reason is null").count() == rows.select("id").distinct().count()
        gate.write.format("noop").mode("overwrite").save()
        final = gate.collect() and gate._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in final and "Window" not in final
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_places_of_exported_rows_need_no_sort_of_a_family(spark, tmp_path):
    """Places are those of a sort by seq, with many ranges, blank lines and both readers; the query sorts and exchanges no family."""
    path = tmp_path / "droseraceae.csv"
    columns = [c for c in OBS_COLUMNS if not c.startswith("private_")]
    path.write_text(",".join(columns) + "\n" + "".join(f'{k},"a\nb {k}"' + "," * (len(columns) - 2) + "\n" * (1 + (k % 5 == 0)) for k in range(300)))
    for rank in (0, 3):
        for rows in (csv_exports.read_family(spark, str(path), rank, range_bytes=700), csv_exports.read_family_whole(spark, str(path), rank)):
            got = {int(r.id): r.place for r in rows.select("id", csv_exports.place().alias("place")).collect()}
            assert got == {k: k + 1 for k in range(300)}
    back = catalogue.QUERIES["csv_exports"](spark, "/root/testdata/sf0.001")
    assert "Window" not in back._jdf.queryExecution().executedPlan().toString()
