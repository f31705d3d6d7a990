import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from perigon.llm import warc

PAGES = [(7, "http://a/", "same"), (3, "http://b/", "same"), (9, None, None), (2, "http://c/", ""), (4, "http://d/", "x" * 200_000), (4, "http://d/", "x" * 200_000), (None, "http://e/", "same"), (None, "http://f/", "alone"), (11, "http://g/\r\nX: y", "ünï\r\n\r\nWARC/1.1")]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("payload", F.lit(1)).withColumn("record_type", F.lit("clash"))


def expected():
    first = {}
    for p, _, h in PAGES:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, _, h in PAGES:
        data = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and p != f and sum((x[2] or "") == (h or "") for x in PAGES) > 1
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = warc.report(spark, pages(spark)).collect()
    assert sorted([tuple(r) for r in got], key=str) == expected()


def test_predicates_are_decided_on_headers(spark, tmp_path):
    warc.write_pages(pages(spark), str(tmp_path / "a"))
    found = warc.read_warc(spark, str(tmp_path / "a"), payload="none")
    assert found.count() >= len(PAGES) and found.filter("payload is not null").count() == 0
    chosen = found.filter("record_type = 'revisit' and target_uri like 'http://a%'")
    plan = spark._jvm.PythonSQLUtils.explainString(chosen._jdf.queryExecution(), "formatted")
    assert "Filter (" not in plan and "EqualTo(record_type,revisit)" in plan
    assert [r.record_id for r in chosen.collect()] == ["<urn:page:7>"]
    assert found.filter("not (record_type in ('response', 'warcinfo'))").count() == 4 - 1
    whole = warc.read_warc(spark, str(tmp_path / "a")).filter("record_type = 'response' and record_id = '<urn:page:11>'").first()
    assert bytes(whole.payload).decode() == PAGES[-1][2] and whole.target_uri == "http://g/ X: y"
    assert not list((tmp_path / "a").glob("_temporary*"))


def test_foreign_files(spark, tmp_path):
    """Plain files, and members that do not say how long they are."""
    records = []
    for k in range(3):
        body = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nbody%d" % k
        records.append(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <x:%d>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (k, len(body)) + body + b"\r\n\r\n")
    (tmp_path / "p.warc").write_bytes(b"".join(records))
    (tmp_path / "z.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    found = warc.read_warc(spark, str(tmp_path), partition_bytes=1)
    assert sorted(bytes(r.payload) for r in found.collect()) == [b"body0", b"body0", b"body1", b"body1", b"body2", b"body2"]
    assert found.filter("record_id = '<x:2>'").count() == 2


def test_empty_table(spark, tmp_path):
    warc.write_pages(pages(spark).limit(0), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def foreign(n, body=b"body"):
    out = []
    for k in range(n):
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % (len(body) + 1) + body + b"%d" % k
        out.append(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <x:%d>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (k, len(block)) + block + b"\r\n\r\n")
    return out


def test_members_of_several_records(spark, tmp_path):
    whole = b"".join(foreign(7))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(whole))
    (tmp_path / "cut.warc.gz").write_bytes(b"".join(gzip.compress(whole[k : k + 150]) for k in range(0, len(whole), 150)))
    for payload in ("all", "none"):
        found = warc.read_warc(spark, str(tmp_path), payload=payload).collect()
        assert sorted(r.record_id for r in found) == sorted([f"<x:{k}>" for k in range(7)] * 2)
        assert {r.http_length for r in found} == {5} and {r.broken for r in found} == {None}
        assert payload == "none" or sorted(bytes(r.payload) for r in found) == sorted([b"body%d" % k for k in range(7)] * 2)
    assert warc.read_warc(spark, str(tmp_path)).filter("record_id = '<x:6>'").count() == 2


@pytest.mark.parametrize("name", ["t.warc", "t.warc.gz"])
@pytest.mark.parametrize("lost", [1, 3, 30, 90])
def test_files_that_are_cut_off(tmp_path, name, lost):
    """No record is lost without a word: an error, or a row that says what is wrong."""
    records = foreign(3, b"b" * 60)
    data = b"".join(records) if name == "t.warc" else b"".join(gzip.compress(r) for r in records)
    lost += 4 if name == "t.warc" else 0  # the blank lines at the end hold nothing
    (tmp_path / name).write_bytes(data[:-lost])
    for payload in ("all", "none"):
        with open(tmp_path / name, "rb") as file, pytest.raises(warc.Broken, match=name):
            list(warc.records(file, len(data) - lost, [], payload, True, name))
        with open(tmp_path / name, "rb") as file:
            got = list(warc.records(file, len(data) - lost, [], payload, True, name, "mark"))
        # with only the end of the last member lost, all three records are there and the rest is marked
        assert [g[4] is None for g in got[:2]] == [True, True] and got[-1][4].startswith(name) and sum(g[4] is not None for g in got) == 1


def test_lengths_that_are_no_numbers(spark, tmp_path):
    (tmp_path / "b.warc").write_bytes(foreign(1)[0] + b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: x\r\n\r\nbody\r\n\r\n")
    with pytest.raises(Exception, match="no number"):
        warc.read_warc(spark, str(tmp_path)).collect()
    rows = warc.read_warc(spark, str(tmp_path), broken="mark").collect()
    assert len(rows) == 2 and sum(r.broken is not None for r in rows) == 1


@pytest.mark.parametrize("packed", [True, False])
def test_large_payloads_take_linear_time(tmp_path, packed):
    import time

    body = bytes(range(256)) * (1 << 18)  # 64 MB
    data = foreign(1, body)[0]
    (tmp_path / "l").write_bytes(gzip.compress(data, 1) if packed else data)
    began = time.perf_counter()
    with open(tmp_path / "l", "rb") as file:
        (got,) = warc.records(file, (tmp_path / "l").stat().st_size, [], "all", True)
    assert got[3] == body + b"0" and time.perf_counter() - began < 4


@pytest.mark.parametrize("few,heavy", [(0, 50_000), (0, 3), (0, 1)])
def test_digests_that_are_not_few(spark, few, heavy):
    typed = warc.with_record_types(pages(spark), few=few, heavy=heavy)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in typed.collect()]
    assert sorted(got, key=str) == expected()
