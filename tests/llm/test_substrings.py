import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from perigon.llm import substrings


def brute(rows, window=50):
    first = {}
    for k, t in sorted((k, (t or "").encode()) for k, t in rows if k is not None):
        for i in range(len(t) - window + 1):
            first.setdefault(t[i : i + window], k)
    out = []
    for k, t in rows:
        t = (t or "").encode()
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if k is not None and first[t[i : i + window]] < k:
                gone[i : i + window] = b"\1" * window
        spans = [i for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((k, len(t), sum(gone), len(spans), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=6):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcde é") for _ in range(rng.randint(40, 300))) for _ in range(8)]
    rows = []
    for k in range(120):
        parts = ["".join(rng.choice("abcdefgh ü") for _ in range(rng.randint(0, 120)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += [p[a : a + rng.randint(30, 200)], "".join(rng.choice("xyz") for _ in range(rng.randint(0, 9)))]
        rows.append((k, "".join(parts)))
    rows += [(500 + k, rows[k][1]) for k in range(10)] + [(600, "a" * 400), (601, "a" * 300), (602, "b" * 49), (603, "b" * 50), (604, "b" * 51)]
    return rows + [(None, rows[3][1]), (700, None), (701, ""), (702, rows[7][1]), (702, rows[7][1]), (-3, rows[9][1][:60] + "zz")]


@pytest.mark.parametrize("block,part,hot", [(4 << 20, 2 << 20, substrings.HOT), (3000, 5000, substrings.HOT), (3000, 2000, 2)])
def test_against_brute_force(spark, block, part, hot):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "n") for k, t in rows], "doc_id bigint, text string, block string")
    got = substrings.remove_repeats(df, block_bytes=block, part_bytes=part, hot=hot).collect()
    found = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert sorted(found, key=str) == brute(rows)


def test_other_windows_and_the_digest(spark):
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for window in (49, 73, 100):
        got = substrings.remove_repeats(df, window).collect()
        assert sorted([(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got], key=str) == brute(rows, window)
    assert sorted([tuple(r) for r in substrings.report(df).collect()], key=str) == brute(rows)
    assert substrings.report(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(df, 20)


def test_buckets_are_refined_exactly():
    rng = random.Random(3)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 200))).encode() for _ in range(30)]
    strings += [s[5:] for s in strings[:9]]
    data, at = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)])
    for window in (17, 20, 49, 50, 64, 65):
        starts = np.array([a + i for a, s in zip(at, strings) for i in range(len(s) - window + 1)])
        got = substrings.buckets(data, at, starts, window)
        by = {}
        for s in starts.tolist():
            by.setdefault(data[s : s + window].tobytes(), []).append(s)
        want = {s: tuple(group) if len(group) > 1 else None for group in by.values() for s in group}
        groups = {}
        for s, b in zip(starts.tolist(), got.tolist()):
            groups.setdefault(b, []).append(s)
        assert all(want[s] is None for s in groups.pop(-1, []))
        assert all(want[s] == tuple(group) for group in groups.values() for s in group)


def test_equal_hashes_of_different_strings_do_not_confuse():
    data = np.frombuffer(b"abcabdabc", np.uint8)
    of, first = substrings.same_strings(data, np.zeros(3, np.uint64), np.array([0, 3, 6]), np.array([3, 3, 3]))
    assert of.tolist() == [0, 1, 0] and first.tolist() == [0, 1]


def test_long_texts_in_pieces(spark, monkeypatch):
    from perigon.llm import common

    monkeypatch.setattr(common, "PIECE_BYTES", 300)
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(5000))
    rows = [*corpus(9)[:40], (800, long), (801, long[700:4000] + "x" * 80), (799, long[100:900])]
    data, offsets = common.utf8(pa.array([t for _, t in rows]))
    ids = pa.array([k for k, _ in rows], pa.int64())
    table = pa.table({"doc_id": ids, "text": pa.array([t for _, t in rows]), "block": pa.array([0] * len(rows), pa.int64())})
    key = (pa.scalar(0, pa.int64()),)
    reply = substrings.shared_anchors(substrings.HOT)(substrings.anchor_entries(50, 1)(key, table))
    reply = substrings.settled(50)(substrings.extent_entries(50, 1, 1)(key, table, reply))
    got = substrings.removals(50, 1, 1)(key, table, reply).to_pylist()
    found = [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got]
    assert sorted(found, key=str) == brute(rows)
