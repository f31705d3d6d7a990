import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from perigon.llm import fingerprints as fp

ROWS = [(5, "a b c d e f g"), (4, "one two"), (3, None), (2, ""), (1, "ä" * 7 + " end of it all now here"), (1, "a b c d e f g"), (None, "no id at all, five words and more"), (5, "a b c d e f g"), (9, "x " * 400)]


def shingles(text):
    words = text.encode().lower().split() if text.isascii() else text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for k, (doc, text) in enumerate(order):
        text, follows = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text)
        out.append((doc, n, hashlib.sha256((text[: n - n // 2] + follows[: n // 2]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edited_texts_meet_the_next_document(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    for ranges in (1, 3, 7):
        got = fp.edited_fingerprints(df, ranges=ranges).collect()
        assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == brute(ROWS)
        by_text = {}
        for r in got:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            by_text.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
        assert all(len(v) == 1 for (d, _), v in by_text.items() if d == 5)


@pytest.mark.parametrize("group", [256, 3])
def test_no_document_is_lost_between_ranges(spark, monkeypatch, group):
    monkeypatch.setattr(fp, "CUT_GROUP", group)
    rng = random.Random(group)
    rows = [(k * k - 500, " ".join(str(rng.random()) for _ in range(rng.randint(0, 20)))) for k in range(300)] + [(None, "x"), (None, None), (225 - 500, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for ranges in (2, 7, 40):
        got = fp.edited_fingerprints(df, ranges=ranges).collect()
        assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == brute(rows)
        assert fp.with_next(df, ranges).agg(F.count_distinct("part")).first()[0] > ranges / 2


def test_small_sets_are_exact_and_parts_merge(spark):
    texts = ["a b c d e f g h i j", "a b c d e f g x y z", "", None, "short one"]
    s = fp.sketches(pa.array(texts))
    a, b = shingles(texts[0]), shingles(texts[1])
    assert fp.resemblance(s[0], s[1]) == len(a & b) / len(a | b)
    assert fp.containment(s[0], s[1]) == 2 / 6 or abs(fp.containment(s[0], s[1]) - len(a & b) / len(a)) < 1e-9
    assert fp.distinct_count(s[0]) == len(a) and len(s[2]) == len(s[3]) == 0 and len(s[4]) == 1
    assert fp.resemblance(s[2], s[3]) == 1 and fp.resemblance(s[2], s[0]) == 0
    rng = np.random.default_rng(1)
    words = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 900)) for _ in range(6)]
    df = spark.createDataFrame([(i % 2, w) for i, w in enumerate(words)], "part int, text string")
    merged = {r.part: r for r in fp.merge_by(fp.fingerprint(df), "part").collect()}
    for part in (0, 1):
        every = set().union(*(shingles(w) for w in words[part::2]))
        whole = np.unique(np.concatenate([fp.sketches(pa.array([w]), k=10**6)[0] for w in words[part::2]]))
        assert (fp.decode(merged[part].fingerprint) == whole[: fp.K]).all()
        assert abs(merged[part].distinct_shingles / len(every) - 1) < 0.3
    pair = fp.compare(fp.fingerprint(df).withColumn("other", F.col("fingerprint")), "fingerprint", "other").collect()
    assert all(r.resemblance == 1 and r.containment == 1 for r in pair)


def test_empty_table(spark):
    assert fp.edited_fingerprints(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_cuts_follow_dense_ids(spark):
    """Half of the ids lie close together, the others far apart; no range is much heavier than its share."""
    rows = [(k, "x" * 10) for k in range(3000)] + [(10**15 + k * 10**12, "x" * 10) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    cuts = fp.id_cuts(df, 0, rows[-1][0], 12, 60_000 // 12)
    ids = sorted(r[0] for r in rows)
    bounds = [-1, *cuts, ids[-1]]
    assert set(cuts) <= set(ids)
    assert max(sum(a < i <= b for i in ids) for a, b in zip(bounds, bounds[1:])) <= 1100 and len(cuts) >= 8


def test_likeness_columns_against_brute_force(spark):
    """Sets within a sketch give the exact shares; larger ones come near."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 5, 20, 60])))) for k in range(0, 400, 2)]
    rows += [(1001, rows[7][1]), (1003, rows[7][1]), (1005, " ".join(f"v{k}" for k in range(3000))), (1007, " ".join(f"v{k}" for k in range(0, 4000)))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, part string")
    got = {r.doc_id: r for r in fp.edited_fingerprints(df, ranges=5).collect()}
    order = sorted(rows, reverse=True)
    for k, (doc, text) in enumerate(order):
        follows = order[(k + 1) % len(order)][1]
        n = len(text)
        own, edited, after = shingles(text), shingles(text[: n - n // 2] + follows[: n // 2]), shingles(follows)
        for have, other in ((got[doc].near_edited, edited), (got[doc].near_next, after)):
            want = len(own & other) / len(own | other) if own | other else 1.0
            assert abs(have - want) <= (1e-12 if len(own | other) <= fp.K else 0.2), (doc, have, want)
        assert len(fp.decode(got[doc].fingerprint)) == min(fp.K, len(own))
    assert got[1001].fingerprint == got[1003].fingerprint == got[rows[7][0]].fingerprint
