import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from perigon.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """(item_id, rank, doc_id, score) from all documents, by the formula."""
    own = [(doc, Counter(terms(text))) for doc, text in docs]
    own = [(doc, c, sum(c.values())) for doc, c in own if c]
    n, total = len(own), sum(x for *_, x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c, size in own:
            m = 25 + 75 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def tables(seed=4, n=300):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["The", "of", "Ünder", "naïve", "日本", "x1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, rng.choice([" ", ", ", "-"]).join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 20, 60])))) for k in range(n)]
    docs += [docs[17]] * 25 + [(None, docs[17][1]), (None, docs[17][1]), (7, docs[40][1]), (901, None), (902, ""), (903, "!!! ..."), (904, "of " * 5000)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for k in range(25)] + [(30, None), (31, "--"), (32, "absent"), (33, docs[17][1]), (33, "of of OF w1"), (None, "w2 w3")]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, block int, terms string").repartition(5)
    return d, spark.createDataFrame([(i, t, 2) for i, t in items], "item_id bigint, text string, rank int")


@pytest.mark.parametrize("settings", [{}, {"seeds": 1, "few": 0}, {"group_terms": 20, "seeds": 2}])
def test_against_brute_force(spark, settings):
    docs, items = tables()
    d, q = frames(spark, docs, items)
    index = ls.build(spark, d, block_docs=8)
    got = ls.search(spark, index, q, **settings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)
    index.remove()


def test_blocks_are_pruned_and_every_document_is_indexed(spark):
    rng = random.Random(1)
    docs = [(k, " ".join(f"t{rng.randrange(5000)}" for _ in range(30))) for k in range(2000)]
    docs += [(3000 + k, f"needle haystack pin {k}") for k in range(12)]
    d, q = frames(spark, docs, [(1, "needle haystack pin t5 t6")])
    index = ls.build(spark, d, block_docs=16)
    assert index.forward.selectExpr("sum(size(ids))").first()[0] == len(docs) and index.n_docs == len(docs)
    group = next(ls.groups(q, "item_id", "text", 100))
    ls._weighed(spark, index, group)
    group.threshold = np.ones(1, np.int64)
    wide = ls._blocks_above(spark, index, group).count()
    found = ls.search(spark, index, q).orderBy("rank").collect()
    group.threshold[0] = found[-1].score
    assert ls._blocks_above(spark, index, group).count() < wide / 3
    assert [tuple(r) for r in found] == [r for r in sorted(brute(docs, [(1, "needle haystack pin t5 t6")]), key=lambda r: r[1])]


def test_empty_tables(spark):
    docs, items = tables(n=60)
    d, q = frames(spark, docs, items)
    assert ls.report(spark, d.limit(0), q).count() == 0 and ls.report(spark, d, q.limit(0)).count() == 0
    assert ls.report(spark, d.filter("doc_id in (901, 902, 903)"), q).count() == 0


def test_large_scores_are_whole_numbers():
    """Sums beyond 2^53 are not rounded."""
    group = ls.Group()
    group.add(1, {b"a": 1, b"b": 1})
    group.starts, group.term, group.weight = np.array([0, 2]), np.array([0, 1]), np.array([10**12 + 1, 1])
    got = ls._scores(group, np.array([0, 1, -1]), np.array([0, 1, 2]), np.array([10**5 + 3, 5, 9]), np.array([0, 0, 0]), 1, np.array([0]), 1 << 60)
    assert got[0, 0] == (10**12 + 1) * (10**5 + 3) + 5


def test_long_text_in_parts():
    raw = ("Ab1" * 300_000 + " ünd " + "x y " * 300_000).encode()
    found = Counter(t for part in ls.terms_of(raw) for t in part)
    assert found == {b"ab1" * 300_000: 1, "ünd".encode(): 1, b"x": 300_000, b"y": 300_000}


def test_query_equals_sql(spark):
    import duckdb

    from perigon.llm import queries

    base = duckdb.connect()
    for t in ("documents", "benchmark"):
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    cursor = base.execute(queries.ORACLE_SQL["op11_lexical_search"])
    columns = [d[0] for d in cursor.description]
    got = queries.QUERIES["op11_lexical_search"](spark, "/root/testdata/sf0.001").select(*columns).collect()
    want = cursor.fetchall()
    assert want and sorted(map(tuple, got), key=str) == sorted(want, key=str)
