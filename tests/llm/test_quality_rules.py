import random
import re
from collections import Counter, defaultdict

import numpy as np

from perigon.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(line):
    line = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c for c in line)
    return " ".join(WORD.findall(line))


def brute(docs, most=qr.MOST_DOCUMENTS, least=qr.MIN_LEFT):
    """Rows of `report`, step by step. docs: (doc_id, text, source)."""
    shared = defaultdict(set)
    for k, (_, text, host) in enumerate(docs):
        for line in (text or "").split("\n"):
            if WORD.findall(line):
                shared[host, plain(line)].add(k)
    out = []
    for doc, text, host in docs:
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.findall(x)]
        spans = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        times = Counter(spans)
        covered = {i + o for i, s in enumerate(spans) if times[s] > 1 for o in range(8)}
        gone = [x for x in lines if len(shared[host, plain(x)]) > most]
        left = len(words) - sum(len(WORD.findall(x)) for x in gone)
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        kept = not failed and left >= 20 and 100 * left >= least * len(words)
        out.append((doc, len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), failed, kept, len(gone), left))
    return sorted(out, key=str)


def documents(seed=5, n=90):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "of", "7", "19", "naïve", "日本", "x#y", "<p>", "&", "$5"]
    shared = ["Subscribe  now 24", "all rights reserved 19", "cookies of the site"]
    docs = []
    for k in range(n):
        lines = [" ".join(rng.choice(vocabulary) + rng.choice(["", str(rng.randint(0, 300))]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        lines += rng.choices(shared, k=rng.randint(0, 3))
        rng.shuffle(lines)
        docs.append((k, rng.choice(["\n", "\n\n", "\r\n"]).join(lines), rng.choice(["h1", "h1", "h2", None])))
    docs += [docs[3]] * 12 + [(None, None, "h1"), (500, "", None), (501, " \t\n \x0b", "h1"), (502, "one two three " * 30, "h2"), (503, "w " * 200, "h2"), (503, "SUBSCRIBE now\t88\n" + " ".join(f"q{k}" for k in range(30)), "h1")]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, s, 1, "x") for d, t, s in docs], "doc_id bigint, text string, source string, n_words int, row__ string")


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", *qr.FIGURES, "base_failed", "kept", "n_removed_lines", "n_words_left").collect()), key=str)


def test_against_brute_force_by_each_way_of_lookup(spark):
    docs = documents()
    for few, heavy in ((qr.FEW, qr.HEAVY), (0, qr.HEAVY), (0, 20), (0, 1)):
        assert rows(qr.judged(spark, frame(spark, docs), most_documents=8, few=few, heavy=heavy)) == brute(docs, 8)
    assert any(r[7] for r in brute(docs, 8)) and any(r[8] for r in brute(docs, 8))


def test_cleaned_texts(spark):
    docs = documents(9)
    got = qr.cleaned(spark, frame(spark, docs), most_documents=8)
    assert got.columns == ["doc_id", "text", "source", "n_words", "row__"]
    shared = Counter((h, p) for _, t, h in docs for p in {plain(x) for x in (t or "").split("\n") if plain(x)})
    want = []
    for (doc, text, host), kept in ((d, next(r[7] for r in brute(docs, 8) if r == b)) for d, b in ((d, row_of(d, docs)) for d in docs)):
        if kept:
            want.append((doc, "\n".join(x for x in text.split("\n") if shared[host, plain(x)] <= 8)))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def row_of(doc, docs):
    """The brute-force row of one document among all."""
    one = brute(docs, 8)
    alone = brute([doc], 8)[0]
    return next(r for r in one if r[:7] == alone[:7])


def test_empty_table_and_repeated_rows(spark):
    docs = documents()[:4]
    assert rows(qr.judged(spark, frame(spark, docs).limit(0))) == []
    assert qr.cleaned(spark, frame(spark, docs).limit(0)).count() == 0
    same = [(1, " ".join(f"w{k}" for k in range(25)), "h")] * 60
    assert rows(qr.judged(spark, frame(spark, same))) == brute(same) and not any(r[7] for r in brute(same))


def test_repeated_words_by_numbers():
    rng = random.Random(2)
    for n in (0, 1, 7, 8, 9, 16, 40, 200):
        for k in (1, 2, 5, 60):
            words = [rng.randrange(k) for _ in range(n)]
            spans = [tuple(words[i : i + 8]) for i in range(n - 7)]
            times = Counter(spans)
            assert qr.repeated_words(np.array(words, np.int64)) == len({i + o for i, s in enumerate(spans) if times[s] > 1 for o in range(8)})


def test_one_long_text(spark):
    text = " ".join(f"word{k % 90000}" for k in range(1_500_000)).encode()
    numbers = qr.word_numbers(text)
    assert len(numbers) == 1_500_000 and numbers.max() == 89_999
    assert qr.repeated_words(numbers) == 1_500_000


def test_long_lines_in_parts_have_the_key_of_the_whole(monkeypatch):
    line = ("  Two  words\t19 " * 400).encode()
    whole = qr.line_keys(line + b"\nend", "h")
    monkeypatch.setattr(qr.common, "PIECE_BYTES", 300)
    assert qr.line_keys(line + b"\nend", "h") == whole and whole[2] == [1200, 1]


def test_query_equals_sql(spark):
    import duckdb

    from perigon.llm import queries

    base = duckdb.connect()
    base.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    cursor = base.execute(queries.ORACLE_SQL["op12_quality_rules"])
    columns = [d[0] for d in cursor.description]
    got = queries.QUERIES["op12_quality_rules"](spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(cursor.fetchall(), key=str)
