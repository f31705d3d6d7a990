import random
import re
import weakref

import pyarrow as pa
from pyspark.sql import functions as F

from perigon.llm import decontamination as dc

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def brute_sets(docs, items):
    return [(doc, n, h, found) for doc, n, h, found in brute(docs, [(str(i), t) for i, t in items])]


def tables(seed=3):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "the", "Of", "x1", "naïve", "zz"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))) for k in range(30)] + [(7, "again the same item id with other words than before"), (90, None), (91, "solo")]
    docs = [(k, " ".join(rng.choice(vocabulary + ["q", "solo"]) for _ in range(rng.randint(0, 200)))) for k in range(60)]
    docs += [(k + 100, f"lead-in, {t or ''}! and more ... {t or ''}") for k, t in items[:20]] + [(None, items[3][1]), (100, items[2][1]), (301, None), (302, "")]
    return docs, items


def test_against_brute_force_in_one_and_many_blocks(spark):
    docs, items = tables()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for most in (dc.BLOCK_WINDOWS, 60):
        got = dc.mark(spark, d, b, ["doc_id"], block_windows=most).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got], key=str) == brute(docs, items)
        for r in got:
            assert sum(s.end_word - s.first_word for s in r.spans) == r.n_hit


def test_stage_keeps_clean_documents(spark):
    docs, items = tables()
    d = spark.createDataFrame([(k, t, 1, "s") for k, t in docs], "doc_id bigint, text string, n_words int, spans string")
    kept = dc.decontaminated(spark, d, spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == d.columns
    clean = sorted((x[0] for x in brute(docs, items) if not x[2]), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == clean


def test_empty_tables(spark):
    docs, items = tables()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert dc.report(spark, d.limit(0), b).count() == 0
    assert {r.contaminated for r in dc.report(spark, d, b.limit(0)).collect()} == {False}


def test_one_block_at_a_time_on_the_driver(spark, monkeypatch):
    alive, most, made = weakref.WeakSet(), [], dc.Windows.__init__

    def counted(self, *given):
        most.append(len(alive))
        alive.add(self)
        made(self, *given)

    monkeypatch.setattr(dc.Windows, "__init__", counted)
    docs, items = tables()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = dc.mark(spark, d, b, ["doc_id"], block_windows=60).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got], key=str) == brute(docs, items)
    assert len(most) > 2 and max(most) == 0, most
    blank = spark.createDataFrame([(k, ". " * 200) for k in range(9)], "item_id bigint, text string")
    assert {(r.doc_id, r.n_words, r.n_hit) for r in dc.mark(spark, d, blank, ["doc_id"], block_windows=60).collect()} == {(k, len(words(t)), 0) for k, t in docs}


def test_items_over_the_same_words_and_long_texts(spark, monkeypatch):
    """Many windows under one shingle, compared a few pairs at a time; texts and items of many pieces."""
    from perigon.llm import common

    monkeypatch.setattr(common, "PIECE_BYTES", 400)
    monkeypatch.setattr(dc, "PAIRS", 50)
    rng = random.Random(4)
    items = [(f"i{k}", " ".join(rng.choice("ab") for _ in range(12))) for k in range(40)] + [("long", " ".join(rng.choice("abc") + str(rng.randrange(30)) for _ in range(400))), (None, "a b a")]
    long = " ".join(rng.choice("ab") for _ in range(1500))
    docs = [(1, long), (2, "x " * 300 + items[40][1][200:900] + " y" * 300), (3, "a b a"), (4, "a b")]
    rows = pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}).to_batches()
    found = [r for b in dc.windows_of(10)(iter(rows)) for r in b.to_pylist()]
    by, members = {}, {}
    for r in found:
        by[r["words"], r["plain"]] = (r["n"], r["tokens"])
        members.setdefault(r["plain"], set()).add(r["item_id"])
    table = pa.table({"words": pa.array([w for w, _ in by], pa.binary()), "plain": pa.array([p for _, p in by], pa.binary()), "n": [n for n, _ in by.values()], "token": [t[-1] for _, t in by.values()], "place": [len(t) - 1 for _, t in by.values()]})

    class Shared:
        value = dc.Windows(table)

    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs], "n_words": [0] * 4, "n_hit": [0] * 4, "spans": pa.array([[]] * 4, pa.list_(dc.SPAN_ARROW)), "windows": pa.array([[]] * 4, pa.list_(pa.binary()))})
    got = [r for b in dc.marker(Shared, ["doc_id", "text"])(iter([batch])) for r in b.to_pylist()]
    want = {d: (n, h, {None if i == "None" else i for i in found}) for d, n, h, found in brute_sets(docs, items)}
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], set().union(*[members[w] for w in r["windows"]])) for r in got} == want
    for r in got:
        assert sum(s["end_word"] - s["first_word"] for s in r["spans"]) == r["n_hit"]


def test_hits_are_confirmed_by_the_words(spark, monkeypatch):
    """With a hash that takes all words of a length for one, only what is there word by word is a hit."""
    from perigon.llm import common

    monkeypatch.setattr(common, "word_hashes", lambda data, start, end: (end - start).astype("uint64"))
    items = pa.table({"item_id": [1, 2], "text": ["one two six", "Ünd six"]}).to_batches()
    found = [r for b in dc.windows_of(10)(iter(items)) for r in b.to_pylist()]
    assert [r["plain"] for r in found] == [b"one two six", "Ünd six".encode()]
    table = pa.table({"words": pa.array([r["words"] for r in found], pa.binary()), "plain": pa.array([r["plain"] for r in found], pa.binary()), "n": [r["n"] for r in found], "token": [r["tokens"][0] for r in found], "place": [0, 0]})

    class Shared:
        value = dc.Windows(table)

    texts = ["ten One, TWO six. one", "one two ten six", "was Ünd-six", "xxxx ünd six"]
    batch = pa.RecordBatch.from_pydict({"text": texts, "n_words": [0] * 4, "n_hit": [0] * 4, "spans": pa.array([[]] * 4, pa.list_(dc.SPAN_ARROW)), "windows": pa.array([[]] * 4, pa.list_(pa.binary()))})
    got = [r for b in dc.marker(Shared, ["text"])(iter([batch])) for r in b.to_pylist()]
    assert [r["n_hit"] for r in got] == [3, 0, 2, 0] and [r["windows"] for r in got] == [[b"one two six"], [], ["Ünd six".encode()], []]


def test_a_window_of_very_many_items(spark):
    """Items are a table: nothing that goes to the tasks grows with those that share a window."""
    b = spark.range(20_000).select(F.col("id").alias("item_id"), F.lit("the same ten words begin each of very many items").alias("text"))
    d = spark.createDataFrame([(1, "so the same ten words begin each of very many items"), (2, "else")], "doc_id bigint, text string")
    windows, members = dc.filed(d, b)
    assert windows.count() == 1 and members.count() == 20_000
    got = {r.doc_id: r for r in dc.mark(spark, d, b, ["doc_id"]).collect()}
    assert list(got[1]["items"]) == list(range(20_000)) and got[1].n_hit == 10 and list(got[2]["items"]) == []


def test_ids_of_other_types(spark):
    d = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1.5, "Two three"), (None, "four"), (2.5, "five")], "item_id double, text string")
    assert {r.doc_id: list(r["items"]) for r in dc.mark(spark, d, b, ["doc_id"]).collect()} == {1: [1.5], 2: [None]}


def swapped(levels=10):
    """Two words of 2^levels letters whose polynomial hashes modulo 2^64 are equal for any odd base."""
    a, b = "a", "b"
    for _ in range(levels):
        a, b = a + b, b + a
    return a, b


def test_long_words_that_hash_alike_by_polynomials(spark):
    a, b = swapped()
    docs = [(1, f"one {a} two"), (2, f"one {b} two"), (3, f"{a}")]
    got = dc.mark(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(5, a)], "item_id bigint, text string"), ["doc_id"]).collect()
    assert sorted((r.doc_id, r.n_hit) for r in got) == [(1, 1), (2, 0), (3, 1)]
