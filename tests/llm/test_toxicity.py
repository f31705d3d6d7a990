import random
import zlib

import pyarrow as pa

from perigon.llm import toxicity


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    syllables = ["ba", "lo", "mi", "tur", "sen", "ka", "ro", "pi"]
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 120))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["you idiot", "IDIOT", "zorkba", "zorklo", "zorkmi"]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(9001, None), (9002, "")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in toxicity.report(spark, docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert len(got) == len(rows) + 2
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    error = toxicity.calibration_error(spark.createDataFrame([(got[k].score, float(t)) for k, _, t in labels if got[k].held_out], "score double, label double")).first()
    assert error.n > 100 and error.error < 0.1
    held = [(got[k].predicted, t) for k, _, t in labels if got[k].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    assert got[9001].score == got[9002].score


def test_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame(corpus(40)[0], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.report(spark, docs, none).collect()} == {0.0}
    clean = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.report(spark, docs, clean).collect()} == {0.0}
    assert toxicity.report(spark, docs.limit(0), clean).count() == 0


def test_features_see_obfuscation_and_whole_texts():
    import numpy as np

    blank = toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool))
    texts = ["calm words", "you are an IDIOT!!", "you 1d1ot", "i d i o t", "", "calm " * 300_000 + "idiot"]
    got = dict(zip(texts, toxicity.features(pa.array(texts), blank)))
    name = {f: k for k, f in enumerate(toxicity.FEATURES)}
    assert got["you are an IDIOT!!"][name["insult_count"]] > 0 and got["you are an IDIOT!!"][name["second_person_near"]] > 0
    assert got["you 1d1ot"][name["hidden_insults"]] > 0 and got["i d i o t"][name["spelled_out"]] > 0
    assert got[texts[-1]][name["insult_count"]] > 0 and not got[""].any() and got["calm words"][name["insult_count"]] == 0


def test_stage_keeps_columns(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(k, t, k % 3, "x") for k, t in rows], "doc_id bigint, text string, length int, score string")
    kept = toxicity.without_toxic(spark, docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = {k for k, _, t in labels if not t}
    assert len(clean - ids) <= 0.02 * len(clean) and len(ids - clean) <= 0.1 * (len(labels) - len(clean))


def test_features_of_a_text_in_parts(monkeypatch):
    """The same features whether a text is looked at in one piece or in parts, but for neighbours across a cut."""
    import numpy as np

    from perigon.llm import common

    rng = random.Random(5)
    lexicon = toxicity.Lexicon(np.sort(toxicity.hashed(["word3", "word7"])), np.array([1.0, 2.0]), np.array([True, False]))
    texts = [" ".join(rng.choice(["word%d" % rng.randrange(9), "IDIOT", "you", "1d1ot", "a!!", "b?"]) for _ in range(3000)), "", "x" * 3000, "short text"]
    whole = toxicity.features(pa.array(texts), lexicon)
    monkeypatch.setattr(common, "PIECE_BYTES", 1000)
    parts = toxicity.features(pa.array(texts), lexicon)
    assert np.abs(whole - parts).max() < 0.02


def test_features_against_their_definitions():
    import re

    import numpy as np

    blank = toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool))
    name = {f: k for k, f in enumerate(toxicity.FEATURES)}
    rng = random.Random(6)
    for _ in range(30):
        text = " ".join(rng.choice(["you", "IDIOT", "idiot", "calm", "Dich", "l0ser", "???", "a", "b", "c", "d", "x!!", "Ab1"]) for _ in range(rng.randint(1, 40)))
        words = re.findall("[0-9a-z]+", text.lower())
        n, got = len(words) or 1, toxicity.features(pa.array([text]), blank)[0]
        insults = [w in toxicity.INSULTS for w in words]
        second = [w in toxicity.SECOND_PERSON for w in words]
        near = sum(any(second[max(0, k - toxicity.NEAR) : k + toxicity.NEAR + 1]) for k, i in enumerate(insults) if i)
        want = {
            "insult_density": sum(insults) / n, "second_person": sum(second) / n, "second_person_near": near / n, "capitals": sum(map(str.isupper, text)) / max(1, sum(map(str.isalpha, text))),
            "exclamations": text.count("!") / len(text), "questions": text.count("?") / len(text), "mixed_words": sum(any(map(str.isdigit, w)) and not w.isdigit() for w in words) / n, "length": np.log1p(len(words)),
        }
        for key, value in want.items():
            assert abs(got[name[key]] - value) < 1e-9, (key, text)


def test_repeated_ids_and_clashing_columns(spark):
    rows, labels = corpus(300)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame([(k, t, "raw", 1) for k, t in [*rows, rows[0], (rows[1][0], rows[0][1]), (None, rows[0][1]), (None, None)]], "doc_id bigint, text string, label string, score int")
    got = toxicity.report(spark, docs, marks).collect()
    assert len(got) == 304 and len({r.score for r in got if r.doc_id == rows[0][0]}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [False, False]
    kept = toxicity.without_toxic(spark, docs, marks)
    assert kept.columns == docs.columns
