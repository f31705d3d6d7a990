"""Scores against a plain version: lexicon and features by Python dictionaries and regular expressions, the same trees on them."""

import functools
import math
import operator
import random
import re
import sys
from collections import Counter

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from perigon.llm import toxicity
from tests.llm.test_toxicity import corpus

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
PUNCTUATION = set(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
LETTERS = set(range(65, 91)) | set(range(97, 123)) | set(range(128, 256))
MEANS = dict(zip(b"013457@$", b"oieastas"))
INSULTS = {w.encode() for w in toxicity.INSULTS}
SECOND = {w.encode() for w in toxicity.SECOND_PERSON}


def lower(raw):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in raw)


def names(word):
    return [("whole", word)] + [("begins", word[:n]) for n in (4, 5, 6, 7) if len(word) > n]


def lexicon(rows):
    """name -> (weight, strong) from (text, label)."""
    toxic, clean = Counter(), Counter()
    for text, label in rows:
        (toxic if label else clean).update({n for w in WORD.findall(lower(text.encode())) for n in names(w)})
    t_all, c_all = sum(label for _, label in rows), sum(not label for _, label in rows)
    errors = min(3.5, max(2.0, 2 + math.log10(len(rows) / 300)))
    found = {}
    for name, n in toxic.items():
        t, c = n + 0.5, clean[name] + 0.5
        weight, error = math.log(t / (t_all + 1)) - math.log(c / (c_all + 1)), math.sqrt(1 / t + 1 / c)
        if n >= 3 and weight - errors * error >= 0.5:
            found[name] = (weight, weight - (errors + 1) * error >= 1)
    return found


def features(text, known):
    raw = text.encode()
    words = WORD.findall(raw)
    low = [lower(w) for w in words]
    weights = [max((known[n][0] for n in names(w) if n in known), default=0.0) for w in low]
    strong = [any(known[n][1] for n in names(w) if n in known) for w in low]
    insult, you = [w in INSULTS for w in low], [w in SECOND for w in low]
    near = sum(any(you[max(0, k - 6) : k + 7]) for k in range(len(low)) if insult[k] or weights[k] > 0)
    plain = bytes(MEANS.get(b, b) for b in lower(raw) if b not in PUNCTUATION or b in b"@$").split()
    hidden = sum(w in INSULTS for w in plain)
    hidden_strong = sum(any(known[n][1] for n in names(w) if n in known) for w in plain)
    letters, n, size = sum(b in LETTERS for b in raw), max(1, len(words)), max(1, len(raw))
    digits = [sum(48 <= b <= 57 for b in w) for w in words]
    shouted = sum(len(w) >= 3 and all(65 <= b <= 90 for b in w) for w in words)
    spelled = sum(all(len(w) == 1 for w in words[k : k + 4]) for k in range(len(words) - 3))
    inner = sum(raw[k] in b"@$*#%&" and raw[k - 1] in LETTERS and raw[k + 1] in LETTERS for k in range(1, len(raw) - 1))
    follows = sum(a == b and a in PUNCTUATION for a, b in zip(raw, raw[1:]))
    # doubles added one after the other, since trees may split between values that differ in the last bit
    return [
        sum(insult) / n, np.log1p(sum(insult)), sum(w > 0 for w in weights) / n, sum(strong) / n, np.log1p(sum(strong)), functools.reduce(operator.add, weights, 0.0) / n, max(weights, default=0.0),
        sum(you) / n, near / n, sum(65 <= b <= 90 for b in raw) / max(1, letters), shouted / n, raw.count(b"!") / size, raw.count(b"?") / size, sum(b in PUNCTUATION for b in raw) / size, follows / size,
        sum(0 < d < len(w) for d, w in zip(digits, words)) / n, inner / n, max(hidden - sum(insult), 0) / n, max(hidden_strong - sum(strong), 0) / n, spelled / n,
        np.log1p(len(words)), letters / n,
    ]


def tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    marks = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality", "toxic")
    rows, labels = corpus(700, seed=8)
    rng = random.Random(1)
    odd = [(10_000 + k, rng.choice(["!", "?!", "a@b", "#"]) + t + rng.choice(["!", "??", "", "@"])) for k, t in rows] + [(20_001, None), (20_002, ""), (20_003, "Y0U 1D!OT"), (20_004, "i d i o t  z0rkba")]
    own = spark.createDataFrame(odd, "doc_id bigint, text string")
    return docs.unionByName(own), marks.unionByName(spark.createDataFrame([(10_000 + k, q, t) for k, q, t in labels], "doc_id bigint, quality int, toxic int").select(*[F.col(c).cast(marks.schema[c].dataType) for c in marks.columns]))


def plain_features(texts, known):
    return np.array([features(t.as_py() or "", known) for t in texts], float).reshape(len(texts), len(toxicity.FEATURES))


def test_scores_against_a_plain_version(spark, monkeypatch):
    """All scores of the query's form, whole tables: plain lexicon and features in place of the arrays, trees and calibration on them.

    Rows lie alike for both, since trees choose between splits of equal gain by the last bits of sums.
    """
    docs, marks = tables(spark)
    got = {r.doc_id: r for r in toxicity.report(spark, docs, marks).collect()}
    learned = toxicity.learn_lexicon(toxicity.labelled(docs, marks).filter("fold < 5"))
    known = lexicon([(r.text, r.label) for r in toxicity.labelled(docs, marks).filter("fold < 5").collect()])
    assert any(s for _, s in known.values()) and any(n[0] == "begins" for n in known)
    assert np.allclose(sorted(learned.weights), sorted(w for w, _ in known.values()), rtol=0, atol=1e-12) and learned.strong.sum() == sum(s for _, s in known.values())
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests
    monkeypatch.setattr(toxicity, "learn_lexicon", lambda rows: lexicon([(r.text, r.label) for r in rows.collect()]))
    monkeypatch.setattr(toxicity, "features", plain_features)
    want = toxicity.report(spark, docs, marks).collect()
    assert len(want) == docs.count() == len(got)
    for r in want:
        assert abs(got[r.doc_id].score - r.score) < 1e-9, r.doc_id
        assert got[r.doc_id].predicted == r.predicted == int(r.score >= 0.7)
    assert len({r.score for r in want}) > 3  # steps of the calibration on this few labels


def test_features_do_not_depend_on_neighbours(spark):
    """All 22 features of texts in one batch against the plain ones; a text's ends are no neighbours of the next one's."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = [(t, rng.random() < 0.3) for _, t in corpus(300, seed=4)[0]]
    known = lexicon([(t, "zork" in t or "idiot" in t.lower()) for t, _ in rows])
    texts = [rng.choice(["!", "b@", "$", ""]) + t + rng.choice(["!", "@", "a#", ""]) for t, _ in rows] + ["", "!", "!!", "@", "a", "a@b", "@b"]
    order = sorted(known)
    hashes = []
    for kind, word in order:
        data = np.frombuffer(word, np.uint8)
        own = toxicity.common.SpanHash(data).spans(np.array([0]), np.array([len(data)]))
        hashes.append(toxicity.common.mix(own ^ np.uint64(0x6A09E667F3BCC908))[0] if kind == "whole" else own[0])
    at = np.argsort(np.array(hashes, np.uint64))
    table = toxicity.Lexicon(np.array(hashes, np.uint64)[at], np.array([known[n][0] for n in order])[at], np.array([known[n][1] for n in order])[at])
    got = toxicity.features(pa.array(texts), table)
    for k, text in enumerate(texts):
        assert np.allclose(got[k], features(text, known), rtol=0, atol=1e-12), text
