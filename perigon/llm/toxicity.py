"""Toxicity scores: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features are rates over a whole text: densities of lexicon words (a short list of common insults, and
entries learned from labelled texts: words and word beginnings that mark toxic ones), how often
second-person words stand near them, capitals, punctuation, and signs of obfuscation (letters
replaced by digits or symbols, lexicon words that show only after undoing that, spelled-out words).

Labels are learned from at most SAMPLE labelled rows, chosen by a hash of doc_id. These are dealt by
a hash of the text, so that copies stay together: one part gives the lexicon, another the trees, a
third the calibration. Scores of all documents come from one pass without a shuffle.

Edge cases: a null text is an empty one (all features 0) and is scored as such; several labels of one
document count as toxic if one does; without labels, or with labels of one class only, every score is
the share of toxic labels (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perigon.llm import common

#: Bound on the labelled rows that are learned from.
SAMPLE = 30_000
#: Bound on the learned entries.
ENTRIES = 20_000
LIMIT = 0.7
#: How far the ends of a step of the calibration lie towards the next steps.
TILT = 0.02
PREFIXES = (4, 5, 6, 7)
NEAR = 6
#: Common insults in four languages.
INSULTS = """
idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting trash garbage scum clown fool jerk
freak creep ugly vermin filth coward liar imbecile bastard asshole bitch crap hate
idiotin dumm dumme dummkopf trottel arschloch abschaum versager hässlich ekelhaft wertlos lügner feigling
idiote stupide imbécile crétin connard salaud abruti minable dégoûtant ordure raclure pauvre lâche menteur
idiota estúpido estúpida imbécil tonto tonta basura escoria asqueroso inútil patético payaso perdedor cobarde mentiroso
""".split()
SECOND_PERSON = """
you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie ihnen ihre
tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro su
""".split()

WORD_GAP = np.ones(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    WORD_GAP[_low:_high] = False
_UPPER = common.byte_class(bytes(range(65, 91)))
_LETTER = ~WORD_GAP
_LETTER[0x30:0x3A] = False
_DIGIT = common.byte_class(b"0123456789")
_SIGNS = common.byte_class(b"@$*#%&")
_PUNCTUATION = common.byte_class(bytes(b for b in range(33, 127) if not chr(b).isalnum()))
#: Letters that digits and symbols stand for.
_PLAIN = np.arange(256, dtype=np.uint8)
for _sign, _means in zip(b"013457@$", b"oieastas"):
    _PLAIN[_sign] = _means
_STAYS = ~_PUNCTUATION
_STAYS[list(b"@$")] = True

FEATURES = [
    "insult_density", "insult_count", "lexicon_density", "strong_density", "strong_count", "weight_mean", "weight_max",
    "second_person", "second_person_near", "capitals", "shouted_words", "exclamations", "questions", "punctuation", "repeated_punctuation",
    "mixed_words", "signed_words", "hidden_insults", "hidden_lexicon", "spelled_out", "length", "word_length",
]


def hashed(words: list[str]) -> np.ndarray:
    data, offsets = common.utf8(pa.array(words, pa.large_string()))
    return np.unique(common.SpanHash(data).spans(offsets[:-1], offsets[1:]))


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def entries(hashes: common.SpanHash, start: np.ndarray, end: np.ndarray, whole: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lexicon names of words: of the whole word, and of each beginning. With the words they belong to."""
    yield np.arange(len(start)), common.mix(whole ^ np.uint64(0x6A09E667F3BCC908))
    for n in PREFIXES:
        longer = np.flatnonzero(end - start > n)
        yield longer, hashes.spans(start[longer], start[longer] + n)


@dataclass
class Lexicon:
    """Learned entries: sorted names, their weights (log odds), and which of them are beyond doubt."""

    names: np.ndarray
    weights: np.ndarray
    strong: np.ndarray

    def weigh(self, hashes, start, end, whole) -> tuple[np.ndarray, np.ndarray]:
        weight, strong = np.zeros(len(start)), np.zeros(len(start), bool)
        if len(self.names):
            for of, name in entries(hashes, start, end, whole):
                at = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
                found = self.names[at] == name
                np.maximum.at(weight, of[found], self.weights[at[found]])
                strong[of[found]] |= self.strong[at[found]]
        return weight, strong


def sums(own: np.ndarray, at: np.ndarray, lexicon: Lexicon, insults: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts over each row of a piece of text, and its largest weight. Counts of parts of a row add up."""
    n = len(at) - 1
    lower = common.lower_ascii(own)

    def per_row(flags, rows=at):
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[rows[1:]] - total[rows[:-1]]

    start, end, rows = common.words(lower, at, WORD_GAP)
    hashes = common.SpanHash(lower)
    whole = hashes.spans(start, end)
    row = np.repeat(np.arange(n), np.diff(rows))
    insult = member(whole, insults)
    weight, strong = lexicon.weigh(hashes, start, end, whole)
    hit = insult | (weight > 0)
    you = member(whole, second)
    yous = np.concatenate([[0], np.cumsum(you)])
    where = np.flatnonzero(hit)
    near = np.zeros(len(hit), bool)
    near[where] = yous[np.minimum(where + NEAR + 1, rows[row[where] + 1])] > yous[np.maximum(where - NEAR, rows[row[where]])]
    capital = np.concatenate([[0], np.cumsum(_UPPER[own])])
    digit = np.concatenate([[0], np.cumsum(_DIGIT[own])])
    shouted = (capital[end] - capital[start] == end - start) & (end - start >= 3)
    digits = digit[end] - digit[start]
    mixed = (digits > 0) & (digits < end - start)
    single = end - start == 1
    spelled = np.zeros(len(single), bool)
    if len(single) > 3:
        spelled[:-3] = single[:-3] & single[1:-2] & single[2:-1] & single[3:] & (row[:-3] == row[3:])
    follows = np.zeros(len(own), bool)
    follows[1:] = (own[1:] == own[:-1]) & _PUNCTUATION[own[1:]]
    inner = np.zeros(len(own), bool)
    inner[1:-1] = _SIGNS[own[1:-1]] & _LETTER[own[:-2]] & _LETTER[own[2:]]
    # the first byte of a text follows nothing, the last one is before nothing
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(own))]
    follows[edges] = inner[edges] = inner[edges - 1] = False
    # the same text with digits and signs read as letters, other punctuation dropped
    stays = _STAYS[own]
    moved = np.concatenate([[0], np.cumsum(stays)])
    plain = _PLAIN[lower[stays]]
    pstart, pend, prows = common.words(plain, moved[at], common.SPACE)
    phash = common.SpanHash(plain)
    pwhole = phash.spans(pstart, pend)
    top = np.zeros(n)
    np.maximum.at(top, row, weight)
    counts = [
        per_row(insult, rows), per_row(weight > 0, rows), per_row(strong, rows), np.bincount(row, weight, n), per_row(you, rows), per_row(near, rows),
        per_row(_UPPER[own]), per_row(_LETTER[own]), per_row(shouted, rows), per_row(own == 33), per_row(own == 63), per_row(_PUNCTUATION[own]), per_row(follows),
        per_row(mixed, rows), per_row(inner), per_row(member(pwhole, insults), prows), per_row(lexicon.weigh(phash, pstart, pend, pwhole)[1], prows), per_row(spelled, rows),
        np.diff(rows), np.diff(at),
    ]
    return np.stack(counts, axis=1).astype(float), top


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES for each text. Texts longer than a piece are walked in parts that end at white space."""
    insults, second = hashed(INSULTS), hashed(SECOND_PERSON)
    data, offsets = common.utf8(texts)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for i, j in common.pieces(offsets):
        own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if j == i + 1 and len(own) > common.PIECE_BYTES:
            c, top = np.zeros((1, 1)), np.zeros(1)
            for a, b in common.parts(own, common.SPACE):
                some, most = sums(own[a:b], np.array([0, b - a]), lexicon, insults, second)
                c, top = c + some, np.maximum(top, most)
        else:
            c, top = sums(own, at, lexicon, insults, second)
        insult, known, strong, weight, you, near, upper, letter, shouted, exclaim, question, punctuation, follows, mixed, inner, hidden, hidden_strong, spelled, words, size = c.T
        count, letters, size = np.maximum(words, 1), np.maximum(letter, 1), np.maximum(size, 1)
        out[i:j] = np.stack([
            insult / count, np.log1p(insult), known / count, strong / count, np.log1p(strong), weight / count, top,
            you / count, near / count, upper / letters, shouted / count, exclaim / size, question / size, punctuation / size, follows / size,
            mixed / count, inner / count, np.maximum(hidden - insult, 0) / count, np.maximum(hidden_strong - strong, 0) / count, spelled / count,
            np.log1p(words), letter / count,
        ], axis=1)
    return out


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Texts with labels from a bounded sample of the rows that are not held out: (text, label, fold in 0..9)."""
    marks = labels.filter(F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    chosen = marks.filter(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id")  # `chosen` has at most `sample` rows
    return rows.select("text", "label", F.pmod(F.xxhash64("text"), F.lit(10)).alias("fold"))


def learn_lexicon(rows: DataFrame, most: int = ENTRIES) -> Lexicon:
    """Entries that mark toxic texts: log odds that many standard errors above 0.5, the surest first.

    More texts have more entries that mark by chance, so the standard errors asked for rise from 2 at
    300 texts to 3.5 at 10,000.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.asarray(batch.column(1), dtype=float) > 0.5
            data, offsets = common.utf8(batch.column(0))
            for i, j in common.pieces(offsets):
                long = j == i + 1 and offsets[j] - offsets[i] > common.PIECE_BYTES
                got = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
                for a, b in common.parts(data[offsets[i] : offsets[j]], common.SPACE) if long else [(0, offsets[j] - offsets[i])]:
                    own = common.lower_ascii(data[offsets[i] + a : offsets[i] + b])
                    at = np.array([0, b - a]) if long else offsets[i : j + 1] - offsets[i]
                    start, end, rows = common.words(own, at, WORD_GAP)
                    hashes = common.SpanHash(own)
                    row = np.repeat(np.arange(j - i), np.diff(rows))
                    for of, name in entries(hashes, start, end, hashes.spans(start, end)):
                        got.append((np.unique(name), np.zeros(0, np.int64)) if long else (name, row[of]))
                names = np.concatenate([g[0] for g in got])
                of = np.zeros(len(names), np.int64) if long else np.concatenate([g[1] for g in got])
                order = np.lexsort([of, names])
                names, of = names[order], of[order]
                new = np.ones(len(names), bool)
                new[1:] = (names[1:] != names[:-1]) | (of[1:] != of[:-1])
                names, of = names[new], of[new]
                first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
                if len(first):
                    toxic = np.add.reduceat(label[i:j][of].astype(np.int64), first)
                    n = np.diff(np.append(first, len(names)))
                    yield pa.RecordBatch.from_arrays([pa.array(names[first].view(np.int64)), pa.array(toxic), pa.array(n - toxic)], names=["name", "toxic", "clean"])

    totals = rows.agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).first()
    errors = float(np.clip(2 + np.log10(max(1, (totals["t"] or 0) + (totals["c"] or 0)) / 300), 2, 3.5))
    if not totals["t"] or not totals["c"]:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, bool))
    counted = rows.select("text", "label").mapInArrow(run, "name bigint, toxic bigint, clean bigint").groupBy("name").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    weight = F.log(t / (totals["t"] + 1)) - F.log(c / (totals["c"] + 1))
    error = F.sqrt(1 / t + 1 / c)
    best = counted.filter(F.col("t") >= 3).select("name", weight.alias("weight"), error.alias("error")).filter(F.col("weight") - errors * F.col("error") >= 0.5)
    found = best.orderBy((F.col("weight") - errors * F.col("error")).desc(), "name").limit(most).collect()
    names = np.array([r["name"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(names)
    weights = np.array([r["weight"] for r in found], float)
    return Lexicon(names[order], weights[order], np.array([r["weight"] - (errors + 1) * r["error"] >= 1 for r in found], bool)[order])


def with_features(rows: DataFrame, keep: list[str], lexicon: Lexicon) -> DataFrame:
    """The columns `keep` and FEATURES of each row's text."""
    common.sent_to_workers(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)  # at most ENTRIES entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = features(batch.column(len(keep)), shared.value)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], *[pa.array(got[:, k]) for k in range(len(FEATURES))]], names=[*keep, *FEATURES])

    schema = T.StructType([*[rows.schema[c] for c in keep], *[T.StructField(f, T.DoubleType()) for f in FEATURES]])
    return rows.select(*keep, "text").mapInArrow(run, schema)


@dataclass
class Model:
    lexicon: Lexicon
    trees: PipelineModel | None
    calibration: object | None
    share: float

    def score(self, docs: DataFrame, keep: list[str], out: str = "score") -> DataFrame:
        """The columns `keep` of each document and its score in [0, 1]."""
        if self.trees is None:
            return docs.select(*keep, F.lit(float(self.share)).alias(out))
        got = self.trees.transform(with_features(docs.withColumn("text", F.coalesce("text", F.lit(""))), keep, self.lexicon))
        got = got.withColumn("raw__", vector_to_array("probability")[1])
        if self.calibration is not None:
            got = self.calibration.transform(got)
        else:
            got = got.withColumn("calibrated__", F.col("raw__"))
        return got.select(*keep, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("calibrated__"))).alias(out))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    common.sent_to_workers(spark)
    rows = common.written(labelled(docs, labels, sample), spark, "labelled")
    lexicon = learn_lexicon(rows.filter("fold < 5"))
    share = rows.agg(F.avg("label").alias("share")).first()["share"] or 0.0
    known = common.written(with_features(rows, ["label", "fold"], lexicon), spark, "features").coalesce(8)
    classes = {(r["late"], r["label"]) for r in known.filter("fold >= 5").select((F.col("fold") >= 8).alias("late"), "label").distinct().collect()}
    if not {(False, 0.0), (False, 1.0)} <= classes:
        return Model(lexicon, None, None, share)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxDepth=4, maxIter=20, stepSize=0.3, seed=7)
    learn = assembler.transform(known.filter("fold >= 5 and fold < 8")).select("label", "features").cache()
    model = PipelineModel([assembler, trees.fit(learn)])
    learn.unpersist()
    calibration = None
    if {(True, 0.0), (True, 1.0)} <= classes:
        late = model.transform(known.filter("fold >= 8")).select("label", vector_to_array("probability")[1].alias("raw__"))
        calibration = calibrated(spark, late)
    return Model(lexicon, model, calibration, share)


def calibrated(spark: SparkSession, late: DataFrame):
    """Isotonic regression of label on raw__, whose steps rise a little.

    A step holds many raw values equal. Here it begins and ends TILT of the way towards the steps
    beside it, so the score also orders texts within a step. `late` is a part of the sample.
    """
    model = IsotonicRegression(labelCol="label", featuresCol="raw__", predictionCol="calibrated__").fit(late)
    steps: dict[float, list[float]] = {}
    for x, y in zip(model.boundaries.tolist(), model.predictions.tolist()):  # two values a step
        steps.setdefault(y, []).append(x)
    levels = sorted(steps)
    points = {}
    for y, below, above in zip(levels, [levels[0], *levels], [*levels[1:], levels[-1]]):
        points[min(steps[y])] = y - TILT * (y - below)
        points[max(steps[y])] = y + TILT * (above - y)
    knots = spark.createDataFrame(sorted(points.items()), "raw__ double, label double")
    return IsotonicRegression(labelCol="label", featuresCol="raw__", predictionCol="calibrated__").fit(knots)


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    """One row: rows, and the mean distance of mean score and share of label 1 over equal bins of the score.

    scored: score and label.
    """
    by = scored.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("score") - F.avg("label")).alias("gap"))
    return by.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("error"))


def report(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from LIMIT on) of every document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = fit(spark, rows, labels).score(rows, ["doc_id"])
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The documents that score below the limit, whole and with their own columns."""
    rows = docs.withColumn("whole__", F.struct(*docs.columns)).select("whole__", "doc_id", "text")
    model = fit(spark, docs, labels)
    return model.score(rows, ["whole__"], "score__").filter(F.col("score__") < limit).select("whole__.*")
