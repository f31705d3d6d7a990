import random

from perigon.llm import near_dedup


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows, percent):
    s = [sets(t) for _, t in rows]
    of = list(range(len(rows)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] is not None and rows[i][0] == rows[j][0] and s[i] and s[j]
            if rows[i][0] is not None and rows[j][0] is not None and s[i] and s[j] and (same or 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])):
                of[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted([(d, len(s[k]), d if d is None or not s[k] else least[find(k)]) for k, (d, _) in enumerate(rows)], key=str)


def corpus(seed=4):
    rng = random.Random(seed)

    def text(n):
        return [f"w{rng.randrange(4000)}" for _ in range(n)]

    rows = [(k, " ".join(text(rng.randint(0, 80)))) for k in range(150)]
    n = 1000
    for g in range(12):
        base = text(rng.randint(30, 150))
        for _ in range(rng.choice([2, 3, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.random())
            rows.append((n, " ".join(copy)))
            n += 1
    # a hub whose copies are too far from each other, and a chain
    base = text(200)
    for k in range(40):
        copy = list(base)
        copy[5 * k + 2] = "hub" + str(k)
        copy[(5 * k + 90) % 200] = "hub" + str(k)
        rows.append((n, " ".join(copy)))
        n += 1
    rows.append((n, " ".join(base)))
    chain = text(120)
    for k in range(15):
        chain = list(chain)
        chain[(k * 8) % 120] = f"link{k}"
        rows.append((n + 1 + k, " ".join(chain)))
    rng.shuffle(rows)
    return rows + [(5000, None), (5001, ""), (5002, " \n "), (None, rows[0][1]), (None, None), (6000, "Two Words"), (6001, "two\twords"), (6002, "two words more"), rows[0], (7000, rows[5][1])]


def test_against_brute_force_with_and_without_blocks(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for percent, block, most in ((85, near_dedup.BLOCK_SHINGLES, near_dedup.BLOCK_DOCS), (80, 2000, near_dedup.BLOCK_DOCS), (80, near_dedup.BLOCK_SHINGLES, 5)):
        got = near_dedup.near_components(spark, df, percent, block_shingles=block, block_docs=most).collect()
        assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == brute(rows, percent)
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_one_document_of_each_group_stays(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, n_shingles int")
    kept = near_dedup.deduplicated(spark, df, 80)
    assert kept.columns == df.columns
    want = sorted({d for d, _, c in brute(rows, 80) if d is not None and d == c})
    got = [r.doc_id for r in kept.collect()]
    assert sorted(d for d in got if d is not None) == want and got.count(None) == 2


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_dedup.near_components(spark, empty).count() == 0
    assert near_dedup.deduplicated(spark, empty).count() == 0


def test_of_repeated_ids_the_smallest_text_stays(spark):
    rows = [(1, "b c d e f g", 1), (1, "a b c d e f", 2), (1, None, 3), (2, "z y x w v u", 4), (2, "z y x w v u", 4), (3, "k l m n o p q", 5), (None, "k l m n o p q", 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, whole__ int")
    got = near_dedup.deduplicated(spark, df.withColumnRenamed("whole__", "region"), 80).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, None, 3), (2, "z y x w v u", 4), (3, "k l m n o p q", 5), (None, "k l m n o p q", 6)], key=str)


def test_near_misses_and_a_dense_region(spark):
    """Hundreds of texts of one template, few of them linked, in blocks: the rarest members keep the comparisons few."""
    rng = random.Random(9)
    base = [f"t{k}" for k in range(60)]
    rows = []
    for k in range(300):
        copy = list(base)
        for j in rng.sample(range(60), 2 if k % 10 else 1):
            copy[j] = f"own{k}-{j}"
        rows.append((k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dedup.near_components(spark, df, 85, block_docs=20).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == brute(rows, 85)


def test_long_words_that_hash_alike_by_polynomials(spark):
    from perigon.llm import fingerprints
    from tests.llm.test_decontamination import swapped

    words = swapped()
    docs = spark.createDataFrame([(k, f"the same words around {w} and after it as well") for k, w in enumerate(words)], "doc_id bigint, text string")
    assert {r.component_id for r in near_dedup.near_components(spark, docs, percent=85).collect()} == {0, 1}
    assert {r.doc_id for r in near_dedup.deduplicated(spark, docs).collect()} == {0, 1}
    prints = fingerprints.edited_fingerprints(docs).orderBy("doc_id").collect()
    assert prints[0].fingerprint != prints[1].fingerprint


def test_ids_that_go_by_either_way(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(40)) for _ in range(30)]
    rows = [(k, texts[k % 30]) for k in range(80)] + [(None, texts[0]), (None, None), (500, None), (501, "")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, kept string")
    both = [sorted(map(str, near_dedup.deduplicated(spark, docs, few=few).collect())) for few in (1000, 0)]
    assert both[0] == both[1] and len(both[0]) == len({c for _, _, c in brute([r for r in rows if r[0] is not None and (r[1] or "").strip()], 80)}) + 4
