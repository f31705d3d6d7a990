import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from perigon.llm import tokens

ENCODER = tokens.Encoder(tokens.tokenizer_path())


def plain(text):
    return len(ENCODER.tokenizer.encode(text, add_special_tokens=False))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_counts_as_the_library_has_it(text):
    assert ENCODER.count(text) == plain(text)


@pytest.mark.parametrize("chunk,overlap", [(20, 2), (40, 8), (33, 16)])
def test_splices_equal_whole_encodings(chunk, overlap):
    rng = random.Random(chunk)
    bits = ["a", "b", " ", "  ", "\n", "<|endoftext|>", "<|endo", "text|>", "'s", "é", "漢", "字", "😀", "1", "23", "!!", "‍", "́", "don't", " \t ", "a" * 32]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 120)))
        assert tokens.count_spliced(text, ENCODER.pieces, ENCODER.margin, chunk, overlap) == plain(text)


def test_overlaps_widen_over_a_piece_without_boundary():
    text = "start " + "x" * 5000 + " end"
    assert tokens.count_spliced(text, ENCODER.pieces, ENCODER.margin, 100, 10) == plain(text)


def test_rows(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (3, "<|endoftext|>"), (None, "word " * 600), (4, "ab " * 40000)]
    got = tokens.count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), chunk=1000).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got], key=str) == sorted([(d, len((t or "").encode()), plain(t or ""), plain(t or "") > 512) for d, t in rows], key=str)
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id bigint, text string, n_tokens int")).count() == 0


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(7, "one two", "x", 3, True)] * 3 + [(None, None, None, None, None)]
    got = tokens.count_tokens(spark.createDataFrame(rows, "doc_id int, text string, n_tokens string, n_bytes int, over_limit boolean")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(7, 7, plain("one two"), False)] * 3 + [(None, 0, 0, False)], key=str)
