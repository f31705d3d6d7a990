"""One text of 50 MB through the array code of each operator that walks whole texts, under 1 GB of memory."""

import subprocess
import sys
from pathlib import Path

import pytest

LIMIT_MB = 1000
HEAD = """
import resource
import numpy as np, pyarrow as pa
words = np.array([("w%x" % (k * 2654435761 % 2**32))[: 3 + k % 6] for k in range(50000)])
def long(mb, seed):
    out, rng = [], np.random.default_rng(seed)
    while sum(map(len, out)) < mb << 20:
        out.append(" ".join(words[rng.integers(0, len(words), 200000)]) + " ")
    return "".join(out)
def table(texts):
    return pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts), "block": pa.array([0] * len(texts), pa.int64())})
text = long(50, 1)
"""
CODE = {
    "fingerprints": """
from perigon.llm import fingerprints as fp
batch = pa.RecordBatch.from_pydict({"part": [0, 0], "tail": [0, 1], "doc_id": [2, 1], "text": [text, "a short one"]})
got = [r for b in fp.edited_pairs()(iter([batch])) for r in b.to_pylist()]
assert len(got) == 1 and got[0]["n_chars"] == len(text) and got[0]["near_edited"] > 0.3
""",
    "near_dedup": """
from perigon.llm import near_dedup as nd
(one, least), = nd.Signer(nd.tree_count(80)).rows(pa.array([text]))
assert len(one) > 5_000_000 and len(least) == nd.tree_count(80) * nd.LEAST
""",
    "decontamination": """
from perigon.llm import decontamination as dc
item = " ".join(text[-500:].split()[1:-1])
rows = [r for b in dc.windows_of(10)(iter(pa.table({"item_id": ["i"], "text": [item]}).to_batches())) for r in b.to_pylist()]
table = pa.table({"words": pa.array([r["words"] for r in rows], pa.binary()), "plain": pa.array([r["plain"] for r in rows], pa.binary()), "n": [r["n"] for r in rows], "token": [r["tokens"][0] for r in rows], "place": [0] * len(rows)})
class Shared:
    value = dc.Windows(table)
batch = pa.RecordBatch.from_pydict({"text": [text], "n_words": [0], "n_hit": [0], "spans": pa.array([[]], pa.list_(dc.SPAN_ARROW)), "windows": pa.array([[]], pa.list_(pa.binary()))})
(got,) = [r for b in dc.marker(Shared, ["text"])(iter([batch])) for r in b.to_pylist()]
assert got["n_hit"] == len(item.split()) and set(got["windows"]) == {r["plain"] for r in rows}
""",
    "quality_rules": """
from perigon.llm import quality_rules as qr
raw = text.encode()
numbers = qr.word_numbers(raw)
assert len(numbers) == len(text.split()) and qr.repeated_words(numbers) >= 0
assert sum(qr.line_keys(raw, "h")[2]) == len(numbers)
""",
    "lexical_search": """
from perigon.llm import lexical_search as ls
ls.TaskContext = type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})())})
batch = pa.RecordBatch.from_pydict({"id": [1, 2], "text": [text, "a short one"]})
blocks = [r for b in ls._blocks(64, 1 << 20)(iter([batch])) for r in b.to_pylist()]
assert sorted(i for b in blocks for i in b["ids"]) == [1, 2] and sum(b["n_terms"] for b in blocks) > 1_000_000
""",
    "toxicity": """
from perigon.llm import toxicity
lexicon = toxicity.Lexicon(np.sort(toxicity.hashed(list(map(str, words[:2000])))), np.ones(len(set(map(str, words[:2000])))), np.zeros(len(set(map(str, words[:2000]))), bool))
got = toxicity.features(pa.array([text]), lexicon)
assert got[0, toxicity.FEATURES.index("length")] > 15
""",
    "substrings": """
from perigon.llm import substrings as s
key, rows = (pa.scalar(0, pa.int64()),), table([text[3000:9000], text, "x" * 70])
reply = s.shared_anchors(s.HOT)(s.anchor_entries(50, 1)(key, rows))
reply = s.settled(50)(s.extent_entries(50, 1, 1)(key, rows, reply))
got = s.removals(50, 1, 1)(key, rows, reply).to_pylist()
assert [x["end"] - x["start"] for r in got for x in r["spans"]] == [6000]
""",
    "tokens": """
from perigon.llm import tokens
encoder = tokens.encoder_for(tokens.tokenizer_path())
assert tokens.count_spliced(text[: 4 << 20], encoder.pieces, encoder.margin) > 1_000_000
""",
}


@pytest.mark.parametrize("name", sorted(CODE))
def test_memory(name):
    code = HEAD + CODE[name] + "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) < LIMIT_MB, done.stdout
