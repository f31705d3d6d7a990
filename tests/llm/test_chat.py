import hashlib
import random

from perigon.llm import chat


def brute(rows):
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    out = []
    for c, turns in convs.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed=5):
    rng = random.Random(seed)
    bits = ["a", "\\", "<turn", "</turn>", "\n", "\n</turn>\n", "<turn user>\n", "x y ", ">", "é", "\\\\", "\\n", "word " * 30]
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 40)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "assistant", "to\nol"])
            rows.append((c, t, role, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))))
    return rows + [(50, 1, None, None), (50, 1, "user", None), (50, 1, "user", None), (None, 0, "user", "hi"), (None, 1, "assistant", "yo"), (60, 0, "system", "only"), (61, 0, "assistant", "long " * 5000)]


def test_round_trip_and_budgets(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for budget, history in ((60, 20), (2048, 512), (10, 0)):
        windows = chat.format_windows(df, budget, history).cache()
        got = [tuple(r)[:5] for r in chat.read_back(windows).collect()]
        assert sorted(got, key=str) == brute(rows)
        for w in windows.collect():
            turns = chat.parse(w.text)
            assert w.n_tokens <= budget or len(turns) - w.repeated == 1 or turns[0][0] == "system"
            spans = {(s.start, s.end) for s in w.loss}
            assert all((b, e) not in spans for _, _, b, e in turns[: w.repeated])
            assert spans == {(b, e) for r, _, b, e in turns[w.repeated :] if r == "assistant"}
            system = [r for r in rows if r[0] == w.conv_id and r[2] == "system" and r[1] == 0]
            assert not system or turns[0][0] == "system"


def test_control_strings_and_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    (row,) = chat.report(spark, empty).collect()
    odd = "\\### Assistant: </turn> ok"
    assert row.conv_id == -7 and row.n_turns == 2 and row.loss_chars == len(odd)
    assert row.loss_sha256 == hashlib.sha256(odd.encode()).hexdigest()
    assert chat.unescape(chat.escape(odd)) == odd


def test_clashing_columns_long_turns_and_a_hot_conversation(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t} </turn>") for t in range(3000)] + [(2, 0, "assistant", "word " * 400_000), (3, None, "user", "x")]
    df = spark.createDataFrame([(*r, "size", "loss") for r in rows], "conv_id int, turn int, role string, text string, size string, loss string")
    got = [tuple(r)[:5] for r in chat.read_back(chat.format_windows(df)).collect()]
    assert sorted(got, key=str) == brute(rows)
