r"""Chat formatting in budgeted windows.

A turn is written as ``<turn ROLE>``, a newline, the text, a newline, ``</turn>`` and a newline. In
texts a backslash is doubled, and one is put before ``<turn`` and ``</turn``; so a line ``</turn>``
only ever ends a turn, and the text comes back exactly. In roles a newline is written ``\n``.

A conversation becomes windows of at most `budget` tokens. Prefix sums of the turns' tokens choose
each window: it begins with the system turn, repeats the latest turns of at most `history` tokens,
and goes on with as many new turns as fit. Turns are never cut; a turn that does not fit by itself
has a window to itself. The loss mask covers the texts of new assistant turns; repeated ones are
context only, so that each is a target once.

Conversations are read as a stream sorted by (conv_id, turn, role, text): a task holds one window,
however long a conversation is. Tokens are counted before that exchange, by all tasks. (Laying out one
conversation and reading it back is one task's work, since its digest is a chain over all its turns.)

Edge cases: null roles and texts are empty; rows with an equal turn are ordered by role and text, and
repeated rows are turns of their own; rows without conv_id form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigon.llm import common, tokens

BUDGET = 2048
HISTORY = 512
END = "\n</turn>\n"
_ESCAPED = re.compile(r"\\|</?turn")
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The written turn, and where in it the text begins and ends."""
    head = "<turn " + role.replace("\\", "\\\\").replace("\n", "\\n") + ">\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin, end) of each turn of a window; begin and end of the text as written."""
    found, at = [], 0
    while at < len(window):
        line = window.index("\n", at)
        end = window.index(END, line)
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], window[at + 6 : line - 1])
        # an empty text shares the newline of the header with the end mark's search, so look from the line's end
        found.append((role, unescape(window[line + 1 : max(line + 1, end)]), line + 1, max(line + 1, end)))
        at = end + len(END)
    return found


class Windows:
    """Windows of one conversation from its turns, one after the other."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system = None
        self.turns: list[tuple[str, int, int, str, int]] = []  # repeated ones first
        self.sums = [0]
        self.repeated, self.number, self.first = 0, 0, True

    def add(self, role: str, text: str, size: int) -> Iterator[tuple]:
        """size: tokens of the written turn."""
        written, begin, end = format_turn(role, text)
        if self.first and role == "system":
            self.system, self.first = (written, begin, end, role, size), False
            return
        self.first = False
        room = self.budget - (self.system[4] if self.system else 0)
        if len(self.turns) > self.repeated and self.sums[-1] + size > room:
            yield self.close()
            keep = bisect_left(self.sums, self.sums[-1] - self.history)
            self.turns = self.turns[keep:]
            self.sums = [s - self.sums[keep] for s in self.sums[keep:]]
            self.repeated = len(self.turns)
        if self.repeated and self.repeated == len(self.turns) and self.sums[-1] + size > room:
            keep = min(bisect_left(self.sums, self.sums[-1] + size - room), len(self.turns))
            self.turns = self.turns[keep:]
            self.sums = [s - self.sums[keep] for s in self.sums[keep:]]
            self.repeated = len(self.turns)
        self.turns.append((written, begin, end, role, size))
        self.sums.append(self.sums[-1] + size)

    def close(self) -> tuple:
        """(window, text, loss, repeated, n_tokens)"""
        parts, loss, at = [], [], 0
        again = self.repeated
        if self.system:
            parts.append(self.system[0])
            at = len(self.system[0])
            again += self.number > 0
        for k, (written, begin, end, role, _) in enumerate(self.turns):
            if role == "assistant" and k >= self.repeated:
                loss.append({"start": at + begin, "end": at + end})
            parts.append(written)
            at += len(written)
        self.number += 1
        return self.number - 1, "".join(parts), loss, again, self.sums[-1] + (self.system[4] if self.system else 0)

    def finish(self) -> Iterator[tuple]:
        if len(self.turns) > self.repeated or not self.number and self.system:
            yield self.close()


LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
WINDOWS = "conv_id bigint, window bigint, text string, loss array<struct<start:bigint,end:bigint>>, repeated bigint, n_tokens bigint"


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, path: str | None = None) -> DataFrame:
    """Windows of all conversations: conv_id, window, text, loss (ranges of characters), repeated (leading turns), n_tokens."""
    path = path or tokens.tokenizer_path()
    common.sent_to_workers(conversations.sparkSession)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The turns with their tokens, before any exchange: a conversation of most turns is counted by all tasks."""
        encoder = tokens.encoder_for(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sizes = []
                for role, text in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    written = format_turn(role, text)[0]
                    sizes.append(encoder.count(written) if len(written) <= tokens.CHUNK else tokens.count_spliced(written, encoder.pieces, encoder.margin))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes, pa.int64())], names=["conv_id", "turn", "role", "text", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        held, windows = object(), None

        def out() -> pa.RecordBatch:
            columns = [[r[k] for r in ready] for k in range(6)]
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), LOSS, pa.int64(), pa.int64()))], names=["conv_id", "window", "text", "loss", "repeated", "n_tokens"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for conv, role, text, size in zip(*(part.column(c).to_pylist() for c in range(4))):
                    if windows is None or conv != held:
                        if windows:
                            ready += [(held, *w) for w in windows.finish()]
                        held, windows = conv, Windows(budget, history)
                    ready += [(held, *w) for w in windows.add(role, text, size)]
                if len(ready) >= 64:
                    yield out()
        if windows:
            ready += [(held, *w) for w in windows.finish()]
        if ready:
            yield out()

    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["turn"].dataType.simpleString()
    counted = rows.mapInArrow(sized, f"conv_id bigint, turn {kind}, role string, text string, size bigint")
    dealt = counted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text", "size").mapInArrow(run, WINDOWS)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation hold, from their text and loss mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        held, have = None, None

        def done() -> tuple:
            return held, have[0], have[1].hexdigest(), have[2], have[3].hexdigest(), have[4]

        def out() -> pa.RecordBatch:
            columns = [[r[k] for r in ready] for k in range(6)]
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                for conv, text, loss, repeated in zip(*(part.column(c).to_pylist() for c in range(4))):
                    if have is None or conv != held:
                        if have:
                            ready.append(done())
                        held, have = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, turn, _, _ in parse(text)[repeated:]:
                        have[0] += 1
                        have[1].update(f"{role}\n{turn}\n".encode("utf-8", "surrogatepass"))
                    for span in loss:
                        target = unescape(text[span["start"] : span["end"]])
                        have[2] += len(target)
                        have[3].update(target.encode("utf-8", "surrogatepass"))
                    have[4] += len(text)
                if len(ready) >= 1024:
                    yield out()
        if have:
            ready.append(done())
        if ready:
            yield out()

    common.sent_to_workers(windows.sparkSession)
    rows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.select("conv_id", "text", "loss", "repeated").mapInArrow(run, DIGEST)


def report(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """All conversations and one of control strings, formatted, written and read back."""
    odd = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"), F.lit(odd).alias("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(extra.withColumn("turn", F.col("turn").cast("bigint")))
    return read_back(common.written(format_windows(rows), spark, "chat-windows"))
