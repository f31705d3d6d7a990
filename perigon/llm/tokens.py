"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A text of at most `chunk` characters is encoded in one go. A longer one is cut into chunks that
overlap. Each chunk's encoding is seen as pieces (the pre-tokenizer's units, each with its offset,
inside which alone tokens merge). The pre-tokenizer reads left to right and its state is only its
position, so as soon as two encodings have a piece starting at the same offset, both go on alike:
that offset is a proven boundary, and the encodings are spliced there. Boundaries closer to the end
of the earlier chunk than the longest added token are not used, since text that is not seen yet
could change them. When an overlap has no common boundary, the later chunk starts earlier (the
overlap doubles) until one is found, at the latest where the earlier chunk itself starts.

Byte-level vocabularies without a normalizer have a quick path: texts of Latin letters and common
signs are cut with the vocabulary's own pattern and each distinct piece is encoded by the library
once. All other texts and vocabularies go through the library as a whole.

Edge cases: a null text is an empty one and has no tokens; added tokens that occur in a text count as
the library has it by default (one token each).
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigon.llm import common

CHUNK = 1 << 16
OVERLAP = 256
TOKENIZER = "byte_bpe_50k.json"
#: Distinct pieces whose lengths a task remembers.
REMEMBERED = 200_000
#: Characters on which the pattern's classes are the same in every Unicode version in use: up to Latin Extended-A, general punctuation, currency.
COMMON = "\t-\r -~ -ſ‐-‧‰-⁞€"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes text into pieces: (start offset, number of tokens) lists, by the library's rules."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, processors

        self.tokenizer = Tokenizer.from_file(path)
        # special tokens are not asked for, so all that a post-processor could do is to trim the offsets that splicing needs
        self.tokenizer.post_processor = processors.TemplateProcessing(single="$A", pair="$A $B", special_tokens=[])
        with open(path) as file:
            spec = json.load(file)
        added = spec.get("added_tokens") or []
        before = spec.get("pre_tokenizer") or {}
        self.added = [a["content"] for a in added]
        plain = not any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip"))
        self.quick = plain and not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.margin = 2 + max((len(a) for a in self.added), default=0)
        self.split_added = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.common = regex.compile(f"[{COMMON}]*")
        # the pattern of byte-level vocabularies
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.known: dict[str, int] = {}

    def lengths(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece; a piece is what the pre-tokenizer leaves together."""
        known = self.known
        new = [p for p in dict.fromkeys(pieces) if p not in known]
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(dict.fromkeys(pieces))
            for i in range(0, len(new), 4096):
                some = new[i : i + 4096]
                known.update(zip(some, map(len, self.tokenizer.encode_batch_fast(some, add_special_tokens=False))))
        return [known[p] for p in pieces]

    def is_quick(self, text: str) -> bool:
        return self.quick and self.common.fullmatch(text) is not None

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at added tokens; True marks these."""
        if self.split_added is None or not any(a in text for a in self.added):
            yield text, False
            return
        for i, part in enumerate(self.split_added.split(text)):
            if part:
                yield part, i % 2 == 1

    def count(self, text: str) -> int:
        """Tokens of a text, encoded in one go."""
        if not self.is_quick(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        return sum(1 if added else sum(self.lengths(self.pattern.findall(part))) for part, added in self.parts(text))

    def pieces(self, text: str) -> tuple[list[int], list[int]]:
        """Start of each piece of a text and its tokens."""
        if self.is_quick(text):
            starts, counts, at = [], [], 0
            for part, added in self.parts(text):
                if added:
                    starts.append(at)
                    counts.append(1)
                else:
                    found = self.pattern.findall(part)
                    counts += self.lengths(found)
                    for p in found:
                        starts.append(at)
                        at += len(p)
                    continue
                at += len(part)
            return starts, counts
        got = self.tokenizer.encode(text, add_special_tokens=False)
        starts, counts, last = [], [], None
        for word, (start, _) in zip(got.word_ids, got.offsets):
            if word is None or word != last:
                starts.append(start)
                counts.append(0)
                last = word
            counts[-1] += 1
        return starts, counts


@functools.lru_cache(maxsize=4)
def encoder_for(path: str) -> Encoder:
    """One encoder for a worker process: what it remembers serves the tasks that follow."""
    return Encoder(path)


def count_spliced(text: str, pieces, margin: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text from encodings of overlapping chunks. pieces(text): starts and tokens of its pieces."""
    n = len(text)
    total = 0
    begin, end = 0, min(chunk, n)
    starts, counts = pieces(text[:end])
    while end < n:
        last = end - margin  # later boundaries of this chunk could still change
        known = {s + begin for s in starts if s + begin <= last}
        wider, at = overlap, None
        while at is None:
            again = max(begin, end - wider)
            after = min(n, max(again + chunk, end + margin + wider))
            new_starts, new_counts = pieces(text[again:after])
            # a chunk that starts where the earlier one does begins with the same pieces, read further
            at = again if again == begin else next((s + again for s in new_starts if s and s + again in known), None)
            wider *= 2
        total += sum(c for s, c in zip(starts, counts) if s + begin < at)
        kept = [(s + again - at, c) for s, c in zip(new_starts, new_counts) if s + again >= at]
        starts, counts = [s for s, _ in kept], [c for _, c in kept]
        begin, end = at, after
    return total + sum(counts)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text."""
    path = path or tokenizer_path()
    common.sent_to_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                tokens = []
                for text in some.column(1).to_pylist():
                    tokens.append(encoder.count(text) if len(text) <= chunk else count_spliced(text, encoder.pieces, encoder.margin, chunk, overlap))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
