"""Removal of repeated substrings by bucket-pointer refinement over all documents.

A byte is removed when a string of `window` bytes that covers it also starts in a document with a
smaller doc_id. Sorting every position of a corpus is too much to exchange, so positions are first
dealt to parts in a way that keeps equal windows together, and refined there.

1.  Of the strings of GRAM bytes inside a window the one of smallest hash is its anchor; equal windows
    have equal anchors at equal places. 32 bits of each distinct anchor of a block of documents (about
    7 % of the positions) are exchanged; anchors that one document alone has are dropped. Equality of
    hashes keeps an anchor, it never removes a byte.
2.  The windows of an anchor follow each other. The bytes they span, its extent, go to the anchor's
    part, each distinct extent of a block once, with the smallest doc_id that has it. Anchors in many
    blocks are dealt by single windows instead, so that a phrase that a third of all documents have
    with different neighbours is no hot group.
3.  In a part, windows are refined by bucket pointers: buckets of 8-byte strings get numbers, and a
    string of twice the length gets its bucket from the numbers of its halves, (bucket at i, bucket at
    i + length), sorted again; windows end with two overlapping strings. Numbers stand for bytes that
    are equal, so no step can confuse two strings. A bucket of one position is settled and goes no
    further. The smallest doc_id of each window's bucket decides, and a bit for each window goes back.
4.  The windows found are laid over the text.

Texts move once: blocks (about `block_bytes` of text, dealt by a hash of doc_id) are one exchange
that all steps share. Long texts are walked in pieces that overlap by a window.

Edge cases: a null text is an empty one; a row without doc_id is never smaller than another and
keeps its text; rows with the same doc_id are not smaller than each other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigon.llm import common

WINDOW = 50
GRAM = 24
BLOCK_BYTES = 4 << 20
#: Text bytes for which one task looks at anchors, and for which one task refines extents.
ANCHOR_BYTES = 24 << 20
PART_BYTES = 2 << 20
#: Partitions of blocks and of parts at most; beyond, a partition holds several, one after the other.
MOST_PARTITIONS = 20_000
#: Blocks that have an anchor, from which on it is dealt by single windows.
HOT = 256
_PLACE = np.uint64((1 << 30) - 1)
_LATER = np.uint64(0x9FB21C651E98DF25)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    have, size = values, 1
    while size * 2 <= width:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    rest = width - size
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def expand(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All integers of the ranges [first, end), one range after the other."""
    n = end - first
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def merged(start: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ranges [start, end) laid together: starts and ends of the maximal runs, which end where a row does."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    row = np.searchsorted(offsets, start, "right")
    new = np.append(True, (start[1:] > end[:-1]) | (row[1:] != row[:-1]))[: len(start)]
    return np.stack([start[new], end[np.append(np.flatnonzero(new)[1:], len(start)) - 1] if len(start) else end])


def same_strings(data: np.ndarray, hashes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal strings of a buffer, and the first string of each number. Hashes only sort: bytes are compared."""
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    of = of.ravel()
    other = first[of]
    todo = np.flatnonzero(other != np.arange(len(of)))
    ok = bool((length[todo] == length[other[todo]]).all())
    for k in range(0, len(todo), 1 << 14):
        if not ok:
            break
        a, b = todo[k : k + (1 << 14)], other[todo[k : k + (1 << 14)]]
        ok = bool((data[expand(start[a], start[a] + length[a])] == data[expand(start[b], start[b] + length[b])]).all())
    if ok:
        return of, first
    known: dict[bytes, int] = {}
    of = np.array([known.setdefault(data[s : s + n].tobytes(), len(known)) for s, n in zip(start.tolist(), length.tolist())], np.int64)
    return of, np.unique(of, return_index=True)[1]


@dataclass
class Anchors:
    """Anchors of a block: hash of each, first start and number of its windows (in the block's bytes), its row."""

    name: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    row: np.ndarray
    extent: np.ndarray | None

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray, usable: np.ndarray, window: int, extents: bool) -> Anchors:
        """extents: whether hashes of the bytes that the windows of each anchor span are wanted."""
        none = np.zeros(0, np.uint64)
        found = [(none, none.astype(np.int64), none.astype(np.uint16), none.astype(np.int32), none)]
        for i, j in common.pieces(offsets):
            low, high = int(offsets[i]), int(offsets[j])
            for a in range(low, high, common.PIECE_BYTES) if j == i + 1 else [low]:
                b = min(high, a + common.PIECE_BYTES + window - 1) if j == i + 1 else high
                own = data[a:b]
                starts = np.zeros(0, np.int64)
                if j == i + 1:
                    if usable[i]:
                        starts = np.arange(max(0, min(common.PIECE_BYTES, b - a - window + 1)))
                else:
                    rows = np.flatnonzero(usable[i:j]) + i
                    starts = expand(offsets[rows] - low, offsets[rows + 1] - low - window + 1)
                if not len(starts):
                    continue
                span = common.SpanHash(own)
                grams = span.windows(GRAM)
                ranked = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
                place = (sliding_min(ranked, window - GRAM + 1)[starts] & _PLACE).astype(np.int64)
                new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
                row = np.searchsorted(offsets, first + a, "right") - 1
                found.append((common.mix(grams[place[new]] ^ _LATER), first + a, (last - first + 1).astype(np.uint16), row.astype(np.int32), span.spans(first, last + window) if extents else none))
        columns = [np.concatenate([f[k] for f in found]) for k in range(5 if extents else 4)]
        return Anchors(*columns, *([] if extents else [None]))


def keyed(names: np.ndarray, parts: int) -> np.ndarray:
    """The part in the high half, 32 bits of the name in the low half."""
    return ((names >> np.uint64(32)) % np.uint64(parts) << np.uint64(32)) | (names & np.uint64(0xFFFFFFFF))


class Block:
    """The texts of a block, its anchors, and their distinct names sorted by part."""

    def __init__(self, rows: pa.Table, window: int, parts: int, extents: bool):
        self.window = window
        ids = rows.column("doc_id").combine_chunks()
        valid = np.asarray(ids.is_valid()).astype(bool)
        self.ids = np.asarray(ids.fill_null(0), np.int64)
        self.data, self.offsets = common.utf8(rows.column("text"))
        self.anchors = Anchors.of(self.data, self.offsets, (np.diff(self.offsets) >= window) & valid, window, extents)
        self.names, self.name_of = np.unique(keyed(self.anchors.name, parts), return_inverse=True)
        self.name_of = self.name_of.ravel()

    def deal(self, shared: np.ndarray, hot: np.ndarray, parts: int) -> None:
        """Entries: the distinct extents of shared anchors, or the distinct windows of hot ones, sorted by part."""
        own = shared[self.name_of]
        single = own & hot[self.name_of]
        a = self.anchors
        whole, single = np.flatnonzero(own & ~single), np.flatnonzero(single)
        first = [a.first[whole], expand(a.first[single], a.first[single] + a.windows[single])]
        # windows of hot anchors are named by their own bytes
        hashes, names = [a.extent[whole]], [a.name[whole]]
        for k in range(0, len(first[1]), 1 << 15):
            some = first[1][k : k + (1 << 15)]
            flat = self.data[expand(some, some + self.window)]
            h = common.SpanHash(flat).spans(np.arange(len(some)) * self.window, (np.arange(len(some)) + 1) * self.window)
            hashes.append(h)
            names.append(common.mix(h ^ _LATER))
        self.first = np.concatenate(first)
        self.windows = np.concatenate([a.windows[whole].astype(np.int64), np.ones(len(first[1]), np.int64)])
        self.doc = self.ids[np.concatenate([a.row[whole], np.repeat(a.row[single], a.windows[single])])]
        length = self.windows + self.window - 1
        entry, lead = same_strings(self.data, np.concatenate(hashes), self.first, length)
        part = (np.concatenate(names)[lead] >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.entry, self.lead, self.part = place[entry], lead[order], part[order]
        self.least = np.full(len(order), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.entry, self.doc)

    def bytes_of(self, some: np.ndarray) -> bytes:
        """The bytes of entries, one after the other, compressed."""
        out = []
        for k in range(0, len(some), 1 << 15):
            at = self.lead[some[k : k + (1 << 15)]]
            out.append(self.data[expand(self.first[at], self.first[at] + self.windows[at] + self.window - 1)].tobytes())
        return pa.compress(b"".join(out), codec="zstd", asbytes=True)


def runs(part: np.ndarray, also: int | None = None) -> list[tuple[int, int, int]]:
    """(part, first, end) of the parts that sorted entries have, and of `also` if they do not have it."""
    found, first = np.unique(part, return_index=True)
    out = list(zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(part)]))
    return out if also is None or also in found else [*out, (also, 0, 0)]


def packed(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(8, "little") + np.packbits(flags).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8, offset=8), count=int.from_bytes(data[:8], "little")).astype(bool)


def answers(reply: pa.Table, column: str, part: np.ndarray) -> np.ndarray:
    """Flags of a block's entries, sorted by part, put together from the parts' replies."""
    bits = dict(zip(reply.column("part").to_pylist(), reply.column(column).to_pylist()))
    found = [unpacked(bits[p]) for p, a, b in runs(part)]
    return np.concatenate(found) if found else np.zeros(0, bool)


_KINDS = {"block": pa.int64(), "part": pa.int32(), "names": pa.binary(), "data": pa.binary(), "docs": pa.binary(), "ids": pa.binary(), "told": pa.list_(pa.binary())}
ENTRIES = "block bigint, part int, names binary, data binary, docs binary, ids binary, told array<binary>"
_REPLIES = {"block": pa.int64(), "part": pa.int32(), "bits": pa.binary(), "hot": pa.binary(), "told": pa.list_(pa.binary())}
REPLY = "block bigint, part int, bits binary, hot binary, told array<binary>"


def table(kinds: dict, rows: list[tuple]) -> pa.Table:
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds.items())})


def numbered(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Documents of entries, as numbers among the distinct ones."""
    known, which = np.unique(ids, return_inverse=True)
    return which.ravel().astype(np.uint32 if len(known) > 65536 else np.uint16).tobytes(), known.tobytes()


def owners(rows: pa.Table) -> np.ndarray:
    found = [np.zeros(0, np.int64)]
    for docs, ids in zip(rows.column("docs").to_pylist(), rows.column("ids").to_pylist()):
        ids = np.frombuffer(ids, np.int64)
        found.append(ids[np.frombuffer(docs, np.uint32 if len(ids) > 65536 else np.uint16)])
    return np.concatenate(found)


def anchor_entries(window: int, parts: int):
    """A block's distinct anchors, by part; data: flags of those that two of its documents have."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        block = Block(rows, window, parts, False)
        n = len(block.names)
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        ids = block.ids[block.anchors.row]
        np.minimum.at(low, block.name_of, ids)
        np.maximum.at(high, block.name_of, ids)
        out = []
        for p, a, b in runs(block.names >> np.uint64(32)):
            out.append((key[0].as_py(), p, block.names[a:b].astype(np.uint32).tobytes(), packed(low[a:b] < high[a:b]), None, None, None))
        return table(_KINDS, out)

    return run


def shared_anchors(hot: int):
    def run(rows: pa.Table) -> pa.Table:
        """For the entries of a part: which of them two documents have, and which `hot` blocks have."""
        names = [np.frombuffer(x, np.uint32) for x in rows.column("names").to_pylist()]
        several = [unpacked(x) for x in rows.column("data").to_pylist()]
        every, of, count = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
        inside = np.zeros(len(every), bool)
        inside[of.ravel()[np.concatenate(several)]] = True
        twice, often = (count > 1) | inside, count >= hot
        ends = np.cumsum([len(n) for n in names])
        out = []
        for block, part, at in zip(rows.column("block").to_pylist(), rows.column("part").to_pylist(), np.split(of.ravel(), ends[:-1])):
            out.append((block, part, packed(twice[at]), packed(often[at]), None))
        return table(_REPLIES, out)

    return run


def extent_entries(window: int, anchor_parts: int, parts: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, reply: pa.Table) -> pa.Table:
        if not rows.num_rows or not reply.num_rows:
            return table(_KINDS, [])
        block = Block(rows, window, anchor_parts, True)
        part = block.names >> np.uint64(32)
        shared, hot = answers(reply, "bits", part), answers(reply, "hot", part)
        block.deal(shared, hot, parts)
        carrier = key[0].as_py() % parts
        out = []
        for p, a, b in runs(block.part, carrier):
            out.append((key[0].as_py(), p, block.windows[block.lead[a:b]].astype(np.uint16).tobytes(), block.bytes_of(np.arange(a, b)), *numbered(block.least[a:b]), [packed(shared), packed(hot)] if p == carrier else None))
        return table(_KINDS, out)

    return run


def buckets(data: np.ndarray, at: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Bucket of the window at each start: equal for equal bytes, -1 for a window that no other equals.

    at: offsets of the strings of the buffer, at which nothing is read across.
    """
    n, size = len(data), 8
    end = np.repeat(at[1:], np.diff(at))

    def named(places: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Numbers of the buckets of several places; a place by itself is settled."""
        found = np.full(n, -1)
        _, of, count = np.unique(key, return_inverse=True, return_counts=True)
        number = np.where(count > 1, np.cumsum(count > 1) - 1, -1)
        found[places] = number[of.ravel()]
        return found

    places = np.flatnonzero(np.arange(size, n + size) <= end)
    key = np.zeros(len(places), np.uint64)
    for k in range(size):
        key |= data[places + k].astype(np.uint64) << np.uint64(8 * k)
    pointer = named(places, key)
    while 2 * size < window:
        places = np.flatnonzero((pointer[:-size] >= 0) & (pointer[size:] >= 0) & (np.arange(2 * size, n + size) <= end[:-size]))
        pointer = named(places, pointer[places] * n + pointer[places + size])
        size *= 2
    a, b = pointer[starts], pointer[starts + window - size]
    open_ = np.flatnonzero((a >= 0) & (b >= 0))
    found = np.full(len(starts), -1)
    _, of, count = np.unique(a[open_] * n + b[open_], return_inverse=True, return_counts=True)
    found[open_] = np.where(count > 1, np.arange(len(count)), -1)[of.ravel()]
    return found


def settled(window: int):
    def run(rows: pa.Table) -> pa.Table:
        """For the windows of a part's entries: whether a smaller document has them."""
        number = [np.frombuffer(x, np.uint16).astype(np.int64) for x in rows.column("names").to_pylist()]
        windows, ids = np.concatenate(number), owners(rows)
        sizes = [int((n + window - 1).sum()) for n in number]
        data = np.frombuffer(b"".join(pa.decompress(x, n, codec="zstd", asbytes=True) for x, n in zip(rows.column("data").to_pylist(), sizes)), np.uint8)
        length = windows + window - 1
        at = np.concatenate([[0], np.cumsum(length)])
        hashes = np.zeros(len(windows), np.uint64)
        k = 0
        while k < len(windows):  # about a piece at a time
            m = max(k + 1, int(np.searchsorted(at, at[k] + common.PIECE_BYTES, "right")) - 1)
            hashes[k:m] = common.SpanHash(data[at[k] : at[m]]).spans(at[k:m] - at[k], at[k + 1 : m + 1] - at[k])
            k = m
        same, lead = same_strings(data, hashes, at[:-1], length)
        least = np.full(len(lead), np.iinfo(np.int64).max)
        np.minimum.at(least, same, ids)
        # the windows of each distinct extent, in the smallest document that has it
        own_at = np.concatenate([[0], np.cumsum(length[lead])])
        own = data[expand(at[:-1][lead], at[1:][lead])]
        starts = expand(own_at[:-1], own_at[:-1] + windows[lead])
        doc = np.repeat(least, windows[lead])
        bucket = buckets(own, own_at, starts, window)
        several = np.flatnonzero(bucket >= 0)
        smallest = np.full(int(bucket.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, bucket[several], doc[several])
        repeated = np.zeros(len(starts), bool)
        repeated[several] = smallest[bucket[several]] < doc[several]
        first = np.cumsum(windows[lead]) - windows[lead]
        flags = repeated[expand(first[same], first[same] + windows)] | np.repeat(least[same] < ids, windows)
        ends = np.concatenate([[0], np.cumsum([int(n.sum()) for n in number])])
        out = [(block, part, packed(flags[a:b]), None, told) for block, part, told, a, b in zip(rows.column("block").to_pylist(), rows.column("part").to_pylist(), rows.column("told").to_pylist(), ends[:-1], ends[1:])]
        return table(_REPLIES, out)

    return run


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
RESULT = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def removals(window: int, anchor_parts: int, parts: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, reply: pa.Table) -> pa.Table:
        known = next(([unpacked(x) for x in t] for t in reply.column("told").to_pylist() if t is not None), None)
        if known is not None and rows.num_rows:
            block = Block(rows, window, anchor_parts, True)
            block.deal(*known, parts)
            flags = answers(reply, "bits", block.part)
            n = block.windows[block.lead]
            first = (np.cumsum(n) - n)[block.entry]
            later = block.least[block.entry] < block.doc
            data, offsets = block.data, block.offsets
            first_of, last_of = [block.first[later]], [block.first[later] + block.windows[later] - 1]
            here = np.flatnonzero(~later)
            for k in range(0, len(here), 1 << 15):
                some = here[k : k + (1 << 15)]
                size = block.windows[some]
                gone = flags[expand(first[some], first[some] + size)]
                # runs of repeated windows inside each entry
                edge = np.zeros(len(gone) + 1, bool)
                edge[np.cumsum(size) - size] = True
                start = np.flatnonzero(gone & (edge[:-1] | ~np.append(False, gone[:-1])))
                end = np.flatnonzero(gone & (edge[1:] | ~np.append(gone[1:], False)))
                shift = np.repeat(block.first[some] - (np.cumsum(size) - size), size)
                first_of.append(start + shift[start])
                last_of.append(end + shift[end])
            data, offsets = block.data, block.offsets
            removed = merged(np.concatenate(first_of), np.concatenate(last_of) + window, offsets)
        else:
            data, offsets = common.utf8(rows.column("text"))
            removed = np.zeros((2, 0), np.int64)
        spans, kept = [], []
        of = np.searchsorted(removed[0], offsets)
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            own = removed[:, of[k] : of[k + 1]].T.tolist()
            spans.append([{"start": x - a, "end": y - a} for x, y in own])
            inner = [a, *[z for pair in own for z in pair], b]
            kept.append(b"".join(data[x:y].tobytes() for x, y in zip(inner[::2], inner[1::2])))
        return pa.table({"doc_id": rows.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "spans": pa.array(spans, pa.list_(SPAN)), "kept": pa.array(kept, pa.binary())})

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges) and kept (the remaining bytes) of every document."""
    if not 2 * GRAM < window <= 1 << 16:
        raise ValueError(f"window must lie between {2 * GRAM + 1} and 65536 bytes")
    common.sent_to_workers(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = common.text_bytes(docs)
    blocks, parts = 1 + total // block_bytes, 1 + total // part_bytes
    anchor_parts = 1 + total // ANCHOR_BYTES
    spread = F.xxhash64("doc_id", "text")  # rows of one doc_id need not meet
    dealt = docs.withColumn("block", F.pmod(spread, F.lit(blocks))).repartition(min(blocks, MOST_PARTITIONS), "block")

    def replies(entries: DataFrame, n: int, settle):
        return entries.repartition(min(n, MOST_PARTITIONS), "part").groupBy("part").applyInArrow(settle, REPLY).groupBy("block")

    def step(reply, run, schema: str) -> DataFrame:
        return dealt.groupBy("block").cogroup(reply).applyInArrow(run, schema)

    anchors = replies(dealt.groupBy("block").applyInArrow(anchor_entries(window, anchor_parts), ENTRIES), anchor_parts, shared_anchors(hot))
    extents = replies(step(anchors, extent_entries(window, anchor_parts, parts), ENTRIES), parts, settled(window))
    return step(extents, removals(window, anchor_parts, parts), RESULT)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), g AS (
  SELECT doc_id, length(h) // 2 AS n, k, substr(h, 512 * k + 1, 610) AS h FROM (SELECT doc_id, h, unnest(range((length(h) + 511) // 512)) AS k FROM d)
), w AS (
  SELECT doc_id, 256 * k + i AS b, substr(h, 2 * i + 1, 2) AS x, CASE WHEN 256 * k + i + 50 <= n THEN substr(h, 2 * i + 1, 100) END AS s
  FROM (SELECT *, unnest(range(least(256, n - 256 * k))) AS i FROM g)
), f AS (
  SELECT s, min(doc_id) AS least FROM w WHERE s IS NOT NULL GROUP BY s
), c AS (
  SELECT doc_id, b, x, coalesce(max(CASE WHEN least < doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY b ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM w LEFT JOIN f USING (s)
), e AS (
  SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS was FROM c
), r AS (
  SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (gone = 1 AND was = 0) AS n_spans, string_agg(x, '' ORDER BY b) FILTER (gone = 0) AS kept FROM e GROUP BY doc_id
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
