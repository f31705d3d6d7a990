"""CSV files with line breaks inside quotes, read in byte ranges by many tasks.

Whether a line break ends a record depends on all quotes before it. So a first pass runs over every range for each state that
it could begin in, and gives the state that it ends in and the records that it ends: a map of five states, which depends on the
range alone. Maps of ranges one after another are put together on the driver (a few numbers for each range), which
gives the state and the number of the first record of each range. The second pass then reads the records that begin in a
range, each numbered as one reader of the whole file would.

States: N at the start of a line, S after a comma, U in a cell without quotes, Q in a quoted one, E after a quote
in it (which ends it, or is the first of two). A quote opens a quoted cell only where a cell begins; elsewhere it stands for itself.

Line breaks are LF, CRLF or CR, inside cells always given as LF; blank lines are left out; a byte order mark is skipped.
Bytes that are no UTF-8 become replacement signs.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigon import workers

RANGE = 32 << 20
CHUNK = 1 << 16
ROWS = 4096
STATES = "NSUQE"
_OPEN = re.compile(rb'(?<=[,\n\r])"')
_BREAKS = re.compile(rb"[\n\r]+")
_MARK = b"\xef\xbb\xbf"


def step(state: str, byte: int) -> tuple[str, int]:
    """State after a byte, and 1 if it ends a record."""
    if state == "Q":
        return ("E" if byte == 34 else "Q"), 0
    if byte in (10, 13):
        return "N", int(state != "N")
    if byte == 44:
        return "S", 0
    if byte == 34 and state != "U":
        return "Q", 0
    return "U", 0


def run(data: bytes, state: str, at: int = 0) -> tuple[str, int]:
    """State after data[at:], and the records that it ends. at > 0, or the state is taken over from before."""
    ended = 0
    n = len(data)
    while at < n:
        if state == "Q":
            at = data.find(b'"', at)
            if at < 0:
                return "Q", ended
            state, at = "E", at + 1
            continue
        if state == "E" or at == 0 or data[at] == 34:
            state, more = step(state, data[at])
            ended, at = ended + more, at + 1
            continue
        # no quote is next: on to the next one that opens a cell
        found = _OPEN.search(data, at)
        end = found.start() if found else n
        runs = len(_BREAKS.findall(data, at, end))
        ended += runs - (runs > 0 and state == "N" and data[at] in (10, 13))
        last = data[end - 1]
        state, at = "N" if last in (10, 13) else "S" if last == 44 else "U", end
    return state, ended


def outcomes(data: bytes) -> dict[str, tuple[str, int]]:
    """For each state at the start of the data: the state at its end and the records that end in it."""
    known: dict[str, tuple[str, int]] = {}
    found = {}
    for state in STATES:
        if not data:
            found[state] = (state, 0)
            continue
        after, first = step(state, data[0])
        if after not in known:
            known[after] = run(data, after, 1)
        found[state] = known[after][0], known[after][1] + first
    return found


def next_record(data: bytes, state: str) -> tuple[int, str] | None:
    """Place after the first run of line breaks that ends a record, counted from the data's start; None if none does."""
    at, n = 0, len(data)
    while at < n:
        if state == "Q":
            at = data.find(b'"', at)
            if at < 0:
                return None
            state, at = "E", at + 1
            continue
        if state == "E" or at == 0 or data[at] == 34:
            state, ends = step(state, data[at])
            at += 1
            if ends:
                return at, state
            continue
        opened = _OPEN.search(data, at)
        end = opened.start() if opened else n
        broken = _BREAKS.search(data, at, end)
        if broken and (state != "N" or broken.start() > at):
            return broken.start() + 1, "N"
        if broken and (again := _BREAKS.search(data, broken.end(), end)):
            return again.start() + 1, "N"
        last = data[end - 1]
        state, at = "N" if last in (10, 13) else "S" if last == 44 else "U", end
    return None


@dataclass(frozen=True)
class Range:
    """Bytes [start, end) of a file, the state at either end and the records of the file that end before it."""

    file: str
    start: int
    end: int
    first: str
    last: str
    before: int


def readable(path: str) -> bool:
    """Whether the file system is one that Python workers reach by themselves."""
    try:
        pafs.FileSystem.from_uri(path)
    except (pa.ArrowException, ValueError, OSError):
        return False
    return True


def _bytes(path: str, start: int, end: int) -> bytes:
    system, below = pafs.FileSystem.from_uri(path)
    with system.open_input_file(below) as file:
        file.seek(start)
        return file.read(end - start)


def header(path: str) -> tuple[list[str], int, int]:
    """Names of the first record, the place where the file's content begins, and the file's size."""
    system, below = pafs.FileSystem.from_uri(path)
    size = system.get_file_info(below).size
    with system.open_input_file(below) as file:
        data = file.read(CHUNK)
        begin = len(_MARK) if data.startswith(_MARK) else 0
        while (found := next_record(data[begin:], "N")) is None and len(data) < size:
            data += file.read(CHUNK)
    text = data[begin : begin + found[0]] if found else data[begin:]
    return next((r for r in _rows(text) if r), []), begin, size


def _rows(data: bytes) -> Iterator[list[str]]:
    """Records of whole lines, without blank ones."""
    csv.field_size_limit(sys.maxsize)
    text = data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
    return (row for row in csv.reader(line + "\n" for line in text.removesuffix("\n").split("\n")) if row)


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> list[Range]:
    """The ranges of a file with what the first pass finds, one task a range."""
    workers.send(spark)
    _, begin, length = header(path)
    cuts = [*range(begin, length, size), length]
    pairs = list(zip(cuts, cuts[1:]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, start, end in zip(*[c.to_pylist() for c in batch.columns]):
                found = outcomes(_bytes(path, start, end))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(STATES), pa.int64()), pa.array(list(STATES)), pa.array([found[s][0] for s in STATES]), pa.array([found[s][1] for s in STATES], pa.int64())], names=["k", "state", "after", "ended"])

    if not pairs:
        return []
    table = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k bigint, start bigint, end bigint").repartitionByRange(len(pairs), "k")
    maps = {(r["k"], r["state"]): (r["after"], r["ended"]) for r in table.mapInArrow(scan, "k bigint, state string, after string, ended bigint").collect()}
    found, state, before = [], "N", 0
    for k, (start, end) in enumerate(pairs):
        after, ended = maps[k, state]
        found.append(Range(path, start, end, state, after, before))
        state, before = after, before + ended
    return found


def _text(r: Range, leads: bool, whole: int) -> tuple[bytes, int]:
    """Bytes of the records that begin after a line break in a range (leads: also at its start), and the number of the first."""
    data = _bytes(r.file, r.start, r.end)
    begin, number = 0, r.before
    if not leads:
        found = next_record(data, r.first)
        if found is None:
            return b"", number
        begin, number = found[0], number + 1
    tail, state, at = b"", r.last, r.end
    size = CHUNK
    while (found := next_record(tail, state)) is None and at < whole:
        tail += _bytes(r.file, at, min(whole, at + size))
        at, size = r.end + len(tail), 2 * size
    return data[begin:] + (tail[: found[0]] if found else tail), number


def read(spark: SparkSession, path: str, columns: dict[str, int], size: int = RANGE) -> DataFrame:
    """(number, column, ...): the cells at the given places of each record but the first, null where a record is shorter; one task a range.

    number: 0 for the first record after the header, and so on through the file.
    """
    found = ranges(spark, path, size)
    names, places = list(columns), list(columns.values())
    schema = ", ".join(["number bigint", *[f"`{n}` string" for n in names]])
    if not found:
        return spark.createDataFrame([], schema)
    whole = found[-1].end

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data, number = _text(Range(path, r["start"], r["end"], r["first"], r["last"], r["before"]), r["k"] == 0, whole)
                held: list[list[str | None]] = []

                def out(first: int) -> pa.RecordBatch:
                    cells = [pa.array([row[p] if p < len(row) else None for row in held], pa.string()) for p in places]
                    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(held)), pa.int64()), *cells], names=["number", *names])

                for row in _rows(data) if data else ():
                    held.append(row)
                    if len(held) == ROWS:
                        yield out(number)
                        number, held = number + ROWS, []
                if held:
                    yield out(number)

    table = spark.createDataFrame([(k, r.start, r.end, r.first, r.last, r.before) for k, r in enumerate(found)], "k bigint, start bigint, end bigint, first string, last string, before bigint")
    rows = table.repartitionByRange(len(found), "k").mapInArrow(parse, schema)
    return rows.filter(F.col("number") > 0).withColumn("number", F.col("number") - 1)
