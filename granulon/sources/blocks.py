"""Large text files read in parallel where a record's meaning depends on all that stands before it.

Spark cuts a file into blocks at a separator. Whether a block begins within quotes, how deep in brackets or at
which line, follows from the blocks before it. So files are read twice. The first pass sums every block up for
each state it might begin in, as one short row; from these the state at the begin of every block is folded in
order. The second pass starts each block in its state. A record that spans blocks comes in pieces, which are put
together by the block in which it begins.

The folding holds a row for each block (128 MB of a file by default) and a file's state; nothing else
passes through the driver.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

PIECES = "file string, block bigint, kind string, section string, at bigint, row bigint, text string"
WHOLE, BEGIN, MIDDLE, END = "whole", "begin", "middle", "end"


def parts(spark: SparkSession, paths: str | Sequence[str], separator: str, below: bool = False) -> DataFrame:
    """(file, block, file_size, value): what stands between separators, in order within each block of a file; below: of all files in folders of any depth."""
    read = spark.read.option("lineSep", separator).option("recursiveFileLookup", below).text(paths)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"), "value")


def by_block(rows: DataFrame, make: Callable[[str, int, int], object], schema: str) -> DataFrame:
    """For each block make(file, block, file size): its feed(values) gets the block's parts in order, its end() follows; both give rows."""
    out = to_arrow_schema(_parse_datatype_string(schema))

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, scan = None, None
        for batch in batches:
            files, starts, sizes, values = (c.to_pylist() for c in batch.columns)
            changes = [i for i in range(len(files)) if i == 0 or starts[i] != starts[i - 1] or files[i] != files[i - 1]]
            for i, stop in zip(changes, [*changes[1:], len(files)]):
                found: list[tuple] = []
                if now != (files[i], starts[i]):
                    if scan is not None:
                        found += scan.end()
                    now, scan = (files[i], starts[i]), make(files[i], starts[i], sizes[i])
                found += scan.feed(values[i:stop])
                if found:
                    yield batch_of(found)
        if scan is not None and (found := scan.end()):
            yield batch_of(found)

    return rows.mapInArrow(run, schema)


def _folded(summaries: DataFrame, begin: Callable[[tuple | None], tuple], step: Callable[[tuple, tuple], tuple]) -> tuple[dict, dict]:
    """State at the begin of each (file, block), and the state behind each file, from one row a block; begin gets the state behind the file before."""
    states, last, state = {}, {}, None
    for row in sorted((tuple(r) for r in summaries.collect()), key=lambda r: (r[0], r[1])):  # a row a block
        state = state if row[0] in last else begin(state)
        states[row[0], row[1]] = state
        state = last[row[0]] = step(state, row)
    return states, last


def _joined(pieces: DataFrame) -> DataFrame:
    """Records that span blocks, with the file, section, place and row at which they begin."""
    order = Window.partitionBy("file").orderBy("block", (F.col("kind") == BEGIN).cast("int"))
    numbered = pieces.withColumn("_g", F.sum((F.col("kind") == BEGIN).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", (F.col("kind") == BEGIN).alias("last"), "text"))), lambda p: p["text"]), "")
    return numbered.groupBy("file", "_g").agg(F.min_by("section", "block").alias("section"), F.min_by("at", "block").alias("at"), F.min_by("row", "block").alias("row"), text.alias("text")).drop("_g")


# JSON


def _structure(text: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """The steps in depth at each byte (1, -1 or 0), the number of quotes up to and with each byte, and the text with blank escapes."""
    plain = re.sub(rb"\\.", b"  ", text, flags=re.DOTALL) if b"\\" in text else text
    b = np.frombuffer(plain, np.uint8)
    step = ((b == 0x7B) | (b == 0x5B)).astype(np.int8) - ((b == 0x7D) | (b == 0x5D)).astype(np.int8)
    return step, np.cumsum(b == 0x22, dtype=np.int64), plain


def _key(text: bytes, plain: bytes, colon: int) -> str | list[str] | None:
    """The string before a colon; of one that begins before the text, its end in a list; None if there is none."""
    close = plain.rfind(b'"', 0, colon)
    start = plain.rfind(b'"', 0, close) if close > 0 else -1
    if close < 0 or start < 0:
        return None if close < 0 else [text[:close].decode(errors="replace")]
    try:
        return json.loads(text[start : close + 1], strict=False)
    except ValueError:
        return None  # no string: only if the block doesn't begin as supposed


def _whole_key(key: str | list[str] | None, before: str) -> str | None:
    return json.loads(f'"{before}{key[0]}"', strict=False) if isinstance(key, list) else key


def _last_keys(text: bytes, plain: bytes, depth: np.ndarray, outside: np.ndarray) -> dict[int, str | list[str]]:
    """The last key at each depth."""
    colons = np.flatnonzero((np.frombuffer(plain, np.uint8) == 0x3A) & outside)
    _, back = np.unique(depth[colons][::-1], return_index=True)
    found = {int(depth[at]): _key(text, plain, int(at)) for at in colons[len(colons) - 1 - back]}
    return {d: k for d, k in found.items() if k is not None}


class _Depths:
    """What a block does if it begins outside (0) or inside (1) of a string: change in depth, last key at each depth, quotes."""

    def __init__(self, inside: int):
        self.inside, self.held, self.quotes, self.deep, self.keys, self.tail = inside, b"", 0, 0, {}, b""

    def feed(self, text: bytes, over: bool = False) -> None:
        text = self.held + text
        step, quotes, plain = _structure(text)
        outside = (quotes + self.quotes + self.inside) % 2 == 0
        cut = len(text)
        if not over:
            # A string stays for the next turn from its first quote on: its colon may follow.
            places = np.flatnonzero(np.frombuffer(plain, np.uint8) == 0x22)
            opening = places[outside[places] == False]  # noqa: E712
            cut = int(opening[-1]) if len(opening) else 0 if (self.quotes + self.inside) % 2 else cut
        depth = self.deep + np.cumsum(np.where(outside, step, 0), dtype=np.int64)
        self.keys.update(_last_keys(text[:cut], plain[:cut], depth[:cut], outside[:cut]))
        if cut:
            self.deep = int(depth[cut - 1])
            self.quotes += int(quotes[cut - 1])
            last = plain.rfind(b'"', 0, cut)
            self.tail = text[last + 1 : cut] if last >= 0 else self.tail + text[:cut]
        self.held = text[cut:]


class _JsonSummary:
    """Of a block: bytes, quotes, what follows the last quote, and what it does for each of both begins."""

    SCHEMA = "file string, block bigint, size bigint, file_size bigint, quotes bigint, tail string, deep0 bigint, deep1 bigint, keys0 string, keys1 string"

    def __init__(self, file: str, block: int, size: int):
        self.file, self.block, self.file_size, self.size = file, block, size, 0
        self.begins = _Depths(0), _Depths(1)

    def feed(self, values: list[str]) -> list[tuple]:
        text = "".join(v + "}" for v in values).encode()
        self.size += len(text)
        for one in self.begins:
            one.feed(text)
        return []

    def end(self) -> list[tuple]:
        for one in self.begins:
            one.feed(b"", over=True)
        a, b = self.begins
        # What follows the last quote matters where the block ends in a string, and then only.
        return [(self.file, self.block, self.size, self.file_size, a.quotes, a.tail.decode(), a.deep, b.deep, json.dumps(a.keys), json.dumps(b.keys))]


class _Elements:
    """Pieces of a block's elements: the objects in the arrays that are members of the whole document."""

    def __init__(self, file: str, block: int, state: tuple):
        self.file, self.block = file, block
        self.inside, self.depth, self.section, self.at, self.before = state
        self.held = b""
        self.open = self.depth > 2  # begun in an earlier block

    def _piece(self, kind: str, text: bytes, at: int) -> tuple:
        return self.file, self.block, kind, self.section, at, None, text.decode()

    def feed(self, values: list[str]) -> list[tuple]:
        text = self.held + "".join(v + "}" for v in values).encode()
        found, used = [], 0
        step, quotes, plain = _structure(text)
        outside = (quotes + self.inside) % 2 == 0
        step = np.where(outside, step, 0)
        depth = self.depth + np.cumsum(step, dtype=np.int64)
        starts = np.flatnonzero((step == 1) & (depth == 3)).tolist()
        ends = np.flatnonzero((step == -1) & (depth == 2)).tolist()
        if self.open and ends:
            found.append(self._piece(END, text[: ends[0] + 1], self.at))
            used, self.open = ends.pop(0) + 1, False
        if not self.open:
            colons = np.flatnonzero((np.frombuffer(plain, np.uint8) == 0x3A) & outside & (depth == 1)).tolist()
            k = 0
            for start, end in zip(starts, ends):
                while k < len(colons) and colons[k] < start:
                    self.section = _whole_key(_key(text, plain, colons[k]), self.before)
                    k += 1
                if text[start : start + 1] == b"{":
                    found.append(self._piece(WHOLE, text[start : end + 1], self.at + start))
                used = end + 1
        if used:
            # Behind an element: outside of strings, two deep.
            self.inside, self.depth = 0, 2
        self.at += used
        self.held = text[used:]
        return found

    def end(self) -> list[tuple]:
        if self.open:
            return [self._piece(MIDDLE, self.held, self.at)] if self.held else []
        step, quotes, plain = _structure(self.held)
        outside = (quotes + self.inside) % 2 == 0
        depth = self.depth + np.cumsum(np.where(outside, step, 0), dtype=np.int64)
        if not len(depth) or depth[-1] < 3:
            return []
        key = _last_keys(self.held, plain, depth, outside).get(1)
        self.section = self.section if key is None else _whole_key(key, self.before)
        start = int(np.flatnonzero((np.where(outside, step, 0) == 1) & (depth == 3))[-1])
        return [self._piece(BEGIN, self.held[start:], self.at + start)]


def json_elements(spark: SparkSession, paths: str | Sequence[str], parts_of_one: bool = False) -> DataFrame:
    """(file, section, at, text) of each object in an array that is a member of a file's one object.

    A file of any size is read by as many tasks as it has blocks. section is the member's name, at the byte
    where the object begins. Other members have no rows, nor has an empty file. A document that isn't closed
    is an error. Objects are cut out by brackets and quotes alone: what is wrong within one shows when it is parsed.
    parts_of_one: all files in the folder are one document, one after the other by their names; no object is in two of them.
    """
    rows = parts(spark, paths, "}", parts_of_one)
    summaries = by_block(rows, _JsonSummary, _JsonSummary.SCHEMA)

    def step(state: tuple, row: tuple) -> tuple:
        inside, depth, section, at, before, _ = state
        _, _, size, file_size, quotes, tail, deep0, deep1, keys0, keys1 = row
        key = json.loads(keys1 if inside else keys0).get(str(1 - depth))
        section = section if key is None else _whole_key(key, before)
        inside_then = (inside + quotes) % 2
        before = (tail if quotes else before + tail) if inside_then else ""
        # The last part of a file had no separator behind it where one byte more than the file's was counted.
        added = parts_of_one and at + size == file_size + 1
        return inside_then, depth + (deep1 if inside else deep0) + added, section, at + size, before, file_size

    def begin(behind: tuple | None) -> tuple:
        return (*behind[:3], 0, *behind[4:]) if parts_of_one and behind else (0, 0, None, 0, "", 0)

    states, last = _folded(summaries, begin, step)
    if parts_of_one:
        file, (inside, depth, *_) = max(last.items(), default=("", (0, 0)))
        if inside or depth:
            raise ValueError(f"{file}: the document isn't closed")
    for file, (inside, depth, _, at, _, file_size) in () if parts_of_one else last.items():
        if inside or depth != -(at == file_size + 1):
            raise ValueError(f"{file}: the document isn't closed")
    shared = spark.sparkContext.broadcast({k: v[:5] for k, v in states.items()})
    found = by_block(rows, lambda file, block, _: _Elements(file, block, shared.value[file, block]), PIECES)
    whole = found.where(F.col("kind") == WHOLE).select("file", "section", "at", "text")
    if not any(state[1] > 2 for state in states.values()):
        return whole
    spanning = _joined(found.where(F.col("kind") != WHOLE)).where(F.col("text").startswith("{"))
    return whole.unionByName(spanning.select("file", "section", "at", "text"))


# Lines and CSV

_CLOSE = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')


def ends_open(line: str, inside: bool = False) -> bool:
    """Whether a line of CSV that begins outside or inside of a quoted cell ends within one."""
    at = 0
    if inside:
        found = _CLOSE.match(line)
        if not found:
            return True
        at = line.find(",", found.end()) + 1
        if not at:
            return False
    while True:
        end = at
        if line.startswith('"', at):
            found = _CLOSE.match(line, at + 1)
            if not found:
                return True
            end = found.end()
        at = line.find(",", end) + 1
        if not at:
            return False


class _LineSummary:
    """Of a block: lines, and for a begin outside and inside of quotes: whether it ends inside, and the records that begin; the file's first lines."""

    SCHEMA = "file string, block bigint, lines bigint, open0 boolean, open1 boolean, rows0 bigint, rows1 bigint, head string"

    def __init__(self, file: str, block: int, quoted: bool):
        self.file, self.block, self.quoted = file, block, quoted
        self.lines, self.open, self.rows = 0, [False, True], [0, 0]
        self.head: list[str] | None = [] if block == 0 and quoted else None
        self.header = None

    def feed(self, values: list[str]) -> list[tuple]:
        self.lines += len(values)
        if not self.quoted:
            return []
        for line in values:
            if self.head is not None:
                self.head.append(line)
            for h in (0, 1):
                if not self.open[h] and line.rstrip("\r"):
                    self.rows[h] += 1
                if '"' in line:
                    self.open[h] = ends_open(line, self.open[h])
            if self.head is not None and not self.open[0]:
                if self.rows[0]:  # the first record is whole
                    self.header, self.head = "\n".join(self.head), None
        return []

    def end(self) -> list[tuple]:
        return [(self.file, self.block, self.lines, *self.open, *self.rows, self.header)]


def _cells(text: str) -> list[str]:
    """The cells of one record."""
    return next((r for r in csv.reader(io.StringIO(text, newline="")) if r), [])


class _Records:
    """Pieces of a block's records of CSV; at is the line where one begins, row its number, the header's being 1."""

    def __init__(self, file: str, block: int, state: tuple):
        self.file, self.block = file, block
        self.open, self.line, self.row = state[:3]
        self.before = self.open  # in a record that began in an earlier block
        self.held: list[str] = []

    def feed(self, values: list[str]) -> list[tuple]:
        found = []
        for line in values:
            self.line += 1
            if not self.held and not self.open:
                if not line.rstrip("\r"):
                    continue
                self.row += 1
                self.at = self.line
            if '"' in line:
                self.open = ends_open(line, self.open)
            if self.open or self.held:
                self.held.append(line)
            if not self.open:
                text = "\n".join(self.held) if self.held else line
                found.append((self.file, self.block, END if self.before else WHOLE, None, None if self.before else self.at, None if self.before else self.row, text))
                self.held, self.before = [], False
        return found

    def end(self) -> list[tuple]:
        if not self.held:
            return []
        text = "\n".join(self.held) + "\n"  # a line follows
        return [(self.file, self.block, MIDDLE, None, None, None, text) if self.before else (self.file, self.block, BEGIN, None, self.at, self.row, text)]


def _line_states(rows: DataFrame, quoted: bool) -> tuple[dict, bool]:
    """(in quotes, lines before, records before, file's header) at each block's begin, and whether a record is open at a block's end."""
    summaries = by_block(rows, lambda file, block, _: _LineSummary(file, block, quoted), _LineSummary.SCHEMA)

    def step(state: tuple, row: tuple) -> tuple:
        inside, line, n, head = state
        return row[4] if inside else row[3], line + row[2], n + (row[6] if inside else row[5]), head if head is not None else row[7]

    states, last = _folded(summaries, lambda _: (False, 0, 0, None), step)
    return {(file, block): (*state[:3], last[file][3]) for (file, block), state in states.items()}, any(s[0] for s in (*states.values(), *last.values()))


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, line, value) of a text file's lines, numbered from 1 through all of its blocks."""
    rows = parts(spark, paths, "\n")
    shared = spark.sparkContext.broadcast(_line_states(rows, False)[0])

    class Numbered:
        def __init__(self, file: str, block: int, _: int):
            self.file, self.line = file, shared.value[file, block][1]

        def feed(self, values: list[str]) -> list[tuple]:
            first = self.line + 1
            self.line += len(values)
            return [(self.file, first + i, v.removesuffix("\r")) for i, v in enumerate(values)]

        def end(self) -> list[tuple]:
            return []

    return by_block(rows, Numbered, "file string, line bigint, value string")


def numbered_csv(spark: SparkSession, paths: str | Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
    """A column of text for each field, and _file, _line, _row, _reason, _surplus of each record of CSV files with headers.

    Cells are found by the names of their file's header; those without a name are null. _line is the line where the record
    begins, _row its number with the header as 1 and blank lines left out. _reason is null, `too many cells` (these are in
    _surplus, an array) or `too few cells` (those are null). Quoted cells may hold line ends; a quote within a cell that
    doesn't begin with one is text; a byte order mark is stripped. Without `fields`: all names of all headers, sorted.
    """
    rows = parts(spark, paths, "\n")
    states, spanning = _line_states(rows, True)
    headers = {file: [c.removeprefix("\ufeff") if i == 0 else c for i, c in enumerate(_cells((state[3] or "").removeprefix("\ufeff")))] for (file, _), state in states.items()}
    fields = list(fields) if fields is not None else sorted({c for h in headers.values() for c in h})
    shared = spark.sparkContext.broadcast((states, headers))
    schema = "struct<" + ",".join(f"`{f}`:string" for f in fields) + ("," if fields else "") + "_reason:string,_surplus:array<string>>"

    def cells_of(file: str, text: str) -> dict:
        names, cells = shared.value[1][file], _cells(text)
        own, extra = dict(zip(names, cells)), cells[len(names) :]
        reason = "too many cells" if extra else "too few cells" if len(cells) < len(names) else None
        return {f: own.get(f) for f in fields} | {"_reason": reason, "_surplus": extra or None}

    class Parsed(_Records):
        """Whole records as cells at once, so that a task needs no second Python worker; the others as pieces."""

        def __init__(self, file: str, block: int, _: int):
            csv.field_size_limit(2**31 - 1)
            super().__init__(file, block, shared.value[0][file, block])

        def feed(self, values: list[str]) -> list[tuple]:
            return [(*p[:6], None, cells_of(p[0], p[6])) if p[2] == WHOLE else (*p, None) for p in super().feed(values)]

        def end(self) -> list[tuple]:
            return [(*p, None) for p in super().end()]

    found = by_block(rows, Parsed, f"{PIECES}, r {schema}")
    names = [F.col("file").alias("_file"), F.col("at").alias("_line"), F.col("row").alias("_row")]
    records = found.where((F.col("kind") == WHOLE) & (F.col("row") > 1)).select("r.*", *names)
    if not spanning:
        return records
    out = to_arrow_schema(_parse_datatype_string(f"file string, at bigint, row bigint, r {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            file, at, row, text = (c.to_pylist() for c in batch.columns)
            columns = file, at, row, [cells_of(*one) for one in zip(file, text)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, out)], schema=out)

    cut = _joined(found.where(F.col("kind") != WHOLE)).where("row > 1").select("file", "at", "row", "text")
    return records.unionByName(cut.mapInArrow(run, f"file string, at bigint, row bigint, r {schema}").select("r.*", *names))
