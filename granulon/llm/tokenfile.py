"""Token-id files with a fixed number of bits for each id.

A file holds the documents of one range of ids, in ascending order:

    header   magic 8 bytes, bits u32, ids in a block u32
    blocks   each the bits of its ids, lowest bit first; a block starts at a whole byte
    footer   block offsets u64[blocks + 1], starts u64[documents + 1], document ids i64[documents]
    trailer  blocks u64, documents u64, documents without an id u64 (they come first), footer offset u64, magic

All numbers are little-endian. The bits are the fewest that hold the vocabulary. Starts and block
offsets lead to any document's ids with one read of its blocks, and blocks are unpacked by numpy.
"""

from __future__ import annotations

import posixpath
import struct
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulon.llm import words
from granulon.llm.common import partitions, shared_folder, slices, text_of

MAGIC = b"GTOKBIN1"
HEADER = struct.Struct("<8sII")
TRAILER = struct.Struct("<QQQQ8s")
#: Ids in a block: a multiple of 8, so that any width gives whole bytes.
BLOCK = 1 << 14
#: Bytes of text that a file holds, about.
FILE_BYTES = 1 << 28
#: Blocks read together when a file is read through.
AT_ONCE = 32


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Lowest bit first, without gaps between ids."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (spread.astype("<u4") << np.arange(bits, dtype="<u4")).sum(axis=1, dtype="<u4")


class Writer:
    """Writes one file front to back; holds a block of ids and the table of documents."""

    def __init__(self, sink, bits: int, block: int = BLOCK):
        self.sink, self.bits, self.block = sink, bits, block
        self.docs, self.nameless = array("q"), 0  # eight bytes a document, not Python objects
        self.starts, self.offsets = array("q", [0]), array("q", [HEADER.size])
        self._held: list[np.ndarray] = []
        self._n = 0
        sink.write(HEADER.pack(MAGIC, bits, block))

    def _flush(self, everything: bool) -> None:
        ids = np.concatenate(self._held) if self._held else np.empty(0, np.uint32)
        end = len(ids) if everything else len(ids) // self.block * self.block
        for at in range(0, end, self.block):
            data = pack_bits(ids[at : min(at + self.block, end)], self.bits)
            self.sink.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self._held = [ids[end:]]
        self._n = len(ids) - end

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(0 if doc is None else doc)
        self.nameless += doc is None
        self.starts.append(self.starts[-1] + len(ids))
        self._held.append(ids)
        self._n += len(ids)
        if self._n >= 8 * self.block:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        at = self.offsets[-1]
        for numbers, kind in ((self.offsets, "<u8"), (self.starts, "<u8"), (self.docs, "<i8")):
            self.sink.write(np.array(numbers, kind).tobytes())
        self.sink.write(TRAILER.pack(len(self.offsets) - 1, len(self.docs), self.nameless, at, MAGIC))


class Reader:
    """Random access to a file's documents."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        magic, self.bits, self.block = HEADER.unpack(self._at(0, HEADER.size))
        n_blocks, n_docs, self.nameless, footer, end = TRAILER.unpack(self._at(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a token file, or cut short")
        data = self._at(footer, 8 * (n_blocks + 1 + 2 * n_docs + 1))
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, 8 * (n_blocks + 1)).astype(np.int64)
        self.docs = np.frombuffer(data, "<i8", n_docs, 8 * (n_blocks + 1 + n_docs + 1))

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        data = self.source.read(n)
        if len(data) != n:
            raise ValueError("a token file is cut short")
        return data

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids by their place in the file; only the blocks that hold them are read."""
        if stop <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        n = min((last + 1) * self.block, int(self.starts[-1])) - first * self.block
        data = self._at(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        return unpack_bits(data, n, self.bits)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def doc_id(self, k: int) -> int | None:
        return None if k < self.nameless else int(self.docs[k])


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """A shared folder given as a path or an address."""
    return fs.FileSystem.from_uri(folder) if urlsplit(folder).scheme else (fs.LocalFileSystem(), folder)


def write(df: DataFrame, path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> list[tuple[int, str, int, int]]:
    """Encode and write every text, in ascending order of id; returns (file, name, documents, ids) of each file.

    A task writes its file under a name of its own and renames it when it is whole, so a task that is
    lost or runs twice leaves one whole file. Null texts count as empty; null ids come first. Without
    `files` their number follows from the bytes of the texts (FILE_BYTES each, about), but for as many as there
    are shuffle partitions at least.
    """
    files = files or max(partitions(df.sparkSession), -(-(df.agg(F.sum(F.octet_length(text_of(text_col)) + 1)).first()[0] or 0) // FILE_BYTES))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    rows = rows.repartitionByRange(files, "id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = words.load(path)
        end = np.array([end_id], "<u4")
        task = TaskContext.get()
        name = f"tokens-{task.partitionId():06d}.bin"
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        own = posixpath.join(base, f".{name}.{task.taskAttemptId()}")
        with store.open_output_stream(own) as sink:
            writer = Writer(sink, width(max(encoder.size, end_id + 1)))
            for part in slices(batches):
                for doc, data in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    writer.add(doc, np.concatenate([np.frombuffer(data, "<u4"), end]))
            writer.close()
        store.move(own, posixpath.join(base, name))
        yield pa.RecordBatch.from_pydict({"file": [task.partitionId()], "name": [name], "n_docs": [len(writer.docs)], "n_ids": [writer.starts[-1]]})

    found = rows.mapInArrow(run, "file bigint, name string, n_docs bigint, n_ids bigint").collect()  # a row for each file
    return sorted(tuple(r) for r in found)


def read(spark, folder: str, listed: list[tuple[int, str, int, int]], id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files; start counts over all files."""
    rows, start = [], 0
    for _, name, _, n in listed:
        rows.append((name, start))
        start += n
    schema = f"{id_col} bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    names = [id_col, "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]
    if not rows:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        for batch in batches:
            for name, before in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(posixpath.join(base, name)) as source:
                    yield from _documents(Reader(source), before, names)

    return spark.createDataFrame(rows, "name string, start bigint").repartition(max(1, min(len(rows), partitions(spark)))).mapInArrow(run, schema)


def _documents(reader: Reader, before: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """All documents of a file, with no more than some blocks of ids in memory besides one batch of rows."""
    window, low, high = np.empty(0, "<u4"), 0, 0
    out: list[list] = [[] for _ in names]
    for k in range(len(reader.docs)):
        start, stop = int(reader.starts[k]), int(reader.starts[k + 1])
        crc, whole, at = 0, [], start
        while at < stop:
            if at >= high:
                low, high = at, min(at + AT_ONCE * reader.block, int(reader.starts[-1]))
                window = reader.ids(low, high)
            part = window[at - low : stop - low]
            crc = zlib.crc32(part.tobytes(), crc)
            if len(names) > 4:
                whole += part.tolist()
            at += len(part)
        for column, value in zip(out, (reader.doc_id(k), before + start, stop - start, crc, whole)):
            column.append(value)
        if len(out[0]) >= 4096:
            yield _batch(out, names)
            out = [[] for _ in names]
    if out[0]:
        yield _batch(out, names)


def _batch(columns: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def round_trip(df: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """What the files hold of each document after writing them in `folder`, or a new folder beneath the shared one.

    The files stay, since the result is read from them; a caller who wants to drop them gives the folder.

    Repeated rows are written each; an empty table gives an empty table; other columns are left out.
    """
    import uuid

    spark = df.sparkSession
    folder = folder or posixpath.join(shared_folder(spark), f"tokens-{uuid.uuid4().hex}")
    return read(spark, folder, write(df, path, folder, end_id, id_col, text_col), id_col)
