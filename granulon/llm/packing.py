"""Best-fit decreasing packing of documents into sequences of a fixed number of tokens.

Best-fit decreasing looks at nothing but lengths, and lengths are whole numbers up to the capacity.
So the plan is made from the histogram of the lengths: at most `capacity` counts, whatever the number
of documents. A segment tree over remaining capacities holds how many open sequences have each, and
finds the tightest one that fits in logarithmic time; all sequences of the same remaining capacity are
filled alike in one step. The plan has, for ranges of ranks among the documents of a length, the
sequences and offsets they get. Documents then find their rank in parallel: the ranks of a frequent
length are counted in many slices.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granulon.llm import words
from granulon.llm.common import cut, map_rows, text_of

#: Pieces of one length that a slice of ranks holds, about.
SLICE = 2_000


class CapacityTree:
    """Numbers of open sequences by remaining capacity, in the leaves of a segment tree."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def add(self, remaining: int, n: int) -> None:
        at = self.leaves + remaining
        while at:
            self.count[at] += n
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least length that some open sequence has."""
        at = self.leaves + length
        if self.count[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Moves (length, first rank, first sequence, documents in each, offset), ascending by length and rank.

    The documents of a length with ranks from `first rank` on fill the sequences from `first sequence`
    on, so many in each, one behind the other from the offset; up to the rank of the next move.
    """
    tree = CapacityTree(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> (first sequence, how many)
    moves: list[tuple[int, int, int, int, int]] = []
    new = 0

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_.setdefault(remaining, []).append((first, n))
            tree.add(remaining, n)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length}")
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, each = capacity, capacity // length
                first, n = new, -(-left // each)
                new += n
            else:
                each = remaining // length
                first, n = open_[remaining].pop()
                tree.add(remaining, -n)
            filled = min(n, left // each)
            moves.append((length, rank, first, each, capacity - remaining))
            put(remaining - each * length, first, filled)
            rank, left = rank + filled * each, left - filled * each
            if filled < n and left and left < each:  # the last one gets what is left
                put(remaining - left * length, first + filled, 1)
                rank, left, filled = rank + left, 0, filled + 1
            put(remaining, first + filled, n - filled)
    return sorted(moves)


def cut_documents(df: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): documents with their end id, cut if longer than capacity."""

    def make():
        encoder = words.load(path)

        def step(c):
            out = [[], [], [], [], [], []]
            for doc, ids in zip(c["id"], encoder.encode(c["text"])):
                ids += end_id.to_bytes(4, "little")
                for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[start : start + 4 * capacity]
                    own = np.frombuffer(piece, "<u4") if with_ids else None
                    for column, value in zip(out, (doc, k, start // 4, len(piece) // 4, zlib.crc32(piece), own)):
                        column.append(value)
            return out if with_ids else out[:5]

        return step

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return map_rows(rows, make, f"{id_col} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def place(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """The pieces with sequence_id and offset; lengths from 1 to capacity. Pieces must be stable when read again.

    Of equal rows each has a place of its own. No piece is dropped, and a sequence has no gaps.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    counts = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # no more rows than capacity
    moves = plan(counts, capacity)
    # A frequent length is ranked in slices: rank within the slice, and how many stand in the slices before.
    slices = [-(-counts.get(n, 0) // SLICE) or 1 for n in range(1, capacity + 1)]
    n_slices = F.element_at(F.from_json(F.lit(json.dumps(slices)), "array<int>"), F.col(length_col).cast("int"))  # one literal array
    dealt = pieces.select(*names, F.pmod(F.xxhash64(*names), n_slices).cast("int").alias("_slice"))
    before = Window.partitionBy(length_col).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(length_col, "_slice").agg(F.count("*").alias("_n")).select(length_col, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(length_col, "_slice").orderBy(*names)
    ranked = dealt.withColumn("_rank", F.row_number().over(own) - 1).join(sizes, [length_col, "_slice"])
    ranked = ranked.select(*names, (F.col("_rank") + F.col("_before")).cast("bigint").alias("_rank"))
    table = df_moves(moves)
    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")
    shared = pieces.sparkSession.sparkContext.broadcast(table)  # bounded by the capacity, not by the documents

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        keys, first, each, offset = shared.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            length = table[length_col].to_numpy().astype(np.int64)
            rank = table["_rank"].to_numpy().astype(np.int64)
            at = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
            into = rank - (keys[at] & ((1 << 44) - 1))
            got = table.drop_columns(["_rank"])
            got = got.append_column("sequence_id", pa.array(first[at] + into // each[at])).append_column("offset", pa.array(offset[at] + into % each[at] * length))
            yield from got.cast(to_arrow_schema(schema)).to_batches()

    return ranked.mapInArrow(run, schema)


def df_moves(moves: list[tuple[int, int, int, int, int]]) -> tuple[np.ndarray, ...]:
    """The moves as arrays: sorted keys of length and rank, first sequence, documents in each, offset."""
    a = np.array(moves or np.empty((0, 5)), np.int64).reshape(-1, 5)
    return a[:, 0] * (1 << 44) + a[:, 1], a[:, 2], np.maximum(a[:, 3], 1), a[:, 4]


def pack(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    A null or empty text is its end id alone; a text that is longer than a sequence is cut into whole
    sequences and a rest; repeated rows are packed each; a null id is kept; an empty table gives an
    empty table; other columns are left out, so their names can't clash.
    """
    return place(cut(cut_documents(df, path, capacity, end_id, id_col, text_col)), capacity)


def sequences(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """(sequence_id, n_tokens, doc_ids, ids): the packed sequences of placed pieces that carry their ids.

    A group is one sequence, so it holds at most `capacity` ids.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p")).select("sequence_id", "n_tokens", F.col("p.doc_id").alias("doc_ids"), F.flatten("p.ids").alias("ids"))
