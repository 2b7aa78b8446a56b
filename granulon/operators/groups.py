"""Whole groups for numpy: rows are shuffled by keys, and a task hands on as many whole groups at once as a batch holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def changes(rows: pa.RecordBatch, by: Sequence[str]) -> np.ndarray:
    """Where the values of `by` differ from those of the row before; the first row is none."""
    found = np.zeros(len(rows), bool)
    for name in by:
        one, two = rows.column(name)[1:], rows.column(name)[:-1]
        differ = pc.coalesce(pc.not_equal(one, two), pc.xor(pc.is_null(one), pc.is_null(two)))
        found[1:] |= differ.to_numpy(zero_copy_only=False)
    return found


def by_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[str], found: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: T.StructType | str, most: int | None = None) -> DataFrame:
    """found(rows, group number of each) of whole groups, in order within each; rows are partitioned by the keys or some of them.

    With `most`, found gives rows of its own kind and takes them again before further ones: a group of more rows is held as what is found of them so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the group that isn't whole yet
        limit = most
        whole = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        numbered = lambda parts: found(parts, np.cumsum(changes(parts, keys)))
        for batch in batches:
            if not len(batch):
                continue
            joined = whole([held[-1].slice(len(held[-1]) - 1), batch]) if held else batch
            turns = np.flatnonzero(changes(joined, keys)) - (1 if held else 0)
            if len(turns):
                yield numbered(whole([r for r in [*held, batch.slice(0, turns[-1])] if len(r)]))
                held = [batch.slice(turns[-1])]
                limit = most
            else:
                held.append(batch)
            if limit and sum(map(len, held)) > limit:
                held = [numbered(whole(held))]
                limit = max(most, 2 * len(held[0]))
        if held:
            yield numbered(whole(held))

    return rows.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
