"""Rendezvous hashing of records over weighted shards.

Every shard draws a number for each record from a hash of the record's key and its own number; the
record goes to the highest draw. A draw is -weight / ln(u) with u uniform in (0, 1), so shards get
records by their weights, and the draws of a shard depend on nothing but its number and weight: a new
or heavier shard only takes records, a lighter or dropped one only gives them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from granulon.llm.common import cut, partitions, text_of


def draw(key: Column, shard: int, weight: float) -> Column:
    """The number that a shard draws for a key: the 53 highest bits of a 64-bit hash as a share of one."""
    if not weight > 0:
        raise ValueError(f"shard {shard} has no weight")
    share = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(2**53)
    return -F.lit(float(weight)) / F.ln(share)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard with the highest draw, from 0; of equal draws the highest number's."""
    drawn = [F.struct(draw(key, k, w).alias("d"), F.lit(k).alias("k")) for k, w in enumerate(weights)]
    return (F.greatest(*drawn) if len(drawn) > 1 else drawn[0])["k"]


def record_key(id_col: str, text_col: str) -> Column:
    """A record's id; without one, a hash of its text, so that records without ids are dealt out too."""
    return F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("text:"), F.xxhash64(text_of(f"`{text_col}`")).cast("string")))


def numbered(rows: DataFrame, group_col: str, out: str = "slot") -> DataFrame:
    """rows with their number in their group, gapless from 0, in no particular order; groups aren't null.

    Each task numbers its own rows of a group and stores them; the numbers of rows in the tasks before come from
    a table of counts for tasks and groups. So no group is ever in one place, equal rows included.
    """
    names = rows.columns
    kind = rows.schema[group_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            groups = batch.column(names.index(group_col)).dictionary_encode()
            codes, values = groups.indices.to_numpy(zero_copy_only=False), groups.dictionary.to_pylist()
            own = np.empty(len(codes), np.int64)
            for code, value in enumerate(values):
                at = np.flatnonzero(codes == code)
                own[at] = np.arange(len(at)) + seen.get(value, 0)
                seen[value] = seen.get(value, 0) + len(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), task, np.int32)), pa.array(own)], names=[*names, "_task", "_own"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_task", T.IntegerType()), T.StructField("_own", T.LongType())])
    stored = cut(rows.mapInArrow(run, schema))
    before = Window.partitionBy(group_col).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored.groupBy(group_col, "_task").agg((F.max("_own") + 1).alias("_n"))
    starts = counts.select(F.col(group_col).cast(kind).alias(group_col), "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return stored.join(starts, [group_col, "_task"]).select(*names, (F.col("_own") + F.col("_before")).alias(out))


def shards(df: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): where each record goes, and where with the weights `grown`.

    size is the text's bytes in UTF-8 and 8 more for its id. Null texts count as empty; records without id are dealt
    by their text; repeated rows go to one shard and have slots of their own; an empty table gives an empty table;
    other columns are left out. No text is shuffled.
    """
    text, key = text_of(f"`{text_col}`"), record_key(id_col, text_col)
    placed = df.select(
        F.col(f"`{id_col}`").alias("_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        shard_of(key, weights).alias("shard"), (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return numbered(placed, "shard").select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write(df: DataFrame, folder: str, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", rows_in_file: int = 1_000_000) -> None:
    """The records in folders _shard=0, 1 and so on, with all their columns; a shard has a few files, none of more than `rows_in_file`.

    Records of a shard go to several writers by a hash of all their columns, so that a task has files of few shards.
    """
    if "_shard" in (c.lower() for c in df.columns):
        raise ValueError("a column is named _shard already")
    writers = -(-partitions(df.sparkSession) // len(weights))
    own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), writers)
    placed = df.withColumn("_shard", shard_of(record_key(id_col, text_col), weights)).repartition(len(weights) * writers, "_shard", own)
    placed.write.option("maxRecordsPerFile", rows_in_file).partitionBy("_shard").parquet(folder)


def moves(df: DataFrame, weights: Sequence[float], grown: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, grown_shard, n, bytes): how many records, and bytes of text, go from shard to shard when the weights change."""
    key = record_key(id_col, text_col)
    both = df.select(shard_of(key, weights).alias("shard"), shard_of(key, grown).alias("grown_shard"), F.octet_length(text_of(f"`{text_col}`")).cast("bigint").alias("b"))
    return both.where("shard <> grown_shard").groupBy("shard", "grown_shard").agg(F.count("*").alias("n"), F.sum("b").alias("bytes"))
