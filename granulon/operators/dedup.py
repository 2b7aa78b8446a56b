"""Deduplication and incremental change by keys and content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granulon.session import cut


def content_hash(content: Column, height: Column | None = None, width: Column | None = None) -> Column:
    """MD5 of the content and, for rasters, of its shape: the same bytes in another shape are another image."""
    if height is None or width is None:
        return F.md5(content)
    return F.md5(F.concat(F.encode(F.concat_ws("x", height.cast("string"), width.cast("string"), F.lit("")), "UTF-8"), content))


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row of each key, the first in order; only that row is held for a key, before the shuffle and behind it."""
    whole = F.struct(*df.columns)
    place = F.struct(*order)
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min_by(whole, place).alias("_row")).select("_row.*")


def append_new(existing: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The rows of a batch to append: keys that don't exist yet, the first row of each."""
    return first_wins(batch.join(existing.select(*key).distinct(), list(key), "left_anti").select(*batch.columns), key, order)


def upsert_plan(existing: DataFrame, incoming: DataFrame, key: str, name: str) -> DataFrame:
    """(key, action, name, old_name) for incoming content: replace under the existing name, insert, or keep what only exists.

    Both sides are reduced to the first name of a content; null contents (unreadable) take no part.
    """
    one = lambda df, to: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(name).alias(to))
    both = one(existing, "old_name").join(one(incoming, "new_name"), key, "full_outer")
    action = F.when(F.col("new_name").isNull(), "keep").when(F.col("old_name").isNull(), "insert").otherwise("replace")
    return both.select(key, action.alias("action"), F.coalesce("old_name", "new_name").alias("name"), "old_name")


def union_first(frames: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """Several sources in order as one: of a key the first source's first row, with new ids from 1."""
    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    every = tagged[0]
    for f in tagged[1:]:
        every = every.unionByName(f)
    return first_wins(every, [key], ["_source", order]).drop("_source")


def renumbered(df: DataFrame, order: Sequence[str], to: str = "new_id", within: Sequence[str] = ()) -> DataFrame:
    """df with ids 1, 2, ... in order, within groups if given (else over all rows, in parallel by ranges of the first column)."""
    if within:
        return df.withColumn(to, F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("bigint"))
    # Row counts of sorted partitions give each partition its first number; no single task sees all rows.
    # They are cut off first: ranges drawn anew would number the rows otherwise.
    ranged = cut(df.repartitionByRange(*[F.col(o) for o in order]).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return ranged.join(before, "_p").withColumn(to, (F.col("_b") + F.col("_i") + 1).cast("bigint")).drop("_m", "_p", "_i", "_b")


def numbered_within(df: DataFrame, group: str, order: Sequence[str], to: str) -> DataFrame:
    """df with numbers 0, 1, ... of each group in order, for groups of any size; null is a group too.

    Rows are dealt by ranges of group and order, so a large group is in many tasks; each numbers its own rows of a group, and counts
    by group and task give the first number.
    """
    c = F.col
    # Cut off first: ranges drawn anew would number the rows otherwise.
    ranged = cut(df.repartitionByRange(c(group), *[c(o) for o in order]).withColumn("_p", F.spark_partition_id()))
    local = ranged.withColumn("_k", F.row_number().over(Window.partitionBy(group, "_p").orderBy(*order)) - 1)
    sizes = ranged.groupBy(c(group).alias("_g"), c("_p").alias("_q")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_g").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("_g", "_q", F.coalesce(before, F.lit(0)).alias("_b"))
    joined = local.join(firsts, c(group).eqNullSafe(c("_g")) & (c("_p") == c("_q")))
    return joined.select(*df.columns, (c("_k") + c("_b")).alias(to))
