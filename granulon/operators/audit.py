"""Audits by joins: pairs, orphans, leaks between splits, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granulon.operators.dedup import numbered_within


def pair_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, status): paired, missing (no right side) or orphan (no left side), a row for each key."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    status = F.when(F.col("_l").isNull(), "orphan").when(F.col("_r").isNull(), "missing").otherwise("paired")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def strict_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with right's columns; a left row without a partner is an error when it is read."""
    marked = left.join(right.withColumn("_found", F.lit(True)), key, "left")
    checked = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no partner for "), F.col(key).cast("string")))).otherwise(F.col(key))
    return marked.withColumn(key, checked).drop("_found")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key no row of parent has. Parents are never broadcast: estimates of a few columns would have it for any number of keys."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).hint("merge"), child_key, "left_anti").select(*child.columns)


def kept_with(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key some row of parent has."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_semi").select(*child.columns)


def name_differences(a: DataFrame, b: DataFrame, key: str, only_a: str, only_b: str) -> DataFrame:
    """(key, status) of the names that only one side has."""
    # By joins of sorted names: no table of all names is held, only what is left of them is made distinct.
    lost = lambda one, other, status: orphans(one.select(key), other, key, key).distinct().select(key, F.lit(status).alias("status"))
    return lost(a, b, only_a).unionByName(lost(b, a, only_b))


def content_leaks(df: DataFrame, split: Column, content: Column, name: Column) -> DataFrame:
    """(content_hash, n_train, n_val, first_train, first_val) of contents that are on both sides."""
    rows = df.select(split.alias("s"), content.alias("content_hash"), name.alias("n")).where(F.col("s").isin("train", "val"))
    train = F.col("s") == "train"
    found = rows.groupBy("content_hash").agg(
        F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_val"), F.min(F.when(train, F.col("n"))).alias("first_train"), F.min(F.when(~train, F.col("n"))).alias("first_val")
    )
    return found.where("n_train > 0 and n_val > 0")


def source_leaks(df: DataFrame, source: Column, split: Column) -> DataFrame:
    """(source_unit, n_splits) of sources that are in several splits."""
    return df.groupBy(source.alias("source_unit")).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def key_collisions(df: DataFrame, key: Column, name: Column) -> DataFrame:
    """(key, n, names) where several names have the same key; up to five names, the first ones.

    Names are counted first and ranked within their key, so no more than five of a key are ever gathered.
    """
    each = df.select(key.alias("key"), name.alias("n")).groupBy("key", "n").agg(F.count("*").alias("c"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("n").asc_nulls_last()))
    first = each.withColumn("r", rank).where("r <= 5").groupBy("key").agg(F.array_sort(F.collect_list("n")).alias("names"))
    counts = each.groupBy("key").agg(F.sum("c").alias("n")).where("n > 1")
    return counts.withColumnRenamed("key", "k").join(first, F.col("k").eqNullSafe(F.col("key"))).select("key", "n", "names")


def renamed(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """df with new_name: the first row of a name keeps it, others get _1, _2, ... before the extension. A name may have any number of rows."""
    parts = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return numbered_within(df, name, order, "_k").withColumn("new_name", F.when(F.col("_k") == 0, F.col(name)).otherwise(F.concat(parts[0], F.lit("_"), F.col("_k").cast("string"), parts[1]))).drop("_k")


def status_counts(checks: DataFrame, status: str = "status") -> DataFrame:
    return checks.groupBy(status).agg(F.count("*").alias("n"))
