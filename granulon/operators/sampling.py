"""Splits that keep sources together, and stratified choices; hash order in place of random shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_order(seed: int, key: Column) -> Column:
    """The place of a key in the order that stands in for shuffling with a seed."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit("|"), key.cast("string")))


def source_units(df: DataFrame, source: Column, stratum: Column, order: Column) -> DataFrame:
    """(unit, stratum, n_rows): each source once, with its first row's stratum."""
    return df.select(source.alias("unit"), stratum.alias("s"), order.alias("o")).groupBy("unit").agg(F.min_by("s", "o").alias("stratum"), F.count("*").alias("n_rows"))


def val_quota(n: Column, ratio: float, policy: str = "spare") -> Column:
    """Units of a stratum that go to validation: n * ratio, halves to the even number.

    spare: at least 1 from 4 units on; always: at least 1.
    """
    wanted = F.bround(n * ratio, 0).cast("int")
    least = F.when((n >= 4) & F.lit(ratio > 0), 1).otherwise(0) if policy == "spare" else F.lit(1)
    return F.least(n, F.greatest(wanted, least))


def ranked(units: DataFrame, stratum: str, order: Column, tie: str, digits: int = 4) -> DataFrame:
    """units with _h, the order (hexadecimal, evenly spread), _n, how many its stratum has, and _r, its place there by order and tie.

    Units are counted by stratum and first digits of the order; a unit's place is what those before have and its own place among
    those with the same digits. So the largest group that is ordered is a stratum's share of one in 16 ** digits, however large
    the stratum, and the counts are that many rows for each stratum at most.
    """
    own = units.withColumn("_h", order).withColumn("_d", F.substring("_h", 1, digits))
    at = Window.partitionBy(stratum)
    before = F.sum("_c").over(at.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1))
    counts = own.groupBy(stratum, "_d").agg(F.count("*").alias("_c")).select(F.col(stratum).alias("_s"), F.col("_d").alias("_e"), F.sum("_c").over(at).alias("_n"), F.coalesce(before, F.lit(0)).alias("_b"))
    placed = own.withColumn("_k", F.row_number().over(Window.partitionBy(stratum, "_d").orderBy("_h", tie)))
    joined = placed.join(counts, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_d") == F.col("_e")))
    return joined.select(*units.columns, "_h", "_n", (F.col("_b") + F.col("_k")).alias("_r"))


def stratified_split(units: DataFrame, ratio: float, seed: int = 42, min_val_rows: int = 0, policy: str = "spare") -> DataFrame:
    """units with split train or val: the quota of each stratum, in hash order.

    If these have less than min_val_rows rows, more units follow until they do: first of strata with more
    than 3 units, in hash order. No window holds a stratum.
    """
    placed = ranked(units, "stratum", hash_order(seed, F.col("unit")), "unit")
    chosen = placed.withColumn("_val", F.col("_r") <= val_quota(F.col("_n"), ratio, policy))
    if min_val_rows:
        have = chosen.agg(F.coalesce(F.sum(F.when(F.col("_val"), F.col("n_rows"))), F.lit(0)).alias("_have"))
        # No more than min_val_rows units can follow, so only the first so many are ranked together.
        order = [(F.col("_n") <= 3).asc(), F.col("_h").asc(), F.col("unit").asc()]
        spare = chosen.where("not _val").orderBy(*order).limit(min_val_rows)
        running = F.sum("n_rows").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        more = spare.withColumn("_sum", running).join(F.broadcast(have)).where(F.col("_sum") - F.col("n_rows") < F.lit(min_val_rows) - F.col("_have")).select("unit", F.lit(True).alias("_more"))
        chosen = chosen.join(more, "unit", "left").withColumn("_val", F.col("_val") | F.coalesce("_more", F.lit(False)))
    return chosen.select("unit", "stratum", "n_rows", F.when(F.col("_val"), "val").otherwise("train").alias("split"))


def group_split(units: DataFrame, train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """units with split: of each stratum the share of groups for training, at least 1 and not all if there are two."""
    placed = ranked(units, "stratum", hash_order(seed, F.col("unit")), "unit")
    target = F.when(F.col("_n") > 1, F.least(F.greatest(F.bround(F.col("_n") * train_share, 0).cast("int"), F.lit(1)), F.col("_n") - 1)).otherwise(F.col("_n"))
    return placed.select(*units.columns, F.when(F.col("_r") <= target, "train").otherwise("val").alias("split"))


def val_only_strata(split_units: DataFrame) -> DataFrame:
    """(stratum, n_units) of strata without a training unit."""
    return split_units.groupBy("stratum").agg(F.count("*").alias("n_units"), F.count_if(F.col("split") == "train").alias("_t")).where("_t = 0").select("stratum", "n_units")


def hash_split(content_hash: Column, val_ratio: float) -> Column:
    """val or train by the content alone: the same content always falls the same way."""
    at = F.conv(F.substring(content_hash, 1, 12), 16, 10).cast("double") / float(16**12)
    return F.when(at < val_ratio, "val").otherwise("train")


def auto_split_candidate(split: Column, role: Column) -> Column:
    """Whether a row may be dealt: neither held out by its split nor by its tile role."""
    return ~(F.coalesce(split, F.lit("")) == "holdout") & ~(F.coalesce(role, F.lit("")) == "holdout_full_image")


def round_robin(df: DataFrame, group: Column, score: Column, name: str, k: int) -> DataFrame:
    """k rows with pick_round and group_key: the best of each group in order of the groups, then the second best, and so on.

    Within a group by falling score, then name; only k rows of a group can be chosen, so ranks beyond are dropped.
    """
    own = Window.partitionBy("group_key").orderBy(F.col("_score").desc(), F.col(name).asc())
    ranked = df.withColumn("group_key", F.coalesce(F.nullif(group, F.lit("")), F.lit("unknown"))).withColumn("_score", score)
    ranked = ranked.withColumn("pick_round", F.row_number().over(own)).where(F.col("pick_round") <= k)
    return ranked.orderBy("pick_round", "group_key").limit(k).drop("_score")


def quota_then_fill(df: DataFrame, kind: str, score: str, name: str, k: int) -> DataFrame:
    """k rows: of each kind, in order, up to k // kinds + 1 of the best, while there is room; then the best of the rest."""
    n_kinds = df.agg(F.countDistinct(kind)).first()[0]
    if not n_kinds:
        return df.limit(0)
    quota = max(1, k // n_kinds) + 1
    own = Window.partitionBy(kind).orderBy(F.col(score).desc(), F.col(name).asc())
    ranked = df.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= max(quota, k))
    first = ranked.where(F.col("_r") <= quota).orderBy(kind, "_r").limit(k)
    rest = ranked.join(first.select(name), name, "left_anti").select(*ranked.columns)
    both = first.withColumn("_p", F.lit(0)).unionByName(rest.withColumn("_p", F.lit(1)))
    return both.orderBy("_p", F.when(F.col("_p") == 1, -F.col(score)), F.when(F.col("_p") == 0, F.col(kind)), "_r", name).limit(k).drop("_r", "_p")


def group_coverage(candidates: DataFrame, chosen: DataFrame, group: str) -> DataFrame:
    """(group, n_candidates, n_selected)."""
    a = candidates.groupBy(group).agg(F.count("*").alias("n_candidates"))
    b = chosen.groupBy(group).agg(F.count("*").alias("n_selected"))
    return a.join(b, group, "left").select(group, "n_candidates", F.coalesce("n_selected", F.lit(0)).cast("bigint").alias("n_selected"))


def running_best(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, initial: float = -1.0) -> DataFrame:
    """df with best_before and is_best: strictly better than all rows before it, or than the initial value."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.lit(initial), F.coalesce(F.max(value).over(before), F.lit(initial)))
    return df.withColumn("best_before", best).withColumn("is_best", F.col(value) > F.col("best_before"))


def renumber_by_first(df: DataFrame, image: str, label: str, position: str, to: str = "new_label") -> DataFrame:
    """df with labels 1, 2, ... of each image in order of their first position; background 0 stays."""
    first = df.where(F.col(label) > 0).groupBy(image, label).agg(F.min(position).alias("_first"))
    numbered = first.withColumn(to, F.dense_rank().over(Window.partitionBy(image).orderBy("_first"))).drop("_first")
    return df.join(numbered, [image, label], "left").withColumn(to, F.coalesce(to, F.lit(0)))


def keep_share(df: DataFrame, key: Column, ratio: float, seed: int = 42) -> DataFrame:
    """The share of rows whose hash falls below it (background tiles)."""
    return df.where(hash_split(hash_order(seed, key), ratio) == "val")
