"""Statistics of instances, images and datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granulon.functions.scalars import aspect_ratio, equivalent_diameter, touches_edge
from granulon.session import cut


def percentile(value: Column | str, q: float) -> Column:
    """Exact percentile (0 to 100) with linear interpolation; 0 of nothing.

    A group's different values are held by one task: for groups of bounded size, as images are; see percentiles().
    """
    return F.coalesce(F.percentile(value, F.lit(q / 100)), F.lit(0.0))


def upper_median(value: Column | str) -> Column:
    """The element in the middle of the sorted values, the upper one of two; null of nothing. For groups of bounded size; see percentiles()."""
    values = F.array_sort(F.collect_list(value))
    return F.try_element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def instance_stats(pixels: DataFrame, image: str, label: str, x: str, y: str) -> DataFrame:
    """(image, label, area, min_x, max_x, min_y, max_y, sum_x, sum_y, diameter, aspect) of labelled pixels."""
    found = pixels.where(F.col(label) > 0).groupBy(image, label).agg(
        F.count("*").alias("area"), F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"), F.sum(x).alias("sum_x"), F.sum(y).alias("sum_y")
    )
    w, h = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    return found.withColumn("diameter", equivalent_diameter(F.col("area"))).withColumn("aspect", aspect_ratio(w, h).cast("double"))


def run_stats(runs: DataFrame, image: str = "image_id", label: str = "label") -> DataFrame:
    """instance_stats of run-length rows (y, x0, x1 with x1 outside), without making pixels."""
    n = F.col("x1") - F.col("x0")
    found = runs.where(F.col(label) > 0).groupBy(image, label).agg(
        F.sum(n).alias("area"), F.min("x0").alias("min_x"), (F.max("x1") - 1).alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        F.sum((F.col("x0") + F.col("x1") - 1) * n / 2).cast("bigint").alias("sum_x"), F.sum(F.col("y") * n).alias("sum_y"),
    )
    w, h = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    return found.withColumn("diameter", equivalent_diameter(F.col("area"))).withColumn("aspect", aspect_ratio(w, h).cast("double"))


def image_label_stats(instances: DataFrame, sizes: DataFrame, image: str = "image_id") -> DataFrame:
    """One row for each image of sizes (image, height, width): counts, percentiles of areas and diameters, edge contacts."""
    c = F.col
    edge = touches_edge("label", c("min_x"), c("min_y"), c("max_x") - c("min_x") + 1, c("max_y") - c("min_y") + 1, c("width"), c("height"))
    joined = sizes.join(instances, image, "left")
    measures = [percentile(v, q).alias(f"{v}_{n}") for v in ("area", "diameter") for n, q in (("min", 0), ("p10", 10), ("median", 50), ("p90", 90), ("max", 100))]
    return joined.groupBy(image, "height", "width").agg(
        F.count("area").alias("particle_count"), (F.coalesce(F.sum("area"), F.lit(0)) / F.greatest(F.first("height") * F.first("width"), F.lit(1))).alias("foreground_fraction"),
        F.count_if(edge).alias("edge_touching_count"), *measures, percentile("aspect", 50).alias("aspect_median"), percentile("aspect", 90).alias("aspect_p90"),
    )


def percentiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float | str]) -> DataFrame:
    """(keys..., n, p10, ...): exact percentiles as of percentile() for groups of any size; one row without keys.

    Of qs, "upper" is the upper median as of upper_median(), in a column upper_median.

    Values are counted, and ranges of them sorted in parallel. The ranges' sums tell which of them hold the
    wanted ranks, and only these are looked through. Null values don't count; a group without others has 0.
    """
    c, names = F.col, list(keys)
    counts = df.groupBy(*names, c(value).cast("double").alias("_v")).agg(F.count(value).alias("_n"))
    # Cut off first: ranges drawn anew would give other sums.
    ranged = cut(counts.repartitionByRange(*names, "_v").sortWithinPartitions(*names, "_v").withColumn("_p", F.spark_partition_id()))
    group = Window.partitionBy(*names)  # of the sums: a row for each range that has values of the group
    sums = ranged.groupBy(*names, "_p").agg(F.sum("_n").alias("_s"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_s").over(group))
    place = {q: F.floor(c("_total") / 2).cast("double") if q == "upper" else F.lit(q / 100) * (c("_total") - 1) for q in qs}

    def holds(rank: Column, first: Column, n: Column) -> Column:
        return (rank >= first) & (rank < first + n)

    wanted = c("_total") == 0
    for at in place.values():
        wanted = wanted | holds(F.floor(at), c("_before"), c("_s")) | holds(F.ceil(at), c("_before"), c("_s"))
    chosen = sums.where(wanted).select("_before", "_total", *[c(k).alias(f"_k{i}") for i, k in enumerate([*names, "_p"])])
    same = F.lit(True)
    for i, k in enumerate([*names, "_p"]):
        same = same & c(k).eqNullSafe(c(f"_k{i}"))
    running = F.sum("_n").over(Window.partitionBy(*names, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = ranged.join(chosen, same).withColumn("_first", c("_before") + running - c("_n"))
    out = []
    for q, at in place.items():
        low, high = (F.max(F.when(holds(rank, c("_first"), c("_n")), c("_v"))) for rank in (F.floor(at), F.ceil(at)))
        share = F.max(at - F.floor(at))
        found = F.when(low == high, low).otherwise((1 - share) * low + share * high)
        out.append(found.alias("upper_median") if q == "upper" else F.coalesce(found, F.lit(0.0)).alias(f"p{q:g}"))
    return rows.groupBy(*names).agg(F.coalesce(F.max("_total"), F.lit(0)).alias("n"), *out)


def size_percentiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float] = (10, 50, 90)) -> DataFrame:
    return percentiles(df, keys, value, qs)


def small_shares(diameters: DataFrame, diameter: str = "diameter", limits: Sequence[float] = (4.0, 8.0)) -> DataFrame:
    """One row: the number of instances, and counts and shares of those below each limit; shares of nothing are 0."""
    n = F.count(diameter)
    out = [n.alias("total_particles")]
    for limit in limits:
        k = F.count_if(F.col(diameter) < limit)
        out += [k.alias(f"lt{limit:g}_count"), F.when(n > 0, k / n).otherwise(0.0).alias(f"lt{limit:g}_ratio")]
    return diameters.agg(*out)


def spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys..., n, mean, pop_std)."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("pop_std"))


def micro_macro(df: DataFrame, keys: Sequence[str], inter: Column, union: Column) -> DataFrame:
    """(keys..., micro, macro): ratio of the sums, and mean of the ratios; an empty union counts as 1."""
    micro = F.sum(inter) / F.greatest(F.sum(union), F.lit(1))
    return df.groupBy(*keys).agg(micro.alias("micro"), F.avg(inter / F.greatest(union, F.lit(1))).alias("macro"))


def percentile_bias(df: DataFrame, keys: Sequence[str], pred: str, gt: str, qs: Sequence[int] = (10, 50, 90)) -> DataFrame:
    """(keys..., d10_bias, ...): percentiles of the predicted sizes less those of the true ones."""
    return df.groupBy(*keys).agg(*[(percentile(pred, q) - percentile(gt, q)).alias(f"d{q}_bias") for q in qs])


def mean_by_label(df: DataFrame, image: str, label: str, value: Column, name: str) -> DataFrame:
    """(image, label, name): the mean of a pixel value over each instance (logits, flow errors)."""
    return df.where(F.col(label) > 0).groupBy(image, label).agg(F.avg(value).alias(name))


def distinct_sizes(df: DataFrame, height: str, width: str) -> DataFrame:
    return df.groupBy(height, width).agg(F.count("*").alias("n"))


def dataset_summary(instances: DataFrame, image: str, area: str, diameter: str, aspect: str, image_area: float) -> DataFrame:
    """One row: images, instances, mean count and coverage, medians, and the share of long instances."""
    images = instances.groupBy(image).agg(F.count("*").alias("_n"), (F.sum(area) / image_area).alias("_c"))
    whole = instances.agg(F.count("*").alias("n_particles"), (F.count_if(F.col(aspect) > 3.0) / F.greatest(F.count("*"), F.lit(1))).alias("long_share"))
    means = images.agg(F.count("*").alias("n_images"), F.avg("_n").alias("particles_per_image"), F.avg("_c").alias("coverage"))
    medians = [percentiles(instances, [], v, [50]).select(F.col("p50").alias(name)) for v, name in ((area, "area_median"), (diameter, "diameter_median"))]
    return means.crossJoin(whole).crossJoin(medians[0]).crossJoin(medians[1])  # one row each
