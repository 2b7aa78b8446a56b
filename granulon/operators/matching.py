"""Instance matching and quality metrics on pixel relations (image, position, gt, pred)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from granulon.functions.scalars import equivalent_diameter, precision_recall_f1, review_required
from granulon.operators.groups import by_groups
from granulon.operators.stats import percentile

SMALL_DIAMETER = 32.0
#: Side of the squares of pixels in which boundaries are found.
SQUARE = 64


def contingency(pixels: DataFrame, image: str, pred: str = "pred", gt: str = "gt") -> DataFrame:
    """(image, pred, gt, inter, pred_area, gt_area, iou) of instances that share pixels; 0 is background.

    One shuffle counts the pairs of labels of a pixel; areas come from these counts, not from the pixels.
    """
    counts = pixels.groupBy(image, F.coalesce(pred, F.lit(0)).alias("pred"), F.coalesce(gt, F.lit(0)).alias("gt")).agg(F.count("*").alias("inter"))
    areas = counts.withColumn("pred_area", F.sum("inter").over(Window.partitionBy(image, "pred"))).withColumn("gt_area", F.sum("inter").over(Window.partitionBy(image, "gt")))
    met = areas.where("pred > 0 and gt > 0")
    return met.withColumn("iou", F.col("inter") / (F.col("pred_area") + F.col("gt_area") - F.col("inter")))


def instance_areas(pixels: DataFrame, image: str, label: str) -> DataFrame:
    return pixels.where(F.col(label) > 0).groupBy(image, label).agg(F.count("*").alias("area"))


def match(pairs: DataFrame, image: str, least: float = 0.5, ties: str = "highest") -> DataFrame:
    """The one-to-one matches among pairs with an IoU of at least `least` (0.5 or more), greedy by IoU.

    Instances of one map are disjoint, so of an instance's partners only two can reach one half, and then
    both reach it exactly. Being first of both sides is therefore the same as the greedy choice. Ties go
    to the higher ids, or to the lower ones.
    """
    if least < 0.5:
        raise ValueError("below one half the first of both sides need not be the greedy match")
    by = (lambda c: F.col(c).desc()) if ties == "highest" else (lambda c: F.col(c).asc())
    of_gt = Window.partitionBy(image, "gt").orderBy(F.col("iou").desc(), by("pred"))
    of_pred = Window.partitionBy(image, "pred").orderBy(F.col("iou").desc(), by("gt"))
    ranked = pairs.where(F.col("iou") >= least).withColumn("_g", F.row_number().over(of_gt)).withColumn("_p", F.row_number().over(of_pred))
    return ranked.where("_g = 1 and _p = 1").drop("_g", "_p")


def best_partners(pairs: DataFrame, image: str, above: float = 0.5) -> DataFrame:
    """(image, pred, best_iou): for each predicted instance its best IoU, if that is above a limit; partners may repeat."""
    return pairs.groupBy(image, "pred").agg(F.max("iou").alias("best_iou")).where(F.col("best_iou") > above)


def boundary(pixels: DataFrame, image: str, label: str, x: str = "x", y: str = "y") -> DataFrame:
    """(image, label, x, y) of instance pixels with a pixel of the image around them that isn't the instance's.

    What lies outside of the image doesn't make a boundary. pixels holds all pixels of the images.
    """
    c = F.col
    # Pixels are shuffled once, to their square of pixels and to the squares that they are next to.
    at = lambda v: F.explode(F.array_distinct(F.array(*[F.floor((c(v) + d) / SQUARE) for d in (0, -1, 1)])))
    here = pixels.where(c(label).isNotNull()).select(image, c(x).alias("_x"), c(y).alias("_y"), c(label).alias("_l"))
    dealt = here.withColumn("_cx", at("_x")).withColumn("_cy", at("_y")).repartition(image, "_cx", "_cy")
    schema = here.schema

    def found(rows: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch:
        cx, cy, px, py, value = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("_cx", "_cy", "_x", "_y", "_l"))
        side = SQUARE + 2
        dx, dy = px - cx * SQUARE, py - cy * SQUARE
        place = (group * side + dy + 1) * side + dx + 1  # rises from row to row
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        where, low, high = place[first], np.minimum.reduceat(value, first), np.maximum.reduceat(value, first)
        least, most = low.copy(), high.copy()
        for step in (-side - 1, -side, 1 - side, -1, 1, side - 1, side, side + 1):
            near = np.searchsorted(where, where + step).clip(max=len(where) - 1)
            met = where[near] == where + step
            least[met], most[met] = np.minimum(least, low[near])[met], np.maximum(most, high[near])[met]
        mixed = np.repeat(least != most, np.diff(np.append(first, len(place))))
        own = (dx >= 0) & (dx < SQUARE) & (dy >= 0) & (dy < SQUARE)
        return rows.select(schema.names).filter(pa.array(mixed & own & (value > 0)))

    edge = by_groups(dealt, (image, "_cx", "_cy"), ("_y", "_x"), found, schema)
    return edge.select(image, c("_l").alias(label), c("_x").alias(x), c("_y").alias(y))


def boundary_iou(matches: DataFrame, pred_edge: DataFrame, gt_edge: DataFrame, image: str, x: str = "x", y: str = "y") -> DataFrame:
    """matches with boundary_iou; 0 where neither side has a boundary."""
    key = [image, x, y]
    both = pred_edge.join(gt_edge, key).groupBy(image, "pred", "gt").agg(F.count("*").alias("_i"))
    n = lambda e, k, to: e.groupBy(image, k).agg(F.count("*").alias(to))
    joined = matches.join(both, [image, "pred", "gt"], "left").join(n(pred_edge, "pred", "_np"), [image, "pred"], "left").join(n(gt_edge, "gt", "_ng"), [image, "gt"], "left")
    i, u = F.coalesce("_i", F.lit(0)), F.coalesce("_np", F.lit(0)) + F.coalesce("_ng", F.lit(0)) - F.coalesce("_i", F.lit(0))
    return joined.withColumn("boundary_iou", F.when(u > 0, i / u).otherwise(0.0)).drop("_i", "_np", "_ng")


def image_metrics(pixels: DataFrame, image: str, small: float = SMALL_DIAMETER, edges: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row for each image: instance and pixel metrics; an image without instances on both sides has ones.

    edges: the boundaries of pred and gt, without which boundary_iou_mean is null.
    """
    c = F.col
    counts = pixels.groupBy(image, F.coalesce("pred", F.lit(0)).alias("pred"), F.coalesce("gt", F.lit(0)).alias("gt")).agg(F.count("*").alias("inter"))
    in_both, in_any = (c("pred") > 0) & (c("gt") > 0), (c("pred") > 0) | (c("gt") > 0)
    totals = counts.groupBy(image).agg(
        F.coalesce(F.sum(F.when(in_both, c("inter"))), F.lit(0)).alias("_i"), F.coalesce(F.sum(F.when(in_any, c("inter"))), F.lit(0)).alias("_u"),
        F.countDistinct(F.when(c("pred") > 0, c("pred"))).alias("n_pred"), F.countDistinct(F.when(c("gt") > 0, c("gt"))).alias("n_gt"),
    )
    pairs = contingency(pixels, image)
    found = match(pairs, image)
    if edges:
        found = boundary_iou(found, edges[0], edges[1], image)
    dp, dg = equivalent_diameter(c("pred_area")), equivalent_diameter(c("gt_area"))
    of_matches = found.groupBy(image).agg(
        F.count("*").alias("_m"), F.avg("iou").alias("_mi"), (F.avg("boundary_iou") if edges else F.lit(None).cast("double")).alias("_bi"), F.avg(F.abs(dp - dg)).alias("_de"),
        F.avg(F.abs(c("pred_area") - c("gt_area")) / F.greatest(c("gt_area"), F.lit(1))).alias("_ae"), F.count_if(dg < small).alias("_sm"),
        *[(percentile(dp, q) - percentile(dg, q)).alias(f"_d{q}") for q in (10, 50, 90)],
    )
    smalls = counts.where("gt > 0").groupBy(image, "gt").agg(F.sum("inter").alias("a")).groupBy(image).agg(F.count_if(equivalent_diameter(c("a")) < small).alias("_sn"))
    splits = pairs.where("iou >= 0.5").groupBy(image, "gt").agg(F.count("*").alias("k")).groupBy(image).agg(F.sum(c("k") - 1).alias("_os"))
    joined = totals.join(of_matches, image, "left").join(smalls, image, "left").join(splits, image, "left")
    matched = F.coalesce("_m", F.lit(0))
    p, r, f1 = precision_recall_f1(matched, c("n_pred"), c("n_gt"))
    empty = (c("n_pred") == 0) & (c("n_gt") == 0)
    one = lambda x: F.when(empty, 1.0).otherwise(F.coalesce(x, F.lit(0.0)))
    zero = lambda k: F.coalesce(k, F.lit(0.0))
    return joined.select(
        image, "n_pred", "n_gt", matched.alias("n_matched"), one(F.when(c("_u") > 0, c("_i") / c("_u"))).alias("pix_iou"), one(c("_mi")).alias("mask_iou_mean"),
        (one(c("_bi")) if edges else F.lit(None).cast("double")).alias("boundary_iou_mean"), one(p).alias("precision"), one(r).alias("recall"), one(f1).alias("instance_f1"),
        F.when(F.coalesce("_sn", F.lit(0)) > 0, F.coalesce("_sm", F.lit(0)) / c("_sn")).otherwise(1.0).alias("small_recall"), zero("_de").alias("diameter_mae"), zero("_ae").alias("area_error_mean"),
        F.coalesce("_os", F.lit(0)).cast("bigint").alias("over_split"), *[zero(f"_d{q}").alias(f"psd_d{q}_bias") for q in (10, 50, 90)],
    )


def contour_report(metrics: DataFrame) -> DataFrame:
    """metrics with false_positives, false_negatives and review_required."""
    c = F.col
    return metrics.withColumns(
        {
            "false_positives": F.greatest(F.lit(0), c("n_pred") - c("n_matched")),
            "false_negatives": F.greatest(F.lit(0), c("n_gt") - c("n_matched")),
            "review_required": review_required(c("instance_f1"), c("mask_iou_mean"), F.coalesce(c("boundary_iou_mean"), F.lit(1.0)), c("recall"), c("precision")),
        }
    )


def macro_report(metrics: DataFrame) -> DataFrame:
    """One row: means over images, totals of counts, images to review."""
    means = ("mask_iou_mean", "precision", "recall", "instance_f1")
    report = contour_report(metrics)
    return report.agg(F.count("*").alias("n_images"), *[F.avg(m).alias(f"avg_{m}") for m in means], *[F.sum(s).alias(f"total_{s}") for s in ("n_pred", "n_gt", "n_matched", "false_positives", "false_negatives")], F.count_if("review_required").alias("n_review"))


def alignment_row(pixels: DataFrame, image: str, a: str, b: str) -> DataFrame:
    """(image, pixel_iou, diff_pixels, diff_percent, instance_diff) of two label maps; two empty maps agree (1)."""
    la, lb = F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))
    union = F.count_if((la > 0) | (lb > 0))
    return pixels.groupBy(image).agg(
        F.when(union > 0, F.count_if((la > 0) & (lb > 0)) / union).otherwise(1.0).alias("pixel_iou"), F.count_if(la != lb).alias("diff_pixels"), (100.0 * F.count_if(la != lb) / F.count("*")).alias("diff_percent"),
        F.abs(F.countDistinct(F.when(la > 0, la)) - F.countDistinct(F.when(lb > 0, lb))).alias("instance_diff"),
    )


def binary_iou(inter: Column, union: Column, empty: float = 0.0) -> Column:
    return F.when(union > 0, inter / union).otherwise(F.lit(empty))
