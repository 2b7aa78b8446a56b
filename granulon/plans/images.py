"""Instance, box, tile, match and grid queries; line items stand for pixels and boxes."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulon.functions import scalars
from granulon.operators import graph, matching, raster, sampling, spatial, stats, tuning
from granulon.operators import runs as runs_table
from granulon.plans.registry import Query, adder
from granulon.session import table

QUERIES: dict[str, tuple[Query, str | None]] = {}
query = adder(QUERIES)
c = F.col
r6 = lambda x, name: F.round(x, 6).alias(name)

#: Boxes: an order is an image of 512 x 512, its items are instances in order of their keys.
SIDE = 512
_BOX_ORDER = ("l_linenumber", "l_partkey", "l_suppkey")
_BOX = """box AS (SELECT l_orderkey AS image, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS id,
  CAST((l_partkey * 37) % 480 AS DOUBLE) AS x, CAST((l_suppkey * 53 + l_linenumber * 11) % 480 AS DOUBLE) AS y, 8 + round(l_discount * 300) AS w, 8 + round(l_tax * 300) AS h FROM lineitem)"""
#: Pixels: 64 orders are an image; prediction and truth differ where the discount is small.
_PX = """px AS (SELECT l_orderkey // 64 AS image, l_partkey % 40 AS x, l_suppkey % 40 AS y, l_suppkey % 8 + 1 AS gt, CASE WHEN l_discount < 0.03 THEN (l_suppkey + 1) % 8 + 1 ELSE l_suppkey % 8 + 1 END AS pred FROM lineitem)"""
_PAIRS = """n AS (SELECT image, pred, gt, count(*) AS inter FROM px GROUP BY ALL),
  pairs AS (SELECT *, inter / (pa + ga - inter) AS iou FROM (SELECT *, sum(inter) OVER (PARTITION BY image, pred) AS pa, sum(inter) OVER (PARTITION BY image, gt) AS ga FROM n))"""
_MATCH = """m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, gt ORDER BY iou DESC, pred DESC) AS rg, row_number() OVER (PARTITION BY image, pred ORDER BY iou DESC, gt DESC) AS rp FROM pairs WHERE iou >= 0.5) WHERE rg = 1 AND rp = 1)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    from pyspark.sql.window import Window

    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_BOX_ORDER))
    return items.select(
        c("l_orderkey").alias("image"), number.alias("id"), ((c("l_partkey") * 37) % 480).cast("double").alias("x"), ((c("l_suppkey") * 53 + c("l_linenumber") * 11) % 480).cast("double").alias("y"),
        (8 + F.round(c("l_discount") * 300)).alias("w"), (8 + F.round(c("l_tax") * 300)).alias("h"),
    )


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = c("l_suppkey") % 8 + 1
    return table(spark, sf_dir, "lineitem").select(
        F.floor(c("l_orderkey") / 64).alias("image"), (c("l_partkey") % 40).alias("x"), (c("l_suppkey") % 40).alias("y"), gt.alias("gt"), F.when(c("l_discount") < 0.03, (c("l_suppkey") + 1) % 8 + 1).otherwise(gt).alias("pred")
    )


@query(
    f"""WITH {_PX} SELECT image, gt, count(*) AS area, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y, round(sqrt(4 * count(*) / pi()), 6) AS diameter,
    round(greatest(max(x) - min(x) + 1, max(y) - min(y) + 1) / greatest(least(max(x) - min(x) + 1, max(y) - min(y) + 1), 1), 6) AS aspect FROM px GROUP BY image, gt"""
)
def instance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.instance_stats(_pixels(spark, sf_dir), "image", "gt", "x", "y").withColumns({"diameter": F.round("diameter", 6), "aspect": F.round("aspect", 6)})


_RUNS = "runs AS (SELECT l_orderkey // 64 AS image_id, l_suppkey % 8 + 1 AS label, CAST(l_linenumber AS BIGINT) AS y, l_partkey % 900 AS x0, l_partkey % 900 + CAST(l_quantity AS BIGINT) AS x1 FROM lineitem)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0 = c("l_partkey") % 900
    return table(spark, sf_dir, "lineitem").select(F.floor(c("l_orderkey") / 64).alias("image_id"), (c("l_suppkey") % 8 + 1).alias("label"), c("l_linenumber").cast("bigint").alias("y"), x0.alias("x0"), (x0 + c("l_quantity").cast("bigint")).alias("x1"))


@query(f"WITH {_RUNS} SELECT image_id, label, CAST(sum(x1 - x0) AS BIGINT) AS area, min(x0) AS min_x, max(x1) - 1 AS max_x, min(y) AS min_y, max(y) AS max_y, CAST(sum((x0 + x1 - 1) * (x1 - x0) / 2) AS BIGINT) AS sum_x, CAST(sum(y * (x1 - x0)) AS BIGINT) AS sum_y FROM runs GROUP BY 1, 2")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.run_stats(_runs(spark, sf_dir)).drop("diameter", "aspect")


@query("SELECT l_suppkey % 8 AS g, count(*) AS n, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1")
def size_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.size_percentiles(table(spark, sf_dir, "lineitem").withColumn("g", c("l_suppkey") % 8), ["g"], "l_extendedprice")
    return found.select("g", "n", *[F.round(p, 6).alias(p) for p in ("p10", "p50", "p90")])


@query(
    f"""WITH {_PX}, i AS (SELECT image, gt, count(*) AS area, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px GROUP BY 1, 2)
    SELECT image, count(*) AS particle_count, round(sum(area) / 1600, 6) AS foreground_fraction, count(*) FILTER (x0 <= 0 OR y0 <= 0 OR x1 + 1 >= 40 OR y1 + 1 >= 40) AS edge_touching_count,
    round(quantile_cont(area, 0.1), 6) AS area_p10, round(median(area), 6) AS area_median, round(quantile_cont(sqrt(4 * area / pi()), 0.9), 6) AS diameter_p90 FROM i GROUP BY 1"""
)
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _pixels(spark, sf_dir)
    sizes = px.select("image").distinct().withColumn("height", F.lit(40)).withColumn("width", F.lit(40))
    found = stats.image_label_stats(stats.instance_stats(px, "image", "gt", "x", "y"), sizes, "image")
    return found.select("image", "particle_count", r6(c("foreground_fraction"), "foreground_fraction"), "edge_touching_count", r6(c("area_p10"), "area_p10"), r6(c("area_median"), "area_median"), r6(c("diameter_p90"), "diameter_p90"))


@query("SELECT count(*) AS total_particles, count(*) FILTER (l_quantity < 4) AS lt4_count, round(count(*) FILTER (l_quantity < 4) / count(*), 6) AS lt4_ratio, count(*) FILTER (l_quantity < 8) AS lt8_count, round(count(*) FILTER (l_quantity < 8) / count(*), 6) AS lt8_ratio FROM lineitem")
def small_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.small_shares(table(spark, sf_dir, "lineitem"), "l_quantity")
    return found.withColumns({k: F.round(k, 6) for k in ("lt4_ratio", "lt8_ratio")})


@query("SELECT l_orderkey // 64 AS image, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS upper_median FROM lineitem GROUP BY 1")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.floor(c("l_orderkey") / 64).alias("image"), "l_quantity")
    return stats.percentiles(rows, ["image"], "l_quantity", ["upper"]).select("image", "upper_median")


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS pop_std FROM lineitem GROUP BY 1")
def pop_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spread(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity").select("l_returnflag", "n", r6(c("mean"), "mean"), r6(c("pop_std"), "pop_std"))


@query("SELECT l_returnflag, round(sum(least(l_quantity, 25)) / greatest(sum(greatest(l_quantity, 25)), 1), 6) AS micro, round(avg(least(l_quantity, 25) / greatest(l_quantity, 25)), 6) AS macro FROM lineitem GROUP BY 1")
def micro_macro_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = c("l_quantity")
    return stats.micro_macro(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.least(q, F.lit(25.0)), F.greatest(q, F.lit(25.0))).select("l_returnflag", r6(c("micro"), "micro"), r6(c("macro"), "macro"))


@query(f"WITH {_PX} SELECT image, gt, round(avg(x - y), 6) AS mean_logit FROM px GROUP BY 1, 2")
def mean_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mean_by_label(_pixels(spark, sf_dir), "image", "gt", c("x") - c("y"), "m").select("image", "gt", r6(c("m"), "mean_logit"))


@query("SELECT p_size % 5 AS h, p_size % 3 AS w, count(*) AS n FROM part GROUP BY 1, 2")
def distinct_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distinct_sizes(table(spark, sf_dir, "part").select((c("p_size") % 5).alias("h"), (c("p_size") % 3).alias("w")), "h", "w")


@query(
    f"""WITH {_BOX}, i AS (SELECT image, count(*) AS n, sum(w * h) / 262144 AS cov FROM box GROUP BY 1)
    SELECT (SELECT count(*) FROM i) AS n_images, (SELECT round(avg(n), 6) FROM i) AS particles_per_image, (SELECT round(avg(cov), 6) FROM i) AS coverage, count(*) AS n_particles, round(median(w * h), 6) AS area_median,
    round(median(sqrt(4 * w * h / pi())), 6) AS diameter_median, round(count(*) FILTER (greatest(w, h) / least(w, h) > 3) / count(*), 6) AS long_share FROM box"""
)
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir).withColumn("area", c("w") * c("h")).withColumn("diameter", scalars.equivalent_diameter(c("area"))).withColumn("aspect", scalars.aspect_ratio(c("w"), c("h")))
    found = stats.dataset_summary(b, "image", "area", "diameter", "aspect", float(SIDE * SIDE))
    return found.withColumns({k: F.round(k, 6) for k in ("particles_per_image", "coverage", "area_median", "diameter_median", "long_share")})


_EXPANDED = f"e AS (SELECT image, id, w, h, greatest(0, x - greatest(3, least(w, h) * 0.1)) AS x0, greatest(0, y - greatest(3, least(w, h) * 0.1)) AS y0, least({SIDE}, x + w + greatest(3, least(w, h) * 0.1)) AS x1, least({SIDE}, y + h + greatest(3, least(w, h) * 0.1)) AS y1 FROM box)"
_OVERLAPS = "o AS (SELECT a.image, a.id AS a, b.id AS b FROM e a JOIN e b ON a.image = b.image AND a.id < b.id AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0))"


def _overlaps(boxes: DataFrame) -> DataFrame:
    return spatial.overlapping_pairs(spatial.expanded(boxes, F.lit(SIDE), F.lit(SIDE)), "image", "id")


@query(f"WITH {_BOX}, {_EXPANDED}, {_OVERLAPS} SELECT image, a, b FROM o")
def bbox_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(_boxes(spark, sf_dir))


@query(f"WITH {_BOX}, {_EXPANDED}, {_OVERLAPS}, n AS (SELECT image, count(*) AS n FROM box GROUP BY 1), p AS (SELECT image, count(*) AS k FROM o GROUP BY 1) SELECT n.image, n, COALESCE(k, 0) AS n_pairs, round(COALESCE(k, 0) / greatest(n * (n - 1) / 2, 1), 6) AS adhesion_ratio FROM n LEFT JOIN p ON n.image = p.image")
def adhesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    return spatial.adhesion(b, _overlaps(b), "image").withColumn("adhesion_ratio", F.round("adhesion_ratio", 6))


@query(
    f"""WITH {_BOX}, s AS (SELECT image, count(*) AS n, median(sqrt(4 * w * h / pi())) AS d, max(greatest(w, h) / least(w, h)) AS a, count(*) FILTER (x <= 1 OR y <= 1 OR x + w >= {SIDE - 1} OR y + h >= {SIDE - 1}) AS e FROM box GROUP BY 1)
    SELECT image, e AS edge_touching, round(CAST(0 AS DOUBLE) + CASE WHEN n >= 20 AND n < 80 THEN 0.5 ELSE 1 END + 0.3 + CASE WHEN d < 20 OR d > 80 THEN 0.5 ELSE 0 END + CASE WHEN a > 2.5 THEN 1 ELSE 0 END + CASE WHEN e > 0 THEN 1 ELSE 0 END, 6) AS score FROM s"""
)
def diversity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.lit(SIDE)
    edge = scalars.touches_edge("sample", c("x"), c("y"), c("w"), c("h"), side, side)
    found = _boxes(spark, sf_dir).groupBy("image").agg(F.count("*").alias("n"), stats.percentile(scalars.equivalent_diameter(c("w") * c("h")), 50).alias("d"), F.max(scalars.aspect_ratio(c("w"), c("h"))).alias("a"), F.count_if(edge).alias("edge_touching"))
    return found.select("image", "edge_touching", r6(scalars.diversity_score(c("n"), F.lit(0.0), c("d"), c("a"), c("edge_touching")), "score"))


_EDGE_RULES = {"sample": "x <= 1 OR y <= 1 OR x + w >= 511 OR y + h >= 511", "label": "x <= 0 OR y <= 0 OR x + w >= 512 OR y + h >= 512", "margin": "x <= 1 OR y <= 1 OR x + w >= 510 OR y + h >= 510"}


@query(f"WITH {_BOX} SELECT image, id, " + ", ".join(f"({v}) AS edge_{k}" for k, v in _EDGE_RULES.items()) + " FROM box")
def edge_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.lit(SIDE)
    return _boxes(spark, sf_dir).select("image", "id", *[scalars.touches_edge(k, c("x"), c("y"), c("w"), c("h"), side, side).alias(f"edge_{k}") for k in _EDGE_RULES])


@query(f"WITH {_PX}, {_PAIRS}, {_MATCH} SELECT image, pred, gt, inter, round(iou, 6) AS iou FROM m")
def instance_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.match(matching.contingency(_pixels(spark, sf_dir), "image"), "image")
    return found.select("image", "pred", "gt", "inter", r6(c("iou"), "iou"))


@query(f"WITH {_PX}, {_PAIRS} SELECT image, pred, round(max(iou), 6) AS best_iou FROM pairs GROUP BY 1, 2 HAVING max(iou) > 0.5")
def best_match_nonexclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.best_partners(matching.contingency(_pixels(spark, sf_dir), "image"), "image").withColumn("best_iou", F.round("best_iou", 6))


_METRICS = f"""{_PX}, {_PAIRS}, {_MATCH}, t AS (SELECT image, count(DISTINCT pred) AS n_pred, count(DISTINCT gt) AS n_gt FROM px GROUP BY 1),
  k AS (SELECT image, count(*) AS n, avg(iou) AS mi, avg(abs(sqrt(4 * pa / pi()) - sqrt(4 * ga / pi()))) AS de, avg(abs(pa - ga) / ga) AS ae FROM m GROUP BY 1),
  x AS (SELECT t.image, n_pred, n_gt, COALESCE(n, 0) AS n_matched, COALESCE(mi, 0) AS mi, COALESCE(de, 0) AS de, COALESCE(ae, 0) AS ae, COALESCE(n, 0) / n_pred AS p, COALESCE(n, 0) / n_gt AS r FROM t LEFT JOIN k ON t.image = k.image)"""


@query(f"WITH {_METRICS} SELECT image, n_pred, n_gt, n_matched, round(mi, 6) AS mask_iou_mean, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(p + r, 1e-8), 6) AS instance_f1, round(de, 6) AS diameter_mae, round(ae, 6) AS area_error_mean FROM x")
def instance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.image_metrics(_pixels(spark, sf_dir), "image")
    return found.select("image", "n_pred", "n_gt", "n_matched", *[r6(c(k), k) for k in ("mask_iou_mean", "precision", "recall", "instance_f1", "diameter_mae", "area_error_mean")])


@query(
    f"""WITH {_METRICS} SELECT count(*) AS n_images, round(avg(mi), 6) AS avg_mask_iou_mean, round(avg(2 * p * r / greatest(p + r, 1e-8)), 6) AS avg_instance_f1, CAST(sum(n_matched) AS BIGINT) AS total_n_matched,
    CAST(sum(n_pred - n_matched) AS BIGINT) AS total_false_positives, CAST(sum(n_gt - n_matched) AS BIGINT) AS total_false_negatives, count(*) FILTER (2 * p * r / greatest(p + r, 1e-8) < 0.9 OR mi < 0.85 OR r < 0.9 OR p < 0.9) AS n_review FROM x"""
)
def contour_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.macro_report(matching.image_metrics(_pixels(spark, sf_dir), "image"))
    return found.select("n_images", r6(c("avg_mask_iou_mean"), "avg_mask_iou_mean"), r6(c("avg_instance_f1"), "avg_instance_f1"), "total_n_matched", "total_false_positives", "total_false_negatives", "n_review")


@query(f"WITH {_PX}, a AS (SELECT image, pred, count(*) AS k FROM px GROUP BY 1, 2), b AS (SELECT image, gt, count(*) AS k FROM px GROUP BY 1, 2) SELECT COALESCE(x.image, y.image) AS image, " + ", ".join(f"round(x.p{q} - y.p{q}, 6) AS d{q}_bias" for q in (10, 50, 90)) + " FROM (SELECT image, " + ", ".join(f"quantile_cont(k, {q / 100}) AS p{q}" for q in (10, 50, 90)) + " FROM a GROUP BY 1) x JOIN (SELECT image, " + ", ".join(f"quantile_cont(k, {q / 100}) AS p{q}" for q in (10, 50, 90)) + " FROM b GROUP BY 1) y ON x.image = y.image")
def psd_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _pixels(spark, sf_dir)
    both = matching.instance_areas(px, "image", "pred").select("image", c("area").alias("p"), F.lit(None).cast("bigint").alias("g")).unionByName(matching.instance_areas(px, "image", "gt").select("image", F.lit(None).cast("bigint").alias("p"), c("area").alias("g")))
    found = stats.percentile_bias(both, ["image"], "p", "g")
    return found.select("image", *[r6(c(f"d{q}_bias"), f"d{q}_bias") for q in (10, 50, 90)])


@query(f"WITH {_PX} SELECT image, CAST(1 AS DOUBLE) AS pixel_iou, count(*) FILTER (pred <> gt) AS diff_pixels, round(100 * count(*) FILTER (pred <> gt) / count(*), 6) AS diff_percent, abs(count(DISTINCT pred) - count(DISTINCT gt)) AS instance_diff, TRUE AND (100 * count(*) FILTER (pred <> gt) / count(*) >= 0.1 OR abs(count(DISTINCT pred) - count(DISTINCT gt)) > 2) AS failed FROM px GROUP BY 1")
def alignment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.alignment_row(_pixels(spark, sf_dir), "image", "pred", "gt")
    return found.withColumn("failed", scalars.alignment_failed(c("pixel_iou"), c("diff_percent"), c("instance_diff"))).withColumn("diff_percent", F.round("diff_percent", 6)).withColumn("pixel_iou", F.round("pixel_iou", 6))


#: Grid pixels: each place of a 40 x 40 image once, with the largest label there.
_GRID = "g AS (SELECT image, x, y, max(gt) AS label FROM px GROUP BY ALL)"


@query(
    f"""WITH {_PX}, {_GRID}, s AS (SELECT image, x + dx AS x, y + dy AS y, label FROM g, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)), m AS (SELECT image, x, y, min(label) AS lo, max(label) AS hi FROM s GROUP BY ALL)
    SELECT g.image, g.label, g.x, g.y FROM g JOIN m ON g.image = m.image AND g.x = m.x AND g.y = m.y WHERE lo <> hi"""
)
def label_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _pixels(spark, sf_dir).groupBy("image", "x", "y").agg(F.max("gt").alias("label"))
    return matching.boundary(grid, "image", "label")


@query(f"WITH {_PX}, f AS (SELECT image, gt, min(y * 40 + x) AS p FROM px GROUP BY 1, 2) SELECT image, gt, CAST(dense_rank() OVER (PARTITION BY image ORDER BY p) AS INTEGER) AS new_label FROM f")
def renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _pixels(spark, sf_dir).withColumn("pos", c("y") * 40 + c("x"))
    return sampling.renumber_by_first(px, "image", "gt", "pos").select("image", "gt", "new_label").distinct()


_GRID_SQL = "combos AS (SELECT CAST(t AS DOUBLE) AS t, CAST(s AS DOUBLE) AS s FROM (VALUES (0.0), (0.02), (0.04), (0.06), (0.08)) a(t), (VALUES (1.0), (2.0), (3.0)) b(s))"
_SCORED = f"""{_GRID_SQL}, i AS (SELECT l_orderkey // 64 AS image, t, s, count(*) FILTER (l_discount >= t AND l_tax * 100 >= s) AS n_pred, count(*) AS n_gt, count(*) FILTER (l_discount >= t AND l_tax * 100 >= s AND l_returnflag <> 'R') AS k FROM lineitem, combos GROUP BY ALL),
  f AS (SELECT *, k / greatest(n_pred, 1) AS p, k / greatest(n_gt, 1) AS r FROM i), f1 AS (SELECT *, 2 * p * r / greatest(p + r, 1e-8) AS f1 FROM f),
  sc AS (SELECT t, s, avg(0.8 * f1 + 0.05 * r + 0.05 * p + 0.05 * greatest(0, 1 - abs(n_pred - n_gt) / greatest(n_gt, 1)) + 0.05) AS score, stddev_pop(0.8 * f1 + 0.05 * r + 0.05 * p + 0.05 * greatest(0, 1 - abs(n_pred - n_gt) / greatest(n_gt, 1)) + 0.05) AS sd, avg(f1) AS af, avg(r) AS ar, avg(p) AS ap FROM f1 GROUP BY 1, 2)"""


def _scored_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    combos = tuning.grid(spark, {"t": (0.0, 0.02, 0.04, 0.06, 0.08), "s": (1.0, 2.0, 3.0)})
    kept = (c("l_discount") >= c("t")) & (c("l_tax") * 100 >= c("s"))
    per = tuning.with_grid(table(spark, sf_dir, "lineitem").select(F.floor(c("l_orderkey") / 64).alias("image"), "l_discount", "l_tax", "l_returnflag"), combos).groupBy("image", "t", "s")
    counts = per.agg(F.count_if(kept).alias("n_pred"), F.count("*").alias("n_gt"), F.count_if(kept & (c("l_returnflag") != "R")).alias("k"))
    p, r, f1 = scalars.precision_recall_f1(c("k"), c("n_pred"), c("n_gt"))
    m = counts.withColumns({"p": p, "r": r, "f1": f1})
    score = scalars.selection_score(c("f1"), c("f1"), c("f1"), c("r"), c("p"), c("n_pred"), c("n_gt"), F.lit(0))
    averages = {"instance_f1": c("f1"), "boundary_iou": c("f1"), "mask_iou": c("f1"), "recall": c("r"), "precision": c("p"), "over_split": F.lit(0.0), "n_pred": c("n_pred"), "n_gt": c("n_gt")}
    return tuning.score_grid(m, ["t", "s"], score, averages).withColumn("count_gap", F.abs(c("avg_n_pred") - c("avg_n_gt")))


@query(f"WITH {_SCORED} SELECT t, s, round(score, 6) AS score, round(sd, 6) AS score_std, round(af, 6) AS avg_instance_f1, round(ar, 6) AS avg_recall, round(ap, 6) AS avg_precision FROM sc")
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_grid(spark, sf_dir).select(c("t").cast("decimal(3,2)").cast("double").alias("t"), "s", *[r6(c(k), k) for k in ("score", "score_std", "avg_instance_f1", "avg_recall", "avg_precision")])


@query(f"WITH {_SCORED} SELECT t, s, round(score, 6) AS score FROM sc ORDER BY score DESC, af DESC, ar DESC, ap DESC, t, s LIMIT 5")
def grid_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.best(_scored_grid(spark, sf_dir), then=("t", "s"), k=5).select("t", "s", r6(c("score"), "score"))


@query(f"WITH {_SCORED} SELECT round(max(score), 6) AS best, count(*) FILTER (abs(score - (SELECT max(score) FROM sc)) < 1e-9) AS n_ties FROM sc")
def grid_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuning.ties(_scored_grid(spark, sf_dir)).withColumn("best", F.round("best", 6))


#: Parts as images of 900 to some thousands of pixels.
_IMAGES = "im AS (SELECT p_partkey AS image, CAST(900 + p_size * 40 AS INTEGER) AS h, CAST(900 + (p_partkey * 7) % 2000 AS INTEGER) AS w FROM part)"
_STARTS = "CASE WHEN {0} <= 1024 THEN [0] ELSE list_distinct(list_concat(range(0, {0} - 1024 + 1, 768), [{0} - 1024])) END"
_TILES = f"{_IMAGES}, ty AS (SELECT *, unnest({_STARTS.format('h')}) AS y0 FROM im), tiles AS (SELECT image, h, w, x0, y0, least(x0 + 1024, w) AS x1, least(y0 + 1024, h) AS y1 FROM (SELECT *, unnest({_STARTS.format('w')}) AS x0 FROM ty))"


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select(c("p_partkey").alias("image"), (900 + c("p_size") * 40).cast("int").alias("h"), (900 + (c("p_partkey") * 7) % 2000).cast("int").alias("w"))
    return spatial.tile_grid(sizes, "h", "w")


@query(f"WITH {_TILES} SELECT image, CAST(x0 AS INTEGER) AS x0, CAST(y0 AS INTEGER) AS y0, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, greatest(h, w) > 1536 AS large FROM tiles")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).select("image", "x0", "y0", "x1", "y1", scalars.is_large(c("h"), c("w")).alias("large"))


#: Line items as boxes on the part's image.
_ITEMS = "it AS (SELECT l_partkey AS image, concat_ws('-', l_orderkey, l_suppkey, l_linenumber) AS id, (l_orderkey * 31) % 880 + (l_suppkey * 17) % 900 AS x, (l_suppkey * 13 + l_orderkey * 5) % 880 AS y, 10 + CAST(l_quantity AS BIGINT) AS w, 10 + l_linenumber * 5 AS h FROM lineitem)"
_PARTS = f"""{_TILES}, {_ITEMS}, parts AS (SELECT it.image, id, x0 AS tx, y0 AS ty, x1 - x0 AS tw, y1 - y0 AS th, greatest(x, x0) - x0 AS lx0, greatest(y, y0) - y0 AS ly0, least(x + it.w, x1) - 1 - x0 AS lx1, least(y + it.h, y1) - 1 - y0 AS ly1, tiles.w AS iw, tiles.h AS ih
  FROM it JOIN tiles ON it.image = tiles.image AND x < x1 AND x + it.w > x0 AND y < y1 AND y + it.h > y0)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        c("l_partkey").alias("image"), F.concat_ws("-", "l_orderkey", "l_suppkey", "l_linenumber").alias("id"), ((c("l_orderkey") * 31) % 880 + (c("l_suppkey") * 17) % 900).alias("x"), ((c("l_suppkey") * 13 + c("l_orderkey") * 5) % 880).alias("y"),
        (10 + c("l_quantity").cast("bigint")).alias("w"), (10 + c("l_linenumber") * 5).cast("bigint").alias("h"),
    )


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.boxes_in_tiles(_items(spark, sf_dir), _tiles(spark, sf_dir).withColumnsRenamed({"h": "ih", "w": "iw"}), "image")


@query(f"WITH {_PARTS}, q AS (SELECT *, lx0 <= 0 OR ly0 <= 0 OR lx1 + 1 >= tw OR ly1 + 1 >= th AS cut FROM parts) SELECT image, tx AS tile_x, ty AS tile_y, count(*) FILTER (NOT cut) AS n_kept, count(*) FILTER (cut) AS n_removed, CASE WHEN count(*) FILTER (cut) > 0 THEN concat('removed_truncated_instances=', count(*) FILTER (cut)) ELSE '' END AS notes FROM q GROUP BY 1, 2, 3")
def tile_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.truncation_report(_parts(spark, sf_dir), "image").withColumns({k: c(k).cast("bigint") for k in ("tile_x", "tile_y")})


@query(
    f"""WITH {_PARTS}, q AS (SELECT *, (lx0 + lx1) / 2 AS cx, (ly0 + ly1) / 2 AS cy, CASE WHEN tx = 0 THEN 0 ELSE 128 END AS a, CASE WHEN ty = 0 THEN 0 ELSE 128 END AS b, CASE WHEN tx + tw >= iw THEN tw ELSE tw - 128 END AS c, CASE WHEN ty + th >= ih THEN th ELSE th - 128 END AS d FROM parts)
    SELECT image, id, tx + lx0 AS x, ty + ly0 AS y FROM q WHERE c <= a OR d <= b OR (cx >= a AND cx < c AND cy >= b AND cy < d)"""
)
def core_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    tw, th = c("tx1") - c("tile_x"), c("ty1") - c("tile_y")
    inside = spatial.in_core((c("lx0") + c("lx1")) / 2, (c("ly0") + c("ly1")) / 2, tw, th, c("tile_x") == 0, c("tile_y") == 0, c("tx1") >= c("iw"), c("ty1") >= c("ih"))
    return spatial.to_image(parts.where(inside), ["lx0"], ["ly0"]).select("image", "id", c("lx0").cast("bigint").alias("x"), c("ly0").cast("bigint").alias("y"))


#: Detections: a line item as found in tiles of its order's image, a little displaced in each.
_DETECTIONS = """det AS (SELECT l_orderkey // 16 AS image, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS id, CAST((l_partkey * 37) % 1500 AS DOUBLE) AS x, CAST((l_suppkey * 53) % 1500 AS DOUBLE) AS y, 12 + l_quantity AS w, 12 + l_quantity AS h, l_linenumber % 3 AS tile_x, 0 AS tile_y, l_extendedprice AS confidence FROM lineitem)"""


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = 12 + c("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.floor(c("l_orderkey") / 16).alias("image"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("id"), ((c("l_partkey") * 37) % 1500).cast("double").alias("x"), ((c("l_suppkey") * 53) % 1500).cast("double").alias("y"),
        side.alias("w"), side.alias("h"), (c("l_linenumber") % 3).alias("tile_x"), F.lit(0).alias("tile_y"), c("l_extendedprice").alias("confidence"),
    )


_CANDIDATES = f"""WITH {_DETECTIONS}, p AS (SELECT a.image, a.id AS a, b.id AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h AS aa, b.w * b.h AS ba,
      sqrt((a.x + a.w / 2 - b.x - b.w / 2) ** 2 + (a.y + a.h / 2 - b.y - b.h / 2) ** 2) AS d FROM det a JOIN det b ON a.image = b.image AND a.id < b.id AND (a.tile_x <> b.tile_x OR a.tile_y <> b.tile_y))
    SELECT image, a, b, round(i / (aa + ba - i), 6) AS iou, round(d, 6) AS distance FROM p WHERE i / (aa + ba - i) > 0.5 OR (d <= 50 AND greatest(aa, ba) <= 2 * least(aa, ba))"""


@query(_CANDIDATES)
def cross_tile_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.cross_tile_candidates(_detections(spark, sf_dir), "image", "id")
    return found.select("image", "a", "b", r6(c("iou"), "iou"), r6(c("distance"), "distance"))


@query(
    f"""WITH RECURSIVE c AS ({_CANDIDATES}), {_DETECTIONS}, o AS (SELECT image, id, row_number() OVER (PARTITION BY image ORDER BY confidence DESC, id) AS k FROM det),
      n AS (SELECT image, id, list(other) AS near FROM (SELECT image, a AS id, b AS other FROM c UNION ALL SELECT image, b, a FROM c) GROUP BY ALL),
      s AS (SELECT o.*, COALESCE(near, []) AS near FROM o LEFT JOIN n USING (image, id)),
      g(image, k, kept) AS (SELECT DISTINCT image, 0::BIGINT, []::VARCHAR[] FROM o UNION ALL SELECT g.image, s.k, CASE WHEN list_has_any(s.near, g.kept) THEN g.kept ELSE list_append(g.kept, s.id) END FROM g JOIN s ON s.image = g.image AND s.k = g.k + 1)
    SELECT image, unnest(kept) AS id FROM (SELECT image, kept FROM g QUALIFY row_number() OVER (PARTITION BY image ORDER BY k DESC) = 1)"""
)
def tile_dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections that stay if each, the surest first, drops those after it that may be the same."""
    parts = _detections(spark, sf_dir)
    return graph.kept_in_order(parts, spatial.cross_tile_candidates(parts, "image", "id"), "image", "id", c("confidence"))


_REGIONS = [(100, 0, 200, 4), (150, 2, 420, 6)]


@query(
    f"""WITH {_RUNS}, p AS (SELECT image_id, label, y, unnest(range(x0, x1)) AS x FROM runs)
    SELECT image_id, label, y, count(*) AS n, CAST(sum(x) AS BIGINT) AS sum_x FROM p WHERE NOT (x >= 100 AND x < 200 AND y >= 0 AND y < 4) AND NOT (x >= 150 AND x < 420 AND y >= 2 AND y < 6) GROUP BY 1, 2, 3"""
)
def ignore_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of runs outside two rectangles of each image."""
    runs = _runs(spark, sf_dir)
    box = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), r)]) for r in _REGIONS]))
    regions = runs.select("image_id").distinct().select("image_id", box.alias("r")).select("image_id", "r.*")
    left = runs_table.erased(runs, regions)
    n = c("x1") - c("x0")
    return left.groupBy("image_id", "label", "y").agg(F.sum(n).alias("n"), F.sum((c("x0") + c("x1") - 1) * n / 2).cast("bigint").alias("sum_x"))


@query(f"WITH {_TILES} SELECT image, x0 AS tile_x, y0 AS tile_y, greatest(500, x0) - x0 AS x0, greatest(600, y0) - y0 AS y0, least(1500, x1) - x0 AS x1, least(1000, y1) - y0 AS y1 FROM tiles WHERE x1 > 500 AND x0 < 1500 AND y1 > 600 AND y0 < 1000")
def region_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rectangle of each image, cut to the tiles that it meets."""
    tiles = _tiles(spark, sf_dir)
    regions = tiles.select("image").distinct().select("image", *[F.lit(v).alias(k) for k, v in (("x0", 500), ("y0", 600), ("x1", 1500), ("y1", 1000))])
    return reduce(lambda df, k: df.withColumn(k, c(k).cast("bigint")), ("tile_x", "tile_y", "x0", "y0", "x1", "y1"), spatial.regions_in_tiles(regions, tiles, "image"))


@query(
    f"""WITH {_RUNS}, t AS (SELECT * FROM (VALUES (0), (300), (600)) a(tx)) SELECT image_id, tx AS tile_x, label, CAST(sum(least(x1, tx + 400) - greatest(x0, tx)) AS BIGINT) AS area FROM runs, t WHERE x0 < tx + 400 AND x1 > tx GROUP BY 1, 2, 3"""
)
def tile_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    tiles = runs.select("image_id").distinct().withColumn("x0", F.explode(F.array(F.lit(0), F.lit(300), F.lit(600)))).select("image_id", "x0", F.lit(0).alias("y0"), (c("x0") + 400).alias("x1"), F.lit(400).alias("y1"))
    return spatial.clip_runs(runs, tiles).groupBy("image_id", "tile_x", "label").agg(F.sum(c("x1") - c("x0")).alias("area"))


_HIST = "hist AS (SELECT l_orderkey // 4096 AS image, l_partkey % 20 AS x, l_suppkey % 20 AS y, count(*) AS n FROM lineitem GROUP BY ALL)"


@query(
    f"""WITH {_HIST}, s AS (SELECT h.* FROM hist h WHERE n > 10 AND NOT EXISTS (SELECT 1 FROM hist k WHERE k.image = h.image AND abs(k.x - h.x) <= 2 AND abs(k.y - h.y) <= 2 AND k.n > h.n))
    SELECT image, x, y, n, CAST(row_number() OVER (PARTITION BY image ORDER BY n, y, x) AS INTEGER) AS seed FROM s"""
)
def sink_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = table(spark, sf_dir, "lineitem").groupBy(F.floor(c("l_orderkey") / 4096).alias("image"), (c("l_partkey") % 20).alias("x"), (c("l_suppkey") % 20).alias("y")).agg(F.count("*").alias("n"))
    return spatial.sink_seeds(hist, "image")


@query(
    """WITH r AS (SELECT l_orderkey AS image, CAST(l_quantity AS BIGINT) AS n, row_number() OVER w AS k, CAST(sum(l_quantity) OVER w AS BIGINT) AS stop FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
    SELECT image, stop - n AS start, stop, (stop - n) // 30 AS x, (stop - n) % 30 AS y FROM r WHERE k % 2 = 0"""
)
def rle_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("image"), c("l_quantity").cast("bigint").alias("n"), *_BOX_ORDER)
    return spatial.rle_runs(rows, "image", list(_BOX_ORDER), "n", 30)


_LINKED = """RECURSIVE g AS (SELECT DISTINCT l_orderkey // 256 AS image, l_partkey % 20 AS x, l_suppkey % 20 AS y FROM lineitem WHERE l_discount < 0.03),
      reach(image, x, y, root) AS (SELECT image, x, y, y * 20 + x FROM g UNION SELECT g.image, g.x, g.y, r.root FROM reach r JOIN g ON g.image = r.image AND abs(g.x - r.x) <= 1 AND abs(g.y - r.y) <= 1),
      f AS (SELECT image, x, y, min(root) AS root FROM reach GROUP BY 1, 2, 3)"""


def _thresholded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of thresholded images of 20 x 20."""
    items = table(spark, sf_dir, "lineitem").where("l_discount < 0.03")
    return runs_table.of_pixels(items.select(F.floor(c("l_orderkey") / 256).alias("image"), (c("l_partkey") % 20).alias("x"), (c("l_suppkey") % 20).alias("y")), whole=False)


@query(f"WITH {_LINKED} SELECT image, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(dense_rank() OVER (PARTITION BY image ORDER BY root) AS INTEGER) AS label FROM f")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of thresholded images, as a graph of runs."""
    found = runs_table.pixels(runs_table.components(_thresholded(spark, sf_dir)))
    return found.select("image", *[c(k).cast("int").alias(k) for k in ("y", "x", "label")])


@query(f"WITH {_LINKED}, n AS (SELECT image, root, count(*) AS area, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y FROM f GROUP BY 1, 2) SELECT image, area, min_x, max_x, min_y FROM n WHERE area >= 3")
def components_of_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same images cut to tiles of 7 x 7, whose runs are put together again: components reach across borders."""
    runs = _thresholded(spark, sf_dir).withColumn("label", F.lit(1))
    size = F.explode(F.array(F.lit(0), F.lit(7), F.lit(14)))
    tiles = runs.select("image").distinct().withColumn("x0", size).withColumn("y0", size).withColumn("x1", c("x0") + 7).withColumn("y1", c("y0") + 7)
    parts = spatial.to_image(spatial.clip_runs(runs, tiles, "image"), ["x0", "x1"], ["y"])
    found = runs_table.components(parts, min_area=3)
    return found.groupBy("image", "label").agg(F.sum(c("x1") - c("x0")).alias("area"), F.min("x0").alias("min_x"), (F.max("x1") - 1).alias("max_x"), F.min("y").alias("min_y")).drop("label")


#: Squares in cells of 12 x 12: one for each cell of an image that has items; side 6 to 10, and odd or even.
_SQUARES = (
    "SELECT l_orderkey // 64 AS image, (l_suppkey % 5) * 12 AS min_y, (l_partkey % 5) * 12 AS min_x, 6 + CAST(min(l_quantity) AS BIGINT) % 5 AS s, CAST(sum(l_linenumber) AS BIGINT) % 2 AS odd "
    "FROM lineitem GROUP BY 1, 2, 3"
)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, y0, x0, s, odd, v): a row for each square; v is its cell's number."""
    items = table(spark, sf_dir, "lineitem").select(F.floor(c("l_orderkey") / 64).alias("image"), (c("l_suppkey") % 5 * 12).alias("y0"), (c("l_partkey") % 5 * 12).alias("x0"), "l_quantity", "l_linenumber")
    cells = items.groupBy("image", "y0", "x0").agg((F.min("l_quantity").cast("bigint") % 5 + 6).alias("s"), (F.sum("l_linenumber") % 2).alias("odd"))
    return cells.withColumn("v", (c("y0") / 12 * 5 + c("x0") / 12 + 1).cast("int"))


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, y, x, v, iy, ix, s, odd): the pixels of the squares; v is the cell's number, iy and ix count from the square's corner."""
    side = F.sequence(F.lit(0), c("s").cast("int") - 1)
    pixels = _cells(spark, sf_dir).withColumn("iy", F.explode(side)).withColumn("ix", F.explode(side))
    return pixels.select("image", (c("y0") + c("iy")).alias("y"), (c("x0") + c("ix")).alias("x"), "v", "iy", "ix", "s", "odd")


def _square_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, y, x0, x1, v, odd): the rows of the squares, partitioned by image."""
    # A cell is a short row and long work: as many tasks as there are partitions, whatever few bytes they hold.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = _cells(spark, sf_dir).repartition(tasks, "image")
    return cells.select("image", F.explode(F.sequence("y0", c("y0") + c("s") - 1)).alias("y"), "x0", (c("x0") + c("s")).alias("x1"), "v", "odd")


def _measured_squares(found: DataFrame) -> DataFrame:
    return found.groupBy("image", "label").agg(F.min("y").cast("bigint").alias("min_y"), F.min("x0").cast("bigint").alias("min_x"), F.sum(c("x1") - c("x0")).alias("area")).drop("label")


@query(f"SELECT image, min_y, min_x, s * s AS area FROM ({_SQUARES})")
def euler_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances found again by following the flow of each image's squares."""

    def again(images: list[list[np.ndarray]]) -> list[np.ndarray]:
        maps = [labels for (labels,) in images]
        return raster.postprocessed([(5 * dy, 5 * dx, np.where(labels > 0, 5.0, -5.0)) for labels, (dy, dx) in zip(maps, raster.flows_of_masks(maps))], least=20)

    return _measured_squares(raster.by_images(_square_runs(spark, sf_dir), "image", ["v"], again))


@query(f"SELECT image, min_y, min_x, s * s AS area FROM ({_SQUARES}) WHERE odd = 0")
def flow_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The odd squares have a constant flow, which isn't theirs, and go; the others have their own and stay."""

    def checked(images: list[list[np.ndarray]]) -> list[np.ndarray]:
        flows = raster.flows_of_masks([labels for labels, _ in images])
        return raster.drop_bad_flows([(labels, np.where(odd > 0, 5.0, 5 * dy), np.where(odd > 0, 5.0, 5 * dx)) for (labels, odd), (dy, dx) in zip(images, flows)])

    return _measured_squares(raster.by_images(_square_runs(spark, sf_dir), "image", ["v", "odd"], checked))


@query(f"SELECT image, min_y, min_x, CASE WHEN odd = 0 THEN s * s ELSE s * s - (s - 4) * (s - 4) - 2 END AS area FROM ({_SQUARES})")
def hole_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares with a hole, which the odd ones have a way into: only the others are filled."""
    wall = (F.least("iy", "ix") < 2) | (F.greatest("iy", "ix") >= c("s") - 2)
    way = (c("odd") == 1) & (c("ix") == 2) & (c("iy") < 2)
    rings = _squares(spark, sf_dir).where(wall & ~way)
    found = runs_table.fill_holes(runs_table.of_pixels(rings, ["image", "v"], whole=False), "image", "v")
    return found.groupBy("image", "v").agg(F.min("y").alias("min_y"), F.min("x0").alias("min_x"), F.sum(c("x1") - c("x0")).alias("area")).drop("v")
