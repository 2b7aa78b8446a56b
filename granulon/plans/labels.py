"""Annotation and label-map queries; line items stand for annotations, customers and suppliers for images."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulon.operators import annotations, flows, raster, runs, stats
from granulon.plans.registry import Query, adder
from granulon.session import table

QUERIES: dict[str, tuple[Query, str | None]] = {}
query = adder(QUERIES)
c = F.col

_KEY = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
#: Annotations of orders: boxes without a width where the discount is 0, then with a polygon of two or three points.
_ANN = f"""ann AS (SELECT {_KEY} AS id, l_orderkey AS image_id, CAST(l_partkey % 100 AS DOUBLE) AS x, CAST(l_suppkey % 100 AS DOUBLE) AS y, CASE WHEN l_discount = 0 THEN 0.0::DOUBLE ELSE l_quantity END AS w, l_quantity AS h, l_linenumber % 2 = 0 AS triangle, l_tax < 0.02 AS crowd FROM lineitem)"""


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, q = (c("l_partkey") % 100).cast("double"), (c("l_suppkey") % 100).cast("double"), c("l_quantity")
    width = F.when(c("l_discount") == 0, 0.0).otherwise(q)
    corners = F.when(c("l_linenumber") % 2 == 0, F.array(x, y, x + q, y, x + q, y + q)).otherwise(F.array(x, y, x + q, y))
    return table(spark, sf_dir, "lineitem").select(
        F.expr(_KEY).alias("id"), c("l_orderkey").alias("image_id"), F.array(x, y, width, q).alias("bbox"), F.to_json(F.array(corners)).alias("segmentation"), (c("l_tax") < 0.02).cast("int").alias("iscrowd")
    )


@query(f"WITH {_ANN} SELECT id, x AS bx, y AS by, CASE WHEN w > 0 THEN w ELSE h END AS bw, h AS bh FROM ann WHERE w > 0 OR triangle")
def bbox_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polygon of two points has no height, so it can't mend a box."""
    got = annotations.repaired(_annotations(spark, sf_dir))
    return got.select("id", *[F.element_at("bbox", k + 1).alias(n) for k, n in enumerate(("bx", "by", "bw", "bh"))])


@query(f"WITH {_ANN} SELECT count(*) AS n, count(*) FILTER (w > 0) AS good_boxes, count(*) FILTER (triangle) AS good_segmentations FROM ann WHERE NOT crowd")
def annotation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotations.instances(_annotations(spark, sf_dir))
    return rows.agg(F.count("*").alias("n"), F.count_if(annotations.valid_box(c("bbox"))).alias("good_boxes"), F.count_if(annotations.valid_segmentation(c("segmentation"))).alias("good_segmentations"))


@query(
    f"""WITH {_ANN}, i AS (SELECT o_orderkey AS id, concat('o', o_orderkey, '.png') AS f FROM orders WHERE o_orderstatus <> 'P'), d AS (SELECT concat('o', o_orderkey, '.png') AS f FROM orders WHERE o_orderstatus <> 'O'), k AS (SELECT f FROM i WHERE f IN (SELECT f FROM d))
    SELECT 'not_on_disk' AS "check", f AS item FROM i WHERE f NOT IN (SELECT f FROM d) UNION ALL SELECT 'not_in_document', f FROM d WHERE f NOT IN (SELECT f FROM i)
    UNION ALL SELECT 'orphan', id FROM ann WHERE image_id NOT IN (SELECT id FROM i) UNION ALL SELECT 'bad_box', id FROM ann WHERE NOT w > 0 UNION ALL SELECT 'bad_segmentation', id FROM ann WHERE NOT triangle"""
)
def annotation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished and open orders are in the document, finished and pending ones on disk."""
    orders = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), F.concat(F.lit("o"), c("o_orderkey").cast("string"), F.lit(".png")).alias("file_name"), "o_orderstatus")
    return annotations.checks(orders.where("o_orderstatus <> 'P'").drop("o_orderstatus"), _annotations(spark, sf_dir), orders.where("o_orderstatus <> 'O'").select("file_name"))


_MERGE = """im AS (SELECT 0 AS d, c_custkey AS id, concat('n', c_nationkey, '_', c_custkey % 50) AS f FROM customer UNION ALL SELECT 1, s_suppkey, concat('n', s_nationkey, '_', s_suppkey % 50) FROM supplier),
  own AS (SELECT *, row_number() OVER (ORDER BY d, id) AS new_id FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY d, id) AS r FROM im) WHERE r = 1),
  an AS (SELECT 0 AS d, o_orderkey AS id, o_custkey AS image_id FROM orders UNION ALL SELECT 1, p_partkey, p_partkey % 100 + 1 FROM part),
  kept AS (SELECT row_number() OVER (ORDER BY new_id, an.d, an.id) AS id, new_id AS image_id FROM an JOIN own ON an.d = own.d AND an.image_id = own.id)"""


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    name = lambda nation, key: F.concat(F.lit("n"), c(nation).cast("string"), F.lit("_"), (c(key) % 50).cast("string")).alias("file_name")
    customers = table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), name("c_nationkey", "c_custkey"))
    suppliers = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("id"), name("s_nationkey", "s_suppkey"))
    orders = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), c("o_custkey").alias("image_id"))
    parts = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), (c("p_partkey") % 100 + 1).alias("image_id"))
    return annotations.merged([(customers, orders), (suppliers, parts)])


@query(f"WITH {_MERGE} SELECT new_id AS id, f AS file_name FROM own")
def merged_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[0].select("id", "file_name")


@query(f"WITH {_MERGE} SELECT id, image_id FROM kept")
def merged_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[1].select("id", "image_id")


@query("SELECT DISTINCT CAST(l_suppkey % 13 AS VARCHAR) AS set_id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT DISTINCT CAST(l_suppkey % 13 AS VARCHAR) FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey % 13 > 4")
def set_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("nist_set"), (c("l_suppkey") % 13).cast("string"), F.lit("_a.png")).alias("name"), "l_returnflag", "l_suppkey")
    return annotations.set_leaks(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A' AND l_suppkey % 13 > 4"), "name")


_CELLS = "cells AS (SELECT l_orderkey // 64 AS image, l_partkey % 12 AS x, l_suppkey % 12 AS y, l_linenumber * 1000 + l_orderkey % 64 AS o FROM lineitem)"


@query(f"WITH {_CELLS}, top AS (SELECT image, x, y, max(o) AS o FROM cells GROUP BY ALL) SELECT image, x, y, CAST(dense_rank() OVER (PARTITION BY image ORDER BY o) AS INTEGER) AS label FROM top")
def annotation_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(F.floor(c("l_orderkey") / 64).alias("image"), (c("l_partkey") % 12).alias("x"), (c("l_suppkey") % 12).alias("y"), (c("l_linenumber") * 1000 + c("l_orderkey") % 64).alias("o"))
    return annotations.overlay(cells, "image", "o", ["x", "y"])


@query(
    """WITH v AS (SELECT l_orderkey // 4 AS image, CAST(l_linenumber - 2 AS INTEGER) AS label, count(*) AS n FROM lineitem GROUP BY ALL), w AS (SELECT image, sum(n) AS a, count(*) FILTER (label < 0) AS neg, count(*) FILTER (label = 0) AS z, count(*) FILTER (label > 0) AS s, max(n) FILTER (label > 0) AS t FROM v GROUP BY 1)
    SELECT image, 'negative_label' AS rule FROM w WHERE neg > 0 UNION ALL SELECT image, 'no_background' FROM w WHERE z = 0 UNION ALL SELECT image, 'too_large' FROM w WHERE t > a * 0.3 UNION ALL SELECT image, 'no_instance' FROM w WHERE s = 0"""
)
def label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.floor(c("l_orderkey") / 4).alias("image"), (c("l_linenumber") - 2).cast("int").alias("label"))
    return annotations.label_rules(rows, "image", "label", most_fraction=0.3)


@query(
    f"""WITH {_ANN} SELECT concat_ws('-', id, CAST(h AS BIGINT)) AS id, CAST((SELECT sum(greatest(0, least(128, x + h + 1) - (x + d))) FROM range(0, CAST(h AS BIGINT)) t(d) WHERE y + d < 128) AS BIGINT) AS area, CAST(y AS BIGINT) AS first_y FROM ann WHERE triangle"""
)
def polygon_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of triangles with two sides along the axes, by scan lines, clipped to 128 x 128."""
    notes = _annotations(spark, sf_dir).withColumn("polygons", F.from_json("segmentation", "array<array<double>>"))
    # Some items have the same key: with the height it is a row's own.
    rows = notes.withColumn("id", F.concat_ws("-", "id", F.element_at("bbox", 4).cast("bigint").cast("string")))
    found = runs.of_polygons(rows, ["id"], "polygons", F.lit(128), F.lit(128))
    return found.groupBy("id").agg(F.sum(c("x1") - c("x0")).alias("area"), F.min("y").alias("first_y"))


@query(
    """WITH a AS (SELECT l_orderkey // 16 AS image, l_partkey % 40 AS x, l_suppkey % 40 AS y, 4 + l_linenumber AS s, (l_orderkey % 16) * 100 + l_linenumber AS o FROM lineitem),
    p AS (SELECT image, o, x + i AS px, y + j AS py FROM a, range(0, 12) u(i), range(0, 12) v(j) WHERE i <= s AND j < s),
    t AS (SELECT image, px, py, max(o) AS o FROM p GROUP BY 1, 2, 3)
    SELECT image AS image_id, CAST(dense_rank() OVER (PARTITION BY image ORDER BY o) AS INTEGER) AS label, n, sum_x, sum_y FROM (SELECT image, o, count(*) AS n, CAST(sum(px) AS BIGINT) AS sum_x, CAST(sum(py) AS BIGINT) AS sum_y FROM t GROUP BY 1, 2)"""
)
def polygon_label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label maps of squares that cover one another, as runs; a square without a visible pixel has no number."""
    x, y, side = c("l_partkey") % 40, c("l_suppkey") % 40, 4 + c("l_linenumber")
    items = table(spark, sf_dir, "lineitem").select(F.floor(c("l_orderkey") / 16).alias("image_id"), ((c("l_orderkey") % 16) * 100 + c("l_linenumber")).alias("o"), F.array(x, y, x + side, y, x + side, y + side, x, y + side).alias("p"))
    rows = items.select("image_id", "o", F.array("p").alias("polygons"), F.lit(64).alias("h"), F.lit(64).alias("w"))
    found = flows.label_map(rows, "o")
    n = c("x1") - c("x0")
    sums = found.groupBy("image_id", "label").agg(F.sum(n).alias("n"), F.sum(((c("x0") + c("x1") - 1) * n / 2).cast("bigint")).alias("sum_x"), F.sum(c("y") * n).alias("sum_y"))
    return sums.withColumn("label", c("label").cast("int"))


@query()
def form_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median circularity and solidity of the components of thresholded images; contours are beyond SQL."""
    grid = table(spark, sf_dir, "lineitem").where("l_discount < 0.03").select(F.floor(c("l_orderkey") / 256).alias("image"), (c("l_partkey") % 20).alias("x"), (c("l_suppkey") % 20).alias("y")).distinct().withColumn("v", F.lit(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = raster.components(raster.to_array(pdf, "v"), min_area=4)
        found = [raster.form_metrics(labels == i) for i in sorted(set(labels[labels > 0].tolist()))]
        return pd.DataFrame({"image": pdf["image"].iloc[0], "circularity": [m["circularity"] for m in found], "solidity": [m["solidity"] for m in found]})

    each = grid.groupBy("image").applyInPandas(run, "image bigint, circularity double, solidity double")
    return each.groupBy("image").agg(F.count("*").alias("n"), stats.percentile("circularity", 50).alias("circularity_median"), stats.percentile("solidity", 50).alias("solidity_median"))
