"""Recipes and inference settings: documents made from orders, with faults by their keys, against the schema's own file."""

from __future__ import annotations

import json
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granulon.operators import schema
from granulon.plans.registry import Query, adder
from granulon.session import table

QUERIES: dict[str, tuple[Query, str | None]] = {}
query = adder(QUERIES)
c = F.col


@cache
def recipe_schema() -> dict:
    return json.loads((Path(__file__).parent / "recipe.schema.json").read_text())


def _recipe(fault: Column, key: Column, size: Column, priority: Column) -> Column:
    """A recipe as JSON text; what a fault takes away is null, and to_json leaves nulls out."""
    unless = lambda n, value, other=None: F.when(fault == n, F.lit(other) if not isinstance(other, Column) else other).otherwise(value)
    obj = lambda **m: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in m.items()])
    three = F.array(F.lit(0.5), F.lit(0.4), F.lit(0.3))
    scale = obj(has_scale=unless(3, F.lit(False), True), pixel_size=F.when(fault == 3, 0.25))
    region = F.when(fault == 9, F.array(obj(x=-1, y=0, width=F.lit(0), height=size)))
    resolved = obj(
        preprocessing=obj(input_size=unless(5, F.lit(1024).cast("bigint"), size), output_stride=4, mean=unless(8, three, F.slice(three, 1, 2)), std=three, pad_value=114),
        flow_dynamics=obj(euler_cellprob_threshold_logit=0.0, fd_cellprob_threshold=-1.5, fd_niter=unless(4, F.lit(200).cast("bigint"), size), fd_min_size=unless(7, F.lit("15").cast("string")), fd_flow_threshold=0.4, fd_max_size_fraction=1),
        runtime=obj(tile_size=1024, tile_overlap=256, tile_core_margin=128, edge_touch_margin_px=1, boundary_particle_policy="include", deduplicate_overlap_masks=unless(10, F.lit(True), False), ignore_regions=region),
        statistics=obj(min_diameter_px=3),
    )
    whole = obj(
        schema_version=1, analysis_mode=unless(1, F.lit("standard"), priority), model_source=obj(onnx_dir="m", flow_inference_config="c"), user_parameters=obj(minimum_detectable_diameter=0.5, diameter_unit="um", boundary_particle_policy="exclude"),
        advanced_overrides=obj(enabled=False), scale=unless(2, scale), resolved_parameters=resolved, review=obj(status="reviewed", edited=False, final_label_source="auto", edit_counts=obj(added=1)), extra=F.when(fault == 6, key),
    )
    text = F.to_json(whole)
    # Sizes are whole numbers but in fault 7, where fd_min_size is missing as a number and comes as a text.
    text = F.regexp_replace(text, r'"fd_min_size":"15"', '"fd_min_size":15')
    text = F.when(fault == 7, F.regexp_replace(text, r'"fd_niter"', '"fd_min_size":"many","fd_niter"')).otherwise(text)
    return F.when(fault == 11, F.substring(text, 1, 40)).otherwise(text)


@query(
    """
    WITH o AS (SELECT o_orderkey AS id, o_orderkey % 12 AS f, o_custkey AS size FROM orders)
    SELECT id, '$.analysis_mode' AS path, 'enum' AS rule FROM o WHERE f = 1 UNION ALL SELECT id, '$.scale', 'required' FROM o WHERE f = 2
    UNION ALL SELECT id, unnest(['$.scale.pixel_size_unit', '$.scale.source', '$.resolved_parameters.statistics.min_diameter_um']), 'required' FROM o WHERE f = 3
    UNION ALL SELECT id, '$.resolved_parameters.flow_dynamics.fd_niter', CASE WHEN size < 1 THEN 'minimum' ELSE 'maximum' END FROM o WHERE f = 4 AND NOT size BETWEEN 1 AND 500
    UNION ALL SELECT id, '$.resolved_parameters.preprocessing.input_size', CASE WHEN size < 512 THEN 'minimum' ELSE 'maximum' END FROM o WHERE f = 5 AND NOT size BETWEEN 512 AND 4096
    UNION ALL SELECT id, '$.extra', 'additionalProperties' FROM o WHERE f = 6 UNION ALL SELECT id, '$.resolved_parameters.flow_dynamics.fd_min_size', 'type' FROM o WHERE f = 7
    UNION ALL SELECT id, '$.resolved_parameters.preprocessing.mean', 'minItems' FROM o WHERE f = 8
    UNION ALL SELECT id, concat('$.resolved_parameters.runtime.ignore_regions[0].', unnest(CASE WHEN size < 1 THEN ['x', 'width', 'height'] ELSE ['x', 'width'] END)), 'minimum' FROM o WHERE f = 9
    UNION ALL SELECT id, '$.resolved_parameters.runtime.deduplicate_overlap_masks', 'const' FROM o WHERE f = 10 UNION ALL SELECT id, '$', 'json' FROM o WHERE f = 11
    """
)
def recipe_schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order's recipe violates of the recipe schema, whose file is the only list of rules."""
    key = c("o_orderkey")
    # A document takes far longer to check than its order to read, and a small file is read by few tasks: orders are dealt to all cores first.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    orders = table(spark, sf_dir, "orders").select(key, "o_custkey", "o_orderpriority").repartition(tasks, key)
    rows = orders.select(key.alias("id"), _recipe(key % 12, key, c("o_custkey"), c("o_orderpriority")).alias("doc"))
    return schema.violated(rows, "doc", recipe_schema())
