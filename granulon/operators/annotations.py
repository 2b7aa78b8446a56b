"""Annotation tables: validity, repair, audits, merging of several documents, label maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granulon.operators import audit, dedup

POLYGONS = "array<array<double>>"


def polygons(segmentation: Column) -> Column:
    """The polygons of a segmentation's JSON text; null where it is none or a run-length code."""
    return F.when(F.trim(segmentation).startswith("["), F.from_json(segmentation, POLYGONS))


def valid_segmentation(segmentation: Column) -> Column:
    """Polygons of at least three points each, or a run-length code with counts and size."""
    p = polygons(segmentation)
    coded = F.get_json_object(segmentation, "$.counts").isNotNull() & F.get_json_object(segmentation, "$.size").isNotNull()
    return F.coalesce((F.size(p) > 0) & F.forall(p, lambda x: (F.size(x) >= 6) & (F.size(x) % 2 == 0)), coded, F.lit(False))


def valid_box(box: Column) -> Column:
    """Four numbers, the last two positive."""
    return F.coalesce((F.size(box) == 4) & (F.try_element_at(box, F.lit(3)) > 0) & (F.try_element_at(box, F.lit(4)) > 0), F.lit(False))


def box_of_polygon(polygon: Column) -> Column:
    """The box (x, y, w, h) of a flat polygon x, y, x, y, ...; null if it has no area."""
    xs, ys = F.filter(polygon, lambda v, i: i % 2 == 0), F.filter(polygon, lambda v, i: i % 2 == 1)
    box = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    return F.when(valid_box(box), box)


def repaired(annotations: DataFrame, box: str = "bbox", segmentation: str = "segmentation") -> DataFrame:
    """annotations with valid boxes: their own, or that of the first polygon; rows without either go."""
    first = F.try_element_at(polygons(F.col(segmentation)), F.lit(1))
    fixed = F.when(valid_box(F.col(box)), F.col(box)).otherwise(box_of_polygon(first))
    return annotations.withColumn(box, fixed).where(F.col(box).isNotNull())


def instances(annotations: DataFrame, crowd: str = "iscrowd") -> DataFrame:
    """annotations of single instances: no crowds."""
    return annotations.where(F.coalesce(crowd, F.lit(0)) == 0)


def checks(images: DataFrame, annotations: DataFrame, files: DataFrame) -> DataFrame:
    """(check, item) of everything that is wrong: names on one side only, orphans, bad boxes and segmentations.

    images (id, file_name), annotations (id, image_id, bbox, segmentation), files (file_name).
    """
    names = audit.name_differences(images, files, "file_name", "not_on_disk", "not_in_document").select(F.col("status").alias("check"), F.col("file_name").alias("item"))
    item = lambda df, name: df.select(F.lit(name).alias("check"), F.col("id").cast("string").alias("item"))
    lost = item(audit.orphans(annotations, images, "image_id", "id"), "orphan")
    boxes = item(annotations.where(~valid_box(F.col("bbox"))), "bad_box")
    shapes = item(annotations.where(~valid_segmentation(F.col("segmentation"))), "bad_segmentation")
    return names.unionByName(lost).unionByName(boxes).unionByName(shapes)


def on_disk(images: DataFrame, annotations: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images whose file exists and isn't a mask, and their annotations."""
    kept = audit.kept_with(images, files, "file_name", "file_name").where(~F.col("file_name").contains("_mask."))
    return kept, audit.kept_with(annotations, kept, "image_id", "id")


def merged(documents: Sequence[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Several (images, annotations) as one: of a file name the first document's image, with new ids and its annotations."""
    every, parts = None, None
    for k, (images, annotations) in enumerate(documents):
        i = images.withColumn("_doc", F.lit(k))
        a = annotations.withColumn("_doc", F.lit(k))
        every = i if every is None else every.unionByName(i)
        parts = a if parts is None else parts.unionByName(a)
    images = dedup.renumbered(dedup.first_wins(every, ["file_name"], ["_doc", "id"]), ["_doc", "id"])
    ids = images.select("_doc", F.col("id").alias("image_id"), F.col("new_id").alias("_image"))
    annotations = dedup.renumbered(parts.join(ids, ["_doc", "image_id"]), ["_image", "_doc", "id"])
    return (
        images.withColumn("id", F.col("new_id")).drop("_doc", "new_id"),
        annotations.withColumn("id", F.col("new_id")).withColumn("image_id", F.col("_image")).drop("_doc", "_image", "new_id"),
    )


def overlay(runs: DataFrame, image: str, order: str, cell: Sequence[str]) -> DataFrame:
    """(image, cell..., label): where annotations overlap, the later one; labels 1, 2, ... by order of what is left of them."""
    top = runs.groupBy(image, *cell).agg(F.max(order).alias("_o"))
    numbers = top.select(image, "_o").distinct().withColumn("label", F.row_number().over(Window.partitionBy(image).orderBy("_o")))
    return top.join(numbers, [image, "_o"]).select(image, *cell, "label")


def label_rules(pixels: DataFrame, image: str, label: str, most_fraction: float = 0.8, allow_empty: bool = False) -> DataFrame:
    """(image, rule) of label maps that can't be used: negative labels, no background, no instance, one too large."""
    counts = pixels.groupBy(image, label).agg(F.count("*").alias("_n"))
    whole = counts.groupBy(image).agg(
        F.sum("_n").alias("_all"), F.count_if(F.col(label) < 0).alias("_neg"), F.count_if(F.col(label) == 0).alias("_zero"), F.count_if(F.col(label) > 0).alias("_some"), F.max(F.when(F.col(label) > 0, F.col("_n"))).alias("_top")
    )
    c = F.col
    rules = [(c("_neg") > 0, "negative_label"), (c("_zero") == 0, "no_background"), (c("_top") > c("_all") * most_fraction, "too_large")]
    if not allow_empty:
        rules.append((c("_some") == 0, "no_instance"))
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))
    return whole.select(image, F.explode(broken).alias("rule"))


def set_leaks(train: DataFrame, val: DataFrame, name: str, pattern: str = r"set(\d+)") -> DataFrame:
    """(set_id) of sets whose files are on both sides."""
    of = lambda df: df.select(F.regexp_extract(name, pattern, 1).alias("set_id")).where("set_id <> ''")
    return audit.common_keys(of(train), of(val), "set_id")


def clean_plan(images: DataFrame, annotations: DataFrame, files: DataFrame) -> DataFrame:
    """(step, before, after) of a clean-up, without doing it."""
    kept, own = on_disk(images, annotations, files)
    steps = [("images", images, kept), ("annotations", annotations, own), ("boxes", own, repaired(own))]
    count = lambda df, step, side: df.agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), F.lit(side).alias("side"), "n")
    rows = None
    for step, before, after in steps:
        both = count(before, step, "before").unionByName(count(after, step, "after"))
        rows = both if rows is None else rows.unionByName(both)
    return rows.groupBy("step").agg(F.max(F.when(F.col("side") == "before", F.col("n"))).alias("before"), F.max(F.when(F.col("side") == "after", F.col("n"))).alias("after"))
