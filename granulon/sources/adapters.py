"""Collections of images and masks as pairs: each adapter is a join of listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granulon.functions.scalars import noise_contrast_kept
from granulon.operators.audit import key_collisions, pair_audit
from granulon.sources import readers


def paired(images: DataFrame, masks: DataFrame, image_key: Column, mask_key: Column) -> DataFrame:
    """(key, image_path, mask_path), by key; either path may be null. Two masks of one key are an error."""
    a = images.select(image_key.alias("key"), F.col("path").alias("image_path"))
    b = masks.select(mask_key.alias("key"), F.col("path").alias("mask_path"))
    one = b.groupBy("key").agg(F.min("mask_path").alias("mask_path"), F.count("*").alias("_n"))
    checked = one.select("key", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several masks for "), F.col("key")))).otherwise(F.col("mask_path")).alias("mask_path"))
    return a.join(checked, "key", "full_outer")


def _stem(suffix: str = "") -> Column:
    return F.regexp_replace("stem", f"{suffix}$", "") if suffix else F.col("stem")


def emps(spark: SparkSession, root: str) -> DataFrame:
    return paired(readers.images(spark, f"{root}/images"), readers.images(spark, f"{root}/segmaps"), _stem(), _stem())


def nist(spark: SparkSession, root: str) -> DataFrame:
    """Images of each set with their set's one mask; images with too much noise or too little contrast are left out."""
    number = F.regexp_extract("path", r"set(\d+)", 1)
    kept = readers.listing(spark, f"{root}/intensity_sets", recursive=True).where(readers.is_image(F.col("path")) & noise_contrast_kept(F.col("stem")))
    masks = readers.listing(spark, f"{root}/masks", recursive=True).where(readers.is_image(F.col("path"), True)).select(number.alias("set_id"), F.col("path").alias("mask_path"))
    return kept.select(number.alias("set_id"), F.col("stem").alias("key"), F.col("path").alias("image_path")).join(masks, "set_id", "left")


def nnp(spark: SparkSession, root: str) -> DataFrame:
    """Sub-folders with image and target, or img and gt with names that end in _gt."""
    every = readers.listing(spark, root, recursive=True).where(readers.is_image(F.col("path"), True))
    folder, part = F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    key = F.concat_ws("/", folder, F.regexp_replace("stem", "_gt$", ""))
    return paired(every.where(part.isin("image", "img")), every.where(part.isin("target", "gt")), key, key)


def tio2(spark: SparkSession, root: str, layouts=(("images", "masks"), ("img", "mask"), ("image", "label"))) -> DataFrame:
    """The first of several folder layouts that has images."""
    every = readers.listing(spark, root, recursive=True).where(readers.is_image(F.col("path"), True)).withColumn("_part", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    present = {r[0] for r in every.select("_part").where(F.col("_part").isin([l[0] for l in layouts])).distinct().collect()}
    images, masks = next((l for l in layouts if l[0] in present), layouts[0])
    return paired(every.where(F.col("_part") == images), every.where(F.col("_part") == masks), _stem(), _stem("_mask"))


def generic(spark: SparkSession, root: str) -> DataFrame:
    """Images beside their *_labels.png."""
    labels = readers.listing(spark, root, "*_labels.png")
    return paired(readers.images(spark, root), labels, _stem(), _stem("_labels"))


#: Adapters by format, as functions.scalars.format_of_directory names them.
ADAPTERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"emps": emps, "nist": nist, "nnp": nnp, "tio2": tio2, "generic": generic}


def pair_report(pairs: DataFrame) -> DataFrame:
    """(key, status) of an adapter's pairs."""
    return pair_audit(pairs.where("image_path is not null"), pairs.where("mask_path is not null"), "key")


def colliding_masks(masks: DataFrame) -> DataFrame:
    """Masks foo and foo_labels would be the same key."""
    return key_collisions(masks, _stem("_labels"), F.col("path"))
