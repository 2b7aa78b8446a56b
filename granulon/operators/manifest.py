"""The manifest: its columns, normalisation, enrichment, summaries and rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulon.functions.scalars import flag, or_default, source_unit

# The manifest's columns in order, and the values of its closed columns.
FIELDS = (
    "record_id image_path file_name split source microscope_type polarity particle_morphology shape_type density_level size_distribution quality_level "
    "adhesion_level label_status label_path flow_path notes is_large_image is_tile source_image_path tile_x tile_y tile_width tile_height tile_overlap tile_core_margin tile_role"
).split()
ENUMS = {
    "split": ("train", "val", "test", "holdout", "unassigned"),
    "microscope_type": ("SEM", "TEM", "TSEM", "optical", "CryoEM", "unknown"),
    "polarity": ("bright_background_dark_particles", "dark_background_bright_particles", "mixed", "unknown"),
    "particle_morphology": ("round_like", "irregular", "flake_like", "fiber_like", "porous", "mixed", "unknown"),
    "shape_type": ("round_like", "irregular", "flake_like", "fiber_like", "porous", "mixed", "unknown"),
    "density_level": ("sparse", "medium", "dense", "unknown"),
    "size_distribution": ("small", "medium", "large", "wide", "unknown"),
    "quality_level": ("clear", "low_contrast", "blurred", "noisy_texture", "unknown"),
    "adhesion_level": ("none", "few_touching", "many_touching", "unknown"),
    "label_status": ("unlabelled", "prelabelled", "reviewed", "unknown"),
    "is_large_image": ("true", "false"),
    "is_tile": ("true", "false"),
    "tile_role": ("", "train_tile", "validation_tile", "background_negative", "holdout_full_image"),
}
SCENE_FIELDS = ("particle_morphology", "density_level", "size_distribution", "quality_level", "adhesion_level", "is_large_image")
FORBIDDEN_FIELDS = ("has_scale", "pixel_size", "pixel_size_unit", "scale_source")
MINIMA = {"train": 200, "val": 30, "holdout": 10, "large_sources": 5, "holdout_large_sources": 3}

#: Columns of every rule table: which rule, how grave, which row, what about.
RULE_COLUMNS = ("rule", "severity", "row_no", "record_id", "detail")


def normalise(raw: DataFrame) -> DataFrame:
    """The manifest's columns as trimmed strings; missing ones blank, others dropped.

    The two names of the form of particles fill each other, and flags become true, false or what they were.
    Columns with the row's number (row_no) are kept.
    """
    present = set(raw.columns)
    text = {f: F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) if f in present else F.lit("") for f in FIELDS}
    form, shape = text["particle_morphology"], text["shape_type"]
    text["particle_morphology"] = F.when(form == "", shape).otherwise(form)
    text["shape_type"] = F.when(shape == "", form).otherwise(shape)
    for f in ("is_large_image", "is_tile"):
        text[f] = flag(text[f])
    return raw.select(*(["row_no"] if "row_no" in present else []), *[text[f].alias(f) for f in FIELDS])


def extra_columns(columns: Sequence[str]) -> list[tuple[str, str]]:
    """(column, kind) of what isn't in the manifest: forbidden, case (a manifest column in other case), or extra."""
    lower = {f.lower(): f for f in FIELDS}
    kind = lambda c: "forbidden" if c.lower() in FORBIDDEN_FIELDS else "case" if c.lower() in lower else "extra"
    return [(c, kind(c)) for c in columns if c not in FIELDS]


def unpivot(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys..., field, value): a row for each field of each row."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.field", "_p.value")


def field_summary(df: DataFrame, fields: Sequence[str], default: str = "unknown") -> DataFrame:
    """(field, value, n) over several columns in one pass; blank counts as the default."""
    return unpivot(df, [], fields).groupBy("field", or_default(F.col("value"), default).alias("value")).agg(F.count("*").alias("n"))


def duplicate_keys(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """(key, n) of keys that aren't blank and occur more than once."""
    return df.select(key.alias(name)).where((F.col(name).isNotNull()) & (F.col(name) != "")).groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def enum_violations(df: DataFrame, keys: Sequence[str], enums: Mapping[str, Sequence[str]]) -> DataFrame:
    """(keys..., field, value) of values outside their closed set; null counts as blank."""
    allowed = reduce(lambda a, b: a | b, [(F.col("field") == f) & F.col("value").isin(*v) for f, v in enums.items()])
    return unpivot(df, keys, list(enums)).withColumn("value", F.coalesce("value", F.lit(""))).where(~allowed)


def enrich(df: DataFrame, base: DataFrame, on: str, fields: Sequence[str], order: Column) -> DataFrame:
    """df with fields overridden by base where that knows them (not null, blank or unknown); base's last row of a key holds."""
    last = base.groupBy(on).agg(F.max_by(F.struct(*fields), order).alias("_base"))
    known = lambda f: F.nullif(F.nullif(F.col(f"_base.{f}"), F.lit("")), F.lit("unknown"))
    joined = df.join(last, on, "left")
    return joined.select(*[F.coalesce(known(c), F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns])


def with_defaults(draft: DataFrame, source: str) -> DataFrame:
    """A draft row's record_id from its file name, unknown scenes, and the source tag where none is given."""
    from granulon.functions.scalars import microscope_of_file, stem

    filled = draft.withColumn("record_id", F.when(F.col("record_id") == "", stem(F.col("file_name"))).otherwise(F.col("record_id")))
    filled = filled.withColumn("source", or_default(F.col("source"), source)).withColumn("label_status", or_default(F.col("label_status"), "prelabelled"))
    filled = filled.withColumn("microscope_type", F.when(F.col("microscope_type").isin("", "unknown"), microscope_of_file(F.col("file_name"))).otherwise(F.col("microscope_type")))
    return filled.withColumns({f: or_default(F.col(f)) for f in SCENE_FIELDS[:-1]})


def _rule(df: DataFrame, rule: str, where: Column, detail: Column, severity: str = "error") -> DataFrame:
    return df.where(where).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("row_no").cast("bigint").alias("row_no"), "record_id", detail.cast("string").alias("detail"))


def validate(
    manifest: DataFrame,
    files: DataFrame | None = None,
    require_flow_for: Sequence[str] = ("train", "val"),
    strict_unknown_for: Sequence[str] = (),
    require_reviewed_for: Sequence[str] = (),
    columns: Sequence[str] = (),
) -> DataFrame:
    """All violations of a normalised manifest with row_no, as one rule table; empty if there are none.

    files: (path) of what exists, against which paths are checked; columns: those of the raw input, for
    the forbidden ones. A field with unknown values is one warning, or an error if it is strict, besides
    an error for each of its rows.
    """
    c = F.col
    out = [_rule(manifest, f"missing_{f}", c(f) == "", F.lit(f)) for f in ("record_id", "image_path", "file_name")]
    for key in ("record_id", "image_path"):
        found = duplicate_keys(manifest, c(key))
        out.append(found.select(F.lit(f"duplicate_{key}").alias("rule"), F.lit("error").alias("severity"), F.lit(None).cast("bigint").alias("row_no"), F.lit(None).cast("string").alias("record_id"), F.col("key").alias("detail")))
    bad = enum_violations(manifest, ["row_no", "record_id"], ENUMS)
    out.append(bad.select(F.lit("enum").alias("rule"), F.lit("error").alias("severity"), c("row_no").cast("bigint").alias("row_no"), "record_id", F.concat_ws("=", "field", "value").alias("detail")))
    out.append(_rule(manifest, "flow_required", c("split").isin(*require_flow_for) & (c("flow_path") == ""), c("split")))
    if files is not None:
        paths = unpivot(manifest, ["row_no", "record_id"], ["image_path", "flow_path", "label_path"]).where("value <> ''")
        missing = paths.join(files.select(F.col("path").alias("value")).distinct(), "value", "left_anti")
        out.append(missing.select(F.concat(F.lit("not_found_"), c("field")).alias("rule"), F.lit("error").alias("severity"), c("row_no").cast("bigint").alias("row_no"), "record_id", F.col("value").alias("detail")))
    if require_reviewed_for:
        out.append(_rule(manifest, "reviewed_required", c("split").isin(*require_reviewed_for) & (c("label_status") != "reviewed"), c("label_status")))
    unknown = unpivot(manifest, [], ["microscope_type", *SCENE_FIELDS]).where("value = 'unknown'").groupBy("field").agg(F.count("*").alias("n"))
    severity = F.when(c("field").isin(*strict_unknown_for), "error").otherwise("warning") if strict_unknown_for else F.lit("warning")
    out.append(unknown.select(F.lit("unknown_values").alias("rule"), severity.alias("severity"), F.lit(None).cast("bigint").alias("row_no"), F.lit(None).cast("string").alias("record_id"), F.concat_ws("=", "field", c("n").cast("string")).alias("detail")))
    if strict_unknown_for:
        strict = unpivot(manifest, ["row_no", "record_id"], list(strict_unknown_for)).where("coalesce(value, '') in ('', 'unknown')")
        out.append(strict.select(F.lit("strict_field").alias("rule"), F.lit("error").alias("severity"), c("row_no").cast("bigint").alias("row_no"), "record_id", F.concat_ws("=", "field", "value").alias("detail")))
    for name, kind in extra_columns(columns):
        if kind != "extra":
            rule = "forbidden_column" if kind == "forbidden" else "column_case"
            row = manifest.sparkSession.range(1).select(F.lit(rule).alias("rule"), F.lit("error" if kind == "forbidden" else "warning").alias("severity"), F.lit(None).cast("bigint").alias("row_no"), F.lit(None).cast("string").alias("record_id"), F.lit(name).alias("detail"))
            out.append(row)
    return reduce(DataFrame.unionByName, out)


def minimums(df: DataFrame, split: Column, large: Column, source: Column, minima: Mapping[str, int] = MINIMA) -> DataFrame:
    """(rule, actual, minimum, ok): numbers of rows of a split and of large sources, each one aggregate of one pass."""
    counts = {
        "train": F.count_if(split == "train"),
        "val": F.count_if(split == "val"),
        "holdout": F.count_if(split == "holdout"),
        "large_sources": F.countDistinct(F.when(large, source)),
        "holdout_large_sources": F.countDistinct(F.when(large & (split == "holdout"), source)),
    }
    row = df.agg(*[counts[k].alias(k) for k in counts])
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).cast("bigint").alias("actual"), F.lit(minima[k]).cast("bigint").alias("minimum")) for k in counts])
    return row.select(F.explode(rules).alias("r")).select("r.rule", "r.actual", "r.minimum", (F.col("r.actual") >= F.col("r.minimum")).alias("ok"))


def first_violations(df: DataFrame, order: Column, key: Column, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, first_key): for each rule that some row breaks, the first such row."""
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return df.select(order.alias("_o"), key.alias("_k"), F.explode(broken).alias("rule")).groupBy("rule").agg(F.min_by("_k", "_o").alias("first_key"))


def readiness(manifest: DataFrame) -> DataFrame:
    """The minima, the reviewed rule and the scene rules of training rows as (rule, ok, detail)."""
    c = F.col
    counts = minimums(manifest, c("split"), c("is_large_image") == "true", source_unit(c("source_image_path"), c("image_path"))).select("rule", "ok", F.concat_ws("/", c("actual").cast("string"), c("minimum").cast("string")).alias("detail"))
    used = manifest.where(c("split").isin("train", "val"))
    rules = {"reviewed": c("label_status") != "reviewed"} | {f: c(f).isin("", "unknown") for f in SCENE_FIELDS}
    # Rows of train come before those of val.
    order = F.struct((c("split") != "train").alias("s"), c("row_no").alias("r"))
    first = first_violations(used, order, c("record_id"), rules)
    return counts.unionByName(first.select("rule", F.lit(False).alias("ok"), F.col("first_key").alias("detail")))
