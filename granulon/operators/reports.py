"""Whole reports: a typed head of one row from one plan, however many parts it has, and lists that are streamed behind it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granulon.operators.manifest import field_summary

c = F.col

#: Fields, and rules, of one readiness report: there are some dozens.
MOST_GATES = 100_000


def listed(rows: DataFrame, member: str, order: Sequence[Column], most: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., member, n): the first `most` rows in order as an array of structs, and how many there are in all.

    Rows are ranked before they are gathered, so that no more than these ever are; whole lists are for sinks.report, which streams them.
    """
    names = [n for n in rows.columns if n not in by]
    counts = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    if by:
        some = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(c("_at") <= most)
    else:
        # No more than `most` rows in the one window.
        some = rows.orderBy(*order).limit(most).withColumn("_at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    gathered = some.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_at", F.struct(*names).alias("row")))).alias("_l"))
    found = F.transform("_l", lambda x: x["row"]).alias(member)
    both = gathered.join(counts, list(by)) if by else gathered.crossJoin(counts)  # single rows
    return both.select(*by, found, c("_n").alias("n"))


def document(parts: Mapping[str, DataFrame]) -> DataFrame:
    """One row with a column for each part, each of a single row: its only column, or a struct of several."""
    one = [df.select((c(f"`{df.columns[0]}`") if len(df.columns) == 1 else F.struct(*[c(f"`{n}`") for n in df.columns])).alias(name)) for name, df in parts.items()]
    return reduce(DataFrame.crossJoin, one)  # single rows all


def manifest_report(manifest: DataFrame, violations: DataFrame, fields: Sequence[str], values: int = 50) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The head (total_images, n_errors, n_warnings, fields) and the lists errors and warnings, for sinks.report.

    A field has the number of its values and the `values` most frequent ones. Lists are whole, in order of rule, row and detail.
    """
    by_field = listed(field_summary(manifest, fields), "values", [F.desc("n"), F.asc("value")], values, ["field"]).withColumnRenamed("n", "n_values")
    counts = violations.agg(F.count_if(c("severity") == "error").alias("n_errors"), F.count_if(c("severity") == "warning").alias("n_warnings"))
    head = document({"total_images": manifest.agg(F.count("*").alias("n")), "c": counts, "fields": listed(by_field, "fields", [c("field")], len(fields)).select("fields")})
    at = F.concat_ws("|", "rule", F.lpad(F.coalesce(c("row_no"), F.lit(0)).cast("string"), 20, "0"), "record_id", "detail").alias("at")
    part = lambda severity: violations.where(c("severity") == severity).select(F.struct("rule", "row_no", "record_id", "detail").alias("e"), at)
    return head.select("total_images", "c.n_errors", "c.n_warnings", "fields"), {"errors": part("error"), "warnings": part("warning")}


def contour_report(metrics: DataFrame, image: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The head (n_images, summary) and the list of images by name, for sinks.report. metrics as matching.contour_report gives them."""
    sums = {"total_gt": "n_gt", "total_pred": "n_pred", "total_matched": "n_matched", "false_positive_count": "false_positives", "false_negative_count": "false_negatives", "over_split_proxy_count": "over_split"}
    means = {"precision_mean": "precision", "recall_mean": "recall", "instance_f1_mean": "instance_f1", "mask_iou_mean": "mask_iou_mean", "boundary_iou_mean": "boundary_iou_mean"}
    review = F.count_if("review_required")
    parts = [*[F.sum(v).cast("bigint").alias(k) for k, v in sums.items()], *[F.avg(v).alias(k) for k, v in means.items()], review.alias("review_required_count"), (review / F.count("*")).alias("review_required_ratio")]
    head = metrics.agg(F.count("*").alias("n_images"), F.struct(*parts).alias("summary"))
    return head, {"images": metrics.select(F.struct(*metrics.columns).alias("e"), c(image).cast("string").alias("at"))}


def tuning_report(scores: DataFrame, parameters: Sequence[str], order: Sequence[Column], score: str = "score", most: int = 10, tie: float = 1e-9) -> DataFrame:
    """(best_params, best_score, all_results, tie_count_at_best_score, n_combinations): the first rows in ranking order, and how many share the best score."""
    top = scores.agg(F.max(score).alias("_best"))
    ties = scores.crossJoin(F.broadcast(top)).agg(F.count_if(F.abs(c(score) - c("_best")) < tie).alias("n"))  # top is one row
    results = listed(scores, "all_results", order, most)
    first = results.select(F.struct(*[c("all_results")[0][p].alias(p) for p in parameters]).alias("best_params"), c("all_results")[0][score].alias("best_score"), "all_results", c("n").alias("n_combinations"))
    return first.crossJoin(ties.withColumnRenamed("n", "tie_count_at_best_score"))


def markdown(summary: DataFrame, gates: DataFrame, most: int = 50) -> DataFrame:
    """(report): the readiness report as one text from one plan: the `most` frequent values of each field, then what passed, all of it up to MOST_GATES."""
    line = F.concat(F.lit("| "), F.coalesce(c("value"), F.lit("")), F.lit(" | "), c("n").cast("string"), F.lit(" |"))
    lines = summary.select("field", "n", F.coalesce("value", F.lit("")).alias("value"), line.alias("line"))
    tables = listed(lines, "rows", [F.desc("n"), F.asc("value")], most, by=["field"])
    text = F.concat(F.lit("### "), c("field"), F.lit("\n\n| value | n |\n|-|-|\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    whole = listed(tables.select("field", text.alias("text")), "tables", [c("field")], MOST_GATES).select(F.array_join(F.transform("tables", lambda t: t["text"]), "\n\n").alias("_tables"))
    check = F.concat(F.lit("| "), c("rule"), F.lit(" | "), F.when(c("ok"), "PASS").otherwise("FAIL"), F.lit(" | "), F.coalesce(c("detail"), F.lit("")), F.lit(" |"))
    checks = listed(gates.select("rule", check.alias("line")), "checks", [c("rule")], MOST_GATES).select(F.concat(F.lit("| rule | result | detail |\n|-|-|-|\n"), F.array_join(F.transform("checks", lambda r: r["line"]), "\n")).alias("_checks"))
    return whole.crossJoin(checks).select(F.concat_ws("\n\n", "_tables", "_checks").alias("report"))


PASS, FAIL, SKIP = "PASS", "FAIL", "SKIP"


def gate(name: str, failed: Column, n: Column, what: str, skip: Column | None = None, why: str = "") -> Column:
    """One gate's (gate, status, detail) from aggregates: FAIL where failed holds, SKIP where there is nothing to judge."""
    status = F.when(F.coalesce(failed, F.lit(False)), FAIL).otherwise(PASS)
    detail = F.concat(F.coalesce(n, F.lit(0)).cast("string"), F.lit(f" {what}"))
    if skip is not None:
        status, detail = F.when(skip, SKIP).otherwise(status), F.when(skip, F.lit(why)).otherwise(detail)
    return F.struct(F.lit(name).alias("gate"), status.alias("status"), detail.alias("detail"))


def pretrain_gates(manifest: DataFrame, violations: DataFrame, minima: DataFrame, files: DataFrame, critical: Sequence[str], images: DataFrame, flows: DataFrame, leaks: DataFrame, annotations: DataFrame) -> DataFrame:
    """(gate, status, detail): all gates before training as one table.

    manifest: normalised rows. violations: manifest.validate's. minima: manifest.minimums'. files: (path) of what is there, in which the
    `critical` ones are looked for. images and flows: (stem, h, w); flows with (ok) of their audit. leaks: contents in both train and val.
    annotations: annotations.checks' rows. Gates of tiles are skipped where no training row is a large image.
    """
    spark = manifest.sparkSession
    used = c("split").isin("train", "val")
    tile_role = F.coalesce(c("tile_role"), F.lit(""))
    rows = manifest.agg(
        F.count("*").alias("n"), F.count_if(used & (c("is_large_image") == "true")).alias("large"),
        F.count_if(used & (c("is_tile") == "true")).alias("tiles"), F.count_if(used & (tile_role == "background_negative")).alias("background"),
        F.count_if(used & (c("flow_path") == "")).alias("flowless"), F.count_if(used & (c("label_status") != "reviewed")).alias("unreviewed"),
    )
    errors = violations.agg(F.count_if(c("severity") == "error").alias("n"))
    short = minima.agg(F.count_if(~c("ok")).alias("n"))
    wanted = spark.createDataFrame([(p,) for p in critical], "path string")
    missing = wanted.join(files.select("path").distinct(), "path", "left_anti").agg(F.count("*").alias("n"))
    a = images.select("stem", c("h").alias("_h"), c("w").alias("_w"), F.lit(True).alias("_i"))
    both = a.join(flows.select("stem", "h", "w", "ok", F.lit(True).alias("_f")), "stem", "full_outer")
    pairs = both.agg(
        F.count_if(c("_f").isNull()).alias("lone"), F.count_if(c("_i").isNull()).alias("orphans"), F.count_if(c("_i") & c("_f") & ((c("h") != c("_h")) | (c("w") != c("_w")))).alias("sizes"),
        F.count_if(c("_f") & ~F.coalesce("ok", F.lit(False))).alias("bad"), F.count_if(c("_i") & c("_f")).alias("paired"),
    )
    faults = annotations.agg(F.count("*").alias("n"))
    one = document({"m": rows, "e": errors, "s": short, "f": missing, "p": pairs, "l": leaks.agg(F.count("*").alias("n")), "c": faults})
    none_large = c("m.large") == 0
    gates = [
        gate("critical_files", c("f") > 0, c("f"), "files missing"),
        gate("manifest", c("e") > 0, c("e"), "errors", c("m.n") == 0, "no manifest rows"),
        gate("reviewed", c("m.unreviewed") > 0, c("m.unreviewed"), "rows not reviewed", c("m.n") == 0, "no manifest rows"),
        gate("flow_paths", c("m.flowless") > 0, c("m.flowless"), "rows without a flow", c("m.n") == 0, "no manifest rows"),
        gate("minimums", c("s") > 0, c("s"), "minimums not met", c("m.n") == 0, "no manifest rows"),
        gate("pairs", (c("p.lone") + c("p.orphans")) > 0, c("p.lone") + c("p.orphans"), "images or flows alone", c("p.paired") + c("p.lone") + c("p.orphans") == 0, "no images and flows"),
        gate("sizes", c("p.sizes") > 0, c("p.sizes"), "pairs of other sizes", c("p.paired") == 0, "no pairs"),
        gate("flow_files", c("p.bad") > 0, c("p.bad"), "bad flow files", c("p.paired") + c("p.orphans") == 0, "no flows"),
        gate("annotations", c("c") > 0, c("c"), "faults in annotations"),
        gate("leakage", c("l") > 0, c("l"), "contents in train and val"),
        gate("tiles", c("m.tiles") == 0, c("m.tiles"), "tiles of large images", none_large, "no large images in train and val"),
        gate("background_tiles", c("m.background") == 0, c("m.background"), "background tiles", none_large, "no large images in train and val"),
    ]
    return one.select(F.explode(F.array(*gates)).alias("g")).select("g.*")


def verdict(gates: DataFrame) -> DataFrame:
    """(n_pass, n_fail, n_skip, ready): ready if no gate failed."""
    found = gates.agg(*[F.count_if(c("status") == s).alias(f"n_{s.lower()}") for s in (PASS, FAIL, SKIP)])
    return found.withColumn("ready", c("n_fail") == 0)
