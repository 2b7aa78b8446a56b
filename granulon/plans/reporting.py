"""Reports and gates over the tables, written as documents and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulon.operators import annotations, audit, dedup, manifest, matching, reports, tuning
from granulon.plans import images
from granulon.plans.files import _folder
from granulon.plans.registry import Query, adder
from granulon.session import table
from granulon.sources import blocks, sinks

QUERIES: dict[str, tuple[Query, str | None]] = {}
query = adder(QUERIES)
c = F.col


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a manifest: every third one without a flow, some not reviewed, some large, some tiles."""
    key = c("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        key.alias("row_no"), key.cast("string").alias("record_id"), F.concat(F.lit("d"), key.cast("string")).alias("image_path"), F.concat(F.lit("d"), key.cast("string"), F.lit(".png")).alias("file_name"),
        F.when(key % 10 == 0, "val").when(key % 10 == 1, "holdout").otherwise("train").alias("split"), F.when(key % 3 == 0, "").otherwise("f").alias("flow_path"), F.when(key % 7 == 0, "prelabelled").otherwise("reviewed").alias("label_status"),
        F.when(c("n_chars") > 3000, "true").otherwise("false").alias("is_large_image"), F.when(key % 4 == 2, "true").otherwise("false").alias("is_tile"), F.when(key % 5 == 0, "crowded").otherwise("dense").alias("density_level"),
        *[F.lit("unknown").alias(f) for f in ("microscope_type", "polarity", "particle_morphology", "size_distribution", "quality_level", "adhesion_level")],
    )
    return manifest.normalise(rows)


_M = """m AS (SELECT doc_id, text, CASE WHEN doc_id % 10 = 0 THEN 'val' WHEN doc_id % 10 = 1 THEN 'holdout' ELSE 'train' END AS split, doc_id % 3 = 0 AS flowless, doc_id % 7 = 0 AS unreviewed, n_chars > 3000 AS large, doc_id % 4 = 2 AS tile FROM documents)"""
_ERRORS = """e AS (SELECT doc_id, 'enum' AS rule FROM m WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'flow_required' FROM m WHERE flowless AND split <> 'holdout' UNION ALL SELECT doc_id, 'reviewed_required' FROM m WHERE unreviewed AND split <> 'holdout')"""


@query(
    f"""WITH {_M}, {_ERRORS}, w AS (SELECT unnest(['microscope_type', 'particle_morphology', 'size_distribution', 'quality_level', 'adhesion_level']) AS f)
    SELECT 'total_images' AS member, NULL AS detail, (SELECT count(*) FROM m) AS n UNION ALL SELECT 'n_errors', NULL, (SELECT count(*) FROM e) UNION ALL SELECT 'n_warnings', NULL, (SELECT count(*) FROM w)
    UNION ALL SELECT 'errors', rule, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'warnings', concat(f, '=', (SELECT count(*) FROM m)), 1 FROM w UNION ALL SELECT 'first_error', (SELECT concat(rule, ' ', doc_id) FROM e WHERE rule = 'enum' ORDER BY doc_id LIMIT 1), 1
    UNION ALL SELECT 'split', concat_ws(' ', split, count(*)), row_number() OVER (ORDER BY count(*) DESC, split) FROM m GROUP BY split"""
)
def manifest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's report as one document: counts of fields in the head, all errors and warnings as lists behind it."""
    rows, path = _manifest(spark, sf_dir), f"{_folder(spark)}/report.json"
    rules = manifest.validate(rows, None, ("train", "val"), (), ("train", "val"))
    sinks.report(*reports.manifest_report(rows, rules, ["split", "density_level"]), path)
    none = F.lit(None).cast("string")
    kind = "total_images bigint, n_errors bigint, n_warnings bigint, fields array<struct<field:string,values:array<struct<value:string,n:bigint>>,n_values:bigint>>"
    # The head's line is cut off where the lists begin, so its members are read one by one.
    line = spark.read.text(path).where(c("value").startswith("{") & c("value").endswith("[")).select(F.concat(F.regexp_replace("value", r', "errors": \[$', ""), F.lit("}")).alias("value"))
    head = line.select(F.from_json("value", kind).alias("h")).select("h.*")
    counts = head.select(F.explode(F.array(*[F.struct(F.lit(k).alias("member"), none.alias("detail"), c(k).alias("n")) for k in ("total_images", "n_errors", "n_warnings")])).alias("r")).select("r.*")
    split = head.select(F.posexplode(F.filter("fields", lambda f: f["field"] == "split")[0]["values"]).alias("i", "v")).select(F.lit("split").alias("member"), F.concat_ws(" ", "v.value", c("v.n").cast("string")).alias("detail"), (c("i") + 1).cast("bigint").alias("n"))
    found = blocks.json_elements(spark, path).where("section <> 'fields'").select("section", "at", F.from_json("text", "rule string, row_no bigint, record_id string, detail string").alias("e")).select("section", "at", "e.*")
    listed = found.groupBy(c("section").alias("member"), F.when(c("section") == "errors", c("rule")).otherwise(c("detail")).alias("detail")).agg(F.count("*").alias("n"))
    first = found.where("section = 'errors'").agg(F.min_by(F.concat_ws(" ", "rule", "record_id"), "at").alias("detail")).select(F.lit("first_error").alias("member"), "detail", F.lit(1).cast("bigint").alias("n"))
    return counts.unionByName(listed).unionByName(first).unionByName(split)


@query(
    f"""WITH {images._METRICS}, y AS (SELECT *, 2 * p * r / greatest(p + r, 1e-8) AS f1 FROM x)
    SELECT (SELECT count(*) FROM y) AS n_images, round((SELECT avg(f1) FROM y), 6) AS instance_f1_mean, CAST((SELECT sum(n_pred - n_matched) FROM y) AS BIGINT) AS false_positive_count, CAST(image AS VARCHAR) AS image, round(f1, 6) AS instance_f1, row_number() OVER (ORDER BY CAST(image AS VARCHAR)) AS place FROM y"""
)
def contour_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contour evaluation's report as one document: the summary, then every image in order of its name."""
    metrics = matching.contour_report(matching.image_metrics(images._pixels(spark, sf_dir), "image"))
    path = f"{_folder(spark)}/contours.json"
    head, lists = reports.contour_report(metrics, "image")
    sinks.report(head, lists, path)
    line = spark.read.text(path).where(c("value").startswith("{") & c("value").endswith("[")).select(F.concat(F.regexp_replace("value", r', "images": \[$', ""), F.lit("}")).alias("value"))
    one = line.select(F.from_json("value", "n_images bigint, summary struct<instance_f1_mean:double,false_positive_count:bigint>").alias("h")).select("h.n_images", F.round("h.summary.instance_f1_mean", 6).alias("instance_f1_mean"), "h.summary.false_positive_count")
    rows = blocks.json_elements(spark, path).where("section = 'images'").select("at", F.from_json("text", "image string, instance_f1 double").alias("e")).select("e.image", F.round("e.instance_f1", 6).alias("instance_f1"), "at")
    place = dedup.renumbered(rows, ["at"], to="place")
    return place.crossJoin(F.broadcast(one)).select("n_images", "instance_f1_mean", "false_positive_count", "image", "instance_f1", "place")  # one row


@query(
    f"""WITH {images._SCORED}, o AS (SELECT *, row_number() OVER (ORDER BY score DESC, af DESC, ar DESC, ap DESC, t, s) AS k FROM sc)
    SELECT k AS place, t, s, round(score, 6) AS score, (SELECT round(score, 6) FROM o WHERE k = 1) AS best_score, (SELECT count(*) FROM o WHERE abs(score - (SELECT max(score) FROM o)) < 1e-9) AS ties, (SELECT count(*) FROM o) AS n_combinations FROM o WHERE k <= 10"""
)
def tuning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tuning result: the best parameters and the first ten, with how many combinations share the best score."""
    scores = images._scored_grid(spark, sf_dir)
    order = [c(k[1:]).asc() if k.startswith("-") else c(k).desc() for k in tuning.RANKING]
    one = reports.tuning_report(scores, ["t", "s"], [*order, c("t"), c("s")])
    rows = one.select("best_score", c("tie_count_at_best_score").alias("ties"), "n_combinations", F.posexplode("all_results").alias("k", "r"))
    return rows.select((c("k") + 1).cast("bigint").alias("place"), c("r.t").cast("decimal(3,2)").cast("double").alias("t"), "r.s", F.round("r.score", 6).alias("score"), F.round("best_score", 6).alias("best_score"), "ties", "n_combinations")


_GATES = f"""WITH {_M}, {_ERRORS}, u AS (SELECT * FROM m WHERE split <> 'holdout'),
    i AS (SELECT p_partkey AS k, p_size % 7 AS h FROM part WHERE p_partkey % 9 <> 0), fl AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN -1 ELSE p_size % 7 END AS h, p_partkey % 13 <> 0 AS ok FROM part WHERE p_partkey % 8 <> 0),
    j AS (SELECT i.h AS ih, fl.h AS fh, fl.ok, i.k AS ik, fl.k AS fk FROM i FULL JOIN fl ON i.k = fl.k),
    minima AS (SELECT count(*) FILTER (NOT ok) AS n FROM (SELECT count(*) FILTER (split = 'train') >= 200 AS ok FROM m UNION ALL SELECT count(*) FILTER (split = 'val') >= 30 FROM m UNION ALL SELECT count(*) FILTER (split = 'holdout') >= 10 FROM m
      UNION ALL SELECT count(DISTINCT doc_id) FILTER (large) >= 5 FROM m UNION ALL SELECT count(DISTINCT doc_id) FILTER (large AND split = 'holdout') >= 3 FROM m)),
    leaks AS (SELECT text FROM m GROUP BY 1 HAVING count(*) FILTER (split = 'train') > 0 AND count(*) FILTER (split = 'val') > 0),
    g(gate, n, what, skip, why, failed) AS (
      SELECT 'critical_files', 1, 'files missing', false, '', true UNION ALL SELECT 'manifest', count(*), 'errors', false, '', count(*) > 0 FROM e
      UNION ALL SELECT 'reviewed', count(*) FILTER (unreviewed), 'rows not reviewed', false, '', count(*) FILTER (unreviewed) > 0 FROM u UNION ALL SELECT 'flow_paths', count(*) FILTER (flowless), 'rows without a flow', false, '', count(*) FILTER (flowless) > 0 FROM u
      UNION ALL SELECT 'minimums', n, 'minimums not met', false, '', n > 0 FROM minima UNION ALL SELECT 'pairs', count(*) FILTER (ik IS NULL OR fk IS NULL), 'images or flows alone', false, '', count(*) FILTER (ik IS NULL OR fk IS NULL) > 0 FROM j
      UNION ALL SELECT 'sizes', count(*) FILTER (ih <> fh), 'pairs of other sizes', false, '', count(*) FILTER (ih <> fh) > 0 FROM j UNION ALL SELECT 'flow_files', count(*) FILTER (NOT ok), 'bad flow files', false, '', count(*) FILTER (NOT ok) > 0 FROM j
      UNION ALL SELECT 'annotations', count(*), 'faults in annotations', false, '', count(*) > 0 FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'leakage', count(*), 'contents in train and val', false, '', count(*) > 0 FROM leaks
      UNION ALL SELECT 'tiles', count(*) FILTER (tile), 'tiles of large images', count(*) FILTER (large) = 0, 'no large images in train and val', count(*) FILTER (tile) = 0 FROM u
      UNION ALL SELECT 'background_tiles', 0, 'background tiles', count(*) FILTER (large) = 0, 'no large images in train and val', true FROM u)"""


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _manifest(spark, sf_dir)
    rules = manifest.validate(rows, None, ("train", "val"), (), ("train", "val"))
    minima = manifest.minimums(rows, c("split"), c("is_large_image") == "true", c("record_id"))
    part = table(spark, sf_dir, "part").select(c("p_partkey").alias("k"), c("p_partkey").cast("string").alias("stem"), (c("p_size") % 7).alias("h"), F.lit(5).alias("w"))
    flows = part.where("k % 8 <> 0").select("stem", F.when(c("k") % 11 == 0, -1).otherwise(c("h")).alias("h"), "w", (c("k") % 13 != 0).alias("ok"))
    orders = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("o"), c("o_orderkey").cast("string")).alias("file_name")
    own = orders.select(c("o_orderkey").alias("id"), name)
    notes = orders.limit(0).select(c("o_orderkey").cast("string").alias("id"), c("o_orderkey").alias("image_id"), F.array(F.lit(1.0)).alias("bbox"), F.lit("").alias("segmentation"))
    faults = annotations.checks(own, notes, orders.where("o_orderstatus <> 'P'").select(name))
    leaks = audit.content_leaks(table(spark, sf_dir, "documents").withColumn("s", F.when(c("doc_id") % 10 == 0, "val").when(c("doc_id") % 10 == 1, "holdout").otherwise("train")), c("s"), F.md5(F.coalesce("text", F.lit(""))), c("doc_id"))
    there = table(spark, sf_dir, "region").select(F.concat(F.lit("data/"), c("r_name")).alias("path"))
    return reports.pretrain_gates(rows, rules, minima, there, ["data/ASIA", "data/train"], part.where("k % 9 <> 0").select("stem", "h", "w"), flows, leaks, faults)


@query(f"{_GATES} SELECT gate, CASE WHEN skip THEN 'SKIP' WHEN failed THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN skip THEN why ELSE concat(n, ' ', what) END AS detail FROM g")
def pretrain_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve gates as one table."""
    return _gates(spark, sf_dir)


@query(f"{_GATES} SELECT count(*) FILTER (NOT skip AND NOT failed) AS n_pass, count(*) FILTER (NOT skip AND failed) AS n_fail, count(*) FILTER (skip) AS n_skip, count(*) FILTER (NOT skip AND failed) = 0 AS ready FROM g")
def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many passed, failed and were skipped."""
    return reports.verdict(_gates(spark, sf_dir))
