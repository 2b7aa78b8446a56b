"""Reports as documents, read back by json.load; gates with nothing to judge."""

import json

from pyspark.sql import functions as F

from granulon.operators import manifest, reports
from granulon.sources import sinks

RULES = "rule string, severity string, row_no bigint, record_id string, detail string"


def read(path):
    return json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))


def rows(spark, n):
    return manifest.normalise(spark.range(n).select(F.col("id").alias("row_no"), F.col("id").cast("string").alias("record_id"), F.lit("train").alias("split"), F.when(F.col("id") % 3 == 0, "val").otherwise("x").alias("source")))


def test_manifest_report(spark, tmp_path):
    found = spark.createDataFrame([("b", "error", 10, "10", 'say "}"'), ("b", "error", 9, "9", None), ("a", "warning", None, None, "w"), ("a", "error", None, None, "z")], RULES)
    head, lists = reports.manifest_report(rows(spark, 7), found, ["split", "source"], values=1)
    sinks.report(head, lists, str(tmp_path / "r"))
    got = read(tmp_path / "r")
    assert (got["total_images"], got["n_errors"], got["n_warnings"]) == (7, 3, 1)
    assert got["fields"] == [{"field": "source", "values": [{"value": "x", "n": 4}], "n_values": 2}, {"field": "split", "values": [{"value": "train", "n": 7}], "n_values": 1}]
    assert [(e["rule"], e.get("row_no"), e.get("detail")) for e in got["errors"]] == [("a", None, "z"), ("b", 9, None), ("b", 10, 'say "}"')]
    assert [e["detail"] for e in got["warnings"]] == ["w"]


def test_reports_of_nothing(spark, tmp_path):
    head, lists = reports.manifest_report(rows(spark, 3), spark.createDataFrame([], RULES), ["split"])
    sinks.report(head, lists, str(tmp_path / "r"))
    assert read(tmp_path / "r")["errors"] == [] and read(tmp_path / "r")["n_errors"] == 0


def test_long_lists_are_whole(spark, tmp_path):
    many = spark.range(5000).select(F.lit("r").alias("rule"), F.lit("error").alias("severity"), F.col("id").alias("row_no"), F.col("id").cast("string").alias("record_id"), F.lit("").alias("detail"))
    sinks.report(*reports.manifest_report(rows(spark, 1), many, ["split"]), str(tmp_path / "r"))
    assert [e["row_no"] for e in read(tmp_path / "r")["errors"]] == list(range(5000))


def test_listed(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 5)], "g string, v int")
    got = {r.g: ([x.v for x in r.l], r.n) for r in reports.listed(df, "l", [F.col("v")], 2, ["g"]).collect()}
    assert got == {"a": ([1, 2], 3), "b": ([5], 1)}
    one = reports.listed(df, "l", [F.desc("v")], 3).first()
    assert ([x.v for x in one.l], one.n) == ([5, 3, 2], 4)


def gates(spark, manifest_rows, images, flows, files=("a",), violations=(), minima=(), leaks=0, faults=0):
    frame = lambda data, schema: spark.createDataFrame(list(data), schema)
    got = reports.pretrain_gates(
        manifest.normalise(frame(manifest_rows, "row_no bigint, split string, is_large_image string, is_tile string, tile_role string, flow_path string, label_status string")), frame(violations, RULES), frame(minima, "rule string, ok boolean"),
        frame([(f,) for f in files], "path string"), ["a"], frame(images, "stem string, h int, w int"), frame(flows, "stem string, h int, w int, ok boolean"), spark.range(leaks), spark.range(faults),
    )
    return {r.gate: (r.status, r.detail) for r in got.collect()}, reports.verdict(got).first()


def test_gates_that_pass(spark):
    large = [(1, "train", "yes", "no", "", "f", "reviewed"), (2, "val", "no", "yes", "background_negative", "f", "reviewed"), (3, "holdout", "no", "no", "", "", "")]
    got, verdict = gates(spark, large, [("x", 4, 5)], [("x", 4, 5, True)], minima=[("train", True)])
    assert {s for s, _ in got.values()} == {"PASS"} and tuple(verdict) == (12, 0, 0, True)


def test_gates_without_anything_to_judge(spark):
    got, verdict = gates(spark, [], [], [])
    assert {g for g, (s, _) in got.items() if s == "SKIP"} == {"manifest", "reviewed", "flow_paths", "minimums", "pairs", "sizes", "flow_files", "tiles", "background_tiles"}
    assert verdict.ready and verdict.n_pass == 3


def test_gates_that_fail(spark):
    bad = [(1, "train", "yes", "no", "", "", "")]
    got, verdict = gates(spark, bad, [("x", 4, 5), ("y", 1, 1)], [("x", 5, 5, False), ("z", 1, 1, None)], (), [("r", "error", 1, "1", "")], [("train", False)], 2, 3)
    assert {s for s, _ in got.values()} == {"FAIL"} and not verdict.ready
    assert got["pairs"][1] == "2 images or flows alone" and got["leakage"][1] == "2 contents in train and val" and got["flow_files"][1] == "2 bad flow files"
