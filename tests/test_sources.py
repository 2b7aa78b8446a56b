"""Files in and out."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granulon.operators import manifest as rows
from granulon.sources import adapters, png, readers, sinks
from granulon.streaming import ingest

LABELS = np.array([[0, 1, 255], [256, 300, 1000]], np.uint16)


def filtered_png(pixels, kind):
    """An 8-bit RGB PNG whose rows all use one filter."""
    h, w, _ = pixels.shape
    lines = [np.zeros(3 * w, int)] + [r.ravel().astype(int) for r in pixels]
    body = b""
    for above, line in zip(lines, lines[1:]):
        a = np.concatenate([[0] * 3, line[:-3]])
        b, c = above, np.concatenate([[0] * 3, above[:-3]])
        p = a + b - c
        nearest = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
        guess = [0 * a, a, b, (a + b) // 2, nearest][kind]
        body += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_png_keeps_16_bits():
    assert (png.decode(png.encode_grey(LABELS)) == LABELS).all()
    assert png.decode(b"no png") is None and png.decode(png.encode_grey(LABELS)[:40]) is None


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    pixels = np.random.default_rng(kind).integers(0, 256, (7, 5, 3)).astype(np.uint8)
    assert (png.decode(filtered_png(pixels, kind)) == pixels).all()


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.png").write_bytes(png.encode_grey(LABELS))
    (tmp_path / "a_labels.png").write_bytes(png.encode_grey(LABELS))
    (tmp_path / "b.PNG").write_bytes(b"broken")
    (tmp_path / "b_labels.png").write_bytes(b"broken")
    np.save(tmp_path / "a.npy", np.ones((3, 2, 3), np.float32))
    np.save(tmp_path / "b.npy", np.full((3, 2, 3), np.nan, np.float32))
    np.save(tmp_path / "c.npy", np.ones((2, 3), np.int32))
    (tmp_path / "d.npy").write_bytes(b"broken")
    return str(tmp_path)


def test_listings(spark, folder):
    assert sorted(r.stem for r in readers.images(spark, folder).collect()) == ["a", "b"]
    assert readers.images(spark, folder, with_labels=True).count() == 4


def test_label_runs_and_back(spark, folder):
    runs = readers.label_runs(spark, folder)
    got = {(r.y, r.x0, r.x1, r.label) for r in runs.collect()}
    assert got == {(0, 1, 2, 1), (0, 2, 3, 255), (1, 0, 1, 256), (1, 1, 2, 300), (1, 2, 3, 1000)}
    (content,) = [bytes(r.content) for r in sinks.label_images(runs).collect()]
    assert (png.decode(content) == LABELS).all()


def test_flows(spark, folder):
    audit = {r.image_id: r for r in readers.flow_audit(spark, folder, header_only=False).collect()}
    assert {k: r.ok for k, r in audit.items()} == {"a": True, "b": False, "c": False, "d": False}
    assert audit["a"].shape == [3, 2, 3]
    assert {r.image_id: r.ok for r in readers.flow_audit(spark, folder).collect()}["b"]


def test_flow_files_come_back(spark, tmp_path):
    df = spark.createDataFrame([("k", 1, 2, [1.0, 2.0], [3.0, 4.0], [5.0, 6.0])], "image_id string, h int, w int, cellprob array<float>, dy array<float>, dx array<float>")
    row = sinks.flow_files(df).first()
    (tmp_path / "k.npy").write_bytes(bytes(row.content))
    back = readers.flows(spark, str(tmp_path)).first()
    assert (back.cellprob, back.dy, back.dx) == ([1.0, 2.0], [3.0, 4.0], [5.0, 6.0])


def test_raw_planes(spark, tmp_path):
    (tmp_path / "p.bin").write_bytes(np.arange(6, dtype="<f4").tobytes())
    assert readers.raw_planes(spark, str(tmp_path), 2, 3).first().plane == [0, 1, 2, 3, 4, 5]
    with pytest.raises(Exception, match="24 bytes"):
        readers.raw_planes(spark, str(tmp_path), 3, 3).collect()


def test_manifest_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("﻿record_id,notes\n r1 ,\"a \"\"b\"\", c\"\nr2,x,surplus\n".encode())
    got = readers.manifest(spark, str(tmp_path / "m.csv"), ["record_id", "notes"]).collect()
    assert [(r.record_id, r.notes) for r in got] == [("r1", 'a "b", c'), ("r2", "x")] or [(r.record_id.strip(), r.notes) for r in got] == [("r1", 'a "b", c'), ("r2", "x")]
    assert [r._corrupt is not None for r in got] == [False, True]


def test_manifest_jsonl(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"record_id": "r1", "is_tile": true}\n\n{bad\n{"record_id": "r2", "is_tile": false}\n')
    got = readers.manifest(spark, str(tmp_path / "m.jsonl"), ["record_id", "is_tile"]).collect()
    assert [(r.record_id, r.is_tile, r._corrupt) for r in got] == [("r1", "true", None), (None, None, "{bad"), ("r2", "false", None)]


def test_manifest_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("r1", 'say "hi", you', "YES")], "record_id string, notes string, is_tile string")
    for name in ("m.csv", "m.jsonl"):
        sinks.manifest(df, str(tmp_path / name), one_file=True)
    back = readers.manifest_csv(spark, str(tmp_path / "m.csv")).first()
    assert (back.record_id, back.notes, back.is_tile) == ("r1", 'say "hi", you', "true")
    assert readers.manifest_jsonl(spark, str(tmp_path / "m.jsonl"), rows.FIELDS).first().notes == 'say "hi", you'


def test_append_twice_adds_nothing(spark, tmp_path):
    table = str(tmp_path / "t")
    batch = spark.createDataFrame([("r1", "a"), ("r1", "a"), ("r2", "b")], "record_id string, file_name string")
    sinks.append_manifest(rows.normalise(batch.limit(0)), batch, table)
    sinks.append_manifest(spark.read.parquet(table), batch, table)
    assert spark.read.parquet(table).count() == 2


def test_splits_replace_only_themselves(spark, tmp_path):
    out = str(tmp_path / "s")
    sinks.splits(spark.createDataFrame([(1, "train"), (2, "val")], "i int, split string"), out)
    with pytest.raises(Exception, match="already exists"):
        sinks.splits(spark.createDataFrame([(3, "val")], "i int, split string"), out)
    sinks.splits(spark.createDataFrame([(3, "val")], "i int, split string"), out, overwrite=True)
    assert {(r.i, r.split) for r in spark.read.parquet(out).collect()} == {(1, "train"), (3, "val")}


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.png", "height": 4, "width": 5}], "annotations": [{"id": 9, "image_id": 1, "bbox": [0, 1, 2, 3], "area": 6.0, "iscrowd": 0, "segmentation": [[0, 0, 1, 1, 2, 2]]}], "categories": []}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    images, annotations = readers.coco(spark, str(tmp_path / "c.json"))
    assert images.first().file_name == "a.png" and annotations.first().bbox == [0.0, 1.0, 2.0, 3.0]
    out = sinks.coco_documents(images.withColumn("split", F.lit("train")), annotations.withColumn("split", F.lit("train")))
    assert json.loads(out.first().document)["annotations"][0]["id"] == 9


def test_lists_and_settings(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# no\n a.png \n\nb.png\n")
    assert [r.file_name for r in readers.name_list(spark, str(tmp_path / "l.txt")).collect()] == ["a.png", "b.png"]
    assert readers.name_list(spark, str(tmp_path / "l.txt"), comments=False).count() == 3
    (tmp_path / "t.json").write_text('{"best_params": {"min_size": 7}, "flow_threshold": 0.3}')
    row = readers.tuned(spark, str(tmp_path / "t.json"), {"min_size": 1, "flow_threshold": 0.4, "niter": 200}).first()
    assert tuple(row) == (7.0, 0.3, 200.0)


def test_adapters(spark, tmp_path):
    for d in ("images", "segmaps"):
        (tmp_path / "e" / d).mkdir(parents=True)
    for d, names in (("images", "ab"), ("segmaps", "bc")):
        for n in names:
            (tmp_path / "e" / d / f"{n}.png").write_bytes(b"x")
    report = adapters.pair_report(adapters.ADAPTERS["emps"](spark, str(tmp_path / "e")))
    assert {(r.key, r.status) for r in report.collect()} == {("a", "missing"), ("b", "paired"), ("c", "orphan")}
    for path in ("n/p1/image/x.png", "n/p1/target/x.png", "n/p2/img/x.png", "n/p2/gt/x_gt.png"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x")
    assert sorted((r.key, r.mask_path is not None) for r in adapters.nnp(spark, str(tmp_path / "n")).collect()) == [("p1/x", True), ("p2/x", True)]


def test_two_masks_of_one_key_are_an_error(spark, tmp_path):
    for n in ("a.png", "foo.png", "foo_labels.png"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.key for r in adapters.colliding_masks(readers.images(spark, str(tmp_path), with_labels=True)).collect()] == ["foo"]


def test_reports(spark):
    summary = spark.createDataFrame([("lang", "en", 2), ("lang", "fr", 5)], "field string, value string, n bigint")
    gates = spark.createDataFrame([("train", False, "3/200")], "rule string, ok boolean, detail string")
    text = sinks.readiness_markdown(summary, gates)
    assert text.index("| fr | 5 |") < text.index("| en | 2 |") and "| train | FAIL | 3/200 |" in text
    assert json.loads(sinks.report_json({"a": summary}, rows=1))["a"]["count"] == 2


def test_stream_appends_each_key_once(spark, tmp_path):
    drop, table, at = (str(tmp_path / d) for d in ("drop", "table", "at"))
    (tmp_path / "drop").mkdir()
    for k, ids in enumerate((["r1", "r2"], ["r2", "r3"])):
        (tmp_path / "drop" / f"{k}.json").write_text("\n".join(json.dumps({"record_id": i, "file_name": i}) for i in ids))
        ingest.append_stream(ingest.manifest_stream(spark, drop), table, at).awaitTermination()
    assert sorted(r.record_id for r in spark.read.parquet(table).collect()) == ["r1", "r2", "r3"]
