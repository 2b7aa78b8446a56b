"""Annotations, contours and resizing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granulon.operators import annotations as ann
from granulon.operators import raster


@pytest.fixture(scope="module")
def tables(spark):
    images = spark.createDataFrame([(1, "a.png"), (2, "b.png"), (3, "c_mask.png")], "id bigint, file_name string")
    rows = [
        (1, 1, [0.0, 0.0, 2.0, 3.0], "[[0,0,1,1,2,2]]", 0), (2, 1, [0.0, 0.0, 0.0, 3.0], "[[1,1,4,1,4,6]]", 0), (3, 2, [1.0], "[[1,1]]", 0), (4, 9, [0.0, 0.0, 1.0, 1.0], '{"counts":[1],"size":[1,1]}', 1),
        (5, 3, None, None, None),
    ]
    annotations = spark.createDataFrame(rows, "id bigint, image_id bigint, bbox array<double>, segmentation string, iscrowd int")
    files = spark.createDataFrame([("a.png",), ("c_mask.png",), ("d.png",)], "file_name string")
    return images, annotations, files


def test_checks(tables):
    got = {tuple(r) for r in ann.checks(*tables).collect()}
    assert got == {("not_on_disk", "b.png"), ("not_in_document", "d.png"), ("orphan", "4"), ("bad_box", "2"), ("bad_box", "3"), ("bad_box", "5"), ("bad_segmentation", "3"), ("bad_segmentation", "5")}


def test_repair_and_clean(tables):
    _, annotations, _ = tables
    assert {(r.id, tuple(r.bbox)) for r in ann.repaired(annotations).collect()} == {(1, (0, 0, 2, 3)), (2, (1, 1, 3, 5)), (4, (0, 0, 1, 1))}
    assert sorted(r.id for r in ann.instances(annotations).collect()) == [1, 2, 3, 5]
    kept, own = ann.on_disk(*tables)
    assert [r.file_name for r in kept.collect()] == ["a.png"] and sorted(r.id for r in own.collect()) == [1, 2]
    assert {tuple(r) for r in ann.clean_plan(*tables).collect()} == {("images", 3, 1), ("annotations", 5, 2), ("boxes", 2, 2)}


def test_merge(spark):
    im = lambda *r: spark.createDataFrame(r, "id bigint, file_name string")
    an = lambda *r: spark.createDataFrame(r, "id bigint, image_id bigint")
    images, annotations = ann.merged([(im((5, "a"), (6, "b")), an((1, 5), (2, 6), (3, 6))), (im((5, "b"), (7, "c")), an((1, 5), (9, 7)))])
    assert {(r.id, r.file_name) for r in images.collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert sorted((r.id, r.image_id) for r in annotations.collect()) == [(1, 1), (2, 2), (3, 2), (4, 3)]


def test_later_annotations_cover_earlier(spark):
    df = spark.createDataFrame([("i", 1, 0), ("i", 1, 1), ("i", 2, 0), ("i", 2, 1), ("i", 7, 1), ("i", 7, 2)], "image string, o int, x int")
    assert {(r.x, r.label) for r in ann.overlay(df, "image", "o", ["x"]).collect()} == {(0, 1), (1, 2), (2, 2)}


def test_label_rules(spark):
    rows = [(1, 0)] * 5 + [(1, 1)] * 5 + [(2, 1)] * 9 + [(2, 0)] + [(3, 0)] * 4 + [(4, -1), (4, 2)]
    got = {tuple(r) for r in ann.label_rules(spark.createDataFrame(rows, "image int, v int"), "image", "v").collect()}
    assert got == {(2, "too_large"), (3, "no_instance"), (4, "negative_label"), (4, "no_background")}
    assert ann.label_rules(spark.createDataFrame([(3, 0)], "image int, v int"), "image", "v", allow_empty=True).count() == 0


def test_set_leaks(spark):
    df = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert [r.set_id for r in ann.set_leaks(df("nist_set1_a", "nist_set2_b"), df("nist_set2_c", "other"), "name").collect()] == ["2"]


def test_contour_of_rectangles_and_lines():
    mask = np.zeros((9, 9), int)
    mask[2:6, 3:8] = 1
    points = raster.contour(mask)
    assert len(points) == 14 and raster.polygon_area(points) == 12.0 and raster.perimeter(points) == 14.0
    got = raster.form_metrics(mask)
    assert got["area"] == 20 and got["solidity"] == pytest.approx(1.0)
    assert raster.contour(np.eye(1, dtype=int)).tolist() == [[0, 0]]
    assert raster.perimeter(raster.contour(np.ones((1, 4), int))) == 6.0
    assert not len(raster.contour(np.zeros((3, 3), int)))


def test_contours_are_borders_of_random_parts():
    rng = np.random.default_rng(2)
    for _ in range(60):
        labels = raster.components(rng.random((10, 10)) < 0.55)
        for i in np.unique(labels[labels > 0]):
            own = labels == i
            points = raster.contour(own)
            outside = raster.components(~np.pad(own, 1), connectivity=4)
            edge = np.pad(outside == outside[0, 0], 0)
            touching = np.zeros_like(own)
            for dy, dx in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                touching |= edge[1 + dy : 11 + dy, 1 + dx : 11 + dx]
            assert set(map(tuple, points.tolist())) == {(x, y) for y, x in zip(*np.nonzero(own & touching))}
            steps = np.abs(points - np.roll(points, -1, axis=0)).max(axis=1)
            assert len(points) == 1 or (steps == 1).all()


def test_hull():
    points = np.array([[0, 0], [4, 0], [4, 4], [0, 4], [2, 2], [2, 0]])
    assert raster.polygon_area(raster.convex_hull(points)) == 16.0


def test_square_and_back():
    labels = np.zeros((40, 80), int)
    labels[10:30, 20:60] = 1
    square, how = raster.fit_square(labels, 128, pad=0)
    assert (how["height"], how["width"], how["top"], how["left"]) == (64, 128, 32, 0)
    back = raster.to_original((square > 0.5).astype(int), how, 40, 80, stride=1)
    assert (back != labels).mean() < 0.05
    low = raster.suppress_padding(np.zeros((32, 32), np.float32), how)
    assert (low[:8] == -100).all() and (low[8:24] == 0).all()
    assert raster.normalise(np.full((2, 2, 3), 255.0), (0.5,) * 3, (0.5,) * 3).tolist() == np.ones((3, 2, 2)).tolist()
    assert raster.to_8_bit(np.array([[0, 500, 1000]], np.uint16)).tolist() == [[0, 127, 255]]


def test_turned_flow_is_the_flow_of_the_turned_image():
    labels = np.zeros((20, 24), int)
    labels[4:15, 3:12] = 1
    dy, dx = raster.flow_of_masks(labels)
    for quarters, mirror in ((0, True), (1, False), (2, False), (3, True)):
        image = np.rot90(labels[:, ::-1] if mirror else labels, quarters)
        got, expected = raster.turned(dy, dx, quarters, mirror), raster.flow_of_masks(image)
        inside = image > 0
        assert np.mean([np.abs(a - b)[inside].mean() for a, b in zip(got, expected)]) < 0.05


def test_audits_hold_no_table_whole(spark):
    """neither keys nor names are broadcast or gathered in one table; equal and null names are as before."""
    from granulon.operators import audit

    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "n string")
    b = spark.createDataFrame([("y",), ("z",), (None,), (None,)], "n string")
    names, lost = audit.name_differences(a, b, "n", "left", "right"), audit.orphans(a, b, "n", "n")
    for df in (names, lost):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "FullOuter" not in plan
    assert sorted(map(str, (tuple(r) for r in names.collect()))) == sorted(map(str, [("x", "left"), (None, "left"), ("z", "right"), (None, "right")]))
    assert sorted(str(r.n) for r in lost.collect()) == ["None", "x", "x"]
