"""Runs and graphs against drawn maps and one-after-the-other loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granulon.operators import flows, graph, raster, runs, spatial

RUNS = "image string, label int, y int, x0 bigint, x1 bigint"


def frame(spark, maps):
    """Runs of label maps by name."""
    rows = [(name, int(r.label), int(r.y), int(r.x0), int(r.x1)) for name, m in maps.items() for r in flows.runs_of(m.astype(np.int32)).itertuples(index=False)]
    return spark.createDataFrame(rows, RUNS)


def drawn(df, shapes, image="image", label="label"):
    """Label maps of runs, which don't overlap."""
    out = {name: np.zeros(shape, np.int64) for name, shape in shapes.items()}
    for r in df.collect():
        part = out[r[image]][r["y"], r["x0"] : r["x1"]]
        assert len(part) == r["x1"] - r["x0"] > 0 and not part.any()
        part[:] = r[label]
    return out


def same(got, expected):
    assert got.keys() == expected.keys()
    for name in got:
        assert got[name].tolist() == expected[name].tolist(), name


def shapes(maps):
    return {n: m.shape for n, m in maps.items()}


def masks(seed=0):
    rng = np.random.default_rng(seed)
    spiral = np.zeros((41, 150), int)
    spiral[::4], spiral[2::8, :1], spiral[4::8, -1:] = 1, 1, 1
    for k in range(0, 40, 4):
        spiral[k : k + 5, -1 if k % 8 == 0 else 0] = 1
    return {f"r{d}": (rng.random((24, 140)) < d / 10).astype(int) for d in (1, 4, 5, 6, 9)} | {"spiral": spiral, "full": np.ones((3, 200), int), "edge": np.eye(70, dtype=int)}


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components(spark, connectivity):
    maps = masks()
    got = runs.components(frame(spark, maps), connectivity=connectivity, min_area=3)
    same(drawn(got, shapes(maps)), {n: raster.components(m, connectivity, 3) for n, m in maps.items()})


def test_components_across_tiles(spark):
    maps = masks(1)
    whole = frame(spark, maps)
    corner = lambda *v: F.explode(F.array(*map(F.lit, v)))
    tiles = whole.select("image").distinct().withColumn("x0", corner(0, 50, 100, 150)).withColumn("y0", corner(0, 30, 60)).withColumn("x1", F.col("x0") + 50).withColumn("y1", F.col("y0") + 30)
    parts = spatial.to_image(spatial.clip_runs(whole, tiles, "image"), ["x0", "x1"], ["y"])
    assert parts.count() > whole.count()
    same(drawn(runs.components(parts), shapes(maps)), {n: raster.components(m) for n, m in maps.items()})


def test_components_of_labels_do_not_mix(spark):
    got = runs.components(spark.createDataFrame([("i", 1, 0, 0, 5), ("i", 2, 1, 0, 5), ("i", 2, 2, 3, 4), ("i", 1, 3, 0, 1)], RUNS).withColumnRenamed("label", "v"), by=["v"])
    assert sorted((r.v, r.y, r.label) for r in got.collect()) == [(1, 0, 1), (1, 3, 2), (2, 1, 1), (2, 2, 1)]


def test_no_runs(spark):
    none = spark.createDataFrame([], RUNS)
    assert runs.components(none.drop("label")).collect() == [] and runs.fill_holes(none).collect() == [] and runs.overlay(none.withColumn("o", F.lit(1)), "image", "o").collect() == []


def test_holes(spark):
    rng = np.random.default_rng(3)
    maps = {str(k): rng.choice(4, (16, 90), p=p) for k, p in enumerate(([0.4, 0.6, 0, 0], [0.1, 0.5, 0.3, 0.1], [0.3, 0.3, 0.2, 0.2]))}
    ring = np.zeros((30, 160), int)
    ring[2:28, 3:150], ring[5:20, 10:100], ring[8:15, 20:60], ring[10:12, 30:40] = 1, 2, 3, 0
    ring[22:24, 120:130], ring[25, 5:140:3], ring[5:20, 110:140:2] = 0, 0, 0
    open_ = ring.copy()
    open_[3, 3:6] = open_[2, 60] = 0
    maps |= {"ring": ring, "open": open_}
    got = runs.fill_holes(frame(spark, maps))
    same(drawn(got, shapes(maps)), {n: raster.fill_holes(m.astype(np.int32)) for n, m in maps.items()})


def test_pixels_and_back(spark):
    maps = masks(4)
    whole = frame(spark, maps)
    twice = runs.pixels(whole).unionByName(runs.pixels(whole))
    back = runs.of_pixels(twice, ["image", "label"])
    assert sorted(map(tuple, back.select("image", "label", "y", "x0", "x1").collect())) == sorted(map(tuple, whole.collect()))


def test_overlay(spark):
    rng = np.random.default_rng(5)
    rows, expected = [], {n: np.zeros((6, 300), int) for n in "ab"}
    for o in range(80):
        name, y, x0 = "ab"[o % 2], int(rng.integers(6)), int(rng.integers(280))
        x1, label = min(300, x0 + int(rng.choice([1, 5, 60, 200]))), int(rng.integers(1, 9))
        rows.append((name, label, y, x0, x1, o // 3))
    for name, label, y, x0, x1, _ in sorted(rows, key=lambda r: (r[5], r[1])):
        expected[name][y, x0:x1] = label
    got = runs.overlay(spark.createDataFrame(rows, RUNS + ", o int"), "image", "o")
    same(drawn(got, shapes(expected)), expected)
    joined = sorted(map(tuple, got.select("image", "y", "x0", "x1", "label").collect()))
    assert not any(a[:2] == b[:2] and a[3] == b[2] and a[4] == b[4] for a, b in zip(joined, joined[1:]))


def test_erased(spark):
    table = spark.createDataFrame([("i", 1, 0, 0, 100), ("i", 2, 5, 0, 100), ("i", 2, 5, 0, 100), ("j", 1, 0, 0, 9), (None, 3, 0, 0, 9)], "image_id string, label int, y int, x0 bigint, x1 bigint")
    regions = spark.createDataFrame([("i", 10, 0, 20, 3), ("i", 15, 0, 50, 1), ("i", 90, 0, 200, 9), ("i", 30, 0, 40, 1)], "image_id string, x0 int, y0 int, x1 int, y1 int")
    got = sorted((str(r.image_id), r.label, r.x0, r.x1) for r in runs.erased(table, regions).collect())
    assert got == [("None", 3, 0, 9), ("i", 1, 0, 10), ("i", 1, 50, 90), ("i", 2, 0, 90), ("i", 2, 0, 90), ("j", 1, 0, 9)]
    rng = np.random.default_rng(6)
    maps = {"a": rng.choice(3, (40, 90))}
    boxes = [(int(x), int(y), int(x + w), int(y + h)) for x, y, w, h in rng.integers([-5, -5, 1, 1], [90, 40, 30, 12], (12, 4))]
    for x0, y0, x1, y1 in boxes:
        maps["left"] = maps.get("left", maps["a"].copy())
        maps["left"][max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)] = 0
    got = runs.erased(frame(spark, {"a": maps["a"]}), spark.createDataFrame([("a", *b) for b in boxes], "image string, x0 int, y0 int, x1 int, y1 int"), "image")
    same(drawn(got, {"a": maps["a"].shape}), {"a": maps["left"]})


def plain_polygon(points, height, width):
    """Pixel by pixel: an odd number of crossings to the left or at the pixel, or one exactly at it."""
    out = np.zeros((height, width), int)
    ends = list(zip(points, points[1:] + points[:1]))
    for row in range(height):
        at = [x + (row - y) * (nx - x) / (ny - y) for (x, y), (nx, ny) in ends if (y <= row) != (ny <= row)]
        for col in range(width):
            out[row, col] = sum(a <= col for a in at) % 2 or col in at
    return out


def test_polygons(spark):
    rng = np.random.default_rng(7)
    rows, expected = [], {}
    for o in range(12):
        rings = [[(float(a), float(b)) for a, b in np.round(rng.random((int(rng.integers(3, 8)), 2)) * [70, 30] - 8, 1 if o % 2 else 0)] for _ in range(1 + o % 3)]
        rows.append(("i", o, 20, 50, [[v for p in r for v in p] for r in rings]))
        expected[o] = np.max([plain_polygon(r, 20, 50) for r in rings], axis=0)
    rows.append(("i", 99, 20, 50, [[1.0, 1.0, 2.0, 2.0], []]))
    df = spark.createDataFrame(rows, "image_id string, o int, h int, w int, polygons array<array<double>>")
    got = flows.polygon_runs(df, "o")
    same(drawn(got, {o: (20, 50) for o in expected}, "o"), expected)
    covered, number = np.zeros((20, 50), int), {}
    for o in range(12):
        covered[expected[o] > 0] = o + 1
    for k, o in enumerate(sorted(set(covered[covered > 0].tolist())), 1):
        number[o] = k
    same(drawn(flows.label_map(df, "o"), {"i": (20, 50)}, "image_id"), {"i": np.vectorize(lambda v: number.get(v, 0))(covered)})


def kept_one_by_one(nodes, edges):
    gone, near = set(), {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for i, s in sorted(nodes, key=lambda n: (n[1] is None, -(n[1] or 0), n[0])):
        if i not in gone:
            gone |= near.get(i, set()) - {i}
    return sorted(i for i, _ in nodes if i not in gone)


@pytest.mark.parametrize("kind", ["random", "path", "up", "star", "ties", "none"])
def test_kept_in_order(spark, kind):
    rng = np.random.default_rng(8)
    n = 12 if kind == "up" else 40
    score = {"path": lambda i: float(rng.random()), "up": float, "ties": lambda i: float(i % 2), "none": lambda i: None if i % 3 else 1.0}.get(kind, lambda i: float(round(rng.random(), 1)))
    nodes = [(i, score(i)) for i in range(n)]
    edges = [(i, i + 1) for i in range(n - 1)] if kind in ("path", "up") else [(0, i) for i in range(n)] if kind == "star" else [tuple(map(int, rng.integers(0, n, 2))) for _ in range(60)]
    got = graph.kept_in_order(spark.createDataFrame([("g", *v) for v in nodes], "g string, id int, s double"), spark.createDataFrame([("g", *e) for e in [*edges, *edges[:3]]], "g string, a int, b int"), "g", "id", F.col("s"))
    assert sorted(r.id for r in got.collect()) == kept_one_by_one(nodes, edges)


def test_the_surest_detection_stays(spark):
    parts = spark.createDataFrame([(1, k, s) for k, s in zip("abcd", (0.5, 0.9, 0.7, 0.1))], "image bigint, id string, score double")
    near = spark.createDataFrame([(1, "a", "b"), (1, "a", "c")], "image bigint, a string, b string")
    assert sorted(r.id for r in graph.kept_in_order(parts, near, "image", "id", F.col("score")).collect()) == ["b", "c", "d"]
    assert graph.kept_in_order(parts, near.limit(0), "image", "id", F.col("score")).count() == 4


def test_components_of_groups(spark):
    edges = [("g", 1, 2), ("g", 2, 3), ("h", 1, 3), ("h", 9, 8), ("g", 5, 5), ("g", None, 1), ("g", 3, 1)] + [("long", i, i + 1) for i in range(100)]
    got = {(r.g, r.node): r.root for r in graph.components(spark.createDataFrame(edges, "g string, a int, b int"), ["g"]).collect()}
    assert got == {("g", 1): 1, ("g", 2): 1, ("g", 3): 1, ("h", 1): 1, ("h", 3): 1, ("h", 8): 8, ("h", 9): 8} | {("long", i): 0 for i in range(101)}


def test_polygons_are_filled_in_their_own_rows(spark):
    """Only runs that touch are shuffled; rings that cross themselves or hold no number are no trouble."""
    rows = [(1, [[0.0, 0.0, 4.0, 0.0, 4.0, 3.0, 0.0, 3.0]]), (2, [[0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 2.0], [1.0, 0.0, 6.0, 0.0, 6.0, 1.0, 1.0, 1.0]]), (3, [[0.0, 0.0, 4.0, 0.0, float("nan"), 4.0]]), (4, [[0.0, 0.0, 4.0, None, 4.0, 4.0]]), (5, [])]
    found = runs.of_polygons(spark.createDataFrame(rows, "id int, p array<array<double>>"), ["id"], "p", F.lit(10), F.lit(10))
    assert sorted(map(tuple, found.collect())) == [(1, 0, 0, 5), (1, 1, 0, 5), (1, 2, 0, 5), (2, 0, 0, 7), (2, 1, 0, 3)]
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    one = runs.of_polygons(spark.createDataFrame(rows, "id int, p array<array<double>>"), ["id"], "p", F.lit(10), F.lit(10)).where("id = 1")
    assert one.count() == 3


def test_small_images_need_no_rounds_of_links(spark, monkeypatch):
    """F2, F16, F18: what lies within a band is found in one shuffle, without joins of all runs."""

    def never(*_):
        raise AssertionError("rounds of links")

    monkeypatch.setattr(runs.graph, "components", never)
    ring = [("i", 1, y, x, x + 1) for y in range(3) for x in range(3) if (y, x) != (1, 1)]
    df = spark.createDataFrame(ring, "image string, label int, y bigint, x0 bigint, x1 bigint")
    assert {r.label for r in runs.components(df.drop("label")).collect()} == {1}
    assert sorted(tuple(r) for r in runs.fill_holes(df).collect()) == [("i", y, 0, 3, 1) for y in range(3)]


def test_parts_and_holes_across_bands(spark):
    """A comb whose teeth meet far below, and a hole and an open shaft that pass several bands; rows may be negative."""
    low, high = -300, 2 * runs.BAND + 90
    schema = "image string, label int, y bigint, x0 bigint, x1 bigint"
    teeth = [("i", 1, y, x, x + 1) for y in range(low, high) for x in (0, 4, 8)] + [("i", 1, high, 0, 5)]
    found = runs.components(spark.createDataFrame(teeth, schema).drop("label"))
    assert {(r.x0, r.label) for r in found.where(f"y < {high}").collect()} == {(0, 1), (4, 1), (8, 2)}
    walls = [("i", 1, y, x, x + 1) for y in range(low, high) for x in (0, 4, 8)] + [("i", 1, high, 0, 9), ("i", 1, low - 1, 0, 5)]
    inside = runs.holes(spark.createDataFrame(walls, schema)).collect()
    assert {(r.x0, r.x1) for r in inside} == {(1, 4)} and sorted(r.y for r in inside) == list(range(low, high))


def test_parts_by_numbers_are_those_of_pixels(spark):
    """first_of_parts against a plain search, on rows of many groups at once."""
    rng = np.random.default_rng(3)
    for reach in (0, 1):
        rows = []
        for g in range(4):
            for y in sorted(rng.choice(12, 9, replace=False)):
                mask = np.concatenate(([0], rng.random(20) < 0.5, [0])).astype(int)
                edges = np.flatnonzero(np.diff(mask))
                rows += [(g, int(y), int(a) - 5, int(b) - 5) for a, b in zip(edges[::2], edges[1::2])]
        g, y, x0, x1 = (np.array(v) for v in zip(*rows))
        want = np.arange(len(rows))
        for _ in rows:
            for i in range(len(rows)):
                near = (g == g[i]) & (abs(y - y[i]) == 1) & (np.maximum(x0, x0[i]) < np.minimum(x1, x1[i]) + reach)
                want[i] = min([want[i], *want[near]])
        assert runs.first_of_parts(g, y, x0, x1, reach).tolist() == want.tolist()


def test_label_map_is_shuffled_by_band_and_image(spark):
    """polygons' runs go to their band once, what is seen to its image once."""
    square = [0.0, 0.0, 4.0, 0.0, 4.0, 4.0, 0.0, 4.0]
    df = spark.createDataFrame([("i", 64, 64, 1, [square]), ("i", 64, 64, 2, [square])], "image_id string, h int, w int, o int, polygons array<array<double>>")
    found = flows.label_map(df, "o")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 2
    assert {r.label for r in found.collect()} == {1} and sum(r.x1 - r.x0 for r in found.collect()) == 20


def test_nodes_without_links_are_not_sorted(spark):
    """all nodes stream past the few that have links; candidates of any reach are found as before."""
    rows = [("i", f"p{k}", float(40 + 1600 * k), 700.0, 12.0, 12.0, k % 2, 0) for k in range(-3, 9)] + [("i", f"q{k}", float(60 + 1600 * k), 700.0, 12.0, 12.0, 2, 0) for k in range(-3, 9)]
    far = [("i", "wide", 0.0, 650.0, 9000.0, 100.0, 5, 0), ("i", "wide2", 10.0, 650.0, 9000.0, 100.0, 6, 0)]
    df = spark.createDataFrame(rows + far, "image string, id string, x double, y double, w double, h double, tile_x int, tile_y int")
    found = spatial.cross_tile_candidates(df, "image", "id")
    assert {(r.a, r.b) for r in found.collect()} == {(f"p{k}", f"q{k}") for k in range(-3, 9)} | {("wide", "wide2")}
    kept = graph.kept_in_order(df, found.drop("iou", "distance"), "image", "id", F.col("x"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Window" not in plan
    assert {r.id for r in kept.collect()} == {f"q{k}" for k in range(-3, 9)} | {"wide2"}


def test_boundary_across_squares(spark):
    """one shuffle, whatever labels; pixels of other squares and negative places count, repeated ones too, null labels don't."""
    from granulon.operators import matching

    rng = np.random.default_rng(5)
    rows = [("i", int(x) - 70, int(y) - 3, int(v) if v else None) for x, y, v in zip(rng.integers(0, 140, 3000), rng.integers(0, 70, 3000), rng.integers(0, 4, 3000))] + [("j", 0, 0, 1)]
    df = spark.createDataFrame(rows, "image string, x bigint, y bigint, v int")
    found = matching.boundary(df, "image", "v")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    at = {}
    for image, x, y, v in rows:
        if v is not None:
            at.setdefault((image, x, y), set()).add(v)
    around = lambda i, x, y: set().union(*(at.get((i, x + a, y + b), set()) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    want = sorted((i, v, x, y) for i, x, y, v in rows if v and len(around(i, x, y)) > 1)
    assert sorted(tuple(r) for r in found.collect()) == want


def test_polygons_are_filled_by_arrays(spark, monkeypatch):
    """nothing is shuffled, sorted or interpreted by element in Spark; some rows are worked out at a time, one of many crossings alone."""
    rng = np.random.default_rng(11)
    many = [[[(float(a), float(b)) for a, b in np.round(rng.random((int(rng.integers(3, 9)), 2)) * [60, 30] - 8, 1 if o % 2 else 0)] for _ in range(o % 4)] for o in range(30)]
    flat = [[[v for p in r for v in p] for r in rings] for rings in many]
    flat[3], many[3] = None, []
    flat[4] = [None, [0.0, 0.0, 9.0, 0.0, 9.0, float("inf")], [1.0, 1.0, 1e300, 1.0, 1e300, 1e300, 1.0, 1e300], [2.0, None, 3.0, 3.0, 2.0, 9.0]]
    many[4] = [[(1.0, 1.0), (90.0, 1.0), (90.0, 90.0), (1.0, 90.0)]]
    want = [np.max([np.zeros((20, 40), int), *(plain_polygon(r, 20, 40) for r in rings)], axis=0).tolist() for rings in many]
    batch = runs.pa.RecordBatch.from_pydict({"_p": runs.pa.array(flat, runs.pa.list_(runs.pa.list_(runs.pa.float64()))), "_h": [20] * 30, "_w": [40] * 30})
    for limit, pieces in ((1, 20), (60, 4), (1 << 19, 1)):
        monkeypatch.setattr(runs, "CROSSINGS", limit)
        found = list(runs._lines(batch, True))
        assert len(found) >= pieces
        maps = np.zeros((30, 20, 40), int)
        for row, y, x0, x1 in (r for part in found for r in zip(*part)):
            assert x0 == 0 or not maps[row, y, x0 - 1 : x1].any()  # touching runs are one
            maps[row, y, x0:x1] += 1
        assert maps.tolist() == want
    df = spark.createDataFrame([(o, p, None) for o, p in enumerate(flat)], "id int, p array<array<double>>, h int")
    found = runs.of_polygons(df.where("id <> 4"), ["id"], "p", F.col("h"), F.lit(40))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "lambda" not in plan
    # Without a height there is no lowest line.
    assert found.where("y < 20").agg(F.sum(F.col("x1") - F.col("x0"))).first()[0] == sum(np.sum(w) for o, w in enumerate(want) if o != 4)


def test_overlays_are_worked_out_by_arrays(spark, monkeypatch):
    """the last run over each place, for many bands at once; a band of more rows is held as what is seen so far."""
    rng = np.random.default_rng(12)
    n = 400
    group, y, x0 = np.sort(rng.integers(0, 3, n)), rng.integers(0, runs.BAND, n) // 64 * 85, rng.integers(-20, 90, n)
    x1, code = x0 + rng.choice([1, 2, 7, 64, 65], n), rng.integers(0, 5, n)
    want = {}
    for i in range(n):
        want |= {(int(group[i]), int(y[i]), x): int(code[i]) for x in range(x0[i], x1[i])}
    of, left, right = runs.topmost(group, y, x0, x1, code)
    got = [((int(group[i]), int(y[i]), x), int(code[i])) for i, a, b in zip(of, left, right) for x in range(a, b)]
    assert len(got) == len(want) and dict(got) == want
    seen = sorted((group[i], y[i], a, b, code[i]) for i, a, b in zip(of, left, right))
    assert not any(a[:2] == b[:2] and a[3] == b[2] and a[4] == b[4] for a, b in zip(seen, seen[1:]))
    monkeypatch.setattr(runs, "HELD", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(str(g), int(v), int(a), int(b), i // 3, int(k)) for i, (g, v, a, b, k) in enumerate(zip(group, y, x0, x1, code))]
        last = {}
        for g, v, a, b, _, k in sorted(rows, key=lambda r: (r[4], r[5])):
            last |= {(g, v, x): k for x in range(a, b)}
        found = runs.overlay(spark.createDataFrame(rows, "image string, y int, x0 bigint, x1 bigint, o int, label int"), "image", "o").collect()
        assert {(r.image, r.y, x): r.label for r in found for x in range(r.x0, r.x1)} == last and sum(r.x1 - r.x0 for r in found) == len(last)
        squares = [("i", 600, 64, o // 2, [[float(v) for v in (a, b, a + 9, b, a + 9, b + 300, a, b + 300)]]) for o, (a, b) in enumerate(rng.integers(0, 50, (40, 2)).tolist())]
        df = spark.createDataFrame(squares, "image_id string, h int, w int, o int, polygons array<array<double>>")
        top = np.full((600, 64), -1)
        for _, _, _, o, ((a, b, *_),) in squares:
            top[int(b) : int(b) + 300, int(a) : int(a) + 10] = o
        number = {v: k for k, v in enumerate(sorted(set(top[top >= 0].tolist())), 1)}
        same(drawn(flows.label_map(df, "o"), {"i": top.shape}, "image_id"), {"i": np.vectorize(lambda v: number.get(v, 0))(top)})
        plan = flows.label_map(df, "o")._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "lambda" not in plan
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
