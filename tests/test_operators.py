"""Hand-computed cases and properties of the relational operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granulon.functions import scalars
from granulon.operators import audit, dedup, manifest, matching, raster, recipe, sampling, spatial, stats, tuning

c = F.col


def values(spark, column, *args):
    return [r[0] for r in spark.createDataFrame([(a,) for a in args], "v string").select(column(F.col("v"))).collect()]


def test_flags(spark):
    assert values(spark, scalars.flag, " TRUE ", "y", "1", "no", "0", "", "maybe", None) == ["true", "true", "true", "false", "false", "", "maybe", ""]


def test_microscopes(spark):
    names = ("tio2_tsem_a.png", "nist_set1_x.png", "emps_1.png", "cryo_a.png", "nnp_a.png", "a_tile_0_768.png")
    assert values(spark, scalars.microscope_of_file, *names) == ["TSEM", "SEM", "SEM", "CryoEM", "TEM", "unknown"]
    assert values(spark, scalars.microscope_of_directory, "x_TSEM", "a_sem", "b_tem", "c_optical", "d") == ["TSEM", "SEM", "TEM", "optical", "unknown"]
    assert values(spark, scalars.format_of_directory, "my_NIST_x", "EMPS", "nNPipe", "TiO2-b", "z") == ["nist", "emps", "nnp", "tio2", "generic"]
    assert values(spark, scalars.split_group, "NIST_set12_a.png", "b.png") == ["nist_set12", "b.png"]
    assert values(spark, scalars.noise_contrast_kept, "a_34_7", "a_35_7", "a_34_6", "a_x_7", "a") == [True, False, False, False, False]


@pytest.mark.parametrize("length,starts", [(900, {0}), (1024, {0}), (1025, {0, 1}), (1792, {0, 768}), (2600, {0, 768, 1536, 1576})])
def test_tile_starts(spark, length, starts):
    assert set(spark.range(1).select(spatial.tile_starts(F.lit(length))).first()[0]) == starts


def test_tiles_cover_each_pixel(spark):
    rng = random.Random(1)
    sizes = [(i, rng.randint(1, 4000), rng.randint(1, 4000)) for i in range(30)]
    tiles = spatial.tile_grid(spark.createDataFrame(sizes, "image int, h int, w int"), "h", "w").collect()
    for i, h, w in sizes:
        for a, b, n in (("x0", "x1", w), ("y0", "y1", h)):
            spans = sorted({(t[a], t[b]) for t in tiles if t.image == i})
            assert spans[0][0] == 0 and max(s[1] for s in spans) == n
            assert all(later[0] <= before[1] for before, later in zip(spans, spans[1:]))


@pytest.mark.parametrize("n,quota", [(3, 0), (4, 1), (5, 1), (15, 2), (25, 2)])
def test_split_quota(spark, n, quota):
    units = spark.createDataFrame([(f"u{i}", "s", 1) for i in range(n)], "unit string, stratum string, n_rows int")
    assert sampling.stratified_split(units, 0.1).where("split = 'val'").count() == quota


def test_backfill_stops_when_it_has_enough(spark):
    units = spark.createDataFrame([(f"u{i}", "big" if i < 20 else f"s{i}", 3) for i in range(26)], "unit string, stratum string, n_rows int")
    got = sampling.stratified_split(units, 0.1, min_val_rows=20).collect()
    chosen = [r for r in got if r.split == "val"]
    assert sum(r.n_rows for r in chosen) == 21 and all(r.stratum == "big" for r in chosen)
    assert len(got) == 26


def test_places_in_large_strata(spark):
    """Nine tenths of a million units are one stratum: the same places as by ordering it, and no window over it."""
    units = spark.range(1_000_000).select(F.col("id").alias("unit"), F.when(F.col("id") % 10 == 0, F.when(F.col("id") % 7 != 0, F.col("id") % 7)).otherwise(99).alias("stratum"))
    got = sampling.ranked(units, "stratum", sampling.hash_order(42, F.col("unit")), "unit")
    plain = Window.partitionBy("stratum")
    order = sampling.hash_order(42, F.col("unit"))
    expected = units.select("unit", F.row_number().over(plain.orderBy(order, "unit")).alias("r"), F.count("*").over(plain).alias("n"))
    assert got.join(expected, "unit").where("_r = r AND _n = n").count() == got.count() == 1_000_000
    plan = sampling.stratified_split(units.withColumn("n_rows", F.lit(1)), 0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number()" in plan and not any("row_number()" in line and "_d#" not in line for line in plan.splitlines() if "Window" in line)
    val = sampling.stratified_split(units.withColumn("n_rows", F.lit(1)), 0.1).where("split = 'val'").groupBy("stratum").count()
    assert {r[0]: r[1] for r in val.collect()}[99] == 90_000


def test_places_of_equal_orders(spark):
    """An order that isn't spread at all is still exact."""
    units = spark.range(100).select(F.col("id").alias("unit"), F.lit("s").alias("stratum"))
    got = sampling.ranked(units, "stratum", F.lit("ab"), "unit").collect()
    assert all(r._r == r.unit + 1 and r._n == 100 for r in got)


def test_group_split_leaves_both_sides_something(spark):
    units = spark.createDataFrame([(i, s) for s, n in ((1, 1), (2, 2), (3, 6), (4, 10)) for i in range(s * 100, s * 100 + n)], "unit int, stratum int")
    got = {r.stratum: r.n for r in sampling.group_split(units).where("split = 'train'").groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 1, 2: 1, 3: 5, 4: 8}


def test_pairs(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "k string") for s in ("abc", "bcd"))
    assert {(r.k, r.status) for r in audit.pair_audit(a, b, "k").collect()} == {("a", "missing"), ("b", "paired"), ("c", "paired"), ("d", "orphan")}
    with pytest.raises(Exception, match="no partner for a"):
        audit.strict_pairs(a, b, "k").collect()


def test_rename(spark):
    df = spark.createDataFrame([(1, "a.png"), (2, "a.png"), (3, "b"), (4, "a.png"), (5, "b")], "i int, name string")
    assert [r.new_name for r in audit.renamed(df, "name", ["i"]).orderBy("i").collect()] == ["a.png", "a_1.png", "b", "a_2.png", "b_1"]


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    row = df.agg(*[F.round(stats.percentile("v", q), 6) for q in (10, 50, 90)], stats.upper_median("v")).first()
    assert list(row) == [1.3, 2.5, 3.7, 3.0]
    assert df.limit(0).agg(stats.percentile("v", 50), stats.upper_median("v")).first()[0] == 0.0


def test_percentiles_by_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1.0, 2.0, rng.uniform(-9, 9)])) for _ in range(500)] + [("only null", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = (0, 10, 33.3, 50, 90, 100)
    for keys in (["k"], []):
        expected = df.groupBy(*keys).agg(F.count("v").alias("n"), *[stats.percentile("v", q).alias(f"p{q:g}") for q in qs])
        flat = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in d.collect())
        assert flat(stats.percentiles(df, keys, "v", qs)) == flat(expected)
    assert [tuple(r) for r in stats.percentiles(df.limit(0), [], "v", [50]).collect()] == [(0, 0.0)]
    assert stats.percentiles(df.limit(0), ["k"], "v", [50]).count() == 0


def test_boxes_in_tiles_equal_all_against_all(spark):
    rng = random.Random(4)
    images = spark.createDataFrame([(1, 2500, 3100), (2, 700, 900), (3, 1024, 1024)], "image int, h int, w int")
    tiles = spatial.tile_grid(images, "h", "w").select("image", "x0", "y0", "x1", "y1")
    boxes = [(rng.randint(1, 3), i, rng.randint(-50, 3000), rng.randint(-50, 2400), rng.choice([0, 1, 40, 1024, 2600]), rng.choice([0, 1, 40, 1024, 2600])) for i in range(150)]
    df = spark.createDataFrame(boxes + [(1, 999, None, 3, 4, 5)], "image int, id int, x int, y int, w int, h int")
    expected = {(i, t.x0, t.y0) for g, i, x, y, w, h in boxes for t in tiles.collect() if t.image == g and x < t.x1 and x + w > t.x0 and y < t.y1 and y + h > t.y0}
    got = [(r.id, r.tile_x, r.tile_y) for r in spatial.boxes_in_tiles(df, tiles, "image").collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_box_overlap_and_adhesion(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 12.0, 0.0, 10.0, 10.0), (1, 3, 40.0, 0.0, 10.0, 10.0), (2, 1, 0.0, 0.0, 5.0, 5.0)], "image int, id int, x double, y double, w double, h double")
    pairs = spatial.overlapping_pairs(spatial.expanded(df, F.lit(100), F.lit(100)), "image", "id", cell=16.0)
    assert [tuple(r) for r in pairs.collect()] == [(1, 1, 2)]
    assert {r.image: round(r.adhesion_ratio, 6) for r in spatial.adhesion(df, pairs, "image").collect()} == {1: 0.333333, 2: 0.0}


@pytest.mark.parametrize("cell", [7.0, 64.0, 1000.0])
def test_overlap_equals_all_against_all(spark, cell):
    rng = random.Random(3)
    boxes = [(1, i, rng.uniform(0, 200), rng.uniform(0, 200), rng.uniform(1, 60), rng.uniform(1, 60)) for i in range(80)]
    grown = spatial.expanded(spark.createDataFrame(boxes, "image int, id int, x double, y double, w double, h double"), F.lit(256), F.lit(256))
    e = {r.id: r for r in grown.collect()}
    expected = {(a, b) for a in e for b in e if a < b and min(e[a].ex1, e[b].ex1) > max(e[a].ex0, e[b].ex0) and min(e[a].ey1, e[b].ey1) > max(e[a].ey0, e[b].ey0)}
    got = [(r.a, r.b) for r in spatial.overlapping_pairs(grown, "image", "id", cell).collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_rle(spark):
    df = spark.createDataFrame([("i", k, n) for k, n in enumerate([1, 2, 3])], "image string, k int, n int")
    row = spatial.rle_runs(df, "image", ["k"], "n", 2).first()
    cells = {(p % 2, p // 2) for p in range(row.start, row.stop)}
    assert cells == {(1, 0), (0, 1)} and (row.x, row.y) == (0, 1)


def test_edge_rules(spark):
    side = F.lit(100)
    at = lambda rule, *b: spark.range(1).select(scalars.touches_edge(rule, *map(F.lit, b), side, side)).first()[0]
    assert [at(r, 1, 50, 5, 5) for r in ("sample", "label", "margin", "tile")] == [True, False, True, False]
    assert [at(r, 50, 50, 49, 5) for r in ("sample", "label", "margin", "tile")] == [True, False, True, False]
    assert [at(r, 50, 50, 50, 5) for r in ("sample", "label", "margin", "tile")] == [True] * 4
    assert [at(r, 50, 50, 48, 5) for r in ("sample", "label", "margin", "tile")] == [False, False, True, False]


def pixels(spark, *maps):
    rows = []
    for i, (pred, gt) in enumerate(maps):
        for y in range(pred.shape[0]):
            for x in range(pred.shape[1]):
                rows.append((i, x, y, int(pred[y, x]), int(gt[y, x])))
    return spark.createDataFrame(rows, "image int, x int, y int, pred int, gt int")


def test_matching_tie_and_empty(spark):
    gt, pred = np.zeros((4, 4), int), np.zeros((4, 4), int)
    gt[0, :4], pred[0, :2], pred[0, 2:] = 1, 1, 2
    px = pixels(spark, (pred, gt), (np.zeros((2, 2), int), np.zeros((2, 2), int)), (np.zeros((2, 2), int), np.ones((2, 2), int)))
    found = matching.match(matching.contingency(px, "image"), "image").collect()
    assert [(r.image, r.pred, r.gt, r.iou) for r in found] == [(0, 2, 1, 0.5)]
    assert [r.pred for r in matching.match(matching.contingency(px, "image"), "image", ties="lowest").collect()] == [1]
    edges = matching.boundary(px, "image", "pred"), matching.boundary(px, "image", "gt")
    m = {r.image: r for r in matching.contour_report(matching.image_metrics(px, "image", edges=edges)).collect()}
    assert (m[0].precision, m[0].recall, m[0].over_split) == (0.5, 1.0, 1)
    assert all(m[1][k] == 1.0 for k in ("pix_iou", "mask_iou_mean", "boundary_iou_mean", "precision", "recall", "instance_f1", "small_recall"))
    assert not m[1].review_required and m[2].review_required and m[2].false_negatives == 1


def greedy(pred, gt):
    pairs = []
    for p in np.unique(pred[pred > 0]):
        for g in np.unique(gt[gt > 0]):
            i, u = ((pred == p) & (gt == g)).sum(), ((pred == p) | (gt == g)).sum()
            if i / u >= 0.5:
                pairs.append((i / u, p, g))
    out, ps, gs = set(), set(), set()
    for iou, p, g in sorted(pairs, reverse=True):
        if p not in ps and g not in gs:
            out.add((int(p), int(g)))
            ps.add(p)
            gs.add(g)
    return out


def test_matching_equals_greedy_on_random_maps(spark):
    rng = np.random.default_rng(4)
    maps = []
    for _ in range(60):
        gt = rng.integers(0, 4, (4, 5))
        maps.append((np.where(rng.random((4, 5)) < 0.35, rng.integers(0, 4, (4, 5)), gt), gt))
    found = matching.match(matching.contingency(pixels(spark, *maps), "image"), "image").collect()
    for i, (pred, gt) in enumerate(maps):
        assert {(r.pred, r.gt) for r in found if r.image == i} == greedy(pred, gt)


def test_boundary_equals_erosion(spark):
    rng = np.random.default_rng(5)
    labels = np.kron(rng.integers(0, 3, (3, 3)), np.ones((4, 4), int))
    padded = np.pad(labels, 1, mode="edge")
    inside = np.all([padded[a : a + 12, b : b + 12] == labels for a in range(3) for b in range(3)], axis=0)
    expected = {(x, y) for y, x in zip(*np.nonzero((labels > 0) & ~inside))}
    assert {(r.x, r.y) for r in matching.boundary(pixels(spark, (labels, labels)), "image", "gt").collect()} == expected


def test_cross_tile_candidates_equal_all_against_all(spark):
    rng = random.Random(9)
    parts = [(1, i, rng.uniform(0, 500), rng.uniform(0, 500), *(2 * [rng.choice([5.0, 20.0, 90.0, 300.0])]), rng.randint(0, 1), 0) for i in range(90)]
    df = spark.createDataFrame(parts, "image int, id int, x double, y double, w double, h double, tile_x int, tile_y int")

    def same(a, b):
        w = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
        h = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
        iou = w * h / (a[4] * a[5] + b[4] * b[5] - w * h)
        d = np.hypot(a[2] + a[4] / 2 - b[2] - b[4] / 2, a[3] + a[5] / 2 - b[3] - b[5] / 2)
        areas = sorted((a[4] * a[5], b[4] * b[5]))
        return iou > 0.5 or (d <= 50 and areas[1] <= 2 * areas[0])

    for compat in (False, True):
        expected = {(a[1], b[1]) for a in parts for b in parts if a[1] < b[1] and same(a, b) and (compat or a[6] != b[6])}
        got = [(r.a, r.b) for r in spatial.cross_tile_candidates(df, "image", "id", compat=compat).collect()]
        assert set(got) == expected and len(got) == len(expected)


def test_core_zone(spark):
    at = lambda cx, cy, left, right: spark.range(1).select(spatial.in_core(F.lit(cx), F.lit(cy), F.lit(1024), F.lit(1024), F.lit(left), F.lit(False), F.lit(right), F.lit(False))).first()[0]
    assert at(10, 500, True, False) and not at(10, 500, False, False) and at(1000, 500, False, True) and not at(1000, 500, True, False)


def test_upsert_and_append(spark):
    old = spark.createDataFrame([("h1", "a"), ("h2", "b"), (None, "x")], "h string, name string")
    new = spark.createDataFrame([("h2", "z"), ("h3", "c"), ("h3", "d"), (None, "y")], "h string, name string")
    got = {(r.h, r.action, r.name) for r in dedup.upsert_plan(old, new, "h", "name").collect()}
    assert got == {("h1", "keep", "a"), ("h2", "replace", "b"), ("h3", "insert", "c")}
    assert [tuple(r) for r in dedup.append_new(old, new.where("h is not null"), ["h"], ["name"]).collect()] == [("h3", "c")]
    again = dedup.append_new(old.union(new), new.where("h is not null"), ["h"], ["name"])
    assert again.count() == 0


def test_numbers_follow_the_order(spark):
    rng = random.Random(6)
    rows = [(rng.randint(0, 50), i) for i in range(500)]
    got = dedup.renumbered(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", "b"]).collect()
    assert {(r.a, r.b): r.new_id for r in got} == {k: i + 1 for i, k in enumerate(sorted(rows))}


def test_content_hash_has_the_shape(spark):
    df = spark.createDataFrame([(bytearray(b"abcd"), 2, 2), (bytearray(b"abcd"), 4, 1)], "b binary, h int, w int")
    assert df.select(dedup.content_hash(c("b"), c("h"), c("w"))).distinct().count() == 2


def test_leak_of_one_source(spark):
    df = spark.createDataFrame([("s1", "train"), ("s1", "val"), ("s2", "train"), ("s2", "train")], "s string, split string")
    assert [tuple(r) for r in audit.source_leaks(df, c("s"), c("split")).collect()] == [("s1", 2)]


def test_manifest_alias_and_enrich(spark):
    raw = spark.createDataFrame([(1, " a ", None, "porous", "YES"), (2, "b", "irregular", None, None)], "row_no int, record_id string, particle_morphology string, shape_type string, is_tile string")
    got = manifest.normalise(raw).orderBy("row_no").collect()
    assert [(r.record_id, r.particle_morphology, r.shape_type, r.is_tile) for r in got] == [("a", "porous", "porous", "true"), ("b", "irregular", "irregular", "")]
    assert manifest.normalise(raw).columns == ["row_no", *manifest.FIELDS]
    base = spark.createDataFrame([(1, "a", "unknown", 1), (2, "a", "reviewed", 2), (3, "a", "", 3)], "i int, record_id string, label_status string, o int")
    df = spark.createDataFrame([("a", "x"), ("c", "y")], "record_id string, label_status string")
    assert {tuple(r) for r in manifest.enrich(df, base.where("i < 3"), "record_id", ["label_status"], c("o")).collect()} == {("a", "reviewed"), ("c", "y")}
    assert {tuple(r) for r in manifest.enrich(df, base, "record_id", ["label_status"], c("o")).collect()} == {("a", "x"), ("c", "y")}
    assert manifest.extra_columns(["split", "Split", "pixel_size", "more"]) == [("Split", "case"), ("pixel_size", "forbidden"), ("more", "extra")]


def test_readiness(spark):
    rows = manifest.normalise(spark.createDataFrame([(i, f"r{i}", "train", "reviewed" if i else "prelabelled") for i in range(3)], "row_no int, record_id string, split string, label_status string"))
    got = {r.rule: (r.ok, r.detail) for r in manifest.readiness(rows).collect()}
    assert got["train"] == (False, "3/200") and got["reviewed"] == (False, "r0") and got["density_level"] == (False, "r0")


def test_round_robin_and_running_best(spark):
    df = spark.createDataFrame([("b", 1, "x"), ("b", 5, "y"), ("a", 1, "z"), ("a", 1, "w"), (None, 9, "v")], "g string, s int, n string")
    assert [r.n for r in sampling.round_robin(df, c("g"), c("s"), "n", 4).collect()] == ["w", "y", "v", "z"]
    best = sampling.running_best(spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 2, 2, 1, 3])], "k int, t int, v double"), ["k"], ["t"], "v").orderBy("t").collect()
    assert [r.is_best for r in best] == [True, True, False, False, True]


def test_recipe(spark):
    docs = spark.createDataFrame([(1, '{"a": {"b": 5}, "has_scale": true, "x": "q"}'), (2, '{"a": {"b": "?"}, "has_scale": false}'), (3, "no json")], "i int, d string")
    checks = {
        "required": recipe.required(c("d"), ["$.a.b"]), "range": recipe.ranges(c("d"), {"$.a.b": (0, 4)}), "enum": recipe.enums(c("d"), {"$.x": ["p"]}),
        "scale": recipe.implied(c("d"), "$.has_scale", "true", ["$.pixel_size"]), "unknown": recipe.unknown_members(c("d"), ["a", "has_scale"]),
    }
    got = {tuple(r) for r in recipe.rule_table(docs, "i", checks).collect()}
    assert got == {(1, "range", "$.a.b"), (1, "enum", "$.x"), (1, "scale", "$.pixel_size"), (1, "unknown", "x"), (2, "range", "$.a.b"), (3, "required", "$.a.b")}
    regions = F.array(F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(2).alias("x1"), F.lit(0).alias("y1")))
    assert spark.range(1).select(recipe.regions_valid(regions)).first()[0] is False


def test_grid_has_all_combinations(spark):
    assert tuning.grid(spark, {"a": range(5), "b": range(5), "c": range(4)}).distinct().count() == 100


def test_upper_medians_of_groups(spark):
    rows = [("a", 3.0), ("a", 1.0), ("a", 2.0), ("b", 4.0), ("b", 1.0), ("b", 9.0), ("b", 2.0), ("c", None), (None, 5.0)]
    got = {r.g: (r.upper_median, r.p50) for r in stats.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", ["upper", 50]).collect()}
    assert got == {"a": (2.0, 2.0), "b": (4.0, 3.0), "c": (None, 0.0), None: (5.0, 5.0)}


def test_names_of_many_rows(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, "hot.png").when(F.col("id") % 20 > 0, "b").alias("name"))
    got = {r.id: r.new_name for r in audit.renamed(rows, "name", ["id"]).collect()}
    hot = [i for i in range(3000) if i % 10]
    assert [got[i] for i in hot] == ["hot.png", *[f"hot_{k}.png" for k in range(1, len(hot))]]
    assert got[10] == "b" and got[30] == "b_1" and len(got) == 3000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tiles_are_joined_by_merging(spark):
    """Small tables of sizes become many tiles, and these many cells: no side of their joins is broadcast whole."""
    boxes = spark.createDataFrame([(1, 1, 10, 10, 20, 20), (2, 2, 900, 10, 200, 20)], "image int, id int, x int, y int, w int, h int")
    tiles = spatial.tile_grid(spark.createDataFrame([(1, 2000, 2000), (2, 1500, 3000)], "image int, h int, w int"), "h", "w")
    found = spatial.boxes_in_tiles(boxes, tiles.withColumnsRenamed({"h": "ih", "w": "iw"}), "image")
    assert sorted((r.id, r.tile_x, r.tile_y, r.ih, r.iw) for r in found.collect()) == [(1, 0, 0, 2000, 2000), (2, 0, 0, 1500, 3000), (2, 768, 0, 1500, 3000)]
    regions = spark.createDataFrame([(1, 500, 600, 1500, 1000)], "image int, x0 int, y0 int, x1 int, y1 int")
    for df in (found, spatial.regions_in_tiles(regions, tiles, "image")):
        assert "SortMergeJoin" in plan_of(df) and "BroadcastHashJoin" not in plan_of(df)


def test_duplicates_meet_in_few_cells(spark):
    """A detection is sent to the cells that its reach touches, not to nine and more; a far larger one is met all the same."""
    rng = random.Random(5)
    parts = [(1, i, rng.uniform(0, 4000), rng.uniform(0, 4000), 30.0, 30.0, i % 2, 0) for i in range(400)] + [(1, 1000, 10.0, 10.0, 3000.0, 3000.0, 0, 0), (1, 1001, 20.0, 20.0, 2900.0, 2900.0, 1, 0)]
    df = spark.createDataFrame(parts, "image int, id int, x double, y double, w double, h double, tile_x int, tile_y int")
    found = spatial.cross_tile_candidates(df, "image", "id")
    assert (1000, 1001) in {(r.a, r.b) for r in found.collect()}
    small = spatial.cross_tile_candidates(df.where("id < 1000"), "image", "id")
    assert "SortMergeJoin" in plan_of(small) and "array(-1" not in plan_of(small) and " - 1)" not in plan_of(small)
