"""Raster kernels on small images."""

import numpy as np
import pytest

from granulon.operators import raster


def discs():
    y, x = np.mgrid[:64, :64]
    return np.where((y - 20) ** 2 + (x - 20) ** 2 < 64, 1, np.where((y - 44) ** 2 + (x - 44) ** 2 < 49, 2, 0)).astype(np.int32)


def flood(mask, connectivity):
    out, n = np.zeros(mask.shape, int), 0
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * (connectivity == 8)
    for y, x in zip(*np.nonzero(mask)):
        if not out[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                    out[a, b] = n
                    todo += [(a + i, b + j) for i, j in steps]
    return out


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_equal_flood_fill(connectivity):
    rng = np.random.default_rng(1)
    for _ in range(50):
        mask = rng.random((rng.integers(1, 15), rng.integers(1, 15))) < rng.random()
        assert (raster.components(mask, connectivity) == flood(mask, connectivity)).all()


def test_small_components_leave_gaps():
    mask = np.array([[1, 0, 1, 1], [0, 0, 0, 0], [1, 1, 0, 0]])
    assert raster.components(mask, min_area=2).tolist() == [[0, 0, 2, 2], [0, 0, 0, 0], [3, 3, 0, 0]]


def test_own_flow_finds_the_discs_again():
    labels = discs()
    dy, dx = raster.flow_of_masks(labels)
    assert np.isfinite(dy).all() and np.isfinite(dx).all()
    size = np.hypot(dy, dx)[labels > 0]
    assert ((size < 1e-9) | (abs(size - 1) < 1e-9)).all()
    found = raster.postprocess(5 * dy, 5 * dx, np.where(labels > 0, 5.0, -5.0))
    assert len(np.unique(found)) == 3
    for i in (1, 2):
        own = found == np.bincount(found[labels == i]).argmax()
        assert (own & (labels == i)).sum() / (own | (labels == i)).sum() > 0.95


def test_bad_flow_removes_all_and_own_flow_none():
    labels = discs()
    dy, dx = raster.flow_of_masks(labels)
    assert not raster.drop_bad_flow(labels, np.full(labels.shape, 5.0), np.full(labels.shape, 5.0), 0.4).any()
    assert (raster.drop_bad_flow(labels, 5 * dy, 5 * dx, 0.4) == labels).all()


def test_no_foreground():
    zero = np.zeros((8, 8))
    assert not raster.postprocess(zero, zero, zero - 1).any()
    assert not raster.flow_of_masks(zero.astype(int))[0].any()


def test_holes_are_filled_and_bays_are_not():
    ring = np.zeros((9, 9), int)
    ring[1:8, 1:8] = 1
    ring[3:5, 3:5] = 0
    ring[6, 6:9] = 0
    filled = raster.fill_holes(ring)
    assert filled[3:5, 3:5].all() and not filled[6, 8] and not filled[0].any()


def test_filters():
    labels = discs()
    assert set(np.unique(raster.filter_sizes(labels, least=180))) == {0, 1}
    assert set(np.unique(raster.filter_sizes(labels, most_fraction=0.04))) == {0, 2}
    assert (raster.filter_sizes(labels, most_fraction=0.0) == labels).all()
    moved = np.roll(labels, 15, axis=(0, 1))
    assert set(np.unique(raster.filter_boundary(moved))) == {0, 1}
    assert set(np.unique(raster.filter_logit(labels, np.where(labels == 1, 1.0, -1.0), 0.0))) == {0, 1}


def test_relabel_by_first_pixel():
    assert raster.relabel(np.array([[0, 7, 7], [3, 0, 9]])).tolist() == [[0, 1, 1], [2, 0, 3]]


def test_sinks_need_more_than_ten():
    y, x = np.full(10, 3), np.full(10, 3)
    assert not raster.cluster_sinks(y, x, (8, 8)).any()
    assert raster.cluster_sinks(np.full(11, 3), np.full(11, 3), (8, 8))[3, 3] == 1


def test_ways_that_meet_go_on_as_one(monkeypatch):
    """Following a flow costs no more than the ways that are still apart."""
    labels = np.zeros((40, 40), np.int32)
    labels[2:11, 3:12], labels[20:28, 20:29] = 1, 2
    dy, dx = raster.flow_of_masks(labels)
    sizes, floor = [], np.floor
    monkeypatch.setattr(raster.np, "floor", lambda v: sizes.append(np.size(v)) or floor(v))
    raster.follow_flow(5 * dy, 5 * dx, labels > 0)
    monkeypatch.undo()
    assert sizes[-1] < sizes[0] == (labels > 0).sum()
    assert (raster.postprocess(5 * dy, 5 * dx, np.where(labels > 0, 5.0, -5.0)) == labels).all()


def many_maps(seed=4):
    """Maps of several sizes, with instances that touch, in pieces or the same again, and without any."""
    rng = np.random.default_rng(seed)
    maps = [np.zeros((6, 9), np.int32), np.ones((1, 1), np.int32), discs(), discs()]
    for k in range(10):
        h, w = rng.integers(1, 45, 2)
        yy, xx = np.ogrid[:h, :w]
        labels = np.zeros((h, w), np.int32)
        for _ in range(7):
            near = (yy - rng.integers(h)) ** 2 + (xx - rng.integers(w)) ** 2 <= rng.integers(2, 12) ** 2
            labels[near & (rng.random((h, w)) < (0.9 if k % 2 else 2))] = rng.integers(1, 3000)
        maps.append(labels)
    return maps


def plain_flow(labels):
    """Heat of one instance after the other, pixel by pixel of the whole image."""
    ids = [int(i) for i in np.unique(labels[labels > 0])]
    places = {i: np.argwhere(labels == i) for i in ids}
    steps = 2 * max([0, *(int(np.ptp(p, axis=0).sum()) + 4 for p in places.values())])
    heat = np.zeros(np.add(labels.shape, 2))
    for i, p in places.items():
        centre = p.min(axis=0) + np.rint((p - p.min(axis=0)).mean(axis=0))
        y, x = p[np.argmin(((p - centre) ** 2).sum(axis=1))] + 1
        own, warm = np.pad(labels == i, 1), np.zeros(heat.shape)
        for _ in range(steps):
            warm[y, x] += 1
            shifted = [np.roll(warm, (-a, -b), (0, 1)) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            warm = np.where(own, np.sum(shifted, axis=0) / 9, 0)
        heat += warm
    dy, dx = heat[2:, 1:-1] - heat[:-2, 1:-1], heat[1:-1, 2:] - heat[1:-1, :-2]
    size = np.sqrt(dy**2 + dx**2) + 1e-60
    return np.where(labels > 0, dy / size, 0), np.where(labels > 0, dx / size, 0)


def test_flows_of_many_images_are_those_of_each():
    """one call for many images, instances of one form share their heat."""
    maps = many_maps()
    for labels, (dy, dx) in zip(maps, raster.flows_of_masks(maps)):
        want_y, want_x = plain_flow(labels)
        assert np.array_equal(dy, want_y) and np.array_equal(dx, want_x)
    assert raster.flows_of_masks([]) == []


@pytest.mark.parametrize("steps", [1, 40, 41, 97, 200])
def test_ways_that_go_in_circles_end(monkeypatch, steps):
    """where ways meet or come to a place again, the rest isn't walked; they end where they would have."""
    maps = many_maps()
    rng = np.random.default_rng(1)
    fields = [(5 * dy + rng.normal(0, 0.2, dy.shape), 5 * dx, labels > 0) for labels, (dy, dx) in zip(maps, raster.flows_of_masks(maps))]
    walked, floor = [], np.floor
    monkeypatch.setattr(raster.np, "floor", lambda v: walked.append(np.size(v)) or floor(v))
    got = raster.ways_of_flow(fields, steps)
    fewer = sum(walked)
    monkeypatch.setattr(raster, "_HALTS", ())
    want = raster.ways_of_flow(fields, steps)
    assert sum(walked) - fewer == 2 * steps * sum((labels > 0).sum() for labels in maps)
    assert fewer < (sum(walked) - fewer) * {97: 0.9, 200: 0.7}.get(steps, 1.01)
    alone = [raster.follow_flow(*field, steps) for field in fields]
    for one, two, three in zip(got, want, alone):
        assert all(np.array_equal(a, b) and np.array_equal(a, c) for a, b, c in zip(one, two, three))
    with pytest.raises(ValueError):
        raster.ways_of_flow([(np.full((3, 3), np.nan), np.zeros((3, 3)), np.ones((3, 3), bool))])


def test_many_images_find_the_instances_of_each():
    """what a call finds in an image doesn't depend on the other images."""
    maps = many_maps(5)
    fields = [(5 * dy, 5 * dx, np.where(labels > 0, 5.0, -5.0)) for labels, (dy, dx) in zip(maps, raster.flows_of_masks(maps))]
    for field, found in zip(fields, raster.postprocessed(fields, least=3, boundary="exclude")):
        assert np.array_equal(found, raster.postprocess(*field, least=3, boundary="exclude"))
    assert raster.postprocessed([]) == []


def test_kernels_get_many_images_as_runs(spark, sf_dir):
    """an image's pixels aren't rows, and a call of the kernel has more than one image."""
    from granulon.operators import flows
    from granulon.plans import images

    maps = {f"i{k}": labels for k, labels in enumerate(many_maps(6))}
    rows = [(name, int(r.y), int(r.x0), int(r.x1), int(r.label)) for name, m in maps.items() for r in flows.runs_of(m).itertuples(index=False)]
    df = spark.createDataFrame(rows, "image string, y bigint, x0 int, x1 bigint, v int")
    same = raster.by_images(df.repartition(2, "image"), "image", ["v"], lambda group: [labels for (labels,) in group])
    assert sorted(tuple(r) for r in same.collect()) == sorted(rows)
    count = raster.by_images(df.repartition(1, "image"), "image", ["v"], lambda group: [np.full((1, 1), len(group)) for _ in group])
    assert max(r.label for r in count.collect()) > 1 and count.count() == len({r[0] for r in rows})
    assert raster.by_images(df.limit(0), "image", ["v"], lambda group: group).collect() == []
    for query in (images.euler_masks, images.flow_qc):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan and plan.count("Generate explode") == 1
