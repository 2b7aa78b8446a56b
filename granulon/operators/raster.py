"""Raster kernels: small numpy functions of one label map or flow field, and their way into Spark by image.

An image is one group. Its pixels come as rows (image, y, x, ...) or as one row with arrays, so a group is
as large as one image or tile, whatever the table's size; images larger than a tile are tiled first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granulon.operators.groups import by_groups


def components(mask: np.ndarray, connectivity: int = 8, min_area: int = 1) -> np.ndarray:
    """Labels of connected parts in raster order of their first pixel; smaller parts vanish, so ids may have gaps.

    Runs of a row are joined to the runs that they touch in the row above; roots are the smallest run.
    """
    height, width = mask.shape
    padded = np.zeros((height, width + 2), np.int8)
    padded[:, 1:-1] = mask > 0
    steps = np.diff(padded, axis=1)
    ys, starts = np.nonzero(steps == 1)
    stops = np.nonzero(steps == -1)[1]
    root = np.arange(len(ys))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    row_begin = np.searchsorted(ys, np.arange(height + 1))
    reach = 1 if connectivity == 8 else 0
    for y in range(1, height):
        above, end_above, here, end = row_begin[y - 1], row_begin[y], row_begin[y], row_begin[y + 1]
        while above < end_above and here < end:
            if starts[here] < stops[above] + reach and starts[above] < stops[here] + reach:
                a, b = top(above), top(here)
                root[max(a, b)] = min(a, b)
            if stops[above] < stops[here]:
                above += 1
            else:
                here += 1
    out = np.zeros((height, width), np.int32)
    roots = np.array([top(i) for i in range(len(ys))], int)
    names = {r: k + 1 for k, r in enumerate(np.unique(roots).tolist())}
    areas = np.bincount(roots, stops - starts, minlength=len(ys)) if len(ys) else np.zeros(0)
    for y, s, e, r in zip(ys, starts, stops, roots.tolist()):
        if areas[r] >= min_area:
            out[y, s:e] = names[r]
    return out


def _around(a: np.ndarray, radius: int) -> np.ndarray:
    """Largest value within a square around each pixel; outside counts as 0."""
    for axis in (0, 1):
        a = np.moveaxis(a, axis, 0)
        out = np.maximum(a, 0)
        for k in range(1, radius + 1):
            np.maximum(out[k:], a[:-k], out=out[k:])
            np.maximum(out[:-k], a[k:], out=out[:-k])
        a = np.moveaxis(out, 0, axis)
    return a


#: Pixels of several images that kernels take at once; an image of more is taken alone.
TOGETHER = 1 << 16
#: Steps after which ways that have met go on as one, and those that go round in circles end.
_HALTS = (40, 64, 96, 144)


def _canvas(shapes: Sequence[tuple[int, int]], border: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """Where each image's pixel (0, 0) is, and the length of its rows, if images with a border lie one behind the other; and the length of all."""
    height, width = np.array(shapes, np.int64).reshape(-1, 2).T + 2 * border
    stop = np.cumsum(height * width)
    return stop - height * width + border * width + border, width, int(stop[-1]) if len(stop) else 0


def _between(flow: np.ndarray, shapes: Sequence[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """Of each pixel of a canvas its value, how it changes to the right and down, and how the one changes with the other: what lies between four pixels."""
    right, down, both = np.zeros_like(flow), np.zeros_like(flow), np.zeros_like(flow)
    start = 0
    for height, width in shapes:
        stop = start + (height + 2) * (width + 2)
        own, across, under, turn = (a[start:stop].reshape(height + 2, width + 2) for a in (flow, right, down, both))
        across[:, :-1] = own[:, 1:] - own[:, :-1]
        under[:-1] = own[1:] - own[:-1]
        turn[:, :-1] = under[:, 1:] - under[:, :-1]
        start = stop
    return flow, right, down, both


def _step(y: np.ndarray, x: np.ndarray, most: Sequence[np.ndarray], line: np.ndarray, base: np.ndarray, flows: Sequence[tuple[np.ndarray, ...]], room: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Where places are after a step; what is worked out on the way goes to `room`, since new arrays cost more than the sums."""
    down, right, moved, part, iy, ix, at = room
    for p, i, rest in ((y, iy, down), (x, ix, right)):
        low = np.floor(p)
        np.copyto(i, low, casting="unsafe")
        np.subtract(p, low, out=rest)
    np.multiply(iy, line, out=iy)
    np.add(iy, ix, out=iy)
    np.add(iy, base, out=at)
    found = []
    for p, end, (value, across, under, both) in zip((y, x), most, flows):
        # No place is outside; to clip is the fastest way to take.
        both.take(at, out=moved, mode="clip")
        np.multiply(moved, right, out=moved)
        np.add(moved, under.take(at, out=part, mode="clip"), out=moved)
        np.multiply(moved, down, out=moved)
        np.multiply(across.take(at, out=part, mode="clip"), right, out=part)
        np.add(moved, part, out=moved)
        np.add(moved, value.take(at, out=part, mode="clip"), out=moved)
        then = np.add(p, moved)
        found.append(np.clip(then, np.float32(-0.5), end, out=then))
    return found


def ways_of_flow(fields: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], steps: int = 200) -> list[tuple[np.ndarray, np.ndarray]]:
    """follow_flow of several images (dy, dx, inside) at once.

    A way's next place depends on its place alone: ways of an image that have met go on as one, and one that comes to a
    place again is in a circle, whose length tells where it is after all steps.
    """
    if not fields:
        return []
    shapes = [inside.shape for _, _, inside in fields]
    corner, row, length = _canvas(shapes)
    size = np.array(shapes, np.float32).reshape(-1, 2)
    # Places are in the sampled grid, whose pixel centres are at whole numbers: one of the image is N / (N - 1) of it.
    scale = size / np.maximum(size - 1, 1)
    inner = [np.nonzero(inside) for _, _, inside in fields]
    image = np.repeat(np.arange(len(fields)), [len(ys) for ys, _ in inner])
    begin = [np.concatenate([p[k] for p in inner]) for k in (0, 1)]
    at = corner[image] + begin[0] * row[image] + begin[1]
    flows = []
    for k in (0, 1):
        flow = np.zeros(length, np.float32)
        flow[at] = np.concatenate([f[k][f[2]] for f in fields]).astype(np.float32) / 5 * scale[image, k]
        if not np.isfinite(flow).all():
            raise ValueError("a flow isn't finite")
        flows.append(_between(flow, shapes))
    y, x = (begin[k].astype(np.float32) * scale[image, k] - np.float32(0.5) for k in (0, 1))
    lead, alive = np.arange(len(y)), np.arange(len(y))  # the way that each goes on as, and those that do
    ends = np.zeros((len(y), 2), np.float32)
    whole = np.int32 if length < 1 << 31 else np.int64
    done = 0
    for halt in [*(h for h in _HALTS if h < steps), steps]:
        of = image[alive]
        most, line, base = [size[of, k] - np.float32(0.5) for k in (0, 1)], row[of].astype(whole), corner[of].astype(whole)
        past, room = [(y, x)], [np.empty(len(y), kind) for kind in (*[np.float32] * 4, whole, whole, np.intp)]
        for _ in range(done, halt):
            y, x = _step(y, x, most, line, base, flows, room)
            past.append((y, x))
        done = halt
        now, end = np.stack([y, x], axis=1), np.zeros((len(y), 2), np.float32)
        ended = np.full(len(alive), done == steps)
        end[ended] = now[ended]
        for circle in range(1, len(past) if done < steps else 0):
            then_y, then_x = past[-1 - circle]
            again = np.flatnonzero((then_y == y) & (then_x == x) & ~ended)
            end[again] = np.stack(past[len(past) - 1 - circle + (steps - done) % circle], axis=1)[again]
            ended[again] = True
        ends[alive[ended]] = end[ended]
        word, on = now.view(np.int64)[:, 0], np.flatnonzero(~ended)
        turn = on[np.argsort(word[on], kind="stable")]
        first = np.ones(len(turn), bool)
        first[1:] = (word[turn[1:]] != word[turn[:-1]]) | (of[turn[1:]] != of[turn[:-1]])
        kept = turn[first]
        lead[alive[turn]] = alive[kept][np.cumsum(first) - 1]
        kept = np.sort(kept)
        alive, y, x = alive[kept], y[kept], x[kept]
    while not np.array_equal(then := lead[lead], lead):
        lead = then
    found = [((ends[lead, k] + np.float32(0.5)) / scale[image, k]).astype(int).clip(0, size[image, k].astype(int) - 1) for k in (0, 1)]
    cuts = np.cumsum([len(ys) for ys, _ in inner])[:-1]
    return list(zip(*(np.split(v, cuts) for v in found)))


def follow_flow(dy: np.ndarray, dx: np.ndarray, inside: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Where each inside pixel ends after so many steps along the flow: whole rows and columns, in raster order.

    The field counts as 0 outside of inside. Positions are those in [-1, 1] of the image, sampled between the
    four pixels around, each 0 outside of the image, but counted in sampled pixels.
    """
    return ways_of_flow([(dy, dx, inside)], steps)[0]


def cluster_sinks(sink_y: np.ndarray, sink_x: np.ndarray, shape: tuple[int, int], pad: int = 20) -> np.ndarray:
    """Label map of where sinks gather: peaks of more than 10 that are highest within 2 pixels grow over counts above 2.

    Peaks grow 5 times by a pixel within 5 pixels; higher peaks win, of equal ones the later in raster order.
    """
    height, width = shape
    h = np.bincount((sink_y + pad) * (width + 2 * pad) + sink_x + pad, minlength=(height + 2 * pad) * (width + 2 * pad)).reshape(height + 2 * pad, width + 2 * pad)
    ys, xs = np.nonzero((h > 10) & (h == _around(h, 2)))
    order = np.lexsort((xs, ys, h[ys, xs]))
    # The windows of all peaks grow at once; a border of 6 keeps them within the array.
    around = np.arange(-6, 7)
    high = np.pad(h, 6)
    places = (ys[order] + 6)[:, None, None] + around[:, None], (xs[order] + 6)[:, None, None] + around
    dense = high[places] > 2
    dense[:, [0, -1]] = dense[:, :, [0, -1]] = False  # beyond 5 pixels
    grown = np.zeros(dense.shape, bool)
    grown[:, 6, 6] = True
    for _ in range(5):
        rows = grown.copy()
        rows[:, 1:] |= grown[:, :-1]
        rows[:, :-1] |= grown[:, 1:]
        grown = rows.copy()
        grown[:, :, 1:] |= rows[:, :, :-1]
        grown[:, :, :-1] |= rows[:, :, 1:]
        grown &= dense
    peak, y, x = np.nonzero(grown)
    whole = np.zeros(high.shape, np.int32)
    np.maximum.at(whole.reshape(-1), (ys[order][peak] + y) * whole.shape[1] + xs[order][peak] + x, (peak + 1).astype(np.int32))
    out = whole[6:-6, 6:-6]
    return out[pad : pad + height, pad : pad + width]


def masks_of_flow(dy: np.ndarray, dx: np.ndarray, inside: np.ndarray, steps: int = 200) -> np.ndarray:
    """Instances: inside pixels take the label of the place where they end; labels by first pixel in raster order."""
    return _gathered(inside, *follow_flow(dy, dx, inside, steps))


def _gathered(inside: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros(inside.shape, np.int32)
    if len(y):
        out[inside] = cluster_sinks(y, x, inside.shape)[y, x]
    return relabel(out)


def relabel(labels: np.ndarray) -> np.ndarray:
    """Labels 1, 2, ... by first pixel in raster order."""
    first = np.full(int(labels.max(initial=0)) + 1, -1)
    first[labels.ravel()[::-1]] = np.arange(labels.size)[::-1]
    ids = np.flatnonzero(first[1:] >= 0) + 1
    names = np.zeros(len(first), np.int32)
    names[ids[np.argsort(first[ids])]] = np.arange(1, len(ids) + 1)
    return names[labels]


def drop_by(labels: np.ndarray, bad: Callable[[int, np.ndarray], bool]) -> np.ndarray:
    out = labels.copy()
    for i in np.unique(labels[labels > 0]):
        own = labels == i
        if bad(int(i), own):
            out[own] = 0
    return out


def filter_sizes(labels: np.ndarray, least: int = 1, most_fraction: float = 0.0) -> np.ndarray:
    """Without instances below a size or above a share of the image; a share of 0 or less is no bound."""
    areas = np.bincount(labels.ravel())
    bad = areas < least
    if most_fraction > 0:
        bad |= areas > labels.size * most_fraction
    bad[0] = False
    return np.where(bad[labels], 0, labels)


def filter_boundary(labels: np.ndarray, margin: float = 1.0) -> np.ndarray:
    """Without instances whose box comes within a margin of the image's edge."""
    height, width = labels.shape

    def bad(_: int, own: np.ndarray) -> bool:
        ys, xs = np.nonzero(own)
        return bool(xs.min() <= margin or ys.min() <= margin or xs.max() + 1 >= width - 1 - margin or ys.max() + 1 >= height - 1 - margin)

    return drop_by(labels, bad)


def filter_logit(labels: np.ndarray, logit: np.ndarray, threshold: float) -> np.ndarray:
    """Without instances whose mean logit is below the threshold."""
    n = np.maximum(1, np.bincount(labels.ravel()))
    bad = np.bincount(labels.ravel(), logit.ravel()) / n < threshold
    bad[0] = False
    return np.where(bad[labels], 0, labels)


def fill_holes(labels: np.ndarray) -> np.ndarray:
    """Background and other labels enclosed by an instance become its own; of several the larger id holds."""
    out = labels.copy()
    # A hole lies between two runs of a row.
    begin = labels > 0
    begin[:, 1:] &= labels[:, 1:] != labels[:, :-1]
    run_y, run_x = np.nonzero(begin)
    turn = np.lexsort((run_y, of := labels[run_y, run_x]))
    again = (of[turn[1:]] == of[turn[:-1]]) & (run_y[turn[1:]] == run_y[turn[:-1]])
    for i in np.unique(of[turn[1:]][again]):
        ys, xs = np.nonzero(labels == i)
        y0, y1, x0, x1 = ys.min(), ys.max() + 1, xs.min(), xs.max() + 1
        own = np.pad(labels[y0:y1, x0:x1] == i, 1)
        outside = components(~own, connectivity=4)
        holes = (~own & (outside != outside[0, 0]))[1:-1, 1:-1]
        out[y0:y1, x0:x1][holes] = i
    return out


def flows_of_masks(maps: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """flow_of_masks of several images at once: instances of about one size spread their heat in one array, each form in a window of its own."""
    out = [(np.zeros(labels.shape), np.zeros(labels.shape)) for labels in maps]
    places = [np.nonzero(labels > 0) for labels in maps]
    image = np.repeat(np.arange(len(maps)), [len(ys) for ys, _ in places])
    if not len(image):
        return out
    ys, xs = (np.concatenate([p[k] for p in places]).astype(np.int64) for k in (0, 1))
    label = np.concatenate([labels[p] for labels, p in zip(maps, places)]).astype(np.int64)
    # Pixels by instance, in raster order within one.
    turn = np.lexsort((label, image))
    ys, xs, image, label = ys[turn], xs[turn], image[turn], label[turn]
    new = np.append(True, (image[1:] != image[:-1]) | (label[1:] != label[:-1]))
    first, own = np.flatnonzero(new), np.cumsum(new) - 1
    count = np.diff(np.append(first, len(own)))
    (top, left), (low, right) = ([f.reduceat(v, first) for v in (ys, xs)] for f in (np.minimum, np.maximum))
    cy, cx = (start + np.rint(np.add.reduceat(v - start[own], first) / count) for v, start in ((ys, top), (xs, left)))
    off = (ys - cy[own]) ** 2 + (xs - cx[own]) ** 2
    nearest = np.flatnonzero(off == np.minimum.reduceat(off, first)[own])  # the centre itself where that is the instance's
    nearest = nearest[np.append(True, own[nearest[1:]] != own[nearest[:-1]])]
    reach = np.zeros(len(maps), np.int64)
    np.maximum.at(reach, image[first], low - top + right - left + 4)
    corner, row, length = _canvas([labels.shape for labels in maps])
    heat, at = np.zeros(length), corner[image] + ys * row[image] + xs
    high, wide = (-(-(b - a + 1) // 4) * 4 for a, b in ((top, low), (left, right)))
    kinds = np.stack([reach[image[first]], high, wide], axis=1)
    for times, h, w in np.unique(kinds, axis=0):
        like = np.flatnonzero((kinds == (times, h, w)).all(axis=1))
        each = max(1, TOGETHER // 4 // int(h * w))
        for some in (like[k : k + each] for k in range(0, len(like), each)):
            number, before = np.repeat(np.arange(len(some)), count[some]), np.cumsum(count[some]) - count[some]
            pixel = np.arange(len(number)) + (first[some] - before)[number]
            where = ys[pixel] - top[some][number] + 1, xs[pixel] - left[some][number] + 1
            form = np.zeros((len(some), h + 2, w + 2), bool)
            form[number, *where] = True
            # Instances of one form have one heat.
            bits = np.packbits(form.reshape(len(some), -1), axis=1)
            _, once, same = np.unique(np.ascontiguousarray(bits).view(f"V{bits.shape[1]}")[:, 0], return_index=True, return_inverse=True)
            centre = ys[nearest[some]] - top[some] + 1, xs[nearest[some]] - left[some] + 1
            centre = centre[0][once], centre[1][once], np.arange(len(once))
            # Windows lie side by side, so that what is added is long.
            within = np.moveaxis(form[once, 1:-1, 1:-1], 0, 2).astype(float, order="C")
            warm, spread = np.zeros((h + 2, w + 2, len(once))), np.empty(within.shape)
            beside = [warm[a : a + h, b : b + w] for a in range(3) for b in range(3)]
            for _ in range(2 * times):
                warm[centre] += 1
                np.add(beside[0], beside[1], out=spread)
                for other in beside[2:]:
                    spread += other
                spread /= 9
                np.multiply(spread, within, out=beside[4])
            heat[at[pixel]] = warm[*where, same[number]]
    line = row[image]
    gy, gx = heat[at + line] - heat[at - line], heat[at + 1] - heat[at - 1]
    size = np.sqrt(gy**2 + gx**2) + 1e-60
    cuts = np.searchsorted(image, np.arange(len(maps) + 1))
    for (dy, dx), a, b in zip(out, cuts[:-1], cuts[1:]):
        dy[ys[a:b], xs[a:b]], dx[ys[a:b], xs[a:b]] = (gy / size)[a:b], (gx / size)[a:b]
    return out


def flow_of_masks(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (dy, dx) up the heat that spreads from each instance's centre within the instance."""
    return flows_of_masks([labels])[0]


def drop_bad_flow(labels: np.ndarray, dy: np.ndarray, dx: np.ndarray, threshold: float = 0.4) -> np.ndarray:
    """Without instances whose given flow (five times a unit vector) is off the flow of their form by more than the threshold."""
    return drop_bad_flows([(labels, dy, dx)], threshold)[0]


def drop_bad_flows(given: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], threshold: float = 0.4) -> list[np.ndarray]:
    """drop_bad_flow of several images (labels, dy, dx) at once."""
    if threshold <= 0:
        return [labels for labels, _, _ in given]
    out = []
    for (labels, dy, dx), (my, mx) in zip(given, flows_of_masks([labels for labels, _, _ in given])):
        error = (my - dy / 5) ** 2 + (mx - dx / 5) ** 2
        area = np.bincount(labels.ravel())
        bad = np.bincount(labels.ravel(), error.ravel()) / np.maximum(1, area) > threshold
        bad[0] = False
        out.append(np.where(bad[labels], 0, labels))
    return out


def postprocess(
    dy: np.ndarray, dx: np.ndarray, logit: np.ndarray, steps: int = 200, flow_threshold: float = 0.4, least: int = 1, most_fraction: float = 0.5, logit_threshold: float = 0.0, boundary: str = "include", margin: float = 1.0
) -> np.ndarray:
    """Flow and logits to instances: follow, cluster, drop what is too large or off its flow, fill, drop by size, edge and logit."""
    return postprocessed([(dy, dx, logit)], steps, flow_threshold, least, most_fraction, logit_threshold, boundary, margin)[0]


def postprocessed(
    fields: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], steps: int = 200, flow_threshold: float = 0.4, least: int = 1, most_fraction: float = 0.5, logit_threshold: float = 0.0, boundary: str = "include", margin: float = 1.0
) -> list[np.ndarray]:
    """postprocess of several images (dy, dx, logit) at once."""
    inside = [logit > 0 for _, _, logit in fields]
    ends = ways_of_flow([(dy, dx, own) for (dy, dx, _), own in zip(fields, inside)], steps)
    found = [filter_sizes(_gathered(own, *end), 1, most_fraction) for own, end in zip(inside, ends)]
    out = []
    for labels, (_, _, logit) in zip(drop_bad_flows([(labels, dy, dx) for labels, (dy, dx, _) in zip(found, fields)], flow_threshold), fields):
        labels = filter_sizes(fill_holes(labels), least, most_fraction)
        if boundary == "exclude":
            labels = filter_boundary(labels, margin)
        out.append(relabel(filter_logit(labels, logit, logit_threshold)))
    return out


#: Steps around a pixel, clockwise from the left, as (y, x).
_AROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def contour(mask: np.ndarray) -> np.ndarray:
    """The outer contour of the part that has the first pixel in raster order: its border pixels (x, y), clockwise."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return np.empty((0, 2), int)
    inside = np.pad(mask > 0, 1)
    start = (int(ys[0]) + 1, int(xs[0]) + 1)
    at, back, out = start, 0, []
    while True:
        out.append((at[1] - 1, at[0] - 1))
        for k in range(1, 9):
            turn = (back + k) % 8
            after = at[0] + _AROUND[turn][0], at[1] + _AROUND[turn][1]
            if inside[after]:
                break
        else:
            break  # a single pixel
        step = (after, (turn + 5) % 8 if turn % 2 else (turn + 6) % 8)
        if at == start and len(out) > 1 and after == second:
            out.pop()
            break
        if len(out) == 1:
            second = after
        at, back = step
    return np.array(out, int)


def polygon_area(points: np.ndarray) -> float:
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2) if len(points) > 2 else 0.0


def perimeter(points: np.ndarray) -> float:
    return float(np.hypot(*(points - np.roll(points, -1, axis=0)).T).sum()) if len(points) > 1 else 0.0


def convex_hull(points: np.ndarray) -> np.ndarray:
    """The corners of the hull, by monotone chains."""
    ordered = sorted(set(map(tuple, points.tolist())))
    if len(ordered) < 3:
        return np.array(ordered).reshape(-1, 2)

    def chain(side: list) -> list:
        out: list = []
        for p in side:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(ordered) + chain(ordered[::-1]))


def form_metrics(mask: np.ndarray) -> dict[str, float]:
    """Area in pixels, contour perimeter, circularity, solidity (contour to hull) and convexity (its inverse)."""
    points = contour(mask)
    area, length, own, hull = float((mask > 0).sum()), perimeter(points), polygon_area(points), polygon_area(convex_hull(points))
    return {"area": area, "perimeter": length, "circularity": 4 * np.pi * area / max(length**2, 1e-8), "solidity": own / max(hull, 1e-8), "convexity": hull / max(own, 1.0)}


def resize(image: np.ndarray, height: int, width: int, nearest: bool = False) -> np.ndarray:
    """The image at another size: the nearest pixel, or between the four around; pixel centres keep their share."""
    y, x = (np.arange(height) + 0.5) * image.shape[0] / height - 0.5, (np.arange(width) + 0.5) * image.shape[1] / width - 0.5
    if nearest:
        rows, columns = np.floor((np.arange(height) * image.shape[0]) / height).astype(int), np.floor((np.arange(width) * image.shape[1]) / width).astype(int)
        return image[rows][:, columns]
    y, x = np.clip(y, 0, image.shape[0] - 1), np.clip(x, 0, image.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    wy, wx = (y - y0)[:, None], (x - x0)[None, :]
    if image.ndim == 3:
        wy, wx = wy[..., None], wx[..., None]
    at = lambda a, b: image[a][:, b].astype(float)
    return (at(y0, x0) * (1 - wx) + at(y0, x1) * wx) * (1 - wy) + (at(y1, x0) * (1 - wx) + at(y1, x1) * wx) * wy


def fit_square(image: np.ndarray, side: int, pad: float = 114) -> tuple[np.ndarray, dict[str, float]]:
    """The image scaled to fit a square and centred in it, and how: scale, top, left, height, width (cut off, not rounded)."""
    scale = side / max(image.shape[:2])
    h, w = max(1, int(image.shape[0] * scale)), max(1, int(image.shape[1] * scale))
    top, left = (side - h) // 2, (side - w) // 2
    out = np.full((side, side, *image.shape[2:]), pad, float)
    out[top : top + h, left : left + w] = resize(image, h, w)
    return out, {"scale": scale, "top": top, "left": left, "height": h, "width": w}


def normalise(image: np.ndarray, mean: tuple[float, ...], std: tuple[float, ...]) -> np.ndarray:
    """Values of 0 to 255 as multiples of the deviation, channels first."""
    return np.moveaxis((image / 255 - np.array(mean)) / np.array(std), -1, 0).astype(np.float32)


def suppress_padding(logit: np.ndarray, how: dict[str, float], stride: int = 4, low: float = -100.0) -> np.ndarray:
    """Logits of a prediction at a stride with the padding set so low that nothing is found there."""
    out = np.full(logit.shape, low, logit.dtype)
    part = np.s_[int(how["top"]) // stride : -(-int(how["top"] + how["height"]) // stride), int(how["left"]) // stride : -(-int(how["left"] + how["width"]) // stride)]
    out[part] = logit[part]
    return out


def to_original(labels: np.ndarray, how: dict[str, float], height: int, width: int, stride: int = 4) -> np.ndarray:
    """A label map of a padded square, at a stride, back at the image's own size."""
    top, left = int(how["top"]) // stride, int(how["left"]) // stride
    part = labels[top : top + max(1, int(how["height"]) // stride), left : left + max(1, int(how["width"]) // stride)]
    return resize(part, height, width, nearest=True)


def turned(dy: np.ndarray, dx: np.ndarray, quarters: int = 0, mirror: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A flow field mirrored left to right, then turned by quarters against the clock: places and vectors alike."""
    if mirror:
        dy, dx = dy[:, ::-1], -dx[:, ::-1]
    for _ in range(quarters % 4):
        dy, dx = -np.rot90(dx), np.rot90(dy)
    return dy, dx


def to_8_bit(image: np.ndarray) -> np.ndarray:
    """A 16-bit image scaled so that its largest value becomes 255."""
    return (image.astype(float) * (255.0 / max(int(image.max(initial=0)), 1))).astype(np.uint8)


def to_array(pdf: pd.DataFrame, column: str, kind: type = np.int32) -> np.ndarray:
    """One column of an image's pixel rows (y, x from 0) as a raster; pixels without a row are 0."""
    out = np.zeros((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1), kind)
    out[pdf.y.to_numpy(), pdf.x.to_numpy()] = pdf[column].to_numpy()
    return out


def by_image(pixels: DataFrame, image: str, kernel: Callable[[pd.DataFrame], np.ndarray], image_type: str = "bigint") -> DataFrame:
    """(image, y, x, label) of labelled pixels, from a kernel of each image's pixel rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = kernel(pdf)
        ys, xs = np.nonzero(labels)
        return pd.DataFrame({image: pdf[image].iloc[0], "y": ys.astype(np.int32), "x": xs.astype(np.int32), "label": labels[ys, xs].astype(np.int32)})

    return pixels.groupBy(image).applyInPandas(run, f"{image} {image_type}, y int, x int, label int")


def rasters(image: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, values: Sequence[np.ndarray]) -> list[list[np.ndarray]]:
    """A raster of each of the values for each image, from runs by image; places without a run are 0, and the first is (0, 0)."""
    first = np.flatnonzero(np.append(True, image[1:] != image[:-1]))
    shapes = list(zip((np.maximum.reduceat(y, first) + 1).tolist(), np.maximum.reduceat(x1, first).tolist()))
    corner, row, length = _canvas(shapes, 0)
    number = np.cumsum(np.append(0, image[1:] != image[:-1]))
    count = x1 - x0
    of = np.repeat(np.arange(len(y)), count)
    at = (corner[number] + y * row[number] + x0)[of] + np.arange(len(of)) - (np.cumsum(count) - count)[of]
    drawn = []
    for value in values:
        out = np.zeros(length, np.int32)
        out[at] = value[of]
        drawn.append([out[a : a + h * w].reshape(h, w) for a, (h, w) in zip(corner.tolist(), shapes)])
    return [list(each) for each in zip(*drawn)]


def by_images(runs: DataFrame, image: str, values: Sequence[str], kernel: Callable[[list[list[np.ndarray]]], Sequence[np.ndarray]]) -> DataFrame:
    """(image, y, x0, x1, label) of labelled runs, from a kernel of many images' rasters of values; runs (image, y, x0, x1, values...) are partitioned by image.

    An image's pixels have no rows, and a call's costs are shared by the images that a batch holds, TOGETHER pixels or one image at a time.
    """
    given = runs.select(image, *[F.col(n).cast("bigint").alias(n) for n in ("y", "x0", "x1")], *values)
    schema = T.StructType([given.schema[image], *(T.StructField(n, T.IntegerType()) for n in ("y", "x0", "x1", "label"))])

    def found(rows: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch:
        number = lambda n: rows.column(n).to_numpy(zero_copy_only=False).astype(np.int64)
        drawn = rasters(group, number("y"), number("x0"), number("x1"), [number(v) for v in values])
        size = np.cumsum([each[0].size for each in drawn])
        cuts = np.flatnonzero(np.diff(size // TOGETHER)) + 1
        maps = [labels for a, b in zip(np.append(0, cuts), np.append(cuts, len(drawn))) for labels in kernel(drawn[a:b])]
        # A run begins where the label turns, or a row does.
        flat, width = np.concatenate([m.ravel() for m in maps]), np.repeat([m.shape[1] for m in maps], [m.shape[0] for m in maps])
        stop = np.cumsum(width)
        turn = np.zeros(len(flat) + 1, bool)
        turn[1:-1] = flat[1:] != flat[:-1]
        turn[stop] = turn[0] = True
        edge = np.flatnonzero(turn)
        begin, end = edge[:-1], edge[1:]
        begin, end = begin[flat[begin] > 0], end[flat[begin] > 0]
        line = np.searchsorted(stop, begin, "right")
        above = np.cumsum([0, *(m.shape[0] for m in maps)])
        of = np.searchsorted(above, line, "right") - 1
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        places = line - above[of], begin - (stop - width)[line], end - (stop - width)[line], flat[begin]
        return pa.RecordBatch.from_arrays([rows.column(image).take(pa.array(first[of])), *(pa.array(v.astype(np.int32)) for v in places)], names=schema.names)

    return by_groups(given, [image], ["y", "x0"], found, schema)
