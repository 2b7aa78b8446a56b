"""Boxes, tiles and runs: overlap joins within an image, tile grids, clipping, duplicates across tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granulon.functions.scalars import touches_edge

TILE, OVERLAP, CORE_MARGIN = 1024, 256, 128


def expanded(boxes: DataFrame, height: Column, width: Column) -> DataFrame:
    """boxes (x, y, w, h) with ex0, ey0, ex1, ey1: grown by a tenth of the smaller side, 3 at least, clipped to the image."""
    c = F.col
    margin = F.greatest(F.lit(3.0), F.least(c("w"), c("h")) * 0.1)
    return boxes.withColumns(
        {"ex0": F.greatest(F.lit(0.0), c("x") - margin), "ey0": F.greatest(F.lit(0.0), c("y") - margin), "ex1": F.least(width.cast("double"), c("x") + c("w") + margin), "ey1": F.least(height.cast("double"), c("y") + c("h") + margin)}
    )


def overlapping_pairs(boxes: DataFrame, image: str, box_id: str, cell: float = 128.0) -> DataFrame:
    """(image, a, b) with a < b of expanded boxes of an image that overlap.

    Boxes meet in the grid cells that they touch; a pair counts in the cell of its common corner only, so
    the join needs no distinct and no image is compared all against all.
    """
    spread = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    dealt = boxes.select(image, box_id, "ex0", "ey0", "ex1", "ey1").withColumn("cx", spread("ex0", "ex1")).withColumn("cy", spread("ey0", "ey1"))
    a = dealt.select(image, "cx", "cy", F.col(box_id).alias("a"), *[F.col(f"e{k}").alias(f"a{k}") for k in ("x0", "y0", "x1", "y1")])
    b = dealt.select(image, "cx", "cy", F.col(box_id).alias("b"), *[F.col(f"e{k}").alias(f"b{k}") for k in ("x0", "y0", "x1", "y1")])
    c = F.col
    left, top = F.greatest("ax0", "bx0"), F.greatest("ay0", "by0")
    overlap = (F.least("ax1", "bx1") > left) & (F.least("ay1", "by1") > top)
    own_cell = (F.floor(left / cell) == c("cx")) & (F.floor(top / cell) == c("cy"))
    return a.join(b, [image, "cx", "cy"]).where((c("a") < c("b")) & overlap & own_cell).select(image, "a", "b")


def adhesion(boxes: DataFrame, pairs: DataFrame, image: str) -> DataFrame:
    """(image, n, n_pairs, adhesion_ratio): touching pairs to all pairs; images without pairs have 0."""
    n = boxes.groupBy(image).agg(F.count("*").alias("n"))
    touching = pairs.groupBy(image).agg(F.count("*").alias("n_pairs"))
    joined = n.join(touching, image, "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    return joined.withColumn("adhesion_ratio", F.col("n_pairs") / F.greatest(F.col("n") * (F.col("n") - 1) / 2, F.lit(1.0)))


def tile_starts(length: Column, tile: int = TILE, overlap: int = OVERLAP) -> Column:
    """Where tiles start along a side: a step apart, and a last one that ends at the edge."""
    last = F.greatest(F.lit(0), length.cast("int") - tile)
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(tile - overlap)), F.array(last)))


def tile_grid(images: DataFrame, height: str, width: str, tile: int = TILE, overlap: int = OVERLAP) -> DataFrame:
    """images with x0, y0, x1, y1 of each tile, half open and clipped to the image."""
    rows = images.withColumn("y0", F.explode(tile_starts(F.col(height), tile, overlap))).withColumn("x0", F.explode(tile_starts(F.col(width), tile, overlap)))
    return rows.withColumn("x1", F.least(F.col("x0") + tile, F.col(width).cast("int"))).withColumn("y1", F.least(F.col("y0") + tile, F.col(height).cast("int")))


def _meeting(a: DataFrame, b: DataFrame, image: str, of_a: Sequence[Column], of_b: Sequence[Column], cell: int = TILE) -> DataFrame:
    """Rows of a and b of an image whose rectangles (left, top, right, bottom; half open) meet, or might at a common edge.

    Both are dealt to the grid cells that they touch; a pair counts in the cell of its common corner only.
    Tiles touch four cells at most, so no image's boxes are joined with all of its tiles. Spark's estimate knows nothing of the
    cells that rows are dealt to, so it would broadcast a side that is far larger than it looks: the join is by merging.
    """
    place = lambda v: F.floor(v.cast("double") / cell)
    touched = lambda lo, hi: F.explode(F.sequence(place(lo), F.greatest(place(lo), F.ceil(hi.cast("double") / cell) - 1)))
    deal = lambda df, r: df.withColumn("_cx", touched(r[0], r[2])).withColumn("_cy", touched(r[1], r[3]))
    corner = (place(F.greatest(of_a[0], of_b[0])) == F.col("_cx")) & (place(F.greatest(of_a[1], of_b[1])) == F.col("_cy"))
    return deal(a, of_a).join(deal(b, of_b).hint("merge"), [image, "_cx", "_cy"]).where(corner).drop("_cx", "_cy")


def clip_runs(runs: DataFrame, tiles: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, tile_x, tile_y, label, y, x0, x1) of runs cut to the tiles that they meet, in tile coordinates."""
    t = tiles.select(image, F.col("x0").alias("tile_x"), F.col("y0").alias("tile_y"), F.col("x1").alias("tx1"), F.col("y1").alias("ty1"))
    c = F.col
    pairs = _meeting(runs, t, image, (c("x0"), c("y"), c("x1"), c("y") + 1), (c("tile_x"), c("tile_y"), c("tx1"), c("ty1")))
    met = pairs.where((c("y") >= c("tile_y")) & (c("y") < c("ty1")) & (c("x0") < c("tx1")) & (c("x1") > c("tile_x")))
    return met.select(image, "tile_x", "tile_y", "label", (c("y") - c("tile_y")).alias("y"), (F.greatest("x0", "tile_x") - c("tile_x")).alias("x0"), (F.least("x1", "tx1") - c("tile_x")).alias("x1"))


def boxes_in_tiles(boxes: DataFrame, tiles: DataFrame, image: str) -> DataFrame:
    """Each box with each tile that it overlaps: lx0, ly0, lx1, ly1 is the part inside, in tile coordinates, ends included.

    Other columns of the tiles stay.
    """
    t = tiles.withColumnsRenamed({"x0": "tile_x", "y0": "tile_y", "x1": "tx1", "y1": "ty1"})
    c = F.col
    pairs = _meeting(boxes, t, image, (c("x"), c("y"), c("x") + c("w"), c("y") + c("h")), (c("tile_x"), c("tile_y"), c("tx1"), c("ty1")))
    met = pairs.where((c("x") < c("tx1")) & (c("x") + c("w") > c("tile_x")) & (c("y") < c("ty1")) & (c("y") + c("h") > c("tile_y")))
    return met.withColumns(
        {
            "lx0": F.greatest("x", "tile_x") - c("tile_x"), "ly0": F.greatest("y", "tile_y") - c("tile_y"),
            "lx1": F.least(c("x") + c("w"), c("tx1")) - 1 - c("tile_x"), "ly1": F.least(c("y") + c("h"), c("ty1")) - 1 - c("tile_y"),
        }
    )


def truncated(parts: DataFrame) -> Column:
    """Whether a box's part touches its tile's edge: it is cut off there, or may be."""
    c = F.col
    return touches_edge("tile", c("lx0"), c("ly0"), c("lx1") - c("lx0") + 1, c("ly1") - c("ly0") + 1, c("tx1") - c("tile_x"), c("ty1") - c("tile_y"))


def truncation_report(parts: DataFrame, image: str) -> DataFrame:
    """(image, tile_x, tile_y, n_kept, n_removed, notes) after dropping instances that touch a tile's edge."""
    found = parts.groupBy(image, "tile_x", "tile_y").agg(F.count_if(~truncated(parts)).alias("n_kept"), F.count_if(truncated(parts)).alias("n_removed"))
    return found.withColumn("notes", F.when(F.col("n_removed") > 0, F.concat(F.lit("removed_truncated_instances="), F.col("n_removed").cast("string"))).otherwise(""))


def in_core(cx: Column, cy: Column, tile_w: Column, tile_h: Column, at_left: Column, at_top: Column, at_right: Column, at_bottom: Column, margin: int = CORE_MARGIN) -> Column:
    """Whether a centre lies in the tile's core: a margin off each edge that isn't the image's; a core without area is the whole tile."""
    x0, y0 = F.when(at_left, 0).otherwise(margin), F.when(at_top, 0).otherwise(margin)
    x1, y1 = F.when(at_right, tile_w).otherwise(tile_w - margin), F.when(at_bottom, tile_h).otherwise(tile_h - margin)
    return (x1 <= x0) | (y1 <= y0) | ((cx >= x0) & (cx < x1) & (cy >= y0) & (cy < y1))


def to_image(df: DataFrame, x: Sequence[str], y: Sequence[str]) -> DataFrame:
    """Tile coordinates moved to the image."""
    return df.withColumns({c: F.col(c) + F.col("tile_x") for c in x} | {c: F.col(c) + F.col("tile_y") for c in y})


def box_iou(a: str, b: str) -> Column:
    """IoU of boxes with columns ax, ay, aw, ah and bx, ..."""
    col = lambda p, k: F.col(p + k)
    w = F.greatest(F.lit(0.0), F.least(col(a, "x") + col(a, "w"), col(b, "x") + col(b, "w")) - F.greatest(col(a, "x"), col(b, "x")))
    h = F.greatest(F.lit(0.0), F.least(col(a, "y") + col(a, "h"), col(b, "y") + col(b, "h")) - F.greatest(col(a, "y"), col(b, "y")))
    union = col(a, "w") * col(a, "h") + col(b, "w") * col(b, "h") - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def cross_tile_candidates(parts: DataFrame, image: str, particle: str, iou: float = 0.5, distance: float = 50.0, area_ratio: float = 2.0, compat: bool = False) -> DataFrame:
    """(image, a, b, iou, distance) of detections that may be the same: by IoU, or near centres and like areas.

    parts: (image, particle, x, y, w, h, tile_x, tile_y) in image coordinates. Detections of the same tile
    only pair in compat mode. Of a pair, the one with the farther reach is sent to all cells that its reach touches, and
    meets the other in the cell of its centre. Cells are four times as wide as what reaches across them, so most boxes are in one
    or two of them; boxes of a farther reach meet in wider cells, to which the others are sent too if such boxes occur at all.
    """
    # Boxes whose IoU is above the limit have centres no further apart than their sides.
    c = F.col
    reach, px, py = F.greatest(F.lit(float(distance)), "w", "h"), c("x") + c("w") / 2, c("y") + c("h") / 2
    level = F.greatest(F.lit(0), F.ceil(F.log2(reach / (2 * distance)) / 2)).cast("int")
    levels = sorted(r[0] for r in parts.select(level.alias("l")).distinct().collect() if r[0] is not None)  # a few whole numbers
    side = F.lit(8.0 * distance) * F.pow(F.lit(4.0), c("level"))
    touched = lambda p: F.explode(F.sequence(F.floor((p - reach) / side), F.floor((p + reach) / side)))
    names = [particle, "x", "y", "w", "h", "tile_x", "tile_y"]
    of = lambda df, k: df.select(image, "level", "cx", "cy", *[c(n).alias(k + n) for n in names])
    a = of(parts.withColumn("level", level).withColumn("cx", touched(px)).withColumn("cy", touched(py)), "a")
    own = F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda l: l >= level))
    b = of(parts.withColumn("level", own).withColumn("cx", F.floor(px / side)).withColumn("cy", F.floor(py / side)), "b")
    ka, kb = c("a" + particle), c("b" + particle)
    of_pair = lambda k: F.greatest(F.lit(float(distance)), k + "w", k + "h")
    once = (of_pair("b") < of_pair("a")) | ((of_pair("b") == of_pair("a")) & (ka < kb))
    met = a.join(b.hint("merge"), [image, "level", "cx", "cy"]).where(once & (ka != kb))
    if not compat:
        met = met.where((c("atile_x") != c("btile_x")) | (c("atile_y") != c("btile_y")))
    met = met.withColumn("iou", box_iou("a", "b")).withColumn("distance", F.hypot(c("ax") + c("aw") / 2 - c("bx") - c("bw") / 2, c("ay") + c("ah") / 2 - c("by") - c("bh") / 2))
    areas = c("aw") * c("ah"), c("bw") * c("bh")
    like = (F.least(*areas) > 0) & (F.greatest(*areas) <= area_ratio * F.least(*areas)) & (c("distance") <= distance)
    return met.where((c("iou") > iou) | like).select(image, F.least(ka, kb).alias("a"), F.greatest(ka, kb).alias("b"), "iou", "distance")


def regions_in_tiles(regions: DataFrame, tiles: DataFrame, image: str) -> DataFrame:
    """(image, tile_x, tile_y, x0, y0, x1, y1): the parts of regions within tiles, in tile coordinates."""
    g = regions.select(image, *[F.col(k).alias("r" + k) for k in ("x0", "y0", "x1", "y1")])
    c = F.col
    left, top, right, bottom = F.greatest("rx0", "x0"), F.greatest("ry0", "y0"), F.least("rx1", "x1"), F.least("ry1", "y1")
    pairs = _meeting(tiles, g, image, [c(k) for k in ("x0", "y0", "x1", "y1")], [c("r" + k) for k in ("x0", "y0", "x1", "y1")])
    met = pairs.where((right > left) & (bottom > top))
    return met.select(image, c("x0").alias("tile_x"), c("y0").alias("tile_y"), (left - c("x0")).alias("x0"), (top - c("y0")).alias("y0"), (right - c("x0")).alias("x1"), (bottom - c("y0")).alias("y1"))


def rle_runs(rle: DataFrame, image: str, order: Sequence[str], count: str, height: int) -> DataFrame:
    """(image, start, stop, x, y): the foreground runs of column-major run lengths, which begin with background.

    Runs are ranges of the flat column order; x and y are where a run starts.
    """
    own = Window.partitionBy(image).orderBy(*order)
    stop = F.sum(count).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rle.withColumn("_k", F.row_number().over(own)).withColumn("stop", stop.cast("bigint")).withColumn("start", (F.col("stop") - F.col(count)).cast("bigint"))
    return rows.where("_k % 2 = 0").where(F.col("stop") > F.col("start")).select(image, "start", "stop", F.floor(F.col("start") / height).alias("x"), (F.col("start") % height).alias("y"))


def sink_seeds(histogram: DataFrame, image: str, x: str = "x", y: str = "y", n: str = "n", above: int = 10, radius: int = 2) -> DataFrame:
    """(image, x, y, n, seed): histogram cells above a height that no cell around exceeds, numbered by height, then place.

    Each cell is sent to the cells around it, and each takes the maximum; absent cells count 0.
    """
    c = F.col
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    tall = histogram.where(c(n) > above)
    sent = tall.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).select(image, (c(x) + c("_dx")).alias(x), (c(y) + c("_dy")).alias(y), c(n).alias("_m"))
    highest = sent.groupBy(image, x, y).agg(F.max("_m").alias("_m"))
    seeds = tall.join(highest, [image, x, y]).where(c(n) == c("_m")).drop("_m")
    return seeds.withColumn("seed", F.row_number().over(Window.partitionBy(image).orderBy(n, y, x)))
