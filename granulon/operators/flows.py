"""Flow fields and label maps as tables: one row for each field, run-length rows for each map.

Kernels run on one image or tile at a time, wherever its row is; a map's runs are brought together by image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granulon.operators import raster
from granulon.operators import runs as runs_table

RUNS = "image_id string, h int, w int, label int, y int, x0 int, x1 int"
FLOWS = "image_id string, h int, w int, cellprob array<float>, dy array<float>, dx array<float>"


def runs_of(labels: np.ndarray) -> pd.DataFrame:
    """(label, y, x0, x1) of the runs of equal labels above 0; x1 is the first pixel behind a run."""
    h, w = labels.shape
    edge = np.ones((h, w + 1), bool)
    edge[:, 1:-1] = labels[:, 1:] != labels[:, :-1]
    ys, starts = np.nonzero(edge[:, :-1])
    found = pd.DataFrame({"label": labels[ys, starts], "y": ys, "x0": starts, "x1": np.nonzero(edge[:, 1:])[1] + 1}).astype(np.int32)
    return found[found.label > 0]


def raster_of(runs: pd.DataFrame, h: int, w: int) -> np.ndarray:
    out = np.zeros((h, w), np.int32)
    for label, y, a, b in zip(runs.label, runs.y, runs.x0, runs.x1):
        out[y, a:b] = label
    return out


def _named(runs: pd.DataFrame, image: str, h: int, w: int) -> pd.DataFrame:
    runs.insert(0, "image_id", image)
    runs.insert(1, "h", h)
    runs.insert(2, "w", w)
    return runs


def _planes(row: pd.Series) -> tuple[np.ndarray, ...]:
    return tuple(np.asarray(row[k], np.float32).reshape(row["h"], row["w"]) for k in ("dy", "dx", "cellprob"))


def flows_of_labels(runs: DataFrame) -> DataFrame:
    """The true flow of each label map: (image_id, h, w, cellprob, dy, dx), cellprob 1 inside and 0 outside."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf.h.iloc[0]), int(pdf.w.iloc[0])
        labels = raster_of(pdf, h, w)
        dy, dx = raster.flow_of_masks(labels)
        return pd.DataFrame([{"image_id": pdf.image_id.iloc[0], "h": h, "w": w, "cellprob": (labels > 0).astype(np.float32).ravel(), "dy": dy.astype(np.float32).ravel(), "dx": dx.astype(np.float32).ravel()}])

    return runs.groupBy("image_id").applyInPandas(run, FLOWS)


def labels_of_flows(flows: DataFrame, **settings) -> DataFrame:
    """Run-length rows of the instances of predicted fields (cellprob: logits); settings: of raster.postprocess."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                yield _named(runs_of(raster.postprocess(*_planes(row), **settings)), row["image_id"], row["h"], row["w"])

    return flows.select("image_id", "h", "w", "cellprob", "dy", "dx").mapInPandas(run, RUNS)


def labels_of_grid(flows: DataFrame, logit_thresholds: Sequence[float], flow_thresholds: Sequence[float], sizes: Sequence[int], steps: int = 200) -> DataFrame:
    """Run-length rows with the parameters (logit_threshold, flow_threshold, min_size) of each combination.

    What doesn't depend on a parameter is done once for an image: following the flow and clustering, and
    the instances' flow errors; the combinations only filter.
    """
    schema = f"logit_threshold double, flow_threshold double, min_size int, {RUNS}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                dy, dx, logit = _planes(row)
                found = raster.filter_sizes(raster.masks_of_flow(dy, dx, logit > 0, steps), 1, 0.5)
                for flow in flow_thresholds:
                    sound = raster.fill_holes(raster.drop_bad_flow(found, dy, dx, flow))
                    for size in sizes:
                        large = raster.filter_sizes(sound, size, 0.5)
                        for threshold in logit_thresholds:
                            kept = raster.relabel(raster.filter_logit(large, logit, threshold))
                            out = _named(runs_of(kept), row["image_id"], row["h"], row["w"])
                            for k, (name, value) in enumerate((("logit_threshold", threshold), ("flow_threshold", flow), ("min_size", size))):
                                out.insert(k, name, value)
                            yield out

    return flows.select("image_id", "h", "w", "cellprob", "dy", "dx").mapInPandas(run, schema)


def turned(flows: DataFrame, quarters: int = 0, mirror: bool = False) -> DataFrame:
    """Fields mirrored and turned, vectors with them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for _, row in pdf.iterrows():
                dy, dx, cell = _planes(row)
                dy, dx = raster.turned(dy, dx, quarters, mirror)
                cell = np.rot90(cell[:, ::-1] if mirror else cell, quarters % 4)
                rows.append({"image_id": row["image_id"], "h": cell.shape[0], "w": cell.shape[1], "cellprob": cell.ravel(), "dy": dy.ravel(), "dx": dx.ravel()})
            yield pd.DataFrame(rows, columns=["image_id", "h", "w", "cellprob", "dy", "dx"])

    return flows.select("image_id", "h", "w", "cellprob", "dy", "dx").mapInPandas(run, FLOWS)


def loss(pred: DataFrame, true: DataFrame) -> DataFrame:
    """(image_id, flow, cell, loss): mean squared error to five times the true flow, and cross entropy of inside.

    Array expressions of each pair of rows; a pixel isn't a row.
    """
    t = true.select("image_id", F.col("cellprob").alias("tc"), F.col("dy").alias("ty"), F.col("dx").alias("tx"))
    zipped = pred.join(t, "image_id").select("image_id", F.arrays_zip("cellprob", "dy", "dx", "tc", "ty", "tx").alias("p"))

    def mean(term: Callable[[Column], Column]) -> Column:
        return F.aggregate("p", F.lit(0.0), lambda s, q: s + term(q)) / F.size("p")

    def cell(q: Column) -> Column:
        x = q["cellprob"].cast("double")
        return F.greatest(x, F.lit(0.0)) - x * F.when(q["tc"] > 0.5, 1.0).otherwise(0.0) + F.log1p(F.exp(-F.abs(x)))

    flow = mean(lambda q: (F.pow(q["dy"] - 5.0 * q["ty"], 2.0) + F.pow(q["dx"] - 5.0 * q["tx"], 2.0)) / 2)
    found = zipped.select("image_id", flow.alias("flow"), mean(cell).alias("cell"))
    return found.withColumn("loss", F.col("flow") + F.col("cell"))


def model_inputs(images: DataFrame, side: int, mean: Sequence[float], std: Sequence[float], pad: float = 114) -> DataFrame:
    """(image_id, input array<float>, scale, top, left, height, width) of PNG images (image_id, content); unreadable ones have no row."""
    from granulon.sources import png

    names = ("scale", "top", "left", "height", "width")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf.image_id, pdf.content):
                image = png.decode(content)
                if image is None:
                    continue
                image = raster.to_8_bit(image) if image.dtype == np.uint16 else image
                image = np.repeat(image[..., None], 3, axis=2) if image.ndim == 2 else image[..., :3]
                square, how = raster.fit_square(image, side, pad)
                rows.append({"image_id": name, "input": raster.normalise(square, tuple(mean), tuple(std)).ravel(), **how})
            yield pd.DataFrame(rows, columns=["image_id", "input", *names])

    return images.select("image_id", "content").mapInPandas(run, "image_id string, input array<float>, scale double, top int, left int, height int, width int")


def at_original(runs: DataFrame, placed: DataFrame, sizes: DataFrame, stride: int = 4) -> DataFrame:
    """Runs of padded squares back at each image's own size: placed has scale, top, left, height and width, sizes h and w."""
    how = placed.select("image_id", *[F.col(k).alias("p_" + k) for k in ("top", "left", "height", "width")])
    own = sizes.select("image_id", F.col("h").alias("own_h"), F.col("w").alias("own_w"))
    joined = runs.join(how, "image_id").join(own, "image_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        labels = raster_of(pdf, int(first.h), int(first.w))
        back = raster.to_original(labels, {k: first["p_" + k] for k in ("top", "left", "height", "width")}, int(first.own_h), int(first.own_w), stride)
        return _named(runs_of(back), first.image_id, int(first.own_h), int(first.own_w))

    return joined.groupBy("image_id").applyInPandas(run, RUNS)


def polygon_runs(annotations: DataFrame, order: str, whole: bool = True) -> DataFrame:
    """Runs of each annotation's polygons: (image_id, order, label, y, x0, x1), label 1; annotations has image_id, h, w, polygons.

    Annotations have an order of their own within an image.
    """
    found = runs_table.of_polygons(annotations, ["image_id", order], "polygons", F.col("h"), F.col("w"), whole)
    return found.select("image_id", order, F.lit(1).alias("label"), *[F.col(k).cast("int").alias(k) for k in ("y", "x0", "x1")])


def label_map(annotations: DataFrame, order: str) -> DataFrame:
    """(image_id, y, x0, x1, label) of annotations with image_id, h, w, polygons: later ones cover earlier ones, numbered from 1 by what is seen.

    Rows of one image and order are one annotation.
    """
    lists = runs_table.filled(annotations, ["image_id", order], "polygons", F.col("h"), F.col("w"), whole=False, kind="int")
    # What a band shows of an annotation is one row until it has its number.
    numbered = runs_table.overlaid(lists, "image_id", order).withColumn("label", F.dense_rank().over(Window.partitionBy("image_id").orderBy(order)))
    return numbered.select("image_id", "label", F.inline(F.arrays_zip("y", "x0", "x1")).alias("y", "x0", "x1")).select("image_id", "y", "x0", "x1", "label")


def predicted(inputs: DataFrame, predict: Callable[[np.ndarray], Mapping[str, np.ndarray]] | None, side: int, batch: int = 4) -> DataFrame:
    """Fields (image_id, h, w, cellprob, dy, dx) of model inputs by a caller's model, a batch of inputs at a time.

    predict gets an array (n, 3, side, side) and returns cellprob, dy and dx, each (n, h, w). There is no
    model in this library; without one this is an error.
    """
    if predict is None:
        raise ValueError("a model is needed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                out = predict(np.stack([np.asarray(x, np.float32).reshape(3, side, side) for x in part.input]))
                yield pd.DataFrame([{"image_id": name, "h": out["dy"].shape[1], "w": out["dy"].shape[2], **{k: out[k][i].ravel().astype(np.float32) for k in ("cellprob", "dy", "dx")}} for i, name in enumerate(part.image_id)])

    return inputs.select("image_id", "input").mapInPandas(run, FLOWS)
