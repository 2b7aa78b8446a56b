"""Flow fields and label maps as tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granulon.operators import flows, raster
from granulon.sources import png
from test_raster import discs


@pytest.fixture(scope="module")
def runs(spark):
    rows = []
    for name, labels in (("a", discs()), ("b", np.roll(discs(), 3, axis=1))):
        rows += [(name, *labels.shape, *map(int, r)) for r in flows.runs_of(labels).itertuples(index=False)]
    return spark.createDataFrame(rows, flows.RUNS)


def logits(true):
    """A perfect prediction."""
    five = lambda k: F.transform(k, lambda v: (v * 5).cast("float")).alias(k)
    return true.select("image_id", "h", "w", F.transform("cellprob", lambda v: (v * 100 - 50).cast("float")).alias("cellprob"), five("dy"), five("dx"))


def maps(df):
    out = {}
    for name, pdf in df.toPandas().groupby("image_id"):
        out[name] = flows.raster_of(pdf, int(pdf.h.iloc[0]), int(pdf.w.iloc[0]))
    return out


def test_there_and_back(runs):
    true = flows.flows_of_labels(runs).cache()
    found = maps(flows.labels_of_flows(logits(true), least=20))
    for name, labels in maps(runs).items():
        assert ((found[name] > 0) & (labels > 0)).sum() / ((found[name] > 0) | (labels > 0)).sum() > 0.95
        assert len(np.unique(found[name])) == 3
    got = flows.loss(logits(true), true).collect()
    assert len(got) == 2 and all(r.loss < 1e-6 for r in got)
    assert all(r.cell > 10 for r in flows.loss(logits(true).withColumn("cellprob", F.transform("cellprob", lambda v: -v)), true).collect())


def test_grid_equals_single_runs(runs):
    pred = logits(flows.flows_of_labels(runs)).cache()
    grid = flows.labels_of_grid(pred, [0.0, 60.0], [0.0, 0.4], [20, 180])
    for logit in (0.0, 60.0):
        for flow in (0.0, 0.4):
            for size in (20, 180):
                one = maps(flows.labels_of_flows(pred, logit_threshold=logit, flow_threshold=flow, least=size))
                own = maps(grid.where((F.col("logit_threshold") == logit) & (F.col("flow_threshold") == flow) & (F.col("min_size") == size)))
                assert one.keys() == own.keys() and all((one[k] == own[k]).all() for k in one)


def test_turned(runs):
    true = flows.flows_of_labels(runs)
    back = flows.turned(flows.turned(true, 1, True), 1, True)  # a mirrored quarter is its own inverse
    a, b = (df.orderBy("image_id").toPandas() for df in (true, back))
    assert all(np.allclose(x, y, atol=1e-6) for k in ("dy", "dx", "cellprob") for x, y in zip(a[k], b[k]))


def test_inputs_and_original_size(spark):
    grey = np.zeros((20, 40), np.uint16)
    grey[5:15, 10:30] = 1000
    images = spark.createDataFrame([("a", bytearray(png.encode_grey(grey))), ("b", bytearray(b"no"))], "image_id string, content binary")
    got = flows.model_inputs(images, 64, (0.5,) * 3, (0.5,) * 3).cache()
    row = got.first()
    assert got.count() == 1 and (row.height, row.width, row.top, row.left) == (32, 64, 16, 0) and len(row.input) == 3 * 64 * 64
    found = flows.predicted(got, lambda x: {"cellprob": x[:, 0, ::4, ::4], "dy": x[:, 1, ::4, ::4], "dx": x[:, 2, ::4, ::4]}, 64).first()
    assert (found.h, found.w) == (16, 16)
    with pytest.raises(ValueError):
        flows.predicted(got, None, 64)
    labels = (np.asarray(found.cellprob).reshape(16, 16) > 0).astype(np.int32)
    labels[:4] = labels[12:] = 0
    squares = spark.createDataFrame([("a", 16, 16, *map(int, r)) for r in flows.runs_of(labels).itertuples(index=False)], flows.RUNS)
    back = maps(flows.at_original(squares, got, spark.createDataFrame([("a", 20, 40)], "image_id string, h int, w int")))["a"]
    assert ((back > 0) != (grey > 0)).mean() < 0.1
