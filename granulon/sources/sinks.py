"""Writers: manifests, annotations, label maps, flows, reports."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulon.operators import reports
from granulon.operators.dedup import append_new
from granulon.operators.manifest import FIELDS as MANIFEST_FIELDS
from granulon.operators.manifest import normalise
from granulon.sources import png


def manifest(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Normalised rows as CSV with a header, or as JSON lines by the path's suffix."""
    rows = normalise(df).drop("row_no")
    rows = rows.coalesce(1) if one_file else rows
    if path.lower().endswith((".jsonl", ".ndjson")):
        rows.write.json(path)
    else:
        rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def append_manifest(existing: DataFrame, batch: DataFrame, path: str, key: Sequence[str] = ("record_id", "file_name")) -> None:
    """The batch's rows with new keys, appended to a manifest table."""
    rows = normalise(batch)
    append_new(existing, rows, key, list(rows.columns)).write.mode("append").parquet(path)


def splits(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows by split; existing ones are an error, or only the splits at hand are replaced."""
    writer = df.write.partitionBy("split")
    if overwrite:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("errorifexists").parquet(path)


def coco_documents(images: DataFrame, annotations: DataFrame, split: str = "split") -> DataFrame:
    """(split, document): images and annotations of each split as one JSON text. Annotations carry their image's split."""
    of = lambda df, name: df.groupBy(split).agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != split]))).alias(name))
    both = of(images, "images").join(of(annotations, "annotations"), split, "left")
    return both.select(split, F.to_json(F.struct("images", "annotations", F.array(F.struct(F.lit(1).alias("id"), F.lit("particle").alias("name"))).alias("categories"))).alias("document"))


def one_file(lines: DataFrame, path: str, head: Sequence[str] = (), order: str = "at", line: str = "line") -> None:
    """One text file in the folder `path`: the head, then the lines in order. One task streams it; the sort spills, nothing is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if head:
            yield pa.RecordBatch.from_pydict({"value": list(head)})
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string())], names=["value"])

    lines.repartition(1).sortWithinPartitions(order).select(F.col(line).alias("value")).mapInArrow(run, "value string").write.text(path)


def one_document(members: Mapping[str, DataFrame], path: str, head: str = "") -> None:
    """One JSON document in one file in the folder `path`: `head`, then a list for each member of its table's structs `e`.

    One task streams the elements, in order of a text column `at` where a member has one; no list is gathered, and empty lists are
    written too.
    """
    names = list(members)
    # A row of no member, so that there is a task where there are no elements.
    rows = members[names[0]].sparkSession.range(1).select(F.lit(-1).alias("k"), F.lit("").alias("line"), F.lit(None).cast("string").alias("at"))
    for k, name in enumerate(names):
        at = F.col("at") if "at" in members[name].columns else F.lit(None)
        lines = members[name].select(F.lit(k).alias("k"), F.to_json("e").alias("line"), at.cast("string").alias("at"))
        rows = rows.unionByName(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first = 0, True
        yield pa.RecordBatch.from_pydict({"value": ["{" + head + json.dumps(names[0]) + ": ["]})
        for batch in batches:
            out = []
            for k, text in zip(*(c.to_pylist() for c in batch.columns)):
                if k < 0:
                    continue
                while now < k:
                    now, first = now + 1, True
                    out.append("], " + json.dumps(names[now]) + ": [")
                out.append(text if first else "," + text)
                first = False
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})
        rest = ["], " + json.dumps(n) + ": [" for n in names[now + 1 :]]
        yield pa.RecordBatch.from_pydict({"value": [*rest, "]}"]})

    rows.repartition(1).sortWithinPartitions("k", "at").select("k", "line").mapInArrow(run, "value string").write.text(path)


def document_parts(members: Mapping[str, DataFrame], path: str, head: str = "") -> None:
    """One JSON document as the files below the folder `path`, which are it one after the other by their names.

    As `one_document`, but every task writes the elements that it has, in no order, each with a comma before it. The first element
    of a list has none: it is the least one, which is written with the list's begin; of its copies all but one stay. Tables are read
    three times, nothing is shuffled. blocks.json_elements and readers.coco read such folders with `parts`.
    """
    spark = next(iter(members.values())).sparkSession
    text = "{" + head
    for k, (name, df) in enumerate(members.items()):
        lines = df.select(F.to_json("e").alias("value"))
        first = lines.agg(F.min("value")).first()[0]
        text += json.dumps(name) + ": [" + (first or "")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{k:03d}-0")
        if first is not None:
            same = F.col("value") == first
            copies = spark.range(lines.where(same).count() - 1).select(F.lit(first).alias("value"))
            lines.where(~same).unionByName(copies).select(F.concat(F.lit(","), "value")).write.text(f"{path}/{k:03d}-1")
        text = "], "
    spark.createDataFrame([("]}",)], "value string").coalesce(1).write.text(f"{path}/{len(members):03d}-0")


def report(head: DataFrame, lists: Mapping[str, DataFrame], path: str) -> None:
    """A report as one JSON document in the folder `path`: the members of the head's one row, then the lists, whole."""
    first = head.select(F.to_json(F.struct(*head.columns))).first()[0]
    one_document(lists, path, first[1:-1] + ", " if len(first) > 2 else "")


def coco_splits(images: DataFrame, annotations: DataFrame, folder: str, split: str = "split") -> list[str]:
    """A document of each split in `folder`, named instances_<split>.json; annotations carry their image's split. Returns the splits."""
    found = sorted(r[0] for r in images.select(split).where(F.col(split).isNotNull()).distinct().collect())  # a name for each file
    names = lambda df: F.struct(*[F.col(f"`{c}`") for c in df.columns if c != split]).alias("e")
    kinds = images.sparkSession.range(1).select(F.struct(F.lit(1).alias("id"), F.lit("particle").alias("name")).alias("e"))
    for one in found:
        own = {"images": images.where(F.col(split) == one).select(names(images)), "annotations": annotations.where(F.col(split) == one).select(names(annotations)), "categories": kinds}
        one_document(own, f"{folder}/instances_{one}.json")
    return found


def label_images(runs: DataFrame, image: str = "image_id") -> DataFrame:
    """(image_id, content): 16-bit PNG files of run-length rows (h, w, label, y, x0, x1); ids are held to 1 ... 65535."""
    rows = F.collect_list(F.struct("label", "y", "x0", "x1"))
    grouped = runs.groupBy(image, "h", "w").agg(rows.alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, contents = [], []
            for row in batch.to_pylist():
                out = np.zeros((row["h"], row["w"]), np.uint16)
                for r in row["r"]:
                    out[r["y"], r["x0"] : r["x1"]] = min(max(r["label"], 1), 65535)
                names.append(row[image])
                contents.append(png.encode_grey(out))
            yield pa.RecordBatch.from_pydict({image: names, "content": contents})

    return grouped.mapInArrow(run, f"{image} string, content binary")


def flow_files(flows: DataFrame) -> DataFrame:
    """(image_id, content): .npy files of flow rows (h, w, cellprob, dy, dx)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, contents = [], []
            for row in batch.to_pylist():
                sink = io.BytesIO()
                np.save(sink, np.array([row["cellprob"], row["dy"], row["dx"]], np.float32).reshape(3, row["h"], row["w"]))
                names.append(row["image_id"])
                contents.append(sink.getvalue())
            yield pa.RecordBatch.from_pydict({"image_id": names, "content": contents})

    return flows.select("image_id", "h", "w", "cellprob", "dy", "dx").mapInArrow(run, "image_id string, content binary")


def npy_files(arrays: DataFrame, values: str, key: str = "image_id", cut_col: str | None = None) -> DataFrame:
    """(key, content): .npy files of rows with a type (dtype), a shape and values; cut_col: bytes to leave out at the end."""
    rows = arrays.select(F.col(key).cast("string"), "dtype", "shape", values, (F.col(cut_col) if cut_col else F.lit(0)).cast("int").alias("_cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = []
            for _, dtype, shape, v, cut in zip(*(c.to_pylist() for c in batch.columns)):
                sink = io.BytesIO()
                np.save(sink, np.array(v).astype(dtype).reshape(shape))
                contents.append(sink.getvalue()[: len(sink.getvalue()) - cut])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary())], names=[key, "content"])

    return rows.mapInArrow(run, f"{key} string, content binary")


def files(contents: DataFrame, folder: str, suffix: str, key: str = "image_id") -> int:
    """A file of each row's content, named by its key; returns how many. A file is whole under its name or not there.

    The folder is one that all executors share, as a path or an address.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder) if urlsplit(folder).scheme else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        own = f"{base}/.part-{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, content in zip(names, batch.column(1)):
                with store.open_output_stream(own) as sink:
                    sink.write(content.as_py())
                store.move(own, f"{base}/{name}{suffix}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(names)], pa.int64())})

    written = contents.select(F.col(key).cast("string"), "content").mapInArrow(run, "n bigint")
    return written.agg(F.sum("n")).first()[0] or 0


def report_json(parts: dict[str, DataFrame], rows: int = 50) -> str:
    """A short report of tables: `rows` rows of each, in no order, and the number of all. `report` writes whole ones."""
    out = {}
    for name, df in parts.items():
        listed = [json.loads(x) for x in df.limit(rows).toJSON().collect()]
        out[name] = {"count": len(listed) if len(listed) < rows else df.count(), "rows": listed}
    return json.dumps(out, ensure_ascii=False, sort_keys=True)


def readiness_markdown(summary: DataFrame, gates: DataFrame, values: int = 50) -> str:
    """The readiness report: the most frequent values of each field, then all that passed or failed; one job."""
    return reports.markdown(summary, gates, values).first()[0]
