"""Readers: manifests, listings, label maps, flows, annotations, settings, text lists."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from granulon.functions.scalars import IMAGE_EXTENSIONS, stem
from granulon.operators import flows as flows_table
from granulon.operators import raster
from granulon.sources import blocks, png

COCO = (
    "images array<struct<id:bigint,file_name:string,height:int,width:int>>,"
    "annotations array<struct<id:bigint,image_id:bigint,category_id:int,segmentation:string,bbox:array<double>,area:double,iscrowd:int>>,"
    "categories array<struct<id:int,name:string,supercategory:string>>"
)


def manifest_csv(spark: SparkSession, path: str, fields: Sequence[str] | None = None) -> DataFrame:
    """All columns as text, a byte order mark stripped, quotes doubled; a large file is read by many tasks.

    With `fields`, the text of a record with surplus cells is in _corrupt; blocks.numbered_csv has line numbers and reasons.
    """
    read = blocks.numbered_csv(spark, path, fields)
    names = [f"`{f}`" for f in read.columns if f not in ("_file", "_line", "_row", "_reason", "_surplus")]
    return read.select(*names) if fields is None else read.select(*names, F.to_json("_surplus").alias("_corrupt"))


def numbered_jsonl(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """A column of text for each field, and _file, _line, _reason, _corrupt of each line that isn't blank.

    Lines that aren't JSON objects have their text in _corrupt and a reason. Real booleans become true and false.
    """
    lines = blocks.numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("_m", F.from_json("value", "map<string,string>"))
    bad = F.col("_m").isNull()
    cells = [F.try_element_at("_m", F.lit(f)).alias(f) for f in fields]
    return parsed.select(*cells, F.col("file").alias("_file"), F.col("line").alias("_line"), F.when(bad, "not an object").alias("_reason"), F.when(bad, F.col("value")).alias("_corrupt"))


def manifest_jsonl(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """Rows of JSON objects, blank lines skipped; what doesn't parse has its text in _corrupt."""
    return numbered_jsonl(spark, path, fields).select(*fields, "_corrupt")


def manifest(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    return manifest_jsonl(spark, path, fields) if path.lower().endswith((".jsonl", ".ndjson")) else manifest_csv(spark, path, fields)


def listing(spark: SparkSession, directory: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, stem, length) of files, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(directory)
    return files.select("path", stem(F.col("path")).alias("stem"), "length")


def is_image(path: Column, with_labels: bool = False) -> Column:
    image = F.lower(F.regexp_extract(path, r"\.[^.]+$", 0)).isin(*IMAGE_EXTENSIONS)
    return image if with_labels else image & ~stem(path).endswith("_labels")


def images(spark: SparkSession, directory: str, with_labels: bool = False) -> DataFrame:
    """(path, stem, length) of image files; label maps are left out unless asked for."""
    return listing(spark, directory).where(is_image(F.col("path"), with_labels))


def _from_files(files: DataFrame, one, schema: str, key: Column) -> DataFrame:
    """Rows from the content of each file, a file at a time."""
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = one(k, content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

    return files.select(key.alias("k"), "content").mapInArrow(run, schema)


def runs_of(image: str, labels: np.ndarray) -> list[tuple]:
    """(image, h, w, label, y, x0, x1) of the runs of equal labels above 0."""
    return [(image, *labels.shape, *map(int, r)) for r in flows_table.runs_of(labels).itertuples(index=False)]


def label_runs(spark: SparkSession, directory: str) -> DataFrame:
    """Runs of all *_labels.png; the image's id is the stem without that. Unreadable files have no rows."""

    def one(k: str, content: bytes) -> list[tuple]:
        labels = png.decode(content)
        if labels is None:
            return []
        return runs_of(k, labels if labels.ndim == 2 else labels[..., 0])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_labels.png").load(directory)
    return _from_files(files, one, flows_table.RUNS, F.regexp_replace(stem(F.col("path")), "_labels$", ""))


def mask_runs(spark: SparkSession, directory: str, pattern: str = "*.png", connectivity: int = 8, min_area: int = 1) -> DataFrame:
    """Runs of instances in masks: id maps as they are, binary masks by connected components."""

    def one(k: str, content: bytes) -> list[tuple]:
        mask = png.decode(content)
        if mask is None:
            return []
        mask = mask if mask.ndim == 2 else mask[..., 0]
        return runs_of(k, raster.components(mask, connectivity, min_area) if len(np.unique(mask)) <= 2 else mask.astype(np.int32))

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    return _from_files(files, one, flows_table.RUNS, stem(F.col("path")))


#: What is read of a file for its header, and of its values at once.
HEAD, VALUES = 128, 1 << 24


def _npy_header(data: bytes) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and the place of the first value, from a file's first bytes; longer headers ask for more of them."""
    source = io.BytesIO(data)
    version = np.lib.format.read_magic(source)
    shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(source)
    return shape, dtype, source.tell()


def flow_headers(spark: SparkSession, directory: str) -> DataFrame:
    """(path, image_id, length, ok, dtype, shape, start, bytes_read) of .npy files from their first bytes and lengths alone.

    ok: three channels of floats, and as many bytes as these need. The listing knows the lengths; the folder is one that
    pyarrow's file systems reach from all executors, and files are dealt to tasks by their number.
    """
    schema = "path string, image_id string, length bigint, ok boolean, dtype string, shape array<int>, start bigint, bytes_read bigint"
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def one(path: str, image: str, length: int) -> tuple:
        store, at = fs.FileSystem.from_uri(path)
        data, n = b"", HEAD
        with store.open_input_file(at) as source:
            while True:
                data += source.read(n - len(data))
                try:
                    shape, dtype, start = _npy_header(data)
                    break
                except (ValueError, EOFError, OSError):
                    if n >= 64 * HEAD or len(data) < n:
                        return path, image, length, False, None, None, None, len(data)
                    n *= 8
        whole = length == start + dtype.itemsize * int(np.prod(shape, dtype=np.int64))
        return path, image, length, bool(len(shape) == 3 and shape[0] >= 3 and dtype.kind == "f" and whole), str(dtype), list(shape), start, len(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(*r) for r in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(out)], schema=out)

    files = listing(spark, directory, "*.npy").select("path", "stem", "length")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(tasks, F.xxhash64("path")).mapInArrow(run, schema)


def flow_audit(spark: SparkSession, directory: str, header_only: bool = True) -> DataFrame:
    """(image_id, ok, dtype, shape, finite) of flow files; with header_only no values are read, and finite is null.

    Values are read by blocks of some megabytes, each a row of its own, so a large file isn't one task.
    """
    heads = flow_headers(spark, directory)
    if header_only:
        return heads.select("image_id", "ok", "dtype", "shape", F.lit(None).cast("boolean").alias("finite"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, dtype, at, size in zip(*(batch.column(k).to_pylist() for k in ("path", "dtype", "at", "size"))):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as source:
                    source.seek(at)
                    found.append(bool(np.isfinite(np.frombuffer(source.read(size), dtype)).all()))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.bool_())], names=["path", "finite"])

    good = heads.where("ok AND start < length").select("path", "dtype", "length", F.explode(F.sequence("start", F.col("length") - 1, F.lit(VALUES).cast("bigint"))).alias("at"))
    blocks_ = good.withColumn("size", F.least(F.lit(VALUES).cast("bigint"), F.col("length") - F.col("at"))).select("path", "dtype", "at", "size")
    finite = blocks_.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("path", "at")).mapInArrow(run, "path string, finite boolean").groupBy("path").agg(F.bool_and("finite").alias("finite"))
    joined = heads.join(finite, "path", "left")
    return joined.select("image_id", (F.col("ok") & F.coalesce("finite", F.lit(True))).alias("ok"), "dtype", "shape", "finite")


def flows(spark: SparkSession, directory: str) -> DataFrame:
    """(image_id, h, w, cellprob, dy, dx) of ground-truth flow files, whose channels are in that order."""

    def one(k: str, content: bytes) -> list[tuple]:
        flow = np.load(io.BytesIO(content))
        if flow.ndim != 3 or flow.shape[0] < 3:
            raise ValueError(f"{k}: a flow needs three channels")
        return [(k, flow.shape[1], flow.shape[2], *(flow[i].ravel() for i in range(3)))]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(directory)
    return _from_files(files, one, "image_id string, h int, w int, cellprob array<float>, dy array<float>, dx array<float>", stem(F.col("path")))


def raw_planes(spark: SparkSession, directory: str, height: int, width: int, pattern: str = "*.bin") -> DataFrame:
    """(image_id, plane array<float>) of raw 32-bit files; a file of another length is an error."""

    def one(k: str, content: bytes) -> list[tuple]:
        if len(content) != 4 * height * width:
            raise ValueError(f"{k}: {len(content)} bytes, not {4 * height * width}")
        return [(k, np.frombuffer(content, "<f4"))]

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(directory)
    return _from_files(files, one, "image_id string, plane array<float>", stem(F.col("path")))


def coco(spark: SparkSession, paths: str | Sequence[str], lines: bool = False, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of annotation files, each with its source file; segmentation stays JSON text.

    A file's one document is read by as many tasks as the file has blocks, whatever its size. lines: a document in each line.
    parts: one document in all files of a folder, as sinks.document_parts writes it.
    """
    if lines:
        doc = spark.read.schema(COCO).json(paths).withColumn("source_file", F.input_file_name())
        part = lambda name: doc.select("source_file", F.explode(name).alias("r")).select("source_file", "r.*")
    else:
        element = {f.name: f.dataType.elementType for f in T._parse_datatype_string(COCO)}
        found = blocks.json_elements(spark, paths, parts)
        part = lambda name: found.where(F.col("section") == name).select(F.col("file").alias("source_file"), F.from_json("text", element[name]).alias("r")).select("source_file", "r.*")
    return part("images"), part("annotations")


def name_list(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """(file_name) of a text file's lines, blank ones left out, and those that begin with # too."""
    lines = spark.read.text(path).select(F.trim("value").alias("file_name")).where("file_name <> ''")
    return lines.where(~F.col("file_name").startswith("#")) if comments else lines


def tuned(spark: SparkSession, path: str, defaults: dict[str, float]) -> DataFrame:
    """One row of parameters from a tuning result, bare or under best_params, else the defaults."""
    text = spark.read.text(path, wholetext=True)
    value = lambda n: F.coalesce(F.get_json_object("value", f"$.best_params.{n}"), F.get_json_object("value", f"$.{n}")).try_cast("double")
    return text.select(*[F.coalesce(value(n), F.lit(float(d))).alias(n) for n, d in defaults.items()])


def document(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc): a JSON file as one text, for the rules of operators.recipe."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("doc"))
