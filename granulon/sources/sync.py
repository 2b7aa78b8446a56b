"""Folders brought to the state of others: a plan from two listings, applied file by file in tasks.

The plan is a table of copy, replace, delete and keep; looking at it is the dry run. A file is written under a name of
its task's own and moved when it is whole, and a plan that is made anew after a stop has what is left to do. So a run that is
killed or repeated ends in the same state.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are in memory of a file that is copied.
CHUNK = 1 << 22
#: Names of files on their way; no listing has them.
OWN = ".part-"


def contents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(name, length, sum): the files of a folder with a checksum of their content, each read where Spark reads it.

    Spark's reader passes over files without a byte, so these come from its index of the folder's files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    read = files.select(name.alias("name"), "length", F.md5("content").alias("sum"))
    indexed = [(unquote(p.rsplit("/", 1)[-1]),) for p in files.inputFiles()]
    empty = spark.createDataFrame(indexed, "name string").join(read.select("name"), "name", "left_anti").select("name", F.lit(0).cast("bigint").alias("length"), F.md5(F.lit(b"")).alias("sum"))
    return read.unionByName(empty).where(~F.col("name").startswith(OWN))


def plan(source: DataFrame, target: DataFrame, strays: bool = True) -> DataFrame:
    """(name, action, old_length, new_length): copy what is new, replace what differs, delete what the source hasn't (or keep it, without `strays`)."""
    a = source.select("name", F.col("length").alias("new_length"), F.col("sum").alias("_new"))
    b = target.select("name", F.col("length").alias("old_length"), F.col("sum").alias("_old"))
    action = F.when(F.col("_old").isNull(), "copy").when(F.col("_new").isNull(), "delete" if strays else "keep").when(F.col("_old") == F.col("_new"), "keep").otherwise("replace")
    return a.join(b, "name", "full_outer").select("name", action.alias("action"), "old_length", "new_length")


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def apply(steps: DataFrame, source: str, target: str) -> DataFrame:
    """(name, action, done): what each step did; done is false where the file was already as the step leaves it.

    Nothing happens until the result is read; reading it again does nothing more. Names with a slash, and . and .., are an error:
    no step leaves the target's folder. Folders are ones that all executors share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (src, from_), (dst, to) = _store(source), _store(target)
        dst.create_dir(to, recursive=True)
        own = f"{to}/{OWN}{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            names, actions = (c.to_pylist() for c in batch.columns)
            done = []
            for name, action in zip(names, actions):
                if "/" in name or name in ("", ".", ".."):
                    raise ValueError(f"a name that leads elsewhere: {name!r}")
                there = dst.get_file_info(f"{to}/{name}").type == fs.FileType.File
                if action == "delete":
                    if there:
                        dst.delete_file(f"{to}/{name}")
                    done.append(there)
                elif action in ("copy", "replace"):
                    with src.open_input_stream(f"{from_}/{name}") as a, dst.open_output_stream(own) as b:
                        while data := a.read(CHUNK):
                            b.write(data)
                    dst.move(own, f"{to}/{name}")
                    done.append(True)
                else:
                    done.append(False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.bool_())], names=["name", "action", "done"])

    return steps.select("name", "action").mapInArrow(run, "name string, action string, done boolean")


def synchronise(spark: SparkSession, source: str, target: str, pattern: str = "*", strays: bool = True) -> dict[str, int]:
    """Make and apply the plan; the number of files by action. Running it again finds nothing to do."""
    there = contents(spark, target, pattern) if _exists(target) else spark.createDataFrame([], "name string, length bigint, sum string")
    steps = plan(contents(spark, source, pattern), there, strays).where("action <> 'keep'")
    return {r[0]: r[1] for r in apply(steps, source, target).groupBy("action").count().collect()}


def _exists(folder: str) -> bool:
    store, path = _store(folder)
    return store.get_file_info(path).type == fs.FileType.Directory
