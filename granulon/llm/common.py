"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granulon.session import cut, shared_folder

__all__ = ["cut", "Recent", "drop_folder", "filter_rows", "fresh", "join_hot", "map_rows", "partitions", "shared_folder", "slices", "text_of"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    """A document's text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ours, in whatever store it is; nothing if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(rows: DataFrame, each: DataFrame, key: str, how: str = "left", shares: int = 1000) -> DataFrame:
    """rows joined with `each`, which has a key once; a key may hold any share of the rows.

    Keys with more than one in `shares` of the rows, fewer than `shares` of them whatever the input, are
    dealt to as many places as they have such shares, and only their rows of `each` are copied. rows are
    read twice, so they should be stored or cheap. Null keys meet nothing and are dealt out too. The place is a
    hash of all of a row's columns: a task that runs again deals its rows as before, in whatever order they come.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = rows.count()
    found = counts.where(F.col("n") > total // shares + 1).collect()  # fewer than `shares` rows
    if not found:
        return rows.join(each, key, how)
    places = {r[0]: -(-r[1] * shares // max(1, total)) for r in found}
    kind = each.schema[key].dataType.simpleString()
    hot = rows.sparkSession.createDataFrame([(k, n) for k, n in places.items() if k is not None], f"_hot {kind}, _places int")
    number = F.coalesce("_places", F.when(F.col("_hot").isNull() & F.col(key).isNull(), places.get(None, 1)), F.lit(1))
    dealt = rows.join(F.broadcast(hot), rows[key] == F.col("_hot"), "left").withColumn("_salt", F.pmod(F.xxhash64(*[rows[c] for c in rows.columns]), number).cast("int")).drop("_hot", "_places")
    copies = each.join(F.broadcast(hot), each[key] == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_places", F.lit(1)) - 1))).drop("_hot", "_places")
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


#: Rows, and bytes about, that a function of columns gets at once.
SLICE_ROWS, SLICE_BYTES = 1000, 8_000_000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches of a bounded size (but for a single larger row), without copying."""
    for batch in batches:
        rows = max(1, min(SLICE_ROWS, SLICE_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], list]], schema: str) -> DataFrame:
    """Arrow batches through a Python function of whole columns.

    make() runs once in each task and returns a function from {name: list of values} to the lists of
    the output columns, in the order of schema.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for part in slices(batches):
            columns = step({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows whose text the function made by make() keeps, with all their columns; null counts as empty."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for part in slices(batches):
            yield part.filter(pa.array(keep([x or "" for x in part.column(at).to_pylist()]), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def fresh(df: DataFrame, name: str) -> str:
    """A name for a column of our own that df doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Recent(dict):
    """What make(key) gave for the keys used of late, in two generations of most / 2 entries each.

    A key that is asked for again moves to the newer generation; when that is full, the older one goes.
    Keys longer than `longest` are never kept.
    """

    def __init__(self, make: Callable, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most // 2, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
