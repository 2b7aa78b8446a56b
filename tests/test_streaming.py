"""Streams over drop folders: keys once, names by content, states that outlive a stop."""

import pytest
from pyspark.sql import functions as F

from granulon.streaming import ingest

ROWS = "k string, at int, v string"


@pytest.fixture
def places(tmp_path):
    return str(tmp_path / "drop"), str(tmp_path / "table"), str(tmp_path / "checkpoint")


def drop(spark, folder, rows):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").json(folder)


def appended(spark, places, existing=None):
    folder, table, at = places
    ingest.append_stream(spark.readStream.schema(ROWS).json(folder), table, at, ["k"], ["at"], existing).awaitTermination()
    return sorted((str(r.k), r.at, r.v) for r in spark.read.parquet(table).collect())


def test_keys_once_over_drops(spark, places):
    drop(spark, places[0], [("a", 2, "second"), ("a", 1, "first"), ("b", 5, "x"), (None, 1, "none")])
    first = [("None", 1, "none"), ("a", 1, "first"), ("b", 5, "x")]
    assert appended(spark, places) == first
    assert appended(spark, places) == first  # nothing new
    drop(spark, places[0], [("a", 0, "late"), ("c", 9, "y"), ("c", 9, "x"), (None, 0, "again")])
    assert appended(spark, places) == [*first, ("c", 9, "x")]


def test_keys_that_were_there_before(spark, places):
    drop(spark, places[0], [("a", 1, "x"), ("b", 1, "x")])
    assert appended(spark, places, spark.createDataFrame([("a",), ("a",), ("q",)], "k string")) == [("b", 1, "x")]
    drop(spark, places[0], [("a", 2, "x"), ("c", 2, "x")])
    assert appended(spark, places) == [("b", 1, "x"), ("c", 2, "x")]


def test_a_batch_does_not_read_the_table(spark, places):
    """The table's rows may go elsewhere; the state alone knows the keys."""
    drop(spark, places[0], [("a", 1, "x")])
    appended(spark, places)
    spark.createDataFrame([("z", 0, "moved")], ROWS).write.mode("append").parquet(places[1] + "-elsewhere")
    drop(spark, places[0], [("a", 2, "y"), ("b", 2, "y")])
    folder, _, at = places
    query = ingest.append_stream(spark.readStream.schema(ROWS).json(folder), places[1], at, ["k"], ["at"])
    query.awaitTermination()
    state = query.lastProgress["stateOperators"][0] if query.lastProgress["stateOperators"] else {}
    assert state.get("numRowsTotal", 2) == 2


def test_names_by_content(spark, places):
    folder, table, at = places

    def run(existing=None):
        rows = spark.readStream.schema(ROWS).json(folder)
        ingest.upsert_stream(rows, table, at, "k", "v", "at", existing).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(table).collect()), key=str)

    drop(spark, folder, [("h1", 1, "a"), ("h1", 2, "b"), ("h2", 1, "c"), (None, 1, "unreadable"), ("h0", 1, "new name")])
    first = [("h0", "replace", "new name", "old name", 1), ("h1", "insert", "b", None, 2), ("h2", "insert", "c", None, 1)]
    assert run(spark.createDataFrame([("h0", "old name"), ("h9", "other")], "k string, v string")) == first
    drop(spark, folder, [("h1", 3, "d"), ("h3", 1, "e"), ("h3", 1, "f")])
    assert run() == sorted([*first, ("h1", "replace", "d", "b", 1), ("h3", "insert", "f", None, 2)], key=str)


def test_a_key_with_most_rows(spark, places):
    spark.range(30_000).select(F.lit("hot").alias("k"), F.col("id").cast("int").alias("at"), F.col("id").cast("string").alias("v")).write.json(places[0])
    assert appended(spark, places) == [("hot", 0, "0")]


def test_names_with_underscores(spark, places):
    folder, table, at = places
    spark.createDataFrame([("a", 2, "y"), ("a", 1, "x")], "_k string, at int, _v string").write.json(folder)
    ingest.append_stream(spark.readStream.schema("_k string, at int, _v string").json(folder), table, at, ["_k"], ["at"]).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(table).collect()] == [("a", 1, "x")]
