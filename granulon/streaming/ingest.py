"""Drop folders of rows, taken into tables once each key, with the keys seen so far as the stream's own state.

A batch costs what it brings, whatever the table holds: keys are looked up in the state store, not in the table. State and
files are committed with a batch, so a stream that stops and starts again neither loses nor repeats one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from granulon.operators.manifest import FIELDS, normalise

#: The store that the states here need; set for the session before a stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def manifest_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest rows of JSON files as they arrive in a folder."""
    return normalise(spark.readStream.schema(", ".join(f"`{f}` string" for f in FIELDS)).json(folder))


class _First(StatefulProcessor):
    """Of a key that was never seen: its first row in order; of others nothing."""

    def __init__(self, order: Sequence[str], names: Sequence[str], columns: Sequence[str]):
        self.order, self.names, self.columns = list(order), list(names), list(columns)

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "at boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        best = None
        for part in rows:  # a key may have any number of rows: one is held
            if part.empty:  # a key that was there before and has no rows now
                continue
            part.columns = self.columns  # names that begin with _ don't come through
            some = part if best is None else pd.concat([best, part])
            best = some.sort_values(self.order, kind="stable").head(1)
        if best is not None and not self.seen.exists():
            self.seen.update((True,))
            yield best[self.names]

    def handleInitialState(self, key, state: pd.DataFrame, timers) -> None:  # noqa: N802
        self.seen.update((True,))

    def close(self) -> None:
        pass


def append_stream(rows: DataFrame, table: str, checkpoint: str, key: Sequence[str] = ("record_id", "file_name"), order: Sequence[str] = (), existing: DataFrame | None = None) -> StreamingQuery:
    """Append what has a new key, of several rows in a batch the first in order, then by all columns.

    The keys seen are the stream's state; `existing` has those that were in the table before its first batch, and is read
    then only. Null keys count as blank ones.
    """
    spark = rows.sparkSession
    spark.conf.set(*STORE)
    names = rows.columns
    by = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(key)]
    keyed = rows.select(*names, *by).groupBy(*[f"_k{i}" for i in range(len(key))])
    old = existing.select(*by).distinct().groupBy(*[f"_k{i}" for i in range(len(key))]) if existing is not None else None
    found = keyed.transformWithStateInPandas(_First([*order, *[n for n in names if n not in order]], names, [*names, *[f"_k{i}" for i in range(len(key))]]), rows.schema, "append", "none", old)
    return found.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Current(StatefulProcessor):
    """Of a content: insert when it is new, replace when it has a name already, with the last name in order of the batch."""

    def init(self, handle) -> None:
        self.name = handle.getValueState("name", "name string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        last, n = None, 0
        for part in rows:
            if part.empty:
                continue
            n += len(part)
            top = part.sort_values(["place", "name"], kind="stable").iloc[-1]
            if last is None or (top["place"], top["name"]) > last:
                last = (top["place"], top["name"])
        if last is None:
            return
        old = self.name.get()[0] if self.name.exists() else None
        self.name.update((last[1],))
        yield pd.DataFrame({"content": [key[0]], "action": ["insert" if old is None else "replace"], "name": [last[1]], "old_name": [old], "n": [n]})

    def handleInitialState(self, key, state: pd.DataFrame, timers) -> None:  # noqa: N802
        self.name.update((state["name"].max(),))

    def close(self) -> None:
        pass


ACTIONS = T.StructType([T.StructField(n, T.StringType()) for n in ("content", "action", "name", "old_name")] + [T.StructField("n", T.LongType())])


def upsert_stream(rows: DataFrame, table: str, checkpoint: str, content: str, name: str, order: str, existing: DataFrame | None = None) -> StreamingQuery:
    """A log (content, action, name, old_name, n) of what each batch does to files known by their content.

    The last name in order holds: a known content is replaced under it, a new one inserted. n counts the batch's rows.
    Rows without content or order take no part. `existing` (content, name) is what is there before the first batch.
    """
    spark = rows.sparkSession
    spark.conf.set(*STORE)
    kept = rows.where(F.col(content).isNotNull() & F.col(order).isNotNull())
    own = kept.select(F.col(content).cast("string").alias("content"), F.coalesce(F.col(name).cast("string"), F.lit("")).alias("name"), F.col(order).alias("place"))
    old = existing.where(F.col(content).isNotNull()).select(F.col(content).cast("string").alias("content"), F.col(name).cast("string").alias("name")).groupBy("content") if existing is not None else None
    found = own.groupBy("content").transformWithStateInPandas(_Current(), ACTIONS, "append", "none", old)
    return found.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, kind, n) per tumbling window, with a watermark when it is a stream."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
