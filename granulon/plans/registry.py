"""How a query and its SQL are put into a module's table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def adder(table: dict[str, tuple[Query, str | None]]) -> Callable[[str | None], Callable[[Query], Query]]:
    """A decorator that files a function under its name with the SQL given."""

    def with_sql(sql: str | None = None) -> Callable[[Query], Query]:
        def put(run: Query) -> Query:
            table[run.__name__] = (run, sql)
            return run

        return put

    return with_sql
