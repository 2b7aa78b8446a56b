"""All queries besides the corpus operators' by name, with their DuckDB equivalents where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granulon.plans import files, images, labels, layouts, manifests, recipes, reporting

FLAGSHIP = "stratified_split"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in (manifests.QUERIES | images.QUERIES | labels.QUERIES | files.QUERIES | recipes.QUERIES | reporting.QUERIES | layouts.QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (manifests.QUERIES | images.QUERIES | labels.QUERIES | files.QUERIES | recipes.QUERIES | reporting.QUERIES | layouts.QUERIES).items() if sql}
