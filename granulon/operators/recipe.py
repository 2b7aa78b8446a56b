"""Rules of analysis recipes and inference settings, as data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required(document: Column, paths: Sequence[str]) -> Column:
    """The paths ($.a.b) that a JSON text lacks."""
    return F.array_compact(F.array(*[F.when(F.get_json_object(document, p).isNull(), F.lit(p)) for p in paths]))


def ranges(document: Column, limits: Mapping[str, tuple[float | None, float | None]]) -> Column:
    """The paths whose number is outside its range; what isn't there is no violation here, what isn't a number is."""
    out = []
    for path, (low, high) in limits.items():
        raw = F.get_json_object(document, path)
        x = raw.try_cast("double")
        bad = x.isNull()
        bad = bad | (x < low) if low is not None else bad
        bad = bad | (x > high) if high is not None else bad
        out.append(F.when(raw.isNotNull() & bad, F.lit(path)))
    return F.array_compact(F.array(*out))


def enums(document: Column, allowed: Mapping[str, Sequence[str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.get_json_object(document, p).isNotNull() & ~F.get_json_object(document, p).isin(*v), F.lit(p)) for p, v in allowed.items()]))


def implied(document: Column, when: str, value: str, then: Sequence[str]) -> Column:
    """The paths that must be there when one has a value, and aren't."""
    return F.when(F.get_json_object(document, when) == value, required(document, then)).otherwise(F.array().cast("array<string>"))


def unknown_members(document: Column, known: Sequence[str]) -> Column:
    """Top-level members outside the known ones."""
    members = F.map_keys(F.from_json(document, "map<string,string>"))
    return F.array_sort(F.array_except(F.coalesce(members, F.array().cast("array<string>")), F.array(*map(F.lit, known))))


def rule_table(df: DataFrame, key: str, checks: Mapping[str, Column]) -> DataFrame:
    """(key, rule, path): a row for each path that a check returns."""
    every = F.flatten(F.array(*[F.transform(c, _tagged(r)) for r, c in checks.items()]))
    return df.select(key, F.explode(every).alias("_v")).select(key, "_v.rule", "_v.path")


def _tagged(rule: str):
    return lambda p: F.struct(F.lit(rule).alias("rule"), p.alias("path"))


def overrides(recipe: Column, settings: Mapping[str, tuple[str, str]]) -> dict[str, Column]:
    """Setting columns: the recipe's value where it has one, else the present column's. settings: name -> (path, type)."""
    return {name: F.coalesce(F.get_json_object(recipe, path).try_cast(kind), F.col(name)) for name, (path, kind) in settings.items()}


def regions_valid(regions: Column) -> Column:
    """Whether all rectangles (x0, y0, x1, y1) have an area and no negative side."""
    return F.forall(regions, lambda r: (r["x0"] >= 0) & (r["y0"] >= 0) & (r["x1"] > r["x0"]) & (r["y1"] > r["y0"]))
