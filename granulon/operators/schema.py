"""JSON Schema as one expression: a schema is compiled to the array of what a document violates.

A document is parsed once, to a variant. Every keyword is a check of its own; members without a name and items of arrays are
checked by a function over them. `violated` takes all places that the schema names out of the document first, as columns, so
that Spark compiles the checks over them; `violations` is one expression, which Spark interprets, with each object as a map of
its members. Expressions are built as SQL text, which Spark parses at once. Keywords that aren't known are an error when the
schema is compiled, so that no rule is passed over in silence.

Known: type, enum and const (scalars), minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, minLength, maxLength, pattern,
required, properties, additionalProperties, minProperties, maxProperties, dependentRequired, items, minItems, maxItems,
uniqueItems, contains, allOf, anyOf, oneOf, not, if, then, else, $ref to #/... without circles, and true or false for a schema.
Numbers are compared as doubles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from itertools import count
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What says nothing about validity by itself.
ANNOTATIONS = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly", "then", "else"}
#: Keywords that look into an object.
OF_OBJECTS = {"required", "dependentRequired", "properties", "additionalProperties", "minProperties", "maxProperties"}
NONE = "CAST(array() AS array<struct<path:string,rule:string>>)"

Schema = Mapping[str, Any] | bool


def violations(document: str, schema: Schema) -> Column:
    """(path, rule) of each violation of the JSON text in a column, in no particular order; of a text that isn't JSON: $ and json.

    A null document violates nothing.
    """
    name = f"`{document}`"
    checked = _Compiler(schema)
    body = checked.let(f"try_parse_json({name})", lambda v: f"CASE WHEN {v} IS NULL THEN array(named_struct('path', '$', 'rule', 'json')) ELSE {checked.array(_Place(v), schema, _Path())} END")
    return F.expr(f"CASE WHEN {name} IS NULL THEN {NONE} ELSE {body} END")


def valid(document: str, schema: Schema) -> Column:
    return F.size(violations(document, schema)) == 0


def violated(rows: DataFrame, document: str, schema: Schema) -> DataFrame:
    """rows without the document, with path and rule: a row for each of its `violations`; the way for many documents."""
    rest = F.struct(*[F.col(f"`{n}`") for n in rows.columns if n != document]).alias("_rest")
    checked = _Flat(schema)
    if not checked.fit:
        return rows.select(rest, F.explode(violations(document, schema)).alias("_x")).select("_rest.*", "_x.path", "_x.rule")
    found, columns = checked.compiled()
    now = rows.select(rest, F.expr(f"`{document}` IS NOT NULL").alias("_given"), F.expr(f"try_parse_json(`{document}`)").alias("_v"))
    columns[0]["_no"] = "_given AND _v IS NULL"
    for some in columns:
        now = now.select("*", *[F.expr(sql).alias(name) for name, sql in some.items()])
    json = "array(CASE WHEN _no THEN named_struct('path', '$', 'rule', 'json') END)"
    # Checks are an array of structs or null: a project of its own, so that no interpreted function stands above them.
    now = now.select("_rest", F.expr(f"concat({json}, {found})").alias("_x"))
    # Of a bare column Spark would infer a filter on its size, and work out all checks once more for it.
    return now.select("_rest", F.explode(F.array_compact("_x")).alias("_x")).select("_rest.*", "_x.path", "_x.rule")


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


class _Path:
    """Where a value is: an expression, if it depends on the document, and a constant behind it."""

    def __init__(self, before: str | None = None, behind: str = "$"):
        self.before, self.behind = before, behind

    def member(self, name: str) -> _Path:
        return _Path(self.before, f"{self.behind}.{name}")

    def found(self, form: str) -> _Path:
        return _Path(f"concat({self.sql()}, {form})", "")

    def sql(self) -> str:
        return _text(self.behind) if self.before is None else f"concat({self.before}, {_text(self.behind)})" if self.behind else self.before


def _get(v: str, kind: str) -> str:
    return f"try_variant_get({v}, '$', '{kind}')"


def _numeric(kind: str) -> str:
    """Whether a kind is one of those that JSON's numbers have: BIGINT, DOUBLE and DECIMAL(...)."""
    return f"left({kind}, 3) IN ('BIG', 'DOU', 'DEC')"


class _Place:
    """SQL of a value in a document, null if it isn't there, and of what is asked about it; members only of objects that are let."""

    def __init__(self, v: str, members: str | None = None):
        self.v, self.members = v, members

    @property
    def there(self) -> str:
        return f"{self.v} IS NOT NULL"

    @property
    def kind(self) -> str:
        return f"schema_of_variant({self.v})"

    @property
    def number(self) -> str:
        """As a double; null if it isn't a number."""
        return f"(CASE WHEN {_numeric(self.kind)} THEN {_get(self.v, 'double')} END)"

    @property
    def text(self) -> str:
        """Null if it isn't a string."""
        return f"(CASE WHEN {self.kind} = 'STRING' THEN {_get(self.v, 'string')} END)"

    @property
    def truth(self) -> str:
        """Null if it isn't a boolean."""
        return f"(CASE WHEN {self.kind} = 'BOOLEAN' THEN {_get(self.v, 'boolean')} END)"

    @property
    def null(self) -> str:
        return f"is_variant_null({self.v})"

    @property
    def items(self) -> str:
        return _get(self.v, "array<variant>")

    @property
    def an_object(self) -> str:
        return f"{self.members or _get(self.v, 'map<string,variant>')} IS NOT NULL"

    @property
    def size(self) -> str:
        return f"size({self.members})"

    def has(self, name: str) -> str:
        return f"{self.members}[{_text(name)}] IS NOT NULL"

    def member(self, name: str) -> _Place:
        return _Place(f"{self.members}[{_text(name)}]")

    def entries(self) -> str:
        return f"map_entries({self.members})"

    def others(self, known: str) -> str:
        return f"array_except(map_keys({self.members}), {known})"


class _Named(_Place):
    """A place that the schema names: its value, kind and so on are columns that are worked out before all checks."""

    def __init__(self, flat: _Flat, names: tuple[str, ...]):
        self.flat, self.names = flat, names
        # Names that Spark's paths and types can't hold leave the schema to `violations`.
        flat.fit = flat.fit and all(re.fullmatch(r"[^'\"\\?`]+", n) for n in names)

    def _column(self, sql: str) -> str:
        return self.flat.column(1, sql)

    @property
    def path(self) -> str:
        return _text("$" + "".join(f"['{n}']" for n in self.names))

    @property
    def v(self) -> str:
        return "_v" if not self.names else f"try_variant_get(_v, {self.path}, 'variant')" if self.names in self.flat.objects else self.flat.leaf(self.names)

    @property
    def there(self) -> str:
        # An object's value is taken out of the document only where it may be something else.
        return self._column(f"({self.an_object} OR {self.v} IS NOT NULL)" if self.names and self.names in self.flat.objects else super().there)

    @property
    def kind(self) -> str:
        return self._column(super().kind)

    @property
    def number(self) -> str:
        return self._column(f"CASE WHEN {_numeric(super().kind)} THEN {_get(self.v, 'double')} END")

    @property
    def text(self) -> str:
        return self._column(f"CASE WHEN {super().kind} = 'STRING' THEN {_get(self.v, 'string')} END")

    @property
    def truth(self) -> str:
        return self._column(f"CASE WHEN {super().kind} = 'BOOLEAN' THEN {_get(self.v, 'boolean')} END")

    @property
    def null(self) -> str:
        return self._column(super().null)

    @property
    def items(self) -> str:
        return self._column(super().items)

    @property
    def keys(self) -> str:
        # Only names are wanted: values of this type are null without being looked at.
        return self.flat.column(0, f"map_keys(try_variant_get(_v, {self.path}, 'map<string,array<array<boolean>>>'))")

    @property
    def an_object(self) -> str:
        return f"{self.keys} IS NOT NULL"

    @property
    def size(self) -> str:
        return f"size({self.keys})"

    def has(self, name: str) -> str:
        return f"array_contains({self.keys}, {_text(name)})"

    def member(self, name: str) -> _Named:
        return _Named(self.flat, (*self.names, name))

    def entries(self) -> str:
        return self._column(f"map_entries(try_variant_get(_v, {self.path}, 'map<string,variant>'))")

    def others(self, known: str) -> str:
        return f"array_except({self.keys}, {known})"


def _is(p: _Place, kind: str) -> str:
    """Whether a value is of a JSON type; null or false if it isn't there."""
    match kind:
        case "object":
            return f"({p.an_object})"
        case "array":
            return f"({p.items} IS NOT NULL)"
        case "string" | "boolean":
            return f"({p.kind} = '{kind.upper()}')"
        case "null":
            return p.null
        case "number":
            return f"({_numeric(p.kind)})"
        case "integer":
            return f"({p.number} IS NOT NULL AND {p.number} = floor({p.number}))"
    raise ValueError(f"a type that isn't known: {kind}")


def _among(p: _Place, values: list) -> str:
    """Whether a value is one of some scalars."""
    some = []
    if any(x is None for x in values):
        some.append(p.null)
    numbers = [f"{float(x)!r}D" for x in values if isinstance(x, int | float) and not isinstance(x, bool)]
    lists = {"number": numbers, "text": [_text(x) for x in values if isinstance(x, str)], "truth": [str(x).lower() for x in values if isinstance(x, bool)]}
    some += [f"coalesce({getattr(p, of)} IN ({', '.join(known)}), false)" for of, known in lists.items() if known]
    for x in values:
        if not (x is None or isinstance(x, bool | int | float | str)):
            raise ValueError(f"enum and const of scalars only: {x}")
    return " OR ".join(some) or "false"


class _Check(NamedTuple):
    """A violation if `bad` is true; not if it is null."""

    bad: str
    rule: str
    path: _Path

    def sql(self) -> str:
        return f"CASE WHEN {self.bad} THEN named_struct('path', {self.path.sql()}, 'rule', {_text(self.rule)}) END"


class _Compiler:
    def __init__(self, root: Schema):
        self.root = root
        self.within: tuple[str, ...] = ()  # references on the way here
        self.names = count()

    def let(self, value: str, body: Callable[[str], str]) -> str:
        """body of a name for a value that is worked out once."""
        name = f"v{next(self.names)}"
        return f"get(transform(array({value}), {name} -> {body(name)}), 0)"

    def together(self, checks: list[_Check], lists: list[str], named: bool = False) -> str:
        """Checks and lists as one array, which has nulls too if the place is a named one."""
        own = f"array({', '.join(x.sql() for x in checks)})"
        parts = [*([own if named else f"array_compact({own})"] if checks else []), *lists]
        return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0] if parts else NONE

    def array(self, p: _Place, schema: Schema, path: _Path) -> str:
        """All violations at and below a place as one array."""
        return self.together(*self.node(p, schema, path), isinstance(p, _Named))

    def holds(self, p: _Place, schema: Schema) -> str:
        checks, lists = self.node(p, schema, _Path())
        none = [f"({' OR '.join(f'({x.bad})' for x in checks)}) IS NOT TRUE"] if checks else []
        return f"({' AND '.join([*none, *[f'size(array_compact({x})) = 0' for x in lists]]) or 'true'})"

    def node(self, p: _Place, schema: Schema, path: _Path) -> tuple[list[_Check], list[str]]:
        """Checks of a value that may be absent (null, which violates nothing), and arrays of more."""
        if isinstance(schema, bool):
            return ([] if schema else [_Check(p.there, "false", path)]), []
        if OF_OBJECTS.isdisjoint(schema):
            return self.keywords(p, schema, path)
        if isinstance(p, _Named):
            p.flat.objects.add(p.names)
            return self.keywords(p, schema, path)
        inner = self.let(f"named_struct('v', {p.v}, 'm', {_get(p.v, 'map<string,variant>')})", lambda n: self.together(*self.keywords(_Place(f"{n}.v", f"{n}.m"), schema, path)))
        return [], [f"CASE WHEN {p.v} IS NULL THEN {NONE} ELSE {inner} END"]

    def keywords(self, p: _Place, schema: Mapping[str, Any], path: _Path) -> tuple[list[_Check], list[str]]:
        checks: list[_Check] = []
        lists: list[str] = []
        add = lambda bad, rule, at=path: checks.append(_Check(bad, rule, at))
        bounds = {"minimum": "<", "maximum": ">", "exclusiveMinimum": "<=", "exclusiveMaximum": ">="}
        for keyword, x in schema.items():
            match keyword:
                case "type":
                    kinds = " OR ".join(_is(p, k) for k in ([x] if isinstance(x, str) else x))
                    add(f"{p.there} AND NOT ({kinds})", "type")
                case "enum" | "const":
                    add(f"{p.there} AND NOT ({_among(p, x if keyword == 'enum' else [x])})", keyword)
                case "minimum" | "maximum" | "exclusiveMinimum" | "exclusiveMaximum":
                    add(f"{p.number} {bounds[keyword]} {float(x)!r}D", keyword)
                case "minItems" | "maxItems":
                    add(f"{p.items} IS NOT NULL AND size({p.items}) {'<' if keyword == 'minItems' else '>'} {int(x)}", keyword)
                case "minLength" | "maxLength":
                    add(f"length({p.text}) {'<' if keyword == 'minLength' else '>'} {int(x)}", keyword)
                case "minProperties" | "maxProperties":
                    add(f"{p.an_object} AND {p.size} {'<' if keyword == 'minProperties' else '>'} {int(x)}", keyword)
                case "multipleOf":
                    add(f"{p.number} / {float(x)!r}D <> round({p.number} / {float(x)!r}D)", keyword)
                case "pattern":
                    add(f"NOT regexp_like({p.text}, {_text(x)})", keyword)
                case "required":
                    for name in x:
                        add(f"{p.an_object} AND NOT ({p.has(name)})", keyword, path.member(name))
                case "dependentRequired":
                    for name, others in x.items():
                        for other in others:
                            add(f"{p.has(name)} AND NOT ({p.has(other)})", keyword, path.member(other))
                case "properties":
                    for name, sub in x.items():
                        own, more = self.node(p.member(name), sub, path.member(name))
                        checks += own
                        lists += more
                case "additionalProperties":
                    e = f"e{next(self.names)}"
                    known = f"CAST(array({', '.join(map(_text, schema.get('properties', {})))}) AS array<string>)"
                    if x is False:
                        at = path.found(f"concat('.', {e})")
                        found = f"transform({p.others(known)}, {e} -> named_struct('path', {at.sql()}, 'rule', 'additionalProperties'))"
                        # Few objects have other members: none of them is an empty array, and no function is called.
                        lists.append(f"CASE WHEN size({p.others(known)}) > 0 THEN {found} ELSE {NONE} END")
                    else:
                        at = path.found(f"concat('.', {e}.key)")
                        entries = f"filter({p.entries()}, {e} -> NOT array_contains({known}, {e}.key))"
                        lists.append(f"coalesce(flatten(transform({entries}, {e} -> {self.array(_Place(f'{e}.value'), x, at)})), {NONE})")
                case "items":
                    e = f"e{next(self.names)}"
                    at = path.found(f"concat('[', {e}i, ']')")
                    own, more = self.node(_Place(e), x, at)
                    if len(own) == 1 and not more:
                        lists.append(f"coalesce(array_compact(transform({p.items}, ({e}, {e}i) -> {own[0].sql()})), {NONE})")
                    else:
                        lists.append(f"coalesce(flatten(transform({p.items}, ({e}, {e}i) -> {self.together(own, more)})), {NONE})")
                case "uniqueItems":
                    if x:
                        e = f"e{next(self.names)}"
                        add(f"size(array_distinct(transform({p.items}, {e} -> to_json({e})))) < size({p.items})", keyword)
                case "contains":
                    e = f"e{next(self.names)}"
                    add(f"{p.items} IS NOT NULL AND NOT exists({p.items}, {e} -> {self.holds(_Place(e), x)})", keyword)
                case "allOf":
                    for sub in x:
                        own, more = self.node(p, sub, path)
                        checks += own
                        lists += more
                case "anyOf":
                    add(f"{p.there} AND NOT ({' OR '.join(self.holds(p, sub) for sub in x) or 'false'})", keyword)
                case "oneOf":
                    add(f"{p.there} AND {' + '.join(f'CAST({self.holds(p, sub)} AS INT)' for sub in x) or '0'} <> 1", keyword)
                case "not":
                    add(f"{p.there} AND {self.holds(p, x)}", keyword)
                case "if":
                    then, other = (self.array(p, schema.get(k, True), path) for k in ("then", "else"))
                    lists.append(f"CASE WHEN {self.holds(p, x)} THEN {then} ELSE {other} END")
                case "$ref":
                    if x in self.within:
                        raise ValueError(f"a reference to itself: {x}")
                    outer, self.within = self.within, (*self.within, x)
                    own, more = self.node(p, self.referred(x), path)
                    self.within = outer
                    checks += own
                    lists += more
                case _:
                    if keyword not in ANNOTATIONS:
                        raise ValueError(f"a keyword that isn't known: {keyword}")
        return checks, lists

    def referred(self, reference: str) -> Schema:
        if not reference.startswith("#/"):
            raise ValueError(f"a reference to elsewhere: {reference}")
        found: Any = self.root
        for part in reference[2:].split("/"):
            found = found[part]
        return found


class _Flat(_Compiler):
    """A compiler that takes named places out of the document, in two steps of columns: members' names and leaves; then kinds, numbers, texts, items."""

    def __init__(self, root: Schema):
        super().__init__(root)
        self.objects: set[tuple[str, ...]] = set()
        self.leaves: dict[str, Any] = {}
        self.fields: dict[tuple[str, ...], set[str]] = {}
        self.steps: list[dict[str, str]] = [{}, {}]
        self.fit = True
        self.array(_Named(self, ()), root, _Path())  # what is an object is known after this only

    def compiled(self) -> tuple[str, list[dict[str, str]]]:
        self.leaves, self.fields, self.steps, self.names = {}, {}, [{}, {}], count()
        found = self.array(_Named(self, ()), self.root, _Path())
        columns = [{name: sql for sql, name in step.items()} for step in self.steps]
        if self.leaves:
            columns[0]["_d"] = _get("_v", self.typed(self.leaves))
        return found, columns

    def column(self, step: int, sql: str) -> str:
        """The name of a column for a value, the same for the same SQL."""
        return self.steps[step].setdefault(sql, f"_c{step}_{len(self.steps[step])}")

    def leaf(self, names: tuple[str, ...]) -> str:
        now = self.leaves
        for k, n in enumerate(names):
            if n not in now:
                # Spark finds a struct's fields without regard to case.
                alike = "".join(x.upper()[:1].lower()[:1] for x in n)
                fields = self.fields.setdefault(names[:k], set())
                self.fit = self.fit and alike not in fields
                fields.add(alike)
            if k < len(names) - 1:
                now[n] = now.get(n) or {}
                now = now[n]
            else:
                now.setdefault(n, None)
        return "_d" + "".join(f".`{n}`" for n in names)

    def typed(self, leaves: Mapping[str, Any]) -> str:
        return f"struct<{', '.join(f'`{n}`: {"variant" if sub is None else self.typed(sub)}' for n, sub in leaves.items())}>"
