"""A row for each keyword of JSON Schema."""

import json

import pytest

from granulon.operators import schema
from granulon.plans import recipes

OBJECT = {"properties": {"a": {"type": "integer"}, "b c": {"type": "string"}}}
REF = {"$defs": {"side": {"type": "integer", "minimum": 1}}, "properties": {"w": {"$ref": "#/$defs/side"}, "h": {"$ref": "#/$defs/side"}}}
IF = {"if": {"properties": {"k": {"const": True}}, "required": ["k"]}, "then": {"required": ["x"]}, "else": {"properties": {"x": False}}}

CASES = [
    ({"type": "integer"}, "1", []), ({"type": "integer"}, "1.0", []), ({"type": "integer"}, "1.5", ["$ type"]), ({"type": "integer"}, '"1"', ["$ type"]), ({"type": "integer"}, "true", ["$ type"]),
    ({"type": "number"}, "1e40", []), ({"type": "number"}, "null", ["$ type"]), ({"type": "string"}, '""', []), ({"type": "string"}, "{}", ["$ type"]), ({"type": "boolean"}, "false", []), ({"type": "boolean"}, "0", ["$ type"]),
    ({"type": "null"}, "null", []), ({"type": "array"}, "[]", []), ({"type": "object"}, "[]", ["$ type"]), ({"type": "object"}, "{}", []), ({"type": ["string", "null"]}, "null", []), ({"type": ["string", "null"]}, "1", ["$ type"]),
    ({"enum": ["a", 1, None, True]}, '"a"', []), ({"enum": ["a", 1, None, True]}, "1.0", []), ({"enum": ["a", 1, None]}, "null", []), ({"enum": ["a", 1]}, "true", ["$ enum"]), ({"enum": ["1"]}, "1", ["$ enum"]), ({"enum": ["a"]}, "null", ["$ enum"]),
    ({"const": 4}, "4", []), ({"const": 4}, '"4"', ["$ const"]), ({"const": 0.0}, "0", []), ({"const": False}, "0", ["$ const"]), ({"const": None}, "0", ["$ const"]),
    ({"minimum": 1}, "1", []), ({"minimum": 1}, "0.5", ["$ minimum"]), ({"minimum": 1}, '"0"', []), ({"maximum": 1}, "1.5", ["$ maximum"]), ({"exclusiveMinimum": 0}, "0", ["$ exclusiveMinimum"]), ({"exclusiveMinimum": 0}, "0.1", []),
    ({"exclusiveMaximum": 3}, "3", ["$ exclusiveMaximum"]), ({"multipleOf": 4}, "8", []), ({"multipleOf": 4}, "9", ["$ multipleOf"]), ({"minLength": 2}, '"é"', ["$ minLength"]), ({"maxLength": 1}, '"é"', []), ({"maxLength": 1}, '"ab"', ["$ maxLength"]),
    ({"pattern": "^a+$"}, '"aa"', []), ({"pattern": "b"}, '"aac"', ["$ pattern"]), ({"pattern": "b"}, "1", []),
    ({"required": ["a", "b"]}, '{"a": null}', ["$.b required"]), ({"required": ["a"]}, "[]", []), ({"dependentRequired": {"a": ["b"]}}, '{"a": 1}', ["$.b dependentRequired"]), ({"dependentRequired": {"a": ["b"]}}, '{"b": 1}', []),
    (OBJECT, '{"a": "x", "b c": 1, "d": 2}', ["$.a type", "$.b c type"]), (OBJECT, "[]", []), (OBJECT | {"additionalProperties": False}, '{"a": 1, "d": 2, "e.f": 3}', ["$.d additionalProperties", "$.e.f additionalProperties"]),
    (OBJECT | {"additionalProperties": {"type": "null"}}, '{"a": 1, "d": 2, "e": null}', ["$.d type"]), ({"additionalProperties": False}, "{}", []), ({"additionalProperties": False}, "3", []),
    ({"minProperties": 1}, "{}", ["$ minProperties"]), ({"maxProperties": 1}, '{"a": 1, "b": 2}', ["$ maxProperties"]),
    ({"items": {"type": "number"}}, '[1, "a", 2, null]', ["$[1] type", "$[3] type"]), ({"items": {"type": "number"}}, "{}", []), ({"items": {"items": {"minimum": 1}}}, "[[1, 0], [], [0]]", ["$[0][1] minimum", "$[2][0] minimum"]),
    ({"minItems": 3}, "[1, 2]", ["$ minItems"]), ({"maxItems": 1}, "[1, 2]", ["$ maxItems"]), ({"uniqueItems": True}, '[1, "1", [1], 1]', ["$ uniqueItems"]), ({"uniqueItems": True}, '[1, "1"]', []), ({"contains": {"const": 2}}, "[1]", ["$ contains"]), ({"contains": {"const": 2}}, "[2]", []),
    ({"allOf": [{"minimum": 2}, {"maximum": 0}]}, "1", ["$ maximum", "$ minimum"]), ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, "3", ["$ anyOf"]), ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, "7", []),
    ({"oneOf": [{"minimum": 2}, {"minimum": 5}]}, "7", ["$ oneOf"]), ({"oneOf": [{"minimum": 2}, {"minimum": 5}]}, "3", []), ({"not": {"type": "string"}}, '"a"', ["$ not"]), ({"not": {"type": "string"}}, "1", []),
    (IF, '{"k": true}', ["$.x required"]), (IF, '{"k": true, "x": 1}', []), (IF, '{"k": false, "x": 1}', ["$.x false"]), (IF, "{}", []),
    (REF, '{"w": 0, "h": "a"}', ["$.h type", "$.w minimum"]), (True, "1", []), (False, "1", ["$ false"]), ({"title": "x", "description": "y", "default": 1}, "{", ["$ json"]), ({"type": "object"}, "", ["$ json"]),
    ({"properties": {"p": {"type": "object", "required": ["q"], "properties": {"q": {"items": {"required": ["x"], "additionalProperties": False, "properties": {"x": {"minimum": 0}}}}}}}}, '{"p": {"q": [{"x": -1}, {"y": 1}]}}', ["$.p.q[0].x minimum", "$.p.q[1].x required", "$.p.q[1].y additionalProperties"]),
]


def test_keywords(spark):
    by = {}
    for k, (rules, text, _) in enumerate(CASES):
        by.setdefault(json.dumps(rules), []).append((k, text))
    got = {}
    for rules, rows in by.items():
        for r in spark.createDataFrame(rows, "k int, t string").select("k", schema.violations("t", json.loads(rules)).alias("v")).collect():
            got[r.k] = sorted(f"{x.path} {x.rule}" for x in r.v)
    wrong = [(c, got[k]) for k, c in enumerate(CASES) if got[k] != sorted(c[2])]
    assert not wrong


# What columns of named places might get wrong: places that aren't objects, deep ones, names of all kinds, a place that is looked at twice.
DEEP = {"type": "object", "properties": {"a": {"type": "object", "required": ["b"], "properties": {"b": {"type": "object", "additionalProperties": False, "properties": {"c": {"enum": [1, "x", None, True]}}}}}}}
MORE = [
    (DEEP, "[]", ["$ type"]), (DEEP, "null", ["$ type"]), (DEEP, "{}", []), (DEEP, '{"a": null}', ["$.a type"]), (DEEP, '{"a": "x"}', ["$.a type"]), (DEEP, '{"a": {}}', ["$.a.b required"]), (DEEP, '{"a": {"b": 1}}', ["$.a.b type"]),
    (DEEP, '{"a": {"b": {"c": false, "d": {}, "e": [1]}}}', ["$.a.b.c enum", "$.a.b.d additionalProperties", "$.a.b.e additionalProperties"]), (DEEP, '{"a": {"b": {"c": null}}}', []), (DEEP, '{"a": {"b": {"c": {}}}}', ["$.a.b.c enum"]), (DEEP, '{"a": {"b": {"c": "x"}}}', []),
    ({"properties": {"a.b": {"minimum": 1}, "A.B": {"minimum": 2}, "é ü": {"maxLength": 1}}}, '{"a.b": 0, "A.B": 1, "é ü": "xy"}', ["$.A.B minimum", "$.a.b minimum", "$.é ü maxLength"]),
    ({"properties": {"it's": {"properties": {"`": {"type": "null"}, "": {"type": "null"}}}}}, '{"it\'s": {"`": 1, "": 1}}', ["$.it's. type", "$.it's.` type"]),
    ({"properties": {"a": {"type": "object"}}, "allOf": [{"properties": {"a": {"required": ["x"], "enum": [1]}}}]}, '{"a": {}}', ["$.a enum", "$.a.x required"]),
    ({"properties": {"a": {"properties": {"x": False}, "not": {"type": "object"}, "oneOf": [{"required": ["y"]}, {"minimum": 0}, False]}}}, '{"a": {"x": 1}}', ["$.a not", "$.a.x false"]),
    ({"properties": {"a": {"anyOf": [{"required": ["y"]}, {"additionalProperties": False}]}}}, '{"a": {"x": 1}}', ["$.a anyOf"]), ({"properties": {"a": {"anyOf": [{"required": ["y"]}, {"additionalProperties": False}]}}}, '{"a": {}}', []),
]


def test_many_documents_have_the_violations_of_one(spark):
    by = {}
    for k, (rules, text, _) in enumerate([*CASES, *MORE]):
        by.setdefault(json.dumps(rules), []).append((k, text, "other"))
    got = {k: [] for k in range(len(CASES) + len(MORE))}
    for rules, rows in by.items():
        documents = spark.createDataFrame([*rows, (-1, None, "null")], "_v int, `a document` string, _x string")
        for r in schema.violated(documents, "a document", json.loads(rules)).collect():
            assert r._x == "other"
            got[r._v].append(f"{r.path} {r.rule}")
    wrong = [(c, got[k]) for k, c in enumerate([*CASES, *MORE]) if sorted(got[k]) != sorted(c[2])]
    assert not wrong


def test_checks_of_many_documents_are_not_interpreted(spark, sf_dir):
    plan = recipes.recipe_schema_check(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1
    # Spark interprets what is in an explode, if a function over an array is anywhere in it: no check may be.
    assert not [line for line in plan.splitlines() if "Generate" in line and ("parseJson" in line or "CASE WHEN" in line)]


def test_a_null_document_violates_nothing(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(schema.violations("t", {"type": "object"}).alias("v")).first().v == []


@pytest.mark.parametrize("rules", [{"propertyNames": {}}, {"properties": {"a": {"unevaluatedItems": False}}}, {"$ref": "other.json"}, {"$ref": "#"}, {"const": {"a": 1}}, {"$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}, "$ref": "#/$defs/a"}])
def test_rules_that_are_not_known_are_an_error(spark, rules):
    with pytest.raises(ValueError):
        schema.violations("t", rules)
