import json
import random
import re

import pytest
from pyspark.sql import functions as F

from wayfold.functions.schema import SchemaError, first_problem, schema_errors
from wayfold.plans.schema_queries import SCHEMA


def plain(schema, v, root):
    """Errors as (path, keyword) and the keys looked at, by the written rules of the standard."""
    errors, seen = [], set()
    if schema is True:
        return errors, seen
    if schema is False:
        return [((), "false")], seen
    number = isinstance(v, int | float) and not isinstance(v, bool)
    types = {"object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool), "null": v is None, "number": number, "integer": number and v == int(v)}
    same = lambda a, b: type(a) is bool and type(b) is bool and a == b or type(a) is not bool and type(b) is not bool and a == b and (a is None) == (b is None)
    tests = {
        "type": lambda x: any(types[t] for t in ([x] if isinstance(x, str) else x)), "enum": lambda x: any(same(v, y) for y in x), "const": lambda x: same(v, x),
        "pattern": lambda x: not isinstance(v, str) or re.search(x, v), "minLength": lambda x: not isinstance(v, str) or len(v) >= x, "maxLength": lambda x: not isinstance(v, str) or len(v) <= x,
        "minimum": lambda x: not number or v >= x, "maximum": lambda x: not number or v <= x, "exclusiveMinimum": lambda x: not number or v > x, "exclusiveMaximum": lambda x: not number or v < x,
        "minItems": lambda x: not isinstance(v, list) or len(v) >= x,
    }

    def take(found):
        errors.extend(found[0])
        if not found[0]:
            seen.update(found[1])

    for word, rule in schema.items():
        if word in tests and not tests[word](rule):
            errors.append(((), word))
        elif word == "required" and isinstance(v, dict):
            errors.extend(((), word) for n in rule if n not in v)
        elif word == "properties" and isinstance(v, dict):
            for n, s in rule.items():
                if n in v:
                    errors.extend(((n, *p), w) for p, w in plain(s, v[n], root)[0])
            seen.update(rule)
        elif word == "items" and isinstance(v, list):
            for i, x in enumerate(v):
                errors.extend(((str(i), *p), w) for p, w in plain(rule, x, root)[0])
        elif word == "$ref":
            take(plain(root["$defs"][rule.rsplit("/", 1)[1]], v, root))
        elif word == "allOf":
            for s in rule:
                take(plain(s, v, root))
        elif word in ("oneOf", "anyOf"):
            each = [plain(s, v, root) for s in rule]
            n = sum(not e for e, _ in each)
            if n == 0 or word == "oneOf" and n > 1:
                errors.append(((), word))
            for e, s in each:
                if not e:
                    seen.update(s)
        elif word == "not" and not plain(rule, v, root)[0]:
            errors.append(((), word))
        elif word == "if":
            test = plain(rule, v, root)
            if not test[0]:
                seen.update(test[1])
            take(plain(schema.get("else" if test[0] else "then", True), v, root))
        elif word == "additionalProperties" and isinstance(v, dict) and set(v) - set(schema.get("properties", {})):
            errors.append(((), word))
    if schema.get("unevaluatedProperties") is False and isinstance(v, dict) and set(v) - seen:
        errors.append(((), "unevaluatedProperties"))
    return errors, seen


SCHEMAS = [
    SCHEMA,
    {"type": ["object", "array", "null"], "items": {"anyOf": [{"type": "integer", "exclusiveMinimum": 0}, {"type": "string", "maxLength": 2}, False]}, "minItems": 1, "properties": {"a": {"not": {"type": "null"}}, "b": {"$ref": "#/$defs/b"}}, "additionalProperties": False, "$defs": {"b": {"enum": [1, "1", None, True, 2.5]}}},
    {"oneOf": [{"properties": {"a": {"const": 1}}, "required": ["a"]}, {"properties": {"b": {"type": "string"}}, "required": ["b"]}], "unevaluatedProperties": False},
    {"if": {"required": ["a"]}, "then": {"properties": {"a": True}}, "else": {"properties": {"b": True, "c": False}}, "unevaluatedProperties": False},
    True,
    False,
]


def value(rng, depth=0):
    pick = rng.randrange(9 if depth < 2 else 7)
    if pick == 7:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    if pick == 8 or depth == 0 and rng.random() < 0.7:
        return {k: value(rng, depth + 1) for k in rng.sample(["a", "b", "c", "id", "action", "lat", "note", "k", "props", "odd key/ä"], rng.randrange(5))}
    return [None, True, 1, -2, 2.5, 100.0, rng.choice(["", "e1", "click", "view", "1", "long text"])][pick]


@pytest.fixture(scope="module")
def values():
    rng = random.Random(5)
    out = [value(rng) for _ in range(300)]
    base = {"id": "e1", "action": "click", "props": {"k": 5}, "lat": 1}
    for _ in range(300):
        v = json.loads(json.dumps(base))
        for _ in range(rng.randrange(3)):
            k = rng.choice(["id", "action", "props", "lat", "note", "x"])
            v[k] = rng.choice([value(rng, 1), {"k": rng.choice([5, 70, 95, "s", None])}, "view", 91])
        if rng.random() < 0.3:
            v.pop(rng.choice(list(v)))
        out.append(v)
    return out


@pytest.mark.parametrize("k", range(len(SCHEMAS)))
def test_errors_equal_a_plain_validator(spark, values, k):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string").select("i", F.parse_json("j").alias("v"))
    got = {r.i: sorted((e.path, e.keyword) for e in r.e) for r in df.select("i", schema_errors(SCHEMAS[k], F.col("v")).alias("e")).collect()}
    root = SCHEMAS[k] if isinstance(SCHEMAS[k], dict) else {}
    want = {i: sorted(("/".join(p), w) for p, w in plain(SCHEMAS[k], v, root)[0]) for i, v in enumerate(values)}
    assert got == want
    assert SCHEMAS[k] is True or any(want.values())


def test_null_values_and_the_telling_error(spark):
    df = spark.sql("SELECT parse_json(j) AS v FROM VALUES ('{\"id\":\"e1\",\"action\":\"osm\",\"zzz\":1,\"props\":{\"k\":1}}'), (CAST(NULL AS STRING)) AS t(j)")
    got = [(r.p, r.e) for r in df.select(first_problem(schema_errors(SCHEMA, F.col("v")), " (log)").alias("p"), schema_errors(SCHEMA, F.col("v")).alias("e")).collect()]
    assert got[0][0] == 'action: "osm" is not one of ["click", "view", "purchase", "signup"] (log)' and len(got[0][1]) == 2
    assert got[1] == (None, None)


@pytest.mark.parametrize("schema", [{"dependentRequired": {}}, {"$ref": "#/$defs/none"}, {"$ref": "other.json"}, {"$ref": "#/$defs/a", "$defs": {"a": {"$ref": "#/$defs/a"}}}, {"enum": [[1]]}, {"unevaluatedProperties": {"type": "string"}}])
def test_schemas_that_cannot_be_compiled(spark, schema):
    with pytest.raises(SchemaError):
        schema_errors(schema, F.col("v"))


def test_schemas_nest_deeply(spark):
    deep, line = {"type": "string"}, "7"
    for _ in range(9):
        deep, line = {"properties": {"a": {"allOf": [deep]}}} if _ % 3 == 0 else {"properties": {"a": deep}}, f'{{"a":{line}}}'
    e = spark.createDataFrame([(line,)], "j string").select(schema_errors(deep, F.parse_json("j")).alias("e")).first().e
    assert [(x.path, x.keyword) for x in e] == [("/".join("a" * 9), "type")]


def test_a_schema_is_worked_out_once_for_a_value(spark):
    got = spark.range(1).select(schema_errors(SCHEMA, F.parse_json(F.lit("{}"))).alias("e"))._jdf.queryExecution().analyzed().toString()
    assert got.count("schema_of_variant") < 100
