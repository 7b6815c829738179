"""JSON Schema as Column expressions: what breaks a schema in a VARIANT value, all errors with their paths."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ERRORS = "array<struct<path:string,keyword:string,message:string>>"
#: Keywords that say nothing about a value.
SILENT = {"$schema", "$id", "$comment", "$defs", "title", "description", "default", "examples", "deprecated", "then", "else"}
#: Refs within refs; a schema that refers to itself goes deeper than any value is followed here.
DEPTH = 12


class SchemaError(ValueError):
    """A schema that cannot be compiled."""


RESULT = f"struct<errors:{ERRORS},seen:array<string>>"


def _none() -> Column:
    return F.array().cast(ERRORS)


#: Schemas within schemas up to which values are bound; the analyzer bounds how deep lambdas nest, so deeper ones repeat expressions.
BOUND = 4


def _let(value, body: Callable, inline: bool = False):
    """What ``body`` makes of a value that is worked out once, however often the body names it; or of its expression."""
    return body(value) if inline else F.get(F.transform(F.array(value), body), F.lit(0))


def _kind(v: Column, inline: bool) -> Column:
    """The JSON type of a variant: object, array, string, integer, number, boolean or null; null for no value.

    A number without a fraction is an integer, however it is written.
    """

    def of(said: Column) -> Column:
        whole = F.when(said.startswith("BIGINT"), "integer").when(said.startswith("DECIMAL") | said.startswith("DOUBLE") | said.startswith("FLOAT"), F.when(F.try_variant_get(v, "$", "double") % 1 == 0, "integer").otherwise("number"))
        for start, kind in (("OBJECT", "object"), ("ARRAY", "array"), ("STRING", "string"), ("BOOLEAN", "boolean"), ("VOID", "null")):
            whole = F.when(said.startswith(start), kind).otherwise(whole)
        return whole

    return _let(F.schema_of_variant(v), of, inline)


def _ok(result) -> Column:
    return F.size(result["errors"]) == 0


def _seen_if(when: Column, result) -> Column:
    return F.when(when, result["seen"]).otherwise(_names([]))


#: Words that ask what the others have looked at.
LATE = ("additionalProperties", "unevaluatedProperties")


def _result(root: dict, schema: Any, value: Column, path: Column, depth: int = 0):
    """What a schema says of a value: errors and seen, the keys it has looked at, as a struct, or as a dict of expressions below BOUND."""
    if depth > DEPTH:
        raise SchemaError(f"references are nested more than {DEPTH} deep")

    inline = depth >= BOUND

    def body(facts):
        one = _Schema(root, facts, path, depth)
        one.read(schema, False)

        def finish(parts):
            each = lambda k: F.concat(*[p[k] for p in parts]) if inline else F.flatten(F.transform(parts, lambda p: p[k]))
            one.parts, one.looked = [], each("seen")
            one.read(schema, True)
            return one.result(F.concat(each("errors"), *[p["errors"] for p in one.parts]), one.looked)

        parts = [one.part(_none()), *one.parts]
        return _let(parts if inline else F.array(*parts), finish, inline)

    facts = {"value": value, "kind": _kind(value, inline), "members": F.try_variant_get(value, "$", "map<string,variant>")}
    return _let(facts if inline else F.struct(*[c.alias(k) for k, c in facts.items()]), body, inline)


class _Schema:
    """What the words of one schema say of one value, part by part."""

    def __init__(self, root: dict, facts, path: Column, depth: int):
        self.root, self.path, self.depth, self.inline = root, path, depth, depth >= BOUND
        self.value, self.kind, self.members = facts["value"], facts["kind"], facts["members"]
        self.keys = F.map_keys(self.members)
        self.parts: list = []
        self.looked = _names([])

    def result(self, errors: Column, seen: Column):
        return {"errors": errors, "seen": seen} if self.inline else F.struct(errors.alias("errors"), seen.alias("seen"))

    def part(self, errors: Column, seen: Column | None = None):
        got = self.result(errors, _names([]) if seen is None else seen)
        return got if self.inline else got.cast(RESULT)

    def read(self, schema: Any, late: bool) -> None:
        if schema is True:
            schema = {}
        if schema is False:
            if not late:
                self.fail(F.lit(True), "false", "no value is allowed here")
            schema = {}
        for word in schema:
            if word in SILENT or (word in LATE) != late:
                continue
            rule = getattr(self, "_" + word.replace("$", "").lower(), None)
            if rule is None:
                raise SchemaError(f"unknown keyword {word}")
            rule(schema[word], schema)

    def fail(self, when: Column, word: str, message: Column | str, path: Column | None = None) -> None:
        text = message if isinstance(message, Column) else F.lit(message)
        one = F.array(F.struct((self.path if path is None else path).alias("path"), F.lit(word).alias("keyword"), text.alias("message")))
        self.parts.append(self.part(F.when(F.coalesce(when, F.lit(False)), one).otherwise(_none())))

    def under(self, schema: Any, value: Column | None = None, path: Column | None = None):
        got = _result(self.root, schema, self.value if value is None else value, self.path if path is None else path, self.depth + 1)
        return self.part(**got) if isinstance(got, dict) else got.cast(RESULT)

    def take(self, schema: Any) -> None:
        """Another schema of the same value holds; what it looked at counts only if it found no error."""
        self.parts.append(_let(self.under(schema), lambda r: self.part(r["errors"], _seen_if(_ok(r), r)), self.inline))

    def shown(self) -> Column:
        return F.to_json(self.value)

    def child(self, name: Column | str) -> Column:
        text = F.lit(name) if isinstance(name, str) else name
        return F.concat(self.path, F.when(self.path == "", "").otherwise("/"), text)

    def _ref(self, ref: str, _: dict) -> None:
        if not ref.startswith("#"):
            raise SchemaError(f"{ref} is outside the schema")
        found: Any = self.root
        for step in filter(None, ref[1:].split("/")):
            try:
                found = found[step.replace("~1", "/").replace("~0", "~")]
            except (KeyError, TypeError) as e:
                raise SchemaError(f"{ref} is not there") from e
        self.take(found)

    def _type(self, types: str | list[str], _: dict) -> None:
        types = [types] if isinstance(types, str) else types
        good = self.kind.isin(*types, *(["integer"] if "number" in types else []))
        self.fail(~good, "type", F.concat(self.shown(), F.lit(f" is not of type {', '.join(map(repr, types))}")))

    def _equal(self, x: Any) -> Column:
        if isinstance(x, bool):
            return (self.kind == "boolean") & (F.try_variant_get(self.value, "$", "boolean") == x)
        if isinstance(x, int | float):
            return self.kind.isin("integer", "number") & (F.try_variant_get(self.value, "$", "double") == float(x))
        if isinstance(x, str):
            return (self.kind == "string") & (F.try_variant_get(self.value, "$", "string") == x)
        if x is None:
            return self.kind == "null"
        raise SchemaError(f"only plain values can be compared, not {json.dumps(x)}")

    def _enum(self, values: list, _: dict) -> None:
        good = F.lit(False)
        for x in values:
            good |= self._equal(x)
        self.fail(~good, "enum", F.concat(self.shown(), F.lit(f" is not one of {json.dumps(values)}")))

    def _const(self, value: Any, _: dict) -> None:
        self.fail(~self._equal(value), "const", F.concat(F.lit(json.dumps(value)), F.lit(" was expected")))

    def _text(self) -> Column:
        return F.try_variant_get(self.value, "$", "string")

    def _pattern(self, pattern: str, _: dict) -> None:
        self.fail((self.kind == "string") & ~self._text().rlike(pattern), "pattern", F.concat(self.shown(), F.lit(f" does not match {pattern!r}")))

    def _minlength(self, n: int, _: dict) -> None:
        self.fail((self.kind == "string") & (F.length(self._text()) < n), "minLength", F.concat(self.shown(), F.lit(" is too short")))

    def _maxlength(self, n: int, _: dict) -> None:
        self.fail((self.kind == "string") & (F.length(self._text()) > n), "maxLength", F.concat(self.shown(), F.lit(" is too long")))

    def _bound(self, word: str, bad, says: str, n: float) -> None:
        number = F.try_variant_get(self.value, "$", "double")
        self.fail(self.kind.isin("integer", "number") & bad(number), word, F.concat(self.shown(), F.lit(f" is {says} {n}")))

    def _minimum(self, n: float, _: dict) -> None:
        self._bound("minimum", lambda x: x < n, "less than the minimum of", n)

    def _maximum(self, n: float, _: dict) -> None:
        self._bound("maximum", lambda x: x > n, "greater than the maximum of", n)

    def _exclusiveminimum(self, n: float, _: dict) -> None:
        self._bound("exclusiveMinimum", lambda x: x <= n, "less than or equal to the minimum of", n)

    def _exclusivemaximum(self, n: float, _: dict) -> None:
        self._bound("exclusiveMaximum", lambda x: x >= n, "greater than or equal to the maximum of", n)

    def _required(self, names: list[str], _: dict) -> None:
        for name in names:
            self.fail((self.kind == "object") & ~F.array_contains(self.keys, name), "required", f"{name!r} is a required property")

    def _properties(self, each: dict, _: dict) -> None:
        for name, schema in each.items():
            there = (self.kind == "object") & F.array_contains(self.keys, name)
            self.parts.append(self.part(F.when(there, self.under(schema, self.members[name], self.child(name))["errors"]).otherwise(_none())))
        self.parts.append(self.part(_none(), _names(list(each))))

    def _items(self, schema: Any, _: dict) -> None:
        elements = F.try_variant_get(self.value, "$", "array<variant>")
        each = F.transform(elements, lambda v, i: self.under(schema, v, self.child(i.cast("string")))["errors"])
        self.parts.append(self.part(F.when(self.kind == "array", F.flatten(each)).otherwise(_none())))

    def _minitems(self, n: int, _: dict) -> None:
        self.fail((self.kind == "array") & (F.size(F.try_variant_get(self.value, "$", "array<variant>")) < n), "minItems", F.concat(self.shown(), F.lit(" is too short")))

    def _allof(self, schemas: list, _: dict) -> None:
        for s in schemas:
            self.take(s)

    def _choice(self, word: str, schemas: list, good, says: str) -> None:
        def chosen(each):
            if self.inline:
                passed, seen = sum((F.when(_ok(r), 1).otherwise(0) for r in each), F.lit(0)), F.concat(*[_seen_if(_ok(r), r) for r in each])
            else:
                passed, seen = F.size(F.filter(each, _ok)), F.flatten(F.transform(F.filter(each, _ok), lambda r: r["seen"]))
            one = F.array(F.struct(self.path.alias("path"), F.lit(word).alias("keyword"), F.concat(self.shown(), F.lit(f" is valid under {says} of the given schemas")).alias("message")))
            return self.part(F.when(good(passed), _none()).otherwise(one), seen)

        each = [self.under(s) for s in schemas]
        self.parts.append(_let(each if self.inline else F.array(*each), chosen, self.inline))

    def _oneof(self, schemas: list, _: dict) -> None:
        self._choice("oneOf", schemas, lambda n: n == 1, "none or several")

    def _anyof(self, schemas: list, _: dict) -> None:
        self._choice("anyOf", schemas, lambda n: n >= 1, "none")

    def _not(self, schema: Any, _: dict) -> None:
        self.fail(_ok(self.under(schema)), "not", F.concat(self.shown(), F.lit(" should not be valid under the given schema")))

    def _if(self, schema: Any, whole: dict) -> None:
        def judged(test):
            of = {w: self.under(whole[w]) if w in whole else self.part(_none()) for w in ("then", "else")}
            pick = lambda k: F.when(_ok(test), of["then"][k]).otherwise(of["else"][k])
            held = self.part(pick("errors"), pick("seen")) if self.inline else F.when(_ok(test), of["then"]).otherwise(of["else"])
            return _let(held, lambda r: self.part(r["errors"], F.concat(_seen_if(_ok(test), test), _seen_if(_ok(r), r))), self.inline)

        self.parts.append(_let(self.under(schema), judged, self.inline))

    def _beyond(self, word: str, allowed: Any, known: list[Column]) -> None:
        if allowed is True:
            return
        if allowed is not False:
            raise SchemaError(f"{word} can only be true or false")
        other = self.keys
        for names in known:
            other = F.array_except(other, names)
        other = F.array_sort(other)
        self.fail((self.kind == "object") & (F.size(other) > 0), word, F.concat(F.array_join(F.transform(other, lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", "), F.lit(" unexpected")))

    def _additionalproperties(self, allowed: Any, whole: dict) -> None:
        self._beyond("additionalProperties", allowed, [_names(list(whole.get("properties", {})))])

    def _unevaluatedproperties(self, allowed: Any, _: dict) -> None:
        self._beyond("unevaluatedProperties", allowed, [self.looked])


def _names(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def schema_errors(schema: dict | bool, value: Column) -> Column:
    """All errors of a VARIANT value as an array of struct(path, keyword, message); empty for a valid one, null for no value.

    Of a schema are known: type, enum, const, pattern, lengths, bounds, required, properties,
    items, additional- and unevaluatedProperties, allOf, anyOf, oneOf, not, if, then, else and
    $ref within the schema. Any other word that would constrain a value is a SchemaError, as is
    a schema that refers to itself. The path is of keys and indexes joined by slashes, empty for
    the value itself. Patterns are regular expressions of Java.
    """
    root = schema if isinstance(schema, dict) else {}
    return F.when(value.isNotNull(), _result(root, schema, value, F.lit(""))["errors"])


def first_problem(errors: Column, label: str = "") -> Column:
    """The most telling error as ``path: message``, null without any: keys that nothing has looked at come last, else by path and message."""
    ordered = F.transform(errors, lambda e: F.struct((e["keyword"] == "unevaluatedProperties").alias("vague"), e["path"].alias("path"), e["message"].alias("message")))
    first = F.array_min(ordered)
    return F.when(F.size(errors) > 0, F.concat(F.when(first["path"] == "", "").otherwise(F.concat(first["path"], F.lit(": "))), first["message"], F.lit(label)))
