"""Tag maps as Column expressions. An absent key and an empty value are both "not there"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CLASS_KEYS, DETAIL_KEYS
from .text import present, strip


def first_of(tags: Column, keys) -> Column:
    """The value of the first key that has one, else the empty string."""
    return F.coalesce(*[present(tags[k]) for k in keys], F.lit(""))


def name_of(tags: Column) -> Column:
    return first_of(tags, ("name", "name:de"))


def class_of(tags: Column) -> Column:
    return first_of(tags, CLASS_KEYS)


def decisive(tags: Column) -> Column:
    """``k=v`` of the class and detail keys that are there, in fixed order, joined by semicolons."""
    return F.concat_ws(";", *[F.when(tags[k].isNotNull(), F.concat(F.lit(f"{k}="), tags[k])) for k in (*CLASS_KEYS, *DETAIL_KEYS)])


def has_any(tags: Column, *keys: str) -> Column:
    return F.coalesce(F.greatest(*[F.coalesce(tags[k] != "", F.lit(False)) for k in keys]), F.lit(False))


def tag(tags: Column, key: str, *values: str) -> Column:
    """Whether a key is there, and has one of the values if any are given."""
    test = tags[key].isin(*values) if values else tags[key] != ""
    return F.coalesce(test, F.lit(False))


def on(t: Column, letters: str, *tests: Column) -> Column:
    """Whether an object is of one of the types and passes any of the tests."""
    return F.coalesce(t.isin(*letters), F.lit(False)) & (F.greatest(*tests, F.lit(False)) if tests else F.lit(True))


def parse_overrides(spec: Column) -> Column:
    """``k=v;k=`` as a map; of a repeated key the last counts. Null if a piece has no key or no equals sign."""
    pieces = F.filter(F.transform(F.split(F.coalesce(spec, F.lit("")), ";"), strip), lambda x: x != "")
    good = F.forall(pieces, lambda x: x.rlike("^[^=]*[^=\\s][^=]*="))
    pairs = F.transform(pieces, lambda x: F.struct(strip(F.substring_index(x, "=", 1)).alias("key"), strip(F.regexp_replace(x, "^[^=]*=", "")).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.when(good, F.map_from_entries(last))


def overlaid(tags: Column, changes: Column) -> Column:
    """Tags with changes put over them; an empty change deletes the key."""
    kept = F.map_filter(tags, lambda k, v: ~F.coalesce(F.map_contains_key(changes, k), F.lit(False)))
    return F.map_concat(kept, F.map_filter(changes, lambda k, v: v != ""))


def filled(names: Column) -> Column:
    """Trimmed entries that are not empty."""
    return F.map_filter(F.transform_values(names, lambda k, v: strip(v)), lambda k, v: v != "")
