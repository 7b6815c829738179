"""What a place's card shows: merged names, a headline and the other names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import present


def merged(entry: str, tile: str, tile_first: bool = False) -> Column:
    """A name of the list, else of the tile; the other way round for fields that tiles know better."""
    a, b = present(entry), present(tile)
    return F.coalesce(b, a) if tile_first else F.coalesce(a, b)


def generic_language(name: Column, de: Column, da: Column) -> Column:
    """The language of a generic name that equals the German or the Danish one."""
    return F.when(name == de, "de").when(name == da, "da")


def other_lines(headline: Column, lines: list[tuple[str, Column]]) -> Column:
    """Names besides the headline as array of struct(source, name): in order, without empty ones, the headline and repeats."""
    every = F.array(*[F.struct(F.lit(s).alias("source"), n.alias("name")) for s, n in lines])
    shown = F.filter(every, lambda x: x["name"].isNotNull() & (x["name"] != "") & ~x["name"].eqNullSafe(headline))
    names = F.transform(shown, lambda x: x["name"])
    return F.filter(shown, lambda x, i: F.array_position(names, x["name"]) == i + 1)


def is_provisional(key: Column) -> Column:
    return F.coalesce(key.rlike("^new:[0-9a-f]+$"), F.lit(False))


def matches_filter(fields: list[str], needle: str, kind: str | None = None, kind_col: str = "kind") -> Column:
    """Whether a row has the needle in any of its fields, in any case, and is of the kind if one is given."""
    text = F.lower(F.concat_ws(" ", *fields))
    hit = F.contains(text, F.lit(needle.lower()))
    return hit & (F.col(kind_col) == kind) if kind else hit
