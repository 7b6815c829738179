"""Kinds of places: what objects a kind accepts, which of them is the feature, and which suits best to carry its name.

A kind is data: tests as (types, key, values). A test passes for an object of one of the
types that has the key, with one of the values if any are given.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ISLANDS, SETTLEMENTS, WARFT_PLACES
from ..functions import tags

Test = tuple[str, str, tuple[str, ...]]


def test(types: str, key: str, *values: str) -> Test:
    return types, key, values


def passes(obj: Column, tests: tuple[Test, ...]) -> Column:
    """Whether an object (struct t, tags) passes any of the tests; a test without a key asks for the type alone."""
    each = [tags.on(obj["t"], t, *([tags.tag(obj["tags"], k, *v)] if k else [])) for t, k, v in tests]
    return F.greatest(*each, F.lit(False)) if each else F.lit(False)


def _passing(tests: tuple[Test, ...]):
    return lambda obj: passes(obj, tests)


# For each group of kinds which object fits how well.
_ISLAND = (test("nwr", "place", *ISLANDS), test("nwr", "natural", *ISLANDS, "peninsula"))
_ISLAND_AREA = (test("wr", "place", *ISLANDS), test("wr", "natural", *ISLANDS, "peninsula"))
FITS: dict[str, tuple[tuple[tuple[tuple[Test, ...], int], ...], int]] = {
    "place": ((((test("n", "place"),), 30), ((test("r", "boundary", "administrative"),), 12), ((test("w", "place"),), 8)), 2),
    "outline": (((_ISLAND_AREA, 30), ((test("n", "place"),), 18)), 4),
    "water": ((((test("wr", "natural"), test("wr", "water"), test("wr", "place", "sea")), 25), ((test("nwr", "waterway"),), 20)), 6),
    "landscape": ((((test("r", "boundary"), test("r", "place")), 25), ((test("n", "place"), test("n", "natural")), 22)), 6),
    "road": ((((test("w", ""),), 20),), 4),
    "node": ((((test("n", ""),), 10),), 6),
}


@dataclass(frozen=True)
class Kind:
    """accepted: any of these makes an object a candidate, and so do administrative levels;
    canonic: tests that narrow candidates, the likeliest first; fit: key of FITS;
    whole: tests of an object that is a whole feature though it is no candidate by its tags;
    boundary: what a bare administrative boundary is: feature, yields, or yields to node;
    home_only: a match outside the home region is wrong; by_item: found by its item, not as
    an object; point_place: class of a point made for it; area: it can be a square."""

    name: str
    accepted: tuple[Test, ...]
    levels: tuple[int, ...] = ()
    canonic: tuple[tuple[Test, ...], ...] = ()
    fit: str = "node"
    whole: tuple[Test, ...] = ()
    boundary: str = "feature"
    home_only: bool = False
    by_item: bool = False
    point_place: str | None = None
    area: bool = False

    def accepts(self, obj: Column) -> Column:
        admin = tags.tag(obj["tags"], "boundary", "administrative") & tags.tag(obj["tags"], "admin_level", *map(str, self.levels)) if self.levels else F.lit(False)
        return passes(obj, self.accepted) | admin

    def covers(self, obj: Column) -> Column:
        """Whether an object can be a feature of the kind, or a part of one."""
        return self.accepts(obj) | passes(obj, self.whole)

    def bonus(self, obj: Column) -> Column:
        """Points of the first test of the fit that the object passes."""
        cases, otherwise = FITS[self.fit]
        out = F.lit(otherwise)
        for tests, points in reversed(cases):
            out = F.when(passes(obj, tests), F.lit(points)).otherwise(out)
        return out

    def canonical(self, members: Column) -> Column:
        """An array of objects narrowed by the first test that leaves any."""
        out = members
        for tests in reversed(self.canonic):
            left = F.filter(members, _passing(tests))
            out = F.when(F.size(left) > 0, left).otherwise(out)
        return out

    def absorb(self, members: Column) -> Column:
        """An array of objects without bare administrative boundaries, where the kind says so; never empty for that reason."""
        if self.boundary == "feature":
            return members
        kept = F.filter(members, lambda m: ~bare_boundary(m["tags"]))
        done = F.when(F.size(kept) > 0, kept).otherwise(members)
        if self.boundary == "yields":
            return done
        return F.when(F.exists(members, lambda m: tags.on(m["t"], "n", tags.tag(m["tags"], "place"))), done).otherwise(members)


def bare_boundary(tag_map: Column) -> Column:
    """An administrative boundary without a place of its own."""
    return tags.tag(tag_map, "boundary", "administrative") & ~tags.tag(tag_map, "place")


_place = ((test("nwr", "place"),),)
_outline = (_ISLAND_AREA,)
_river = test("r", "type", "waterway")
_settled = test("nwr", "place", *SETTLEMENTS)
# Kinds in the order in which they are worked through.
KINDS = (
    Kind("settlement", (_settled,), tuple(range(6, 12)), _place, "place", boundary="yields", point_place="hamlet"),
    Kind("island", _ISLAND, tuple(range(8, 12)), _outline, "outline", boundary="yields", point_place="island", area=True),
    Kind("hallig", (*_ISLAND, _settled), tuple(range(8, 12)), _outline, "outline", boundary="yields", home_only=True, point_place="island", area=True),
    Kind("helgoland", tuple(test("nwr", k) for k in ("place", "natural", "man_made", "historic", "water", "waterway")), boundary="yields"),
    Kind("sand", (test("nwr", "natural", "sand", "shoal", "beach", "mud", "reef", "wetland"), test("nwr", "place", *ISLANDS, "locality")), (), _outline, "outline", boundary="yields", home_only=True, area=True),
    Kind("landscape", (test("nwr", "place", "region", "county", "state", "district", "province", "island", "archipelago"), test("nwr", "natural", "peninsula", "ridge", "hill", "archipelago"), test("nwr", "boundary", "administrative", "historic", "political")), (), (), "landscape", boundary="yields to node", area=True),
    Kind("water", (test("nwr", "natural", "water", "bay", "strait", "wetland", "spring", "sand"), test("nwr", "water"), test("nwr", "waterway"), test("nwr", "place", "sea"), test("nwr", "boundary", "maritime", "place")), (), ((_river, test("nwr", "place", "sea")), (test("wr", "natural", "water"), test("wr", "water"))), "water", whole=(_river,)),
    Kind("harde", (test("nwr", "boundary", "historic", "political", "administrative"), test("nwr", "place", "region")), home_only=True, area=True),
    Kind("road", (test("nwr", "highway"),), fit="road"),
    Kind("country", (), (2,), by_item=True),
    Kind("koog", (test("nwr", "place", *SETTLEMENTS, "polder"), test("nwr", "boundary", "administrative", "protected_area"), test("nwr", "landuse"), test("nwr", "natural", "water", "wetland")), (), _place, "place", boundary="yields", home_only=True, area=True),
    Kind("warft", (test("nwr", "place", *WARFT_PLACES), test("nwr", "landuse", "residential", "farmyard", "meadow"), test("nwr", "man_made"), test("nwr", "historic")), (), _place, "place", boundary="yields", home_only=True, point_place="hamlet"),
    Kind("not_a_place", (test("nwr", ""),)),
)
BY_NAME = {k.name: k for k in KINDS}


def by_kind(kind: Column, value, otherwise=None) -> Column:
    """What ``value`` gives for the kind that a column names; ``otherwise`` for an unknown one."""
    out = F.lit(otherwise)
    for k in reversed(KINDS):
        found = value(k)
        out = F.when(kind == k.name, found if isinstance(found, Column) else F.lit(found)).otherwise(out)
    return out


def kind_order(kind: Column) -> Column:
    """The place of a kind in the order of work; unknown kinds last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k.name) for k in KINDS]), kind), F.lit(0)), F.lit(len(KINDS) + 1))


#: Every test of any kind, each once; the place of a test is its bit in ``marks``.
TESTS = tuple(dict.fromkeys(t for k in KINDS for group in (k.accepted, k.whole, *k.canonic, *[tests for tests, _ in FITS[k.fit][0]]) for t in group))


def _mask(tests: tuple[Test, ...]) -> Column:
    return F.lit(sum(1 << TESTS.index(t) for t in tests)).cast("long")


def marks(obj: Column) -> Column:
    """Which of TESTS an object (struct t, tags) passes, as bits of a long.

    The tests are a constant array that a fold goes through, so an object is tested once for
    all kinds, and the expression stays small whatever the number of kinds.
    """
    every = F.array(*[F.struct(_mask((t,)).alias("bit"), F.lit(t[0]).alias("types"), F.lit(t[1]).alias("key"), F.array(*[F.lit(v) for v in t[2]]).cast("array<string>").alias("values")) for t in TESTS])

    def passed(t: Column) -> Column:
        value = F.coalesce(obj["tags"][t["key"]], F.lit(""))
        return F.contains(t["types"], obj["t"]) & ((t["key"] == "") | ((value != "") & ((F.size(t["values"]) == 0) | F.array_contains(t["values"], value))))

    return F.aggregate(F.filter(every, passed), F.lit(0).cast("long"), lambda s, t: s.bitwiseOR(t["bit"]))


def rule_of(kind: Column) -> Column:
    """What the kind that a column names says, as masks of ``marks``; null for an unknown one."""
    cell = lambda k: F.struct(
        _mask(k.accepted).alias("accepted"), _mask((*k.accepted, *k.whole)).alias("covers"), F.array(*[F.lit(str(x)) for x in k.levels]).cast("array<string>").alias("levels"),
        *[(_mask(k.canonic[i]) if len(k.canonic) > i else F.lit(0).cast("long")).alias(f"canon{i}") for i in (0, 1)],
        F.array(*[F.struct(_mask(tests).alias("mask"), F.lit(points).alias("points")) for tests, points in FITS[k.fit][0]]).alias("fit"), F.lit(FITS[k.fit][1]).alias("other"),
        F.lit(k.boundary).alias("boundary"), F.lit(k.home_only).alias("home_only"), F.lit(k.by_item).alias("by_item"),
    )
    return F.create_map(*[x for k in KINDS for x in (F.lit(k.name), cell(k))])[kind]


def has(bits: Column, mask: Column) -> Column:
    return F.coalesce(bits.bitwiseAND(mask) != 0, F.lit(False))


def at_level(tag_map: Column, levels: Column) -> Column:
    """An administrative boundary of one of the levels."""
    return tags.tag(tag_map, "boundary", "administrative") & F.coalesce(F.array_contains(levels, F.coalesce(tag_map["admin_level"], F.lit(""))), F.lit(False))


def points(bits: Column, rule: Column) -> Column:
    """Points of the first case of a rule's fit that the bits meet; 0 for an unknown kind."""
    first = F.get(F.filter(rule["fit"], lambda c: bits.bitwiseAND(c["mask"]) != 0), F.lit(0))["points"]
    return F.coalesce(first, rule["other"], F.lit(0))
