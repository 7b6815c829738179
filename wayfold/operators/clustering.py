"""Greedy grouping of objects that describe one feature."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CLUSTER_KM, CORE_KM, EARTH_KM
from ..functions.geo import is_core, linear_km

#: The least cell, in kilometres: 2e-6 of the Earth's radius a side.
CELL_KM = 0.025
#: From the number of a cell to those of the cells that its places' reach meets.
STEPS = [(a << 42) + (b << 21) + c for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3)]


class Reaches:
    """Places, and for each the least group of those within its reach (``geo.reach_of``) that were added to a group.

    Places are of few classes (core, length). For each class and each reach that counts for it,
    its places lie in cells so small that all of a cell are within the reach of each other.
    So a cell that has a place's least group needs no look at its members, and only cells
    next to it with a lesser group do. Distances are compared as chords, and only those next
    to the reach as great circles. Unknown positions and lengths are nan; a place without a
    position is near none.
    """

    def __init__(self, lon: np.ndarray, lat: np.ndarray, core: np.ndarray, linear: np.ndarray):
        self.p, self.q = np.radians(lat), np.radians(lon)
        self.at = np.stack([np.cos(self.p) * np.cos(self.q), np.cos(self.p) * np.sin(self.q), np.sin(self.p)], axis=1)
        self.known = ~np.isnan(self.at).any(axis=1)
        far = np.where(np.isnan(linear), CLUSTER_KM, linear)
        kinds, of = np.unique(np.stack([core.astype(np.float64), far], axis=1), axis=0, return_inverse=True)
        self.of = of.ravel().tolist()
        reach = lambda a, b: float(CORE_KM if a[0] and b[0] else max(a[1], b[1]))
        self.reach = [[reach(a, b) for b in kinds] for a in kinds]
        self.number, self.place = [0] * len(lon), self.at.tolist()
        #: For each reach the cell of each place, and all cells.
        self.cells = {km: self._cells(km) for km in {km for row in self.reach for km in row}}
        self.there = {km: set(cells) for km, cells in self.cells.items()}
        self.around: dict[tuple[float, int], list[int]] = {}
        #: For each class and reach: what a cell has of the class, group by group, and the least of these.
        self.held = [{km: ({}, {}) for km in set(row)} for row in self.reach]
        self.asked = [[(km, *self.held[b][km]) for b, km in enumerate(row)] for row in self.reach]

    def _cells(self, km: float) -> list[int]:
        """A number for the cell of each place; cells are at least 2e-6 of the Earth's radius a side, so that 2 ** 21 numbers do."""
        side = max(2 * np.sin(min(km, np.pi * EARTH_KM) / (2 * EARTH_KM)) * (1 - 1e-6) / np.sqrt(3), 2e-6)
        x, y, z = np.floor(np.where(np.isnan(self.at), 0, self.at) / side).astype(np.int64).T + (1 << 20)
        return ((x << 42) + (y << 21) + z).tolist()

    def add(self, i: int, group: int) -> None:
        if self.known[i]:
            self.number[i] = group
            for km, (members, least) in self.held[self.of[i]].items():
                cell = self.cells[km][i]
                members.setdefault(cell, {}).setdefault(group, []).append(i)
                least[cell] = min(group, least.get(cell, group))

    def least(self, i: int) -> float:
        """The least group with a place within the reach of this one, or infinity."""
        best, asked = float("inf"), self.asked[self.of[i]]
        if not self.known[i]:
            return best
        # A cell is all within the reach, unless that is less than the least cell.
        for km, _, least in asked:
            if km > CELL_KM:
                best = min(best, least.get(self.cells[km][i], best))
        for km, members, least in asked:
            if best == 0:
                break
            others = []
            for cell in self._around(km, self.cells[km][i]):
                if least.get(cell, best) < best:
                    for group, held in members[cell].items():
                        if group < best:
                            others += held
            best = self._least_near(i, others, km, best)
        return best

    def _around(self, km: float, cell: int) -> list[int]:
        """A cell and those next to it that have any places."""
        if (km, cell) not in self.around:
            self.around[km, cell] = [cell + step for step in STEPS if cell + step in self.there[km]]
        return self.around[km, cell]

    def _least_near(self, i: int, others: list[int], km: float, best: float) -> float:
        limit = 4 * math.sin(km / (2 * EARTH_KM)) ** 2
        close, most = limit * (1 - 1e-9), limit * (1 + 1e-9)
        if len(others) > 48:
            d = ((self.at[others] - self.at[i]) ** 2).sum(axis=1)
            others = [others[k] for k in np.flatnonzero(d <= most)]
        x, y, z = self.place[i]
        for j in others:
            if self.number[j] < best:
                a, b, c = self.place[j]
                d = (a - x) * (a - x) + (b - y) * (b - y) + (c - z) * (c - z)
                if d < close or (d <= most and self._km(i, j) <= km):
                    best = self.number[j]
        return best

    def _km(self, i: int, j: int) -> float:
        a = np.sin((self.p[j] - self.p[i]) / 2) ** 2 + np.cos(self.p[i]) * np.cos(self.p[j]) * np.sin((self.q[j] - self.q[i]) / 2) ** 2
        return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(a, 1)))


def first_fit(lon: np.ndarray, lat: np.ndarray, core: np.ndarray, linear: np.ndarray) -> np.ndarray:
    """The number of each place's group: each joins the first group with any member within their reach (``Reaches``).

    Groups are never merged, so the order counts. A place without a position is a group of its own.
    """
    places, numbers, groups = Reaches(lon, lat, core, linear), np.zeros(len(lon), dtype=np.int32), 0
    for i in range(len(lon)):
        found = places.least(i)
        if found == float("inf"):
            found, groups = groups, groups + 1
        numbers[i] = found
        places.add(i, found)
    return numbers


def any_near(mine: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """For each of ``mine`` whether any of ``others`` (both lon, lat, core, linear) is within their reach."""
    places, n = Reaches(*[np.concatenate(x) for x in zip(others, mine, strict=True)]), len(others[0])
    for i in range(n):
        places.add(i, 0)
    return np.array([places.least(n + i) == 0 for i in range(len(mine[0]))], dtype=bool)


_floats = lambda x: np.asarray(x, dtype=np.float64)
_typed = lambda a, b, c, d: [_floats(a), _floats(b), np.asarray(c, dtype=bool), _floats(d)]


def group_numbers(lon: pd.Series, lat: pd.Series, core: pd.Series, linear: pd.Series) -> pd.Series:
    return pd.Series([first_fit(*_typed(*x)) for x in zip(lon, lat, core, linear, strict=True)])


def near_flags(*fields: pd.Series) -> pd.Series:
    return pd.Series([any_near(_typed(*x[:4]), _typed(*x[4:])) for x in zip(*fields, strict=True)])


def _asked(members: str, core, linear) -> list[Column]:
    """What ``geo.reach_of`` asks of each member: arrays of lon, lat, core and linear."""
    of = lambda f: F.transform(members, f)
    return [of(lambda m: m["lon"].cast("double")), of(lambda m: m["lat"].cast("double")), of(lambda m: F.coalesce(core(m), F.lit(False))), of(lambda m: linear(m).cast("double"))]


def near(mine: str, others: str, core, linear) -> Column:
    """Those of the array ``mine`` that have any of the array ``others`` within their reach."""
    flags = F.pandas_udf(near_flags, "array<boolean>")(*_asked(mine, core, linear), *_asked(others, core, linear))
    return F.transform(F.filter(F.arrays_zip(F.col(mine).alias("m"), flags.alias("near")), lambda x: x["near"]), lambda x: x["m"])


def greedy(packed: DataFrame, by: list[str], members: str, core, linear) -> DataFrame:
    """Rows (by..., cluster, members): the array ``members`` of each row grouped greedily, in order; ``core`` and ``linear`` tell of a member what ``geo.reach_of`` asks.

    The members of a row are held by one task, as each looks at all before it.
    """
    numbers = F.pandas_udf(group_numbers, "array<int>")(*_asked(members, core, linear))
    each = packed.withColumn("__n", numbers).select(*by, F.posexplode(F.arrays_zip(F.col(members).alias("m"), F.col("__n").alias("n"))).alias("__at", "__x"))
    placed = F.collect_list(F.struct(F.col("__at").alias("at"), F.col("__x.m").alias("m")))
    grouped = each.groupBy(*by, F.col("__x.n").alias("cluster")).agg(F.array_sort(placed, lambda x, y: x["at"] - y["at"]).alias("members"))
    return grouped.withColumn("members", F.transform("members", lambda x: x["m"]))


def centred(group: Column) -> Column:
    """The mean position of the members that have one, as struct(lon, lat), null for none."""
    known = F.filter(group, lambda m: m["lon"].isNotNull() & m["lat"].isNotNull())
    mean = lambda k: F.aggregate(known, F.lit(0.0), lambda s, m: s + m[k]) / F.size(known)
    return F.when(F.size(known) > 0, F.struct(mean("lon").alias("lon"), mean("lat").alias("lat")))


def clusters(objects: DataFrame, by: list[str], order: list[str], fields: tuple[str, ...] = ("lon", "lat", "t", "tags", "id")) -> DataFrame:
    """Rows (by..., cluster, members, lon, lat) of objects grouped within each key."""
    ranked = F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("m")))
    packed = objects.groupBy(*by).agg(F.array_sort(ranked, lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0)).alias("a"))
    members = packed.select(*by, F.transform("a", lambda x: x["m"]).alias("members"))
    each = greedy(members, by, "members", lambda m: is_core(m["t"], m["tags"]), lambda m: linear_km(m["t"], m["tags"]))
    return each.withColumn("c", centred(F.col("members"))).select(*by, "cluster", "members", "c.lon", "c.lat")
