"""Outlines: rings out of pieces, areas out of rings. Works in pandas by batches of groups, as Spark has no polygons here."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Ends:
    """Which unused pieces begin or end at a node, the least place first."""

    def __init__(self, pieces: dict[int, list[int]]):
        self.pieces = pieces
        self.at: dict[int, list[int]] = {}
        for place, nodes in pieces.items():  # ascending, so each list is a heap
            for node in {nodes[0], nodes[-1]}:
                self.at.setdefault(node, []).append(place)

    def least(self, node: int) -> int | None:
        places = self.at.get(node, [])
        while places and places[0] not in self.pieces:
            heapq.heappop(places)
        return places[0] if places else None


def chains(pieces: list[list[int]]) -> Iterator[list[int]]:
    """Lines that node lists make when joined end to end.

    A line starts with the first piece left and grows, until it closes, by the first piece
    left that has one of the line's ends as an end of its own; a piece that has both goes to
    the line's last node. Time grows with the nodes and the logarithm of the pieces.
    """
    left = {place: list(map(int, nodes)) for place, nodes in enumerate(pieces) if len(nodes) >= 2}
    ends = _Ends(left)
    while left:
        line = deque(left.pop(next(iter(left))))
        while line[0] != line[-1]:
            fitting = [(place, side) for side, node in enumerate((line[-1], line[0])) if (place := ends.least(node)) is not None]
            if not fitting:
                break
            place, side = min(fitting)
            more = left.pop(place)
            if side == 0:
                line.extend(more[1:] if more[0] == line[-1] else more[-2::-1])
            else:
                line.extendleft(more[-2::-1] if more[-1] == line[0] else more[1:])
        yield list(line)


def rings(pieces: list[list[int]]) -> tuple[list[list[int]], list[list[int]]]:
    """Closed rings (four ids or more, the first again at the end), and what does not close."""
    lines = list(chains(pieces))
    whole = [line[0] == line[-1] and len(line) > 3 for line in lines]
    return [x for x, w in zip(lines, whole, strict=True) if w], [x for x, w in zip(lines, whole, strict=True) if not w]


def assembled(ways: DataFrame, key: str | list[str] = "relation_id") -> DataFrame:
    """Rows (key, ring, closed) of ways (key, role_place, nodes) joined in order of role_place for each relation, of one place in order of nodes.

    Relations are gathered by an aggregate and worked on in batches, so that very many small ones cost no start each.
    """
    keys = [key] if isinstance(key, str) else list(key)
    kinds = dict(ways.dtypes)

    def run(batches):
        for pdf in batches:
            rows = []
            for *own, lists in zip(*(pdf[k] for k in keys), pdf["lists"], strict=True):
                closed, open_ = rings([list(map(int, n)) for n in lists])
                rows += [(*own, r, True) for r in closed] + [(*own, r, False) for r in open_]
            yield pd.DataFrame(rows, columns=[*keys, "ring", "closed"])

    parts = F.array_sort(F.collect_list(F.struct(F.col("role_place").isNull().alias("last"), "role_place", "nodes")))
    gathered = ways.groupBy(*keys).agg(parts.alias("p")).select(*keys, F.transform("p", lambda w: w["nodes"]).alias("lists"))
    return gathered.mapInPandas(run, f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, ring array<long>, closed boolean")


def simplified(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """A line with fewer points (Douglas-Peucker): none left out lies farther from it than the tolerance."""
    keep, work = {0, len(points) - 1}, [(0, len(points) - 1)]
    while work:
        a, b = work.pop()
        (x1, y1), (x2, y2) = points[a], points[b]
        length = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
        far, at = tolerance, -1
        for i in range(a + 1, b):
            x, y = points[i]
            d = abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / length if length else ((x - x1) ** 2 + (y - y1) ** 2) ** 0.5
            if d > far:
                far, at = d, i
        if at > 0:
            keep.add(at)
            work += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]
