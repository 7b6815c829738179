import math
import random

import numpy as np
import pytest

from wayfold.operators import areas

WAYS, NODES = "area string, role string, place int, nodes array<long>", "id long, lon double, lat double"


class Map:
    """Nodes by position, and ways of areas."""

    def __init__(self):
        self.ids, self.ways = {}, []

    def node(self, p):
        return self.ids.setdefault((float(p[0]), float(p[1])), len(self.ids) + 1)

    def add(self, area, role, points, pieces=1, turned=False):
        ids = [self.node(p) for p in points] + [self.node(points[0])]
        cuts = np.linspace(0, len(ids) - 1, pieces + 1).astype(int)
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            part = ids[a : b + 1]
            self.ways.append((area, role, k, part[::-1] if turned or k % 2 else part))

    def frames(self, spark):
        return spark.createDataFrame(self.ways, WAYS), spark.createDataFrame([(i, x, y) for (x, y), i in self.ids.items()], NODES)


def square(x, y, size):
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]


def found(df):
    return sorted((r.polygon, r.hole, r.doubled / 2, {(p.lon, p.lat) for p in r.points}) for r in df.collect())


def shape(rows):
    """Polygons as (outer area, sorted hole areas)."""
    by = {}
    for polygon, hole, area, _ in rows:
        by.setdefault(polygon, [None, []])
        if hole:
            by[polygon][1].append(area)
        else:
            by[polygon][0] = area
    return sorted((o, sorted(h)) for o, h in by.values())


def test_holes_islands_in_holes_and_broken_rings(spark):
    m = Map()
    m.add("a", "outer", square(0, 0, 10), 4, True)
    m.add("a", "inner", square(2, 2, 6), 2)
    m.add("a", "outer", square(4, 4, 2), 1, True)
    m.add("a", "inner", square(4.5, 4.5, 1), 3)
    m.add("a", "outer", square(20, 0, 1))
    m.ways.append(("open", "outer", 0, [m.node((50, 50)), m.node((51, 50)), m.node((51, 51))]))
    m.add("lost", "outer", square(60, 60, 1))
    ways, nodes = m.frames(spark)
    nodes = nodes.where(f"id <> {m.node((60, 60))}")
    rows = areas.of_ways(ways, nodes).collect()
    assert {r.area for r in rows} == {"a"} and all(r.ring[0] == r.ring[-1] and len(set(r.ring)) == len(r.ring) - 1 for r in rows)
    assert shape(found(areas.of_ways(ways, nodes))) == [(1.0, []), (4.0, [-1.0]), (100.0, [-36.0])]


def test_a_hole_at_the_border_and_pieces_that_touch(spark):
    m = Map()
    m.add("notch", "outer", [(0, 0), (4, 0), (4, 2), (4, 4), (0, 4)])
    m.add("notch", "inner", [(4, 2), (2, 2), (2, 3)])  # touches the border in one node
    m.add("bite", "outer", [(10, 0), (14, 0), (14, 1), (14, 2), (14, 4), (10, 4)])
    m.add("bite", "inner", [(14, 1), (14, 2), (12, 2), (12, 1)])  # shares an edge with the border
    m.add("pair", "outer", square(20, 0, 1))
    m.add("pair", "outer", square(21, 1, 1))  # one common corner
    m.add("twice", "outer", square(30, 0, 1))
    m.add("twice", "outer", [(31, 0), (32, 0), (32, 1), (31, 1)])  # one common edge
    rows = areas.of_ways(*m.frames(spark))
    got = {k: shape(found(rows.where(f"area = '{k}'"))) for k in ("notch", "bite", "pair", "twice")}
    assert got == {"notch": [(16.0, [-1.0])], "bite": [(14.0, [])], "pair": [(1.0, []), (1.0, [])], "twice": [(2.0, [])]}


def test_dissolved_cells_equal_a_flood_fill(spark):
    rng = random.Random(4)
    m, cells = Map(), {}
    for x in range(9):
        for y in range(9):
            cells[x, y] = rng.choice("pqr")
            m.add(f"{x},{y}", "outer", square(x, y, 1), rng.randint(1, 4), rng.random() < 0.5)
    groups = [(f"{x},{y}", t) for (x, y), t in cells.items()] + [("0,0", cells[0, 0])]  # one is listed twice
    got = areas.dissolved(*m.frames(spark), spark.createDataFrame(groups, "area string, tag string"))
    for t in "pqr":
        rows = found(got.where(f"tag = '{t}'"))
        own = {c for c, v in cells.items() if v == t}
        pieces = []
        left = set(own)
        while left:
            todo, piece = [left.pop()], set()
            while todo:
                x, y = todo.pop()
                piece.add((x, y))
                for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                    if n in left:
                        left.discard(n)
                        todo.append(n)
            pieces.append(len(piece))
        assert sorted(o + sum(h) for o, h in shape(rows)) == sorted(map(float, pieces))


def wavy(spark, steps=60):
    """Four areas around a point, their common borders full of small turns, and an island alone."""
    m, rng = Map(), random.Random(2)
    arm = lambda dx, dy: [(10 + dx * k / 10 + (rng.uniform(-0.02, 0.02) if dy else 0), 10 + dy * k / 10 + (rng.uniform(-0.02, 0.02) if dx else 0)) for k in range(steps + 1)]
    east, north, west, south = arm(1, 0), arm(0, 1), arm(-1, 0), arm(0, -1)
    for a in (north, west, south):
        a[0] = east[0]
    corner = steps / 10
    for name, first, second, c in (("ne", east, north, (1, 1)), ("nw", north, west, (-1, 1)), ("sw", west, south, (-1, -1)), ("se", south, east, (1, -1))):
        m.add(name, "outer", [*first, (10 + c[0] * corner, 10 + c[1] * corner), *second[:0:-1]], 3)
    m.add("island", "outer", [(30 + math.cos(k / 50 * math.tau), 30 + math.sin(k / 50 * math.tau)) for k in range(50)])
    return areas.of_ways(*m.frames(spark))


def away(p, line):
    best = 9e9
    for (x1, y1), (x2, y2) in zip(line[:-1], line[1:], strict=True):
        d = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = max(0, min(1, ((p[0] - x1) * (x2 - x1) + (p[1] - y1) * (y2 - y1)) / d)) if d else 0
        best = min(best, math.dist(p, (x1 + t * (x2 - x1), y1 + t * (y2 - y1))))
    return best


@pytest.mark.parametrize("tolerance", [0.0, 0.01, 0.05, 100.0])
def test_neighbours_share_every_point_after_simplification(spark, tolerance):
    before = wavy(spark)
    after = areas.simplified_rings(before, tolerance)
    old = {r.area: [(p.lon, p.lat) for p in r.points] for r in before.collect()}
    new = {r.area: r for r in after.collect()}
    assert set(new) == set(old)
    sides = {}
    for name, r in new.items():
        points = [(p.lon, p.lat) for p in r.points]
        assert points[0] == points[-1] and len(set(points)) == len(points) - 1 >= 3 and set(points) <= set(old[name]) and r.doubled > 0
        if tolerance < 1:
            assert max(away(p, points) for p in old[name]) <= tolerance + 1e-12
        for a, b in zip(points[:-1], points[1:], strict=True):
            sides.setdefault(frozenset((a, b)), []).append((name, a, b))
    # Where two areas meet they have the very same edges, once each way.
    shared = [v for v in sides.values() if len(v) == 2]
    assert len(shared) >= 4 and all(v[0][1] == v[1][2] for v in shared)
    covered = sum(r.doubled / 2 for n, r in new.items() if n != "island")
    outline = [s for v in sides.values() if len(v) == 1 for s in v if s[0] != "island"]
    assert covered == pytest.approx(sum((a[0] - 10) * (b[1] - 10) - (b[0] - 10) * (a[1] - 10) for _, a, b in outline) / 2)
    if tolerance == 0.05:
        assert sum(len(r.points) for r in new.values()) < sum(map(len, old.values())) / 3


def covered(x, y, rings):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True):
            if (y1 > y) != (y2 > y) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x:
                n += 1
    return n % 2 == 1


def test_inside_points_are_inside_concave_areas_with_holes(spark):
    m = Map()
    m.add("u", "outer", [(0, 0), (9, 0), (9, 9), (8, 9), (8, 1), (1, 1), (1, 9), (0, 9)])
    m.add("holed", "outer", square(20, 0, 8))
    m.add("holed", "inner", square(21, 1, 6))
    m.add("two", "outer", square(40, 0, 1))
    m.add("two", "outer", square(45, 0, 3))
    m.add("star", "outer", [(60 + (3 if k % 2 else 1) * math.cos(k / 14 * math.tau), 3 + (3 if k % 2 else 1) * math.sin(k / 14 * math.tau)) for k in range(14)])
    rows = areas.of_ways(*m.frames(spark))
    rings = {}
    for r in rows.collect():
        rings.setdefault(r.area, []).append([(p.lon, p.lat) for p in r.points])
    got = {r.area: r for r in areas.inside_points(rows).collect()}
    assert set(got) == set(rings)
    for name, r in got.items():
        assert covered(r.lon, r.lat, rings[name])
    assert (got["two"].lon, got["two"].width) == (46.5, 3.0)


def test_nothing_gives_nothing(spark):
    ways, nodes = Map().frames(spark)
    rows = areas.of_ways(ways, nodes)
    assert rows.count() == 0 and areas.simplified_rings(rows, 0.1).count() == 0 and areas.inside_points(rows).count() == 0
