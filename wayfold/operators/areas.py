"""Areas with holes: polygons out of ways, dissolved areas, borders simplified once, inner points.

A boundary is held as directed edges between nodes with the area on the left: outer rings run
counter-clockwise, inner ones clockwise. Then uniting areas and taking holes out are the same
aggregate: an edge that is there in both directions has area on both sides and goes. Areas
must meet at common nodes, as they do in a map; where their outlines cross without a node,
neither side is cut.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.tables import cut
from .geometry import assembled, simplified


def directed_edges(ways: DataFrame, nodes: DataFrame, key: str = "area") -> DataFrame:
    """Rows (key, u, v, x1, y1, x2, y2): the edges of closed rings, area on the left.

    ``ways`` are (key, role: outer or inner, place, nodes), ``nodes`` (id, lon, lat). Ways are
    joined to rings by role in order of place; a ring that does not close, or one of whose
    nodes is not there, is left out.
    """
    parts = ways.select(F.col(key).alias("area"), "role", F.col("place").alias("role_place"), "nodes")
    rings = assembled(parts, ["area", "role"]).where("closed").withColumn("ring_id", F.xxhash64("area", "role", "ring"))
    steps = rings.select("area", "role", "ring_id", F.posexplode(F.arrays_zip(F.slice("ring", F.lit(1), F.size("ring") - 1).alias("u"), F.slice("ring", F.lit(2), F.size("ring") - 1).alias("v"))).alias("place", "e"))
    # Nodes are many more than the size of what they are made from may tell: they are not sent to all tasks.
    ends = lambda i: nodes.select(F.col("id").alias("u" if i == 1 else "v"), F.col("lon").alias(f"x{i}"), F.col("lat").alias(f"y{i}")).hint("merge")
    whole = Window.partitionBy("area", "role", "ring_id")
    at = steps.select("area", "role", "ring_id", "e.u", "e.v").join(ends(1), "u", "left").join(ends(2), "v", "left")
    at = at.where(F.col("u") != F.col("v")).withColumns({"lost": F.count(F.when(F.col("x1").isNull() | F.col("x2").isNull(), 1)).over(whole), "turn": F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).over(whole)}).where("lost = 0 AND turn != 0")
    back = (F.col("turn") > 0) != (F.col("role") == "outer")
    pick = lambda a, b: F.when(back, F.col(b)).otherwise(F.col(a)).alias(a)
    return at.select(F.col("area").alias(key), *[pick(a, b) for a, b in (("u", "v"), ("v", "u"), ("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))])


def boundary(edges: DataFrame, key: str = "area") -> DataFrame:
    """The edges of each key that have area on one side only, each once: what unites areas of a key and takes out holes.

    Edges are grouped without regard to direction; nothing is compared pairwise.
    """
    low, high = F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")
    ahead = F.col("u") < F.col("v")
    sides = edges.groupBy(key, low, high).agg(F.max(F.when(ahead, F.struct("x1", "y1", "x2", "y2"))).alias("ahead"), F.max(F.when(~ahead, F.struct("x1", "y1", "x2", "y2"))).alias("back"))
    one = sides.where(F.col("ahead").isNull() != F.col("back").isNull()).withColumn("e", F.coalesce("ahead", "back"))
    first = F.col("ahead").isNotNull()
    return one.select(key, F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"), "e.x1", "e.y1", "e.x2", "e.y2")


def _loops(steps: list[int]) -> list[list[int]]:
    """A closed walk, cut where it comes back to a node: loops without a repeated node."""
    out, path, at = [], [], {}
    for node in steps:
        if node in at:
            start = at[node]
            out.append(path[start:] + [node])
            for gone in path[start + 1 :]:
                del at[gone]
            del path[start + 1 :]
        else:
            at[node] = len(path)
            path.append(node)
    return out


def walks(edges: list[tuple[int, int]], place: dict[int, tuple[float, float]], outside: set[int] = frozenset()) -> list[list[int]]:
    """Walks along directed edges with the area on the left, each edge in one of them.

    Where several edges leave a node, the walk takes the one that bounds the same piece of
    area: the first clockwise from where it came. A walk ends where it began, or at a node
    outside, where it may have begun as well.
    """
    leaving = defaultdict(list)
    for u, v in edges:
        if u not in outside:
            leaving[u].append(v)
    angle = lambda a, b: math.atan2(place[b][1] - place[a][1], place[b][0] - place[a][0])
    left, out = set(edges), []
    # What comes from outside goes first, so that no walk begins in the middle of another.
    for start in sorted(edges, key=lambda e: (e[0] not in outside, e)) if outside else sorted(edges):
        if start not in left:
            continue
        walk, (u, v) = [start[0]], start
        while (u, v) in left:
            left.discard((u, v))
            walk.append(v)
            ahead = leaving.get(v, ())
            if len(ahead) > 1:
                ahead = [w for w in ahead if (v, w) in left]
            if len(ahead) > 1:
                came = angle(v, u)
                # Clockwise from the way back; straight back counts as a whole turn.
                ahead = [min(ahead, key=lambda w: ((came - angle(v, w)) % (2 * math.pi) or 2 * math.pi, w))]
            if not ahead:
                break
            u, v = v, ahead[0]
        out.append(walk)
    return out


def traced(edges: list[tuple[int, int]], place: dict[int, tuple[float, float]]) -> list[list[int]]:
    """Closed rings of directed edges with the area on the left (see ``walks``), none with a node twice."""
    return [r for walk in walks(edges, place) for r in _loops(walk)]


def _doubled(points: np.ndarray) -> float:
    """Twice the signed area of a closed ring, taken from its first point so that far positions keep their digits."""
    p = points - points[0]
    return float(np.dot(p[:-1, 0], p[1:, 1]) - np.dot(p[1:, 0], p[:-1, 1]))


def _sizes(flat: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``_doubled`` of rings that follow each other in ``flat``, ``count`` points each."""
    start = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(int)
    p = flat - np.repeat(flat[start], count, axis=0)
    cross = np.zeros(len(p))
    cross[:-1] = p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]
    cross[start + count - 1] = 0.0
    return np.add.reduceat(cross, start)


def _inside(x: float, y: float, ring: np.ndarray) -> bool:
    a, b = ring[:-1], ring[1:]
    over = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[over], b[over]
    return bool(np.count_nonzero(a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]) > x) % 2)


def _which_inside(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Which of many points are inside a ring: an edge is held only against points of its latitudes."""
    order = np.argsort(y, kind="stable")
    x, y, odd = x[order], y[order], np.zeros(len(x), bool)
    a, b = ring[:-1], ring[1:]
    # (a > y) != (b > y) are the y from the lower end on, below the upper one.
    first, end = np.searchsorted(y, np.minimum(a[:, 1], b[:, 1])), np.searchsorted(y, np.maximum(a[:, 1], b[:, 1]))
    met = np.flatnonzero(end > first)
    a, b, first, n = a[met], b[met], first[met], (end - first)[met]
    done = np.cumsum(n)
    for low, high in _runs(done, MOST_POINTS * 10):
        c = n[low:high]
        e = np.repeat(np.arange(low, high), c)
        i = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + first[e]
        right = a[e, 0] + (y[i] - a[e, 1]) / (b[e, 1] - a[e, 1]) * (b[e, 0] - a[e, 0]) > x[i]
        odd ^= np.bincount(i[right], minlength=len(x)) % 2 == 1
    out = np.empty(len(x), bool)
    out[order] = odd
    return out


def _runs(done: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of places whose sums, of which ``done`` are the running ones, are about ``most``."""
    low, before = 0, 0
    while low < len(done):
        high = max(low + 1, int(np.searchsorted(done, before + most, "right")))
        yield low, high
        low, before = high, done[high - 1]


class _Boxes:
    """Boxes in grids of several sizes, each in the grid whose cells are just as large as it, so in at most four cells; a point looks into one cell of each grid."""

    def __init__(self, boxes: dict[int, tuple[float, float, float, float]]):
        self.boxes, self.cells = boxes, {}
        # Degrees of longitude and latitude are weighed by the mean width and height of boxes.
        self.wide = sum(b[2] - b[0] for b in boxes.values()) / max(len(boxes), 1) or 1.0
        self.high = sum(b[3] - b[1] for b in boxes.values()) / max(len(boxes), 1) or 1.0
        for i, (w, s, e, n) in boxes.items():
            size = max((e - w) / self.wide, (n - s) / self.high)
            level = math.frexp(size)[1] if size > 0 else -60
            (x1, y1), (x2, y2) = self._cell(w, s, level), self._cell(e, n, level)
            grid = self.cells.setdefault(level, {})
            for x in range(x1, x2 + 1):
                for y in range(y1, y2 + 1):
                    grid.setdefault((x, y), []).append(i)

    def _cell(self, x: float, y: float, level: int) -> tuple[int, int]:
        size = 2.0**level
        return math.floor(x / self.wide / size), math.floor(y / self.high / size)

    def around(self, x: float, y: float) -> list[int]:
        near = (i for level, grid in self.cells.items() for i in grid.get(self._cell(x, y, level), ()))
        return [i for i in near if self.boxes[i][0] <= x <= self.boxes[i][2] and self.boxes[i][1] <= y <= self.boxes[i][3]]


#: How far from its ring a point just outside a hole is taken, as a part of an edge.
STEP = 1e-7


def nested(rings: list[np.ndarray], size: list[float] | None = None) -> list[tuple[int, int]]:
    """For each ring (polygon, hole): outer rings are hole 0 of a polygon of their own, holes belong to the smallest outer ring around them.

    Polygons are numbered as their rings come; so an island within a hole is a polygon of its own, at any depth. A hole is held
    only against the outer rings whose boxes have it, which a grid finds.
    """
    size = [_doubled(r) for r in rings] if size is None else size
    outers = [i for i, s in enumerate(size) if s > 0]
    number, count = {i: k for k, i in enumerate(outers)}, [0] * len(outers)
    index = None if len(outers) == len(rings) else _Boxes({i: (*rings[i].min(axis=0).tolist(), *rings[i].max(axis=0).tolist()) for i in outers})
    out = []
    for i, ring in enumerate(rings):
        if i in number:
            out.append((number[i], 0))
            continue
        # A point just outside the hole, where its area is: left of the middle of an edge.
        (x1, y1), (x2, y2) = ring[:2].tolist()
        x, y = (x1 + x2) / 2 - (y2 - y1) * STEP, (y1 + y2) / 2 + (x2 - x1) * STEP
        home = next((o for o in sorted(index.around(x, y), key=lambda o: (size[o], o)) if _inside(x, y, rings[o])), None)
        if home is None:
            out.append((-1, 0))
            continue
        count[number[home]] += 1
        out.append((number[home], count[number[home]]))
    return out


#: Points of rings that a task hands on at once, and edges that a task traces at once: a key with more is cut into strips of about as many.
MOST_POINTS, STRIP_EDGES = 100_000, 50_000
#: Nodes of a strip that are looked at for where to cut.
CUT_NODES = 50
RINGS = "polygon int, hole int, ring array<long>, points array<struct<lon:double,lat:double>>, doubled double"
_NODES, _ENDS = ("u", "v"), ("x1", "y1", "x2", "y2")


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, nodes, positions, whether nodes are outside) of rows that come in order of keys: one strip's edges at a time, however many batches they are in."""
    held: list[tuple[np.ndarray, ...]] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        col = lambda c: batch.column(names.index(c))
        stack = lambda cols: np.column_stack([col(c).to_numpy(zero_copy_only=False) for c in cols])
        parts = stack(_NODES), stack(_ENDS), stack(("out1", "out2"))
        runs = [pc.run_end_encode(col(k)) for k in keys]
        stops = np.unique(np.concatenate([r.run_ends.to_numpy() for r in runs]))
        values = [r.values.take(pa.array(np.searchsorted(r.run_ends.to_numpy(), stops))).to_pylist() for r in runs]
        start = 0
        for k, end in zip(zip(*values, strict=True), stops.tolist(), strict=True):
            if held and k != now:
                yield now, *(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
            now = k
            held.append(tuple(p[start:end] for p in parts))
            start = end
    if held:
        yield now, *(np.concatenate(x) for x in zip(*held, strict=True))


class _Rows:
    """Rows of rings (keys, others, ring, points) that are handed on as record batches of about MOST_POINTS points."""

    def __init__(self, names: list[str], types: list[pa.DataType]):
        self.names, self.types, self.rows, self.kept = names, types, [], 0

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.kept += len(row[-1])
        if self.kept > MOST_POINTS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        *others, r, q = zip(*self.rows, strict=True)
        self.rows, self.kept = [], 0
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in r])]), pa.int32())
        flat = np.concatenate(q)
        at = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["lon", "lat"])
        ring = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(r), pa.int64()))
        yield pa.RecordBatch.from_arrays([*[pa.array(o, t) for o, t in zip(others, self.types, strict=True)], ring, pa.ListArray.from_arrays(offsets, at)], self.names)


def _with_sizes(rings: list[list[int]], place: dict[int, tuple[float, float]]) -> tuple[list[np.ndarray], list[float]]:
    """The points of rings, and twice their signed areas."""
    if not rings:
        return [], []
    count = np.array([len(r) for r in rings])
    flat = np.array([place[n] for r in rings for n in r])
    return np.split(flat, np.cumsum(count)[:-1]), _sizes(flat, count).tolist()


def _traced(edges: DataFrame, key: str) -> DataFrame:
    """Rows (key, strip, polygon, hole, doubled, ring, points) of edges (key, strip, u, v, x1, y1, x2, y2, out1, out2: whether u and v are outside the strip).

    polygon is numbered within a strip; it is -1 for a hole whose ring is not in the strip, and -2 for a walk that leaves the strip.
    """
    key_type = to_arrow_type(edges.schema[key].dataType)

    def run(batches):
        out = _Rows([key, "strip", "polygon", "hole", "doubled", "ring", "points"], [key_type, pa.int32(), pa.int32(), pa.int32(), pa.float64()])
        for (k, strip), nodes, at, away in _by_key(batches, [key, "strip"]):
            starts, ends = nodes[:, 0].tolist(), nodes[:, 1].tolist()
            place = dict(zip(starts, zip(at[:, 0].tolist(), at[:, 1].tolist(), strict=True), strict=True))
            place.update(zip(ends, zip(at[:, 2].tolist(), at[:, 3].tolist(), strict=True), strict=True))
            outside = set(nodes[away].tolist())
            rings = []
            for walk in walks(list(zip(starts, ends, strict=True)), place, outside):
                if walk[0] not in outside and walk[-1] not in outside:
                    rings += _loops(walk)
                elif len(walk) > 2:  # a single edge is the end of another strip's walk
                    yield from out.add(k, strip, -2, 0, 0.0, walk, np.array([place[n] for n in walk]))
            points, size = _with_sizes(rings, place)
            for r, q, d, (p, h) in zip(rings, points, size, nested(points, size), strict=True):
                if p >= 0 or strip >= 0:
                    yield from out.add(k, strip, p, h, d, r, q)
        yield from out.rest()

    kind = dict(edges.dtypes)[key]
    sorted_edges = edges.repartition(key, "strip").sortWithinPartitions(key, "strip")
    return sorted_edges.mapInArrow(run, f"{key} {kind}, strip int, polygon int, hole int, doubled double, ring array<long>, points array<struct<lon:double,lat:double>>")


def _in_strips(edges: DataFrame, key: str) -> DataFrame:
    """``edges`` with strip, out1 and out2: once for each strip that has one of their ends.

    A strip has the nodes between two positions in order of latitude, then longitude. So what lies within a ring of one strip is in that strip.
    Where to cut is told by some nodes, chosen by a hash of their ids.
    """
    some = edges.where(F.pmod(F.xxhash64("u"), F.lit(max(1, STRIP_EDGES // CUT_NODES))) == 0).select(key, "y1", "x1").collect()
    found = defaultdict(list)
    for k, y, x in some:
        found[k].append(complex(y, x))
    cuts = {k: np.unique(np.sort(np.array(at))[CUT_NODES::CUT_NODES]) for k, at in found.items()}
    kind = dict(edges.dtypes)[key]
    names = [key, *_NODES, *_ENDS]

    def strips(at: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        spot = np.empty(len(lat), complex)  # compared by latitude, then longitude
        spot.real, spot.imag = lat, lon
        return np.searchsorted(at, spot, "right").astype(np.int32)

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch]).select(names)
            for k in pc.unique(table[key]):
                own = table.filter(pc.equal(table[key], k))
                at = cuts.get(k.as_py(), np.array([], complex))
                x1, y1, x2, y2 = (own[c].to_numpy() for c in _ENDS)
                one, two = strips(at, y1, x1), strips(at, y2, x2)
                both = np.flatnonzero(one != two)
                for rows, strip in ((None, one), (both, two)):
                    part = own if rows is None else own.take(rows)
                    s, a, b = (c if rows is None else c[rows] for c in (strip, one, two))
                    for name, values in (("strip", s), ("out1", a != s), ("out2", b != s)):
                        part = part.append_column(name, pa.array(values))
                    yield from part.combine_chunks().to_batches()

    return edges.select(*names).mapInArrow(run, f"{key} {kind}, u long, v long, x1 double, y1 double, x2 double, y2 double, strip int, out1 boolean, out2 boolean")


def _linked(parts: DataFrame, key: str) -> DataFrame:
    """Rows (key, doubled, ring, points) of the rings that walks through several strips make.

    The last edge of a walk is the first of the next. Which walks follow each other is found in one task a key, by their
    ends; their nodes are gathered afterwards, a ring at a time.
    """
    kind, key_type = dict(parts.dtypes)[key], to_arrow_type(parts.schema[key].dataType)
    ends = parts.select(key, *[F.element_at("ring", i).alias(n) for i, n in ((1, "a"), (2, "b"), (-2, "c"), (-1, "d"))])

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, c, d = (pdf[x].to_numpy() for x in "abcd")
        first = {e: i for i, e in enumerate(zip(a.tolist(), b.tolist(), strict=True))}
        after = [first.get(e, -1) for e in zip(c.tolist(), d.tolist(), strict=True)]
        led = set(after)
        ring, place, closed = np.full(len(a), -1), np.zeros(len(a), int), np.ones(len(a), bool)
        by_edge = np.lexsort((b, a)).tolist()
        for n, i in enumerate([i for i in by_edge if i not in led] + by_edge):
            if ring[i] >= 0:
                continue
            whole, k = i in led, 0
            while i >= 0 and ring[i] < 0:
                ring[i], place[i], closed[i] = n, k, whole
                i, k = after[i], k + 1
        return pd.DataFrame({key: pdf[key], "a": a, "b": b, "n": ring, "place": place, "closed": closed})

    def join(batches):
        out = _Rows([key, "doubled", "ring", "points"], [key_type, pa.float64()])
        for batch in batches:
            for i in range(batch.num_rows):
                k, whole, lists = (batch.column(c)[i] for c in (0, 1, 2))
                lists = lists.values.flatten()
                walk, place = [], {}
                nodes, points = lists[1], lists[2]
                for j in range(len(nodes)):
                    own, at = nodes[j].values.to_numpy().tolist(), points[j].values.flatten()
                    place.update(zip(own, zip(at[0].to_pylist(), at[1].to_pylist(), strict=True), strict=True))
                    walk += own[:-2] if whole.as_py() or j + 1 < len(nodes) else own
                if whole.as_py():  # from its least edge on, as a walk in one piece
                    at = min(range(len(walk)), key=lambda i: (walk[i], walk[(i + 1) % len(walk)]))
                    walk = walk[at:] + walk[: at + 1]
                rings = _loops(walk)
                for r, q, d in zip(rings, *_with_sizes(rings, place), strict=True):
                    yield from out.add(k.as_py(), d, r, q)
        yield from out.rest()

    found = ends.groupBy(key).applyInPandas(order, f"{key} {kind}, a long, b long, n int, place int, closed boolean")
    own = parts.withColumns({"a": F.element_at("ring", 1), "b": F.element_at("ring", 2)})
    gathered = own.join(found, [key, "a", "b"]).groupBy(key, "n").agg(F.first("closed").alias("closed"), F.array_sort(F.collect_list(F.struct("place", "ring", "points"))).alias("lists"))
    return gathered.select(key, "closed", "lists").mapInArrow(join, f"{key} {kind}, doubled double, ring array<long>, points array<struct<lon:double,lat:double>>")


def _homes(holes: DataFrame, outers: DataFrame, key: str) -> DataFrame:
    """Rows (key, a, b, home_a, home_b) of holes (key, a, b: their first edge, points) and the smallest of ``outers`` (the same, doubled) around each; none without any.

    A ring is put into a grid whose cells are just as large as its box, so into four cells at most; a hole looks into one cell of each
    grid. A ring's holes are held against it in one task.
    """
    kind, key_type = dict(holes.dtypes)[key], to_arrow_type(holes.schema[key].dataType)
    (x1, y1), (x2, y2) = [(F.get("points", F.lit(i))["lon"], F.get("points", F.lit(i))["lat"]) for i in (0, 1)]
    spots = holes.select(key, "a", "b", ((x1 + x2) / 2 - (y2 - y1) * STEP).alias("x"), ((y1 + y2) / 2 + (x2 - x1) * STEP).alias("y"))
    most = lambda f, c: f(F.transform("points", lambda p: p[c]))
    boxes = outers.select(key, F.col("a").alias("home_a"), F.col("b").alias("home_b"), most(F.array_min, "lon").alias("west"), most(F.array_min, "lat").alias("south"), most(F.array_max, "lon").alias("east"), most(F.array_max, "lat").alias("north"))
    level = lambda low, high: F.ceil(F.log2(F.greatest(F.col(high) - F.col(low), F.lit(1e-9)))).cast("int")
    boxes = boxes.withColumns({"wide": level("west", "east"), "high": level("south", "north")})
    at = lambda c, level: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col(level)))
    grids = boxes.select(key, "wide", "high").distinct()
    cells = boxes.withColumn("i", F.explode(F.sequence(at("west", "wide"), at("east", "wide")))).withColumn("j", F.explode(F.sequence(at("south", "high"), at("north", "high"))))
    asked = spots.join(F.broadcast(grids), key).withColumns({"i": at("x", "wide"), "j": at("y", "high")})
    near = asked.join(cells, [key, "wide", "high", "i", "j"]).where("x BETWEEN west AND east AND y BETWEEN south AND north")
    gathered = near.groupBy(key, "home_a", "home_b").agg(F.collect_list(F.struct("a", "b", "x", "y")).alias("spots"))
    rings = outers.select(key, F.col("a").alias("home_a"), F.col("b").alias("home_b"), "doubled", "points")

    def run(batches):
        for batch in batches:
            k, one, two, size, points, asked = (batch.column(i) for i in range(6))
            for i in range(batch.num_rows):
                ring = np.column_stack([c.to_numpy() for c in points[i].values.flatten()])
                a, b, x, y = (c.to_numpy() for c in asked[i].values.flatten())
                held = _which_inside(x, y, ring)
                n = int(held.sum())
                same = lambda c, t: pa.array([c[i].as_py()] * n, t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(k, key_type), pa.array(a[held]), pa.array(b[held]), same(one, pa.int64()), same(two, pa.int64()), same(size, pa.float64())], [key, "a", "b", "home_a", "home_b", "doubled"])

    inside = rings.join(gathered, [key, "home_a", "home_b"]).mapInArrow(run, f"{key} {kind}, a long, b long, home_a long, home_b long, doubled double")
    return inside.groupBy(key, "a", "b").agg(F.min_by(F.struct("home_a", "home_b"), "doubled").alias("h")).select(key, "a", "b", "h.*")


def _by_strips(edges: DataFrame, key: str) -> DataFrame:
    """``polygons`` of keys with very many edges: traced strip by strip, rings that cross strips and their holes put together afterwards."""
    traced_parts = cut(_traced(_in_strips(edges, key), key), "strips")
    first = {"a": F.element_at("ring", 1), "b": F.element_at("ring", 2)}
    crossing = cut(_linked(traced_parts.where("polygon = -2"), key).withColumns(first), "crossing-rings")
    outers, lost = crossing.where("doubled > 0"), crossing.where("doubled <= 0")
    alone = traced_parts.where("polygon = -1").withColumns(first).select(*crossing.columns).unionByName(lost)
    homes = _homes(alone, outers, key)
    # Polygons are numbered strip by strip, those that cross strips last.
    counts = traced_parts.where("polygon >= 0 AND hole = 0").groupBy(key, "strip").agg(F.count("*").alias("n"))
    base = counts.select(key, "strip", (F.sum("n").over(Window.partitionBy(key).orderBy("strip")) - F.col("n")).cast("int").alias("before"))
    totals = counts.groupBy(key).agg(F.sum("n").cast("int").alias("before"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("a", "b")) - 1
    numbered = outers.withColumn("n", number).join(F.broadcast(totals), key, "left").withColumn("polygon", (F.col("n") + F.coalesce("before", F.lit(0))).cast("int"))
    place = F.row_number().over(Window.partitionBy(key, "polygon").orderBy("a", "b"))
    found = homes.join(numbered.select(key, F.col("a").alias("home_a"), F.col("b").alias("home_b"), "polygon"), [key, "home_a", "home_b"]).withColumn("hole", place).select(key, "a", "b", "polygon", "hole")
    columns = [key, "polygon", "hole", "ring", "points", "doubled"]
    local = traced_parts.where("polygon >= 0").join(F.broadcast(base), [key, "strip"]).withColumn("polygon", F.col("polygon") + F.col("before"))
    return local.select(*columns).unionByName(numbered.withColumn("hole", F.lit(0)).select(*columns)).unionByName(alone.join(found, [key, "a", "b"]).select(*columns))


def polygons(border: DataFrame, key: str = "area", large: Sequence = ()) -> DataFrame:
    """Rows (key, polygon, hole, ring, points, doubled) of boundary edges: each ring with its nodes, the first again at the end.

    hole is 0 for an outer ring, holes are numbered from 1. doubled is twice the signed area
    in square degrees, negative for holes, so a key's sum is its area without holes. A
    key's rings are found in one task, which gets its keys one after the other; only keys named in ``large`` are
    traced by strips of latitude, each in a task. A ring is held by one task, as it is one row.
    """
    edges = border.select(key, F.col("u").cast("long"), F.col("v").cast("long"), "x1", "y1", "x2", "y2")
    columns = [key, "polygon", "hole", "ring", "points", "doubled"]
    whole = {"strip": F.lit(-1), "out1": F.lit(False), "out2": F.lit(False)}
    if not large:
        return _traced(edges.withColumns(whole), key).select(*columns)
    edges = cut(edges, "border")
    named = F.coalesce(F.col(key).isin(list(large)), F.lit(False))
    return _traced(edges.where(~named).withColumns(whole), key).select(*columns).unionByName(_by_strips(edges.where(named), key))


def _large(ways: DataFrame, key: str) -> list:
    """The keys whose ways have more nodes than one task traces."""
    count = ways.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(F.size("nodes")).alias("n"))
    return [r[0] for r in count.where(F.col("n") > STRIP_EDGES).select(key).collect()]


def of_ways(ways: DataFrame, nodes: DataFrame, key: str = "area") -> DataFrame:
    """The polygons (see ``polygons``) of each key's ways: outer rings without what inner rings take out. A key without a closed outer ring has no row."""
    edges = directed_edges(ways, nodes, key)
    return polygons(boundary(edges, key), key, _large(ways, key))


def dissolved(ways: DataFrame, nodes: DataFrame, groups: DataFrame, key: str = "area", group: str = "tag") -> DataFrame:
    """The polygons of each group of areas as one: ``groups`` has (key, group). Borders within a group go, as do areas listed twice."""
    # Groups are as many as areas; by the size of their file they may look small enough to be sent to all tasks.
    groups = groups.hint("merge")
    edges = boundary(directed_edges(ways, nodes, key), key).join(groups, key)
    return polygons(boundary(edges, group), group, _large(ways.select(key, "nodes").join(groups, key), group))


def junctions(rings: DataFrame, key: str) -> DataFrame:
    """Rows (node) where borders meet or their owners change: nodes of other than two edges, or of edges that belong to different keys."""
    steps = rings.select(key, F.explode(F.arrays_zip(F.slice("ring", F.lit(1), F.size("ring") - 1).alias("u"), F.slice("ring", F.lit(2), F.size("ring") - 1).alias("v"))).alias("e"))
    owners = steps.groupBy(F.least("e.u", "e.v").alias("a"), F.greatest("e.u", "e.v").alias("b")).agg(F.bit_xor(F.xxhash64(key)).alias("owners"))
    ends = owners.select("owners", F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("n"), F.min("owners").alias("one"), F.max("owners").alias("other")).where("n != 2 OR one != other").select("node")


def _arcs(ring: list[int], marked: set[int]) -> list[tuple[list[int], bool]]:
    """A ring's pieces between marked nodes, each as every ring that has it would write it, and whether that is backwards here."""
    nodes = ring[:-1]
    at = [i for i, n in enumerate(nodes) if n in marked]
    if not at:
        at = [nodes.index(min(nodes))]
    turned = nodes[at[0] :] + nodes[: at[0]]
    stops = [i - at[0] for i in at] + [len(nodes)]
    turned.append(turned[0])
    out = []
    for a, b in zip(stops[:-1], stops[1:], strict=True):
        arc = turned[a : b + 1]
        out.append((arc[::-1], True) if arc[::-1] < arc else (arc, False))
    return out


def _kept(points: list[tuple[float, float]], tolerance: float) -> tuple[list[tuple[float, float]], tuple[float, float] | None]:
    """An arc with fewer points, and the point to keep besides if that leaves only its ends and they are another arc's as well. A closed arc keeps three corners, so that no ring collapses."""
    if len(points) < 3:
        return points, None
    away = lambda a, b: max(range(1, len(points) - 1), key=lambda i: (abs((b[0] - a[0]) * (a[1] - points[i][1]) - (a[0] - points[i][0]) * (b[1] - a[1])) if a != b else math.dist(a, points[i]), -i))
    if points[0] == points[-1]:
        far = away(points[0], points[0])
        halves = points[: far + 1], points[far:]
        first, second = (simplified(h, tolerance) for h in halves)
        if len(first) + len(second) < 5:  # a needle: take the corner farthest from it
            k = away(points[0], points[far])
            return [points[0], *(points[i] for i in sorted({far, k})), points[-1]], None
        return first[:-1] + second, None
    out = simplified(points, tolerance)
    return out, points[away(points[0], points[-1])] if len(out) < 3 else None


def simplified_rings(rings: DataFrame, tolerance: float, key: str = "area") -> DataFrame:
    """``rings`` (see ``polygons``) with fewer points; areas that shared a border share every point of it afterwards.

    Rings are cut into arcs where borders meet; each arc is simplified once, whoever has it,
    and rings are put together again. No point left out is farther than the tolerance from
    its arc. Arcs are simplified apart from each other, so two that run closer than the tolerance may cross.
    """
    rings = cut(rings, "rings")
    marked = junctions(rings, key).select(F.col("node"), F.lit(True).alias("marked"))
    whole = rings.select(key, "polygon", "hole", "ring", "points")
    met = whole.select(key, "polygon", "hole", F.explode(F.array_distinct("ring")).alias("node")).join(marked, "node").groupBy(key, "polygon", "hole").agg(F.collect_set("node").alias("marked"))

    def cut_up(batches):
        for batch in batches:
            nodes, points, marks = (batch.column(batch.schema.names.index(c)) for c in ("ring", "points", "marked"))
            ends, flat, marks = nodes.offsets.to_numpy(), nodes.values.to_numpy(), marks.to_pylist()
            row, place, back, count, at = [], [], [], [], []
            for r in range(batch.num_rows):
                ring = flat[ends[r] : ends[r + 1]].tolist()
                spot = dict(zip(ring[:-1], range(ends[r], ends[r + 1] - 1), strict=True))
                for i, (arc, turned) in enumerate(_arcs(ring, set(marks[r] or ()))):
                    for out, x in ((row, r), (place, i), (back, turned), (count, len(arc))):
                        out.append(x)
                    at += [spot[n] for n in arc]
            starts, at, row = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(at, pa.int64()), pa.array(row, pa.int64())
            own = [batch.column(batch.schema.names.index(c)).take(row) for c in (key, "polygon", "hole")]
            arcs = [pa.ListArray.from_arrays(starts, x.values.take(at)) for x in (nodes, points)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(place, pa.int32()), pa.array(back, pa.bool_()), *arcs], [key, "polygon", "hole", "place", "back", "arc", "points"])

    def thin(batches):
        for pdf in batches:
            rows = []
            for arc, points in zip(pdf["arc"], pdf["points"], strict=True):
                line, at = [(q["lon"], q["lat"]) for q in points], {}
                for n, q in zip(map(int, arc), line, strict=True):
                    at.setdefault(q, n)
                spot = lambda q: {"node": at[q], "lon": q[0], "lat": q[1]}
                out, spare = _kept(line, tolerance)
                rows.append((list(map(int, arc)), [spot(q) for q in out], None if spare is None else spot(spare)))
            yield pd.DataFrame(rows, columns=["arc", "kept", "spare"])

    kind = dict(rings.dtypes)[key]
    arcs = whole.join(met, [key, "polygon", "hole"], "left").mapInArrow(cut_up, f"{key} {kind}, polygon int, hole int, place int, back boolean, arc array<long>, points array<struct<lon:double,lat:double>>")
    arcs = cut(arcs, "arcs")
    # Most arcs of a fine map are single edges: they stay as they are, and only the others are looked for among each other.
    single, longer = arcs.where(F.size("arc") == 2), arcs.where(F.size("arc") > 2)
    once = longer.groupBy("arc").agg(F.first("points").alias("points"))
    ends = lambda: [F.least(F.get("arc", F.lit(0)), F.element_at("arc", -1)).alias("low"), F.greatest(F.get("arc", F.lit(0)), F.element_at("arc", -1)).alias("high")]
    spot = "struct<node:long,lon:double,lat:double>"
    # Arcs of which nothing but common ends is left would lie on each other: only those keep one point more.
    thinned = cut(once.mapInPandas(thin, f"arc array<long>, kept array<{spot}>, spare {spot}").select("arc", "kept", "spare", *ends()), "thinned-arcs")
    straight = thinned.where("size(kept) = 2").select("low", "high")
    common = straight.unionByName(single.select(*ends()).join(straight, ["low", "high"], "left_semi").distinct()).groupBy("low", "high").agg((F.count("*") > 1).alias("common"))
    more = F.array(F.get("kept", F.lit(0)), F.col("spare"), F.element_at("kept", -1))
    fewer = thinned.join(common, ["low", "high"], "left").select("arc", F.when(F.col("common") & F.col("spare").isNotNull(), more).otherwise(F.col("kept")).alias("kept"))
    as_they_are = F.transform(F.arrays_zip("arc", "points"), lambda s: F.struct(s["arc"].alias("node"), s["points"]["lon"].alias("lon"), s["points"]["lat"].alias("lat")))
    turned = longer.drop("points").join(fewer, "arc").drop("arc").unionByName(single.withColumn("kept", as_they_are).drop("arc", "points"))
    turned = turned.withColumn("kept", F.when(F.col("back"), F.reverse("kept")).otherwise(F.col("kept")))
    inner = F.transform(F.array_sort(F.collect_list(F.struct("place", "kept"))), lambda s: F.slice(s["kept"], F.lit(1), F.size(s["kept"]) - 1))
    joined = turned.groupBy(key, "polygon", "hole").agg(F.flatten(inner).alias("open"))
    closed = F.concat("open", F.slice("open", 1, 1))
    out = joined.select(key, "polygon", "hole", F.transform(closed, lambda s: s["node"]).alias("ring"), F.transform(closed, lambda s: F.struct(s["lon"].alias("lon"), s["lat"].alias("lat"))).alias("points"))
    return out.withColumn("doubled", doubled_area("points"))


def doubled_area(points: str) -> Column:
    """Twice the signed area of a closed ring of points, taken from its first point."""
    first = F.get(F.col(points), F.lit(0))
    steps = F.arrays_zip(F.slice(points, F.lit(1), F.size(points) - 1).alias("a"), F.slice(points, F.lit(2), F.size(points) - 1).alias("b"))
    cross = F.transform(steps, lambda e: (e["a"]["lon"] - first["lon"]) * (e["b"]["lat"] - first["lat"]) - (e["b"]["lon"] - first["lon"]) * (e["a"]["lat"] - first["lat"]))
    return F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)


def inside_points(rings: DataFrame, key: str = "area") -> DataFrame:
    """Rows (key, lon, lat, width): a point inside each area, in none of its holes.

    Each polygon is cut at the latitude halfway between the corners next to the middle of its
    height, so the cut meets no corner; the point is the middle of the widest stretch inside.
    Of a key's polygons that of the widest stretch counts, of equal ones the southernmost, then the westernmost.
    """
    ends = F.arrays_zip(F.slice("points", F.lit(1), F.size("points") - 1).alias("a"), F.slice("points", F.lit(2), F.size("points") - 1).alias("b"))
    edges = rings.select(key, "polygon", F.explode(ends).alias("e")).select(key, "polygon", F.col("e.a.lon").alias("x1"), F.col("e.a.lat").alias("y1"), F.col("e.b.lon").alias("x2"), F.col("e.b.lat").alias("y2"))
    box = edges.groupBy(key, "polygon").agg(((F.min("y1") + F.max("y1")) / 2).alias("mid"))
    near = edges.join(box, [key, "polygon"]).groupBy(key, "polygon").agg(((F.max(F.when(F.col("y1") <= F.col("mid"), F.col("y1"))) + F.min(F.when(F.col("y1") > F.col("mid"), F.col("y1")))) / 2).alias("y"))
    cut = edges.join(near, [key, "polygon"]).where((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")))
    x = F.col("x1") + (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    along = Window.partitionBy(key, "polygon").orderBy("x")
    met = cut.withColumn("x", x).withColumns({"n": F.row_number().over(along), "next": F.lead("x").over(along)}).where("n % 2 = 1")
    best = F.max_by(F.struct("x", "next", "y"), F.struct((F.col("next") - F.col("x")).alias("w"), -F.col("y"), -F.col("x"))).alias("s")
    return met.groupBy(key).agg(best).select(key, ((F.col("s.x") + F.col("s.next")) / 2).alias("lon"), F.col("s.y").alias("lat"), (F.col("s.next") - F.col("s.x")).alias("width"))
