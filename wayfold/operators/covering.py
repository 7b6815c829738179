"""Which area covers a point, over quadtree cells of several sizes.

A polygon of few edges is in the up to four cells that its box meets in a grid whose cells are
about as large as the box. One of more edges is covered by a bounded number of quadtree cells: a cell
that no edge touches lies wholly inside, so a point in it needs no test. All other points are held
against the polygon's edges, holes included. A point looks up one cell for each size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a polygon at most (four at least, and no more than its edges and eight), and halvings of the world after which no cell is cut.
MOST_CELLS, DEEPEST = 256, 24
#: Edges of a polygon that has no quadtree cells of its own; the least size of grid cells, as a power of two of the mean box, and what tells its sizes from quadtree levels.
FEW_EDGES, LEAST_GRID, GRIDS = 64, -8, 128
#: Fixed value: the level of municipalities; areas above it have no variety of their own.
MUNICIPALITY_LEVEL = 8
CELLS = "polygon int, level int, cell long, full boolean, west double, south double, east double, north double, size double, wide double, high double"


def _touching(edges: np.ndarray, west: float, south: float, east: float, north: float) -> np.ndarray:
    """Which edges (x1, y1, x2, y2) meet a closed box, its border included; in doubt they do."""
    x1, y1, x2, y2 = edges.T
    near = (np.minimum(x1, x2) <= east) & (np.maximum(x1, x2) >= west) & (np.minimum(y1, y2) <= north) & (np.maximum(y1, y2) >= south)
    side = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (west, east) for y in (south, north)]
    slack = 1e-12 * (np.abs(x2 - x1) + np.abs(y2 - y1))
    return near & (np.minimum.reduce(side) <= slack) & (np.maximum.reduce(side) >= -slack)


def _odd(edges: np.ndarray, x: float, y: float) -> bool:
    x1, y1, x2, y2 = edges.T
    over = (y1 > y) != (y2 > y)
    x1, y1, x2, y2 = x1[over], y1[over], x2[over], y2[over]
    return bool(np.count_nonzero(x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x) % 2)


def _home(edges: np.ndarray, deepest: int) -> tuple[int, int, int]:
    """The smallest cell (level, column, row) that has all edges well inside."""
    x, y = edges[:, ::2], edges[:, 1::2]
    low = int((x.min() - 1e-9 + 180) / 360 * 2**deepest // 1), int((y.min() - 1e-9 + 90) / 180 * 2**deepest // 1)
    high = int((x.max() + 1e-9 + 180) / 360 * 2**deepest // 1), int((y.max() + 1e-9 + 90) / 180 * 2**deepest // 1)
    if min(low) < 0 or max(high) >= 2**deepest:
        return 0, 0, 0
    up = max((a ^ b).bit_length() for a, b in zip(low, high, strict=True))
    return deepest - up, low[0] >> up, low[1] >> up


def cells_of(edges: np.ndarray, most: int = MOST_CELLS, deepest: int = DEEPEST) -> list[tuple[int, int, int, bool]]:
    """Cells (level, column, row, full) that cover a polygon of edges; the largest cells at a border are cut first, as long as the number allows."""
    box = lambda level, i, j: (-180 + i * 360 / 2**level, -90 + j * 180 / 2**level, -180 + (i + 1) * 360 / 2**level, -90 + (j + 1) * 180 / 2**level)
    full: list[tuple[int, int, int, bool]] = []
    border = [(*_home(edges, deepest), edges)]
    most = max(4, min(most, len(edges) + 8))
    while border:
        level = border[0][0]
        grown, inner = [], []
        for _, i, j, own in border:
            for a, b in ((2 * i, 2 * j), (2 * i + 1, 2 * j), (2 * i, 2 * j + 1), (2 * i + 1, 2 * j + 1)):
                w, s, e, n = box(level + 1, a, b)
                mine = own[_touching(own, w, s, e, n)]
                if len(mine):
                    grown.append((level + 1, a, b, mine))
                elif _odd(edges, (w + e) / 2, (s + n) / 2):
                    inner.append((level + 1, a, b, True))
        if level + 1 > deepest or len(full) + len(inner) + len(grown) > most:
            break
        full += inner
        border = grown
    return full + [(level, i, j, False) for level, i, j, _ in border]


def covering(rings: DataFrame, key: str = "tag", most: int = MOST_CELLS) -> DataFrame:
    """Rows (key, polygon, level, cell, full, west, south, east, north: the box of the polygon, size: twice its area, wide, high: of the cell) that cover each polygon of ``rings`` (see ``areas.polygons``).

    A polygon of FEW_EDGES at most has four cells at most, another ``most``, four at least.
    """
    return _cover(with_edges(rings, key), key, most)


def _cover(whole: DataFrame, key: str, most: int = MOST_CELLS) -> DataFrame:
    """``covering`` of polygons with their edges (see ``with_edges``)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for tag, polygon, size, *ends in zip(*(pdf[c] for c in (key, "polygon", "size", "x1", "y1", "x2", "y2")), strict=True):
                edges = np.column_stack(ends)
                box = (*edges[:, :2].min(axis=0).tolist(), *edges[:, :2].max(axis=0).tolist())
                rows += [(tag, polygon, level, (i << 32) + j, full, *box, size, 360.0 / 2**level, 180.0 / 2**level) for level, i, j, full in cells_of(edges, most)]
            yield pd.DataFrame(rows, columns=columns)

    columns = [key, "polygon", *[c.split()[0] for c in CELLS.split(", ")[1:]]]
    many = F.size("edges") > FEW_EDGES
    cut_up = whole.where(many).select(key, "polygon", "size", *[F.col(f"edges.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    cells = cut_up.mapInPandas(run, f"{key} {dict(whole.dtypes)[key]}, {CELLS}")
    # Edges make closed rings, so their first ends are all corners.
    box = {c: f(F.col(f"edges.{end}")) for c, f, end in (("west", F.array_min, "x1"), ("south", F.array_min, "y1"), ("east", F.array_max, "x1"), ("north", F.array_max, "y1"))}
    few = whole.where(~many).select(key, "polygon", "size", *[c.alias(n) for n, c in box.items()])
    wide, high = (x or 1.0 for x in few.agg(F.avg(F.col("east") - F.col("west")), F.avg(F.col("north") - F.col("south"))).first())
    part = F.greatest((F.col("east") - F.col("west")) / wide, (F.col("north") - F.col("south")) / high, F.lit(2.0**LEAST_GRID))
    few = few.withColumn("step", F.ceil(F.log2(part)).cast("int"))
    few = few.withColumns({"level": F.col("step") + GRIDS, "full": F.lit(False), "wide": F.lit(wide) * F.pow(F.lit(2.0), "step"), "high": F.lit(high) * F.pow(F.lit(2.0), "step")})
    span = lambda low, high, size, start: F.explode(F.sequence(_place(F.col(low), F.col(size), start), _place(F.col(high), F.col(size), start)))
    few = few.withColumn("i", span("west", "east", "wide", -180.0)).withColumn("j", span("south", "north", "high", -90.0)).withColumn("cell", _packed(F.col("i"), F.col("j")))
    return cells.unionByName(few.select(*columns))


def with_edges(rings: DataFrame, key: str) -> DataFrame:
    """Rows (key, polygon, edges, size) of rings: each polygon's edges (structs x1, y1, x2, y2), those of holes among them, and twice its area."""
    steps = F.arrays_zip(F.slice("points", F.lit(1), F.size("points") - 1).alias("a"), F.slice("points", F.lit(2), F.size("points") - 1).alias("b"))
    edges = F.transform(steps, lambda e: F.struct(e["a"]["lon"].alias("x1"), e["a"]["lat"].alias("y1"), e["b"]["lon"].alias("x2"), e["b"]["lat"].alias("y2")))
    return rings.groupBy(key, "polygon").agg(F.flatten(F.collect_list(edges)).alias("edges"), F.sum("doubled").alias("size"))


def _place(x: Column, size: Column, start: float) -> Column:
    return F.floor((x - start) / size).cast("long")


def _packed(i: Column, j: Column) -> Column:
    return F.shiftleft(i, 32).bitwiseXOR(j)


def _cell(lon: Column, lat: Column, level: Column, wide: Column, high: Column) -> Column:
    """The cell of a point; the map's eastern and northern borders are in the last quadtree cells."""
    last = F.when(level < GRIDS, F.call_function("shiftleft", F.lit(1).cast("long"), F.least(level, F.lit(DEEPEST + 1))) - 1)
    at = lambda x, size, start: F.least(_place(x, size, start), last)
    return _packed(at(lon, wide, -180.0), at(lat, high, -90.0))


def _inside(edges: Column, x: Column, y: Column) -> Column:
    """Whether edges (structs x1, y1, x2, y2) hold a point, those of holes among them; a point on an edge counts."""
    side = lambda e: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    on = lambda e: (side(e) == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
    crossed = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & F.when(e["y2"] > e["y1"], side(e) > 0).otherwise(side(e) < 0)
    # Most edges are above or below the point: they go first, by the cheapest test. One on the point makes the sum negative for good.
    level = F.filter(edges, lambda e: ((e["y1"] <= y) & (e["y2"] >= y)) | ((e["y2"] <= y) & (e["y1"] >= y)))
    return F.aggregate(level, F.lit(0).cast("long"), lambda s, e: F.when(on(e), s - (1 << 40)).when(crossed(e), s + 1).otherwise(s), lambda s: (s < 0) | (s % 2 == 1))


def covered_by(points: DataFrame, rings: DataFrame, keys: list[str], tag: str = "tag", cover: DataFrame | None = None, whole: DataFrame | None = None) -> DataFrame:
    """Rows (keys, tag, polygon, size) of points (keys, lon, lat) and the polygons that cover them, edges included."""
    whole = with_edges(rings, tag) if whole is None else whole
    cover = _cover(whole, tag) if cover is None else cover
    levels = [F.struct(F.lit(level).cast("int").alias("level"), F.lit(wide).cast("double").alias("wide"), F.lit(high).cast("double").alias("high")) for level, wide, high in sorted(cover.select("level", "wide", "high").distinct().collect())]
    if not levels:
        levels = [F.lit(None).cast("struct<level:int,wide:double,high:double>")]
    own = [*keys, *[c for c in ("lon", "lat") if c not in keys]]
    at = points.where("lon IS NOT NULL AND lat IS NOT NULL").select(*own, F.explode(F.array(*levels)).alias("s"))
    at = at.select(*own, "s.level", _cell(F.col("lon"), F.col("lat"), F.col("s.level"), F.col("s.wide"), F.col("s.high")).alias("cell"))
    hits = at.join(cover.drop("wide", "high"), ["level", "cell"]).where("lon BETWEEN west AND east AND lat BETWEEN south AND north")
    sure = hits.where("full").select(*keys, tag, "polygon", "size")
    tested = hits.where("NOT full").drop("size").join(whole, [tag, "polygon"]).where(_inside(F.col("edges"), F.col("lon"), F.col("lat")))
    return sure.unionByName(tested.select(*keys, tag, "polygon", "size"))


def smallest(points: DataFrame, rings: DataFrame, keys: list[str], tag: str = "tag", cover: DataFrame | None = None, whole: DataFrame | None = None) -> DataFrame:
    """Rows (keys, tag) of points that some polygon covers: the tag of the smallest; equal sizes go by tag."""
    found = covered_by(points, rings, keys, tag, cover, whole)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("size", tag))
    return found.withColumn("__n", first).where("__n = 1").select(*keys, tag)


def variety_of(objects: DataFrame, rings: DataFrame, keys: list[str], tag: str = "tag") -> DataFrame:
    """``objects`` (keys, lon, lat, lon2, lat2, admin_level) with ``tag``: of the area around the point, else of that around the outline point.

    An administrative area above municipality level has none; an unknown level is no reason.
    A position is looked up once, however many objects are there.
    """
    from ..sources.tables import cut

    whole = cut(with_edges(rings, tag), "area-edges")
    cover = cut(_cover(whole, tag), "area-cells")
    able = F.coalesce("admin_level", F.lit(MUNICIPALITY_LEVEL)) >= MUNICIPALITY_LEVEL
    both = F.array(*[F.struct(F.col(x).cast("double").alias("lon"), F.col(y).cast("double").alias("lat")) for x, y in (("lon", "lat"), ("lon2", "lat2"))])
    spots = objects.where(able).select(F.explode(both).alias("p")).select("p.*").where("lon IS NOT NULL AND lat IS NOT NULL").distinct()
    found = cut(smallest(spots, rings, ["lon", "lat"], tag, cover, whole), "area-spots")
    out = objects
    for n, x, y in ((1, "lon", "lat"), (2, "lon2", "lat2")):
        # What has no position is dealt out by its key: it meets nothing, as there is no such longitude.
        nowhere = F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) + F.lit(1000.0)
        there = able & F.col(x).isNotNull() & F.col(y).isNotNull()
        out = out.withColumns({f"__x{n}": F.when(there, F.col(x).cast("double")).otherwise(nowhere), f"__y{n}": F.when(there, F.col(y).cast("double")).otherwise(0.0)})
        out = out.join(found.select(F.col("lon").alias(f"__x{n}"), F.col("lat").alias(f"__y{n}"), F.col(tag).alias(f"__tag{n}")), [f"__x{n}", f"__y{n}"], "left")
    return out.select(*objects.columns, F.coalesce("__tag1", "__tag2").alias(tag))
