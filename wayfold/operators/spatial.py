"""Distance and containment joins on a grid, so that each is an equi-join on cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import KM_PER_DEGREE
from ..functions.geo import covers, haversine, ring_km2
from ..sources.tables import cut

#: Latitude up to which pairs are found; beyond it a degree of longitude is next to nothing.
MOST_LATITUDE = 88.0
#: Pairs of rows in neighbouring cells that a part of a cell, and a task, hold against each other.
PAIRS_OF_PART, PAIRS_OF_TASK = 2_000_000, 8_000_000
#: Sizes of cells among which a search for the nearest row chooses, each half of the one before.
LEVELS = 12


def _high(km):
    """Degrees of latitude that are a little more than ``km``: the height of a row of cells."""
    return km / KM_PER_DEGREE * 1.01


def _wide(row: Column, km) -> Column:
    """The width in degrees of the cells of a row: the distance at the latitude that its neighbours reach on the side of the pole."""
    high = _high(km)
    return high / F.cos(F.radians(F.least(F.greatest(F.abs(row * high), F.abs((row + 1) * high)) + high, F.lit(89.5))))


def _cells(lon: Column, lat: Column, km, around: bool) -> Column:
    """The cell of a point, or all cells that points within ``km`` of it can be in, as packed longs.

    Rows of cells are as high as the distance, and a row's cells as wide, so of each of three rows three cells are enough.
    """
    row = F.floor(lat / _high(km))
    cells = lambda y, steps: [(F.floor(lon / _wide(y, km)) + x) * F.lit(1 << 32) + y for x in steps]
    return F.array(*[c for b in (-1, 0, 1) for c in cells(row + b, (-1, 0, 1))]) if around else F.array(*cells(row, (0,)))


def _far(c: Column, km: float) -> Column:
    """A latitude, or an error where it is too near to a pole for pairs within ``km``."""
    return F.when(F.abs(c) + km / KM_PER_DEGREE > MOST_LATITUDE, F.raise_error(F.lit("too near to a pole")).cast("double")).otherwise(c)


def within(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """Pairs of rows at most ``km`` apart, with ``km``; both sides have lon and lat, and no other name in common.

    The right side is put into the nine cells around each row, the left into its own. Rows
    without a position pair with none. A latitude beyond MOST_LATITUDE is an error, as is a
    distance that reaches beyond; pairs across the 180th meridian are not looked for.

    Pairs are counted by cell first, and the left rows of a full cell are dealt out, so that a
    task makes about PAIRS_OF_TASK of them however many there are and wherever they lie.
    """
    return _pairs(*[side.withColumn("lat", _far(F.col("lat"), km)) for side in (left, right)], km)


def _pairs(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    a = left.withColumn("__cell", F.get(_cells(F.col("lon"), F.col("lat"), km, False), F.lit(0))).where("__cell IS NOT NULL")
    b = right.withColumnsRenamed({"lon": "lon2", "lat": "lat2"}).withColumn("__cell", F.explode(_cells(F.col("lon2"), F.col("lat2"), km, True))).where("__cell IS NOT NULL")
    count = lambda rows, n: rows.groupBy("__cell").agg(F.count("*").alias(n))
    both = count(a, "__n").join(count(b, "__m"), "__cell").withColumn("__pairs", F.col("__n") * F.col("__m"))
    cells = cut(both.select("__cell", "__pairs", F.ceil(F.col("__pairs") / PAIRS_OF_PART).alias("__parts")), "pair-cells")
    pairs = cells.agg(F.sum("__pairs")).first()[0] or 0
    tasks = max(1, math.ceil(pairs / PAIRS_OF_TASK), min(pairs // PAIRS_OF_PART, left.sparkSession.sparkContext.defaultParallelism))
    # A row's part depends on what it holds and not on where it was read, so that a task done again deals alike.
    plain = [c for c, t in left.dtypes if not t.startswith(("map", "array", "struct", "variant"))]
    parts = cells.select("__cell", "__parts")
    a = a.join(parts, "__cell").withColumn("__part", F.pmod(F.xxhash64(*plain), "__parts")).drop("__parts").repartition(tasks, "__cell", "__part")
    b = b.join(parts, "__cell").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))).drop("__parts").repartition(tasks, "__cell", "__part")
    # The box around a row spares most of the pairs that are too far the sines.
    boxed = (F.abs(F.col("lat2") - F.col("lat")) <= _high(km)) & (F.abs(F.col("lon2") - F.col("lon")) <= F.col("__wide"))
    a = a.withColumn("__wide", _wide(F.floor(F.col("lat") / _high(km)), km))
    return a.join(b.hint("shuffle_hash"), ["__cell", "__part"]).where(boxed).withColumn("km", haversine("lon", "lat", "lon2", "lat2")).where(F.col("km") <= km).drop("__cell", "__part", "__wide")


def _least_ranks(places: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """Places (lon, lat) with ``__rank``: the least rank of the right rows (lon2, lat2, __rank) within ``km``; places without any are left out.

    Cells of both sides are held against each other first: where a cell is near as a whole, its
    ranks are sure, and only rows of lesser ranks in cells that are near in part are looked at.
    """
    side = km / 5
    row = lambda lat: F.floor(lat / _high(side))
    in_cell = lambda rows, lon, lat, y, x: rows.withColumn(y, row(F.col(lat))).withColumn(x, F.floor(F.col(lon) / _wide(F.col(y), side)))

    def centred(cells: DataFrame, y: str, x: str, reach: str) -> DataFrame:
        """Cells with their middle (lon, lat) and the distance from it to the farthest corner."""
        wide, south = _wide(F.col(y), side), F.col(y) * _high(side)
        out = cells.withColumns({"lon": (F.col(x) + 0.5) * wide, "lat": south + _high(side) / 2})
        corner = lambda lat: haversine("lon", "lat", F.col(x) * wide, lat)
        return out.withColumn(reach, F.greatest(corner(south), corner(south + _high(side))) * 1.001)

    a, b = cut(in_cell(places, "lon", "lat", "__y", "__x"), "near-places"), cut(in_cell(right, "lon2", "lat2", "__v", "__u"), "near-others")
    # The middles of cells that hold a pair are farther apart by two half diagonals at most.
    middles = _pairs(centred(a.select("__y", "__x").distinct(), "__y", "__x", "__r"), centred(b.select("__v", "__u", "__rank").distinct(), "__v", "__u", "__s"), km * 1.35)
    middles = cut(middles.where(F.col("km") <= km + F.col("__r") + F.col("__s")).select("__y", "__x", "__v", "__u", "__rank", (F.col("km") + F.col("__r") + F.col("__s") <= km).alias("__whole")), "near-cells")
    sure = middles.where("__whole").groupBy("__y", "__x").agg(F.min("__rank").alias("__sure"))
    maybe = middles.where("not __whole").join(sure, ["__y", "__x"], "left").where(F.col("__sure").isNull() | (F.col("__rank") < F.col("__sure"))).drop("__whole", "__sure")
    tried = a.join(maybe, ["__y", "__x"]).join(b, ["__v", "__u", "__rank"]).where(haversine("lon", "lat", "lon2", "lat2") <= km)
    found = tried.groupBy("lon", "lat").agg(F.min("__rank").alias("__found"))
    both = a.join(sure, ["__y", "__x"], "left").join(found, ["lon", "lat"], "left")
    return both.select("lon", "lat", F.least("__sure", "__found").alias("__rank")).where("__rank IS NOT NULL")


def nearest(left: DataFrame, right: DataFrame, key: list[str], km: float, rank: Column, tie: Column) -> DataFrame:
    """For each left key the right row within ``km`` of the least rank, of those the nearest, of those the first by ``tie``; none without any.

    ``rank`` (a number, unknown ones last) and ``tie`` are columns of the right side. The rest is as in ``within``, but not all pairs are
    made: a place's least rank is found by cells, and the nearest row of that rank in cells of
    about the distance of one that is known. So the pairs do not grow with how many rows are near.
    """
    a = left.withColumn("lat", _far(F.col("lat"), km))
    others = right.withColumnsRenamed({"lon": "lon2", "lat": "lat2"}).withColumns({"lat2": _far(F.col("lat2"), km), "__rank": F.coalesce(rank.cast("double"), F.lit(float("inf"))), "__tie": tie})
    others = others.where("lon2 IS NOT NULL AND lat2 IS NOT NULL")
    first = Window.partitionBy("lon2", "lat2", "__rank").orderBy("__tie")
    others = cut(others.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n"), "nearest-others")
    places = a.select("lon", "lat").where("lon IS NOT NULL AND lat IS NOT NULL").distinct()
    ranked = cut(_least_ranks(places, others.select("lon2", "lat2", "__rank"), km), "nearest-ranks")

    # Cells of halved sizes: a row of the rank in a place's own cell says how far the nearest is at most.
    at = lambda level: F.lit(km) / F.pow(F.lit(2.0), level)
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))
    own = lambda rows, lon, lat: rows.withColumn("__level", levels).withColumn("__cell", F.get(_cells(F.col(lon), F.col(lat), at(F.col("__level")), False), F.lit(0)))
    grid = own(others, "lon2", "lat2")
    one = grid.groupBy("__rank", "__level", "__cell").agg(F.min(F.struct("lon2", "lat2")).alias("__one"))
    known = own(ranked, "lon", "lat").join(one, ["__rank", "__level", "__cell"], "left").groupBy("lon", "lat", "__rank").agg(F.min(haversine("lon", "lat", F.col("__one.lon2"), F.col("__one.lat2"))).alias("__most"))
    finest = F.floor(F.log2(F.lit(km) / F.greatest(F.coalesce("__most", F.lit(km)), F.lit(km / 2**LEVELS))) - 1e-6)
    known = known.withColumn("__level", F.greatest(F.least(finest, F.lit(LEVELS - 1)), F.lit(0)).cast("int"))
    around = known.withColumn("__cell", F.explode(_cells(F.col("lon"), F.col("lat"), at(F.col("__level")), True))).drop("__most")
    near = around.join(grid, ["__rank", "__level", "__cell"]).withColumn("km", haversine("lon", "lat", "lon2", "lat2")).where(F.col("km") <= km)
    best = near.withColumn("__n", F.row_number().over(Window.partitionBy("lon", "lat").orderBy("km", "__tie"))).where("__n = 1").drop("__n", "__level", "__cell")
    pairs = a.join(best, ["lon", "lat"])
    return pairs.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("__rank", "km", "__tie"))).where("__n = 1").drop("__n", "__rank", "__tie")


def in_boxes(points: DataFrame, boxes: DataFrame, degrees: float = 0.25) -> DataFrame:
    """Pairs of points (lon, lat) and closed boxes (west, south, east, north) that hold them."""
    to = lambda c: F.floor(F.col(c) / degrees)
    cell = lambda x, y: x * F.lit(1 << 32) + y
    a = points.withColumn("__cell", cell(to("lon"), to("lat")))
    b = boxes.withColumn("__x", F.explode(F.sequence(to("west"), to("east")))).withColumn("__y", F.explode(F.sequence(to("south"), to("north")))).withColumn("__cell", cell(F.col("__x"), F.col("__y"))).drop("__x", "__y")
    return a.join(b, "__cell").where(F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))).drop("__cell")


def with_box(areas: DataFrame, ring: str = "ring") -> DataFrame:
    """Areas with the box of their ring and, unless there, its size as ``km2``."""
    least = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    out = areas.select("*", least(F.array_min, "lon").alias("west"), least(F.array_min, "lat").alias("south"), least(F.array_max, "lon").alias("east"), least(F.array_max, "lat").alias("north"))
    return out if "km2" in areas.columns else out.withColumn("km2", ring_km2(F.col(ring)))


def smallest_area(points: DataFrame, areas: DataFrame, key: list[str], tag: str = "tag") -> DataFrame:
    """Points with ``tag`` of the smallest area that covers them, edges included; null for none.

    Areas have tag and either ring (array of lon, lat) or a box and km2. Equal sizes go by tag.
    """
    rings = "ring" in areas.columns
    held = in_boxes(points, with_box(areas) if rings else areas)
    if rings:
        held = held.where(covers(F.col("ring"), "lon", "lat"))
    first = held.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("km2", tag))).where("__n = 1").select(*key, tag)
    return points.join(first, key, "left")


def area_of_two_points(points: DataFrame, areas: DataFrame, key: list[str], tag: str = "tag") -> DataFrame:
    """The area of the inside point (lon, lat), else of the outline point (lon2, lat2)."""
    inside = smallest_area(points.select(*key, "lon", "lat"), areas, key, tag).select(*key, F.col(tag).alias("__a"))
    outline = smallest_area(points.select(*key, F.col("lon2").alias("lon"), F.col("lat2").alias("lat")), areas, key, tag).select(*key, F.col(tag).alias("__b"))
    return points.join(inside, key, "left").join(outline, key, "left").withColumn(tag, F.coalesce("__a", "__b")).drop("__a", "__b")
