"""Positions, distances and outlines as Column expressions. Unknown coordinates are null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CLUSTER_KM, CORE_KM, CORE_PLACES, EARTH_KM, HOME_BOX, HOME_CENTRE, KM_PER_DEGREE, RIVER_KM, STRETCH_KM


def _col(c: Column | str | float) -> Column:
    return F.col(c) if isinstance(c, str) else F.lit(c) if isinstance(c, (int, float)) else c


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle kilometres; null if any coordinate is."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.when(a > 1, F.lit(1.0)).otherwise(F.sqrt(a)))


def from_centre(lon, lat) -> Column:
    return haversine(lon, lat, *HOME_CENTRE)


def km_or(km, unknown: float) -> Column:
    """A null distance as ``unknown``; zero is a distance."""
    return F.coalesce(_col(km), F.lit(float(unknown)))


def in_box(lon, lat, box: tuple[float, float, float, float] = HOME_BOX) -> Column:
    """Whether a point lies in a closed box; false for an unknown position."""
    w, s, e, n = box
    return F.coalesce(_col(lon).between(w, e) & _col(lat).between(s, n), F.lit(False))


def linear_km(t: Column, tags: Column) -> Column:
    """How far apart two pieces of one linear feature may be: 30 km for waterways, 5 km for roads and dykes, else null."""
    river = F.coalesce(tags["waterway"], F.lit("")) != ""
    stretch = (F.coalesce(tags["highway"], F.lit("")) != "") | F.coalesce(tags["man_made"].isin("dyke", "embankment"), F.lit(False))
    return F.when(t != "w", F.lit(None)).when(river, F.lit(RIVER_KM)).when(stretch, F.lit(STRETCH_KM)).cast("double")


def is_core(t: Column, tags: Column) -> Column:
    """Whether an object is the node of a settlement of its own."""
    return F.coalesce((t == "n") & tags["place"].isin(*CORE_PLACES), F.lit(False))


def reach(a: Column, b: Column) -> Column:
    """Kilometres up to which two objects (structs t, tags) may be one feature."""
    return reach_of(is_core(a["t"], a["tags"]), linear_km(a["t"], a["tags"]), is_core(b["t"], b["tags"]), linear_km(b["t"], b["tags"]))


def reach_of(core_a: Column, linear_a: Column, core_b: Column, linear_b: Column) -> Column:
    """The same from what is known of both: settlement nodes, and kilometres of linear features (null: none)."""
    far = F.greatest(F.coalesce(linear_a, F.lit(CLUSTER_KM)), F.coalesce(linear_b, F.lit(CLUSTER_KM)))
    return F.when(core_a & core_b, F.lit(CORE_KM)).otherwise(far)


def same_feature(a: Column, b: Column) -> Column:
    """Whether two objects (structs lon, lat, t, tags) lie within their reach; false for an unknown position."""
    return F.coalesce(haversine(a["lon"], a["lat"], b["lon"], b["lat"]) <= reach(a, b), F.lit(False))


def admin_level(tags: Column) -> Column:
    """The level as a number, 0 without one."""
    return F.coalesce(F.when(tags["admin_level"].rlike("^[0-9]+$"), tags["admin_level"].try_cast("int")), F.lit(0))


def square_around(lon, lat, km2) -> Column:
    """The corners of a square of so many square kilometres, as array of struct(lon, lat), counter-clockwise from the south-west."""
    lon, lat, half = _col(lon), _col(lat), F.sqrt(_col(km2)) / 2 / KM_PER_DEGREE
    wide = half / F.cos(F.radians(lat))
    return F.array(*[F.struct((lon + x * wide).alias("lon"), (lat + y * half).alias("lat")) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))])


def ring_sum(ring: Column) -> Column:
    """Twice the signed area of a ring in square degrees; the ring may be closed or not."""
    pairs = F.arrays_zip(ring.alias("a"), F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)).alias("b"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["a"]["lon"] * p["b"]["lat"] - p["b"]["lon"] * p["a"]["lat"])


def ring_km2(ring: Column) -> Column:
    """The planar area of a ring, scaled at the mean latitude of its points."""
    mean = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / F.size(ring)
    return F.abs(ring_sum(ring)) / 2 * F.lit(KM_PER_DEGREE**2) * F.cos(F.radians(mean))


def covers(ring: Column, lon, lat) -> Column:
    """Whether a ring covers a point, its edge included (even-odd rule)."""
    lon, lat = _col(lon), _col(lat)
    pairs = F.arrays_zip(ring.alias("a"), F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)).alias("b"))

    def side(p: Column) -> Column:
        return (p["b"]["lon"] - p["a"]["lon"]) * (lat - p["a"]["lat"]) - (p["b"]["lat"] - p["a"]["lat"]) * (lon - p["a"]["lon"])

    def on_edge(p: Column) -> Column:
        x = lon.between(F.least(p["a"]["lon"], p["b"]["lon"]), F.greatest(p["a"]["lon"], p["b"]["lon"]))
        return (side(p) == 0) & x & lat.between(F.least(p["a"]["lat"], p["b"]["lat"]), F.greatest(p["a"]["lat"], p["b"]["lat"]))

    def crossing(p: Column) -> Column:
        up = (p["a"]["lat"] > lat) != (p["b"]["lat"] > lat)
        right = F.when(p["b"]["lat"] > p["a"]["lat"], side(p) > 0).otherwise(side(p) < 0)
        return F.when(up & right, F.lit(1)).otherwise(F.lit(0))

    return F.exists(pairs, on_edge) | (F.aggregate(pairs, F.lit(0), lambda n, p: n + crossing(p)) % 2 == 1)


def tile_of(lon, lat, zoom: int) -> Column:
    """Web-mercator tile as struct(x, y)."""
    n = float(1 << zoom)
    r = F.radians(_col(lat))
    y = (F.lit(1.0) - F.log(F.tan(r) + F.lit(1.0) / F.cos(r)) / F.lit(math.pi)) / 2 * F.lit(n)
    return F.struct(((_col(lon) + 180.0) / 360.0 * F.lit(n)).cast("int").alias("x"), y.cast("int").alias("y"))


def tile_point(x, y, px, py, zoom: int, extent: int = 4096) -> Column:
    """A point of a tile in degrees, as struct(lon, lat)."""
    n = float(1 << zoom)
    u, v = (_col(x) + _col(px) / float(extent)) / n, (_col(y) + _col(py) / float(extent)) / n
    return F.struct((u * 360.0 - 180.0).alias("lon"), F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - 2.0 * v)))).alias("lat"))


def circle_ring(lon, lat, km, points: int = 48) -> Column:
    """A closed circle of ``points`` + 1 points, as array of struct(lon, lat)."""
    lon, lat, r = _col(lon), _col(lat), _col(km) / KM_PER_DEGREE
    turn = lambda i: F.lit(2 * math.pi / points) * i
    return F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: F.struct((lon + r * F.cos(turn(i)) / F.greatest(F.lit(0.1), F.cos(F.radians(lat)))).alias("lon"), (lat + r * F.sin(turn(i))).alias("lat")))


def centroid(points: Column) -> Column:
    """The mean of at most 23 of the points, taken at even steps, as struct(lon, lat); null for none."""
    step = F.greatest(F.lit(1), F.floor(F.size(points) / 12).cast("int"))
    taken = F.filter(points, lambda p, i: (i % step == 0) & p["lon"].isNotNull() & p["lat"].isNotNull())
    mean = lambda k: F.aggregate(taken, F.lit(0.0), lambda s, p: s + p[k].cast("double")) / F.size(taken)
    return F.when(F.size(taken) > 0, F.struct(mean("lon").alias("lon"), mean("lat").alias("lat")))


def first_position(points: Column) -> Column:
    """The first usable of the first, middle and last point."""
    ok = lambda p: F.when(p["lon"].isNotNull() & p["lat"].isNotNull(), p)
    return F.coalesce(ok(F.get(points, F.lit(0))), ok(F.get(points, F.floor(F.size(points) / 2).cast("int"))), ok(F.get(points, F.size(points) - 1)))
