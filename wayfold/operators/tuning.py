"""Map tuning: typed rows of a hand-kept list, what is wrong with them, and objects made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, tags
from ..functions.text import local_of, parse_refs, present
from .checks import problems


def typed(rows: DataFrame) -> DataFrame:
    """Rows (osm, lat, lon, set_tags, minzoom, maxzoom, polygon_km2: strings) with refs, numbers and a tag map; null for what is empty or no such value."""
    number = lambda c: present(c).try_cast("double")
    zoom = lambda c: F.when(present(c).rlike("^([0-9]|1[0-9]|2[0-4])$"), F.col(c).try_cast("int"))
    lat, lon = number("lat"), number("lon")
    good = lat.between(-90, 90) & lon.between(-180, 180)
    km2 = number("polygon_km2")
    return rows.select(
        *[c for c in rows.columns if c not in ("lat", "lon", "minzoom", "maxzoom", "polygon_km2")], parse_refs("osm").alias("refs"),
        F.when(good, lat).alias("lat"), F.when(good, lon).alias("lon"), (present("lat").isNotNull() | present("lon").isNotNull()).alias("has_position"),
        tags.parse_overrides(F.col("set_tags")).alias("changes"), zoom("minzoom").alias("minzoom"), zoom("maxzoom").alias("maxzoom"),
        F.when((km2 > 0) & (km2 < float("inf")), km2).alias("km2"), (present("polygon_km2").isNotNull() & ~F.coalesce((km2 > 0) & (km2 < float("inf")), F.lit(False))).alias("bad_km2"),
    )


def tuning_problems(rows: DataFrame, line: str = "line") -> DataFrame:
    """Rows (line, message) of what is wrong with typed rows."""
    local = local_of(F.col("refs")).isNotNull()
    node = F.get("refs", F.lit(0))["t"] == "n"
    placed = F.col("lat").isNotNull()
    island = F.coalesce(F.col("changes")["place"] == "island", F.lit(False))
    before = F.min(line).over(Window.partitionBy("osm"))
    marked = rows.withColumn("__first", before)
    return problems(
        marked, line,
        [
            (F.col("refs").isNull() | (F.size("refs") == 0), "no reference"), (F.col("__first") < F.col(line), "tuned on an earlier line"), (F.col("changes").isNull(), "malformed tags"),
            (F.col("has_position") & ~placed, "no such position"), (local & ~placed, "a local reference needs a position"), (~local & node & placed, "a node has a position of its own"),
            (~local & ~node & placed & F.col("km2").isNull(), "a position without a square"), (~local & ~node & ~placed & F.col("km2").isNotNull() & (F.size("refs") == 1), "a square needs its centre"),
            (F.col("maxzoom") < F.col("minzoom"), "maxzoom is below minzoom"), (F.col("bad_km2"), "no such size"), (F.col("km2").isNotNull() & ~island, "a square is for islands only"),
        ],
    )


def parts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Typed rows as (objects, squares, points): by object reference, squares of a size around a position, local points."""
    local = local_of(F.col("refs"))
    objects = rows.where(local.isNull()).withColumn("ref", F.explode("refs"))
    squares = rows.where(F.col("km2").isNotNull() & F.col("lat").isNotNull()).withColumn("ring", geo.square_around("lon", "lat", F.col("km2")))
    return objects, squares, rows.where(local.isNotNull()).withColumn("slug", local)


def inserted(rows: DataFrame, new: DataFrame, kind: str = "kind", line: str = "line") -> DataFrame:
    """New rows (kind, seq) put after the last row of their kind, or at the end; lines are numbered anew.

    For hand-kept lists: numbering lines puts all rows in one task.
    """
    last = rows.groupBy(kind).agg(F.max(line).alias("__at"))
    end = rows.agg(F.max(line)).first()[0] or 0
    placed = new.join(last, kind, "left").withColumn("__at", F.coalesce("__at", F.lit(end)))
    both = rows.withColumn("__at", F.col(line)).withColumn("seq", F.lit(0)).unionByName(placed.withColumn(line, F.lit(None).cast(rows.schema[line].dataType)), allowMissingColumns=True)
    return both.withColumn(line, F.row_number().over(Window.orderBy("__at", "seq"))).drop("__at", "seq")


def made_objects(points: DataFrame, highest: int, key: str = "slug") -> DataFrame:
    """Local points with ids above the highest one in use, in order of their key."""
    return points.withColumn("id", F.row_number().over(Window.orderBy(key)) + F.lit(highest))


def point_tags(kind_place: Column, name: Column, names: Column, changes: Column) -> Column:
    """Tags of a made point: the kind's place class, its name, its resolved names, then the row's changes. Null without a place class."""
    base = F.map_concat(F.map_from_arrays(F.array(F.lit("place"), F.lit("name")), F.array(F.coalesce(kind_place, F.lit("")), name)), names)
    out = tags.overlaid(F.map_filter(base, lambda k, v: v != ""), F.coalesce(changes, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    return F.when(tags.tag(out, "place"), out)
