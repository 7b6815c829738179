"""Which row an object belongs to, and where a hint points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HINT_CIRCLES, HINT_KM, ISLAND_POINTS, ISLANDS, LARGE_HINTS, VILLAGE_POINTS, VILLAGES
from ..functions import geo, tags
from ..functions.text import norm

#: Keys any of which makes an object place-like, besides being a waterway relation.
PLACE_KEYS = ("place", "natural", "boundary", "waterway", "landuse")


def is_place_like(t: Column, tag_map: Column) -> Column:
    return tags.on(t, "r", tags.tag(tag_map, "type", "waterway")) | tags.has_any(tag_map, *PLACE_KEYS)


def waterway_members(relations: DataFrame, order: str = "id") -> DataFrame:
    """Rows (id, relation, name) of the member ways of waterway relations; of several relations the first."""
    rel = relations.where(tags.tag(F.col("tags"), "type", "waterway")).select(F.col("id").alias("relation"), tags.name_of(F.col("tags")).alias("name"), F.explode("members").alias("m"))
    ways = rel.where("m.type = 'w'").select(F.col("m.ref").alias("id"), "relation", "name")
    return ways.withColumn("__n", F.row_number().over(Window.partitionBy("id").orderBy("relation"))).where("__n = 1").drop("__n")


def row_for(objects: DataFrame, by_ref: DataFrame, by_item: DataFrame, members: DataFrame) -> DataFrame:
    """Objects (t, id, tags) with ``row`` and ``how``: by their own reference, else as a like-named
    member way of a waterway relation that a row holds, else by their item if they are place-like.

    ``by_ref`` has t, id and row; ``by_item`` item and row; ``members`` id, relation and name.
    An item held by an object that is not place-like is told by ``how`` = skipped.
    """
    own = by_ref.select("t", "id", F.col("row").alias("r1"))
    member = members.join(by_ref.where("t = 'r'").select(F.col("id").alias("relation"), F.col("row").alias("r2")), "relation").select(F.lit("w").alias("t"), "id", F.col("name").alias("rel_name"), "r2")
    out = objects.withColumn("item", tags.first_of(F.col("tags"), ["wikidata"])).join(own, ["t", "id"], "left").join(member, ["t", "id"], "left")
    out = out.join(by_item.select("item", F.col("row").alias("r3")), "item", "left")
    same = (F.col("tags")["name"] != "") & ((F.col("tags")["name"] == F.col("rel_name")) | (F.col("tags")["name:de"] == F.col("rel_name")))
    as_member = F.when(F.coalesce(same, F.lit(False)), F.col("r2"))
    place = is_place_like(F.col("t"), F.col("tags"))
    how = F.when(F.col("r1").isNotNull(), "reference").when(as_member.isNotNull(), "member").when(F.col("r3").isNotNull(), F.when(place, "item").otherwise("skipped"))
    row = F.coalesce("r1", as_member, F.when(place, F.col("r3")))
    return out.select(*objects.columns, row.alias("row"), how.alias("how"))


def is_island(tag_map: Column) -> Column:
    """An island, or the peninsula that one has become."""
    return tags.tag(tag_map, "place", *ISLANDS) | tags.tag(tag_map, "natural", *ISLANDS, "peninsula")


def is_a_place(tag_map: Column) -> Column:
    return tags.has_any(tag_map, "place", "natural") | tags.tag(tag_map, "boundary", "administrative")


def plausibility(lon: Column, lat: Column, tag_map: Column) -> Column:
    """Nearness to the centre, and points for islands and villages."""
    far = -geo.km_or(geo.from_centre(lon, lat), float("inf"))
    return far + F.when(is_island(tag_map), ISLAND_POINTS).otherwise(0.0) + F.when(tags.tag(tag_map, "place", *VILLAGES), VILLAGE_POINTS).otherwise(0.0)


def circle_km(key: Column, tag_map: Column) -> Column:
    """The radius of a hint's circle: large ones by their normalised name, then islands and regions, then the rest."""
    wide = is_island(tag_map) | tags.tag(tag_map, "place", "region")
    return F.when(key.isin(*LARGE_HINTS), HINT_KM["large"]).when(wide, HINT_KM["island"]).otherwise(HINT_KM["place"])


def hint_circles(hits: DataFrame, hint: str = "hint", order: str | list[str] = "id") -> DataFrame:
    """Rows (hint, lon, lat, km): the most plausible placed hit (hint, id, lon, lat, tags) of each hint, the first among equals."""
    placed = hits.where(F.col("lon").isNotNull() & F.col("lat").isNotNull() & is_a_place(F.col("tags")))
    best = placed.withColumn("__p", plausibility(F.col("lon"), F.col("lat"), F.col("tags")))
    best = best.withColumn("__n", F.row_number().over(Window.partitionBy(hint).orderBy(F.col("__p").desc(), *([order] if isinstance(order, str) else order)))).where("__n = 1")
    return best.select(hint, "lon", "lat", circle_km(norm(hint), F.col("tags")).alias("km"))


def resolved_hints(rows: DataFrame, index: DataFrame, objects: DataFrame, hint: str = "hint") -> DataFrame:
    """Rows (hint, lon, lat, km): where each distinct hint of ``rows`` lies; hints that no place has are left out.

    Only what stands before a first semicolon counts. A fixed circle goes before what the
    index (key, src, t, id) finds.
    """
    hints = rows.select(hint).where(F.col(hint).isNotNull()).distinct().withColumn("key", norm(F.substring_index(hint, ";", 1))).where("key <> ''")
    fixed = F.create_map(*[x for k, (lon, lat, km) in HINT_CIRCLES.items() for x in (F.lit(k), F.struct(F.lit(lon).alias("lon"), F.lit(lat).alias("lat"), F.lit(km).alias("km")))])
    known = hints.withColumn("c", fixed[F.col("key")])
    hits = known.where("c IS NULL").select("key").distinct().join(index, "key").join(objects.select("src", "t", "id", "lon", "lat", "tags"), ["src", "t", "id"])
    found = hint_circles(hits, "key", ["src", "t", "id"])
    out = known.join(found.withColumnsRenamed({c: f"f_{c}" for c in ("lon", "lat", "km")}), "key", "left")
    return out.select(hint, *[F.coalesce(F.col("c")[c], F.col(f"f_{c}")).alias(c) for c in ("lon", "lat", "km")]).where("km IS NOT NULL")


def in_circle(lon: Column, lat: Column, circle: Column) -> Column:
    """Whether a point lies in a circle (struct lon, lat, km); false for either unknown."""
    return F.coalesce(geo.haversine(lon, lat, circle["lon"], circle["lat"]) <= circle["km"], F.lit(False))
