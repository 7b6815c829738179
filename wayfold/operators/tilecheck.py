"""Labelled features of tiles held against the search entries whose objects they are.

A feature has osm (``node/1``, null for a made one), props (map of strings) and lon, lat for a
point; an entry has id, osm, names (map by tag), lon, lat and the fields of ``TILE_KEYS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import format_refs, local_of, parse_refs, present
from .namelist import TILE_KEYS, dialect_key

SQUARE = "place:square"
#: Degrees that a point may be off.
TOLERANCE = 1e-4


def is_square(props: Column) -> Column:
    """Whether a feature is a made square."""
    return F.coalesce(props[SQUARE] == "yes", F.lit(False))


def is_point_object(osm: Column, props: Column, lon: Column) -> Column:
    """Whether a point stands where its object does: a node, a made node or a square; other ways and relations are labelled anywhere."""
    nodes = F.forall(parse_refs(osm), lambda r: r["t"] == "n")
    return lon.isNotNull() & (is_square(props) | F.coalesce(nodes, F.lit(False)))


def is_entry_object(entry_osm: Column, osm: Column, props: Column) -> Column:
    """Whether a feature is the entry's first reference; a place of our own and a square always are."""
    refs = parse_refs(entry_osm)
    first = F.coalesce(present(osm) == format_refs(F.slice(refs, 1, 1)), F.lit(False))
    return F.coalesce(local_of(refs).isNotNull(), F.lit(False)) | is_square(props) | first


def _held(features: DataFrame, entries: DataFrame) -> DataFrame:
    both = features.withColumn("id", F.col("props")[TILE_KEYS["id"]]).join(entries.select("id", F.struct(*[c for c in entries.columns if c != "id"]).alias("entry")), "id")
    return both.where(is_entry_object(F.col("entry.osm"), F.col("osm"), F.col("props")))


def checked_entries(features: DataFrame, entries: DataFrame) -> DataFrame:
    """Ids of entries whose own object is among the features, each once."""
    return _held(features, entries).select("id").distinct()


def disagreements(features: DataFrame, entries: DataFrame, varieties: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (keep, id, osm, field, key, said, shown) of what a feature shows and its entry says otherwise.

    Empty fields of an entry are null, and so is what neither has. A German name that the list
    has not may be anything. Positions are compared for points that stand where their object does.
    """
    e, props = F.col("entry"), F.col("props")
    of_fields = [f for f in ("kind", "name_de", "dialect", "local", "variety") if f in entries.columns]
    pairs = [(f, F.lit(TILE_KEYS[f]), present(e[f])) for f in of_fields] + [(f"names[{t}]", dialect_key(t), e["names"][t]) for t in varieties]

    def told(field: str, key: Column, said: Column) -> Column:
        off = ~said.eqNullSafe(props[key])
        if field == "name_de":
            off &= said.isNotNull()
        return F.when(off, F.struct(F.lit(field).alias("field"), key.alias("key"), said.alias("said"), props[key].alias("shown")))

    spot = lambda lat, lon: F.format_string("%.5f, %.5f", lat, lon)
    apart = F.hypot(F.col("lon") - e["lon"], F.col("lat") - e["lat"]) > TOLERANCE
    moved = F.when(
        is_point_object(F.col("osm"), props, F.col("lon")) & apart,
        F.struct(F.lit("position").alias("field"), F.lit(None).cast("string").alias("key"), spot(e["lat"], e["lon"]).alias("said"), spot(F.col("lat"), F.col("lon")).alias("shown")),
    )
    each = F.filter(F.array(*[told(*p) for p in pairs], moved), lambda x: x.isNotNull())
    return _held(features, entries).select(*keep, "id", "osm", F.explode(each).alias("d")).select(*keep, "id", "osm", "d.*")
