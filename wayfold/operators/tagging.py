"""The tags that objects of an extract get: those of the row that claims them, else their own name in the language of their area, then tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .covering import variety_of
from .namelist import unclaimed_tags
from .naming import Variety


def local_names(named: DataFrame, held: DataFrame, objects: DataFrame, rings: DataFrame, varieties: list[Variety]) -> DataFrame:
    """Rows (t, id, added) of named objects (t, id) that no row holds (held: t, id) and that have a name in the language of their area.

    ``objects`` are located (t, id, lon, lat, lon2, lat2, admin_level, name_frr, name_nds). What
    is not located, outside all areas, or without such a name gets nothing.
    """
    # Few objects have such a name: only they are looked up, and only what lies in an area is held against the rows.
    able = objects.where("coalesce(name_frr, '') != '' OR coalesce(name_nds, '') != ''")
    added = lambda: unclaimed_tags(F.col("tag"), varieties)
    got = variety_of(able, rings, ["t", "id"]).select("t", "id", "tag", "name_frr", "name_nds").where(F.size(added()) > 0)
    free = got.join(named.select("t", "id"), ["t", "id"], "left_semi").join(held.select("t", "id"), ["t", "id"], "left_anti")
    return free.select("t", "id", added().alias("added"))


def added_tags(objects: DataFrame, claimed: DataFrame, local: DataFrame, tuned: DataFrame) -> DataFrame:
    """Objects (t, id, ...) with ``added`` and ``how``: the tags of their row (claimed: t, id, added), else their local name, with tuning (t, id, changes) put over.

    ``how`` is row, osm or null. A row without tags is a row still. An empty value of tuning
    stays, as it deletes the key. Each side has an object once. Columns of these two names are replaced.
    """
    out = objects.drop("added", "how")
    own = out.columns
    for rows, c, side in ((claimed, "added", "__row"), (local, "added", "__osm"), (tuned, "changes", "__changes")):
        out = out.join(rows.select("t", "id", F.col(c).alias(side)), ["t", "id"], "left")
    none = F.create_map().cast("map<string,string>")
    base, changes = F.coalesce("__row", "__osm", none), F.coalesce("__changes", none)
    added = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(changes, k)), changes)
    how = F.when(F.col("__row").isNotNull(), "row").when(F.col("__osm").isNotNull(), "osm")
    return out.select(*own, added.alias("added"), how.alias("how"))
