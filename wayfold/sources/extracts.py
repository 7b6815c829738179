"""Map extracts held as three tables: nodes (id, lon, lat, tags), ways (id, nodes, tags), relations (id, members, tags)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CLASS_KEYS, KEPT_KEYS, NAME_RANKS
from ..functions import geo, tags
from .tables import cut

NODES = "id bigint, lon double, lat double, tags map<string,string>"
WAYS = "id bigint, nodes array<bigint>, tags map<string,string>"
RELATIONS = "id bigint, members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>"


@dataclass
class Extract:
    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame
    source: str = ""

    @classmethod
    def read(cls, spark: SparkSession, path: str, source: str = "") -> Extract:
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
        return cls(read("nodes", NODES), read("ways", WAYS), read("relations", RELATIONS), source)

    def write(self, path: str) -> None:
        for name in ("nodes", "ways", "relations"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    def by_id(self, table: str, ids: DataFrame) -> DataFrame:
        """Rows of a table with their ids among ``ids`` (id); ways need a node, nodes a position."""
        found = getattr(self, table).join(ids.select("id").distinct(), "id", "left_semi")
        usable = {"ways": F.size("nodes") > 0, "nodes": F.col("lon").isNotNull() & F.col("lat").isNotNull()}
        return found.where(usable[table]) if table in usable else found

    def tagged(self, key: str) -> DataFrame:
        """Rows (t, id, value) of every object with a value for a key."""
        each = [getattr(self, n).select(F.lit(t).alias("t"), "id", F.col("tags")[key].alias("value")) for n, t in (("nodes", "n"), ("ways", "w"), ("relations", "r"))]
        return each[0].unionByName(each[1]).unionByName(each[2]).where("value <> ''")

    def geometry(self, refs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The relations asked for (refs: t, id), the ways of those and the ways asked for, and the nodes of all."""
        relations = self.by_id("relations", refs.where("t = 'r'"))
        members = relations.select(F.explode("members").alias("m"))
        ways = self.by_id("ways", refs.where("t = 'w'").select("id").unionByName(members.where("m.type = 'w'").select(F.col("m.ref").alias("id"))))
        labels = members.where("m.type = 'n' AND m.role IN ('label', 'admin_centre')").select(F.col("m.ref").alias("id"))
        of_ways = ways.select(F.explode("nodes").alias("id"))
        nodes = self.by_id("nodes", refs.where("t = 'n'").select("id").unionByName(labels).unionByName(of_ways))
        return relations, ways, nodes


def ring_members(members: Column) -> Column:
    """Member ways as struct(inner, outer); every role but inner counts as outer."""
    ways = F.filter(members, lambda m: m["type"] == "w")
    ref = lambda a: F.transform(a, lambda m: m["ref"])
    return F.struct(ref(F.filter(ways, lambda m: m["role"] == "inner")).alias("inner"), ref(F.filter(ways, lambda m: ~m["role"].eqNullSafe(F.lit("inner")))).alias("outer"))


def label_node(members: Column) -> Column:
    return F.get(F.filter(members, lambda m: (m["type"] == "n") & m["role"].isin("label", "admin_centre")), F.lit(0))["ref"]


def candidates(x: Extract) -> DataFrame:
    """Rows (src, t, id, lon, lat, tags) of named objects of a kept class.

    A node stands where it is, a way at the mean of sampled nodes, a relation at the mean of
    its member ways' first usable nodes (in single precision). Roads count only inside the
    home region. Tags are cut to those that later steps read; positions have six decimals.
    """
    kept = F.array(*[F.lit(k) for k in KEPT_KEYS])
    named = lambda t: tags.has_any(t, *NAME_RANKS)
    # Only ways that are named or belong to a named relation are joined with their nodes.
    wanted = x.relations.where(named(F.col("tags")))
    parts = wanted.select("id", F.explode("members").alias("m")).where("m.type = 'w'").select("id", F.col("m.ref").alias("way"))
    asked = x.ways.where(named(F.col("tags"))).select("id").unionByName(parts.select(F.col("way").alias("id"))).distinct()
    spots = x.ways.join(asked, "id", "left_semi").select("id", F.posexplode("nodes").alias("k", "node")).join(x.nodes.select(F.col("id").alias("node"), "lon", "lat"), "node", "left")
    lines = cut(spots.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "lon", "lat"))), lambda p: F.struct(p["lon"], p["lat"])).alias("points")), "way-points")
    nodes = x.nodes.where(named(F.col("tags"))).select(F.lit("n").alias("t"), "id", "lon", "lat", "tags")
    ways = x.ways.where(named(F.col("tags"))).join(lines, "id", "left").withColumn("c", geo.centroid(F.col("points"))).select(F.lit("w").alias("t"), "id", "c.lon", "c.lat", "tags")
    firsts = parts.join(lines.withColumn("p", geo.first_position(F.col("points"))).select(F.col("id").alias("way"), "p"), "way").where("p IS NOT NULL")
    means = firsts.groupBy("id").agg(F.avg(F.col("p.lon").cast("float")).alias("lon"), F.avg(F.col("p.lat").cast("float")).alias("lat"))
    relations = wanted.join(means, "id", "left").select(F.lit("r").alias("t"), "id", "lon", "lat", "tags")
    every = nodes.unionByName(ways).unionByName(relations)
    reason = F.array_compact(F.array(*[F.when(tags.tag(F.col("tags"), k) & (geo.in_box("lon", "lat") if k == "highway" else F.lit(True)), F.lit(k)) for k in CLASS_KEYS]))
    every = every.withColumn("reasons", reason).where(F.size("reasons") > 0)
    return every.select(F.lit(x.source).alias("src"), "t", "id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.map_filter("tags", lambda k, v: F.array_contains(kept, k)).alias("tags"), "reasons")


def with_claims(x: Extract, claims: DataFrame) -> DataFrame:
    """Rows (t, id, tags) of all objects with the tags of the claims (t, id, changes) put over them, in order of type, then id."""
    every = None
    for name, t in (("nodes", "n"), ("ways", "w"), ("relations", "r")):
        part = getattr(x, name).select(F.lit(t).alias("t"), "id", "tags")
        every = part if every is None else every.unionByName(part)
    changed = every.join(claims.select("t", "id", "changes"), ["t", "id"], "left")
    return changed.select("t", "id", F.when(F.col("changes").isNull(), F.col("tags")).otherwise(tags.overlaid(F.col("tags"), F.col("changes"))).alias("tags"))
