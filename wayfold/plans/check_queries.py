"""Checks of tiles, sets and lists, and the tags objects get, over the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import areas, listcheck, namelist, sets, tagging, tilecheck
from ..operators.naming import Variety
from . import area_queries
from .list_queries import _CELLS, VARIETIES
from .queries import SQL, _pos, lat_of, lon_of, query, table

# Tiles against entries: a customer is an entry, an order a feature of it.

_ENTRY = {
    "id": "'c' || c_custkey", "osm": "CASE c_custkey % 4 WHEN 0 THEN 'way/' || (c_custkey + 1) || '; node/7' WHEN 1 THEN 'local/p-' || c_custkey WHEN 2 THEN 'node/' || (c_custkey + 1) ELSE '' END", "kind": "CASE WHEN c_custkey % 2 = 0 THEN 'island' ELSE 'koog' END",
    "name_de": "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'de ' || c_custkey END", "n_a": "CASE WHEN c_custkey % 5 < 3 THEN 'A' || c_custkey END",
}
_FEATURE = {
    "ref": "CASE WHEN o_orderkey % 17 = 0 THEN 'gone' ELSE 'c' || o_custkey END", "osm": "CASE o_orderkey % 5 WHEN 0 THEN 'way/' || (o_custkey + 1) WHEN 1 THEN 'node/' || (o_custkey + 1) WHEN 2 THEN NULL WHEN 3 THEN 'relation/' || (o_custkey + 1) ELSE 'way/' || (o_custkey + 1) END",
    "square": "CASE WHEN o_orderkey % 7 = 0 THEN 'yes' ELSE '' END", "kind": "CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 6 <> 0 THEN 'island' ELSE 'koog' END", "name_de": "'de ' || o_custkey", "n_a": "CASE WHEN o_orderkey % 9 <> 0 THEN 'A' || o_custkey END",
}


def _cells(fields: dict[str, str]) -> list[Column]:
    return [F.expr(sql).alias(name) for name, sql in fields.items()]


def _tiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "customer").select("c_custkey", *_cells(_ENTRY)).withColumn("names", F.map_filter(F.create_map(F.lit("frr-x-a"), F.col("n_a")), lambda k, v: v.isNotNull()))
    f = table(spark, d, "orders").select("o_orderkey", "o_custkey", *_cells(_FEATURE))
    keys = {"ref": "place:ref", "square": tilecheck.SQUARE, "kind": "place:kind", "name_de": "name:de", "n_a": "name:frr-x-a"}
    props = F.map_filter(F.create_map(*[x for c, k in keys.items() for x in (F.lit(k), F.col(c))]), lambda k, v: v.isNotNull())
    point = lambda c: F.when(F.col("o_orderkey") % 3 != 0, c)
    off = F.when(F.col("o_orderkey") % 4 == 0, 0.5).otherwise(0.0)
    features = f.select("o_orderkey", "osm", props.alias("props"), point(lon_of("o_custkey") + off).alias("lon"), point(lat_of("o_custkey")).alias("lat"))
    return features, e.select("id", "osm", "kind", "name_de", "names", lon_of("c_custkey").alias("lon"), lat_of("c_custkey").alias("lat"))


_HELD = f"""e AS (SELECT c_custkey, {', '.join(f'{sql} AS {name}' for name, sql in _ENTRY.items())}, {_pos('c_custkey')} FROM customer), f AS (SELECT o_orderkey, {', '.join(f'{sql} AS {name}' for name, sql in _FEATURE.items())} FROM orders),
h AS (SELECT e.id, o_orderkey, f.osm, f.square, e.kind AS k1, f.kind AS k2, e.name_de AS d1, f.name_de AS d2, e.n_a AS a1, f.n_a AS a2, lon, lat FROM f JOIN e ON f.ref = e.id WHERE e.osm LIKE 'local/%' OR f.square = 'yes' OR f.osm = nullif(split_part(e.osm, '; ', 1), ''))"""


@query(f"WITH {_HELD} SELECT DISTINCT id FROM h")
def checked_entries(spark: SparkSession, d: str) -> DataFrame:
    """JN26, FLT29: entries whose own object is among the features of tiles."""
    return tilecheck.checked_entries(*_tiles(spark, d))


@query(f"""
WITH {_HELD}, p AS (SELECT *, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 = 0 AND (square = 'yes' OR osm IS NULL OR osm LIKE 'node/%') THEN true ELSE false END AS moved FROM h)
SELECT o_orderkey, id, osm, 'kind' AS field, 'place:kind' AS key, k1 AS said, k2 AS shown FROM p WHERE k1 <> k2 UNION ALL SELECT o_orderkey, id, osm, 'name_de', 'name:de', d1, d2 FROM p WHERE d1 <> '' AND d1 <> d2
UNION ALL SELECT o_orderkey, id, osm, 'names[frr-x-a]', 'name:frr-x-a', a1, a2 FROM p WHERE a1 IS DISTINCT FROM a2
UNION ALL SELECT o_orderkey, id, osm, 'position', NULL, printf('%.5f, %.5f', lat, lon), printf('%.5f, %.5f', lat, lon + 0.5) FROM p WHERE moved
""")
def tile_disagreements(spark: SparkSession, d: str) -> DataFrame:
    """JN25, FLT28, FLT29: what features of tiles show otherwise than the entries whose objects they are."""
    return tilecheck.disagreements(*_tiles(spark, d), ["frr-x-a"], ("o_orderkey",))


# Sets.


@query("SELECT DISTINCT k::VARCHAR AS key FROM (SELECT l_partkey AS k FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem)")
def keys_of_either(spark: SparkSession, d: str) -> DataFrame:
    """SET03, SET08: keys that were found or were asked for in vain."""
    line = table(spark, d, "lineitem")
    return sets.either(line.select(F.col("l_partkey").alias("k")), line.select(F.col("l_suppkey").alias("k")), "k")


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 4 <> 0)
SELECT coalesce(a.k, b.k)::VARCHAR AS key, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'extra' END AS fate FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL
""")
def keys_on_one_side(spark: SparkSession, d: str) -> DataFrame:
    """SET05: what is listed and not there, and what is there and not listed."""
    listed, there = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("k"))
    return sets.installed(listed, there, "k")


# Lists. Ids, separators and name cells are broken in some rows, beside what the cells of the name list break.
_ODD = _CELLS | {
    "id": "CASE WHEN c_custkey % 50 = 0 THEN '' WHEN c_custkey % 51 = 0 THEN 'c' || (c_custkey - 1) WHEN c_custkey % 52 = 0 THEN 'Bad Id' ELSE 'c' || c_custkey END", "one": "CASE WHEN c_custkey % 9 = 0 THEN c_name || '?' WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END",
    "osm": "CASE c_custkey % 6 WHEN 0 THEN CASE WHEN c_custkey % 12 = 0 THEN 'way/' || (c_custkey + 1) || ';node/' || (c_custkey + 2) ELSE 'way/' || (c_custkey + 1) || '; way/' || (c_custkey + 1) END WHEN 1 THEN 'local/p-' || c_custkey WHEN 2 THEN 'relation/' || (c_custkey + 1) WHEN 3 THEN '' WHEN 4 THEN 'road/' || c_custkey ELSE 'way/' || (c_custkey % 40 + 1) END",
}
_TUNED = {
    "osm": "'local/p-' || (6 * s_suppkey + 1)", "lat": "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '54.5' END", "lon": "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '8.5' END", "set_tags": "CASE s_suppkey % 4 WHEN 0 THEN 'place:ref=gone' || s_suppkey WHEN 1 THEN 'place:ref=c' || s_suppkey ELSE '' END",
    "minzoom": "''", "maxzoom": "''", "polygon_km2": "''",
}
_ODD_SQL = f"""l AS (SELECT c_custkey AS line, {', '.join(f'{sql} AS {name}' for name, sql in _ODD.items())} FROM customer),
refs AS (SELECT *, CASE WHEN osm LIKE 'road/%' OR osm = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(osm, '; ?') END AS r FROM l),
k AS (SELECT line, unnest(list_concat(r, CASE WHEN wikidata <> '' THEN [wikidata] ELSE CAST([] AS VARCHAR[]) END)) AS key, unnest(range(len(r) + (wikidata <> '')::INT)) AS place FROM refs WHERE status <> 'skip'),
c AS (SELECT *, min(line) OVER (PARTITION BY key) AS first, row_number() OVER (PARTITION BY key, line ORDER BY place) AS n FROM k), i AS (SELECT *, min(CASE WHEN id <> '' THEN line END) OVER (PARTITION BY id) AS first FROM l)"""


@query(f"""
WITH {_ODD_SQL}, p AS (
SELECT 0 AS part, line, 0 AS rank, m.seq AS seq, m.message AS message FROM (SELECT line, unnest(list_filter([
    {{'seq': 0, 'message': CASE WHEN kind = 'volcano' THEN 'unknown kind ''volcano''' END}}, {{'seq': 1, 'message': CASE WHEN status = 'maybe' THEN 'unknown status ''maybe'' (auto / ok / skip / empty)' END}},
    {{'seq': 2, 'message': CASE WHEN osm LIKE 'road/%' THEN 'bad reference ''' || osm || '''' END}}, {{'seq': 3, 'message': CASE WHEN wikidata = 'q12' THEN 'bad wikidata id ''q12''' END}},
    {{'seq': 4, 'message': CASE WHEN wikidata <> '' AND osm LIKE 'local/%' THEN 'a local reference is for a place OSM does not have -- it cannot have a wikidata id' END}}], lambda p: p.message IS NOT NULL)) AS m FROM l)
UNION ALL SELECT 0, line, 1, 0, CASE WHEN id = '' THEN 'no id' WHEN id = 'Bad Id' THEN 'malformed id' ELSE 'id of an earlier line' END FROM i WHERE id IN ('', 'Bad Id') OR first < line
UNION ALL SELECT 0, line, 2, place, key || ' is held by line ' || first || ' already' FROM c WHERE first < line UNION ALL SELECT 0, line, 2, place + 1000, key || ' twice in `osm`' FROM c WHERE n = 2
UNION ALL SELECT 0, line, 3, 1, 'one: `?` in ''' || one || ''' -- say `uncertain` in `note` instead' FROM l WHERE one LIKE '%?' UNION ALL SELECT 0, line, 4, 0, 'osm: references are separated by `; `' FROM l WHERE osm LIKE '%;node%'
UNION ALL SELECT 0, line, 5, 0, osm || ' has no row with a position' FROM l WHERE osm LIKE 'local/%' AND osm NOT IN (SELECT 'local/p-' || (6 * s_suppkey + 1) FROM supplier WHERE s_suppkey % 3 <> 0)
UNION ALL SELECT 1, s_suppkey, 0, 0, 'a local reference needs a position' FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT 1, s_suppkey, 1, 0, ref || ' names no row of the name list' FROM (SELECT s_suppkey, {_TUNED['set_tags']} AS ref FROM supplier) WHERE ref <> '' AND ref[11:] NOT IN (SELECT id FROM l)
UNION ALL SELECT 3, line, 0, 0, problem FROM ({SQL['area_rules']}) WHERE problem IS NOT NULL)
SELECT part, ['names', 'tuning', 'registry', 'areas'][part + 1] AS file, CAST(line AS BIGINT) AS line, rank, CAST(seq AS INTEGER) AS seq, message FROM p
""")
def list_problems(spark: SparkSession, d: str) -> DataFrame:
    """DQ11, DQ13, JN35, JN36: every problem of all hand-kept lists, file by file, line by line."""
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("line"), *_cells(_ODD))
    tuned = table(spark, d, "supplier").select(F.col("s_suppkey").alias("line"), *_cells(_TUNED))
    known = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in (("tag", v.tag), ("column", v.column), ("language", v.language))]) for v in VARIETIES])
    n = table(spark, d, "nation").withColumn("v", F.get(known, F.col("n_nationkey").cast("int")))
    registry = n.select(F.col("n_nationkey").alias("line"), "v.*", F.col("n_name").alias("label"), F.lit("living").alias("status"), F.when(F.col("v.language") == "frr", "yes").otherwise("no").alias("view"))
    s, key = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    osm = F.when(s % 7 == 0, "").when(s % 5 == 0, F.concat(F.lit("way/"), key, F.lit("; node/"), key)).otherwise(F.concat(F.lit("relation/"), (F.floor(s / 2) * 2).cast("string")))
    area_list = table(spark, d, "supplier").where("s_suppkey > 1").select(s.alias("line"), F.when(s % 11 == 0, "none").otherwise("frr-x-a").alias("dialect"), osm.alias("osm"), F.lit("").alias("name"))
    return listcheck.all_problems(names, tuned, registry, area_list).orderBy("part", "line", "rank", "seq", "message")


@query(f"""
WITH {_ODD_SQL}, held AS (SELECT line, c_name, key FROM k JOIN customer ON c_custkey = line WHERE key NOT LIKE 'local/%'), one AS (SELECT key, min_by(c_name, line) AS name FROM held GROUP BY key)
SELECT CASE WHEN lower(key[1:1]) = 'q' THEN 'item' ELSE 'reference' END AS what, key, name FROM one
WHERE CASE WHEN lower(key[1:1]) = 'q' THEN key NOT IN (SELECT 'Q' || s_suppkey FROM supplier) ELSE key NOT IN (SELECT 'way/' || p_partkey FROM part WHERE p_partkey % 3 <> 0) END
""")
def not_found_keys(spark: SparkSession, d: str) -> DataFrame:
    """SET01: references and items of the name list that an extract has not."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("line"), F.col("c_name").alias("name"), *_cells({c: _ODD[c] for c in ("osm", "wikidata", "status")}))
    found = table(spark, d, "part").where("p_partkey % 3 <> 0").select(F.lit("w").alias("t"), F.col("p_partkey").alias("id"))
    return sets.not_found(rows, found, table(spark, d, "supplier").select(F.concat(F.lit("Q"), F.col("s_suppkey").cast("string")).alias("item")))


# Tags.
_SPOKEN = [Variety("BUILDING", "one", "frr"), Variety("MACHINERY", "two", "nds"), Variety("FURNITURE", "three", "frr")]
_LOCAL = f"""a AS ({SQL['area_cells']}), n AS (SELECT o_orderkey, tag, CASE WHEN tag IN ('BUILDING', 'FURNITURE') THEN CASE WHEN o_orderkey % 4 <> 3 THEN 'F' || o_orderkey END WHEN tag = 'MACHINERY' THEN CASE WHEN o_orderkey % 6 <> 5 THEN 'S' || o_orderkey END END AS name FROM a WHERE o_orderkey % 5 <> 0),
local AS (SELECT o_orderkey AS id, name, tag FROM n WHERE name IS NOT NULL)"""


def _local(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = area_queries.spots(spark, d).withColumns({"t": F.lit("n"), "id": k, "name_frr": F.when(k % 4 != 3, F.concat(F.lit("F"), k.cast("string"))), "name_nds": F.when(k % 6 != 5, F.concat(F.lit("S"), k.cast("string")))})
    rings = areas.dissolved(*area_queries._grid(spark, d))
    return tagging.local_names(o.select("t", "id"), o.where("o_orderkey % 5 = 0").select("t", "id"), o.drop("o_orderkey"), rings, _SPOKEN)


@query(f"WITH {_LOCAL} SELECT id, name AS local, tag AS dialect FROM local")
def osm_local_names(spark: SparkSession, d: str) -> DataFrame:
    """JN37: the local names of objects that no row holds, in the language of the area they lie in."""
    return _local(spark, d).select("id", F.col("added")[namelist.naming.LOCAL].alias("local"), F.col("added")[namelist.TILE_KEYS["dialect"]].alias("dialect"))


@query(f"""
WITH {_LOCAL}, o AS (SELECT o_orderkey AS id, o_custkey, o_orderkey % 5 = 0 AS claimed, o_orderkey % 7 = 0 AS tuned FROM orders),
b AS (SELECT o.*, CASE WHEN claimed THEN CASE WHEN id % 10 <> 0 THEN 'R' || o_custkey END ELSE name END AS local, CASE WHEN NOT claimed THEN tag END AS dialect, CASE WHEN claimed THEN 'row' WHEN name IS NOT NULL THEN 'osm' END AS how FROM o LEFT JOIN local USING (id))
SELECT id, how, CASE WHEN tuned THEN '' ELSE local END AS local, dialect, CASE WHEN tuned THEN 'T' || id END AS name FROM b
""")
def added_tags(spark: SparkSession, d: str) -> DataFrame:
    """JN39: what is added to each object: its row's tags, else its local name, then tuning, which may empty a tag."""
    o = table(spark, d, "orders").select(F.lit("n").alias("t"), F.col("o_orderkey").alias("id"), "o_custkey")
    key, none = F.lit(namelist.naming.LOCAL), F.create_map().cast("map<string,string>")
    claimed = o.where("id % 5 = 0").withColumn("added", F.when(F.col("id") % 10 == 0, none).otherwise(F.create_map(key, F.concat(F.lit("R"), F.col("o_custkey").cast("string")))))
    tuned = o.where("id % 7 = 0").withColumn("changes", F.create_map(key, F.lit(""), F.lit("name"), F.concat(F.lit("T"), F.col("id").cast("string"))))
    got = tagging.added_tags(o, claimed, _local(spark, d), tuned)
    return got.select("id", "how", F.col("added")[key].alias("local"), F.col("added")[namelist.TILE_KEYS["dialect"]].alias("dialect"), F.col("added")["name"].alias("name"))
