"""Queries of the library's small functions, each over a whole table, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, tags, text
from ..operators import cards, kinds, search, stats, tuning
from .queries import _extract, _km, _pos, lat_of, lon_of, placed, query, table


@query("""
SELECT p_partkey, rtrim(rtrim(printf('%.6f', p_partkey / 8.0::DOUBLE), '0'), '.') AS degrees, CASE WHEN p_partkey % 3 = 0 THEN 'way/' || (p_partkey + 1) WHEN p_partkey % 3 = 1 THEN 'node/' || (p_partkey + 1) END AS ref,
    CASE WHEN p_partkey % 2 = 0 THEN 'Q' || p_partkey ELSE '' END AS item, p_name || '\\(' || p_size || '\\)\\.\\*' AS pattern, [p_name, p_brand || ' (b'] AS names, 'region-' || p_size AS source FROM part
""")
def small_texts(spark: SparkSession, d: str) -> DataFrame:
    """STR14, STR20, STR23, STR27, STR28, SRC16: degrees, references of pages, patterns, items, naive names, sources of files."""
    p, key = table(spark, d, "part"), F.col("p_partkey").cast("string")
    after = (F.col("p_partkey") + 1).cast("string")
    ref = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("https://www.openstreetmap.org/Way/"), after, F.lit("?x#y"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("NODE/"), after)).otherwise(F.concat(F.lit("node/0"), after))
    item = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Q"), key)).otherwise(F.concat(F.lit("Q"), key, F.lit(";Q1")))
    return p.select(
        "p_partkey", text.degrees(F.col("p_partkey") / 8).alias("degrees"), text.ref_of_text(ref).alias("ref"), text.single_item(item).alias("item"),
        text.regex_escaped(F.concat("p_name", F.lit("("), F.col("p_size").cast("string"), F.lit(").*"))).alias("pattern"),
        text.naive_names(F.concat("p_name", F.lit(" (a);"), "p_brand", F.lit(" (b; )"))).alias("x"), text.source_name(F.concat(F.lit("/x/region-"), F.col("p_size").cast("string"), F.lit("-latest.osm.pbf"))).alias("source"),
    ).withColumn("names", F.slice("x", 1, 2)).drop("x")


@query("""
WITH o AS (SELECT p_partkey, ['n', 'w', 'r'][p_partkey % 3 + 1] AS t, ['village', 'borough', 'polder', 'farm', ''][p_partkey % 5 + 1] AS place, p_partkey % 4 AS k FROM part),
f AS (SELECT p_partkey, t = 'n' AND place IN ('village', 'polder', 'farm') AS core, CASE WHEN t = 'w' THEN CASE WHEN k = 0 THEN 30.0 WHEN k IN (1, 2) THEN 5.0 END END::DOUBLE AS linear FROM o)
SELECT p_partkey, core, linear, CASE WHEN core THEN 1.0 ELSE coalesce(linear, 3.0) END::DOUBLE AS to_its_like, greatest(coalesce(linear, 3.0), 3.0)::DOUBLE AS to_a_point FROM f
""")
def reaches(spark: SparkSession, d: str) -> DataFrame:
    """FLT11, FLT12, GEO04, GEO05: settlement nodes, linear features, and how far apart two objects may be and still be one."""
    k = F.col("p_partkey") % 4
    m = F.create_map(
        F.lit("place"), F.element_at(F.array(*[F.lit(x) for x in ("village", "borough", "polder", "farm", "")]), (F.col("p_partkey") % 5 + 1).cast("int")), F.lit("waterway"), F.when(k == 0, "river").otherwise(""),
        F.lit("highway"), F.when(k == 1, "track").otherwise(""), F.lit("man_made"), F.when(k == 2, "dyke").otherwise("pier"),
    )
    t = F.element_at(F.array(F.lit("n"), F.lit("w"), F.lit("r")), (F.col("p_partkey") % 3 + 1).cast("int"))
    p = table(spark, d, "part").select("p_partkey", F.struct(t.alias("t"), m.alias("tags")).alias("o"))
    point = F.struct(F.lit("r").alias("t"), F.create_map(F.lit("x"), F.lit("y")).alias("tags"))
    o = F.col("o")
    return p.select("p_partkey", geo.is_core(o["t"], o["tags"]).alias("core"), geo.linear_km(o["t"], o["tags"]).alias("linear"), geo.reach(o, o).alias("to_its_like"), geo.reach(o, point).alias("to_a_point"))


@query(f"""
SELECT c_custkey, round((x + 2048 / 4096.0::DOUBLE) / 16384 * 360 - 180, 6) AS lon, round(degrees(2 * atan(exp(pi() * (1 - 2 * (y + 1024 / 4096.0::DOUBLE) / 16384))) - pi() / 2), 6) AS lat, 25 AS points, true AS closed, true AS round
FROM (SELECT c_custkey, floor((lon + 180) / 360 * 16384) AS x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384) AS y FROM (SELECT c_custkey, {_pos('c_custkey')} FROM customer))
""")
def tile_points(spark: SparkSession, d: str) -> DataFrame:
    """GEO19-GEO21: a point of a tile in degrees, and circles around it, whose points are all as far away."""
    c = placed(table(spark, d, "customer"), "c_custkey").withColumn("t", geo.tile_of("lon", "lat", 14)).withColumn("p", geo.tile_point("t.x", "t.y", F.lit(2048), F.lit(1024), 14))
    ring = geo.circle_ring("lon", "lat", F.lit(2.0), 24)
    c = c.withColumn("ring", ring)
    near = F.forall("ring", lambda q: F.abs(geo.haversine("lon", "lat", q["lon"], q["lat"]) - 2.0) < 0.02)
    last = F.element_at("ring", -1)
    closed = (F.abs(last["lon"] - F.get("ring", F.lit(0))["lon"]) < 1e-9) & (F.abs(last["lat"] - F.get("ring", F.lit(0))["lat"]) < 1e-9)
    c = c.withColumns({"closed": closed, "round": near})
    return c.select("c_custkey", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"), F.size("ring").alias("points"), "closed", "round")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' ' || c_mktsegment ELSE c_mktsegment END AS words, CASE WHEN c_custkey % 3 = 0 THEN 'de' WHEN c_custkey % 3 = 1 THEN 'da' END AS language, CAST((c_custkey % 2 = 0)::INT + 1 AS BIGINT) AS filled FROM customer
""")
def search_texts(spark: SparkSession, d: str) -> DataFrame:
    """PRJ34, PRJ38, STR16, CPX12: what is searched of a place, its generic name's language, and names that are filled in."""
    c, n = table(spark, d, "customer"), F.col("c_custkey") % 3
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("")
    filled = tags.filled(F.create_map(F.lit("a"), F.concat(F.lit("  "), name), F.lit("b"), F.concat("c_mktsegment", F.lit(" ")), F.lit("c"), F.lit("  ")))
    language = cards.generic_language(F.col("c_name"), F.when(n == 0, F.col("c_name")).otherwise("x"), F.when(n == 1, F.col("c_name")).otherwise("y"))
    return c.select("c_custkey", search.search_text(name, F.col("c_mktsegment"), F.col("c_mktsegment")).alias("words"), language.alias("language"), F.size(filled).cast("long").alias("filled"))


@query("""
WITH r AS (SELECT s_suppkey AS line, 'k' || (s_nationkey % 6) AS kind, s_name AS v FROM supplier), n AS (SELECT n_nationkey + 1 AS seq, 'k' || (n_nationkey % 8) AS kind, n_name AS v FROM nation),
e AS (SELECT line AS place, 0 AS seq, kind, v FROM r UNION ALL SELECT coalesce((SELECT max(line) FROM r WHERE r.kind = n.kind), (SELECT max(line) FROM r)), seq, kind, v FROM n)
SELECT CAST(row_number() OVER (ORDER BY place, seq) AS INTEGER) AS line, kind, v FROM e
""")
def inserted_rows(spark: SparkSession, d: str) -> DataFrame:
    """WIN08, SRT07: new rows put after the last of their kind."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("line"), F.concat(F.lit("k"), (F.col("s_nationkey") % 6).cast("string")).alias("kind"), F.col("s_name").alias("v"))
    new = table(spark, d, "nation").select(F.concat(F.lit("k"), (F.col("n_nationkey") % 8).cast("string")).alias("kind"), (F.col("n_nationkey") + 1).alias("seq"), F.col("n_name").alias("v"))
    return tuning.inserted(rows, new).select("line", "kind", "v")


@query("""
WITH p AS (SELECT s_name AS slug, s_suppkey AS k FROM supplier)
SELECT slug, CAST(1000 + row_number() OVER (ORDER BY slug) AS INTEGER) AS id, CASE WHEN k % 3 = 0 THEN 'hamlet' WHEN k % 3 = 1 AND k % 2 = 0 THEN 'island' END AS place,
    CASE WHEN k % 3 = 0 OR (k % 3 = 1 AND k % 2 = 0) THEN slug END AS name, CASE WHEN k % 3 = 0 OR (k % 3 = 1 AND k % 2 = 0) THEN 'F' || k END AS own FROM p
""")
def made_points(spark: SparkSession, d: str) -> DataFrame:
    """PRJ30, STM04: points for places that are not there, with ids above all others, and their tags."""
    k = F.col("k")
    s = table(spark, d, "supplier").select(F.col("s_name").alias("slug"), F.col("s_suppkey").alias("k"))
    place = kinds.by_kind(F.when(k % 3 == 0, "settlement").otherwise("koog"), lambda x: x.point_place, None)
    change = F.when((k % 3 == 1) & (k % 2 == 0), F.create_map(F.lit("place"), F.lit("island"))).when(k % 3 == 1, F.create_map(F.lit("place"), F.lit("")))
    names = F.create_map(F.lit("name:own"), F.concat(F.lit("F"), k.cast("string")), F.lit("name:none"), F.lit(""))
    got = tuning.made_objects(s, 1000).withColumn("m", tuning.point_tags(place, F.col("slug"), names, change))
    return got.select("slug", "id", F.col("m")["place"].alias("place"), F.col("m")["name"].alias("name"), F.col("m")["name:own"].alias("own"))


@query("""
WITH asked AS (SELECT s_suppkey * 3 AS id FROM supplier), w AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey IN (SELECT id FROM asked) OR l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT id FROM asked)))
SELECT 'tagged' AS what, t, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT 'n' AS t, p_partkey AS id FROM part UNION ALL SELECT 'w', l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    UNION ALL SELECT 'r', c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) GROUP BY t
UNION ALL SELECT 'read', 'r', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer WHERE c_custkey IN (SELECT id FROM asked) AND c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'read', 'w', count(*), CAST(sum(id) AS BIGINT) FROM w JOIN orders ON o_orderkey = id
UNION ALL SELECT 'read', 'n', count(*), CAST(sum(p_partkey) AS BIGINT) FROM part WHERE p_partkey IN (SELECT id FROM asked) OR p_partkey IN (SELECT l_partkey FROM lineitem JOIN w ON w.id = l_orderkey JOIN orders ON o_orderkey = l_orderkey)
""")
def extract_reads(spark: SparkSession, d: str) -> DataFrame:
    """SRC01, SRC06-SRC09: objects by tag, and all that the geometry of objects asked for takes."""
    x = _extract(spark, d)
    asked = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("id"))
    refs = None
    for t in "nwr":
        part = asked.select(F.lit(t).alias("t"), "id")
        refs = part if refs is None else refs.unionByName(part)
    count = lambda df, what, t: df.agg(F.count("*").alias("n"), F.sum("id").alias("ids")).select(F.lit(what).alias("what"), F.lit(t).alias("t"), "n", "ids")
    relations, ways, nodes = x.geometry(refs)
    out = x.tagged("name").groupBy("t").agg(F.count("*").alias("n"), F.sum("id").alias("ids")).select(F.lit("tagged").alias("what"), "t", "n", "ids")
    return out.unionByName(count(relations, "read", "r")).unionByName(count(ways, "read", "w")).unionByName(count(nodes, "read", "n"))


@query("""
SELECT key, count(*) AS n FROM (SELECT unnest(list_filter(['name:de', CASE WHEN p_partkey % 2 = 0 THEN 'name:frr' END, CASE WHEN p_partkey % 5 = 0 THEN 'name:' || lower(p_type) END], lambda k: k IS NOT NULL)) AS key FROM part) GROUP BY key
""")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    """AGG01: how often each name key has a value."""
    n = F.col("p_partkey")
    pairs = [("name:de", F.col("p_name")), ("name:frr", F.when(n % 2 == 0, F.col("p_name")).otherwise("")), ("place", F.lit("x"))]
    m = F.map_concat(F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]), F.create_map(F.concat(F.lit("name:"), F.lower("p_type")), F.when(n % 5 == 0, F.lit("y")).otherwise("")))
    return stats.key_counts(table(spark, d, "part").select(m.alias("tags")), "tags")


@query(f"""
WITH o AS (SELECT o_orderkey, {_pos('o_orderkey')} FROM orders), b AS (SELECT n_nationkey, {_pos('n_nationkey')}, n_regionkey FROM nation WHERE n_nationkey % 3 > 0)
SELECT o_orderkey, n_nationkey FROM o JOIN b ON {_km('o.lon', 'o.lat', 'b.lon', 'b.lat')} <= 10 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY -n_regionkey, {_km('o.lon', 'o.lat', 'b.lon', 'b.lat')}, 'Q' || n_nationkey) = 1
""")
def borrowed_items(spark: SparkSession, d: str) -> DataFrame:
    """JN13: the item of the most local boundary within 10 km that has one, the nearest among equals."""
    from ..operators import spatial

    o = table(spark, d, "orders").select("o_orderkey", lon_of("o_orderkey").alias("lon"), lat_of("o_orderkey").alias("lat"))
    b = placed(table(spark, d, "nation"), "n_nationkey").where("n_nationkey % 3 > 0").select("n_nationkey", "n_regionkey", "lon", "lat")
    return spatial.nearest(o, b, ["o_orderkey"], 10.0, -F.col("n_regionkey"), F.concat(F.lit("Q"), F.col("n_nationkey").cast("string"))).select("o_orderkey", "n_nationkey")
