"""An extract that passes as a stream and gets made objects, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir
from ..streaming import injection
from .queries import lat_of, lon_of, query, table


def _extract_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parts are nodes, suppliers ways, nations relations; even and odd keys are two sources, of which the odd one ends without relations."""
    src = lambda k: F.when(F.col(k) % 2 == 0, "even").otherwise("odd").alias("src")
    tags = lambda c: F.create_map(F.lit("name"), F.col(c), F.lit("place"), F.lit("x"))
    none, nowhere = F.lit(None).cast("array<long>").alias("nodes"), F.lit(None).cast("double")
    n = table(spark, d, "part").select(src("p_partkey"), F.col("p_partkey").alias("seq"), F.lit("n").alias("t"), F.col("p_partkey").alias("id"), lon_of("p_partkey").alias("lon"), lat_of("p_partkey").alias("lat"), none, tags("p_name").alias("tags"))
    w = table(spark, d, "supplier").select(src("s_suppkey"), (F.col("s_suppkey") + 10**9).alias("seq"), F.lit("w").alias("t"), F.col("s_suppkey").alias("id"), nowhere.alias("lon"), nowhere.alias("lat"), F.array("s_suppkey").alias("nodes"), tags("s_name").alias("tags"))
    r = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(src("n_nationkey"), (F.col("n_nationkey") + 2 * 10**9).alias("seq"), F.lit("r").alias("t"), F.col("n_nationkey").cast("long").alias("id"), nowhere.alias("lon"), nowhere.alias("lat"), none, tags("n_name").alias("tags"))
    end = table(spark, d, "region").where("r_regionkey < 2").select(src("r_regionkey"), F.lit(3 * 10**9).alias("seq"), F.lit("e").alias("t"), F.lit(0).cast("long").alias("id"), nowhere.alias("lon"), nowhere.alias("lat"), none, F.lit(None).cast("map<string,string>").alias("tags"))
    return n.unionByName(w).unionByName(r).unionByName(end)


def _made(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points from regions and squares from every fifth nation, for both sources; every third part has a change of its name."""
    both = F.explode(F.array(F.lit("even"), F.lit("odd"))).alias("src")
    points = table(spark, d, "region").select(both, (F.col("r_regionkey") + 1).alias("place"), lon_of("r_regionkey").alias("lon"), lat_of("r_regionkey").alias("lat"), F.create_map(F.lit("name"), F.col("r_name")).alias("tags"))
    host = F.create_map(F.lit("name"), F.col("n_name"), F.lit("place"), F.lit("island"), F.lit("name:de"), F.lower("n_name"))
    squares = table(spark, d, "nation").where("n_nationkey % 5 = 0").select(both, (F.col("n_nationkey") / 5 + 1).cast("int").alias("place"), lon_of("n_nationkey").alias("lon"), lat_of("n_nationkey").alias("lat"), F.lit(4.0).alias("km2"), injection.inherited(host, F.create_map(F.lit("name"), F.lit(""), F.lit("place"), F.lit("polder"))).alias("tags"))
    changes = table(spark, d, "part").where("p_partkey % 3 = 0").select(F.lit("n").alias("t"), F.col("p_partkey").alias("id"), F.create_map(F.lit("name"), F.upper("p_name"), F.lit("place"), F.lit("")).alias("changes"))
    return points, squares, changes


@query("""
WITH s AS (SELECT 'even' AS src, 0 AS m UNION ALL SELECT 'odd', 1),
high AS (SELECT src, (SELECT max(p_partkey) FROM part WHERE p_partkey % 2 = m) AS n, (SELECT max(s_suppkey) FROM supplier WHERE s_suppkey % 2 = m) AS w, 1000000000 + (SELECT min(s_suppkey) FROM supplier WHERE s_suppkey % 2 = m) AS way_at,
    CASE WHEN m = 0 THEN 2000000000 ELSE 3000000000 END AS relation_at FROM s),
o AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS src, p_partkey AS seq, 2147483647 AS part, 'n' AS t, p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN p_partkey % 3 > 0 THEN 'x' END AS place, NULL AS nodes FROM part
    UNION ALL SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END, s_suppkey + 1000000000, 2147483647, 'w', s_suppkey, s_name, 'x', s_suppkey::VARCHAR FROM supplier
    UNION ALL SELECT 'even', n_nationkey + 2000000000, 2147483647, 'r', n_nationkey, n_name, 'x', NULL FROM nation WHERE n_nationkey % 2 = 0
    UNION ALL SELECT src, way_at, r_regionkey + 1, 'n', n + r_regionkey + 1, r_name, NULL, NULL FROM region, high
    UNION ALL SELECT src, way_at, 5 + n_nationkey // 5 * 4 + k, 'n', n + 5 + n_nationkey // 5 * 4 + k, NULL, NULL, NULL FROM nation, high, range(1, 5) r(k) WHERE n_nationkey % 5 = 0
    UNION ALL SELECT src, relation_at, 1073741824 + n_nationkey // 5 + 1, 'w', w + n_nationkey // 5 + 1, NULL, 'polder', array_to_string(list_transform([1, 2, 3, 4, 1], lambda k: n + 5 + n_nationkey // 5 * 4 + k), ',') FROM nation, high WHERE n_nationkey % 5 = 0)
SELECT src, CAST(seq AS BIGINT) AS seq, CAST(part AS INTEGER) AS part, t, CAST(id AS BIGINT) AS id, name, place, nodes FROM o
""")
def injected_stream(spark: SparkSession, d: str) -> DataFrame:
    """STM01-STM03, WIN15, PRJ31: two extracts pass as a stream of nine files; made nodes come before the first way, made ways before the first relation or the end."""
    base = f"{shared_dir(spark)}/wayfold/injection-{uuid.uuid4().hex}"
    points, squares, changes = _made(spark, d)
    rows = _extract_rows(spark, d)
    # Files that are written later come by later: three of nodes, three of ways, three of the rest, each three in one micro-batch.
    for part in (F.col("t") == "n", F.col("t") == "w", F.col("t").isin("r", injection.END)):
        rows.where(part).repartition(3).write.mode("append").parquet(f"{base}/extract")
    injection.inject_stream(injection.extract_stream(spark, f"{base}/extract", 3), points, squares, changes, f"{base}/made", f"{base}/checkpoint").awaitTermination()
    got = injection.read_injected(spark, f"{base}/made")
    nodes = F.when(F.col("nodes").isNotNull(), F.array_join(F.col("nodes").cast("array<string>"), ","))
    return got.select("src", "seq", "part", "t", "id", F.col("tags")["name"].alias("name"), F.col("tags")["place"].alias("place"), nodes.alias("nodes"))
