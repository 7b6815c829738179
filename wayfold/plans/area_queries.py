"""Queries of areas over a grid that customers make, and the same in SQL.

Customer k is the cell (k mod 40, k div 40) of a grid; its outline is two open ways, and every
seventh has a hole. Market segments are groups of cells: their areas have holes, islands in
holes and pieces that touch in one corner. Positions are whole parts of powers of two, so
areas are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import areas, covering
from .queries import query, table

#: Cells in a row; cells of a degree of longitude and of latitude.
WIDE, PER_LON, PER_LAT = 40, 64, 4096
_CELLS = 2.0 * PER_LON * PER_LAT


def _grid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ways (area, role, place, nodes), nodes (id, lon, lat) and groups (area, tag)."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("area"), F.col("c_mktsegment").alias("tag"))
    x, y = F.col("area") % WIDE, F.floor(F.col("area") / WIDE)
    node = lambda i, j: (y + j) * 100_000 + x + i
    hole = lambda i: F.col("area") * 4 + i + F.lit(10**12)
    way = lambda role, place, ids: F.struct(F.lit(role).alias("role"), F.lit(place).alias("place"), F.array(*[n.cast("long") for n in ids]).alias("nodes"))
    outer = [way("outer", 0, [node(0, 0), node(1, 0), node(1, 1)]), way("outer", 1, [node(0, 0), node(0, 1), node(1, 1)])]
    inner = way("inner", 0, [hole(0), hole(1), hole(2), hole(3), hole(0)])
    every = F.when(F.col("area") % 7 == 0, F.array(*outer, inner)).otherwise(F.array(*outer))
    ways = c.select("area", F.explode(every).alias("w")).select("area", "w.*")
    at = lambda i, dx, dy: F.struct(i.cast("long").alias("id"), ((x + dx) / PER_LON + 8).alias("lon"), ((y + dy) / PER_LAT + 54).alias("lat"))
    corners = [at(node(i, j), i, j) for i in (0, 1) for j in (0, 1)]
    holes = [at(hole(i), dx, dy) for i, (dx, dy) in enumerate(((0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)))]
    points = F.when(F.col("area") % 7 == 0, F.array(*corners, *holes)).otherwise(F.array(*corners))
    return ways, c.select(F.explode(points).alias("p")).select("p.*").distinct(), c


_SQL = f"""
WITH RECURSIVE cells AS (SELECT c_custkey AS k, c_custkey % {WIDE} AS x, c_custkey // {WIDE} AS y, c_mktsegment AS tag, c_custkey % 7 = 0 AS holed FROM customer),
near AS (SELECT a.k, b.k AS other FROM cells a JOIN cells b ON a.tag = b.tag AND ((a.x = b.x AND abs(a.y - b.y) = 1) OR (a.y = b.y AND abs(a.x - b.x) = 1))),
reach(k, root) AS (SELECT k, k FROM cells UNION SELECT near.other, reach.root FROM reach JOIN near ON near.k = reach.k),
piece AS (SELECT k, min(root) AS root FROM reach GROUP BY k),
sides AS (SELECT k, tag, x AS x1, y AS y1, x + 1 AS x2, y AS y2 FROM cells UNION ALL SELECT k, tag, x, y + 1, x + 1, y + 1 FROM cells
    UNION ALL SELECT k, tag, x, y, x, y + 1 FROM cells UNION ALL SELECT k, tag, x + 1, y, x + 1, y + 1 FROM cells),
border AS (SELECT tag, min(k) AS k, x1, y1, x2, y2 FROM sides GROUP BY tag, x1, y1, x2, y2 HAVING count(*) = 1)
"""


@query(f"""
SELECT c_custkey AS area, CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END AS n_rings, CASE WHEN c_custkey % 7 = 0 THEN 8 ELSE 4 END AS n_points, CASE WHEN c_custkey % 7 = 0 THEN 0.75 ELSE 1 END::DOUBLE AS cells FROM customer
""")
def area_polygons(spark: SparkSession, d: str) -> DataFrame:
    """GEO16: the polygons of cells, out of open ways, holes taken out."""
    ways, nodes, _ = _grid(spark, d)
    got = areas.of_ways(ways, nodes)
    return got.groupBy("area").agg(F.count("*").cast("int").alias("n_rings"), F.sum(F.size("ring") - 1).cast("int").alias("n_points"), (F.sum("doubled") * (_CELLS / 4)).alias("cells"))


@query(f"""
{_SQL}, holes AS (SELECT tag, count(*) AS n FROM cells WHERE holed GROUP BY tag)
SELECT tag, (SELECT count(DISTINCT root) FROM piece JOIN cells USING (k) WHERE cells.tag = b.tag) AS n_polygons, count(*) + 4 * any_value(holes.n) AS n_points,
    (SELECT count(*) FROM cells WHERE cells.tag = b.tag) - any_value(holes.n) / 4.0::DOUBLE AS cells
FROM border b JOIN holes USING (tag) GROUP BY tag
""")
def area_dissolved(spark: SparkSession, d: str) -> DataFrame:
    """AGG12: each segment's cells as one area; inner borders cancel, what touches in a corner only stays apart."""
    got = areas.dissolved(*_grid(spark, d))
    return got.groupBy("tag").agg(F.count(F.when(F.col("hole") == 0, 1)).alias("n_polygons"), F.sum(F.size("ring") - 1).alias("n_points"), (F.sum("doubled") * (_CELLS / 4)).alias("cells"))


@query(f"""
{_SQL}, owned AS (SELECT x1, y1, x2, y2, string_agg(tag, ',' ORDER BY tag) AS owners FROM border GROUP BY ALL),
ends AS (SELECT x1 AS x, y1 AS y, owners, x1 = x2 AS up FROM owned UNION ALL SELECT x2, y2, owners, x1 = x2 FROM owned),
straight AS (SELECT x, y, any_value(owners) AS owners FROM ends GROUP BY x, y HAVING count(*) = 2 AND min(owners) = max(owners) AND min(up) = max(up)),
gone AS (SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(owners, ',')) AS tag FROM straight) GROUP BY tag), holes AS (SELECT tag, count(*) AS n FROM cells WHERE holed GROUP BY tag)
SELECT tag, CAST(count(*) + 4 * any_value(holes.n) - coalesce(any_value(gone.n), 0) AS BIGINT) AS n_points, (SELECT count(*) FROM cells WHERE cells.tag = b.tag) - any_value(holes.n) / 4.0::DOUBLE AS cells
FROM border b JOIN holes USING (tag) LEFT JOIN gone USING (tag) GROUP BY tag
""")
def area_simplified(spark: SparkSession, d: str) -> DataFrame:
    """GEO13: borders simplified once for both sides; with next to no tolerance only points on straight lines go, and areas stay."""
    got = areas.simplified_rings(areas.dissolved(*_grid(spark, d)), 1e-9, "tag")
    return got.groupBy("tag").agg(F.sum(F.size("ring") - 1).cast("long").alias("n_points"), (F.sum("doubled") * (_CELLS / 4)).alias("cells"))


@query(f"""
{_SQL}, lines AS (SELECT b.tag, root, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM border b JOIN piece USING (k)
    UNION ALL SELECT tag, root, x + 0.25 + 0.5 * i, y + 0.25, x + 0.25 + 0.5 * i, y + 0.75 FROM cells JOIN piece USING (k), range(2) r(i) WHERE holed),
box AS (SELECT tag, root, (min(y1) + max(y2)) / 2 AS mid FROM lines GROUP BY tag, root),
corners AS (SELECT tag, root, y1 AS y FROM lines UNION ALL SELECT tag, root, y2 FROM lines),
level AS (SELECT tag, root, (max(y) FILTER (y <= mid) + min(y) FILTER (y > mid)) / 2 AS y FROM corners JOIN box USING (tag, root) GROUP BY tag, root),
met AS (SELECT tag, root, y, x1 AS x, lead(x1) OVER w AS next, row_number() OVER w AS n FROM lines JOIN level USING (tag, root) WHERE (y1 > y) <> (y2 > y) WINDOW w AS (PARTITION BY tag, root ORDER BY x1))
SELECT tag, 8 + (x + next) / 2 / {PER_LON} AS lon, 54 + y / {PER_LAT} AS lat, (next - x) / {PER_LON} AS width FROM met WHERE n % 2 = 1 QUALIFY row_number() OVER (PARTITION BY tag ORDER BY next - x DESC, y, x) = 1
""")
def inside_points(spark: SparkSession, d: str) -> DataFrame:
    """GEO17: the middle of the widest stretch inside each segment's area."""
    return areas.inside_points(areas.dissolved(*_grid(spark, d)), "tag")


def spots(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a point, for some an outline point, and for some a level."""
    k = F.col("o_orderkey")
    at = lambda x, y: [((x / PER_LON) + 8), ((y / PER_LAT) + 54)]
    px, py = (k * 37 % 688) / 16 - 1.5, (k * 101 % 640) / 16 - 1
    (lon, lat), (lon2, lat2) = at(px, py), at(px + 1.5, py + 1)
    level = F.when(k % 11 == 0, 6).when(k % 11 == 1, 8)
    return table(spark, d, "orders").select("o_orderkey", lon.alias("lon"), lat.alias("lat"), F.when(k % 3 == 0, lon2).alias("lon2"), F.when(k % 3 == 0, lat2).alias("lat2"), level.alias("admin_level"))


@query(f"""
{_SQL}, size AS (SELECT root, count(*) - count(*) FILTER (holed) / 4.0::DOUBLE AS size FROM piece JOIN cells USING (k) GROUP BY root),
o AS (SELECT o_orderkey, (o_orderkey * 37 % 688) / 16.0::DOUBLE - 1.5 AS px, (o_orderkey * 101 % 640) / 16.0::DOUBLE - 1 AS py, o_orderkey % 11 = 0 AS above, o_orderkey % 3 = 0 AS outlined FROM orders),
points AS (SELECT o_orderkey, 1 AS which, px, py FROM o WHERE NOT above UNION ALL SELECT o_orderkey, 2, px + 1.5, py + 1 FROM o WHERE NOT above AND outlined),
hit AS (SELECT o_orderkey, which, tag, size FROM points JOIN cells ON px BETWEEN x AND x + 1 AND py BETWEEN y AND y + 1 AND NOT (holed AND px > x + 0.25 AND px < x + 0.75 AND py > y + 0.25 AND py < y + 0.75) JOIN piece USING (k) JOIN size USING (root)),
best AS (SELECT o_orderkey, tag FROM hit QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY which, size, tag) = 1)
SELECT o_orderkey, tag FROM o LEFT JOIN best USING (o_orderkey)
""")
def area_cells(spark: SparkSession, d: str) -> DataFrame:
    """JN10, JN11, SRC27: the smallest area around each order's point, else around its outline point, edges included and holes not, by cells; none above municipality level."""
    return covering.variety_of(spots(spark, d), areas.dissolved(*_grid(spark, d)), ["o_orderkey"]).select("o_orderkey", "tag")
